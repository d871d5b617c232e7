import io
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import text, vocab
from quarry.functions.shared import settings
from quarry.operators import acquire as acquiring
from quarry.operators import metrics, pack, tokenize
from quarry.plans import acquire, prepare
from quarry.plans import tokenize as tokenizing
from quarry.sources import config, files, github, replay
from quarry.streaming import incremental

GOOD = "package p\nfunc F(a []int) int {\n\tif len(a) == 0 { return 0 }\n\treturn a[0]\n}\n"


@pytest.fixture
def tree(tmp_path):
    """A folder of sources: two good, one bad, one of another kind, one in capitals, one too long."""
    top = tmp_path / "src"
    (top / "r/sub").mkdir(parents=True)
    (top / "r/a.go").write_text(GOOD)
    (top / "r/sub/b.go").write_text("package q\n\nvar X = 1\n")
    (top / "r/bad.go").write_text("package p\nfunc {\n")
    (top / "r/c.py").write_text("x")
    (top / "r/D.GO").write_text("package d")
    (top / "r/long.go").write_text("package l\n" + "// filler\n" * 200)
    return top


def test_scan(spark, tree):
    found = files.go_files(spark, str(tree), 1000)
    assert sorted(r.path.rpartition("/")[2] for r in found.select("path").collect()) == ["a.go", "b.go", "bad.go"]
    plan = found.select("path", "length")._jdf.queryExecution().toString()
    assert "LessThanOrEqual(length,1000)" in plan


def test_listed_paths(spark, tree, tmp_path):
    (tmp_path / "list").write_text(f"  {tree}/r/a.go \n\n{tree}/r/none.go\n")
    rows = {r.path.rpartition("/")[2]: r for r in files.read_paths(files.listed_paths(spark, str(tmp_path / "list"))).collect()}
    assert bytes(rows["a.go"].content).decode() == GOOD and rows["a.go"].error is None
    assert rows["none.go"].content is None and rows["none.go"].error


def test_prepare(spark, tree, tmp_path):
    own = config.parsed(config.Prepare, ["--src", str(tree), "--dst", str(tmp_path / "out"), "--max-file-bytes", "1000", "--val-frac", "0.5"])
    found = prepare.run(spark, own)
    refused = found.quarantine.collect()
    assert [r.path.rpartition("/")[2] for r in refused] == ["bad.go"] and refused[0].error.startswith("2:")
    packed = found.packed.collect()
    assert sorted(r.path.rpartition("/")[2] for r in packed) == ["a.go", "b.go"]
    assert sum(r.tokens for r in found.totals.collect()) == sum(r.n for r in packed)
    for split in ("train", "val"):
        parts = spark.read.parquet(str(tmp_path / f"out/{split}.parts")).orderBy("part").collect()
        data = np.concatenate([np.zeros(0, "<u2"), *(np.fromfile(p.path.removeprefix("file:"), "<u2") for p in parts)])
        assert data.tolist() == [i for r in sorted((r for r in packed if r.split == split), key=lambda r: r.start) for i in r.ids]
    assert all(r.strict for r in prepare.balance_by_file(found).collect())


def test_nothing_accepted(spark, tmp_path):
    (tmp_path / "x.go").write_text("not go")
    with pytest.raises(RuntimeError):
        prepare.run(spark, config.Prepare(str(tmp_path), str(tmp_path / "out")))
    found = tokenize.tokenized(spark.createDataFrame([("a", None), ("b", "x")], "path string, content string"))
    assert {r.path: r.tokens for r in found.collect()} == {"a": None, "b": None}
    with pytest.raises(RuntimeError):
        tokenize.require_some(found)
    tokenize.require_some(found.limit(0))


def test_token_lines(spark, tmp_path):
    found = tokenize.tokenized(spark.createDataFrame([("a", "package p")], "path string, content string"))
    tokenize.token_lines(found, str(tmp_path / "t"))
    assert [r.value for r in spark.read.text(str(tmp_path / "t")).collect()] == ["BOS", "EOF"]


def test_deep_nesting(spark):
    deep = "package p\nvar x = " + "(" * 3000 + "1" + ")" * 3000
    wide = "package p\nvar x = 1" + " + 1" * 5000
    found = {r.path: r for r in tokenize.tokenized(spark.createDataFrame([("d", deep), ("w", wide)], "path string, content string")).collect()}
    assert found["d"].error is None and found["w"].error is None and found["w"].tokens.count("OP_ADD") == 5000


@pytest.mark.parametrize(("stream", "rate", "strict"), [
    ("O1 O2 C2 C1", 1.0, True), ("O1 O2 C1 C1", 0.5, False), ("O1 O1 C2 C1", 0.5, False), ("C1", 1.0, False), ("", 1.0, True), ("O1", 0.0, False), ("x O1 y C1", 1.0, True),
])
def test_balance(spark, stream, rate, strict):
    df = spark.createDataFrame([(stream.split(),)], "s array<string>")
    got = df.select(vocab.balance(F.col("s"), {"O1": "C1", "O2": "C2"}).alias("b")).first().b
    assert (got.rate, got.strict) == (rate, strict)


@pytest.mark.parametrize(("header", "want"), [
    ('<u1>; rel="next", <u2>; rel="last"', "u1"), ('<p>; rel="prev", <n>; rel=next', "n"), ('<p>; rel="prev"', None), ("", None), (None, None), ('u; rel="next"', None), ('<a>; rel="prev"; rel="next"', "a"), ('<a> ; title="x"; rel="next"', "a"),
])
def test_next_link(spark, header, want):
    assert spark.createDataFrame([(header,)], "h string").select(text.next_link(F.col("h")).alias("n")).first().n == want


def test_wanted(spark):
    rows = [("a.go", 10, "u"), ("a.GO", None, "u"), ("go", 1, "u"), ("a.go.py", 1, "u"), ("a.go", 512_000, "u"), ("a.go", 512_001, "u"), ("a.go", 0, ""), ("a.go", 0, None)]
    df = spark.createDataFrame(rows, "name string, size long, download_url string")
    got = df.select(text.wanted(F.col("name"), F.col("size"), F.col("download_url")).alias("w")).collect()
    assert [r.w for r in got] == [True, True, False, False, True, False, False, False]


def test_entries(spark):
    bodies = [('{"type":"file","name":"a.go"}',), ('[{"type":"dir","url":"u"}, 3, "x", {"type":"symlink"}]',), ("[]",)]
    got = acquiring.entries(spark.createDataFrame(bodies, "body string")).collect()
    assert sorted(str(r.type) for r in got) == ["dir", "file", "symlink"]


def test_unreadable_pages(spark):
    pages = spark.createDataFrame([(1, '{"items": []}'), (2, "{}"), (3, "<html>")], "page int, body string")
    assert acquiring.readable(pages.filter("page < 3")).count() == 2 and acquiring.repositories(pages).collect() == []
    with pytest.raises(ValueError, match="3"):
        acquiring.readable(pages)


def test_seen(spark, tmp_path):
    path = str(tmp_path / "seen")
    assert files.seen(spark, path).collect() == []
    files.mark_seen(spark.createDataFrame([("a/b",), ("c/d",)], "full_name string"), path)
    files.mark_seen(spark.createDataFrame([("a/b",)], "full_name string"), path)
    assert sorted(r.full_name for r in files.seen(spark, path).collect()) == ["a/b", "c/d"]


def test_rate_limit():
    waits, replies = [], [github.Reply(403, b"", {"X-RateLimit-Remaining": "0", "X-RateLimit-Reset": "130"}), github.Reply(200, b"{}", {"Link": "l"})]
    got = github.request("u", {}, lambda *_: replies.pop(0), lambda: 100, waits.append)
    assert got.body == b"{}" and got.headers["link"] == "l" and 31 <= waits[0] <= 35
    assert github.pause(github.Reply(429, b"", {"X-RateLimit-Remaining": "0", "X-RateLimit-Reset": "90"}), 100, lambda a, b: b) == 5
    for status, headers in ((403, {}), (429, {"X-RateLimit-Remaining": "0"}), (403, {"X-RateLimit-Remaining": "1", "X-RateLimit-Reset": "1"}), (500, {})):
        with pytest.raises(github.Refused, match=f"status {status}: x{{200}}$"):
            github.request("u", {}, lambda *_, s=status, h=headers: github.Reply(s, b"x" * 999, h))
    assert github.headers("t")["Authorization"] == "Bearer t" and "Authorization" not in github.headers()


@pytest.fixture
def api():
    """A server of two search pages, listings two folders deep, and files."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            own, at = f"http://127.0.0.1:{self.server.server_port}", urlparse(self.path)
            if at.path == "/search/repositories":
                page = int(parse_qs(at.query)["page"][0])
                names = {1: [f"o/r{k}" for k in range(30)], 2: ["o/r3", "o/last", ""]}.get(page, [])
                out = {"items": [{"full_name": n, "contents_url": f"{own}/c/{n}/{{+path}}"} for n in names]}
            elif at.path == "/rate_limit":
                out = {"resources": {"core": {"remaining": 9, "limit": 60}}}
            elif at.path.startswith("/c/o/r2/"):
                self.send_error(500)
                return
            elif at.path.startswith("/c/o/r4/"):
                out = [{"type": "file", "name": "latin.go", "path": "latin.go", "size": 9, "download_url": f"{own}/raw/latin"}]
            elif at.path.startswith("/c/o/r5/"):
                out = "<html>"
            elif at.path.startswith("/c/o/r1/"):
                out = [{"type": "dir", "url": f"{own}/sub"}, {"type": "file", "name": "a.go", "path": "a.go", "size": 9, "download_url": f"{own}/raw/a"}, {"type": "file", "name": "b.txt", "path": "b.txt", "download_url": f"{own}/raw/b"}]
            elif at.path == "/sub":
                out = [{"type": "dir", "url": f"{own}/sub"}, {"type": "file", "name": "z.go", "path": "s/z.go", "size": 9, "download_url": f"{own}/raw/z"}, {"type": "file", "name": "gone.go", "path": "gone.go", "download_url": f"{own}/gone"}]
            elif at.path.startswith("/c/"):
                out = []
            elif at.path.startswith("/raw/"):
                out = f"package {at.path[-1]}"
            else:
                self.send_error(404)
                return
            self.send_response(200)
            if at.query.endswith("page=1"):
                self.send_header("Link", f'<{own}/search/repositories?page=2>; rel="next"')
            self.end_headers()
            self.wfile.write("package l // caf\xe9".encode("latin-1") if at.path.endswith("latin") else (out if isinstance(out, str) else json.dumps(out)).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_acquire(spark, api, tmp_path, caplog):
    own = config.Acquire(output_dir=str(tmp_path / "out"), max_pages=4, concurrency=4)
    with caplog.at_level("INFO"):
        lost = acquire.run(spark, own, base=api).collect()
    assert "'core': (9, 60)" in caplog.text
    why = {(r.slug, r.path): r.error for r in lost}
    assert set(why) == {("o__r1", "gone.go"), ("o__r2", None), ("o__r5", None)}
    assert "404" in why["o__r1", "gone.go"] and "500" in why["o__r2", None] and "JSON" in why["o__r5", None]
    stored = spark.read.parquet(f"{own.output_dir}/files")
    content = {(r.slug, r.path): bytes(r.content) for r in stored.collect()}
    assert content == {("o__r1", "a.go"): b"package a", ("o__r1", "s/z.go"): b"package z", ("o__r4", "latin.go"): b"package l // caf\xe9"}
    known = {r.full_name for r in files.seen(spark, f"{own.output_dir}/.seen-repos").collect()}
    assert known == {f"o/r{k}" for k in range(30)} - {"o/r2", "o/r5"} | {"o/last"}
    assert {r.slug for r in acquire.run(spark, own, base=api).collect()} == {"o__r2", "o__r5"}  # tried again
    assert spark.read.parquet(f"{own.output_dir}/files").count() == 3
    out = files.export_files(stored, str(tmp_path / "tree")).collect()
    assert len(out) == 3 and (tmp_path / "tree/o__r1/s/z.go").read_text() == "package z"
    refused = {r.path: r.error for r in tokenize.tokenized(stored.select("path", "content")).collect()}
    assert "UTF-8" in refused["latin.go"] and refused["a.go"] is None


def test_faults_stop_no_other(spark, api):
    got = {r.url: r for r in github.fetch(spark.createDataFrame([(f"{api}/raw/a",), ("no address",), ("http://127.0.0.1:9/x",), (f"{api}/none",)], "url string"), concurrency=2).collect()}
    assert bytes(got[f"{api}/raw/a"].body) == b"package a" and got[f"{api}/none"].gone
    assert got["no address"].error.startswith("ValueError") and got["http://127.0.0.1:9/x"].error and not got["no address"].gone


def test_replay(spark, tmp_path):
    rows = [("u", 0, 403, {"X-RateLimit-Remaining": "0", "X-RateLimit-Reset": "1"}, b""), ("u", 1, 200, {"Link": "l"}, b"one"), ("v", 0, 500, None, b"no")]
    replay.record(spark.createDataFrame(rows, "url string, number int, status int, headers map<string,string>, body binary"), str(tmp_path)).collect()
    opened = replay.Recorded(str(tmp_path))
    assert github.request("u", {}, opened).body == github.request("u", {}, opened).body == b"one"
    assert opened("v", {}).status == 500 and opened("w", {}).status == 404


def test_command(spark, tree, tmp_path):
    def run(*args, stdin=()):
        out, err = io.StringIO(), io.StringIO()
        return tokenizing.run(spark, list(args), stdin, out, err), out.getvalue().split(), err.getvalue()

    code, out, err = run(f"{tree}/r/sub/b.go", f"{tree}/r/bad.go", f"{tree}/none.go", f"{tree}/r/long.go")
    assert code == 0 and out == "BOS OPEN_VAR_DECL OPEN_VALUE_SPEC NAME_0 INT_LIT CLOSE_VALUE_SPEC CLOSE_VAR_DECL EOF BOS EOF".split()
    assert f"skip {tree}/r/bad.go: 2:" in err and f"skip {tree}/none.go: " in err
    assert run(stdin=["x"])[0] == 2 and run(f"{tree}/r/bad.go")[0] == 1
    assert run("-", stdin=[f"  {tree}/r/long.go\n", "\n"])[:2] == (0, ["BOS", "EOF"])
    assert run("-", stdin=["\n"]) == (0, [], "")


def test_config(capsys):
    assert config.parsed(config.Sampling, ["--block-size", "8", "--verbose", "yes"]) == config.Sampling(block_size=8, verbose=True)
    assert config.parsed(config.Prepare, ["--val-frac=0.25", "--src", "--odd"]) == config.Prepare(val_frac=0.25, src="--odd")
    for wrong in (["--none", "1"], ["block-size", "1"], ["--seed"], ["--seed", "x"]):
        with pytest.raises(SystemExit) as e:
            config.parsed(config.Sampling, wrong)
        assert e.value.code == 2 and capsys.readouterr().err


def test_windows(spark):
    own = pack.blocks(spark.range(0, 100, 7).select(F.col("id").alias("start"), F.sequence("id", F.least(F.col("id") + 6, F.lit(99))).cast("array<int>").alias("ids")), 8).cache()
    rows = pack.sampled_windows(own, 8, seed=3).collect()
    assert len(rows) == 12
    for r in rows:
        assert list(r.x) == list(range(r.start, r.start + 8)) and list(r.y) == list(range(r.start + 1, r.start + 9)) and r.start < 91
    assert [tuple(r) for r in pack.sampled_windows(own, 8, seed=3).collect()] == [tuple(r) for r in rows]
    with pytest.raises(ValueError):
        pack.sampled_windows(own, 99)
    with pytest.raises(ValueError):
        pack.sampled_windows(own.limit(0), 2)


def test_running_total(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), int(n)) for i, n in zip(rng.permutation(3000) * 7 - 500, rng.integers(0, 9, 3000), strict=True)]
    got = {r.i: r.t for r in pack.running_total(spark.createDataFrame(rows, "i long, n long"), "i", "n", "t").collect()}
    total = 0
    for i, n in sorted(rows):
        total += n
        assert got[i] == total
    assert pack.running_total(spark.createDataFrame([], "i long, n long"), "i", "n", "t").collect() == []


def test_running_total_of_equal_values(spark):
    """A value that most rows have, and an outlier."""
    rows = [(5, 1)] * 2000 + [(k, 1) for k in range(5)] + [(10**15, 1)]
    got = pack.running_total(spark.createDataFrame(rows, "i long, n long").repartition(3), "i", "n", "t").collect()
    assert sorted(r.t for r in got) == list(range(1, 2007)) and [r.t for r in sorted(got, key=lambda r: r.t)][-1] == max(r.t for r in got if r.i == 10**15)


@pytest.mark.parametrize("size", [1, 3, 8, 40])
def test_blocks(spark, size):
    rng = np.random.default_rng(size)
    lengths, rows, at = rng.integers(0, 30, 40), [], 0
    for n in lengths.tolist():
        rows.append((at, list(range(at, at + n))))
        at += n
    packed = spark.createDataFrame(rows, "start long, ids array<int>").repartition(3)
    got = sorted((r.block, r.ids) for r in pack.blocks(packed, size).collect())
    assert got == [(b, list(range(b * size, min(at, (b + 1) * size)))) for b in range(-(-at // size))]
    pairs = sorted((r.block, r.x, r.y) for r in pack.training_blocks(packed, size).collect())
    assert pairs == [(b, list(range(b * size, (b + 1) * size)), list(range(b * size + 1, (b + 1) * size + 1))) for b in range((at - 1) // size)]


def test_settings_come_back(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with pytest.raises(RuntimeError), settings(spark, {name: "7"}):
        assert spark.conf.get(name) == "7"
        raise RuntimeError
    assert spark.conf.get(name) == before


def test_scopes(spark):
    from pathlib import Path

    from quarry.functions.shared import scope, written

    folder = lambda df: Path(df.inputFiles()[0].removeprefix("file:")).parent
    with scope(spark):
        own = written(spark.range(3), "own", outer=1)
        inner = folder(written(spark.range(3), "inner"))
        with scope(spark):
            far, near = written(spark.range(4), "far", outer=2), folder(written(spark.range(2), "near", outer=1))
        assert inner.exists() and near.exists()
    assert not inner.exists() and not near.exists() and own.count() == 3 and far.count() == 4


def test_no_window_over_everything(spark, sf_dir):
    from quarry.plans import registry

    plan = registry.pack_offsets(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SinglePartition") <= 3  # the ends, on both sides of the join, and the cells' totals


def test_top_k_and_draw(spark):
    df = spark.createDataFrame([([3.0, 1.0, 2.0, 2.0, 0.0],), ([1.0],), ([],)], "x array<double>")
    got = [[tuple(e) for e in r.t] for r in df.select(metrics.top_k(F.col("x"), 2).alias("t")).collect()]
    assert got == [[(0, 3.0, 1), (2, 2.0, 2), (3, 2.0, 2)], [(0, 1.0, 1)], []]
    df = spark.createDataFrame([([0.5, 0.25, 0.25], 0.49), ([0.5, 0.25, 0.25], 0.5), ([0.5, 0.25, 0.25], 1.0)], "p array<double>, u double")
    assert [r.d for r in df.select(metrics.draw(F.col("p"), F.col("u")).alias("d")).collect()] == [0, 1, 2]


def test_next_token(spark):
    rng = np.random.default_rng(3)
    rows = [(rng.normal(size=20).round(1).tolist(), float(rng.random())) for _ in range(50)]
    df = spark.createDataFrame(rows, "x array<double>, u double")
    got = df.select(metrics.next_token(F.col("x"), F.col("u"), 0.7, 5).alias("a"), metrics.next_token(F.col("x"), F.col("u")).alias("b"), metrics.next_token(F.col("x"), F.col("u"), 0.0, 1).alias("c")).collect()
    for (x, u), r in zip(rows, got, strict=True):
        x = np.array(x)
        kept = np.flatnonzero(x >= np.sort(x)[-5])
        for places, t, drawn in ((kept, 0.7, r.a), (np.arange(20), 1.0, r.b)):
            p = np.exp(x[places] / t - x[places].max() / t)
            assert drawn == places[min(np.searchsorted(np.cumsum(p / p.sum()), u, "right"), len(places) - 1)]
        assert x[r.c] == x.max()


def test_nesting_and_subtree(spark):
    df = spark.createDataFrame([("a ( b ( ) ) ( )".split(),), (") (".split(),), ([],), ("x".split(),), ("( ( )".split(),)], "s array<string>")
    change = lambda x: F.when(x == "(", 1).when(x == ")", -1).otherwise(0)
    got = df.select(metrics.nesting(F.col("s"), change).alias("n"), metrics.first_subtree(F.col("s"), "(", ")").alias("t")).collect()
    assert [tuple(r.n) for r in got] == [(2, 0), (0, 0), (None, None), (0, 0), (2, 1)]
    assert [" ".join(r.t) for r in got] == ["( b ( ) )", "(", "", "", "( ( )"]


def test_empty_losses(spark):
    assert metrics.mean_of_first(spark.createDataFrame([], "i int, v double"), "i", "v").first().mean == 0.0


def test_stream(spark, tree, tmp_path):
    out = [str(tmp_path / x) for x in ("ok", "bad", "check")]
    for _ in range(2):  # the second run has nothing new
        incremental.tokenized(incremental.go_stream(spark, str(tree)), *out).awaitTermination()
    assert spark.read.parquet(out[0]).count() == 3 and spark.read.parquet(out[1]).count() == 1
    (tree / "r/e.go").write_text("package e")
    incremental.tokenized(incremental.go_stream(spark, str(tree)), *out).awaitTermination()
    assert spark.read.parquet(out[0]).count() == 4


def test_nothing_imports_the_optional_package():
    from pathlib import Path

    for p in (Path(__file__).parent.parent / "quarry").rglob("*.py"):
        assert "quarry/llm" in str(p) or "quarry.llm" not in p.read_text()


def test_ids_are_the_tokens_ids(spark):
    df = spark.createDataFrame([("a", GOOD), ("b", "no"), ("c", None)], "path string, content string")
    one = {r.path: (r.ids, r.error) for r in tokenize.tokenized_ids(df).collect()}
    two = {r.path: (r.ids, r.error) for r in tokenize.encoded(tokenize.tokenized(df)).collect()}
    assert one["a"] == two["a"] and one["a"][0][0] == vocab.IDS["BOS"]
    assert one["b"][0] is None and one["b"][1] == two["b"][1] and one["c"] == (None, "no content")


def test_spread(spark):
    assert tokenize.spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
