"""The engine's own queries by name, over the driver's tables, and the SQL that each must agree with.

Go sources are made in the queries, from the rows of ``part``; what their streams must be is written
out in SQL from the scheme, not computed by the tokenizer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text, vocab
from quarry.functions.shared import shared_path, written
from quarry.operators import acquire, metrics, pack, tokenize
from quarry.plans import acquire as acquisition
from quarry.plans import constructs, prepare
from quarry.sources import config, files, github, replay
from quarry.streaming import incremental

BLOCK = 64
#: Tags whose nesting the page queries follow.
TAGS = ("html", "head", "body", "title", "style", "script", "nav", "ul", "li", "a", "div", "article", "h1", "h2", "p", "b", "table", "tr", "td", "footer")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- Go sources from part ---
def go_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p_partkey, path, content: a source for each part, one of five kinds, by its size."""
    part, size = _table(spark, sf_dir, "part"), F.col("p_size")
    n = size % 7

    def times(s: str, count: Column) -> Column:
        return F.repeat(F.lit(s), count.cast("int"))

    nested = F.concat(F.lit("package p\nfunc F(a int) int {\n"), times("if a > 0 {\n", n), F.lit("a++\n"), times("}\n", n), F.lit("return a\n}\n"))
    struct = F.concat(F.lit("package p\ntype S struct {\n"), times("_ string\n", n + 1), F.lit("}\n"))
    fresh = F.concat(F.lit("package p\nfunc F() {\n"), times("x := 1\n", n + 60), F.lit("}\n"))
    wrong = F.concat(F.lit("package p\nfunc F( {\n"), times("x := 1\n", n))
    chain = F.concat(F.lit("package p\nvar v = 1"), times(" + 1", n), F.lit("\n"))
    kind = size % 5
    content = F.when(kind == 0, nested).when(kind == 1, struct).when(kind == 2, fresh).when(kind == 3, wrong).otherwise(chain)
    return tokenize.spread(part.select("p_partkey", F.concat(F.lit("src/"), F.col("p_partkey").cast("string"), F.lit(".go")).alias("path"), content.alias("content")))


#: p_partkey, path and tokens, joined by spaces; null for sources that are refused.
GO_EXPECTED = """
go AS (
  SELECT p_partkey, 'src/' || p_partkey || '.go' AS path, CASE p_size % 5
    WHEN 0 THEN 'BOS OPEN_FUNC_DECL NAME_0 OPEN_FUNC_TYPE OPEN_PARAMS OPEN_FIELD NAME_1 T_INT CLOSE_FIELD CLOSE_PARAMS OPEN_RESULTS OPEN_FIELD T_INT CLOSE_FIELD CLOSE_RESULTS CLOSE_FUNC_TYPE OPEN_BLOCK'
      || repeat(' OPEN_IF OPEN_BINOP NAME_1 OP_GTR INT_LIT CLOSE_BINOP OPEN_BLOCK', p_size % 7) || ' OPEN_INCDEC NAME_1 OP_INC CLOSE_INCDEC'
      || repeat(' CLOSE_BLOCK CLOSE_IF', p_size % 7) || ' OPEN_RETURN NAME_1 CLOSE_RETURN CLOSE_BLOCK CLOSE_FUNC_DECL EOF'
    WHEN 1 THEN 'BOS OPEN_TYPE_DECL OPEN_TYPE_SPEC NAME_0 OPEN_STRUCT_TYPE' || repeat(' OPEN_FIELD FIELD_0 T_STRING CLOSE_FIELD', p_size % 7 + 1) || ' CLOSE_STRUCT_TYPE CLOSE_TYPE_SPEC CLOSE_TYPE_DECL EOF'
    WHEN 2 THEN 'BOS OPEN_FUNC_DECL NAME_0 OPEN_FUNC_TYPE OPEN_PARAMS CLOSE_PARAMS CLOSE_FUNC_TYPE OPEN_BLOCK'
      || array_to_string(list_transform(range(1, p_size % 7 + 61), lambda i: ' OPEN_ASSIGN ' || CASE WHEN i < 64 THEN 'NAME_' || i ELSE 'NAME_OVF' END || ' OP_DEFINE INT_LIT CLOSE_ASSIGN'), '')
      || ' CLOSE_BLOCK CLOSE_FUNC_DECL EOF'
    WHEN 3 THEN NULL
    ELSE 'BOS OPEN_VAR_DECL OPEN_VALUE_SPEC NAME_0' || repeat(' OPEN_BINOP', p_size % 7) || ' INT_LIT' || repeat(' OP_ADD INT_LIT CLOSE_BINOP', p_size % 7) || ' CLOSE_VALUE_SPEC CLOSE_VAR_DECL EOF'
  END AS tokens FROM part
), files AS (
  SELECT *, len(string_split(tokens, ' ')) AS n, CASE WHEN ('0x' || substr(md5('0:' || path), 1, 8))::BIGINT < 214748364 THEN 'val' ELSE 'train' END AS split,
         md5('0:' || path) AS k FROM go WHERE tokens IS NOT NULL
)"""


def go_tokens_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tokenize.tokenized(go_sources(spark, sf_dir))
    return found.select("p_partkey", F.col("error").isNull().alias("ok"), F.array_join("tokens", " ").alias("tokens"), F.coalesce(F.size("tokens"), F.lit(0)).cast("long").alias("n_tokens"))


def go_constructs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every construct of the language in a file of its own, by the part's key; blank lines and
    comments, as many as the part's size says, change nothing."""
    sources = constructs.files()
    made = spark.createDataFrame([(k, code) for k, (code, _) in enumerate(sources)], "construct int, code string")
    part = _table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % len(sources)).cast("int").alias("construct"), F.repeat(F.lit("\n// a note {\n"), (F.col("p_size") % 3).cast("int")).alias("note"))
    own = part.join(F.broadcast(made), "construct").select("p_partkey", "construct", F.concat("note", "code", "note").alias("content"))
    return tokenize.tokenized(tokenize.spread(own)).select("p_partkey", "construct", F.array_join("tokens", " ").alias("tokens"))


def go_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tokenize.accepted(tokenize.tokenized_ids(go_sources(spark, sf_dir)))
    return metrics.with_balance(found).select("p_partkey", F.array_join("ids", ",").alias("ids"), F.round("balance", 6).alias("balance"), "strict")


def go_token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.packed(go_sources(spark, sf_dir).drop("p_partkey")).totals


def go_pack_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.packed(go_sources(spark, sf_dir).drop("p_partkey")).packed.select("path", "split", "start", "n")


def go_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.packed(go_sources(spark, sf_dir).drop("p_partkey")).quarantine.select("path", F.col("error").startswith("2:").alias("at_line_2"))


def go_vocab_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of a tokenizer that has drifted: each file has one more, that the vocabulary lacks."""
    found = tokenize.accepted(tokenize.tokenized(go_sources(spark, sf_dir).withColumn("new", F.concat(F.lit("OP_NEW_"), (F.col("p_partkey") % 3).cast("string")))))
    return tokenize.unknown_tokens(found.withColumn("tokens", F.array_append("tokens", F.col("new"))))


def go_bin_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both splits written as raw numbers and read again."""
    packed = written(prepare.packed(go_sources(spark, sf_dir).drop("p_partkey")).packed, "packed")
    out = None
    for split in ("train", "val"):
        parts = written(pack.write_bin(packed.filter(F.col("split") == split), shared_path(spark, f"{split}-bin")), "parts")
        own = pack.read_bin(parts, 64).select(F.lit(split).alias("split"), "block", F.array_join("ids", ",").alias("ids"))
        out = own if out is None else out.unionByName(own)
    return out


def token_line_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the files that token lines are written to: each token, and how often it stands there."""
    path = shared_path(spark, "token-lines")
    tokenize.token_lines(tokenize.accepted(tokenize.tokenized(go_sources(spark, sf_dir))), path)
    return spark.read.text(path).groupBy(F.col("value").alias("token")).agg(F.count("*").alias("n"))


def token_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs of a tokenizer, with blanks, blank lines, what precedes the first stream and unknown
    tokens, as streams of ids."""
    part, n = _table(spark, sf_dir, "part"), (F.col("p_size") % 4).cast("int")
    output = F.concat(F.lit("EOF\n\n OP_SUB\r\n"), F.repeat(F.lit("BOS\n  OP_ADD \n\n\tNAME_3\nEOF\n"), n), F.lit("BOS\nX_"), F.col("p_size").cast("string"), F.lit("\nFIELD_63\n"))
    found = tokenize.streams_of_lines(part.select("p_partkey", output.alias("output")))
    return found.select("p_partkey", "stream", F.array_join("ids", ",").alias("ids"), F.array_join("unknown", ",").alias("unknown"))


# --- vocabulary ---
def vocab_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.table(spark)


def vocab_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.pairs(spark)


def vocab_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.duplicates(_table(spark, sf_dir, "part").select(F.col("p_name").alias("token")))


def vocab_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([("view",), ("click",), ("purchase",)], "event_type string")
    return _table(spark, sf_dir, "events").select("event_type").distinct().join(known, "event_type", "left_anti")


# --- acquisition ---
def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as listed files: a quarter .go, a quarter .GO, the rest otherwise or without a dot."""
    docs, k = _table(spark, sf_dir, "documents"), F.col("doc_id") % 4
    name = F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.when(k == 0, ".go").when(k == 1, ".x.GO").when(k == 2, ".py").otherwise(""))
    return docs.select("doc_id", name.alias("name"), F.when(F.col("doc_id") % 5 == 0, None).otherwise(F.col("n_chars")).alias("size"),
                       F.when(F.col("doc_id") % 11 == 0, "").otherwise(F.concat(F.lit("u/"), F.col("source"))).alias("download_url"))


def size_ext_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(spark, sf_dir).filter(text.wanted(F.col("name"), F.col("size"), F.col("download_url"), max_bytes=5000)).select("doc_id", "name", text.extension(F.col("name")).alias("extension"))


def _host(url: Column) -> Column:
    return F.regexp_extract(url, "//([^/]*)", 1)


def seen_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts in order of their first page; those of French pages were seen before."""
    pages = _table(spark, sf_dir, "pages").select("page_id", _host(F.col("url")).alias("full_name"), "url")
    seen = pages.filter(F.col("url").contains("/fr/")).select("full_name").distinct()
    return acquire.new_repositories(pages, seen, ("page_id",)).select("page_id", "full_name")


def slug_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, url, k = _table(spark, sf_dir, "pages"), F.col("url"), F.col("page_id") % 5
    link = F.when(k == 0, F.concat(F.lit("<"), url, F.lit('>; rel="next", <z>; rel="last"'))).when(k == 1, F.concat(F.lit('<a>; rel="prev", <'), url, F.lit(">; rel=next"))) \
        .when(k == 2, F.concat(F.lit("<"), url, F.lit('>; rel="prev"'))).when(k == 3, F.concat(url, F.lit('; rel="next"'))).otherwise(F.lit(""))
    return pages.select("page_id", text.slug(_host(url)).alias("slug_host"), text.slug(F.regexp_extract(url, "//(.*)", 1)).alias("slug"), text.contents_root(F.concat(url, F.lit("/contents/{+path}"))).alias("root"), text.next_link(link).alias("next"))


def search_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", text.search_url("https://host", F.concat(F.lit("language:Go "), "p_name"), F.col("p_size")).alias("url"))


def repo_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search pages as JSON, a page a nation, whose items are its customers; parsed again."""
    rows = _table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("page"), F.struct(
        F.when(F.col("c_custkey") % 10 == 0, "").otherwise(F.concat(F.lit("o/"), "c_name")).alias("full_name"), F.concat(F.lit("h/"), "c_name", F.lit("/contents/{+path}")).alias("contents_url")).alias("item"))
    pages = rows.groupBy("page").agg(F.to_json(F.struct(F.collect_list("item").alias("items"))).alias("body"))
    return acquire.repositories(pages).select("page", "full_name", "slug", "contents_url")


def contents_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A host's pages as files, each in its language's folder and as many folders below it as its
    number says; listed level by level from the hosts. Some files have no path, which their name
    stands in for; the folders of one language are listed by one object, not a list."""
    n, lang = (F.col("page_id") % 6).cast("int"), F.split("url", "/")[3]
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", _host(F.col("url")).alias("host"), lang.alias("lang"), n.alias("n"))
    folders = F.transform(F.sequence(F.lit(0), F.col("n")), lambda k: F.concat_ws("/", "host", "lang", F.when(k > 0, F.array_join(F.transform(F.sequence(F.lit(1), k), lambda i: F.concat(F.lit("d"), i.cast("string"))), "/"))))
    placed = pages.withColumn("folders", folders)
    edges = placed.select(F.posexplode("folders").alias("k", "folder"), "folders", "host").select(F.when(F.col("k") == 0, F.col("host")).otherwise(F.get("folders", F.col("k") - 1)).alias("parent"), "folder").distinct()
    none, name = F.lit(None).cast("string"), F.concat(F.col("page_id").cast("string"), F.lit(".go"))
    entry = lambda type_, name, path, url, size, address: F.to_json(F.struct(F.lit(type_).alias("type"), name.alias("name"), path.alias("path"), url.alias("url"), size.alias("size"), address.alias("download_url")))
    folder = edges.select("parent", entry("dir", F.substring_index("folder", "/", -1), none, F.col("folder"), F.lit(None).cast("long"), none).alias("entry"))
    file = placed.select(F.element_at("folders", -1).alias("parent"), entry("file", name, F.when(F.col("page_id") % 7 > 0, F.concat_ws("/", "lang", name)), F.col("url"), F.col("page_id"), F.col("url")).alias("entry"))
    bodies = folder.unionByName(file).groupBy("parent").agg(F.collect_list("entry").alias("own"))
    body = F.when(F.size("own") == 1, F.get("own", F.lit(0))).otherwise(F.concat(F.lit("["), F.array_join("own", ","), F.lit(', "no object"]')))
    listing = written(bodies.select(F.col("parent").alias("url"), body.alias("body"), F.lit(None).cast("string").alias("error")), "listings")
    roots = pages.select(F.col("host").alias("slug"), F.col("host").alias("url")).distinct()
    found = acquire.expand(roots, lambda level: acquire.listed(level.join(listing, "url"), "slug"))
    return acquire.wanted_files(found, "out").select("slug", "depth", "save_path", "download_url")


def _replies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """Recorded replies of a service whose repositories are the suppliers, a search page a nation, and
    its address. Each repository has two files of Go in two folders, one too large and one of another
    kind; some listings, folders and files can't be had, and every fifth page is refused once."""
    host, key, none = "https://host", F.col("s_suppkey").cast("string"), F.create_map().cast("map<string,string>")
    own = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").alias("nation"))
    items = own.groupBy("nation").agg(F.to_json(F.struct(F.collect_list(F.struct(F.concat(F.lit("o/"), "s_name").alias("full_name"), F.concat(F.lit(f"{host}/c/"), key, F.lit("{+path}")).alias("contents_url"))).alias("items"))).alias("body"))
    every = spark.range(25).select(F.col("id").cast("int").alias("nation")).join(items, "nation", "left")
    page = F.concat(F.lit(f"{host}/search/repositories?q=language%3AGo&per_page=30&page="), (F.col("nation") + 1).cast("string"))
    link = F.create_map(F.lit("Link"), F.when(F.col("nation") < 24, '<x>; rel="next", <y>; rel="last"').otherwise('<x>; rel="first"'))
    refusal = F.create_map(F.lit("X-RateLimit-Remaining"), F.lit("0"), F.lit("X-RateLimit-Reset"), F.lit("100"))
    refused = F.col("nation") % 5 == 0
    row = lambda url, number, status, headers, body: [url.alias("url"), number.alias("number"), F.lit(status).alias("status"), headers.alias("headers"), body.alias("body")]
    parts = [
        every.filter(refused).select(*row(page, F.lit(0), 403, refusal, F.lit("slower"))),
        every.select(*row(page, refused.cast("int"), 200, link, F.coalesce("body", F.lit("{}")))),
        own.filter("s_suppkey % 7 <> 3").select(*row(F.concat(F.lit(f"{host}/c/"), key), F.lit(0), 200, none, F.concat(
            F.lit('[{"type":"dir","name":"sub","path":"sub","url":"https://host/d/'), key, F.lit('"},{"type":"file","name":"a.go","path":"a.go","size":9,"download_url":"https://host/r/a'), key,
            F.lit('"},{"type":"file","name":"big.go","path":"big.go","size":512001,"download_url":"u"},{"type":"file","name":"n.txt","path":"n.txt","download_url":"u"}]')))),
        own.select(*row(F.concat(F.lit(f"{host}/d/"), key), F.lit(0), 200, none, F.when(F.col("s_suppkey") % 11 == 4, "<html>").otherwise(F.concat(F.lit('{"type":"file","name":"z.go","path":"sub/z.go","download_url":"https://host/r/z'), key, F.lit('"}'))))),
        own.filter("s_suppkey % 10 <> 5").select(*row(F.concat(F.lit(f"{host}/r/a"), key), F.lit(0), 200, none, F.concat(F.lit("package a"), key))),
        own.select(*row(F.concat(F.lit(f"{host}/r/z"), key), F.lit(0), 200, none, F.concat(F.lit("package z"), key))),
        own.agg(F.count("*").alias("n")).select(*row(F.lit(f"{host}/rate_limit"), F.lit(0), 200, none, F.concat(F.lit('{"resources":{"core":{"remaining":'), F.col("n").cast("string"), F.lit(',"limit":5000},"search":{"remaining":9}}}')))),
    ]
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    folder = shared_path(spark, "replies")
    return written(replay.record(rows.withColumn("body", F.col("body").cast("binary")), folder), "recorded"), folder


def search_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty pages of a search at most, partitions of five pages side by side, from recorded replies."""
    _, folder = _replies(spark, sf_dir)
    pages = github.search(spark, "language:Go", base="https://host", maxPages=20, replies=folder)
    return acquire.repositories(pages).select("page", "full_name", "slug", "contents_url")


def acquire_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole acquisition from recorded replies: the files stored, what was lost, and the
    repositories that are marked as seen. The first of them were seen before."""
    _, folder = _replies(spark, sf_dir)
    out = shared_path(spark, "acquired")
    before = _table(spark, sf_dir, "supplier").filter("s_suppkey <= 3").select(F.concat(F.lit("o/"), "s_name").alias("full_name"))
    files.mark_seen(before, f"{out}/.seen-repos")
    lost = acquisition.run(spark, config.Acquire("language:Go", out, 25, concurrency=4), base="https://host", replies=folder)
    stored = spark.read.schema("path string, content binary, slug string").parquet(f"{out}/files")
    what = [
        stored.select(F.lit("stored").alias("kind"), F.concat_ws("/", "slug", "path").alias("name"), F.col("content").cast("string").alias("value")),
        lost.select(F.lit("lost").alias("kind"), F.col("url").alias("name"), F.substring("error", 1, 10).alias("value")),
        files.seen(spark, f"{out}/.seen-repos").select(F.lit("seen").alias("kind"), F.col("full_name").alias("name"), F.lit("").alias("value")),
    ]
    return what[0].unionByName(what[1]).unionByName(what[2])


def rate_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, folder = _replies(spark, sf_dir)
    found = github.rate_status(base="https://host", opened=github.opener(folder))
    return spark.createDataFrame([(k, *v) for k, v in found.items()], "quota string, remaining long, allowed long")


def request_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(t or "", *kv) for t in (None, "abc") for kv in github.headers(t).items()], "token string, name string, value string")


def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings read from arguments, over their defaults."""
    got = [("prepare", config.parsed(config.Prepare, ["--src", "a b", "--val-frac=0.5", "--seed", "1", "--seed", "7"])), ("sampling", config.parsed(config.Sampling, ["--verbose", "Yes", "--block_size", "8"]))]
    return spark.createDataFrame([(kind, k, str(v)) for kind, own in got for k, v in vars(own).items()], "kind string, name string, value string")


def _stored_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """Suppliers as files of their own below a folder, a subfolder a nation: path (below the folder)
    and bytes, written when read."""
    own, k = _table(spark, sf_dir, "supplier"), F.col("s_suppkey") % 4
    path = F.concat(F.col("s_suppkey").cast("string"), F.when(k == 0, ".go").when(k == 1, ".x.go").when(k == 2, ".GO").otherwise(".txt"))
    folder = shared_path(spark, "sources")
    rows = own.select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("slug"), path.alias("path"), F.repeat("s_name", (F.col("s_suppkey") % 9).cast("int")).alias("content"))
    return written(files.export_files(rows, folder), "exported"), folder


def scan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files stored one by one and scanned again: names that end in .go, up to a size, in order."""
    _, folder = _stored_files(spark, sf_dir)
    found = files.go_files(spark, folder, 100).select(F.substring_index("path", "/", -2).alias("path"), "length", F.md5("content").alias("md5"))
    return pack.running_total(found.withColumn("one", F.lit(1).cast("long")), "path", "one", "place").drop("one")


def listed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files read by name, from a list with blanks and blank lines; every fifth isn't there."""
    stored, folder = _stored_files(spark, sf_dir)
    names = stored.select(F.concat(F.lit("  "), "path", F.when(F.col("bytes") % 5 == 0, ".none").otherwise(""), F.lit(" \n\n \t")).alias("value"))
    path = shared_path(spark, "list")
    names.write.text(path)
    read = files.read_paths(files.listed_paths(spark, path))
    return read.select(F.substring_index("path", "/", -2).alias("path"), F.md5("content").alias("md5"), F.col("error").isNull().alias("ok"))


def seen_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list that names are appended to twice, some with blanks, some empty, some again."""
    own, path = _table(spark, sf_dir, "supplier"), shared_path(spark, "seen")
    files.mark_seen(own.select(F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.concat(F.lit(" "), "s_name")).alias("full_name")), path)
    files.mark_seen(own.filter("s_suppkey % 2 = 0").select(F.concat("s_name", F.lit("  ")).alias("full_name")), path)
    return files.seen(spark, path)


def error_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", text.excerpt(F.col("text")).alias("excerpt"))


def import_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("host/"), F.replace("p_name", F.lit(" "), F.lit("/")), F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("/v"), F.col("p_size").cast("string"))).otherwise(""), F.when(F.col("p_size") % 6 == 0, "/v2").otherwise(""))
    return _table(spark, sf_dir, "part").select("p_partkey", text.import_name(path).alias("name"))


# --- split and pack ---
def split_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", text.split(F.col("doc_id")).alias("split"), text.order_key(0, F.col("doc_id")).alias("order_key"))


def split_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.totals(_table(spark, sf_dir, "documents").select(text.split(F.col("doc_id")).alias("split"), F.col("n_chars").alias("n")))


def pack_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = pack.running_total(_table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", "end")
    return own.select("doc_id", (F.col("end") - F.col("n_chars")).alias("start"), "end")


def file_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in batches of 32, in shuffled order."""
    return pack.batched(_table(spark, sf_dir, "documents").select("doc_id"), 32, "doc_id")


def _word_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """start, ids: the lengths of the words of all conversations, in order of conversation and turn."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.transform(F.filter(F.split("text", r"\s+"), lambda w: w != ""), lambda w: F.length(w)).alias("ids"))
    turns = turns.withColumn("n", F.size("ids").cast("long"))
    return pack.running_total(turns, "conv_id", "n", "end", "turn").select((F.col("end") - F.col("n")).alias("start"), "ids")


_WORDS_SQL = """
w AS (
  SELECT conv_id, turn, unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS word, generate_subscripts(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''), 1) AS k FROM conversations
), s AS (SELECT row_number() OVER (ORDER BY conv_id, turn, k) - 1 AS pos, length(word) AS id FROM w)"""


def block_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack.training_blocks(_word_lengths(spark, sf_dir), BLOCK)
    return out.select("block", F.array_join("x", ",").alias("x"), F.array_join("y", ",").alias("y"))


def window_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = written(pack.blocks(_word_lengths(spark, sf_dir), BLOCK), "blocks")
    return pack.sampled_windows(own, BLOCK).select("number", "start", F.array_join("x", ",").alias("x"), F.array_join("y", ",").alias("y"))


def stream_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as a flat stream, in which a first turn begins a new one."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") == 0, "BOS").otherwise("TURN").alias("token"), (F.col("conv_id") * 1000 + F.col("turn")).alias("line"))
    return tokenize.streams(turns, "line").groupBy("stream_no").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))


# --- metrics ---
def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, tags: a page's tags in order, closing ones with their slash."""
    found = F.regexp_extract_all("html", F.lit(f"<(/?(?:{'|'.join(TAGS)}))[ >]"), F.lit(1))
    return _table(spark, sf_dir, "pages").select("page_id", found.alias("tags"))


_TAGS_SQL = f"""
t AS (SELECT page_id, regexp_extract_all(html, '<(/?(?:{"|".join(TAGS)}))[ >]', 1) AS tags FROM pages),
e AS (SELECT page_id, unnest(tags) AS tag, generate_subscripts(tags, 1) - 1 AS pos FROM t)"""


def html_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.with_balance(_tags(spark, sf_dir), "tags", {t: f"/{t}" for t in TAGS}).select("page_id", F.round("balance", 6).alias("balance"), "strict")


def html_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _tags(spark, sf_dir).filter(F.size("tags") > 0)
    own = found.withColumn("nesting", metrics.nesting(F.col("tags"), lambda t: F.when(t.startswith("/"), -1).otherwise(1)))
    return own.select("page_id", F.col("nesting.most").alias("max_depth"), F.size("tags").cast("long").alias("n_tags"), F.col("nesting.last").alias("end_depth"))


def first_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first list of each page: its tags, and its items."""
    own = _tags(spark, sf_dir).withColumn("own", metrics.first_subtree(F.col("tags"), "ul", "/ul")).filter(F.size("own") > 0)
    return own.select("page_id", F.size("own").cast("long").alias("n_tags"), F.size(F.filter("own", lambda t: t == "li")).cast("long").alias("n_items"))


def lr_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select("o_orderkey", F.round(metrics.learning_rate(F.col("o_orderkey")) * 1e4, 6).alias("lr_e4"))


def interval_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("step"), "value")
    return metrics.interval_means(own, "step", "value").select("interval", F.round("mean", 6).alias("mean"))


def interval_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("step"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return metrics.interval_latency(own, "step", "t").select("interval", F.round(F.col("latency") * 1e6, 1).alias("latency_us"))


def eval_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.mean_of_first(_table(spark, sf_dir, "events"), "event_id", "value").select(F.round("mean", 6).alias("mean"))


def topk_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    logits = F.transform("embedding", lambda x: F.floor(x.cast("double") * 100))
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.explode(metrics.top_k(logits, 40)).alias("e")).select("vec_id", "e.*")


def next_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step of generation from each vector as logits: temperature, the ten largest, one drawn."""
    u = text.hashed(9, F.col("vec_id")) / F.lit(2.0**32)
    return _table(spark, sf_dir, "embeddings").select("vec_id", metrics.next_token(F.col("embedding"), u, 0.05, 10).alias("token"))


def sample_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as a sequence of ids, of eight kinds of brackets and of names; its balance."""
    thousand = F.lit(1000).cast("float")  # the product is a float, as in the SQL; a double can be just below the same whole number
    ids = F.transform("embedding", lambda x: F.when(F.floor(F.abs(x) * thousand) % 5 == 0, 201).otherwise(101 + F.floor(F.abs(x) * thousand) % 8).cast("int"))
    own = _table(spark, sf_dir, "embeddings").select("vec_id", ids.alias("ids"))
    return metrics.with_balance(own).select("vec_id", F.round("balance", 6).alias("balance"), "strict")


def softmax_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = text.hashed(7, F.col("vec_id")) / F.lit(2.0**32)
    return _table(spark, sf_dir, "embeddings").select("vec_id", metrics.draw(metrics.softmax(F.col("embedding"), 0.5), u).alias("drawn"))


def xent_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _table(spark, sf_dir, "embeddings").select("label", metrics.cross_entropy(F.col("embedding"), F.col("label")).alias("loss"))
    return own.groupBy("label").agg(F.round(F.avg("loss"), 6).alias("loss"), F.count("*").alias("n"))


# --- streaming ---
def stream_new_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts taken once by a stream over the pages that is run twice."""
    path, out, checkpoint = f"{sf_dir}/pages.parquet", shared_path(spark, "hosts"), shared_path(spark, "stream")
    schema = spark.read.parquet(path).schema
    for _ in range(2):
        rows = spark.readStream.schema(schema).parquet(path if _folder(spark, path) else f"{path}*")
        incremental.new_names(rows.select(_host(F.col("url")).alias("host")), "host", out, checkpoint).awaitTermination()
    return spark.read.schema("host string").parquet(out)


def _folder(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.balance_by_file(prepare.packed(go_sources(spark, sf_dir).drop("p_partkey")))


QUERIES = (
    go_tokens_template, go_constructs, go_token_ids, go_token_totals, go_pack_offsets, go_quarantine, go_vocab_drift, go_bin_round_trip, token_line_files, token_lines,
    vocab_ids, vocab_pairs, vocab_duplicates, vocab_coverage,
    size_ext_filter, seen_anti, slug_link, search_url, repo_pages, contents_recursive, import_names,
    search_replay, acquire_replay, rate_status, request_headers, settings, scan_files, listed_files, seen_list, error_excerpt,
    split_hash, split_totals, pack_offsets, file_batches, block_cut, window_sample, stream_partition,
    html_balance, sample_balance, html_depth, first_list, lr_schedule, interval_mean, interval_latency, eval_mean, topk_ties, softmax_draw, next_token, xent_mean,
    stream_new_hosts,
)

_TOKENS_SQL = "SELECT unnest([" + ", ".join(f"'{t}'" for t in vocab.TOKENS) + f"]) AS token, unnest(range({len(vocab.TOKENS)})) AS i"
_CONSTRUCTS = ", ".join(f"({k}, '{tokens}')" for k, (_, tokens) in enumerate(constructs.files()))
_HOST = "regexp_extract(url, '//([^/]*)', 1)"

ORACLE = {
    "go_tokens_template": f"WITH {GO_EXPECTED} SELECT p_partkey, tokens IS NOT NULL AS ok, tokens, CAST(coalesce(len(string_split(tokens, ' ')), 0) AS BIGINT) AS n_tokens FROM go",
    "go_token_ids": f"WITH {GO_EXPECTED}, v AS ({_TOKENS_SQL}), e AS (SELECT p_partkey, unnest(string_split(tokens, ' ')) AS token, generate_subscripts(string_split(tokens, ' '), 1) AS k FROM files) SELECT p_partkey, string_agg(CAST(i AS VARCHAR), ',' ORDER BY k) AS ids, 1.0::DOUBLE AS balance, true AS strict FROM e JOIN v USING (token) GROUP BY p_partkey",
    "go_token_totals": f"WITH {GO_EXPECTED} SELECT split, count(*) AS files, CAST(sum(n) AS BIGINT) AS tokens FROM files GROUP BY split",
    "go_pack_offsets": f"WITH {GO_EXPECTED} SELECT path, split, CAST(sum(n) OVER (PARTITION BY split ORDER BY k, path) - n AS BIGINT) AS start, CAST(n AS BIGINT) AS n FROM files",
    "go_quarantine": f"WITH {GO_EXPECTED} SELECT path, true AS at_line_2 FROM go WHERE tokens IS NULL",
    "go_vocab_drift": f"WITH {GO_EXPECTED} SELECT 'OP_NEW_' || (p_partkey % 3) AS token, count(*) AS n FROM files GROUP BY 1",
    "go_constructs": f"WITH c(construct, tokens) AS (VALUES {_CONSTRUCTS}) SELECT p_partkey, CAST(construct AS INTEGER) AS construct, tokens FROM part JOIN c ON p_partkey % {len(constructs.files())} = construct",
    "token_line_files": f"WITH {GO_EXPECTED} SELECT token, count(*) AS n FROM (SELECT unnest(string_split(tokens, ' ')) AS token FROM files) GROUP BY token",
    "token_lines": "SELECT p_partkey, CAST(stream AS INTEGER) AS stream, CASE WHEN stream < p_size % 4 THEN '0,23,204,1' ELSE '0,328' END AS ids, CASE WHEN stream < p_size % 4 THEN '' ELSE 'X_' || p_size END AS unknown FROM (SELECT p_partkey, p_size, unnest(range(p_size % 4 + 1)) AS stream FROM part)",
    "go_bin_round_trip": f"WITH {GO_EXPECTED}, v AS ({_TOKENS_SQL}), e AS (SELECT split, k, path, unnest(string_split(tokens, ' ')) AS token, generate_subscripts(string_split(tokens, ' '), 1) AS j FROM files), s AS (SELECT split, row_number() OVER (PARTITION BY split ORDER BY k, path, j) - 1 AS pos, token FROM e) SELECT split, CAST(pos // 64 AS BIGINT) AS block, string_agg(CAST(i AS VARCHAR), ',' ORDER BY pos) AS ids FROM s JOIN v USING (token) GROUP BY 1, 2",
    "vocab_ids": f"SELECT CAST(i AS INTEGER) AS id, token FROM ({_TOKENS_SQL})",
    "vocab_pairs": "SELECT CAST(101 + 2 * k AS INTEGER) AS open_id, CAST(102 + 2 * k AS INTEGER) AS close_id FROM (SELECT unnest(range(50)) AS k)",
    "vocab_duplicates": "SELECT p_name AS token, count(*) AS count FROM part GROUP BY p_name HAVING count(*) > 1",
    "vocab_coverage": "SELECT DISTINCT event_type FROM events EXCEPT SELECT unnest(['view', 'click', 'purchase'])",
    "size_ext_filter": "SELECT doc_id, 'f' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.go' ELSE '.x.GO' END AS name, 'go' AS extension FROM documents WHERE doc_id % 4 < 2 AND (doc_id % 5 = 0 OR n_chars <= 5000) AND doc_id % 11 <> 0",
    "seen_anti": f"SELECT min(page_id) AS page_id, {_HOST} AS full_name FROM pages p WHERE NOT EXISTS (SELECT 1 FROM pages q WHERE q.url LIKE '%/fr/%' AND regexp_extract(q.url, '//([^/]*)', 1) = regexp_extract(p.url, '//([^/]*)', 1)) GROUP BY 2",
    "slug_link": f"SELECT page_id, replace({_HOST}, '/', '__') AS slug_host, replace(regexp_extract(url, '//(.*)', 1), '/', '__') AS slug, url || '/contents/' AS root, CASE WHEN page_id % 5 < 2 THEN url END AS next FROM pages",
    "search_url": "SELECT p_partkey, 'https://host/search/repositories?q=language%3AGo+' || replace(p_name, ' ', '+') || '&per_page=30&page=' || p_size AS url FROM part",
    "repo_pages": "SELECT c_nationkey AS page, 'o/' || c_name AS full_name, 'o__' || c_name AS slug, 'h/' || c_name || '/contents/' AS contents_url FROM customer WHERE c_custkey % 10 <> 0",
    "contents_recursive": f"""SELECT {_HOST} AS slug, CAST(page_id % 6 + 1 AS INTEGER) AS depth, 'out/' || {_HOST} || '/' || CASE WHEN page_id % 7 > 0 THEN string_split(url, '/')[4] || '/' ELSE '' END || page_id || '.go' AS save_path, url AS download_url FROM pages""",
    "search_replay": "SELECT s_nationkey + 1 AS page, 'o/' || s_name AS full_name, 'o__' || s_name AS slug, 'https://host/c/' || s_suppkey AS contents_url FROM supplier WHERE s_nationkey < 20",
    "acquire_replay": """WITH new AS (SELECT *, 'o__' || s_name AS slug FROM supplier WHERE s_suppkey > 3), listed AS (SELECT * FROM new WHERE s_suppkey % 7 <> 3)
        SELECT 'stored' AS kind, slug || '/a.go' AS name, 'package a' || s_suppkey AS value FROM listed WHERE s_suppkey % 10 <> 5
        UNION ALL SELECT 'stored', slug || '/sub/z.go', 'package z' || s_suppkey FROM listed WHERE s_suppkey % 11 <> 4
        UNION ALL SELECT 'lost', 'https://host/c/' || s_suppkey, 'status 404' FROM new WHERE s_suppkey % 7 = 3
        UNION ALL SELECT 'lost', 'https://host/d/' || s_suppkey, 'the listin' FROM listed WHERE s_suppkey % 11 = 4
        UNION ALL SELECT 'lost', 'https://host/r/a' || s_suppkey, 'status 404' FROM listed WHERE s_suppkey % 10 = 5
        UNION ALL SELECT 'seen', 'o/' || s_name, '' FROM supplier WHERE s_suppkey <= 3 OR s_suppkey % 7 <> 3 AND s_suppkey % 11 <> 4""",
    "rate_status": "SELECT 'core' AS quota, count(*) AS remaining, CAST(5000 AS BIGINT) AS allowed FROM supplier UNION ALL SELECT 'search', 9, NULL",
    "request_headers": "SELECT token, unnest(['Accept', 'User-Agent', 'X-GitHub-Api-Version']) AS name, unnest(['application/vnd.github+json', 'quarry', '2022-11-28']) AS value FROM (SELECT unnest(['', 'abc']) AS token) UNION ALL SELECT 'abc', 'Authorization', 'Bearer abc'",
    "settings": """SELECT * FROM (VALUES ('prepare', 'src', 'a b'), ('prepare', 'dst', 'data'), ('prepare', 'val_frac', '0.5'), ('prepare', 'seed', '7'), ('prepare', 'batch', '32'), ('prepare', 'max_file_bytes', '512000'),
        ('sampling', 'block_size', '8'), ('sampling', 'epoch_windows', '0'), ('sampling', 'max_steps', '20000'), ('sampling', 'warmup_steps', '200'), ('sampling', 'lr', '0.0003'), ('sampling', 'min_lr', '3e-05'), ('sampling', 'eval_iters', '20'),
        ('sampling', 'log_interval', '10'), ('sampling', 'top_k', '40'), ('sampling', 'seed', '0'), ('sampling', 'verbose', 'True')) AS t(kind, name, value)""",
    "scan_files": """WITH f AS (SELECT 'n' || s_nationkey || '/' || s_suppkey || CASE s_suppkey % 4 WHEN 0 THEN '.go' ELSE '.x.go' END AS path, repeat(s_name, CAST(s_suppkey % 9 AS INTEGER)) AS c FROM supplier WHERE s_suppkey % 4 < 2)
        SELECT path, CAST(length(c) AS BIGINT) AS length, md5(c) AS md5, row_number() OVER (ORDER BY path) AS place FROM f WHERE length(c) BETWEEN 1 AND 100""",
    "listed_files": """WITH f AS (SELECT 'n' || s_nationkey || '/' || s_suppkey || CASE s_suppkey % 4 WHEN 0 THEN '.go' WHEN 1 THEN '.x.go' WHEN 2 THEN '.GO' ELSE '.txt' END AS path, repeat(s_name, CAST(s_suppkey % 9 AS INTEGER)) AS c FROM supplier)
        SELECT path || CASE WHEN length(c) % 5 = 0 THEN '.none' ELSE '' END AS path, CASE WHEN length(c) % 5 > 0 THEN md5(c) END AS md5, length(c) % 5 > 0 AS ok FROM f""",
    "seen_list": "SELECT s_name AS full_name FROM supplier WHERE s_suppkey % 3 <> 0 OR s_suppkey % 2 = 0",
    "error_excerpt": "SELECT doc_id, substr(text, 1, 200) AS excerpt FROM documents",
    "file_batches": "SELECT doc_id, CAST((row_number() OVER (ORDER BY md5('0:' || doc_id), doc_id) - 1) // 32 AS BIGINT) AS batch FROM documents",
    "next_token": "WITH e AS (SELECT vec_id, ('0x' || substr(md5('9:' || vec_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), k AS (SELECT vec_id, u, i, x / 0.05 AS x FROM e QUALIFY rank() OVER (PARTITION BY vec_id ORDER BY x DESC) <= 10), p AS (SELECT vec_id, u, i, exp(x - max(x) OVER (PARTITION BY vec_id)) AS p FROM k), c AS (SELECT vec_id, u, i, sum(p) OVER (PARTITION BY vec_id ORDER BY i) / sum(p) OVER (PARTITION BY vec_id) AS c FROM p) SELECT vec_id, CAST(coalesce(min(i) FILTER (c > u), max(i)) AS INTEGER) AS token FROM c GROUP BY vec_id",
    "sample_balance": """WITH RECURSIVE e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS pos, CAST(floor(abs(unnest(embedding)) * 1000) AS BIGINT) AS v FROM embeddings), t AS (SELECT vec_id, pos, CASE WHEN v % 5 = 0 THEN -1 ELSE v % 8 END AS kind FROM e), f AS (
        SELECT DISTINCT vec_id, 0::BIGINT AS pos, []::BIGINT[] AS stack, 0 AS ok, 0 AS total, false AS bad FROM t
        UNION ALL
        SELECT f.vec_id, f.pos + 1, CASE WHEN kind < 0 THEN stack WHEN kind % 2 = 1 THEN stack[:len(stack) - 1] ELSE list_append(stack, kind + 1) END,
               ok + CASE WHEN kind % 2 = 1 AND stack[-1] = kind THEN 1 ELSE 0 END, total + CASE WHEN kind >= 0 AND kind % 2 = 0 THEN 1 ELSE 0 END, bad OR (kind >= 0 AND kind % 2 = 1 AND (len(stack) = 0 OR stack[-1] <> kind))
        FROM f JOIN t ON f.vec_id = t.vec_id AND f.pos = t.pos)
        SELECT vec_id, round(CASE WHEN total = 0 THEN 1.0 ELSE ok / total END, 6)::DOUBLE AS balance, NOT bad AND len(stack) = 0 AS strict FROM f QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY pos DESC) = 1""",
    "import_names": "SELECT p_partkey, string_split(p_name, ' ')[-1] AS name FROM part",
    "split_hash": "SELECT doc_id, CASE WHEN ('0x' || substr(md5('0:' || doc_id), 1, 8))::BIGINT < 214748364 THEN 'val' ELSE 'train' END AS split, md5('0:' || doc_id) AS order_key FROM documents",
    "split_totals": "SELECT CASE WHEN ('0x' || substr(md5('0:' || doc_id), 1, 8))::BIGINT < 214748364 THEN 'val' ELSE 'train' END AS split, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS tokens FROM documents WHERE n_chars > 0 GROUP BY 1",
    "pack_offsets": "SELECT doc_id, CAST(sum(n_chars) OVER w - n_chars AS BIGINT) AS start, CAST(sum(n_chars) OVER w AS BIGINT) AS \"end\" FROM documents WINDOW w AS (ORDER BY doc_id)",
    "block_cut": f"WITH {_WORDS_SQL}, n AS (SELECT pos, id, lead(id) OVER (ORDER BY pos) AS y FROM s) SELECT CAST(pos // {BLOCK} AS BIGINT) AS block, string_agg(CAST(id AS VARCHAR), ',' ORDER BY pos) AS x, string_agg(CAST(y AS VARCHAR), ',' ORDER BY pos) AS y FROM n GROUP BY 1 HAVING count(y) = {BLOCK}",
    "window_sample": f"WITH {_WORDS_SQL}, a AS (SELECT list(id ORDER BY pos) AS ids, count(*) AS n FROM s), d AS (SELECT ids, unnest(range(n // {BLOCK})) AS number, n FROM a), e AS (SELECT ids, number, ('0x' || substr(md5('0:' || number), 1, 8))::BIGINT % (n - {BLOCK} - 1) AS start FROM d) SELECT number, start, array_to_string(ids[start + 1:start + {BLOCK}], ',') AS x, array_to_string(ids[start + 2:start + {BLOCK} + 1], ',') AS y FROM e",
    "stream_partition": "WITH s AS (SELECT conv_id, CAST(sum(CASE WHEN turn = 0 THEN 1 ELSE 0 END) OVER (ORDER BY conv_id, turn) AS BIGINT) AS stream_no FROM conversations) SELECT stream_no, count(*) AS n, min(conv_id) AS conv_id FROM s WHERE stream_no > 0 GROUP BY stream_no",
    "html_balance": f"""WITH RECURSIVE {_TAGS_SQL}, f AS (
        SELECT page_id, 0::BIGINT AS pos, []::VARCHAR[] AS stack, 0 AS ok, 0 AS total, false AS bad FROM t
        UNION ALL
        SELECT f.page_id, f.pos + 1, CASE WHEN tag[1] = '/' THEN stack[:len(stack) - 1] ELSE list_append(stack, '/' || tag) END,
               ok + CASE WHEN tag[1] = '/' AND stack[-1] = tag THEN 1 ELSE 0 END, total + CASE WHEN tag[1] = '/' THEN 0 ELSE 1 END,
               bad OR (tag[1] = '/' AND (len(stack) = 0 OR stack[-1] <> tag))
        FROM f JOIN e ON f.page_id = e.page_id AND f.pos = e.pos)
        SELECT page_id, round(CASE WHEN total = 0 THEN 1.0 ELSE ok / total END, 6)::DOUBLE AS balance, NOT bad AND len(stack) = 0 AS strict FROM f QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos DESC) = 1""",
    "html_depth": f"WITH {_TAGS_SQL}, d AS (SELECT page_id, CASE WHEN tag[1] = '/' THEN -1 ELSE 1 END AS c, CAST(sum(CASE WHEN tag[1] = '/' THEN -1 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY pos) AS BIGINT) AS depth FROM e) SELECT page_id, max(depth) AS max_depth, count(*) AS n_tags, CAST(sum(c) AS BIGINT) AS end_depth FROM d GROUP BY page_id",
    "first_list": f"WITH {_TAGS_SQL}, a AS (SELECT page_id, min(pos) AS first FROM e WHERE tag = 'ul' GROUP BY page_id), d AS (SELECT e.page_id, pos, tag, sum(CASE tag WHEN 'ul' THEN 1 WHEN '/ul' THEN -1 ELSE 0 END) OVER (PARTITION BY e.page_id ORDER BY pos) AS depth FROM e JOIN a USING (page_id) WHERE pos >= first), z AS (SELECT page_id, min(pos) AS last FROM d WHERE depth = 0 GROUP BY page_id) SELECT page_id, count(*) AS n_tags, count(*) FILTER (tag = 'li') AS n_items FROM d LEFT JOIN z USING (page_id) WHERE last IS NULL OR pos <= last GROUP BY page_id",
    "lr_schedule": "SELECT o_orderkey, round(1e4 * CASE WHEN o_orderkey < 200 THEN 3e-4::DOUBLE * (o_orderkey + 1) / 200 WHEN o_orderkey >= 20000 THEN 3e-5::DOUBLE ELSE 3e-5::DOUBLE + 0.5 * (1 + cos(pi() * ((o_orderkey - 200) / 19800.0::DOUBLE))) * (3e-4::DOUBLE - 3e-5::DOUBLE) END, 6) AS lr_e4 FROM orders",
    "interval_mean": "SELECT CAST(event_id // 10 AS BIGINT) AS interval, round(avg(value), 6) AS mean FROM events GROUP BY 1 HAVING count(*) = 10",
    "interval_latency": "WITH i AS (SELECT CAST(event_id // 10 AS BIGINT) AS interval, count(*) AS n, max(epoch_us(ts)) AS t FROM events GROUP BY 1) SELECT a.interval, round((a.t - b.t) / 10, 1)::DOUBLE AS latency_us FROM i a JOIN i b ON a.interval = b.interval + 1 WHERE a.n = 10",
    "eval_mean": "SELECT round(coalesce(avg(value), 0.0), 6) AS mean FROM (SELECT value FROM events ORDER BY event_id LIMIT 20)",
    "topk_ties": "WITH e AS (SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS idx, CAST(floor(unnest(embedding)::DOUBLE * 100) AS BIGINT) AS logit FROM embeddings) SELECT * FROM (SELECT vec_id, idx, logit, CAST(rank() OVER (PARTITION BY vec_id ORDER BY logit DESC) AS INTEGER) AS rank FROM e) WHERE rank <= 40",
    "softmax_draw": "WITH e AS (SELECT vec_id, ('0x' || substr(md5('7:' || vec_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE / 0.5 AS x FROM embeddings), p AS (SELECT vec_id, u, i, exp(x - max(x) OVER (PARTITION BY vec_id)) AS p FROM e), c AS (SELECT vec_id, u, i, sum(p) OVER (PARTITION BY vec_id ORDER BY i) / sum(p) OVER (PARTITION BY vec_id) AS c FROM p) SELECT vec_id, CAST(coalesce(min(i) FILTER (c > u), max(i)) AS INTEGER) AS drawn FROM c GROUP BY vec_id",
    "xent_mean": "WITH e AS (SELECT vec_id, label, embedding[label + 1]::DOUBLE AS own, unnest(embedding)::DOUBLE AS x FROM embeddings), l AS (SELECT vec_id, label, ln(sum(exp(x))) - any_value(own) AS loss FROM e GROUP BY vec_id, label) SELECT label, round(avg(loss), 6) AS loss, count(*) AS n FROM l GROUP BY label",
    "stream_new_hosts": f"SELECT DISTINCT {_HOST} AS host FROM pages WHERE {_HOST} <> ''",
}


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
