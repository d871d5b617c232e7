import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest_llm import odd_texts
from quarry.llm import records
from tokenizers import Tokenizer

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
LIBRARY.encode_special_tokens = True


def ids_of(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0]


def checked(got, rows):
    """Fails unless what was read is the rows, in ascending order, end to end."""
    want = sorted(((i is not None, i or 0, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ((i, ids_of(t)) for i, t in rows)))
    at, own = 0, sorted(got, key=lambda r: r.start)
    assert sorted((r.id is not None, r.id or 0, r.n_tokens, r.ids_crc32) for r in own) == want
    assert [(r.id is not None, r.id or 0) for r in own] == [w[:2] for w in want]
    for r in own:
        assert r.start == at
        at += r.n_tokens


@pytest.mark.parametrize("size", [1 << 25, 20_000])
def test_write_and_read(odd, tmp_path, size):
    manifest = records.write(odd, str(tmp_path), file_bytes=size)
    checked(records.read(manifest).collect(), odd_texts())
    assert manifest.count() >= (1 if size > 1 << 20 else 4)


def test_offsets(odd, tmp_path):
    for r in records.write(odd, str(tmp_path), file_bytes=50_000).collect():
        places = np.fromfile(r.path.removesuffix(".rec") + ".idx", "<u8")
        assert len(places) == r.n_records
        for k in np.random.default_rng(1).permutation(r.n_records)[:5]:
            key, ids = records.open_record(r.path, int(k), r.width)
            assert ids[-1] == 0 and any(i == key and ids_of(t) == ids.tolist() for i, t in odd_texts())


def test_empty(empty, tmp_path):
    manifest = records.write(empty, str(tmp_path))
    assert manifest.collect() == [] and records.read(manifest).collect() == []


def test_damage_is_found(odd, tmp_path):
    manifest = records.write(odd, str(tmp_path))
    path = manifest.first().path
    data = bytearray(open(path, "rb").read())
    data[len(data) // 2] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(Exception, match="damaged"):
        records.read(manifest).collect()


def test_frame():
    import io

    framed = records.frame(b"payload")
    assert len(framed) == 8 + 4 + 7 + 4 and records.unframe(io.BytesIO(framed).read) == b"payload" and records.unframe(io.BytesIO(b"").read) is None
    c = zlib.crc32(b"payload")
    assert int.from_bytes(framed[-4:], "little") == ((c >> 15 | c << 17) + 0xA282EAD8) % (1 << 32)


def test_special_strings_are_text():
    encoding = records.encoding(records.default_path())
    texts = ["<|endoftext|>", "a <|endoftext|> b"]
    assert [x.tolist() for x in encoding(texts)] == [ids_of(t)[:-1] for t in texts] and all(50256 not in x for x in encoding(texts))


def test_a_tokenizer_of_another_kind():
    encoding = records.Encoding(public_tokenizers.path("word_bpe_49k.json"))
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.encode_special_tokens = True
    texts = ["Some Words here", "", "and <|endoftext|> more"]
    assert not encoding.by_piece and [x.tolist() for x in encoding(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_shuffled(odd, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "OPEN", 2)
    monkeypatch.setattr(records, "DEALT", 40)
    manifest = records.write(odd, str(tmp_path), file_bytes=20_000)
    rows = sorted(records.shuffled(manifest, 1).collect())
    assert [r.place for r in rows] == list(range(len(odd_texts())))
    want = sorted(((i, ids_of(t)) for i, t in odd_texts()), key=repr)
    assert sorted(((r.id, r.ids) for r in rows), key=repr) == want
    again, other = (sorted(records.shuffled(manifest, k).collect()) for k in (1, 2))
    assert again == rows and [r.ids for r in other] != [r.ids for r in rows]
    assert len({r.id for r in rows[:40]} - {None}) > 20  # of many files


def test_shuffled_nothing(empty, tmp_path):
    assert records.shuffled(records.write(empty, str(tmp_path))).collect() == []


def test_ids_must_be_whole_numbers(spark, tmp_path):
    with pytest.raises(TypeError, match="whole numbers"):
        records.write(spark.createDataFrame([("a", "b")], "doc_id string, text string"), str(tmp_path))
