"""Files: WARC archives, token planes."""

import io
import os
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from streamlanes.llm import token_planes as tp
from streamlanes.llm import warc
from streamlanes.llm.registry import vocabulary

PAGES = "page_id long, url string, html string, size int, digest string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], PAGES)  # extra columns with clashing names


def through(df):
    return warc.read_warc(warc.normalise_archives(warc.write_warc(df)), with_payload=True)


def test_archives_round_trip(spark):
    rows = [(1, "http://a/\r\nx", "héllo"), (2, None, "héllo"), (3, "http://b", None), (4, "http://c", ""), (5, "http://d", "x\r\n\r\nWARC/1.1\r\n" * 50_000), (None, "http://e", "héllo"), (None, None, "only null ids"), (7, "u", "same id"), (7, "u", "same id")]
    got = sorted((tuple(r) for r in through(pages(spark, rows)).collect()), key=lambda r: (r[0] or 0, r[6] or ""))
    by = {(r[0], r[1]): r for r in got}
    assert len(got) == len(rows)
    assert by[(1, 6)][3:5] == ("revisit", 2) and by[(2, 6)][3:5] == ("response", None) and by[(None, 6)][3:5] == ("revisit", 2)
    assert by[(3, 0)][3:5] == ("revisit", 4) and by[(4, 0)][3:5] == ("response", None)
    assert by[(None, 13)][3] == "response" and [r[3] for r in got if r[0] == 7] == ["response", "response"]
    assert by[(5, 15 * 50_000)][6] == rows[4][2] and by[(2, 6)][2] == by[(1, 6)][2] == warc.base32_sha1("héllo".encode())
    assert by[(1, 6)][5] == "http://a/%0D%0Ax"
    assert through(pages(spark, [])).count() == 0


def test_reader_keeps_no_payloads_it_does_not_return(tmp_path):
    import tracemalloc

    import pyarrow as pa

    page = ("<p>" + "word " * 20_000).encode()
    z, raws = zlib.compressobj(1, zlib.DEFLATED, 31), (warc.record(i, "http://x", page, warc.base32_sha1(page), len(page), None, "d") for i in range(1500))
    src, out = str(tmp_path / "a.warc.gz"), str(tmp_path / "b.warc.gz")
    with open(src, "wb") as f:
        for r in raws:
            f.write(z.compress(r))
        f.write(z.flush())
    assert warc.normalise(src, out, f"{out}.index", 1) == 1500
    tracemalloc.start()
    got = sum(b.num_rows for b in warc._record_reader(False)(iter([pa.RecordBatch.from_arrays([pa.array([out])], names=["path"])])))
    assert got == 1500 and tracemalloc.get_traced_memory()[1] < 20_000_000  # of 150 MB of pages
    tracemalloc.stop()


def test_normaliser_writes_members_and_finds_cut_off_files(tmp_path):
    raws = [warc.record(i, "http://x", os.urandom(5000 * (i % 3)), "D", 0, None, "d") for i in range(300)]
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    whole = b"".join(z.compress(r) for r in raws) + z.flush()
    src, out, idx = (str(tmp_path / n) for n in ("a.gz", "b.gz", "b.index"))
    open(src, "wb").write(whole)
    assert warc.normalise(src, out, idx) == 300
    import json

    with open(out, "rb") as f:
        for line, raw in zip(open(idx), raws, strict=True):
            e = json.loads(line)
            f.seek(e["offset"])
            assert zlib.decompress(f.read(e["length"]), 31) == raw
    assert b"".join(h + b"".join(b) for h, b in warc.records(warc.inflated(open(out, "rb")))) == b"".join(raws)
    with pytest.raises(EOFError):
        list(warc.inflated(io.BytesIO(whole[:-1000])))
    with pytest.raises(ValueError):
        list(warc.records(iter([b"HTTP/1.1 200 OK\r\n\r\n"])))


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_and_files_round_trip(kind, tmp_path):
    rng = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 1), (7, 2), (1000, 50257), (4097, 1 << 32)):
        ids = rng.integers(0, top, n, dtype=np.uint64).astype("<u4")
        assert (tp.from_planes(tp.to_planes(ids, kind), n, kind) == ids).all()
    w = tp.PlaneWriter(str(tmp_path / "f.ids"), kind, block=64)
    docs = [(i if i else None, rng.integers(0, 50257, rng.integers(0, 300)).astype("<u4")) for i in range(50)]
    for d, ids in docs:
        w.add(d, ids.tobytes())
    w.close()
    r = tp.PlaneReader(str(tmp_path / "f.ids"))
    assert [(d, x.tolist()) for d, x in r.documents()] == [(d, x.tolist()) for d, x in docs]
    assert (r.block(2) == np.concatenate([x for _, x in docs])[128:192]).all()  # any block by its index entry
    (tmp_path / "bad").write_bytes(b"x" * 40)
    with pytest.raises(ValueError):
        tp.PlaneReader(str(tmp_path / "bad"))


TEXTS = [None, "", " ", "a", "a b", "a  b", " a b ", "a\n b", "a \nb", "Don't we'll it's", "x\u00a0y z", "\u3000x y", "1 2,3 4.5", "é è ñ", "😀 a 😀😀", "<|endoftext|> a <|endoftext|>", "\t\tq\r\n w", "...! ?? a.b c,", "日本語 テキスト", "a" * 5000 + " b"]


def test_encoder_matches_the_library():
    path = vocabulary("byte_bpe_50k.json")
    plain, rng = Tokenizer.from_file(path), random.Random(5)
    signs = ["a", "The", "word", ".", ",", " ", "  ", "\n", "'s", "é", "7", "\u00a0", "!", "-", "ñ", "\t", "x1"]
    texts = [t or "" for t in TEXTS] + ["".join(rng.choices(signs, k=rng.randint(1, 25))) for _ in range(1500)]
    e = tp.CachedEncoder(path, cache=50)  # small, so that tables turn over
    for i in range(0, len(texts), 40):
        for t, got in zip(texts[i : i + 40], e.encode(texts[i : i + 40]), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, t


def test_encoder_matches_the_library_on_a_table_and_much_of_unicode():
    import pyarrow.parquet as pq

    path = vocabulary("byte_bpe_50k.json")
    plain, rng, e = Tokenizer.from_file(path), random.Random(11), tp.CachedEncoder(path)
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()]
    every = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(every), 64):  # each sign alone, doubled, behind and before letters, signs and blanks
        texts.append(" ".join(x for c in every[i : i + 64] for x in (c, f"a{c}", f"{c}a", f"a{c}.", f".{c}", c + c, f"1{c}'s", f"{c} {c}")))
    strange = [c for c in every[:0x3100] if not c.isalnum()]
    texts += ["".join(rng.choices(["a", " ", "é", "B", rng.choice(strange), rng.choice(strange), rng.choice(every), ".", "7"], k=rng.randint(1, 40))) for _ in range(5000)]
    for i in range(0, len(texts), 500):
        want = plain.encode_batch(texts[i : i + 500], add_special_tokens=False)
        for t, w, got in zip(texts[i : i + 500], want, e.encode(texts[i : i + 500]), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == w.ids, t


def test_a_file_that_cuts_texts_otherwise_is_used_whole(tmp_path):
    import json

    told = json.load(open(vocabulary("byte_bpe_50k.json")))
    told["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "t.json").write_text(json.dumps(told))
    plain, e = Tokenizer.from_file(str(tmp_path / "t.json")), tp.CachedEncoder(str(tmp_path / "t.json"))
    assert not e.by_words
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(["a b", "", "x  y"])] == [plain.encode(t, add_special_tokens=False).ids for t in ("a b", "", "x  y")]


def test_token_files_in_order(spark):
    plain = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    rows = [(None if i == 3 else 100 - i % 18, t, "en", 5) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string, path int").repartition(3)
    index = tp.write_token_planes(df, vocabulary("byte_bpe_50k.json"), file_ids=40)
    assert index.count() > 2
    got = [tuple(r) for r in tp.read_token_planes(index, with_ids=True).orderBy("start").collect()]
    assert [g[0] for g in got] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d))
    assert [g[1] for g in got] == np.cumsum([0] + [g[2] for g in got])[:-1].tolist()
    want = sorted((r[0] or 0, plain.encode(r[1] or "", add_special_tokens=False).ids + [2]) for r in rows)
    assert sorted((g[0] or 0, g[4]) for g in got) == want
    assert all(g[3] == zlib.crc32(np.array(g[4], "<u4").tobytes()) for g in got)
    assert tp.read_token_planes(tp.write_token_planes(df.where("false"), vocabulary("byte_bpe_50k.json"))).count() == 0
