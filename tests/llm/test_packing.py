"""Packing: plans against exhaustive search, pieces and ids against the library, places against the contract."""

import random
import struct
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from streamlanes.llm.packing import WordEncoder, best_fit, pack_documents, plan, reduce_by_dominance
from streamlanes.llm.registry import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")


def fewest(sizes, capacity):
    """The least number of sequences, by going through all fillings of the one that holds the largest piece."""

    @lru_cache(maxsize=None)
    def least(left):
        if not left:
            return 0
        first, rest = left[0], left[1:]
        best = len(left)
        for mask in range(1 << len(rest)):
            chosen = [s for i, s in enumerate(rest) if mask >> i & 1]
            if first + sum(chosen) <= capacity:
                best = min(best, 1 + least(tuple(s for i, s in enumerate(rest) if not mask >> i & 1)))
        return best

    return least(tuple(sorted(sizes, reverse=True)))


def contents(groups):
    return Counter({s: sum(g.count * k for g in groups for x, k in g.content if x == s) for s in {x for g in groups for x, _ in g.content}})


def counted(sizes, capacity):
    return np.bincount(sizes, minlength=capacity + 1)


def plain_best_fit(sizes, capacity):
    """Piece by piece: how many sequences."""
    rooms = []
    for s in sorted(sizes, reverse=True):
        fits = [r for r in rooms if r >= s]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - s)
        else:
            rooms.append(capacity - s)
    return sorted(rooms)


def test_reduction_keeps_the_best_packing_possible():
    rng = random.Random(5)
    fixed = 0
    for _ in range(250):
        capacity = rng.randint(5, 30)
        sizes = [rng.randint(rng.choice((1, capacity // 4)) or 1, capacity) for _ in range(rng.randint(0, 9))]
        groups, rest = reduce_by_dominance(counted(sizes, capacity), capacity)
        left = np.repeat(np.arange(len(rest)), rest).tolist()
        assert contents(groups) + Counter(left) == Counter(sizes)
        assert all(sum(s * k for s, k in g.content) <= capacity for g in groups)
        assert sum(g.count for g in groups) + fewest(left, capacity) == fewest(sizes, capacity)
        fixed += len(sizes) - len(left)
    assert fixed > 500


def test_best_fit_by_counts_is_best_fit_piece_by_piece():
    rng = random.Random(6)
    for _ in range(200):
        capacity = rng.randint(5, 60)
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(0, 80))]
        groups = best_fit(counted(sizes, capacity), capacity)
        rooms = sorted(capacity - sum(s * k for s, k in g.content) for g in groups for _ in range(g.count))
        assert rooms == plain_best_fit(sizes, capacity) and contents(groups) == Counter(sizes)


def test_plans_of_large_histograms_are_near_the_bound():
    rng = np.random.default_rng(1)
    for sizes in (rng.integers(1, 4097, 200_000), np.minimum(4096, rng.lognormal(6, 1, 200_000).astype(int) + 1), np.full(100_000, 1000), rng.integers(1400, 1500, 100_000)):
        groups = plan(counted(sizes, 4096))
        assert contents(groups) == Counter(sizes.tolist()) and all(sum(s * k for s, k in g.content) <= 4096 for g in groups)
        n = sum(g.count for g in groups)
        per = 4096 // sizes.min()  # no sequence holds more pieces
        assert n <= 1.01 * max(-(-int(sizes.sum()) // 4096), -(-len(sizes) // per)) + 1
        assert len(groups) < 4 * 4096


def library(texts):
    t = Tokenizer.from_file(PATH)
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_ids_are_those_of_whole_texts(spark):
    encoder = WordEncoder(PATH, cache=500)
    assert encoder.by_words
    rng = random.Random(7)
    signs = [chr(c) for c in [*range(0x250), *range(0x300, 0x400), *range(0x1100, 0x1200), *range(0x2000, 0x2070), *range(0x3000, 0x3100), *range(0xAC00, 0xAC40)] if not 0xD800 <= c < 0xE000]
    texts = ["", None, " ", "ΣΑΣ Á ́x", "a<|endoftext|>b <|startoftext|> it's I'LL don't'", "x y z\u0085w", "\x1c\x1d\x1fq"]
    texts += ["".join(rng.choices(signs + [" "] * 200, k=rng.randint(1, 80))) for _ in range(3000)]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    ids, starts = encoder.encode(pa.array(texts))
    for i, want in enumerate(library(texts)):
        assert ids[starts[i] : starts[i + 1]].tolist() == want, texts[i]
    other = WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))  # keeps blanks: texts are encoded whole
    assert not other.by_words
    ids, starts = other.encode(pa.array(["a b", None, "c"]))
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == [e.ids for e in other.tokenizer.encode_batch(["a b", "", "c"])]


def check(rows, docs, capacity=4096):
    """The contract's conditions on ``rows`` for (doc_id, text) with distinct ids."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == {i for i, _ in docs}
    for (i, _), ids in zip(docs, library([t for _, t in docs]), strict=True):
        ids = [*ids, 1]
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(-(-len(ids) // capacity)))
        for r in pieces:
            own = ids[r.piece * capacity : (r.piece + 1) * capacity]
            assert (r.start, r.length, r.ids_crc32) == (r.piece * capacity, len(own), zlib.crc32(struct.pack(f"<{len(own)}I", *own)))
    for rs in by_sequence.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    return len(by_sequence)


def test_query_packs_the_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = QUERIES["op11_dominance_packing"](spark, sf).collect()
    n = check(rows, docs)
    sizes = [r.length for r in rows]
    assert n <= len(plain_best_fit(sizes, 4096)) and n <= -(-sum(sizes) // 4096) + 2


def test_odd_rows(spark):
    rng = random.Random(2)
    docs = [(1, None), (2, ""), (3, "  "), (4, " ".join(rng.choices(["alpha", "beta", "x1"], k=30_000))), *[(10 + i, "word " * rng.randint(1, 60)) for i in range(300)]]
    df = spark.createDataFrame([(i, t, 1, "s", 2) for i, t in docs], "doc_id long, text string, part int, nth string, size int").repartition(5)
    assert check(pack_documents(df, PATH, capacity=64).collect(), docs, 64) > 3
    got = pack_documents(df, PATH, capacity=64, with_ids=True).collect()
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in got)
    again = [(None, "a b c")] * 3 + [(5, "same text")] * 4
    got = pack_documents(spark.createDataFrame(again, "doc_id long, text string"), PATH).collect()
    assert len(got) == 7 and {r.sequence_id for r in got} == {0} and sorted(r.offset for r in got)[-1] + 4 >= sum(r.length for r in got) - 4
    assert pack_documents(df.where("false"), PATH).count() == 0


@pytest.mark.parametrize("one", [1000, 4096])
def test_a_length_that_all_documents_have(spark, one):
    df = spark.range(4000).selectExpr("id AS doc_id", f"repeat('a ', {one - 1}) AS text").repartition(7)
    rows = pack_documents(df, PATH).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == 4000 and max(r.sequence_id for r in rows) == 4000 // (4096 // one) - 1
