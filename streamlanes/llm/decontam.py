"""Benchmark decontamination by greedy string tiling (Wise 1993), with Karp-Rabin matching."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, unused_name

TOKEN = re.compile(r"\w+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bits of the filter that keeps most windows of documents from being shuffled; 2 MB whatever the benchmark's size.
FILTER_BITS = 24


def tokens_of(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


def token_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each token. 0 stands for no token."""
    found = tokens_of(text)
    return np.fromiter((xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) or 1 for t in found), np.uint64, len(found))


def window_hashes(tokens: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of ``size`` tokens, from the hashes of all beginnings."""
    n = len(tokens) - size + 1
    if n < 1:
        return np.empty(0, np.uint64)
    if size <= 8:
        h = np.zeros(n, np.uint64)
        for j in range(size):
            h = h * _BASE + tokens[j : n + j]
        return h
    # h(i) = sum of t[j] B^(size - 1 - (j - i)): by doubling, windows of 2k are two windows of k side by side.
    half = window_hashes(tokens, size // 2)
    h = half[: n + size - 2 * (size // 2)] * np.power(_BASE, np.uint64(size // 2)) + half[size // 2 : n + size - size // 2]
    return h if size % 2 == 0 else h[:n] * _BASE + tokens[size - 1 :]


def _free(used: np.ndarray, size: int) -> np.ndarray:
    """Starts of windows of ``size`` with no token used."""
    upto = np.concatenate([[0], np.cumsum(used)])
    return np.flatnonzero(upto[size:] == upto[:-size]) if len(used) >= size else np.empty(0, np.int64)


def greedy_tiles(pattern: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (start in pattern, start in text, length): longest non-overlapping common stretches first, none below ``least``.

    Karp-Rabin runs over what is not marked yet: a search length that has a match is raised, one that has none lowered,
    until the longest is found; all matches of that length are marked, in the pattern's and then the text's order, but
    those that one marked before overlaps; then the search runs on for shorter ones. Each round ends a length, and
    lengths add up to the pattern's at most, so rounds are few even where all tokens are equal. A token of 0 never
    matches.
    """
    used_p, used_t = pattern == 0, text == 0
    tiles: list[tuple[int, int, int]] = []
    most = min(len(pattern), len(text))

    def matches(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        p, t = _free(used_p, size), _free(used_t, size)
        hp, ht = window_hashes(pattern, size)[p], window_hashes(text, size)[t]
        keep = np.isin(hp, ht)
        return p[keep], hp[keep], t, ht

    while most >= least:
        low, high, size = least - 1, most, least
        while low < high:  # the longest length with a match; mostly short ones match or none
            if len(matches(size)[0]):
                low = size
                size = min(high, max(size + 1, min(2 * size, (size + high + 1) // 2)))
            else:
                high = size - 1
                size = (low + high + 1) // 2
        if low < least:
            break
        p, hp, t, ht = matches(low)
        keep = np.isin(ht, hp)
        order = np.argsort(ht[keep], kind="stable")
        t, ht = t[keep][order], ht[keep][order]
        at = dict(zip(*(x.tolist() for x in (np.unique(ht), np.searchsorted(ht, np.unique(ht)))), strict=True))
        for i, h in zip(p.tolist(), hp.tolist(), strict=True):
            if used_p[i : i + low].any():
                continue
            k = at[h]
            while k < len(t) and ht[k] == h and used_t[t[k] : t[k] + low].any():
                k += 1
            at[h] = k  # what is used stays used
            if k < len(t) and ht[k] == h and (pattern[i : i + low] == text[t[k] : t[k] + low]).all():
                used_p[i : i + low] = used_t[t[k] : t[k] + low] = True
                tiles.append((i, int(t[k]), low))
        most = low - 1
    return tiles


def coverage(item: np.ndarray, text: np.ndarray, least: int) -> tuple[int, int]:
    """Tokens of ``item`` that tiles of ``least`` (of all its tokens, if it has fewer) cover, and the tiles."""
    least = min(least, len(item))
    if not least or len(text) < least:
        return 0, 0
    # Tiles lie within windows that both have, so only those stretches of the text are tiled; a 0 parts them.
    hit = np.isin(window_hashes(text, least), window_hashes(item, least))
    inside = np.convolve(hit, np.ones(least, int))[: len(text)] > 0
    kept = np.flatnonzero(inside)
    if not len(kept):
        return 0, 0
    tiles = greedy_tiles(item, np.insert(text[kept], np.flatnonzero(np.diff(kept) > 1) + 1, 0), least)
    return sum(t[2] for t in tiles), len(tiles)


ITEMS = "item long, item_id long, text string, size int, h array<long>, times array<int>"


def _seeder(least: int):
    """Items' windows of ``least`` tokens (of all tokens for shorter items), each once with the number of its places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for row, item_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                t = token_hashes(text)
                if len(t):
                    h, n = np.unique(window_hashes(t, min(least, len(t))).view(np.int64), return_counts=True)
                    for c, x in zip(cols, (row, item_id, text, len(t), h, n.astype(np.int32)), strict=True):
                        c.append(x)
            types = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["item", "item_id", "text", "size", "h", "times"])

    return run


def _window_finder(sizes: list[int], bits: np.ndarray):
    """Windows of texts, of ``sizes`` tokens, that pass the filter: each once for a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, found = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = token_hashes(text.as_py())
                for size in sizes:
                    h = window_hashes(t, size)
                    slot = h >> np.uint64(64 - FILTER_BITS)
                    h = np.unique(h[bits[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1) > 0])
                    keys += [key] * len(h)
                    found.append(h.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(np.concatenate(found) if found else np.empty(0, np.int64))], names=["key", "h"])

    return run


def _tiler(least: int, threshold: float):
    """Items contained in texts, from rows (key, part, item_id, text) by key and part: the text itself, without an item's id, precedes its items."""
    types = [pa.binary(), *[pa.int64()] * 4, pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = np.empty(0, np.uint64)
        for batch in batches:
            rows = []
            for key, item_id, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                p = token_hashes(text.as_py())
                if item_id is None:
                    tokens = p
                    continue
                covered, tiles = coverage(p, tokens, least)
                if covered >= threshold * len(p):
                    rows.append((key, item_id, len(p), covered, tiles, covered / len(p)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=["key", "item_id", "item_tokens", "covered", "tiles", "coverage"])

    return run


#: Items that are tiled against one text in one task.
ITEMS_A_TASK = 256


def _text_key(column: str) -> Column:
    """16 bytes that stand for a text."""
    return F.unhex(F.md5(F.coalesce(F.col(column), F.lit("")).cast("binary")))


def _contaminated(texts: DataFrame, benchmark: DataFrame, least: int, threshold: float, shortest: int, common: int = 100) -> DataFrame:
    """(key, item_id, item_tokens, covered, tiles, coverage) of the texts (key, text) that contain an item, each text once.

    Items' windows are a table, the seeds, which a shuffle joins to the texts' windows; a filter of fixed size, made of
    the seeds, goes to all tasks before and keeps windows that no item has from being shuffled. An item of n tokens of
    which ``threshold`` lie in tiles of ``least`` or more has threshold * n / least of its windows in the text at least:
    only pairs with so many are tiled. Windows of more than ``common`` items lead to none as long as an item can do
    without them, that is has fewer of them than it needs.
    """
    ws = Workspace(texts.sparkSession, "tiling")
    given = benchmark.select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    items = ws.stage(given.mapInArrow(_seeder(least), ITEMS).where(F.col("size") >= shortest), "items", batch_rows=200)
    places = items.dropDuplicates(["item"]).select("item", "size", F.explode(F.arrays_zip("h", "times")).alias("w")).select("item", "size", "w.h", "w.times")
    owners = ws.stage(places.groupBy("h").agg(F.count("*").alias("owners")), "owners")
    need = F.ceil(F.lit(threshold) * F.col("size") / least).cast("int")
    upto = F.sum("times").over(Window.partitionBy("item").orderBy(F.desc("owners"), "h"))
    ranked = places.join(owners, "h").withColumn("upto", upto).withColumn("spared", (F.col("owners") > common) & (F.col("upto") < need) & (F.col("size") >= least))
    ranked = ranked.withColumn("need", F.greatest(F.lit(1), need - F.coalesce(F.max(F.when(F.col("spared"), F.col("upto"))).over(Window.partitionBy("item")), F.lit(0))).cast("int"))
    seeds = ws.stage(ranked.where("NOT spared").select("h", "item", "times", F.when(F.col("size") < least, 1).otherwise(F.col("need")).alias("need")), "seeds")
    slots = seeds.select(F.shiftrightunsigned("h", 64 - FILTER_BITS).alias("slot")).distinct()
    words = slots.groupBy(F.expr("CAST(shiftright(slot, 6) AS INT)").alias("at")).agg(F.expr("bit_or(shiftleft(1L, CAST(slot & 63 AS INT)))").alias("word"))
    bits = np.zeros(1 << FILTER_BITS - 6, np.uint64)
    for r in words.collect():  # 2^18 at most
        bits[r.at] = r.word & 0xFFFFFFFFFFFFFFFF
    sizes = sorted(r.size for r in items.select(F.least("size", F.lit(least)).alias("size")).distinct().collect())
    windows = ws.stage(texts.select("key", "text").mapInArrow(_window_finder(sizes, bits), "key binary, h long"), "windows", batch_rows=500)
    met = windows.distinct().join(seeds, "h").groupBy("key", "item").agg(F.sum("times").alias("places"), F.first("need").alias("need"))
    pairs = ws.stage(met.where("places >= need").select("key", "item"), "pairs")
    # A text moves once, with all its items behind it; one with very many is dealt to several tasks.
    parts = ws.stage(pairs.groupBy("key").agg(F.ceil(F.count("*") / ITEMS_A_TASK).cast("int").alias("parts")), "parts")
    part = F.pmod(F.xxhash64("item"), F.col("parts")).cast("int").alias("part")
    of_items = pairs.join(parts, "key").select("key", part, "item").join(items.select("item", "item_id", "text"), "item").select("key", "part", "item_id", "text")
    some = texts.join(parts, "key").groupBy("key").agg(F.first("text").alias("text"), F.first("parts").alias("parts"))
    each = some.select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("item_id"), "text")
    rows = each.unionByName(of_items).repartition("key", "part").sortWithinPartitions("key", "part", F.col("item_id").asc_nulls_first())
    return ws.stage(rows.mapInArrow(_tiler(least, threshold), "key binary, item_id long, item_tokens long, covered long, tiles long, coverage double"), "found", batch_rows=200)


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    least: int = 5, threshold: float = 0.8, shortest: int = 1,
) -> DataFrame:
    """(doc_id, item_id, item_tokens, covered, tiles, coverage) of every document and benchmark item it contains.

    Words are compared in lower case without punctuation, by 64-bit hashes. An item counts as contained if tiles of
    ``least`` words or more, in whatever order they stand in the document, cover ``threshold`` of its words. An item of
    fewer words is contained where it stands whole; whoever has items of a word or two, which say nothing of where a text
    comes from, can leave out those below ``shortest`` words. Windows of ``least`` words shared with an item (seeds) lead to the pairs that are tiled, and none that can reach the threshold is missed.
    Neither table is gathered anywhere: windows that pass a filter of 2 MB are shuffled, and the texts of pairs.

    Null or empty texts contain nothing; items that are null, empty or have a null id are contained in nothing. Very
    long texts and texts of one repeated word are tiled whole. Of tiles of equal length the item's first is marked,
    where the text has it first. Null document ids are kept as null; repeated rows are repeated; repeated items too.
    Empty tables give an empty table; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("key", _text_key("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"))
    found = _contaminated(rows.select("key", "text"), items, least, threshold, shortest)
    return rows.select("key", "doc_id").join(found, "key").select("doc_id", "item_id", "item_tokens", "covered", "tiles", "coverage")


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = 5, threshold: float = 0.8,
    shortest: int = 1,
) -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item, with all their columns, whatever their names.

    Items as in ``find_contamination``. Null or empty texts stay; equal texts stay or go together; null ids are no matter; empty
    tables are fine.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"))
    found = _contaminated(docs.select(_text_key(text_col).alias("key"), F.col(text_col).alias("text")), items, least, threshold, shortest)
    key = unused_name(docs, "text_key")
    return docs.withColumn(key, _text_key(text_col)).join(found.select(F.col("key").alias(key)).distinct(), key, "left_anti").select(docs.columns)
