"""MinHash near-duplicates by bottom-k sketches from one hash function (Cohen & Kaplan 2007; Beyer et al. 2007)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, connected_components, words_of

_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53))
_S29, _S33 = np.uint64(29), np.uint64(33)


def shingle_set(words: list[bytes], width: int = 5) -> np.ndarray:
    """Distinct ``width``-word shingles as sorted signed 64-bit hashes; fewer words count as one shingle, none as none."""
    if not words:
        return np.empty(0, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    # A text of fewer words must not equal a longer one's shingle: its length is mixed in.
    s = np.full(n, min(len(h), width), np.uint64)
    for j in range(min(len(h), width)):
        s = (s ^ (s >> _S29)) * _MIX[0] + h[j : n + j]
    for m in _MIX[1:]:
        s = (s ^ (s >> _S33)) * m
    return np.unique((s ^ (s >> _S33)).view(np.int64))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


SKETCHES = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("sketch", pa.list_(pa.int64()))])


def _sketcher(width: int, k: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, sketches = [], [], []
            for text in batch.column(1):
                s = shingle_set(words_of(text.as_py()), width)
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sketches.append(s[:k])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.list_(pa.int64()))], schema=SKETCHES)

    return run


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _verifier(width: int, percent: int):
    """Links (a, b) among rows (b, part, a, text) sorted by b, part and a: a row without ``a`` holds the text of ``b`` itself and precedes its partners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hubs: list[np.ndarray] = []
        hub_of = None
        for batch in batches:
            found_a, found_b = [], []
            for b, part, a, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mine = shingle_set(words_of(text), width)
                if a is None:
                    hubs = [*hubs, mine] if hub_of == (b, part) else [mine]
                    hub_of = (b, part)
                    continue
                for hub in hubs if hub_of == (b, part) else ():
                    shared = overlap(mine, hub)
                    if shared and 100 * shared >= percent * (len(mine) + len(hub) - shared):
                        found_a.append(a)
                        found_b.append(b)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], schema=LINKS)

    return run


def sure_share(k: int, percent: int, deviations: float = 7) -> int:
    """How many of the union's ``k`` smallest values a linked pair shares, so many standard deviations on the safe side."""
    share = percent / 100
    return max(1, math.floor(k * share - deviations * math.sqrt(k * share * (1 - share))))


def _lists(ws: Workspace, sketches: DataFrame, k: int | None, percent: int, name: str) -> DataFrame:
    """(v, doc_id, n, alone, place): each document under the rarest of its retained values, for ``sketches`` (doc_id, n, own, sketch).

    ``place`` counts from 1 in the order of rarity, ``alone`` is the number of values that no other document has. Sets
    whose partners must all be retained whole too (all sets if ``k`` is None) need the prefix for exact overlaps; others
    that for ``sure_share``. Counts are staged: a join of two plain exchanges is one whose hot values Spark can split.
    """
    values = sketches.select("doc_id", F.col("n").cast("int").alias("n"), "own", F.explode("sketch").alias("v"))
    of_one = Window.partitionBy("doc_id", "own")
    shared = values.join(ws.stage(values.groupBy("v").count().where("count > 1"), f"counts-{name}"), "v")
    n = F.col("n")
    kept = n if k is None else F.least(n, F.lit(k))
    whole = n - F.ceil(n * F.lit(percent) / 100).cast("int") + 1
    room = whole if k is None else F.when(n * 100 < percent * (k + 1), whole).otherwise(kept - sure_share(k, percent) + 1)
    alone = (kept - F.count("*").over(of_one)).cast("int")
    ranked = shared.withColumn("alone", alone).withColumn("place", F.col("alone") + F.row_number().over(of_one.orderBy("count", "v")))
    return ranked.where(F.col("place") <= room).select("v", "doc_id", "n", "alone", "place")


#: Partners of one document that are compared in one task.
PARTNERS = 64


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, k: int = 64, exact: bool = False,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of ``docs``.

    Two documents are linked if 100 * intersection >= ``percent`` * union of their shingle sets. One hash function
    orders all shingles; a document retains its ``k`` smallest. Steps:

    1. Documents with equal sets are one class, represented by its smallest id.
    2. Of the union's k smallest values, a linked pair shares hypergeometrically many, 7 standard deviations below
       whose mean is ``sure``. Two documents that share ``sure`` of k retained values meet in the list of one of the
       k - sure + 1 that are rarest in the corpus, so only those lists are kept. Common passages and license lines head
       no list unless a document holds little else. Sets of up to k shingles are retained whole; for them it is exact.
    3. In each list, documents are paired with the list's hub, the one with the fewest values of its own: of edited
       copies, the one closest to what they were copied from. Pairs whose union sketch holds fewer than ``sure`` shared
       values are dropped; the rest is verified on full sets.
    4. Documents in lists that still hold several components (all documents if ``exact``) are listed again by their
       whole sets, in one order of rarity. A linked pair meets at its first common value, where what follows on either
       side still reaches the overlap that the two sizes need. Each document's place tells which sizes it can reach at
       all: as the smaller of a pair only with few values of its own.
    5. What is open then is split into groups of similar sketches. Pages of one template have most of their values in
       common, so within a group only what they differ in is listed and compared (``_joined_in_groups``), in rounds that
       join a list's documents to one of them before any are paired. Pairs of different groups that step 4 leaves are
       verified on full sets. Grouping decides what is compared by which way, not what is linked.

    Pairs inside a component say nothing new and are not made. No list is cut short. Only step 2 can miss a link: of
    a pair exactly at ``percent`` with sets over k, with a probability below 1e-8, if no third document links the two;
    ``exact=True`` takes all documents through step 4 and misses none. Shingles are compared by 64-bit hashes.

    Memory: no task gathers a list; texts travel for documents in lists only, one at a time through the verifier, and
    a document with many partners is dealt to several tasks.

    Null or blank text: n_shingles 0, linked with nothing. Very long texts are taken whole. Null id: linked with
    nothing, component_id null, kept true. Rows that share an id are one document: a link of one is a link of all. A
    tie at exactly ``percent`` is a link. Other columns are not read. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "near")
    schema = "doc_id long, n_shingles long, digest binary, sketch array<long>"
    sure = sure_share(k, percent)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketched = ws.stage(own.mapInArrow(_sketcher(width, k), schema), "sketches", batch_rows=1000)
    usable = sketched.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = ws.stage(usable.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")), "classes")

    # Values of one class only head no list, but count among the rarest.
    listed = ws.stage(_lists(ws, classes.select(F.col("rep").alias("doc_id"), "n", F.hash("digest").alias("own"), "sketch"), k, percent, "first"), "listed")

    # Rows that share an id but not a text hold their classes together: each of them is linked to the smallest.
    named = usable.join(classes.select("digest", "rep"), "digest").select("doc_id", "rep")
    many = named.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("last")).where("b <> last").select("doc_id", "b")
    twice = named.join(ws.stage(many, "ids-of-several"), "doc_id")
    links = ws.stage(twice.select(F.col("rep").alias("a"), "b").unionByName(twice.select(F.col("doc_id").alias("a"), "b")).distinct(), "links-twice")
    if not exact and listed.isEmpty():
        return _result(ws, sketched, classes, _merged(ws, None, links, "cc-twice"))
    members = classes.select(F.col("rep").alias("doc_id")).distinct() if exact else listed.select("doc_id").distinct()
    texts = ws.stage(own.join(members, "doc_id").groupBy("doc_id", F.xxhash64("text")).agg(F.first("text").alias("text")).select("doc_id", "text"), "texts")
    sketches = ws.stage(classes.select(F.col("rep").alias("doc_id"), "n", "sketch").join(members, "doc_id"), "listed-sketches")

    def dealt(pairs: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """Distinct ``pairs`` (a, b) with a part of ``b``'s partners each, and the parts (b, part) there are."""
        pairs = ws.stage(pairs.distinct(), f"pairs-{name}")
        parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("parts"))
        hot = ws.stage(parts.where("parts > 1"), f"hot-{name}")
        part = F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))).cast("int")
        each = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
        return pairs.join(hot, "b", "left").select("a", "b", part.alias("part")), parts.select("b", each)

    def close(pairs: DataFrame, name: str, least: Column | None = None) -> DataFrame:
        """Of ``pairs`` (a, b), those whose sketches leave room for a link, or whose union's sketch shares ``least`` values."""
        pairs, parts = dealt(pairs, name)
        a, b = (sketches.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab")
        union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
        both = F.size(F.array_intersect("union", F.array_intersect("sa", "sb")))
        need = F.when(F.size("union") < k, F.ceil(F.size("union") * F.lit(percent) / 100)).otherwise(F.lit(sure))
        return (
            pairs.join(a, "a").join(parts.join(b, "b"), ["b", "part"]).where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
            .withColumn("union", union).where(both >= (need if least is None else least)).select("a", "b")
        )

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """Of ``pairs`` (a, b), those linked."""
        pairs, parts = dealt(pairs, name)
        partners = pairs.join(texts.withColumnRenamed("doc_id", "a"), "a").select("b", "part", "a", "text")
        selves = parts.join(texts.withColumnRenamed("doc_id", "b"), "b").select("b", "part", F.lit(None).cast("long").alias("a"), "text")
        rows = partners.unionByName(selves).repartition("b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())
        return ws.stage(rows.mapInArrow(_verifier(width, percent), "a long, b long"), f"links-{name}", batch_rows=200)

    hubs = listed.groupBy("v").agg(F.min(F.struct("alone", "doc_id")).alias("h"), F.count("*").alias("m")).where("m > 1").select("v", F.col("h.doc_id").alias("hub"))
    stars = listed.join(ws.stage(hubs, "hubs"), "v").where("doc_id <> hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b"))
    links = links.unionByName(verified(close(stars, "star-sketches"), "star"))
    joined = _merged(ws, None, links, "cc-star")
    found = joined.select(F.col("a").alias("doc_id"), F.col("b").alias("component"))

    # What stars left open: lists that hold several components. Their documents are listed anew by their whole sets.
    def split_lists(lists: DataFrame, name: str) -> DataFrame:
        named = lists.join(found, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
        several = named.groupBy("v").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.min("n").alias("least")).where("c0 <> c1").select("v", "least")
        return named.join(ws.stage(several, name), "v")

    def reaches(size: Column) -> Column:
        """Whether the values from this one on can hold the overlap needed with a set of ``size``."""
        return (1 + F.col("n") - F.col("place")) * (100 + percent) >= (F.col("n") + size) * percent

    unclear = members if exact else ws.stage(split_lists(listed, "several").select("doc_id").distinct(), "unclear")
    whole = ws.stage(
        texts.join(unclear, "doc_id").select("doc_id", "text").mapInArrow(_sketcher(width, None), schema)
        .select("doc_id", F.col("n_shingles").alias("n"), F.hash("digest").alias("own"), "sketch"),
        "whole-sets", batch_rows=200,
    )
    again = split_lists(ws.stage(_lists(ws, whole, None, percent, "again"), "listed-whole"), "several-again")
    # A set that cannot reach an overlap with the smallest of its list, or of the sizes that link at all, pairs with none.
    able = ws.stage(again.where(reaches(F.greatest("least", F.ceil(F.col("n") * F.lit(percent) / 100)))).drop("least", "component"), "listed-reaching")
    able = ws.stage(split_lists(able, "several-able").drop("least"), "listed-open")
    if able.isEmpty():
        return _result(ws, sketched, classes, joined)
    hubs = able.groupBy("v").agg(F.min(F.struct("alone", "doc_id"))["doc_id"].alias("b"))
    spokes = able.select("v", F.col("doc_id").alias("a")).join(ws.stage(hubs, "hubs-able"), "v").where("a <> b").select("a", "b")
    alike = ws.stage(close(spokes, "alike", F.ceil(F.size("union") / 2)), "alike")
    groups = connected_components(ws, alike, "cc-alike").select(F.col("node").alias("doc_id"), F.col("component").alias("g"))
    open_docs = able.select("doc_id").distinct().join(groups, "doc_id", "left")
    grouped = ws.stage(open_docs.select("doc_id", F.coalesce("g", "doc_id").alias("g")), "groups")
    joined = _joined_in_groups(ws, whole.join(grouped, "doc_id").select("doc_id", "g", "n", "sketch"), joined, percent, dealt)

    found = joined.select(F.col("a").alias("doc_id"), F.col("b").alias("component"))
    able = able.drop("component", "least").join(grouped, "doc_id").join(found, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    ends = [f(c).alias(f"{c}{i}") for c in ("component", "g") for i, f in enumerate((F.min, F.max))]
    across = able.groupBy("v").agg(*ends).where("component0 <> component1 AND g0 <> g1").select("v")
    able = ws.stage(able.join(ws.stage(across, "several-groups"), "v"), "listed-last")
    if able.isEmpty():
        return _result(ws, sketched, classes, joined)
    columns = ("doc_id", "n", "place", "component", "g")
    small = able.where(reaches(F.col("n"))).select("v", *[F.col(c).alias(f"{c}_b") for c in columns])
    large = able.select("v", *[F.col(c).alias(f"{c}_a") for c in columns])
    na, nb = F.col("n_a"), F.col("n_b")
    reach = 1 + F.least(na - F.col("place_a"), nb - F.col("place_b"))
    open_pairs = large.join(small, "v").where(
        (F.col("g_a") != F.col("g_b")) & (F.col("component_a") != F.col("component_b")) & ((na > nb) | ((na == nb) & (F.col("doc_id_a") > F.col("doc_id_b"))))
        & (nb * 100 >= na * percent) & (reach * (100 + percent) >= (na + nb) * percent)
    ).select(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b"))
    return _result(ws, sketched, classes, _merged(ws, joined, verified(open_pairs, "open"), "cc-last"))


def _merged(ws: Workspace, joined: DataFrame | None, links: DataFrame, name: str) -> DataFrame:
    """Components as edges (a, b) from each node to its smallest, of ``joined``, such edges already, and more ``links``."""
    if joined is not None and links.isEmpty():
        return joined
    every = links if joined is None else joined.unionByName(links)
    return connected_components(ws, every, name).select(F.col("node").alias("a"), F.col("component").alias("b"))


#: Rounds at most in which the documents of a list are compared with one of them, as long as that finds links; then all that are still apart are compared.
ROUNDS = 4


def _joined_in_groups(ws: Workspace, docs: DataFrame, joined: DataFrame, percent: int, dealt) -> DataFrame:
    """Components ``joined`` (edges from each node to its smallest) and all links within groups of ``docs`` (doc_id, g, n, sketch), with whole sets.

    A group's core are the values that more than half of its sets hold, and a set is told by its delta, the values in
    which it differs from the core. Two sets differ in just the values in which their deltas differ, so whether they are
    linked follows from deltas, exactly. With s values in a delta and u = (100 + percent) s - (100 - percent) n, two
    documents are linked where u_a + u_b <= 0, whatever their deltas hold, and else where these share as many values as
    (u_a + u_b) / (2 (100 + percent)). Of the first kind all are linked to the group's smallest u; of the second kind
    both hold their first common value, in one order of rarity, where enough values follow.
    """
    sizes = ws.stage(docs.groupBy("g").agg(F.count("*").alias("members")).where("members > 1"), "group-sizes")
    docs = docs.join(sizes, "g")
    held = docs.select("g", "members", F.explode("sketch").alias("v")).groupBy("g", "v").agg(F.count("*").alias("c"), F.first("members").alias("members"))
    core = ws.stage(held.where("2 * c > members").groupBy("g").agg(F.collect_list("v").alias("core")), "cores")
    delta = F.concat(F.array_except("sketch", "core"), F.array_except("core", "sketch"))
    deltas = docs.join(core, "g", "left").withColumn("core", F.coalesce("core", F.array().cast("array<long>"))).select("doc_id", "g", "n", delta.alias("delta"))
    deltas = deltas.withColumn("s", F.size("delta")).withColumn("u", (F.col("s") * (100 + percent) - F.col("n") * (100 - percent)).cast("long"))
    deltas = ws.stage(deltas, "deltas")
    best = ws.stage(deltas.groupBy("g").agg(F.min(F.struct("u", "doc_id")).alias("best")).select("g", F.col("best.u").alias("least_u"), F.col("best.doc_id").alias("b")), "group-hubs")
    found = deltas.join(best, "g").where((F.col("u") + F.col("least_u") <= 0) & (F.col("doc_id") != F.col("b"))).select(F.col("doc_id").alias("a"), "b")
    found = ws.stage(found, "links-certain")

    def shared_least(total: Column) -> Column:
        return F.greatest(F.lit(1), F.ceil(total / (2 * (100 + percent)))).cast("int")

    values = deltas.join(best.select("g", "least_u"), "g").select("doc_id", "g", "n", "s", "u", shared_least(F.col("u") + F.col("least_u")).alias("least_shared"), F.explode("delta").alias("v"))
    of_one = Window.partitionBy("doc_id")
    shared = values.join(ws.stage(values.groupBy("g", "v").count().where("count > 1"), "counts-deltas"), ["g", "v"])
    place = F.col("s") - F.count("*").over(of_one) + F.row_number().over(of_one.orderBy("count", "v"))
    lists = shared.withColumn("place", place.cast("int")).where(F.col("place") <= F.col("s") - F.col("least_shared") + 1)
    lists = ws.stage(lists.select("g", "v", "doc_id", "n", "s", "u", "place"), "listed-deltas")

    def still_open(name: str) -> DataFrame:
        """Rows of lists that hold several components."""
        named = lists.join(joined.select(F.col("a").alias("doc_id"), F.col("b").alias("component")), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
        several = named.groupBy("g", "v").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1").select("g", "v")
        return ws.stage(named.join(ws.stage(several, f"open-values-{name}"), ["g", "v"]), f"open-{name}")

    def side(rows: DataFrame, x: str) -> DataFrame:
        return rows.select("g", "v", *[F.col(c).alias(f"{c}_{x}") for c in ("doc_id", "n", "s", "u", "place", "component")])

    def linked(pairs: DataFrame, name: str) -> DataFrame:
        """Links among pairs of rows of lists, the ``b`` of which may have many partners."""
        na, nb = F.col("n_a"), F.col("n_b")
        reach = 1 + F.least(F.col("s_a") - F.col("place_a"), F.col("s_b") - F.col("place_b"))
        pairs = pairs.where((F.col("component_a") != F.col("component_b")) & (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (reach >= shared_least(F.col("u_a") + F.col("u_b"))))
        pairs, parts = dealt(pairs.select(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b")), name)
        a, b = (deltas.select(F.col("doc_id").alias(x), F.col("u").alias(f"u{x}"), F.col("delta").alias(f"d{x}")) for x in "ab")
        both = F.size(F.array_intersect("da", "db"))
        return ws.stage(pairs.join(a, "a").join(parts.join(b, "b"), ["b", "part"]).where(2 * (100 + percent) * both >= F.col("ua") + F.col("ub")).select("a", "b"), f"links-{name}")

    joined = _merged(ws, joined, found, "cc-certain")
    for turn in range(ROUNDS):
        rows = still_open(f"turn-{turn}")
        if rows.isEmpty():
            return joined
        hub = rows.groupBy("g", "v").agg(F.min(F.struct(F.xxhash64("doc_id", F.lit(turn)).alias("h"), "doc_id", "n", "s", "u", "place", "component")).alias("hub"))
        partners = ws.stage(side(hub.select("g", "v", "hub.*"), "b"), f"delta-hubs-{turn}")
        more = linked(side(rows, "a").join(partners, ["g", "v"]), f"deltas-{turn}")
        if more.isEmpty():
            break
        joined = _merged(ws, joined, more, f"cc-turn-{turn}")
    else:
        rows = still_open("last")
    more = linked(side(rows, "a").join(side(rows, "b"), ["g", "v"]).where("doc_id_a < doc_id_b"), "deltas-last")
    return _merged(ws, joined, more, "cc-deltas")


def _result(ws: Workspace, sketched: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    ws.keep("sketches", "classes", "cc-")
    out = sketched.select("doc_id", "n_shingles", "digest").join(classes.select("digest", "rep"), "digest", "left")
    out = out.join(found.select(F.col("a").alias("rep"), F.col("b").alias("component")), "rep", "left")
    node = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    out = out.withColumn("component_id", node)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
