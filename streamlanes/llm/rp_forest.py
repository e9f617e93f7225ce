"""Near-duplicate embeddings by a forest of random-projection trees with spill (Dasgupta & Freund 2008; Liu et al. 2004)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, connected_components


def unit_rows(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Unit vectors in double precision, one row for each of the lists, which are equally long."""
    flat = (vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors).flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    top = np.abs(x).max(axis=1, keepdims=True, initial=0)
    x /= np.where(top > 0, top, 1)
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    x /= np.where(norm > 0, norm, 1)
    return x


#: Levels that a node is split by at once, from a sample of its own rows.
LEVELS = 5


def directions(node: int, levels: int, width: int) -> np.ndarray:
    """Random unit vectors of the inner nodes below ``node``, in heap order from 1; row 0 is not used. The same wherever they are made."""
    d = np.random.default_rng(node & 0xFFFFFFFFFFFFFFFF).standard_normal((1 << levels, width))
    return d / np.linalg.norm(d, axis=1, keepdims=True)


def split_cuts(node: int, x: np.ndarray, levels: int, spill: float, least: int = 8) -> np.ndarray:
    """Cuts of the inner nodes below ``node``, in heap order, fitted to a sample of unit vectors: medians along each node's direction.

    A node is a leaf (nan) below ``2 * least`` rows, or where its halves, with the spill on both sides, would have over
    three quarters of its pairs: a cluster that tight gains too little from a split.
    """
    cuts = np.full(1 << levels, np.nan)
    along = x @ directions(node, levels, x.shape[1]).T
    rows = {1: np.arange(len(x))}
    for i in range(1, 1 << levels):
        own = rows.pop(i, None)
        if own is None or len(own) < 2 * least:
            continue
        at = along[own, i]
        cut = float(np.median(at))
        low, high = own[at <= cut + spill], own[at >= cut - spill]
        if len(low) ** 2 + len(high) ** 2 <= 0.75 * len(own) ** 2:
            cuts[i] = cut
            rows[2 * i], rows[2 * i + 1] = low, high
    return cuts


def fall(node: int, cuts: np.ndarray, x: np.ndarray, spill: float) -> list[tuple[int, np.ndarray]]:
    """(place in heap order, rows of ``x`` that fall into it) for each leaf below ``node`` with rows."""
    found = []
    along = x @ directions(node, len(cuts).bit_length() - 1, x.shape[1]).T
    stack = [(1, np.arange(len(x)))]
    while stack:
        i, rows = stack.pop()
        if i >= len(cuts) or np.isnan(cuts[i]):
            found.append((i, rows))
        else:
            at = along[rows, i]
            stack += [(c, own) for c, own in ((2 * i, rows[at <= cuts[i] + spill]), (2 * i + 1, rows[at >= cuts[i] - spill])) if len(own)]
    return found


def _fitter(spill_of):
    schema = pa.schema([("node", pa.int64()), ("cuts", pa.list_(pa.float64()))])

    def run(table: pa.Table) -> pa.Table:
        node, rows, most = (table[c][0].as_py() for c in ("node", "rows", "most"))
        x = unit_rows(table["vec"])
        levels = min(LEVELS, max(1, math.ceil(math.log2(rows / most))))
        return pa.Table.from_arrays([pa.array([node]), pa.array([split_cuts(node, x, levels, spill_of(x.shape[1]))], pa.list_(pa.float64()))], schema=schema)

    return run


def _faller(spill_of):
    """Rows (key, node, vec, cuts, most) as (key, node, most, leaf), once for each child node; the node's own number where it was not split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, nodes, most = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 4))
            order = np.argsort(nodes, kind="stable")
            each, starts = np.unique(nodes[order], return_index=True)
            taken, leaf = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for node, rows in zip(each.tolist(), np.split(order, starts[1:]), strict=True):
                cuts = batch.column(3)[int(rows[0])].values.to_numpy(zero_copy_only=False)
                x = unit_rows(batch.column(2).take(pa.array(rows)))
                for i, own in fall(node, cuts, x, spill_of(x.shape[1])):
                    taken.append(rows[own])
                    leaf.append(np.full(len(own), xxhash.xxh3_64_intdigest(f"{node} {i}") - (1 << 63) if i > 1 else node, np.int64))
            at = np.concatenate(taken)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (key[at], nodes[at], most[at], np.concatenate(leaf))], names=["key", "node", "most", "leaf"])

    return run


def _grown(ws: Workspace, classes: DataFrame, trees: int, leaf_rows: int, block_rows: int, sample_rows: int, spill_of, seed: int) -> DataFrame:
    """(key, leaf) of every class (label, size, key, vec) in every tree, each once: a tree for each label and size, grown by rounds.

    A leaf may have four times the root of its tree's rows, within ``leaf_rows`` and ``block_rows``. In a round every
    node with more is split by up to five levels fitted to about ``sample_rows`` of its own rows, in a task of its own,
    and its rows fall through them. Only cuts travel: directions are made from a node's number. Rounds go on until no
    node is too large, so leaves follow the table, not the sample; nodes that cannot be split stay whole.
    """
    node = F.xxhash64(F.lit(seed), "label", "size", "tree")
    most = F.greatest(F.lit(leaf_rows), F.least(F.lit(block_rows), F.ceil(4 * F.sqrt("n")))).cast("int")
    limits = ws.stage(classes.groupBy("label", "size").agg(F.count("*").alias("n")).select("label", "size", most.alias("most")), "limits")
    at = classes.join(limits, ["label", "size"]).withColumn("tree", F.explode(F.sequence(F.lit(1), F.lit(trees)))).select("key", node.alias("node"), "most")
    at = ws.stage(at, "nodes-0")
    done, turn = None, 0
    while True:
        large = ws.stage(at.groupBy("node", "most").agg(F.count("*").alias("rows")).where("rows > most").select("node", "rows"), f"large-{turn}")
        rest = at.join(large, "node", "left_anti").select("key", F.col("node").alias("leaf"))
        done = rest if done is None else done.unionByName(rest)
        if large.isEmpty():
            return done
        rows = at.join(large, "node").join(classes.select("key", "vec"), "key").select("key", "node", "most", "rows", "vec")
        drawn = rows.where(F.pmod(F.xxhash64(F.lit(seed + 1), "key", "node"), F.lit(1 << 30)) < F.lit(float(sample_rows) * (1 << 30)) / F.col("rows"))
        cuts = ws.stage(drawn.select("node", "most", "rows", "vec").groupBy("node").applyInArrow(_fitter(spill_of), "node long, cuts array<double>"), f"cuts-{turn}")
        moved = rows.join(cuts, "node").select("key", "node", "vec", "cuts", "most").mapInArrow(_faller(spill_of), "key long, node long, most int, leaf long")
        moved = ws.stage(moved, f"moved-{turn}")
        done = done.unionByName(moved.where("leaf = node").select("key", "leaf"))
        turn += 1
        at = moved.where("leaf <> node").select("key", F.col("leaf").alias("node"), "most")


PART = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("rep", pa.int64()), ("root", pa.int64())])


def leaf_links(rep: np.ndarray, weight: np.ndarray, x: np.ndarray, smaller: tuple[np.ndarray, np.ndarray], side: np.ndarray, cosine: float, chunk: int = 512):
    """Links of the rows of one leaf: each row's linked weight that no smaller leaf counts, and its local component's smallest id.

    ``smaller`` are (row, leaf) of the smaller leaves that rows are in, too. ``side`` is null-free; where it has two
    values only pairs across count. A pair is counted by the smallest leaf that holds both, so counts over all leaves
    add up to each row's true number without listing pairs.
    """
    n = len(rep)
    across = len(np.unique(side)) > 1
    linked = np.zeros((n, n), bool)
    for s in range(0, n, chunk):
        near = x[s : s + chunk] @ x.T >= cosine
        if across:
            near &= side[s : s + chunk, None] != side[None, :]
        linked[s : s + chunk] = near
    linked[np.arange(n), np.arange(n)] = False
    linked |= linked.T  # rounding may differ between the halves
    counts, root = np.zeros(n, np.int64), rep.copy()
    met = np.flatnonzero(linked.any(axis=1))
    if not len(met):
        return counts, root, met
    linked = linked[np.ix_(met, met)]
    row, leaf = smaller
    of_met = np.isin(row, met)
    each, place = np.unique(leaf[of_met], return_inverse=True)
    member = np.zeros((len(met), len(each)), np.float32)
    member[np.searchsorted(met, row[of_met]), place] = 1
    low, top = rep[met], np.iinfo(np.int64).max
    while True:
        following = low.copy()
        for s in range(0, len(met), chunk):
            following[s : s + chunk] = np.minimum(low[s : s + chunk], np.where(linked[s : s + chunk], low, top).min(axis=1))
        if (following == low).all():
            break
        low = following
    root[met] = low
    for s in range(0, len(met), chunk):
        counts[met[s : s + chunk]] = (linked[s : s + chunk] & ~((member[s : s + chunk] @ member.T) > 0)) @ weight[met]
    return counts, root, met


def _leaf_worker(cosine: float):
    def run(table: pa.Table) -> pa.Table:
        key, rep, weight, side = (table[c].to_numpy() for c in ("key", "rep", "weight", "block"))
        lists = table["leaves"].combine_chunks()
        row, leaf = np.repeat(np.arange(len(key)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
        less = leaf < table["leaf"][0].as_py()
        counts, root, met = leaf_links(rep, weight, unit_rows(table["vec"]), (row[less], leaf[less]), side, cosine)
        return pa.Table.from_arrays([pa.array(c[met]) for c in (key, counts, rep, root)], schema=PART)

    return run


def embedding_near_duplicates(
    vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = 0.98,
    trees: int = 4, leaf_rows: int = 32, sample_rows: int = 512, block_rows: int = 1024, spill_sd: float = 0.5, seed: int = 5,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of ``vectors``.

    Vectors with equal labels link at a cosine of ``cosine`` or more, in double precision. Equal vectors of a label are
    one class, of which one takes part with the class's size as weight. Every label has ``trees`` trees of its own, split
    at random until a leaf is small against the label (four times the root of its rows, within ``leaf_rows`` and
    ``block_rows``); a split is fitted to about ``sample_rows`` rows of the node it
    splits, and every class is indexed, into both children where its projection is within the spill, ``spill_sd``
    standard deviations of the projected distance of two vectors that just link. Within a leaf all cosines are computed.
    A cluster too tight to be split is cut into blocks of ``block_rows`` rows about, all pairs of which are compared, so
    it costs time but is whole and no task holds it. Only counts and component roots leave a leaf, never pairs. Recall
    is below 1 only where all trees part a pair; the tests measure it against brute force.

    Null, empty or zero vectors, and those with null or non-finite components, null labels or null ids link with
    nothing: n_links 0, component_id = vec_id (null for a null id), kept true. Vectors of unequal length do not link;
    very long ones are compared whole. A cosine of exactly ``cosine`` links. Repeated rows count as vectors of their
    own; rows that share an id share a component. An empty table gives an empty table; other columns are not read.
    """
    ws = Workspace(vectors.sparkSession, "forest")
    vec = F.col("vec")
    fine = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & vec.isNotNull() & (F.size(vec) > 0)
        & F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(vec, lambda v: v != 0)
    )
    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec")).withColumn("fine", F.coalesce(fine, F.lit(False)))
    by = ["label", "h1", "h2"]
    keyed = given.withColumn("h1", F.xxhash64("vec")).withColumn("h2", F.xxhash64(F.lit(1), "vec"))
    # A class is numbered by its hashes; ids may stand for several classes.
    classes = keyed.where("fine").groupBy(*by).agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("vec").alias("vec"))
    classes = ws.stage(classes.withColumn("key", F.xxhash64(*by)).withColumn("size", F.size("vec")), "classes")
    rows = keyed.select("vec_id", "fine", *by)
    if classes.isEmpty():
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))

    def spill_of(width: int) -> float:
        return spill_sd * math.sqrt(max(0.0, 2 - 2 * cosine) / width)

    leaves = ws.stage(_grown(ws, classes, trees, leaf_rows, block_rows, sample_rows, spill_of, seed), "leaves")
    # Alone in a leaf there is nothing to compare with.
    counts = ws.stage(leaves.groupBy("leaf").agg(F.count("*").alias("n")).where("n > 1"), "leaf-counts")
    met = leaves.join(counts, "leaf")
    own = met.groupBy("key").agg(F.collect_list("leaf").alias("leaves"))  # a class is in a few leaves of each tree
    blocks = F.when(F.col("n") > block_rows, F.ceil(F.col("n") * 2 / block_rows)).otherwise(1).cast("int")
    met = met.select("key", "leaf", blocks.alias("blocks")).join(classes.select("key", "rep", "weight", "vec").join(own, "key"), "key")
    met = met.withColumn("block", F.pmod(F.xxhash64("key", F.lit(seed + 1)), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumn("b0", F.least("block", "other")).withColumn("b1", F.greatest("block", "other"))
    parts = ws.stage(
        met.select("leaf", "b0", "b1", "rep", "key", "weight", "vec", "leaves", "block").groupBy("leaf", "b0", "b1").applyInArrow(_leaf_worker(cosine), "key long, n long, rep long, root long"),
        "parts",
    )
    links = parts.groupBy("key").agg(F.sum("n").alias("n"))
    # Rows that share an id hold their classes together: each of them is linked to the smallest.
    named = rows.where("fine").join(classes.select(*by, "rep"), by).select("vec_id", "rep")
    many = named.groupBy("vec_id").agg(F.min("rep").alias("b"), F.max("rep").alias("last")).where("b <> last").select("vec_id", "b")
    same = named.join(many, "vec_id").select(F.col("rep").alias("a"), "b")
    found = connected_components(ws, parts.select(F.col("rep").alias("a"), F.col("root").alias("b")).unionByName(same))
    ws.keep("classes", "parts", "cc")
    of_class = classes.select(*by, "key", "rep", "weight").join(links, "key", "left").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    out = rows.join(of_class.withColumn("fine", F.lit(True)), [*by, "fine"], "left")
    out = out.select("vec_id", (F.coalesce("n", F.lit(0)) + F.coalesce("weight", F.lit(1)) - 1).alias("n_links"), F.coalesce("component", "rep", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
