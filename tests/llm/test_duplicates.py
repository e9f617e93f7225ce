"""Near-duplicate texts and embeddings, and the components they share, against brute force."""

import random
import re
from itertools import combinations

import duckdb
import numpy as np
from pyspark.sql import Row

from streamlanes.llm.common import Workspace, connected_components
from streamlanes.llm.near_dup import near_duplicates, shingle_set
from streamlanes.llm.registry import ORACLES, QUERIES
from streamlanes.llm.rp_forest import embedding_near_duplicates, leaf_links


def components(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(500, 200 + i) for i in range(40)] + [(7, 7)]
    df = spark.createDataFrame([*edges, (None, 1)], "a long, b long")
    want = components({i for e in edges for i in e}, edges)
    got = {r.node: r.component for r in connected_components(Workspace(spark, "t"), df).collect()}
    assert all(want[i] == got.get(i, i) for i in want) and len(got) == len(set(got))
    assert connected_components(Workspace(spark, "t"), df.where("false")).count() == 0


def texts(rng, words=120):
    vocabulary = [f"w{i}" for i in range(2000)]
    passage = rng.choices(vocabulary, k=70)
    out = {}
    for g in range(6):  # groups of edited copies around an original, some copies of copies
        base = rng.choices(vocabulary, k=words * (1 + g % 3))
        for _ in range(14):
            t = list(base)
            for _ in range(rng.randint(0, 5)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            out[len(out)] = " ".join(t)
            if rng.random() < 0.3:
                base = t
    for _ in range(25):  # a passage that many share, with little else
        out[len(out)] = " ".join(passage + rng.choices(vocabulary, k=rng.randint(5, 60)))
    for t in ("", "  \t", "one two", "ONE  two", "one two three four five", "One two three four five", "a b", "b a"):
        out[len(out)] = t
    out[len(out)] = None
    out[len(out)] = out[3]
    return out


def plain_sets(docs):
    """Shingle sets of (id, text) by words alone, apart from the code under test."""
    out = {}
    for i, t in docs:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        out[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    return out


def plain_links(sets, percent):
    return [(a, b) for a, b in combinations(sets, 2) if (m := len(sets[a] & sets[b])) and 100 * m >= percent * len(sets[a] | sets[b])]


def edited(rng, words, n):
    t = list(words)
    for _ in range(n):
        t[rng.randrange(len(t))] = f"x{rng.randrange(10**9)}"
    return t


def test_near_duplicates_match_brute_force(spark):
    for seed in (1, 2, 3):
        docs = texts(random.Random(seed))
        sets = plain_sets(docs.items())
        want = components(docs, plain_links(sets, 85))
        df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs.items()], "doc_id long, text string, n int, component string").repartition(3)
        got = {r.doc_id: r for r in near_duplicates(df, percent=85, k=32 if seed == 1 else 64, exact=seed == 3).collect()}
        assert {i: r.component_id for i, r in got.items()} == want
        assert all(r.n_shingles == len(sets[i]) and r.kept == (want[i] == i) for i, r in got.items())


def test_long_texts_near_the_threshold(spark):
    rng = random.Random(8)
    docs = {}
    for _ in range(12):  # 700 to 1600 words, around 0.80 of each other, no original among them
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(700, 1600))]
        for _ in range(10):
            docs[len(docs)] = " ".join(edited(rng, base, round(len(base) * rng.uniform(0.008, 0.016))))
    sets = plain_sets(docs.items())
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    near = sum(0.79 < (m := len(sets[a] & sets[b])) / (len(sets[a]) + len(sets[b]) - m) < 0.81 for a, b in combinations(sets, 2))
    assert near > 30 and min(map(len, sets.values())) > 512
    for exact in (False, True):
        got = {r.doc_id: r.component_id for r in near_duplicates(df, exact=exact).collect()}
        assert got == components(docs, plain_links(sets, 80))


def counted_pairs(monkeypatch):
    counts, stage = {}, Workspace.stage

    def counted(self, df, name, batch_rows=None):
        out = stage(self, df, name, batch_rows)
        if name.startswith("pairs-"):
            counts[name] = counts.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(Workspace, "stage", counted)
    return counts


def test_copies_that_differ_too_much_are_not_paired(spark, monkeypatch):
    """Many edited copies of a long text, none linked: what is compared stays far below all pairs."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(900)]
    df = spark.createDataFrame([(i, " ".join(edited(rng, base, 30))) for i in range(300)], "doc_id long, text string")
    counts = counted_pairs(monkeypatch)
    assert sum(r.kept for r in near_duplicates(df, percent=85).collect()) == 300
    assert max(counts.values()) <= 4 * 300 and counts.get("pairs-open", 0) < 300  # of 44,850 pairs


def pages(n, words, seed=4):
    """Pages of one template that is not among them: so many of its 200 words are changed, each to a word of its own."""
    rng, base = random.Random(seed), [f"w{i}" for i in range(200)]
    out = {}
    for i in range(n):
        t = list(base)
        for at in rng.sample(range(200), words):
            t[at] = f"x{rng.randrange(10**9)}"
        out[i] = " ".join(t)
    return out


def test_pages_of_a_template_are_not_all_paired(spark, monkeypatch):
    counts, seen = counted_pairs(monkeypatch), {}
    for words, n in ((2, 300), (2, 600), (3, 300)):
        docs = pages(n, words)
        counts.clear()
        got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), percent=85).collect()}
        assert got == components(docs, plain_links(plain_sets(docs.items()), 85)), (words, n)
        seen[words, n] = sum(counts.values())
        assert counts.get("pairs-open", 0) == 0  # no text moves for a pair of one template
    assert seen[2, 300] <= 0.12 * 44_850 and seen[2, 600] <= 0.1 * 179_700  # of all pairs
    assert seen[3, 300] <= 0.15 * 44_850


def test_templates_that_share_a_passage(spark):
    """Two templates with a common half and a page between them: groups meet, and no link is lost at 80."""
    docs = {}
    for i, t in pages(60, 3, 1).items():
        docs[i] = t
    for i, t in pages(60, 2, 2).items():
        docs[100 + i] = " ".join([*t.split()[:100], *(f"y{j}" for j in range(100))])
    docs[300] = " ".join([*(f"w{j}" for j in range(110)), *(f"y{j}" for j in range(10, 100))])
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert got == components(docs, plain_links(plain_sets(docs.items()), 80))


def test_near_duplicates_of_a_table_match_their_oracle(spark):
    con = duckdb.connect()
    for name, d in (("op6_bottom_k_near_dup", "sf0.001"), ("op3_rp_forest", "sf0.01"), ("op2_warc_normaliser", "sf0.01")):
        for t in ("documents", "embeddings", "pages"):
            con.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '/root/testdata/{d}/{t}.parquet'")
        got = QUERIES[name](spark, f"/root/testdata/{d}")
        want = con.sql(ORACLES[name])
        assert sorted(map(str, got.select(sorted(got.columns)).collect())) == sorted(map(str, (Row(**dict(zip(sorted(got.columns), r, strict=True))) for r in want.select(*sorted(got.columns)).fetchall())))


def test_shingles_by_words(spark):
    assert len(shingle_set([])) == 0 and len(shingle_set([b"a"])) == 1 and len(shingle_set([b"a"] * 9)) == 1
    assert not set(shingle_set([b"a"] * 4).tolist()) & set(shingle_set([b"a"] * 5).tolist())
    assert len(shingle_set([str(i).encode() for i in range(9)])) == 5


def test_near_duplicates_of_odd_rows(spark):
    schema = "doc_id long, text string"
    assert near_duplicates(spark.createDataFrame([], schema)).count() == 0
    assert [r.kept for r in near_duplicates(spark.createDataFrame([(1, None), (2, " ")], schema)).collect()] == [True, True]
    base = " ".join(map(str, range(200)))
    rows = [(None, base), (None, None), (5, base), (5, base), (9, base + " x"), (9, "something else"), (12, "something else")]
    got = sorted((tuple(r) for r in near_duplicates(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert [g[2] for g in got if g[0] is None] == [None, None] and all(g[3] for g in got if g[0] is None)
    assert {g[2] for g in got if g[0] in (5, 9, 12)} == {5}  # id 9 holds both its texts' groups together
    long = " ".join(map(str, range(60_000)))
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame([(1, long), (2, long + " y"), (3, "z")], schema)).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_an_id_with_three_texts_holds_their_groups_together(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (2, b), (3, c), (9, a), (9, b), (9, c)]
    for extra in ([], [(4, a + " x")]):  # without and with a near copy
        got = near_duplicates(spark.createDataFrame(rows + extra, "doc_id long, text string")).collect()
        assert len(got) == len(rows + extra) and {r.component_id for r in got} == {1}


def test_embeddings_match_brute_force(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 16))
    x = np.concatenate([centres[rng.integers(0, 40, 500)] + rng.standard_normal((500, 16)) * 0.12, np.repeat(centres[:1], 30, 0)]).astype(np.float32)
    labels = rng.integers(0, 3, len(x))
    odd = [(None, 1), ([], 1), ([0.0] * 16, 1), ([float("nan")] * 16, 1), ([float("inf")] + [0.0] * 15, 1), ([None] + [1.0] * 15, 1), (x[0].tolist(), None), ([1.0, 2.0], 1), ([2.0, 4.0], 1)]
    rows = [(i, v.tolist(), int(k), "x") for i, (v, k) in enumerate(zip(x, labels, strict=True))] + [(1000 + i, v, k, "x") for i, (v, k) in enumerate(odd)] + [(None, x[0].tolist(), int(labels[0]), "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rep string")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.98) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(near, False)
    want = components(range(len(x)), list(zip(*np.nonzero(np.triu(near)), strict=True)))
    got = {r.vec_id: r for r in embedding_near_duplicates(df, leaf_rows=16).collect()}
    assert len(got) == len(rows) and near.sum() > 500
    recall = sum(got[i].n_links for i in range(len(x))) / near.sum()
    assert 0.99 <= recall <= 1 and all(got[i].n_links <= near[i].sum() for i in range(len(x)))
    if recall == 1:
        assert all(got[i].component_id == want[i] for i in range(len(x)))
    assert all(got[1000 + i].n_links == 0 and got[1000 + i].kept for i in range(7)) and got[1007].n_links == got[1008].n_links == 1
    assert got[None].n_links == 0 and got[None].component_id is None and got[None].kept
    assert embedding_near_duplicates(df.where("false")).count() == 0
    assert [r.component_id for r in embedding_near_duplicates(df.where("vec_id in (1000, 1002)")).orderBy("vec_id").collect()] == [1000, 1002]


def test_links_of_leaves_match_brute_force():
    rng = np.random.default_rng(6)
    n = 90
    x = np.repeat(rng.standard_normal((9, 6)), 10, 0) + rng.standard_normal((n, 6)) * 0.1
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rep, weight, side = rng.permutation(n) + 100, rng.integers(1, 4, n), rng.integers(0, 2, n)
    others = [set(rng.choice(7, 2).tolist()) for _ in range(n)]
    smaller = (np.repeat(np.arange(n), [len(o) for o in others]), np.array([k for o in others for k in sorted(o)]))
    for sides in (np.zeros(n, int), side):
        near = {(i, j) for i in range(n) for j in range(n) if i != j and x[i] @ x[j] >= 0.98 and (sides is not side or side[i] != side[j])}
        counts = [sum(int(weight[j]) for j in range(n) if (i, j) in near and not others[i] & others[j]) for i in range(n)]
        whole = components(rep.tolist(), [(int(rep[i]), int(rep[j])) for i, j in near])
        got_counts, root, met = leaf_links(rep, weight, x, smaller, sides, 0.98, chunk=32)
        assert got_counts.tolist() == counts and met.tolist() == sorted({i for i, _ in near})
        assert root.tolist() == [whole[int(r)] for r in rep]


def test_a_cluster_too_tight_to_be_split_is_whole(spark):
    rng = np.random.default_rng(8)
    centre = rng.standard_normal((2, 24))
    x = (centre[np.arange(600) % 5 // 4] + rng.standard_normal((600, 24)) * 1e-3).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {(r.n_links, r.component_id, r.vec_id % 5 // 4) for r in embedding_near_duplicates(df, leaf_rows=16, block_rows=64, sample_rows=128).collect()}
    assert got == {(479, 0, 0), (119, 4, 1)}


def test_vectors_that_share_an_id_share_a_component(spark):
    x, y, z = ([float(i == j) for j in range(4)] for i in range(3))
    rows = [(5, x, 1), (5, y, 1), (3, y, 1), (5, z, 2), (4, z, 2), (8, z, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = embedding_near_duplicates(df).collect()
    assert len(got) == len(rows) and {(r.vec_id, r.component_id) for r in got} == {(5, 3), (3, 3), (4, 3), (8, 8)}
