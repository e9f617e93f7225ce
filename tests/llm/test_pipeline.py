"""The corpus pipeline, stage by stage, against what its operators say of the same rows."""

from collections import Counter

import corpus_pipeline as pipeline
from streamlanes.llm.common import Workspace
from streamlanes.llm.decontam import tokens_of
from streamlanes.llm.near_dup import overlap, shingle_set
from streamlanes.llm.common import words_of

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    ws = Workspace(spark, "t")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in pipeline.STAGES:
        docs = ws.stage(stage(spark, docs, SF), name)
        seen.append(docs)
        if name != "token_files":
            assert docs.columns == columns
    start, good, unique, clean, mixed, tokens = ([r.asDict() for r in d.collect()] for d in seen)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in good}
    judged = [r["doc_id"] for r in start if r["doc_id"] in labels]
    assert sum((labels[i] == 1) == (i in kept) for i in judged) / len(judged) > 0.93
    sets = {r["doc_id"]: shingle_set(words_of(r["text"])) for r in good}
    left = {r["doc_id"] for r in unique}
    near = lambda a, b: (m := overlap(sets[a], sets[b])) and 100 * m >= 80 * (len(sets[a]) + len(sets[b]) - m)
    assert not any(near(a, b) for a in left for b in left if a < b)
    assert all(any(near(a, b) for b in sets if b != a) for a in set(sets) - left)
    items = [" ".join(tokens_of(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    has = lambda r: any(f" {i} " in f" {' '.join(tokens_of(r['text']))} " for i in items)
    assert not any(map(has, clean)) and {r["doc_id"] for r in unique if not has(r)} >= {r["doc_id"] for r in clean}
    assert len(clean) >= 0.9 * len(unique)
    times = Counter(r["doc_id"] for r in mixed)
    assert set(times.values()) <= {1, 2} and set(times) <= {r["doc_id"] for r in clean}
    words = lambda rs: sum(len(words_of(r["text"])) for r in rs)
    assert abs(words(mixed) / words(clean) - 1.5) < 0.1  # sources are small here
    assert Counter(r["doc_id"] for r in tokens) == times
    assert sorted(tuple(r) for r in pipeline.run(spark, SF).collect()) == sorted(tuple(r.values()) for r in tokens)


def test_one_row_of_a_repeated_id_stays(spark):
    rows = [(1, "a b c d e f", "en", "s", 1), (1, "a b c d e f", "en", "s", 1), (2, "a b c d e f", "en", "s", 1), (None, "x", None, None, None), (None, "x", None, None, None), (3, None, None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = [r.doc_id for r in pipeline.near_duplicate(spark, docs, SF).collect()]
    assert sorted(got, key=str) == [1, 3, None, None]
    mixed = pipeline.mix(spark, docs, SF)
    assert mixed.columns == docs.columns and pipeline.mix(spark, docs.where("false"), SF).count() == 0


def test_stages_with_clashing_columns_and_odd_rows(spark):
    """Extra columns named as the stages' own, null and empty texts, a long one, repeated rows, null ids and sources."""
    extra = ("size", "copies", "rows", "nth_row", "copy", "key", "h", "text_key", "mix_size", "Label", "quality", "count")
    fine = "The river runs quietly past the old mill and people walk there. "
    texts = [None, "", " ", "short", fine * 5, fine * 3000, "one more plain sentence of text, written for nobody."]
    rows = [(i, t, "en", "s" if i % 2 else None, 1, *range(100, 100 + len(extra))) for i, t in enumerate(texts)]
    rows += [rows[6]] * 2 + [(None, "a text without an id", None, "s", None, *[None] * len(extra))] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in extra))
    before = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions")}
    for name, stage in pipeline.STAGES:
        for df in (docs, docs.where("false")):
            out = stage(spark, df, SF)
            got = out.collect()
            if name != "token_files":
                assert out.columns == docs.columns and {tuple(r) for r in got} <= set(rows), name
            if df is not docs:
                assert not got
            elif name == "decontamination":
                assert len(got) == len(rows)
            elif name == "near_duplicates":
                assert sorted((r.doc_id for r in got), key=str) == [0, 1, 2, 3, 4, 6, None, None]  # 5 has the same shingles as 4
            elif name == "mixing":
                assert not {0, 1, 2} & {r.doc_id for r in got} and max(Counter(r.doc_id for r in got).values()) <= 6
            elif name == "token_files":
                assert len(got) == len(rows)
    assert before == {k: spark.conf.get(k) for k in before}


def test_near_copies_from_0_8_on_go(spark):
    base = [f"w{i}" for i in range(204)]  # 200 shingles
    at = lambda n: " ".join(base[:-n] + [f"x{n}.{i}" for i in range(n)])
    texts = {1: " ".join(base), 2: at(22), 3: "other " * 3, 4: at(30)}  # 178 of 222 shared, 0.802; 170 of 230 with 1, 170 of 230 with 2
    sets = {i: shingle_set(words_of(t)) for i, t in texts.items()}
    share = lambda a, b: (m := overlap(sets[a], sets[b])) / (len(sets[a]) + len(sets[b]) - m)
    assert 0.8 <= share(1, 2) < 0.85 and max(share(1, 4), share(2, 4)) < 0.8
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in pipeline.near_duplicate(spark, docs, SF).collect()) == [1, 3, 4]
