"""Back-off through suffixes, and the finished model as tables, against plain loops and numpy."""

import random
from collections import Counter

import pytest

from streamlanes.operators import langmodel


def test_lookups_back_off_to_the_longest_known_suffix(spark):
    rng = random.Random(4)
    events = []
    for session in range(30):
        words = rng.choices("abcd", [5, 3, 2, 1], k=rng.randint(1, 9))
        events += [(len(events) + i, session, " ".join(words[max(0, i - 5) : i]), w) for i, w in enumerate(words)]
    df = spark.createDataFrame(events, "seq long, session long, state string, word string")
    counts = Counter()
    for _, session, state, word in events:
        if session < 20:
            ws = state.split()
            counts.update((tuple(ws[len(ws) - k :]), word) for k in range(min(len(ws), 3) + 1))
    totals = Counter()
    for (suffix, _), n in counts.items():
        totals[suffix] += n
    index = langmodel.suffix_index(df.where("session < 20"), 3)
    for smoothing in (0.0, 0.25):
        got = {r.seq: (r.k, r.n, r.total, r.p) for r in langmodel.smoothed_lookup(df.where("session >= 20"), index, smoothing=smoothing, n_words=4, longest=3).collect()}
        for seq, session, state, word in events:
            if session >= 20:
                ws = state.split()
                k = max(k for k in range(min(len(ws), 3) + 1) if tuple(ws[len(ws) - k :]) in totals)
                suffix = tuple(ws[len(ws) - k :])
                n, total = counts[suffix, word], totals[suffix]
                assert got[seq] == (k, n, total, pytest.approx((n + smoothing) / (total + 4 * smoothing)))
        assert len(got) == sum(e[1] >= 20 for e in events) and {g[0] for g in got.values()} >= {0, 3}
    none = langmodel.smoothed_lookup(df.where("seq < 2"), index.where("false"), longest=3).collect()
    assert [(r.k, r.n, r.total, r.p) for r in none] == [(0, 0, 0, None)] * 2


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_tables_finish_a_model_as_the_matrix_does(spark, seed):
    rng = random.Random(seed)
    words = [rng.choice("abcde") for _ in range(12)]
    moves = Counter(zip(["idle", *words], words))
    if seed == 2:
        moves["e", "idle"] += 2
    current = "idle" if seed == 3 else words[-1]
    if seed == 3:
        moves[words[-1], "idle"] += 1
    df = spark.createDataFrame([(s, w, n) for (s, w), n in moves.items()], "state string, word string, n long")
    finished = langmodel.finish_moves(df, current)
    got = langmodel.model_rates(finished).first()
    want = langmodel.finish_model(moves, current)
    assert (got.min_error, got.entropy_rate, got.perplexity_rate) == tuple(pytest.approx(want[k], abs=1e-8) for k in ("min_error", "entropy_rate", "perplexity_rate"))
    assert {r.node for r in langmodel.reachable(df, "idle").collect()} >= {"idle", words[0]}


def test_small_models_have_no_rates(spark):
    df = spark.createDataFrame([("idle", "a", 3)], "state string, word string, n long")
    got = langmodel.model_rates(langmodel.finish_moves(df, "a")).first()
    assert (got.n_states, got.min_error) == (2, None)
    assert sorted(map(tuple, langmodel.finish_moves(df, "a").collect())) == [("a", "idle", 1), ("idle", "a", 3)]
