"""Sequence model over the merged stream of word events: sessions, transitions, predictions, rolling errors.

Probabilities, smoothing and back-off are this library's own definitions: an event's state is the words since the last idle, at
most ``history`` of them; a word's probability is its count after that state over the state's; smoothing adds a
constant to each word's count.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .motifs import BEGIN, NONE
from .ordering import PART, carried, in_parts, numbered_parts, position, running_sums, with_lead
from .staging import staged

IDLE = "idle"


def check_vocabulary(words: Mapping[int, Sequence[str]], numeric: Sequence[int], begin: str = BEGIN, none: str = NONE, idle: str = IDLE) -> None:
    """Numeric lanes know exactly none, begin and idle; the others at least none and idle."""
    for lane, known in words.items():
        if lane in numeric and set(known) != {none, begin, idle}:
            raise ValueError(f"lane {lane} must know {none}, {begin} and {idle} only")
        if not {none, idle} <= set(known):
            raise ValueError(f"lane {lane} must know {none} and {idle}")


def word_events(stream: DataFrame, numeric: int, begin: str = BEGIN, none: str = NONE) -> DataFrame:
    """Elements that are words: motif starts of numeric lanes, anything but ``none`` of the others; with ``word``."""
    keep = F.when(F.col("channel") < numeric, F.col("label") == begin).otherwise(F.col("label") != none)
    return stream.where(keep).withColumn("word", F.concat_ws(":", F.col("channel").cast("string"), F.col("label")))


def idle_timeouts(stream: DataFrame, numeric: int, timeout_ms: int, begin: str = BEGIN, none: str = NONE) -> DataFrame:
    """(time_ms, channel, pos) of the rows at which the stream goes idle.

    Between two labels other than ``none`` the first row at least ``timeout_ms`` after the first of them is a candidate;
    it fires if a word came since the candidate before. Runs are numbered by running sums over buckets of time, so the
    merged stream is never in one task; runs are then grouped, and only candidates are ordered among themselves.
    """
    return _idle_rows(in_parts(stream.select("time_ms", "channel", "pos", "label"), MERGED), numeric, timeout_ms, begin, none).select(*MERGED)


#: The order of the merged stream.
MERGED = ("time_ms", "channel", "pos")


def _idle_rows(rows: DataFrame, numeric: int, timeout_ms: int, begin: str, none: str) -> DataFrame:
    """(time_ms, channel, pos, part) of the rows of a stream in parts at which it goes idle."""
    is_word = F.when(F.col("channel") < numeric, F.col("label") == begin).otherwise(F.col("label") != none)
    rows = running_sums(rows, {"run": F.col("label") != none, "words": is_word}).where(F.col("label") == none)
    rows = staged(rows.select(*MERGED, PART, "run", "words"))
    first = rows.groupBy("run").agg(F.min("time_ms").alias("since"))
    late = rows.join(first, "run").where(F.col("time_ms") - F.col("since") >= timeout_ms)
    candidate = late.groupBy("run").agg(F.min(F.struct(*MERGED, "words", PART)).alias("c")).select("c.*")
    # Of candidates with the same number of words so far, the first fires; at none at all, none does.
    fired = candidate.where("words > 0").groupBy("words").agg(F.min(F.struct(*MERGED, PART)).alias("c"))
    return fired.select("c.*")


def sessions(stream: DataFrame, numeric: int, timeout_ms: int, begin: str = BEGIN, none: str = NONE) -> DataFrame:
    """Word events (time_ms, channel, pos, word) with ``seq``, their place in the merged order, and ``session``, the number of times it was idle before.

    The stream is cut into parts of the merged order once; its words, its idle times and their numbers all stay in them.
    """
    rows = in_parts(stream.select("time_ms", "channel", "pos", "label"), MERGED)
    words = word_events(rows, numeric, begin, none).select(*MERGED, PART, "word")
    idle = _idle_rows(rows, numeric, timeout_ms, begin, none).withColumn("word", F.lit(None).cast("string"))
    both = running_sums(words.unionByName(idle), {"session": F.col("word").isNull(), "seq": F.col("word").isNotNull()})
    return both.where("word IS NOT NULL").withColumn("seq", F.col("seq") - 1).drop(PART)


def with_states(events: DataFrame, history: int = 100) -> DataFrame:
    """Word events with ``state``: up to ``history`` words before them in their session, joined by blanks (empty at its start).

    Events are numbered, so they are cut into parts that overlap by ``history``: a session may last as long as the stream.
    """
    before = Window.partitionBy(PART, "session").orderBy("seq").rowsBetween(-history, -1)
    rows = with_lead(events, "seq", history).withColumn("state", F.array_join(F.collect_list("word").over(before), " "))
    return rows.where("own").drop("own", PART)


#: A state in short, as it may be a hundred words long: two hashes of 64 bits. Counting and ordering go by these.
KEY = ("h1", "h2")


def keyed(df: DataFrame) -> DataFrame:
    """``df`` with the key of its ``state``."""
    return df.withColumns({"h1": F.xxhash64("state"), "h2": F.xxhash64(F.lit(1), F.col("state"))})


def transition_counts(states: DataFrame) -> DataFrame:
    """(state, word, n): the model as a table."""
    return states.groupBy("state", "word").agg(F.count("*").alias("n"))


def probabilities(counts: DataFrame, smoothing: float = 0.0, n_words: int | None = None) -> DataFrame:
    """Transition counts with ``p``, the word's share of its state's, each word's count raised by ``smoothing``."""
    total = F.sum("n").over(Window.partitionBy("state")) + smoothing * (n_words or 0)
    return counts.withColumn("p", (F.col("n") + smoothing) / total)


def _suffixes(states: DataFrame, longest: int) -> DataFrame:
    """``states`` with a row for each suffix of 1 to ``longest`` words: its length ``k`` and two hashes of it, ``h1`` and ``h2``."""
    words = F.when(F.col("state") == "", F.array().cast("array<string>")).otherwise(F.split("state", " "))
    rows = states.withColumn("__words", words).where(F.size("__words") > 0)
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(1), F.least(F.size("__words"), F.lit(longest)))))
    suffix = F.array_join(F.slice("__words", -F.col("k"), F.col("k")), " ")
    return rows.withColumn("h1", F.xxhash64(suffix)).withColumn("h2", F.xxhash64(F.lit(1), suffix)).drop("__words")


def suffix_index(states: DataFrame, longest: int = 8) -> DataFrame:
    """(k, h1, h2, word, n): how often each word came after each suffix of up to ``longest`` words of its state; k = 0 is the empty one.

    Suffixes are told by two 64-bit hashes, so rows stay short whatever the history.
    """
    rows = _suffixes(states.select("state", "word"), longest).groupBy("k", "h1", "h2", "word").agg(F.count("*").alias("n"))
    empty = states.groupBy("word").agg(F.count("*").alias("n")).select(F.lit(0).alias("k"), F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"), "word", "n")
    return rows.unionByName(empty)


def smoothed_lookup(events: DataFrame, index: DataFrame, *, smoothing: float = 0.0, n_words: int = 0, longest: int = 8) -> DataFrame:
    """``events`` (seq, state, word, ...) with ``k``, ``n``, ``total`` and ``p``: the word's share after the longest suffix of its state that the index has.

    A state that was never seen backs off to its longest known suffix, at last to the empty one, which says how frequent
    words are. Each of ``n_words`` words counts ``smoothing`` more, so a word never seen after that suffix gets
    smoothing / (total + n_words * smoothing). Suffixes meet by equality of hashes; the empty one is joined by word, so
    no key gathers all events. An empty index gives k, n and total of 0 and, without smoothing, no p.
    """
    index = staged(index)
    totals = staged(index.where("k > 0").groupBy("k", "h1", "h2").agg(F.sum("n").alias("total")))
    of_all = index.where("k = 0").agg(F.sum("n")).first()[0] or 0
    known = _suffixes(events.select("seq", "state"), longest).join(totals, ["k", "h1", "h2"])
    best = known.groupBy("seq").agg(F.max(F.struct("k", "h1", "h2", "total")).alias("best")).select("seq", "best.*")
    rows = staged(events.join(best, "seq", "left"))
    deep = rows.where("k IS NOT NULL").join(index.where("k > 0"), ["k", "h1", "h2", "word"], "left")
    flat = rows.where("k IS NULL").drop("k", "total").join(index.where("k = 0").select("word", "n"), "word", "left").withColumn("k", F.lit(0)).withColumn("total", F.lit(of_all).cast("long"))
    both = deep.drop("h1", "h2").unionByName(flat.drop("h1", "h2")).withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return both.withColumn("p", F.try_divide(F.col("n") + F.lit(float(smoothing)), F.col("total") + F.lit(float(smoothing * n_words))))


def predictions(states: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """Word events with ``predicted``: the likeliest word after their state by the events before them; ties go to the first word.

    ``earlier`` (state, word, n) counts events before those of ``states``.

    Counts only grow, so the likeliest word so far is that of the earlier event with the highest running count. Counts
    and the best so far are summed up by parts of the stream first: no state, the empty one least, is gone through in
    one task.
    """
    given = staged(keyed(states))
    return given.join(likeliest(given, None if earlier is None else keyed(earlier)).select("seq", "predicted"), "seq").drop(*KEY)


def likeliest(states: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """(seq, word, predicted) of ``predictions``, for staged tables with keys: states stay where they are."""
    rows = numbered_parts(states.select("seq", *KEY, "word"), "seq")
    counts = rows.groupBy(*KEY, "word", PART).agg(F.count("*").alias("n"))
    if earlier is not None:
        counts = counts.unionByName(earlier.select(*KEY, "word", F.lit(-1).cast("long").alias(PART), "n"))
    counts = staged(counts)
    before = carried(counts, {"n": "sum"}, [*KEY, "word"]).withColumnRenamed("n", "start")
    counts = counts.join(before, [*KEY, "word", PART]).withColumn("start", F.coalesce("start", F.lit(0)))
    # The most frequent word at the end of a part, the first by name where counts tie; then of all parts before.
    tops = counts.groupBy(*KEY, PART).agg(F.min(F.struct((-(F.col("start") + F.col("n"))).alias("c"), F.col("word"))).alias("top"))
    tops = carried(tops, {"top": "min"}, KEY).withColumnRenamed("top", "carried")
    nth = F.row_number().over(Window.partitionBy(*KEY, "word", PART).orderBy("seq"))
    counted = rows.join(counts.select(*KEY, "word", PART, "start"), [*KEY, "word", PART]).withColumn("c", -(F.col("start") + nth))
    inside = F.min(F.struct("c", "word")).over(Window.partitionBy(*KEY, PART).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    best = counted.join(tops, [*KEY, PART]).withColumn("best", F.least(inside, F.col("carried")))
    return best.select("seq", "word", F.col("best")["word"].alias("predicted"))


def rolling_errors(predicted: DataFrame, numeric: int, last: int = 100, counts: bool = False) -> DataFrame:
    """Word events with ``error`` and ``char_error``: shares of wrong predictions among the last ``last`` ones.

    The second counts events whose word or prediction is of a string lane, and stays as it was elsewhere (null before
    the first). With ``counts`` also how many are counted (n, char_n), how many of them are wrong (wrong_n, char_wrong_n)
    and how many of the second kind came before (char_before). Events are numbered and cut into parts that overlap by
    ``last``, so no task needs the whole stream.
    """
    rows = with_outcomes(predicted, numeric)
    out = _rolling(rows, "seq", last, "")
    chars = char_errors(rows, last)
    # An event carries the value of the last char event up to it, which has the same running number.
    joined = out.join(chars, "char_no", "left").withColumn("char_before", F.col("char_no") - F.col("char")).drop("wrong", "char", "char_no")
    return joined if counts else joined.drop("n", "wrong_n", "char_n", "char_wrong_n", "char_before")


def with_outcomes(predicted: DataFrame, numeric: int, chars_before: int = 0) -> DataFrame:
    """Predicted word events, staged, with ``wrong`` and ``char`` (0 or 1) and ``char_no``, the char events up to and with each, ``chars_before`` of them before all."""
    wrong = (F.col("predicted").isNull() | (F.col("predicted") != F.col("word"))).cast("long")
    lane = lambda c: F.split_part(c, F.lit(":"), F.lit(1)).cast("long")
    char = (lane(F.col("word")) >= numeric) | (F.coalesce(lane(F.col("predicted")), F.lit(-1)) >= numeric)
    rows = numbered_parts(predicted.withColumn("wrong", wrong).withColumn("char", char.cast("long")), "seq")
    rows = running_sums(rows, {"char_no": F.col("char")}, order=["seq"]).drop(PART)
    return staged(rows.withColumn("char_no", F.col("char_no") + chars_before))


def char_errors(rows: DataFrame, last: int) -> DataFrame:
    """(char_no, char_error, char_n, char_wrong_n) of the char events among ``rows``."""
    chars = rows.where("char = 1").withColumn("place", F.col("char_no") - 1)
    return _rolling(chars, "place", last, "char_").select("char_no", "char_error", "char_n", "char_wrong_n")


def _rolling(rows: DataFrame, place: str, last: int, name: str) -> DataFrame:
    w = Window.partitionBy(PART).orderBy(place).rowsBetween(-(last - 1), 0)
    out = with_lead(rows, place, last - 1).withColumns({f"{name}n": F.count("*").over(w), f"{name}wrong_n": F.sum("wrong").over(w), f"{name}error": F.avg("wrong").over(w)})
    return out.where("own").drop(PART, "own")


def model_sizes(states: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """(seq, n_states, n_transitions) after each word event: distinct ones seen so far, without those of ``earlier`` (state, word). First times come from grouping, not from a state's window."""
    return sizes(staged(keyed(states).select("seq", *KEY, "word")), None if earlier is None else keyed(earlier))


def sizes(rows: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """``model_sizes`` for staged tables with keys."""
    def firsts(*by: str) -> DataFrame:
        found = rows.groupBy(*by).agg(F.min("seq").alias("seq"))
        return found if earlier is None else found.join(earlier.select(*by).distinct(), list(by), "left_anti")

    new = firsts(*KEY).select("seq", F.lit(1).alias("s"), F.lit(0).alias("t"))
    new = new.unionByName(firsts(*KEY, "word").select("seq", F.lit(0).alias("s"), F.lit(1).alias("t")))
    every = rows.select("seq", F.lit(0).alias("s"), F.lit(0).alias("t")).unionByName(new).groupBy("seq").agg(F.max("s").alias("s"), F.max("t").alias("t"))
    return running_sums(numbered_parts(every, "seq"), {"n_states": F.col("s"), "n_transitions": F.col("t")}, order=["seq"]).select("seq", "n_states", "n_transitions")


def finish_model(counts: Mapping[tuple[str, str], float], current: str, idle: str = IDLE) -> dict[str, float]:
    """Close an order-1 model (previous word, word) with a move to idle where it needs one, and return its least error, entropy and perplexity rates.

    Rates weigh each state by the stationary distribution. Models of fewer than three states give none.
    """
    moves = dict(counts)
    names = sorted({s for s, _ in moves} | {w for _, w in moves} | {idle})
    place = {s: i for i, s in enumerate(names)}

    def reach(a: np.ndarray) -> np.ndarray:
        seen = a | np.eye(len(a), dtype=bool)
        while True:
            more = (seen.astype(int) @ seen.astype(int)) > 0
            if (more == seen).all():
                return seen
            seen = more

    def table() -> np.ndarray:
        t = np.zeros((len(names), len(names)))
        for (s, w), n in moves.items():
            t[place[s], place[w]] += n
        return t

    if current != idle and not reach(table() > 0).all():
        moves[(current, idle)] = moves.get((current, idle), 0) + 1
    t = table()
    if len(names) < 3:
        return {}
    total = t.sum(axis=1, keepdims=True)
    p = np.where(total > 0, t / np.where(total > 0, total, 1), 1 / len(names))
    a = np.vstack([p.T - np.eye(len(p)), np.ones(len(p))])
    stationary = np.clip(np.linalg.lstsq(a, np.append(np.zeros(len(p)), 1.0), rcond=None)[0], 0, None)
    stationary /= stationary.sum()
    entropy = float(-(stationary[:, None] * p * np.log2(np.where(p > 0, p, 1))).sum())
    return {"min_error": float((stationary * (1 - p.max(axis=1))).sum()), "entropy_rate": entropy, "perplexity_rate": 2**entropy}


# The finished model as tables ----------------------------------------------------------------------------------------

def order_one_moves(events: DataFrame, idles: DataFrame, idle: str = IDLE) -> DataFrame:
    """(state, word, n): moves from each word to the next, from ``idle`` to a session's first word and back from its last, for ``sessions`` and ``idle_timeouts``."""
    events = staged(events.select("seq", "session", "word"))
    within = with_states(events, 1).select(F.when(F.col("state") == "", idle).otherwise(F.col("state")).alias("state"), "word")
    closed = events.groupBy("session").agg(F.max_by("word", "seq").alias("state")).where(F.col("session") < idles.count()).select("state", F.lit(idle).alias("word"))
    return within.unionByName(closed).groupBy("state", "word").agg(F.count("*").alias("n"))


def current_state(events: DataFrame, idles: DataFrame, idle: str = IDLE) -> str:
    """The last word, or ``idle`` where it went idle since, or nothing came."""
    last = events.agg(F.max(F.struct("seq", "session", "word")).alias("last")).first()["last"]
    return idle if last is None or last["session"] < idles.count() else last["word"]


def reachable(moves: DataFrame, start: str, back: bool = False) -> DataFrame:
    """(node) that moves lead to from ``start``, itself included, or from which they lead to it if ``back``: a join for each step away."""
    a, b = ("word", "state") if back else ("state", "word")
    edges = staged(moves.select(F.col(a).alias("a"), F.col(b).alias("node")).distinct())
    seen = frontier = staged(moves.sparkSession.createDataFrame([(start,)], "node string"))
    while True:
        following = edges.join(frontier.withColumnRenamed("node", "a"), "a").select("node").distinct()
        frontier = staged(following.join(seen, "node", "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = staged(seen.unionByName(frontier))


def finish_moves(moves: DataFrame, current: str, idle: str = IDLE) -> DataFrame:
    """``moves`` with one from ``current`` to ``idle`` where it is not idle and some word cannot be reached from, or cannot reach, ``idle``: strong connection by reach in both directions."""
    moves = staged(moves)
    if current == idle:
        return moves
    nodes = moves.select(F.col("state").alias("node")).unionByName(moves.select(F.col("word").alias("node"))).distinct()
    both = reachable(moves, idle).join(reachable(moves, idle, back=True), "node")
    if nodes.join(both, "node", "left_anti").isEmpty():
        return moves
    more = moves.sparkSession.createDataFrame([(current, idle, 1)], "state string, word string, n long")
    return moves.unionByName(more).groupBy("state", "word").agg(F.sum("n").alias("n"))


#: A node of no word's name, through which nodes that nothing leaves share out their weight.
_EVEN = "\0even"


def stationary(shares: DataFrame, nodes: DataFrame, *, tolerance: float = 1e-12, steps: int = 1000, together: int = 8) -> DataFrame:
    """(node, weight): the distribution that moves by ``shares`` (state, word, p) leave as it is, by power iteration from the even one.

    Half of the weight stays in each step, so that cycles settle. Nodes that nothing leaves share their weight out
    evenly, through a node of their own that is left out at the end. ``together`` steps, a join and a sum each, are one
    job, whose result is staged, until no weight changes by more than ``tolerance``.
    """
    n = nodes.count()
    dangling = nodes.join(shares.select(F.col("state").alias("node")).distinct(), "node", "left_anti")
    edges = shares.select(F.col("state").alias("a"), F.col("word").alias("b"), (F.col("p") / 2).alias("p"))
    edges = edges.unionByName(nodes.select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0.5).alias("p")))
    edges = edges.unionByName(dangling.select(F.col("node").alias("a"), F.lit(_EVEN).alias("b"), F.lit(0.5).alias("p")))
    edges = staged(edges.unionByName(nodes.select(F.lit(_EVEN).alias("a"), F.col("node").alias("b"), F.lit(1.0 / max(n, 1)).alias("p"))))
    weights = staged(nodes.select("node", F.lit(1.0 / max(n, 1)).alias("weight")))
    for _ in range(0, steps, together):
        now = weights
        for _ in range(together):
            now = now.join(edges, F.col("node") == F.col("a")).groupBy(F.col("b").alias("node")).agg(F.sum(F.col("weight") * F.col("p")).alias("weight"))
        now = staged(now)
        change = now.join(weights.withColumnRenamed("weight", "before"), "node", "left").agg(F.max(F.abs(F.col("weight") - F.coalesce("before", F.lit(0.0))))).first()[0]
        weights = now
        if change is None or change <= tolerance:
            break
    real = staged(weights.where(F.col("node") != _EVEN))
    total = real.agg(F.sum("weight")).first()[0]
    return real.select("node", (F.col("weight") / F.lit(total)).alias("weight"))


def model_rates(moves: DataFrame, idle: str = IDLE) -> DataFrame:
    """(n_states, min_error, entropy_rate, perplexity_rate) of finished moves; rates are null for fewer than three states.

    Rates weigh each state by the stationary distribution: how often the likeliest next word is wrong, and the bits that
    the next word tells.
    """
    moves = staged(moves)
    only_idle = moves.sparkSession.createDataFrame([(idle,)], "node string")
    nodes = staged(moves.select(F.col("state").alias("node")).unionByName(moves.select(F.col("word").alias("node"))).unionByName(only_idle).distinct())
    n = nodes.count()
    if n < 3:
        none = F.lit(None).cast("double")
        return only_idle.select(F.lit(n).cast("long").alias("n_states"), none.alias("min_error"), none.alias("entropy_rate"), none.alias("perplexity_rate"))
    totals = moves.groupBy("state").agg(F.sum("n").alias("total"))
    shares = staged(moves.join(totals, "state").select("state", "word", (F.col("n") / F.col("total")).alias("p")))
    own = shares.groupBy(F.col("state").alias("node")).agg((1 - F.max("p")).alias("error"), F.sum(-F.col("p") * F.log2("p")).alias("bits"))
    weighed = stationary(shares, nodes).join(own, "node", "left")
    error, bits = F.coalesce("error", F.lit(1 - 1 / n)), F.coalesce("bits", F.lit(float(np.log2(n))))
    rates = weighed.agg(F.sum(F.col("weight") * error).alias("min_error"), F.sum(F.col("weight") * bits).alias("entropy_rate"))
    return rates.select(F.lit(n).cast("long").alias("n_states"), "min_error", "entropy_rate", F.pow(F.lit(2.0), "entropy_rate").alias("perplexity_rate"))
