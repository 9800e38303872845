"""Solution selection by outcome patterns.

Distances are Hamming distances between the outcome rows of two solutions of
the same problem.  Rows are packed into 63-test words first, so a pair costs
one ``bit_count(a ^ b)`` per word instead of one joined row per test, and a
problem with very many tests spreads its pair work over ``(problem, word)``
keys instead of landing in one task.

Only the operators whose *output* is pairwise (C8) or a best triple (C9)
build solution pairs; the "similar" selection (S2) never does: total
distance to all others (C10) comes from per-test pass counts, and the nearest
distance to a seed set (C11) joins against at most four seeds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .outcomes import P, S, T, expand_join, solution_pass_rate, test_pass_mean
from ..session import cut_lineage
from .suites import seeded_key

WORD = 63  # tests per packed word (bit 63 left clear so every word is a non-negative long)

# fixed values of the diverse selection
MID_LOW, MID_HIGH = 0.4, 0.9  # candidate band: MID_LOW <= rate < MID_HIGH
EXTRA_MIN = 0.1  # fallback pool: rate > EXTRA_MIN
PICKS = 5


def packed_solutions(outcomes: DataFrame) -> DataFrame:
    """(problem_id, solution_id, words, n_tests, n_pass): each solution's whole outcome row as one bit array.

    Word i holds tests 63 i to 63 i + 62 (a missing cell is a zero bit), so two
    rows compare word by word, equal arrays are identical rows, and every
    selection below reads this one narrow table instead of the cells.
    Materialised once (reliable checkpoint).
    """
    bit = F.when(F.col("pass"), F.expr(f"shiftleft(1L, CAST({T} % {WORD} AS INT))")).otherwise(F.lit(0).cast("long"))
    word = F.floor(F.col(T) / WORD).cast("int")
    by_word = outcomes.groupBy(P, S, word.alias("word")).agg(
        F.bit_or(bit).alias("bits"), F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.col("pass"), F.lit(False))).alias("k")
    )
    held = by_word.groupBy(P, S).agg(
        F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("held"), F.max("word").alias("last"), F.sum("n").alias("n_tests"), F.sum("k").alias("n_pass")
    )
    words = F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.coalesce(F.col("held")[i], F.lit(0).cast("long")))
    return cut_lineage(held.select(P, S, words.alias("words"), "n_tests", "n_pass"))


def word_distance(a: Column, b: Column) -> Column:
    """Hamming distance of two bit arrays (the shorter one is filled with zeros)."""
    zero = F.lit(0).cast("long")
    differ = F.zip_with(a, b, lambda x, y: F.bit_count(F.coalesce(x, zero).bitwiseXOR(F.coalesce(y, zero))).cast("long"))
    return F.aggregate(differ, zero, lambda s, x: s + x)


def rate_of_packed() -> Column:
    return (F.col("n_pass").cast("double") / F.col("n_tests")).alias("pass_rate")


def packed_rows(outcomes: DataFrame) -> DataFrame:
    """(problem_id, solution_id, word, bits): each solution's outcome row in 63-bit words."""
    bit = F.when(F.col("pass"), F.expr(f"shiftleft(1L, CAST({T} % {WORD} AS INT))")).otherwise(F.lit(0).cast("long"))
    return outcomes.groupBy(P, S, F.floor(F.col(T) / WORD).cast("long").alias("word")).agg(F.bit_or(bit).alias("bits"))


PAIR_CHUNK = 2048  # solutions per salt slice of a hot (problem, word) key


def pair_hamming(
    outcomes: DataFrame, solutions: DataFrame | None = None, chunk: int = PAIR_CHUNK, hot: bool | None = None
) -> DataFrame:
    """Hamming distance of every solution pair a < b within a problem.

    ``solutions`` optionally restricts both sides (e.g. to candidates) before
    the pair join, so only the wanted pairs are ever built.

    Hot keys are salted: a ``(problem, word)`` key with n solutions is split
    into ceil(n / chunk) slices of its left side, and its right side is
    replicated once per slice, so one huge problem becomes many tasks of at
    most ``chunk x n`` pairs.  Ordinary keys get one slice (no replication).
    """
    rows = packed_rows(outcomes)
    if solutions is not None:
        rows = rows.join(solutions.select(P, S), [P, S], "left_semi")
    a = rows.select(P, "word", F.col(S).alias("a"), F.col("bits").alias("ba"))
    b = rows.select(P, "word", F.col(S).alias("b"), F.col("bits").alias("bb"))
    return (
        expand_join(a, b, [P, "word"], "a", chunk, hot)
        .where(F.col("a") < F.col("b"))
        .groupBy(P, "a", "b")
        .agg(F.sum(F.bit_count(F.col("ba").bitwiseXOR(F.col("bb")))).cast("long").alias("distance"))
    )


def _greedy_floor(pairs: DataFrame) -> DataFrame:
    """Per problem, the best least pair distance of the triples (a, its farthest x, z), over every start a and every z.

    The best triple's minimum is at least this, so pairs below it cannot be in
    the answer.  For each start one z row per other solution is looked at:
    as many rows as there are pairs, whatever the ties.
    """
    sym = pairs.select(P, "a", "b", "distance").unionByName(pairs.select(P, F.col("b").alias("a"), F.col("a").alias("b"), "distance"))
    far = sym.groupBy(P, "a").agg(F.max(F.struct("distance", (-F.col("b")).alias("nx"))).alias("far"))
    starts = far.select(P, "a", (-F.col("far.nx")).alias("x"), F.col("far.distance").alias("d_ax"))
    az = sym.withColumnRenamed("distance", "d_az").join(starts, [P, "a"]).where(F.col("b") != F.col("x"))
    xz = sym.select(P, F.col("a").alias("x"), "b", F.col("distance").alias("d_xz"))
    return az.join(xz, [P, "x", "b"]).groupBy(P).agg(F.max(F.least("d_ax", "d_az", "d_xz")).alias("floor"))


PRUNE_MIN = 64  # candidates per problem above which the exact floor prune pays off


def best_triple(pairs: DataFrame, prune: bool = True) -> DataFrame:
    """Per problem the triple a<b<c maximising (min pair distance, total distance);
    the first triple in index order wins ties.

    Triangles are built from the pair table only (never from tests), after an
    exact prune: a greedy triple's minimum is a floor for the optimum's, so
    pairs below the floor are dropped first.  Ties survive the prune because
    every triple at the optimum has all its pairs at or above the floor.
    Callers skip the prune (``prune=False``) when no problem has more than
    PRUNE_MIN candidates: the triangles are then few and the prune's extra
    stages cost more than they save.
    """
    if prune:
        pairs = cut_lineage(pairs)  # read six times below: materialise once
        floor = _greedy_floor(pairs)
        pairs = pairs.join(floor, P, "left").where(F.col("floor").isNull() | (F.col("distance") >= F.col("floor"))).drop("floor")
    ab = pairs.select(P, "a", "b", F.col("distance").alias("d_ab"))
    ac = pairs.select(P, "a", F.col("b").alias("c"), F.col("distance").alias("d_ac"))
    bc = pairs.select(P, F.col("a").alias("b"), F.col("b").alias("c"), F.col("distance").alias("d_bc"))
    tri = ab.join(ac, [P, "a"]).where(F.col("b") < F.col("c")).join(bc, [P, "b", "c"])
    score = F.struct(
        F.least("d_ab", "d_ac", "d_bc").alias("min_d"),
        (F.col("d_ab") + F.col("d_ac") + F.col("d_bc")).alias("total_d"),
        (-F.col("a")).alias("na"),
        (-F.col("b")).alias("nb"),
        (-F.col("c")).alias("nc"),
    )
    best = tri.groupBy(P).agg(F.max(score).alias("s"))
    return best.select(
        P,
        (-F.col("s.na")).alias("a"),
        (-F.col("s.nb")).alias("b"),
        (-F.col("s.nc")).alias("c"),
        F.col("s.min_d").alias("min_distance"),
        F.col("s.total_d").alias("total_distance"),
    )


def _largest_group(cand: DataFrame) -> int:
    """One planning number: the most candidates any problem has.  It decides
    both whether the pair join needs salting and whether the prune pays off."""
    return cand.groupBy(P).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def _pairs_of(packed: DataFrame, hot: bool, chunk: int) -> DataFrame:
    """(problem, a, b, distance) of all pairs a < b of packed solutions; the left side of a large problem goes in slices."""
    a = packed.select(P, F.col(S).alias("a"), F.col("words").alias("wa"))
    b = packed.select(P, F.col(S).alias("b"), F.col("words").alias("wb"))
    pairs = expand_join(a, b, [P], "a", chunk, hot).where(F.col("a") < F.col("b"))
    return pairs.select(P, "a", "b", word_distance(F.col("wa"), F.col("wb")).alias("distance"))


def _triple_of(cand: DataFrame) -> DataFrame:
    """The best triple among packed candidates.

    Of candidates with one pattern only the three lowest ids can be in the
    answer: any other member may be exchanged for a lower one without changing
    a distance, and the lower one wins the tie.
    """
    rank = F.row_number().over(Window.partitionBy(P, "words").orderBy(S))
    cand = cut_lineage(cand.withColumn("_rank", rank).where(F.col("_rank") <= 3).drop("_rank"))
    biggest = _largest_group(cand)
    return best_triple(_pairs_of(cand, biggest > PAIR_CHUNK, PAIR_CHUNK), prune=biggest > PRUNE_MIN)


def top_two(rates: DataFrame) -> DataFrame:
    """The two highest pass rates per problem, ties to the lower solution id."""
    w = Window.partitionBy(P).orderBy(F.col("pass_rate").desc(), F.col(S))
    return rates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 2).select(
        P, S, "pass_rate", F.col("rank").cast("long").alias("rank")
    )


def diverse_candidates(rates: DataFrame, top: DataFrame) -> DataFrame:
    """Solutions outside the top two with MID_LOW <= rate < MID_HIGH."""
    return rates.join(top.select(P, S), [P, S], "left_anti").where(
        (F.col("pass_rate") >= MID_LOW) & (F.col("pass_rate") < MID_HIGH)
    )


def _with_top(packed: DataFrame) -> DataFrame:
    """Packed solutions with ``_top`` (the two highest rates); only two rows of a problem leave each task for the ranking."""
    top = top_two(packed.select(P, S, rate_of_packed())).groupBy(P).agg(F.collect_list(S).alias("_two"))
    rated = packed.select(P, S, "words", rate_of_packed())
    return rated.join(top, P).withColumn("_top", F.array_contains("_two", F.col(S))).drop("_two")


def _mid_band() -> Column:
    return ~F.col("_top") & (F.col("pass_rate") >= MID_LOW) & (F.col("pass_rate") < MID_HIGH)


def diverse_triple(outcomes: DataFrame) -> DataFrame:
    """C9 as used by S1: the best triple among the mid-band candidates of problems with 3+ of them."""
    return _triple_of(_with_top(packed_solutions(outcomes)).where(_mid_band()).select(P, S, "words"))


def diverse_five(outcomes: DataFrame, seed: int = 42) -> DataFrame:
    """Top two + the most diverse mid-band triple; under 3 candidates, up to 3
    seeded draws from the rest with rate > 0.1.  Returns one row per pick with
    ``slot`` (0.. in solution order) and ``status`` ('ok' or 'insufficient').

    All roles read the packed table.  Rankings keep a few rows per problem and
    task before they are shuffled (top-k), so no window holds all solutions of
    a problem; three draws are made for every problem and dropped where a
    triple exists.
    """
    r = cut_lineage(_with_top(packed_solutions(outcomes)))
    tri = _triple_of(r.where(_mid_band()).select(P, S, "words"))
    draw = F.row_number().over(Window.partitionBy(P).orderBy(seeded_key(seed, P, S)))
    extra = r.where(~F.col("_top") & (F.col("pass_rate") > EXTRA_MIN)).select(P, S).withColumn("_rn", draw).where(F.col("_rn") <= 3)
    tri = cut_lineage(tri.select(P, F.array("a", "b", "c").alias("three")))  # one row per problem
    picks = extra.join(tri, P, "left_anti").select(P, S).unionByName(r.where("_top").select(P, S)).unionByName(tri.select(P, F.explode("three").alias(S)))
    return _finish(picks, "diverse")


def _finish(picks: DataFrame, kind: str) -> DataFrame:
    w = Window.partitionBy(P).orderBy(S)
    wc = Window.partitionBy(P)
    n = F.count(F.lit(1)).over(wc)
    return picks.select(
        P,
        S,
        F.lit(kind).alias("kind"),
        (F.row_number().over(w) - 1).cast("long").alias("slot"),
        F.when(n >= PICKS, F.lit("ok")).otherwise(F.lit("insufficient")).alias("status"),
    )


def total_distance(outcomes: DataFrame) -> DataFrame:
    """Each solution's summed Hamming distance to all other solutions of its
    problem, from per-test pass counts: no solution pairs are built."""
    counts = test_pass_mean(outcomes).select(P, T, "n_pass", "n_solutions")
    j = outcomes.select(P, S, T, "pass").join(counts, [P, T])
    far = F.when(F.col("pass"), F.col("n_solutions") - F.col("n_pass")).otherwise(F.col("n_pass"))
    return j.groupBy(P, S).agg(F.sum(far).cast("long").alias("total_distance"))


def closest_five(outcomes: DataFrame) -> DataFrame:
    """C10 selection: the five solutions with least total distance, ties to lower id (all if n <= 5)."""
    td = total_distance(outcomes)
    w = Window.partitionBy(P).orderBy("total_distance", S)
    return td.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= PICKS).select(P, S, "total_distance")


def nearest_distance(outcomes: DataFrame, seeds: DataFrame) -> DataFrame:
    """C11: for every non-seed solution, its least Hamming distance to the seed set of its problem.

    ``seeds`` is (problem_id, solution_id), a few per problem: their distinct
    rows travel as one array to the packed solutions of the problem.
    """
    packed = packed_solutions(outcomes)
    of = seeds.select(P, S).distinct()
    rows = packed.join(of, [P, S], "left_semi").groupBy(P).agg(F.collect_set("words").alias("seed_words"))
    others = packed.join(of, [P, S], "left_anti").join(rows, P)
    least = F.array_min(F.transform("seed_words", lambda w: word_distance(F.col("words"), w)))
    return others.select(P, S, least.alias("min_distance"))


def similar_five(outcomes: DataFrame, seed: int = 42) -> DataFrame:
    """Pick five solutions that behave alike.

    If the problem has groups of identical outcome rows, one group is chosen
    with probability proportional to its size (the seeded-first *member* of
    all grouped solutions picks its group: E6); a group of 5+ gives a seeded
    sample of 5 (E7), a smaller one is kept and filled by rising nearest
    distance with seeded ties (E8).  Without groups the five with least total
    distance are taken (C10).

    A group is its packed row, so the nearest distance of every other solution
    is one XOR with the chosen row, and all three rules are one top-five order:
    members by draw, then others by distance and draw.
    """
    packed = packed_solutions(outcomes)
    groups = packed.groupBy(P, "words").agg(F.count(F.lit(1)).alias("n"), F.min(seeded_key(seed, P, S)).alias("draw")).where(F.col("n") > 1)
    chosen = groups.groupBy(P).agg(F.min_by(F.struct(F.col("words").alias("chosen"), F.col("n").alias("gsize")), "draw").alias("g")).select(P, "g.*")
    k = packed.select(P, S, "words").join(chosen, P, "left")
    grouped = k.where(F.col("chosen").isNotNull()).select(
        P, S, F.when(F.col("words") == F.col("chosen"), F.lit(-1)).otherwise(word_distance(F.col("words"), F.col("chosen"))).alias("far"),
        F.when(F.col("gsize") >= PICKS, seeded_key(seed + 1, P, S)).otherwise(seeded_key(seed + 2, P, S)).alias("draw"),
    )
    alone = outcomes.join(k.where(F.col("chosen").isNull()).select(P).distinct(), P, "left_semi")
    alone = total_distance(alone).select(P, S, F.col("total_distance").alias("far"), F.lit("").alias("draw"))
    ranked = grouped.unionByName(alone).withColumn("_rn", F.row_number().over(Window.partitionBy(P).orderBy("far", "draw", S)))
    return _finish(ranked.where(F.col("_rn") <= PICKS).select(P, S), "similar")
