"""The packed per-solution table, best triples of many candidates, and the keyed counts of a stream."""

import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_MID
from suiteforge.fixtures import fx_outcomes
from suiteforge.operators import outcomes as oc
from suiteforge.operators import select as sel
from suiteforge.streaming.running import compact_counts, run_counts, running_counts


def test_packed_rows_hold_every_cell(spark):
    cells = [(1, 1, 0, True), (1, 1, 62, True), (1, 1, 63, False), (1, 1, 130, True), (1, 2, 63, True), (1, 2, 0, None), (2, 7, 5, False)]
    found = {r.solution_id: r for r in sel.packed_solutions(spark.createDataFrame(cells, "problem_id long, solution_id long, test_id long, pass boolean")).collect()}
    assert found[1].words == [1 + (1 << 62), 0, 1 << 4] and (found[1].n_tests, found[1].n_pass) == (4, 3)
    assert found[2].words == [0, 1] and found[2].n_pass == 1 and found[7].words == [0]
    pair = spark.createDataFrame([(found[1].words, found[2].words)], "a array<long>, b array<long>")
    assert pair.select(sel.word_distance(F.col("a"), F.col("b"))).first()[0] == 4


def best_triple_by_hand(ids, rows):
    """Greatest (least distance, total distance), then the first in index order, over all triples."""
    d = (rows[:, None, :] != rows[None, :, :]).sum(2).astype(np.int16)
    best = None
    upper = np.triu(np.ones(d.shape, bool), 1)
    for a in range(len(ids)):
        own = d[a]
        score = np.minimum(np.minimum(own[:, None], own[None, :]), d).astype(np.int32) * 4096 + own[:, None] + own[None, :] + d
        score[~upper] = -1
        score[: a + 1] = -1
        k = int(score.argmax())
        if score.flat[k] >= 0 and (best is None or score.flat[k] > best[0]):
            best = (int(score.flat[k]), ids[a], ids[k // len(ids)], ids[k % len(ids)])
    return best


@pytest.mark.parametrize(("n", "tests", "distinct"), [(900, 14, 900), (400, 70, 400), (300, 9, 4), (250, 6, 250)])
def test_best_triple_of_many_candidates(spark, monkeypatch, n, tests, distinct):
    draw = np.random.default_rng(n)
    patterns = draw.random((distinct, tests)) < 0.6
    rows = patterns[draw.integers(0, distinct, n)]
    ids = draw.permutation(5 * n)[:n]
    order = ids.argsort()
    ids, rows = ids[order].tolist(), rows[order]
    words = [[sum(int(b) << k for k, b in enumerate(r[i : i + sel.WORD])) for i in range(0, tests, sel.WORD)] for r in rows]
    cand = spark.createDataFrame([(5, i, w) for i, w in zip(ids, words, strict=True)], "problem_id long, solution_id long, words array<long>")
    monkeypatch.setattr(sel, "PAIR_CHUNK", 500)
    got = sel._triple_of(cand).collect()
    score, a, b, c = best_triple_by_hand(ids, rows)
    assert [(r.a, r.b, r.c, r.min_distance * 4096 + r.total_distance) for r in got] == [(a, b, c, score)]


@pytest.mark.parametrize("partitions", [1, 200])
def test_selections_do_not_depend_on_partitions(spark, partitions):
    o = fx_outcomes(spark, SF_MID).where("problem_id < 12")
    plain = [sorted(map(tuple, pick(o).collect())) for pick in (sel.diverse_five, sel.similar_five)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        assert plain == [sorted(map(tuple, pick(o.repartition(partitions)).collect())) for pick in (sel.diverse_five, sel.similar_five)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_selection_plans_are_short(spark):
    o = fx_outcomes(spark, SF_MID)
    for pick in (sel.diverse_five, sel.similar_five):
        plan = pick(o)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") <= 15 and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


# running counts

SCHEMA = "problem_id long, solution_id long, test_id long, pass boolean, order long"


def batch_counts(rows, axis):
    won = {}
    for p, s, t, ok, order in rows:
        if None in (p, s, t, order):
            continue
        won[p, s, t] = max(won.get((p, s, t), (order, bool(ok))), (order, bool(ok)))
    out = {}
    for (p, s, t), (_, ok) in won.items():
        n, k = out.get((p, s if axis == "solutions" else t), (0, 0))
        out[p, s if axis == "solutions" else t] = (n + 1, k + ok)
    return out


def test_running_counts_equal_the_batch_after_replays_conflicts_and_a_lost_batch(spark, tmp_path):
    draw = np.random.default_rng(1)
    source, counts, point = (f"{tmp_path}/{x}" for x in ("in", "counts", "point"))
    rows = []

    def drop(n, seed):
        new = [(int(p), int(s), int(t), bool(k) if k < 2 else None, int(o)) for p, s, t, k, o in zip(draw.integers(0, 3, n), draw.integers(0, 4, n), draw.integers(0, 3000, n) if seed % 2 else draw.integers(0, 5, n), draw.integers(0, 3, n), draw.integers(0, 4, n), strict=True)]
        new += [(None, 1, 1, True, 1), (1, 1, 1, True, None)]
        rows.extend(new)
        spark.createDataFrame(new, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        return new

    def agrees():
        for axis in ("solutions", "tests"):
            found = {tuple(r)[:2]: tuple(r)[2:] for r in running_counts(spark, counts, axis).collect()}
            assert found == batch_counts(rows, axis)

    first = drop(300, 0)
    drop(300, 1)
    run_counts(spark, source, counts, point, spark.createDataFrame([], SCHEMA).schema, files_per_batch=1)
    agrees()
    spark.createDataFrame(first, SCHEMA).coalesce(1).write.mode("append").parquet(source)  # delivered twice
    drop(200, 2)
    run_counts(spark, source, counts, point, spark.createDataFrame([], SCHEMA).schema, files_per_batch=1)
    agrees()
    # the last batch was written but its end was lost: it runs again and counts once
    last = max(glob.glob(f"{point}/commits/[0-9]*"), key=lambda f: int(os.path.basename(f)))
    os.remove(last)
    for crc in glob.glob(f"{point}/commits/.{os.path.basename(last)}.crc"):
        os.remove(crc)
    run_counts(spark, source, counts, point, spark.createDataFrame([], SCHEMA).schema, files_per_batch=1)
    agrees()
    compact_counts(spark, counts, "solutions", f"{tmp_path}/small")
    assert {tuple(r) for r in running_counts(spark, f"{tmp_path}/small", "solutions").collect()} == {tuple(r) for r in running_counts(spark, counts, "solutions").collect()}


def test_many_solutions_share_a_state_key(spark, tmp_path):
    """Sixteen solutions with twenty tests are one key of the state, not sixteen."""
    source, counts, point = (f"{tmp_path}/{x}" for x in ("in", "counts", "point"))
    spark.createDataFrame([(1, s, t, True, 1) for s in range(16) for t in range(20)], SCHEMA).write.parquet(source)
    run_counts(spark, source, counts, point, spark.createDataFrame([], SCHEMA).schema)
    progress = spark.read.format("statestore").load(point)
    assert progress.count() == 1
    assert {tuple(r) for r in running_counts(spark, counts, "solutions").collect()} == {(1, s, 20, 20) for s in range(16)}


def test_rates_of_packed_equal_the_cells(spark):
    o = fx_outcomes(spark, SF_MID)
    packed = sel.packed_solutions(o).select("problem_id", "solution_id", sel.rate_of_packed())
    assert sorted(map(tuple, packed.collect())) == sorted((r.problem_id, r.solution_id, r.pass_rate) for r in oc.solution_pass_rate(o).collect())
