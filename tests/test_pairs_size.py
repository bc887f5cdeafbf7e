"""Pairs of tables that grow: nothing that grows is broadcast, and what goes before a rule never takes a pair away."""

import random
import re

import pytest
from pyspark.sql import functions as F

from linkwright import catalog, runtime
from linkwright.functions import metrics as m
from linkwright.operators import grouping, pairs
from linkwright.operators import predicates as pr
from linkwright.plans import linkage

SF = "/root/testdata/sf0.001"
#: The plan that makes a query's pairs.
PLANS = {
    "blocking_coverage": lambda spark: linkage.edges(catalog.planted(spark, SF), catalog.SPEC),
    "ed_all_pairs": lambda spark: catalog.queries()["ed_all_pairs"](spark, SF),
    "generalised_pass": lambda spark: pairs.near_pairs(catalog.super_index(catalog.planted(spark, SF)), catalog.planted(spark, SF), catalog.COLS, [(catalog.COLS, 2)], pr.sum_within(catalog.COLS, 2)),
    "match_f12": lambda spark: catalog.queries()["match_f12"](spark, SF),
    "match_mean_jaro": lambda spark: catalog.alike(spark, SF, pr.jaro_possible(catalog.COLS, 0.8, 0.9)),
}


@pytest.mark.parametrize("name", PLANS)
def test_no_table_of_records_is_broadcast(spark, name):
    plan = PLANS[name](spark)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_a_written_table_is_read_after_its_shuffles_are_gone(spark):
    kept = spark.conf.get(runtime.CLEANUP, "false")
    rows = runtime.materialize(spark.range(100).groupBy(F.col("id") % 7).count(), "sevens")
    assert rows.count() == 7 and spark.conf.get(runtime.CLEANUP, "false") == kept


def _words(seed, n, letters="abcé\U0001f600", low=0, high=7):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(low, high))) for _ in range(n)]


def test_signatures_never_rule_out_a_near_pair(spark):
    rows = list(zip(_words(1, 400), _words(2, 400), _words(3, 400), _words(4, 400), strict=True))
    df = spark.createDataFrame(rows, "l_a string, l_b string, r_a string, r_b string")
    df = df.withColumn("x", m.signature("l_a", "l_b")).withColumn("y", m.signature("r_a", "r_b")).withColumn("d", F.levenshtein("l_a", "r_a") + F.levenshtein("l_b", "r_b"))
    got = df.select("d", *[m.near_signatures("x", "y", t).alias(f"t{t}") for t in range(13)]).collect()
    assert all(r[f"t{t}"] for r in got for t in range(13) if r.d <= t)
    assert not all(r.t1 for r in got)


def test_no_jaro_similarity_is_above_its_cap(spark):
    rows = list(zip(_words(1, 400), _words(2, 400), _words(3, 400), _words(4, 400), strict=True))
    df = spark.createDataFrame(rows, "l_a string, l_b string, r_a string, r_b string").withColumn("l_sign", m.signature("l_a", "l_b")).withColumn("r_sign", m.signature("r_a", "r_b"))
    got = df.select("*", m.jaro("l_a", "r_a").alias("a"), m.jaro("l_b", "r_b").alias("b"), *[pr.jaro_possible(["a", "b"], t / 10, (t + 1) / 10).alias(f"t{t}") for t in range(10)]).collect()
    assert all(r[f"t{t}"] for r in got for t in range(10) if min(r.a, r.b) >= t / 10 and (r.a + r.b) / 2 >= (t + 1) / 10)
    assert not all(r.t8 for r in got)


def test_a_record_without_a_block_takes_no_pair_away(spark):
    blocks = spark.createDataFrame([("x", 1), ("x", 2), (None, 1), (None, 2), ("y", 2), ("y", 3)], "block string, rec long")
    assert sorted((r.l, r.r) for r in pairs.within_blocks(blocks).collect()) == [(1, 2), (2, 3)]


@pytest.mark.parametrize("t, low, high", [(1, 29, 36), (2, 9, 16)])
def test_short_and_long_values_within_a_distance(spark, t, low, high):
    rng = random.Random(t)
    words = _words(5, 12, "ab", low, high)
    for w in words[:]:
        for _ in range(6):
            i, s = rng.randrange(len(w)), w
            for _ in range(rng.randint(1, t + 1)):
                s = rng.choice([s[:i] + s[i + 1 :], s[:i] + "c" + s[i:], s[:i] + "d" + s[i + 1 :]])
            words.append(s)
    df = spark.createDataFrame(list(enumerate(words)), "rec_idx long, v string")
    x, y = df.select(F.col("rec_idx").alias("l"), F.col("v").alias("a")), df.select(F.col("rec_idx").alias("r"), F.col("v").alias("b"))
    want = {(r.l, r.r) for r in x.crossJoin(y).where((F.col("l") < F.col("r")) & (F.levenshtein("a", "b") <= t)).collect()}
    got = [(r.l, r.r) for r in pairs.all_pairs_within(df, "v", t).collect()]
    assert set(got) == want and len(got) == len(want)


def test_partners_are_counted_where_pairs_are_made(spark):
    made = pairs.within_blocks(spark.createDataFrame([("x", i) for i in range(9)] + [("y", i) for i in range(4, 12)], "block string, rec long"), 3)
    assert sorted(grouping.partners(made, once=True).collect()) == sorted(grouping.partners(made).collect())


def test_what_stands_in_a_join_never_takes_a_similar_pair_away(spark):
    rows = list(zip(_words(1, 400), _words(2, 400), _words(3, 400), _words(4, 400), strict=True))
    df = spark.createDataFrame(rows, "l_a string, l_b string, r_a string, r_b string").withColumn("l_sign", m.signature("l_a", "l_b")).withColumn("r_sign", m.signature("r_a", "r_b"))
    df = df.select("*", *[F.length(f"{side}_{c}").alias(f"{side}_size_{c}") for side in ("l", "r") for c in ("a", "b")])
    got = df.select("*", m.jaro("l_a", "r_a").alias("a"), m.jaro("l_b", "r_b").alias("b"), *[pr.jaro_near(["a", "b"], t / 10).alias(f"t{t}") for t in range(10)]).collect()
    assert all(r[f"t{t}"] for r in got for t in range(10) if min(r.a, r.b) >= t / 10)
    assert not all(r.t8 for r in got)


#: Java interprets a method of more bytes, many times slower; the loop over the pairs of a block is one method.
HUGE = 8000


@pytest.mark.parametrize("name", ["match_mean_jaro", "match_each_jaro", "match_thresholded_jaro", "pair_similarity"])
def test_the_loop_over_pairs_is_compiled(spark, name):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = catalog.queries()[name](spark, SF)._jdf.queryExecution()
        code = spark._jvm.PythonSQLUtils.explainString(plan, "codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(x) for part in code.split("== Subtree ")[1:] if "findNextJoinRows" in part for x in re.findall(r"maxMethodCodeSize:(\d+)", part)]
    assert sizes and max(sizes) <= HUGE


def test_a_metric_sees_each_pair_once_and_behind_the_join(spark):
    plan = catalog.queries()["match_each_jaro"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("ArrowEvalPython") < plan.index("SortAggregate") < plan.index("SortMergeJoin")


@pytest.mark.parametrize("name", ["match_f2", "match_f3", "match_f8", "match_source", "match_each_jaro", "match_thresholded_jaro", "pair_partners"])
def test_no_table_of_records_is_broadcast_by_a_rule(spark, name):
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["match_f1", "pair_similarity", "weighted_ed", "pair_distance", "reversal_truncation"])
def test_no_table_of_records_is_broadcast_for_all_candidates(spark, name):
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_a_grid_has_the_distances_of_all_its_strings():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    for high in (4, 8, 14, 30, 64, 150):
        x, y = _words(high, 12, "abé\U0001f600", 0, high), _words(high + 1, 11, "abé\U0001f600", 0, high)
        got = m.EditGrid(m.names(x), m.names(y)).distances(4, shorter=True)
        want = [[(distance(a, b), distance(a[:4], b[:4]), distance(a[: len(b)], b[: len(a)])) for b in y] for a in x]
        assert [[tuple(int(g[i, j]) for g in got) for j in range(11)] for i in range(12)] == want


@pytest.mark.parametrize("part, batch, high", [(512, 10000, 7), (5, 7, 7), (3, 1, 12), (130, 100, 7)])
def test_pairs_of_a_grid_are_the_candidates_with_their_metrics(spark, part, batch, high):
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = [(i * 7 % 401, a or None, b) for i, (a, b) in enumerate(zip(_words(8, 300, "abé"), _words(9, 300, "abé\U0001f600", 0, high), strict=True))]
    df = spark.createDataFrame(rows, "rec_idx long, first string, last string")
    blocks = catalog.super_index(df)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = pairs.measured_pairs(blocks, df, ["first", "last"], m.reversals_truncations, ["a", "b", "c"], part=part).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    want = pairs.candidate_pairs(blocks, df, ["first", "last"], part=part)
    want = want.select("l", "r", m.reversal("l_first", "l_last", "r_first", "r_last"), m.truncation("l_last", "r_last", 4), m.truncation("l_last", "r_last")).collect()
    assert len(want) > 1000 and sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_all_candidates_are_measured_in_grids_and_not_joined(spark):
    plan = catalog.queries()["reversal_truncation"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("MapInArrow") < plan.index("SortMergeJoin") and "levenshtein" not in plan
