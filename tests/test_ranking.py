"""Places over whole tables against row numbers in one list, and how their work is dealt out."""

import random
import re

import pytest
from pyspark.sql import Column
from pyspark.sql import functions as F

from triagelake.operators import ranking, views


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("n", [0, 1, 7, 3000])
def test_numbered_is_gapless_and_in_order(spark, n):
    r = random.Random(n)
    rows = [(r.choice([None, "a", "b", "ä", ""]), r.choice([None, 1.5, -0.0, 3.0]), i) for i in range(n)]
    got = ranking.numbered(frame(spark, rows, "g string, x double, _ord long"), F.col("g").asc_nulls_first(), F.col("x").desc_nulls_last(), "_ord")
    want = sorted(rows, key=lambda t: (t[0] is not None, (t[0] or "").encode(), t[1] is None, -(t[1] or 0), t[2]))
    assert got.count == n
    assert [tuple(x)[:3] for x in sorted(got.rows.collect(), key=lambda x: x["place"])] == want
    assert sorted(x["place"] for x in got.rows.collect()) == list(range(n))


def test_equal_rows_each_get_a_place(spark):
    rows = [("k", 1)] * 900 + [("k", 2)] * 3 + [(None, None)] * 5
    got = ranking.numbered(frame(spark, rows, "g string, x int"), F.col("g").asc_nulls_first(), "x", collapse=True)
    places = sorted((x["place"], x["g"], x["x"]) for x in got.rows.collect())
    assert got.count == 908 and [p for p, _, _ in places] == list(range(908))
    assert [t[1:] for t in places] == [(None, None)] * 5 + [("k", 1)] * 900 + [("k", 2)] * 3


@pytest.mark.parametrize("collapse", [False, True])
def test_places_inside_groups(spark, collapse):
    r = random.Random(8)
    rows = [(r.choice([None, "hot", "hot", "hot", "", "z"]), r.randint(0, 50), i) for i in range(2000)]
    got = ranking.placed(frame(spark, rows, "g string, x int, _ord long"), ["g"], F.col("x").desc(), "_ord", collapse=collapse)
    groups = {}
    for t in rows:
        groups.setdefault(t[0], []).append(t)
    want, start = [], 0
    for g in sorted(groups, key=lambda g: (g is not None, g or "")):
        for k, t in enumerate(sorted(groups[g], key=lambda t: (-t[1], t[2]))):
            want.append((*t, k, start, len(groups[g])))
        start += len(groups[g])
    assert sorted(map(repr, map(tuple, got.select("g", "x", "_ord", "place", "start", "size").collect()))) == sorted(map(repr, want))


def test_no_step_puts_all_rows_in_one_task(spark, tmp_path):
    rows = spark.range(20_000).select(F.lit("S").alias("grade"), F.lit(1).alias("score"), F.col("id").alias("_ord"))
    got = views.with_place(rows, F.col("grade"), F.col("score").desc(), F.col("_ord"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" not in plan
    # equal grades and scores all over: the rows still lie in several written parts of like size
    parts = [x["n"] for x in got.groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(parts) >= 3 and max(parts) < 10_000


def test_view_queries_have_no_single_task(spark):
    from triagelake.plans import contract

    for name in ("view_ranked", "view_ranked_all", "view_recent", "view_recent_all", "view_amount", "view_priority"):
        plan = contract.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan and "Window" not in plan, name


def sorts(df):
    """What each sort and range cut of a plan goes by."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return re.findall(r"(?:Sort|RepartitionByExpression) \[(.*?)\], ", plan)


ONLY_COLUMNS = r"\w+#\d+L? (ASC|DESC) NULLS (FIRST|LAST)"


@pytest.mark.parametrize("name", ["view_recent_all", "view_recent", "view_ranked_all", "view_ranked", "view_amount", "view_priority", "preferred_place"])
def test_places_are_sorted_by_columns_that_are_worked_out_once(spark, monkeypatch, name):
    from triagelake.plans import view_contract
    from triagelake.sources import scratch

    plans, save = [], scratch.Scratch.save
    monkeypatch.setattr(scratch.Scratch, "save", lambda self, df, *more: plans.append(sorts(df)) or save(self, df, *more))
    view_contract.QUERIES[name](spark, "/root/testdata/sf0.001")
    keys = [key for plan in plans for sort in plan for key in sort.split(", ")]
    assert keys and all(re.fullmatch(ONLY_COLUMNS, key) for key in keys), keys


@pytest.mark.parametrize("name", ["view_opportunities", "view_art", "view_local", "view_board", "preferred_order"])
def test_views_are_sorted_by_columns_that_are_worked_out_once(spark, name):
    from triagelake.plans import view_contract

    df = view_contract.QUERIES[name](spark, "/root/testdata/sf0.001")
    keys = [key for sort in sorts(df) for key in sort.split(", ")]
    assert all(re.fullmatch(ONLY_COLUMNS, key) for key in keys), keys


@pytest.mark.parametrize("collapse", [False, True])
def test_keys_sort_as_their_expressions_do_and_leave_no_columns(spark, collapse):
    r = random.Random(5)
    rows = [(r.choice([None, "a", "B", "b", ""]), i % 50) for i in range(500)]
    df = frame(spark, rows, "g string, x int").distinct()
    low = F.lower("g")
    got = ranking.numbered(df, ranking.Key(low, Column.desc_nulls_first), ranking.Key(-F.col("x")), F.col("g"), collapse=collapse).rows
    want = ranking.numbered(df, low.desc_nulls_first(), (-F.col("x")).asc(), F.col("g"), collapse=collapse).rows
    assert got.columns == ["g", "x", "place"]
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    way = ranking.placed(df, ["g"], ranking.Key(F.col("x") * 2, Column.desc)).select("g", "x", "place")
    assert sorted(map(repr, way.collect())) == sorted(map(repr, ranking.placed(df, ["g"], F.col("x").desc()).select("g", "x", "place").collect()))
    ordered = df.withColumn("_ord", F.xxhash64("g", "x"))
    assert views.ranked(ordered, ranking.Key(low, Column.desc)).collect() == ordered.orderBy(low.desc(), "_ord").collect()
