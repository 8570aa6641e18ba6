"""State folded over micro-batches against the same fold over all events at once."""

import random

import pytest

from pyspark.sql import functions as F

from triagelake.operators import state
from triagelake.plans import boards
from triagelake.streaming import registrations

EVENTS = "research_id string, seq long, op string, at string, is_sync boolean, status string, statusLabel string, progress string, projectId string, sheetUpdatedAt string"


def events(r, n):
    some = lambda *values: r.choice([None, "", *values])
    return [
        (f"k{r.randint(0, 6)}", seq, r.choice(["upsert", "upsert", "upsert", "delete"]), f"t{seq}", r.choice([None, True, False]), some("WORKING", "READY", "REVIEW"), some("라벨", "b"), some("10", "49.5", "x"), some("p", "q"), some("u"))
        for seq in range(n)
    ]


@pytest.mark.parametrize("ordered", [True, False])
def test_stream_state_equals_the_fold_of_all_events(spark, tmp_path, ordered):
    r = random.Random(ordered)
    rows = events(r, 60)
    if not ordered:
        r.shuffle(rows)
        rows += r.sample(rows, 10)  # delivered again
    done = []
    for n in range(3):
        part = rows[n * len(rows) // 3 : (n + 1) * len(rows) // 3]
        done += part
        spark.createDataFrame(part, EVENTS).coalesce(1).write.json(str(tmp_path / "in" / f"b{n}"))
        stream = spark.readStream.schema(EVENTS).json(str(tmp_path / "in" / "*"))
        registrations.start(stream, str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination()
        show = lambda df: sorted(map(repr, df.collect()))
        assert show(registrations.current(spark, str(tmp_path / "state"))) == show(state.merged(spark.createDataFrame(sorted(set(done), key=lambda e: e[1]), EVENTS)))


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    fold = registrations.write_versions(str(tmp_path / "s"))
    make = lambda *rows: spark.createDataFrame(rows, "key string, live boolean, value string")
    fold(make(("a", True, "1"), ("b", True, "2")), 0)
    for _ in range(2):
        fold(make(("a", True, "3"), ("b", False, None), ("c", True, "4")), 1)
    got = lambda: sorted(tuple(x) for x in registrations.stored(spark, str(tmp_path / "s")).select("key", "value").collect())
    assert got() == [("a", "3"), ("c", "4")]
    fold(make(("d", True, "5")), 2)
    assert got() == [("a", "3"), ("c", "4"), ("d", "5")]


def test_values_by_key(spark, tmp_path):
    rows = [("k", 1, "upsert", "new"), ("l", 2, "upsert", "done"), ("k", 5, "upsert", "hold"), ("k", 3, "upsert", "late"), ("l", 4, "delete", None)]
    spark.createDataFrame(rows, "review_key string, seq long, op string, status string").write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("review_key string, seq long, op string, status string").json(str(tmp_path / "in"))
    registrations.start_values(stream, str(tmp_path / "s"), str(tmp_path / "cp"), "review_key", "status").awaitTermination()
    assert [tuple(x) for x in registrations.stored(spark, str(tmp_path / "s")).where(F.col("live")).select("key", "value").collect()] == [("k", "hold")]


def test_no_batch_yet(spark, tmp_path):
    assert registrations.current(spark, str(tmp_path / "none")).count() == 0


def test_callbacks_as_a_stream(spark, tmp_path):
    calls = [
        ("https://d.example/?registeredResearchId=r1&projectId=p1", 1), ("https://d.example/?syncResult=1&syncFound=1&researchId=r1&status=WORKING&progress=49.5", 2), ("https://d.example/?syncResult=1&syncFound=0&researchId=r2", 3),
        ("https://d.example/?registeredResearchId=r2&status=READY&syncResult=1&syncFound=1&researchId=r2&statusLabel=x&projectId=q", 4), ("https://d.example/?registeredResearchId=r1&projectId=p1", 1),
    ]
    rows = [(u, s, f"t{s}") for u, s in calls]
    for n in range(2):  # all of it comes twice
        spark.createDataFrame(rows, "url string, seq long, at string").coalesce(1).write.json(str(tmp_path / "in" / f"b{n}"))
        stream = spark.readStream.schema("url string, seq long, at string").json(str(tmp_path / "in" / "*"))
        registrations.start_callbacks(stream, str(tmp_path / "s"), str(tmp_path / "cp")).awaitTermination()
    got = {r["research_id"]: r for r in registrations.current(spark, str(tmp_path / "s")).collect()}
    assert (got["r1"]["status"], got["r1"]["progress"], got["r1"]["projectId"], got["r1"]["syncedAt"]) == ("WORKING", 50, "", "t2")
    assert (got["r2"]["status"], got["r2"]["statusLabel"], got["r2"]["projectId"]) == ("REVIEW", "x", "")  # the registration took both out of the URL
    batch = boards.registered_state(spark.createDataFrame(rows, "url string, seq long, at string"))
    assert sorted(map(repr, batch.collect())) == sorted(map(repr, got.values()))
