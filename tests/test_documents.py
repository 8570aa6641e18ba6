"""Large JSON arrays against a plain parser, and documents that are replaced while they are read."""

import json
import random

import pytest
from pyspark.sql import functions as F

from triagelake.sources import arrays, readers, schemas, sinks

BITS = ['"', "\\", "{", "}", "[", "]", ",", ":", "\n", "a", "é", "projects", '":[', '\\"', " "]


def value(r, deep=0):
    kind = r.randint(0, 7 if deep < 3 else 4)
    if kind < 3:
        return "".join(r.choice(BITS) for _ in range(r.randint(0, 12)))
    if kind < 5:
        return r.choice([None, True, 0, -1.5, 10**12])
    if kind == 5:
        return [value(r, deep + 1) for _ in range(r.randint(0, 3))]
    return {"".join(r.choice(BITS) for _ in range(3)) + str(i): value(r, deep + 1) for i in range(r.randint(0, 4))}


def read(spark, path, wrappers=(), cut=None):
    conf = {"spark.sql.files.maxPartitionBytes": str(cut or 1 << 27), "spark.sql.files.openCostInBytes": str(cut or 1 << 22)}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = arrays.elements(spark, path, wrappers).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    rows = sorted(rows, key=lambda r: r["_ord"])
    assert [r["_ord"] for r in rows] == list(range(len(rows)))
    return [json.loads(r["value"]) for r in rows]


@pytest.mark.parametrize("cut", [101, 700])
def test_elements_equal_a_plain_parser(spark, tmp_path, cut):
    r = random.Random(cut)
    path = str(tmp_path / "a.json")
    for n, indent in ((0, None), (1, 2), (25, None), (25, 1)):
        rows = [value(r) for _ in range(n)]
        open(path, "w").write(json.dumps(rows, indent=indent, ensure_ascii=False))
        assert read(spark, path, cut=cut) == rows
        inside = {"count": n, "note": 'x,"projects":[1,2]', "other": [1, [2], {"items": [3]}], "o": {"data": [4]}, "items": rows, "z": [5]}
        open(path, "w").write(json.dumps(inside, indent=indent, ensure_ascii=False))
        assert read(spark, path, ("projects", "items", "data"), cut=cut) == rows
        assert read(spark, path, cut=cut) == []


def test_the_first_wrapper_that_is_an_array_counts(spark, tmp_path):
    path = str(tmp_path / "a.json")
    for document, want in (({"data": [1], "items": [2, 3], "projects": 5}, [2, 3]), ({"data": [1], "projects": {"items": [7]}}, [1]), ({"x": [1]}, []), (5, []), ([], []), ("[1,2]", [])):
        open(path, "w").write(json.dumps(document))
        for cut in (3, 1 << 20):
            assert read(spark, path, ("projects", "items", "data"), cut=cut) == want
    open(path, "w").write("")
    assert read(spark, path) == []


def test_a_large_document_is_read_by_many_tasks(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "big.json")
    rows = [{"id": f"n{i}", "title": f"제목, \"{i}\" [{i % 7}]", "score": i % 101 if i % 3 else str(i % 101), "amount": i} for i in range(40_000)]
    open(path, "w").write(json.dumps({"projects": rows}, ensure_ascii=False, indent=1))
    whole = readers.load_records(spark, path, schemas.PRIORITY, wrapped=True)
    monkeypatch.setattr(readers, "SPLIT_BYTES", 1000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        parts = readers.load_records(spark, path, schemas.PRIORITY, wrapped=True)
        assert arrays._ranges(spark, path).rdd.getNumPartitions() > 8
        show = lambda df: df.select("_ord", "id", "title", F.col("score").cast("string"), F.schema_of_variant("score"), F.col("amount").cast("long")).orderBy("_ord").collect()
        assert show(parts) == show(whole) and parts.count() == 40_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


NOTICES = "id string, title string, _ord long"


def titles(spark, path):
    return [r["title"] for r in readers.load_records(spark, path, schemas.ART, wrapped=True).orderBy("_ord").collect()]


@pytest.mark.parametrize("wrapper", [None, "projects"])
def test_documents_of_one_and_of_many_parts(spark, tmp_path, monkeypatch, wrapper):
    monkeypatch.setattr(sinks, "PART", 10)
    path = str(tmp_path / "doc.json")
    rows = lambda n: spark.createDataFrame([(str(i), f"t{i}, [\"{i}\"", 100 - i) for i in range(n)], NOTICES)
    want = lambda n: [f"t{i}, [\"{i}\"" for i in reversed(range(n))]
    sinks.publish(rows(0), path, wrapper)
    assert json.load(open(path)) == ([] if wrapper is None else {wrapper: []})
    sinks.publish(rows(7), path, wrapper)
    found = json.load(open(path))
    assert [x["title"] for x in (found if wrapper is None else found[wrapper])] == want(7) == titles(spark, path)
    sinks.publish(rows(95), path, wrapper)
    assert titles(spark, path) == want(95)
    text = "".join(open(p).read() for p in sorted(map(str, (tmp_path / "doc.json.d").glob("v-*/part-*"))))
    found = json.loads(text)
    assert [x["title"] for x in (found if wrapper is None else found[wrapper])] == want(95)
    sinks.publish(rows(3), path, wrapper)  # the pointer goes on saying what the document is
    assert titles(spark, path) == want(3)


@pytest.mark.parametrize("large", [False, True])
def test_a_run_that_stops_leaves_the_old_document(spark, tmp_path, monkeypatch, large):
    monkeypatch.setattr(sinks, "PART", 5)
    path = str(tmp_path / "doc.json")
    sinks.publish(spark.createDataFrame([(str(i), "old", i) for i in range(12 if large else 4)], NOTICES), path)
    old = titles(spark, path)

    def stop(*_):
        raise RuntimeError("stopped")

    for step in ("_move_over", "_point_to") if large else ("_move_over",):
        with monkeypatch.context() as m, pytest.raises(RuntimeError, match="stopped"):
            m.setattr(sinks, step, stop)
            source = readers.load_records(spark, path, schemas.ART)
            sinks.publish(source.withColumn("title", F.lit("new")), path)
        assert titles(spark, path) == old
    source = readers.load_records(spark, path, schemas.ART)  # a document that is read while it is replaced
    sinks.publish(source.withColumn("title", F.lit("new")), path)
    assert titles(spark, path) == ["new"] * len(old)


def test_no_group_holds_a_document(spark, tmp_path):
    rows = spark.createDataFrame([("1", "a", 0)], NOTICES)
    plan = sinks.document_lines(rows.withColumn("place", F.col("_ord")), 1)._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "Exchange" not in plan


def test_memo_reads_again_only_what_changed(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "m.json")
    open(path, "w").write(json.dumps([{"id": "1"}]))
    memo, loads = readers.Memo(spark), []
    real = readers.load_records
    monkeypatch.setattr(readers, "load_records", lambda *a, **b: loads.append(a[1]) or real(*a, **b))
    ids = lambda p=path: [r["id"] for r in memo.get(p, schemas.ART).collect()]
    assert ids() == ids() == ["1"] and len(loads) == 1
    open(path, "w").write(json.dumps({"items": [{"id": "2"}, {"id": "33"}]}))
    assert ids() == ids() == ["2", "33"] and len(loads) == 2
    assert ids(path + "-none") == [] and ids(path + "-none") == [] and len(loads) == 3

    def fail(*_, **__):
        loads.append("failed")
        raise readers.PySparkException("unreadable")

    with monkeypatch.context() as m:
        m.setattr(readers, "load_records", fail)
        open(path, "w").write("[]  ")
        assert ids() == ids() == [] and loads.count("failed") == 1
    assert ids() == []  # it stays empty until the document changes
    open(path, "w").write(json.dumps([{"id": "4"}]))
    assert ids() == ["4"]
