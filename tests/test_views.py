"""Sources, views, boards, lookups, state, sinks and the stream, on small records of invented values."""

import json

import pytest
from pyspark.sql import functions as F

from triagelake.operators import lookup, state, summary, views
from triagelake.plans import boards
from triagelake.sources import readers, schemas, sinks
from triagelake.streaming import registrations

AS_OF = "2026-08-22"


@pytest.fixture
def base(tmp_path):
    put = lambda name, value: (tmp_path / name).write_text(json.dumps(value, ensure_ascii=False))
    put("b2g_opportunities.json", [
        {"bidNtceNo": "1", "bidNtceNm": "공공  미술 설치", "grade": "A", "score": 80, "bidClseDt": "2026-08-30 10:00:00", "budgetAmount": 52000000, "category": "public_art", "matchedKeywords": ["미술"], "scoreReasons": ["a", "b"], "publishedDate": "2026-08-01", "deadline": "2026-08-30"},
        {"noticeNo": "2", "title": "전시 <운영>", "grade": "S", "score": 70, "deadline": "2026-08-20", "asignBdgtAmt": "1000", "category": "exhibition"},
        {"noticeNo": "3", "title": "미정", "grade": "S", "score": 99, "presmptPrce": ""},
        {"noticeNo": "4", "title": "동점", "grade": "S", "score": 99},
    ])
    put("art_commissions.json", {"projects": [{"title": "조형물", "region": "서울", "deadline": "2026-08-24", "publishedDate": "2026-08-05", "keywords": ["공모"], "periodEnd": "2026-08-24", "dateConfidence": "HIGH", "detailTextSample": "등록일 2026-08-05"}]})
    put("local_projects.json", [])
    put("priority_projects.json", {"items": [
        {"title": "p1", "category": "other", "score": 90, "amount": "150000000", "endDate": "2026-09-01", "field": "a / / b"}, {"title": "p2", "priorityCategory": "other", "grade": "S", "fitScore": 10, "matchedKeywords": []},
        {"title": "p3", "category": "other", "score": 99, "isExcludedFromPriority": True}, {"title": "p4", "categoryKey": "exhibition_content", "score": 49},
    ]})
    put("art_commission_source_targets.json", {"data": [
        {"sourceName": "a", "priority": "1", "regionGroup": "수도권", "sourceUrl": "https://a.example"}, {"sourceName": "b", "priority": "2", "enabled": False}, {"sourceName": "c", "priority": "2", "regionGroupLabel": "영남"},
        {"sourceName": "d", "priority": "1", "regionGroupLabel": "수도권"},
    ]})
    put("dashboard_meta.json", {"lastUpdatedAt": "2026-08-22 11:22", "timezone": "KST", "opportunityCount": 2})
    return str(tmp_path)


def reviews(spark):
    return spark.createDataFrame([("opportunity-2", "done")], "review_key string, status string")


def test_base_views(spark, base):
    out = boards.base_views(spark, base, reviews(spark), AS_OF)
    rows = out["opportunities"].orderBy("review_key").collect()
    assert [r["review_status"] for r in rows] == ["new", "done", "new", "new"]
    one = rows[0]
    assert (one["title"], one["d_day"], one["budget"], one["reasons"], one["category_label"], one["publish_period"], one["deadline_date"]) == ("공공  미술 설치", "D-8", "52,000,000원", "a · b", "공공미술", "2026-08-01 ~ 2026-08-30", "2026-08-30")
    assert tuple(out["grades"].first()) == (4, 3, 1, 0)
    assert out["banner"].first()[0] == "최근 업데이트 : 2026-08-22 11:22 (KST)"
    assert out["agencies"].count() == 0 and out["local"].count() == 0
    art = out["art"].first()
    assert (art["source_label"], art["d_day"], art["d_day_class"]) == ("서울", "D-2", "deadline-urgent")


def test_order_and_facets(spark, base):
    t = readers.load_records(spark, f"{base}/b2g_opportunities.json", schemas.OPPORTUNITIES)
    order = lambda f: [r["notice_no"] for r in views.opportunities(t, reviews(spark), AS_OF, f).collect()]
    assert order(views.Facets()) == ["2", "3", "4", "1"]  # closed before unknown, ties as they came
    assert order(views.Facets(search="미술")) == ["1"] and order(views.Facets(search="미술  ")) == []  # this search is not trimmed
    assert order(views.Facets(grade="S", review="new")) == ["3", "4"] and order(views.Facets(category="exhibition")) == ["2"]


def test_agencies_and_local(spark):
    rows = [("가", "서울", "A", "5", 1, 0), ("나", "강원", "A", "9", 0, 2), ("다", "전국", None, "", 0, 0)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "agencyName string, region string, grade string, estimatedAmount string, awardCount int, orderPlanCount int, _ord long")
    full = df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schemas.AGENCIES.fields if f.name not in df.columns})
    names = lambda **f: [r["name"] for r in views.agencies(full, reviews(spark), views.Facets(**f)).collect()]
    assert names() == ["나", "가", "다"] and names(region="기타") == ["나", "다"] and names(award_only=True) == ["가"] and names(plan_only=True) == ["나"] and names(search="강원") == ["나"]
    rows = [("a", "2026-08-22", "x"), ("b", "2026-08-21", "y"), ("c", "", "x"), ("d", "2026-10-01", "x")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "title string, deadline string, projectType string, _ord long")
    full = df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schemas.LOCAL.fields if f.name not in df.columns})
    titles = lambda **f: [r["title"] for r in views.local_projects(full, reviews(spark), AS_OF, views.Facets(**f)).collect()]
    assert titles() == ["a", "d", "b", "c"] and titles(deadline="soon") == ["a"] and titles(deadline="active") == ["a", "d"] and titles(deadline="closed") == ["b"] and titles(deadline="unknown") == ["c"] and titles(kind="y") == ["b"]


def test_priority_board(spark, base):
    p = readers.load_records(spark, f"{base}/priority_projects.json", schemas.PRIORITY, wrapped=True)
    panels, counts = boards.board(p)
    assert counts.first().asDict() == {"mural_sculpture": 0, "exhibition_content": 1, "arts_content_support": 0, "other": 2, "excluded": 1}
    rows = panels["other"].collect()
    assert [(r["title"], r["grade"], r["amount"], r["deadline"], r["keywords"]) for r in rows] == [
        ("p1", "S", "1.5억", "2026-09-01", ["a", "b"]), ("p2", "S", "예산 미확인", "확인 필요", ["키워드 미분류"]),
    ]
    assert panels["exhibition_content"].first()["grade"] == "C" and views.excluded(p).count() == 1


def test_numeric_zeros_give_way_to_the_next_alias(spark):
    load = lambda records, schema: readers.parse_records(spark.createDataFrame([(json.dumps(records),)], "value string"), schema)
    notices = [{"noticeNo": "1", "budgetAmount": 0, "asignBdgtAmt": "5000"}, {"noticeNo": "2", "budgetAmount": "0", "asignBdgtAmt": "5000"}, {"noticeNo": "3", "budgetAmount": 0.0, "presmptPrce": 70}]
    shown = {r["notice_no"]: r["budget"] for r in views.opportunities(load(notices, schemas.OPPORTUNITIES), reviews(spark), AS_OF).collect()}
    assert shown == {"1": "5,000원", "2": "금액 미공개", "3": "70원"}
    projects = [{"title": "a", "score": 0, "fitScore": 90, "amount": 0, "budget": 7}, {"title": "b", "score": 0}, {"title": "c", "score": 60, "fitScore": 90, "amount": "0", "budget": 7}, 5, None]
    rows = views.priority_rows(load(projects, schemas.PRIORITY)).where("title is not null").orderBy("_ord").collect()
    assert [(r["board_score"], r["board_grade"], r["board_amount"]) for r in rows] == [(90.0, "S", 7.0), (0.0, "C", 0.0), (60.0, "B", 0.0)]


def test_targets(spark, base):
    t = readers.load_records(spark, f"{base}/art_commission_source_targets.json", schemas.TARGETS, wrapped=True)
    assert summary.target_counts(t).first().asDict() == {"total": 3, "priority_1": 2, "priority_2": 1, "priority_3": 0, "region_groups": 2}
    names = lambda tag: [r["source"] for r in views.source_targets(t, tag).collect()]
    assert names("all") == ["a", "c", "d"] and names("priority:1") == ["a", "d"] and names("regionGroup:영남") == ["c"] and names("other:1") == ["a", "c", "d"]
    facets = summary.facet_values(t.where("coalesce(enabled, true)"), F.coalesce("regionGroupLabel", "regionGroup"), [("전체", "all")], "regionGroup:")
    assert [r["value"] for r in facets.collect()] == ["all", "regionGroup:수도권", "regionGroup:영남"]


def test_wrappers(spark):
    texts = spark.createDataFrame([('{"data":[{"a":"1"}],"items":3}',), ('[{"a":2},{}]',), ('{"x":[]}',), ("not json",)], "value string")
    kind = boards.schemas.T.StructType.fromDDL("a string")
    assert [r["a"] for r in readers.parse_records(texts, kind).collect()] == ["1", "2", None]
    with pytest.raises(Exception, match="no array of records"):
        readers.parse_records(texts.limit(3), kind, strict=True).collect()
    assert readers.load_records(spark, "/no/such/file.json", schemas.ART).count() == 0
    assert [tuple(r) for r in readers.kv_entries(spark.createDataFrame([('{"k":"v"}',), ("broken",)], "value string")).collect()] == [("k", "v")]


def test_normalize_file(spark, base):
    path = f"{base}/art_commissions.json"
    assert {r["value"]: r["n"] for r in boards.normalize_file(spark, path, AS_OF, "projects").collect()} == {"HIGH": 0, "MEDIUM": 1, "LOW": 0}
    done = json.load(open(path))["projects"]
    assert (done[0]["publishedDate"], done[0]["deadlineSource"], done[0]["dateNormalizedAt"]) == ("2026-08-05", "existing_deadline", AS_OF)


def test_first_match(spark):
    left = spark.createDataFrame([(1, "a  b"), (2, ""), (3, "zz")], "i int, t string")
    right = spark.createDataFrame([(5, "a b ", "late"), (4, " a b", "first"), (6, None, "none")], "_ord long, t string, v string")
    assert [tuple(r) for r in lookup.lookup_first(left, right, F.col("t"), F.col("t"), {"v": "v"}).orderBy("i").select("i", "v").collect()] == [(1, "first"), (2, None), (3, None)]


def test_register_and_sync(spark, base):
    urls = [
        ("https://d.example/?registeredResearchId=r1&projectId=p1", 1), ("https://d.example/?syncResult=1&syncFound=1&researchId=r1&status=WORKING&statusLabel=%EC%9E%91%EC%84%B1&progress=49.5&projectId=&updatedAt=u", 2),
        ("https://d.example/?registeredResearchId=r2", 3), ("https://d.example/?syncResult=1&syncFound=0&researchId=r2", 4), ("https://d.example/?syncResult=0&researchId=r1", 5), ("https://d.example/?registeredResearchId=r3&status=READY", 6),
    ]
    kv = boards.registered_state(spark.createDataFrame([(u, s, f"t{s}") for u, s in urls], "url string, seq long, at string"))
    got = {r["research_id"]: r for r in kv.collect()}
    assert set(got) == {"r1", "r3"}
    assert (got["r1"]["status"], got["r1"]["statusLabel"], got["r1"]["progress"], got["r1"]["projectId"], got["r1"]["syncedAt"], got["r1"]["sheetUpdatedAt"]) == ("WORKING", "작성", 50, "", "t2", "u")
    assert (got["r3"]["status"], got["r3"]["statusLabel"], got["r3"]["syncedAt"]) == ("READY", "제출준비", "")
    projects = spark.createDataFrame([(0, "r1", "제목", 85.0), (1, "", "다른 제목", 10.0)], "_ord long, id string, title string, score double")
    full = projects.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schemas.PRIORITY.fields if f.name not in projects.columns})
    rows = boards.capture_links(full, kv, "priority", "https://app.example/x").orderBy("_ord").collect()
    assert rows[0]["button"] == "✓ 지원 관리 등록됨 · 작성 · 50%" and rows[1]["button"] == "⭐ 지원 관리에 추가"
    assert rows[0]["add_url"].startswith("https://app.example/x?mode=add&researchId=r1&title=%EC%A0%9C%EB%AA%A9&institution=&deadline=&priority=HIGH&")
    assert rows[1]["research_id"] == "priority::다른 제목::" and "projectId" not in rows[1]["sync_url"]


def test_labels_do_not_follow_a_later_status(spark):
    rows = [("k", 1, "upsert", "t1", False, "REVIEW", None, None, "p", None), ("k", 2, "upsert", "t2", False, "READY", None, None, None, None)]
    df = spark.createDataFrame(rows, "research_id string, seq long, op string, at string, is_sync boolean, status string, statusLabel string, progress string, projectId string, sheetUpdatedAt string")
    r = state.merged(df).first()
    assert (r["status"], r["statusLabel"], r["projectId"], r["updatedAt"]) == ("READY", "검토중", "p", "t2")


def test_stream(spark, tmp_path):
    schema = "research_id string, seq long, op string, at string, is_sync boolean, status string, statusLabel string, progress string, projectId string, sheetUpdatedAt string"
    put = lambda n, rows: spark.createDataFrame(rows, schema).write.json(str(tmp_path / "in" / n))
    put("a", [("k", 1, "upsert", "t1", False, "WORKING", None, "10", "p", None), ("l", 2, "upsert", "t2", False, None, None, None, "", None)])
    events = lambda: spark.readStream.schema(schema).json(str(tmp_path / "in" / "*"))
    go = lambda: registrations.start(events(), str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination()
    go()
    put("b", [("l", 3, "delete", "t3", False, None, None, None, None, None), ("k", 4, "upsert", "t4", True, None, None, "20", None, "u")])
    go()
    assert [(r["research_id"], r["progress"], r["syncedAt"]) for r in registrations.current(spark, str(tmp_path / "state")).collect()] == [("k", 20, "t4")]


def test_kv_and_documents(spark):
    kv = spark.createDataFrame([("b", "2"), ("a", "1")], "key string, value string")
    assert sinks.kv_document(kv).first()[0] == '{"a":"1","b":"2"}'
    rows = spark.createDataFrame([(1, "y"), (0, "x")], "_ord long, t string")
    assert json.loads(sinks.wrapped_document(rows).first()[0]) == [{"t": "x"}, {"t": "y"}]


def test_plans_push_filters_and_columns(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = views.keep(df, views.equals(F.col("o_orderstatus"), "P")).select("o_orderkey")._jdf.queryExecution().toString()
    assert "EqualTo(o_orderstatus,P)" in plan.replace("EqualNullSafe", "EqualTo") and "o_totalprice" not in plan.split("ReadSchema")[-1]


MIXED = [
    {"id": "a", "score": "90", "amount": 0, "budget": "7"}, {"id": "b", "score": 80.5, "amount": "0", "budget": 7}, {"id": "c", "score": 0, "theirScore": "55", "amount": 5.50},
    {"id": "d", "score": True}, {"id": "e", "score": False, "theirScore": 71}, {"id": "f", "score": "", "fitScore": None, "theirScore": "99"}, {"id": "g", "score": [1], "amount": {"x": 1}}, {"id": "h", "score": 1e2},
]


@pytest.mark.parametrize("by_line", [False, True])
def test_values_count_by_their_own_type_in_every_reader(spark, tmp_path, by_line):
    names = {"theirScore": "fitScore", "theirReason": "fitReason"}
    path = str(tmp_path / "records.json")
    open(path, "w").write("\n".join(map(json.dumps, MIXED)) if by_line else json.dumps(MIXED))
    load = readers.load_lines if by_line else readers.load_records
    rows = views.priority_rows(load(spark, path, schemas.PRIORITY, names=names))
    got = {r["id"]: (r["board_score"], r["board_grade"], r["board_amount"]) for r in rows.collect()}
    assert got == {
        "a": (90.0, "S", 7.0), "b": (80.5, "A", 0.0), "c": (55.0, "B", 5.5), "d": (1.0, "C", 0.0), "e": (71.0, "A", 0.0), "f": (99.0, "S", 0.0), "g": (0.0, "C", 0.0), "h": (100.0, "S", 0.0),
    }
    plain = {r["id"]: r["board_score"] for r in views.priority_rows(load(spark, path, schemas.PRIORITY)).collect()}
    assert (plain["c"], plain["e"], plain["f"], plain["a"]) == (0.0, 0.0, 0.0, 90.0)  # without a map no other name counts


def test_names_of_the_documents_give_reasons(spark):
    texts = spark.createDataFrame([('[{"id":"1","theirReason":"왜"},{"id":"2","fitReason":"own","theirReason":"왜"},{"id":"3","gradeReason":"g","theirReason":"왜"}]',)], "value string")
    rows = views.priority_rows(readers.parse_records(texts, schemas.PRIORITY, names={"theirReason": "fitReason"})).orderBy("_ord")
    assert [r["grade_reason"] for r in rows.collect()] == ["왜", "own", "g"]


def test_scores_of_opportunities_show_as_they_came(spark):
    texts = spark.createDataFrame([(json.dumps([{"noticeNo": str(i), "score": s} for i, s in enumerate([80.5, "81", 1e3, 7, "", None])]),)], "value string")
    rows = views.opportunities(readers.parse_records(texts, schemas.OPPORTUNITIES), reviews(spark), AS_OF).collect()
    assert [(r["notice_no"], r["score"]) for r in rows] == [("2", "1000"), ("1", "81"), ("0", "80.5"), ("3", "7"), ("4", "-"), ("5", "-")]


def test_first_match_moves_no_text_through_the_aggregation(spark):
    left = spark.createDataFrame([(1, "a  b", "x"), (2, "", "y"), (3, None, "z"), (4, "c", "w")], "i int, t string, v string")
    right = spark.createDataFrame([(5, "a b ", "late"), (4, " a b", "first"), (6, None, "none"), (7, "", "empty"), (9, "c", None)], "_ord long, t string, v string")
    got = lookup.lookup_first(left, right, F.col("t"), F.col("t"), {"v": "found", "_ord": "at"})
    assert [tuple(r) for r in got.orderBy("i").select("i", "v", "found", "at").collect()] == [(1, "x", "first", 4), (2, "y", None, None), (3, "z", None, None), (4, "w", None, 9)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    for line in [x for x in plan.splitlines() if "Aggregate" in x]:
        assert "regexp_replace" not in line and "v#" not in line and "struct" not in line
    assert plan.count("regexp_replace") == 2  # one compaction for each row of either side
