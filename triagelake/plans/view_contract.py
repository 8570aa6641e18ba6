"""The views themselves on whole benchmark tables, and state and orders as results, each beside the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triagelake.functions import extract, scalars
from triagelake.functions import semantics as sem
from triagelake.operators import lookup, summary, views
from triagelake.plans import boards
from triagelake.plans.contract import _DAYS_SQL, _GRADE, _GRADE_SQL, _TARGETS_SQL, AS_OF, QUERIES, SQL, _t, _targets, big, contract, notices  # noqa: F401
from triagelake.sources import schemas


def as_records(df: DataFrame, schema: T.StructType, **fields: Column) -> DataFrame:
    """Rows as records of ``schema``: the given fields, null in all others, and ``_ord``."""
    known = {f.name: f.dataType for f in schema.fields}
    cast = {n: c if isinstance(known.get(n), T.ArrayType) else c.cast(known.get(n, "bigint")) for n, c in fields.items()}
    return df.select(*[cast[n].alias(n) if n in cast else F.lit(None).cast(t).alias(n) for n, t in known.items()], *[c.alias(n) for n, c in cast.items() if n not in known])


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def _reviews(df: DataFrame, key: Column, done: Column) -> DataFrame:
    return df.where(done).select(key.alias("review_key"), F.lit("done").alias("status"))


_CLASS_SQL = "CASE WHEN n < 0 THEN 'deadline-closed' WHEN n <= 3 THEN 'deadline-urgent' WHEN n <= 7 THEN 'deadline-soon' ELSE 'deadline-normal' END"
_LABEL_SQL = "CASE WHEN n < 0 THEN '마감' WHEN n = 0 THEN 'D-DAY' ELSE 'D-' || n END"
_DATE_SQL = "strftime(o_orderdate, '%Y-%m-%d')"


@contract(f"""SELECT o_orderkey::VARCHAR AS notice_no, {_GRADE_SQL} AS grade, CASE WHEN o_orderkey % 2 = 0 THEN '문화행사' ELSE '기타' END AS category_label, {_LABEL_SQL} AS d_day, {_CLASS_SQL} AS d_day_class,
(floor(o_totalprice)::BIGINT % 101)::VARCHAR AS score, 'Order ' || o_orderkey AS title, CASE WHEN o_orderkey % 4 = 1 THEN '금액 미공개' ELSE format('{{:,}}', floor(o_totalprice)::BIGINT) || '원' END AS budget,
{_DATE_SQL} AS deadline, CASE WHEN o_orderkey % 5 = 0 THEN 'a · b' ELSE '점수 산정 사유 없음' END AS reasons, 'opportunity-' || o_orderkey AS review_key, CASE WHEN o_orderkey % 3 = 0 THEN 'done' ELSE 'new' END AS review_status
FROM (SELECT *, {_DAYS_SQL} AS n FROM orders)""")
def view_opportunities(spark, sf):
    o, key = _t(spark, sf, "orders"), F.col("o_orderkey")
    price = F.floor("o_totalprice")
    rows = as_records(
        o, schemas.OPPORTUNITIES, noticeNo=_text("o_orderkey"), bidNtceNm=F.lit(""), title=F.concat(F.lit("Order "), _text("o_orderkey")), grade=scalars.lookup(F.col("o_orderpriority"), _GRADE),
        category=F.when(key % 2 == 0, F.lit("festival")), deadline=F.date_format("o_orderdate", "yyyy-MM-dd"), score=price % 101, budgetAmount=F.when(key % 4 == 0, F.lit(0)).when(key % 4 != 1, price),
        asignBdgtAmt=F.when(key % 4 != 1, price.cast("string")), scoreReasons=F.when(key % 5 == 0, F.array(F.lit("a"), F.lit("b"))), _ord=key,
    )
    done = _reviews(o, F.concat(F.lit("opportunity-"), _text("o_orderkey")), key % 3 == 0)
    names = "notice_no grade category_label d_day d_day_class score title budget deadline reasons review_key review_status".split()
    return views.opportunities(rows, done, AS_OF).select(*names)


@contract(f"""SELECT CASE WHEN o_orderkey % 3 = 0 THEN '공고 출처' ELSE 'R' || o_orderkey % 3 END AS source_label, '건축물 미술작품' AS category, '공모' AS status, {_LABEL_SQL} AS d_day, {_CLASS_SQL} AS d_day_class, 'Work ' || o_orderkey AS title,
{_DATE_SQL} AS deadline, {_DATE_SQL} AS period, CASE o_orderkey % 3 WHEN 0 THEN '● 확인됨' WHEN 1 THEN '● 부분 확인' ELSE '● 확인 필요' END AS confidence, 'art-Work ' || o_orderkey || '-' AS review_key, 'new' AS review_status
FROM (SELECT *, {_DAYS_SQL} AS n FROM orders)""")
def view_art(spark, sf):
    key = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    rows = as_records(
        _t(spark, sf, "orders"), schemas.ART, title=F.concat(F.lit("Work "), _text("o_orderkey")), region=F.when(key % 3 != 0, F.concat(F.lit("R"), (key % 3).cast("string"))), periodStart=day, periodEnd=day,
        dateConfidence=F.element_at(F.array(F.lit("high"), F.lit("MEDIUM"), F.lit("x")), (key % 3 + 1).cast("int")), _ord=key,
    )
    names = "source_label category status d_day d_day_class title deadline period confidence review_key review_status".split()
    return views.art(rows, _reviews(spark.range(0).select(F.lit("").alias("k")), F.col("k"), F.lit(True)), AS_OF, periods=True).select(*names)


@contract(f"""SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE 'c' END AS kind, {_LABEL_SQL} AS d_day, (floor(o_totalprice)::BIGINT % 101)::VARCHAR AS score, 'Local ' || o_orderkey AS title,
CASE WHEN o_orderkey % 2 = 0 THEN 'A' ELSE '서울특별시' END AS notice_agency, CASE WHEN o_orderkey % 2 = 0 THEN 'A' ELSE '확인 필요' END AS demand_agency, '제한경쟁' AS contract_short, {_DATE_SQL} AS deadline,
CASE WHEN o_orderkey % 2 = 0 THEN 'a,b,c' ELSE 'b,c' END AS keywords, '산정 사유를 확인해 주세요.' AS reason FROM (SELECT *, {_DAYS_SQL} AS n FROM orders) WHERE n BETWEEN 0 AND 7 AND o_orderkey % 3 <> 1""")
def view_local(spark, sf):
    """Local projects that end soon, of those whose region holds 서울."""
    key = F.col("o_orderkey")
    rows = as_records(
        _t(spark, sf, "orders"), schemas.LOCAL, title=F.concat(F.lit("Local "), _text("o_orderkey")), type=F.when(key % 3 == 0, F.lit("x")), category=F.lit("c"), agencyName=F.when(key % 2 == 0, F.lit("A")),
        contractMethod=F.lit(" 제한경쟁 / 일반경쟁"), closeDate=F.date_format("o_orderdate", "yyyy-MM-dd"), score=F.floor("o_totalprice") % 101, region=F.when(key % 3 != 1, F.lit("서울 중구")),
        directFitKeywords=F.when(key % 2 == 0, F.array(F.lit("a"), F.lit("b"))), keywords=F.array(F.lit("b"), F.lit(""), F.lit("c"), F.lit("b")), _ord=key,
    )
    none = spark.createDataFrame([], "review_key string, status string")
    out = views.local_projects(rows, none, AS_OF, views.Facets(deadline="soon", region="서울"))
    return out.select("kind", "d_day", "score", "title", "notice_agency", "demand_agency", "contract_short", "deadline", F.array_join("keywords", ",").alias("keywords"), "reason")


@contract(f"""SELECT c_mktsegment AS category_label, CASE WHEN o_orderkey % 4 = 0 THEN 'HOLD' WHEN s >= 85 THEN 'S' WHEN s >= 70 THEN 'A' WHEN s >= 50 THEN 'B' ELSE 'C' END AS grade, 'P' || o_orderkey AS title, '기관 미확인' AS agency,
CASE WHEN v >= 10000 THEN format('{{:,}}', (v + 5000) // 10000) || '만원' ELSE format('{{:,}}', v) || '원' END AS amount, {_DATE_SQL} AS deadline, '확인 필요' AS published, CASE WHEN o_orderkey % 2 = 0 THEN 'a,b' ELSE '키워드 미분류' END AS keywords
FROM (SELECT *, floor(o_totalprice)::BIGINT % 101 AS s, floor(o_totalprice)::BIGINT AS v FROM orders JOIN customer ON o_custkey = c_custkey) WHERE o_orderkey % 3 <> 0""")
def view_board(spark, sf):
    """The priority board of every market segment; each third order is excluded."""
    key = F.col("o_orderkey")
    o = _t(spark, sf, "orders").join(_t(spark, sf, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    rows = as_records(
        o, schemas.PRIORITY, title=F.concat(F.lit("P"), _text("o_orderkey")), category=F.col("c_mktsegment"), categoryLabel=F.col("c_mktsegment"), grade=F.when(key % 4 == 0, F.lit("HOLD")), score=F.lit(0),
        fitScore=(F.floor("o_totalprice") % 101).cast("string"), amount=F.floor("o_totalprice").cast("string"), endDate=F.date_format("o_orderdate", "yyyy-MM-dd"), isExcludedFromPriority=key % 3 == 0,
        matchedKeywords=F.when(key % 2 != 0, F.array().cast("array<string>")), field=F.lit("a / b"), _ord=key,
    )
    out = None
    for segment in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"):
        one = views.priority_board(rows, segment)
        out = one if out is None else out.unionByName(one)
    return out.select("category_label", "grade", "title", "agency", "amount", "deadline", "published", F.array_join("keywords", ",").alias("keywords"))


@contract(f"""SELECT priority || '차' AS priority_label, coalesce(grp, '미분류') AS region_group, '-' AS region, 'S' || p_partkey AS source, CASE WHEN p_partkey % 2 = 0 THEN 'https://s.example/' || p_partkey ELSE '' END AS url,
'확인 필요' AS mode, '수집 가능 여부 확인' AS action FROM ({_TARGETS_SQL}) WHERE coalesce(enabled, true)""")
def view_targets(spark, sf):
    t = _targets(spark, sf)
    url = F.concat(F.when(F.col("p_partkey") % 2 == 0, F.lit(" https://s.example/")).otherwise("ftp://s.example/"), _text("p_partkey"))
    rows = as_records(
        t, schemas.TARGETS, priority=F.col("priority"), regionGroup=F.col("regionGroup"), regionGroupLabel=F.col("regionGroupLabel"), enabled=F.col("enabled"), sourceName=F.concat(F.lit("S"), _text("p_partkey")), sourceUrl=url, _ord=F.col("p_partkey"),
    )
    return views.source_targets(rows)


@contract(f"""SELECT o_orderkey AS "at", '나라장터' AS source, {_GRADE_SQL} AS grade, CASE WHEN b < '2000' THEN '-' WHEN a < '2000' THEN b ELSE a || ' ~ ' || b END AS period,
CASE WHEN b < '2000' THEN '-' ELSE b END AS deadline FROM (SELECT *, strftime(o_orderdate - INTERVAL 30 DAY, '%Y-%m-%d') AS a, {_DATE_SQL} AS b FROM orders) WHERE o_orderkey % 4 <> 0""")
def summary_lines(spark, sf):
    """The one-line summary of each notice with a real title."""
    key, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    rows = as_records(
        _t(spark, sf, "orders"), schemas.OPPORTUNITIES, title=F.when(key % 4 == 0, F.lit("조건에 맞는 공고가 없습니다")).otherwise(F.concat(F.lit("n"), _text("o_orderkey"))), grade=scalars.lookup(F.col("o_orderpriority"), _GRADE),
        publishedDate=F.date_format(F.col("o_orderdate") - F.expr("interval 30 days"), "yyyy-MM-dd"), deadlineDate=day, _ord=key,
    )
    return views.summary_line(rows.where(views.real_title(F.col("title"))), "opportunities").select(big(F.col("_ord")).alias("at"), "source", "grade", "period", "deadline")


# ---- state from callbacks, and orders as results ---------------------------


_CALLS = "(SELECT user_id::VARCHAR AS research_id, event_id AS seq, event_type AS kind, value FROM events WHERE event_type <> 'signup')"


@contract(f"""WITH e AS {_CALLS}, d AS (SELECT research_id, max(seq) AS last FROM e WHERE kind = 'error' GROUP BY research_id),
l AS (SELECT e.* FROM e LEFT JOIN d USING (research_id) WHERE kind <> 'error' AND (last IS NULL OR seq > last))
SELECT research_id, CASE arg_max(kind, seq) WHEN 'view' THEN 'REVIEW' WHEN 'click' THEN 'READY' ELSE 'WORKING' END AS status,
CASE WHEN count_if(kind = 'purchase') > 0 THEN '작성' WHEN arg_min(kind, seq) = 'click' THEN '제출준비' ELSE '검토중' END AS "statusLabel",
CASE WHEN count_if(kind = 'purchase') > 0 THEN greatest(0, least(100, floor(arg_max(value, seq) FILTER (kind = 'purchase') + 0.5))) ELSE -1 END::BIGINT AS progress,
CASE WHEN arg_max(kind, seq) = 'view' THEN 'p' || max(seq) ELSE '' END AS "projectId", coalesce('u' || max(seq) FILTER (kind = 'purchase'), '') AS "sheetUpdatedAt",
coalesce((max(seq) FILTER (kind = 'purchase'))::VARCHAR, '') AS "syncedAt", max(seq)::VARCHAR AS "updatedAt" FROM l GROUP BY research_id""")
def callback_state(spark, sf):
    """Registration and sync callbacks as URLs, each delivered twice, folded to the registered state."""
    e, kind, user, seq = _t(spark, sf, "events"), F.col("event_type"), _text("user_id"), _text("event_id")
    url = F.concat(
        F.lit("https://d.example/list?"),
        F.when(kind == "view", F.concat(F.lit("registeredResearchId="), user, F.lit("&projectId=p"), seq))
        .when(kind == "click", F.concat(F.lit("registeredResearchId="), user, F.lit("&status=READY")))
        .when(kind == "purchase", F.concat(F.lit("syncResult=1&syncFound=1&researchId="), user, F.lit("&status=WORKING&statusLabel=%EC%9E%91%EC%84%B1&progress="), F.col("value").cast("string"), F.lit("&updatedAt=u"), seq))
        .when(kind == "error", F.concat(F.lit("syncResult=1&syncFound=0&researchId="), user)).otherwise(F.concat(F.lit("syncResult=0&researchId="), user)),
    )
    urls = e.select(url.alias("url"), F.col("event_id").alias("seq"), seq.alias("at"))
    out = boards.registered_state(urls.unionByName(urls))
    return out.select("research_id", "status", "statusLabel", big(F.coalesce("progress", F.lit(-1))).alias("progress"), "projectId", "sheetUpdatedAt", "syncedAt", "updatedAt")


@contract("""SELECT event_id, event_type, (CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END)::BIGINT AS section,
row_number() OVER (ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, event_id)::BIGINT AS place FROM events""")
def preferred_place(spark, sf):
    """Every event's place in the preferred order, from the operator."""
    rows = _t(spark, sf, "events").select("event_id", "event_type", F.col("event_id").alias("_ord"))
    return lookup.placed_by_preference(rows, "event_type", ["purchase", "click"]).select("event_id", "event_type", "section", "place")


@contract("""SELECT label, value, section, row_number() OVER (ORDER BY section, "at")::BIGINT AS place FROM (SELECT 0::BIGINT AS section, 0::BIGINT AS "at", '전체' AS label, 'all' AS value
UNION ALL SELECT 1, min(p_partkey), p_brand, 'regionGroup:' || p_brand FROM part GROUP BY p_brand)""")
def facet_places(spark, sf):
    """Facet values with their place in the list."""
    p = _t(spark, sf, "part").withColumn("_ord", F.col("p_partkey"))
    found = summary.facet_values(p, F.col("p_brand"), [("전체", "all")], "regionGroup:")
    return views.with_place(found, F.col("section"), F.col("at")).select("label", "value", big(F.col("section")).alias("section"), "place")


# ---- notices of all years: only years from 2000 on are read as such --------


def _all_notices(spark, sf) -> DataFrame:
    """The notices of the extraction queries, for every order."""
    return notices(_t(spark, sf, "orders"))


_NOTICES_SQL = """(SELECT o_orderkey, year(o_orderdate) >= 2000 AS recent, o_orderkey % 3 = 0 AND year(o_orderdate + INTERVAL 21 DAY) >= 2000 AS own, strftime(o_orderdate, '%Y-%m-%d') AS a, strftime(o_orderdate + INTERVAL 20 DAY, '%Y-%m-%d') AS b,
strftime(o_orderdate + INTERVAL 21 DAY, '%Y-%m-%d') AS c FROM orders)"""


@contract(f"SELECT o_orderkey, CASE WHEN recent THEN a WHEN own THEN c END AS published, CASE WHEN recent OR own THEN '등록일' END AS keyword FROM {_NOTICES_SQL}")
def extract_published_all(spark, sf):
    """A registration date before 2000 is none; then the first date behind the keyword that is one counts, and there may be none."""
    p = extract.published_keyword(sem.compact("detailTextSample"), AS_OF)
    return _all_notices(spark, sf).select("o_orderkey", p.alias("p")).select("o_orderkey", F.col("p.value").alias("published"), "p.keyword")


@contract(f"SELECT o_orderkey, CASE WHEN recent THEN a END AS \"start\", CASE WHEN recent THEN b END AS \"end\" FROM {_NOTICES_SQL}")
def extract_range_all(spark, sf):
    """Without a registration date from 2000 on, the year is that of today, which lies before 2000 here: no period."""
    rows = _all_notices(spark, sf).withColumn("text", sem.compact("detailTextSample")).withColumn("pub", F.regexp_extract("text", r"등록일 ([0-9-]+)", 1))
    return rows.select("o_orderkey", extract.period_keyword(F.col("text"), F.col("pub"), AS_OF).alias("p")).select("o_orderkey", "p.start", "p.end")


@contract(f"""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND (recent OR own) THEN c ELSE e END AS deadline, CASE WHEN o_orderkey % 3 = 0 AND (recent OR own) THEN 'explicit_deadline' ELSE 'period_end' END AS source, 'HIGH' AS confidence,
(CASE WHEN o_orderkey % 3 = 0 AND (recent OR own) THEN c ELSE e END) < '2000-12-31' AS expired
FROM (SELECT *, CASE WHEN recent THEN b WHEN substr(b, 6) < substr(a, 6) THEN '2001-' || substr(b, 6) ELSE '2000-' || substr(b, 6) END AS e FROM {_NOTICES_SQL})""")
def extract_deadline_all(spark, sf):
    """Today is in 2000: months and days of the 1990s are read as of that year, and an end before its start as of the next."""
    n = extract.normalize_notices(_all_notices(spark, sf), "2000-12-31")
    return n.select("o_orderkey", "deadline", F.col("deadlineSource").alias("source"), F.col("dateConfidence").alias("confidence"), F.col("isExpired").alias("expired"))
