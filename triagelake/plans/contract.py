"""Every operator on whole benchmark tables, each beside the SQL that says the same.

The tables are not procurement records, so each query maps their columns to
the fields that an operator reads, and calls the operator itself.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.functions import dates, extract, scalars
from triagelake.functions import semantics as sem
from triagelake.operators import lookup, resolvers, state, summary, views
from triagelake.operators.ranking import Key
from triagelake.sources import readers, schemas

AS_OF = "1998-06-15"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def contract(sql: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def big(c: Column) -> Column:
    return c.cast("bigint")


# ---- records made from orders ---------------------------------------------

_GRADE = {"1-URGENT": "S", "2-HIGH": "A", "3-MEDIUM": "B", "4-NOT SPECIFIED": "C", "5-LOW": "HOLD"}
_GRADE_SQL = "CASE o_orderpriority WHEN '1-URGENT' THEN 'S' WHEN '2-HIGH' THEN 'A' WHEN '3-MEDIUM' THEN 'B' WHEN '4-NOT SPECIFIED' THEN 'C' ELSE 'HOLD' END"
_RANK_SQL = "CASE grade WHEN 'S' THEN 0 WHEN 'A' THEN 1 WHEN 'B' THEN 2 WHEN 'C' THEN 3 ELSE 9 END"
_DAYS_SQL = f"date_diff('day', DATE '{AS_OF}', o_orderdate::DATE)"
_SORT_SQL = f"CASE WHEN o_orderdate IS NULL THEN 9999 WHEN {_DAYS_SQL} < 0 THEN 9998 ELSE {_DAYS_SQL} END"


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as notices: grade, deadline text, score, and their key as source order."""
    o = _t(spark, sf, "orders")
    return o.select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", F.col("o_orderkey").alias("_ord"),
        scalars.lookup(F.col("o_orderpriority"), _GRADE).alias("grade"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("deadline"), (F.floor(F.col("o_totalprice")) % 101).cast("int").alias("score"),
    )


@contract(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*)::BIGINT AS n FROM {t}" for t in TABLES))
def scan_count(spark, sf):
    out = None
    for t in TABLES:
        one = readers.load_parquet(spark, f"{sf}/{t}.parquet").agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@contract("SELECT o_orderkey, o_orderstatus FROM orders WHERE false")
def empty_fallback(spark, sf):
    return readers.load_parquet(spark, f"{sf}/no_such_table.parquet", _t(spark, sf, "orders").select("o_orderkey", "o_orderstatus").schema)


@contract("SELECT event_id, (json_extract(props, '$.k'))::BIGINT AS k FROM events")
def json_props(spark, sf):
    return _t(spark, sf, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@contract("SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events")
def kv_scan(spark, sf):
    rows = _t(spark, sf, "events").select("event_id", F.from_json("props", "map<string,string>").alias("m"))
    return rows.select("event_id", F.explode(F.map_entries("m")).alias("e")).select("event_id", "e.key", "e.value")


@contract("""SELECT event_type, pos - 1 AS _ord, n FROM (SELECT event_type, unnest(range(1, 4)) AS pos, unnest([count(*), count(*) + 1, count(*) + 2])::BIGINT AS n FROM events GROUP BY event_type)""")
def wrapped_records(spark, sf):
    counts = _t(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    kind = F.lit('","n":')
    record = lambda k: F.concat(F.lit('{"event_type":"'), F.col("event_type"), kind, (F.col("n") + k).cast("string"), F.lit("}"))
    array = F.concat(F.lit("["), F.concat_ws(",", *[record(k) for k in range(3)]), F.lit("]"))
    # a different wrapper by the length of the name: none, projects, items, data
    value = F.concat(F.element_at(F.array(F.lit(""), F.lit('{"projects":'), F.lit('{"items":'), F.lit('{"data":')), F.length("event_type") % 4 + 1), array, F.when(F.length("event_type") % 4 > 0, F.lit("}")).otherwise(""))
    return readers.parse_records(counts.select(value.alias("value")), _schema("event_type string, n bigint")).select("event_type", big(F.col("_ord")).alias("_ord"), "n")


def _schema(ddl: str):
    from pyspark.sql import types as T

    return T.StructType.fromDDL(ddl)


@contract("""SELECT p_partkey, coalesce(nullif(CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size % 3 = 1 THEN NULL ELSE p_name END, ''), nullif(CASE WHEN p_size % 2 = 0 THEN '' ELSE p_brand END, ''), p_type, '-') AS title,
coalesce(CASE WHEN nullif(p_size % 4, 0) IS NULL THEN NULL ELSE (p_size % 4)::DOUBLE END, p_retailprice, 0.0) AS amount FROM part""")
def truthy_title(spark, sf):
    p = _t(spark, sf, "part")
    name = F.when(F.col("p_size") % 3 == 0, F.lit("")).when(F.col("p_size") % 3 == 1, F.lit(None)).otherwise(F.col("p_name"))
    brand = F.when(F.col("p_size") % 2 == 0, F.lit("")).otherwise(F.col("p_brand"))
    size = F.nullif(F.col("p_size") % 4, F.lit(0)).cast("string")
    return p.select("p_partkey", sem.truthy(name, brand, "p_type", default="-").alias("title"), sem.first_number(size, F.col("p_retailprice").cast("string")).alias("amount"))


@contract("""SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE contains(lower(s_name || ' ' || n_name || ' ' || r_name), lower('1 Nation_1'))""")
def search_multi(spark, sf):
    rows = _t(spark, sf, "supplier").join(_t(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(_t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return views.keep(rows, views.search("1 Nation_1", "s_name", "n_name", "r_name")).select("s_suppkey")


@contract("SELECT doc_id FROM documents WHERE contains(lower(text), 'the')")
def search_docs(spark, sf):
    return views.keep(_t(spark, sf, "documents"), views.search("  THE ", "text")).select("doc_id")


@contract(f"SELECT o_orderkey, {_GRADE_SQL} AS grade, {_RANK_SQL.replace('grade', '(' + _GRADE_SQL + ')')}::BIGINT AS rank FROM orders WHERE {_GRADE_SQL} = 'A'")
def facet_grade(spark, sf):
    return views.keep(_orders(spark, sf), views.equals(F.col("grade"), "A"), views.equals(F.col("o_orderstatus"), views.ALL)).select("o_orderkey", "grade", big(scalars.grade_rank("grade")).alias("rank"))


@contract("""SELECT n_nationkey, region FROM (SELECT n_nationkey, CASE n_nationkey % 6 WHEN 0 THEN '서울 전역' WHEN 1 THEN '경기' WHEN 2 THEN '강원' WHEN 3 THEN '전국' WHEN 4 THEN '기타 지역' ELSE '서울, 전국' END AS region FROM nation)
WHERE region LIKE '%기타%' OR region LIKE '%전국%' OR NOT regexp_matches(region, '서울|경기|인천|부산|대전|광주|대구|울산|세종')""")
def facet_region_other(spark, sf):
    names = F.array(*[F.lit(x) for x in ("서울 전역", "경기", "강원", "전국", "기타 지역", "서울, 전국")])
    rows = _t(spark, sf, "nation").select("n_nationkey", F.element_at(names, F.col("n_nationkey") % 6 + 1).alias("region"))
    return views.keep(rows, views.in_region(F.col("region"), views.OTHER))


@contract("""SELECT c_custkey, count(o_orderkey)::BIGINT AS awards, count_if(o_orderstatus = 'P')::BIGINT AS plans FROM customer LEFT JOIN orders ON c_custkey = o_custkey
GROUP BY c_custkey HAVING count(o_orderkey) > 0 AND count_if(o_orderstatus = 'P') > 0""")
def facet_flags(spark, sf):
    o = _t(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("awards"), F.count_if(F.col("o_orderstatus") == "P").alias("plans"))
    rows = _t(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return views.keep(rows, views.positive(F.col("awards"), True), views.positive(F.col("plans"), True)).select("c_custkey", "awards", "plans")


@contract(f"""SELECT o_orderkey, CASE WHEN n < 0 THEN '마감' WHEN n = 0 THEN 'D-DAY' ELSE 'D-' || n END AS label,
CASE WHEN n < 0 THEN 'deadline-closed' WHEN n <= 3 THEN 'deadline-urgent' WHEN n <= 7 THEN 'deadline-soon' ELSE 'deadline-normal' END AS class, (CASE WHEN n < 0 THEN 9998 ELSE n END)::BIGINT AS sort_days
FROM (SELECT o_orderkey, {_DAYS_SQL} AS n FROM orders)""")
def dday_label(spark, sf):
    d = dates.d_day("deadline", AS_OF)
    return _orders(spark, sf).select("o_orderkey", d.alias("d")).select("o_orderkey", "d.label", "d.class", big(F.col("d.sort_days")).alias("sort_days"))


@contract(f"""SELECT f.status, count_if(CASE f.status WHEN 'soon' THEN n BETWEEN 0 AND 7 WHEN 'active' THEN n >= 0 AND n < 9998 WHEN 'closed' THEN n < 0 WHEN 'unknown' THEN n IS NULL ELSE true END)::BIGINT AS n
FROM (SELECT CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE {_DAYS_SQL} END AS n FROM orders), (VALUES ('soon'), ('active'), ('closed'), ('unknown'), ('all')) f(status) GROUP BY f.status""")
def facet_deadline(spark, sf):
    rows = _orders(spark, sf).select(dates.d_day(F.when(F.col("o_orderkey") % 10 != 0, F.col("deadline")), AS_OF).alias("d"))
    names = ("soon", "active", "closed", "unknown", "all")
    one = rows.agg(*[F.count_if(dates.matches_deadline(F.col("d"), s)).alias(s) for s in names])
    return one.select(F.explode(F.array(*[F.struct(F.lit(s).alias("status"), F.col(s).alias("n")) for s in names])).alias("x")).select("x.status", "x.n")


@contract("""SELECT o_orderkey, coalesce(flag, false) AS excluded, coalesce(flag, true) AS enabled FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN true WHEN o_orderkey % 3 = 1 THEN false END AS flag FROM orders)""")
def null_flags(spark, sf):
    flag = F.when(F.col("o_orderkey") % 3 == 0, F.lit(True)).when(F.col("o_orderkey") % 3 == 1, F.lit(False))
    return _t(spark, sf, "orders").select("o_orderkey", flag.alias("flag")).select("o_orderkey", sem.eq_true("flag").alias("excluded"), sem.not_false("flag").alias("enabled"))


_TARGETS_SQL = "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN false WHEN p_partkey % 5 = 1 THEN NULL ELSE true END AS enabled, (p_size % 4)::VARCHAR AS priority, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_brand END AS grp FROM part"


def _targets(spark, sf):
    p = _t(spark, sf, "part")
    return p.select(
        F.col("p_partkey"), F.col("p_partkey").alias("_ord"), F.when(F.col("p_partkey") % 5 == 0, F.lit(False)).when(F.col("p_partkey") % 5 == 1, F.lit(None)).otherwise(True).alias("enabled"),
        (F.col("p_size") % 4).cast("string").alias("priority"), F.lit("").alias("regionGroupLabel"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_brand")).alias("regionGroup"),
    )


@contract(f"""SELECT p_partkey, 'p' AS facet FROM ({_TARGETS_SQL}) WHERE coalesce(enabled, true) AND priority = '2' UNION ALL SELECT p_partkey, 'r' FROM ({_TARGETS_SQL}) WHERE coalesce(enabled, true) AND coalesce(grp, '미분류') = 'Brand#2'
UNION ALL SELECT p_partkey, 'x' FROM ({_TARGETS_SQL}) WHERE coalesce(enabled, true) AND grp IS NULL""")
def tag_facet(spark, sf):
    t = _targets(spark, sf)
    one = lambda tag, name: t.where(views.tagged(tag)).select("p_partkey", F.lit(name).alias("facet"))
    return one("priority:2", "p").unionByName(one("regionGroup:Brand#2", "r")).unionByName(one("regionGroup:미분류", "x"))


@contract("""SELECT d.doc_id, 'opportunity-' || d.doc_id AS review_key, CASE WHEN l.doc_id IS NULL THEN 'new' WHEN quality = 1 THEN 'done' ELSE 'hold' END AS review_status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def review_join(spark, sf):
    kv = _t(spark, sf, "labels").select(F.concat(F.lit("opportunity-"), F.col("doc_id").cast("string")).alias("review_key"), F.when(F.col("quality") == 1, F.lit("done")).otherwise("hold").alias("status"))
    docs = _t(spark, sf, "documents").select("doc_id", F.lit("").alias("bidNtceNo"), F.col("doc_id").cast("string").alias("noticeNo"), F.lit(None).cast("string").alias("bidNtceNm"), F.lit("").alias("title"))
    return lookup.with_review(docs, kv, scalars.opportunity_key()).select("doc_id", "review_key", "review_status")


@contract("""SELECT d.doc_id, f.first_id FROM documents d LEFT JOIN (SELECT key, min(doc_id) AS first_id FROM (SELECT trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')) AS key, doc_id FROM documents) WHERE key <> '' GROUP BY key) f
ON trim(regexp_replace(d.text, '[ \\t\\r\\n]+', ' ', 'g')) = f.key""")
def lookup_first(spark, sf):
    docs = _t(spark, sf, "documents").select("doc_id", "text", F.col("doc_id").alias("_ord"))
    return lookup.lookup_first(docs, docs, F.col("text"), F.col("text"), {"_ord": "first_id"}).select("doc_id", "first_id")


@contract("""SELECT c_custkey, coalesce(event_type, '') AS last_type FROM customer LEFT JOIN (SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id) ON c_custkey = user_id""")
def kv_left(spark, sf):
    last = state.last_write(_t(spark, sf, "events"), "user_id", "event_type", "event_id").select(F.col("user_id").cast("string").alias("card_key"), F.col("event_type").alias("memo"))
    c = _t(spark, sf, "customer").select("c_custkey")
    memos = last.withColumn("card_key", F.concat(F.lit("p-"), "card_key"))
    return lookup.with_memo(c, memos, "p", F.col("c_custkey").cast("string")).select("c_custkey", F.col("memo").alias("last_type"))


@contract(f"SELECT count(*)::BIGINT AS total, count_if(g = 'S')::BIGINT AS s, count_if(g = 'A')::BIGINT AS a, count_if(g IN ('B', 'C'))::BIGINT AS bc FROM (SELECT {_GRADE_SQL} AS g FROM orders)")
def grade_counts(spark, sf):
    return summary.grade_counts(_orders(spark, sf))


@contract("""SELECT count(*)::BIGINT AS total, count_if(contains(text, 'the'))::BIGINT AS first, count_if(contains(text, 'que'))::BIGINT AS second, greatest(count(*) - count_if(contains(text, 'the')) - count_if(contains(text, 'que')), 0)::BIGINT AS rest FROM documents""")
def overlap_counts(spark, sf):
    return summary.region_overlap(_t(spark, sf, "documents"), "text", "the", "que")


@contract("""SELECT count_if(event_type = 'view' AND NOT x)::BIGINT AS "view", count_if(event_type = 'click' AND NOT x)::BIGINT AS click, count_if(event_type = 'purchase' AND NOT x)::BIGINT AS purchase, count_if(event_type = 'none' AND NOT x)::BIGINT AS "none",
count_if(x)::BIGINT AS excluded FROM (SELECT event_type, coalesce(CASE WHEN user_id % 5 = 0 THEN true WHEN user_id % 5 = 1 THEN NULL ELSE false END, false) AS x FROM events)""")
def category_counts(spark, sf):
    x = F.when(F.col("user_id") % 5 == 0, F.lit(True)).when(F.col("user_id") % 5 == 1, F.lit(None)).otherwise(False)
    return summary.category_counts(_t(spark, sf, "events"), F.col("event_type"), x, ["view", "click", "purchase", "none"])


@contract(f"""SELECT count(*)::BIGINT AS total, count_if(priority = '1')::BIGINT AS priority_1, count_if(priority = '2')::BIGINT AS priority_2, count_if(priority = '3')::BIGINT AS priority_3,
count(DISTINCT coalesce(grp, '미분류'))::BIGINT AS region_groups FROM ({_TARGETS_SQL}) WHERE coalesce(enabled, true)""")
def distinct_counts(spark, sf):
    return summary.target_counts(_targets(spark, sf))


@contract("""SELECT 0::BIGINT AS section, 0::BIGINT AS at, '전체' AS label, 'all' AS value UNION ALL SELECT 1, min(p_partkey), p_brand, 'regionGroup:' || p_brand FROM part GROUP BY p_brand""")
def facet_values(spark, sf):
    p = _t(spark, sf, "part").withColumn("_ord", F.col("p_partkey"))
    return summary.facet_values(p, F.col("p_brand"), [("전체", "all")], "regionGroup:").select(big(F.col("section")).alias("section"), "at", "label", "value")


@contract("""SELECT d.value, coalesce(n, 0)::BIGINT AS n FROM (VALUES ('HIGH'), ('MEDIUM'), ('LOW'), ('NEVER')) d(value) LEFT JOIN (SELECT CASE WHEN value >= 60 THEN 'HIGH' WHEN value >= 20 THEN 'MEDIUM' WHEN value >= 1 THEN 'LOW' ELSE 'OTHER' END AS value, count(*) AS n FROM events GROUP BY 1) h ON d.value = h.value""")
def histogram_zero(spark, sf):
    v = F.when(F.col("value") >= 60, F.lit("HIGH")).when(F.col("value") >= 20, F.lit("MEDIUM")).when(F.col("value") >= 1, F.lit("LOW")).otherwise("OTHER")
    return summary.histogram(_t(spark, sf, "events"), v, ["HIGH", "MEDIUM", "LOW", "NEVER"])


@contract("SELECT coalesce(NULL, count(*))::BIGINT AS n FROM orders")
def meta_counter(spark, sf):
    return summary.counter(spark.createDataFrame([(None,)], "n int"), "n", _t(spark, sf, "orders"))


@contract(f"""SELECT o_orderkey, grade, sort_days::BIGINT AS sort_days, row_number() OVER (ORDER BY {_RANK_SQL}, sort_days, score DESC, o_orderkey)::BIGINT AS place
FROM (SELECT o_orderkey, {_GRADE_SQL} AS grade, {_SORT_SQL} AS sort_days, floor(o_totalprice)::BIGINT % 101 AS score FROM orders WHERE o_orderstatus = 'P')""")
def view_ranked(spark, sf):
    rows = views.keep(_orders(spark, sf), views.equals(F.col("o_orderstatus"), "P")).withColumn("d_day", dates.d_day("deadline", AS_OF))
    rows = rows.select("o_orderkey", "_ord", "grade", "score", "d_day")
    return views.with_place(rows, *views.by_grade_deadline(), F.col("_ord")).select("o_orderkey", "grade", big(F.col("d_day.sort_days")).alias("sort_days"), "place")


@contract(f"""SELECT c_custkey, row_number() OVER (ORDER BY {_RANK_SQL}, c_acctbal DESC, c_custkey)::BIGINT AS place FROM (SELECT c_custkey, c_acctbal, CASE c_mktsegment WHEN 'BUILDING' THEN 'S' WHEN 'MACHINERY' THEN 'A' WHEN 'HOUSEHOLD' THEN 'B' ELSE 'z' END AS grade FROM customer)""")
def view_amount(spark, sf):
    grade = F.when(F.col("c_mktsegment") == "BUILDING", F.lit("S")).when(F.col("c_mktsegment") == "MACHINERY", F.lit("A")).when(F.col("c_mktsegment") == "HOUSEHOLD", F.lit("B")).otherwise("z")
    rows = _t(spark, sf, "customer").withColumn("grade", grade)
    rows = rows.select("c_custkey", "grade", "c_acctbal")
    return views.with_place(rows, Key(scalars.grade_rank("grade")), Key(views.number_of("c_acctbal"), Column.desc), F.col("c_custkey")).select("c_custkey", "place")


@contract(f"""SELECT o_orderkey, row_number() OVER (ORDER BY {_SORT_SQL}, strftime(o_orderdate - INTERVAL 30 DAY, '%Y-%m-%d') DESC, o_orderkey)::BIGINT AS place FROM orders WHERE o_orderstatus = 'F'""")
def view_recent(spark, sf):
    rows = _orders(spark, sf).where("o_orderstatus = 'F'").withColumn("published", F.date_format(F.col("o_orderdate") - F.expr("interval 30 days"), "yyyy-MM-dd"))
    keys = [Key(dates.d_day("deadline", AS_OF)["sort_days"]), Key(sem.or_empty("published"), Column.desc), F.col("_ord")]
    return views.with_place(rows.select("o_orderkey", "_ord", "deadline", "published"), *keys).select("o_orderkey", "place")


_BOARD_SQL = """SELECT o_orderkey, c_mktsegment AS cat, (floor(o_totalprice)::BIGINT % 101)::DOUBLE AS score, o_totalprice AS amount, strftime(o_orderdate, '%Y-%m-%d') AS deadline,
CASE WHEN o_orderkey % 4 = 0 THEN 'HOLD' WHEN floor(o_totalprice)::BIGINT % 101 >= 85 THEN 'S' WHEN floor(o_totalprice)::BIGINT % 101 >= 70 THEN 'A' WHEN floor(o_totalprice)::BIGINT % 101 >= 50 THEN 'B' ELSE 'C' END AS grade
FROM orders JOIN customer ON o_custkey = c_custkey WHERE NOT coalesce(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus = 'P' END, false)"""


@contract(f"""SELECT o_orderkey, cat AS board_category, grade AS board_grade, score AS board_score, amount AS board_amount, deadline AS board_deadline,
row_number() OVER (PARTITION BY cat ORDER BY {_RANK_SQL}, score DESC, amount DESC, deadline, o_orderkey)::BIGINT AS place FROM ({_BOARD_SQL})""")
def view_priority(spark, sf):
    """The priority board of every category: aliases resolved, excluded rows out, four keys and the source's order."""
    o = _t(spark, sf, "orders").join(_t(spark, sf, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    rows = o.select(
        "o_orderkey", F.col("o_orderkey").alias("_ord"), F.lit("").alias("priorityCategory"), F.col("c_mktsegment").alias("category"), F.when(F.col("o_orderkey") % 4 == 0, F.lit("HOLD")).alias("grade"),
        F.lit(None).cast("string").alias("score"), (F.floor("o_totalprice") % 101).cast("string").alias("fitScore"), F.lit(None).cast("string").alias("priorityScore"), F.lit("").alias("amount"), F.col("o_totalprice").cast("string").alias("budget"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("endDate"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus") == "P").alias("isExcludedFromPriority"),
    )
    chains = {
        "board_category": sem.truthy("priorityCategory", "category"), "board_score": sem.first_number(*resolvers.SCORES), "board_grade": scalars.board_grade("grade", list(resolvers.SCORES)),
        "board_amount": sem.first_number("amount", "budget"), "board_deadline": sem.truthy("endDate", default="9999-99-99"),
    }
    rows = rows.where(~sem.eq_true("isExcludedFromPriority")).withColumns(chains)
    keys = [Key(scalars.grade_rank("board_grade")), F.col("board_score").desc(), F.col("board_amount").desc(), F.col("board_deadline"), F.col("_ord")]
    return views.with_place(rows.select("o_orderkey", "_ord", *chains), *keys, within=("board_category",)).drop("_ord")


@contract("""SELECT p_partkey, array_to_string(list_slice(l, 1, 2), ' · ') AS shown, len(l)::BIGINT AS n FROM (SELECT p_partkey, CASE WHEN split_part(p_name, ' ', 1) = p_type THEN [p_type] WHEN true THEN list_filter(CASE WHEN split_part(p_name, ' ', 1) = split_part(p_name, ' ', 2)
THEN [split_part(p_name, ' ', 1), p_type] ELSE [split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), p_type] END, lambda x: x <> '') END AS l FROM part)""")
def array_ops(spark, sf):
    words = scalars.split_keywords(F.concat(F.replace("p_name", F.lit(" "), F.lit(" / ")), F.lit(" // "), F.col("p_type"), F.lit("/"), F.split("p_name", " ")[0]))
    return _t(spark, sf, "part").select("p_partkey", F.array_distinct(words).alias("l")).select("p_partkey", scalars.joined_or(F.slice("l", 1, 2), " · ", "-").alias("shown"), big(F.size("l")).alias("n"))


@contract("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS first, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END::BIGINT AS n FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01'""")
def date_list(spark, sf):
    other = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy. M. d")).otherwise(F.date_format(F.col("o_orderdate") + F.expr("interval 1 day"), "yyyy년 M월 d일"))
    text = F.concat(other, F.lit(" 가"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("1800나 "))
    rows = _t(spark, sf, "orders").where("o_orderdate >= timestamp '2000-01-01'").select("o_orderkey", dates.date_list(text).alias("l"))
    return rows.select("o_orderkey", F.col("l")[0].alias("first"), big(F.size("l")).alias("n"))


@contract("""SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#039;') AS html FROM pages""")
def escape_html(spark, sf):
    return _t(spark, sf, "pages").select("page_id", scalars.escape_html("html").alias("html"))


@contract("SELECT doc_id, trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')) AS text FROM documents")
def compact_ws(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", sem.compact("text").alias("text"))


@contract("""SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN '협상계약' WHEN p_type = 'STANDARD' THEN '제한경쟁' WHEN p_type = 'PROMO' THEN '확인 필요' ELSE p_type END AS contract,
CASE WHEN p_brand LIKE '%1%' THEN '경기도' ELSE p_brand END AS source, CASE WHEN p_type IN ('S', 'A') THEN lower(p_type) ELSE 'b' END AS class, CASE WHEN contains(p_type, 'S') THEN 'S' WHEN contains(p_type, 'A') THEN 'A' WHEN contains(p_type, 'B') THEN 'B' WHEN contains(p_type, 'C') THEN 'C' ELSE '' END AS badge FROM part""")
def contract_case(spark, sf):
    t = F.col("p_type")
    text = F.when(t == "ECONOMY", F.lit("제한경쟁/협상에 의한 계약")).when(t == "STANDARD", F.lit(" 제한경쟁 / 일반경쟁")).when(t == "PROMO", F.lit("-")).otherwise(F.concat(t, F.lit(" / 기타")))
    brand = F.when(F.col("p_brand").contains("1"), F.lit("경기 북부")).otherwise(F.col("p_brand"))
    return _t(spark, sf, "part").select("p_partkey", scalars.compact_contract(text).alias("contract"), scalars.compact_source(brand).alias("source"), scalars.grade_class("p_type").alias("class"), scalars.grade_from_badge("p_type").alias("badge"))


@contract("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey::VARCHAR ELSE 'art::Order ' || o_orderkey || '::' || strftime(o_orderdate, '%Y-%m-%d') END AS id FROM orders""")
def research_id(spark, sf):
    key = F.col("o_orderkey").cast("string")
    title = F.concat(F.lit(" Order   "), key, F.lit("\n"))
    due = dates.normalize_date(F.date_format("o_orderdate", "yyyy/M/d HH:mm"))
    return _t(spark, sf, "orders").select("o_orderkey", scalars.research_id("art", [F.lit(""), F.when(F.col("o_orderkey") % 2 == 0, key)], title, due).alias("id"))


@contract("""SELECT page_id, 'mode=add&title=' || replace(url_encode('page ' || page_id || ' 공고 & 기타'), '%20', '+') || CASE WHEN page_id % 2 = 0 THEN '&url=' || url_encode(url) ELSE '' END AS query FROM pages""")
def url_build(spark, sf):
    title = F.concat(F.lit("page "), F.col("page_id").cast("string"), F.lit(" 공고 & 기타"))
    return _t(spark, sf, "pages").select("page_id", scalars.form_query([("mode", F.lit("add")), ("title", title), ("url", F.when(F.col("page_id") % 2 == 0, F.col("url")))]).alias("query"))


@contract("""SELECT page_id, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page, nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), '') AS ref,
CASE WHEN contains(url, '?page=2&ref=x') THEN replace(url, '?page=2&ref=x', '?ref=x') ELSE url END AS without, url AS safe FROM pages""")
def url_parse(spark, sf):
    p = _t(spark, sf, "pages")
    return p.select("page_id", scalars.query_param("url", "page").alias("page"), scalars.query_param("url", "ref").alias("ref"), scalars.without_params("url", ["page"]).alias("without"), scalars.safe_url(F.concat(F.lit(" "), "url")).alias("safe"))


@contract("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS dashed, strftime(o_orderdate, '%Y-%m-%d') AS packed, 'none' AS broken FROM orders""")
def dates_compact(spark, sf):
    d = F.date_format("o_orderdate", "yyyy-MM-dd")
    return _t(spark, sf, "orders").select(
        "o_orderkey", dates.parse_date(F.concat(F.lit(" "), d, F.lit(" 17:00:00 / 개찰"))).cast("string").alias("dashed"), dates.parse_date(F.concat(F.replace(d, F.lit("-"), F.lit("")), F.lit("1800"))).cast("string").alias("packed"),
        F.coalesce(dates.parse_date(F.lit("2026-02-30")).cast("string"), F.lit("none")).alias("broken"),
    )


@contract("""SELECT o_orderkey, year(o_orderdate) || '-' || month(o_orderdate) || '-' || day(o_orderdate) AS compact, strftime(o_orderdate, '%Y-%m-%d') AS normal FROM orders""")
def dates_norm(spark, sf):
    dotted = F.date_format("o_orderdate", "yyyy.M.d")
    return _t(spark, sf, "orders").select("o_orderkey", dates.compact_date(F.concat(F.lit("마감 "), dotted)).alias("compact"), dates.normalize_date(F.concat(dotted, F.lit(" 까지"))).alias("normal"))


@contract("""SELECT l_orderkey, CASE WHEN a = b THEN a ELSE a || ' ~ ' || b END AS span, CASE WHEN a = b THEN a ELSE a || ' ~ ' || b END AS period, b AS one_sided FROM (SELECT l_orderkey, strftime(min(l_shipdate), '%Y-%m-%d') AS a, strftime(max(l_shipdate), '%Y-%m-%d') AS b FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-01-01' GROUP BY l_orderkey)""")
def range_text(spark, sf):
    g = _t(spark, sf, "lineitem").where("l_shipdate >= timestamp '2000-01-01'").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("x"), F.max("l_shipdate").alias("y"))
    a, b = F.date_format("x", "yyyy.M.d"), F.date_format("y", "yyyy년 M월 d일")
    iso = [F.date_format(c, "yyyy-MM-dd") for c in ("x", "y")]
    return g.select("l_orderkey", dates.date_range(a, b).alias("span"), dates.period_text(*iso).alias("period"), dates.date_range(F.lit(""), b).alias("one_sided"))


def _notice(spark, sf) -> DataFrame:
    return notices(_t(spark, sf, "orders").where("o_orderdate >= timestamp '2000-01-01'"))


def notices(o: DataFrame) -> DataFrame:
    """Notices in Korean with a registration date, a period of 20 days and, for some, a deadline of their own."""
    d, e = F.col("o_orderdate"), F.col("o_orderdate") + F.expr("interval 20 days")
    part = lambda c: F.date_format(c, "M월 d일")
    period = F.concat(F.lit(" 접수기간 : "), part(d), F.element_at(F.array(*[F.lit(f" {g} ") for g in "~∼～–—-"]), (F.col("o_orderkey") % 6 + 1).cast("int")), part(e))
    due = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(" 제출마감 "), F.date_format(e + F.expr("interval 1 day"), "yyyy. M. d"))).otherwise("")
    return o.select("o_orderkey", F.concat(F.lit("작품 공모 등록일 "), F.date_format(d, "yyyy-MM-dd"), F.lit(" 본문"), period, F.lit(" 10:00 ~ 17:00"), due).alias("detailTextSample"))


_NOTICE_SQL = "(SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS a, strftime(o_orderdate + INTERVAL 20 DAY, '%Y-%m-%d') AS b, strftime(o_orderdate + INTERVAL 21 DAY, '%Y-%m-%d') AS c FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01')"


@contract(f"SELECT o_orderkey, a AS published, '등록일' AS keyword FROM {_NOTICE_SQL}")
def extract_published(spark, sf):
    p = extract.published_keyword(sem.compact("detailTextSample"), AS_OF)
    return _notice(spark, sf).select("o_orderkey", p.alias("p")).select("o_orderkey", F.col("p.value").alias("published"), "p.keyword")


@contract(f"SELECT o_orderkey, a AS \"start\", b AS \"end\" FROM {_NOTICE_SQL}")
def extract_range(spark, sf):
    rows = _notice(spark, sf).withColumn("text", sem.compact("detailTextSample")).withColumn("pub", F.regexp_extract("text", r"등록일 ([0-9-]+)", 1))
    return rows.select("o_orderkey", extract.period_keyword(F.col("text"), F.col("pub"), AS_OF).alias("p")).select("o_orderkey", "p.start", "p.end")


@contract(f"""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN c ELSE b END AS deadline, CASE WHEN o_orderkey % 3 = 0 THEN 'explicit_deadline' ELSE 'period_end' END AS source, 'HIGH' AS confidence, (CASE WHEN o_orderkey % 3 = 0 THEN c ELSE b END) < '2000-12-31' AS expired FROM {_NOTICE_SQL}""")
def extract_deadline(spark, sf):
    n = extract.normalize_notices(_notice(spark, sf), "2000-12-31")
    return n.select("o_orderkey", "deadline", F.col("deadlineSource").alias("source"), F.col("dateConfidence").alias("confidence"), F.col("isExpired").alias("expired"))


@contract("""SELECT o_orderkey, format('{:,}', v) || '원' AS won, CASE WHEN v >= 1000000000 THEN ((v + 50000000) // 100000000)::VARCHAR || '억' WHEN v >= 100000000 THEN (((v + 5000000) // 10000000) // 10) || '.' || (((v + 5000000) // 10000000) % 10) || '억'
WHEN v >= 10000 THEN format('{:,}', (v + 5000) // 10000) || '만원' ELSE format('{:,}', v) || '원' END AS short, format('{:,}', v) AS n FROM (SELECT o_orderkey, (floor(o_totalprice) * (10 ** (o_orderkey % 5)))::BIGINT + 1 AS v FROM orders)""")
def money(spark, sf):
    v = (F.floor("o_totalprice") * F.pow(F.lit(10), F.col("o_orderkey") % 5).cast("bigint") + 1).cast("string")
    return _t(spark, sf, "orders").select("o_orderkey", v.alias("v")).select("o_orderkey", scalars.format_money("v").alias("won"), scalars.format_krw("v").alias("short"), scalars.format_count("v").alias("n"))


@contract("""SELECT event_id, CASE WHEN s >= 85 THEN 'S' WHEN s >= 70 THEN 'A' WHEN s >= 50 THEN 'B' ELSE 'C' END AS board, CASE WHEN s >= 85 THEN 'S' WHEN s >= 70 THEN 'A' WHEN s >= 50 THEN 'B' ELSE '' END AS capture,
CASE WHEN s >= 70 THEN 'HIGH' ELSE 'NORMAL' END AS priority FROM (SELECT event_id, value / 5 AS s FROM events)""")
def score_grade(spark, sf):
    rows = _t(spark, sf, "events").select("event_id", F.lit("").alias("grade"), (F.col("value") / 5).cast("string").alias("s"))
    g = scalars.capture_grade("grade", ["s"])
    return rows.select("event_id", scalars.board_grade("grade", ["s"]).alias("board"), g.alias("capture"), scalars.priority_of(g, F.lit("priority")).alias("priority"))


@contract("SELECT event_id, greatest(0, least(100, floor(value - 50 + 0.5)))::BIGINT AS progress, CASE WHEN value >= 50 THEN '검토중' ELSE 'OTHER' END AS label FROM events")
def clamp(spark, sf):
    return _t(spark, sf, "events").select(
        "event_id", big(scalars.clamp_progress((F.col("value") - 50).cast("string"))).alias("progress"), scalars.status_label(F.when(F.col("value") >= 50, F.lit(" review ")).otherwise("other")).alias("label"),
    )


@contract("SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def state_lww(spark, sf):
    return state.last_write(_t(spark, sf, "events"), "user_id", "event_type", "event_id")


_STATE_SQL = "(SELECT user_id::VARCHAR AS research_id, event_id AS seq, event_type, value FROM events)"


def _state_events(spark, sf) -> DataFrame:
    e = _t(spark, sf, "events")
    kind = F.col("event_type")
    return e.select(
        F.col("user_id").cast("string").alias("research_id"), F.col("event_id").alias("seq"), F.when(kind == "error", F.lit("delete")).otherwise("upsert").alias("op"), F.col("event_id").cast("string").alias("at"), (kind == "purchase").alias("is_sync"),
        F.when(kind == "purchase", F.lit("WORKING")).when(kind == "signup", F.lit("")).alias("status"), F.when(kind == "purchase", F.lit("작성")).alias("statusLabel"), F.when(kind == "view", F.col("value").cast("string")).alias("progress"),
        F.when(kind == "click", F.lit("")).when(kind == "purchase", F.concat(F.lit("p"), F.col("event_id").cast("string"))).alias("projectId"), F.lit(None).cast("string").alias("sheetUpdatedAt"),
    )


@contract(f"""WITH e AS {_STATE_SQL}, d AS (SELECT research_id, max(seq) AS last FROM e WHERE event_type = 'error' GROUP BY research_id), l AS (SELECT e.* FROM e LEFT JOIN d USING (research_id) WHERE event_type <> 'error' AND (last IS NULL OR seq > last))
SELECT research_id, CASE WHEN max(CASE WHEN event_type = 'purchase' THEN seq END) IS NULL THEN 'REVIEW' ELSE 'WORKING' END AS status, CASE WHEN max(CASE WHEN event_type = 'purchase' THEN seq END) IS NULL THEN '검토중' ELSE '작성' END AS "statusLabel",
CASE WHEN count_if(event_type = 'view') = 0 THEN -1 ELSE greatest(0, least(100, floor(arg_max(value, seq) FILTER (event_type = 'view') + 0.5))) END::BIGINT AS progress,
coalesce(arg_max(CASE WHEN event_type = 'click' THEN '' ELSE 'p' || seq END, seq) FILTER (event_type IN ('click', 'purchase')), '') AS "projectId", coalesce((max(seq) FILTER (event_type = 'purchase'))::VARCHAR, '') AS "syncedAt", max(seq)::VARCHAR AS "updatedAt" FROM l GROUP BY research_id""")
def state_merge(spark, sf):
    return state.merged(_state_events(spark, sf)).select("research_id", "status", "statusLabel", big(F.coalesce("progress", F.lit(-1))).alias("progress"), "projectId", "syncedAt", "updatedAt")


@contract(f"""WITH e AS {_STATE_SQL}, d AS (SELECT research_id, max(seq) AS last FROM e WHERE event_type = 'error' GROUP BY research_id) SELECT e.research_id, count(*)::BIGINT AS n FROM e LEFT JOIN d USING (research_id) WHERE event_type <> 'error' AND (last IS NULL OR seq > last) GROUP BY e.research_id""")
def state_delete(spark, sf):
    return state.live(_state_events(spark, sf)).groupBy("research_id").agg(F.count(F.lit(1)).alias("n"))


@contract("""SELECT event_id, event_type, CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END::BIGINT AS tier FROM events WHERE NOT contains(event_type, 'error')""")
def preferred_order(spark, sf):
    rows = views.keep(_t(spark, sf, "events"), ~F.col("event_type").contains("error")).withColumn("_ord", F.col("event_id"))
    out = lookup.by_preference(rows, "event_type", ["purchase", "click"])
    tier = F.when(F.col("event_type") == "purchase", F.lit(0)).when(F.col("event_type") == "click", F.lit(1)).otherwise(2)
    return out.select("event_id", "event_type", big(tier).alias("tier"))


@contract("""SELECT event_id, '[검토 카드]' || chr(10) || '제목: ' || event_type || chr(10) || '점수/정보: ' || user_id || chr(10) || 'a: b' || CASE WHEN event_id % 2 = 0 THEN chr(10) || '담당자 메모: m' ELSE '' END AS block FROM events""")
def copy_block(spark, sf):
    e = F.lit("")
    memo = F.when(F.col("event_id") % 2 == 0, F.lit("m")).otherwise("")
    block = scalars.copy_block("[검토 카드]", F.col("event_type"), F.array(e), F.col("user_id").cast("string"), e, F.array(F.lit("a: b"), e), F.array(e), memo, e)
    return _t(spark, sf, "events").select("event_id", block.alias("block"))


# ---- the same on whole tables: the queries above keep their filters and SQL ----


@contract(f"""SELECT o_orderkey, grade, sort_days::BIGINT AS sort_days, row_number() OVER (ORDER BY {_RANK_SQL}, sort_days, score DESC, o_orderkey)::BIGINT AS place
FROM (SELECT o_orderkey, {_GRADE_SQL} AS grade, {_SORT_SQL} AS sort_days, floor(o_totalprice)::BIGINT % 101 AS score FROM orders)""")
def view_ranked_all(spark, sf):
    rows = _orders(spark, sf).withColumn("d_day", dates.d_day("deadline", AS_OF))
    rows = rows.select("o_orderkey", "_ord", "grade", "score", "d_day")
    return views.with_place(rows, *views.by_grade_deadline(), F.col("_ord")).select("o_orderkey", "grade", big(F.col("d_day.sort_days")).alias("sort_days"), "place")


@contract(f"""SELECT o_orderkey, row_number() OVER (ORDER BY {_SORT_SQL}, strftime(o_orderdate - INTERVAL 30 DAY, '%Y-%m-%d') DESC, o_orderkey)::BIGINT AS place FROM orders""")
def view_recent_all(spark, sf):
    rows = _orders(spark, sf).withColumn("published", F.date_format(F.col("o_orderdate") - F.expr("interval 30 days"), "yyyy-MM-dd"))
    keys = [Key(dates.d_day("deadline", AS_OF)["sort_days"]), Key(sem.or_empty("published"), Column.desc), F.col("_ord")]
    return views.with_place(rows.select("o_orderkey", "_ord", "deadline", "published"), *keys).select("o_orderkey", "place")


@contract("""SELECT o_orderkey, CASE WHEN year(o_orderdate) >= 2000 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 2 = 1 AND year(o_orderdate + INTERVAL 1 DAY) = 2000 THEN '2000-01-01' END AS first,
CASE WHEN year(o_orderdate) >= 2000 THEN CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END WHEN o_orderkey % 2 = 1 AND year(o_orderdate + INTERVAL 1 DAY) = 2000 THEN 1 ELSE 0 END::BIGINT AS n FROM orders""")
def date_list_all(spark, sf):
    other = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy. M. d")).otherwise(F.date_format(F.col("o_orderdate") + F.expr("interval 1 day"), "yyyy년 M월 d일"))
    text = F.concat(other, F.lit(" 가"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("1800나 "))
    rows = _t(spark, sf, "orders").select("o_orderkey", dates.date_list(text).alias("l"))
    return rows.select("o_orderkey", F.get("l", F.lit(0)).alias("first"), big(F.size("l")).alias("n"))


@contract("""SELECT l_orderkey, CASE WHEN b < '2000' THEN '-' WHEN a < '2000' OR a = b THEN b ELSE a || ' ~ ' || b END AS span, CASE WHEN a = b THEN a ELSE a || ' ~ ' || b END AS period, CASE WHEN b < '2000' THEN '-' ELSE b END AS one_sided
FROM (SELECT l_orderkey, strftime(min(l_shipdate), '%Y-%m-%d') AS a, strftime(max(l_shipdate), '%Y-%m-%d') AS b FROM lineitem GROUP BY l_orderkey)""")
def range_text_all(spark, sf):
    g = _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("x"), F.max("l_shipdate").alias("y"))
    a, b = F.date_format("x", "yyyy.M.d"), F.date_format("y", "yyyy년 M월 d일")
    iso = [F.date_format(c, "yyyy-MM-dd") for c in ("x", "y")]
    return g.select("l_orderkey", dates.date_range(a, b).alias("span"), dates.period_text(*iso).alias("period"), dates.date_range(F.lit(""), b).alias("one_sided"))


# ---- records whose fields mix numbers, text and flags, read from JSON as they are ----

_MIXED = {
    "score": ["{n}", '"{n}"', "{n}.5", "0", '"0"', "true", "false", '""', "null", '"x"'],
    "amount": ["0", '"0"', "12.5", '"1,000"', "null", "0.0", '" 7 "'],
}


def _mixed(field: str, key: Column, number: Column) -> Column:
    forms = _MIXED[field]
    made = F.array(*[F.concat(*[number.cast("string") if part == "{n}" else F.lit(part) for part in re.split(r"({n})", form) if part]) for form in forms])
    return F.element_at(made, (key % len(forms) + 1).cast("int"))


@contract("""SELECT o_orderkey, score AS board_score, CASE WHEN score >= 85 THEN 'S' WHEN score >= 70 THEN 'A' WHEN score >= 50 THEN 'B' ELSE 'C' END AS board_grade,
CASE o_orderkey % 7 WHEN 1 THEN 0 WHEN 2 THEN 12.5 WHEN 3 THEN 0 WHEN 6 THEN 7 ELSE o_totalprice END::DOUBLE AS board_amount
FROM (SELECT *, CASE o_orderkey % 10 WHEN 0 THEN CASE WHEN n = 0 THEN 66.5 ELSE n END WHEN 1 THEN n WHEN 2 THEN n + 0.5 WHEN 4 THEN 0 WHEN 5 THEN 1 WHEN 9 THEN 0 ELSE 66.5 END::DOUBLE AS score
 FROM (SELECT *, floor(o_totalprice)::BIGINT % 101 AS n FROM orders))""")
def mixed_values(spark, sf):
    """Scores and amounts as numbers, digits, decimals, zeros, flags and text in one field; the second score stands under the documents' own name."""
    o, n = _t(spark, sf, "orders"), F.floor("o_totalprice") % 101
    record = F.concat(
        F.lit('[{"id":"'), F.col("o_orderkey").cast("string"), F.lit('","score":'), _mixed("score", F.col("o_orderkey"), n), F.lit(',"theirScore":"66.5","amount":'), _mixed("amount", F.col("o_orderkey"), n),
        F.lit(',"budget":'), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("}]"),
    )
    rows = views.priority_rows(readers.parse_records(o.select(record.alias("value")), schemas.PRIORITY, names={"theirScore": "fitScore"}))
    return rows.select(F.col("id").cast("bigint").alias("o_orderkey"), "board_score", "board_grade", "board_amount")


@contract("""SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN '5' WHEN 1 THEN '3' WHEN 3 THEN '0' WHEN 5 THEN 'true' WHEN 7 THEN '2.5' END AS awards
FROM customer WHERE c_custkey % 8 IN (0, 1, 5, 7)""")
def mixed_counts(spark, sf):
    """Award counts of mixed types under the award facet, and as they show."""
    forms = F.array(*[F.lit(x) for x in ('"5"', "3", "0", '"0"', "null", "true", "false", "2.50")])
    record = F.concat(F.lit('[{"agencyName":"'), F.col("c_custkey").cast("string"), F.lit('","awardCount":'), F.element_at(forms, (F.col("c_custkey") % 8 + 1).cast("int")), F.lit("}]"))
    rows = views.agencies(readers.parse_records(_t(spark, sf, "customer").select(record.alias("value")), schemas.AGENCIES), _no_reviews(spark), views.Facets(award_only=True))
    return rows.select(F.col("name").cast("bigint").alias("c_custkey"), F.col("awardCount").alias("awards"))


def _no_reviews(spark):
    return spark.createDataFrame([], "review_key string, status string")
