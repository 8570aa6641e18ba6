"""Faceted, ranked views: predicates that exist only where a facet is set, deterministic orders, displayed columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.functions.dates import compact_date, d_day, matches_deadline, period_text
from triagelake.functions.scalars import (
    agency_key, art_key, compact_contract, compact_source, confidence_label, format_krw, format_money, grade_rank, joined_or, local_key, opportunity_key, safe_text, safe_url,
)
from triagelake.functions.semantics import array_or_empty, contains_ci, eq_true, join_fields, js_number, not_false, or_empty, truthy
from triagelake.operators import resolvers
from triagelake.operators.lookup import with_review
from triagelake.operators.ranking import Key, keyed, numbered, placed

# The regions that are not "other", and the wildcard of every facet.
MAJOR_REGIONS = ("서울", "경기", "인천", "부산", "대전", "광주", "대구", "울산", "세종")
ALL, OTHER, NATIONWIDE = "all", "기타", "전국"
PLACEHOLDER_TITLES = ("데이터가 없습니다", "조건에 맞는", "불러오는 중")


@dataclass(frozen=True)
class Facets:
    """What a view is asked for; the defaults let everything pass."""

    search: str = ""
    grade: str = ALL
    category: str = ALL
    kind: str = ALL
    region: str = ALL
    source: str = ALL
    review: str = ALL
    deadline: str = ALL
    award_only: bool = False
    plan_only: bool = False


# ---- predicates ------------------------------------------------------------


def search(needle: str, *fields: Column | str, trim: bool = True) -> Column | None:
    """Whether the lower-cased fields, joined by blanks, contain the needle; no predicate for an empty one."""
    needle = needle.strip() if trim else needle
    return contains_ci(join_fields(*fields), needle) if needle else None


def equals(value: Column, wanted: str) -> Column | None:
    return None if wanted == ALL else value.eqNullSafe(F.lit(wanted))


def holds(value: Column, wanted: str) -> Column | None:
    return None if wanted == ALL else safe_text(value).contains(wanted)


def in_region(value: Column, wanted: str) -> Column | None:
    if wanted == ALL:
        return None
    text = safe_text(value)
    if wanted != OTHER:
        return text.contains(wanted)
    major = F.lit(False)
    for r in MAJOR_REGIONS:
        major = major | text.contains(r)
    return text.contains(OTHER) | text.contains(NATIONWIDE) | ~major


def positive(value: str | Column, active: bool) -> Column | None:
    return js_number(value) > 0 if active else None


def tagged(tag: str) -> Column:
    """The target facet: ``all``, ``priority:N``, ``regionGroup:X``; an unknown one lets all enabled targets pass."""
    on = not_false("enabled")
    name, _, value = tag.partition(":")
    if name == "priority":
        return on & (F.col("priority").cast("string") == value)
    if name == "regionGroup":
        return on & (resolvers.region_group() == value)
    return on


def real_title(title: Column) -> Column:
    out = F.lit(True)
    for text in PLACEHOLDER_TITLES:
        out = out & ~or_empty(title).contains(text)
    return out


def keep(df: DataFrame, *predicates: Column | None) -> DataFrame:
    for p in predicates:
        df = df if p is None else df.where(p)
    return df


# ---- orders ----------------------------------------------------------------


def number_of(c: str) -> Column:
    return F.coalesce(js_number(c), F.lit(0.0))


def ranked(df: DataFrame, *keys: Key | Column) -> DataFrame:
    """Ordered rows; equal ones in the order of their source."""
    rows, order, made = keyed(df, *keys)
    return rows.orderBy(*order, F.col("_ord").asc()).drop(*made)


def with_place(df: DataFrame, *keys: Key | Column, within: tuple[str, ...] = ()) -> DataFrame:
    """The place of each row, from 1, in an order (inside its group of equal ``within`` columns, if given); runs when called.

    End the keys with something unique, such as ``_ord``, and give expressions as a Key. No step needs all rows of a view in one task.
    """
    rows = placed(df, list(within), *keys).drop("start", "size") if within else numbered(df, *keys).rows
    return rows.withColumn("place", F.col("place") + 1)


def by_grade_deadline() -> list[Key]:
    return [Key(grade_rank("grade")), Key(F.col("d_day.sort_days")), Key(number_of("score"), Column.desc)]


# ---- views -----------------------------------------------------------------


def opportunities(df: DataFrame, reviews: DataFrame, as_of, facets: Facets = Facets()) -> DataFrame:
    fields = ["bidNtceNm", "title", "ntceInsttNm", "dminsttNm", "category", "categoryLabel", F.array_join(array_or_empty("matchedKeywords"), " ")]
    rows = keep(df, search(facets.search, *fields, trim=False), equals(F.col("grade"), facets.grade), equals(F.col("category"), facets.category))
    rows = rows.withColumns(resolvers.opportunity()).withColumn("d_day", d_day("deadline_text", as_of))
    rows = keep(with_review(rows, reviews, opportunity_key()), equals(F.col("review_status"), facets.review))
    return ranked(rows, *by_grade_deadline()).select(
        safe_text("grade").alias("grade"), "category_label", F.col("d_day.label").alias("d_day"), F.col("d_day.class").alias("d_day_class"), safe_text("score").alias("score"),
        safe_text("shown_title").alias("title"), safe_text("notice_agency").alias("notice_agency"), safe_text("demand_agency").alias("demand_agency"), safe_text("contract").alias("contract"),
        format_money("money").alias("budget"), safe_text("deadline_text").alias("deadline"), safe_text("notice_no").alias("notice_no"), array_or_empty("matchedKeywords").alias("keywords"),
        joined_or(array_or_empty("scoreReasons"), " · ", "점수 산정 사유 없음").alias("reasons"), safe_text("recommendedAction").alias("action"), "review_key", "review_status", "document_url",
    )


def agencies(df: DataFrame, reviews: DataFrame, facets: Facets = Facets()) -> DataFrame:
    fields = ["agencyName", "agencyType", "region", "note", "recommendedProposal", "nextAction", F.array_join(array_or_empty("mainKeywords"), " ")]
    rows = keep(
        df, search(facets.search, *fields), in_region(F.col("region"), facets.region), equals(F.col("grade"), facets.grade),
        positive("awardCount", facets.award_only), positive("orderPlanCount", facets.plan_only),
    )
    rows = keep(with_review(rows, reviews, agency_key()), equals(F.col("review_status"), facets.review))
    count = lambda c: truthy(c, default="0").alias(c)
    return ranked(rows, Key(grade_rank("grade")), Key(number_of("estimatedAmount"), Column.desc)).select(
        truthy("grade", default="C").alias("grade"), truthy("agencyType", default="기관").alias("type"), truthy("region", default="기타").alias("region"), truthy("agencyName", default="기관명 없음").alias("name"),
        *[count(c) for c in ("relatedCount", "bidCount", "contractCount", "awardCount", "orderPlanCount")], format_money("estimatedAmount").alias("estimated"), array_or_empty("mainKeywords").alias("keywords"),
        truthy("note", default="기관 타깃 근거를 확인해 주세요.").alias("note"), truthy("recommendedProposal", default="-").alias("proposal"), truthy("nextAction", default="-").alias("next_action"),
        F.slice(F.coalesce("evidenceSources", F.array().cast(df.schema["evidenceSources"].dataType)), 1, 4).alias("evidence"), "review_key", "review_status",
    )


def art(df: DataFrame, reviews: DataFrame, as_of, facets: Facets = Facets(), periods: bool = False) -> DataFrame:
    """``periods`` gives the later form of the rows: period and confidence texts, and the period's end as a deadline."""
    rows = keep(df, search(facets.search, "title", "agency", "region", "source", "category", "status", F.array_join(array_or_empty("keywords"), " ")))
    rows = keep(rows.withColumns(resolvers.art()), holds(F.col("source_value"), facets.source))
    due = truthy("deadline", "periodEnd") if periods else F.col("deadline")
    rows = keep(with_review(rows, reviews, art_key()), equals(F.col("review_status"), facets.review)).withColumn("d_day", d_day(due, as_of))
    more = [period_text("periodStart", "periodEnd").alias("period"), confidence_label("dateConfidence").alias("confidence")] if periods else []
    return ranked(rows, Key(F.col("d_day.sort_days")), Key(or_empty("publishedDate"), Column.desc)).select(
        "source_label", truthy("category", default="건축물 미술작품").alias("category"), truthy("status", default="공모").alias("status"), F.col("d_day.label").alias("d_day"), F.col("d_day.class").alias("d_day_class"),
        safe_text("region").alias("region"), safe_text("title").alias("title"), safe_text("agency").alias("agency"), safe_text("publishedDate").alias("published"), safe_text(due).alias("deadline"),
        array_or_empty("keywords").alias("keywords"), safe_url("sourceUrl").alias("url"), "review_key", "review_status", *more,
    )


def local_projects(df: DataFrame, reviews: DataFrame, as_of, facets: Facets = Facets()) -> DataFrame:
    rows = df.withColumns(resolvers.local())
    lists = [F.array_join(array_or_empty(c), " ") for c in ("directFitKeywords", "supportFitKeywords", "keywords")]
    fields = ["title", "sourceName", "agencyName", "noticeAgency", "demandAgency", "department", "contractMethod", "noticeNo", "opportunityStatus", "projectScale", "kind", "region", *lists]
    rows = keep(rows, search(facets.search, *fields), holds(F.col("region"), facets.region), equals(F.col("kind"), facets.kind), equals(F.col("grade"), facets.grade))
    rows = rows.withColumn("d_day", d_day("deadline_text", as_of))
    rows = keep(rows, None if facets.deadline == ALL else matches_deadline(F.col("d_day"), facets.deadline))
    rows = keep(with_review(rows, reviews, local_key()), equals(F.col("review_status"), facets.review))
    return ranked(rows, *by_grade_deadline()).select(
        safe_text("grade").alias("grade"), "kind", F.col("opportunityStatus").alias("status"), F.col("projectScale").alias("scale"), F.col("d_day.label").alias("d_day"), F.col("d_day.class").alias("d_day_class"),
        safe_text("score").alias("score"), safe_text("title").alias("title"), "notice_agency", "demand_agency", compact_contract("contract").alias("contract_short"), "contract", format_money("budget").alias("budget"),
        safe_text("deadline_opening").alias("deadline"), safe_text("notice_no").alias("notice_no"), F.col("unique_keywords").alias("keywords"), "reason", safe_text("nextAction").alias("action"), "url", "review_key", "review_status",
    )


def priority_rows(df: DataFrame) -> DataFrame:
    return df.withColumns(resolvers.priority())


def priority_board(df: DataFrame, category: str) -> DataFrame:
    """One category's projects that are not excluded, best first."""
    rows = priority_rows(df).where((F.col("board_category") == category) & ~eq_true("isExcludedFromPriority"))
    return ranked(rows, Key(grade_rank("board_grade")), F.col("board_score").desc(), F.col("board_amount").desc(), F.col("board_deadline").asc()).select(
        "source_type", F.col("board_grade").alias("grade"), "grade_reason", "category_label", F.col("shown_title").alias("title"), F.col("shown_agency").alias("agency"), format_krw("board_amount").alias("amount"),
        compact_date("published").alias("published"), compact_date(F.when(F.col("board_deadline") != "9999-99-99", F.col("board_deadline"))).alias("deadline"), "action", F.col("shown_keywords").alias("keywords"), "url",
    )


def excluded(df: DataFrame) -> DataFrame:
    return df.where(eq_true("isExcludedFromPriority"))


def source_targets(df: DataFrame, tag: str = ALL) -> DataFrame:
    label = truthy("priorityLabel", default=F.concat(truthy("priority", default="-"), F.lit("차")))
    return df.where(tagged(tag)).orderBy("_ord").select(
        label.alias("priority_label"), resolvers.region_group().alias("region_group"), truthy("region", default="-").alias("region"), truthy("sourceName", default="출처명 없음").alias("source"), safe_url("sourceUrl").alias("url"),
        truthy("crawlStrategyLabel", "crawlMode", default="확인 필요").alias("mode"), truthy("recommendedAction", default="수집 가능 여부 확인").alias("action"),
    )


def summary_line(df: DataFrame, tab: str) -> DataFrame:
    """Source, grade, period and deadline of a row's one-line summary, by view."""
    from triagelake.functions.dates import date_only

    o = resolvers.overlay()
    grade = safe_text("grade")
    if tab == "opportunities":
        cols = (F.lit("나라장터"), grade, o["publish_period"], o["deadline_date"])
    elif tab == "agencies":
        cols = (safe_text("agencyType"), grade, safe_text("region"), F.concat(F.lit("관련 "), or_empty("relatedCount"), F.lit("건")))
    elif tab == "art":
        cols = (compact_source(resolvers.art()["source_label"]), F.lit(""), date_only("publishedDate"), date_only("deadline"))
    else:
        l = resolvers.local()  # noqa: E741
        due = date_only(l["deadline_opening"])
        cols = (truthy(l["notice_agency"], default="로컬공고"), grade, compact_contract(l["contract"]), due)
    return df.select("_ord", *[c.alias(n) for c, n in zip(cols, ("source", "grade", "period", "deadline"), strict=True)])

