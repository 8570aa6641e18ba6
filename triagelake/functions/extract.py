"""Dates in free Korean notices: publication, application period, deadline, confidence.

All built from regular expressions and higher-order functions, row by row, so
the whole pass is one projection that scales with the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.functions.dates import FULL, day, deadline_state, existing_date, to_iso, year_of
from triagelake.functions.semantics import compact, drop_empty, js_trim, let, or_empty, truthy

# Keywords in order of precedence, and the characters read behind one.
PERIOD_KEYWORDS = ("응모작품 접수일시", "작품 접수일시", "접수일시", "접수기간", "공모기간", "응모기간", "신청기간", "제출기간", "작품 접수", "접수일")
DEADLINE_KEYWORDS = ("접수마감", "제출마감", "신청마감", "응모마감", "마감일", "마감기한", "제출기한", "접수기한")
PUBLISHED_KEYWORDS = ("등록일", "등록일자", "작성일", "게시일", "공고일")
PUBLISHED_WINDOW, PERIOD_WINDOW, DEADLINE_WINDOW, TIME_WINDOW = 120, 220, 160, 100
VERSION = "1.1.0"
DASH = "[~∼～–—-]"
DATED = FULL + r"\s*일?"
PARTIAL = r"(\d{1,2})\s*월\s*(\d{1,2})\s*일?"
NOTE = r"\s*(?:\([^)]*\))?\s*"
FULL_RANGE = DATED + NOTE + DASH + r"\s*(?:(20\d{2})\s*(?:년|[.\-/])\s*)?(\d{1,2})\s*(?:월|[.\-/])\s*(\d{1,2})\s*일?"
PARTIAL_RANGE = PARTIAL + NOTE + DASH + r"\s*(?:(20\d{2})\s*년\s*)?(\d{1,2})\s*월\s*(\d{1,2})\s*일?"
TIMES = r"\d{1,2}\s*:\s*\d{2}\s*" + DASH + r"\s*\d{1,2}\s*:\s*\d{2}"


def clean(c: str | Column) -> Column:
    return compact(c)


def _groups(text: Column, pattern: str, *numbers: int) -> list[Column]:
    return [F.nullif(F.regexp_extract(text, pattern, k), F.lit("")) for k in numbers]


def _spans(text: Column, pattern: str) -> Column:
    """Each match in order: ``b`` (from 1), ``e`` (behind it) and the matched text ``m``."""
    kind = "array<struct<b:int,e:int,m:string>>"
    start = F.struct(F.lit(1).alias("at"), F.array().cast(kind).alias("out"))

    def step(s: Column, m: Column) -> Column:
        b = F.call_function("locate", m, text, s["at"]).cast("int")
        span = F.struct(b.alias("b"), (b + F.length(m)).alias("e"), m.alias("m"))
        return F.struct((b + F.length(m)).alias("at"), F.concat(s["out"], F.array(span)).alias("out"))

    return F.aggregate(F.regexp_extract_all(text, F.lit(pattern), 0), start, step, lambda s: s["out"])


def _dated(text: Column, pattern: str, value) -> Column:
    """The matches of a pattern whose ``value`` (of the matched text) is a real date."""
    spans = F.transform(_spans(text, pattern), lambda s: F.struct(s["b"].alias("b"), s["e"].alias("e"), value(s["m"]).alias("value")))
    return F.filter(spans, lambda s: s["value"].isNotNull())


def first_date(text: Column, base_year: Column) -> Column:
    """``b``, ``e`` (the place behind) and ``value`` of the earliest real date: with a year, or month and day
    of the base year where these are not part of a date with a year. Null where there is none."""
    full = _dated(text, DATED, lambda m: to_iso(*_groups(m, DATED, 1, 2, 3)))
    part = _dated(text, PARTIAL, lambda m: to_iso(base_year, *_groups(m, PARTIAL, 1, 2)))

    def earliest(full: Column) -> Column:
        outside = F.filter(part, lambda p: ~F.exists(full, lambda f: (p["b"] >= f["b"]) & (p["b"] < f["e"])))
        return F.array_min(F.concat(full, outside))

    return let(full, earliest)


def date_span(text: Column, base_year: Column) -> Column:
    """``start`` and ``end`` of the first "date ~ date" of a text; an end before its start, without a year, is next year's."""
    def one(pattern: str, year: Column | None, numbers: tuple[int, ...]) -> Column:
        def read(g: Column) -> Column:
            k = 1 if year is None else 0
            sy = g[0].cast("int") if year is None else year
            em, ed = g[k + 3], g[k + 4]
            dates = F.struct(to_iso(sy, g[k], g[k + 1]).alias("start"), to_iso(F.coalesce(g[k + 2].cast("int"), sy), em, ed).alias("end"))

            def close(d: Column) -> Column:
                end = F.when(g[k + 2].isNull() & (d["end"] < d["start"]), to_iso(sy + 1, em, ed)).otherwise(d["end"])
                return let(end, lambda e: F.when(d["start"].isNotNull() & e.isNotNull(), F.struct(d["start"].alias("start"), e.alias("end"))))

            return let(dates, close)

        # the groups are taken from the matched text alone
        return let(F.regexp_extract(text, pattern, 0), lambda m: F.when(m != "", let(F.array(*_groups(m, pattern, *numbers)), read)))

    return F.coalesce(one(FULL_RANGE, None, (1, 2, 3, 4, 5, 6)), one(PARTIAL_RANGE, base_year, (1, 2, 3, 4, 5)))


def _by_keyword(text: Column, keywords: tuple[str, ...], window: int, kind: str, found) -> Column:
    """What ``found(window of text, keyword)`` gives for the first keyword, in order, for which it is not null."""
    def step(s: Column, k: Column) -> Column:
        part = lambda at: F.when(at > 0, let(F.call_function("substring", text, at, F.lit(window)), lambda p: found(p, k)))
        return F.when(s.isNotNull(), s).otherwise(let(F.call_function("instr", text, k), part))

    return F.aggregate(F.array(*[F.lit(k) for k in keywords]), F.lit(None).cast(kind), step)


VALUE = "struct<value:string,keyword:string>"


def published_keyword(text: Column, as_of) -> Column:
    def found(part: Column, k: Column) -> Column:
        return let(first_date(part, F.year(day(as_of))), lambda d: F.when(d.isNotNull(), F.struct(d["value"].alias("value"), k.alias("keyword"))))

    return _by_keyword(text, PUBLISHED_KEYWORDS, PUBLISHED_WINDOW, VALUE, found)


def period_keyword(text: Column, published: Column, as_of) -> Column:
    """A range behind a keyword, else a single day that is followed by a range of times."""
    year = year_of(published, as_of)

    def found(part: Column, k: Column) -> Column:
        period = lambda a, b: F.struct(a.alias("start"), b.alias("end"), k.alias("keyword"))
        timed = lambda d: F.call_function("substring", part, d["e"], F.lit(TIME_WINDOW)).rlike(TIMES)
        single = let(first_date(part, year), lambda d: F.when(d.isNotNull() & timed(d), period(d["value"], d["value"])))
        return let(date_span(part, year), lambda r: F.when(r.isNotNull(), period(r["start"], r["end"])).otherwise(single))

    return _by_keyword(text, PERIOD_KEYWORDS, PERIOD_WINDOW, "struct<start:string,end:string,keyword:string>", found)


def deadline_keyword(text: Column, published: Column, as_of) -> Column:
    year = year_of(published, as_of)

    def found(part: Column, k: Column) -> Column:
        return let(first_date(part, year), lambda d: F.when(d.isNotNull(), F.struct(d["value"].alias("value"), k.alias("keyword"))))

    return _by_keyword(text, DEADLINE_KEYWORDS, DEADLINE_WINDOW, VALUE, found)


def confidence(published: Column, deadline: Column, source: Column) -> Column:
    return (
        F.when((published != "") & (deadline != "") & source.isin("explicit_deadline", "period_end"), F.lit("HIGH"))
        .when(deadline != "", F.lit("MEDIUM")).otherwise("LOW")
    )


def normalize_notices(df: DataFrame, as_of) -> DataFrame:
    """Overrides the date fields of notice records; every other column stays as it is.

    Missing input columns count as null. Detail text, where there is any, is
    read alone; only without it are the other text fields joined and read.
    """
    names = ["detailTextSample", "rawText", "summary", "nextAction", "title", "postedDate", "publishedDate", "noticeDate", "createdDate", "deadline", "endDate",
             "closeDate", "periodStart", "periodEnd", "deadlineSource", "periodSource", "status"]
    base = df.withColumns({c: F.lit(None).cast("string") for c in names if c not in df.columns})
    detail = clean("detailTextSample")
    other = clean(F.array_join(drop_empty(F.array(*[js_trim(c) for c in ("rawText", "summary", "nextAction", "title")])), " | "))
    step = base.withColumn("_text", F.when(detail != "", detail).otherwise(other))
    step = step.withColumn("_pub", published_keyword(F.col("_text"), as_of))
    earlier = truthy(*[existing_date(c) for c in ("postedDate", "publishedDate", "noticeDate", "createdDate")])
    step = step.withColumn("_published", F.coalesce("_pub.value", earlier))
    step = step.withColumn("_period", period_keyword(F.col("_text"), F.col("_published"), as_of)).withColumn("_due", deadline_keyword(F.col("_text"), F.col("_published"), as_of))
    step = step.withColumn("_start", truthy("_period.start", existing_date("periodStart"))).withColumn("_end", truthy("_period.end", existing_date("periodEnd")))
    stored = existing_date(truthy("deadline", "endDate", "closeDate"))
    step = step.withColumn("_stored", stored).withColumn("_deadline", truthy("_due.value", "_period.end", "_stored", "_end"))
    kept = F.when(or_empty("deadlineSource").isin("", "not_found"), F.lit("existing_deadline")).otherwise(F.col("deadlineSource"))
    source = (
        F.when(F.col("_due").isNotNull(), F.lit("explicit_deadline")).when(F.col("_period").isNotNull(), F.lit("period_end"))
        .when(F.col("_stored") != "", kept).when(F.col("_end") != "", F.lit("existing_period_end")).otherwise("not_found")
    )
    step = step.withColumn("_source", source).withColumn("_state", deadline_state(F.col("_deadline"), as_of))
    state = F.col("_state")
    status = F.when(
        (F.col("_deadline") != "") & or_empty("status").contains("마감일 확인 필요"), F.when(state["is_expired"], F.lit("마감")).otherwise("공모중")
    ).otherwise(or_empty("status"))
    out = {
        "publishedDate": F.col("_published"), "postedDate": truthy("_published", "postedDate"), "deadline": F.col("_deadline"), "endDate": F.col("_deadline"),
        "deadlineSource": F.col("_source"), "periodStart": F.col("_start"), "periodEnd": F.col("_end"),
        "publishedDateSource": F.when(F.col("_pub").isNotNull(), F.lit("detail_metadata")).when(F.col("_published") != "", F.lit("existing")).otherwise("not_found"),
        "periodSource": F.when(F.col("_period").isNotNull(), F.lit("detail_body")).otherwise(truthy("periodSource", default="not_found")),
        "periodKeyword": or_empty("_period.keyword"), "deadlineKeyword": or_empty("_due.keyword"),
        "dateConfidence": confidence(F.col("_published"), F.col("_deadline"), F.col("_source")),
        "isExpired": state["is_expired"], "deadlineStatus": state["status"], "status": status,
        "dateNormalizationVersion": F.lit(VERSION), "dateNormalizedAt": day(as_of).cast("string"),
    }
    keep = [F.col(c) for c in df.columns if c not in out]
    return step.select(*keep, *[v.alias(k) for k, v in out.items()])
