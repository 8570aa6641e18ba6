"""Date texts: parsing, days left, compact forms and ranges. "Today" is always a parameter."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from triagelake.functions.semantics import js_trim, let, or_empty, truthy

CLOSED, UNKNOWN = 9998, 9999


def korea_today() -> datetime.date:
    return (datetime.datetime.now(datetime.UTC) + datetime.timedelta(hours=9)).date()


def day(as_of: datetime.date | str | Column) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(str(as_of)).cast("date")


def parse_date(c: str | Column) -> Column:
    """A date from ``YYYY-MM-DD`` (what stands before a slash, with or without a time) or eight leading digits; else null."""
    text = js_trim(c)
    head = js_trim(F.get(F.split(text, "/"), F.lit(0)))
    dashed = F.regexp_extract(head, r"^(\d{4}-\d{2}-\d{2})(?:[ T]\d{1,2}:\d{2}.*)?$", 1)
    packed = F.regexp_extract(text, r"^(\d{4})(\d{2})(\d{2})", 0)
    apart = F.concat_ws("-", F.substring(packed, 1, 4), F.substring(packed, 5, 2), F.substring(packed, 7, 2))
    return F.when(text.contains("-"), F.nullif(dashed, F.lit("")).try_cast("date")).when(packed != "", apart.try_cast("date"))


def d_day(c: str | Column, as_of) -> Column:
    """label, class and sort_days of a deadline; closed ones sort behind open ones, unknown ones last."""
    n = F.datediff(parse_date(c), day(as_of))
    row = lambda label, kind, days: F.struct(label.alias("label"), F.lit(kind).alias("class"), days.cast("int").alias("sort_days"))
    left = F.concat(F.lit("D-"), n.cast("string"))
    return (
        F.when(n.isNull(), row(F.lit("마감일 확인 필요"), "deadline-unknown", F.lit(UNKNOWN)))
        .when(n < 0, row(F.lit("마감"), "deadline-closed", F.lit(CLOSED)))
        .when(n == 0, row(F.lit("D-DAY"), "deadline-urgent", n))
        .when(n <= 3, row(left, "deadline-urgent", n))
        .when(n <= 7, row(left, "deadline-soon", n))
        .otherwise(row(left, "deadline-normal", n))
    )


def compact_date(c: str | Column) -> Column:
    """The first dashed or dotted date with dashes, as wide as it is; else the text; 확인 필요 where there is none."""
    text = js_trim(c)
    found = F.regexp_extract(text, r"\d{4}[-.]\d{1,2}[-.]\d{1,2}", 0)
    return F.when(text == "", F.lit("확인 필요")).when(found != "", F.translate(found, ".", "-")).otherwise(text)


def _padded(y: Column, m: Column, d: Column) -> Column:
    return F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))


def normalize_date(c: str | Column) -> Column:
    """The first date with dashes, dots or slashes, padded but not validated; else empty."""
    text, p = or_empty(c), r"(\d{4})[-./](\d{1,2})[-./](\d{1,2})"
    return F.when(text.rlike(p), _padded(*[F.regexp_extract(text, p, k) for k in (1, 2, 3)])).otherwise("")


def date_list(c: str | Column) -> Column:
    """All eight-digit dates, then all separated ones, padded, each once, not validated."""
    text = or_empty(c)
    packed = F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_])(20\d{2})(\d{2})(\d{2})(?:\d{4}(?:\d{2})?)?(?![A-Za-z0-9_])"), 0)
    packed = F.transform(packed, lambda x: F.concat_ws("-", F.substring(x, 1, 4), F.substring(x, 5, 2), F.substring(x, 7, 2)))
    p = r"(20\d{2})\s*(?:년|[-./])\s*(\d{1,2})\s*(?:월|[-./])\s*(\d{1,2})"
    apart = F.transform(F.regexp_extract_all(text, F.lit(p), 0), lambda x: _padded(*[F.regexp_extract(x, p, k) for k in (1, 2, 3)]))
    return F.array_distinct(F.concat(packed, apart))


def date_only(c: str | Column) -> Column:
    """The first of ``date_list``, else a dash."""
    return F.coalesce(F.get(date_list(c), F.lit(0)), F.lit("-"))


def date_range(start: str | Column, end: str | Column) -> Column:
    """``a ~ b`` of two texts' first dates; one where they are equal or the other is missing."""
    a, b = date_only(start), date_only(end)
    return F.when((a != "-") & (b != "-") & (a != b), F.concat(a, F.lit(" ~ "), b)).when(a != "-", a).otherwise(b)


def period_text(start: str | Column, end: str | Column) -> Column:
    a, b = js_trim(start), js_trim(end)
    return F.when((a != "") & (b != "") & (a != b), F.concat(a, F.lit(" ~ "), b)).otherwise(truthy(a, b, default="확인 필요"))


def to_iso(y: Column, m: Column, d: Column) -> Column:
    """``YYYY-MM-DD`` of a real date from 2000 to 2100, else null."""
    date = F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), m.cast("string"), d.cast("string")).try_cast("date")
    return let(date, lambda x: F.when(F.year(x).between(2000, 2100), x.cast("string")))


FULL = r"(20\d{2})\s*(?:년|[.\-/])\s*(\d{1,2})\s*(?:월|[.\-/])\s*(\d{1,2})"


def existing_date(c: str | Column) -> Column:
    """The first date with a year in a text, if it is a real one; else empty."""
    text = or_empty(c)
    return F.coalesce(to_iso(*[F.nullif(F.regexp_extract(text, FULL, k), F.lit("")) for k in (1, 2, 3)]), F.lit(""))


def year_of(c: str | Column, as_of) -> Column:
    """The year of a text's date, else that of today."""
    return F.coalesce(F.nullif(F.substring(existing_date(c), 1, 4), F.lit("")).cast("int"), F.year(day(as_of)))


def deadline_state(deadline: Column, as_of) -> Column:
    """is_expired and status of an ISO deadline text."""
    past = deadline < day(as_of).cast("string")
    return (
        F.when(F.coalesce(deadline, F.lit("")) == "", F.struct(F.lit(False).alias("is_expired"), F.lit("마감일 확인 필요").alias("status")))
        .when(past, F.struct(F.lit(True).alias("is_expired"), F.lit("마감").alias("status")))
        .otherwise(F.struct(F.lit(False).alias("is_expired"), F.lit("진행중").alias("status")))
    )


def matches_deadline(d: Column, status: str) -> Column:
    """The deadline facet on a ``d_day`` struct: soon, active, closed, unknown; anything else lets all pass."""
    days = d["sort_days"]
    return {
        "soon": days.between(0, 7), "active": days < CLOSED, "closed": days == CLOSED, "unknown": days == UNKNOWN,
    }.get(status, F.lit(True))


