"""The date normaliser: golden rows, edge rows, and an independent model over random texts."""

import datetime
import random
import re

from pyspark.sql import functions as F

from triagelake.functions import extract
from triagelake.functions import semantics as sem

AS_OF = "2026-08-22"
FIELDS = ["publishedDate", "periodStart", "periodEnd", "deadline", "deadlineSource", "dateConfidence", "periodKeyword", "deadlineKeyword"]


def run(spark, rows, as_of=AS_OF, schema="detailTextSample string"):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
    return extract.normalize_notices(df, as_of).orderBy("i")


def test_golden(spark):
    rows = [
        ("공모 게시물 정보 등록일 2026-08-05 ◦ 응모작품 접수일시 : 2026. 8. 24 .( 월 ) 10:00 ~ 17:00, 접수",),
        ("공고 등록일 2026-08-10 접수일시 : 2026 년 8 월 10 일 ~ 8 월 29 일 까지",),
        ("접수기간 2026. 8. 24 장소 미정",),
        ("접수기간 미정, 접수일 2026. 8. 24 09:00 – 11:00 접수마감 추후 제출마감 2026년 9월 1일",),
        ("접수기간 2026.12.20 ~ 01.10",),
        ("신청기간 12월 20일(월) ∼ 1월 10일 등록일 2026.11.01",),
        ("마감일 2026년 2월 30일 3월 2일",),
    ]
    got = [tuple(r[f] for f in FIELDS) for r in run(spark, rows).collect()]
    assert got == [
        ("2026-08-05", "2026-08-24", "2026-08-24", "2026-08-24", "period_end", "HIGH", "응모작품 접수일시", ""),
        ("2026-08-10", "2026-08-10", "2026-08-29", "2026-08-29", "period_end", "HIGH", "접수일시", ""),
        ("", "", "", "", "not_found", "LOW", "", ""),
        ("", "2026-08-24", "2026-08-24", "2026-09-01", "explicit_deadline", "MEDIUM", "접수기간", "접수마감"),
        ("", "2026-12-20", "2027-01-10", "2027-01-10", "period_end", "MEDIUM", "접수기간", ""),
        ("2026-11-01", "2026-12-20", "2027-01-10", "2027-01-10", "period_end", "HIGH", "신청기간", ""),
        ("", "", "", "2026-03-02", "explicit_deadline", "MEDIUM", "", "마감일"),
    ]


def test_stored_fields(spark):
    schema = "detailTextSample string, rawText string, title string, postedDate string, deadline string, deadlineSource string, status string, more int"
    rows = [
        ("", "등록일 2026.8.1", "t", None, "2026-08-30", "period_end", "마감일 확인 필요", 1),
        (None, None, None, "2026. 8. 2", "2026-08-01", "not_found", "마감일 확인 필요", 2),
        (None, None, None, "x", None, None, "공모중", 3),
    ]
    got = run(spark, rows, schema=schema).select("publishedDate", "postedDate", "deadline", "endDate", "deadlineSource", "dateConfidence", "status", "isExpired", "deadlineStatus", "more").collect()
    assert [tuple(r) for r in got] == [
        ("2026-08-01", "2026-08-01", "2026-08-30", "2026-08-30", "period_end", "HIGH", "공모중", False, "진행중", 1),
        ("2026-08-02", "2026-08-02", "2026-08-01", "2026-08-01", "existing_deadline", "MEDIUM", "마감", True, "마감", 2),
        ("", "x", "", "", "not_found", "LOW", "공모중", False, "마감일 확인 필요", 3),
    ]


def test_running_again_changes_nothing(spark):
    once = run(spark, [("등록일 2026-08-05 접수기간 8월 10일 ~ 8월 29일 제출마감 9월 1일",), ("",)])
    twice = extract.normalize_notices(once, AS_OF)
    assert [r.asDict() for r in once.collect()] == [r.asDict() for r in twice.select(once.columns).collect()]


def real(y, m, d):
    try:
        return datetime.date(int(y), int(m), int(d)).isoformat()
    except ValueError:
        return None


def model_first(text, year):
    """By its definition: dates with a year that are real, and month-day pairs of the year that no such date contains."""
    found = [(m.start(), m.end(), real(*m.groups())) for m in re.finditer(r"(20\d\d)\s*[년.\-/]\s*(\d{1,2})\s*[월.\-/]\s*(\d{1,2})\s*일?", text)]
    found = [f for f in found if f[2]]
    pairs = [(m.start(), m.end(), real(year, *m.groups())) for m in re.finditer(r"(\d{1,2})\s*월\s*(\d{1,2})\s*일?", text)]
    found += [p for p in pairs if p[2] and not any(a <= p[0] < b for a, b, _ in found)]
    return min(found)[2] if found else None


def test_first_date_against_a_model(spark):
    r = random.Random(7)
    bits = ["2026년 8월 10일", "2026. 2. 30", "8월 29일", "13월 2일", "2월 29 일", "2026-08-1", " ", "가", "12", "월", "2026/12/31", "20", "~", "일", "3월 2026년 8월 10일"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 6))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [x[0] for x in df.orderBy("i").select(extract.first_date(sem.compact("t"), F.lit(2026))["value"]).collect()]
    assert got == [model_first(" ".join(t.split()), 2026) for t in texts]
