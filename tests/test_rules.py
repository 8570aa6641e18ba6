"""Value rules, texts, dates and money on edge rows."""

import pytest
from pyspark.sql import functions as F

from triagelake.functions import dates, scalars
from triagelake.functions import semantics as sem

AS_OF = "2026-08-22"


def values(spark, inputs, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("v")).alias("x")).collect()]


def test_truthy_by_type(spark):
    df = spark.createDataFrame([(0, 0.0, False, "0"), (3, 0.0, True, "")], "i int, d double, b boolean, s string").withColumn("m", F.col("i").cast("decimal(5,2)"))
    assert [tuple(r) for r in df.select(sem.truthy("i", "s"), sem.truthy("d", default="-"), sem.truthy("b", default="-"), sem.truthy("m", default="-")).collect()] == [("0", "-", "-", "-"), ("3", "-", "true", "3.00")]


def test_truthy(spark):
    df = spark.createDataFrame([("", None, " "), (None, "0", "x"), (None, None, None)], "a string, b string, c string")
    assert [r[0] for r in df.select(sem.truthy("a", "b", "c", default="-")).collect()] == [" ", "0", "-"]


def test_numbers(spark):
    got = values(spark, ["52000000", "", None, "5d", "1,000", " 5 ", "0", "0x10", "1e3", ".5", "-2.5"], sem.js_number)
    assert got == [52000000.0, 0.0, 0.0, None, None, 5.0, 0.0, 16.0, 1000.0, 0.5, -2.5]


def test_white_space(spark):
    assert values(spark, [" a　　b﻿\n", None, "  "], sem.compact) == ["a b", "", ""]


def test_flags(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "f boolean")
    assert [tuple(r) for r in df.select(sem.eq_true("f"), sem.not_false("f")).collect()] == [(True, True), (False, False), (False, True)]


@pytest.mark.parametrize(
    ("make", "inputs", "wanted"),
    [
        (scalars.escape_html, ["<a href=\"x\">&'", None], ["&lt;a href=&quot;x&quot;&gt;&amp;&#039;", ""]),
        (scalars.safe_text, [" x ", "", None, "  "], ["x", "-", "-", "-"]),
        (scalars.safe_url, [" https://a.example/ ", "ftp://x", None], ["https://a.example/", "", ""]),
        (scalars.compact_contract, ["제한경쟁/협상에 의한 계약", "지명 / 기타", "", "-"], ["협상계약", "지명", "확인 필요", "확인 필요"]),
        (scalars.compact_source, ["경기 북부", "부산"], ["경기도", "부산"]),
        (scalars.grade_class, ["S", "HOLD", None], ["s", "b", "b"]),
        (scalars.grade_from_badge, ["A등급", "등급", None], ["A", "", ""]),
        (scalars.status_label, [" review ", "DONE"], ["검토중", "DONE"]),
        (scalars.format_money, ["52000000", "", "0", "abc", "1234.5"], ["52,000,000원", "금액 미공개", "금액 미공개", "금액 미공개", "1,234.5원"]),
        (scalars.format_krw, ["52000000", "150000000", "1230000000", "9999", "", "12345678900000"], ["5,200만원", "1.5억", "12억", "9,999원", "예산 미확인", "123457억"]),
        (scalars.clamp_progress, ["-5", "0", "49.5", "100", "150", "abc", "", None], [0, 0, 50, 100, 100, 0, 0, 0]),
        (scalars.confidence_label, ["high", "MEDIUM", None], ["● 확인됨", "● 부분 확인", "● 확인 필요"]),
        (scalars.split_keywords, ["a / / b", None], [["a", "b"], []]),
        (scalars.digits_only, ["12건 3", "", None], [123, 0, 0]),
        (dates.compact_date, ["마감 2026.8.4", "", "미정"], ["2026-8-4", "확인 필요", "미정"]),
        (dates.normalize_date, ["2026/8/4", "2026년", None], ["2026-08-04", "", ""]),
        (dates.date_list, ["2026.8.4 가20260824나 2026년 8월 4일", ""], [["2026-08-24", "2026-08-04"], []]),
        (dates.existing_date, ["2026-02-30", "2026. 8. 4", "1999-12-31", "2101-01-01", None], ["", "2026-08-04", "", "", ""]),
    ],
)
def test_texts(spark, make, inputs, wanted):
    assert values(spark, inputs, make) == wanted


def test_days_left(spark):
    inputs = ["2026-08-21", "2026-08-22", "2026-08-23", "2026-08-25", "20260826", "2026-08-29 17:00:00 / x", "202608301700", None, "미정", "2026-02-30"]
    got = values(spark, inputs, lambda c: dates.d_day(c, AS_OF))
    assert [(r["label"], r["sort_days"]) for r in got] == [
        ("마감", 9998), ("D-DAY", 0), ("D-1", 1), ("D-3", 3), ("D-4", 4), ("D-7", 7), ("D-8", 8), ("마감일 확인 필요", 9999), ("마감일 확인 필요", 9999), ("마감일 확인 필요", 9999),
    ]
    assert [r["class"].split("-")[1] for r in got] == ["closed", "urgent", "urgent", "urgent", "soon", "soon", "normal", "unknown", "unknown", "unknown"]


def test_grades(spark):
    board = values(spark, ["49", "50", "69", "70", "84", "85", "x"], lambda c: scalars.board_grade(F.lit(None).cast("string"), [c]))
    capture = values(spark, ["49", "50", "85"], lambda c: scalars.capture_grade(F.lit(""), [c]))
    assert (board, capture) == (["C", "B", "B", "A", "A", "S", "C"], ["", "B", "S"])
    assert values(spark, [" s "], lambda c: scalars.capture_grade(c, [F.lit("1")])) == ["S"] and values(spark, [" s "], lambda c: scalars.board_grade(c, [F.lit("1")])) == [" s "]


def test_urls(spark):
    url = "https://a.example/p?x=1&title=%EA%B3%B5%20a+b&y=#frag"
    df = spark.createDataFrame([(url,)], "u string").select(
        scalars.query_param("u", "title"), scalars.query_param("u", "y"), scalars.query_param("u", "z"), scalars.without_params("u", ["x", "y"]), scalars.form_query([("a", F.lit("b c~")), ("n", F.lit(None).cast("string"))])
    )
    assert tuple(df.first()) == ("공 a b", "", None, "https://a.example/p?title=%EA%B3%B5%20a+b#frag", "a=b+c%7E")


def test_both_forms_of_white_space_are_the_same(spark):
    points = [*range(0, 0xD800), *range(0xE000, 0x10400), 0x1F600, 0x10FFFF]
    rows = spark.createDataFrame([(i, f"a{chr(i)}b") for i in points], "i int, t string")
    assert rows.where(~sem.compact("t").eqNullSafe(F.regexp_replace("t", f"{sem.BLANKS}+", " "))).count() == 0
    assert rows.where(F.col("t").rlike(sem.BLANKS) != F.col("t").rlike(sem.BLANK)).count() == 0
