"""Each view's own way to resolve a field from its aliases. The chains differ on purpose and are not shared."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from triagelake.functions.dates import date_only, date_range, normalize_date
from triagelake.functions.scalars import CATEGORY_LABELS, board_grade, capture_grade, lookup, priority_of, research_id, safe_url, split_keywords
from triagelake.functions.semantics import array_or_empty, drop_empty, first_number, truthy

# Placeholders that the views show.
ART_ACTION = "공고문 확인 후 접수 기간, 설치 조건, 작품 규모, 제출 서류 검토"
PRIORITY_ACTION = "공고문 및 지원 조건 확인"
SCORES = ("score", "fitScore", "priorityScore")


def opportunity() -> dict[str, Column]:
    return {
        "deadline_text": truthy("bidClseDt", "bidNtceEndDt", "opengDt", "deadline", "deadlineDate"),
        "document_url": safe_url(truthy("ntceSpecDocUrl1", "ntceSpecDocUrl2", "ntceSpecDocUrl3", "sourceUrl")),
        "category_label": truthy("categoryLabel", lookup(F.col("category"), CATEGORY_LABELS), default="기타"),
        "shown_title": truthy("bidNtceNm", "title"), "notice_agency": truthy("ntceInsttNm", "noticeAgency", "agency"),
        "demand_agency": truthy("dminsttNm", "demandAgency"), "contract": truthy("cntrctCnclsMthdNm", "bidMethdNm", "contractMethod"),
        "money": truthy("budgetAmount", "asignBdgtAmt", "presmptPrce"), "notice_no": truthy("bidNtceNo", "noticeNo"),
    }


def art() -> dict[str, Column]:
    return {"source_value": truthy("source", "region", "agency"), "source_label": truthy("source", "region", default="공고 출처")}


def local() -> dict[str, Column]:
    keywords = F.concat(*[array_or_empty(c) for c in ("directFitKeywords", "supportFitKeywords", "keywords")])
    return {
        "deadline_text": truthy("deadline", "endDate", "closeDate"), "deadline_opening": truthy("deadlineAndOpening", "deadline", "openingDate", "endDate", "closeDate"),
        "kind": truthy("projectType", "type", "category", default="기타"), "url": safe_url(truthy("sourceUrl", "sourcePageUrl", "rawSourcePageUrl", "attachmentUrl")),
        "notice_agency": truthy("noticeAgency", "agencyName", "sourceName", default="서울특별시"), "demand_agency": truthy("demandAgency", "agencyName", "department", default="확인 필요"),
        "contract": truthy("contractMethod", default="확인 필요"), "notice_no": truthy("noticeNo", "sourceId"), "reason": truthy("fitReason", "reason", default="산정 사유를 확인해 주세요."),
        "unique_keywords": F.slice(F.array_distinct(drop_empty(keywords)), 1, 8),
    }


def priority() -> dict[str, Column]:
    return {
        "board_category": truthy("priorityCategory", "category", "categoryKey"), "board_score": first_number(*SCORES), "board_grade": board_grade("grade", list(SCORES)),
        "board_amount": first_number("amount", "budget", "supportAmount", "budgetAmount", "asignBdgtAmt", "presmptPrce"),
        "board_deadline": truthy("deadline", "endDate", "bidNtceEndDt", "deadlineDate", "closeDate", default="9999-99-99"),
        "shown_title": truthy("title", "bidNtceNm", "projectName", default="제목 없음"),
        "shown_agency": truthy("agency", "organization", "ntceInsttNm", "dminsttNm", "noticeAgency", "demandAgency", default="기관 미확인"),
        "source_type": truthy("sourceType", "source", "sourceName", default="출처 미확인"), "category_label": truthy("priorityCategoryLabel", "categoryLabel", "field", default="기타"),
        "published": truthy("publishedDate", "postedDate", "startDate", "bidNtceDt"), "action": truthy("nextAction", "recommendedAction", default="검토"),
        "grade_reason": truthy("gradeReason", "fitReason", "summary", default="등급 기준 정보 없음"),
        "url": safe_url(truthy("sourceUrl", "originalUrl", "url", "ntceSpecDocUrl1", "documentUrl")), "shown_keywords": priority_keywords(),
    }


def priority_keywords() -> Column:
    """The first array that there is, even an empty one, else the field's parts; up to six, a placeholder for none."""
    found = F.coalesce("matchedPriorityKeywords", "matchedKeywords", "keywords", split_keywords("field"))
    return F.when(F.size(found) == 0, F.array(F.lit("키워드 미분류"))).otherwise(F.slice(found, 1, 6))


def capture(kind: str) -> dict[str, Column]:
    title = truthy("title", "bidNtceNm", "projectName")
    deadline = normalize_date(truthy("deadline", "endDate", "bidNtceEndDt", "bidClseDt", "deadlineDate", "closeDate"))
    grade = capture_grade("grade", ["fitScore", "score", "priorityScore"])
    links = [F.nullif(safe_url(c), F.lit("")) for c in ("sourceUrl", "originalUrl", "url", "ntceSpecDocUrl1", "documentUrl")]
    return {
        "title": title, "agency": truthy("agency", "organization", "ntceInsttNm", "dminsttNm", "noticeAgency", "demandAgency"), "deadline": deadline,
        "source_url": F.coalesce(*links, F.lit("")), "research_id": research_id(kind, ["id", "bidNtceNo", "noticeNo", "noticeId", "sourceId"], title, deadline), "grade": grade,
        "priority": priority_of(grade, F.lit(kind)),
        "next_action": truthy("recommendedAction", default=ART_ACTION) if kind == "art" else truthy("recommendedAction", "nextAction", default=PRIORITY_ACTION),
    }


def overlay(period_label: Column | None = None, deadline_label: Column | None = None) -> dict[str, Column]:
    """Publication period and deadline of the summary line, from the record found by title, else from what is shown."""
    start = truthy("publishedDate", "postedDate", "noticeDate", "bidNtceDt", "bidNtceBgnDt", "bidNtceBgn")
    end = truthy("deadlineDate", "deadline", "bidClseDt", "bidNtceEndDt")
    due = truthy("deadlineDate", "deadline", "bidClseDt", "bidNtceEndDt", "bidClseDate")
    shown = lambda made, other: made if other is None else F.when(made != "-", made).otherwise(other)
    return {"publish_period": shown(date_range(start, end), period_label), "deadline_date": shown(date_only(due), deadline_label)}


def region_group() -> Column:
    return truthy("regionGroupLabel", "regionGroup", default="미분류")
