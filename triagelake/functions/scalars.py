"""String, money and grading functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from triagelake.functions.semantics import col, compact, drop_empty, first_number, js_number, js_trim, or_empty, round_half_up, truthy

# Fixed values of the record sets: labels, ranks, ordered rules.
CATEGORY_LABELS = {
    "arts_content_support": "예술·콘텐츠 지원사업", "public_art": "공공미술", "media_art": "미디어아트", "exhibition": "전시",
    "festival": "문화행사", "design": "공공디자인", "tourism": "관광콘텐츠", "general": "기타",
}
GRADE_RANK = {"S": 0, "A": 1, "B": 2, "C": 3}
REVIEW_LABELS = {"new": "미검토", "reviewing": "검토중", "proposal": "제안 준비", "hold": "보류", "done": "제안 완료"}
STATUS_LABELS = {"REVIEW": "검토중", "WORKING": "작성중", "REVIEW_REQUESTED": "검토요청", "READY": "제출준비", "SUBMITTED": "제출완료"}
CONTRACT_RULES = (
    ("협상에 의한 계약", "협상계약"), ("제한경쟁", "제한경쟁"), ("일반경쟁", "일반경쟁"),
    ("수의계약", "수의계약"), ("전자입찰", "전자입찰"), ("방문제출", "방문제출"),
)
SOURCE_RULES = (("경기", "경기도"), ("서울", "서울시"), ("인천", "인천시"))
UNKNOWN = "확인 필요"
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;"))


def lookup(c: Column, table: dict, default: Column | None = None) -> Column:
    """A literal map lookup; ``default`` where there is no entry."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    found = F.try_element_at(F.create_map(*pairs), c)
    return found if default is None else F.coalesce(found, default)


def ordered_contains(c: Column, rules: tuple[tuple[str, str], ...], otherwise: Column) -> Column:
    """The label of the first rule whose text is contained."""
    out = otherwise
    for needle, label in reversed(rules):
        out = F.when(c.contains(needle), F.lit(label)).otherwise(out)
    return out


def escape_html(c: str | Column) -> Column:
    out = or_empty(c)
    for char, entity in ENTITIES:
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def safe_text(c: str | Column, fallback: str = "-") -> Column:
    return truthy(js_trim(c), default=fallback)


def safe_url(c: str | Column) -> Column:
    """The trimmed text where it starts with http:// or https://, else empty."""
    text = js_trim(c)
    return F.when(text.startswith("http://") | text.startswith("https://"), text).otherwise("")


def compact_contract(c: str | Column) -> Column:
    text = js_trim(c)
    head = js_trim(F.get(F.split(text, "/"), F.lit(0)))
    return F.when(text.isin("", "-"), F.lit(UNKNOWN)).otherwise(ordered_contains(text, CONTRACT_RULES, head))


def compact_source(c: str | Column) -> Column:
    text = js_trim(c)
    return ordered_contains(text, SOURCE_RULES, text)


def grade_class(c: str | Column) -> Column:
    return F.when(col(c).isin("S", "A", "B", "C"), F.lower(col(c))).otherwise("b")


def grade_from_badge(c: str | Column) -> Column:
    """The first of S, A, B, C that a badge's text contains, else empty."""
    return ordered_contains(or_empty(c), (("S", "S"), ("A", "A"), ("B", "B"), ("C", "C")), F.lit(""))


def grade_rank(c: str | Column) -> Column:
    """S, A, B, C before everything else."""
    return lookup(col(c), GRADE_RANK, F.lit(9)) if isinstance(c, str) else lookup(c, GRADE_RANK, F.lit(9))


def status_label(c: str | Column) -> Column:
    key = F.upper(js_trim(c))
    return lookup(key, STATUS_LABELS, key)


def review_label(c: str | Column) -> Column:
    return lookup(col(c), REVIEW_LABELS, col(c))


def split_keywords(c: str | Column) -> Column:
    """Parts between slashes, trimmed, without empty ones."""
    return drop_empty(F.transform(F.split(or_empty(c), "/"), js_trim))


def joined_or(c: Column, separator: str, placeholder: str) -> Column:
    return truthy(F.array_join(c, separator), default=placeholder)


# ---- keys and links --------------------------------------------------------


def opportunity_key() -> Column:
    return F.concat(F.lit("opportunity-"), truthy("bidNtceNo", "noticeNo", "bidNtceNm", "title"))


def agency_key() -> Column:
    return F.concat(F.lit("agency-"), or_empty("agencyName"), F.lit("-"), or_empty("region"))


def art_key() -> Column:
    return F.concat(F.lit("art-"), truthy("bidNtceNo", "title"), F.lit("-"), or_empty("deadline"))


def local_key() -> Column:
    return F.concat(F.lit("local-"), truthy("noticeNo", "sourceId", "title"), F.lit("-"), or_empty("deadline"))


def research_id(kind: str | Column, ids: list[str | Column], title: Column, deadline: Column) -> Column:
    """The first identifier there is, else type, compacted title and deadline joined by ``::``."""
    made = F.concat_ws("::", F.lit(kind) if isinstance(kind, str) else kind, compact(title), deadline)
    return truthy(*ids, default=made)


def form_query(params: list[tuple[str, Column]]) -> Column:
    """Form-encoded ``name=value`` pairs; a null value leaves its pair out."""
    return F.concat_ws("&", *[F.concat(F.lit(f"{name}="), F.url_encode(value)) for name, value in params])


def query_param(url: str | Column, name: str) -> Column:
    """The decoded parameter of a URL's query, null where it is absent."""
    # the query stops at the fragment; parse_url leaves escapes as they are
    raw = F.nullif(F.regexp_extract(col(url), rf"^[^#?]*\?(?:[^#]*&)?{name}=([^&#]*)", 0), F.lit(""))
    value = F.regexp_extract(col(url), rf"^[^#?]*\?(?:[^#]*&)?{name}=([^&#]*)", 1)
    return F.when(raw.isNotNull(), F.try_url_decode(value))


def without_params(url: str | Column, names: list[str]) -> Column:
    """The URL with the named parameters taken out of its query."""
    pair = rf"(?:{'|'.join(names)})(?:=[^&#]*)?"
    # a leading parameter keeps the question mark, the others go with their ampersand
    out = F.regexp_replace(col(url), rf"(?<=[?&]){pair}(?=&|#|$)&?", "")
    return F.regexp_replace(out, r"[?&]+(?=#|$)", "")


# ---- money, grades, progress ----------------------------------------------


def format_money(c: str | Column) -> Column:
    """Grouped digits and 원; nothing, zero and what is no number are undisclosed."""
    n = js_number(c)
    whole = F.format_number(n, 0)
    text = F.when(n == F.floor(n), whole).otherwise(F.call_function("format_number", n, F.lit("#,##0.###")))
    return F.when(n.isNull() | (n == 0), F.lit("금액 미공개")).otherwise(F.concat(text, F.lit("원")))


def format_count(c: str | Column) -> Column:
    return F.format_number(F.coalesce(js_number(c), F.lit(0.0)), 0)


def format_krw(c: str | Column) -> Column:
    """억 from 100 million (one decimal below ten, ungrouped), 만원 from ten thousand, else 원; exact decimal arithmetic."""
    n = F.coalesce(js_number(c), F.lit(0.0))
    won = n.cast("decimal(30,2)")
    eok = won / F.lit(100_000_000)
    large = F.when(eok >= 10, F.round(eok, 0).cast("decimal(30,0)").cast("string")).otherwise(F.round(eok, 1).cast("decimal(30,1)").cast("string"))
    man = F.format_number(round_half_up(won / F.lit(10_000)), 0)
    plain = F.when(n == F.floor(n), F.format_number(n, 0)).otherwise(F.call_function("format_number", n, F.lit("#,##0.###")))
    return (
        F.when(n == 0, F.lit("예산 미확인")).when(won >= 100_000_000, F.concat(large, F.lit("억")))
        .when(won >= 10_000, F.concat(man, F.lit("만원"))).otherwise(F.concat(plain, F.lit("원")))
    )


def _by_score(score: Column, lowest: str) -> Column:
    return F.when(score >= 85, F.lit("S")).when(score >= 70, F.lit("A")).when(score >= 50, F.lit("B")).otherwise(lowest)


def board_grade(grade: str | Column, scores: list[str | Column]) -> Column:
    """The given grade as it is, else by score down to C."""
    return truthy(grade, default=_by_score(first_number(*scores), "C"))


def capture_grade(grade: str | Column, scores: list[str | Column]) -> Column:
    """The given grade trimmed and in capitals, else by score, with none below 50."""
    return truthy(F.upper(js_trim(grade)), default=_by_score(first_number(*scores), ""))


def priority_of(grade: Column, kind: Column) -> Column:
    return F.when(kind == "art", F.lit("NORMAL")).when(grade.isin("S", "A"), F.lit("HIGH")).when(grade == "C", F.lit("LOW")).otherwise("NORMAL")


def clamp_progress(c: str | Column) -> Column:
    """Rounded to a whole number from 0 to 100; what is no finite number is 0."""
    n = js_number(c)
    finite = n.isNotNull() & ~F.isnan(n) & (F.abs(n) < F.lit(1e300))
    return F.when(finite, F.greatest(F.lit(0), F.least(F.lit(100), round_half_up(n)))).otherwise(0).cast("int")


def confidence_label(c: str | Column) -> Column:
    level = F.upper(js_trim(c))
    return F.when(level == "HIGH", F.lit("● 확인됨")).when(level == "MEDIUM", F.lit("● 부분 확인")).otherwise("● 확인 필요")


def digits_only(c: str | Column) -> Column:
    return F.coalesce(F.regexp_replace(or_empty(c), "[^0-9]", "").try_cast("long"), F.lit(0))


def capture_button(registered: Column, status: Column, label: Column, progress: Column) -> Column:
    """What a registered record shows: its label (or its status's) and, where there is one, its progress."""
    shown = truthy(label, default=F.coalesce(status_label(status), F.lit("")))
    done = F.when(truthy(progress.cast("string")) != "", F.concat(F.lit(" · "), clamp_progress(progress.cast("string")).cast("string"), F.lit("%"))).otherwise("")
    detail = F.when(shown != "", F.concat(F.lit(" · "), shown, done)).otherwise("")
    return F.when(F.coalesce(registered, F.lit(False)), F.concat(F.lit("✓ 지원 관리 등록됨"), detail)).otherwise("⭐ 지원 관리에 추가")


def last_updated_text(at: str | Column, zone: str | Column) -> Column:
    tail = F.when(truthy(zone) != "", F.concat(F.lit(" ("), truthy(zone), F.lit(")"))).otherwise("")
    return F.concat(F.lit("최근 업데이트 : "), F.when(truthy(at) != "", F.concat(truthy(at), tail)).otherwise("-"))


def copy_block(heading: str, title: Column, badges: Column, score: Column, deadline: Column, meta: Column, actions: Column, memo: Column, link: Column) -> Column:
    """A record as lines of text; empty parts leave no line. ``badges``, ``meta`` and ``actions`` are arrays."""
    part = lambda name, value: F.when(value != "", F.concat(F.lit(f"{name}: "), value)).otherwise("")
    lines = F.array(
        F.lit(heading), F.concat(F.lit("제목: "), title), part("구분", F.array_join(drop_empty(badges), " / ")), part("점수/정보", score), part("마감", deadline),
        F.array_join(drop_empty(meta), "\n"), F.array_join(drop_empty(actions), "\n"), part("담당자 메모", memo), part("링크", link),
    )
    return F.array_join(drop_empty(lines), "\n")
