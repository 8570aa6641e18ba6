"""Value rules of loosely typed records, each as one small Column helper."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from triagelake.sources.schemas import MIXED

# The white space that a trim or a blank run takes in.
BLANKS = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
# The same white space as all that it is not, the most usual characters first: a letter is told from a blank by one comparison.
BLANK = (
    r"[^\x{21}-\x{9F}\x{A1}-\x{167F}\x{3001}-\x{FEFE}\x{1681}-\x{1FFF}\x{200B}-\x{2027}\x{202A}-\x{202E}"
    r"\x{2030}-\x{205E}\x{2060}-\x{2FFF}\x{FF00}-\x{10FFFF}\x{0}-\x{8}\x{E}-\x{1F}]"
)
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")
NUMBER = r"^[+-]?(Infinity|(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)$"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def by_value(c: str | Column, mixed: Callable[[Column], Column], plain: Column) -> Column:
    """``mixed`` of a VARIANT field, ``plain`` of anything else.

    Only a field's name can stand for a VARIANT; what was made from fields is typed.
    The field's type is a constant once the plan is resolved, so one of the two stays in it.
    """
    if not isinstance(c, str) or c not in MIXED:
        return plain
    return F.when(F.typeof(F.col(c)) == "variant", mixed(F.col(c).cast("variant"))).otherwise(plain)


def _kind(v: Column) -> Column:
    """What a VARIANT value is: STRING, BOOLEAN, BIGINT, DOUBLE, DECIMAL(..), ARRAY<..>, OBJECT<..>, VOID (null)."""
    return F.schema_of_variant(v)


def _is_number(v: Column) -> Column:
    return _kind(v).isin("BIGINT", "DOUBLE", "FLOAT") | _kind(v).startswith("DECIMAL")


def _text(v: Column) -> Column:
    """A VARIANT value as text: whole numbers without a fraction, arrays and objects as JSON, null as null."""
    number = v.try_cast("double")
    whole = (_kind(v) == "DOUBLE") & (number == F.floor(number)) & (F.abs(number) < 1e15)
    return F.when(whole, number.cast("bigint").cast("string")).otherwise(v.try_cast("string"))


def or_empty(c: str | Column) -> Column:
    return F.coalesce(by_value(c, _text, col(c).cast("string")), F.lit(""))


def _filled_value(v: Column, true: str) -> Column:
    nothing = (_is_number(v) & (v.try_cast("double") == 0)) | ((_kind(v) == "BOOLEAN") & ~v.try_cast("boolean")) | ((_kind(v) == "STRING") & (v.try_cast("string") == ""))
    return F.when(~F.coalesce(nothing, F.lit(False)), F.when(_kind(v) == "BOOLEAN", F.lit(true)).otherwise(_text(v)))


def _filled(c: str | Column, true: str = "true") -> Column:
    """The value as text, null where it counts as nothing; ``true`` is what a true in a VARIANT gives."""
    text, kind = col(c).cast("string"), F.typeof(col(c))
    zero = (kind.isin(*NUMERIC) | kind.startswith("decimal")) & F.coalesce(text.try_cast("double") == 0, F.lit(False))
    return by_value(c, lambda v: _filled_value(v, true), F.when(~(zero | ((kind == "boolean") & (text == "false")) | (text == "")), text))


def truthy(*cols: str | Column, default: str | Column | None = "") -> Column:
    """The first value, as text, that is not null, an empty string, a numeric zero or false; white space and the string "0" count as something.

    In a VARIANT column each value counts by its own type.
    """
    end = [] if default is None else [F.lit(default) if isinstance(default, str) else default]
    return F.coalesce(*[_filled(c) for c in cols], *end)


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANKS}+|{BLANKS}+$", "")


def js_trim(c: str | Column) -> Column:
    return _trim(or_empty(c))


def compact(c: str | Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(or_empty(c), f"{BLANK}+", " "))  # only single blanks are left


def _number_text(text: Column) -> Column:
    hexadecimal = F.conv(F.substring(text, 3, 16), 16, 10).try_cast("double")
    return (
        F.when(text == "", F.lit(0.0)).when(text.rlike(NUMBER), text.try_cast("double"))
        .when(text.rlike("^0[xX][0-9A-Fa-f]+$"), hexadecimal)
    )


def js_number(c: str | Column) -> Column:
    """A string or number as a double: empty and null are 0, hexadecimal is read, anything else that is not a number is null.

    In a VARIANT column true is 1 and false 0, and arrays and objects are no numbers.
    """
    own = lambda v: F.when(_is_number(v) | (_kind(v) == "BOOLEAN"), v.try_cast("double")).otherwise(_number_text(_trim(F.coalesce(_text(v), F.lit("")))))
    return by_value(c, own, _number_text(js_trim(c)))


def first_number(*cols: str | Column) -> Column:
    """js_number of the first truthy column (a numeric zero is not truthy, the string "0" is), as 0 where there is none or it is no number."""
    return F.coalesce(js_number(F.coalesce(*[_filled(c, "1") for c in cols], F.lit("0"))), F.lit(0.0))


def eq_true(c: str | Column) -> Column:
    return col(c).eqNullSafe(F.lit(True))


def not_false(c: str | Column) -> Column:
    return ~col(c).eqNullSafe(F.lit(False))


def array_or_empty(c: str | Column) -> Column:
    return F.coalesce(col(c), F.array().cast("array<string>"))


def join_fields(*cols: str | Column) -> Column:
    """All fields with one blank between; nulls are empty but keep their blank."""
    return F.concat_ws(" ", *[or_empty(c) for c in cols])


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: inside lambdas Spark does not share common parts."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def contains_ci(haystack: Column, needle: str) -> Column:
    return F.lower(haystack).contains(needle.lower())


def round_half_up(c: Column) -> Column:
    """To whole numbers, halves upwards."""
    return F.floor(c + F.lit(0.5))


def drop_empty(c: Column) -> Column:
    return F.filter(c, lambda x: x.isNotNull() & (x != ""))
