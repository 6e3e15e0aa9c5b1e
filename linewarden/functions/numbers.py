"""Text to number, and number to text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# All white space, as a set of characters and as a pattern for
# any character outside it.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
INK = (
    r"[^\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
)
# What a cast to double would take, but a decimal number lacks.
NO_DECIMAL = r"[A-DF-Za-df-z\x00-\x08\x0e-\x1b]"

_INF = float("inf")


def strip(text: Column) -> Column:
    """Remove all leading and trailing white space, not only blanks."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text.rlike(INK), F.lit(False))


def finite(number: Column) -> Column:
    """NaN and the infinities become null."""
    value = number.cast("double")
    return F.when(F.abs(value) < _INF, value)


def as_number(value: Column, dtype: T.DataType) -> Column:
    """A finite double, or null for anything else.

    A plain cast also takes ``1d`` or ``inf``, so text with letters other than
    an exponent is none.
    """
    if isinstance(dtype, T.StringType):
        return finite(_decimal_text(value).try_cast("double"))
    if isinstance(dtype, T.BooleanType):
        return value.cast("double")
    if isinstance(dtype, T.NumericType):
        return finite(value)
    return F.lit(None).cast("double")


def int_or_null(value: Column) -> Column:
    """Of a variant: the whole part of a number, or a text that is an integer."""
    text = strip(F.try_variant_get(value, "$", "string"))
    whole = F.when(text.rlike("^[+-]?[0-9]+$"), text).try_cast("bigint")
    number = F.try_variant_get(value, "$", "bigint")
    return F.when(F.schema_of_variant(value) == "STRING", whole).otherwise(number)


def _decimal_text(text: Column) -> Column:
    return F.when(~text.rlike(NO_DECIMAL), text)


def fixed_text(number: Column, digits: int) -> Column:
    """The number with ``digits`` (at most 3) decimals, ties to even.

    The rounding sees the binary value and not its shortest decimal form: the
    fraction in units of 2^-52, and what a value below one has beneath them. A value from
    2^53 on has no fraction; it is shown by the digits of its shortest decimal form, then zeros.
    """
    if not 1 <= digits <= 3:
        raise ValueError("digits must be 1, 2 or 3")
    power = 10**digits
    whole_from = float(1 << 53)
    given = F.abs(number.cast("double"))
    # Held inside a long, since a branch not taken may be evaluated as well.
    size = F.least(given, F.lit(whole_from))
    whole = F.floor(size).cast("bigint")
    units = (size - F.floor(size)) * float(1 << 52)
    below = (units - F.floor(units)) * float(power)
    scaled = units.cast("bigint") * F.lit(power) + F.floor(below).cast("bigint")
    quotient = F.shiftright(scaled, 52)
    rest = scaled.bitwiseAND(F.lit((1 << 52) - 1))
    half = F.lit(1 << 51)
    odd = quotient.bitwiseAND(F.lit(1)) == 1
    beyond = (rest == half) & (odd | (below > F.floor(below)))
    up = F.when((rest > half) | beyond, 1).otherwise(0)
    units = whole * F.lit(power) + quotient + up
    head = F.call_function("div", units, F.lit(power).cast("bigint"))
    near = F.concat(
        head.cast("string"),
        F.lit("."),
        F.lpad((units - head * F.lit(power)).cast("string"), digits, "0"),
    )
    large = F.format_string(f"%.{digits}f", given)
    text = F.concat(
        F.when(number < 0, "-").otherwise(""),
        F.when(given < whole_from, near).otherwise(large),
    )
    return F.when(number.isNotNull(), text)


def once(value: Column, shown: Callable[[Column], Column]) -> Column:
    """``shown(value)`` with a value that is worked out once.

    For long expressions over other long ones, whose code would multiply.
    """
    return F.get(F.transform(F.array(value), shown), 0)


def plain_text(number: Column) -> Column:
    """A number rounded to two decimals, shown with one or two of them."""
    text = F.bround(number.cast("double"), 2).cast("decimal(38,2)").cast("string")
    return F.regexp_replace(text, "0$", "")
