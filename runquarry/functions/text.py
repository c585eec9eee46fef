"""The one text of a value: what logging writes is what look-ups, hashes and trial keys compare with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T

#: How a missing value is logged.
NONE = "None"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once: plain nesting would repeat its expression at every use."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _laid_out(digits: Column, exponent: Column) -> Column:
    """d.ddd × 10^exponent as Python writes it: plain from 1e-4 to below 1e16, else with an exponent of two digits or more."""
    n = F.length(digits)
    whole = F.when(n <= exponent + 1, F.concat(F.rpad(digits, exponent + 1, F.lit("0")), F.lit(".0"))).otherwise(
        F.concat(F.substring(digits, F.lit(1), exponent + 1), F.lit("."), F.substring(digits, exponent + 2, n)))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    power = F.abs(exponent).cast("string")
    science = F.concat(F.substring(digits, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise(""), F.lit("e"),
                       F.when(exponent < 0, "-").otherwise("+"), F.lpad(power, F.greatest(F.lit(2), F.length(power)), F.lit("0")))
    return F.when((exponent >= 0) & (exponent < 16), whole).when((exponent < 0) & (exponent >= -4), small).otherwise(science)


def double_text(c: Column) -> Column:
    """A double in the fewest digits that give it back, as Python writes it: ``0.0001``, ``1e-05``, ``12345678.0``, ``1e+16``,
    ``inf``, ``nan``.

    Spark's own text has another layout below 1e-3 and from 1e7 on, and Java before 19 writes more digits than needed for some
    numbers: the first of a few precisions that gives the number back is taken. Where 16 or 17 digits are needed, those Java
    versions may miss the last digit that Python writes, for about one such number in two hundred; comparing numbers, not texts, is exact.
    """
    def anew(texts: Column) -> Column:
        """From ``d.ddde±xx`` texts of growing precision."""
        first = F.get(F.filter(texts, lambda t: t.cast("double") == c), F.lit(0))

        def parts(t: Column) -> Column:
            sign, body = F.when(t.startswith("-"), "-").otherwise(""), F.ltrim(t, F.lit("-"))
            digits = F.rtrim(F.replace(F.substring_index(body, "e", 1), F.lit("."), F.lit("")), F.lit("0"))
            return F.concat(sign, _laid_out(digits, F.substring_index(body, "e", -1).try_cast("int")))

        return _let(first, parts)

    def text(java: Column) -> Column:
        precise = F.array(*[F.format_string(f"%.{n}e", c) for n in (0, 14, 15, 16)])
        return F.when(java.contains("E") | (F.length(java) >= 17), anew(precise)).otherwise(java)

    odd = F.when(F.isnan(c), "nan").when(c == float("inf"), "inf").when(c == float("-inf"), "-inf").when(c == 0, c.cast("string"))
    return odd.otherwise(_let(c.cast("string"), text))


def value_text(c: Column, kind: T.DataType, none: str | None = NONE) -> Column:
    """The text of a value as it is logged: ``True``, ``False``, a double by ``double_text``, anything else as Spark casts it.

    A float is the double of the same value. NULL is ``none``, or NULL where that is None.
    """
    if isinstance(kind, T.BooleanType):
        text = F.when(c, "True").when(~c, "False")
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        text = F.when(c.isNotNull(), double_text(c.cast("double")))
    else:
        text = c.cast("string")
    return text if none is None else F.coalesce(text, F.lit(none))


def column_text(df: DataFrame, name: str, none: str | None = NONE) -> Column:
    """``value_text`` of a column by its type."""
    return value_text(df[name], df.schema[name].dataType, none)
