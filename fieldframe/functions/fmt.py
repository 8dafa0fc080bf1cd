"""How numbers and strings are written."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def float_text(x: Column) -> Column:
    """The shortest decimal that reads back as the same double, never with an exponent, and without `.0`."""
    s = x.cast("string")
    sign = F.when(s.startswith("-"), "-").otherwise("")
    body = F.ltrim(s, F.lit("-"))
    mantissa = F.regexp_replace(F.split_part(body, F.lit("E"), F.lit(1)), r"\.0$", "")
    whole = F.split_part(mantissa, F.lit("."), F.lit(1))
    digits = F.replace(mantissa, F.lit("."), F.lit(""))
    point = F.length(whole) + F.split_part(body, F.lit("E"), F.lit(2)).try_cast("int")
    n = F.length(digits)
    expanded = (
        F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        .when(point >= n, F.concat(digits, F.repeat(F.lit("0"), point - n)))
        .otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, n)))
    )
    word = F.when(F.isnan(x), F.lit("NaN")).when(body == "Infinity", F.concat(sign, F.lit("inf")))
    return F.coalesce(word, F.when(s.contains("E"), F.concat(sign, expanded)).otherwise(F.regexp_replace(s, r"\.0$", "")))


def plain_float_text(x: Column) -> Column:
    """float_text with -0 as 0: what checksums and normal forms use."""
    return float_text(F.when(x == 0, F.lit(0.0)).otherwise(x))


def bit_text(x: Column) -> Column:
    return F.when(x, "1").otherwise("0")


def escape(s: Column) -> Column:
    for char, code in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        s = F.replace(s, F.lit(char), F.lit(code))
    return s


def quoted(s: Column) -> Column:
    return F.concat(F.lit('"'), escape(s), F.lit('"'))


#: Characters that need no quotes.
SAFE = r"^[A-Za-z0-9_.-]+$"
#: Words and numbers that a reader would not take for a string.
LITERAL = r"(?i)^(?:true|false|yes|no|[+-]?(?:inf|infinity|nan|[0-9]+(?:\.[0-9]*)?(?:e[+-]?[0-9]+)?|\.[0-9]+(?:e[+-]?[0-9]+)?))$"


def string_text(s: Column, literals: bool = True) -> Column:
    """A string as it stands in record text; with literals, one that looks like a number or word is quoted too."""
    bare = s.rlike(SAFE)
    if literals:
        bare = bare & ~s.rlike(LITERAL)
    return F.when(bare, s).otherwise(quoted(s))


def bracketed(items: Column, sep: str = ",") -> Column:
    return F.concat(F.lit("["), F.array_join(items, sep), F.lit("]"))
