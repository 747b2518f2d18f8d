"""Payload fields with the coercions that logs were written under, as JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def field(v: Column, name: str) -> Column:
    """A payload field as a variant; null if it is missing."""
    return F.try_variant_get(v, f"$.{name}", "variant")


def kind_of(x: Column) -> Column:
    return F.schema_of_variant(x)


def number(kind: Column, text: Column) -> Column:
    """A field's numeric value from its kind and trimmed text: numbers as they are, numeric text, '' and null as 0, booleans as 0 or 1; null for anything else."""
    decimal = text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    return (
        F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)") | (kind.startswith("STRING") & decimal), text.try_cast("double"))
        .when((kind == "VOID") | (kind.startswith("STRING") & (text == "")), 0.0)
        .when(kind == "BOOLEAN", F.when(text == "true", 1.0).otherwise(0.0))
        .when(kind.startswith("STRING") & text.rlike("^0[xX][0-9a-fA-F]{1,15}$"), F.conv(F.substring(text, 3, 15), 16, 10).cast("double"))
    )


def string(kind: Column, text: Column) -> Column:
    """A field's text; a missing one reads 'undefined', a null one 'null'."""
    return F.when(kind.isNull(), "undefined").when(kind == "VOID", "null").otherwise(text)


def optional(v: Column, *fields: str) -> Column:
    """Text of the first field that is neither missing nor null, else null."""
    return F.coalesce(*[_text(v, f"$.{f}") for f in fields])


def number_text(x: Column) -> Column:
    """A number as ECMAScript prints it: whole ones below 1e21 without a fraction, exponents only from there and below 1e-6. Digits are the JVM's; before Java 19 some doubles get one more than the shortest."""
    text = x.cast("string")
    sign = F.when(text.startswith("-"), "-").otherwise("")
    mantissa = F.regexp_replace(F.regexp_extract(text, r"^-?([\d.]+)E", 1), r"\.0$", "")
    digits, n = F.regexp_replace(mantissa, r"\.", ""), F.regexp_extract(text, r"E(-?\d+)$", 1).try_cast("int")
    long_ = F.concat(sign, F.rpad(digits, n + 1, "0"))
    short = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -n - 1), digits)
    return (
        F.when((x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("long").cast("string"))
        .when(n.isNull(), text)
        .when((n >= 0) & (n < 21) & (F.length(digits) <= n + 1), long_)
        .when((n >= 0) & (n < 21), F.concat(sign, F.substring(digits, F.lit(1), n + 1), F.lit("."), F.substring(digits, n + 2, F.length(digits))))
        .when((n < 0) & (n >= -7 + 1), short)
        .otherwise(F.concat(sign, mantissa, F.when(n > 0, "e+").otherwise("e-"), F.abs(n).cast("string")))
    )
