"""Strict JSON on free text, held as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.let import let


def allow_duplicate_keys(spark: SparkSession) -> None:
    """The last of several equal keys wins, as a JSON reader in Python has it."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def json_span(text: Column) -> Column:
    """Text from the first ``{`` to the last ``}``; NULL when there is none."""
    first = F.instr(text, "{")
    last = F.length(text) - F.length(F.substring_index(text, "}", -1))
    ends = F.struct(first.alias("first"), last.alias("last"))

    def cut(at: Column) -> Column:
        length = at["last"] - at["first"] + 1
        return F.when(
            (at["first"] > 0) & (length > 1), F.substring(text, at["first"], length)
        )

    return let(ends, cut)


# Numbers that Python reads in JSON and Spark does not.
NOT_FINITE = ("-Infinity", "Infinity", "NaN")
STRING_OR_REST = r'"(?:[^"\\]++|\\.)*+"|[^"]++|"'


def finite_numbers(text: Column) -> Column:
    """`text` with non-finite numbers, outside strings, as null."""

    def nulled(part: Column) -> Column:
        for number in NOT_FINITE:
            part = F.replace(part, F.lit(number), F.lit("null"))
        return part

    parts = F.regexp_extract_all(text, F.lit(STRING_OR_REST), F.lit(0))
    fixed = F.array_join(
        F.transform(parts, lambda p: F.when(F.startswith(p, F.lit('"')), p).otherwise(nulled(p))), ""
    )
    return F.when(F.contains(text, F.lit("NaN")) | F.contains(text, F.lit("Infinity")), fixed) \
        .otherwise(text)


def strict_json(text: Column) -> Column:
    """The JSON value that `text` as a whole is, else NULL.

    Spark's parser stops at the end of the first value and drops what follows.  A
    closing element holding the text's own hash, which must be read back, shows
    that nothing was dropped and that there was one value only.
    """
    seal = F.hex(F.xxhash64(text))
    sealed = F.concat(F.lit("["), text, F.lit(',"'), seal, F.lit('"]'))

    def value(parts: Column) -> Column:
        closed = F.try_variant_get(parts, "$[1]", "string") == seal
        more = F.try_variant_get(parts, "$[2]", "variant").isNotNull()
        return F.when(closed & ~more, F.try_variant_get(parts, "$[0]", "variant"))

    return let(F.try_parse_json(sealed), value)


def is_object(value: Column) -> Column:
    return F.startswith(F.schema_of_variant(value), F.lit("OBJECT"))


def is_empty_object(value: Column) -> Column:
    return F.to_json(value) == "{}"


def security_issue_count(report: Column) -> Column:
    """Length of ``results`` in a scanner report; 0 for no or broken JSON."""
    parsed = strict_json(finite_numbers(report))
    results = F.try_variant_get(parsed, "$.results", "array<variant>")
    return F.coalesce(F.size(results), F.lit(0))
