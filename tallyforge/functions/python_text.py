"""How Python prints a value that it has read from JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions.json import STRING_OR_REST
from tallyforge.functions.let import let

# What Python writes for JSON's three words, and its escapes within strings.
WORDS = {"true": "True", "false": "False", "null": "None"}
ESCAPES = {"\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def raw_fields(object_text: Column) -> Column:
    """``array<struct<key, value>>`` of a JSON object: each value's own text, strings unquoted."""
    return F.map_entries(F.from_json(object_text, "map<string,string>"))


def raw_field(fields: Column, name: Column | str) -> Column:
    """The last value written for a key, as a reader in Python has it."""
    named = F.filter(fields, lambda f: f["key"] == name)
    return F.try_element_at(named, F.lit(-1))["value"]


def float_text(number: Column) -> Column:
    """A float as Python writes it, from the JVM's text: an exponent only from 1e16 on or
    below 1e-4, with sign and two digits."""
    parts = F.split(number, "E")

    def written(p: Column) -> Column:
        power = p[1].cast("int")
        digits = F.rtrim(number.try_cast("decimal(38,22)").cast("string"), F.lit("0"))
        plain = F.when(F.endswith(digits, F.lit(".")), F.concat(digits, F.lit("0"))).otherwise(digits)
        sign = F.when(power < 0, F.lit("-")).otherwise(F.lit("+"))
        short = F.concat(
            F.regexp_replace(p[0], r"\.0$", ""), F.lit("e"), sign,
            F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")),
        )
        return F.when(power.between(-4, 15), plain).otherwise(short)

    return F.when(F.contains(number, F.lit("E")), let(parts, written)).otherwise(number)


def _string(token: Column) -> Column:
    """A JSON string as Python prints it inside a list: the quotes that need no escape."""
    text = F.from_json(F.concat(F.lit("["), token, F.lit("]")), "array<string>")[0]

    def quoted(t: Column) -> Column:
        body = t
        for plain, escaped in ESCAPES.items():
            body = F.replace(body, F.lit(plain), F.lit(escaped))
        double = F.contains(t, F.lit("'")) & ~F.contains(t, F.lit('"'))
        single = F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'"))
        return F.when(double, F.concat(F.lit('"'), body, F.lit('"'))).otherwise(single)

    return let(text, quoted)


def container_text(json_text: Column) -> Column:
    """A list or object, from its JSON text without white space between values."""

    def rest(token: Column) -> Column:
        for word, python in WORDS.items():
            token = F.replace(token, F.lit(word), F.lit(python))
        return F.replace(F.replace(token, F.lit(","), F.lit(", ")), F.lit(":"), F.lit(": "))

    tokens = F.regexp_extract_all(json_text, F.lit(STRING_OR_REST), F.lit(0))
    return F.array_join(F.transform(
        tokens, lambda t: F.when(F.startswith(t, F.lit('"')), _string(t)).otherwise(rest(t))
    ), "")


def python_text(value: Column, raw: Column) -> Column:
    """Text of a VARIANT value as Python prints it; NULL for no value.

    `raw` is the value as it was written (see `raw_fields`): a VARIANT holds 5.0 as 5 and
    sorts an object's keys.
    """
    kind = F.schema_of_variant(value)
    held = value.try_cast("string")
    # Where the raw text cannot be had, the VARIANT's stands in.
    text = F.coalesce(raw, held)
    return (
        F.when(kind == "VOID", F.lit("None"))
        .when(kind == "STRING", held)
        .when(kind == "BOOLEAN", F.initcap(held))
        .when(F.startswith(kind, F.lit("ARRAY")) | F.startswith(kind, F.lit("OBJECT")), container_text(text))
        .otherwise(float_text(text))
    )
