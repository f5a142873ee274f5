"""Judge verdicts: an object of model -> marks plus three reserved keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions.json import is_object
from tallyforge.functions.let import let
from tallyforge.functions.python_text import python_text, raw_field
from tallyforge.settings import RESERVED_VERDICT_KEYS

# Texts of a failed text evaluation.
FAILED_TEXT = "Failed to evaluate text"
NO_JSON = "No valid JSON in judge output"
BAD_JSON = "Invalid JSON in judge output"


def model_entries(parsed: Column) -> Column:
    """``map<model, variant>`` without the reserved keys."""
    entries = parsed.try_cast("map<string,variant>")
    return F.map_filter(entries, lambda k, _: ~k.isin(*RESERVED_VERDICT_KEYS))


def all_entries_are_objects(parsed: Column) -> Column:
    others = F.map_filter(
        parsed.try_cast("map<string,variant>"),
        lambda k, v: ~k.isin(*RESERVED_VERDICT_KEYS) & ~is_object(v),
    )
    return F.size(others) == 0


def field(parsed: Column, name: str) -> Column:
    """A top-level field as text; NULL when absent or null."""
    return F.try_variant_get(parsed, f"$.{name}", "string")


def truthy(value: Column) -> Column:
    """True for a VARIANT that Python counts as true: no null, zero, false or empty value."""
    kind = F.schema_of_variant(value)
    text = value.try_cast("string")
    held = (
        F.when(kind == "STRING", text != "")
        .when(kind == "BOOLEAN", text == "true")
        .when(F.startswith(kind, F.lit("ARRAY")), text != "[]")
        .when(F.startswith(kind, F.lit("OBJECT")), text != "{}")
        .otherwise(value.try_cast("double") != 0)
    )
    return F.coalesce(held, F.lit(False))


def told(value: Column, fields: Column, name: str) -> Column:
    """A field as Python prints it where it is truthy, else empty.

    `fields` are the raw fields of the object `value` (`raw_fields` of its text).
    """
    held = F.try_variant_get(value, f"$.{name}", "variant")
    return let(held, lambda v: F.when(truthy(v), python_text(v, raw_field(fields, name))).otherwise(F.lit("")))


def shown(entry: Column, fields: Column, name: str, default: str = "N/A") -> Column:
    """A mark as a report prints it; an absent one prints as `default`."""
    raw = F.try_variant_get(entry, f"$.{name}", "variant")
    return let(raw, lambda v: F.when(v.isNull(), F.lit(default)).otherwise(
        F.coalesce(python_text(v, raw_field(fields, name)), F.lit("None"))
    ))


def mark(entry: Column, name: str) -> Column:
    """A mark as a number; judges also write 4.5 or "5"."""
    return F.try_variant_get(entry, f"$.{name}", "double")


def text_failure(json_text: Column, parsed: Column) -> Column:
    """Why a text verdict fails, or NULL when it holds."""
    return (
        F.when(json_text.isNull(), F.lit(NO_JSON))
        .when(parsed.isNull(), F.lit(BAD_JSON))
        .when(~all_entries_are_objects(parsed), F.lit("A model entry is not an object"))
    )


def key_order(json_text: Column) -> Column:
    """Keys of the verdict in written order (VARIANT sorts them)."""
    return F.array_distinct(F.json_object_keys(json_text))


def models_in_order(json_text: Column) -> Column:
    return F.filter(key_order(json_text), lambda k: ~k.isin(*RESERVED_VERDICT_KEYS))
