"""JSON text as Python writes it: two-space indent, ASCII, keys in written order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions.let import let
from tallyforge.functions.python_text import float_text

_TOKEN = r'"(?:[^"\\]++|\\.)*+"|[{}\[\],:]|[^\s{}\[\],:"]++'
_ESCAPED = r"\\u[0-9A-Fa-f]{4}|\\.|[^\\]++"
_PLAIN = r"^[ !#-\[\]-~]*\z"
INDENT = "  "


def json_string(text: Column) -> Column:
    """`text` as a JSON string, quotes included; NULL stays NULL."""
    # Escapes and code points are Jackson's, but for lower-case hex digits and DEL.
    ascii_only = {"writeNonAsciiCharacterAsCodePoint": "true"}
    quoted = F.to_json(F.array(text), ascii_only)
    inner = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    parts = F.transform(
        F.regexp_extract_all(inner, F.lit(_ESCAPED), F.lit(0)),
        lambda p: F.when(F.startswith(p, F.lit("\\u")), F.lower(p)).otherwise(p),
    )
    escaped = F.replace(F.array_join(parts, ""), F.lit("\x7f"), F.lit("\\u007f"))
    plain = F.concat(F.lit('"'), text, F.lit('"'))
    return F.when(text.rlike(_PLAIN), plain).when(text.isNotNull(), escaped)


def _scalar(token: Column) -> Column:
    """A string, number or word of JSON text."""
    text = F.from_json(F.concat(F.lit("["), token, F.lit("]")), "array<string>")[0]
    body = F.substring(token, F.lit(2), F.length(token) - 2)
    string = F.when(body.rlike(_PLAIN), token).otherwise(json_string(text))
    is_float = token.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$") & token.rlike(r"[.eE]")
    number = float_text(token.try_cast("double").cast("string"))
    return (
        F.when(F.startswith(token, F.lit('"')), string)
        .when(is_float, number).otherwise(token)
    )


def indented_json(text: Column) -> Column:
    """A JSON text with each entry on a line of its own; NULL stays NULL.

    Keys keep their written order, equal keys stay as written, empty objects and lists
    stay on one line, fractions are written as doubles.  `text` has to be JSON.  Depths
    take time that grows with the square of the number of entries, not with the length
    of their texts.
    """
    opening, closing = F.array(F.lit("{"), F.lit("[")), F.array(F.lit("}"), F.lit("]"))

    def is_open(t):
        return F.coalesce(F.array_contains(opening, t), F.lit(False))

    def is_close(t):
        return F.coalesce(F.array_contains(closing, t), F.lit(False))

    def step(t):
        return F.when(is_open(t), 1).when(is_close(t), -1).otherwise(0)

    def written(bound):
        tokens, depths = bound["tokens"], bound["depths"]

        def new_line(i):
            return F.concat(F.lit("\n"), F.repeat(F.lit(INDENT), F.get(depths, i)))

        def token(t, i):
            before, after = F.get(tokens, i - 1), F.get(tokens, i + 1)
            return (
                F.when(is_open(t), F.when(is_close(after), t).otherwise(F.concat(t, new_line(i))))
                .when(is_close(t), F.when(is_open(before), t).otherwise(F.concat(new_line(i), t)))
                .when(t == ",", F.concat(t, new_line(i)))
                .when(t == ":", F.lit(": "))
                .otherwise(_scalar(t))
            )

        return F.array_join(F.transform(tokens, token), "")

    def with_depths(tokens):
        # The depth after each token: how many objects and lists are open.
        depths = F.aggregate(
            tokens, F.array().cast("array<int>"),
            lambda seen, t: F.array_append(
                seen, F.coalesce(F.try_element_at(seen, F.lit(-1)), F.lit(0)) + step(t)
            ),
        )
        return let(F.struct(tokens.alias("tokens"), depths.alias("depths")), written)

    return let(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), with_depths)
