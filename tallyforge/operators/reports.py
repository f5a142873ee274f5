"""Console reports as rows of lines, built per row without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import verdict as V
from tallyforge.functions.let import let
from tallyforge.functions.python_text import python_text, raw_field, raw_fields
from tallyforge.functions.scoring import EVALUATED
from tallyforge.functions.text import category_label, model_label
from tallyforge.operators.binding import bind
from tallyforge.operators.winners import runner_up_in_order
from tallyforge.settings import CODE_CATEGORIES, RESERVED_VERDICT_KEYS, ScoreWeights


def _line(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _lines_if(condition: Column, *lines: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.when(F.coalesce(condition, F.lit(False)), F.array(*lines)).otherwise(none)


def _outcome(models: Column) -> Column:
    """Lines on the judge's winner and on the runner-up."""
    winner = F.col(RESERVED_VERDICT_KEYS[0])
    why, why_not = (V.told(F.col("parsed"), F.col("fields"), n) for n in RESERVED_VERDICT_KEYS[1:])
    loser = runner_up_in_order(models, winner)
    return F.concat(
        _lines_if((winner != "") & (why != ""), _line("WINNER (", winner, "):"), _line("   ", why)),
        _lines_if(
            (why_not != "") & (loser != ""), _line("RUNNER-UP (", loser, "):"), _line("   ", why_not)
        ),
    )


def text_report(
    verdicts: DataFrame, models: str = "models", weights: ScoreWeights = ScoreWeights()
) -> DataFrame:
    """(prompt_id, line_no, line) of the held text verdicts.

    `verdicts` comes from `parse_text_verdicts` and has an array of the answering
    models in order.
    """
    entries = V.model_entries(F.col("parsed"))
    scale = f"/{weights.mark_scale}"

    def block(model: Column) -> Column:
        entry = F.col("entries")[model]
        return let(raw_fields(raw_field(F.col("fields"), model)), lambda raw: F.concat(
            F.array(
                _line(model_label(model), " ANALYSIS:"),
                _line("   Correctness: ", V.shown(entry, raw, "correctness"), scale),
                _line("   Relevance: ", V.shown(entry, raw, "relevance"), scale),
            ),
            let(
                V.told(entry, raw, "reasoning"),
                lambda told: _lines_if(told != "", _line("   Reasoning: ", told)),
            ),
        ))

    lines = F.concat(
        F.array(F.lit("JUDGE'S DETAILED ANALYSIS")),
        F.flatten(F.transform(V.models_in_order(F.col("json_text")), block)),
        _outcome(F.col(models)),
    )
    held = bind(
        verdicts.filter(F.col("status") == EVALUATED), entries=entries,
        fields=raw_fields(F.col("json_text")),
    )
    return held.select("prompt_id", F.posexplode(lines).alias("line_no", "line"))


def code_report(verdicts: DataFrame) -> DataFrame:
    """(prompt_id, line_no, line) of code verdicts joined with their `results` map.

    Metrics appear for verdict models that have a score row; a verdict may name
    models nobody ran.
    """
    entries = V.model_entries(F.col("parsed"))

    def metrics(model: Column) -> Column:
        return let(F.try_element_at(F.col("results"), model), metric_lines)

    def metric_lines(row: Column) -> Column:
        evaluated = row["status"] == EVALUATED

        def known(value: Column) -> Column:
            return F.coalesce(value.cast("string"), F.lit("N/A"))

        style = row["style"]
        return _lines_if(
            row.isNotNull(),
            _line("   Final Score: ",
                  F.when(evaluated, row["score"].cast("double").cast("string")).otherwise(F.lit("0"))),
            _line("   Tests: ", F.coalesce(row["tests"]["passed"], F.lit(0)).cast("string"),
                  " passed, ", F.coalesce(row["tests"]["failed"], F.lit(0)).cast("string"), " failed"),
            _line("   Style Score: ", known(style["style_score"])),
            _line("   Pylint: ", known(style["pylint_score"]), "/10"),
            _line("   Complexity: ", known(style["average_complexity"])),
            _line("   Security Issues: ", known(row["lint"]["security_issues"])),
        )

    def categories(model: Column) -> Column:
        # Only an object casts to a map and has keys.
        texts = F.try_element_at(F.col("entries"), model).try_cast("map<string,variant>")
        raw_entry = raw_field(F.col("fields"), model)
        written = F.json_object_keys(raw_entry)
        known = F.filter(F.array_distinct(written), lambda k: k.isin(*CODE_CATEGORIES))

        def lines(of: Column) -> Column:
            named = F.transform(known, lambda k: F.struct(
                F.try_element_at(of, k).alias("value"), k.alias("name"),
                raw_field(raw_fields(raw_entry), k).alias("raw"),
            ))
            told = F.filter(named, lambda l: V.truthy(l["value"]))
            return F.transform(
                told, lambda l: _line(
                    "   ", category_label(l["name"]), ": ", python_text(l["value"], l["raw"])
                )
            )

        return F.coalesce(let(texts, lines), F.array().cast("array<string>"))

    def block(model: Column) -> Column:
        return F.concat(
            F.array(_line(model_label(model), " ANALYSIS:")), metrics(model), categories(model)
        )

    blocks = F.flatten(F.transform(
        F.filter(V.models_in_order(F.col("json_text")),
                 lambda m: F.map_contains_key(F.col("entries"), m)),
        block,
    ))
    lines = F.concat(
        F.array(F.lit("JUDGE'S DETAILED CODE ANALYSIS")),
        F.coalesce(blocks, F.array().cast("array<string>")),
        _outcome(F.map_keys(F.col("results"))),
    )
    opened = bind(verdicts, entries=entries, fields=raw_fields(F.col("json_text")))
    return opened.select("prompt_id", F.posexplode(lines).alias("line_no", "line"))


def tally_lines(tally: DataFrame) -> DataFrame:
    """The batch summary, one line per model that won, in order of first win."""
    return tally.select(
        "first_win",
        _line(F.col("winner"), ": ", F.col("wins").cast("string"), " wins").alias("line"),
    )


def response_listing(responses: DataFrame) -> DataFrame:
    """Each answer under its model's name and over a rule."""
    return responses.select(
        "prompt_id", "model_pos",
        _line(F.col("model"), ":\n", F.col("response"), "\n", F.repeat(F.lit("-"), F.lit(40)))
        .alias("listing"),
    )
