"""Document quality rules: a table of thresholds compiled into one Spark projection.

All measures are built-in functions over the words, lines and three-word windows
of a text; no user function runs. Rows are never shuffled.

Defined results: a NULL or empty text has no words and fails; lines and windows
that repeat count each time after (lines) or every time (windows) they occur;
other columns of the frame, whatever their names, are carried along untouched by
``apply_rules`` and dropped by the query.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surtscope.llm.common import SPACE_CLASS, WORD_PATTERN
from surtscope.operators.fences import computed_once

_WORK = "__quality_rules"

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to a in is it that for on with as are was be by this or an "
    "de la le les et des en un une que est pour dans qui du "
    "der die das und den von zu mit ist nicht im dem auf "
    "el los las y por con del se para una"
).split()


@dataclass(frozen=True)
class Rule:
    """``low <= measure <= high`` must hold; a bound of None is open. ``unless`` names a
    measure and a bound; texts beyond it are not asked."""

    measure: str
    low: float | None = None
    high: float | None = None
    unless: tuple[str, float] | None = None


#: The default table. Measures are the names that ``measures`` makes.
RULES = (
    Rule("n_words", 50, None),
    Rule("mean_word_chars", 2, 20),
    Rule("symbol_ratio", None, 0.25),
    # the stop words are of languages in Latin script
    Rule("stop_word_ratio", 0.01, None, ("other_script_ratio", 0.5)),
    Rule("repeat_word_ratio", None, 0.5),
    Rule("dup_line_ratio", None, 0.6),
    Rule("ellipsis_line_ratio", None, 0.5),
    Rule("bullet_line_ratio", None, 0.9),
)


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _repeat_words(sorted_windows: Column) -> Column:
    """Words covered by windows that occur more than once.

    ``sorted_windows`` holds (hash, position) by hash; equal neighbours repeat.
    Each repeated window adds the words that the one before it does not cover.
    """
    s = sorted_windows
    same = lambda w, k: (F.get(s, k - 1).h == w.h) | F.coalesce(F.get(s, k + 1).h == w.h, F.lit(False))
    repeated = F.filter(s, lambda w, k: F.when(k == 0, F.coalesce(F.get(s, k + 1).h == w.h, F.lit(False))).otherwise(same(w, k)))
    positions = F.array_sort(F.transform(repeated, lambda w: w.i))
    return F.aggregate(
        positions,
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a.n + F.least(F.lit(3), p - a["last"])).alias("n")),
        lambda a: a.n,
    )


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` plus a struct column of measures of ``text``.

    Windows are told apart by 64-bit xxHash of their words.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn(_WORK, F.struct(body.alias("body")))
    field = lambda name: F.col(f"{_WORK}.{name}")
    step = df.withColumns(
        {
            f"{_WORK}_words": F.regexp_extract_all(field("body"), F.lit(f"({WORD_PATTERN})"), F.lit(1)),
            f"{_WORK}_lines": F.filter(
                F.split(field("body"), "\n", -1), lambda line: line.rlike(f"[^{SPACE_CLASS}]")
            ),
        }
    )
    words, lines = F.col(f"{_WORK}_words"), F.col(f"{_WORK}_lines")
    step = step.withColumn(
        f"{_WORK}_windows",
        F.slice(
            F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))),
            F.lit(1),
            F.greatest(F.size(words) - 2, F.lit(0)),
        ),
    )
    windows = F.col(f"{_WORK}_windows")
    step = step.withColumn(
        f"{_WORK}_sorted",
        F.when(
            F.size(F.array_distinct(windows)) < F.size(windows),
            F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    n_words = F.size(words).cast("long")
    n_lines = F.size(lines).cast("long")
    stop = F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS)))
    found = F.struct(
        n_words.alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count(field("body"), F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (n_lines - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.coalesce(_repeat_words(F.col(f"{_WORK}_sorted")), F.lit(0)).cast("long").alias("n_repeat_words"),
        n_lines.alias("n_lines"),
        stop.cast("long").alias("n_stop_words"),
        F.regexp_count(field("body"), F.lit(r"[^\x00-\u024F]")).cast("long").alias("n_other_script"),
        F.size(F.filter(lines, lambda x: x.rlike(rf"(\.\.\.|…)[{SPACE_CLASS}]*$"))).cast("long").alias("n_ellipsis_lines"),
        F.size(F.filter(lines, lambda x: x.rlike(rf"^[{SPACE_CLASS}]*[-*•]"))).cast("long").alias("n_bullet_lines"),
    )
    step = step.withColumn(f"{_WORK}_found", found)
    m = lambda name: F.col(f"{_WORK}_found.{name}")
    ratios = F.struct(
        F.col(f"{_WORK}_found.*"),
        _ratio(m("word_chars"), m("n_words")).alias("mean_word_chars"),
        _ratio(m("n_symbols"), m("n_words")).alias("symbol_ratio"),
        _ratio(m("n_stop_words"), m("n_words")).alias("stop_word_ratio"),
        _ratio(m("n_other_script"), m("word_chars")).alias("other_script_ratio"),
        _ratio(m("n_repeat_words"), m("n_words")).alias("repeat_word_ratio"),
        _ratio(m("n_dup_lines"), m("n_lines")).alias("dup_line_ratio"),
        _ratio(m("n_ellipsis_lines"), m("n_lines")).alias("ellipsis_line_ratio"),
        _ratio(m("n_bullet_lines"), m("n_lines")).alias("bullet_line_ratio"),
    )
    extra = [f"{_WORK}_words", f"{_WORK}_lines", f"{_WORK}_windows", f"{_WORK}_sorted", f"{_WORK}_found"]
    return computed_once(step.drop("quality_measures"), {"quality_measures": ratios}).drop(_WORK, *extra)


def compile_rules(rules: tuple[Rule, ...], measure) -> Column:
    """One boolean column: every rule of the table holds."""
    verdict = F.lit(True)
    for rule in rules:
        value, holds = measure(rule.measure), F.lit(True)
        if rule.low is not None:
            holds = holds & (value >= F.lit(rule.low))
        if rule.high is not None:
            holds = holds & (value <= F.lit(rule.high))
        if rule.unless is not None:
            holds = holds | (measure(rule.unless[0]) > F.lit(rule.unless[1]))
        verdict = verdict & holds
    return verdict


def apply_rules(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``df`` with ``quality_measures`` and ``quality_verdict``."""
    return measures(df, text).withColumn(
        "quality_verdict", compile_rules(rules, lambda name: F.col(f"quality_measures.{name}"))
    )


def quality_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: base measures, base_failed and kept."""
    scored = apply_rules(docs.select("doc_id", "text"), "text", rules)
    m = lambda name: F.col(f"quality_measures.{name}")
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    failed = (m("n_words") < 50) | (100 * m("n_repeat_words") > 50 * m("n_words"))
    return scored.select(
        "doc_id",
        *(m(c).alias(c) for c in base),
        failed.alias("base_failed"),
        (~failed & F.col("quality_verdict")).alias("kept"),
        *(m(c).alias(c) for c in ("mean_word_chars", "symbol_ratio", "stop_word_ratio", "dup_line_ratio")),
    )
