"""Quality rules: a threshold table compiled into one projection of text statistics.

Only built-in functions are used, so the rules run next to the scan without a shuffle. Repeated
5-word windows are first looked for by hash: a text whose window hashes are all different has none,
and only the others compare the windows themselves, sorted, neighbour by neighbour.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger.llm.common import SPACE, keep_columns, own, private, settled, words

WINDOW = 5

# Frequent function words of the supported languages, lower case.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the",
    "this", "to", "was", "with",
    "als", "auch", "auf", "aus", "bei", "das", "dem", "den", "der", "des", "die", "ein", "eine", "für", "im", "ist",
    "mit", "nicht", "sich", "und", "von", "zu",
    "au", "ce", "dans", "de", "du", "elle", "en", "est", "et", "il", "la", "le", "les", "ne", "par", "pas", "pour",
    "que", "qui", "sur", "un", "une",
    "al", "como", "con", "del", "el", "las", "lo", "los", "más", "no", "para", "por", "se", "su", "una", "y",
)


class Rule(NamedTuple):
    """A text of at least ``from_words`` words fails if ``metric`` leaves [low, high]."""

    name: str
    metric: str
    low: float | None
    high: float | None
    from_words: int = 0


RULES = (
    Rule("word_length", "mean_word_chars", 2.0, 15.0),
    Rule("symbols", "symbol_ratio", None, 0.25),
    Rule("repeated_lines", "dup_line_ratio", None, 0.5),
    Rule("stop_words", "stop_ratio", 0.02, None, from_words=50),
)
METRICS = ("mean_word_chars", "symbol_ratio", "dup_line_ratio", "stop_ratio")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """Names of the failed rules, as one expression over the metric columns."""
    checks = []
    for rule in rules:
        bounds = F.lit(False)
        if rule.low is not None:
            bounds = bounds | (F.col(rule.metric) < rule.low)
        if rule.high is not None:
            bounds = bounds | (F.col(rule.metric) > rule.high)
        checks.append(F.when((F.col("n_words") >= rule.from_words) & bounds, F.lit(rule.name)))
    return F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")


def _repeated(df: DataFrame, window: int) -> DataFrame:
    """Adds n_repeat_words: words inside windows that occur twice or more, each word once."""
    last = F.col("n_words") - window
    hashes = F.transform(F.sequence(F.lit(0), last), lambda at: F.xxhash64(F.slice("_words", at + 1, window)))
    suspect = F.when(last >= 1, F.size(F.array_distinct(hashes)) <= last).otherwise(False)
    ordered = F.sort_array(F.transform(
        F.sequence(F.lit(0), last), lambda at: F.struct(F.slice("_words", at + 1, window).alias("run"), at.alias("at"))
    ))
    neighbours = F.zip_with(
        F.slice("_runs", 1, F.size("_runs") - 1), F.slice("_runs", 2, F.size("_runs") - 1),
        lambda a, b: F.when(a["run"] == b["run"], F.array(a["at"], b["at"])),
    )
    starts = F.sort_array(F.array_distinct(F.flatten(F.array_compact(neighbours))))
    covered = F.aggregate(
        starts, F.struct(F.lit(0).alias("total"), F.lit(-window).alias("last")),
        lambda seen, at: F.struct((seen["total"] + F.least(F.lit(window), at - seen["last"])).alias("total"), at.alias("last")),
        lambda seen: seen["total"],
    )
    return (
        df.withColumn("_runs", F.when(suspect, ordered))
        .withColumn("n_repeat_words", settled(F.when(F.col("_runs").isNotNull(), covered).otherwise(0).cast("bigint")))
        .drop("_runs")
    )


def apply_rules(docs: DataFrame, *, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with the counts, base_failed, the metrics, failed_rules and kept.

    A null or empty text has no words, fails the base and is not kept; all its counts and ratios are
    zero. Rows are judged one by one, so repeated rows get equal verdicts. Columns of ``docs`` named
    like a result are replaced, the text's own among them; all others stay, whatever they are called.
    """
    names = keep_columns(docs, {*COUNTS, *METRICS, "base_failed", "failed_rules", "kept"})
    kept, said = [f"`{own(name)}`" for name in names], F.col(f"`{own(text)}`")
    value = F.coalesce(said, F.lit(""))
    worded = private(docs).select(*kept, value.alias("_text"), words(said).alias("_words"))
    lines = F.filter(F.split("_text", "\n"), lambda line: line.rlike(f"[^{SPACE}]"))
    counted = worded.withColumns({
        "n_words": F.size("_words"),
        "word_chars": F.length(F.array_join("_words", "")).cast("bigint"),
        "n_symbols": F.regexp_count("_text", F.lit("[#*$%&|<>]")).cast("bigint"),
        "_stops": F.size(F.filter("_words", lambda word: word.isin(*STOP_WORDS))),
        "_lines": lines,
    })
    counted = counted.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"))
    counted = _repeated(counted, WINDOW)

    def ratio(part: str, whole: Column) -> Column:
        return F.when(whole > 0, F.col(part) / whole).otherwise(0.0)

    measured = counted.select(
        *kept, F.col("n_words").cast("bigint").alias("n_words"), *COUNTS[1:],
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
        ratio("word_chars", F.col("n_words")).alias("mean_word_chars"),
        ratio("n_symbols", F.col("n_words")).alias("symbol_ratio"),
        ratio("n_dup_lines", F.size("_lines")).alias("dup_line_ratio"),
        ratio("_stops", F.col("n_words")).alias("stop_ratio"),
    )
    failed = measured.withColumn("failed_rules", compile_rules(rules))
    judged = failed.withColumn("kept", settled(~F.col("base_failed") & (F.size("failed_rules") == 0)))
    return judged.toDF(*names, *judged.columns[len(names):])
