"""Document quality by gradient-boosted trees over text statistics.

The trees are fitted to a bounded sample of the labelled rows; every document is then scored whole,
next to the scan, in Arrow batches.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docledger.llm.quality_rules import STOP_WORDS
from docledger.llm.trees import Forest, fit_forest

#: Labelled rows the trees are fitted to, at most (in expectation); they are drawn by hash.
SAMPLE_ROWS = 20_000
FOLDS, HELD_OUT = 3, 1

_STOPS = frozenset(word.encode() for word in STOP_WORDS)
_SYMBOLS, _DIGITS, _STOP_MARKS = b"#*$%&|<>=_~^{}[]", b"0123456789", b".,;:!?"
_UPPER = bytes(range(0x41, 0x5B))
#: Statistics of a text, in the order of the matrix.
FEATURES = (
    "log_words", "mean_word_bytes", "longest_word", "symbols_per_word", "bars_per_word", "digit_share", "upper_share",
    "marks_per_word", "shouts_per_word", "stop_share", "distinct_share", "top_word_share", "stutter_share",
    "distinct_pair_share", "repeated_line_share", "words_per_line", "log_lines", "non_ascii_share", "lone_letter_share",
)


def _without(text: bytes, marks: bytes) -> int:
    return len(text) - len(text.translate(None, marks))


def statistics(text: bytes) -> list[float]:
    words = text.split()
    n, size = max(1, len(words)), max(1, len(text))
    lines = [line for line in text.split(b"\n") if line.strip()]
    counts = Counter(words)
    pairs = max(1, len(words) - 1)
    return [
        math.log1p(len(words)), sum(map(len, words)) / n, max(map(len, words), default=0), _without(text, _SYMBOLS) / n,
        text.count(b"|") / n, _without(text, _DIGITS) / size, _without(text, _UPPER) / size,
        _without(text, _STOP_MARKS) / n, text.count(b"!!") / n, sum(map(_STOPS.__contains__, words)) / n,
        len(counts) / n, max(counts.values(), default=0) / n, sum(map(bytes.__eq__, words, words[1:])) / pairs,
        len(set(zip(words, words[1:]))) / pairs, 1 - len(set(lines)) / max(1, len(lines)), len(words) / max(1, len(lines)),
        math.log1p(len(lines)), (len(text) - len(text.decode("utf-8", "ignore"))) / size,
        sum(len(word) == 1 for word in words) / n,
    ]


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def text_statistics(texts: pa.Array) -> pa.Array:
    return pa.array([statistics(text.as_py() or b"") for text in texts.cast(pa.binary())], pa.list_(pa.float64()))


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text, modulo 3, is 1 (never so without id)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, *, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> Forest:
    """Trees fitted to a hash sample of the labelled rows that are not held out.

    Repeated labels of one document count once (the larger), null labels and ids not at all. The
    sample is the only thing that reaches the driver: ``sample_rows`` rows of statistics.
    """
    usable = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("quality").alias("quality"))
    )
    total = max(1, usable.count())
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 4)
    sample = usable.where(place < int(2**60 * min(1.0, sample_rows / total)))
    learned = docs.select("doc_id", text).join(F.broadcast(sample), "doc_id")
    first = learned.groupBy("doc_id").agg(F.min(text).alias(text), F.first("quality").alias("quality"))
    rows = first.select(text_statistics(text).alias("row"), "quality", "doc_id").orderBy("doc_id").collect()
    matrix = np.array([row.row for row in rows], float).reshape(len(rows), len(FEATURES))
    return fit_forest(matrix, np.array([row.quality for row in rows], float))


def score_quality(docs: DataFrame, forest: Forest, *, text: str = "text") -> DataFrame:
    """``docs`` with score (chance of label 1) and predicted (1 from 0.5 on); null texts count as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        rows = np.array([statistics(value.as_py() or b"") for value in texts.cast(pa.binary())], float)
        return pa.array(shared.value.score(rows.reshape(-1, len(FEATURES))), pa.float64())

    return docs.withColumn("score", score(text)).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
