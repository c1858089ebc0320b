"""Toxicity of texts whose words may be disguised.

A disguised word is seen as sent over a noisy channel: letters come out as digits or signs, are
repeated, or are torn apart by spaces and punctuation. Every such token is a lattice of the letters
it may stand for; Viterbi finds the likeliest reading under a letter-trigram model counted over the
whole corpus. A logistic model then scores the restored words.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docledger.session import cut_lineage

#: Labelled rows the weights are fitted to, at most (in expectation); they are drawn by hash.
SAMPLE_ROWS = 20_000
#: Words and word beginnings that may carry a weight, and how sure their tie to the label must be (a G² statistic).
TERMS, LEAST_G2 = 4096, 15.0
FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3
#: Letters of a word's beginning.
STEM = 5
#: Different tokens a task remembers the reading of.
REMEMBERED = 300_000

# The letters a sign may stand for.
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i",
    "|": "il", "+": "t", "(": "c", "<": "c", "*": "aeiou", "#": "h", "€": "e", "£": "l", "¥": "y", "µ": "u",
}
# Fixed value: signs that are common marks too, so that they are as easily put in as others.
MARKS = "!|(<*#+"
# Costs of the channel, in nats: a sign for a letter, letters repeated, a double for a single, a mark put in, a sign or digit put in.
SIGN_COST, REPEAT_COST, DOUBLE_COST, MARK_COST, SIGN_GAP_COST = 1.0, 1.5, 4.0, 1.0, 12.0

_LETTERS = {chr(97 + k): k + 1 for k in range(26)}
_SIGN = re.escape("".join(SIGNS))
#: A token of letters alone, but for marks around it; readings start only where this fails.
_PLAIN = re.compile(r"[^\w@$€£¥+(<*#]*([a-z]+)[^\w]*")
_ACCENT = re.compile("[\u0300-\u036f]+")
_TRIPLE = re.compile(r"(.)\1\1")
_SPACED = re.compile(rf"\s((?:[a-z{_SIGN}][.,_~-]?\s+){{2,}}[a-z{_SIGN}][.,_~-]?)(?=\s)")
_WIDTH = 27
_EDGE = np.zeros(2, np.int32)
#: Characters counted at once.
_PIECE = 1 << 20


def fold(text: str) -> str:
    """Case and accents folded; letters that have no Latin base stay as they are."""
    if text.isascii():
        return text.lower()
    return _ACCENT.sub("", unicodedata.normalize("NFKD", text.casefold()))


# ---------------------------------------------------------------- letter model
def count_letters(text: str) -> np.ndarray:
    """Counts of letter trigrams of folded text; a word stands between boundaries (code 0)."""
    codes = np.frombuffer(fold(text).encode("utf-32-le"), np.int32) - 96
    codes = np.concatenate([_EDGE, np.where((codes >= 1) & (codes <= 26), codes, 0), _EDGE[:1]])
    one, two = codes[1:-1], codes[:-2]
    now = codes[2:]
    used = (one > 0) | (now > 0)  # of several boundaries in a row the first counts
    cells = (np.where(one > 0, two, 0) * _WIDTH + one) * _WIDTH + now
    return np.bincount(cells[used], minlength=_WIDTH**3)


def letter_counts(docs: DataFrame, *, text: str = "text") -> np.ndarray:
    """Trigram counts over every whole text: a task sums its own, Spark adds the tasks' up.

    The table has 27³ cells however large the corpus is; that is all the driver sees.
    """
    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_WIDTH**3, np.int64)
        waiting, size = [], 0
        for batch in batches:
            for value in batch.column(0):
                waiting.append(value.as_py() or "")
                size += len(waiting[-1])
                if size >= _PIECE:
                    total += count_letters("\n".join(waiting))
                    waiting, size = [], 0
        total += count_letters("\n".join(waiting))
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(total[cells], pa.int64())], ["cell", "n"])

    counts = np.zeros(_WIDTH**3, np.int64)
    for row in docs.select(F.col(text).alias("text")).mapInArrow(per_task, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        counts[row["cell"]] = row["n"]
    return counts


def letter_costs(counts: np.ndarray) -> list[float]:
    """-log P(letter | two before), each order smoothed by the one below it with the weight of its variety."""
    tri = counts.reshape(_WIDTH, _WIDTH, _WIDTH).astype(float)

    def smooth(level: np.ndarray, below: np.ndarray) -> np.ndarray:
        kinds = np.maximum(1, (level > 0).sum(axis=-1, keepdims=True))
        return (level + kinds * below) / (level.sum(axis=-1, keepdims=True) + kinds)

    uni = smooth(tri.sum(axis=(0, 1)), np.full(_WIDTH, 1 / _WIDTH))
    two = smooth(tri.sum(axis=0), uni[None, :])
    return (-np.log(smooth(tri, two[None, :, :]))).ravel().tolist()


# ---------------------------------------------------------------- lattice
def _options(char: str, run: int) -> list[tuple[str, float]]:
    """What a run of one character may stand for, with the channel's cost. A blank is a boundary."""
    if char in _LETTERS:
        found = [(char, (0.0, DOUBLE_COST, REPEAT_COST)[min(run, 3) - 1])]
        if run > 1:
            found.append((char * 2, 0.0 if run == 2 else REPEAT_COST))
        return found
    found = [(letter * times, SIGN_COST * times) for letter in SIGNS.get(char, "") for times in range(1, min(run, 2) + 1)]
    gap = SIGN_GAP_COST if char in SIGNS and char not in MARKS else MARK_COST
    return [*found, ("", gap), (" ", gap - MARK_COST)]


def decode(token: str, costs: list[float]) -> str:
    """The likeliest reading of a folded token, words apart by a blank; exact Viterbi over the last two letters.

    Linear in the token's length. Characters that are neither letters nor signs are gaps.
    """
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    at = 0
    while at < len(token):
        end = at + 1
        while end < len(token) and token[end] == token[at]:
            end += 1
        options = _options(token[at], end - at)
        at, reached = end, {}
        for (two, one), (cost, path) in states.items():
            for written, extra in options:
                first, second, total = two, one, cost + extra
                for letter in written:
                    code = _LETTERS.get(letter, 0)
                    if code or second:  # of several boundaries in a row the first counts
                        total += costs[(first * _WIDTH + second) * _WIDTH + code]
                        first, second = (second, code) if code else (0, 0)
                known = reached.get((first, second))
                if known is None or total < known[0]:
                    reached[first, second] = (total, (written, path) if written else path)
        states = reached
    ends = [(cost + (costs[(two * _WIDTH + one) * _WIDTH] if one else 0.0), path) for (two, one), (cost, path) in states.items()]
    path, parts = min(ends, key=lambda end: end[0])[1], []
    while path is not None:
        parts.append(path[0])
        path = path[1]
    return " ".join("".join(reversed(parts)).split())


def read_token(token: str, costs: list[float]) -> str:
    """Words of a folded token without white space. Tokens without any Latin letter are no disguise and stay."""
    plain = _PLAIN.fullmatch(token)
    if plain and not _TRIPLE.search(plain[1]):
        return plain[1]
    if not any(char in _LETTERS for char in token):
        return token
    if any(char.isalpha() and char not in _LETTERS for char in token):
        return token  # another script
    return decode(token, costs)


def restore(text: str, costs: list[float]) -> str:
    """The folded text with every token read, and runs of three and more single letters or signs read as one."""
    padded = _SPACED.sub(lambda run: " " + decode(run[1], costs) if sum(char in _LETTERS for char in run[1]) > 1 else run[0], f" {fold(text)} ")
    return re.sub(r"\S+", lambda token: read_token(token[0], costs), padded)[1:-1]


class _Reader:
    """Distinct words of texts; readings of tokens are remembered up to a fixed number."""

    def __init__(self, costs: list[float]) -> None:
        self.costs, self.known = costs, {}

    def words(self, text: str) -> Iterator[tuple[str, ...]]:
        folded = fold(text)
        for token in set(folded.split()):
            read = self.known.get(token)
            if read is None:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                read = self.known[token] = self.keep(read_token(token, self.costs).split())
            if read:
                yield read
        for run in _SPACED.finditer(f" {folded} "):
            if sum(char in _LETTERS for char in run[1]) > 1:
                # a word of one letter may stand before or after the one torn apart
                signs = run[1].split()
                for first, last in ((0, 0), (1, 0), (0, 1), (1, 1)):
                    yield self.keep(decode(" ".join(signs[first:len(signs) - last]), self.costs).split())

    def keep(self, words: list[str]) -> tuple:
        return tuple(terms(words))


def terms(words: Iterable[str]) -> list[str]:
    """What can carry a weight: the word, and the beginning of a longer one."""
    return [term for word in words for term in ((word, word[:STEM] + "-") if len(word) > STEM else (word,))]


# ---------------------------------------------------------------- weights
class Toxicity(NamedTuple):
    costs: list[float]  #: of the letter model
    weights: dict[str, float]
    base: float


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text, modulo 4, is 2 (never so without id)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def _fit(rows: list[list[int]], labels: np.ndarray, count: int, *, penalty: float = 0.1, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression on presence by gradient steps of each weight's own length."""
    prior = (labels.sum() + 0.5) / (len(labels) + 1.0)
    weights, base = np.zeros(count), math.log(prior / (1 - prior))
    if not len(labels) or labels.min() == labels.max():
        return weights, base
    owner = np.repeat(np.arange(len(rows)), [len(row) for row in rows])
    term = np.array([k for row in rows for k in row], np.int64)
    widest = max(map(len, rows), default=0) + 1
    curve = np.bincount(term, minlength=count) * widest / 4 + penalty  # bounds the loss's second derivative
    for _ in range(steps):
        chance = 1 / (1 + np.exp(-np.clip(base + np.bincount(owner, weights[term], len(rows)), -500, 500)))
        slope = labels - chance
        # rows hold few terms, so their own share of the curvature is the better bound
        bend = np.maximum(np.bincount(term, (chance * (1 - chance))[owner], count) * 2 + penalty, curve / widest / 8)
        weights += 0.5 * (np.bincount(term, slope[owner], count) - penalty * weights) / bend
        base += 0.5 * slope.sum() / max(1e-9, (chance * (1 - chance)).sum() * 2)
    return weights, float(base)


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> Toxicity:
    """Letter model of all of ``docs``; weights from a hash sample of the labelled rows that are not held out.

    Repeated labels of one document count once (the larger), null labels and ids not at all. Terms
    that toxic documents hold more often are chosen by a G² statistic, at most ``TERMS``; the
    driver sees those terms and which sampled row holds which. Without labels the prior is the score.
    """
    costs = letter_costs(letter_counts(docs, text=text))
    shared = docs.sparkSession.sparkContext.broadcast(costs)
    usable = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    total = max(1, usable.count())
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 4)
    sample = usable.where(place < int(2**60 * min(1.0, sample_rows / total)))

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def read(texts: pa.Array) -> pa.Array:
        reader = _Reader(shared.value)
        return pa.array([sorted({term for found in reader.words(value.as_py() or "") for term in found}) for value in texts], pa.list_(pa.string()))

    learned = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(sample), "doc_id")
    first = learned.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    rows = cut_lineage(first.select("doc_id", "toxic", read("text").alias("terms")))
    size, hit = (rows.agg(F.count("toxic"), F.sum(F.col("toxic").cast("long"))).first()[:])
    hit = hit or 0
    # G² of a term's two-by-two table; cells of 0 add nothing
    a, n = F.col("a").cast("double"), F.col("n").cast("double")

    def cell(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, 2 * seen * F.log(seen / expected)).otherwise(F.lit(0.0))

    by_term = rows.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.sum(F.col("toxic").cast("long")).alias("a"), F.count(F.lit(1)).alias("n"))
    rest = F.lit(float(size)) - n
    whole = float(max(size, 1))
    g2 = cell(a, n * hit / whole) + cell(n - a, n * (size - hit) / whole) + cell(hit - a, rest * hit / whole) + cell(
        (size - hit) - (n - a), rest * (size - hit) / whole)
    chosen = [row["term"] for row in by_term.withColumn("g2", g2).where((F.col("g2") >= LEAST_G2) & (a * whole > n * hit)).orderBy(F.desc("g2"), "term").limit(TERMS).collect()]
    number = {term: k for k, term in enumerate(chosen)}
    names = docs.sparkSession.sparkContext.broadcast(number)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def numbers(found: pa.Array) -> pa.Array:
        return pa.array([[names.value[term] for term in row.as_py() if term in names.value] for row in found], pa.list_(pa.int32()))

    matrix = rows.select(numbers("terms").alias("held"), "toxic", "doc_id").orderBy("doc_id").collect()
    weights, base = _fit([row["held"] for row in matrix], np.array([row["toxic"] for row in matrix], float), len(chosen))
    return Toxicity(costs, dict(zip(chosen, weights.tolist(), strict=True)), base)


def score_toxicity(docs: DataFrame, model: Toxicity, *, text: str = "text") -> DataFrame:
    """``docs`` with score (chance of label 1) and predicted (1 from 0.3 on).

    Null and empty texts score the base. A text's score depends on nothing but the text; order,
    repeated rows and other columns do not matter. Columns named score or predicted are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        model = shared.value

        class Weighed(_Reader):
            def keep(self, words: list[str]) -> tuple:
                return tuple(term for term in terms(words) if term in model.weights)

        reader = Weighed(model.costs)
        sums = [model.base + sum(model.weights[term] for term in sorted({term for found in reader.words(value.as_py() or "") for term in found})) for value in texts]
        return pa.array([1 / (1 + math.exp(-max(-700.0, s))) for s in sums], pa.float64())

    return docs.withColumn("score", score(F.col(text))).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def restore_texts(docs: DataFrame, model: Toxicity, *, text: str = "text") -> DataFrame:
    """``docs`` with restored: the text as :func:`restore` reads it, null where it is null."""
    shared = docs.sparkSession.sparkContext.broadcast(model.costs)

    @F.arrow_udf(T.StringType())
    def read(texts: pa.Array) -> pa.Array:
        return pa.array([None if value.as_py() is None else restore(value.as_py(), shared.value) for value in texts], pa.string())

    return docs.withColumn("restored", read(F.col(text)))
