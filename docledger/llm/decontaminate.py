"""Benchmark decontamination by a prefix-filtered set join.

Every run of 13 consecutive words of a benchmark item (all words of a shorter item) is a set of
3-word shingles that a document must contain whole, so a prefix of one shingle suffices: the one
that is rarest in the documents. Documents meet a window only at an occurrence of its prefix
shingle; the occurrence fixes where the window would start, the length bound rejects windows that
would leave the document, and the words are then compared exactly.

The windows are cut into blocks of bounded size, each sent to the tasks as a whole; the documents
are scanned once a block for shingle counts and once for matches. Items stay a table: a document
carries the numbers of its windows, and each different set of them is joined to its items once.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docledger.llm.common import keep_columns, own, private, public
from docledger.session import cut_lineage

RESULTS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
WINDOW = 13
SHINGLE = 3
#: Windows of one block; at 13 words each the driver and a task hold about 100 MB of them.
BLOCK_WINDOWS = 100_000
#: Bytes of the windows of one block, on average.
BLOCK_BYTES = 10_000_000
#: Sets of windows up to which their results are broadcast to the documents; more are joined by a shuffle.
BROADCAST_SETS = 50_000

# Fixed value: bytes outside [0-9A-Za-z] and non-ASCII separate words, A-Z are lower-cased.
_TO_WORDS = bytes(
    byte + 32 if 0x41 <= byte <= 0x5A
    else byte if 0x30 <= byte <= 0x39 or 0x61 <= byte <= 0x7A or byte >= 0x80
    else 0x20
    for byte in range(256)
)
_FOUND = pa.struct([("spans", pa.list_(pa.int32())), ("windows", pa.list_(pa.binary())), ("n_words", pa.int64())])
_FOUND_TYPE = T.StructType([
    T.StructField("spans", T.ArrayType(T.IntegerType())), T.StructField("windows", T.ArrayType(T.BinaryType())),
    T.StructField("n_words", T.LongType()),
])


def _words(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


def _shingles(words: list[bytes], width: int) -> Iterator[tuple[bytes, ...]]:
    return zip(*(words[at:] for at in range(width)))


@F.arrow_udf(T.ArrayType(T.BinaryType()))
def _windows_of(texts: pa.Array) -> pa.Array:
    out = []
    for text in texts.cast(pa.binary()):
        words = _words(text.as_py() or b"")
        last = max(0, len(words) - WINDOW)
        out.append([b" ".join(words[at:at + WINDOW]) for at in range(last + 1)] if words else [])
    return pa.array(out, pa.list_(pa.binary()))


def _width(window: list[bytes]) -> int:
    return min(SHINGLE, len(window))


def _shingle_counts(docs: DataFrame, text: str, wanted: frozenset) -> dict[tuple[bytes, ...], int]:
    """How often each wanted shingle occurs in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)
    widths = sorted({len(shingle) for shingle in wanted})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = shared.value, Counter()
        for batch in batches:
            for value in batch.column(0).cast(pa.binary()):
                words = _words(value.as_py() or b"")
                for width in widths:
                    seen.update(shingle for shingle in _shingles(words, width) if shingle in known)
        yield pa.RecordBatch.from_pydict({
            "shingle": pa.array([b" ".join(shingle) for shingle in seen], pa.binary()),
            "n": pa.array(list(seen.values()), pa.int64()),
        })

    counted = docs.select(text).mapInArrow(count, "shingle binary, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))
    return {tuple(row.shingle.split(b" ")): row.n for row in counted.collect()}


def _index(block: list[bytes], rarity: dict[tuple[bytes, ...], int]) -> dict:
    """Prefix shingle -> [(its place in the window, the window's words, its number)]."""
    index: dict = defaultdict(list)
    for window in block:
        words = window.split(b" ")
        shingles = list(_shingles(words, _width(words)))
        if all(shingle in rarity for shingle in shingles):  # else some shingle occurs nowhere, nor does the window
            at = min(range(len(shingles)), key=lambda k: (rarity[shingles[k]], shingles[k], k))
            index[shingles[at]].append((at, words, hashlib.md5(window).digest()))
    return dict(index)


def _merge(spans: list[tuple[int, int]]) -> list[int]:
    """Overlapping or touching [start, end) spans joined, as a flat list."""
    flat: list[int] = []
    for start, end in sorted(spans):
        if flat and start <= flat[-1]:
            flat[-1] = max(flat[-1], end)
        else:
            flat += [start, end]
    return flat


def _scan(docs: DataFrame, text: str, index: dict, found: str | None) -> DataFrame:
    """Adds ``_found`` with the words hit and the windows seen, over what earlier blocks found."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    widths = sorted({len(shingle) for shingle in index})

    def match(words: list[bytes]) -> tuple[list[tuple[int, int]], set[bytes]]:
        spans, seen = [], set()
        for width in widths:
            for place, shingle in enumerate(_shingles(words, width)):
                if shingle in shared.value:
                    for offset, window, number in shared.value[shingle]:
                        start, end = place - offset, place - offset + len(window)
                        if start >= 0 and end <= len(words) and words[start:end] == window:
                            spans.append((start, end))
                            seen.add(number)
        return spans, seen

    def rows(texts: pa.Array, before: list | None) -> pa.Array:
        out = []
        for k, value in enumerate(texts.cast(pa.binary())):
            words = _words(value.as_py() or b"")
            spans, seen = match(words)
            if before is not None:
                seen.update(before[k]["windows"])
                flat = before[k]["spans"]
                spans += zip(flat[::2], flat[1::2])
            out.append({"spans": _merge(spans), "windows": sorted(seen), "n_words": len(words)})
        return pa.array(out, _FOUND)

    @F.arrow_udf(_FOUND_TYPE)
    def first(texts: pa.Array) -> pa.Array:
        return rows(texts, None)

    @F.arrow_udf(_FOUND_TYPE)
    def more(texts: pa.Array, before: pa.Array) -> pa.Array:
        return rows(texts, before.to_pylist())

    return docs.withColumn("_found", first(text) if found is None else more(text, found))


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    one_in: int = 20, block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if any occurrence of any window covers it; a document is contaminated if at least
    one in ``one_in`` of its words is hit. Null and empty texts have no words and are clean. Null, empty and
    wordless items have no window; an item without id marks words but is not listed. Repeated
    documents are judged row by row, repeated items count once. An empty benchmark hits nothing.
    Columns of ``docs`` named like a result are replaced, all others stay, whatever they are called.
    """
    names, docs, text = keep_columns(docs, set(RESULTS)), private(docs), own(text)
    owned = cut_lineage(
        benchmark.select(F.col(item_id).cast("string").alias("item"), F.explode(_windows_of(item_text)).alias("window")).distinct()
    )
    windows = owned.select("window").distinct()
    total, size = windows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("window")), F.lit(0))).first()
    blocks = max(1, -(-total // block_windows), -(-size // BLOCK_BYTES))
    found = None
    for number in range(blocks):
        mine = windows.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == number)
        block = sorted(bytes(row["window"]) for row in mine.collect())
        wanted = frozenset(
            shingle for window in block for words in [window.split(b" ")] for shingle in _shingles(words, _width(words))
        )
        rarity = _shingle_counts(docs, text, wanted) if wanted else {}
        docs = _scan(docs, text, _index(block, rarity), found)
        found = "_found"
    numbers = F.col("_found.windows")
    # the documents without a hit have a key of their own each, which spreads them
    keyed = docs.withColumn("_key", F.when(F.size(numbers) > 0, F.sha2(F.array_join(F.transform(numbers, F.hex), ""), 256)).otherwise(
        F.concat(F.lit("-"), F.xxhash64(text).cast("string"))
    ))
    owners = owned.where(F.col("item").isNotNull()).select(F.unhex(F.md5("window")).alias("number"), "item")
    sets = keyed.where(F.size(numbers) > 0).select("_key", numbers.alias("_windows")).dropDuplicates(["_key"])
    listed = cut_lineage(
        sets.select("_key", F.explode("_windows").alias("number")).join(owners, "number").select("_key", "item").distinct()
        .groupBy("_key").agg(F.sort_array(F.collect_list("item")).alias("items"))
        .select(F.col("_key").alias("_set"), F.size("items").cast("bigint").alias("_n"), F.sha2(F.array_join("items", ","), 256).alias("_sha"))
    )
    few = listed.count() <= BROADCAST_SETS
    docs = keyed.join(F.broadcast(listed) if few else listed, F.col("_key") == F.col("_set"), "left")
    spans = F.col("_found.spans")
    hit = F.aggregate(
        F.transform(spans, lambda at, k: F.when(k % 2 == 0, -at).otherwise(at)), F.lit(0), lambda total, at: total + at
    ).cast("bigint")
    judged = (
        docs.withColumn("n_words", F.col("_found.n_words")).withColumn("n_hit", hit)
        .withColumn("n_items", F.coalesce("_n", F.lit(0).cast("bigint")))
        .withColumn("items_sha256", F.coalesce("_sha", F.sha2(F.lit(""), 256)))
    )
    enough = (F.col("n_hit") > 0) & (F.lit(one_in) * F.col("n_hit") >= F.col("n_words"))
    return public(judged.withColumn("contaminated", enough), names, RESULTS)
