"""Merkle manifest: against hashing by hand, and odd rows."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from docledger.llm.manifest import lowered_where_chosen, manifest, verify

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    def written(value):
        return "-" if value is None else f"{len(str(value).encode())}:{value}"

    doc_id, text, lang, source, n_chars = row
    return sha("".join(map(written, (doc_id, source, lang, n_chars, text))))


def lowered(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def climb(hashes, at):
    """(root, siblings of node ``at`` level by level as (before, after))."""
    path = []
    while len(hashes) > 1:
        start = at // 16 * 16
        path.append(("".join(hashes[start:at]), "".join(hashes[at + 1:start + 16])))
        hashes = [sha("".join(hashes[i:i + 16])) for i in range(0, len(hashes), 16)]
        at //= 16
    return hashes[0], path


def by_hand(rows):
    sources = sorted({row[3] for row in rows}, key=lambda s: (s is not None, (s or "").encode()))
    ordered = {s: sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in sources}
    leaves = {s: [leaf(r) for r in part] for s, part in ordered.items()}
    subroots = [climb(leaves[s], 0)[0] for s in sources]
    for k, s in enumerate(sources):
        root, above = climb(subroots, k)
        for at, row in enumerate(ordered[s]):
            subroot, path = climb(leaves[s], at)
            chosen = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            node = leaf((row[0], lowered(row[1]) if chosen else row[1], *row[2:]))
            for before, after in path + above:
                node = sha(before + node + after)
            proof = sha("".join(before + after for before, after in path + above))
            yield row[0], leaves[s][at], subroot, root, proof, node, node == root


def run(docs):
    claims = {"text": lowered_where_chosen(F.col("doc_id"), F.col("text"))}
    return sorted(map(tuple, verify(manifest(docs, claims=claims)).collect()), key=repr)


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 17, None: 1}, {"a": 300, "b": 16, "é": 2, "Z": 33}, {f"s{k}": 1 + k % 3 for k in range(20)}])
def test_manifest_equals_hashing_by_hand(spark, sizes):
    rows = [(k * 3, f"Text {k} É Ωmega", "en", source, k) for source, size in sizes.items() for k in range(size)]
    assert run(spark.createDataFrame(rows, COLUMNS)) == sorted(by_hand(rows), key=repr)


def test_tampering_is_found_exactly_where_letters_change(spark):
    rows = [(k, "UPPER" if k % 2 else "lower", "en", "s", 5) for k in range(60)]
    found = {row[0]: row[-1] for row in run(spark.createDataFrame(rows, COLUMNS))}
    assert found == {k: not (k % 2 and zlib.crc32(str(k).encode()) % 5 == 0) for k in range(60)}
    assert not all(found.values())


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, "", "", "", 0), (7, "A", "x", "", 1), (7, "A", "x", "", 1), (7, "B", "x", "", 1), (5, "w " * 200_000, None, None, -3)]
    assert run(spark.createDataFrame(rows, COLUMNS)) == sorted(by_hand(rows), key=repr)


def test_a_repeated_row_is_spread_over_its_places(spark):
    rows = [(1, "same", "en", "hot", 4)] * 90 + [(k, "other", "en", "cold", 5) for k in range(30)]
    assert run(spark.createDataFrame(rows, COLUMNS)) == sorted(by_hand(rows), key=repr)


def test_clashing_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a", "en", "s", 1), (2, "b", "en", "s", 1)], COLUMNS)
    plain = run(docs)
    assert run(docs.selectExpr("*", "1 as tree", "2 as hash", "3 as pos", "4 as n", "map('k', 1) as path", "5 as claim", "6 as root")) == plain
    assert run(docs.where("false")) == []


def test_windows_hold_one_run_each(spark):
    """No window is partitioned by the source alone, so a hot source is many tasks."""
    docs = spark.createDataFrame([(k, "t", "en", "s", 1) for k in range(40)], COLUMNS)
    plan = manifest(docs)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line and "lag" in line]
    assert windows and all("run" in line for line in windows)
