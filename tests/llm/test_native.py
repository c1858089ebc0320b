"""Quality rules, mixing and sharding: small fixtures against plain Python."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docledger.llm.mixing import mix_sources, repeat_mixed
from docledger.llm.quality_rules import apply_rules
from docledger.llm.sharding import assign_shards, shard_documents

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile("[^\x20\x09-\x0d]+")
PROSE = "the river ran to the sea and it was cold in the morning when they went down to look at it with a lamp"


def documents(spark, texts, sources=None):
    rows = [(k, text, "en", sources[k] if sources else "a", 0) for k, text in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def counts(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[k:k + 5]) for k in range(len(words) - 4)]
    often = Counter(windows)
    covered = {p for k, window in enumerate(windows) if often[window] > 1 for p in range(k, k + 5)}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)
    )


TEXTS = [
    None, "", " \t\n\x0b\x0c\r ", "one", PROSE, f"{PROSE}\n{PROSE}", "a b c d e a b c d e", "x x x x x x x x x x x x",
    "é ü ß 漢字 | # $", "l\nl\n\nl \n m", "a b c d e f " * 3000, "the " * 5, "  word 　 word", "# & % < > | * $",
]


def test_counts_follow_the_definition(spark):
    got = {row.doc_id: row for row in apply_rules(documents(spark, TEXTS)).collect()}
    for k, text in enumerate(TEXTS):
        row, want = got[k], counts(text)
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == want, text
        assert row.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])


def test_rules_reject_junk_and_keep_prose(spark):
    junk = [" ".join(f"{word}###" for word in PROSE.split()), " ".join(f"xq{k}zz" for k in range(80)), "\n".join(["same line of ten words here and it is so long"] * 5)]
    rows = apply_rules(documents(spark, [PROSE, *junk])).orderBy("doc_id").collect()
    assert [row.kept for row in rows] == [True, False, False, False]
    assert rows[1].failed_rules == ["symbols"] and rows[2].failed_rules == ["stop_words"]


def test_a_condition_on_the_verdict_leaves_the_word_list_alone(spark):
    kept = apply_rules(documents(spark, [PROSE])).where("kept").select("doc_id")
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 3


def test_clashing_and_extra_columns(spark):
    clash = documents(spark, [PROSE]).withColumn("n_words", F.lit("mine")).withColumn("kept", F.lit(7)).withColumn("more", F.lit(1))
    row = apply_rules(clash).first()
    assert row.n_words == 24 and row.kept is True and row.more == 1


@pytest.mark.parametrize("operator", [apply_rules, mix_sources, shard_documents, repeat_mixed, assign_shards])
def test_empty_tables(spark, operator):
    assert operator(documents(spark, [])).count() == 0


def targets(sizes):
    """Water filling by hand: split, cap at twice the size, split the excess."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, free, out = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if 2 * sizes[s] <= level * weight[s]}
        if not full:
            out |= {s: level * weight[s] for s in free}
            break
        out |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        free -= full
    return out


def test_mix_meets_its_targets(spark):
    texts = [" ".join(["w"] * (1 + k * 7 % 23)) for k in range(900)]
    sources = [("s0", "s1", "s2", None, "é")[0 if k % 3 == 0 else k % 5] for k in range(900)]
    rows = mix_sources(documents(spark, texts, sources)).collect()
    sizes = Counter()
    for row in rows:
        sizes[row.source] += row.size
    want, taken = targets(sizes), Counter()
    for row in rows:
        taken[row.source] += row.taken
        assert row.target == pytest.approx(want[row.source]) and row.source_size == sizes[row.source]
        assert row.taken in (0, row.size, 2 * row.size)
    for source, total in taken.items():
        assert abs(total - want[source]) <= 23
    again = mix_sources(documents(spark, texts, sources).repartition(5)).select("doc_id", "taken")
    assert sorted(map(tuple, again.collect())) == sorted((row.doc_id, row.taken) for row in rows)


def test_mix_of_nulls_repeats_and_empty_texts(spark):
    docs = documents(spark, [None, "", "a b", "a b"], [None, None, None, "x"]).withColumn("doc_id", F.lit(None).cast("long"))
    rows = mix_sources(docs.union(docs).withColumn("size", F.lit(-1))).collect()
    assert len(rows) == 8 and all(row.taken <= 2 * row.size for row in rows)
    assert sum(row.size for row in rows) == 8
    repeated = repeat_mixed(docs)
    assert repeated.columns == docs.columns


def test_repeated_documents_of_a_mix(spark):
    docs = documents(spark, ["a b c"] * 40, ["x"] * 10 + ["y"] * 30)
    want = sum(row.copies for row in mix_sources(docs).collect())
    assert repeat_mixed(docs).count() == want


def test_large_source_tables_are_joined_by_a_shuffle(spark, monkeypatch):
    from docledger.llm import mixing

    docs = documents(spark, [" ".join(["w"] * (k % 9)) for k in range(200)], [f"s{k % 7}" for k in range(200)])
    small = sorted((row.doc_id, row.taken) for row in mix_sources(docs).collect())
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", 0)
    assert sorted((row.doc_id, row.taken) for row in mix_sources(docs).collect()) == small


def test_shards_are_stable_and_gapless(spark):
    texts = [None, "", "é", *(f"text {k}" for k in range(3000))]
    docs = documents(spark, texts)
    rows = shard_documents(docs).collect()
    assert len(rows) == len(texts) and {row.law for row in rows} == {"key"}
    slots = {}
    for row in rows:
        data = (texts[row.doc_id] or "").encode()
        assert (row.size, row.text_crc32) == (len(data) + 16, zlib.crc32(data))
        assert row.grown_shard in (row.shard, 40)
        slots.setdefault(row.shard, []).append(row.slot)
    assert set(slots) == set(range(40))
    assert all(sorted(found) == list(range(len(found))) for found in slots.values())
    moved = sum(row.grown_shard == 40 for row in rows) / len(rows)
    assert 0.01 < moved < 0.05
    grown = {row.doc_id: row.shard for row in shard_documents(docs, shards=41).collect()}
    assert all(grown[row.doc_id] == row.grown_shard for row in rows)


def test_shards_of_repeated_and_nameless_rows(spark):
    docs = documents(spark, ["same"] * 50).withColumn("doc_id", F.when(F.col("doc_id") < 30, 7))
    rows = shard_documents(docs.withColumn("slot", F.lit("x"))).collect()
    by = Counter((row.doc_id, row.shard) for row in rows)
    assert sorted(by.values()) == [20, 30]
    for shard in {row.shard for row in rows}:
        mine = [row.slot for row in rows if row.shard == shard]
        assert sorted(mine) == list(range(len(mine)))


def test_weights_draw_in_proportion(spark):
    docs = documents(spark, ["x"] * 4000)
    got = Counter(row.shard for row in assign_shards(docs, shards=2, weights=(3.0, 1.0)).collect())
    assert 0.7 < got[0] / 4000 < 0.8
