"""Near-duplicates, components, decontamination, fixity and the pipeline: brute force on small fixtures."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from docledger.llm import simhash
from docledger.llm.components import components
from docledger.llm.decontaminate import find_contamination
from docledger.llm.simhash import drop_near_duplicates, fingerprint_links, near_duplicates
from docledger.llm.warc import archive, audit, damaged_copy, mismatches, tree

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SPACES = re.compile("[^\x20\x09-\x0d]+")
WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def documents(spark, texts):
    return spark.createDataFrame([(k, text, "en", f"s{k % 3}", 0) for k, text in enumerate(texts)], SCHEMA)


def fingerprint(text):
    words = SPACES.findall(lower(text))
    shingles = [" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def classes(prints):
    """doc number -> smallest number reachable by links of two bits."""
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for a in range(len(prints)):
            for b in range(a):
                if (prints[a] ^ prints[b]).bit_count() <= 2 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def near_copies():
    draw = random.Random(3)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = [None, "", "a", "A b", "a B", " \n ", "x y z", "É è É", "é è é"]
    for _ in range(25):
        words = draw.choices(vocabulary, k=300)
        texts.append(" ".join(words))
        for _ in range(4):
            words = words.copy()
            words[draw.randrange(300)] = draw.choice(vocabulary)
            texts.append(" ".join(words))
    return texts + texts[10:14]


def test_components_match_brute_force(spark):
    texts = near_copies()
    prints = [fingerprint(text) for text in texts]
    want = classes(prints)
    rows = near_duplicates(documents(spark, texts)).collect()
    assert len(rows) == len(texts)
    for row in rows:
        assert row.fingerprint == f"{prints[row.doc_id]:016x}"
        assert row.component_id == want[row.doc_id]
    kept = drop_near_duplicates(documents(spark, texts))
    assert sorted(row.doc_id for row in kept.collect()) == sorted(set(want)) and kept.columns == documents(spark, []).columns


@pytest.mark.parametrize("crowded", [64, 2])
def test_links_of_dense_fingerprints(spark, crowded):
    draw = random.Random(5)
    values = set()
    for _ in range(12):
        centre = draw.getrandbits(64)
        for _ in range(12):
            value = centre
            for _ in range(draw.randrange(4)):
                value ^= 1 << draw.randrange(64)
            values.add(value - (1 << 64) if value >> 63 else value)
    values = sorted(values)
    links = fingerprint_links(spark.createDataFrame([(v,) for v in values], "print long"), crowded=crowded)
    assert all(((row.a ^ row.b) & (2**64 - 1)).bit_count() <= 2 for row in links.collect())
    roots = {row.node: row.root for row in components(links).collect()}
    want = classes([v & (2**64 - 1) for v in values])
    got = [roots.get(v, v) for v in values]
    assert [values[k] for k in want] == got


def test_components_of_a_chain_and_of_nothing(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(5, 5), (90, 80), (80, 90)], "a long, b long")
    got = {row.node: row.root for row in components(chain).collect()}
    assert got == {**{k: 0 for k in range(1, 61)}, 90: 80}
    assert components(chain.where("a > 1000")).count() == 0


def test_near_duplicates_of_odd_rows(spark):
    docs = documents(spark, ["same text here"] * 4 + ["other words of text"]).withColumn("doc_id", F.when(F.col("doc_id") > 1, F.col("doc_id")))
    docs = docs.union(docs).withColumn("print", F.lit("mine")).withColumn("component_id", F.lit(0))
    rows = near_duplicates(docs).collect()
    assert len(rows) == 10 and {row.component_id for row in rows} == {2, 4}
    kept = drop_near_duplicates(docs)
    assert sorted(row.doc_id for row in kept.collect()) == [2, 4] and kept.columns == docs.columns
    assert near_duplicates(documents(spark, [])).count() == 0 and drop_near_duplicates(documents(spark, [])).count() == 0


def contamination(text, items):
    words = WORDS.findall(lower(text))
    hit, seen = set(), set()
    for number, item in items:
        own = WORDS.findall(lower(item))
        size = min(13, len(own))
        windows = {tuple(own[k:k + size]) for k in range(len(own) - size + 1)} if own else set()
        for k in range(len(words) - size + 1):
            if size and tuple(words[k:k + size]) in windows:
                hit.update(range(k, k + size))
                seen.add(number)
    ids = ",".join(sorted(str(number) for number in seen if number is not None))
    return len(words), len(hit), len(seen - {None}), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


def benchmark_case():
    draw = random.Random(9)
    vocabulary = ["the", "of", "Und", "é", "x1", *(f"v{k}" for k in range(60))]
    text = lambda n: " ".join(draw.choices(vocabulary, k=n))
    items = [(k, text(draw.choice((5, 13, 14, 40)))) for k in range(12)]
    items += [(20, items[2][1]), (21, None), (22, ""), (None, text(15)), (23, "the"), (24, "v1 v2"), (3, items[3][1])]
    texts = [None, "", "the", "...", text(3)]
    for k in range(60):
        piece = items[k % len(items)][1] or ""
        texts.append(f"{text(draw.randrange(30))}, {piece.upper()}; {text(draw.choice((2, 300)))} {piece[5:]}")
    return texts, items


@pytest.mark.parametrize("block_windows", [100_000, 40])
def test_contamination_matches_brute_force(spark, block_windows):
    texts, items = benchmark_case()
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, texts).withColumn("n_hit", F.lit("mine"))
    for row in find_contamination(docs, bench, block_windows=block_windows).collect():
        got = (row.n_words, row.n_hit, row.n_items, row.items_sha256, row.contaminated)
        assert got == contamination(texts[row.doc_id], items), texts[row.doc_id]


def test_no_item_lists_reach_the_tasks(spark, monkeypatch):
    from docledger.llm import decontaminate

    texts, items = benchmark_case()
    prompt = " ".join(f"p{k}" for k in range(20))
    items = [*items, *((100 + k, f"{prompt} v{k}") for k in range(300))]
    texts = [*texts, f"{prompt} v7 {prompt}", prompt]
    sent = []
    monkeypatch.setattr(decontaminate, "_index", lambda block, rarity, f=decontaminate._index: sent.append(f(block, rarity)) or sent[-1])
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(decontaminate, "BROADCAST_SETS", 0)
    for row in find_contamination(documents(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect():
        got = (row.n_words, row.n_hit, row.n_items, row.items_sha256, row.contaminated)
        assert got == contamination(texts[row.doc_id], items), texts[row.doc_id]
    assert len(sent) > 1 and all(isinstance(entry[2], bytes) for index in sent for entries in index.values() for entry in entries)


def test_contamination_of_empty_tables(spark):
    texts, items = benchmark_case()
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert find_contamination(documents(spark, []), bench).count() == 0
    clean = find_contamination(documents(spark, texts), bench.where("item_id > 1000"))
    assert clean.where("contaminated or n_hit > 0 or n_items > 0").count() == 0


PAGES = "page_id long, url string, html string"


def pages(spark, n=700):
    return spark.createDataFrame([(k, f"http://h{k % 5}.org/{k}", f"<p>{k}</p>" * (k % 7)) for k in range(n)], PAGES)


def test_equal_replicas_are_intact(spark):
    first = archive(pages(spark), 3)
    rows = audit(first, archive(pages(spark).repartition(7), 3)).collect()
    assert [(row.kind, row.status) for row in rows] == [("file", "intact")] * 3
    offsets = sorted((row.file, row.offset, row.length) for row in first.collect())
    for before, after in zip(offsets, offsets[1:]):
        assert after[1] == (before[1] + before[2] if before[0] == after[0] else 0)


def test_damage_is_located(spark):
    ours = pages(spark)
    theirs = ours.withColumn("html", F.when(F.col("page_id") == 33, "broken").otherwise(F.col("html"))).where("page_id <> 600")
    theirs = theirs.union(spark.createDataFrame([(9999, "new", None), (9999, "new", None)], PAGES))
    rows = audit(archive(ours, 3), archive(theirs, 3)).where("kind = 'record'").collect()
    assert sorted((row.status, row.page_id) for row in rows) == [("changed", 33), ("extra", 9999), ("missing", 600)]


def test_only_differing_branches_are_descended(spark):
    ours = tree(archive(pages(spark, 2000), 1))
    theirs = tree(archive(pages(spark, 2000).withColumn("html", F.when(F.col("page_id") == 5, "x").otherwise(F.col("html"))), 1))
    levels = [row.level for row in mismatches(ours, theirs).collect()]
    assert sorted(levels) == [0, 1, 2, 3]


def test_audit_of_odd_tables(spark):
    odd = spark.createDataFrame([(None, None, None), (1, None, ""), (1, None, ""), (None, "u", "é")], PAGES)
    assert audit(archive(odd, 1), archive(odd, 1)).count() == 1
    empty = odd.where("page_id > 5")
    assert audit(archive(empty, 1), archive(empty, 1)).count() == 0
    rows = audit(archive(odd, 1), archive(empty, 1)).collect()
    assert {row.status for row in rows} == {"missing"} and len(rows) == 4
    assert damaged_copy(pages(spark)).columns == ["page_id", "url", "html"]


def test_every_damaged_record_of_an_address_is_reported(spark):
    def side(*bodies):
        return archive(spark.createDataFrame([(1, "u", body) for body in bodies] + [(2, "u", "x"), (2, "u", "x")], PAGES), 1)

    def found(ours, theirs):
        rows = audit(side(*ours), side(*theirs)).where("kind = 'record'").collect()
        return sorted((row.status, row.page_id, row.copies) for row in rows)

    assert found("AB", "C") == [("extra", 1, 1), ("missing", 1, 1), ("missing", 1, 1)]
    assert found("AB", "AC") == [("changed", 1, 1)]
    assert found("AAAAA", "AA") == [("missing", 1, 3)] and found("AA", "BB") == [("changed", 1, 2)]
    assert found("AAA", "B") == [("extra", 1, 1), ("missing", 1, 3)]
    nameless = spark.createDataFrame([(None, None, f"{k}") for k in range(1000)], PAGES)
    rows = audit(archive(nameless, 2), archive(nameless.where("html = '7'"), 2)).where("kind = 'record'").collect()
    assert len(rows) == 999 and {row.status for row in rows} == {"missing"} and len({row.hash for row in rows}) == 999


def test_records_of_one_address_are_numbered_in_chunks(spark, monkeypatch):
    from docledger.llm import warc

    mixed = pages(spark, 50).union(spark.createDataFrame([(None, None, "x" * (k % 9) + f"{k // 2}") for k in range(900)], PAGES))
    monkeypatch.setattr(warc, "CHUNK_ROWS", 5)
    whole = archive(mixed, 2)
    rows = sorted(whole.collect(), key=lambda r: (r.file, r.page_id is not None, r.page_id, r.url or "", r.digest))
    ordinal, offset, file = 0, 0, None
    for row in rows:
        ordinal, offset = (ordinal, offset) if row.file == file else (0, 0)
        assert (row.ordinal, row.offset) == (ordinal, offset)
        ordinal, offset, file = ordinal + 1, offset + row.length * row.copies, row.file
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number() windowspecdefinition(file#" in plan and "_chunk" in plan


def test_pipeline_matches_its_stages_by_hand(spark, tmp_path):
    prose = "the river ran to the sea and it was cold in the morning when they went down to look at it with a lamp"
    item = " ".join(f"term{k}" for k in range(16))
    texts = [f"{prose} number {k} and then {' '.join(f'word{k * 37 % 101 + j}' for j in range(20))}" for k in range(60)]
    texts += [texts[4], None, "", "short", f"{prose} {item}", "### $$$ " * 30]
    documents(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    clean = {k for k in range(60) if classes([fingerprint(text) for text in texts[:60]])[k] == k}
    assert {row.doc_id for row in rows} <= clean
    assert len(corpus_pipeline.STAGES) == 5 and all(0 <= row.shard < 40 for row in rows)
    assert {"doc_id", "text", "lang", "source", "n_chars", "shard"} <= set(rows[0].asDict())
    docs = documents(spark, texts)
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == documents(spark, []).columns, name
    assert {row.doc_id for row in docs.collect()} == clean


def test_stages_keep_columns_named_like_results(spark, tmp_path):
    prose = "the river ran to the sea and it was cold in the morning when they went down to look at it with a lamp"
    texts = [f"{prose} number {k} {' '.join(f'word{k * 37 % 101 + j}' for j in range(20))}" for k in range(6)]
    own = {name: F.concat(F.lit(f"{name}-"), F.col("doc_id")) for name in ("target", "source_size", "size", "n_words", "kept", "n_hit", "contaminated")}
    docs = documents(spark, texts).withColumns(own)
    spark.createDataFrame([(1, "some other text")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns[: len(docs.columns)] == docs.columns, name
        rows = got.collect()
        assert rows and all(row[column] == f"{column}-{row.doc_id}" for row in rows for column in own), name


def test_index_of_variants_is_never_broadcast(spark, monkeypatch):
    plans = []

    def kept(df):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(simhash, "cut_lineage", kept)
    prints = simhash.spread(spark.range(1, 200).select(F.xxhash64("id").alias("print")).union(spark.range(4).select("id")), F.xxhash64("print"))
    found = {(row.a, row.b) for row in fingerprint_links(prints).collect()}
    assert found == {(a, b) for a in range(4) for b in range(a)}
    assert plans and not any("BroadcastExchange" in plan for plan in plans)
