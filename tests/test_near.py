"""Containment and similarity by grams and segments, against comparing every field with every span."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from docledger.operators.align import FUZZY_RATIO, MIN_FUZZY, MIN_SUBSTRING, SUBSTRING_RATIO, _cut, _segments, match_cascade

REGIONS = "document_id string, page_index long, region_id string, text string, x_min double, y_min double, x_max double, y_max double"
FIELDS = "document_id string, field_path string, label string, gt_value string, normalization_kind string, page_index long"


def expected(fields, regions, boxes):
    pages = {}
    for document, page, _, text, x, y, *_ in sorted(regions, key=lambda r: (r[0], r[1], r[5], r[4], r[2])):
        pages.setdefault((document, page), []).append(text)
    found = {}
    for document, path, _, value, _, own in fields:
        for (where, page), texts in pages.items():
            if where != document or (own != page and (document, own) in pages):
                continue
            for start in range(len(texts)):
                for size in range(1, min(boxes, len(texts) - start) + 1):
                    o = " ".join(t.strip() for t in texts[start:start + size] if t.strip()).strip(" .-'\"")
                    g = value.strip(" .-'\"")
                    if not o or o == g:
                        continue
                    ratio = min(len(g), len(o)) / max(len(g), len(o))
                    key = path, page, start + 1, size
                    if len(g) >= MIN_SUBSTRING and (g in o or o in g) and ratio >= SUBSTRING_RATIO:
                        found[key] = ("value_substring", round(min(0.89, 0.72 + 0.15 * ratio), 9))
                    elif min(len(g), len(o)) >= MIN_FUZZY and SequenceMatcher(None, g, o).ratio() >= FUZZY_RATIO:
                        found[key] = ("fuzzy", round(SequenceMatcher(None, g, o).ratio(), 9))
    return found


@pytest.mark.parametrize("seed", range(3))
def test_near_matches_equal_comparing_everything(spark, seed):
    rng = random.Random(seed)

    def word():
        return "".join(rng.choice("abcde" if seed else "ab.-") for _ in range(rng.choice([1, 2, 3, 4, 6, 9])))

    regions = [(f"d{d}", p, f"r{d}-{p}-{k}", " ".join(word() for _ in range(rng.choice([1, 1, 2]))), 0.0, 20.0 * k, 10.0, 20.0 * k + 10)
               for d in range(3) for p in range(2) for k in range(12)]
    fields = []
    for d in range(3):
        for k in range(14):
            texts = [r[3] for r in regions if r[0] == f"d{d}"]
            at = rng.randrange(len(texts))
            value = list(" ".join(texts[at:at + rng.choice([1, 2, 3])]))
            for _ in range(rng.choice([0, 1, 2])):
                value[rng.randrange(len(value))] = rng.choice(["", "a", "zz"])
            fields.append((f"d{d}", f"f{d}-{k}", "NOTE", "".join(value), "text", rng.choice([0, 1, 7])))
    rows = match_cascade(spark.createDataFrame(fields, FIELDS), spark.createDataFrame(regions, REGIONS), max_boxes=4).where("inherently_ambiguous").collect()
    found = {(r.field_path, r.page_index, r.start, r.size): (r.method.removeprefix("multi_box_"), round(r.confidence, 9)) for r in rows}
    want = expected(fields, regions, 4)
    assert want and found == want


def test_segments_outnumber_the_spoilt_ones(spark):
    for value in ("abcdefgh", "ab cd ef gh", "a.b.c", "x" * 40, "...---", "ab"):
        rarity = F.array_repeat(F.lit(0), 4096)
        row = spark.range(1).withColumn("_rarity", rarity).select(
            _segments(F.lit(value)).alias("s"), *(F.size(_cut(F.lit(value), k)).alias(f"n{k}") for k in (1, 2, 3))).first()
        needed = int((1 - FUZZY_RATIO) * (len(value) + int(len(value) * (2 / FUZZY_RATIO - 1) + 1e-9)) + 1e-9) + 1
        assert row.s == ["*any*"] if row.n1 < needed else all(piece in value for piece in row.s)


def test_no_join_on_lengths(spark):
    fields = spark.createDataFrame([("d", "f", "NOTE", "abcdef", "text", 0)], FIELDS)
    regions = spark.createDataFrame([("d", 0, "r", "abcdxf", 0.0, 0.0, 1.0, 1.0)], REGIONS)
    plan = match_cascade(fields, regions)._jdf.queryExecution().optimizedPlan().toString()
    assert "_length" not in plan and "_gram" in plan
