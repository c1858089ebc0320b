"""Toxicity: the lattice against all readings, disguised words, held-out labels, odd rows."""

import itertools
import random

import numpy as np
import pytest

from docledger.llm.toxicity import (
    _LETTERS, _options, count_letters, decode, fit_toxicity, fold, held_out, letter_costs, letter_counts, restore, restore_texts, score_toxicity,
)

RUDE = ("idiot", "stupid", "moron", "pathetic", "scum")
CLEAN = "the river runs past old houses and people walk along its bank while boats carry stones to a town below it is quiet".split()
DOCS, LABELS = "doc_id bigint, text string", "doc_id bigint, toxic int, quality int"


def corpus(count, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for k in range(count):
        words, rude = rng.choices(CLEAN, k=30), int(rng.random() < 0.3)
        if rude:
            for _ in range(2):
                words.insert(rng.randrange(30), rng.choice(RUDE))
        rows.append((k, " ".join(words)))
        labels.append((k, rude, 1))
    return rows, labels


@pytest.fixture(scope="module")
def model(spark):
    rows, labels = corpus(900)
    return fit_toxicity(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS))


@pytest.fixture(scope="module")
def costs():
    return letter_costs(count_letters("\n".join(text for _, text in corpus(900)[0])))


def every_reading(token, costs):
    """(cost, reading) over all paths of the lattice."""
    runs = [(char, len(list(same))) for char, same in itertools.groupby(token)]
    for path in itertools.product(*(_options(char, run) for char, run in runs)):
        total, two, one = 0.0, 0, 0
        for written, extra in path:
            total += extra
            for letter in written:
                code = _LETTERS.get(letter, 0)
                if code or one:
                    total += costs[(two * 27 + one) * 27 + code]
                    two, one = (one, code) if code else (0, 0)
        if one:
            total += costs[(two * 27 + one) * 27]
        yield total, " ".join("".join(written for written, _ in path).split())


@pytest.mark.parametrize("token", ["1d10t", "st*p1d", "p@thet!c", "m.o-r0n", "ssscccum", "a1b2", "$", "|d!o+", "s t u p", "%%a%%", "é1"])
def test_decoding_finds_the_cheapest_of_all_readings(token, costs):
    best = min(every_reading(token, costs))
    reading = decode(token, costs)
    assert min(cost for cost, read in every_reading(token, costs) if read == reading) == pytest.approx(best[0])


@pytest.mark.parametrize("shown, meant", [
    ("1d10t", "idiot"), ("ST*P1D", "stupid"), ("m0r0n!!!", "moron"), ("p@thet1c", "pathetic"), ("sccccum", "scum"), ("m-o-r-o-n", "moron"),
    ("$tup!d,", "stupid"), ("i d i o t", "idiot"), ("s.t.u.p.i.d", "stupid"), ("stuuuuupid", "stupid"), ("pàthétïc", "pathetic"), ("houses", "houses"), ("(river)", "river"),
])
def test_disguises_are_read(shown, meant, costs):
    assert restore(shown, costs) == meant


def test_clean_text_stays(costs):
    assert restore("The river runs past, old houses;\nand people walk.", costs) == "the river runs past old houses\nand people walk"
    assert restore("1234 5.6 %% Ωmega", costs) == "1234 5.6 %% ωmega"
    assert restore("", costs) == "" and restore("1 2 3 4", costs) == "1 2 3 4"


def test_counts_cover_every_text_and_equal_counting_by_hand(spark):
    texts = ["Ab ab!", "", None, "ÀB c", "x" * 5, "1a"]
    slow = np.zeros(27**3, int)
    for text in texts:
        for word in "".join(c if "a" <= c <= "z" else " " for c in fold(text or "")).split():
            codes = [0, 0, *(ord(c) - 96 for c in word), 0]
            for k in range(2, len(codes)):
                slow[(codes[k - 2] * 27 + codes[k - 1]) * 27 + codes[k]] += 1
    docs = spark.createDataFrame([(k, text) for k, text in enumerate(texts)], DOCS).repartition(4)
    assert (letter_counts(docs) == slow).all()


def test_held_out_rows_plain_and_disguised(spark, model):
    rows, labels = corpus(400, seed=2)
    scored = {r.doc_id: r for r in score_toxicity(spark.createDataFrame(rows, DOCS), model).collect()}
    assert all(scored[k].predicted == toxic for k, toxic, _ in labels)
    hidden = str.maketrans({"i": "1", "o": "0", "a": "@", "u": "*"})
    shown = [(k, " ".join(word.translate(hidden) if word in RUDE else word for word in text.split())) for k, text in rows]
    scored = {r.doc_id: r for r in score_toxicity(spark.createDataFrame(shown, DOCS), model).collect()}
    right = sum(scored[k].predicted == toxic for k, toxic, _ in labels)
    assert right >= 0.97 * len(labels)
    torn = [(k, " ".join(" ".join(word) if word in RUDE else word for word in text.split())) for k, text in rows]
    scored = {r.doc_id: r for r in score_toxicity(spark.createDataFrame(torn, DOCS), model).collect()}
    assert sum(scored[k].predicted == toxic for k, toxic, _ in labels) >= 0.97 * len(labels)


def test_held_out_labels_are_never_learned(spark):
    rows, labels = corpus(300)
    docs, told = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    turned = told.withColumn("toxic", told["toxic"] + (1 - 2 * told["toxic"]) * held_out(told["doc_id"]).cast("int"))
    assert turned.where("toxic = 1").count() != told.where("toxic = 1").count()
    assert fit_toxicity(docs, told) == fit_toxicity(docs, turned)


def test_odd_rows(spark, model):
    long = "river " * 150_000 + "m0r0n"
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "idiot stupid"), (3, "x" * 200_000), (4, long), (4, long), (5, "1" * 5000 + "a")], DOCS)
    clash = docs.selectExpr("*", "1 as score", "2 as terms", "map('a', 1) as toxic", "3 as _x")
    found = score_toxicity(clash, model).collect()
    assert len(found) == 7 and [r.score for r in found if r.doc_id in (1, 2)] == pytest.approx([1 / (1 + np.exp(-model.base))] * 2)
    assert all(r.predicted == 1 for r in found if r.doc_id is None or r.doc_id == 4)
    assert score_toxicity(docs.where("false"), model).collect() == []
    assert [r.restored for r in restore_texts(docs.where("doc_id = 1 or doc_id = 2"), model).orderBy("doc_id").collect()] == [None, ""]


def test_fitting_odd_labels(spark):
    rows, labels = corpus(200)
    docs, told = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    noisy = told.union(told).union(spark.createDataFrame([(None, 1, 1), (5, None, 1), (99_999, 1, 1)], LABELS))
    assert fit_toxicity(docs, noisy).weights == fit_toxicity(docs, told).weights
    empty = fit_toxicity(docs.where("false"), told.where("false"))
    assert empty.weights == {} and 0 < 1 / (1 + np.exp(-empty.base)) < 1
