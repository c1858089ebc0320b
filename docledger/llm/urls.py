"""URL filter: allow and block rules first, gradient-boosted trees on lexical features for the rest."""

from __future__ import annotations

import math
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docledger.llm.trees import Forest, fit_forest
from docledger.session import cut_lineage

#: Labelled URLs the trees are fitted to, at most (in expectation); they are drawn by hash.
SAMPLE_ROWS = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The rules (verdict, host and path), and words that mark a host as unwanted for the labels.
RULES = (
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"),
)
UNWANTED = (
    "adult", "ads", "bet", "bets", "betting", "casino", "cheap", "gambling", "phish", "pills", "poker", "porn", "sex",
    "spam", "spyware", "track", "tracker", "viagra", "warez", "xxx",
)


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def compile_rules(rules: tuple[tuple[str, str], ...], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda pair: len(pair[1])):
        site, slash, rest = text.partition("/")
        fits = ((host == site) | host.endswith("." + site)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def label_url(host: Column, path: Column | None = None) -> Column:
    """1 if a word of the host, or a whole directory of the path, is an unwanted one; words are cut at dots, hyphens and digits."""
    unwanted = F.array(*map(F.lit, UNWANTED))
    named = F.arrays_overlap(F.split(host, "[^a-z]+"), unwanted)
    if path is not None:
        named = named | F.arrays_overlap(F.split(F.translate(path, UPPER, LOWER), "/"), unwanted)
    return named.cast("int")


#: Lexical features, in the order of the matrix; the last two come from the labelled URLs of other sites.
FEATURES = (
    "url_length", "host_length", "path_length", "host_parts", "depth", "longest_part", "hyphens", "host_digit_share",
    "digit_share", "host_entropy", "entropy", "parameters", "query_length", "fragment", "secure", "vowel_share",
    "host_words", "shortest_host_word", "path_words", "consonant_run", "suffix_rate", "word_rate",
)
_TO_LOWER = str.maketrans(UPPER, LOWER)
_PARTS = re.compile(r"^(.*?)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$", re.DOTALL)
#: Sites of average rate that a suffix and a word are given beside their own.
_SUFFIX_PRIOR, _WORD_PRIOR = 5.0, 0.5
#: Shares of a site's pages that are joined apart.
_SALTS = 16
#: Folds of sites; a site is described by the labels of the other ones.
_FOLDS = 5
_WORD, _CONSONANTS = re.compile("[a-z]+"), re.compile("[b-df-hj-np-tv-z]+")


class UrlModel(NamedTuple):
    forest: Forest
    sites: DataFrame  #: _site, bad: share of unwanted URLs of every labelled site
    average: float  #: of the sites


def _entropy(text: str) -> float:
    size = len(text)
    return -sum(n / size * math.log2(n / size) for n in Counter(text).values()) if size else 0.0


def _share(text: str, marks: str) -> float:
    return sum(map(text.count, marks)) / max(1, len(text))


def _site(host: Column) -> Column:
    """The host's last three parts; its last two are the suffix."""
    return F.substring_index(host, ".", -3)


def _suffix(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def _split(url: str) -> tuple[str, str, str, str, str]:
    match = _PARTS.match(url)
    scheme, host, path, query, fragment = match.groups("") if match else ("", "", url, "", "")
    return scheme, host.translate(_TO_LOWER), path, query, fragment


def lexical(url: str, suffix_rate: float, word_rate: float) -> list[float]:
    scheme, host, path, query, fragment = _split(url)
    parts = host.split(".")
    name = host[: -len(".".join(parts[-2:]))] if len(parts) > 2 else host
    words = _WORD.findall(name)
    return [
        len(url), len(host), len(path), len(parts), len([part for part in path.split("/") if part]), max(map(len, parts)),
        host.count("-"), _share(host, "0123456789"), _share(url, "0123456789"), _entropy(host), _entropy(url),
        query.count("=") + query.count("&"), len(query), bool(fragment), scheme == "https", _share(host, "aeiou"),
        len(words), min(map(len, words), default=0), len(_WORD.findall(path.lower())), max(map(len, _CONSONANTS.findall(name)), default=0), suffix_rate, word_rate,
    ]


def _rates(sites: DataFrame, known: DataFrame, average: float) -> DataFrame:
    """_site, _suffix_rate, _word_rate for every row of ``sites`` (_site): unwanted shares of sites in the other folds.

    The suffix is the host's last two parts; of the words before it the worst counts. Sites fall into
    folds by hash, and a site's own fold is left out: sites of one fold and part have the same rate,
    so it tells nothing about a site's own label, and a labelled site is judged like one never seen.
    A site has a handful of parts; the parts' totals have one row a fold.
    """
    words = F.filter(F.split(F.regexp_replace("_site", r"\.?[^.]*\.[^.]*$", ""), "[^a-z]+"), lambda word: F.length(word) > 1)
    parts = F.explode(F.concat(F.array(F.concat(F.lit("."), _suffix(F.col("_site")))), F.array_distinct(words))).alias("_part")
    fold = F.pmod(F.xxhash64("_site", F.lit("fold")), F.lit(_FOLDS)).alias("_fold")
    totals = known.select("bad", fold, parts).groupBy("_part", "_fold").agg(F.count(F.lit(1)).alias("seen"), F.sum("bad").alias("bad"))
    whole = totals.groupBy("_part").agg(F.sum("seen").alias("all_seen"), F.sum("bad").alias("all_bad"))
    joined = sites.select("_site", fold, parts).join(totals, ["_part", "_fold"], "left").join(whole, "_part", "left").na.fill(0)
    is_suffix = F.startswith("_part", F.lit("."))
    prior = F.when(is_suffix, _SUFFIX_PRIOR).otherwise(_WORD_PRIOR)
    rated = joined.withColumn("_rate", (F.col("all_bad") - F.col("bad") + prior * average) / (F.col("all_seen") - F.col("seen") + prior))
    return rated.groupBy("_site").agg(
        F.max(F.when(is_suffix, F.col("_rate"))).alias("_suffix_rate"),
        F.coalesce(F.max(F.when(~is_suffix, F.col("_rate"))), F.lit(average)).alias("_word_rate"))


def fit_urls(labelled: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> UrlModel:
    """Model from (url, label) rows: shares of all sites, and trees fitted to a hash sample of ``sample_rows`` distinct URLs.

    The shares stay a table; only the sample reaches the driver. Every URL, sampled or judged, is
    described by other sites of its suffix and words, so the trees cannot learn hosts by heart.
    """
    usable = labelled.where(F.col("url").isNotNull() & F.col("label").isNotNull()).groupBy("url").agg(F.max("label").alias("label"))
    placed = usable.withColumn("_site", _site(host_of(F.col("url"))))
    counts = cut_lineage(placed.groupBy("_site").agg(F.count(F.lit(1)).alias("seen"), F.avg("label").alias("bad")))
    total, average = counts.agg(F.coalesce(F.sum("seen"), F.lit(0)), F.coalesce(F.avg("bad"), F.lit(0.0))).first()
    sites = counts.select("_site", "bad")
    place = F.shiftrightunsigned(F.xxhash64("url"), 4)
    sample = placed.where(place < int(2**60 * min(1.0, sample_rows / max(1, total))))
    rated = sample.join(_rates(sites.select("_site"), sites, average), "_site").select("url", "label", "_suffix_rate", "_word_rate")
    rows = rated.orderBy("url").collect()
    matrix = np.array([lexical(row.url, row._suffix_rate, row._word_rate) for row in rows], float).reshape(len(rows), len(FEATURES))
    return UrlModel(fit_forest(matrix, np.array([row.label for row in rows], float), trees=40, depth=2), sites, average)


def judge_urls(
    pages: DataFrame, model: UrlModel, *, url: str = "url", rules: tuple[tuple[str, str], ...] = RULES
) -> DataFrame:
    """``pages`` with host, path, rule, score (chance that the URL is unwanted) and verdict.

    A null URL, or one without ``://``, has an empty host and path and fits no rule; the model then
    scores its text. Rows are joined to the rates of their site's suffix and words, average where no
    other site has them; equal scores get equal verdicts. Columns named like a result are replaced.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model.forest)

    @F.arrow_udf(T.DoubleType())
    def unwanted(urls: pa.Array, suffix_rates: pa.Array, word_rates: pa.Array) -> pa.Array:
        parts = zip(urls.to_pylist(), suffix_rates.to_pylist(), word_rates.to_pylist(), strict=True)
        rows = np.array([lexical(value or "", *rates) for value, *rates in parts], float)
        return pa.array(shared.value.score(rows.reshape(-1, len(FEATURES))), pa.float64())

    split = pages.withColumns({"_url": F.col(url), "host": host_of(F.col(url)), "path": path_of(F.col(url))})
    placed = split.withColumns({"_site": _site(F.col("host")), "_salt": F.pmod(F.xxhash64("_url"), F.lit(_SALTS))})
    # pages are counted down before the joins, and a site of many pages is dealt out by salt
    shares = placed.select("_site", "_salt").distinct()
    rates = shares.join(_rates(shares.select("_site").distinct(), model.sites, model.average), "_site")
    rated = placed.join(rates, ["_site", "_salt"], "left")
    rule, says = compile_rules(rules, F.col("host"), F.col("path"))
    scored = rated.withColumns({"rule": rule, "_says": says, "score": unwanted("_url", "_suffix_rate", "_word_rate")})
    return scored.withColumn(
        "verdict", F.coalesce("_says", F.when(F.col("score") >= 0.5, F.lit("block")).otherwise(F.lit("allow")))
    ).drop("_says", "_url", "_site", "_salt", "_suffix_rate", "_word_rate")
