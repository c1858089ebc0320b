"""Ground-truth values matched to recognised spans: candidates, pruning, ranking, assignment."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher
from statistics import median

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from docledger.functions.ordinals import LARGE, number_rows, split_groups
from docledger.functions.text import collapse, compose, EDGE, fold_accents, NOT_IDENTIFIER, normalize_text, separated, strip
from docledger.functions.values import compatible_date, number_text
from docledger.labels import VALUE_PREFIXES
from docledger.operators.geometry import PAGE, normalize_bbox
from docledger.session import cut_lineage, spread

FIELD = ("document_id", "field_path")
SPAN = ("page_index", "start", "size")
# Longest span, thresholds and confidences of the match cascade, in trial order.
MAX_BOXES, MIN_SUBSTRING, SUBSTRING_RATIO, MIN_FUZZY, FUZZY_RATIO = 12, 3, 0.55, 4, 0.84
CASCADE = (
    ("exact", 1.0), ("whitespace_normalized", 0.995), ("anchored_exact_normalized", 0.985), ("exact_normalized", 0.99),
    ("identifier_normalized", 0.98), ("number_normalized", 0.98), ("date_normalized", 0.98),
)
# What a printed date, number or unit looks like once accents are folded.
DATE_TEXT = r"^(?:\d{1,4}[./-]\d{1,2}[./-]\d{1,4}|ngay\s+\d{1,2}\s+thang\s+\d{1,2}\s+nam\s+\d{4})$"
NUMBER_TEXT = r"^[+-]?\s*\d+(?:[.\s]\d+)*\s*(?:%|vnd|d|dong)?$"
NUMBER_SUFFIX = r"\s*(?:%|vnd|d|dong)\s*$"
#: Regions times fields up to which a page compares its spans with its fields in place.
PAGE_PAIRS = 50_000


# ---------------------------------------------------------------- spans
# First words of the printed prefixes, and the letters a prefix, unit or date may add to a value.
PREFIX_STARTS = tuple(dict.fromkeys(p.split(" ")[0] for group in VALUE_PREFIXES.values() for p in group))
PREFIX_LETTERS = max(len(p) for group in VALUE_PREFIXES.values() for p in group)
UNIT_OR_DATE_LETTERS = max(len("ngaythangnam"), len("dong"))
# What each of the letters a-z and digits 1-9 adds to a print (:func:`_print`), by its place after "0".
LETTER_PRINTS = [pow(31, ord(c), 2**31 - 1) if c in "123456789abcdefghijklmnopqrstuvwxyz" else 0 for c in map(chr, range(ord("0"), ord("z") + 1))]


def _print_of(text: str) -> int:
    return sum(LETTER_PRINTS[ord(c) - ord("0")] for c in text if "0" <= c <= "z")


def _print(folded: Column) -> Column:
    """A sum over the letters and digits but zero of a folded text, whatever their order: texts that any equality rule
    takes as equal have equal prints, and the print of a span is the sum of its regions'."""
    weights = F.array(*map(F.lit, LETTER_PRINTS)).cast("array<bigint>")
    letters = F.split(F.regexp_replace(folded, "[^1-9a-z]+", ""), "")
    return F.aggregate(letters, F.lit(0).cast("bigint"), lambda total, c: total + F.when(c == "", 0).otherwise(
        F.element_at(weights, F.ascii(c) - (ord("0") - 1))))


def _parts(regions: DataFrame, longest: DataFrame | None) -> DataFrame:
    """Regions with the one struct of what their spans need, and the length of the longest value of their page."""
    slim = regions.where("y_min is not null").select(
        *PAGE, "region_id", strip(F.col("text")).alias("raw"), compose(strip(F.col("text"))).alias("text"), "x_min", "y_min", "x_max", "y_max")
    started = fold_accents(normalize_text(F.col("text"), composed=True))
    weight, starts, print_, norm = F.lit(0), F.lit(False), F.lit(0).cast("bigint"), F.lit("")  # only asked for beside a longest value
    if longest is not None:
        norm = separated(F.col("text"))
        print_ = F.coalesce(_print(started), F.lit(0))
        weight = F.length(F.regexp_replace(F.regexp_replace(started, NOT_IDENTIFIER, ""), "0+", ""))
        starts = (started == "") | started.rlike(rf"^(?:{'|'.join(PREFIX_STARTS)})(?![a-z0-9])")
    placed = slim.withColumn("_weight", weight).withColumn("_starts", starts).withColumn("_print", print_).withColumn("_norm", norm)
    return placed.select(*PAGE, "y_min", "x_min", "region_id", F.struct(
        "region_id", "raw", "text", "x_min", "y_min", "x_max", "y_max", "_weight", "_starts", "_print", "_norm").alias("_part"))


def _page_runs(parts: DataFrame, longest: DataFrame | None, max_boxes: int) -> DataFrame:
    """The run ahead of every region, on pages that one task can order: rows are dealt by page once."""
    dealt = spread(parts, *PAGE)
    dealt = dealt.withColumn("_longest", F.lit(None).cast("int")) if longest is None else dealt.join(longest, list(PAGE))
    order = Window.partitionBy(*PAGE).orderBy("y_min", "x_min", "region_id")
    return dealt.select(
        *PAGE, F.row_number().over(order).cast("bigint").alias("start"), "_longest",
        F.collect_list("_part").over(order.rowsBetween(0, max_boxes - 1)).alias("_run"))


def _block_runs(parts: DataFrame, longest: DataFrame | None, max_boxes: int, band: float, block: int) -> DataFrame:
    """The same on longer pages: numbered in two levels and cut into blocks, each of which also receives the
    first ``max_boxes - 1`` regions of the next one, so a window of that fixed length never needs a page."""
    banded = parts.withColumn("_band", F.floor(F.col("y_min") / band))
    placed = number_rows(banded, PAGE, "_band", [F.col("y_min"), F.col("x_min"), F.col("region_id")], "_pos")
    placed = placed.withColumn("_longest", F.lit(None).cast("int")) if longest is None else placed.join(longest, list(PAGE))
    place = F.col("_pos") - 1
    own = F.floor(place / block)
    shared = (place % block < max_boxes - 1) & (own > 0)
    blocks = placed.withColumn("_own", own).withColumn("_block", F.explode(F.when(shared, F.array(own, own - 1)).otherwise(F.array(own))))
    ahead = Window.partitionBy(*PAGE, "_block").orderBy("_pos").rowsBetween(0, max_boxes - 1)
    runs = spread(blocks, *PAGE, "_block").withColumn("_run", F.collect_list("_part").over(ahead)).where("_own = _block")
    return runs.select(*PAGE, F.col("_pos").alias("start"), "_longest", "_run")


def _sized(runs: DataFrame, weighed: bool) -> DataFrame:
    """Every beginning of a run as one span. Texts and sums grow along the run, so each region is read once a run."""
    def said(before: Column, text: Column) -> Column:
        now = F.coalesce(text, F.lit(""))
        return F.when(now == "", before).when(before == "", now).otherwise(F.concat_ws(" ", before, now))

    sums = ("text", "raw", "x", "y", "high", "weight", *(("print", "norm") if weighed else ()))

    def step(text, raw, x, y, high, weight, *more, row) -> Column:
        extra = [(more[0] + row["_print"]).alias("print"), said(more[1], row["_norm"]).alias("norm")] if more else []
        return F.struct(
            said(text, row["text"]).alias("text"), said(raw, row["raw"]).alias("raw"), (x + (row["x_min"] + row["x_max"]) / 2).alias("x"),
            (y + (row["y_min"] + row["y_max"]) / 2).alias("y"), (high + (row["y_max"] - row["y_min"])).alias("high"),
            (weight + row["_weight"]).alias("weight"), *extra, row["x_max"].alias("right"))

    none, zero = F.lit(""), F.lit(0.0)
    first = F.array(step(none, none, zero, zero, zero, F.lit(0), *((F.lit(0).cast("bigint"), none) if weighed else ()), row=F.col("_run")[0]))

    def grown(found: Column, row: Column) -> Column:
        last = F.element_at(found, -1)
        return F.concat(found, F.array(step(*[last[n] for n in sums], row=row)))

    ahead = F.aggregate(F.slice("_run", 2, F.greatest(F.size("_run") - 1, F.lit(0))), first, grown)
    head = F.col("_run")[0]
    sized = runs.select(
        *PAGE, "start", "_longest", F.transform("_run", lambda r: r["region_id"]).alias("_ids"), head["x_min"].alias("_left"), head["_starts"].alias("_starts"),
        F.posexplode(ahead).alias("_at", "_s")).withColumn("size", F.col("_at") + 1)
    if weighed:
        carried = F.col("_s.weight")
        bare = F.greatest(F.col("_longest") / SUBSTRING_RATIO, F.col("_longest") + UNIT_OR_DATE_LETTERS)
        sized = sized.where((carried <= bare) | (F.col("_starts") & (carried <= bare + PREFIX_LETTERS)))
    return sized.where("_s.text <> ''").select(
        *PAGE, "start", "size", F.slice("_ids", 1, F.col("size")).alias("region_ids"), F.col("_s.text").alias("text"), F.col("_s.raw").alias("raw"),
        (F.col("_s.x") / F.col("size")).alias("center_x"), (F.col("_s.y") / F.col("size")).alias("center_y"),
        (F.col("_s.high") / F.col("size")).alias("mean_height"), (F.col("_s.right") - F.col("_left")).alias("span_width"),
        *([F.col("_s.print").alias("_print"), F.btrim(F.col("_s.norm"), F.lit(EDGE)).alias("_norm")] if weighed else []))


def spans(
    regions: DataFrame, *, max_boxes: int = MAX_BOXES, band: float = 200.0, block: int = 1024, longest: DataFrame | None = None, large: int = LARGE
) -> DataFrame:
    """Every run of 1..max_boxes regions that follow each other on a page.

    ``longest`` (page, ``_longest`` value length) leaves out runs that no value of the page can match:
    a run weighs its letters and digits, accents folded and zeros left out, which is the least that
    any rule compares; a match adds at most a prefix, a unit or the words of a date to the value's
    own, or the surplus that containment allows.

    Pages of more than ``large`` regions are cut into blocks, all others are read where they are dealt.
    """
    if max_boxes <= 0:
        raise ValueError("max_boxes must be positive")
    usual, long = split_groups(regions, PAGE, large)
    runs = _page_runs(_parts(usual, longest), longest, max_boxes)
    if long is not None:
        runs = runs.unionByName(_block_runs(_parts(long, longest), longest, max_boxes, band, block))
    return _sized(runs, longest is not None).drop("_print", "_norm")


def gate_pages(fields: DataFrame, regions: DataFrame) -> DataFrame:
    """Fields with the pages they may match on: their own page if it was recognised, else every page of the document."""
    pages = regions.select("document_id", F.col("page_index").alias("match_page")).distinct()
    own = pages.select("document_id", F.col("match_page").alias("page_index"), F.lit(True).alias("_own"))
    known = fields.join(own, ["document_id", "page_index"], "left")
    return known.where("_own").withColumn("match_page", F.col("page_index").cast("bigint")).drop("_own").unionByName(
        known.where("_own is null").drop("_own").join(pages, "document_id").withColumn("match_page", F.col("match_page").cast("bigint")))


# ---------------------------------------------------------------- match cascade
def _number_key(text: Column) -> Column:
    return number_text(text)


def anchored(label: str, folded: Column) -> Column:
    """Text after the first printed prefix of the label; null when there is none or nothing follows."""
    tries = F.lit(None).cast("string")
    for prefix in reversed(VALUE_PREFIXES[label]):
        rest = F.trim(F.substring(folded, F.lit(len(prefix) + 2), F.lit(2147483647)))
        tries = F.when(folded.startswith(f"{prefix} "), F.nullif(rest, F.lit(""))).otherwise(tries)
    return tries


def _key(kind: str, value: Column) -> Column:
    return F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"{kind}:"), value))


def _keys(columns: list[Column]) -> Column:
    return F.array_distinct(F.filter(F.array(*columns), lambda k: k.isNotNull()))


def _field_keys(fields: DataFrame) -> DataFrame:
    """Normal forms of the values and the keys under which a span may equal them."""
    plain = F.col("_plain")
    kind = F.col("normalization_kind")
    formed = fields.withColumn("_plain", compose(strip(F.col("gt_value")))).withColumn("_norm", normalize_text(plain, composed=True)).withColumn(
        "_fold", fold_accents(F.col("_norm")))
    number = F.when(kind.isin("number", "money"), _number_key(F.col("gt_value")))
    day = F.when(kind == "date", compatible_date(plain))
    has_prefix = F.col("label").isin(*VALUE_PREFIXES)
    tagged = F.when(has_prefix, F.col("label"))
    return formed.withColumn("_number", number).withColumn("_day", day).withColumn("_keys", _keys([
        F.when(F.col("_norm") != "", F.concat(F.lit("n:"), "_norm")).otherwise(F.concat(F.lit("w:"), collapse(plain))),
        F.when(kind == "identifier", _key("i", F.regexp_replace("_norm", NOT_IDENTIFIER, ""))),
        _key("m", F.col("_number")), _key("d", F.col("_day")),
        _key("a", F.concat_ws("/", tagged, F.when(has_prefix, F.col("_fold")))),
        _key("m", F.when(has_prefix & F.col("_number").isNotNull(), F.concat_ws("/", "label", "_number"))),
        _key("d", F.when(has_prefix & F.col("_day").isNotNull(), F.concat_ws("/", "label", "_day"))),
    ]))


def _prints() -> Column:
    """The prints of the spans that may equal a formed field: its own, that of its number with a unit or of its date with
    the words of one, and each of them behind a printed prefix of its label."""
    prefixes = F.create_map(*[c for label, group in VALUE_PREFIXES.items() for c in (
        F.lit(label), F.array(F.lit(0), *[F.lit(_print_of(p)) for p in group]).cast("array<bigint>"))])
    none = F.array(F.lit(0)).cast("array<bigint>")

    def beside(value: Column, words: Sequence[str]) -> Column:
        own = _print(value)
        return F.when(value.isNotNull(), F.array(*[own + F.lit(_print_of(w)) for w in ("", *words)])).otherwise(F.array().cast("array<bigint>"))

    bare = F.concat(beside(F.col("_fold"), ()), beside(F.col("_number"), ("vnd", "d", "dong")), beside(F.col("_day"), ("ngaythangnam",)))
    ahead = F.coalesce(F.try_element_at(prefixes, F.col("label")), none)
    return F.array_distinct(F.flatten(F.transform(ahead, lambda p: F.transform(bare, lambda b: b + p))))


def _span_keys(formed: DataFrame) -> DataFrame:
    """(span, key) rows. Only spans that print a number, a date or a known prefix pay for parsing."""
    fold = F.col("_fold")
    ident = [c for c in formed.columns if c not in ("_norm", "_fold")]

    def number_of(value: Column) -> Column:
        return F.when(value.rlike(NUMBER_TEXT), _number_key(F.trim(F.regexp_replace(value, NUMBER_SUFFIX, ""))))

    def day_of(value: Column, printed: Column) -> Column:
        return F.when(value.rlike(DATE_TEXT), compatible_date(printed))

    plain = formed.select(*ident, F.explode(_keys([
        F.when(F.col("_norm") != "", F.concat(F.lit("n:"), "_norm")).otherwise(F.concat(F.lit("w:"), collapse(F.col("text")))),
        _key("i", F.regexp_replace("_norm", NOT_IDENTIFIER, ""))])).alias("_key"))
    typed = formed.where(fold.rlike(NUMBER_TEXT) | fold.rlike(DATE_TEXT)).select(
        *ident, F.explode(_keys([_key("m", number_of(fold)), _key("d", day_of(fold, F.col("text")))])).alias("_key"))
    prefixes = sorted({p for group in VALUE_PREFIXES.values() for p in group}, key=len, reverse=True)
    rests = F.array(*[F.struct(F.lit(label).alias("label"), anchored(label, fold).alias("rest")) for label in VALUE_PREFIXES])
    told = formed.where(fold.rlike(f"^(?:{'|'.join(prefixes)}) ")).select(*ident, F.explode(rests).alias("_a")).where("_a.rest is not null")
    rest, label = F.col("_a.rest"), F.col("_a.label")
    anchors = told.select(*ident, F.explode(_keys([
        _key("a", F.concat_ws("/", label, rest)), _key("m", F.concat(label, F.lit("/"), number_of(rest))),
        _key("d", F.concat(label, F.lit("/"), day_of(rest, rest)))])).alias("_key"))
    return plain.unionByName(typed).unionByName(anchors)


def _span_key_array(fold: Column) -> Column:
    """The keys of one span in its own row, for pages whose fields meet their spans in place."""
    def number_of(value: Column) -> Column:
        return F.when(value.rlike(NUMBER_TEXT), _number_key(F.trim(F.regexp_replace(value, NUMBER_SUFFIX, ""))))

    def day_of(value: Column, printed: Column) -> Column:
        return F.when(value.rlike(DATE_TEXT), compatible_date(printed))

    def told(row: Column) -> Column:
        rest, label = row["rest"], row["label"]
        return _keys([
            _key("a", F.concat_ws("/", label, rest)), _key("m", F.concat(label, F.lit("/"), number_of(rest))),
            _key("d", F.concat(label, F.lit("/"), day_of(rest, rest)))])

    none = F.array().cast("array<string>")
    plain = _keys([
        F.when(F.col("_norm") != "", F.concat(F.lit("n:"), "_norm")).otherwise(F.concat(F.lit("w:"), collapse(F.col("text")))),
        _key("i", F.regexp_replace("_norm", NOT_IDENTIFIER, ""))])
    typed = F.when(fold.rlike(NUMBER_TEXT) | fold.rlike(DATE_TEXT), _keys([_key("m", number_of(fold)), _key("d", day_of(fold, F.col("text")))])).otherwise(none)
    prefixes = sorted({p for group in VALUE_PREFIXES.values() for p in group}, key=len, reverse=True)
    rests = F.array(*[F.struct(F.lit(label).alias("label"), anchored(label, fold).alias("rest")) for label in VALUE_PREFIXES])
    anchors = F.when(fold.rlike(f"^(?:{'|'.join(prefixes)}) "), F.flatten(F.transform(
        F.filter(rests, lambda row: row["rest"].isNotNull()), told))).otherwise(none)
    return F.concat(plain, typed, anchors)


SPAN_FACTS = ("region_ids", "center_x", "center_y", "mean_height", "span_width")


# ---------------------------------------------------------------- near values
#: Buckets of the gram counts that tell rare grams from frequent ones.
RARITY_BUCKETS = 4096
#: The key of values too short on letters to be cut; every region has it.
_ANY = "*any*"


def _tokens(norm: Column) -> Column:
    """Parts of a normalised text that trimming never touches and no two regions share."""
    return F.filter(F.split(norm, "[ .'\"-]+"), lambda token: token != "")


def _grams(norm: Column) -> Column:
    """All different pieces of one to three characters inside tokens."""
    def pieces(token: Column, size: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(token) - size + 1), lambda at: F.substring(token, at, size))

    def sizes(token: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.least(F.lit(3), F.length(token))), lambda size: pieces(token, size))

    return F.array_distinct(F.flatten(F.flatten(F.transform(_tokens(norm), sizes))))


def _cut(norm: Column, size: int) -> Column:
    """Pieces of ``size`` characters that lie side by side inside tokens."""
    def pieces(token: Column) -> Column:
        whole = F.floor(F.length(token) / size).cast("int")
        return F.when(whole > 0, F.transform(F.sequence(F.lit(0), whole - 1), lambda k: F.substring(token, k * size + 1, F.lit(size)))).otherwise(F.array())

    return F.flatten(F.transform(_tokens(norm), pieces))


def _rarity(singles: DataFrame) -> DataFrame:
    """One row: how often grams of each hash bucket occur in regions. Only the speed depends on it."""
    spread_out = singles.select(F.explode(_grams(F.col("_norm"))).alias("_gram")).select(_bucket(F.col("_gram")).alias("_bucket"), F.lit(1).alias("_n"))
    every = singles.sparkSession.range(RARITY_BUCKETS).select(F.col("id").alias("_bucket"), F.lit(0).alias("_n"))
    counts = spread_out.groupBy("_bucket").agg(F.sum("_n").alias("_n")).unionByName(every).groupBy("_bucket").agg(F.sum("_n").alias("_n"))
    return counts.agg(F.transform(F.array_sort(F.collect_list(F.struct("_bucket", "_n"))), lambda row: row["_n"]).alias("_rarity"))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(RARITY_BUCKETS))


def _rarest(grams: Column, count: Column | int) -> Column:
    rated = F.transform(grams, lambda gram: F.struct(F.element_at("_rarity", (_bucket(gram) + 1).cast("int")).alias("n"), gram.alias("gram")))
    return F.array_distinct(F.transform(F.slice(F.array_sort(rated), 1, count), lambda row: row["gram"]))


def _anchor(norm: Column) -> Column:
    """The rarest of the longest grams: what contains the text contains it."""
    grams = _grams(norm)
    longest = F.array_max(F.transform(grams, lambda gram: F.length(gram)))
    return F.element_at(_rarest(F.filter(grams, lambda gram: F.length(gram) == longest), 1), 1)


def _segments(norm: Column) -> Column:
    """Pieces of a value of which every similar text holds at least one, the rarest ones.

    With similarity r over lengths a and b at most (1 - r)(a + b) characters of either side are out of
    the matching blocks, and each of them spoils at most one piece. So one piece more than that, for
    the longest partner the value may have, leaves a whole one.
    """
    longest = F.floor(F.length(norm) * (2 / FUZZY_RATIO - 1) + 1e-9)
    needed = F.floor((1 - FUZZY_RATIO) * (F.length(norm) + longest) + 1e-9).cast("int") + 1
    found = F.array(F.lit(_ANY))
    for size in (1, 2, 3):
        found = F.when(F.size(_cut(norm, size)) >= needed, _rarest(_cut(norm, size), needed)).otherwise(found)
    return found


def _meet(fields: DataFrame, spans_: DataFrame, *keys: str, loose: bool) -> DataFrame:
    """Fields and spans of one document that share ``keys``; a field that knows its page meets that page only.

    ``loose`` says whether there are fields without a page at all.
    """
    own = fields.where("_page is not null").withColumnRenamed("_page", "page_index").join(spans_, ["document_id", "page_index", *keys])
    if not loose:
        return own
    return own.unionByName(fields.where("_page is null").drop("_page").join(spans_, ["document_id", *keys]))


def _near(fields: DataFrame, formed: DataFrame, *, fuzzy: bool, loose: bool, max_boxes: int) -> DataFrame:
    """Pairs of a field (_g) and a span (_o) on pages they may share, all contained or similar ones among them.

    Containment: the shorter text's rarest gram must be a gram of the longer one. A field sends its own
    to the regions of its pages; a region sends its own to the fields, and stays if the field contains
    all of it, as every region of a span does that lies inside the value. Similarity: the field sends
    its segments. A hit names a region; only the spans over such a region meet the field.
    """
    values = fields.where(F.length("_norm") >= MIN_SUBSTRING).select("document_id", "_page", "field_path", F.col("_norm").alias("_g"))
    singles = formed.where("size = 1").select(*PAGE, F.col("start").alias("_at"), "_norm").where("_norm <> ''")
    rarity = F.broadcast(_rarity(singles))  # one row
    sent = F.array(_anchor(F.col("_g")))
    if fuzzy:
        sent = F.array_distinct(F.concat(sent, F.when(F.length("_g") >= MIN_FUZZY, _segments(F.col("_g"))).otherwise(F.array())))
    asked = values.crossJoin(rarity).select("document_id", "_page", "field_path", "_g", F.explode(sent).alias("_gram"))
    region_grams = singles.select(*PAGE, "_at", F.explode(F.concat(_grams(F.col("_norm")), F.array(F.lit(_ANY)))).alias("_gram"))
    above = _meet(asked, region_grams, "_gram", loose=loose).drop("_gram")
    region_anchor = singles.crossJoin(rarity).select(*PAGE, "_at", "_norm", _anchor(F.col("_norm")).alias("_gram"))
    field_grams = values.select("document_id", "_page", "field_path", "_g", F.explode(_grams(F.col("_g"))).alias("_gram"))
    below = _meet(field_grams, region_anchor, "_gram", loose=loose).where(F.col("_g").contains(F.col("_norm"))).drop("_gram", "_norm")
    starts = above.unionByName(below).select(
        *PAGE, "field_path", "_g", "_at", F.explode(F.sequence(F.greatest(F.lit(1), F.col("_at") - max_boxes + 1), F.col("_at"))).alias("start"))
    first = starts.groupBy(*PAGE, "field_path", "_g", "start").agg(F.min("_at").alias("_at"))
    over = formed.select(*PAGE, "start", "size", F.col("_norm").alias("_o"), *SPAN_FACTS)
    a, b = F.length("_g"), F.length("_o")
    return first.join(over, [*PAGE, "start"]).where(
        (F.col("start") + F.col("size") > F.col("_at")) & (b >= a * (SUBSTRING_RATIO - 1e-9)) & (b <= a * (1 / SUBSTRING_RATIO + 1e-9))).drop("_at")


def _fields_and_pages(fields: DataFrame, regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fields with ``_page`` (null where their own page was not recognised: they may match on any), and the recognised pages."""
    pages = regions.groupBy("document_id", F.col("page_index").cast("bigint").alias("page_index")).agg(F.count(F.lit(1)).alias("_regions"))
    own = pages.select("document_id", "page_index", F.col("page_index").alias("_page"))
    kept = fields.select("document_id", "field_path", "label", "gt_value", "normalization_kind", F.col("page_index").cast("bigint").alias("page_index"))
    return kept.join(own, ["document_id", "page_index"], "left").drop("page_index"), pages


def match_cascade(
    fields: DataFrame, regions: DataFrame, *, max_boxes: int = MAX_BOXES, fuzzy: bool = True, page_pairs: int = PAGE_PAIRS
) -> DataFrame:
    """Candidate spans of every field with the first rule that fits.

    Where regions times fields of a page stay within ``page_pairs`` its spans are made and compared in
    place (:func:`_met_in_place`). On fuller pages equality rules are one equi-join on normal-form keys, and
    containment and similarity meet on grams and segments of the texts (:func:`_near`).
    """
    placed, pages = _fields_and_pages(fields, regions)
    # values are formed once; all joins read them
    keyed_fields = cut_lineage(_field_keys(placed).withColumn("_prints", _prints()))
    width, fields_there = F.max(F.length("_norm")), F.count(F.lit(1))
    anywhere = keyed_fields.where("_page is null").groupBy("document_id").agg(width.alias("_any"), fields_there.alias("_loose"))
    there = keyed_fields.where("_page is not null").groupBy("document_id", F.col("_page").alias("page_index")).agg(width.alias("_own"), fields_there.alias("_bound"))
    pairs = F.col("_regions") * (F.coalesce("_loose", F.lit(0)) + F.coalesce("_bound", F.lit(0)))
    asked = cut_lineage(pages.join(anywhere, "document_id", "left").join(there, list(PAGE), "left").select(
        *PAGE, F.greatest("_any", "_own").alias("_longest"), (pairs > page_pairs).alias("_full")).where("_longest is not null"))
    in_place, full = asked.where("not _full").drop("_full"), asked.where("_full").drop("_full")
    found = _met_in_place(keyed_fields, regions, in_place, max_boxes=max_boxes, fuzzy=fuzzy).unionByName(
        _met_by_keys(keyed_fields, regions, full, max_boxes=max_boxes, fuzzy=fuzzy))
    # dealt by field: pruning and ranking find the candidates of a field together
    found = found.repartition(*FIELD)
    facts = F.struct("_rank", "_method", "confidence", *SPAN_FACTS)
    best = found.groupBy(*FIELD, *SPAN).agg(F.min_by(facts, "_rank").alias("_b"))
    return best.select(
        *FIELD, *SPAN, *[F.col(f"_b.{c}").alias(c) for c in SPAN_FACTS],
        F.concat(F.when(F.col("size") > 1, "multi_box_").otherwise(""), F.col("_b._method")).alias("method"),
        F.col("_b.confidence").alias("confidence"), (F.col("_b._rank") >= 7).alias("inherently_ambiguous"))


def _method(rank: Column) -> Column:
    names = F.array(*[F.lit(n) for n, _ in CASCADE])
    return F.when((rank == 5) & (F.col("normalization_kind") == "money"), "money_normalized").otherwise(F.get(names, rank))


def _contained(g: Column, o: Column) -> Column:
    """Confidence of a pair of which one text contains enough of the other; null otherwise."""
    shorter, longer = F.least(F.length(g), F.length(o)), F.greatest(F.length(g), F.length(o))
    inside = (o.contains(g) | g.contains(o)) & (shorter / longer >= SUBSTRING_RATIO)
    return F.when(inside, F.least(F.lit(0.89), 0.72 + shorter / longer * 0.15))


def _met_in_place(keyed_fields: DataFrame, regions: DataFrame, pages: DataFrame, *, max_boxes: int, fuzzy: bool) -> DataFrame:
    """Candidates on pages of few pairs: regions and fields are dealt by page, and spans never leave their task."""
    bound = keyed_fields.where("_page is not null").withColumnRenamed("_page", "page_index").join(pages.select(*PAGE), list(PAGE), "left_semi")
    loose = keyed_fields.where("_page is null").drop("_page").join(pages.select(*PAGE), "document_id")
    asked = bound.unionByName(loose).select(
        *PAGE, "field_path", "normalization_kind", strip(F.col("gt_value")).alias("_told"), F.col("_norm").alias("_g"), F.length("_norm").alias("_a"),
        "_keys", "_prints")
    runs = _page_runs(_parts(regions.withColumn("page_index", F.col("page_index").cast("bigint")), pages), pages, max_boxes)
    formed = _sized(runs, True).select(*PAGE, "start", "size", "raw", "text", "_norm", F.length("_norm").alias("_b"), "_print", *SPAN_FACTS)
    # a page's fields are few: they are looked up, so that spans need no order
    met = formed.withColumn("_o", F.col("_norm")).join(asked.hint("shuffle_hash"), list(PAGE))
    a, b = F.col("_a"), F.col("_b")
    fitting = (a >= MIN_SUBSTRING) & (b >= a * (SUBSTRING_RATIO - 1e-9)) & (b <= a * (1 / SUBSTRING_RATIO + 1e-9))
    sure = F.when(fitting, _contained(F.col("_g"), F.col("_o")))
    near = sure.isNotNull()
    if fuzzy:
        near = near | (fitting & _close())
    # equal texts have equal prints; only a span whose print a field asks for is folded and parsed
    alike = F.array_contains("_prints", F.col("_print"))
    kept = met.where(alike | near).withColumn("_fold", F.when(alike, fold_accents(F.col("_norm"))))
    # the look at the partition's number, which always passes, keeps the last condition from being written out into the join
    here = F.spark_partition_id() >= 0
    kept = kept.withColumn("_printed", F.when(alike & here, _span_key_array(F.col("_fold"))).otherwise(F.array().cast("array<string>")))
    order = F.create_map(*[F.lit(x) for k, kind in enumerate("anim", 2) for x in (kind, k)], F.lit("d"), F.lit(6))
    kinds = F.transform(F.array_intersect("_keys", "_printed"), lambda key: F.try_element_at(order, F.substring(key, 1, 1)))
    rank = F.when(F.size(kinds) > 0, F.when(F.col("raw") == F.col("_told"), 0).when(
        collapse(F.col("raw")) == collapse(F.col("_told")), 1).otherwise(F.array_min(kinds)))
    ranked = kept.withColumn("_equal", rank).withColumn("_inside", sure)
    if fuzzy:
        unsure = F.col("_equal").isNull() & F.col("_inside").isNull() & fitting & _close()
        ranked = ranked.withColumn("_ratio", _sequence_ratio(F.when(unsure, F.col("_g")), F.when(unsure, F.col("_o"))))
    else:
        ranked = ranked.withColumn("_ratio", F.lit(None).cast("double"))
    scores = F.array(*[F.lit(c) for _, c in CASCADE])
    contained = F.col("_inside").isNotNull()
    return ranked.where(F.col("_equal").isNotNull() | contained | (F.col("_ratio") >= FUZZY_RATIO)).select(
        *FIELD, *SPAN, *SPAN_FACTS, F.coalesce("_equal", F.when(contained, 7).otherwise(8)).alias("_rank"),
        F.when(F.col("_equal").isNotNull(), _method(F.col("_equal"))).when(contained, "value_substring").otherwise("fuzzy").alias("_method"),
        F.coalesce(F.get(scores, F.col("_equal")), "_inside", "_ratio").alias("confidence"))


def _met_by_keys(keyed_fields: DataFrame, regions: DataFrame, longest: DataFrame, *, max_boxes: int, fuzzy: bool) -> DataFrame:
    """Candidates on full pages: spans and fields meet on keys, grams and segments only."""
    keyed_fields = keyed_fields.join(longest.select("document_id").distinct(), "document_id", "left_semi")
    runs = _block_runs(_parts(regions.join(longest.select(*PAGE), list(PAGE), "left_semi"), longest), longest, max_boxes, 200.0, 1024)
    formed = cut_lineage(_sized(runs, True).drop("_print").withColumn("_fold", fold_accents(F.col("_norm"))))
    f = keyed_fields.select("document_id", "_page", "field_path", "normalization_kind", strip(F.col("gt_value")).alias("_told"), F.explode("_keys").alias("_key"))
    loose = keyed_fields.where("_page is null").limit(1).count() > 0
    hit = _meet(f, _span_keys(formed), "_key", loose=loose)
    kind = F.substring("_key", 1, 1)
    rank = (
        F.when(F.col("raw") == F.col("_told"), 0).when(collapse(F.col("raw")) == collapse(F.col("_told")), 1)
        .when(kind == "a", 2).when(kind == "n", 3).when(kind == "i", 4).when(kind == "m", 5).when(kind == "d", 6))
    scores = F.array(*[F.lit(c) for _, c in CASCADE])
    equal = hit.withColumn("_rank", rank).where("_rank is not null").select(
        *FIELD, *SPAN, *SPAN_FACTS, "_rank", _method(F.col("_rank")).alias("_method"), F.get(scores, F.col("_rank")).alias("confidence"))
    near = _near(keyed_fields, formed, fuzzy=fuzzy, loose=loose, max_boxes=max_boxes)
    return equal.unionByName(_graded(near.withColumn("_inside", _contained(F.col("_g"), F.col("_o"))), fuzzy))


@F.pandas_udf(DoubleType())
def _sequence_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([None if a is None else SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right, strict=True)], dtype=float)


def _close() -> Column:
    """Whether the edit distance leaves room for the wanted similarity: with ratio r, 2M >= r(a + b) characters match
    in order, so at most (1 - r)(a + b) edits separate the texts."""
    a, b = F.length("_g"), F.length("_o")
    possible = (F.least(a, b) >= MIN_FUZZY) & (2 * F.least(a, b) >= FUZZY_RATIO * (a + b))
    bound = F.floor((1 - FUZZY_RATIO) * (a + b) + 1e-9)
    return F.when(possible, F.levenshtein(F.col("_g"), F.col("_o")) <= bound).otherwise(False)


def _graded(near: DataFrame, fuzzy: bool) -> DataFrame:
    """Candidates among near pairs: contained ones (_inside is their confidence), and those similar enough.

    The native edit distance bounds the similarity (:func:`_close`) before Python sees a pair.
    """
    if not fuzzy:
        graded = near.where("_inside is not null").withColumn("confidence", F.col("_inside"))
    else:
        kept = near.where(F.col("_inside").isNotNull() | _close())
        asked = F.col("_inside").isNull()
        ratio = _sequence_ratio(F.when(asked, F.col("_g")), F.when(asked, F.col("_o")))
        graded = kept.withColumn("confidence", F.coalesce("_inside", ratio)).where(F.col("_inside").isNotNull() | (F.col("confidence") >= FUZZY_RATIO))
    contained = F.col("_inside").isNotNull()
    return graded.select(
        *FIELD, *SPAN, *SPAN_FACTS, F.when(contained, 7).otherwise(8).alias("_rank"),
        F.when(contained, "value_substring").otherwise("fuzzy").alias("_method"), "confidence")


# ---------------------------------------------------------------- pruning and ranking
def prune_spans(candidates: DataFrame, *, max_boxes: int = MAX_BOXES) -> DataFrame:
    """Drop a candidate when a strictly smaller one inside it is at least as sure.

    What lies inside a span starts less than ``max_boxes`` regions after it, so a window of that range
    holds it (for spans of at most that size); the candidates of one field are never paired with each other.
    """
    ahead = Window.partitionBy(*FIELD, "page_index").orderBy("start").rangeBetween(0, max_boxes - 1)
    near = F.collect_list(F.struct("start", "size", "confidence")).over(ahead)
    size = F.when(F.col("size") <= max_boxes, F.col("size")).otherwise(F.raise_error(F.lit("a span is longer than max_boxes")).cast("int"))
    inside = F.exists("_near", lambda c: (
        (c["size"] < F.col("size")) & (c["start"] + c["size"] <= F.col("start") + F.col("size")) & (c["confidence"] >= F.col("confidence"))))
    known = F.col("document_id").isNotNull() & F.col("field_path").isNotNull() & F.col("page_index").isNotNull()
    return candidates.withColumn("size", size).withColumn("_near", near).where(~F.coalesce(inside & known, F.lit(False))).drop("_near")


def rank_candidates(pruned: DataFrame) -> DataFrame:
    """Keep the unambiguous ones where any exist; add ``position`` (1 = best) and ``candidate_count``."""
    field = Window.partitionBy(*FIELD)
    order = field.orderBy(F.desc("confidence"), "size", "page_index", "center_y", "center_x", "start")
    kept = pruned.withColumn("_strong", F.max(~F.col("inherently_ambiguous")).over(field)).where(
        ~F.col("_strong") | ~F.col("inherently_ambiguous")).drop("_strong")
    return kept.withColumn("position", F.row_number().over(order)).withColumn("candidate_count", F.count(F.lit(1)).over(field))


# ---------------------------------------------------------------- assignment
ANCHOR_ORDER = {"LINE_NUMBER": 0, "MEDICINE_NAME": 1, "RAW_DESCRIPTION": 2, "LOT_NUMBER": 3}
MATCH_SCHEMA = (
    "document_id string, field_path string, label string, page_index bigint, region_ids array<string>, match_method string, "
    "match_confidence double, ambiguous boolean, duplicate_candidates boolean, candidate_count bigint")


def order_fields(fields: DataFrame) -> DataFrame:
    """Walk order inside a document: document-level values, then items, anchors first."""
    anchor = F.coalesce(F.try_element_at(F.create_map(*[c for k, v in ANCHOR_ORDER.items() for c in (F.lit(k), F.lit(v))]), F.col("label")), F.lit(10))
    return fields.withColumn("_order", F.struct(
        F.col("item_index").isNotNull().alias("item"), F.col("invoice_index"), F.coalesce("item_index", F.lit(-1)).alias("at"), anchor.alias("anchor"), "field_path"))


class _Walk:
    """State of one document while its fields are settled in order."""

    def __init__(self) -> None:
        self.fields: dict[str, dict] = {}
        self.used: set[str] = set()
        self.rows: dict[tuple, list[float]] = {}
        self.columns: dict[str, list[float]] = {}

    def add(self, row: dict) -> None:
        field = self.fields.setdefault(row["field_path"], {**row, "options": []})
        if row["region_ids"] is not None:
            field["options"].append(row)

    def _free(self, field: dict) -> list[dict]:
        return [o for o in field["options"] if self.used.isdisjoint(o["region_ids"])]

    def _by_geometry(self, field: dict, free: list[dict]) -> tuple | None:
        """The option nearest to where the row and the column of this item have been seen."""
        row = self.rows.get((field["invoice_index"], field["item_index"]))
        column = self.columns.get(field["label"])
        if not row and not column:
            return None

        def distance(o: dict) -> float:
            off = abs(o["center_y"] - median(row)) / max(o["mean_height"], 1.0) if row else 0.0
            return off + (abs(o["center_x"] - median(column)) / max(o["span_width"], 1.0) if column else 0.0)

        ranked = sorted(((distance(o), -o["confidence"], o["center_y"], i) for i, o in enumerate(free)))
        nearest, lead = ranked[0][0], (ranked[1][0] if len(ranked) > 1 else float("inf")) - ranked[0][0]
        if nearest <= 4.0 and lead >= 0.5:
            pick = free[ranked[0][3]]
            return pick, "item_row_column_geometry", min(pick["confidence"], max(0.85, 0.98 - 0.03 * nearest))
        return None

    def _by_order(self, field: dict, free: list[dict]) -> tuple | None:
        """Equal values of one column: when there are as many spans as items, they correspond in order."""
        same = [
            f for f in self.fields.values() if f["item_index"] is not None and all(
                f[k] == field[k] for k in ("invoice_index", "label", "_value", "field_page"))]
        offered: dict[tuple, dict] = {}
        for peer in same:
            for o in peer["options"]:
                offered.setdefault(tuple(o["region_ids"]), o)
        if len(same) < 2 or len(offered) != len(same):
            return None
        items = sorted(same, key=lambda f: f["item_index"])
        places = sorted(offered.values(), key=lambda o: (o["center_y"], o["center_x"]))
        pick = places[[f["field_path"] for f in items].index(field["field_path"])]
        if any(o["region_ids"] == pick["region_ids"] for o in free):
            return pick, "item_order", min(0.94, pick["confidence"])
        return None

    def settle(self) -> Iterator[tuple]:
        for field in self.fields.values():
            free = self._free(field)
            if not free:
                continue
            chosen = None
            if len(free) == 1:
                chosen = free[0], free[0]["method"], free[0]["confidence"]
            elif field["item_index"] is not None:
                chosen = self._by_geometry(field, free) or self._by_order(field, free)
            unsure = chosen is None
            pick, method, confidence = chosen or (free[0], free[0]["method"], min(free[0]["confidence"], 0.75))
            ambiguous = unsure or pick["inherently_ambiguous"]
            if not ambiguous:
                self.used.update(pick["region_ids"])
                if field["item_index"] is not None:
                    self.rows.setdefault((field["invoice_index"], field["item_index"]), []).append(pick["center_y"])
                    self.columns.setdefault(field["label"], []).append(pick["center_x"])
            total = len(field["options"])
            yield (field["document_id"], field["field_path"], field["label"], pick["page_index"], pick["region_ids"], method, confidence, ambiguous, total > 1, total)


def _settle_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("document_id", pa.string()), ("field_path", pa.string()), ("label", pa.string()), ("page_index", pa.int64()), ("region_ids", pa.list_(pa.string())),
        ("match_method", pa.string()), ("match_confidence", pa.float64()), ("ambiguous", pa.bool_()), ("duplicate_candidates", pa.bool_()), ("candidate_count", pa.int64())])

    def emit(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    document, walk, out = None, _Walk(), []
    for batch in batches:
        for row in batch.to_pylist():
            if row["document_id"] != document:
                out.extend(walk.settle())
                document, walk = row["document_id"], _Walk()
            walk.add(row)
        if out:
            yield emit(out)
            out = []
    out.extend(walk.settle())
    if out:
        yield emit(out)


def assign(fields: DataFrame, ranked: DataFrame) -> DataFrame:
    """One span per field, settled in order so that sure matches keep their regions to themselves.

    The walk is sequential by definition inside a document: later choices depend on the regions and the
    row and column centres of earlier ones. Documents without any candidate never reach it, rows come
    sorted and stream through, and the state holds one document at a time.
    """
    asked = order_fields(fields).select(
        *FIELD, "label", "invoice_index", "item_index", F.col("page_index").alias("field_page"), "_order", normalize_text(F.col("gt_value")).alias("_value"))
    rows = asked.join(ranked.drop("start", "size", "candidate_count"), list(FIELD), "left").repartition("document_id")
    open_here = F.max(F.col("region_ids").isNotNull()).over(Window.partitionBy("document_id"))
    ordered = rows.withColumn("_open", open_here).where("_open").drop("_open").sortWithinPartitions("document_id", "_order", "position").drop("_order")
    return ordered.mapInArrow(_settle_documents, MATCH_SCHEMA)


def align(fields: DataFrame, regions: DataFrame, *, max_boxes: int = MAX_BOXES) -> DataFrame:
    """Candidates to matches in one plan."""
    return assign(fields, rank_candidates(prune_spans(match_cascade(fields, regions, max_boxes=max_boxes), max_boxes=max_boxes)))


# ---------------------------------------------------------------- results
def region_labels(matches: DataFrame) -> DataFrame:
    """B-/I- label of every region of an unambiguous match."""
    sure = matches.where("not ambiguous").select("document_id", "label", F.posexplode("region_ids").alias("_i", "region_id"))
    return sure.select("document_id", "region_id", F.concat(F.when(F.col("_i") == 0, "B-").otherwise("I-"), "label").alias("region_label"))


def alignment_rows(matches: DataFrame, fields: DataFrame, regions: DataFrame) -> DataFrame:
    """Matches with recognised text, page and the weakest confidences of their regions.

    All three sides are dealt together, by document, and meet where they lie: a match is one row per region while it
    meets them, and one row again at its first region.
    """
    own = matches.where(F.col("document_id").isNotNull() & F.col("field_path").isNotNull()).select(
        "*", F.posexplode_outer("region_ids").alias("_i", "_region"), F.lit("match").alias("_side"))
    confidences, known = ("detection_confidence", "recognition_confidence"), ("gt_value", "invoice_index", "item_index", "line_number")
    seen = regions.select(
        "document_id", F.col("region_id").alias("_region"), F.nullif(strip(F.col("text")), F.lit("")).alias("_text"), *[F.col(c).alias(f"_{c}") for c in confidences],
        F.lit("region").alias("_side"))
    values = fields.select(*FIELD, *[F.col(c).alias(f"_{c}") for c in known], F.lit("value").alias("_side"))
    dealt = own.unionByName(seen, allowMissingColumns=True).unionByName(values, allowMissingColumns=True).repartition("document_id")

    def told(side: str, names: Sequence[str], keys: Sequence[str]) -> Column:
        row = F.struct(*[F.col(f"_{n}").alias(n) for n in names])
        return F.collect_list(F.when(F.col("_side") == side, row)).over(Window.partitionBy(*keys))

    is_match = F.col("_side") == "match"
    met = dealt.withColumn("_seen", told("region", ("text", *confidences), ("document_id", "_region"))).where(F.col("_side") != "region").select(
        *matches.columns, "_i", "_side", *[f"_{c}" for c in known], F.posexplode_outer(F.when(is_match & F.col("_region").isNotNull(), F.col("_seen"))).alias("_copy", "_r"))
    field = Window.partitionBy(*FIELD)
    texts = F.array_sort(F.collect_list(F.when(F.col("_r.text").isNotNull(), F.struct("_i", F.col("_r.text").alias("text")))).over(field))
    gathered = met.select(
        *matches.columns, "_i", "_side", "_copy", texts.alias("_texts"), F.max("_copy").over(field).alias("_found"),
        *[F.min(f"_r.{c}").over(field).alias(c) for c in confidences], told("value", known, FIELD).alias("_values"))
    first = is_match & F.col("_found").isNotNull() & (F.coalesce("_i", F.lit(0)) == 0) & (F.coalesce("_copy", F.lit(0)) == 0)
    said = F.array_join(F.transform("_texts", lambda t: t["text"]), " ")
    return gathered.where(first).select(
        *FIELD, *[c for c in matches.columns if c not in FIELD], F.when(F.size("_texts") > 0, said).alias("ocr_text"), *confidences,
        F.inline("_values")).withColumn("page", F.col("page_index") + 1).withColumn("training_eligible", ~F.col("ambiguous"))


def layout_pages(regions: DataFrame, labels: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per page parallel arrays of tokens, integer boxes, labels and region ids; pages without regions are absent."""
    named = regions.join(labels, ["document_id", "region_id"], "left").join(sizes, list(PAGE))
    box = normalize_bbox(F.col("x_min"), F.col("y_min"), F.col("x_max"), F.col("y_max"), F.col("width"), F.col("height"))
    token = F.struct("y_min", "x_min", "region_id", F.col("text").alias("token"), box.alias("box"), F.coalesce("region_label", F.lit("O")).alias("label"))
    grouped = named.groupBy(*PAGE).agg(F.array_sort(F.collect_list(token)).alias("_t"))
    return grouped.select(*PAGE, *[
        F.col("_t").getField(name).alias(plural)
        for name, plural in (("token", "tokens"), ("box", "boxes"), ("label", "labels"), ("region_id", "region_ids"))])
