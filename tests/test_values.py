"""Normal forms of printed values."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from docledger.functions import text as T
from docledger.functions import values as V
from docledger.operators.training import align_subtokens
from docledger.operators.transcription import char_edits, word_edits


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in rows.select("i", expression(F.col("v")).alias("out")).orderBy("i").collect()]


def test_dates(spark):
    given = ["09/09/2025", "2025-09-09", "ngày 9 tháng 9 năm 2025", "31/02/2025", "09/09/25", None, "Ngày 09 Tháng 12 năm 2024", "x 1.2.2024 y", "123456/1/2020"]
    assert column(spark, given, V.normalize_date) == ["2025-09-09"] * 3 + [None, None, None, "2024-12-09", "2024-02-01", None]


@pytest.mark.parametrize("printed, expected", [
    ("1.234.567", 1234567.0), ("1.234,50", 1234.5), ("1,234.50", 1234.5), ("12,5", 12.5), ("1 234 567", 1234567.0), ("words", None),
    ("0.123", 123.0), (".123", 0.123), ("5.", 5.0), (".5", 0.5), ("1.23.4", None), ("-5,00", -5.0), ("+7", 7.0), ("5-3", None), ("", None),
    (".", None), ("-", None), ("1,234.567.8", None), (".123.456", 123456.0), ("5%", 5.0), ("--5", None),
])
def test_numbers(spark, printed, expected):
    got = column(spark, [printed], V.parse_number)[0]
    assert (None if got is None else float(got)) == expected


def test_money_is_never_negative(spark):
    assert [None if v is None else float(v) for v in column(spark, ["-5", "5,50", None], V.parse_money)] == [None, 5.5, None]


def test_text_forms(spark):
    given = ["  Số:  00000123 ", "Straße…", "“Ａ－１”", "Đường_Lê, Lợi.", "ﬁne"]
    normal = column(spark, given, T.normalize_text)
    assert normal == ["số 00000123", "strasse", "a-1", "đường lê lợi", "fine"]
    assert column(spark, given, T.fold_text)[3] == "duong le loi"
    assert column(spark, ["AB-12/3.4"], T.normalize_identifier) == ["ab1234"]
    assert column(spark, [" A  b\tC "], T.normalize_scalar) == ["a b c"]


def test_accent_table_matches_decomposition(spark):
    letters = "ăâđêôơưàảãáạằẳẵắặầẩẫấậèẻẽéẹềểễếệìỉĩíịòỏõóọồổỗốộờởỡớợùủũúụừửữứựỳỷỹýỵ"
    plain = "".join(c for c in unicodedata.normalize("NFKD", letters) if not unicodedata.combining(c)).replace("đ", "d")
    assert column(spark, [letters], T.fold_text) == [plain]


def test_product_description(spark):
    rows = spark.createDataFrame([("Paracetamol 500mg, NSX: Việt Nam; lô 1",), ("Thuốc A nhà sản xuất: ABC",), (" ",)], "d string")
    got = rows.select(*[c.alias(n) for n, c in V.describe_product(F.col("d")).items()]).collect()
    assert tuple(got[0]) == ("Paracetamol", "500mg", None, "Việt Nam")
    assert tuple(got[1]) == ("Thuốc A", None, "ABC", None)
    assert tuple(got[2]) == (None, None, None, None)


def test_edit_distances(spark):
    rows = spark.createDataFrame([("kitten", "sitting"), ("a b c", "a x c d"), ("", "a b"), ("é", "e")], "a string, b string")
    got = rows.select(char_edits(F.col("a"), F.col("b")), word_edits(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(3, 1), (3, 2), (3, 2), (1, 1)]


def test_subtokens(spark):
    rows = spark.createDataFrame([([None, 0, 0, 1, 2, 2, None], [5, 6, 7])], "w array<int>, l array<int>")
    got = rows.select(align_subtokens(F.col("w"), F.col("l")).alias("a"), align_subtokens(F.col("w"), F.col("l"), label_all=True).alias("b")).first()
    assert got.a == [-100, 5, -100, 6, 7, -100, -100] and got.b == [-100, 5, 5, 6, 7, 7, -100]
    bad = spark.createDataFrame([([0, 3], [5, 6])], "w array<int>, l array<int>")
    assert bad.select(align_subtokens(F.col("w"), F.col("l"))).first()[0] is None
