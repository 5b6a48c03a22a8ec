"""Golden values of the text, money and date functions."""

from datetime import date

from pyspark.sql import functions as F

from ledgerloom.functions import money as M
from ledgerloom.functions import text as T
from ledgerloom.operators.detect import suggestion_id
from ledgerloom.operators.recurrence import amount_bucket


def values(spark, column, rows, kind="string"):
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, v {kind}")
    return [r[0] for r in frame.orderBy("i").select(column(F.col("v"))).collect()]


def test_recurrence_tokens(spark):
    assert values(spark, T.recurrence_tokens, ["PAGTO SERVIÇOS S/A 05/01 123456", None, "", "Café  CAFÉ aluguel 2026-01-05 x1"]) == [["servico"], [], [], ["cafe", "aluguel"]]


def test_money(spark):
    given = ["1.234,56", "(10,5)", "R$ -3", "1.23", "1.234", "12.34.5", "", None, "abc"]
    assert values(spark, M.parse_money, given) == [1234.56, -10.5, -3.0, 1.23, 1234.0, None, None, None, None]


def test_dates(spark):
    assert values(spark, M.parse_date, ["31/02/2026", "05/01/2026", "2026-01-05", "46027", "x", None]) == [None, date(2026, 1, 5), date(2026, 1, 5), date(2026, 1, 5), None, None]


def test_rounding_is_toward_plus_infinity(spark):
    assert values(spark, M.round_money, [-0.125, 0.125, 2.675], "double") == [-0.12, 0.13, 2.68]


def test_buckets(spark):
    assert values(spark, amount_bucket, [0.0, 49.99, 50.0, 2499.99, 2500.0], "double") == [0, 0, 1, 5, 6]


def test_repair_of_encoding(spark):
    assert values(spark, T.statement_text, ["SERVIÃ\u0087OS", "ação", " a   b "]) == ["SERVIÇOS", "ação", "a b"]


def test_monthly_pairs(spark):
    rows = [("2026-01-31", "2026-02-28", True, True), ("2026-01-05", "2026-02-12", False, False), ("2026-01-01", "2026-01-26", True, True), ("2026-01-31", "2026-03-31", False, True), ("2026-01-05", "2026-03-06", False, False), ("2026-01-05", "2026-04-05", False, True)]
    frame = spark.createDataFrame(rows, "a string, b string, m boolean, c boolean").withColumn("a", F.to_date("a")).withColumn("b", F.to_date("b"))
    for r in frame.select("m", "c", M.is_monthly_pair(F.col("a"), F.col("b")).alias("x"), M.is_cadence_pair(F.col("a"), F.col("b")).alias("y")).collect():
        assert (r.m, r.c) == (r.x, r.y)


def test_document_in_text(spark):
    assert values(spark, T.document_in_text, ["NF 12.345.678/0001-90 x", "a 12345678901 b", "12345", None]) == ["12345678000190", "12345678901", None, None]


def test_suggestion_id_is_the_rolling_hash(spark):
    def rolled(text):
        h = 0
        for c in text:
            h = (h * 31 + ord(c)) & 0xFFFFFFFF
        h = abs(h - (1 << 32) if h >= 1 << 31 else h)
        digits = ""
        while h:
            digits = "0123456789abcdefghijklmnopqrstuvwxyz"[h % 36] + digits
            h //= 36
        return digits or "0"

    frame = spark.createDataFrame([(["t-1", "t-2", "zz"],)], "ids array<string>")
    assert frame.select(suggestion_id(F.lit("c"), F.col("ids"))).first()[0] == "rec_c_" + rolled("t-1|t-2|zz")
