"""Hand examples of the column functions."""

from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S


def values(spark, data, f, kind="string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in data], f"x {kind}").select(f(F.col("x"))).collect()]


def test_money_and_percent(spark):
    assert values(spark, ["1,234.5", "￥12", "", None], S.money) == [1234.5, 12.0, None, None]
    got = values(spark, ["98.52%", "98.52", "１％", None], S.percent)
    assert got[:2] == [0.9852, 98.52] and got[3] is None


def test_booleans(spark):
    assert values(spark, ["true", "yes", "y", "0", "2.0", None], S.to_bool) == [True, True, True, False, True, False]


def test_day_parts_differ_at_5_and_19(spark):
    hours = [4, 5, 19, 23, None]
    assert values(spark, hours, S.day_part, "int") == ["late_night", "early_morning", "commute_evening", "night", "unknown"]
    assert values(spark, hours, lambda h: S.day_part(h, "fallback"), "int") == ["late_night", "late_night", "night", "night", "unknown"]


def test_names_and_thoughts(spark):
    assert values(spark, [" A-b_C ", "É 1"], S.normalize_name) == ["abc", "é1"]
    assert values(spark, ["<think>x\ny</think> Out"], S.strip_think) == ["Out"]
