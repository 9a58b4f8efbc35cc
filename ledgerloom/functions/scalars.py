"""Column functions of the enrichment: parsing, labels, distances, keyed random numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The four ordered amount levels.
LEVELS = ["low", "low_to_medium", "medium", "high"]


def keyed_uniform(salt: str, *keys: Column) -> Column:
    """A number in [0, 1) that depends on the keys and the salt alone, not on partitions or order."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[k.cast("string") for k in keys], F.lit(salt))), 1, 8), 16, 10).cast("double") / float(1 << 32)


def money(x: Column) -> Column:
    return F.regexp_replace(F.trim(x), "[,$￥¥]", "").try_cast("double")


def percent(x: Column) -> Column:
    number = F.regexp_replace(F.trim(x), "[,%％]", "").try_cast("double")
    return F.when(x.rlike("[%％]"), number / 100).otherwise(number)


def relative_level(x: Column) -> Column:
    """A level against 1 as a percent or plain number; a plain number over 3 is read as a percent."""
    v = percent(x)
    return F.when(~x.rlike("[%％]") & (v > 3), v / 100).otherwise(v)


def normalized(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """`value` as shares of its group; a group of zeros: even shares; negative values are refused as rows are read."""
    w = Window.partitionBy(*group)
    checked = F.when(F.col(value) < 0, F.raise_error(F.lit(f"negative {value}")).cast("double")).otherwise(F.col(value))
    total = F.sum(value).over(w)
    return df.withColumn(value, checked).withColumn(value, F.when(total > 0, F.col(value) / total).otherwise(1 / F.count("*").over(w)))


def to_bool(x: Column, yes: tuple[str, ...] = ("true", "1", "yes", "y", "t")) -> Column:
    return F.coalesce(F.lower(F.trim(x.cast("string"))).isin(*yes) | (x.try_cast("double") != 0), F.lit(False))


def amount_label(x: Column, q25: Column | float = 20, q50: Column | float = 100, q75: Column | float = 500) -> Column:
    return F.when(x.isNull(), "medium").when(x < q25, "low").when(x < q50, "low_to_medium").when(x < q75, "medium").otherwise("high")


def cv_label(x: Column) -> Column:
    return amount_label(x, 0.5, 1.0, 2.0)


def label_distance(a: Column, b: Column) -> Column:
    levels = F.array(*[F.lit(x) for x in LEVELS])
    i, j = F.array_position(levels, a), F.array_position(levels, b)
    return F.when((i > 0) & (j > 0), F.abs(i - j) / 3.0).otherwise(0.5)


def minmax_score(x: Column, low: Column, high: Column) -> Column:
    return F.when(high <= low, F.when(x > low, 1.0).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - low) / (high - low))))


def online_bucket(x: Column) -> Column:
    return F.when(x >= 0.75, "strong_online").when(x >= 0.55, "mixed_online").when(x >= 0.35, "mixed_offline").otherwise("strong_offline")


def online_tendency(x: Column) -> Column:
    return F.when(x >= 0.45, "strong_online").when(x >= 0.15, "mixed_online_offline").otherwise("strong_offline")


def circular_distance(a: Column, b: Column, modulus: int) -> Column:
    d = F.pmod(F.abs(a - b), F.lit(modulus))
    return F.least(d, modulus - d)


def nearly_equal(a: Column, b: Column, tolerance: float = 0.01) -> Column:
    return F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b), F.lit(1e-6))


def stable_id(prefix: str, *columns: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), F.md5(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("__NA__")) for c in columns])))


def normalize_name(x: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(x)), r"[^\p{L}\p{N}]+", "")


def short_word_count(x: Column) -> Column:
    return F.size(F.regexp_extract_all(x, F.lit("[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*"), 0))


def strip_think(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, "(?is)<think>.*?</think>", ""))


def has_cjk(x: Column) -> Column:
    return x.rlike(r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]")


def fixed(x: Column, digits: int) -> Column:
    """A number of 0 or more as text with so many digits, halves up."""
    n = F.floor(x * 10**digits + 0.5).cast("long")
    return F.concat(F.floor(n / 10**digits).cast("long").cast("string"), F.lit("."), F.lpad(F.pmod(n, F.lit(10**digits)).cast("string"), digits, "0"))


def fixed_sql(x: str, digits: int) -> str:
    n = f"floor(({x}) * {10**digits} + 0.5)::BIGINT"
    return f"(({n} // {10**digits})::VARCHAR || '.' || lpad(({n} % {10**digits})::VARCHAR, {digits}, '0'))"


def dominant(*columns: str) -> Column:
    """The name of the column with the largest value, the first of equals."""
    most = F.greatest(*columns)
    return F.coalesce(*[F.when(F.col(c) == most, c) for c in columns])


def safe_div(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(default))


# Names and hours of the day parts; the fallback rule closes night at 5 and the evening at 18.
PARTS = ["late_night", "early_morning", "commute_morning", "workday_morning", "lunch", "afternoon", "commute_evening", "night"]
BOUNDS = {"generator": [5, 8, 10, 12, 14, 17, 20], "fallback": [6, 8, 10, 12, 14, 17, 19]}


def day_part(hour: Column, rule: str = "generator") -> Column:
    out = F.when(hour.isNull(), "unknown")
    for name, bound in zip(PARTS, BOUNDS[rule], strict=False):
        out = out.when(hour < bound, name)
    return out.otherwise(PARTS[-1])


def day_part_sql(hour: str, rule: str = "generator") -> str:
    return f"CASE WHEN {hour} IS NULL THEN 'unknown' " + " ".join(f"WHEN {hour} < {b} THEN '{n}'" for n, b in zip(PARTS, BOUNDS[rule], strict=False)) + f" ELSE '{PARTS[-1]}' END"
