"""Sequential rules over the rows of a group in order, side by side: groups, and shards of large groups, each in a task of its own."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import global_rank

#: Rows of a group that one task visits in order; a larger group is dealt over several shards.
SHARD_ROWS = 50_000


def dealt(rows: DataFrame, group: str, order: list[Column], shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Rows with `_rank`, their number by group and order, and `_shard`: neighbours in the order lie in different shards of the group, so each shard is a
    thinned copy of its group and a rule that follows totals goes the same way in all. A group of up to `shard_rows` is one shard: exact."""
    size = rows.groupBy(group).agg(F.ceil(F.count("*") / shard_rows).cast("long").alias("_shards"))
    ranked = global_rank(rows, [F.col(group), *order], "_rank")
    return ranked.join(size, group).withColumn("_shard", F.pmod("_rank", "_shards")).drop("_shards")


def quota_shards(items: DataFrame, quotas: DataFrame, w_amount: float, w_count: float, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The joint quota greedy of `assign.quota_greedy` without a task after the other: each shard fills its own share of the quotas.

    items: id, amount (null: 0). quotas: category, amount_share, count_share, at most a taxonomy, sent as literals. One shard: the sequential greedy itself; with
    S shards the amount of a category is off by at most S times what one item moves. Returns id, amount, category (null without quotas).
    """
    from .assign import MOST_QUOTAS, greedy

    plan = quotas.orderBy("category").limit(MOST_QUOTAS + 1).collect()
    if len(plan) > MOST_QUOTAS:
        raise ValueError(f"more than {MOST_QUOTAS} quotas")
    items = items.select("id", F.coalesce(F.col("amount").cast("double"), F.lit(0.0)).alias("amount"))
    if not plan:
        return items.withColumn("category", F.lit(None).cast("string"))
    names = np.array([str(r["category"]) for r in plan], dtype=object)
    shares = [np.array([float(r[c] or 0) for r in plan]) for c in ("amount_share", "count_share")]

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_rank")
        amount = rows["amount"].to_numpy()
        quota = [np.maximum(s * t, 1e-9) for s, t in zip(shares, (amount.sum(), len(amount)), strict=True)]
        chosen = greedy(amount, *quota, np.zeros(len(names)), np.zeros(len(names)), w_amount, w_count)
        return rows[["id", "amount"]].assign(category=names[chosen])

    kind = items.schema["id"].dataType.simpleString()
    shards = dealt(items.withColumn("_g", F.lit(0)), "_g", [F.desc("amount"), F.col("id")], shard_rows)
    return shards.groupBy("_g", "_shard").applyInPandas(one, f"id {kind}, amount double, category string")


def soft_steps(scores: np.ndarray, effective: np.ndarray, raw: np.ndarray, configs: np.ndarray) -> np.ndarray:
    """(row x configuration): the class that each row takes, rows in order, under every configuration at once.

    A configuration is (effective, raw, count, score) weights. A class is worth its weighted score less the weighted squares of what its effective amount,
    raw amount and count would be against an even share; the first of equals wins. The state is one number a configuration, class and measure.
    """
    n, k = scores.shape
    den = [max(t, least) / k + 1e-9 for t, least in ((effective.sum(), 1e-9), (raw.sum(), 1e-9), (n, 1))]
    used = np.zeros((3, len(configs), k))
    lam, weight, each = configs[:, :3].T[:, :, None], configs[:, 3:], np.arange(len(configs))
    out = np.empty((n, len(configs)), np.int16)
    for i, step in enumerate(np.column_stack([effective, raw, np.ones(n)])):
        ratio = [(used[m] + step[m]) / den[m] for m in range(3)]
        value = weight * scores[i] - (lam[0] * ratio[0] ** 2 + lam[1] * ratio[1] ** 2 + lam[2] * ratio[2] ** 2)
        out[i] = pick = value.argmax(axis=1)
        used[:, each, pick] += step[:, None]
    return out


def _shards(rows: DataFrame, group: str, shard_rows: int):
    order = [F.desc("effective"), F.desc("raw"), F.desc("n"), F.col("id")]
    return dealt(rows, group, order, shard_rows).groupBy(group, "_shard")


def soft_balance(rows: DataFrame, group: str, classes: dict[str, list[str]], configs: dict[str, tuple], shard_rows: int = SHARD_ROWS) -> DataFrame:
    """A class for every row of a group: good scores, with amounts and counts near even shares; biggest effective amount first.

    rows: id, group, effective, raw, n, scores (array by the order of the group's classes). configs: weights of each group. Groups with one class take it.
    Returns id, group, class. A group over `shard_rows` is dealt; its shares differ from the sequential rule's by what its shards' last rows move.
    """

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part, name = part.sort_values("_rank"), part[group].iloc[0]
        own = classes[name]
        if len(own) == 1:
            return part[["id", group]].assign(**{"class": own[0]})
        got = soft_steps(np.stack(part["scores"].to_numpy()), part["effective"].to_numpy(float), part["raw"].to_numpy(float), np.array([configs[name]], float))[:, 0]
        return part[["id", group]].assign(**{"class": np.array(own, object)[got]})

    kind = rows.schema["id"].dataType.simpleString()
    return _shards(rows, group, shard_rows).applyInPandas(one, f"id {kind}, {group} string, class string")


def grid(effective: list[float], raw: list[float], count: list[float], score: list[float]) -> list[tuple]:
    return list(itertools.product(effective, raw, count, score))


def soft_search(rows: DataFrame, group: str, classes: dict[str, list[str]], configs: list[tuple], weights: dict[str, float], buffer: float, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Losses of every configuration for every group of several classes, in one pass over the rows.

    Each task keeps an array of states, one a configuration, while it visits its rows, and returns sums a class and configuration: never rows. A measure's loss is 0.45 of the
    shares' root mean square distance from even, against even, and 0.55 of what the largest share has above even or the largest row's own share, and the buffer;
    the score loss is the mean share of the best score that is given away. Returns group, config (its number), the four losses, not_top, objective.
    """
    table = np.array(configs, float)

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part, own = part.sort_values("_rank"), classes[part[group].iloc[0]]
        scores, effective, raw = np.stack(part["scores"].to_numpy()), part["effective"].to_numpy(float), part["raw"].to_numpy(float)
        got = soft_steps(scores, effective, raw, table)
        best = scores.max(axis=1)
        given = best[:, None] - np.take_along_axis(scores, got.astype(int), axis=1)
        lost, off = np.maximum(given, 0) / np.maximum(np.abs(best), 1.0)[:, None], given > 1e-9
        frames = []
        for c, name in enumerate(own):
            has = got == c
            frames.append(pd.DataFrame({"config": np.arange(len(table)), "class": name, "n": has.sum(axis=0), "effective": effective @ has, "raw": raw @ has, "lost": (lost * has).sum(axis=0), "off": (off & has).sum(axis=0), "top_effective": effective.max(), "top_raw": raw.max()}))
        return pd.concat(frames).assign(**{group: part[group].iloc[0]})

    several = [g for g, c in classes.items() if len(c) > 1]
    sums = _shards(rows.where(F.col(group).isin(several)), group, shard_rows).applyInPandas(one, f"{group} string, config int, class string, n long, effective double, raw double, lost double, off long, top_effective double, top_raw double")
    by = sums.groupBy(group, "config", "class").agg(*[F.sum(c).alias(c) for c in ("n", "effective", "raw", "lost", "off")], F.max("top_effective").alias("top_effective"), F.max("top_raw").alias("top_raw"))
    total = lambda c: F.greatest(F.sum(c), F.lit(1e-9))
    wide = by.groupBy(group, "config").agg(F.count("*").alias("k"), F.sum("n").alias("rows"), F.sum("lost").alias("lost"), F.sum("off").alias("off"), *[F.collect_list(c).alias(f"{c}_of") for c in ("n", "effective", "raw")], *[total(c).alias(f"{c}_total") for c in ("n", "effective", "raw")], F.max("top_effective").alias("top_effective"), F.max("top_raw").alias("top_raw"))

    def loss(c: str, single: Column) -> Column:
        even = 1 / F.col("k")
        share = F.transform(f"{c}_of", lambda v: v / F.col(f"{c}_total"))
        rmse = F.sqrt(F.aggregate(share, F.lit(0.0), lambda a, v: a + (v - even) * (v - even)) / F.col("k")) / even
        return 0.45 * rmse + 0.55 * F.greatest(F.lit(0.0), F.array_max(share) - (F.greatest(even, single) + buffer)) / even

    losses = wide.select(group, "config", loss("n", 1 / F.col("rows")).alias("count_loss"), loss("effective", F.col("top_effective") / F.col("effective_total")).alias("effective_loss"), loss("raw", F.col("top_raw") / F.col("raw_total")).alias("raw_loss"), (F.col("lost") / F.col("rows")).alias("semantic_loss"), (F.col("off") / F.col("rows")).alias("not_top"))
    names = {"count": "count_loss", "effective": "effective_loss", "raw": "raw_loss", "semantic": "semantic_loss"}
    return losses.withColumn("objective", sum((F.lit(w) * F.col(names[m]) for m, w in weights.items()), F.lit(0.0)))


def best_configs(losses: DataFrame, group: str, configs: list[tuple]) -> DataFrame:
    """The first configuration of least objective of each group, with its weights."""
    held = F.lit(None)
    names = ("effective", "raw", "count", "score")
    first = losses.groupBy(group).agg(F.min(F.struct("objective", "config")).alias("b"))
    held = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in configs])
    both = losses.join(first.select(group, F.col("b.config").alias("config")), [group, "config"])
    return both.select("*", *[held[F.col("config")][i].alias(f"w_{n}") for i, n in enumerate(names)])
