"""Soft balance, its weight search and ranks over ranges against plain loops."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest

from ledgerloom.operators import assign, balance, order
from ledgerloom.plans import levels

CLASSES = {"x": ["a", "b", "c"], "y": ["d", "e"], "z": ["f"]}
CONFIGS = balance.grid([1.5, 5.0], [0.5], [1.0, 4.5], [0.9, 1.2])


def plain(rows, classes, config):
    """The sequential rule: rows are (id, effective, raw, n, scores)."""
    rows = sorted(rows, key=lambda r: (-r[1], -r[2], -r[3], r[0]))
    den = [max(sum(r[j] for r in rows), 1e-9) / len(classes) + 1e-9 for j in (1, 2)] + [len(rows) / len(classes) + 1e-9]
    used, out = [[0.0] * 3 for _ in classes], {}
    for r in rows:
        step = (r[1], r[2], 1)
        value = [config[3] * s - sum(w * ((u + x) / d) ** 2 for w, u, x, d in zip(config, use, step, den)) for s, use in zip(r[4], used)]
        k = value.index(max(value))
        out[r[0]] = classes[k]
        used[k] = [u + x for u, x in zip(used[k], step)]
    return out


def losses(rows, classes, got, buffer=0.06):
    k, n = len(classes), len(rows)
    out = {}
    for name, column, single in (("count_loss", None, 1 / n), ("effective_loss", 1, None), ("raw_loss", 2, None)):
        size = [1.0 if column is None else r[column] for r in rows]
        share = [sum(s for s, r in zip(size, rows) if got[r[0]] == c) / sum(size) for c in classes]
        floor = max(1 / k, single if single is not None else max(size) / sum(size)) + buffer
        out[name] = 0.45 * math.sqrt(sum((s - 1 / k) ** 2 for s in share) / k) * k + 0.55 * max(0, max(share) - floor) * k
    gap = [max(r[4]) - r[4][classes.index(got[r[0]])] for r in rows]
    out["semantic_loss"] = sum(g / max(abs(max(r[4])), 1) for g, r in zip(gap, rows)) / n
    out["objective"] = 0.25 * out["count_loss"] + 0.30 * out["effective_loss"] + 0.25 * out["raw_loss"] + 0.20 * out["semantic_loss"]
    return out


@pytest.fixture(scope="module")
def given():
    rng = np.random.default_rng(5)
    out = {g: [(i + 1000 * j, float(rng.integers(0, 400)) / 4, float(rng.integers(0, 900)) / 4, int(rng.integers(1, 9)), [float(v) for v in np.round(rng.normal(size=len(c)), 3)]) for i in range(n)] for j, (g, c, n) in enumerate([("x", CLASSES["x"], 240), ("y", CLASSES["y"], 90), ("z", CLASSES["z"], 5)])}
    out["y"] += [(1200, 500.0, 500.0, 3, [0.5, 0.5]), (1201, 500.0, 500.0, 3, [0.5, 0.5])]  # ties
    return out


def table(spark, given):
    rows = [(r[0], g, *r[1:]) for g, own in given.items() for r in own]
    return spark.createDataFrame(rows, "id long, category string, effective double, raw double, n long, scores array<double>").repartition(4)


def test_soft_balance_is_the_sequential_rule(spark, given):
    configs = {"x": CONFIGS[0], "y": CONFIGS[5], "z": CONFIGS[0]}
    got = {r["id"]: r["class"] for r in balance.soft_balance(table(spark, given), "category", CLASSES, configs).collect()}
    want = {i: c for g, own in given.items() for i, c in plain(own, CLASSES[g], configs[g]).items()}
    assert got == want
    assert balance.soft_balance(table(spark, given).where("id < 0"), "category", CLASSES, configs).count() == 0


def test_search_has_the_losses_of_every_configuration(spark, given):
    got = balance.soft_search(table(spark, given), "category", CLASSES, CONFIGS, levels.LOSS, levels.BUFFER)
    best = {r["category"]: r for r in balance.best_configs(got, "category", CONFIGS).collect()}
    assert set(best) == {"x", "y"}
    for g in best:
        rows = {r["config"]: r for r in got.where(f"category = '{g}'").collect()}
        assert len(rows) == len(CONFIGS)
        want = [losses(given[g], CLASSES[g], plain(given[g], CLASSES[g], c)) for c in CONFIGS]
        for i, own in enumerate(want):
            for name, value in own.items():
                assert rows[i][name] == pytest.approx(value, abs=1e-9)
        first = min(range(len(want)), key=lambda i: (round(want[i]["objective"], 12), i))
        assert best[g]["config"] == first and best[g]["w_score"] == CONFIGS[first][3]


def test_shards_of_a_large_group_stay_near_the_sequential_rule(spark):
    """Objective within 0.01 of the sequential rule's, shares of counts and amounts within 0.02, on ten shards."""
    rng = np.random.default_rng(8)
    own = [(i, float(v), float(v), 1, [float(x) for x in s]) for i, (v, s) in enumerate(zip(np.round(rng.lognormal(3, 1, 6000), 2), np.round(rng.uniform(0, 2, (6000, 3)), 3)))]
    config = (4.0, 1.5, 2.5, 1.1)
    want = plain(own, CLASSES["x"], config)
    got = {r["id"]: r["class"] for r in balance.soft_balance(table(spark, {"x": own}), "category", CLASSES, {"x": config}, shard_rows=600).collect()}
    assert len(got) == len(own)
    a, b = (losses(own, CLASSES["x"], x) for x in (want, got))
    assert abs(a["objective"] - b["objective"]) < 0.01
    for c, column in itertools.product(CLASSES["x"], (1, None)):
        size = {r[0]: 1.0 if column is None else r[1] for r in own}
        share = [sum(size[i] for i, k in x.items() if k == c) / sum(size.values()) for x in (want, got)]
        assert abs(share[0] - share[1]) < 0.02


def test_quota_shards(spark):
    """One shard is the sequential greedy; several stay within what the largest items of the shards move."""
    rng = np.random.default_rng(1)
    amount = rng.integers(0, 5000, 4000) / 4
    items = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(amount)), "amount": amount}))
    quotas = spark.createDataFrame([("a", 0.5, 0.4), ("b", 0.3, 0.4), ("c", 0.2, 0.2)], "category string, amount_share double, count_share double")
    want = {r["id"]: r["category"] for r in assign.quota_greedy(items, quotas).collect()}
    assert {r["id"]: r["category"] for r in balance.quota_shards(items, quotas, 0.35, 0.65).collect()} == want
    got = balance.quota_shards(items, quotas, 0.35, 0.65, shard_rows=500).toPandas()
    share = lambda x: np.array([sum(amount[i] for i in x if x[i] == c) / amount.sum() for c in "abc"])
    assert len(got) == len(amount) and np.abs(share(dict(zip(got["id"], got["category"]))) - share(want)).max() < 8 * amount.max() / amount.sum()
    assert {r["category"] for r in balance.quota_shards(items, quotas.where("false"), 0.35, 0.65).collect()} == {None}


def test_ranks_over_ranges(spark):
    rng = np.random.default_rng(3)
    own = pd.DataFrame({"id": np.arange(400), "g": rng.choice(["a", "b", "hot", "hot", "hot"], 400), "v": rng.integers(0, 9, 400) / 2, "w": rng.normal(size=400)})
    own.loc[len(own)] = [400, "alone", 1.0, 2.0]
    own["id"] = own["id"].astype(int)
    got = order.average_ranks(spark.createDataFrame(own), "id", "g", ["v", "w"], parts=7).toPandas().sort_values("id")
    for m in ("v", "w"):
        want = own.groupby("g")[m].rank(method="average", pct=True)
        want[own["g"] == "alone"] = 0.5
        assert np.allclose(got[f"{m}_rank"].to_numpy(), want.to_numpy())
    missing = spark.createDataFrame([(1, "a", None), (2, "a", 3.0), (3, "a", 4.0)], "id long, g string, v double")
    assert {r["id"]: r["v_rank"] for r in order.average_ranks(missing, "id", "g", ["v"]).collect()} == {1: 0.5, 2: 0.5, 3: 1.0}


def test_merchants_are_read_once(spark):
    """What ranks and balances ask for several times is kept: nothing behind it reads the facts again."""
    rows = levels.merchants(spark, "/root/testdata/sf0.001")
    assert rows.count() and not rows.inputFiles() and not levels.relative(levels.allocated(rows)).inputFiles()
