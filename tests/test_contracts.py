"""Sources, joins and orders that queries cannot show: files, missing tables, faults, many ranges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.operators import graph, order
from ledgerloom.plans import contracts, people


def test_clean_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿id , name\n1, x \n2,\n".encode())
    got = contracts.read_clean_csv(spark, str(tmp_path / "a.csv"))
    assert got.columns == ["id", "name"] and [tuple(r) for r in got.collect()] == [("1", "x"), ("2", None)]


def test_optional_table_and_required_columns(spark, tmp_path):
    none = contracts.optional_table(spark, str(tmp_path / "none.parquet"), "a long, b string")
    assert none.columns == ["a", "b"] and none.count() == 0
    with pytest.raises(ValueError, match="lacks c"):
        contracts.require_columns(none, ["a", "c"])
    assert contracts.require_columns(none, ["a"]) is none


def test_resume_takes_the_first_pending(spark):
    todo, done = spark.range(10).toDF("id"), spark.createDataFrame([(0,), (2,), (2,)], "id long")
    assert [r["id"] for r in contracts.resume_pending(todo, done, "id", 3).collect()] == [1, 3, 4]


def test_labels_of_another_table(spark):
    facts, labels = spark.createDataFrame([(1, 5), (2, 5)], "id long, label int"), spark.createDataFrame([(1, 1)], "id long, odd int")
    assert sorted(map(tuple, contracts.merge_labels(facts, labels, "id").collect())) == [(1, 1), (2, 0)]
    with pytest.raises(ValueError, match="no label"):
        contracts.merge_labels(facts, labels.withColumn("other", F.lit(1)), "id")


def test_negative_shares_are_refused(spark):
    with pytest.raises(Exception, match="negative p"):
        S.normalized(spark.createDataFrame([("a", -1.0)], "g string, p double"), ["g"], "p").collect()


def test_orders_over_many_ranges(spark):
    rng = np.random.default_rng(3)
    values = [int(x) for x in rng.integers(0, 500, 700)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v int").repartition(5)
    assert [r["rank"] for r in order.global_rank(df, ["v", "i"], parts=7).orderBy("v", "i").collect()] == list(range(1, 701))
    assert [r["m"] for r in order.running_max(df, ["i"], "v", "m", parts=7).orderBy("i").collect()] == [int(x) for x in np.maximum.accumulate(values)]
    near = order.neighbours(df, ["i"], "v", "b", "a", parts=7).orderBy("i").collect()
    assert [r["b"] for r in near] == [None, *values[:-1]] and [r["a"] for r in near] == [*values[1:], None]


def test_components(spark):
    rng = np.random.default_rng(5)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(200 + i, 201 + i) for i in range(40)]
    root = {n: n for n in range(300)}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = graph.components(spark.createDataFrame(links, "u long, v long"), spark.range(300).toDF("node")).collect()
    assert {r["node"]: r["root"] for r in got} == {n: find(n) for n in range(300)}


def test_ages_keep_their_limits(spark):
    levels = spark.createDataFrame([("a", "100%"), ("b", "20%"), ("c", "900%")], "province string, raw string")
    got = {(r["province"], r["gender"], r["value"]): r["prob"] for r in people.age_prior(levels).collect()}
    old = people.AGES["Male"][2]
    assert got["a", "Male", "Older Adults"] == pytest.approx(old) and got["b", "Male", "Older Adults"] == pytest.approx(old / 2) and got["c", "Male", "Older Adults"] == pytest.approx(0.8)
    assert all(abs(sum(p for (a, g, _), p in got.items() if (a, g) == k) - 1) < 1e-12 for k in {k[:2] for k in got})
