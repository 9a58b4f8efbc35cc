"""Priors by ordered overrides, errors with missing parts, and new categories under moving limits, against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.plans import semantics, taxonomy


def test_overrides_win_in_order(spark):
    pairs = [("General Clinical Care and Health Management", "Private Hospital"), ("Online Entertainment and Hobby Spending", "Gaming"), ("Specialized Consumer Medical and Care Services", "Online Medical Services"), ("Vehicle Energy and Automotive Services", "Fuel Supply Services"), ("No such level1", "Plain"), ("Education Payments and Training Services", "Higher Education")]
    got = {r["level2"]: r for r in taxonomy.keyword_priors(spark.createDataFrame([*pairs, pairs[0]], "level1 string, level2 string")).collect()}
    assert len(got) == len(pairs)
    game = got["Gaming"]
    assert (game["online"], game["female"], game["vol"], game["hours"], game["bucket"]) == (0.84, 0.35, "high", ",".join(map(str, range(12, 24))), "strong_online")
    care = got["Online Medical Services"]  # online words, then online medicine
    assert (care["online"], care["female"], care["amount"], list(care["age"])) == (0.78, 0.56, "high", [0.36, 0.46, 0.18])
    assert care["basis"] == f"{taxonomy.FIRST_BASIS};digital/online keyword;online medical"
    fuel = got["Fuel Supply Services"]
    assert (fuel["online"], fuel["amount"], fuel["female"], fuel["basis"]) == (0.15, "low_to_medium", 0.35, f"{taxonomy.FIRST_BASIS};vehicle/male-skew")
    assert got["Private Hospital"]["female"] == 0.54 and got["Plain"]["basis"] == taxonomy.FIRST_BASIS and got["Plain"]["online"] == 0.5
    assert got["Higher Education"]["basis"].count("education") == 1
    for r in got.values():
        assert sum(r["industries"]) == pytest.approx(1) and sum(r["edu"]) == pytest.approx(1)


def test_errors_without_data(spark):
    prior = taxonomy.keyword_priors(spark.createDataFrame([("Food and Beverage Services", "Gaming")], "level1 string, level2 string"))
    k = len(taxonomy.INDUSTRY_LABELS)
    row = lambda i, l2, tx, online: (i, "Food and Beverage Services", l2, tx, 5.0, 0.1, online, [12, 3], 0.5, [0.0, 1.0, 0.0], [0.25] * 4, [1.0 / k] * k, "low", "high")
    rows = spark.createDataFrame([row(1, "Gaming", 4, 0.84), row(2, "Other", 4, 0.5), row(3, "Gaming", 4, None)], "target long, level1 string, level2 string, tx long, mean double, cv double, online_score double, top_hours array<int>, women double, ages array<double>, educations array<double>, occupations array<double>, amount_label string, cv_label string")
    got = {r["target"]: r for r in semantics.against(rows, prior).collect()}
    assert got[2]["overall"] is None and got[2]["mean"] == 5.0  # kept, without a prior
    one = got[1]
    assert one["online_error"] == 0 and one["hour_hit"] == 0.5 and one["amount_error"] == pytest.approx(1 / 3) and one["volatility_error"] == 0
    assert one["gender_error"] == pytest.approx(0.15) and one["age_error"] == pytest.approx(0.8)
    rest = (1 - one["amount_error"]) + 1 + 0.5 + (1 - one["demographic_tvd"])
    assert one["overall"] == pytest.approx((1 + rest) / 5) and got[3]["online_error"] is None
    assert got[3]["overall"] == pytest.approx(rest / 4)  # the mean of the parts that are there


def walked(merchants, choices, most, rate, share):
    """The walk as a program would make it."""
    count, size, moved, out = {}, {}, {}, []
    for _, a, b in merchants:
        count[a, b], size[a] = count.get((a, b), 0) + 1, size.get(a, 0) + 1
    limit = {a: max(1, int(k * rate)) for a, k in size.items()}
    for t, a, b, r, fraud, dims, tx, options in sorted(choices, key=lambda c: (-c[3], -c[4], -c[5], -c[6], c[0])):
        if len(out) >= most or moved.get(a, 0) >= limit[a]:
            continue
        for cross, goal, x, y in sorted(options, key=lambda o: (o[0], -o[1], o[2], o[3])):
            if size.get(x, 0) == 0 or count.get((x, y), 0) / size[x] < share:
                count[a, b] -= 1
                size[a] -= 1
                count[x, y], size[x] = count.get((x, y), 0) + 1, size.get(x, 0) + 1
                moved[a] = moved.get(a, 0) + 1
                out.append((t, a, b, x, y))
                break
    return sorted(out)


@pytest.mark.parametrize(("most", "rate", "share"), [(120, 0.08, 0.65), (9, 0.5, 0.3), (60, 0.9, 0.34), (1000, 1.0, 0.4)])
def test_recategorised_as_by_a_walk(spark, most, rate, share):
    rng = np.random.default_rng(3)
    merchants = [(i, f"l{rng.choice(3, p=[0.7, 0.2, 0.1])}", str(rng.choice(["a", "b", "c"], p=[0.4, 0.35, 0.25]))) for i in range(400)]
    choices = []
    for t, a, b in merchants[:220]:
        options = []
        for x in ("l0", "l1", "l2"):
            for y in ("a", "b", "c", "new"):
                if (x, y) != (a, b) and rng.random() < 0.3:
                    options.append((int(x != a), float(rng.integers(0, 5)) / 4, x, y))
        if options:
            choices.append((t, a, b, float(rng.integers(0, 9)) / 10, int(rng.integers(3, 6)), int(rng.integers(1, 3)), int(rng.integers(5, 9)), options))
    kind = "array<struct<cross:int,g:double,new_level1:string,new_level2:string,fit:double,risk:double,old_fit:double,old_risk:double>>"
    rows = [(*c[:7], sorted([(o[0], -o[1], o[2], o[3], 0.5, 0.7, 0.4, 0.2) for o in c[7]])) for c in choices]
    df = spark.createDataFrame(rows, f"target long, level1 string, level2 string, rate double, fraud long, dims int, tx long, options {kind}")
    table = spark.createDataFrame(merchants, "target long, level1 string, level2 string")
    got = semantics.recategorise(table, df, most, rate, share)
    want = walked(merchants, choices, most, rate, share)
    assert sorted(tuple(r) for r in got.select("target", "old_level1", "old_level2", "new_level1", "new_level2").collect()) == want and want
    new = {r["target"]: (r["level1"], r["level2"]) for r in semantics.after(table, got).collect()}
    assert len(new) == 400 and all(new[t] == (x, y) for t, _, _, x, y in want)
    summary = {(r["measure"], r["scope"]): r["value"] for r in semantics.change_summary(table, df, got).collect()}
    assert summary["changed", "all"] == len(want) and summary["merchants", "all"] == 400
    assert semantics.explained(got).where(F.col("reason").isNull()).count() == 0


def test_categories_add_up_from_their_merchants(spark):
    """Profiles of categories, put together from tallies of merchants, against plain sums over the facts; and facts that are read once."""
    rng = np.random.default_rng(5)
    n = 600
    pick = lambda names: [str(x) for x in rng.choice(names, n)]
    rows = list(zip([int(x) for x in rng.integers(0, 9, n)], [float(x) for x in np.round(rng.lognormal(8, 1, n), 2)], [int(x) for x in rng.integers(0, 3, n)], [int(x) for x in rng.integers(0, 5, n)], [int(x) for x in rng.integers(0, 2, n)],
        pick(["Female", "Male"]), pick(semantics.AGE_LABELS), pick(semantics.EDUCATION_LABELS), pick(semantics.INDUSTRY_LABELS), strict=True))
    rows += [(9, 5.0, 0, 7, None, "Male", semantics.AGE_LABELS[0], semantics.EDUCATION_LABELS[0], semantics.INDUSTRY_LABELS[0])]
    facts = spark.createDataFrame(rows, "target long, amount double, label int, hour int, out int, gender string, age string, education string, industry string")
    places = {t: ("one", "a") if t < 5 else ("one", "b") if t < 9 else ("two", "c") for t in range(10)}
    tally = semantics.tallies(facts, spark.createDataFrame([(t, *p) for t, p in places.items()], "target long, level1 string, level2 string"))
    got = {(r["level1"], r["level2"]): r for r in semantics.profiles(semantics.summed(tally, ["level1", "level2"]), ["level1", "level2"]).collect()}
    assert set(got) == set(places.values()) and got["two", "c"]["cross"] is None and got["two", "c"]["std"] == 0
    for key, r in got.items():
        own = [x for x in rows if places[x[0]] == key]
        amounts = [x[1] for x in own]
        hours = [x[3] for x in own]
        assert r["tx"] == len(own) and r["fraud"] == sum(x[2] == 1 for x in own) and r["total"] == pytest.approx(sum(amounts)) and r["mean"] == pytest.approx(np.mean(amounts))
        assert r["std"] == pytest.approx(np.std(amounts, ddof=1) if len(own) > 1 else 0.0, rel=1e-9)
        assert list(r["top_hours"]) == sorted(set(hours), key=lambda h: (-hours.count(h), h))[:3]
        assert list(r["ages"]) == [np.mean([x[6] == v for x in own]) for v in semantics.AGE_LABELS] and r["women"] == np.mean([x[5] == "Female" for x in own])
    assert not any(t.inputFiles() for t in semantics.tables(spark, "/root/testdata/sf0.001"))
    merchants, _, profile, prior = semantics.tables(spark, "/root/testdata/sf0.001")
    # Options against every category tried on its own.
    every = semantics.risk(prior).collect()
    candidates = semantics.against(profile, prior).withColumns({"labeled": F.lit(1), "rate": F.lit(0.5), "dims": F.lit(1)}).orderBy("target").limit(12)
    old = {r["target"]: r for r in candidates.withColumn("fit", semantics.fit_of()).collect()}
    lists = {r["target"]: [(o["cross"], o["new_level1"], o["new_level2"]) for o in r["options"]] for r in semantics.options(candidates, prior).collect()}
    risks = {(r["level1"], r["level2"]): r["risk"] for r in every}
    plain = profile.join(F.broadcast(candidates.select("target")), "target").drop("level1", "level2").join(prior.select("level1", "level2"))
    want: dict = {}
    for r in semantics.against(plain, prior).withColumn("fit", semantics.fit_of()).collect():
        was, now = old[r["target"]], (r["level1"], r["level2"])
        gain, cross = round(risks[now] - risks[was["level1"], was["level2"]], 9), r["level1"] != was["level1"]
        fine = r["fit"] >= round(was["fit"] + 0.05, 9) and risks[now] >= 0.65 if cross else r["fit"] >= round(was["fit"] - 0.08, 9)
        if now != (was["level1"], was["level2"]) and gain >= 0.12 and fine:
            want.setdefault(r["target"], []).append((int(cross), -round(r["fit"] + 0.35 * risks[now], 9), *now))
    assert lists == {t: [(o[0], *o[2:]) for o in sorted(os)] for t, os in want.items()} and lists
