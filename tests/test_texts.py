"""Texts against plain loops."""

from ledgerloom.plans import texts


def test_earlier_names_of_a_category_by_several_tasks(spark):
    """One category has most merchants, some have no name, one no category: blocks of 7 names give what one walk gives, and rows meet their earlier names without a shuffle of lists."""
    rows = [(i, None if i % 11 == 0 else "a" if i % 10 else "b", "x", None if i % 5 == 0 or 20 < i < 40 else f"n{i}") for i in range(200)]
    want, seen = {}, {}
    for target, *key, name in rows:
        names = seen.setdefault(tuple(key), [])
        want[target] = "\n".join(names)
        names += [f"- {name}"] if name else []
    dim = spark.createDataFrame(rows, "target long, level1 string, level2 string, name string").repartition(3)
    found = texts.running_concepts(dim, block=7)
    got = found.selectExpr("*", "spark_partition_id() AS part").collect()
    assert {r["target"]: r["existing_concepts"] for r in got} == want
    of_a = {r["part"] for r in got if rows[r["target"]][1] == "a"}
    assert len(of_a) > 1
    assert texts.running_concepts(dim, most=2).where("target = 15").first()["existing_concepts"] == "- n13\n- n14"
