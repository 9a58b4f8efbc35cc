"""Blocks over one order against a plain loop, for any number of ranges."""

import numpy as np
import pytest

from ledgerloom.plans import clock

COLUMNS = "seq long, source long, target long, amount double, label int"


def plain(rows, size=20, tolerance=0.01):
    """Blocks as a program would cut them, row after row: (seq, block, k, n, kind)."""
    near = lambda a, b: abs(a - b) <= tolerance * max(abs(a), abs(b), 1e-6)
    out, i = [], 0
    while i < len(rows):
        first, n, kind = rows[i], 1, "normal"
        if first[4] == 1:
            kind = "isolated_fraud"
            for end in range(i + 2, min(len(rows), i + size) + 1):
                part = rows[i:end]
                if any(r[4] != 1 for r in part):
                    break
                target, source = all(r[2] == first[2] for r in part), all(r[1] == first[1] for r in part)
                found = "equal_amount" if all(near(r[3], first[3]) for r in part) else "same_pair" if target and source else "same_target" if target else "same_source" if source else None
                if found:
                    n, kind = end - i, found
        else:
            while n < size and i + n < len(rows) and rows[i + n][4] != 1:
                n += 1
        out += [(rows[i + j][0], first[0], j, n, kind) for j in range(n)]
        i += n
    return out


@pytest.fixture(scope="module")
def given():
    """Long runs of both kinds, fraud runs over several users, amounts that nearly agree."""
    rng = np.random.default_rng(6)
    rows, seq = [], 0
    for _ in range(60):
        fraud = rng.random() < 0.6
        for _ in range(int(rng.integers(1, 60))):
            seq += int(rng.integers(1, 4))
            rows.append((seq, int(rng.integers(1, 3)), int(rng.choice([7, 7, 7, 8])), float(rng.choice([10.0, 10.0, 10.0, 10.05, 0.0, 99.0])), 1 if fraud else int(rng.choice([0, 2]))))
    rows += [(seq + 1 + i, 5, 9, 3.0, 1) for i in range(45)] + [(seq + 50 + i, i, 9, float(i), 1) for i in range(45)]
    return rows


@pytest.mark.parametrize("parts", [1, 3, 16, 150])
def test_blocks_are_those_of_a_plain_loop(spark, given, parts):
    df = spark.createDataFrame(given, COLUMNS).repartition(5)
    got = clock.block_rows(df, parts=parts).select("seq", "block", "k", "n", "kind").collect()
    want = plain(given)
    assert sorted(map(tuple, got)) == sorted(want)
    assert {k for *_, k in want} == {"normal", "isolated_fraud", "equal_amount", "same_pair", "same_target", "same_source"}


def test_ranges_shorter_than_a_block(spark):
    rows = [(i, 1, 1, 5.0, 0) for i in range(70)]
    got = clock.block_rows(spark.createDataFrame(rows, COLUMNS), parts=60)
    assert sorted(tuple(r) for r in got.select("seq", "block", "k").collect()) == [(i, i // 20 * 20, i % 20) for i in range(70)]
    assert clock.block_rows(spark.createDataFrame([], COLUMNS)).count() == 0
