"""Ordered target statistics over several ranges against a plain loop."""

import hashlib
from collections import defaultdict

import pytest

from giftlens.operators.features import ordered_target_stats


def test_categories_carry_their_sums_over_ranges(spark):
    rows = [(f"k{i}" if i else None, "hot" if i % 3 else f"v{i % 7}", None if i % 5 == 0 else f"w{i}", None if i % 11 == 0 else i / 8, i) for i in range(120)]
    df = spark.createDataFrame(rows, "k string, a string, b string, y double, other int").repartition(3)
    found = ordered_target_stats(df, ["a", "b"], "y", ["k"], prior=0.25, range_rows=9)
    assert found.columns == [*df.columns, "a_ts", "b_ts"]
    seen = defaultdict(lambda: [0.0, 0])
    want = {}
    for k, a, b, y, other in sorted(rows, key=lambda r: hashlib.md5(f"{r[0] or 'NONE'}|42".encode()).hexdigest()):
        cells = [seen["a", a], seen["b", b]]
        want[other] = [(s + 0.25) / (n + 1) for s, n in cells]
        for cell in cells:
            cell[0] += y or 0.0
            cell[1] += 1
    got = {r.other: (r, [r.a_ts, r.b_ts]) for r in found.collect()}
    assert len(got) == 120 and all(got[o][1] == pytest.approx(want[o]) for o in want)
    assert all(tuple(got[r[4]][0])[:5] == r for r in rows)


def test_rows_that_share_keys_get_the_largest(spark):
    df = spark.createDataFrame([("k", "a", 1.0), ("k", "a", 1.0), ("j", "b", 0.5)], "k string, a string, y double")
    found = sorted((r.k, r.a_ts) for r in ordered_target_stats(df, ["a"], "y", ["k"], prior=0.0).collect())
    assert found == [("j", 0.0), ("k", 0.5), ("k", 0.5)]


def test_rows_that_are_stored_are_not_stored_again(spark, monkeypatch):
    from giftlens import session
    rows = spark.createDataFrame([(i, f"c{i % 3}", float(i % 2)) for i in range(40)], "k long, cat string, label double")
    stored = session.cut_lineage(rows)
    want = sorted(map(tuple, ordered_target_stats(rows, ["cat"], "label", ["k"], range_rows=10).collect()))
    monkeypatch.setattr(session, "cut_lineage", lambda *a: (_ for _ in ()).throw(AssertionError("stored again")))
    assert sorted(map(tuple, ordered_target_stats(stored, ["cat"], "label", ["k"], range_rows=10, stored=True).collect())) == want


def test_sums_are_the_nearest_doubles_of_exact_sums(spark):
    import random
    from decimal import Decimal
    rng = random.Random(3)
    rows = [(f"k{i}", rng.choice(["a", "b"]), rng.choice([1, -1, 9000]) * rng.random()) for i in range(300)]
    found = ordered_target_stats(spark.createDataFrame(rows, "k string, a string, y double"), ["a"], "y", ["k"], prior=0.25, range_rows=40)
    sums, want = defaultdict(lambda: [Decimal(0), 0]), {}
    for k, a, y in sorted(rows, key=lambda r: hashlib.md5(f"{r[0]}|42".encode()).hexdigest()):
        want[k] = (float(sums[a][0]) + 0.25) / (sums[a][1] + 1)
        sums[a][0] += Decimal(repr(y)).quantize(Decimal("1e-12"), "ROUND_HALF_UP")
        sums[a][1] += 1
    assert {r.k: r.a_ts for r in found.collect()} == want
