import hashlib
import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from giftlens.operators.selection import choose, pair_information, select_features


def test_pair_information_equals_formula_and_redundant_columns_wait(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(600):
        a, noise, b = rng.randrange(4), rng.choice(["x", "y", None]), rng.randrange(3)
        rows.append((f"a{a}", f"copy of a{a}", noise, f"b{b}", rng.choice([None, float("nan"), 0.3 * a + 0.2 * b, 0.3 * a + 0.2 * b, 0.3 * a + 0.2 * b])))
    df = spark.createDataFrame(rows, "a string, copy string, noise string, b string, label double").repartition(4)
    names = ["a", "copy", "noise", "b"]
    found = {(r.feature, r.other): (r.mutual_information, r.n) for r in pair_information(df, names, bins=6).collect()}
    kept = [r for r in rows if r[4] is not None and r[4] == r[4]]
    cuts = sorted({float(np.quantile([r[4] for r in kept], k / 6)) for k in range(1, 6)})
    bucket = lambda v: int(hashlib.md5((v or "NONE").encode()).hexdigest()[:6], 16) % 32
    columns = {n: [bucket(r[i]) for r in kept] for i, n in enumerate(names)} | {"label": [sum(r[4] > c for c in cuts) for r in kept]}
    assert set(found) == set(combinations([*names, "label"], 2))
    for (x, y), (mi, n) in found.items():
        xy, cx, cy = Counter(zip(columns[x], columns[y])), Counter(columns[x]), Counter(columns[y])
        want = sum(c / len(kept) * math.log(c * len(kept) / (cx[i] * cy[j])) for (i, j), c in xy.items())
        assert mi == pytest.approx(want, abs=1e-9) and n == len(kept)
    # the copy of the best column says nothing new: the second choice is the other informative one
    assert select_features(df, names, 2, bins=6) == ["a", "b"]


def test_choice_by_hand():
    pairs = [("p", "label", 0.9), ("q", "label", 0.8), ("r", "label", 0.3), ("p", "q", 0.85), ("p", "r", 0.0), ("q", "r", 0.1)]
    assert [c for c, _ in choose(pairs, ["p", "q", "r"], 3)] == ["p", "r", "q"]
    assert choose(pairs, ["p"], 5) == [("p", 0.9)] and choose([], [], 3) == []
    assert [c for c, _ in choose([("p", "label", 0.5), ("q", "label", 0.5)], ["q", "p"], 1)] == ["q"]


def test_pairs_are_counted_before_they_are_shuffled(spark):
    df = spark.createDataFrame([(f"a{i}", f"b{i}", i / 50) for i in range(50)], "a string, b string, label double")
    plan = pair_information(df, ["a", "b"])._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan
