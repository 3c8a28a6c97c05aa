import math
import random

import pytest

from giftlens.operators.intervals import conformal_widths, least_rows, with_intervals
from giftlens.operators.names import validate_name_requests

ROW = "g string, y double, p double"


def test_least_rows_of_a_level():
    assert [least_rows(x) for x in (0.5, 0.9, 0.95, 0.99)] == [1, 9, 19, 99]
    with pytest.raises(ValueError):
        least_rows(1.0)


def test_widths_equal_sorting_and_cover_new_rows(spark):
    """A hot group, one with ties, one too small for an interval of its own, a null group, nulls and NaN."""
    rng = random.Random(3)
    def draw(n):
        rows = [("hot", rng.gauss(0, 1)) for _ in range(n)] + [("ties", rng.choice([0.0, 1.0, 1.0])) for _ in range(n // 3)]
        return rows + [("few", rng.gauss(0, 9)) for _ in range(12)] + [(None, rng.gauss(0, 1)) for _ in range(25)]
    cal = draw(900)
    rows = [(g, 5.0 + e, 5.0) for g, e in cal] + [("hot", None, 1.0), ("hot", float("nan"), 1.0), ("hot", 1.0, None)]
    got = {r.g: (r.width, r.n) for r in conformal_widths(spark.createDataFrame(rows, ROW).repartition(5), "g", level=0.9).collect()}
    def width(r):
        r = sorted(abs((5.0 + e) - 5.0) for e in r)
        return r[math.ceil(round((len(r) + 1) * 0.9, 9)) - 1], len(r)
    assert got == {"hot": width([e for g, e in cal if g == "hot"]), "ties": width([e for g, e in cal if g == "ties"]),
                   "few": width([e for g, e in cal if g == "few"]), None: width([e for _, e in cal])}
    assert "few" not in {r.g for r in conformal_widths(spark.createDataFrame(rows, ROW), "g", level=0.95).collect()}
    new = draw(3000)
    out = with_intervals(spark.createDataFrame([(g, 50.0 + e, 50.0) for g, e in new], ROW), conformal_widths(
        spark.createDataFrame(rows, ROW), "g", level=0.9), "g").collect()
    assert len(out) == len(new) and all(r.quantity == 50 for r in out)
    for g in ("hot", "ties"):
        own = [r for r in out if r.g == g]
        assert sum(r.interval_low <= r.y <= r.interval_high for r in own) / len(own) >= 0.88
    assert all(r.pooled == (r.g is None) for r in out)


def test_bounds_and_no_calibration(spark):
    none = conformal_widths(spark.createDataFrame([("a", 1.0, 1.0)], ROW), "g")
    assert [(r.g, r.width, r.n) for r in none.collect()] == [(None, None, 1)]
    new = spark.createDataFrame([("a", None, 20000.0), ("a", None, -3.0), ("b", None, 2.5)], ROW)
    out = {r.p: r for r in with_intervals(new, none, "g").collect()}
    assert [(out[p].quantity, out[p].interval_low) for p in (20000.0, -3.0, 2.5)] == [(10000, None), (0, None), (2, None)]
    known = spark.createDataFrame([("a", float(k), 0.0) for k in range(40)], ROW)
    out = {r.p: r for r in with_intervals(new, conformal_widths(known, "g"), "g").collect()}
    assert (out[2.5].interval_low, out[2.5].interval_high, out[2.5].pooled) == (0, 41, True)
    assert (out[20000.0].interval_high, out[-3.0].interval_low) == (10000, 0)
    assert conformal_widths(known.limit(0), "g").count() == 0


def test_name_request_limits(spark):
    rows = [("ok", "A")] * 3 + [("ok", ""), ("ok", None)] + [("full", "x")] * 5 + [("over", "x")] * 6 + [("none", None)]
    got = {r.request_id: (r.n_names, r.errors, r.is_valid) for r in validate_name_requests(
        spark.createDataFrame(rows, "request_id string, name string"), limit=5).collect()}
    assert got == {"ok": (4, "", True), "full": (5, "", True), "over": (6, "too_many_names", False), "none": (0, "names_empty", False)}
