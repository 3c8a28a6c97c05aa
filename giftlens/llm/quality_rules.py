"""Quality rules: learned decision lists over native text statistics.

Sequential covering: a rule grows one threshold at a time, by information gain
over counts of labelled rows, until it covers no good row; it is pruned back on
rows kept from growing; rows that it covers are set aside and the next rule
grows on the rest. Counts come from Spark aggregates of at most
features x thresholds rows; the outcome is an ordered conditional expression.
Everything is DataFrame expressions, with no Python on the executors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checkpoints import written

#: Most labelled rows that the fit reads (chosen by hash of the id).
MAX_LABELLED = 60_000
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
_POSITION_BITS = 27

FEATURES = ["n_words", "mean_word_chars", "symbols_per_word", "capitals_share", "exclaims_per_word",
            "distinct_share", "repeat_share", "dup_line_share"]


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def text_statistics(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: the id, ``n_words`` and base counts (``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words``), further counts, the ratios of ``FEATURES``, and the columns of ``carry``.

    Words are ``[^\\x20\\x09-\\x0D]+``. ``n_repeat_words`` counts words in
    three-word windows that occur at least twice in the text: 36-bit hashes
    sorted with their places give candidates, which are then compared as words.
    A null or empty text has no words and all counts zero.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), *carry)
    rows = rows.select("doc_id", *carry, "text", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "").alias("words"))
    place = (1 << _POSITION_BITS) - 1
    word = lambda i: F.get("words", i)
    spots = F.when(F.size("words") >= 4, F.sequence(F.lit(0), F.size("words") - 3)).otherwise(
        F.array().cast("array<int>"))
    packed = F.transform(spots, lambda i: F.shiftleft(
        F.xxhash64(word(i), word(i + 1), word(i + 2)).bitwiseAND(F.lit((1 << 36) - 1)), _POSITION_BITS)
        .bitwiseOR(i.cast("long")))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(
        "doc_id", *carry, "words", F.size("words").cast("long").alias("n_words"), F.length("text").alias("chars"),
        _without(F.col("text"), SPACES).cast("long").alias("word_chars"),
        (F.length("text") - _without(F.col("text"), SYMBOLS)).cast("long").alias("n_symbols"),
        (F.length("text") - _without(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).alias("n_capitals"),
        (F.length("text") - _without(F.col("text"), "!")).alias("n_exclaims"),
        F.size(F.array_distinct("words")).alias("n_distinct"), lines.alias("lines"),
        F.sort_array(packed).alias("windows"))
    key = lambda x: F.shiftright(x, _POSITION_BITS)
    near = lambda col, x, k, f: (  # noqa: E731  equal to the neighbour before or after
        F.coalesce(f(F.get(col, k - 1)) == f(x), F.lit(False)) | F.coalesce(f(F.get(col, k + 1)) == f(x), F.lit(False)))
    rows = rows.withColumn("maybe", F.filter("windows", lambda x, k: near("windows", x, k, key)))
    rows = rows.withColumn("grams", F.array_sort(F.transform("maybe", lambda x: F.struct(
        F.concat_ws(" ", *[word((x.bitwiseAND(F.lit(place)) + j).cast("int")) for j in range(3)]).alias("g"),
        x.bitwiseAND(F.lit(place)).alias("p")))))
    rows = rows.withColumn("starts", F.sort_array(F.transform(
        F.filter("grams", lambda x, k: near("grams", x, k, lambda y: y["g"])), lambda x: x["p"])))
    steps = F.transform("starts", lambda s, k: F.when(k == 0, F.lit(3).cast("long")).otherwise(
        F.least(F.lit(3).cast("long"), s - F.get("starts", k - 1))))
    rows = rows.select(
        "doc_id", *carry, "n_words", "chars", "word_chars", "n_symbols", "n_capitals", "n_exclaims", "n_distinct",
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_repeat_words"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return rows.select(
        "*", share("word_chars", "n_words").alias("mean_word_chars"),
        share("n_symbols", "n_words").alias("symbols_per_word"), share("n_capitals", "chars").alias("capitals_share"),
        share("n_exclaims", "n_words").alias("exclaims_per_word"),
        share("n_distinct", "n_words").alias("distinct_share"), share("n_repeat_words", "n_words").alias("repeat_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"))


def base_failed() -> Column:
    """Fewer than 50 words, or more than half of the words in repeated three-word windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    """``feature >= cut`` (``above``) or ``feature < cut``."""

    feature: str
    cut: float
    above: bool
    bin: int

    def column(self) -> Column:
        return F.col(self.feature) >= self.cut if self.above else F.col(self.feature) < self.cut

    def on_bins(self) -> Column:
        b = F.col(f"bin_{self.feature}")
        return b >= self.bin if self.above else b < self.bin

    def __str__(self):
        return f"{self.feature} {'>=' if self.above else '<'} {self.cut:g}"


@dataclass(frozen=True)
class Rule:
    """A conjunction that rejects, with its counts of bad and good rows among those kept for pruning."""

    conditions: tuple[Condition, ...]
    bad: int
    good: int

    def column(self) -> Column:
        return _all([c.column() for c in self.conditions])

    def __str__(self):
        return "reject if " + " and ".join(map(str, self.conditions)) + f"  ({self.bad} bad, {self.good} good)"


def _all(columns: list[Column]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & c
    return out


def decision_list(rules: list[Rule]) -> Column:
    """The ordered conditional expression: the number of the first rule that holds (from 1), 0 if none does."""
    out = F
    for k, rule in enumerate(rules, 1):
        out = out.when(rule.column(), k)
    return F.lit(0) if not rules else out.otherwise(0)


def learn_rules(statistics: DataFrame, labels: DataFrame, label_col: str = "quality", features: list[str] = FEATURES,
                max_rules: int = 8, max_conditions: int = 3, thresholds: int = 48, min_bad: int = 3,
                min_precision: float = 0.95, max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """A decision list that rejects rows like those with label 0.

    ``statistics`` has ``doc_id`` and the features; ``labels`` has ``doc_id`` and
    the label (1 good, 0 bad; others and nulls are left out). At most
    ``max_labelled`` labelled rows are read. Two thirds grow rules, one third
    prunes them; a rule stays if at least ``min_bad`` bad rows and a share of
    ``min_precision`` of the covered rows speak for it there. No labels, or one class only: no rules.
    """
    known = (labels.where(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull())
             .select("doc_id", (F.col(label_col) == 0).cast("int").alias("bad"))
             .orderBy(F.xxhash64("doc_id"), "doc_id", "bad").limit(max_labelled))
    rows = statistics.select("doc_id", *[F.col(f).cast("double").alias(f) for f in features]).join(known, "doc_id")
    rows = written(rows.withColumn("grow", F.pmod(F.xxhash64("doc_id", F.lit("grow")), F.lit(3)) > 0))
    shares = [(k + 1) / (thresholds + 1) for k in range(thresholds)]
    quantiles = rows.groupBy("bad").agg(*[F.percentile_approx(f, shares, 10_000).alias(f) for f in features]).collect()
    if len(quantiles) < 2:
        return []
    # thresholds lie half way between neighbouring quantiles of the two classes
    cuts = {}
    for f in features:
        points = sorted({v for q in quantiles for v in q[f]})
        cuts[f] = [(a + b) / 2 for a, b in zip(points, points[1:])]
    bins = [sum([(F.col(f) >= c).cast("int") for c in cuts[f]], F.lit(0)).alias(f"bin_{f}") for f in features]
    cells = written(rows.select("bad", "grow", *bins).groupBy("bad", "grow", *[f"bin_{f}" for f in features])
                    .agg(F.count(F.lit(1)).alias("n")).coalesce(4))

    rules: list[Rule] = []
    left = cells
    while len(rules) < max_rules:
        grown = _grow(left.where("grow"), features, cuts, max_conditions)
        if not grown:
            break
        # one aggregate counts every prefix of the grown rule on the pruning rows
        held = left.where(~F.col("grow")).agg(*[
            F.sum(F.when(_all([c.on_bins() for c in grown[:k]]) & (F.col("bad") == bad), F.col("n")).otherwise(0))
            for k in range(1, len(grown) + 1) for bad in (1, 0)]).first()
        counts = [(int(held[2 * k] or 0), int(held[2 * k + 1] or 0)) for k in range(len(grown))]
        worth = [(p - n) / (p + n) if p + n else -1.0 for p, n in counts]
        best = max(range(len(grown)), key=lambda k: (worth[k], -k))
        bad, good = counts[best]
        if bad < min_bad or bad < min_precision * (bad + good):
            break
        rule = Rule(tuple(grown[:best + 1]), bad, good)
        rules.append(rule)
        left = left.where(~_all([c.on_bins() for c in rule.conditions]))
    return rules


def _grow(rows: DataFrame, features: list[str], cuts: dict[str, list[float]], most: int) -> list[Condition]:
    """Adds the threshold of the best gain until no good row is covered or nothing gains."""
    chosen: list[Condition] = []
    while len(chosen) < most:
        covered = rows.where(_all([c.on_bins() for c in chosen]))
        pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("f"), F.col(f"bin_{f}").alias("b"))
                                    for k, f in enumerate(features)]))
        table = (covered.select("bad", "n", pairs.alias("x")).groupBy("x.f", "x.b")
                 .agg(F.sum(F.col("n") * F.col("bad")).alias("p"), F.sum(F.col("n") * (1 - F.col("bad"))).alias("q"))
                 .collect())  # at most features x thresholds rows
        by: dict[int, dict[int, tuple[int, int]]] = {}
        for r in table:
            by.setdefault(r["f"], {})[r["b"]] = (int(r["p"]), int(r["q"]))
        if not by:
            break
        first = next(iter(by.values()))
        all_bad, all_good = (sum(v[i] for v in first.values()) for i in (0, 1))
        if not all_bad or not all_good:
            break
        best, gain = None, 1e-9
        base = math.log2(all_bad / (all_bad + all_good))
        for k, f in enumerate(features):
            p = q = 0
            for b in range(1, len(cuts[f]) + 1):  # rows in bins below b are under cut b - 1
                low = by[k].get(b - 1, (0, 0))
                p, q = p + low[0], q + low[1]
                for above, (bad, good) in ((False, (p, q)), (True, (all_bad - p, all_good - q))):
                    if bad and (g := bad * (math.log2(bad / (bad + good)) - base)) > gain:
                        best, gain = Condition(f, cuts[f][b - 1], above, b), g
        if best is None:
            break
        chosen.append(best)
    return chosen
