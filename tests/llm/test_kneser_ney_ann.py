import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from giftlens.llm import ann, queries
from giftlens.llm import blocks as B
from giftlens.llm.kneser_ney import CALIBRATE, Lookup, byte_grams, classify, perplexities, word_perplexities


def brute_force(rows, training, order):
    """log probabilities by the textbook recursion, per language; rows: (id, text, lang)."""
    counts = {}
    for lang in {x for _, _, x in rows}:
        top = Counter()
        for i, t, x in rows:
            if x == lang and i in training:
                b = b"\0" * (order - 1) + (t or "").encode()
                top.update(b[k:k + order] for k in range(len(b) - order + 1))
        levels = {order: top}
        for k in range(order - 1, 0, -1):
            levels[k] = Counter(g[1:] for g in levels[k + 1])
        counts[lang] = levels

    def discounts(level):
        n = [sum(1 for c in level.values() if c == j) for j in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] + 2 * n[1] else 0
        out = []
        for j in (1, 2, 3):
            d = j - (j + 1) * y * n[j] / n[j - 1] if n[0] and n[j - 1] else 0.5 * j
            out.append(min(max(d, 0.1), 0.95 * j))
        return out

    cut, context = {}, {}
    for lang, levels in counts.items():
        for k, level in levels.items():
            cut[lang, k] = discounts(level)
            by = defaultdict(list)
            for g, c in level.items():
                by[g[:-1]].append(c)
            context[lang, k] = by

    def p(lang, g):
        k = len(g)
        if not k:
            return 1 / 256
        by = context[lang, k].get(g[:-1])
        below = p(lang, g[1:])
        if not by:
            return below
        d = cut[lang, k]
        c = counts[lang][k].get(g, 0)
        take = lambda c: 0 if not c else d[min(c, 3) - 1]
        return (c - take(c)) / sum(by) + sum(map(take, by)) / sum(by) * below

    out = Counter()
    for i, t, lang in rows:
        b = (t or "").encode()
        full = b"\0" * (order - 1) + b
        logs = [math.log(p(lang, full[k:k + order])) for k in range(len(b))]
        out[(i, lang, len(b), round(math.exp(-sum(logs) / len(b)), 3) if b else None)] += 1
    return out


@pytest.mark.parametrize("size", [1 << 24, 300])
def test_perplexities_equal_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(B, "block_count", lambda docs, col, block_bytes=0, f=B.block_count: f(docs, col, size))
    rng = random.Random(6)
    word = lambda: rng.choice(["the", "gift", "of", "Ünï", "shop", "a", "日本", "zz%%"])
    rows = [(k, " ".join(word() for _ in range(rng.randint(1, 12))), rng.choice(["en", "de", None, ""])) for k in range(60)]
    rows += [(100, None, "en"), (101, "", "en"), (102, "x y " * 400, "en"), (None, "the gift", "de"), (103, "alone", "fr"),
             (7, "a second row of an id", "en"), (7, "a second row of an id", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("g", F.lit(1)).withColumn("part", F.lit(2))
    trusted = spark.createDataFrame([(k,) for k in range(40)] + [(3,), (None,)], "doc_id long")
    scores = perplexities(df, trusted, order=3)
    got = scores.collect()
    training = {r.doc_id for r in got if r.part == "train"}
    assert training | {r.doc_id for r in got if r.part == "calibrate"} == set(range(40)) and len(training) > 40 // CALIBRATE
    want = brute_force(rows, training, 3)
    mine = Counter((r.doc_id, r.lang, r.n_bytes, None if r.perplexity is None else round(r.perplexity, 3)) for r in got)
    close = lambda a, b: a[:3] == b[:3] and (a[3] is None) == (b[3] is None) and (a[3] is None or abs(a[3] - b[3]) < 0.01)
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[1] or "", r[3] or 0)
    for a, b in zip(sorted(mine.elements(), key=key), sorted(want.elements(), key=key), strict=True):
        assert close(a, b), (a, b)
    kept = {r.doc_id: (r.kept, r.threshold) for r in classify(scores).collect()}
    assert kept[100][0] is False and kept[101][0] is False and kept[103] == (True, None)


def test_perplexities_without_rows_or_trusted_texts(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long")
    assert classify(perplexities(empty, none)).collect() == []
    r = classify(perplexities(spark.createDataFrame([(1, "abc", "en")], empty.schema), none)).first()
    assert r.kept and abs(r.perplexity - 256) < 1e-3


def test_byte_grams_and_lookup():
    raw, off = np.frombuffer(b"abcdab", np.uint8), np.array([0, 4, 4, 6])
    want = [b"\0\0a", b"\0ab", b"abc", b"bcd", b"\0\0a", b"\0ab"]
    assert byte_grams(raw, off, 3).tolist() == [int.from_bytes(w, "big") for w in want]
    keys = np.unique(np.random.default_rng(0).integers(0, 2**40, 5000))
    assert (Lookup(keys, keys * 0.5)(keys[::-1]) == keys[::-1] * 0.5).all()


def vectors(spark, n=1500, dim=16, hot=0, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[:hot] = x[0]
    rows = [(k, [float(v) for v in x[k]]) for k in range(n)]
    bad = [(5000, None), (5020, [0.0] * dim), (5040, [float("nan")] * dim), (5060, [1.0, None] * (dim // 2)),
           (5080, [float("inf")] + [1.0] * (dim - 1)), (5100, [1.0]), (5120, []), (None, [1.0] * dim)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("leaf", F.lit("x"))
    return x, df


@pytest.mark.parametrize("hot", [0, 500])
def test_neighbours_reach_recall_and_order(spark, monkeypatch, hot):
    monkeypatch.setattr(ann, "CELL_ROWS", 200)
    monkeypatch.setattr(ann, "QUERY_ROWS", 20)
    x, df = vectors(spark, hot=hot)
    out = ann.nearest(df, k=10, query_filter=F.col("vec_id") % 20 == 0, sample_rows=600).collect()
    by = defaultdict(list)
    for r in out:
        by[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert sorted(by) == list(range(0, 1500, 20))
    hits = 0
    for q, found in by.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11)) and q not in [v for _, v, _ in found]
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        for _, v, s in found:
            assert s == math.fsum((x[q].astype(float) * x[v].astype(float)).tolist())
        exact = sorted((-math.fsum((x[q].astype(float) * x[v].astype(float)).tolist()), v) for v in range(1500) if v != q)[:10]
        hits += len({v for _, v in exact} & {v for _, v, _ in found})
    assert hits / (10 * len(by)) >= 0.9


def test_neighbours_of_few_equal_or_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert ann.nearest(spark.createDataFrame([], schema)).collect() == []
    assert ann.nearest(spark.createDataFrame([(1, [0.0, 0.0])], schema)).collect() == []
    same = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(60)], schema)
    got = sorted(tuple(r) for r in ann.nearest(same, k=3, query_filter="vec_id < 2").collect())
    assert got == [(0, 1, 1, 5.0), (0, 2, 2, 5.0), (0, 3, 3, 5.0), (1, 1, 0, 5.0), (1, 2, 2, 5.0), (1, 3, 3, 5.0)]
    assert len(ann.nearest(same.where("vec_id < 2"), k=20).collect()) == 2


def test_every_query_row_is_answered(spark):
    rng = random.Random(5)
    rows = [(k % 40, [rng.gauss(0, 1) for _ in range(8)]) for k in range(120)]  # every id has three rows
    out = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=10, query_filter="vec_id = 0").collect()
    assert Counter(r["rank"] for r in out) == {k: 3 for k in range(1, 11)}
    want = Counter()
    for i, q in rows:
        if i == 0:
            found = sorted((-math.fsum(a * b for a, b in zip(q, v)), j) for j, v in rows if j)[:10]
            want.update((j, round(-s, 9)) for s, j in found)
    assert sum((Counter((r.vec_id, round(r.score, 9)) for r in out) & want).values()) >= 27


def test_word_perplexities_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(B, "block_count", lambda docs, col, block_bytes=0, f=B.block_count: f(docs, col, 300))
    rng = random.Random(7)
    word = lambda: rng.choice(["the", "gift", "of", "Ünï", "shop", "a", "日本"] + ["w%d" % k for k in range(30)])
    rows = [(k, "  ".join(word() for _ in range(rng.randint(1, 12))), rng.choice(["en", "de", None])) for k in range(60)]
    rows += [(100, None, "en"), (101, " \n", "en"), (102, "x y " * 40, "en"), (None, "the gift", "de"), (103, "alone here", "fr")]
    trusted = spark.createDataFrame([(k,) for k in range(40)], "doc_id long")
    got = word_perplexities(spark.createDataFrame(rows, "doc_id long, text string, lang string"), trusted).collect()
    training = {r.doc_id for r in got if r.part == "train"}

    def model(lang):
        top = Counter()
        for i, t, x in rows:
            if x == lang and i in training:
                w = ["", "", *t.split()]
                top.update(zip(w, w[1:], w[2:]))
        levels = {3: top, 2: Counter(g[1:] for g in top)}
        levels[1] = Counter(g[1:] for g in levels[2])

        def p(g):
            if not g:
                return 1 / (len(levels[1]) + 1)
            level = levels[len(g)]
            by = [c for h, c in level.items() if h[:-1] == g[:-1]]
            if not by:
                return p(g[1:])
            n = [sum(1 for c in level.values() if c == j) for j in (1, 2, 3, 4)]
            y = n[0] / (n[0] + 2 * n[1]) if n[0] + 2 * n[1] else 0
            d = [min(max(j - (j + 1) * y * n[j] / n[j - 1] if n[0] and n[j - 1] else 0.5 * j, 0.1), 0.95 * j) for j in (1, 2, 3)]
            take = lambda c: d[min(c, 3) - 1] if c else 0
            return (level[g] - take(level[g])) / sum(by) + sum(map(take, by)) / sum(by) * p(g[1:])
        return p

    models = {lang: model(lang) for lang in {x for _, _, x in rows}}
    want = {}
    for i, t, lang in rows:
        w = ["", "", *(t or "").split()]
        logs = [math.log(models[lang](g)) for g in zip(w, w[1:], w[2:])]
        want[i] = math.exp(-sum(logs) / len(logs)) if logs else None
    assert len(got) == len(rows)
    for r in got:
        assert (r.perplexity is None) == (want[r.doc_id] is None) and (
            r.perplexity is None or abs(r.perplexity / want[r.doc_id] - 1) < 1e-4), (r, want[r.doc_id])


def shuffled_bytes(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    files = [files.apply(k) for k in range(files.size())]
    return sum(f.length() for f in files if f.getName().startswith("shuffle_"))


def test_word_rounds_give_the_same_and_free_what_they_exchange(spark, monkeypatch):
    monkeypatch.setattr(B, "block_count", lambda docs, col, block_bytes=0, f=B.block_count: f(docs, col, 1 << 17))
    rng = random.Random(11)
    rows = [(k, " ".join("w%d" % int(rng.paretovariate(0.3) % 10**6) for _ in range(400)), rng.choice(["en", "de", None]))
            for k in range(200)] + [(1000, "x" * 1000 + " y " + "x" * 1001, "en"), (1001, "x" * 1000 + " y", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trusted = spark.createDataFrame([(k,) for k in range(120)] + [(1000,)], "doc_id long")
    one = {r.doc_id: r.perplexity for r in word_perplexities(df, trusted, rounds=1).collect()}
    before = shuffled_bytes(spark)
    many = {r.doc_id: r.perplexity for r in word_perplexities(df, trusted, rounds=3).collect()}
    assert shuffled_bytes(spark) - before < sum(len(t) for _, t, _ in rows) / 2
    assert one.keys() == many.keys() and all(abs(one[k] / many[k] - 1) < 1e-9 for k in one)


def test_word_order_counts_in_the_query(spark, tmp_path):
    rng = random.Random(3)
    # words that begin and end alike: five bytes never see which word follows which
    kinds = [["be%sing" % "".join(rng.choice("klmnoprstu") for _ in range(5)) for _ in range(3)] for _ in range(6)]
    sentence = lambda: " ".join(rng.choice(x) for x in kinds)
    rows = [(k, " ".join(sentence() for _ in range(20)), "en") for k in range(400)]
    for k in range(400, 450):  # the same words in any order
        w = " ".join(sentence() for _ in range(20)).split()
        rng.shuffle(w)
        rows.append((k, " ".join(w), "en"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1) for k in range(300)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r.doc_id for r in queries.QUERIES["op6_kneser_ney"](spark, str(tmp_path)).where("kept").collect()}
    assert not kept & set(range(400, 450)) and len(kept & set(range(300, 400))) >= 80


def test_threshold_survives_odd_trusted_texts(spark):
    rng = random.Random(5)
    rows = [(k, "de", "calibrate", 10, rng.uniform(3, 5)) for k in range(30)] + [(90, "de", "calibrate", 10, 25.0)]
    rows += [(k, "en", "calibrate", 10, rng.uniform(3, 5)) for k in range(100, 300)] + [(400, "de", None, 10, 20.0), (401, "de", None, 10, 4.0)]
    scores = spark.createDataFrame(rows, "doc_id long, lang string, part string, n_bytes long, perplexity double")
    kept = {r.doc_id: r.kept for r in classify(scores).collect()}
    assert kept[400] is False and kept[401] is True
