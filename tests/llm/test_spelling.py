import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from giftlens.llm import twins
from giftlens.llm.fm_index import Vocabulary
from giftlens.llm.spelling import crc_after, near_pairs, variants, words_of

DOC = "doc_id long, text string, word string, n long, shard int, key string"
WORD = "word string, n long, near string, key int"


def one_apart(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def words_by_hand(rows):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}


def variants_by_hand(n):
    near = {w: [x for x in n if x != w and one_apart(w, x)] for w in n}
    best = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: b for w, b in best.items() if n[b] >= 2 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w
    return {(w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


def texts(seed, docs=120):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcdeÉéß×") for _ in range(rng.randint(3, 9))) for _ in range(25)]
    stems += ["aaaaaa", "aaaaa", "abcdefghijklmnop", "abcdefghijklmnopq", "bcdefghijklmnopqr", "x" * 70]
    def word():
        w = rng.choice(stems)
        if rng.random() < 0.4:
            k = rng.randrange(len(w) + 1)
            w = rng.choice([w[:k] + rng.choice("abcé") + w[k:], w[:k] + w[k + 1:], w[:k] + rng.choice("abcÀ") + w[k + 1:]])
        return rng.choice([w, w.upper().replace("SS", "ß")])
    rows = [(rng.choice([k, None, 7]), "".join(word() + rng.choice([" ", "1", "日", "\n", "ā", "\xbf", "Ā"]) for _ in range(rng.randint(0, 60)))) for k in range(docs)]
    return rows + [(1, None), (2, ""), (3, "y" * 40000), (3, "y" * 40000), (3, "y" * 40000), (4, "short of five"), rows[0], rows[0]]


@pytest.mark.parametrize("seed", [1, 2])
def test_words_and_variants_equal_brute_force(spark, seed):
    rows = texts(seed)
    docs = spark.createDataFrame([(*r, "x", 1, 2, "k") for r in rows], DOC).repartition(3)
    words = words_of(docs)
    want = words_by_hand(rows)
    assert {r.word: r.n for r in words.collect()} == want
    assert any(zlib.crc32(f"{i}:{w}".encode()) % 97 == 0 for i, t in rows if i is not None for w in (t or "").split())
    got = [tuple(r) for r in variants(words).collect()]
    assert len(got) == len(want) and set(got) == variants_by_hand(want)
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert set(con.sql(twins.OP12_SQL).fetchall()) == set(got)


@pytest.mark.parametrize("hot, shard_chars", [(100_000, 500_000), (5, 300), (1, 60)])
def test_pairs_are_whole_however_groups_are_split(spark, hot, shard_chars):
    """A third of the words share their first half; crowded halves are split around the error."""
    rng = random.Random(3)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(0, 7))) for _ in range(150)}
    words |= {"crowded" + "".join(rng.choice("abc") for _ in range(rng.randint(4, 7))) for _ in range(80)} | {"日本語", "日本", "𝒳本語"}
    n = {w: rng.randint(1, 40) for w in words}
    df = spark.createDataFrame([(w, k, "x", 1) for w, k in n.items()], WORD)
    got = Counter(tuple(r) for r in near_pairs(df, hot, shard_chars).collect())
    assert max(got.values()) == 1
    assert set(got) == {(a, b, n[b]) for a in n for b in n if a != b and one_apart(a, b)}
    assert {tuple(r) for r in variants(df, hot, shard_chars).collect()} == variants_by_hand(n)


def test_nothing_in_nothing_out(spark):
    assert variants(words_of(spark.createDataFrame([], DOC))).count() == 0
    assert variants(words_of(spark.createDataFrame([(1, None, "x", 1, 2, "k"), (2, "1 2", "x", 1, 2, "k")], DOC))).count() == 0
    assert [tuple(r) for r in variants(spark.createDataFrame([("alone", 4, "x", 1)], WORD)).collect()] == [("alone", None, "alone", 4, 0, None)]


@pytest.mark.parametrize("seed", range(12))
def test_search_finds_every_word_once(seed):
    rng = random.Random(seed)
    letters = ["ab", "abcdé", "aé日𝒳"][seed % 3]
    words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(0, 9 if seed % 2 else 40))) for _ in range(rng.randint(1, 150))})
    asks = [(i, p, s) for i, w in enumerate(words) for p, s in ((len(w) // 2, 0), (0, len(w) - len(w) // 2)) if p + s < len(w)]
    asks = np.array(asks, np.int64).reshape(-1, 3)
    q, found, deleted = Vocabulary(words).near(*asks.T)
    got = Counter(zip(asks[q, 0].tolist(), found.tolist()))
    assert max(got.values(), default=1) == 1
    assert set(got) == {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if i != j and len(a) >= len(b) and one_apart(a, b)}
    assert all(d == (len(words[w]) < len(words[asks[k, 0]])) for k, w, d in zip(q, found, deleted))


def test_crc_goes_on_from_a_prefix():
    raw = np.frombuffer(("x" * 300 + "abc" + "é" * 5).encode(), np.uint8)
    starts, size = np.array([0, 300, 303, 5]), np.array([300, 3, 10, 0])
    got = crc_after(np.array([zlib.crc32(b"7:")] * 4, np.uint32), raw, starts, size)
    assert got.tolist() == [zlib.crc32(b"7:" + raw[a:a + n].tobytes()) for a, n in zip(starts, size)]
