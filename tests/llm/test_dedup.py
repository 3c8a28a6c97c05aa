import random
import re
from collections import Counter

import numpy as np
import pytest

from giftlens.llm import blocks as B
from giftlens.llm.components import components
from giftlens.llm.merge_runs import Run, front_code, merge, repeated
from giftlens.llm.minhash_dedup import link_cell, near_duplicates, sketches
from giftlens.llm.substring_dedup import remove_repeated_windows
from giftlens.llm.suffix_dedup import anchors, gram_hashes, remove_repeats, sliding_min


def corpus(seed, n=60, words=60):
    """Random texts with shared passages, exact and near copies, nulls, empty and very long texts, repeated rows."""
    rng = random.Random(seed)
    vocab = ["w%d" % k for k in range(400)] + ["Ünï", "日本", "a,b"]
    text = lambda k: rng.choice([" ", "  ", "\n"]).join(rng.choice(vocab) for _ in range(k))
    passage, base = text(40), [rng.choice(vocab) for _ in range(120)]
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one two"), (4, "One TWO")]
    for i in range(5, n):
        kind = rng.random()
        if kind < 0.3:
            t = text(rng.randint(1, words)) + " " + passage + " " + text(rng.randint(0, 20))
        elif kind < 0.6:
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            t = " ".join(w)
        elif kind < 0.7:
            t = passage
        else:
            t = text(rng.randint(1, words))
        rows.append((i, t))
    rows += [(n, text(6000)), (n + 1, "x" * 3000), (n + 2, rows[10][1]), (n + 2, rows[10][1]), (n + 3, "x" * 3000)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(params=[1, 2])
def rows(request):
    return corpus(request.param)


def small_blocks(monkeypatch, size):
    monkeypatch.setattr(B, "block_count", lambda docs, col, block_bytes=0, f=B.block_count: f(docs, col, size))


@pytest.mark.parametrize("size", [1 << 24, 4000])
def test_windows_equal_brute_force(docs_of, rows, monkeypatch, size):
    small_blocks(monkeypatch, size)
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in remove_repeated_windows(
        docs_of(rows, ["n_words", "block", "payload", "removed"])).collect())
    first = {}
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - 12):
            g = tuple(w[k:k + 13])
            first[g] = min(first.get(g, i), i)
    want = Counter()
    for i, w in split:
        gone = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k:k + 13])] < i:
                gone |= set(range(k, k + 13))
        want[(i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))] += 1
    assert got == want


def test_windows_of_empty_table_and_null_ids(docs_of):
    assert remove_repeated_windows(docs_of([])).collect() == []
    t = " ".join("abcdefghijklmnop")
    got = {(r.doc_id, r.n_removed) for r in remove_repeated_windows(docs_of([(None, t), (7, t), (None, t)])).collect()}
    assert got == {(7, 0), (None, 16)}
    spans = remove_repeated_windows(docs_of([(1, t), (2, "q " + t + " z")])).where("doc_id = 2").first().removed
    assert [(s.begin, s.end) for s in spans] == [(1, 17)]


@pytest.mark.parametrize("size", [1 << 24, 4000])
def test_suffixes_equal_brute_force(docs_of, rows, monkeypatch, size):
    small_blocks(monkeypatch, size)
    length, gram = 60, 16
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(
        docs_of(rows, ["kept", "block", "bucket"]), length=length, gram=gram).collect())
    data = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[k:k + length] for _, b in data for k in range(len(b) - length + 1))
    want = Counter()
    for i, b in data:
        mask = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if count[b[k:k + length]] > 1:
                mask[k:k + length] = True
        spans = int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())
        want[(i, len(b), int(mask.sum()), spans, bytes(x for x, m in zip(b, mask) if not m))] += 1
    assert got == want


def test_partial_quotes_of_copies_equal_brute_force(docs_of):
    length, rows = 24, []
    for seed in range(2500):  # two copies and a quote from their middle; texts of different seeds share nothing
        rng = random.Random(seed)
        text = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
        copy = text(rng.randint(50, 120))
        at = rng.randint(1, len(copy) - length - 1)
        quote = copy[at:at + rng.randint(length, length + 12)]
        rows += [(3 * seed, copy), (3 * seed + 1, copy), (3 * seed + 2, text(30) + quote + text(30))]
    got = {r.doc_id: bytes(r.kept).decode() for r in remove_repeats(docs_of(rows), length=length, gram=6).collect()}
    count = Counter(t[k:k + length] for _, t in rows for k in range(len(t) - length + 1))
    for i, t in rows:
        gone = {j for k in range(len(t) - length + 1) if count[t[k:k + length]] > 1 for j in range(k, k + length)}
        assert got[i] == "".join(c for j, c in enumerate(t) if j not in gone), i


def test_suffixes_of_empty_table_and_carried_columns(docs_of):
    assert remove_repeats(docs_of([])).collect() == []
    r = remove_repeats(docs_of([(1, "ab")]), carry=["lang", "source"]).first()
    assert (r.lang, r.source, bytes(r.kept), r.removed) == ("en", "s", b"ab", [])


def test_windows_with_equal_bytes_have_equal_anchors():
    rng = np.random.default_rng(0)
    piece = rng.integers(97, 100, 300).astype(np.uint8)
    found = []
    for pad in (0, 13, 40):
        raw = np.concatenate([rng.integers(97, 100, pad).astype(np.uint8), piece])
        x, y, h = anchors(raw, np.array([0, len(raw)]), 50, 8)
        # by window of the piece: the hash of its anchor
        found.append([int(h[np.searchsorted(x, k + pad, "right") - 1]) for k in range(len(piece) - 49)])
    assert found[0] == found[1] == found[2]
    v = rng.integers(0, 1000, 200).astype(np.uint64)
    for w in (1, 2, 3, 7, 8, 31):
        assert sliding_min(v, w).tolist() == [int(v[k:k + w].min()) for k in range(len(v) - w + 1)]
    for size in (8, 50, 60):
        g = gram_hashes(piece, size)
        texts = [piece[k:k + size].tobytes() for k in range(len(piece) - size + 1)]
        assert len(g) == len(texts) and len(set(zip(g.tolist(), texts))) == len(set(texts)) == len(set(g.tolist()))


def test_loser_tree_merges_front_coded_runs():
    for trial in range(60):
        rng = random.Random(trial)
        width, letters = rng.choice([3, 8, 40]), rng.choice([b"ab", b"a", bytes(range(256))])
        texts = [sorted({bytes(rng.choice(letters) for _ in range(width)) for _ in range(rng.randint(1, 30))})
                 for _ in range(rng.randint(1, 9))]

        def runs():
            out = []
            for t in texts:
                lcp, tails = front_code(np.frombuffer(b"".join(t), np.uint8).reshape(-1, width))
                out.append(Run(lcp.tolist(), tails, width))
            return out

        assert [texts[r][k] for r, k, _ in merge(runs(), width)] == sorted(x for t in texts for x in t)
        count = Counter(x for t in texts for x in t)
        found = repeated(runs(), width, [np.zeros(len(t), bool) for t in texts])
        assert [f.tolist() for f in found] == [[k for k, x in enumerate(t) if count[x] > 1] for t in texts]


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(zip(w, w[1:], w[2:])) if len(w) > 2 else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("size", [1 << 24, 4000])
def test_near_duplicates_equal_brute_force(docs_of, rows, monkeypatch, size):
    from giftlens.llm import minhash_dedup
    small_blocks(monkeypatch, size)
    monkeypatch.setattr(minhash_dedup, "CELL", 4)
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept)
                  for r in near_duplicates(docs_of(rows, ["rep", "node", "component"]), shingle=3, percent=85).collect())
    sets = [(i, shingles(t)) for i, t in rows]
    label = {i: i for i, _ in sets}
    while True:
        before = dict(label)
        for i, a in sets:
            for j, b in sets:
                if a and b and 100 * len(a & b) >= 85 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
        if label == before:
            break
    assert got == Counter((i, len(s), label[i], i == label[i]) for i, s in sets)


def test_near_duplicates_null_ids_empty_table_and_shared_ids(docs_of):
    assert near_duplicates(docs_of([])).collect() == []
    rows = [(None, "a b c d"), (5, "a b c d"), (5, "p q r s"), (3, "p q r s"), (9, None)]
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs_of(rows), shingle=3).collect()}
    assert got == {(None, 2, None, True), (5, 2, 3, False), (3, 2, 3, True), (9, 0, 9, True)}


def test_sketch_fills_and_estimates_similarity():
    rng = np.random.default_rng(4)
    common, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (600, 100, 100))
    sets = [np.concatenate([common, a]), np.concatenate([common, b]), common[:1], common[:0]]
    off = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    s = sketches(np.concatenate(sets), off, 512)
    blank = np.uint64(2**64 - 1)
    assert not (s[:3] == blank).any() and (s[3] == blank).all()
    assert abs((s[0] == s[1]).mean() - 0.75) < 0.08


def test_link_cell_gives_a_forest():
    sets = [np.arange(k, k + 100, dtype=np.uint64) for k in (0, 2, 4, 500, 502)]
    links = link_cell(sets, np.arange(5), np.arange(5), 85)
    assert len(links) == 3 and {frozenset(x) for x in links} <= {frozenset(p) for p in [(0, 1), (1, 2), (0, 2), (3, 4)]}


def test_components_of_chains_stars_and_loops(spark):
    links = [(k, k + 1) for k in range(100, 130)] + [(7, k) for k in range(8, 40)] + [(3, 3), (None, 4), (50, 51), (51, 50)]
    got = {(r.node, r.component) for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == ({(k, 100) for k in range(100, 131)} | {(k, 7) for k in range(7, 40)} | {(50, 50), (51, 50)})
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


def test_sorted_lists_round_trip():
    rng = np.random.default_rng(1)
    for bits in (20, 40, 52, 64):
        v = np.unique(rng.integers(0, 2**bits - 1, 300, dtype=np.uint64))
        assert (B.decode_sorted(B.encode_sorted(v)) == v).all()
    assert len(B.decode_sorted(B.encode_sorted(np.zeros(0, np.uint64)))) == 0


def test_an_id_that_many_rows_share_is_spread_over_all_blocks(spark, docs_of, monkeypatch):
    """A third of the rows has no id, a third one id: blocks stay even, results equal brute force."""
    rng = random.Random(12)
    words = ["w%d" % k for k in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = text(120)
    rows = [(None if k % 3 == 0 else 5 if k % 3 == 1 else k, text(80) + (" " + shared if k % 7 == 0 else "")) for k in range(240)]
    docs = docs_of(rows)
    sizes = {r.block: r.n for r in B.pack_blocks(docs, "doc_id", ["doc_id", "text"], 8, spread=("text",)).selectExpr(
        "block", "octet_length(payload) as n").groupBy("block").sum("n").toDF("block", "n").collect()}
    assert len(sizes) == 8 and max(sizes.values()) < 2 * min(sizes.values())
    small_blocks(monkeypatch, 20_000)
    got = Counter((r.doc_id, r.n_removed) for r in remove_repeats(docs).collect())
    raw = [(i, t.encode()) for i, t in rows]
    seen = Counter(b[k:k + 400] for _, b in raw for k in range(len(b) - 399))
    want = Counter()
    for i, b in raw:
        gone = set()
        for k in range(len(b) - 399):
            if seen[b[k:k + 400]] > 1:
                gone.update(range(k, k + 400))
        want[i, len(gone)] += 1
    assert got == want and sum(n for (_, k), n in want.items() if k) > 20
    first, cut = {}, Counter()
    split = [(i, t.split()) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - 12):
            g = tuple(w[k:k + 13])
            first[g] = min(first.get(g, B.NULL_ID), B.NULL_ID if i is None else i)
    for i, w in split:
        gone = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k:k + 13])] < (B.NULL_ID if i is None else i):
                gone.update(range(k, k + 13))
        cut[i, len(gone)] += 1
    assert Counter((r.doc_id, r.n_removed) for r in remove_repeated_windows(docs).collect()) == cut
