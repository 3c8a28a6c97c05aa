import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from giftlens.llm import source_divergence as D
from giftlens.llm import twins
from giftlens.llm.packed_terms import heads, long_numbers, pack, radix_order, runs_of, unpack
from giftlens.llm.queries import URL_RULES
from giftlens.llm.url_filters import alias_links, judged

DOC = "doc_id long, text string, lang string, source string, clash string, n long, terms long, rank int"
LONG = ["ab" * 8, "ab" * 8 + "c", "xy" * 40, "q" * 300, "q" * 300 + "r", "日本語の長い言葉です", "éa" * 9]


def divergence_rows(seed, n=90):
    rng = random.Random(seed)
    vocab = [rng.choice("abAB") + rng.choice(["", "é", "x", "Öl", "abcdefgh", "abcdefghi"]) + rng.choice("cdeß") for _ in range(60)] + LONG
    rows = []
    for i in range(n):
        t = "".join(rng.choice(vocab) + rng.choice([" ", ", ", "1", "_", "\n", "\x7f"]) for _ in range(rng.randint(0, 60)))
        rows.append((rng.choice([i, None, 3]), t, rng.choice(["en", "en", "de", None]), rng.choice(["a", "b", "é", "Z", None])))
    rows += [(1, None, "fr", "a"), (2, "", "fr", "b"), (4, "solo " * 500, "fr", "c"), (5, rows[0][1], "en", "a"), (5, rows[0][1], "en", "a"), (6, "x " * 30000, "en", "a")]
    rng.shuffle(rows)
    return rows


def divergence_by_hand(rows, min_docs=3, top=200):
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        count[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, k in docs[lang].items() if k >= min_docs]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[u] for u in kept) + len(kept)) for t in kept}
        p = {s: share(count[lang, s]) for s in sources}
        q = share(sum((count[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            parts = {"pair": [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources - {s}],
                     "term": [(f(p[s][t], q[t]), t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]}
            for part, found in parts.items():
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found) if part == "pair" or k < top}
    return out


@pytest.mark.parametrize("seed, top", [(1, 200), (2, 3)])
def test_divergence_equals_brute_force(spark, seed, top):
    rows = divergence_rows(seed)
    docs = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], DOC).repartition(3)
    got = [tuple(r) for r in D.divergence(docs, top=top).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got))
    assert set(got) == divergence_by_hand(rows, top=top)
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    if top == 200:
        assert set(con.sql(twins.OP11_SQL).fetchall()) == set(got)


def test_divergence_of_nothing(spark):
    assert D.divergence(spark.createDataFrame([], DOC)).count() == 0
    empty = spark.createDataFrame([(1, None, None, "a", "x", 1, 2, 3), (2, "", None, "b", "x", 1, 2, 3)], DOC)
    assert {tuple(r) for r in D.divergence(empty).collect()} == {("", "a", "pair", "b", 0, 1), ("", "b", "pair", "a", 0, 1)}


def test_shares_are_exact_at_any_size(spark):
    rng = random.Random(5)
    pairs = [(c, rng.randint(c + 1, 9 * 10**15)) for c in (0, 1, 999, 10**12, 8 * 10**15)] + [(k, k + 1) for k in range(5)]
    want = [1 + 10**9 * (c + 1) // d for c, d in pairs]
    count, total = (np.array(x, np.int64) for x in zip(*pairs))
    assert D._shares(count, total).tolist() == want
    df = spark.createDataFrame(pairs, "c long, d long")
    assert [r[0] for r in df.select(D._share(F.col("c"), F.col("d"))).collect()] == want


def test_counts_in_parts_equal_counts_at_once():
    import pyarrow as pa
    from giftlens.llm.blocks import text_bytes
    texts = [t or "" for _, t, _, _ in divergence_rows(3, 40)]
    whole, parts = D._Counts(1), D._Counts(1)
    whole.add(*text_bytes(pa.array(texts)), whole.numbers(["en"] * len(texts), ["s"] * len(texts)))
    for k in range(0, len(texts), 7):
        own = texts[k:k + 7]
        parts.add(*text_bytes(pa.array(own)), parts.numbers(["en"] * len(own), ["s"] * len(own)))
    read = lambda held: [pa.ipc.open_stream(p).read_all().to_pylist() for _, p in held.rows_by_bucket()]
    assert read(whole) == read(parts)


def test_packed_terms_sort_as_bytes():
    rng = random.Random(9)
    words = [bytes(rng.choice(b"abz\xff") for _ in range(rng.randint(1, 16))) for _ in range(500)]
    raw = np.frombuffer(b" ".join(words), np.uint8)
    starts, size, doc = runs_of(raw != 0x20, np.array([0, len(raw)]))
    assert [bytes(raw[s:s + n]) for s, n in zip(starts, size)] == words
    first, second = pack(raw, starts, size)
    order = radix_order(first, second)
    assert [words[i] for i in order] == sorted(words)
    flat, n = unpack(first[order], second[order])
    assert flat.tobytes() == b"".join(sorted(words)) and n.tolist() == [len(w) for w in sorted(words)]
    assert heads(first[order], second[order]).sum() == len(set(words))
    terms, place = long_numbers([w * 40 for w in words])
    assert [terms[i] for i in place] == [w * 40 for w in words] and len(terms) == len({w * 40 for w in words})


PAGE = "page_id long, url string, html string, node string, host string, path string, verdict string"
CANON = '<head><link href="{}" rel="canonical"></head>'


def judged_by_hand(pages, rules, links):
    """links: (url, url) of whole urls without fragments."""
    def split(url):
        m = re.match(r"(?s)(.*?)://([^/?#]*)([^?#]*)", url or "")
        return (re.sub("[A-Z]", lambda c: c[0].lower(), m[2]), m[3]) if m else ("", "")

    def rule(url):
        h, p = split(url)
        fit = [(-len(rh + rp), v != "allow", rh + rp, v) for rh, rp, v in rules if (h == rh or h.endswith("." + rh)) and p.startswith(rp)]
        return min(fit)[2:] if fit else (None, None)

    near = defaultdict(set)
    for a, b in links:
        near[a].add(b), near[b].add(a)
    blocked = {u for u in near if rule(u)[1] == "block"}
    todo = list(blocked)
    while todo:
        for v in near[todo.pop()] - blocked:
            blocked.add(v), todo.append(v)
    return Counter((i, *split(u), rule(u)[0], rule(u)[1] or ("block" if (u or "").split("#")[0] in blocked else "allow")) for i, u, _ in pages)


def test_blocks_reach_aliases_and_allows_win(spark):
    a, b, c = "https://a.example.org/x", "https://b.example.org/y?k=1", "https://c.example.org/z"
    pages = [(1, "http://bad.net/spam", ""), (2, a, CANON.format("http://bad.net/spam")), (3, b, CANON.format(a)),
             (4, c + "#part", '<meta http-equiv="refresh" content="0; URL=' + "https://b.example.org/y?k=1" + '">'),
             (5, "http://www.example.net/en/1", CANON.format("http://bad.net/spam")), (6, "http://www.example.net/de/1", None),
             (7, "https://d.example.org/p", CANON.format("https://e.example.org/q")), (8, "HTTP://Good.Example.org/fr/1", "<link rel=stylesheet href=x.css>"),
             (9, None, "<p>"), (10, "no address", CANON.format(a)), (None, c, None), (None, c, None), (11, "https://f.example.org/dir/page", CANON.format("other")),
             (12, "https://f.example.org/dir/other", ""), (13, "https://net", ""), (14, "https://net/", ""), (15, "https://x.com:80?a=/de/", ""),
             (16, "https://f.example.org/q", "<LINK REL='Canonical' HREF='https://quoted.net/a?b=1&amp;c=2'>"), (17, "https://g.org/", CANON.format(""))]
    links = [(a, "http://bad.net/spam"), (b, a), (c, b), ("http://www.example.net/en/1", "http://bad.net/spam"),
             ("https://d.example.org/p", "https://e.example.org/q"), ("https://f.example.org/dir/page", "https://f.example.org/dir/other"),
             ("https://f.example.org/q", "https://quoted.net/a?b=1&c=2")]
    df = spark.createDataFrame([(*p, "x", "x", "x", "x") for p in pages], PAGE)
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    assert {tuple(r) for r in alias_links(df).collect()} == set(links)
    got = Counter(tuple(r) for r in judged(df, rules).collect())
    assert got == judged_by_hand(pages, URL_RULES, links)
    verdict = {k[0]: k[-1] for k in got}
    assert [verdict[k] for k in (1, 2, 3, 4, 5, 7, 11, 16)] == ["block"] * 4 + ["allow"] * 3 + ["block"]
    con = duckdb.connect()
    con.sql("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", pages)
    assert Counter(con.sql(twins.OP13_SQL).fetchall()) == got
    known = spark.createDataFrame([("https://d.example.org/p#x", "https://far.net/"), (None, "x://y"), (a, a)], "a string, b string")
    more = {r.page_id: r.verdict for r in judged(df, rules, known).collect()}
    assert more[7] == "block" and more[12] == "allow"
    assert judged(df.limit(0), rules).count() == 0
    assert {r.rule for r in judged(df, rules.limit(0)).collect()} == {None}


def test_random_link_graphs(spark):
    rng = random.Random(4)
    urls = [f"http://{rng.choice('abc')}.{rng.choice(['example.org', 'example.com', 'net', 'example.net'])}/{rng.choice(['en', 'de', 'fr'])}/{k}" for k in range(80)]
    links = [(u, rng.choice(urls)) for u in rng.sample(urls, 50)]
    links = [(u, v) for u, v in links if u != v]
    html = defaultdict(str)
    for u, v in links:
        html[u] += CANON.format(v)
    pages = [(k, u, html[u]) for k, u in enumerate(urls)]
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    got = judged(spark.createDataFrame(pages, "page_id long, url string, html string"), rules)
    assert Counter(tuple(r) for r in got.collect()) == judged_by_hand(pages, URL_RULES, links)
