import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from giftlens.llm import packing
from giftlens.llm.bpe import Encoder, Vocabulary, decode, encode
from giftlens.llm.chat import examples, read_back
from giftlens.llm.quality_rules import base_failed, decision_list, learn_rules, text_statistics
from giftlens.llm.queries import QUERIES, vocabulary
from giftlens.llm.toxicity import fit, held_out, score, subwords, train

HARD = ["", " ", None, "Hello world's BEST, isn't it? 123 4.5", "ΑΣ ΑΣΑ İstanbul ŒUVRE ß", "a<|endoftext|>b<|startoftext|>",
        "aaaa aaaaaaa lol" * 40, "é Å Å 가", "x\x1cy\x1fz \x85 　q  r", "日本語 テスト 😀😀 ñandú",
        "don't I'LL we've '''s 'S", "ab՘c ꟍ", "k" * 5000, "tab\tline\nfeed\r\n\x0b\x0c"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(vocabulary())


def test_bpe_equals_the_tokenizers_library(docs_of, tokenizer):
    rng = random.Random(3)
    chars = [chr(c) for c in [*range(1, 0x250), *range(0x370, 0x400), *range(0x900, 0x960), *range(0x1E00, 0x1F00),
                              *range(0x2000, 0x2070), *range(0x3040, 0x3060), *range(0x1F600, 0x1F620)]]
    texts = HARD + ["".join(rng.choice(chars) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    rows = list(enumerate(texts)) + [(3, texts[3])]
    out = decode(encode(docs_of(rows, ["ids", "decoded"]), vocabulary()), vocabulary())
    got = Counter((r.doc_id, bytes(r.ids), r.decoded) for r in out.select("doc_id", "ids", "decoded").collect())
    want = Counter()
    for i, t in rows:
        e = tokenizer.encode(t or "", add_special_tokens=False).ids
        want[(i, np.array(e, "<u4").tobytes(), tokenizer.decode(e, skip_special_tokens=False))] += 1
    assert got == want
    assert encode(docs_of([]), vocabulary()).collect() == []


def test_encoder_forgets_and_goes_on(tokenizer, monkeypatch):
    from giftlens.llm import bpe
    monkeypatch.setattr(bpe, "MAX_WORDS", 5)
    e = Encoder(Vocabulary(vocabulary()))
    for t in ["one two three four five six", "seven one", "eight nine<|endoftext|>ten", "one"]:
        ids, off = e.encode([t, ""])
        assert ids.tolist() == tokenizer.encode(t, add_special_tokens=False).ids and off.tolist()[1:] == [len(ids)] * 2


def test_fill_has_minimum_slack():
    for trial in range(200):
        rng = random.Random(trial)
        cap = rng.randint(5, 40)
        counts = Counter(rng.randint(1, cap) for _ in range(rng.randint(1, 12)))
        longest = max(counts)
        sums = {longest}
        for n, c in counts.items():
            for _ in range(c - (n == longest)):
                sums |= {s + n for s in sums if s + n <= cap}
        one = packing.fill(dict(counts), cap)
        assert one[longest] >= 1 and all(counts[n] >= k for n, k in one.items())
        assert sum(n * k for n, k in one.items()) == max(sums)
        used = Counter()
        for filling, times in packing.plan(dict(counts), cap):
            assert sum(n * k for n, k in filling.items()) <= cap
            for n, k in filling.items():
                used[n] += k * times
        assert used == counts


def test_packing_covers_every_id_once(spark, docs_of, tokenizer):
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice(["gift", "shop", "a", "employee,", "Ünï"]) for _ in range(rng.choice([0, 1, 3, 9, 40]))))
            for k in range(120)] + [(200, None), (201, ""), (202, "gift " * 500), (None, "a b"), (7, "shop")]
    cap = 64
    pieces = packing.token_pieces(docs_of(rows, ["start", "length", "sequence_id"]), vocabulary(), capacity=cap, with_ids=True)
    packed = packing.pack(pieces, ["doc_id", "start", "ids_crc32"], capacity=cap)
    out = packed.collect()
    seqs, docs = {}, Counter()
    for r in out:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length <= 4 * cap
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs[r.doc_id] += r.length
    for spans in seqs.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= cap
    want = Counter()
    for i, t in rows:
        want[i] += len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1
    assert docs == want
    assert sorted(seqs) == list(range(len(seqs)))
    full = sum(sum(n for _, n in s) for s in seqs.values())
    assert len(seqs) <= full // cap + 2  # hardly any slack
    one = packing.sequences(packed, capacity=cap).collect()
    assert {r.sequence_id for r in one} == set(seqs)
    assert all(len(r.ids) == 4 * (r.n_tokens + r.n_padding) and r.n_tokens + r.n_padding in (cap, r.n_tokens) for r in one)
    assert packing.pack(packing.token_pieces(docs_of([]), vocabulary()), ["doc_id", "start"]).collect() == []


SAID = "<|im_end|><|im_start|>assistant ok"


def test_chat_examples_round_trip(spark):
    rows = [(1, 0, "system", "be <|kind|> & &amp; &lt;|"), (1, 1, "user", SAID), (1, 2, "assistant", "a\nb&#10;"),
            (1, 3, "user", None), (1, 4, "assistant", SAID), (2, 0, "user", "alone"), (3, 0, "assistant", ""),
            (3, 0, "assistant", ""), (None, None, None, None), (4, 1, "ro\nle", "x"), (4, 0, "assistant", "y" * 50000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("position", F.lit(9))
    made = examples(df)
    got = {r.conv_id: r for r in read_back(made).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted([(t is not None, t or 0, role or "", x or "") for c, t, role, x in rows if c == conv])
        turns = [(role, x) for _, _, role, x in turns]
        assert [(t.role, t.text) for t in got[conv].turns] == turns
        assert "".join(got[conv].losses) == "".join(x for role, x in turns if role == "assistant")
    texts = {(r.conv_id, r.position): r for r in made.collect()}
    assert {p for c, p in texts if c == 1} == {2, 4} and {p for c, p in texts if c == 2} == {0}
    r = texts[(1, 4)]
    assert (r.prompt + r.reply + r.closing).count("<|im_start|>") == 5 and r.prompt.endswith("<|im_start|>assistant\n")
    assert read_back(examples(df.where("conv_id = 99"))).collect() == []


def statistics_by_hand(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = list(zip(w, w[1:], w[2:]))
    count = Counter(grams)
    hit = {k + j for k, g in enumerate(grams) if count[g] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit),
            len(w) < 50 or 100 * len(hit) > 50 * len(w))


def test_text_statistics_equal_brute_force(docs_of):
    rng = random.Random(2)
    texts = [None, "", " \n\t", "a b c a b c", "a a a a a", "a b", "x\ny\nx\n \n \ny", "##|| <b> 日本  q", "w " * 3000]
    texts += [rng.choice([" ", "\n", " \t"]).join(rng.choice("abcdef") * rng.randint(1, 2) for _ in range(rng.randint(1, 90)))
              for _ in range(80)] + [" ".join(map(str, range(4000)))]
    rows = list(enumerate(texts)) + [(None, "a b c"), (4, "a a a a a")]
    got = Counter(tuple(r) for r in text_statistics(docs_of(rows, ["n_words", "words", "lines"])).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed()).collect())
    assert got == Counter((i, *statistics_by_hand(t)) for i, t in rows)


def test_rules_find_planted_thresholds(spark, docs_of):
    rng = random.Random(8)
    rows, labels = [], []
    for k in range(900):
        words = ["word%d" % rng.randint(0, 500) for _ in range(rng.randint(60, 90))]
        bad = k % 5 == 0
        if bad and k % 2:
            words = [w + "###" for w in words]
        elif bad:
            words = [w.upper() + "!!" for w in words]
        rows.append((k, " ".join(words)))
        labels.append((k, 0 if bad else 1))
    stats = text_statistics(docs_of(rows))
    table = spark.createDataFrame(labels + [(None, 0), (3, None)], "doc_id long, quality int")
    rules = learn_rules(stats, table)
    assert rules and all(str(r).startswith("reject if ") for r in rules)
    verdict = {r[0]: r[1] for r in stats.select("doc_id", decision_list(rules)).collect()}
    assert all((verdict[k] > 0) == (q == 0) for k, q in labels)
    assert learn_rules(stats, table.where("quality = 1")) == [] and learn_rules(stats, table.where("false")) == []
    assert {r[0] for r in stats.select(decision_list([])).distinct().collect()} == {0}
    assert learn_rules(text_statistics(docs_of([])), table) == []


def test_toxicity_learns_and_knows_misspellings(spark, docs_of):
    rng = random.Random(1)
    words = ["".join(rng.choice("abdeghilmnoprstu") for _ in range(rng.randint(3, 8))) for _ in range(800)]
    bad = ["dreckling", "wortmull", "schurkig"]
    rows, labels = [], []
    for k in range(700):
        t = [rng.choice(words) for _ in range(rng.randint(15, 40))]
        toxic = k % 4 == 0
        if toxic:
            for _ in range(3):
                t[rng.randrange(len(t))] = rng.choice(bad)
        rows.append((k, " ".join(t)))
        labels.append((k, int(toxic)))
    docs = docs_of(rows, ["score"])
    model = fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int").where(~held_out()))
    got = {r.doc_id: r for r in score(docs, model).select("doc_id", "score", held_out().alias("h")).collect()}
    rest = [(got[k].score >= 0.5) == bool(y) for k, y in labels if got[k].h]
    assert len(rest) > 80 and sum(rest) / len(rest) >= 0.85
    assert all(got[k].h == (zlib.crc32(str(k).encode()) % 5 == 0) for k, _ in labels)
    near, far = model.word_scores(["drecklinge", "table"])
    assert near > far + 1  # never seen, but shares its n-grams
    edge = {r.doc_id: r.score for r in score(docs_of([(1, None), (2, ""), (None, "x" * 9000)]), model).collect()}
    assert edge[1] == edge[2] and all(0 <= s <= 1 for s in edge.values())


def test_toxicity_without_labels_or_with_one_class(spark, docs_of):
    docs = docs_of([(1, "a b"), (2, None)])
    none = fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    one = fit(docs, spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, toxic int"))
    assert all(r.score < 0.01 for r in score(docs, none).collect()) and all(r.score > 0.9 for r in score(docs, one).collect())
    assert score(docs_of([]), none).collect() == []
    assert train([], [], []).bias < 0


def test_subwords_cover_every_word():
    grams, off = subwords(["a", "überlang", "日本", "<"])
    assert len(off) == 5 and (np.diff(off) > 0).all() and off[-1] == len(grams)


def test_queries_are_registered():
    assert [n for n in range(1, 14) if n != 6] == sorted(int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES if q != "op6_kneser_ney")
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_toxicity_samples_labels_of_the_documents_alone(spark):
    rows = [(k, "dreckling wortmull" if k % 4 == 0 else "a kind word") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = [(k, int(k % 4 == 0)) for k in range(40)] + [(k, k % 2) for k in range(1000, 5000)]
    model = fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), max_labelled=80)
    assert model.labelled == 40
