import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from giftlens.llm import queries

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, request):
    """Documents with junk, toxic texts, copies, passages, nulls and repeated rows, and their labels."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abdeghilmnoprstu") for _ in range(rng.randint(2, 7))) for _ in range(900)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, rows, labels = text(90), [], []
    for k in range(520):
        t, quality, toxic = text(rng.randint(70, 110)), 1, 0
        if k % 6 == 1:
            t, quality = " ".join(w + "###" for w in t.split()), 0
        elif k % 6 == 2:
            w = t.split()
            for j in range(0, len(w), 9):
                w[j] = rng.choice(["dreckling", "wortmull"])
            t, toxic = " ".join(w), 1
        elif k in (300, 301):
            t = text(60) + " " + passage + " " + text(30)
        rows.append((k, t, "en", "s", len(t)))
        labels.append((k, quality, toxic))
    rows += [(600, rows[0][1], "en", "s", 1), (601, rows[3][1] + " more words", "en", None, None), (700, None, None, None, None),
             (701, "", "en", "s", 0), (702, "short text", "en", "s", 10)]
    top = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn(
        "block", F.lit("clash")).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return str(top), rows, labels, passage


def test_stages_take_effect(spark, folder):
    top, rows, labels, passage = folder
    docs, seen = queries.table(spark, top, "documents"), {}
    for name, stage in P.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, top).collect(), "doc_id long, text string, lang string, source string, n_chars long")
        assert docs.columns == P.COLUMNS
        seen[name] = {r.doc_id: r for r in docs.collect()}
    bad = {k for k, q, _ in labels if q == 0}
    toxic = {k for k, _, t in labels if t == 1}
    clean = {k for k, q, t in labels if q and not t}
    assert not bad & set(seen["quality_rules"]) and clean <= set(seen["quality_rules"])
    assert not {700, 701, 702} & set(seen["quality_rules"])
    assert len(toxic & set(seen["toxicity"])) <= 0.1 * len(toxic) and len(clean - set(seen["toxicity"])) <= 0.03 * len(clean)
    assert 600 not in seen["near_dedup"] and 601 not in seen["near_dedup"] and {0, 3} & set(seen["near_dedup"]) == {0, 3} & set(seen["toxicity"])
    if {300, 301} <= set(seen["near_dedup"]):
        assert passage not in seen["suffix_dedup"][300].text and passage not in seen["suffix_dedup"][301].text
    assert set(seen["suffix_dedup"]) == set(seen["near_dedup"])
    assert all(r.n_chars == len(r.text) for r in seen["suffix_dedup"].values())
    last = P.STAGES[-1][1](spark, docs, top).collect()
    assert {r.doc_id for r in last} == {k for k, r in seen["suffix_dedup"].items() if r.text}


def test_cut_characters_are_dropped(spark, docs_of, monkeypatch):
    monkeypatch.setattr(P, "PASSAGE_BYTES", 400)
    a, b = "é" + "x" * 450, "è" + "x" * 450  # é and è share no first byte pair, but their last bytes differ
    c, d = "日" + "q" * 399, "旦" + "q" * 399 + "z"
    out = {r.doc_id: r for r in P.suffix_dedup(spark, docs_of([(1, a), (2, b), (3, c), (4, d), (5, None)]), "").collect()}
    assert out[1].text == "é" and out[2].text == "è" and out[5].text == ""
    assert out[3].text == c and all(r.n_chars == len(r.text) for r in out.values())


def test_passages_of_over_fifty_words_are_cut(spark, docs_of):
    rng = random.Random(6)
    text = lambda n: " ".join("".join(rng.choice("abdeghilmnoprstu") for _ in range(4)) for _ in range(n))
    passage, shorter = text(51), text(40)
    rows = [(1, text(60) + " " + passage + " " + text(9)), (2, passage), (3, text(80)), (4, text(20) + " " + shorter), (5, shorter)]
    out = {r.doc_id: r.text for r in P.suffix_dedup(spark, docs_of(rows), "").collect()}
    assert passage not in out[1] and passage not in out[2] and len(out[1]) >= len(rows[0][1]) - len(passage) - 2
    assert [out[k] for k in (3, 4, 5)] == [t for k, t in rows if k > 2]


def test_run_on_small_tables_and_empty_input(spark):
    rows = P.run(spark, SMALL).collect()
    assert rows and {"doc_id", "sequence_id", "offset"} <= set(rows[0].asDict())
    docs = queries.table(spark, SMALL, "documents").where("false")
    for _, stage in P.STAGES:
        assert stage(spark, docs, SMALL).collect() == []


def test_repeated_rows_are_packed_once(spark, tmp_path):
    rng = random.Random(8)
    text = lambda: " ".join("".join(rng.choice("abdeghilmnoprstu") for _ in range(6)) for _ in range(90))
    a, b, c, d = (text() for _ in range(4))  # each has more than 400 bytes
    rows = [(1, a), (1, a), (2, b), (2, c), (None, d), (None, d), (3, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in P.STAGES[2:]:
        docs = stage(spark, docs, str(tmp_path))
        if name == "near_dedup":
            assert sorted((r.doc_id or 0, r.text) for r in docs.collect()) == sorted([(1, a), (2, b), (2, c), (0, d)])
    assert sorted(r.doc_id or 0 for r in docs.collect()) == [0, 1, 2, 2] and docs.where("length < 50").count() == 0


def test_quality_judges_each_row_by_its_own_text(spark, folder):
    top, rows, labels, _ = folder
    clean = [rows[k][1] for k in (0, 3, 4, 5, 9)]
    given = [(None, clean[0]), (None, clean[1]), (None, "short"), (800, clean[2]), (800, "short"), (801, clean[3]), (801, None),
             (802, clean[4])]
    docs = queries.table(spark, top, "documents").select(*P.COLUMNS).unionByName(spark.createDataFrame(
        [(i, t, "en", "s", 1) for i, t in given], "doc_id long, text string, lang string, source string, n_chars long"))
    out = P.quality(spark, docs, top).where("doc_id IS NULL OR doc_id >= 800").collect()
    assert sorted((r.doc_id or 0, r.text) for r in out) == sorted((i or 0, t) for i, t in given if t in clean)


def test_documents_without_text_left_are_packed(spark, docs_of):
    rng = random.Random(9)
    passage = "".join(rng.choice("abdeghilmnoprstu ") for _ in range(500))
    docs = P.suffix_dedup(spark, docs_of([(1, passage), (2, "before " + passage), (3, "a text of its own"), (4, None)]), "")
    last = P.packing(spark, docs, "").collect()
    assert {r.doc_id for r in last} == {1, 2, 3, 4} and {r.doc_id for r in last if r.length == 1} == {1, 4}
