"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (with marks for its ends) and itself,
all hashed into one embedding table; a text is the average of its words. The
table and the softmax weights learn together, so a misspelt word that was never
seen still scores through the n-grams that it shares with known ones.

Training uses a bounded sample of labelled rows in one task. Scoring folds the
softmax into the table (each n-gram then has one number), so a text costs one
lookup per word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import mix
from .bpe import batches_of
from .checkpoints import written

#: Most labelled rows that the fit reads, half of each class (chosen by hash of the id).
MAX_LABELLED = 8000
BUCKETS = 1 << 17
DIM = 8
NGRAMS = (3, 4)
#: Words whose scores a task keeps, and bytes of text that it splits at a time.
MAX_WORDS = 300_000
PART_BYTES = 1 << 20


def split_words(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def subwords(words: list[str], buckets: int = BUCKETS, sizes=NGRAMS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every n-gram, offsets by word); each word has at least its whole form."""
    parts = [_subwords(words[lo:lo + 50_000], buckets, sizes) for lo in range(0, max(1, len(words)), 50_000)]
    counts = np.concatenate([np.diff(off) for _, off in parts])
    return np.concatenate([bucket for bucket, _ in parts]), np.concatenate([[0], np.cumsum(counts)])


def _subwords(words: list[str], buckets: int, sizes) -> tuple[np.ndarray, np.ndarray]:
    marked = ["<" + w + ">" for w in words]
    size = np.array([len(w) for w in marked], np.int64)
    ends = np.cumsum(size)
    chars = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word_of = np.repeat(np.arange(len(words)), size)
    grams, owners = [], []
    with np.errstate(over="ignore"):
        code = mix(chars, 11)
        for n in sizes:
            m = len(chars) - n + 1
            if m <= 0:
                continue
            h = np.full(m, n, np.uint64)
            for j in range(n):
                h = h * np.uint64(0x100000001B3 | 1 << 45) + code[j:j + m]
            inside = word_of[:m] == word_of[n - 1:]
            grams.append(mix(h[inside]))
            owners.append(word_of[:m][inside])
        if len(words):
            place = np.arange(len(chars), dtype=np.uint64) - np.repeat((ends - size).astype(np.uint64), size)
            whole = np.add.reduceat(mix(code + place * np.uint64(0x9E3779B97F4A7C15), 5), ends - size)
            grams.append(mix(whole, 1))
            owners.append(np.arange(len(words)))
    if not grams:
        return np.zeros(0, np.int32), np.zeros(len(words) + 1, np.int64)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    bucket = (np.concatenate(grams)[order] % np.uint64(buckets)).astype(np.int32)
    return bucket, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(words)))])


@dataclass
class ToxicityModel:
    """One number per bucket and a bias: the folded embedding table."""

    weights: np.ndarray
    bias: float
    labelled: int = 0

    def word_scores(self, words: list[str]) -> np.ndarray:
        bucket, off = subwords(words, len(self.weights))
        if not len(words):
            return np.zeros(0)
        return np.add.reduceat(self.weights[bucket], off[:-1]) / np.diff(off)


def train(texts: list[str], labels: list[int], weights: list[float], updates: int = 280, batch: int = 128,
          rate: float = 3.0, dim: int = DIM, buckets: int = BUCKETS, seed: int = 7) -> ToxicityModel:
    """Fits embeddings and softmax together by mini-batch Adagrad; ``weights`` restore the class shares.

    Small samples get smaller batches and more rounds, so that about ``updates`` steps are made in 6 to 40 rounds.
    """
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():  # nothing to tell apart: the one class, or not toxic
        sure = 20.0 if len(y) and y[0] else -20.0
        return ToxicityModel(np.zeros(buckets), sure, len(y))
    vocab: dict[str, int] = {}
    docs = [np.array([vocab.setdefault(w, len(vocab)) for w in split_words(t)], np.int32) for t in texts]
    bucket, off = subwords(list(vocab), buckets)
    n_words = len(vocab)
    del vocab
    per_word = np.diff(off)
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (buckets, dim))
    soft = np.stack([-np.ones(dim), np.ones(dim)]) / np.sqrt(dim)  # rows: clean, toxic
    bias = np.log(np.array([np.average(1 - y, weights=weights), np.average(y, weights=weights)]))
    g_table, g_soft, g_bias = np.full(buckets, 1e-8), np.full(dim, 1e-8), 1e-8
    share = np.array(weights) / np.mean(weights)
    seen, number, hit = np.zeros(n_words, bool), np.zeros(n_words, np.int32), np.zeros(buckets, bool)
    bags = [np.unique(d, return_counts=True) for d in docs]  # each text as distinct words with shares
    batch = max(16, min(batch, len(y) // 12))
    epochs = int(np.clip(np.ceil(updates * batch / len(y)), 6, 40))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
            every = np.concatenate([bags[r][0] for r in rows])
            seen[every] = True
            words = np.flatnonzero(seen)
            seen[words] = False
            number[words] = np.arange(len(words))
            at = number[every]
            counts = np.concatenate([bags[r][1] / max(1, len(docs[r])) for r in rows])
            own = np.repeat(np.arange(len(rows)), [len(bags[r][0]) for r in rows])
            size = per_word[words]
            pick = np.repeat(off[words] - np.cumsum(size) + size, size) + np.arange(size.sum())
            grams = bucket[pick]
            # With two classes only the difference of the softmax rows enters the loss and every
            # gradient of a text lies along it: averages run over one number per n-gram, not dim.
            along = soft[1] - soft[0]
            hit[grams] = True
            used = np.flatnonzero(hit)
            hit[used] = False
            along_gram = np.zeros(buckets)
            along_gram[used] = table[used] @ along
            along_word = np.add.reduceat(along_gram[grams], np.cumsum(size) - size) / size if len(words) else size
            z = np.bincount(own, counts * along_word[at], len(rows)) + bias[1] - bias[0]
            d = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y[rows]) * share[rows] / len(rows)
            word_back = np.bincount(at, counts * d[own], len(words)) / size
            gram_back = np.bincount(grams, np.repeat(word_back, size), buckets)[used]
            d_soft = gram_back @ table[used]
            g_table[used] += gram_back ** 2 * (along @ along)
            table[used] -= step * (gram_back / np.sqrt(g_table[used]))[:, None] * along
            g_soft += d_soft ** 2
            soft += step * d_soft / np.sqrt(g_soft) * np.array([[1.0], [-1.0]])
            g_bias += d.sum() ** 2
            bias = bias + 0.1 * step * d.sum() / np.sqrt(g_bias) * np.array([1.0, -1.0])
    return ToxicityModel(table @ (soft[1] - soft[0]), float(bias[1] - bias[0]), len(y))


def calibrated(texts: list[str], labels: list[int], weights: list[float], least: int = 400, **options) -> ToxicityModel:
    """Trains on four fifths of the rows and moves the bias to the cut that has the best F1 on the rest.

    With fewer than ``least`` rows all of them train and the bias stays.
    """
    if len(texts) < least:
        return train(texts, labels, weights, **options)
    part = np.random.default_rng(13).permutation(len(texts)) % 5 == 0
    y, w = np.array(labels), np.array(weights, np.float64)
    model = train([t for t, p in zip(texts, part) if not p], y[~part].tolist(), w[~part].tolist(), **options)
    if not y[part].any():
        return model
    vocab: dict[str, int] = {}
    docs = [[vocab.setdefault(x, len(vocab)) for x in split_words(t)] for t, p in zip(texts, part) if p]
    value = model.word_scores(list(vocab))
    z = np.array([value[d].mean() if d else 0.0 for d in docs]) + model.bias
    order = np.argsort(-z)
    good = np.cumsum((w * y)[part][order])
    f1 = 2 * good / (np.cumsum(w[part][order]) + good[-1])
    k = int(np.argmax(f1))
    after = z[order[min(k + 1, len(z) - 1)]]
    return ToxicityModel(model.weights, model.bias - float((z[order[k]] + after) / 2), len(texts))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
        max_labelled: int = MAX_LABELLED, **options) -> ToxicityModel:
    """Trains on at most ``max_labelled`` labelled rows, half of each class if there are as many.

    Classes keep their shares of all labelled rows through weights. Rows with a
    null id or label are left out, as are labels of ids that ``docs`` does not
    have; a null text is empty; of an id with several labels each counts. With no
    labels, or one class, the model is that constant.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
             .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)))
    known = written(known.join(texts.select("doc_id"), "doc_id", "left_semi"))
    total = {int(r[0]): int(r[1]) for r in known.groupBy("label").count().collect()}
    half = max_labelled // 2
    take = {k: min(half, n) for k, n in total.items()}
    order = [F.xxhash64("doc_id"), "doc_id"]
    parts = [known.where(F.col("label") == k).orderBy(*order).limit(n) for k, n in take.items() if n]
    if not parts:
        return ToxicityModel(np.zeros(BUCKETS), -20.0)
    chosen = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")  # <= max_labelled ids
    share = {k: total[k] / take[k] for k in take if take[k]}

    def learn(stream):
        table = pa.Table.from_batches(list(stream), sample)
        table = table.sort_by([("doc_id", "ascending"), ("label", "ascending"), ("text", "ascending")])
        label = table.column("label").to_pylist()
        model = calibrated(table.column("text").to_pylist(), label, [share[k] for k in label], **options)
        yield pa.RecordBatch.from_pydict({"weights": [model.weights.astype("<f8").tobytes()], "bias": [model.bias],
                                          "labelled": [model.labelled]})

    sample = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("text", pa.string())])
    # the bounded sample meets in one task, away from the driver; only the folded table comes back
    one = rows.repartition(1).mapInArrow(learn, "weights binary, bias double, labelled long").first()
    if one is None:  # no document has one of the labels
        return ToxicityModel(np.zeros(BUCKETS), -20.0)
    return ToxicityModel(np.frombuffer(bytes(one["weights"]), "<f8"), one["bias"], one["labelled"])


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", out_col: str = "score",
          drop_text: bool = False) -> DataFrame:
    """Every row with its toxicity score from 0 to 1 in ``out_col``; a text without words has the bias alone."""
    docs = docs.drop(out_col)
    kept = [c for c in docs.columns if not (drop_text and c == text_col)]
    schema = docs.select(*kept).withColumn(out_col, F.lit(0.0)).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of buckets

    def run(stream):
        known: dict[str, int] = {}
        values = np.zeros(0)
        for part in batches_of(stream, PART_BYTES):
            if len(known) > MAX_WORDS:
                known, values = {}, np.zeros(0)
            split = [split_words(t) for t in part.column(text_col).to_pylist()]
            new = [w for w in set().union(*split) if w not in known] if split else []
            values = np.concatenate([values, shared.value.word_scores(new)])
            known.update(zip(new, range(len(known), len(known) + len(new))))
            n = np.array([len(s) for s in split], np.int64)
            look = known.__getitem__
            codes = np.fromiter((c for s in split for c in map(look, s)), np.int64, int(n.sum()))
            own = np.repeat(np.arange(len(n)), n)
            mean = np.bincount(own, values[codes], len(n)) / np.maximum(n, 1)
            z = np.clip(mean + shared.value.bias, -500, 500)
            yield from (part.select(kept).append_column(out_col, pa.array(1 / (1 + np.exp(-z)))).to_batches())

    return docs.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from the fit: crc32 of the id's text is a multiple of 5 (a null id is not held out)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
