"""Spelling variant grouping: words one code point apart, and the commoner form that each belongs to.

Two words at one error share a half exactly. A word x that is as long as its partner or
one longer asks for words that match its first (or last) half, up to the delimiter, and
differ by one code point in the other half: a search scheme on an FM-index of the delimited
vocabulary, read in both directions (``fm_index``). A vocabulary of any size is dealt by these
halves: words go to the shards of the halves that they can be found by, as their own length
or as one shorter, and each shard has an index of its own, so that nothing but a shard is ever
held whole. A half that more than ``hot`` words share is halved again around the error (prefix
and suffix exact, the error between), down to a single place, where a group has at most one
word per letter and one more.

Defined cases (``words_of``): a null text has no words; a null id counts as '' in the hash; every
row is a document of its own; other columns are not read. (``variants``): equal words must be
given once; an empty vocabulary gives no rows; a word without near words has 0 of them and no form.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import LOWER, one_array, slices, text_bytes
from .checkpoints import stored, written
from .fm_index import Vocabulary
from .packed_terms import SHORT, heads, long_numbers, pack, radix_order, runs_of, strings, totals, unpack

LETTERS = np.zeros(256, bool)
LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = True
PART_BYTES = 4 << 20
HELD_ROWS = 1_000_000
SHARD_CHARS = 500_000
HOT = 100_000
NOISE = 97
COUNTED = "word string, n bigint"
LINKS = "word string, links bigint, near_n bigint, near string"
PAIRS = "word string, near string, near_n bigint"


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, np.uint32(0xEDB88320) ^ (c >> np.uint32(1)), c >> np.uint32(1))
    return c


_CRC = _crc_table()
_TABLED = 64


def crc_after(state: np.ndarray, raw: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """crc32 of what ``state`` is the crc32 of, with the bytes of each run behind it."""
    order = np.argsort(-size, kind="stable")
    out = state[order].astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    at, left = starts[order], size[order]
    for k in range(min(_TABLED, int(left[0]) if len(left) else 0)):
        live = int(np.searchsorted(-left, -k, "left"))  # runs longer than k
        s = out[:live]
        out[:live] = _CRC[(s ^ raw[at[:live] + k]) & np.uint32(0xFF)] ^ (s >> np.uint32(8))
    out ^= np.uint32(0xFFFFFFFF)
    for i in range(int(np.searchsorted(-left, -_TABLED, "left"))):
        out[i] = zlib.crc32(raw[at[i] + _TABLED:at[i] + left[i]].tobytes(), int(out[i]))
    back = np.empty_like(out)
    back[order] = out
    return back


def words_in(raw: np.ndarray, offsets: np.ndarray, ids: list, least: int):
    """(bytes, first byte, bytes per word) of a part's words, one byte (its Latin-1 number) per code point.

    Words are runs of ASCII letters and U+00C0 to U+00FF, A-Z lower-cased; a run whose hash with
    the document id is a multiple of 97 loses one code point.
    """
    lead = raw == 0xC3
    behind = np.concatenate([[False], lead[:-1]]) if len(raw) else lead
    starts, size, doc = runs_of(LETTERS[raw] | lead | behind, offsets)
    low = LOWER[raw]
    leads = np.concatenate([[0], np.cumsum(lead)])
    chars = size - (leads[starts + size] - leads[starts])
    long = chars >= least
    starts, size, doc, chars = starts[long], size[long], doc[long], chars[long]
    seeds = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    h = crc_after(seeds[doc], low, starts, size)
    low[behind] += 0x40
    single, at = low[~lead], starts - leads[starts]
    hit = np.flatnonzero(h % NOISE == 0)
    stay = np.ones(len(single) + 1, bool)
    stay[at[hit] + h[hit].astype(np.int64) % chars[hit]] = False
    gone = np.concatenate([[0], np.cumsum(~stay)])
    at -= gone[at]
    chars = chars.copy()
    chars[hit] -= 1
    fit = chars >= least
    return single[stay[:-1]], at[fit], chars[fit]


class _Words:
    """Counts of words in one task."""

    def __init__(self):
        self.short, self.long, self.rows = [], [], 0

    def add(self, raw, starts, size):
        one = np.ones(len(starts), np.int64)
        short = size <= SHORT
        at = np.flatnonzero(short)
        self.short.append(self._sum(*pack(raw, starts[at], size[at]), one[at]))
        at, data = np.flatnonzero(~short), raw.tobytes()
        if len(at):
            self.long.append(self._sum_long([data[s:s + n] for s, n in zip(starts[at].tolist(), size[at].tolist())], one[at]))
        self.rows += len(self.short[-1][0]) + (len(self.long[-1][0]) if len(at) else 0)

    @staticmethod
    def _sum(first, second, n):
        order = radix_order(first, second)
        first, second = first[order], second[order]
        head = heads(first, second)
        return first[head], second[head], totals(n[order], head)

    @staticmethod
    def _sum_long(terms, n):
        terms, place = long_numbers(terms)
        return terms, np.bincount(place, n, len(terms)).astype(np.int64)

    def compact(self):
        if len(self.short) > 1:
            self.short = [self._sum(*(np.concatenate(x) for x in zip(*self.short)))]
        if len(self.long) > 1:
            self.long = [self._sum_long([t for x in self.long for t in x[0]], np.concatenate([x[1] for x in self.long]))]
        self.rows = sum(len(x[0]) for x in self.short + self.long)

    def batches(self):
        self.compact()
        for first, second, n in self.short:
            for k in range(0, len(n), 100_000):
                raw, size = unpack(first[k:k + 100_000], second[k:k + 100_000])
                text = raw.tobytes().decode("latin-1").encode()
                wide = np.concatenate([[0], np.cumsum(raw >= 0x80)])
                ends = np.cumsum(size)
                words = strings(np.frombuffer(text, np.uint8), size + wide[ends] - wide[ends - size])
                yield pa.RecordBatch.from_arrays([words.cast(pa.string()), pa.array(n[k:k + 100_000])], names=["word", "n"])
        for terms, n in self.long:
            yield pa.RecordBatch.from_arrays([pa.array([t.decode("latin-1") for t in terms], pa.string()), pa.array(n)], names=["word", "n"])
        self.__init__()


def words_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 5, least_count: int = 3) -> DataFrame:
    """(word, n): the words of all texts with at least ``least_chars`` code points and ``least_count`` occurrences."""

    def count(batches):
        held = _Words()
        for batch in batches:
            for part, _ in slices(pa.Table.from_batches([batch]), PART_BYTES):
                raw, offsets = text_bytes(part.column("text"))
                held.add(*words_in(raw, offsets, part.column("doc_id").to_pylist(), least_chars))
                if held.rows > HELD_ROWS:
                    held.compact()
                    if held.rows > HELD_ROWS // 2:
                        yield from held.batches()
        yield from held.batches()

    counted = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(count, COUNTED)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _routed(words: DataFrame, hot: int) -> DataFrame:
    """(word, n, p, s, asks, key): each word under the halves that it asks by, and those that it can be found by as a
    partner one shorter. ``p`` and ``s`` code points at its ends are exact; a key never has more than ``hot`` words,
    unless a single place is open."""
    size = F.length("word")
    cut = F.explode(F.array(*[F.struct(length.alias("len"), asks.alias("asks"), p.alias("p"), s.alias("s"))
                              for length, asks in ((size, F.lit(True)), (size + 1, F.lit(False)))
                              for p, s in ((F.floor(length / 2).cast("int"), F.lit(0)), (F.lit(0), (length - F.floor(length / 2)).cast("int")))]))
    rows = _keyed(words.select("word", "n", cut.alias("c")).select("word", "n", "c.*"))
    done = []
    while True:
        crowded = written(rows.where("len - p - s > 1").groupBy("key").count().where(F.col("count") > hot).select("key"))
        if crowded.isEmpty():
            break
        done.append(rows.join(crowded, "key", "left_anti"))
        middle = F.floor((F.col("len") - F.col("p") - F.col("s")) / 2).cast("int")
        halves = F.explode(F.array(F.struct((F.col("p") + middle).alias("p"), F.col("s").alias("s")),
                                   F.struct(F.col("p").alias("p"), (F.col("len") - F.col("p") - middle).alias("s"))))
        rows = _keyed(rows.join(crowded, "key", "left_semi").select("word", "n", "len", "asks", halves.alias("c"))
                      .select("word", "n", "len", "asks", "c.*"))
    for part in done:
        rows = rows.unionByName(part)
    return rows


def _keyed(rows: DataFrame) -> DataFrame:
    fits = (F.col("len") > F.col("p") + F.col("s")) & (F.col("p") + F.col("s") <= F.length("word"))
    key = F.xxhash64("len", "p", "s", F.substring("word", F.lit(1), F.col("p")),
                     F.substring("word", F.length("word") - F.col("s") + 1, F.col("s")))
    return rows.where(fits).withColumn("key", key)


def _found(words: DataFrame, search, schema: str, hot: int, shard_chars: int) -> DataFrame:
    chars = words.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    shards = max(1, -(-4 * int(chars) // shard_chars))
    routed = _routed(words, hot).select(F.pmod("key", F.lit(shards)).cast("int").alias("shard"), "word", "n", "p", "s", "asks")
    return routed.groupBy("shard").applyInArrow(search, schema)


def _links(rows: pa.Table):
    """(words, their counts, asking word, near word, deleted) of one shard."""
    code = one_array(rows.column("word")).dictionary_encode()
    order = pa.compute.sort_indices(code.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    words = code.dictionary.take(pa.array(order))
    word = place[code.indices.to_numpy()]
    n = np.zeros(len(words), np.int64)
    n[word] = rows.column("n").to_numpy()
    asks = rows.column("asks").to_numpy()
    at = np.flatnonzero(asks)
    p, s = (rows.column(c).to_numpy().astype(np.int64)[at] for c in ("p", "s"))
    q, near, deleted = Vocabulary(words.to_pylist()).near(word[at], p, s)
    a = word[at][q]
    # a deletion is found from the longer word alone, so it counts for both
    return words, n, np.concatenate([a, near[deleted]]), np.concatenate([near, a[deleted]])


def near_pairs(words: DataFrame, hot: int = HOT, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(word, near, near_n): every ordered pair of words that differ by one inserted, deleted or replaced code point, once."""

    def search(rows):
        names, n, a, b = _links(rows)
        return pa.table([names.take(pa.array(a)), names.take(pa.array(b)), pa.array(n[b])], names=["word", "near", "near_n"])

    return _found(words, search, PAIRS, hot, shard_chars)


def variants(words: DataFrame, hot: int = HOT, shard_chars: int = SHARD_CHARS, times: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n): of each word its near words' number, its form (the near word of largest n,
    ties to the first in code point order, if that n is at least ``times`` its own) and the end of the chain of forms."""

    def search(rows):
        names, n, a, b = _links(rows)
        order = np.lexsort((b, -n[b], a))
        a, b = a[order], b[order]
        head = heads(a)
        return pa.table([names.take(pa.array(a[head])), pa.array(totals(np.ones(len(a), np.int64), head)), pa.array(n[b[head]]),
                         names.take(pa.array(b[head]))], names=["word", "links", "near_n", "near"])

    words = stored(words.select("word", "n"))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    found = _found(words, search, LINKS, hot, shard_chars).groupBy("word").agg(F.sum("links").alias("n_near"), best)
    enough = -F.col("best.less") >= times * F.col("n")
    forms = stored(words.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.near")).alias("form"),
        F.when(enough, -F.col("best.less")).alias("form_n")))
    roots = _roots(forms.where("form is not null").select("word", F.col("form").alias("root")))
    return forms.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(step: DataFrame) -> DataFrame:
    """The ends of chains (word, root): every round doubles the steps taken; counts at least double along a chain, so few do."""
    step = stored(step)
    while True:
        ahead = step.select(F.col("word").alias("root"), F.col("root").alias("far"))
        taken = stored(step.join(ahead, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")))
        step = taken.select("word", "root")
        if taken.where("moved").isEmpty():
            return step
