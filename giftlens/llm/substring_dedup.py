"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

Three exchanges, all of hashes, around one exchange of texts (``blocks``):

1. every block sends the 48-bit prefixes of its distinct window hashes; a hash
   range answers with those that at least two blocks sent;
2. for these, blocks send the full hash (64 + 32 bits) with their smallest
   document id; the range answers to each block with the hashes that a smaller
   id of another block holds;
3. blocks join the answers with their own repeats, merge the repeated windows
   into maximal intervals and cut them out.

The 48 bits only select candidates: a chance agreement there costs a few bytes,
never a result.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B

WINDOW = 13
_PREFIX_BITS = 48
_ROUTE2 = "bucket int, block int, hash binary, check binary, first binary"
_ROUTE2_ARROW = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("hash", pa.binary()),
                           ("check", pa.binary()), ("first", pa.binary())])
_REPLY2 = "block int, hash binary, check binary"
_REPLY2_ARROW = pa.schema([("block", pa.int32()), ("hash", pa.binary()), ("check", pa.binary())])


def _windows(chunk: pa.Table, size: int):
    """hash, check hash, first word and document row of each window; the word counts by document."""
    raw, off = B.text_bytes(chunk.column("text"))
    words, doc = B.word_hashes(raw, off)
    h, at = B.window_hashes(words, doc, size, 0xD6E8FEB86659FD93)
    return words, doc, h, at


def _check(words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A second hash of the windows at ``at``, by another base over re-mixed words."""
    out = np.zeros(len(at), np.uint64)
    other = B.mix(words, 7)
    with np.errstate(over="ignore"):
        for j in range(size):
            out *= np.uint64(0xA0761D6478BD642B)
            out += other[at + j]
    return (B.mix(out, 3) >> np.uint64(32)).astype(np.uint32)


def _group(h: np.ndarray, c: np.ndarray, ids: np.ndarray):
    """Order by (hash, check, id); flags of the first row of each (hash, check)."""
    order = np.lexsort((ids, c, h))
    h, c, ids = h[order], c[order], ids[order]
    new = np.append(True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])) if len(h) else np.zeros(0, bool)
    return order, h, c, ids, new


def remove_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                            window: int = WINDOW) -> DataFrame:
    """Cut out every word inside a window of ``window`` words that also starts in a document with a smaller id.

    Returns one row per input row: the id, ``n_words``, ``n_removed``, ``kept_text``
    (kept words joined by one space) and ``removed`` (maximal word intervals
    [begin, end)). Words are ``[^\\x20\\x09-\\x0D]+``.

    Null text: no words, empty kept text. Null id: larger than every id; rows
    with equal ids (or both null) never count against each other. Texts shorter
    than the window keep all words. An empty table gives an empty result. Other
    columns are not read, whatever their names.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n = B.block_count(docs, "text")
    packed = B.pack_blocks(docs, "doc_id", ["doc_id", "text"], n, spread=("text",))
    shift = np.uint64(64 - _PREFIX_BITS)

    def send_prefixes(key, table):
        parts = []
        for chunk in B.chunks(table):
            parts.append(B.unique_sorted(_windows(chunk, window)[2] >> shift))
        values = B.unique_sorted(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
        return B.rows_table(list(B.route(key[0].as_py(), values, n, _PREFIX_BITS)), B.ROUTED_ARROW)

    prefixes = packed.groupBy("block").applyInArrow(send_prefixes, B.ROUTED).repartition(n, "bucket")
    candidates = B.repeated_across_blocks(prefixes, n)

    def send_candidates(key, table, answers):
        known, rows = B.merged_reply(answers), []
        hs, cs, ds = [], [], []
        for chunk in B.chunks(table) if len(known) else ():
            words, doc, h, at = _windows(chunk, window)
            keep = B.contains(known, h >> shift)
            hs.append(h[keep])
            cs.append(_check(words, at[keep], window))
            ds.append(B.ids_of(chunk.column("doc_id"))[doc[at[keep]]])
        if hs:
            _, h, c, ids, new = _group(*(np.concatenate(x) for x in (hs, cs, ds)))
            h, c, ids = h[new], c[new], ids[new]
            edges = np.array([(b << 64) // n for b in range(1, n)], np.uint64)
            at = np.concatenate([[0], np.searchsorted(h, edges), [len(h)]]).astype(int)
            rows = [(int(b), key[0].as_py(), h[at[b]:at[b + 1]].tobytes(), c[at[b]:at[b + 1]].tobytes(),
                     ids[at[b]:at[b + 1]].tobytes()) for b in np.flatnonzero(np.diff(at))]
        return B.rows_table(rows, _ROUTE2_ARROW)

    def answer_firsts(table):
        blocks = table.column("block").to_pylist()
        lists = [[np.frombuffer(v.as_buffer(), t) for v in table.column(c)]
                 for c, t in (("hash", np.uint64), ("check", np.uint32), ("first", np.int64))]
        own = np.repeat(np.arange(len(blocks)), [len(x) for x in lists[0]])
        order, h, c, ids, new = _group(*(np.concatenate(x) for x in lists))
        least = ids[np.flatnonzero(new)][np.cumsum(new) - 1]
        late = ids > least
        own, h, c = own[order][late], h[late], c[late]
        by = np.argsort(own, kind="stable")
        own, h, c = own[by], h[by], c[by]
        at = np.searchsorted(own, np.arange(len(blocks) + 1))
        return B.rows_table([(blocks[k], h[at[k]:at[k + 1]].tobytes(), c[at[k]:at[k + 1]].tobytes())
                             for k in range(len(blocks)) if at[k + 1] > at[k]], _REPLY2_ARROW)

    cogrouped = packed.groupBy("block").cogroup(candidates.groupBy("block"))
    routed = cogrouped.applyInArrow(send_candidates, _ROUTE2).repartition(n, "bucket")
    firsts = routed.groupBy("bucket").applyInArrow(answer_firsts, _REPLY2)

    def cut(table, answers):
        late_h = [np.frombuffer(v.as_buffer(), np.uint64) for v in answers.column("hash")]
        late_c = [np.frombuffer(v.as_buffer(), np.uint32) for v in answers.column("check")]
        late_h = np.concatenate(late_h) if late_h else np.zeros(0, np.uint64)
        late_c = np.concatenate(late_c) if late_c else np.zeros(0, np.uint32)
        held, flags = [], []
        for chunk in B.chunks(table):
            words, doc, h, at = _windows(chunk, window)
            held.append((chunk, len(words), doc, h, at))
            flags.append(h)
        every = np.sort(np.concatenate(flags)) if flags else np.zeros(0, np.uint64)
        own = B.unique_sorted(every[1:][every[1:] == every[:-1]])  # repeated inside the block
        maybe = B.unique_sorted(np.concatenate([own, late_h]))
        hs, cs, ds = [], [], []
        picks = []
        for chunk, _, doc, h, at in held:
            keep = np.flatnonzero(B.contains(maybe, h))
            raw, off = B.text_bytes(chunk.column("text"))
            words = B.word_hashes(raw, off)[0] if len(keep) else np.zeros(0, np.uint64)
            picks.append(keep)
            hs.append(h[keep])
            cs.append(_check(words, at[keep], window))
            ds.append(B.ids_of(chunk.column("doc_id"))[doc[at[keep]]])
        if hs:
            k = sum(len(x) for x in hs)
            h = np.concatenate([*hs, late_h])
            c = np.concatenate([*cs, late_c])
            ids = np.concatenate([*ds, np.full(len(late_h), np.iinfo(np.int64).min)])
            order, h, c, ids, new = _group(h, c, ids)
            late = np.empty(len(h), bool)
            late[order] = ids > ids[np.flatnonzero(new)][np.cumsum(new) - 1] if len(h) else False
            late = late[:k]
        out, lo = [], 0
        for (chunk, n_words, doc, h, at), keep in zip(held, picks):
            bad = at[keep[late[lo:lo + len(keep)]]]
            lo += len(keep)
            out.append(_cut_chunk(chunk, n_words, doc, bad, window))
        return pa.concat_tables(out) if out else _RESULT_ARROW.empty_table()

    return (packed.groupBy("block").cogroup(firsts.groupBy("block"))
            .applyInArrow(cut, _RESULT).withColumnRenamed("doc_id", id_col))


_RESULT = ("doc_id long, n_words long, n_removed long, kept_text string, "
           "removed array<struct<begin: long, end: long>>")
_SPAN = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
_RESULT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                           ("kept_text", pa.string()), ("removed", pa.list_(_SPAN))])


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Mask of the ``n`` places inside [s, s + size) of some start."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + size, -1)
    return np.cumsum(step[:-1]) > 0


def intervals(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the maximal runs of a mask."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _cut_chunk(chunk: pa.Table, n_words: int, doc: np.ndarray, bad: np.ndarray, window: int) -> pa.Table:
    raw, off = B.text_bytes(chunk.column("text"))
    data = raw.tobytes()
    counts = np.bincount(doc, minlength=chunk.num_rows) if n_words else np.zeros(chunk.num_rows, int)
    at = np.concatenate([[0], np.cumsum(counts)])
    gone = covered(bad, window, n_words)
    hit = np.add.reduceat(np.append(gone, 0), at[:-1]) * (counts > 0) if chunk.num_rows else counts
    kept, removed = [], []
    for r in range(chunk.num_rows):
        words = data[off[r]:off[r + 1]].split()
        spans = []
        if hit[r]:
            mask = gone[at[r]:at[r + 1]]
            words = compress(words, ~mask)
            spans = [{"begin": int(b), "end": int(e)} for b, e in zip(*intervals(mask))]
        kept.append(b" ".join(words))
        removed.append(spans)
    return pa.Table.from_arrays(
        [B.one_array(chunk.column("doc_id")).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(hit, pa.int64()),
         pa.array(kept, pa.binary()).cast(pa.string()), pa.array(removed, pa.list_(_SPAN))], schema=_RESULT_ARROW)
