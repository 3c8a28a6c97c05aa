"""Suffix-array dedup by a common-prefix-aware distributed merge sort.

Removes bytes inside strings of ``length`` bytes that start at two places or
more. Sorting the suffix of every byte would move hundreds of bytes for each,
so the sorted suffixes are a sparse set that content picks: in every window of
``length`` bytes the 128-byte gram with the smallest hash is its anchor, and a
window's suffix is sorted where the anchor changes. Equal windows have equal
anchors at equal places, whatever surrounds them, so nothing is lost:

1. blocks send the hash prefixes of their anchors' grams; grams that occur once
   rule their windows out;
2. each block sorts the suffixes of the other anchors into a run, front-coded
   and split by sampled splitters;
3. a range merges its runs with a loser tree that never compares a known prefix
   again, and answers which suffixes are repeated;
4. between two repeated neighbours nothing is left to decide. Where a repeat
   begins or ends inside a window stretch, the stretch's places (and those of
   all stretches with that gram) are compared by hash, place by place;
5. blocks cut the covered bytes out.

Blocks answer each other through hash or key ranges; what a block has found so
far travels along as a small array, so the whole is one plan over one exchange
of texts.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks as B
from .merge_runs import Run, front_code, repeated
from .substring_dedup import intervals

LENGTH = 400
GRAM = 128
#: Documents whose text the splitters of the key ranges are sampled from (by hash of the id).
SPLITTER_DOCS = 1000
_PREFIX = np.uint64(16)  # hash prefixes have 48 bits
_POWER = np.uint64(0x9E3779B97F4A7C15)
_SENT = "bucket int, block int, kind int, payload binary"
_SENT_ARROW = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])
_BACK = "block int, kind int, payload binary"
_BACK_ARROW = pa.schema([("block", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])
STATE, DATA = 0, 1


def save(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def load(payload) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(payload)) as z:
        return {k: z[k] for k in z.files}


def gram_hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes from every place, by doubling; sizes are sums of powers of two."""
    with np.errstate(over="ignore"):
        n, h, k, power = len(raw), B.mix(raw.astype(np.uint64) + np.uint64(1)), 1, _POWER
        total, done = None, 0
        while True:
            if size & k:  # the part of this power of two, after the larger ones still to come
                part = h[size - done - k:] if size - done - k else h
                part = part[:n - size + 1]
                total = part.copy() if total is None else total * B.mix(power) + part
                done += k
            if done == size:
                return B.mix(total)
            h = h[:-k] * power + h[k:]
            power, k = power * power, 2 * k


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """The minimum of ``width`` values from every place."""
    k = 1
    m = v
    while 2 * k <= width:
        m = np.minimum(m[:-k], m[k:])
        k *= 2
    return np.minimum(m[:len(v) - width + 1], m[width - k:]) if k < width else m


def anchors(raw: np.ndarray, off: np.ndarray, length: int, gram: int):
    """(first window, last window, gram hash) of each stretch of windows with one anchor.

    The anchor of a window is its gram with the smallest hash, the leftmost of equals.
    """
    n = len(raw)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, np.zeros(0, np.uint64)
    h = gram_hashes(raw, gram)
    place_bits = np.uint64(max(1, int(n).bit_length()))
    with np.errstate(over="ignore"):
        order = (h * np.uint64(0xD6E8FEB86659FD93)) >> place_bits << place_bits
    best = sliding_min(order | np.arange(len(h), dtype=np.uint64), length - gram + 1)
    at = (best & ((np.uint64(1) << place_bits) - np.uint64(1))).astype(np.int64)
    del best, order
    valid = np.zeros(len(at), bool)
    for lo, hi in zip(off[:-1], off[1:]):
        if hi - lo >= length:
            valid[lo:hi - length + 1] = True
    edge = np.append(True, (at[1:] != at[:-1]) | (valid[1:] != valid[:-1]))
    first = np.flatnonzero(edge)
    last = np.append(first[1:], len(at)) - 1
    keep = valid[first]
    return first[keep], last[keep], h[at[first[keep]]]


def block_anchors(table: pa.Table, length: int, gram: int):
    """Anchors of a whole block, in its byte places."""
    parts = []
    for part, base in B.slices(table):
        raw, off = B.text_bytes(part.column("text"))
        x, y, h = anchors(raw, off, length, gram)
        parts.append((x + base, y + base, h))
    return tuple(np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 2 + (
        np.zeros(0, np.uint64),)


def counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values ascending, those that occur at least twice)."""
    values = np.sort(values)
    new = np.append(True, values[1:] != values[:-1]) if len(values) else np.zeros(0, bool)
    twice = values[1:][values[1:] == values[:-1]]
    return values[new], B.unique_sorted(twice)


def stretch_places(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All places of the stretches [x, y], end to end."""
    size = y - x + 1
    return np.repeat(x - np.cumsum(size) + size, size) + np.arange(size.sum())


def place_hashes(table: pa.Table, x: np.ndarray, y: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash of the ``length`` bytes from it) for all places of the stretches."""
    places, hashes = [], []
    for part, base in B.slices(table):
        raw, off = B.text_bytes(part.column("text"))
        lo, hi = np.searchsorted(x, [base, base + len(raw)])
        if lo == hi:
            continue
        at = stretch_places(x[lo:hi] - base, y[lo:hi] - base)
        doc = np.unique(np.searchsorted(off, x[lo:hi] - base, "right") - 1)  # only documents with a stretch
        size = (off[1:] - off[:-1])[doc]
        some = raw[np.repeat(off[doc] - np.cumsum(size) + size, size) + np.arange(size.sum())]
        moved = np.zeros(len(off) - 1, np.int64)
        moved[doc] = np.cumsum(size) - size - off[doc]
        h = gram_hashes(some, length)
        hashes.append(h[at + moved[np.searchsorted(off, at, "right") - 1]])
        places.append(at + base)
    return (np.concatenate(places), np.concatenate(hashes)) if places else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   gram: int = GRAM, carry: list[str] = ()) -> DataFrame:
    """Cut out every byte inside a ``length``-byte string (UTF-8) that also starts anywhere else.

    One row per input row: the id, the columns of ``carry``, ``n_bytes``,
    ``n_removed``, ``n_spans`` (maximal removed runs), ``kept`` (the remaining
    bytes, which may cut a character) and ``removed`` (intervals [begin, end)).
    Matches never cross documents; overlaps count; strings are judged on the
    input. Null text: no bytes. Null and repeated ids are rows like any other.
    Texts shorter than ``length`` stay whole. An empty table gives an empty
    result. Columns that are not carried are not read.
    """
    spark = docs.sparkSession
    carry = list(carry)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       *[F.col(c).alias(f"c_{c}") for c in carry])
    n = B.block_count(docs, "text")
    packed = B.pack_blocks(docs, "doc_id", docs.columns, n, spread=("text",))
    splitters = _splitters(docs, n, length)

    def answers(table, kind):
        return [p.as_buffer() for p, k in zip(table.column("payload"), table.column("kind").to_pylist()) if k == kind]

    def one(table, kind) -> np.ndarray:
        lists = [B.decode_sorted(p) for p in answers(table, kind)]
        return B.unique_sorted(np.concatenate(lists)) if lists else np.zeros(0, np.uint64)

    # 1: which grams occur twice
    def send_grams(key, table):
        block = B.ordered_block(table)
        _, _, h = block_anchors(block, length, gram)
        return B.rows_table(list(B.route(key[0].as_py(), counted(h >> _PREFIX)[0], n, 48)), B.ROUTED_ARROW)

    grams = packed.groupBy("block").applyInArrow(send_grams, B.ROUTED).repartition(n, "bucket")
    grams = B.repeated_across_blocks(grams, n).selectExpr("block", f"{DATA} AS kind", "payload")

    # 2: a sorted, front-coded run of the suffixes at the anchors that remain
    def send_runs(key, table, reply):
        block, number, rows = B.ordered_block(table), key[0].as_py(), []
        if block is not None:
            x, y, h = block_anchors(block, length, gram)
            g = h >> _PREFIX
            distinct, twice = counted(g)
            keep = B.contains(B.unique_sorted(np.concatenate([twice, one(reply, DATA)])), g)
            x, y, g = x[keep], y[keep], g[keep]
            text = [np.zeros((0, length), np.uint8)]
            for part, base in B.slices(block):
                raw, _ = B.text_bytes(part.column("text"))
                mine = x[slice(*np.searchsorted(x, [base, base + len(raw)]))] - base
                if len(mine):
                    text.append(np.lib.stride_tricks.sliding_window_view(raw, length)[mine])
            text = np.concatenate(text)
            as_key = np.ascontiguousarray(text).view(f"S{length}")[:, 0]
            order = np.argsort(as_key, kind="stable")
            lcp, _ = front_code(text[order])
            new = lcp < length
            if len(new):
                new[0] = True
            run_of = np.empty(len(x), np.int64)
            run_of[order] = np.cumsum(new) - 1
            several = np.bincount(run_of, minlength=int(new.sum())) > 1 if len(x) else np.zeros(0, bool)
            text, heads = text[order][new], as_key[order][new]
            cut = [0, *np.searchsorted(heads, np.array(splitters, f"S{length}")).tolist(), len(heads)] \
                if splitters else [0, len(heads)]
            for k, (lo, hi) in enumerate(zip(cut, cut[1:])):
                if hi > lo:
                    lcps, tails = front_code(text[lo:hi])
                    rows.append((k, number, DATA, save(lcp=lcps, tails=np.frombuffer(tails, np.uint8),
                                                       several=several[lo:hi], first=np.array([lo]))))
            rows.append((-1 - number, number, STATE, save(x=x, y=y, g=g, run=run_of)))
        return B.rows_table(rows, _SENT_ARROW)

    runs = packed.groupBy("block").cogroup(grams.groupBy("block")).applyInArrow(send_runs, _SENT).repartition(2 * n, "bucket")

    # 3: merge the runs of a range; a block's own state passes through
    def merge_range(key, table):
        blocks = table.column("block").to_pylist()
        if key[0].as_py() < 0:
            return B.rows_table([(b, STATE, p.as_py()) for b, p in zip(blocks, table.column("payload"))], _BACK_ARROW)
        pieces = [load(p.as_buffer()) for p in table.column("payload")]
        found = repeated([Run(p["lcp"].tolist(), p["tails"].tobytes(), length) for p in pieces], length,
                         [p["several"] for p in pieces])
        return B.rows_table([(b, DATA, B.encode_sorted((np.sort(f) + p["first"][0]).astype(np.uint64)))
                             for b, p, f in zip(blocks, pieces, found) if len(f)], _BACK_ARROW)

    merged = runs.groupBy("bucket").applyInArrow(merge_range, _BACK)

    # 4a: grams of stretches in which a repeat begins or ends
    def send_contested(key, table):
        number, rows = key[0].as_py(), []
        for blob in answers(table, STATE):
            state = load(blob)
            x, y = state["x"], state["y"]
            hit = np.isin(state["run"], one(table, DATA).astype(np.int64))
            follows = np.append((x[1:] == y[:-1] + 1) & hit[1:], False) if len(x) else hit
            settled = hit & (follows | (x == y))  # a window that the sort did not find may repeat inside a stretch
            grams_, _ = counted(state["g"])
            open_ = B.unique_sorted(state["g"][~settled])
            edges = [(b << 48) // n for b in range(1, n)]
            at = np.concatenate([[0], np.searchsorted(grams_, np.array(edges, np.uint64)), [len(grams_)]]).astype(int)
            for b in np.flatnonzero(np.diff(at)):
                g = grams_[at[b]:at[b + 1]]
                rows.append((int(b), number, DATA, save(g=g, open=B.contains(open_, g))))
            rows.append((-1 - number, number, STATE, save(x=x, y=y, g=state["g"], hit=hit)))
        return B.rows_table(rows, _SENT_ARROW)

    contested = merged.groupBy("block").applyInArrow(send_contested, _SENT).repartition(2 * n, "bucket")

    def answer_contested(key, table):
        blocks = table.column("block").to_pylist()
        if key[0].as_py() < 0:
            return B.rows_table([(b, STATE, p.as_py()) for b, p in zip(blocks, table.column("payload"))], _BACK_ARROW)
        pieces = [load(p.as_buffer()) for p in table.column("payload")]
        asked = B.unique_sorted(np.concatenate([p["g"][p["open"]] for p in pieces]))
        rows = [(b, p["g"][B.contains(asked, p["g"])]) for b, p in zip(blocks, pieces)]
        return B.rows_table([(b, DATA, B.encode_sorted(g)) for b, g in rows if len(g)], _BACK_ARROW)

    contested = contested.groupBy("bucket").applyInArrow(answer_contested, _BACK)

    # 4b: the places of those stretches, by hash
    def send_places(key, table, reply):
        number, rows = key[0].as_py(), []
        for blob in answers(reply, STATE):
            state = load(blob)
            asked = B.contains(one(reply, DATA), state["g"])
            x, y = state["x"][asked], state["y"][asked]
            if len(x):
                _, h = place_hashes(B.ordered_block(table), x, y, length)
                rows += [(b, number, DATA, p) for b, _, p in B.route(number, counted(h)[0], n)]
            rows.append((-1 - number, number, STATE, save(x=x, y=y, hit=state["x"][state["hit"]])))
        return B.rows_table(rows, _SENT_ARROW)

    places = packed.groupBy("block").cogroup(contested.groupBy("block")).applyInArrow(send_places, _SENT).repartition(
        2 * n, "bucket")

    def answer_places(key, table):
        blocks = table.column("block").to_pylist()
        if key[0].as_py() < 0:
            return B.rows_table([(b, STATE, p.as_py()) for b, p in zip(blocks, table.column("payload"))], _BACK_ARROW)
        lists = [B.decode_sorted(p.as_buffer()) for p in table.column("payload")]
        twice = counted(np.concatenate(lists))[1]
        rows = [(b, v[B.contains(twice, v)]) for b, v in zip(blocks, lists)]
        return B.rows_table([(b, DATA, B.encode_sorted(v)) for b, v in rows if len(v)], _BACK_ARROW)

    settled = places.groupBy("bucket").applyInArrow(answer_places, _BACK)

    # 5: cut
    schema = T.StructType([docs.schema[c] for c in docs.columns if c != "text"]
                          + T.StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept binary, "
                                                "removed array<struct<begin: long, end: long>>").fields)
    span = pa.struct([("begin", pa.int64()), ("end", pa.int64())])

    def cut(table, reply):
        block = B.ordered_block(table)
        start = []
        for blob in answers(reply, STATE):
            state = load(blob)
            start.append(state["hit"])
            if len(state["x"]):
                at, h = place_hashes(block, state["x"], state["y"], length)
                known = B.unique_sorted(np.concatenate([counted(h)[1], one(reply, DATA)]))
                start.append(at[B.contains(known, h)])
        start = np.unique(np.concatenate(start)) if start else np.zeros(0, np.int64)
        out = []
        for part, base in B.slices(block):
            raw, off = B.text_bytes(part.column("text"))
            mine = start[slice(*np.searchsorted(start, [base, base + len(raw)]))] - base
            doc = np.searchsorted(off, mine, "right") - 1
            step = np.zeros(len(raw) + 1, np.int32)
            np.add.at(step, mine, 1)
            np.add.at(step, mine + length, -1)
            gone = np.cumsum(step[:-1]) > 0
            hit = set(np.unique(doc).tolist())
            kept, removed, lost = [], [], []
            for r in range(part.num_rows):
                lo, hi = off[r], off[r + 1]
                if r in hit:
                    mask = gone[lo:hi]
                    kept.append(raw[lo:hi][~mask].tobytes())
                    removed.append([{"begin": int(a), "end": int(b)} for a, b in zip(*intervals(mask))])
                    lost.append(int(mask.sum()))
                else:
                    kept.append(raw[lo:hi].tobytes())
                    removed.append([])
                    lost.append(0)
            columns = [B.one_array(part.column(c)) for c in ["doc_id", *[f"c_{c}" for c in carry]]]
            columns += [pa.array(np.diff(off), pa.int64()), pa.array(lost, pa.int64()),
                        pa.array([len(s) for s in removed], pa.int64()), pa.array(kept, pa.binary()),
                        pa.array(removed, pa.list_(span))]
            out.append(pa.Table.from_arrays(columns, names=["doc_id", *[f"c_{c}" for c in carry], "n_bytes", "n_removed",
                                                            "n_spans", "kept", "removed"]))
        return pa.concat_tables(out)

    done = packed.groupBy("block").cogroup(settled.groupBy("block")).applyInArrow(cut, schema)
    return done.select(F.col("doc_id").alias(id_col), *[F.col(f"c_{c}").alias(c) for c in carry], "n_bytes", "n_removed",
                       "n_spans", "kept", "removed")


def _splitters(docs: DataFrame, ranges: int, length: int) -> list[bytes]:
    """Borders of the key ranges: quantiles of strings at spread places of a bounded number of documents.

    They only balance the ranges; any borders give the same result.
    """
    if ranges < 2:
        return []
    ids = docs.select("doc_id").where("doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SPLITTER_DOCS)
    sample = (docs.join(F.broadcast(ids.distinct()), "doc_id").where(F.octet_length("text") >= length)  # bounded ids
              .select(F.substring("text", 1, 20_000).alias("text")).limit(2 * SPLITTER_DOCS).collect())
    heads = []
    for r in sample:
        raw = r["text"].encode()
        heads += [raw[at:at + 16] for at in range(0, len(raw) - 16, 97)]
    heads = sorted(set(heads))
    return sorted({heads[k * len(heads) // ranges] for k in range(1, ranges)}) if heads else []
