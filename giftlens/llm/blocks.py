"""Text blocks and compact hash exchanges shared by the operators of this folder.

A *block* is a bounded set of documents (about ``BLOCK_BYTES`` of text) chosen by
the hash of the document id. Documents travel once, as compressed Arrow payloads
keyed by block; hashes travel as sorted, delta-coded arrays keyed by hash range.
A hash that occurs a million times costs at most one entry per block and range,
so a hot passage or key never gathers its copies in one task, and answers go
back to the block they came from.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 16 << 20
CHUNK_BYTES = 1 << 20
PACKED = "block int, payload binary"
ROUTED = "bucket int, block int, payload binary"
REPLY = "block int, payload binary"
NULL_ID = np.int64(2**63 - 1)


def block_count(docs: DataFrame, text_col: str, block_bytes: int = BLOCK_BYTES) -> int:
    """Number of blocks for the table: all its text bytes over the block size, at least one."""
    total = docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0
    return max(1, math.ceil(total / block_bytes))


def pack_blocks(docs: DataFrame, id_col: str, columns: list[str], blocks: int, spread: tuple[str, ...] = ()) -> DataFrame:
    """(block, payload): the rows of each block as zstd-compressed Arrow batches, shuffled by block.

    A block is chosen by the hash of the id and of the ``spread`` columns. Where a step needs
    nothing but the rows, the text spreads ids that many rows share, such as null, over all blocks; only rows
    equal in both meet. The choice depends on nothing but the row, so it is the same whenever it is made.
    The same frame may feed several steps of one plan: Spark then reuses its one exchange.
    """
    keyed = docs.select(F.pmod(F.xxhash64(F.col(id_col), *[F.col(c) for c in spread]), F.lit(blocks)).cast("int").alias("__block"),
                        *[F.col(c) for c in columns])

    def pack(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= 2 * BLOCK_BYTES:
                yield from emit(held)
                held, size = [], 0
        yield from emit(held)

    def emit(held):
        held = [b for b in held if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        key = table.column("__block").to_numpy()
        order = np.argsort(key, kind="stable")
        table = table.drop_columns(["__block"]).take(order)
        ids, first = np.unique(key[order], return_index=True)
        for k, (b, lo) in enumerate(zip(ids, first)):
            hi = first[k + 1] if k + 1 < len(first) else len(key)
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(b)], pa.int32()), pa.array([to_payload(table.slice(lo, hi - lo))], pa.binary())],
                names=["block", "payload"])

    parts = max(blocks, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return keyed.mapInArrow(pack, PACKED).repartition(parts, "block")


_ZSTD = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=2))


def to_payload(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    table = table.combine_chunks()
    with pa.ipc.new_stream(sink, table.schema, options=_ZSTD) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def chunks(packed: pa.Table, chunk_bytes: int = CHUNK_BYTES):
    """Arrow tables of whole documents, each of about ``chunk_bytes`` (a longer document stands alone)."""
    for payload in packed.column("payload"):
        table = pa.ipc.open_stream(payload.as_buffer()).read_all().combine_chunks()
        text = table.column("text").combine_chunks() if "text" in table.column_names else None
        if text is None or table.num_rows == 0:
            if table.num_rows:
                yield table
            continue
        ends = np.cumsum(np.maximum(lengths(text), 1))
        lo = 0
        while lo < table.num_rows:
            base = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, base + chunk_bytes, "right")))
            yield table.slice(lo, hi - lo)
            lo = hi


def ordered_block(packed: pa.Table) -> pa.Table | None:
    """All rows of a block by id, then text: the same order whenever the block is read."""
    parts = [pa.ipc.open_stream(p.as_buffer()).read_all() for p in packed.column("payload")]
    if not parts:
        return None
    table = pa.concat_tables(parts).combine_chunks()
    by = pa.compute.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("text", "ascending")])
    return table.take(by).combine_chunks()


def slices(table: pa.Table, chunk_bytes: int = CHUNK_BYTES):
    """(rows, first byte) of consecutive parts of a table, each of about ``chunk_bytes`` of text."""
    size = lengths(one_array(table.column("text")))
    ends, at = np.cumsum(np.maximum(size, 1)), np.concatenate([[0], np.cumsum(size)])
    lo = 0
    while lo < table.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + chunk_bytes, "right")))
        yield table.slice(lo, hi - lo), int(at[lo])
        lo = hi


def one_array(column) -> pa.Array:
    """A column of a chunk as one array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null text has no bytes."""
    arr = one_array(column)
    if arr.null_count:
        arr = arr.fill_null("")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(arr.buffers()[1], np.int64 if wide else np.int32)[arr.offset:arr.offset + len(arr) + 1]
    data = arr.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], (off - off[0]).astype(np.int64)


def lengths(arr: pa.Array) -> np.ndarray:
    return np.diff(text_bytes(arr)[1])


def ids_of(column) -> np.ndarray:
    """Document ids as int64; null counts as larger than every id."""
    return one_array(column).fill_null(int(NULL_ID)).to_numpy(zero_copy_only=False).astype(np.int64)


# ---- words -----------------------------------------------------------------

SEPARATORS = np.zeros(256, bool)
SEPARATORS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_BYTE[SEPARATORS] = 0
_BASE = np.uint64(0x9E3779B97F4A7C15 & ~0x7 | 0x3)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit finaliser: spreads every input bit over the word."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15 * (2 * seed + 1) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, document index) of each word ``[^\\x20\\x09-\\x0D]+``, in text order."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = ~SEPARATORS[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    at = offsets[:-1][np.diff(offsets) > 0]
    begins[at] = inside[at]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    doc = np.searchsorted(offsets, starts, "right") - 1
    first = starts[0]
    k = np.arange(n - first, dtype=np.int64)
    k -= np.repeat(starts - first, np.diff(np.append(starts, n)))
    with np.errstate(over="ignore"):
        part = _BYTE[raw[first:]]
        part *= powers(int(k.max()) + 1)[k]
        h = np.add.reduceat(part, starts - first)
    return mix(h), doc


def window_hashes(words: np.ndarray, doc: np.ndarray, size: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(Rabin-Karp hash, index of the first word) of every window of ``size`` words of one document."""
    m = len(words) - size + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        h = words[:m].copy()
        for j in range(1, size):
            h *= np.uint64(base)
            h += words[j:j + m]
    at = np.flatnonzero(doc[:m] == doc[size - 1:])
    return mix(h[at]), at


# ---- sorted hash lists -----------------------------------------------------

def encode_sorted(values: np.ndarray) -> bytes:
    """Ascending uint64 values as a first value and gaps of 4 bytes (6 or 8 where a gap needs them)."""
    gaps = np.diff(values)
    most = int(gaps.max()) if len(gaps) else 0
    wide = 0 if most < 2**32 else 1 if most < 2**48 else 2
    head = np.array([len(values), wide], np.uint32).tobytes() + values[:1].tobytes()
    if wide == 2:
        return head + gaps.tobytes()
    high = (gaps >> np.uint64(32)).astype(np.uint16).tobytes() if wide else b""
    return head + gaps.astype(np.uint32).tobytes() + high


def decode_sorted(blob: bytes) -> np.ndarray:
    n, wide = (int(x) for x in np.frombuffer(blob, np.uint32, 2))
    if not n:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    out[0] = np.frombuffer(blob, np.uint64, 1, 8)[0]
    if wide == 2:
        out[1:] = np.frombuffer(blob, np.uint64, n - 1, 16)
    else:
        out[1:] = np.frombuffer(blob, np.uint32, n - 1, 16)
        if wide:
            out[1:] += np.frombuffer(blob, np.uint16, n - 1, 16 + 4 * (n - 1)).astype(np.uint64) << np.uint64(32)
    return np.cumsum(out, dtype=np.uint64)


def unique_sorted(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def contains(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each value whether it is in the ascending list."""
    if not len(sorted_values):
        return np.zeros(len(values), bool)
    at = np.searchsorted(sorted_values, values)
    at[at == len(sorted_values)] = 0
    return sorted_values[at] == values


def route(block: int, values: np.ndarray, buckets: int, bits: int = 64):
    """(bucket, block, payload) rows: the ascending values split by range of their top bits."""
    edges = [(b << bits) // buckets for b in range(1, buckets)]
    cut = np.searchsorted(values, np.array(edges, np.uint64)) if edges else np.zeros(0, np.int64)
    at = np.concatenate([[0], cut, [len(values)]])
    for b in np.flatnonzero(np.diff(at)):
        yield int(b), block, encode_sorted(values[at[b]:at[b + 1]])


def rows_table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)] if rows
                                else [pa.array([], f.type) for f in schema], schema=schema)


ROUTED_ARROW = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("payload", pa.binary())])
REPLY_ARROW = pa.schema([("block", pa.int32()), ("payload", pa.binary())])


def repeated_across_blocks(routed: DataFrame, buckets: int) -> DataFrame:
    """(block, payload): of each block's sorted values, those that another block sent as well."""

    def answer(table):
        blocks = table.column("block").to_pylist()
        lists = [decode_sorted(p.as_buffer()) for p in table.column("payload")]
        every = np.sort(np.concatenate(lists))
        twice = every[1:][every[1:] == every[:-1]]
        twice = twice[np.append(True, twice[1:] != twice[:-1])] if len(twice) else twice
        del every
        rows = []
        for block, values in zip(blocks, lists):
            found = values[contains(twice, values)]
            if len(found):
                rows.append((block, encode_sorted(found)))
        return rows_table(rows, REPLY_ARROW)

    return routed.groupBy("bucket").applyInArrow(answer, REPLY)


def merged_reply(table: pa.Table) -> np.ndarray:
    """All values of the answers to one block, ascending."""
    lists = [decode_sorted(p.as_buffer()) for p in table.column("payload")]
    return unique_sorted(np.concatenate(lists)) if lists else np.zeros(0, np.uint64)
