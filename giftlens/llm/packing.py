"""Packing token pieces into fixed windows by minimum bin slack.

Only the lengths matter for the plan, so the driver sees a histogram of at most
``capacity`` counts, whatever the table's size. It fills one window at a time:
the longest piece left, then the multiset of the remaining lengths that comes
closest to capacity, by subset sums over a bitset with backtracked counts. A
filling found once is repeated as often as the counts allow, so every step uses
up a length and the plan has at most ``capacity`` fillings. Spark then ranks the
pieces of each length and looks their places up in the plan.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import Vocabulary, encode_batches
from .checkpoints import written

CAPACITY = 4096
END_ID = 2


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The minimum-slack multiset of lengths with the longest one in it: {length: count}.

    Lengths are offered in descending order; the sums they reach are a bitset.
    The search ends as soon as the window can be filled to the brim.
    """
    longest = max(counts)
    room = capacity - longest
    reach, steps, full = 1, [], (1 << room + 1) - 1
    for length in sorted((n for n in counts if n <= room), reverse=True):
        left = min(counts[length] - (length == longest), room // length)
        take = 1
        while left > 0:  # counts as 1, 2, 4, ... and a rest
            k = min(take, left)
            more = reach | (reach << k * length) & full
            if more != reach:
                steps.append((length, k, reach))
                reach = more
            left -= k
            take *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    chosen = {longest: 1}
    for length, k, before in reversed(steps):
        if not before >> total & 1:  # this sum needs the step
            chosen[length] = chosen.get(length, 0) + k
            total -= k * length
    return chosen


def plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Fillings with the number of windows that each one serves; all counts are used up."""
    left = {n: c for n, c in counts.items() if c > 0}
    out = []
    while left:
        one = fill(left, capacity)
        times = min(left[n] // k for n, k in one.items())
        for n, k in one.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
        out.append((one, times))
    return out


def places(fillings: list[tuple[dict[int, int], int]]) -> dict[int, dict[str, np.ndarray]]:
    """For each length, by rank: where a filling's share begins, how many it takes, its first window and offset."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    window = 0
    for one, times in fillings:
        offset = 0
        for n in sorted(one, reverse=True):
            rows.setdefault(n, []).append((used.get(n, 0), one[n], window, offset))
            used[n] = used.get(n, 0) + one[n] * times
            offset += n * one[n]
        window += times
    return {n: dict(zip(("rank", "take", "window", "offset"), np.array(r, np.int64).T)) for n, r in rows.items()}


def pack(pieces: DataFrame, key_cols: list[str], length_col: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces of 1 to ``capacity`` tokens.

    Within a sequence the offsets are gapless from 0. ``key_cols`` must tell the
    pieces apart (equal keys with equal lengths are interchangeable, so either
    may come first). Rows without a length, or with one below 1, have nothing to
    pack and are left out; a length over the capacity is an error. An empty table
    gives an empty result. Columns named like the results are replaced.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset", "__shard", "__rank", "__base")
    length = F.col(length_col)
    pieces = written(pieces.where(length >= 1))
    shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # a hot length is ranked in shards: counts by (length, shard) give each shard its first rank
    sharded = pieces.withColumn("__shard", F.pmod(F.xxhash64(*key_cols), F.lit(shards)))
    tally = sharded.groupBy(length_col, "__shard").agg(F.count(F.lit(1)).alias("__n"))
    histogram = {int(r[0]): int(r[1]) for r in pieces.groupBy(length_col).count().collect()}  # <= capacity rows
    if histogram and max(histogram) > capacity:
        raise ValueError(f"a piece of {max(histogram)} tokens is over the capacity {capacity}")
    before = Window.partitionBy(length_col).orderBy("__shard").rowsBetween(Window.unboundedPreceding, -1)
    tally = tally.select(length_col, "__shard", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy(length_col, "__shard").orderBy(*key_cols)
    ranked = (sharded.withColumn("__rank", F.row_number().over(inside) - 1)
              .join(tally, [length_col, "__shard"])
              .select(*[pieces[c] for c in pieces.columns], (F.col("__rank") + F.col("__base")).alias("__rank")))
    # at most ``capacity`` fillings of few lengths each: bounded whatever the number of pieces
    shared = spark.sparkContext.broadcast(places(plan(histogram, capacity)))
    schema = pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema

    def look_up(stream):
        where = shared.value
        for batch in stream:
            table = pa.Table.from_batches([batch])
            n = table.column(length_col).to_numpy().astype(np.int64)
            rank = table.column("__rank").to_numpy().astype(np.int64)
            sequence, offset = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
            order = np.argsort(n, kind="stable")
            cut = np.flatnonzero(np.diff(n[order])) + 1
            for rows in np.split(order, cut) if len(n) else ():
                size = int(n[rows[0]])
                spot = where[size]
                k = np.searchsorted(spot["rank"], rank[rows], "right") - 1
                inner = rank[rows] - spot["rank"][k]
                sequence[rows] = spot["window"][k] + inner // spot["take"][k]
                offset[rows] = spot["offset"][k] + inner % spot["take"][k] * size
            table = table.drop_columns(["__rank"]).append_column("sequence_id", pa.array(sequence))
            yield from table.append_column("offset", pa.array(offset)).to_batches()

    return ranked.mapInArrow(look_up, schema)


def token_pieces(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text",
                 capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Token ids of each text with ``end_id`` after them, cut into pieces of at most ``capacity`` ids.

    One row per piece: the id, ``start``, ``length``, ``ids_crc32`` (of the ids
    as little-endian unsigned 32-bit integers), ``doc_tokens`` and, if asked
    for, the ``ids`` themselves. A null or empty text is the end id alone.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(vocab_path))
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
              ("doc_tokens", pa.int64()), *([("ids", pa.binary())] if with_ids else [])]
    arrow = pa.schema(fields)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids

    def run(stream):
        end = np.array([end_id], "<u4").tobytes()
        for table, ids, off in encode_batches(shared.value, stream, "text"):
            raw = ids.astype("<u4").tobytes()
            rows = []
            for doc, lo, hi in zip(table.column("doc_id").to_pylist(), off[:-1].tolist(), off[1:].tolist()):
                blob, n = raw[4 * lo:4 * hi] + end, hi - lo + 1
                for at in range(0, n, capacity):
                    part = blob[4 * at:4 * (at + capacity)]
                    rows.append((doc, at, len(part) // 4, zlib.crc32(part), n, *([part] if with_ids else [])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)],
                                                 schema=arrow)

    return docs.mapInArrow(run, schema)


def sequences(packed: DataFrame, pad_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """The packed windows: one row per sequence with its ``ids``, padded to ``capacity`` unless a power of two long.

    ``packed`` is ``pack`` of pieces that kept their ids.
    """
    joined = packed.groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").alias("n_tokens"))
    power = F.log2(F.col("n_tokens")) == F.floor(F.log2(F.col("n_tokens")))
    pad = F.when(power, 0).otherwise(capacity - F.col("n_tokens")).cast("int")
    ids = F.expr("aggregate(parts, cast('' as binary), (a, p) -> concat(a, p.ids))")
    padding = F.expr(f"unhex(repeat('{int(pad_id).to_bytes(4, 'little').hex()}', {capacity}))")
    return joined.select("sequence_id", "n_tokens", pad.alias("n_padding"),
                         F.concat(ids, F.substring(padding, F.lit(1), 4 * pad)).alias("ids"))
