"""MinHash near-dedup by fast similarity sketching, banding and exact verification.

1. Equal shingle sets are one class (128-bit fingerprint); only the smallest id
   of a class goes on.
2. Its sketch: in round i every shingle falls into a hashed bin with a hashed
   value; a bin keeps its smallest value of the first round that reached it.
   After ``t`` rounds, round ``t + b`` sends all shingles to bin b, so that every
   coordinate fills. Two sketches agree in a coordinate with the probability of
   the sets' Jaccard similarity, with concentration as for independent ones.
3. Bands of coordinates give bucket keys; buckets tie their members to a hub,
   first inside each task, then across tasks, and the ties' components are
   candidate clusters.
4. Inside a cluster full sets are compared, in cells of bounded size; a cell
   returns a spanning forest of its true links, never its pairs.
5. The components of the true links are the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .checkpoints import written
from .components import components

SHINGLE, PERCENT = 5, 80
#: Bands x rows: a pair with similarity 0.8 shares no band with probability (1 - 0.8**5)**48 < 1e-8.
BANDS, ROWS = 48, 5
CELL = 1024
_BASE = 0xD6E8FEB86659FD93


def shingle_sets(chunk: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): each row's distinct shingles, ascending.

    A shingle is ``size`` consecutive words with A-Z in lower case; fewer words
    are one shingle, no words none.
    """
    raw, off = B.text_bytes(chunk.column("text"))
    words, doc = B.word_hashes(B.LOWER[raw], off)
    h, at = B.window_hashes(words, doc, size, _BASE)
    owner = doc[at]
    count = np.bincount(doc, minlength=chunk.num_rows)
    begin = np.concatenate([[0], np.cumsum(count)])
    few = np.flatnonzero((count > 0) & (count < size))
    if len(few):
        extra = np.empty(len(few), np.uint64)
        with np.errstate(over="ignore"):
            for k, r in enumerate(few):
                one = np.uint64(count[r])
                for w in words[begin[r]:begin[r + 1]]:
                    one = one * np.uint64(_BASE) + w
                extra[k] = one
        h, owner = np.concatenate([h, B.mix(extra, 9)]), np.concatenate([owner, few])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.append(True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])) if len(h) else np.zeros(0, bool)
    h, owner = h[new], owner[new]
    return h, np.searchsorted(owner, np.arange(chunk.num_rows + 1))


def sketches(h: np.ndarray, off: np.ndarray, t: int) -> np.ndarray:
    """The sketch of each set, ``t`` coordinates; an empty set has only blanks."""
    n = len(off) - 1
    out = np.full(n * t, 2**64 - 1, np.uint64)
    size = np.diff(off)
    live = np.flatnonzero(size > 0)
    item, row = h, np.repeat(np.arange(n), size)
    for i in range(2 * t):
        if not len(live):
            break
        v = B.mix(item, 100 + i)
        spot = row * t + ((v & np.uint64(0xFFFFFFFF)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t \
            else row * t + (i - t)
        value = (np.uint64(i) << np.uint64(54)) | (B.mix(v, 1) >> np.uint64(10))
        np.minimum.at(out, spot, value)  # later rounds have larger values: a filled bin stays as it is
        open_rows = (out.reshape(n, t)[live] == np.uint64(2**64 - 1)).any(1)
        if not open_rows.all():
            live = live[open_rows]
            keep = np.zeros(n, bool)
            keep[live] = True
            keep = keep[row]
            item, row = item[keep], row[keep]
    return out.reshape(n, t)


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit bucket key per band."""
    out = np.empty((len(sketch), bands), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(bands):
            key = np.full(len(sketch), b + 1, np.uint64)
            for r in range(rows):
                key = B.mix(key * np.uint64(_BASE) + sketch[:, b * rows + r])
            out[:, b] = key
    return out


def fingerprints(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each set (sums of mixed shingles: order does not matter)."""
    size = np.diff(off)
    out = []
    for seed in (21, 22):
        total = np.concatenate([[np.uint64(0)], np.cumsum(B.mix(h, seed), dtype=np.uint64)])
        with np.errstate(over="ignore"):
            out.append(B.mix(total[off[1:]] - total[off[:-1]] + size.astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def _ties(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of bucket rows: the distinct keys with their smallest id, and each other id tied to it (distinct ties)."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    new = np.append(True, keys[1:] != keys[:-1]) if len(keys) else np.zeros(0, bool)
    hub = ids[np.flatnonzero(new)][np.cumsum(new) - 1]
    tied = ids != hub
    ties = np.unique(np.stack([ids[tied], hub[tied]], 1), axis=0)
    return keys[new], ids[new], ties[:, 0], ties[:, 1]


def link_cell(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links (100 * common >= percent * union) between the sets of two lists of places.

    Equal lists compare a chunk with itself.
    """
    size = np.array([len(s) for s in sets], np.int64)
    every = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    _, local = np.unique(every, return_inverse=True)
    off = np.concatenate([[0], np.cumsum(size)])
    group = np.arange(len(sets))  # labels of the forest so far
    same = len(left) == len(right) and (left == right).all()
    flag = np.zeros(int(local.max()) + 1 if len(local) else 1, bool)
    spans = np.concatenate([local[off[r]:off[r + 1]] for r in right]) if len(right) else local[:0]
    begin = np.concatenate([[0], np.cumsum(size[right])[:-1]]).astype(int) if len(right) else np.zeros(0, int)
    out = []
    for k, a in enumerate(left):
        mine = local[off[a]:off[a + 1]]
        flag[mine] = True
        common = np.add.reduceat(flag[spans].astype(np.int64), begin)
        flag[mine] = False
        near = 100 * common >= percent * (size[a] + size[right] - common)
        if same:
            near[:k + 1] = False
        found = right[near]
        labels = np.unique(group[found])
        labels = labels[labels != group[a]]
        for g in labels:  # one link to each part that was apart until now
            b = found[group[found] == g][0]
            out.append((int(a), int(b)))
            group[group == g] = group[a]
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_shingles``, ``component_id`` (smallest id reachable by links) and ``kept``.

    Two documents are linked if 100 * common shingles >= ``percent`` * all
    shingles of both. No words (null, empty): no shingles, linked with nothing.
    A null id is linked with nothing, has no component and is kept. Rows with
    one id are one document for links; each keeps its own count. An empty table
    gives an empty result; other columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()),
                        ("bands", pa.binary())])

    def sign(stream):
        for batch in stream:
            table = pa.Table.from_batches([batch])
            lo = 0
            ends = np.cumsum(np.maximum(B.lengths(B.one_array(table.column("text"))), 1))
            while lo < table.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + B.CHUNK_BYTES, "right")))
                part = table.slice(lo, hi - lo)
                h, off = shingle_sets(part, shingle)
                f1, f2 = fingerprints(h, off)
                keys = band_keys(sketches(h, off, bands * rows), bands, rows)
                yield pa.RecordBatch.from_arrays(
                    [B.one_array(part.column("doc_id")), pa.array(np.diff(off)), pa.array(f1), pa.array(f2),
                     pa.array([k.tobytes() for k in keys], pa.binary())], schema=signed)
                lo = hi

    signs = written(docs.mapInArrow(sign, "doc_id long, n_shingles long, f1 long, f2 long, bands binary"))
    linkable = signs.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = linkable.groupBy("f1", "f2", "n_shingles").agg(
        F.min("doc_id").alias("rep"), F.min("bands").alias("bands"))  # equal sets have equal bands
    classes = written(classes)

    # candidate ties: a task's own hub per bucket, then the hubs of all tasks
    tie = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("hub", pa.int64())])

    def tie_rows(key, ident, hub):
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(ident, pa.int64()),
                                           pa.array(hub, pa.int64())], schema=tie)

    def tie_inside(stream):
        for batch in stream:
            if batch.num_rows:
                ids = batch.column("rep").to_numpy()
                keys = np.frombuffer(b"".join(batch.column("bands").to_pylist()), np.int64)
                key, hub, a, b = _ties(keys, np.repeat(ids, bands))
                yield tie_rows(key, hub, pa.nulls(len(hub), pa.int64()))
                yield tie_rows(B.mix(a.view(np.uint64)).view(np.int64), a, b)

    def tie_across(stream):
        batches = [b for b in stream if b.num_rows]
        if batches:
            table = pa.Table.from_batches(batches)
            known = table.column("hub").is_valid().to_numpy()
            ids = table.column("id").to_numpy()
            _, _, a, b = _ties(table.column("key").to_numpy()[~known], ids[~known])
            hub = table.column("hub").fill_null(0).to_numpy()[known]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, ids[known]]), pa.int64()),
                                              pa.array(np.concatenate([b, hub]), pa.int64())], names=["a", "b"])

    ties = (classes.select("rep", "bands").mapInArrow(tie_inside, "key long, id long, hub long")
            .repartition("key").mapInArrow(tie_across, "a long, b long"))
    clusters = components(ties, "a", "b").withColumnRenamed("component", "cluster")
    sizes = clusters.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("chunks"))
    clusters = clusters.join(sizes, "cluster").withColumn(
        "chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))

    # full sets of the clusters' members meet in cells (chunk, chunk)
    n = B.block_count(docs, "text")
    packed = B.pack_blocks(docs, "doc_id", ["doc_id", "text"], n)
    wanted = clusters.select(F.pmod(F.xxhash64("node"), F.lit(n)).cast("int").alias("block"), "node", "cluster", "chunks",
                             "chunk")
    cell = pa.schema([("cluster", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("node", pa.int64()),
                      ("chunk", pa.int32()), ("shingles", pa.binary())])

    def send_sets(table, members):
        out = []
        if members.num_rows:
            nodes = members.column("node").to_numpy()
            order = np.argsort(nodes)
            nodes = nodes[order]
            cluster, chunks, chunk = (members.column(c).to_numpy()[order] for c in ("cluster", "chunks", "chunk"))
            for part in B.chunks(table):
                ids = B.ids_of(part.column("doc_id"))
                pick = np.flatnonzero(B.contains(nodes, ids))
                if not len(pick):
                    continue
                h, off = shingle_sets(part.take(pa.array(pick)), shingle)
                at = np.searchsorted(nodes, ids[pick])
                for k, m in enumerate(at):
                    blob, c = h[off[k]:off[k + 1]].tobytes(), int(chunk[m])
                    out += [(int(cluster[m]), min(c, o), max(c, o), int(nodes[m]), c, blob)
                            for o in range(int(chunks[m])) if blob]
        return B.rows_table(out, cell)

    cells = packed.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(
        send_sets, "cluster long, i int, j int, node long, chunk int, shingles binary")
    pair = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(key, table):
        ids, chunk = table.column("node").to_numpy(), table.column("chunk").to_numpy()
        sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in table.column("shingles")]
        i, j = key[1].as_py(), key[2].as_py()
        links = link_cell(sets, np.flatnonzero(chunk == i), np.flatnonzero(chunk == j), percent)
        return B.rows_table([(int(ids[a]), int(ids[b])) for a, b in links], pair)

    links = cells.groupBy("cluster", "i", "j").applyInArrow(compare, "a long, b long")
    member = written(linkable.join(classes.select("f1", "f2", "n_shingles", "rep"), ["f1", "f2", "n_shingles"])
                     .select("doc_id", "rep"))
    # rows with one id may sit in several classes: the id links them
    several = member.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("most")).where("b <> most")
    links = links.unionByName(member.withColumnRenamed("rep", "a").join(several, "doc_id").select("a", "b"))
    found = components(links, "a", "b")
    return (signs.join(member.join(found, F.col("rep") == F.col("node"), "left")
                       .groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("__c")), "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("__c", "doc_id").alias("component_id"))
            .withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))
            .withColumnRenamed("doc_id", id_col))
