"""Source divergence audit: how far the term shares of each source lie from other sources and from its language.

Terms are runs of ASCII letters and characters beyond ASCII, only A-Z lower-cased.
Tasks count them by length-bucketed packing: terms of at most 16 bytes are one or
two uint64 words, radix-sorted and run-counted in numpy; longer ones go through
byte-sorted buckets. What a task has counted travels as compressed runs, dealt by
a hash of (language, term), and is merged in the same way. A hot source or term is
one entry per task and bucket, never a row per occurrence.

All shares are exact integers: p = 1 + floor(10^9 (count + 1) / (N + V)), N being the
group's occurrences of kept terms and V the language's number of kept terms.

Defined cases: a null text, language or source is ''; every row is a document of its
own, whatever its id; a group without terms has counts of 0; a language without kept
terms has pair values of 0 and no term rows; an empty table gives no rows; other
columns are not read. Counts may reach 9e15.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import LOWER, block_count, mix, one_array, slices, text_bytes, to_payload
from .checkpoints import stored
from .packed_terms import SHORT, heads, long_numbers, pack, radix_order, runs_of, strings, totals, unpack

LETTERS = np.ones(256, bool)
LETTERS[:0x80] = False
LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = True
PART_BYTES = 4 << 20
HELD_ROWS = 1_000_000
SCALE_STEPS = 3  # 10^9 = 1000^3
MATRIX_CELLS = 4_000_000
COUNTED = "bucket int, payload binary"
KEPT = "lang string, term string, sources array<string>, counts array<bigint>"


class _Counts:
    """Counts of (group, term) in one task; groups are (language, source), numbered as they come."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.clear()

    def clear(self):
        self.groups: dict[tuple[str, str], int] = {}
        self.short, self.long, self.rows = [], [], 0

    def numbers(self, langs: list[str], sources: list[str]) -> np.ndarray:
        known = self.groups
        return np.fromiter((known.setdefault(g, len(known)) for g in zip(langs, sources)), np.int64, len(langs))

    def add(self, raw: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> None:
        starts, size, doc = runs_of(LETTERS[raw], offsets)
        raw = LOWER[raw]
        short = size <= SHORT
        at = np.flatnonzero(short)
        if len(at):
            first, second = pack(raw, starts[at], size[at])
            own, of = group[doc[at]], doc[at]
            order = radix_order(own, first, second)  # stable: a term's rows stay in document order
            own, first, second, of = own[order], first[order], second[order], of[order]
            head = heads(own, first, second)
            docs = (head | heads(own, of)).astype(np.int64)
            self.short.append((own[head], first[head], second[head], totals(np.ones(len(own), np.int64), head), totals(docs, head)))
            self.rows += int(head.sum())
        at = np.flatnonzero(~short)
        if len(at):
            data = raw.tobytes()
            terms, place = long_numbers([data[s:s + n] for s, n in zip(starts[at].tolist(), size[at].tolist())])
            own, of = group[doc[at]], doc[at]
            order = radix_order(own, place)
            own, place, of = own[order], place[order], of[order]
            head = heads(own, place)
            docs = (head | heads(own, of)).astype(np.int64)
            self.long.append((own[head], [terms[i] for i in place[head]], totals(np.ones(len(own), np.int64), head), totals(docs, head)))
            self.rows += int(head.sum())

    def compact(self) -> None:
        """Adds up what several parts have counted."""
        if len(self.short) > 1:
            own, first, second, n, df = (np.concatenate(x) for x in zip(*self.short))
            order = radix_order(own, first, second)
            own, first, second = own[order], first[order], second[order]
            head = heads(own, first, second)
            self.short = [(own[head], first[head], second[head], totals(n[order], head), totals(df[order], head))]
        if len(self.long) > 1:
            terms, place = long_numbers([t for x in self.long for t in x[1]])
            own, n, df = (np.concatenate([x[k] for x in self.long]) for k in (0, 2, 3))
            order = radix_order(own, place)
            own, place = own[order], place[order]
            head = heads(own, place)
            self.long = [(own[head], [terms[i] for i in place[head]], totals(n[order], head), totals(df[order], head))]
        self.rows = sum(len(x[0]) for x in self.short + self.long)

    def rows_by_bucket(self):
        """(bucket, payload) of everything counted so far."""
        self.compact()
        langs, sources = (pa.array([g[k] for g in self.groups], pa.string()) for k in (0, 1))
        seeds = np.array([zlib.crc32(g[0].encode()) for g in self.groups], np.uint64)
        none = np.zeros(0, np.int64)
        own, first, second, n, df = self.short[0] if self.short else (none, none.astype(np.uint64), none.astype(np.uint64), none, none)
        l_own, l_terms, l_n, l_df = self.long[0] if self.long else (none, [], none, none)
        with np.errstate(over="ignore"):
            key = mix(mix(first) + second + seeds[own]) if len(own) else first
            l_key = mix(np.array([zlib.crc32(t) for t in l_terms], np.uint64) + seeds[l_own]) if len(l_own) else np.zeros(0, np.uint64)
        bucket = (np.concatenate([key, l_key]) % np.uint64(self.buckets)).astype(np.int64)
        order = radix_order(bucket)
        own = np.concatenate([own, l_own])
        table = pa.table({
            "lang": pa.DictionaryArray.from_arrays(pa.array(own.astype(np.int32)), langs).cast(pa.string()).dictionary_encode(),
            "source": pa.DictionaryArray.from_arrays(pa.array(own.astype(np.int32)), sources).cast(pa.string()).dictionary_encode(),
            "first": pa.array(np.concatenate([first, np.zeros(len(l_own), np.uint64)])),
            "second": pa.array(np.concatenate([second, np.zeros(len(l_own), np.uint64)])),
            "term": pa.concat_arrays([pa.nulls(len(first), pa.large_binary()), pa.array(l_terms, pa.large_binary())]),
            "n": pa.array(np.concatenate([n, l_n])), "df": pa.array(np.concatenate([df, l_df])),
        }).take(pa.array(order))
        bucket = bucket[order]
        at = np.append(np.flatnonzero(heads(bucket)), len(bucket)) if len(bucket) else [0]
        for lo, hi in zip(at[:-1], at[1:]):
            yield int(bucket[lo]), to_payload(table.slice(lo, hi - lo))
        self.clear()


def _counted(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, payload): what each task has counted of (language, source, term), as sorted compressed runs."""

    def count(batches):
        held = _Counts(buckets)
        for batch in batches:
            for part, _ in slices(pa.Table.from_batches([batch]), PART_BYTES):
                raw, offsets = text_bytes(part.column("text"))
                group = held.numbers(part.column("lang").to_pylist(), part.column("source").to_pylist())
                held.add(raw, offsets, group)
                if held.rows > HELD_ROWS:
                    held.compact()
                    if held.rows > HELD_ROWS // 2:
                        yield from emit(held)
        yield from emit(held)

    def emit(held):
        for bucket, payload in held.rows_by_bucket():
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([payload], pa.binary())], names=["bucket", "payload"])

    return docs.mapInArrow(count, COUNTED)


def term_counts(docs: DataFrame, min_docs: int = 3) -> DataFrame:
    """(lang, term, sources, counts): of each language the terms in at least ``min_docs`` of its documents,
    with the sources that have them and their occurrences there."""

    def merge(rows):
        table = pa.concat_tables([pa.ipc.open_stream(p.as_buffer()).read_all() for p in rows.column("payload")]).unify_dictionaries().combine_chunks()
        lang, source = one_array(table.column("lang")), one_array(table.column("source"))
        l_code, s_code = (a.indices.to_numpy().astype(np.int64) for a in (lang, source))
        n, df = (table.column(c).to_numpy() for c in ("n", "df"))
        term = one_array(table.column("term"))
        is_long = term.is_valid().to_numpy(zero_copy_only=False)
        first, second = (table.column(c).to_numpy() for c in ("first", "second"))
        out = []
        for long in (False, True):
            at = np.flatnonzero(is_long == long)
            if not len(at):
                continue
            if long:
                names, key = long_numbers(term.take(pa.array(at)).to_pylist())
                words = (key.astype(np.uint64),)
            else:
                words = (first[at], second[at])
            order = radix_order(l_code[at], *words, s_code[at])
            words = [w[order] for w in words]
            by_lang, by_source = l_code[at][order], s_code[at][order]
            head = heads(by_lang, *words)
            pair = head | heads(by_source)
            kept = totals(df[at][order], head) >= min_docs
            counts, of = totals(n[at][order], pair), np.cumsum(head)[pair] - 1  # of: the term that a count belongs to
            mine = kept[of]
            ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=int(head.sum()))[kept])]).astype(np.int32)
            tops = [w[head][kept] for w in words]
            text = pa.array([names[int(i)].decode() for i in tops[0]], pa.string()) if long else strings(*unpack(*tops)).cast(pa.string())
            out.append(pa.table([
                lang.dictionary.take(pa.array(by_lang[head][kept])), text,
                pa.ListArray.from_arrays(pa.array(ends), source.dictionary.take(pa.array(by_source[pair][mine]))),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(counts[mine]))], names=["lang", "term", "sources", "counts"]))
        return pa.concat_tables(out)

    docs = _named(docs)
    counted = _counted(docs, block_count(docs, "text"))
    return counted.groupBy("bucket").applyInArrow(merge, KEPT)


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")])


def _share(count: Column, total: Column) -> Column:
    """1 + floor(10^9 (count + 1) / total), for count < total, digit by digit in base 1000 so that nothing overflows."""
    rest, out = count + 1, F.lit(0).cast("long")
    for _ in range(SCALE_STEPS):
        wide = rest * 1000
        rest = wide % total
        out = out * 1000 + F.call_function("div", wide, total)
    return out + 1


def _shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """As ``_share``, of arrays."""
    rest, out = count + 1, 0
    for _ in range(SCALE_STEPS):
        wide = rest * 1000
        out = out * 1000 + wide // total
        rest = wide % total
    return (out + 1).astype(np.int64)


def _pair_sums(kept: DataFrame, langs: DataFrame) -> DataFrame:
    """(lang, source, item, value): per ordered pair of a language's sources the sum of f over all kept terms."""

    def add_up(batches):
        held: dict[str, tuple[list[str], np.ndarray]] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            code = one_array(table.column("lang")).dictionary_encode()
            for k, lang in enumerate(code.dictionary.to_pylist()):
                own = table.filter(pa.compute.equal(code.indices, k)).combine_chunks()
                members = own.column("groups")[0].as_py()
                names = [m["source"] for m in members]
                place = {s: i for i, s in enumerate(names)}
                total = np.array([m["n"] for m in members], np.int64) + int(own.column("terms")[0].as_py())
                sums = held[lang][1] if lang in held else np.zeros((len(names), len(names)), np.int64)
                lists, numbers = one_array(own.column("sources")), one_array(own.column("counts"))
                seen = lists.flatten().dictionary_encode()
                column = np.array([place[s] for s in seen.dictionary.to_pylist()], np.int64)[seen.indices.to_numpy()]
                row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
                value = numbers.flatten().to_numpy()
                step = max(1, MATRIX_CELLS // (4 * len(names)))
                for lo in range(0, len(lists), step):
                    a, b = np.searchsorted(row, [lo, lo + step])
                    count = np.zeros((min(step, len(lists) - lo), len(names)), np.int64)
                    count[row[a:b] - lo, column[a:b]] = value[a:b]
                    p = _shares(count, total).T.copy()
                    for i in range(len(names)):
                        gap = p[i] - p
                        gap *= gap
                        gap //= p
                        sums[i] += gap.sum(axis=1)
                if len(names) ** 2 > MATRIX_CELLS:
                    yield from rows(lang, names, sums)
                else:
                    held[lang] = (names, sums)
        for lang, (names, sums) in held.items():
            yield from rows(lang, names, sums)

    def rows(lang, names, sums):
        every = pa.array(names, pa.string())
        for i, name in enumerate(names):
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(names), pa.string()), pa.array([name] * len(names), pa.string()),
                                              every, pa.array(sums[i])], names=["lang", "source", "item", "value"])

    parts = kept.select("lang", "sources", "counts").join(langs.select("lang", "terms", "groups"), "lang")
    return (parts.mapInArrow(add_up, "lang string, source string, item string, value bigint")
            .groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))


def divergence(docs: DataFrame, min_docs: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank) for every occurring (lang, source).

    Part ``pair``: each other source of the language with the sum over kept terms of
    floor((p - q)^2 / q), all ranks. Part ``term``: the ``top`` terms that the group has more
    often than its language. Ranks by value descending, then item in byte order.
    """
    kept = stored(term_counts(docs, min_docs))
    counts = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).select("lang", F.col("x.sources").alias("source"), F.col("x.counts").alias("count"))
    terms = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    groups = stored(_named(docs).select("lang", "source").distinct()
                    .join(counts.groupBy("lang", "source").agg(F.sum("count").alias("n")), ["lang", "source"], "left")
                    .join(terms, "lang", "left")
                    .select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("terms", F.lit(0)).alias("terms")))
    langs = groups.groupBy("lang").agg(F.first("terms").alias("terms"), F.sum("n").alias("n"),
                                       F.sort_array(F.collect_list(F.struct("source", "n"))).alias("groups"))
    of_pairs = (langs.select("lang", F.explode("groups.source").alias("source"), "groups")
                .select("lang", "source", F.explode("groups.source").alias("item")).where(F.col("source") != F.col("item"))
                .join(_pair_sums(kept, langs), ["lang", "source", "item"], "left")
                .select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value")))
    p = _share(F.col("count"), F.col("n") + F.col("terms"))
    q = _share(F.col("all"), F.col("all_n") + F.col("terms"))
    of_terms = (kept.select("lang", "term", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("all"),
                            F.explode(F.arrays_zip("sources", "counts")).alias("x"))
                .select("lang", "term", "all", F.col("x.sources").alias("source"), F.col("x.counts").alias("count"))
                .join(groups, ["lang", "source"]).join(langs.select("lang", F.col("n").alias("all_n")), "lang")
                .select("lang", "source", "term", p.alias("p"), q.alias("q")).where("p > q")
                .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                        F.call_function("div", (F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("q")).alias("value")))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [x.withColumn("rank", F.row_number().over(best)) for x in (of_pairs, of_terms)]
    return ranked[0].unionByName(ranked[1].where(F.col("rank") <= top))
