"""BPE encoding and decoding with a pair occurrence index.

The distinct words of a part of a partition stand in one symbol array. An index
maps each active pair (one that has a rank) to all its positions; a heap holds
the active ranks. The lowest rank is applied to all its positions at once, and
the pairs that its merges create join the lists of their ranks. Since a pair
with a new symbol always ranks after the merge that made the symbol (checked
when the vocabulary is read), this gives every word the result of merging it
alone. Texts are then lookups of their words.
"""

from __future__ import annotations

import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import one_array

#: Text taken together, and distinct words remembered, before results go out.
FLUSH_CHARS = 4 << 20
MAX_WORDS = 300_000

# ---- FIXED VALUES: word pattern and byte alphabet of the vocabulary's pre-tokenizer ----
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
PRINTABLE = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
#: Letters and digits that Unicode 16 added (the vocabulary's tokenizer knows them, Python 3.13 does not).
ADDED = [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D65),
         (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E),
         (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x116D0, 0x116E3),
         (0x11BC0, 0x11BE0), (0x11BF0, 0x11BF9), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
         (0x16D70, 0x16D79), (0x18CFF, 0x18CFF), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5FA)]
# ---- end of fixed values ----


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next free one from U+0100."""
    out, free = [""] * 256, 256
    for b in range(256):
        if b in PRINTABLE:
            out[b] = chr(b)
        else:
            out[b] = chr(free)
            free += 1
    return out


class Vocabulary:
    """Merge table and symbols of a word-end BPE vocabulary file (``tokenizers`` JSON)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*ids.values(), *self.special.values()]))
        for t, i in [*ids.items(), *self.special.items()]:
            self.tokens[i] = t
        alphabet = byte_alphabet()
        self.byte_ids = np.array([ids[c] for c in alphabet], np.int32)
        self.last_ids = np.array([ids[c + end] for c in alphabet], np.int32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([ids[a] for a, _ in merges], np.int64)
        right = np.array([ids[b] for _, b in merges], np.int64)
        self.merged = np.array([ids[a + b] for a, b in merges], np.int32)
        self.left, self.right = left, right
        self.base = len(self.tokens)
        keys = left * self.base + right
        self.rank_order = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys = keys[self.rank_order]
        made = np.full(self.base, -1, np.int64)
        made[self.merged] = np.arange(len(merges))
        at = np.arange(len(merges))
        if not ((made[left] < at) & (made[right] < at)).all():
            raise ValueError("a merge comes before the merge that makes its part")

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, -1 where it has none."""
        if len(a) > 1 << 18:
            return np.concatenate([self.ranks(a[k:k + (1 << 18)], b[k:k + (1 << 18)]) for k in range(0, len(a), 1 << 18)])
        key = a.astype(np.int64) * self.base + b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.rank_order[at], np.int32(-1))


def merge_words(vocab: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words, offsets): every word's BPE symbols."""
    size = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(size)
    raw = np.frombuffer(b"".join(words), np.uint8)
    n = len(raw)
    if not n:
        return np.zeros(0, np.int32), np.zeros(len(words) + 1, np.int64)
    sym = vocab.byte_ids[raw]
    sym[ends[size > 0] - 1] = vocab.last_ids[raw[ends[size > 0] - 1]]
    # linked lists; -1 ends a word. A position that was merged away has symbol -1.
    nxt = np.arange(1, n + 1, dtype=np.int32)
    nxt[ends[size > 0] - 1] = -1
    prv = np.arange(-1, n - 1, dtype=np.int32)
    prv[(ends - size)[size > 0]] = -1
    first = np.flatnonzero(nxt >= 0).astype(np.int32)
    rank = vocab.ranks(sym[first], sym[first + 1])
    first, rank = first[rank >= 0], rank[rank >= 0]
    order = np.argsort(rank, kind="stable")
    first, rank = first[order], rank[order]
    cut = np.flatnonzero(np.append(True, rank[1:] != rank[:-1])) if len(rank) else np.zeros(0, np.int64)
    index = {int(rank[lo]): [first[lo:hi]] for lo, hi in zip(cut, np.append(cut[1:], len(rank)))}
    active = list(index)
    heapq.heapify(active)
    left, right, merged = vocab.left, vocab.right, vocab.merged
    while active:
        r = heapq.heappop(active)
        lists = index.pop(r)
        at = lists[0] if len(lists) == 1 else np.sort(np.concatenate(lists))
        a, b, c = left[r], right[r], merged[r]
        after = nxt[at]
        good = (sym[at] == a) & (after >= 0)
        good &= sym[after] == b
        at, after = at[good], after[good]
        if not len(at):
            continue
        if a == b:  # of overlapping places take the first, then every other one
            linked = np.append(False, after[:-1] == at[1:])
            begin = np.maximum.accumulate(np.where(linked, 0, np.arange(len(at))))
            take = (np.arange(len(at)) - begin) % 2 == 0
            at, after = at[take], after[take]
        sym[at] = c
        sym[after] = -1
        far = nxt[after]
        nxt[at] = far
        has = far >= 0
        prv[far[has]] = at[has]
        near = prv[at]
        made = np.concatenate([at[has], near[near >= 0]])
        if not len(made):
            continue
        new = vocab.ranks(sym[made], sym[nxt[made]])
        keep = new >= 0
        new, made = new[keep], made[keep]
        if not len(new):
            continue
        order = np.argsort(new, kind="stable")
        new, made = new[order], made[order]
        cut = [0, *(np.flatnonzero(new[1:] != new[:-1]) + 1).tolist(), len(new)]
        for lo, hi in zip(cut, cut[1:]):
            k = int(new[lo])
            if k in index:
                index[k].append(made[lo:hi])
            else:
                index[k] = [np.unique(made[lo:hi])]
                heapq.heappush(active, k)
    alive = sym >= 0
    total = np.concatenate([[0], np.cumsum(alive, dtype=np.int32)])
    return sym[alive], total[np.concatenate([[0], ends])]


_WORD = regex.compile(WORD_PATTERN)
_SPACE = regex.compile(r"[\t-\r \x85\xa0  -     　]+")
_SIGMA = {ord("Σ"): "σ"}


def spaced_parts(text: str) -> list[str]:
    """The parts between white space of a text, composed (NFC) and in lower case."""
    if not text.isascii():
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if "Σ" in text:  # lower case by character: no final form
            text = text.translate(_SIGMA)
    text = text.lower()
    if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
        return [p for p in _SPACE.split(text) if p]
    return text.split()


def unassigned(c: str) -> bool:
    return unicodedata.category(c) == "Cn" and not any(lo <= ord(c) <= hi for lo, hi in ADDED)


def words_of(part: str) -> list[str]:
    """The words of a part by the pattern; code points that Unicode 16 leaves unassigned are no letters."""
    if max(part) > "\u0557":
        plain = "".join("\ue000" if c > "\u0557" and unassigned(c) else c for c in part)
        return [part[m.start():m.end()] for m in _WORD.finditer(plain)]
    return _WORD.findall(part)


class Codes(dict):
    """Numbers for keys in the order of their first use; ``new`` lists those numbered since it was cleared."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, key):
        self.new.append(key)
        self[key] = code = len(self)
        return code


class Encoder:
    """Encodes texts part by part; parts that were seen are looked up."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.special = regex.compile("(" + "|".join(map(regex.escape, vocab.special)) + ")") if vocab.special else None
        self.reset()

    def reset(self):
        self.known = Codes()
        self.ids = np.array(list(self.vocab.special.values()), np.int32)
        self.sizes = np.ones(len(self.ids), np.int64)
        for token in self.vocab.special:  # no part looks like this: it holds white space
            self.known[" " + token]
        self.known.new.clear()

    def parts(self, text: str) -> list[str]:
        if self.special is None or "<|" not in text:
            return spaced_parts(text)
        out = []
        for k, piece in enumerate(self.special.split(text)):
            out += [" " + piece] if k % 2 else spaced_parts(piece)
        return out

    def learn(self) -> None:
        """Merges the words of all new parts by one run over their pair index."""
        new = self.known.new
        if not new:
            return
        words, seq, count = Codes(), [], []
        for p in new:
            if p.isascii() and p.isalpha():
                seq.append(words[p])
                count.append(1)
            else:
                found = words_of(p)
                seq.extend(map(words.__getitem__, found))
                count.append(len(found))
        ids, off = merge_words(self.vocab, [w.encode("utf-8", "surrogatepass") for w in words])
        flat, size = gather(ids, off, np.array(seq, np.int64))
        count = np.array(count, np.int64)
        total = np.concatenate([[0], np.cumsum(size)])
        ends = np.cumsum(count)
        self.ids = np.concatenate([self.ids, flat])
        self.sizes = np.concatenate([self.sizes, total[ends] - total[ends - count]])
        new.clear()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets)."""
        if len(self.known) > MAX_WORDS:
            self.reset()
        look = self.known.__getitem__
        codes = [np.fromiter(map(look, self.parts(t)), np.int32) for t in texts]
        self.learn()
        n = np.array([len(c) for c in codes], np.int64)
        off = np.concatenate([[0], np.cumsum(self.sizes)])
        flat, size = gather(self.ids, off, np.concatenate(codes) if codes else np.zeros(0, np.int32))
        total = np.concatenate([[0], np.cumsum(size)])
        return flat, total[np.concatenate([[0], np.cumsum(n)])]


def gather(values: np.ndarray, offsets: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices of ``values`` that ``picks`` name, end to end, and their sizes."""
    size = np.diff(offsets)[picks]
    ends = np.cumsum(size)
    if not len(size) or not ends[-1]:
        return values[:0], size
    at = np.repeat((offsets[:-1][picks] - ends + size).astype(np.int32 if len(values) < 2**30 and ends[-1] < 2**30 else np.int64), size)
    at += np.arange(ends[-1], dtype=at.dtype)
    return values[at], size


def batches_of(stream, chars: int = FLUSH_CHARS):
    """Arrow tables of whole rows with about ``chars`` bytes each."""
    held, size = [], 0
    for batch in stream:
        step = max(1, min(batch.num_rows, int(batch.num_rows * chars / max(1, batch.nbytes))))
        for lo in range(0, batch.num_rows, step):
            part = batch.slice(lo, step)
            held.append(part)
            size += part.nbytes
            if size >= chars:
                yield pa.Table.from_batches(held)
                held, size = [], 0
                pa.default_memory_pool().release_unused()
    if held:
        yield pa.Table.from_batches(held)


def encode_batches(vocab: Vocabulary, stream, text_col: str):
    """(table, ids, offsets) of each part of a stream of Arrow batches; null texts are empty."""
    encoder = Encoder(vocab)
    for table in batches_of(stream):
        texts = table.column(text_col).to_pylist()
        ids, off = encoder.encode([t or "" for t in texts])
        del texts
        yield table, ids, off


def encode(docs: DataFrame, vocab_path: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """Every row with its token ids in ``out_col``: little-endian unsigned 32-bit integers, end to end.

    Ids are those of the vocabulary's own tokenizer without added special
    tokens; their strings inside a text count as the special tokens. Null and
    empty texts have no ids. All columns stay (one named ``out_col`` is replaced);
    rows may repeat. An empty table gives an empty result.
    """
    docs = docs.drop(out_col)
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(vocab_path))
    schema = docs.withColumn(out_col, F.lit(b"")).schema

    def run(stream):
        for table, ids, off in encode_batches(shared.value, stream, text_col):
            col = pa.Array.from_buffers(pa.binary(), len(off) - 1, [
                None, pa.py_buffer((4 * off).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
            yield from table.append_column(out_col, col).to_batches()

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, vocab_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Every row with the text of its ids: their tokens joined by one space (the vocabulary has no other decoder).

    Null ids give an empty text; an id outside the vocabulary is left out.
    """
    encoded = encoded.drop(out_col)
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary(vocab_path).tokens)
    schema = encoded.withColumn(out_col, F.lit("")).schema

    def run(stream):
        token = dict(enumerate(shared.value)).__getitem__
        top = len(shared.value)
        for table in batches_of(stream, FLUSH_CHARS // 4):
            out = []
            for blob in one_array(table.column(ids_col)):
                ids = np.frombuffer(blob.as_buffer(), "<u4") if blob.is_valid else np.zeros(0, np.uint32)
                out.append(" ".join(map(token, ids[ids < top].tolist())))
            yield from table.append_column(out_col, pa.array(out, pa.string())).to_batches()

    return encoded.mapInArrow(run, schema)
