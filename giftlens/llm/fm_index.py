"""FM-index of a delimited vocabulary, read from either end, for searches that allow one error.

Each direction keeps the Burrows-Wheeler transform of the words, every word ended by a
delimiter smaller than all symbols. A pattern is a suffix-rank interval; one symbol
more is one rank look-up at each end of the interval. Equal suffixes of different
words keep the words' order, so a word that is matched from delimiter to delimiter
is told by its rank alone. All queries step together, as numpy arrays.
"""

from __future__ import annotations

import numpy as np

_ROW = np.int64(40)  # bits of a row number in a (symbol, row) key
QUERIES_AT_ONCE = 20_000


def _ranks(symbols: np.ndarray, left: np.ndarray, longest: int) -> np.ndarray:
    """Rank of the suffix at each place by its symbols up to the delimiter (``left`` symbols on); equal ones share a rank."""
    n, bits = len(symbols), max(1, int(symbols.max(initial=0)).bit_length())
    held = 63 // bits
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(held, np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(held):
        key = (key << bits) | np.where(left >= j, padded[j:j + n], 0)
    rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
    while held <= longest:
        ahead = np.zeros(n, np.int64)
        inside = np.flatnonzero(left >= held)
        ahead[inside] = rank[inside + held]
        rank = np.unique(rank * (n + 1) + ahead, return_inverse=True)[1].astype(np.int64)
        held *= 2
    return rank


class Direction:
    """Words (distinct, ascending) whose patterns grow from the last symbol to the first."""

    def __init__(self, symbols: np.ndarray, size: np.ndarray):
        """``symbols``: all words one behind another, from 1; ``size``: symbols per word."""
        self.words, self.size = len(size), size.astype(np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size + 1)[:-1]]).astype(np.int64)
        n = int(self.size.sum()) + self.words
        self.text = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[self.start + self.size] = False
        self.text[inside] = symbols
        left = np.repeat(self.start + self.size, self.size + 1) - np.arange(n)
        rows = np.argsort(_ranks(self.text, left, int(self.size.max(initial=0))), kind="stable")
        before = np.concatenate([[0], self.text])[rows]  # a word's first symbol has the delimiter before it
        by_symbol = np.argsort(before, kind="stable")
        self.before, self.keys = before, (before[by_symbol] << _ROW) | by_symbol
        self.up = np.empty(n, np.int64)  # row of the suffix that is one symbol longer
        self.up[by_symbol] = np.arange(n)
        self.last = np.full(n, -1, np.int64)  # the row before with the same symbol
        same = np.flatnonzero(before[by_symbol][1:] == before[by_symbol][:-1])
        self.last[by_symbol[same + 1]] = by_symbol[same]
        self.symbols = np.unique(before[before > 0])

    def longer(self, symbol, row):
        """Rank of ``symbol`` in front of the suffixes before ``row``: an end of the longer pattern's interval."""
        return np.searchsorted(self.keys, (symbol << _ROW) | row)

    def _replaced(self, state: np.ndarray, lo: np.ndarray, hi: np.ndarray, but: np.ndarray):
        """(state, lo, hi) of each interval with every other symbol that stands in front of it."""
        width, out = hi - lo, []
        narrow = np.flatnonzero(width <= len(self.symbols))
        if len(narrow):
            w = width[narrow]
            of = np.repeat(narrow, w)
            row = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w) + lo[of]
            symbol = self.before[row]
            new = (self.last[row] < lo[of]) & (symbol != but[of]) & (symbol > 0)
            of, row, symbol = of[new], row[new], symbol[new]
            out.append((state[of], self.up[row], self.longer(symbol, hi[of])))
        wide = np.flatnonzero(width > len(self.symbols))
        if len(wide):
            of, symbol = np.repeat(wide, len(self.symbols)), np.tile(self.symbols, len(wide))
            other = symbol != but[of]
            of, symbol = of[other], symbol[other]
            a, b = self.longer(symbol, lo[of]), self.longer(symbol, hi[of])
            some = b > a
            out.append((state[of][some], a[some], b[some]))
        return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 3

    def one_error(self, word: np.ndarray, exact: np.ndarray, tail: np.ndarray, run_is_ahead: bool):
        """(query, found word, whether a symbol was deleted): words equal to the query's but for one symbol of it
        replaced or deleted. ``exact`` symbols from the end and ``tail`` at the front must match. Of a run of equal
        symbols only one is deleted: the last to be read if ``run_is_ahead``, else the first."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))]
        for k in range(0, len(word), QUERIES_AT_ONCE):
            part = slice(k, k + QUERIES_AT_ONCE)
            for q, w, deleted in self._search(word[part], exact[part], tail[part], run_is_ahead):
                found.append((q + k, w, deleted))
        return [np.concatenate(x) for x in zip(*found)]

    def _search(self, word, exact, tail, run_is_ahead):
        size, start = self.size[word], self.start[word]
        q = np.arange(len(word))
        lo, hi = np.zeros(len(word), np.int64), np.full(len(word), self.words, np.int64)
        none = np.zeros(0, np.int64)
        spent = [none, none, none, none.astype(bool)]  # query, lo, hi, deleted: the error is behind
        for t in range(int(size.max(initial=0)) + 1):
            more = []
            open_ = t < size[q] - tail[q]
            q, lo, hi = q[open_], lo[open_], hi[open_]
            if len(q):
                at = start[q] + size[q] - 1 - t
                symbol = self.text[at]
                may = np.flatnonzero(t >= exact[q])
                if len(may):
                    if run_is_ahead:
                        first = (size[q[may]] - 1 == t) | (self.text[at[may] - 1] != symbol[may])
                    else:
                        first = (t == 0) | (self.text[at[may] + 1] != symbol[may])
                    d = may[first]
                    more.append((q[d], lo[d], hi[d], np.ones(len(d), bool)))
                    of, a, b = self._replaced(q[may], lo[may], hi[may], symbol[may])
                    more.append((of, a, b, np.zeros(len(of), bool)))
                lo, hi = self.longer(symbol, lo), self.longer(symbol, hi)
                some = hi > lo
                q, lo, hi = q[some], lo[some], hi[some]
            s_q, s_lo, s_hi, s_deleted = spent
            ended = size[s_q] == t
            if ended.any():
                e = np.flatnonzero(ended)
                a, b = self.longer(np.int64(0), s_lo[e]), self.longer(np.int64(0), s_hi[e])
                hit = b > a
                yield s_q[e][hit], a[hit], s_deleted[e][hit]
            on = np.flatnonzero(~ended)
            if len(on):
                s_q = s_q[on]
                symbol = self.text[start[s_q] + size[s_q] - 1 - t]
                a, b = self.longer(symbol, s_lo[on]), self.longer(symbol, s_hi[on])
                some = b > a
                more.append((s_q[some], a[some], b[some], s_deleted[on][some]))
            spent = [np.concatenate(x) for x in zip(*more)] if more else [none, none, none, none.astype(bool)]
        if len(spent[0]):
            a, b = self.longer(np.int64(0), spent[1]), self.longer(np.int64(0), spent[2])
            hit = b > a
            yield spent[0][hit], a[hit], spent[3][hit]


class Vocabulary:
    """Both directions of a set of words."""

    def __init__(self, words: list[str]):
        """``words``: distinct, ascending by code points."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        size = np.fromiter(map(len, words), np.int64, len(words))
        symbols = np.unique(codes, return_inverse=True)[1].astype(np.int64) + 1
        self.ahead = Direction(symbols, size)
        backward = [w[::-1] for w in words]
        self.order = np.array(sorted(range(len(words)), key=backward.__getitem__), np.int64)
        ends = np.cumsum(size)
        turned = size[self.order]
        at = np.repeat(ends[self.order] - 1, turned) - (np.arange(int(size.sum())) - np.repeat(np.cumsum(turned) - turned, turned))
        self.back = Direction(symbols[at] if len(at) else symbols, turned)
        self.place = np.empty(len(words), np.int64)
        self.place[self.order] = np.arange(len(words))

    def near(self, word: np.ndarray, prefix: np.ndarray, suffix: np.ndarray):
        """(query, word, deleted): for each query the words that keep its first ``prefix`` and last ``suffix`` symbols
        and differ by one symbol of the query between them, replaced or deleted; every such word once per query."""
        out = []
        from_start = np.flatnonzero(prefix > 0)
        q, w, d = self.back.one_error(self.place[word[from_start]], prefix[from_start], suffix[from_start], False)
        out.append((from_start[q], self.order[w], d))
        from_end = np.flatnonzero(prefix == 0)
        q, w, d = self.ahead.one_error(word[from_end], suffix[from_end], prefix[from_end], True)
        out.append((from_end[q], w, d))
        return [np.concatenate(x) for x in zip(*out)]
