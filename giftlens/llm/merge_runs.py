"""Front-coded sorted runs and their merge by a loser tree that knows common prefixes."""

from __future__ import annotations

import numpy as np


def front_code(rows: np.ndarray) -> tuple[np.ndarray, bytes]:
    """(common prefix with the string before, the rest end to end) of sorted strings of one width (n x width bytes)."""
    n, width = rows.shape
    lcp = np.zeros(n, np.int64)
    if n > 1:
        differ = rows[1:] != rows[:-1]
        lcp[1:] = np.where(differ.any(1), differ.argmax(1), width)
    keep = np.arange(width)[None, :] >= lcp[:, None]
    return lcp.astype(np.uint16), rows[keep].tobytes()


class Run:
    """Reads a front-coded run string by string."""

    __slots__ = ("lcps", "tails", "width", "at", "k", "text")

    def __init__(self, lcps: list[int], tails: bytes, width: int):
        self.lcps, self.tails, self.width = lcps, tails, width
        self.at, self.k, self.text = 0, -1, b""

    def advance(self) -> int:
        """Moves to the next string; its common prefix with the one before, -1 at the end."""
        self.k += 1
        if self.k == len(self.lcps):
            return -1
        h = self.lcps[self.k]
        size = self.width - h
        self.text = self.text[:h] + self.tails[self.at:self.at + size]
        self.at += size
        return h


def common_prefix(a: bytes, b: bytes, start: int, width: int) -> int:
    """Length of the common prefix of two strings that agree up to ``start``."""
    step = 16
    while start < width:
        x, y = a[start:start + step], b[start:start + step]
        if x != y:
            bits = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
            return start + len(x) - (bits.bit_length() + 7) // 8
        start += step
        step *= 2
    return width


def merge(runs: list[Run], width: int):
    """(run, its string's number, common prefix with the string before it) of all strings in order.

    Every run's head carries the length of its common prefix with the last
    string that left the tree. The longer one wins without a look at its
    characters; only heads that tie compare, from that length on, and the loser
    keeps the new length. No known prefix is compared again.
    """
    size = 1
    while size < len(runs):
        size *= 2
    h = [run.advance() for run in runs] + [-1] * (size - len(runs))
    loser = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); a run that has ended loses."""
        x, y = h[a], h[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        if x < 0:
            return a, b
        s, t = runs[a].text, runs[b].text
        n = common_prefix(s, t, x, width)
        if n == width or s[n] < t[n]:
            h[b] = n
            return a, b
        h[a] = n
        return b, a

    winners = list(range(size))
    level = size
    while level > 1:
        level //= 2
        after = []
        for k in range(level):
            win, lose = play(winners[2 * k], winners[2 * k + 1])
            loser[level + k] = lose
            after.append(win)
        winners = after
    top = winners[0]
    while h[top] >= 0:
        run = runs[top]
        yield top, run.k, h[top]
        h[top] = run.advance()
        node = (top + size) // 2
        while node:
            other = loser[node]
            x, y = h[top], h[other]
            if y > x:
                loser[node], top = top, other
            elif x == y and x >= 0:
                win, lose = play(top, other)
                loser[node], top = lose, win
            node //= 2


def repeated(runs: list[Run], width: int, several: list[np.ndarray]) -> list[np.ndarray]:
    """For each run the numbers of its strings that another run holds too, or that its run holds several times."""
    out: list[list[int]] = [[] for _ in runs]
    before, open_ = (-1, -1), False
    for run, k, h in merge(runs, width):
        same = h == width and before[0] >= 0
        if same and not open_:
            out[before[0]].append(before[1])
        if same or several[run][k]:
            out[run].append(k)
        open_ = same or bool(several[run][k])
        before = (run, k)
    return [np.array(x, np.int64) for x in out]
