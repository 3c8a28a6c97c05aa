"""Name normalisation and hashing expressions (native, no Python UDFs)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from giftlens.functions.cleaning import WHITESPACE

# Regex class of the characters str.split() splits on.
_WS_RE = "[" + "".join(re.escape(c) if c not in "\\]^-" else "\\" + c for c in WHITESPACE) + "]+"


def capitalize(c: Column) -> Column:
    """First character upper-case, the rest lower-case (str.capitalize)."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def split_ws(c: Column) -> Column:
    """str.split(): whitespace runs, no empty parts."""
    return F.filter(F.split(c, _WS_RE), lambda x: x != "")


def normalize_name(c: Column) -> Column:
    """Strip; hyphenated -> capitalise each non-empty hyphen part; else
    capitalise each whitespace-separated word. Null stays null."""
    s = F.btrim(c, F.lit(WHITESPACE))
    hy = F.array_join(F.transform(F.filter(F.split(s, "-"), lambda x: x != ""), capitalize), "-")
    words = F.array_join(F.transform(split_ws(s), capitalize), " ")
    return F.when(c.isNull(), c).when(s == "", s).when(s.contains("-"), hy).otherwise(words)


def first_name(c: Column) -> Column:
    """First whitespace token of the normalised name (hyphenated kept whole);
    the normalised name itself when it has no token."""
    n = normalize_name(c)
    return F.coalesce(F.try_element_at(split_ws(n), F.lit(1)), n)


def md5_mod(text: Column, m: int = 100) -> Column:
    """int(md5(text), 16) % m. The 128-bit digest is read as four 32-bit
    chunks c0..c3 (each fits a long) and reduced with the weights 2^(32k) mod m."""
    h = F.md5(text)
    chunks = [F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    weights = [pow(2, 96, m), pow(2, 64, m), pow(2, 32, m), 1]
    total = None
    for ch, w in zip(chunks, weights):
        term = (ch % m) * w
        total = term if total is None else total + term
    return total % m
