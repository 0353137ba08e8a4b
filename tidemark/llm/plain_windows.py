"""The windows of line_dedup over texts in hand, which tests hold its expressions against; no query runs this."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pandas.util import hash_array

KEY_BITS, MOST_WORDS, MARKS = 56, 127, ".!?,;:"
GAPS = rf"\n+|\x20(?<=[{MARKS}]\x20)(?![\x20\n])"
TO_SPACES = bytes.maketrans(b"\t\r\x0b\f\n", b" " * 5)
#: A document's lines with words, and its windows from the first line on; an odd number mixes the hashes of a window's lines.
COLUMNS = "_id long, _mark long, hashes array<long>, places array<int>, fingerprints array<long>, keys array<long>, offs array<int>, ns array<int>, nexts array<int>"
MIX = np.uint64(0x9E3779B97F4A7C15)


def bare_lines(text: bytes) -> list[bytes]:
    """The lines of a lower-case text as they are compared, as many as ``lines_of`` gives and maybe an empty one more: without outer white space, any of inner a space."""
    if b"\0" in text:
        parts = [x.translate(TO_SPACES) for x in re.split(GAPS.encode(), text)]
    else:
        for mark in MARKS.encode():
            text = text.replace(b"%c " % mark, b"%c \0" % mark)
        text = text.replace(b"\0 ", b" ").replace(b"\n", b"\n\0").replace(b"\0\n", b"\n")
        parts = text.translate(TO_SPACES).split(b"\0")
    return [x.strip(b" ") for x in parts]


def windows_of(ids: pa.Array, marks: pa.Array, texts: list[bytes], min_words: int) -> pa.RecordBatch:
    """The windows of lower-case texts (COLUMNS); texts without a window are left out.

    A window is the shortest run of lines from one on that has enough words.  A text's last
    lines have none, so those with one come first.
    """
    parts = [bare_lines(x) for x in texts]
    sizes = np.array([len(x) for x in parts], np.int64)
    parts = [x for own in parts for x in own]
    words = np.array([x.count(b" ") + 1 if x else 0 for x in parts], np.int64)
    hashes = np.empty(len(parts), object)
    hashes[:] = parts
    hashes = hash_array(hashes, categorize=False)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    place = (np.arange(len(doc)) - (np.cumsum(sizes) - sizes)[doc]).astype(np.int32)
    some = words > 0
    doc, place, hashes, words = doc[some], place[some], hashes[some], words[some]
    lines = np.bincount(doc, minlength=len(sizes))
    summed = np.concatenate([[0], np.cumsum(words)])
    end = np.searchsorted(summed, summed[:-1] + max(1, min_words))
    at = np.flatnonzero(end <= np.cumsum(lines)[doc])
    n, own = end[at] - at, doc[at]
    keys = ((MOST_WORDS - np.minimum(words, MOST_WORDS)) << KEY_BITS) + (hashes & np.uint64((1 << KEY_BITS) - 1)).astype(np.int64)
    found, key, off = n.astype(np.uint64), keys[at], np.zeros(len(at), np.int32)
    left, k = np.arange(len(at)), 0
    while len(left):  # line k of all windows that have one
        line = at[left] + k
        mixed = (found[left] ^ hashes[line]) * MIX
        found[left] = mixed ^ (mixed >> np.uint64(32))
        less = keys[line] < key[left]
        key[left[less]], off[left[less]] = keys[line[less]], k
        k += 1
        left = left[n[left] > k]
    windows = np.bincount(own, minlength=len(sizes))
    last = np.ones(len(n), bool)
    last[:-1] = own[1:] != own[:-1]
    following = pa.array(np.roll(n, -1).astype(np.int32), mask=last)
    laid = lambda values, sizes: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values if isinstance(values, pa.Array) else pa.array(values))
    of_lines = [laid(x, lines) for x in (hashes.view(np.int64), place)]
    of_windows = [laid(x, windows) for x in (found.view(np.int64), key, off, n.astype(np.int32), following)]
    out = pa.RecordBatch.from_arrays([ids, marks, *of_lines, *of_windows], names=[c.split()[0] for c in COLUMNS.split(", ")])
    return out.filter(pa.array(windows > 0))
