"""The longest entry of a dictionary that each text holds, where some entries do not count in some texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import automaton

#: So many bytes of entries, some three times as many in memory, go to the tasks to be found by hashes; automata, ten to fifty times as many, end sooner.
WINDOW_BYTES = 64 << 20
#: Windows have so many characters at most; longer entries are found by their beginning.
WIDEST = 64
#: So many windows are looked up at once; texts of a batch are joined up to GROUP characters.
STEP, GROUP = 1 << 16, 1 << 21
#: Of a hash modulo 2 ** 64: any odd number serves, as entries found are compared.
BASE, MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)

Settle = Callable[[np.ndarray, np.ndarray], None]


@lru_cache(maxsize=2)
def _powers(base: int) -> np.ndarray:
    out = np.full(STEP + WIDEST, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def _spot(keys: np.ndarray, shift: np.uint64) -> np.ndarray:
    return (keys * MIX >> shift).view(np.int64)


class Automaton:
    """All entries in one pass over a text."""

    def __init__(self, entries: pa.Array):
        self.found = ahocorasick.Automaton()
        for k, entry in enumerate(entries.to_pylist()):
            self.found.add_word(entry, k)
        self.found.make_automaton()

    def hits(self, texts: list[str], length_found: np.ndarray, settle: Settle) -> None:
        who, what = [], []
        for j, text in enumerate(texts):
            own = {k for _, k in self.found.iter(text)}
            who += [j] * len(own)
            what += own
            if len(what) > STEP or j == len(texts) - 1:
                settle(np.array(who, np.int64), np.array(what, np.int64))
                who, what = [], []


class Windows:
    """Entries by hashes of the windows of a text, the longest first: few bytes for an entry, and time that hardly grows with their number."""

    def __init__(self, entries: pa.Array, sizes: np.ndarray):
        self.entries, self.groups = entries, []
        width = np.minimum(sizes, WIDEST)  # entries come longest first
        edges = [0, *(np.flatnonzero(np.diff(width)) + 1), len(width)]
        for low, high in zip(edges, edges[1:], strict=False):
            m = int(width[low])
            codes = _codes("".join(w[:m] for w in self.entries[low:high].to_pylist())).reshape(-1, m)
            keys = np.zeros(high - low, np.uint64)
            for c in range(m):
                keys += codes[:, c].astype(np.uint64) * _powers(BASE)[c]
            order = np.argsort(keys, kind="stable")
            shift = np.uint64(64 - int(16 * len(keys)).bit_length())
            seen = np.zeros(1 << int(64 - shift), bool)  # most windows end here
            seen[_spot(keys, shift)] = True
            self.groups.append((m, shift, seen, keys[order], low + order))

    def hits(self, texts: list[str], length_found: np.ndarray, settle: Settle) -> None:
        """Calls ``settle`` with texts and entries, none shorter than ``length_found`` has for the text, which ``settle`` brings up to date."""
        low = 0
        while low < len(texts):
            high, size = low, 0
            while high < len(texts) and (high == low or size + len(texts[high]) < GROUP):
                size += len(texts[high]) + 1
                high += 1
            self._group(texts, low, high, length_found, settle)
            low = high

    def _group(self, texts: list[str], low: int, high: int, length_found: np.ndarray, settle: Settle) -> None:
        codes = _codes("\0".join(texts[low:high]))
        sizes = np.array([len(t) + 1 for t in texts[low:high]])
        owner = np.repeat(np.arange(low, high), sizes)
        begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
        powers, inverse = _powers(BASE), _powers(pow(BASE, -1, 1 << 64))
        for at in range(0, len(codes), STEP):
            part = codes[at : at + STEP + WIDEST - 1].astype(np.uint64)
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * powers[: len(part)], out=sums[1:])
            mine, live, done = owner[at : at + STEP], None, 0
            for m, shift, seen, keys, ranks in self.groups:
                n = min(len(mine), len(part) - m + 1)
                longer = np.count_nonzero(length_found[mine[0] : mine[-1] + 1] > m)
                if longer > done:  # texts with a longer entry need no more
                    still = np.flatnonzero(length_found.take(mine) <= m) if live is None else live[length_found.take(mine.take(live)) <= m]
                    live, done = still if 2 * len(still) < len(mine) else None, longer
                if n <= 0 or live is not None and not len(live):
                    continue
                if live is None:
                    window = (sums[m : m + n] - sums[:n]) * inverse[:n]
                    maybe = np.flatnonzero(seen.take(_spot(window, shift)))
                    window = window[maybe]
                else:
                    maybe = live[live < n]
                    window = (sums[maybe + m] - sums[maybe]) * inverse[maybe]
                    there = seen.take(_spot(window, shift))
                    maybe, window = maybe[there], window[there]
                first = np.searchsorted(keys, window)
                equal = keys[np.minimum(first, len(keys) - 1)] == window
                maybe, first, window = maybe[equal], first[equal], window[equal]
                if not len(maybe):
                    continue
                many = np.searchsorted(keys, window, "right") - first
                portion = max(1, 16 * STEP // int(many.max()))  # many long entries may begin alike
                for k in range(0, len(maybe), portion):
                    own = many[k : k + portion]
                    place = np.repeat(maybe[k : k + portion] + at, own)
                    rank = ranks[np.repeat(first[k : k + portion] - np.cumsum(own) + own, own) + np.arange(len(place))]
                    who = owner[place]
                    holds = [texts[j].startswith(e, p) for j, e, p in zip(who.tolist(), self.entries.take(pa.array(rank)).to_pylist(), (place - begin[place]).tolist(), strict=True)]
                    settle(who[holds], rank[holds])


class Finder:
    """The first entry in order of a dictionary that counts in a text, else the first that does for a facility."""

    def __init__(self, table: pa.Table, few: bool):
        self.entries = table["entry"].combine_chunks()
        self.sizes, self.broad, self.placelike = (table[n].to_numpy() for n in ("size", "broad", "placelike"))
        self.way = None if not len(self.entries) else Automaton(self.entries) if few else Windows(self.entries, self.sizes)

    def best(self, texts: list[str], no_broad: np.ndarray, no_whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        none, sizes, length_found = len(self.sizes), np.array([len(t) for t in texts], np.int64), np.zeros(len(texts), np.int64)
        named, facility = np.full(len(texts), none), np.full(len(texts), none)

        def settle(who: np.ndarray, rank: np.ndarray) -> None:
            weak = self.broad[rank] & (no_broad[who] | (no_whole[who] & (self.sizes[rank] == sizes[who])))
            np.minimum.at(named, who[~weak], rank[~weak])
            length_found[who[~weak]] = np.minimum(self.sizes[named[who[~weak]]], WIDEST)  # more may begin like it
            weak &= self.placelike[rank]
            np.minimum.at(facility, who[weak], rank[weak])

        if self.way and texts:
            self.way.hits(texts, length_found, settle)
        return np.minimum(named, np.where(named < none, none, facility)), np.where(named < none, 0, 1)


@lru_cache(maxsize=1)
def _finder(sent: Broadcast) -> Finder:
    """Built once in a worker, not once in a task."""
    return Finder(*sent.value)


def sent_to_tasks(entries: DataFrame) -> Broadcast | None:
    """``entries`` (entry, broad, placelike; in lower case and distinct) for ``longest``, or None where they are more than WINDOW_BYTES."""
    size = entries.agg(F.sum(F.octet_length("entry") + 16)).first()[0] or 0
    if size > max(WINDOW_BYTES, automaton.MOST_BYTES):
        return None
    table = entries.select("entry", F.length("entry").cast("long").alias("size"), "broad", "placelike").toArrow()
    table = table.sort_by([("size", "descending"), ("entry", "ascending")])
    return entries.sparkSession.sparkContext.broadcast((table, size <= automaton.MOST_BYTES))


def longest(text: Column, no_broad: Column, no_whole: Column, sent: Broadcast) -> Column:
    """entry and tier, for a text in lower case: the longest entry it holds, the first by letters among equals.

    Tier 0 are entries that count: with ``no_broad`` no broad ones do, with ``no_whole`` none that
    is the whole text; where none counts, tier 1 is the longest place-like one that is there.
    """

    @F.pandas_udf("entry string, tier int")
    def found(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        own = _finder(sent)
        for texts, broad, whole in batches:
            given = texts.notna().to_numpy()
            best, tier = own.best(texts[given].tolist(), *(x[given].to_numpy(bool) for x in (broad, whole)))
            there = best < len(own.sizes)
            entry, tiers = np.full(len(texts), None, object), pd.array([pd.NA] * len(texts), "Int32")
            at = np.flatnonzero(given)[there]
            entry[at] = own.entries.take(pa.array(best[there])).to_pylist()
            tiers[at] = tier[there]
            yield pd.DataFrame({"entry": entry, "tier": tiers})

    return found(text, no_broad, no_whole)
