"""Periodic runs of words: harmonic grid with longest common extensions.

For each period ``p`` the words at ``0, p, 2p, ...`` are looked at. A run of period ``p`` that is at least ``times * p`` long
holds ``times`` neighbours of that grid, which are then equal words; where such a chain begins, the longest common extension
forwards from ``jp`` and ``(j + 1)p``, and backwards from the words before them, gives the run's both ends. Extensions are
minima over ranges of the neighbours' common prefixes in a suffix array, and in that of the words in reverse.

Texts are independent of each other: the work is one pass over the rows without a shuffle. Within a task short texts are
worked on together; a text longer than ``BATCH_BYTES`` is worked on alone, in memory linear in its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_views, freeing, slices, text_of

#: Bytes of text worked on together, and grid pairs looked at together; neither changes a result.
BATCH_BYTES = 4 << 20
PAIRS = 1 << 20


def suffix_array(symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order and each one's place, by prefix doubling. ``ends`` has for each position the end of its sequence;
    no symbol occurs in two sequences. Only suffixes that are still level with another are sorted again."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    head = np.r_[True, symbols[order][1:] != symbols[order][:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    step = 1
    while len(level := np.flatnonzero(~(head & np.r_[head[1:], True]))):
        at = order[level]
        further = at + step
        second = np.where(further < ends[at], rank[np.minimum(further, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + second
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        fresh = np.r_[True, key[1:] != key[:-1]]
        order[level], head[level] = at, fresh
        rank[at] = np.maximum.accumulate(np.where(fresh, level, 0))
        step *= 2
    return order, rank


def common_prefixes(symbols: np.ndarray, starts: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Of each suffix in order, the words it shares with the one before it.

    In the order of the text such a length is one less than that of the position before, unless the words before the two
    suffixes differ. Only those others, whose lengths sum to 2 n log n at most, are counted word by word.
    """
    n = len(symbols)
    place = np.arange(n)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    first = np.zeros(n, bool)
    first[starts] = True
    own = first | (before < 0) | first[before] | (symbols[place - 1] != symbols[before - 1])
    total = np.zeros(n, np.int64)
    width = 8
    padded = np.r_[symbols, np.full(4096, -1, symbols.dtype)]
    for lo in range(0, n, 1 << 18):
        i = lo + np.flatnonzero((own & (before >= 0))[lo : lo + (1 << 18)])
        j = before[i]
        while len(i):
            width = int(min(4096, max(8, (1 << 20) // len(i))))
            span = total[i][:, None] + np.arange(width)
            # a suffix that ends meets the next sequence's symbols or the padding, which are in no other place of its own
            same = padded[np.minimum(i[:, None] + span, n)] == padded[np.minimum(j[:, None] + span, n)]
            same &= np.maximum(i, j)[:, None] + span < n
            whole = same.all(axis=1)
            total[i] += np.where(whole, width, np.argmin(same, axis=1))
            i, j = i[whole], j[whole]
    anchor = np.maximum.accumulate(np.where(own, place, 0))
    return np.maximum(total[anchor] + anchor - place, 0)[order]


class RangeMinimum:
    """Minima over ranges in linear memory: a sparse table over blocks, running minima inside them."""

    BLOCK = 16

    def __init__(self, values: np.ndarray):
        b = self.BLOCK
        self.values = np.r_[values, np.full(-len(values) % b, np.iinfo(np.int64).max)].astype(np.int64)
        blocks = self.values.reshape(-1, b)
        self.head = np.minimum.accumulate(blocks, axis=1).ravel()
        self.tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [blocks.min(axis=1)]
        while len(t := self.table[-1]) > (h := 1 << (len(self.table) - 1)):
            self.table.append(np.minimum(t[:-h], t[h:]))

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The least of ``values[lo..hi]``, both ends included."""
        b = self.BLOCK
        out = np.minimum(self.tail[lo], self.head[hi])
        left, right = lo // b + 1, hi // b - 1
        for k, table in enumerate(self.table):
            on = np.flatnonzero((right >= left) & (right - left + 1 >= 1 << k) & (right - left + 1 < 2 << k))
            out[on] = np.minimum(out[on], np.minimum(table[left[on]], table[right[on] - (1 << k) + 1]))
        on = np.flatnonzero(lo // b == hi // b)
        if len(on):
            least = self.values[lo[on]]
            for t in range(1, b):
                least = np.where(lo[on] + t <= hi[on], np.minimum(least, self.values[np.minimum(lo[on] + t, hi[on])]), least)
            out[on] = least
        return out


class Extensions:
    """Longest common extensions of two positions of one sequence."""

    def __init__(self, symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        order, self.rank = suffix_array(symbols, np.repeat(starts + sizes, sizes))
        self.least = RangeMinimum(common_prefixes(symbols, starts, order))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.rank[i], self.rank[j]
        return self.least(np.minimum(a, b) + 1, np.maximum(a, b))


def grid(symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray, least: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sequence, place and period of all grid points that begin a chain of ``times`` equal ones."""
    most = np.where(sizes >= least, sizes // times, 0)
    seq = np.repeat(np.arange(len(sizes)), most)
    period = np.arange(len(seq)) - np.repeat(np.cumsum(most) - most, most) + 1
    points = (sizes[seq] - 1) // np.maximum(period, 1) - (times - 2)
    done = np.cumsum(points)
    lo = 0
    while lo < len(seq):
        hi = max(lo + 1, int(np.searchsorted(done, done[lo] + PAIRS)))
        count = points[lo:hi]
        p, s = np.repeat(period[lo:hi], count), np.repeat(seq[lo:hi], count)
        at = starts[s] + (np.arange(len(p)) - np.repeat(np.cumsum(count) - count, count)) * p
        for k in range(1, times):
            on = np.flatnonzero(symbols[at] == symbols[at + k * p])
            at, p, s = at[on], p[on], s[on]
        if len(at):
            yield s, at, p
        lo = hi


def runs(symbols: np.ndarray, sizes: np.ndarray, least: int = 6, times: int = 4) -> np.ndarray:
    """``sequence, start, length, period`` of all maximal runs of at least ``least`` symbols and ``times`` periods, by sequence,
    start and period. ``symbols`` has the sequences one after another, ``sizes`` their lengths. ``times`` is 3 or more: of
    two periods of one stretch that long, the smaller divides the larger."""
    if times < 3:
        raise ValueError("times must be 3 or more")
    starts = np.cumsum(sizes) - sizes
    seqs = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.unique(s) for s, _, _ in grid(symbols, starts, sizes, least, times))]))
    if not len(seqs):
        return np.zeros((0, 4), np.int64)
    # only sequences with a chain go on; a symbol is made its sequence's own
    size = sizes[seqs]
    start = np.cumsum(size) - size
    at = np.repeat(starts[seqs] - start, size) + np.arange(int(size.sum()))
    text = symbols[at] + np.repeat(np.arange(len(seqs)), size) * (int(symbols.max()) + 1)
    n = len(text)
    forward = Extensions(text, start, size)
    back = Extensions(text[::-1].copy(), (n - start - size)[::-1].copy(), size[::-1].copy())
    found = [np.zeros((0, 4), np.int64)]
    for s, i, p in grid(text, start, size, least, times):
        # points that follow each other at one period are mostly of one run: the first is asked for, then what lies beyond
        # its run, and in the end all that is left
        chain = np.cumsum(np.r_[True, (s[1:] != s[:-1]) | (p[1:] != p[:-1]) | (i[1:] != i[:-1] + p[1:])]) - 1
        end = np.zeros(int(chain[-1]) + 1, np.int64)
        for last in (False, False, True):
            on = np.flatnonzero(i + p >= end[chain])
            s, i, p, chain = s[on], i[on], p[on], chain[on]
            at = slice(None) if last else np.flatnonzero(np.r_[True, chain[1:] != chain[:-1]][: len(chain)])
            t, j, q = s[at], i[at], p[at]
            after = forward(j, j + q)
            ahead = np.zeros(len(j), np.int64)
            on = np.flatnonzero(j > start[t])
            ahead[on] = back(n - j[on], n - j[on] - q[on])
            # two places of a sequence have their own words before them, so an extension stays inside it
            length = q + after + ahead
            end[chain[at]] = j + q + after
            on = np.flatnonzero(length >= np.maximum(least, times * q))
            found.append(np.unique(np.stack([t[on], j[on] - ahead[on] - start[t[on]], length[on], q[on]], axis=1), axis=0))
    every = np.unique(np.concatenate(found), axis=0)
    # equal stretches differ in their period: the smallest comes first
    every = every[np.r_[True, (every[1:, :3] != every[:-1, :3]).any(axis=1)]] if len(every) else every
    every = every[np.lexsort((every[:, 3], every[:, 1], every[:, 0]))]
    every[:, 0] = seqs[every[:, 0]]
    return every


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """``id, n_words, runs, collapsed`` of every row: its maximal runs of words ``[^\\x20\\x09-\\x0D]+``, and the text with each
    run cut down to its first period.

    A run is a stretch of consecutive words with smallest period ``q`` and a length of at least ``max(least, times * q)`` that
    no neighbouring word extends; ``runs`` has ``start`` (from 0), ``length`` and ``period`` in words, by start, then period.
    ``collapsed`` has the words that are in no run, or in its first ``period`` words for every run they are in, joined by one
    space. A null or empty text has no words, no runs and an empty ``collapsed``; repeated rows and null ids come out as they
    came in; other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, _ = byte_views(batch.column(1))
            for lo, hi in slices(off, BATCH_BYTES):
                yield _found(batch.slice(lo, hi - lo), least, times)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).mapInArrow(freeing(run), schema)


def _found(rows: pa.RecordBatch, least: int, times: int) -> pa.RecordBatch:
    texts = [t.split() for t in rows.column(1).to_pylist()]  # of bytes: at ASCII white space
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    words = pa.array([w for t in texts for w in t], pa.binary())
    found = runs(words.dictionary_encode().indices.to_numpy().astype(np.int64), sizes, least, times) if len(words) else np.zeros((0, 4), np.int64)
    starts = np.cumsum(sizes) - sizes
    # words behind the first period of a run: ends are marked and summed up
    marks = np.zeros(len(words) + 1, np.int64)
    at = starts[found[:, 0]] + found[:, 1]
    np.add.at(marks, at + found[:, 3], 1)
    np.add.at(marks, at + found[:, 2], -1)
    stays = np.cumsum(marks[:-1]) == 0
    kept = []
    for i, t in enumerate(texts):
        s = stays[starts[i] : starts[i] + sizes[i]]
        kept.append(b" ".join(t if s.all() else [t[k] for k in np.flatnonzero(s)]))
    ends = np.searchsorted(found[:, 0], np.arange(len(texts) + 1)).astype(np.int32)
    each = pa.StructArray.from_arrays([pa.array(found[:, k]) for k in (1, 2, 3)], ["start", "length", "period"])
    return pa.RecordBatch.from_arrays(
        [rows.column(0), pa.array(sizes), pa.ListArray.from_arrays(pa.array(ends), each), pa.array(kept, pa.binary()).cast(pa.string())],
        ["id", "n_words", "runs", "collapsed"],
    )


def plant(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with runs planted in about a tenth of them, by the CRC-32 of their decimal id: from word ``a`` on, the
    ``p`` words there are repeated to the end. Others, those without an id among them, keep their text."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    planned = docs.withColumn("__w", F.when(h % 10 == 0, F.regexp_extract_all(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+"), 0)))
    n, g = F.size("__w").cast("long"), F.floor(h / 10).cast("long")
    a = F.expr("g % n")
    planned = planned.withColumns({"n": n, "g": g}).withColumn("a", F.when(F.col("n") > 0, a))
    planned = planned.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    turns = F.expr("flatten(array_repeat(slice(__w, int(a + 1), int(p)), int((n - a) div p + 1)))")
    made = F.array_join(F.concat(F.expr("slice(__w, 1, int(a))"), F.slice(turns, F.lit(1), (F.col("n") - F.col("a")).cast("int"))), " ")
    return planned.select(F.col(id_col), F.when(F.col("n") > 0, made).otherwise(F.col(text_col)).alias(text_col))
