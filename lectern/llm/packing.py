"""Packing documents into fixed-length sequences: first-fit decreasing with a tournament tree of bin capacities.

A document longer than a sequence gives full sequences first. What remains of each goes, with the remainders of a
random group of documents, through first-fit decreasing: the tree's root tells whether any bin is roomy enough, and a
descent finds the leftmost such bin in logarithmic time. The fullest bins stay as first-fit made them. The emptiest, no
more of them than it takes, are opened: their documents fill the room that is left in the others, cut where that ends, and
the group's last tokens, under a sequence, go into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordTable, byte_views, distinct_words, freeing, regroup, slices, text_of

LENGTH, GROUP_DOCS, SLACK = 4096, 2048, 8


class Tournament:
    """Free room of bins; every inner node holds the larger of its two, so the leftmost fit is found by a descent."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.tree = [room] * (2 * self.leaves)

    def take(self, size: int) -> int:
        """Put ``size`` into the leftmost bin with that much room, and return the bin."""
        tree, i = self.tree, 1
        while i < self.leaves:
            i *= 2
            if tree[i] < size:
                i += 1
        tree[i] -= size
        found = i - self.leaves
        while i > 1:
            i //= 2
            tree[i] = max(tree[2 * i], tree[2 * i + 1])
        return found


def first_fit_decreasing(sizes: list[int], room: int = LENGTH) -> list[list[int]]:
    """Bins of item numbers. Each size is 1..room; equal sizes keep their order."""
    tree, bins = Tournament(max(1, len(sizes)), room), []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        b = tree.take(sizes[i])
        while b >= len(bins):
            bins.append([])
        bins[b].append(i)
    return bins


def pack_group(sizes: list[int], room: int = LENGTH, slack: int = SLACK) -> list[list[tuple[int, int, int]]]:
    """Sequences of ``(item, start, length)`` that hold every token of every item once.

    The bins of first-fit decreasing stay, fullest first, while the tokens of the others suffice to fill what is left in
    them; room of ``slack`` tokens or fewer is left empty. So sequences come full, or short by ``slack`` or fewer, or, with
    under ``room`` tokens of the group in all, with a power of two of tokens.
    """
    bins = first_fit_decreasing(sizes, room)
    filled = [sum(sizes[i] for i in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda b: (-filled[b], b))
    out, spaces, rest = [], [], sum(filled)  # rest: tokens of the bins to come, less what the gaps so far take of them
    for k, b in enumerate(order):
        gap = room - filled[b] if room - filled[b] > slack else 0
        if rest - filled[b] < gap:
            order = order[k:]
            break
        rest -= filled[b] + gap
        out.append([(i, 0, sizes[i]) for i in bins[b]])
        spaces.append(gap)
    else:
        order = []
    for k in reversed(range(rest.bit_length())):
        if rest >> k & 1:
            out.append([])
            spaces.append(1 << k)
    loose = iter([i for b in order for i in bins[b]])
    item, at = next(loose, None), 0
    for sequence, free in zip(out, spaces):
        while free:
            n = min(free, sizes[item] - at)
            sequence.append((item, at, n))
            at, free = at + n, free - n
            if at == sizes[item]:
                item, at = next(loose, None), 0
    return out


class WordIds:
    """Token ids of whole texts from the library, asked once for each distinct word.

    The vocabulary's pre-tokenizer never crosses white space and drops it, so a text's ids are those of its words in turn.
    """

    def __init__(self, path: str, held: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.cores = Tokenizer.from_file(path), WordTable(held, self._ask), WordTable(held, self._encode)
        self.mark = next((a.content for _, a in sorted(self.tokenizer.get_added_tokens_decoder().items(), reverse=True) if a.special and not (a.lstrip or a.rstrip)), None)
        self.mark_id = self.tokenizer.token_to_id(self.mark) if self.mark else None

    def _ask(self, words: list[str]) -> list[bytes]:
        """A closing mark after a letter is always a piece of its own, and case is dropped: so cores are asked for."""
        cores, tails = [], []
        for w in words:
            tail = ""
            if len(w) > 1 and w[-1] in ",.;:!?" and "A" <= w[-2] < "\u0130" and w[-2].isalpha():
                w, tail = w[:-1], w[-1]
            cores.append(w.lower() if w.isalpha() and max(w) < "\u0130" else w)
            tails.append(tail)
        few = list(dict.fromkeys([*cores, *filter(None, tails)]))
        start, size, pool = self.cores.rows(pa.array(few, pa.string()))
        raw = pool.tobytes()
        ids = {w: raw[4 * s : 4 * (s + n)] for w, s, n in zip(few, start.tolist(), size.tolist())}
        return [ids[c] + ids[t] if t else ids[c] for c, t in zip(cores, tails)]

    def _encode(self, words: list[str], together: int = 64) -> list[bytes]:
        """Several words in one call, held apart by a special token; a word that has it inside goes alone."""
        alone = [w for w in words if not self.mark or self.mark in w]
        found = {w: np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in alone}
        rest = [w for w in words if w not in found]
        for lo in range(0, len(rest), 128 * together):
            parts = [rest[k : k + together] for k in range(lo, min(len(rest), lo + 128 * together), together)]
            for part, e in zip(parts, self.tokenizer.encode_batch_fast([self.mark.join(p) for p in parts], add_special_tokens=False)):
                ids = np.array(e.ids, "<u4")
                at = np.flatnonzero(ids == self.mark_id)
                if len(at) != len(part) - 1:
                    raise ValueError("the vocabulary's special token doesn't hold words apart")
                raw, s = ids.tobytes(), 0
                for w, e_ in zip(part, [*at.tolist(), len(ids)]):
                    found[w] = raw[4 * s : 4 * e_]
                    s = e_ + 1
        return [found[w] for w in words]

    def of(self, texts: pa.Array, block: int = 256) -> Iterator[np.ndarray]:
        """Ids of each text in turn. Words are looked up for all texts at once, ids put together block by block."""
        codes, words, off = distinct_words(texts)
        start, size, pool = self.known.rows(words)
        start, size = start.astype(np.int32), size.astype(np.int32)
        for lo in range(0, len(texts), block):
            bounds = off[lo : lo + block + 1]
            c = codes[bounds[0] : bounds[-1]]
            n = size[c]
            end = np.cumsum(n, dtype=np.int32)
            at = np.repeat(start[c] - (end - n), n)
            at += np.arange(len(at), dtype=np.int32)
            ids, ends = pool[at], np.r_[0, end][bounds - bounds[0]].tolist()
            for s, e in zip(ends, ends[1:]):
                yield ids[s:e]


@functools.lru_cache(maxsize=1)
def worker_ids(path: str, held: int) -> WordIds:
    """A worker's own: the words it has met serve its later tasks."""
    return WordIds(path, held)


def pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", *, end_id: int = 2, length: int = LENGTH, group_docs: int = GROUP_DOCS, slack: int = SLACK, lookup_bytes: int = 16 << 20, held: int = 1_000_000) -> DataFrame:
    """One row per piece: ``id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document is its ids (no special tokens added) and then ``end_id``; null text counts as empty and is that one id. Null
    ids and repeated rows are packed like any other row (a row is not told apart by its id alone, but its pieces are
    complete). An empty table gives no row. ``vocabulary`` is the path of a ``tokenizers`` file on every machine.
    Words are looked up for ``lookup_bytes`` of text at once and some ``held`` of them remembered: more of either takes less
    time and more of a worker's memory, and changes no row.
    """
    groups = max(1, -(-docs.count() // group_docs))
    slim = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))

    def tokenized(batches):
        words, end = worker_ids(vocabulary, held), np.array([end_id], "<u4")
        for b in regroup(batches, lookup_bytes):
            off, _ = byte_views(b.column(1))
            for lo, hi in slices(off, lookup_bytes):
                counts, crcs, rests = [], [], []
                for ids in words.of(b.column(1).slice(lo, hi - lo)):
                    own = np.concatenate([ids, end])
                    if own.max() >= 1 << 16:
                        raise ValueError("ids of 65,536 and more don't fit the two bytes they travel in")
                    full = len(own) // length
                    counts.append(len(own))
                    crcs.append([zlib.crc32(own[k * length : (k + 1) * length]) for k in range(full)])
                    rests.append(own[full * length :].astype("<u2").tobytes())  # ids under 65536 travel as two bytes
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), pa.array(counts, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(rests, pa.binary())], ["id", "pack", "tokens", "crcs", "rest"])

    def packed(group: pa.Table) -> pa.Table:
        group = group.sort_by([("id", "ascending"), ("tokens", "ascending"), ("rest", "ascending")])
        ids, tokens, crcs, rests = (group.column(c).to_pylist() for c in ("id", "tokens", "crcs", "rest"))
        first, rows, seq = group.column("pack")[0].as_py() << 32, [], 0
        for i, t, c in zip(ids, tokens, crcs):
            for k, crc in enumerate(c):
                rows.append((i, k * length, length, crc, t, first + seq, 0))
                seq += 1
        some = [k for k, r in enumerate(rests) if r]
        for s in pack_group([len(rests[k]) // 2 for k in some], length, slack):
            at = 0
            for item, start, n in s:
                k = some[item]
                crc = zlib.crc32(np.frombuffer(rests[k], "<u2")[start : start + n].astype("<u4").tobytes())
                rows.append((ids[k], len(crcs[k]) * length + start, n, crc, tokens[k], first + seq, at))
                at += n
            seq += 1
        cols = list(zip(*rows))
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    keyed = slim.withColumn("pack", F.pmod(F.xxhash64("id", "text"), F.lit(groups)))
    told = keyed.mapInArrow(freeing(tokenized), "id long, pack long, tokens long, crcs array<long>, rest binary")
    return told.groupBy("pack").applyInArrow(packed, "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
