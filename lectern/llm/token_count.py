"""Token counts by heap-and-linked-list byte-pair merging.

A word's symbols form a linked list; a heap holds its adjacent pairs by merge rank. The lowest-ranked pair is merged
again and again, and the count is the initial symbols less the merges: no identifier is ever made.
"""

from __future__ import annotations

import functools
import heapq
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import WordTable, byte_views, distinct_words, freeing, regroup, slices, text_of


class Merger:
    """Counts tokens of words under the merge list of a ``tokenizers`` BPE file."""

    def __init__(self, path: str, held: int = 1_000_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("ignore_merges") or model.get("dropout") or model.get("continuing_subword_prefix"):
            raise ValueError("only plain byte-level BPE is counted")
        # splitting a text into words is the library's; merging and counting them is done here
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        whole = Tokenizer.from_file(path)
        self.normal = whole.normalizer.normalize_str if whole.normalizer else str
        self.pieces = whole.pre_tokenizer.pre_tokenize_str
        # added tokens are single tokens wherever they stand in a text
        self.added = re.compile("|".join(sorted((re.escape(a["content"]) for a in spec["added_tokens"]), key=len, reverse=True)) or r"(?!)")
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab = model["vocab"]
        self.ranks: dict[tuple[str, str], int] = {tuple(m): i for i, m in enumerate(model["merges"])}
        self.known = WordTable(held, lambda new: [self.of_word(w).to_bytes(4, "little") for w in new])

    def initial(self, piece: str) -> list[str]:
        """A piece's first symbols: its characters, the last with the word's end."""
        out = list(piece)
        out[-1] += self.suffix
        return [s for s in out if s in self.vocab]  # without an unknown token, a symbol outside the vocabulary gives none

    def merges(self, symbols: list[str]) -> int:
        """How many merges the symbols undergo."""
        n, ranks, done = len(symbols), self.ranks, 0
        after, before, now = [*range(1, n), -1], list(range(-1, n - 1)), list(symbols)
        heap = [(r, i, now[i] + now[i + 1]) for i in range(n - 1) if (r := ranks.get((now[i], now[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, merged = heapq.heappop(heap)
            j = after[i] if now[i] else -1
            if j < 0 or now[i] + now[j] != merged or (now[i], now[j]) not in ranks:
                continue  # one of the two has been merged since
            now[i], now[j] = merged, ""
            done += 1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a in (before[i], i):
                b = after[a] if a >= 0 else -1
                if b >= 0 and (r := ranks.get((now[a], now[b]))) is not None:
                    heapq.heappush(heap, (r, a, now[a] + now[b]))
        return done

    def of_word(self, text: str) -> int:
        """Tokens of a run of text without ASCII white space."""
        total = at = 0
        for m in [*self.added.finditer(text), None]:
            part = text[at : m.start() if m else len(text)]
            for piece, _ in self.pieces(self.normal(part)) if part else ():
                symbols = self.initial(piece)
                total += len(symbols) - self.merges(symbols)
            if m:
                total, at = total + 1, m.end()
        return total

    def of(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text: its pieces never cross white space, so each distinct word is merged once."""
        codes, words, off = distinct_words(texts)
        at, _, counts = self.known.rows(words)
        return np.diff(np.r_[0, np.cumsum(counts[at][codes], dtype=np.int64)][off])


@functools.lru_cache(maxsize=1)
def worker_merger(path: str) -> Merger:
    """A worker's own: the words it has met serve its later tasks."""
    return Merger(path)


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """``id, n_bytes, n_tokens, over_limit`` of every row, counted over its whole text.

    ``vocabulary`` is the path of a ``tokenizers`` BPE file on every machine; no begin, end or other token is added, and the
    file's own special strings inside a text are one token each. Null text is empty: no byte, no token. Rows that repeat
    or have no id are counted like any other; an empty table gives no row.
    """

    def run(batches):
        m = worker_merger(vocabulary)
        for b in regroup(batches):
            off, _ = byte_views(b.column(1))
            n = np.concatenate([m.of(b.column(1).slice(i, j - i)) for i, j in slices(off, 8 << 20)] or [np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(off)), pa.array(n), pa.array(n > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).mapInArrow(freeing(run), "id long, n_bytes long, n_tokens long, over_limit boolean")
