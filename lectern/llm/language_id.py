"""Language identification by prediction by partial matching (PPM).

For each language a tree of byte contexts up to three bytes long is counted on a bounded sample of labelled texts and
then frozen. A byte is coded by its longest known context; escapes (method C, with exclusions) lead to shorter ones, at
last to the uniform code. All code lengths are worked out once into a table for each language (context node x byte), so the
exact code length of a whole text is a few table look-ups a byte and language.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_views, freeing, materialize, slices, text_of

#: Documented bounds of the training sample: documents per language, and how many bytes of a longer text are drawn.
SAMPLE_DOCS, SAMPLE_BYTES = 300, 32_768


@dataclass
class Tree:
    """One language's contexts, numbered: 0 none, then one byte, two bytes, three bytes. ``node2[x * classes + y]`` and
    ``node3[node of two * classes + z]`` are the longest known context, ``bits[node * classes + class]`` the code lengths."""

    node2: np.ndarray
    node3: np.ndarray
    bits: np.ndarray


@dataclass
class Model:
    """``byte_class``: 256 -> class (0: never seen in any language), and a tree for each language."""

    langs: list[str]
    byte_class: np.ndarray
    trees: list[Tree]

    @property
    def classes(self) -> int:
        return int(self.byte_class.max()) + 1


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, allowed, docs_per_lang: int = SAMPLE_DOCS, longest: int = SAMPLE_BYTES) -> DataFrame:
    """At most ``docs_per_lang`` labelled documents of each language, picked by a hash of id and text: the same on every run.
    Of a text beyond ``longest`` bytes a slice of that size is drawn, which begins where the hash says.

    Only hashes are ranked. The few texts are fetched by a join with them, and rows of one hash come once, so the sample is
    bounded however often an id or a row is repeated; null ids take part.
    """
    key = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))
    fits = F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & allowed
    keys = docs.where(fits).select(F.col(lang_col).alias("lang"), key.alias("k"))
    # of a large language only a thin slice by the hash is ranked, some times what is wanted
    n = materialize(keys.groupBy("lang").agg(F.approx_count_distinct("k").alias("n")))
    top = (F.least(F.lit(1.0), F.lit(8.0 * docs_per_lang) / F.col("n")) * 2 - 1) * 2.0**63
    thin = keys.join(n, "lang").where(F.col("k").cast("double") <= top).select("lang", "k").distinct()
    w = Window.partitionBy("lang").orderBy("k")
    picked = thin.withColumn("n", F.row_number().over(w)).where(F.col("n") <= docs_per_lang).select("lang", "k")
    text = text_of(text_col)
    begin = F.pmod(key, F.greatest(F.lit(1), F.length(text) - longest + 1)).cast("int") + 1
    found = docs.where(fits).select(F.col(lang_col).alias("lang"), key.alias("k"), F.substr(text, begin, F.lit(longest)).alias("text"))
    few = F.broadcast(picked)  # at most docs_per_lang rows a language
    return found.join(few, ["lang", "k"]).groupBy("lang", "k").agg(F.min("text").alias("text"))


def _grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the (order + 1)-grams of bytes, and their counts."""
    keys = []
    for t in texts:
        a = np.frombuffer(t, np.uint8).astype(np.int64)
        if len(a) > order:
            k = np.zeros(len(a) - order, np.int64)
            for i in range(order + 1):
                k = (k << 8) | a[i : len(a) - order + i]
            keys.append(k)
    return np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def fit(samples: dict[str, list[bytes]], least: int = 2, most_nodes: int = 8192) -> Model:
    """Count the trees and freeze them. Each language has its own contexts: those of three bytes seen ``least`` times or more
    in its own sample, the ``most_nodes`` most frequent of them, and a quarter as many of two bytes. Of others the shorter
    contexts stand in. At most 14 MB a language, whatever other languages there are."""
    langs = sorted(samples)
    seen = np.zeros(256, bool)
    for ts in samples.values():
        for t in ts:
            seen[np.frombuffer(t, np.uint8)] = True
    byte_class = np.zeros(256, np.int64)
    byte_class[seen] = np.arange(1, seen.sum() + 1)
    return Model(langs, byte_class, [_tree([_grams(samples[x], o) for o in range(4)], byte_class, least, most_nodes) for x in langs])


def _contexts(grams: tuple[np.ndarray, np.ndarray], least: int, most: int) -> np.ndarray:
    """The contexts before the last byte that were seen ``least`` times or more: the ``most`` most frequent, sorted."""
    found, of = np.unique(grams[0] >> 8, return_inverse=True)
    total = np.bincount(of, weights=grams[1], minlength=len(found))
    enough = np.flatnonzero(total >= least)
    return np.sort(found[enough[np.argsort(-total[enough], kind="stable")[:most]]])


def _tree(counts: list[tuple[np.ndarray, np.ndarray]], byte_class: np.ndarray, least: int, most_nodes: int) -> Tree:
    a = int(byte_class.max()) + 1
    two, three = _contexts(counts[2], least, most_nodes // 4), _contexts(counts[3], least, most_nodes)
    three = three[np.isin(three >> 8, two)]  # reached by way of its first two bytes
    byte = lambda k, back: byte_class[(k >> (8 * back)) & 255]
    at2, at3 = a, a + len(two)
    nodes = at3 + len(three)
    node2 = np.tile(np.arange(a, dtype=np.int32), (a, 1))
    node2[byte(two, 1), byte(two, 0)] = at2 + np.arange(len(two))
    last = np.r_[np.arange(a), byte(two, 0)]  # of a context of up to two bytes
    node3 = node2[last]
    node3[node2[byte(three, 2), byte(three, 1)], byte(three, 0)] = at3 + np.arange(len(three))
    parent = np.r_[np.zeros(a, np.int64), byte(two, 0), node2[byte(three, 1), byte(three, 0)]]
    depth = np.repeat([0, 1, 2, 3], [1, a - 1, len(two), len(three)])
    table = np.zeros((nodes, a))
    for order, (k, n) in enumerate(counts):
        context = k >> 8
        if order < 2:
            node, known = byte_class[context] if order else context, np.ones(len(k), bool)
        else:
            kept = two if order == 2 else three
            known = np.isin(context, kept)
            node = np.searchsorted(kept, context) + (at2 if order == 2 else at3)
        np.add.at(table, (node[known], byte_class[k & 255][known]), n[known])
    return Tree(node2.ravel(), node3.ravel(), _code_lengths(table, parent, depth, 256 - (a - 1)).astype(np.float32).ravel())


def _code_lengths(table: np.ndarray, parent: np.ndarray, depth: np.ndarray, unseen_bytes: int) -> np.ndarray:
    """Bits of every class at every node: PPM method C with exclusions. Class 0 stands for each of ``unseen_bytes`` bytes."""
    nodes, a = table.shape
    size = np.ones(a)
    size[0] = unseen_bytes
    out = np.empty((nodes, a))
    for lo in range(0, nodes, 2048):
        rows = np.arange(lo, min(nodes, lo + 2048))
        cost = np.zeros((len(rows), a))
        open_ = np.ones((len(rows), a), bool)  # not yet coded, and not excluded
        at, live = rows.copy(), np.ones(len(rows), bool)
        while live.any():
            here = np.where(open_, table[at], 0.0)
            total, kinds = here.sum(1), (here > 0).sum(1)
            use = live & (kinds > 0)
            with np.errstate(divide="ignore"):
                p = here / np.maximum(total + kinds, 1)[:, None]
                esc = -np.log2(np.where(use, kinds / np.maximum(total + kinds, 1), 1.0))
            coded = use[:, None] & (here > 0)
            cost = np.where(coded, cost - np.log2(np.where(coded, p, 1.0)), np.where(open_, cost + esc[:, None], cost))
            open_ &= ~coded
            live &= depth[at] > 0
            at = np.where(depth[at] > 0, parent[at], 0)
        left = (open_ * size).sum(1)
        cost = np.where(open_, cost + np.log2(np.maximum(left, 1))[:, None], cost)
        out[rows] = cost
    return out


def code_lengths(model: Model, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Exact code length in bits of each whole document ``data[off[i]:off[i+1]]`` under each language."""
    a = model.classes
    c = model.byte_class[data]
    n = len(c)
    pos = np.arange(n) - np.repeat(off[:-1], np.diff(off))  # in its document
    one = np.zeros(n, np.int64)
    one[1:] = c[:-1]
    pairs = c[:-2] * a + c[1:-1]
    out = np.zeros((len(off) - 1, len(model.trees)))
    full = np.flatnonzero(np.diff(off) > 0)
    for k, tree in enumerate(model.trees if len(full) else ()):
        two = np.zeros(n, np.int64)
        two[2:] = tree.node2[pairs]
        three = np.zeros(n, np.int64)
        if n > 3:
            three[3:] = tree.node3[two[2:-1] * a + c[2:-1]]
        node = np.where(pos >= 3, three, np.where(pos == 2, two, np.where(pos == 1, one, 0)))
        out[full, k] = np.add.reduceat(tree.bits[node * a + c], off[:-1][full], dtype=np.float64)
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", allowed=None, docs_per_lang: int = SAMPLE_DOCS, longest: int = SAMPLE_BYTES) -> Model:
    """Fit on :func:`training_sample`; only that bounded sample comes to the driver."""
    sample = training_sample(docs, id_col, text_col, lang_col, F.lit(True) if allowed is None else allowed, docs_per_lang, longest).toPandas()
    sample = sample.sort_values(["lang", "k"], kind="stable")
    return fit({x: [bytes(t) for t in g["text"]] for x, g in sample.groupby("lang")})


def whole_lengths(model: Model, raw: np.ndarray, off: np.ndarray, piece: int = 4 << 20) -> np.ndarray:
    """Code lengths of the documents ``raw[off[i]:off[i+1]]``; a very long one in pieces, each led by the three bytes before it."""
    if off[-1] - off[0] <= piece:
        return code_lengths(model, raw[off[0] : off[-1]], off - off[0])
    found = np.zeros((len(off) - 1, len(model.langs)))
    for k, (s, e) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
        for at in range(s, e, piece):
            lead = min(3, at - s)
            part = raw[at - lead : min(at + piece, e)]
            found[k] += code_lengths(model, part, np.array([0, len(part)]))[0]
            if lead:
                found[k] -= code_lengths(model, part[:lead], np.array([0, lead]))[0]
    return found


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``id, lang_pred, score, bits_per_byte`` of every row, from its whole text alone, and the columns named in ``carry``.

    ``lang_pred`` is the language with the shortest exact code of the whole text (a tie: the first by name), ``und`` if the
    text is null or has no letter, or if nothing was learned. ``score`` is its posterior under equal priors, 0 for ``und``.
    ``bits_per_byte`` is its code length over the text's length, null for an empty text. Repeated rows and null ids are predicted like any other row; an
    empty table gives no row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 14 MB a language, see fit

    def run(batches):
        m = shared.value
        for b in batches:
            off, raw = byte_views(b.column(1))
            letter = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            preds, scores, rates = [], [], []
            for i, j in slices(off, 1 << 20):
                if not m.langs:
                    preds += ["und"] * (j - i)
                    scores += [0.0] * (j - i)
                    rates += [None] * (j - i)
                    continue
                total = whole_lengths(m, raw, off[i : j + 1])
                best = total.argmin(axis=1)
                score = 1 / np.exp2(np.maximum(total.min(axis=1)[:, None] - total, -1000)).sum(axis=1)
                size = np.diff(off[i : j + 1])
                for k in range(j - i):
                    ok = letter[i + k]
                    preds.append(m.langs[best[k]] if ok else "und")
                    scores.append(float(score[k]) if ok else 0.0)
                    rates.append(float(total[k, best[k]] / size[k]) if size[k] else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64()), *b.columns[3:]], ["id", "lang_pred", "score", "bits_per_byte", *carry])

    slim = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letter"), *carry)
    more = "".join(f", {name} {kind}" for name, kind in slim.dtypes[3:])
    return slim.mapInArrow(freeing(run), "id long, lang_pred string, score double, bits_per_byte double" + more)
