"""Removal of repeated long word spans by De Bruijn compaction.

Windows of k words are the edges of a De Bruijn graph whose nodes are runs of k - 1 words. Edges are dealt out by their
minimizer (the least hash of the four-word runs inside), so neighbouring edges mostly meet in one bucket and travel as one
run. Where an edge occurs in more than one document, the occurrence in the smallest document is its source; edges that
follow each other both here and at the source form a nonbranching path, which is kept as one span with two coordinates.
Pieces of a path from different buckets are joined end to end by Spark. The spans then meet the texts, both ends of each
span digest the words they name, and a join of the digests verifies it; spans whose words differ (hashes that collide)
send their documents through an exact comparison of window texts.

A task settles what it can by itself: of the occurrences of an edge in its own documents only those of the smallest leave
it, so a passage that a third of all documents share reaches a bucket once per task, and no source serves them all.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, byte_views, freeing, materialize, text_of

WIDTH, INNER = 13, 4
SPAN = "id long, start int, len int, src long, src_start int"
NAMES = ["id", "start", "len", "src", "src_start"]
MUL = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Hash of a word, worked out once."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > 400_000:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _rolled(a: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` entries."""
    n = len(a) - width + 1
    h = np.zeros(n, np.uint64)
    for i in range(width):
        h = h * MUL + a[i : i + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def edges_of(words: np.ndarray, width: int, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Hash and minimizer of each window of a document's word hashes."""
    if len(words) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    q = min(INNER, width)
    small = _rolled(words, q)
    m, have, want = small, 1, width - q + 1
    while have < want:
        step = min(have, want - have)
        m = np.minimum(m[: len(m) - step], m[step:])
        have += step
    return _rolled(words, width) >> np.uint64(64 - bits), m


def spans_of(doc, pos, src, src_pos) -> list[np.ndarray]:
    """Paths: entries sorted by (doc, pos) that follow each other both in the document and at the source."""
    o = np.lexsort((pos, doc))
    doc, pos, src, src_pos = doc[o], pos[o], src[o], src_pos[o]
    new = np.ones(len(doc), bool)
    if len(doc):
        new[1:] = (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1) | (src[1:] != src[:-1]) | (src_pos[1:] != src_pos[:-1] + 1)
    at = np.flatnonzero(new)
    return [doc[at], pos[at].astype(np.int32), np.diff(np.r_[at, len(doc)]).astype(np.int32), src[at], src_pos[at].astype(np.int32)]


def settle(h, doc, pos):
    """Of entries sorted by (h, doc, pos): which belong to the smallest document of their hash, and the first entry of each
    one's hash."""
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    at = np.flatnonzero(new)
    first = np.repeat(at, np.diff(np.r_[at, len(h)]))
    return doc == doc[first], first


def _flush(ids: list[int], hashes: list[np.ndarray], minims: list[np.ndarray], buckets: int):
    """Rows of one task's documents: their edges by bucket, and the spans settled here."""
    o = sorted(range(len(ids)), key=ids.__getitem__)
    n = np.array([len(hashes[i]) for i in o])
    h = np.concatenate([hashes[i] for i in o])
    doc = np.repeat(np.array([ids[i] for i in o], np.int64), n)
    pos = np.concatenate([np.arange(x, dtype=np.int64) for x in n])
    # rows that share an id stand side by side; verification tells their positions apart later
    by = np.argsort(h, kind="stable")
    mine, first = settle(h[by], doc[by], pos[by])
    gone = np.flatnonzero(~mine)
    spans = spans_of(doc[by][gone], pos[by][gone], doc[by][first[gone]], pos[by][first[gone]])
    keep = np.zeros(len(h), bool)
    keep[by[mine]] = True
    bucket = (np.concatenate([minims[i] for i in o]) % np.uint64(buckets)).astype(np.int32)
    h, doc, pos, bucket = h[keep], doc[keep], pos[keep], bucket[keep]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1) | (bucket[1:] != bucket[:-1])
    at = np.flatnonzero(new)
    size = np.diff(np.r_[at, len(h)])
    runs = np.argsort(bucket[at], kind="stable")
    b = bucket[at][runs]
    edge = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, np.int64)
    size, at = size[runs], at[runs]
    ends = np.cumsum(size)
    order = np.repeat(at - (ends - size), size) + np.arange(int(size.sum()))
    h = h[order]
    cols = ([], [], [], [], [])
    for s, e in zip(edge.tolist(), [*edge[1:].tolist(), len(b)]):
        lo, hi = int(ends[s] - size[s]), int(ends[e - 1])
        cols[0].append(int(b[s]))
        cols[1].append(doc[at[s:e]].tobytes())
        cols[2].append(pos[at[s:e]].astype(np.int32).tobytes())
        cols[3].append(size[s:e].astype(np.int32).tobytes())
        cols[4].append(h[lo:hi].tobytes())
    none = [b""] * len(cols[0])
    packed = [none[:] for _ in range(5)]
    if len(spans[0]):
        if not none:
            cols = ([0], [b""], [b""], [b""], [b""])
            packed = [[b""] for _ in range(5)]
        for k in range(5):
            packed[k][0] = spans[k].tobytes()
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in (*cols[1:], *packed))], _COLS)


_COLS = ["bucket", "docs", "starts", "sizes", "hashes", "s_id", "s_start", "s_len", "s_src", "s_src_start"]
_EDGE_ROW = "bucket int, " + ", ".join(f"{c} binary" for c in _COLS[1:])


def repeated_spans(docs: DataFrame, id_col: str, text_col: str, width: int = WIDTH, bits: int = 64, flush: int = 1_500_000, bucket_bytes: int = 4 << 20) -> DataFrame:
    """``id, start, len, src, src_start``: ``len`` windows of document ``id`` from word ``start`` on have the hashes of those of
    document ``src`` (smaller) from ``src_start`` on. Each window with such a source is in one span of its document."""
    slim = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    total = slim.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(1, int(total) // bucket_bytes)

    def edges(batches):
        known, ids, hashes, minims, n = WordHashes(), [], [], [], 0
        for b in batches:
            off, raw = byte_views(b.column(1))
            for i, s, e in zip(b.column(0).to_pylist(), off[:-1], off[1:]):
                h, m = edges_of(known.of(raw[s:e].tobytes().split()), width, bits)
                if len(h):
                    ids.append(i)
                    hashes.append(h)
                    minims.append(m)
                    n += len(h)
                if n > flush:
                    yield _flush(ids, hashes, minims, buckets)
                    ids, hashes, minims, n = [], [], [], 0
        if ids:
            yield _flush(ids, hashes, minims, buckets)

    def meet(t: pa.Table) -> pa.Table:
        col = lambda c, kind: np.frombuffer(b"".join(t.column(c).to_pylist()), kind)
        size = col("sizes", np.int32)
        h = col("hashes", np.uint64)
        doc = np.repeat(col("docs", np.int64), size)
        within = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
        pos = np.repeat(col("starts", np.int32), size) + within
        o = np.lexsort((pos, doc, h))
        h, doc, pos = h[o], doc[o], pos[o]
        mine, first = settle(h, doc, pos)
        gone = np.flatnonzero(~mine)
        found = spans_of(doc[gone], pos[gone], doc[first[gone]], pos[first[gone]])
        local = [col(c, k) for c, k in zip(_COLS[5:], (np.int64, np.int32, np.int32, np.int64, np.int32))]
        return pa.table([pa.array(np.concatenate([a, b])) for a, b in zip(found, local)], names=NAMES)

    return slim.mapInArrow(freeing(edges), _EDGE_ROW).groupBy("bucket").applyInArrow(meet, SPAN)


def glued(spans: DataFrame) -> DataFrame:
    """Join the pieces of a path end to end: a piece goes on where the one before it in its document ends, if it does so at
    the same source as well."""
    w = Window.partitionBy("id").orderBy("start", "src", "src_start", "len")
    last = lambda c: F.lag(c).over(w)
    goes_on = (last("start") + last("len") == F.col("start")) & (last("src") == F.col("src")) & (last("src_start") + last("len") == F.col("src_start"))
    part = F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    each = spans.withColumn("part", part)
    return each.groupBy("id", "part").agg(F.min("start").alias("start"), F.sum("len").cast("int").alias("len"), F.first("src").alias("src"), F.min("src_start").alias("src_start")).drop("part")


_RESULT = "id long, n_words long, n_removed long, kept_sha256 string, own array<struct<start:int,len:int,src:bigint,src_start:int,digest:binary>>, lent array<struct<start:int,len:int,digest:binary>>"


def _applied(joined: DataFrame, width: int) -> DataFrame:
    """``joined(id, text, own, lent)`` -> the words left, and digests of the spans a document has and lends."""

    def run(batches):
        for b in batches:
            off, raw = byte_views(b.column(1))
            rows = []
            for i, s, e, own, lent in zip(b.column(0).to_pylist(), off[:-1], off[1:], b.column(2).to_pylist(), b.column(3).to_pylist()):
                words = raw[s:e].tobytes().split()
                digest = lambda start, n: hashlib.blake2b(b" ".join(words[start : start + n + width - 1]), digest_size=16).digest()  # noqa: B023, E731
                stay = np.ones(len(words), bool)
                for x in own or ():
                    stay[x["start"] : x["start"] + x["len"] + width - 1] = False
                    x["digest"] = digest(x["start"], x["len"])
                for x in lent or ():
                    x["digest"] = digest(x["start"], x["len"])
                left = b" ".join(compress(words, stay.tolist()))
                rows.append((i, len(words), int(len(words) - stay.sum()), hashlib.sha256(left).hexdigest(), own or [], lent or []))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("len", pa.int32()), ("src", pa.int64()), ("src_start", pa.int32()), ("digest", pa.binary())])), pa.list_(pa.struct([("start", pa.int32()), ("len", pa.int32()), ("digest", pa.binary())]))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["id", "n_words", "n_removed", "kept_sha256", "own", "lent"])

    return joined.mapInArrow(freeing(run), _RESULT)


def _exact(slim: DataFrame, bad: DataFrame, width: int) -> DataFrame:
    """The rows of the ids in ``bad``, decided by the texts of their windows alone (for spans whose hashes collided)."""
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    texts = F.when(F.size("w") >= width, F.transform(F.sequence(F.lit(1), F.size("w") - width + 1), lambda i: F.concat_ws(" ", F.slice("w", i, width))))
    every = slim.where("id is not null").select("id", F.xxhash64("text").alias("row"), words.alias("w")).select("id", "row", F.posexplode(texts).alias("start", "window"))
    ours = every.join(bad, "id", "left_semi")
    first = every.join(ours.select("window").distinct(), "window", "left_semi").groupBy("window").agg(F.min("id").alias("least"))
    gone = ours.join(first, "window").where("least < id").groupBy("id", "row").agg(F.collect_set(F.struct(F.col("start"), F.lit(1).alias("len"), F.col("least").alias("src"), F.lit(0).alias("src_start"), F.lit(None).cast("binary").alias("digest"))).alias("own"))
    rows = slim.join(bad, "id", "left_semi").withColumn("row", F.xxhash64("text"))
    put = rows.join(gone, ["id", "row"], "left").select("id", F.col("text").cast("binary").alias("text"), "own", F.expr("cast(null as array<struct<start:int,len:int,digest:binary>>)").alias("lent"))
    return _applied(put, width)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = WIDTH, bits: int = 64, flush: int = 1_500_000) -> DataFrame:
    """``id, n_words, n_removed, kept_sha256`` of every row.

    A word goes if it lies in a window of ``width`` words whose sequence also starts in a document with a smaller id, judged
    on the input. Null text has no word; a shorter text has no window; a row without an id neither removes nor loses a word;
    rows that share an id never remove each other's words. An empty table gives no row. ``bits`` under 64 exists to test
    colliding hashes.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spans = materialize(glued(repeated_spans(slim, "id", "text", width, bits, flush)))
    own = spans.groupBy("id").agg(F.collect_list(F.struct("start", "len", "src", "src_start", F.lit(None).cast("binary").alias("digest"))).alias("own"))
    # a source answers each interval once, however many documents ask
    asked = spans.select(F.col("src").alias("id"), F.col("src_start").alias("start"), "len").distinct()
    lent = asked.groupBy("id").agg(F.collect_list(F.struct("start", "len", F.lit(None).cast("binary").alias("digest"))).alias("lent"))
    both = materialize(own.join(lent, "id", "full"))
    joined = slim.select("id", F.col("text").cast("binary").alias("text")).join(both.hint("shuffle_hash"), "id", "left").select("id", "text", "own", "lent")
    found = materialize(_applied(joined, width))
    mine = found.select("id", F.explode("own").alias("x")).select("id", F.col("x.src").alias("src"), F.col("x.src_start").alias("start"), F.col("x.len").alias("len"), F.col("x.digest").alias("digest"))
    theirs = found.select(F.col("id").alias("src"), F.explode("lent").alias("x")).select("src", "x.*").distinct()
    # what many documents claim of one source interval is compared once
    keys = ["src", "start", "len", "digest"]
    wrong = materialize(mine.select(*keys).distinct().join(theirs, keys, "left_anti"))
    out = found.select("id", "n_words", "n_removed", "kept_sha256")
    if wrong.isEmpty():
        return out
    bad = materialize(mine.join(wrong, keys, "left_semi").select("id").distinct())
    return out.join(bad, "id", "left_anti").union(_exact(slim, bad, width).select(*out.columns))
