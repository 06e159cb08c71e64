"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is embedded as the bit counts of its 32 two-bit segments. The Manhattan distance of two embeddings
never exceeds the Hamming distance of the fingerprints, so links at ``radius`` bits are a range join on the grid of
counts: the segments form ``blocks`` groups, of which at least ``blocks - radius`` agree exactly in any linked pair. Each
choice of that many groups is a projection of the grid; the points of one cell are compared, first by the Manhattan
bound, then by the exact Hamming distance.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import near_copies
from .common import byte_views, freeing, materialize, text_of, too_many
from .components import Forest, components

LOW = np.uint64(0x5555555555555555)
SEED = 42


def majority(h: np.ndarray) -> np.ndarray:
    """The bits set in over half of the 64-bit numbers, as one of them."""
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(h), 65_536):
        part = h[lo : lo + 65_536].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)


def fingerprint(text: bytes, words: int = 4) -> int:
    """SimHash over the XXH64 (seed 42) of the ``words``-word shingles, repeats included; 0 without a word."""
    found = text.lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    size = np.fromiter(map(len, found), np.int64, len(found))
    end = np.cumsum(size + 1) - 1
    start = end - size
    n, xx = len(found) - words + 1, xxhash.xxh64_intdigest
    h = np.fromiter((xx(joined[s:e], SEED) for s, e in zip(start[:n].tolist(), end[words - 1 :].tolist())), np.uint64, n)
    return int(majority(h)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """``id, fp`` of every row; the fingerprint as a signed long. Null text has no word."""

    def run(batches):
        for b in batches:
            off, raw = byte_views(b.column(1))
            fps = np.fromiter((fingerprint(raw[s:e].tobytes(), words) for s, e in zip(off[:-1], off[1:])), np.uint64, len(off) - 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).mapInArrow(freeing(run), "id long, fp long")


def embed(fp: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 segments as thermometer codes (0: 00, 1: 01, 2: 11): their XOR has as many bits as the
    Manhattan distance of the counts."""
    low, high = fp & LOW, (fp >> np.uint64(1)) & LOW
    return (low | high) | ((low & high) << np.uint64(1))


def grid(blocks: int, radius: int) -> list[np.ndarray]:
    """A mask over the embedding for each choice of ``blocks - radius`` groups of segments."""
    parts = [sum(3 << (2 * int(s)) for s in group) for group in np.array_split(np.arange(32), blocks)]
    return [np.uint64(sum(x)) for x in itertools.combinations(parts, blocks - radius)]


def blocks_for(distinct: int, radius: int = 4) -> int:
    """Groups of segments such that a cell of the grid holds few unrelated points: a segment's count tells 1.5 bits.
    Any number gives the same links."""
    blocks = radius + 2
    while blocks < radius + 6 and distinct / 2 ** (48 * (blocks - radius) / blocks) > 64:
        blocks += 1
    return blocks


def links_in(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within one cell. A point is compared only with those not reached yet, so a dense
    group of copies costs about its size, not its square."""
    fps = fps.view(np.uint64)
    rest, emb, out = fps, embed(fps), []
    while len(rest) > 1:
        front, rest, emb = [rest[0]], rest[1:], emb[1:]
        while front and len(rest):
            u = front.pop()
            near = np.flatnonzero(np.bitwise_count(emb ^ embed(u)) <= radius)
            if len(near):
                near = near[np.bitwise_count(rest[near] ^ u) <= radius]
            if len(near):
                hit = rest[near]
                out += [(int(u), int(v)) for v in hit]
                front += list(hit)
                keep = np.ones(len(rest), bool)
                keep[near] = False
                rest, emb = rest[keep], emb[keep]
    return out


def _small_cells(key: np.ndarray, fps: np.ndarray, radius: int, most: int) -> list[tuple[int, int]]:
    """Links in all cells of ``most`` points or fewer at once: rows that are d apart in one cell, for each d."""
    f, out, u64 = Forest(), [], fps.view(np.uint64)
    emb = embed(u64)
    i = np.arange(len(key))
    for d in range(1, most):
        i = i[i + d < len(key)]
        i = i[key[i] == key[i + d]]
        if not len(i):
            break
        near = i[np.bitwise_count(emb[i] ^ emb[i + d]) <= radius]
        near = near[np.bitwise_count(u64[near] ^ u64[near + d]) <= radius]
        out += [(x, y) for x, y in zip(u64[near].tolist(), u64[near + d].tolist()) if f.join(x, y)]
    return out


def _cells(batches, radius: int, small: int = 16) -> Iterator[pa.RecordBatch]:
    """Batches sorted by (projection, cell), with a cell cut anywhere -> links."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def links(which, cell, fps):
        edge = np.flatnonzero((which[1:] != which[:-1]) | (cell[1:] != cell[:-1])) + 1
        starts, ends = np.r_[0, edge], np.r_[edge, len(cell)]
        size = ends - starts
        out = []
        for s, e in zip(starts[size > small].tolist(), ends[size > small].tolist()):
            out += links_in(fps[s:e], radius)
        few = np.repeat(size <= small, size)
        out += _small_cells(np.repeat(np.arange(len(size)), size)[few], fps[few], radius, small)
        a = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], ["u", "v"])

    for b in batches:
        now = tuple(b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if not len(now[0]):
            continue
        edge = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
        cut = int(edge[-1]) + 1 if len(edge) else 0  # the last cell may go on in the next batch
        if held and (cut or held[-1][0][-1] != now[0][0] or held[-1][1][-1] != now[1][0]):
            yield links(*(np.concatenate([*(h[i] for h in held), now[i][:cut]]) for i in range(3)))
            held = []
        elif cut:
            yield links(*(x[:cut] for x in now))
        held.append(tuple(x[cut:] for x in now))
    if held:
        yield links(*(np.concatenate([h[i] for h in held]) for i in range(3)))


def links(distinct: DataFrame, radius: int = 4, blocks: int | None = None) -> DataFrame:
    """``u, v``: links between the fingerprints in ``distinct(fp)`` (each once) that connect all within ``radius`` bits."""
    blocks = blocks or blocks_for(distinct.count(), radius)
    masks = grid(blocks, radius)

    def keyed(batches):
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False)
            emb = embed(fps.view(np.uint64))
            for k, m in enumerate(masks):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fps), k, np.int32)), pa.array((emb & m).view(np.int64)), b.column(0)], ["which", "cell", "fp"])

    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = distinct.select("fp").mapInArrow(keyed, "which int, cell long, fp long").repartition(n, "which", "cell").sortWithinPartitions("which", "cell")
    return cells.mapInArrow(lambda batches: _cells(batches, radius), "u long, v long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 4, radius: int = 4, blocks: int | None = None) -> DataFrame:
    """``id, fingerprint`` (16 hex digits) and ``component_id`` of every row.

    Rows link when their fingerprints differ in ``radius`` bits or fewer; ``component_id`` is the smallest id reachable.
    Equal fingerprints are one point from the start. Null ids are passed over when looking for the smallest (it is null
    where there is no other); null text has no word; repeated rows each come back; an empty table gives no row.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, words))
    points = materialize(fps.groupBy("fp").agg(F.min("id").alias("least")))
    parts = components(links(points, radius, blocks))
    named = points.join(parts, points["fp"] == parts["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of = named.join(least, "component").select("fp", "component_id")
    return fps.join(of, "fp").select("id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _described(docs: DataFrame, late, words: int, similarity) -> DataFrame:
    """``docs(id, sha, text)`` without the texts: of each row the fingerprint of its shingles, their set's 128-bit digest, size,
    parities, and the shingles it is looked up by."""
    known, at, _ = late
    shared = docs.sparkSession.sparkContext.broadcast((known, at))  # bounded: near_copies.FREQUENT numbers

    def run(batches):
        known, at = shared.value
        for b in batches:
            fps, digests, sizes, bits, heads = [], [], [], [], []
            for h in near_copies.shingles(b.column(2), words):
                fps.append(int(majority(h).view(np.int64)[0]))
                found = near_copies.as_set(h)
                digests.append(xxhash.xxh3_128_digest(found.tobytes(), SEED))
                sizes.append(len(found))
                bits.append(near_copies.parities(found))
                heads.append(near_copies.prefix(found, known, at, similarity) if len(found) else found)
            made = [pa.array(x, t) for x, t in ((fps, pa.int64()), (digests, pa.binary()), (sizes, pa.int64()), (heads, pa.list_(pa.int64())))]
            made += [pa.array(x) for x in np.array(bits, np.int64).reshape(-1, 8).T]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made], names)

    names = ["id", "sha", "fp", "digest", "size", "heads", *near_copies.BITS]
    kinds = "id long, sha binary, fp long, digest binary, size long, heads array<long>, " + ", ".join(f"{x} long" for x in near_copies.BITS)
    made = docs.select("id", "sha", "text").mapInArrow(freeing(run), kinds)
    return materialize(made.withColumn("node", F.monotonically_increasing_id()))  # written, so a row's number stays


def near_duplicate_links(docs: DataFrame, *, words: int = 5, similarity=near_copies.SIMILARITY, radius: int = 4, blocks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Of ``docs(id, sha, text)``: its rows numbered (``id, sha, node``), and links ``u, v`` between them that connect all pairs
    whose sets of ``words``-word shingles have at least the Jaccard ``similarity``, and no others.

    Rows of one set link at once. Fingerprints within ``radius`` bits, found on the grid, are tried first; no radius that the
    grid can search reaches every pair of the similarity (at 0.8 they differ in some ten bits of 64), so the rest of the pairs
    come from the shingles they must share. Every pair is compared by its whole sets.
    """
    late = near_copies.frequent(docs, "text", words)
    marks = _described(docs, late, words, similarity)
    least = marks.groupBy("digest").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    same = materialize(marks.select("node", "digest").join(least, "digest").where("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v")))
    again = same.select(F.col("u").alias("node"))
    points = marks.join(again.hint("shuffle_hash") if too_many(again, near_copies.SENT) else F.broadcast(again), "node", "left_anti").where("size > 0")
    of = materialize(points.groupBy("fp").agg(F.min("node").alias("node")))
    end = lambda x: of.select(F.col("fp").alias(f"{x}_fp"), F.col("node").alias(x))
    on_grid = links(of, radius, blocks).withColumnsRenamed({"u": "u_fp", "v": "v_fp"}).join(end("u"), "u_fp").join(end("v"), "v_fp").select("u", "v")
    equal = points.select(F.col("node").alias("u"), "fp").join(of.withColumnRenamed("node", "v"), "fp").where("u <> v").select("u", "v")
    near = materialize(on_grid.union(equal))
    return marks.select("id", "sha", "node"), same.union(near_copies.similar_links(points, marks, docs, near, late, words, similarity))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each group of :func:`near_duplicate_links` (its parameters: ``how``) the
    row with the smallest id stays, with all its columns.

    A null id comes after any other, equal ids are told apart by a digest of the text; rows that repeat both id and text of
    the one that stays, stay as well. Texts without a word are one group; null counts as empty. An empty table gives no row.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    sha = F.unhex(F.sha2(text.cast("binary"), 256))
    rows, found = near_duplicate_links(docs.select(F.col(id_col).cast("long").alias("id"), sha.alias("sha"), text.alias("text")), **how)
    parts = components(materialize(found))
    member = rows.join(parts, "node").select("component", F.struct(F.col("id").isNull().alias("none"), "id", "sha").alias("row"))
    keep = member.groupBy("component").agg(F.min("row").alias("keep"))
    go = member.join(keep, "component").where(F.col("row") != F.col("keep")).select(F.col("row.id").alias("__id"), F.col("row.sha").alias("__sha")).distinct()
    # written first, so that its size is known: few rows are sent to every task, many are hashed, texts are never sorted
    go = materialize(go)
    named = docs.withColumn("__of", sha)
    gone = named[id_col].cast("long").eqNullSafe(go["__id"]) & (named["__of"] == go["__sha"])
    return named.join(go.hint("shuffle_hash") if too_many(go, near_copies.SENT) else F.broadcast(go), gone, "left_anti").drop("__of")
