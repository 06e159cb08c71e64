"""Exact dedup by content-defined chunk recipes.

Every text is cut where a rolling hash of its own bytes says so. A distinct chunk moves once, to be compared
byte by byte with the other chunks of its hash; that gives each chunk a verified identifier. A document is then
only its ordered list of identifiers (its recipe), and equal texts are equal recipes, so long documents themselves
are never grouped, sorted or compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_views, freeing, lower_ascii, materialize, slices, text_of, too_many

WINDOW = 32
_mix = np.arange(256, dtype=np.uint64)
for _shift, _mul in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
    _mix = (_mix + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(_mul)
    _mix ^= _mix >> np.uint64(_shift)
GEAR = (_mix >> np.uint64(16)).astype(np.uint32)


def cut_points(data: np.ndarray, off: np.ndarray, mask_bits: int, least: int, most: int) -> list[list[int]]:
    """Ends of the chunks of each document ``data[off[i]:off[i+1]]``.

    A cut follows a byte where the gear hash of the last 32 bytes has ``mask_bits`` leading zeros; a chunk has
    ``least`` bytes or more (above 32, so the hash never sees another document) and ``most`` or fewer.
    """
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        shifted = np.zeros_like(h)
        shifted[k:] = h[:-k] << np.uint32(k)
        h = h + shifted
    found = np.flatnonzero((h >> np.uint32(32 - mask_bits)) == 0) + 1
    first, out = np.searchsorted(found, off, side="right"), []
    for i in range(len(off) - 1):
        last, end, ends = int(off[i]), int(off[i + 1]), []
        for c in [*found[first[i] : first[i + 1]].tolist(), end]:
            while c - last > most:
                last += most
                ends.append(last)
            if c - last >= least or c == end and c > last:
                last = c
                ends.append(c)
        out.append(ends)
    return out


def _hasher(hash_bits: int):
    shift = 64 - hash_bits
    return lambda b: (xxhash.xxh3_64_intdigest(b) >> shift) - (1 << 63 if not shift else 0)


def _chunked(column: pa.Array, mask_bits: int, least: int, most: int) -> Iterator[tuple[int, bytes, list[int]]]:
    """Row number, lower-cased bytes and chunk ends, document by document."""
    off, raw = byte_views(column)
    for i, j in slices(off, 1 << 20):
        part = raw[off[i] : off[j]].tobytes().lower()
        local = off[i : j + 1] - off[i]
        for k, ends in enumerate(cut_points(np.frombuffer(part, np.uint8), local, mask_bits, least, most)):
            yield i + k, part[local[k] : local[k + 1]], [e - int(local[k]) for e in ends]


def recipes(docs: DataFrame, id_col: str, text_col: str, *, mask_bits: int = 10, least: int = 256, most: int = 8192, hash_bits: int = 64) -> DataFrame:
    """``id, text_sha256, recipe`` (array of chunk hashes) of every row."""

    def run(batches):
        h = _hasher(hash_bits)
        for b in batches:
            sha, recipe = [], []
            for _, text, ends in _chunked(b.column(1), mask_bits, least, most):
                sha.append(hashlib.sha256(text).hexdigest())
                recipe.append([h(text[s:e]) for s, e in zip([0, *ends], ends)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sha, pa.string()), pa.array(recipe, pa.list_(pa.int64()))], ["id", "text_sha256", "recipe"])

    slim = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    return slim.mapInArrow(freeing(run), "id long, text_sha256 string, recipe array<long>")


def _chunk_store(docs: DataFrame, text_col: str, mask_bits: int, least: int, most: int, hash_bits: int, held: int = 8 << 20) -> DataFrame:
    """``h, chunk``: each distinct chunk of a task once (while ``held`` bytes of chunks fit)."""

    def run(batches):
        h, seen, size = _hasher(hash_bits), {}, 0
        for b in batches:
            hs, chunks, waiting = [], [], 0
            for _, text, ends in _chunked(b.column(0), mask_bits, least, most):
                for s, e in zip([0, *ends], ends):
                    c = text[s:e]
                    k = h(c)
                    if seen.get(k) == c:
                        continue
                    if size > held:
                        seen, size = {}, 0
                    if k not in seen:
                        seen[k] = c
                        size += len(c)
                    hs.append(k)
                    chunks.append(c)
                    waiting += len(c)
                if waiting > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(chunks, pa.binary())], ["h", "chunk"])
                    hs, chunks, waiting = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(chunks, pa.binary())], ["h", "chunk"])

    return docs.select(text_of(text_col).alias("text")).mapInArrow(freeing(run), "h long, chunk binary")


def _collisions(store: DataFrame) -> DataFrame:
    """``h, chunk, variant`` of the second and later byte strings that share a hash; normally no row."""
    n = int(store.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        now, known = None, []
        for b in batches:
            out = []
            for k, c in zip(b.column(0).to_pylist(), b.column(1)):
                c = c.as_buffer()
                if k != now:
                    now, known = k, [c]
                elif not any(c.equals(x) for x in known):
                    known.append(c)
                    out.append((k, c.to_pybytes(), len(known) - 1))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.int32()))], ["h", "chunk", "variant"])

    # the caller writes this once: a variant's number then stays what it is
    return store.repartition(n, "h").sortWithinPartitions("h").mapInArrow(run, "h long, chunk binary, variant int")


def _resolved(docs: DataFrame, id_col: str, text_col: str, clash: DataFrame, mask_bits: int, least: int, most: int, hash_bits: int) -> DataFrame:
    """Recipes in which a chunk whose hash is shared carries its variant as well (the rare path)."""

    def run(batches):
        h = _hasher(hash_bits)
        for b in batches:
            rows = []
            for i, text, ends in _chunked(b.column(1), mask_bits, least, most):
                sha, row = hashlib.sha256(text).hexdigest(), b.column(2)[i].as_py()
                rows += [(row, b.column(0)[i].as_py(), sha, p, h(text[s:e]), text[s:e]) for p, (s, e) in enumerate(zip([0, *ends], ends))] or [(row, b.column(0)[i].as_py(), sha, -1, 0, b"")]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary()))], ["row", "id", "text_sha256", "pos", "h", "chunk"])

    slim = materialize(docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"), F.monotonically_increasing_id().alias("row")))
    each = slim.mapInArrow(run, "row long, id long, text_sha256 string, pos int, h long, chunk binary")
    each = each.join(clash, ["h", "chunk"], "left").select("row", "id", "text_sha256", "pos", F.struct("pos", "h", F.coalesce("variant", F.lit(0)).alias("variant")).alias("piece"))
    lists = each.groupBy("row", "id", "text_sha256").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    flat = F.flatten(F.transform("pieces", lambda x: F.when(x["pos"] < 0, F.array().cast("array<long>")).otherwise(F.array(x["h"], x["variant"].cast("long")))))
    return lists.select("id", "text_sha256", flat.alias("recipe"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, mask_bits: int = 10, least: int = 256, most: int = 8192, hash_bits: int = 64) -> DataFrame:
    """One row per input row: ``id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty, and empty texts form a group. The row
    with the largest id stays. A null id is smaller than any other; of rows that repeat both id and text, one is kept.
    An empty table gives no row. ``hash_bits`` under 64 exists to test how shared hashes are told apart.
    """
    cut = {"mask_bits": mask_bits, "least": least, "most": most, "hash_bits": hash_bits}
    clash = _collisions(_chunk_store(docs, text_col, **cut))
    clash = materialize(clash)
    # The chunks are verified now: without a clash a hash names one byte string, and recipes of hashes are exact.
    rows = recipes(docs, id_col, text_col, **cut) if clash.isEmpty() else _resolved(docs, id_col, text_col, clash, **cut)
    per_id = materialize(rows.groupBy("id", "text_sha256", "recipe").agg(F.count(F.lit(1)).alias("n")))
    # only groups of several rows are looked up; written apart, a hot recipe's rows can be split in the join
    groups = materialize(per_id.groupBy("recipe").agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size")).where("group_size > 1"))
    each = per_id.join(groups, "recipe", "left").withColumn("keep_id", F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))).withColumn("group_size", F.coalesce("group_size", F.lit(1)).cast("long"))
    each = each.select("*", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"))
    return each.select("id", "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`exact_groups` keeps, with all their columns.

    Of rows that repeat both id and normalised text, the smallest by all columns in their order stays (they must be of types
    that can be ordered). Only the ids and digests of rows that go are sent; a text that stays is never shuffled.
    """
    found = materialize(exact_groups(docs, id_col, text_col))
    each = found.groupBy("id", "text_sha256").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")).where("not kept or n > 1")
    odd = materialize(each.select(F.col("id").alias("__id"), F.unhex("text_sha256").alias("__sha"), "kept"))
    named = docs.withColumn("__of", F.unhex(F.sha2(lower_ascii(F.coalesce(F.col(text_col), F.lit(""))).cast("binary"), 256)))
    same = named[id_col].cast("long").eqNullSafe(odd["__id"]) & (named["__of"] == odd["__sha"])
    known = odd.hint("shuffle_hash") if too_many(odd, 200_000) else F.broadcast(odd)
    held = named.join(known, same, "left_anti")
    twice = odd.where("kept")
    if not twice.isEmpty():
        again = named.join(known.where("kept"), same, "left_semi")
        one = again.groupBy(F.col(id_col).alias("__id"), "__of").agg(F.min(F.struct(*docs.columns)).alias("__row"))
        held = held.select(*docs.columns).union(one.select("__row.*"))
    return held.select(*docs.columns)
