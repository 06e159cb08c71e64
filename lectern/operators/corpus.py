"""Corpus operators: usable pages, document report, language, chunks, topics.

Pages have ``document_id, page_number, text`` (and ``lecture``, ``unit``, derived where missing).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..scratch import written

# Fixed values.
MIN_PAGE_CHARS = 40
TARGET_TOKENS, MAX_TOKENS = 500, 1200
LANGUAGE_PAGES = 5

#: Digests that are sent to every task, some sixty bytes each; beyond, a filter of so many bits, in buckets of SQL bitmaps.
SENT = 100_000
FILTER_BITS, BUCKET = 1 << 27, 1 << 15


def with_names(pages: DataFrame) -> DataFrame:
    """Add ``lecture`` and ``unit`` from the document id where they are missing."""
    if "lecture" not in pages.columns:
        pages = pages.withColumn("lecture", t.lecture_name("document_id"))
    if "unit" not in pages.columns:
        pages = pages.withColumn("unit", t.unit_name("document_id"))
    return pages


def _digest(text) -> Column:
    return F.unhex(F.sha2(F.col(text).cast("binary"), 256))


def _bit(digest: str) -> Column:
    """A digest's place among the filter's bits."""
    return F.pmod(F.xxhash64(digest), F.lit(FILTER_BITS))


def filter_of(digests: DataFrame) -> DataFrame:
    """``bucket, bits``: a Bloom filter of one hash over ``__of``, put together by aggregation. It has ``FILTER_BITS`` bits
    whatever goes in, 16 MB in buckets of 4 KB; of n digests about n / FILTER_BITS of all others pass as well."""
    at = digests.select(_bit("__of").alias("at"))
    return at.groupBy(F.expr(f"at div {BUCKET}").alias("bucket")).agg(F.bitmap_construct_agg(F.pmod("at", F.lit(BUCKET))).alias("bits"))


def passing(rows: DataFrame, bits: DataFrame) -> DataFrame:
    """``rows`` with ``__may``: whether the filter lets their ``__of`` pass."""
    placed = rows.withColumn("__at", _bit("__of"))
    held = placed.join(F.broadcast(bits), F.expr(f"__at div {BUCKET}") == F.col("bucket"), "left")  # FILTER_BITS / 8 bytes at most
    byte = F.conv(F.hex(F.expr(f"substring(bits, int((__at % {BUCKET}) div 8 + 1), 1)")), 16, 10).cast("int")
    may = F.expr("shiftright(__byte, int(__at % 8)) & 1") == 1
    return held.withColumn("__byte", byte).withColumn("__may", F.coalesce(may, F.lit(False))).drop("__at", "__byte", *bits.columns)


def usable_pages(pages: DataFrame, least: int = MIN_PAGE_CHARS, sent: int = SENT) -> DataFrame:
    """Pages of ``least`` characters or more, of equal texts the first by (document, page), which names a page.

    Digests are grouped, partial on the map side, so a page that half the corpus repeats stays one row per task. What comes of
    it, the digests that occur twice, is written and counted. Up to ``sent`` of them go to every task, and no text moves.
    Of more a filter of fixed size goes: a text that it doesn't let pass stays where it is, and only the others are shuffled
    to meet their digests.
    """
    rich = pages.where(t.utf16_length("text") >= least).withColumn("__of", _digest("text"))
    page = F.struct("document_id", "page_number")
    first = written(rich.groupBy("__of").agg(F.min(page).alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n"))
    stays = F.col("__first").isNull() | (page == F.col("__first"))
    if first.limit(sent + 1).count() <= sent:
        return rich.join(F.broadcast(first), "__of", "left").where(stays).select(*pages.columns)
    flagged = passing(rich, written(filter_of(first)))
    again = flagged.where("__may").join(first.hint("shuffle_hash"), "__of", "left").where(stays)
    return flagged.where("not __may").select(*pages.columns).union(again.select(*pages.columns))


def language_samples(usable: DataFrame, pages: int = LANGUAGE_PAGES) -> DataFrame:
    """``document_id, german, english``: marker counts over the first usable pages of each document."""
    w = Window.partitionBy("document_id").orderBy("page_number")
    first = usable.withColumn("n", F.row_number().over(w)).where(F.col("n") <= pages)
    low = F.lower("text")
    # markers are words without a space, so counting page by page is counting their joined text
    return first.groupBy("document_id").agg(F.sum(t.marker_count(low, t.GERMAN_MARKERS)).alias("german"), F.sum(t.marker_count(low, t.ENGLISH_MARKERS)).alias("english"))


def document_report(pages: DataFrame, least: int = MIN_PAGE_CHARS) -> DataFrame:
    """One row per document: usable and text-poor pages, characters, tokens, damage, alternative text, language, role."""
    pages = with_names(pages)
    low, size = F.lower("text"), t.utf16_length("text").cast("long")
    # texts are read once: what is counted of a page, and its digest, are some sixty bytes
    counted = written(pages.select(
        "document_id", "page_number", "unit", F.when(size >= least, _digest("text")).alias("__of"), (size < least).alias("poor"), size.alias("size"),
        t.damage_count("text").alias("damaged"), t.alt_text_count("text").alias("alt"),
        t.marker_count(low, t.GERMAN_MARKERS).alias("g"), t.marker_count(low, t.ENGLISH_MARKERS).alias("e"),
    ))
    every = counted.groupBy("document_id").agg(F.min("unit").alias("unit"), F.sum(F.col("poor").cast("long")).alias("text_poor_pages"))
    # equal texts have equal counts: the first page of a digest stands for it
    page = F.struct("document_id", "page_number", "size", "damaged", "alt", "g", "e")
    usable = counted.where("__of is not null").groupBy("__of").agg(F.min(page).alias("p")).select("p.*")
    early = F.row_number().over(Window.partitionBy("document_id").orderBy("page_number")) <= LANGUAGE_PAGES
    of_first = lambda c: F.sum(F.when(F.col("early"), F.col(c)).otherwise(F.lit(0)))
    sums = usable.withColumn("early", early).groupBy("document_id").agg(
        F.count(F.lit(1)).alias("pages"), F.sum("size").alias("chars"), F.sum("damaged").alias("damaged_tokens"), F.sum("alt").alias("alt_text_lines"),
        of_first("g").alias("german"), of_first("e").alias("english"),
    )
    out = every.join(sums, "document_id", "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("pages", "chars", "damaged_tokens", "alt_text_lines", "german", "english")}
    out = out.withColumns(zero)
    return out.select(
        "document_id", t.role_of("unit").alias("role"), "pages", "text_poor_pages", "chars", t.approx_tokens("chars").alias("approx_tokens"), "damaged_tokens", "alt_text_lines",
        t.language_of("german", "english").alias("language"),
    )


def chunk_numbers(pages: DataFrame, target: int = TARGET_TOKENS, most: int = MAX_TOKENS) -> DataFrame:
    """``document_id, page_number, chunk``: the greedy packing of a document's pages in order.

    Pages gather until a chunk has ``target`` tokens; a page of ``most`` or more closes the one before and stands alone.
    The state resets, so it is one pass over each document's ordered token counts (texts don't take part, and no list of a
    document's pages is held).
    """
    tokens = pages.select("document_id", F.col("page_number").cast("int").alias("page_number"), F.coalesce(t.approx_tokens(t.utf16_length("text")).cast("long"), F.lit(0)).alias("tokens"))

    def fold(batches):
        document, chunk, held, waiting = None, 0, 0, 0
        for b in batches:
            out = []
            for d, n in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if d != document:
                    document, chunk, held, waiting = d, 0, 0, 0
                if n >= most:  # a lone page closes the pages that wait, and takes the number after theirs
                    chunk += waiting > 0
                out.append(chunk)
                if n >= most or held + n >= target:
                    chunk, held, waiting = chunk + 1, 0, 0
                else:
                    held, waiting = held + n, waiting + 1
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.int64())], ["document_id", "page_number", "chunk"])

    ordered = tokens.repartition("document_id").sortWithinPartitions("document_id", "page_number")
    return ordered.mapInArrow(fold, "document_id string, page_number int, chunk long")


def chunks(pages: DataFrame, target: int = TARGET_TOKENS, most: int = MAX_TOKENS, roles: DataFrame | None = None) -> DataFrame:
    """Chunks with id, page span, role and text (pages joined by an empty line). ``roles(document_id, role)``: OTHER without."""
    pages = with_names(pages)
    put = pages.join(chunk_numbers(pages, target, most), ["document_id", "page_number"])
    ordered = F.array_sort(F.collect_list(F.struct("page_number", "text")))
    out = put.groupBy("document_id", "chunk").agg(F.min("lecture").alias("lecture"), F.min("unit").alias("unit"), F.min("page_number").alias("first_page"), F.max("page_number").alias("last_page"), F.concat_ws("\n\n", ordered["text"]).alias("text"))
    role = F.lit("OTHER")
    if roles is not None:
        out = out.join(roles.select("document_id", F.col("role").alias("r")), "document_id", "left")
        role = F.coalesce("r", F.lit("OTHER"))
    return out.select(t.chunk_id("document_id", "first_page", "last_page").alias("chunk_id"), "document_id", "lecture", "unit", "first_page", "last_page", role.alias("role"), "text")


def topics(chunks_: DataFrame) -> DataFrame:
    """``topic, query, chunks, position`` of each lecture, in the order in which lectures first appear."""
    by = chunks_.groupBy("lecture").agg(F.count(F.lit(1)).alias("chunks"), F.min(F.struct("document_id", "first_page")).alias("first"))
    place = F.row_number().over(Window.orderBy("first", "lecture")).cast("long")  # one row a lecture
    return by.select(F.col("lecture").alias("topic"), t.to_query("lecture").alias("query"), "chunks", place.alias("position"))


def competency_topics(competencies: DataFrame, links: DataFrame, chunks_: DataFrame) -> DataFrame:
    """``competency_key, chunks``: chunks of the linked documents; a document linked twice counts twice."""
    per = chunks_.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    sums = links.join(per, "document_id", "left").groupBy("competency_key").agg(F.sum(F.coalesce("n", F.lit(0))).alias("chunks"))
    return competencies.join(sums, "competency_key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))


def grounded(topics_: DataFrame) -> DataFrame:
    return topics_.where("chunks > 0")


def lecture_listing(documents: DataFrame) -> DataFrame:
    """``lecture, documents`` of files in folders."""
    return documents.where(F.lower("document_id").endswith(".pdf") & F.col("document_id").contains("/")).groupBy(t.lecture_name("document_id").alias("lecture")).agg(F.count(F.lit(1)).alias("documents"))
