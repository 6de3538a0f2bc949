"""Line de-duplication across documents (native: DataFrame functions only).

Line keys are hashed, range-partitioned by (hash, slice of the document id) and sorted by document and
position inside; a window streams over the sorted rows and lets the first row of each document out. A key
held by a third of all documents is spread over ``SLICES`` slices, each of which counts its own documents;
the few rows per key that are left are summed. What comes back per document is no text but a bitmap of
its lines, 64 lines to a word, with runs of untouched words coded as a number to skip.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored

MIN_CHARS, MIN_DOCS, SLICES = 40, 5, 64
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _row_key(docs: DataFrame) -> Column:
    return F.xxhash64(docs["doc_id"], docs["text"])


def line_occurrences(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per line whose key has ``min_chars`` code points: h1, h2 (96 bits of hash), doc_id, row_key, pos."""
    # two steps: a hash of the text beside posexplode() would be taken again for every line of it
    split = docs.select("doc_id", _row_key(docs).alias("row_key"), F.split(_text(), "\n").alias("lines"))
    lines = split.select("doc_id", "row_key", F.posexplode("lines").alias("pos", "line"))
    keyed = (lines.select("doc_id", "row_key", "pos", F.btrim("line", F.lit(SPACES)).alias("key"))
             .filter(F.length("key") >= min_chars)
             .withColumn("key", F.translate("key", UPPER, LOWER)))
    return keyed.select(F.xxhash64("key").alias("h1"), F.hash("key").alias("h2"), "doc_id", "row_key", "pos")


def first_occurrences(occurrences: DataFrame) -> DataFrame:
    """The first row of every (key, document): range partitions, secondary sort by document and position."""
    sliced = occurrences.withColumn("slice", F.pmod(F.hash("doc_id"), F.lit(SLICES)))
    ranged = sliced.repartitionByRange("h1", "h2", "slice")
    stream = Window.partitionBy("h1", "h2", "slice").orderBy(F.col("doc_id").desc_nulls_last(), "pos")
    return (ranged.withColumn("rank", F.row_number().over(stream))
            .withColumn("before", F.lag("doc_id").over(stream))
            .filter((F.col("rank") == 1) | ~F.col("before").eqNullSafe(F.col("doc_id")))
            .select("h1", "h2", "doc_id"))


def line_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Bitmaps of the lines to drop: doc_id, row_key, drops array<struct<skip, bits>>; untouched documents have no row.

    A line goes if its key (ends stripped, A-Z lower-cased) has ``min_chars`` code points, at least
    ``min_docs`` documents hold it and this is not the one with the largest doc_id. NULL ids count as one
    document smaller than all others. Rows that repeat an id with another text keep bitmaps of their own.
    """
    occurrences = stored(line_occurrences(docs, min_chars), "line-occurrences")
    frequent = stored(first_occurrences(occurrences).groupBy("h1", "h2")
                .agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("owner"))
                .filter(F.col("n_docs") >= min_docs).select("h1", "h2", "owner"), "frequent-lines")
    dropped = (occurrences.join(frequent, ["h1", "h2"])
               .filter(~F.col("doc_id").eqNullSafe(F.col("owner"))))
    words = (dropped.groupBy("doc_id", "row_key", F.floor(F.col("pos") / 64).cast("int").alias("word"))
             .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos") % 64)).alias("bits")))
    whole = words.groupBy("doc_id", "row_key").agg(
        F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("entries"))
    coded = F.transform(F.array("entries"), lambda entries: F.transform(entries, lambda e, i: F.struct(
        (e["word"] - F.coalesce(F.get(entries, i - 1)["word"], F.lit(-1)) - 1).alias("skip"),
        e["bits"].alias("bits"))))
    return whole.select("doc_id", "row_key", F.get(coded, 0).alias("drops"))


def n_dropped(drops: Column) -> Column:
    return F.coalesce(F.aggregate(drops, F.lit(0).cast("long"), lambda a, e: a + F.bit_count(e["bits"])),
                      F.lit(0).cast("long"))


def kept_text(text: Column, drops: Column) -> Column:
    """The lines that the bitmap keeps, joined by newlines; a NULL bitmap keeps the text as it is."""
    dense = F.flatten(F.transform(drops, lambda e: F.concat(
        F.array_repeat(F.lit(0).cast("long"), e["skip"]), F.array(e["bits"]))))
    lines = F.get(F.transform(F.array(dense), lambda d: F.filter(
        F.split(text, "\n"),
        lambda _, i: F.coalesce(F.bit_get(F.get(d, F.floor(i / 64).cast("int")), i % 64), F.lit(0)) == 0)), 0)
    return F.when(drops.isNull(), text).otherwise(F.array_join(lines, "\n"))


def _with_bitmaps(docs: DataFrame, **options) -> tuple[DataFrame, Column]:
    """``docs`` joined with the bitmaps, and the bitmap column (NULL where all lines stay)."""
    bitmaps = line_bitmaps(docs.select("doc_id", "text"), **options)
    joined = docs.join(bitmaps.hint("shuffle_hash"), _row_key(docs).eqNullSafe(bitmaps["row_key"])
                       & docs["doc_id"].eqNullSafe(bitmaps["doc_id"]), "left")
    return joined, bitmaps["drops"]


def drop_repeated_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text`` and ``n_chars`` counted anew; other columns as they are.

    A NULL text stays NULL, a text that loses all its lines is empty.
    """
    joined, drops = _with_bitmaps(docs, **options)
    text = kept_text(docs["text"], drops)
    changed = {"text": text, "n_chars": F.coalesce(F.length(text), F.lit(0)).cast("long")}
    return joined.select(*(changed[c].alias(c) if c in changed else docs[c] for c in docs.columns))


def line_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 per row of ``docs``; NULL text is one empty line."""
    rows = docs.select("doc_id", "text")
    joined, drops = _with_bitmaps(rows, **options)
    text = F.coalesce(rows["text"], F.lit(""))
    return joined.select(
        rows["doc_id"], F.size(F.split(text, "\n")).cast("long").alias("n_lines"),
        n_dropped(drops).alias("n_dropped"),
        F.sha2(kept_text(text, drops).cast("binary"), 256).alias("kept_sha256"))
