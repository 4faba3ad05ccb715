"""Line dedup by overlapping three-line windows, in native expressions only.

Every run of three consecutive lines is hashed (128 bits). A window's first
place is the least (doc_id, text, position) that holds it; every later place is
a repeat, and the lines that repeats cover, merged, are removed.

Defined cases: null text stays null and has no lines; a text with fewer lines
than a window is unchanged; windows without a word don't count, so blank lines
alone are never a repeat; null ids come first in the order; rows with the same
id and text are one document and get the same result; other columns are passed
through; a document whose lines are all removed becomes an empty text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finscope.llm.quality_rules import INNER


def repeated_windows(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, starts): for each document with repeats, the sorted first lines (from 0) of its repeated windows.

    The first places are aggregated before they are shuffled, so a window that
    a third of all documents share is a row for each task there. The join of
    places with first places has one row a window on one side: what is hot on
    the other can be split.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.split(text, "\n")
    starts = F.slice(F.col("lines"), 1, F.greatest(F.size("lines") - (width - 1), F.lit(0)))

    def window(line, i):
        parts = [line, *[F.get(F.col("lines"), i + k) for k in range(1, width)]]
        filled = F.concat(*parts).rlike(INNER)
        return F.when(filled, F.struct(F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(width), *parts).alias("h2")))

    places = (
        docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key"), lines.alias("lines"))
        .select("doc_id", "text_key", F.posexplode(F.transform(starts, window)).alias("pos", "w"))
        .where("w IS NOT NULL")
        .select("w.h1", "w.h2", F.struct("doc_id", "text_key", "pos").alias("place"))
    )
    first = places.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("last > first").select("h1", "h2", "first")
    later = places.join(first, ["h1", "h2"]).where("place > first")
    return later.groupBy("place.doc_id", "place.text_key").agg(F.sort_array(F.collect_set("place.pos")).alias("starts"))


def deduped(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeated lines cut from their text, plus n_lines and n_lines_removed (long)."""
    repeats = repeated_windows(docs, width, id_col, text_col).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("starts").alias("_starts"))
    text = F.col(text_col)
    on = F.col(id_col).eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("_key"))
    joined = docs.join(repeats.hint("shuffle_hash"), on, "left")
    lines = F.split(text, "\n")
    # What lies between two covered stretches is kept: from the end of one window to the start of the next.
    bounds = F.concat(F.array(F.lit(-width)), F.col("_starts"), F.array(F.size(lines)))
    kept = F.transform(
        F.array(F.struct(lines.alias("lines"), bounds.alias("bounds"))),
        lambda x: F.flatten(
            F.transform(
                F.slice(x["bounds"], 1, F.size(x["bounds"]) - 1),
                lambda b, i: F.slice(x["lines"], b + (width + 1), F.greatest(F.get(x["bounds"], i + 1) - (b + width), F.lit(0))),
            )
        ),
    )[0]
    out = joined.withColumn("_kept", F.when(F.col("_starts").isNotNull(), kept))
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long")
    removed = F.when(F.col("_kept").isNull(), 0).otherwise(F.size(lines) - F.size("_kept")).cast("long")
    new_text = F.when(F.col("_kept").isNull(), text).otherwise(F.array_join("_kept", "\n"))
    plain = [c for c in docs.columns if c not in ("n_lines", "n_lines_removed")]
    return out.select(*[new_text.alias(c) if c == text_col else F.col(c) for c in plain], n_lines.alias("n_lines"), removed.alias("n_lines_removed"))
