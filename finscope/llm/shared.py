"""What the text operators share: reading, row identity, words, scratch tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finscope.scratch import written  # noqa: F401

#: Fixed by the contracts: a word is a maximal run of characters other than these.
SPACE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Stands for a null id where ids are compared: no document comes after one without an id.
LAST = (1 << 63) - 1


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, who, text_key, text) of the given rows.

    who is the id, or LAST for null. text_key tells rows apart that share an id
    or have none; where every id is unique, as one look at the ids shows, it is
    0. Rows with the same id and the same text are one document where documents
    are compared.
    """
    seen = docs.select(F.col(id_col).alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("n"))
    odd = seen.where("n > 1 OR doc_id IS NULL").limit(1).count()
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) if odd else F.lit(0).cast("long")
    own = F.col(id_col).cast("long")
    return docs.select(own.alias("doc_id"), F.coalesce(own, F.lit(LAST)).alias("who"), key.alias("text_key"), F.col(text_col).alias("text"))


def words_of(text: Column) -> Column:
    """Array of the words of a text, unchanged; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column, nulls as empty strings; no copy where none is null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :]
    body = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[starts[0] : starts[-1]], starts - starts[0]


def portions(offsets: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Split rows into runs of at most `limit` bytes each; a longer row stands alone."""
    out, first, n = [], 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(n, max(first + 1, last))
        out.append((first, last))
        first = last
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that their order says nothing about the content."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xFF51AFD7ED558CCD)
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def appended(df: DataFrame, fields: str, start, rows: int = 500) -> DataFrame:
    """df with the columns of `fields` (a DDL string), made by Python on Arrow batches.

    start() is called once in a task and returns a function from a RecordBatch
    of at most `rows` rows to a list of arrays, one for each field. An input
    column of the same name as a new one is replaced.
    """
    from pyspark.sql.types import StructType

    new = StructType.fromDDL(fields)
    keep = [c for c in df.columns if c not in new.names]
    schema = StructType([df.schema[c] for c in keep] + new.fields)

    def run(batches):
        work = start()
        for batch in batches:
            for first in range(0, batch.num_rows, rows):
                part = batch.slice(first, rows)
                made = work(part)
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in keep] + made, names=schema.names)

    return df.mapInArrow(run, schema)
