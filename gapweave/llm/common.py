"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gapweave.plans.storage import materialize

#: A word is a run without ASCII white space (Java and RE2 syntax).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Words of a text; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def fold(doc_id: Column, n: int) -> Column:
    """Remainder that splits documents into folds; NULL for a NULL id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


def unique_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have, whatever its extra columns are called."""
    name, taken = base, {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def add_column(batches: Iterator[pa.RecordBatch], make, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Append what ``make(batch)`` returns (a list of arrays) to every Arrow batch."""
    for b in batches:
        if b.num_rows:
            yield pa.RecordBatch.from_arrays([*b.columns, *make(b)], schema=schema)


def stack_vectors(col: pa.Array) -> np.ndarray:
    """List column of equal lengths to a double matrix."""
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(col), -1)


def list_views(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The lists of a column as views of its flat values: no copy for each."""
    out: list[np.ndarray] = []
    for c in column.chunks:
        flat, at = c.values.to_numpy(zero_copy_only=False), c.offsets.to_numpy()
        out += [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    return out


def usable_vector(v: Column) -> Column:
    """True for a non-empty vector without NULL or non-finite components that is not all zero."""
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & ok & F.exists(v, lambda x: x != 0), F.lit(False))


def one_row_each(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` reduced to one of each ``keys``: that of the text with the smallest hash, so repeated ids do not multiply a sample.

    The grouped minimum holds hashes only and is combined before the shuffle; texts stay where they are until one is chosen.
    """
    rows = rows.withColumn("_h", F.xxhash64("text"))
    rows = rows.withColumn("_at", F.struct("_h", F.xxhash64(F.lit(1), "text").alias("b")))
    least = materialize(rows.groupBy(*keys).agg(F.min("_at").alias("_at")), "sample-rows")
    return rows.join(least, [*keys, "_at"], "left_semi").dropDuplicates([*keys, "_at"]).drop("_h", "_at")


def first_of_each(rows: DataFrame, by: str, n: int, seed: int) -> DataFrame:
    """A written sample of ``rows(doc_id, by)``: of each group the first ``n`` in hash order, with the hash as ``key``.

    Only rows whose hash falls below four times the share that is wanted meet in the ordering, so a group of any size costs about
    4 n rows there; a group of up to 4 n rows is ordered whole. The table is small and written, so joins can broadcast it by its known size.
    """
    rows = rows.withColumn("key", F.xxhash64("doc_id", F.lit(seed)))
    sizes = materialize(rows.groupBy(by).agg(F.count(F.lit(1)).alias("_n")), "sample-sizes")
    near = rows.join(sizes, by).where(F.col("key") / 2.0**64 + 0.5 <= 4.0 * n / F.col("_n")).drop("_n")
    order = Window.partitionBy(by).orderBy("key", "doc_id")
    return materialize(near.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r"), "sample")


#: Common table expressions: ``crc(crc_table)``, the 256 entries of the crc32 table. Needs WITH RECURSIVE.
CRC_SQL = """bits(i, k, v) AS (SELECT i, 0, i::BIGINT FROM range(256) r(i)
        UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
    crc AS (SELECT list(v ORDER BY i) AS crc_table FROM bits WHERE k = 8)"""


def crc32_sql(text: str) -> str:
    """Unsigned crc32 of a text's UTF-8 bytes as SQL over a table joined with ``crc`` (``CRC_SQL``); NULL for NULL."""
    byte = f"[('0x' || substr(hex({text}), 2 * i - 1, 2))::BIGINT FOR i IN range(1, strlen({text}) + 1)]"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {byte}), lambda a, b: xor(a >> 8, crc_table[(xor(a, b) & 255) + 1])), 4294967295::BIGINT)"
