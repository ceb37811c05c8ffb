"""Per-site text sheets: one file per site, header discovered per file, everything read as text."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Header fragments that mark the date column.
DATE_MARKS = ("수집일", "date", "time")


def parse_compact_ts(col: Column) -> Column:
    """'YYYY-MM-DD HHMMSS' or any text Spark can cast to a timestamp; unparseable gives NULL."""
    t = F.trim(col)
    spaced = F.regexp_replace(t, r"^(\d{4}-\d{2}-\d{2}) (\d{2})(\d{2})(\d{2})$", "$1 $2:$3:$4")
    return spaced.try_cast("timestamp_ntz")


def parse_timestamps(df: DataFrame, col: str, mode: str = "strict", out: str = "ts") -> DataFrame:
    """``strict`` fails the job at an unparseable stamp, ``drop`` removes the row."""
    ts = parse_compact_ts(F.col(col))
    if mode == "strict":
        bad = F.raise_error(F.concat(F.lit("unparseable timestamp: "), F.coalesce(F.col(col), F.lit("NULL")))).cast("timestamp_ntz")
        return df.withColumn(out, F.when(ts.isNull(), bad).otherwise(ts))
    if mode == "drop":
        return df.withColumn(out, ts).where(F.col(out).isNotNull())
    raise ValueError(f"unknown mode {mode!r}")


def _site_of(path: Column) -> Column:
    """Site of a file: its ``site=...`` folder when written by Spark, else the file stem."""
    text = F.url_decode(path)
    folder = F.regexp_extract(text, r"site=([^/]+)/", 1)
    stem = F.regexp_replace(F.element_at(F.split(text, "/"), -1), r"\.[^.]+$", "")
    return F.when(folder != "", folder).otherwise(stem)


def list_sites(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """Site names below a directory with their file counts, from the file listing alone."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(_site_of(F.col("path")).alias("site")).groupBy("site").agg(F.count(F.lit(1)).alias("files")).orderBy("site")


def sheet_headers(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """(file, header): the first line of every sheet, found by one aggregation over the files' first blocks."""
    reader = spark.read.format("text").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    lines = reader.load(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_i"))
    heads = lines.where("_at = 0").groupBy("file").agg(F.min_by("value", "_i").alias("header"))
    return heads.withColumn("header", F.regexp_replace("header", "^\ufeff", ""))


def read_site_sheets(spark: SparkSession, path: str, pattern: str = "*.csv", mode: str = "strict", multi_line: bool = True) -> DataFrame:
    """All sheets -> (site, variable, ts, value); bad numbers become NULL.

    Sheets may differ in columns and order. Files with the same header line form a group that is read with its own CSV schema, so quoted commas, quotes
    ("" inside quotes) and line breaks belong to their cell. A file with line breaks in cells cannot be cut; ``multi_line=False`` lets large sheets without them be read in
    parts. Header lines and file names reach the driver, as they do for any reader's listing; cells never do. The date column is the first whose name holds a date mark, else the first.
    """
    groups: dict[str, list[str]] = {}
    for r in sheet_headers(spark, path, pattern).collect():
        groups.setdefault(r.header, []).append(r.file)
    out = None
    for header, files in sorted(groups.items()):
        names = [n.strip() for n in next(csv.reader([header]), [""])]
        cols = [f"_c{i}" for i in range(len(names))]
        date = next((i for i, n in enumerate(names) if any(m in n.lower() for m in DATE_MARKS)), 0)
        schema = T.StructType([T.StructField(c, T.StringType()) for c in cols])
        reader = spark.read.schema(schema).option("header", True).option("multiLine", multi_line).option("quote", '"').option("escape", '"')
        rows = reader.option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(sorted(files)).select(*cols, _site_of(F.col("_metadata.file_path")).alias("site"))
        rows = parse_timestamps(rows.withColumnRenamed(cols[date], "_raw"), "_raw", mode)
        cells = [F.struct(F.lit(n).alias("variable"), F.col(c).try_cast("double").alias("num")) for i, (n, c) in enumerate(zip(names, cols, strict=True)) if i != date]
        if cells:
            long = rows.select("site", "ts", F.inline(F.array(*cells))).select("site", "variable", "ts", F.when(~F.isnan("num"), F.col("num")).alias("value"))
            out = long if out is None else out.unionByName(long)
    return spark.createDataFrame([], "site string, variable string, ts timestamp_ntz, value double") if out is None else out


def write_site_sheets(wide: DataFrame, path: str, date_column: str = "date") -> None:
    """One CSV per site (UTF-8, header): rows are dealt by site first, so no task writes a piece of every site's sheet."""
    wide = wide.repartition("site")
    wide.withColumn(date_column, F.date_format("ts", "yyyy-MM-dd HHmmss")).drop("ts").write.partitionBy("site").option("header", True).csv(path)
