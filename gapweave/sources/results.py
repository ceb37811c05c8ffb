"""Result tables: resumable append, reset, sharding, patching, splits and metadata."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RESULT_KEY = ("site", "model", "scenario", "vars_key", "gap_len", "repeat")


def pending(df: DataFrame, done: DataFrame, key: Sequence[str] = RESULT_KEY) -> DataFrame:
    """Rows whose key is not in the results yet."""
    return df.join(done.select(*key).distinct(), list(key), "left_anti")


def append_results(df: DataFrame, path: str, key: Sequence[str] = RESULT_KEY) -> DataFrame:
    """Append only the missing keys to the results table (parquet by model) and return the table."""
    spark = df.sparkSession
    done = _read_or_none(spark, path)
    new = df if done is None else pending(df, done, key)
    new.write.mode("append").partitionBy("model").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def reset_models(spark: SparkSession, path: str, backup: str, models: Sequence[str]) -> DataFrame:
    """Copy the named models' results to ``backup``, then empty their partitions and no others.

    A partition is overwritten by a file without rows only after its rows are in the backup; partitions of other models are neither read in full nor written.
    """
    live = spark.read.parquet(path)
    named = live.where(F.col("model").isin(list(models)))
    named.write.mode("errorifexists").partitionBy("model").parquet(backup)
    folders = named.select(F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("at")).distinct().collect()
    for folder in folders:  # one per model and rewritten part
        live.drop("model").limit(0).write.mode("overwrite").parquet(unquote(folder.at))
    return spark.read.schema(live.schema).parquet(path)


def shard(df: DataFrame, n: int, i: int, key: str = "case_id") -> DataFrame:
    return df.where(F.pmod(F.col(key), F.lit(n)) == i)


def merge_shards(shards: Sequence[DataFrame], key: Sequence[str], expected: DataFrame) -> DataFrame:
    """Union of shards; the job fails on a duplicate key or a key set other than ``expected``."""
    out = shards[0]
    for s in shards[1:]:
        out = out.unionByName(s)
    have = out.groupBy(*key).agg(F.count(F.lit(1)).alias("_have"))
    want = expected.select(*key).distinct().withColumn("_want", F.lit(1))
    chk = want.join(have, list(key), "full_outer").select(
        *key,
        F.when(F.col("_have").isNull(), F.raise_error(F.lit("missing key")).cast("int"))
        .when(F.col("_want").isNull(), F.raise_error(F.lit("unexpected key")).cast("int"))
        .when(F.col("_have") > 1, F.raise_error(F.lit("duplicate key")).cast("int"))
        .otherwise(F.lit(1))
        .alias("_ok"),
    )
    return out.join(chk.where("_ok = 1").select(*key), list(key), "inner")


def patch_results(base: DataFrame, fix: DataFrame, key: Sequence[str] = ("case_id",)) -> DataFrame:
    """All rows whose key is present in ``fix`` are replaced."""
    return base.join(fix.select(*key).distinct(), list(key), "left_anti").unionByName(fix)


def write_split(roles: DataFrame, path: str, meta: dict[str, object]) -> None:
    """One JSON line per site with its role and the run's settings; no list of sites is ever gathered."""
    fields = F.struct(*[F.lit(v).alias(k) for k, v in meta.items()])
    roles.select("site", "role").withColumn("meta", fields).write.json(path)


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """site, role rows of a stored split: one line per site, or one {train: [...], test: [...]} document."""
    raw = spark.read.option("multiLine", False).json(path)
    if "role" not in raw.columns:
        raw = spark.read.option("multiLine", True).json(path)
        pairs = F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).alias("sites")) for r in ("train", "test")])
        raw = raw.select(F.explode(pairs).alias("p")).select("p.*")
    if "site" not in raw.columns:
        raw = raw.select(F.explode("sites").alias("site"), "role")
    return raw.select("site", "role")


def normalise_name(c):
    return F.trim(F.regexp_replace(F.lower(F.trim(c)), "_", " "))


def read_site_metadata(meta: DataFrame, name: str = "name", group: str = "plant", order: Sequence[str] = ()) -> DataFrame:
    """Names and groups normalised, the first row of each name kept; two groups for a name fail the job."""
    d = meta.withColumns({name: normalise_name(F.col(name)), group: normalise_name(F.col(group))})
    first = d.withColumn("_r", F.row_number().over(Window.partitionBy(name).orderBy(*order, group)))
    one = d.groupBy(name).agg(F.count_distinct(group).alias("n_groups"))
    ok = F.when(F.col("n_groups") > 1, F.raise_error(F.concat(F.lit("several groups for "), F.col(name))).cast("bigint")).otherwise(F.col("n_groups"))
    return first.where("_r = 1").drop("_r").join(one, name).withColumn("n_groups", ok)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("encoding", "UTF-8").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)
