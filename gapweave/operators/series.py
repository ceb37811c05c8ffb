"""Ordered-series primitives that never put a whole series into one task.

A series (one site, one variable) is cut into position chunks. Work that looks like a long window
becomes: a window inside each chunk, one summary row per chunk, a window over the summaries, and a
join of the summaries back to their chunk. Only the summary (rows / chunk size) is ever ordered per
series, so one site holding a third of the table still spreads over the cluster.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 4096
SERIES = ("site", "variable")


def _chunk(pos: str, size: int) -> Column:
    return F.expr(f"`{pos}` div {int(size)}")


#: Rows of the files that a frame reads, for each task it is spread to.
TASK_ROWS = 65_536
_FILE_ROWS: dict[frozenset[str], int] = {}


def _rows_read(df: DataFrame) -> int:
    """Rows of the parquet files behind ``df``, from their footers; 0 where it reads none. Text files do not count."""
    files = frozenset(f for f in df.inputFiles() if f.endswith(".parquet"))
    if files and files not in _FILE_ROWS:
        try:
            _FILE_ROWS[files] = df.sparkSession.read.parquet(*sorted(files)).count()
        except PySparkException:  # a path that cannot be given again as it is named: the plain number of tasks will do
            _FILE_ROWS[files] = 0
    return _FILE_ROWS.get(files, 0)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to a number of tasks that adaptive execution leaves as it is and that grows with the rows ``df`` reads.

    What a task holds in sorts and aggregates is many times what crosses the wire (chunks that become cells, stamps that compress well), so
    merging partitions by their written size would give a few tasks all of it, and a fixed number would make every task grow with the input.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(max(parts, -(-_rows_read(df) // TASK_ROWS)), *keys)


def carry(
    df: DataFrame,
    keys: Sequence[str] = SERIES,
    prev: Mapping[str, Column] | None = None,
    next: Mapping[str, Column] | None = None,
    size: int = CHUNK,
    pos: str = "pos",
) -> DataFrame:
    """Attach the last / next non-NULL payload at or before / at or after each position.

    ``prev`` and ``next`` map an output name to a payload expression; a NULL payload is "no mark". A frame that already has the chunk
    number as ``_ck`` (of the same ``size``) and is dealt by it is not dealt again.
    """
    prev, next = dict(prev or {}), dict(next or {})
    d = df.withColumns(
        ({} if "_ck" in df.columns else {"_ck": _chunk(pos, size)})
        | {f"_p_{k}": c for k, c in prev.items()}
        | {f"_n_{k}": c for k, c in next.items()}
    )
    part = [*keys, "_ck"]
    aggs = [F.max_by(f"_p_{k}", F.when(F.col(f"_p_{k}").isNotNull(), F.col(pos))).alias(f"_ep_{k}") for k in prev]
    aggs += [F.min_by(f"_n_{k}", F.when(F.col(f"_n_{k}").isNotNull(), F.col(pos))).alias(f"_en_{k}") for k in next]
    edge = d.groupBy(*part).agg(*aggs)
    before = Window.partitionBy(*keys).orderBy("_ck").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(F.col("_ck").desc()).rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.select(
        *part,
        *[F.last(f"_ep_{k}", ignorenulls=True).over(before).alias(f"_cp_{k}") for k in prev],
        *[F.last(f"_en_{k}", ignorenulls=True).over(after).alias(f"_cn_{k}") for k in next],
    )
    fwd = Window.partitionBy(*part).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    bwd = Window.partitionBy(*part).orderBy(F.col(pos).desc()).rowsBetween(Window.unboundedPreceding, 0)
    dealt = d if "_ck" in df.columns else spread(d, *part)
    local = dealt.withColumns(
        {f"_lp_{k}": F.last(f"_p_{k}", ignorenulls=True).over(fwd) for k in prev}
        | {f"_ln_{k}": F.last(f"_n_{k}", ignorenulls=True).over(bwd) for k in next}
    )
    return local.join(edge, part, "left").select(
        *df.columns,
        *[F.coalesce(f"_lp_{k}", f"_cp_{k}").alias(k) for k in prev],
        *[F.coalesce(f"_ln_{k}", f"_cn_{k}").alias(k) for k in next],
    )


def shift(
    df: DataFrame,
    cols: Mapping[str, tuple[str, int]],
    keys: Sequence[str] = SERIES,
    size: int = CHUNK,
    pos: str = "pos",
) -> DataFrame:
    """Attach values of neighbouring positions: ``{"prev_value": ("value", -1)}``.

    Positions must be dense. The few rows next to a chunk border are copied into the neighbouring
    chunk, so one exchange is enough and no join back is needed.
    """
    reach_back = max([-o for _, o in cols.values() if o < 0] or [0])
    reach_fwd = max([o for _, o in cols.values() if o > 0] or [0])
    if max(reach_back, reach_fwd) > size:
        raise ValueError("offset larger than the chunk")
    home, off = _chunk(pos, size), F.col(pos) % size
    targets = F.array_compact(
        F.array(
            F.col("_home"),
            F.when(off >= size - reach_back, F.col("_home") + 1),
            F.when(off < reach_fwd, F.col("_home") - 1),
        )
    )
    d = spread(df.withColumn("_home", home).withColumn("_ck", F.explode(targets)), *keys, "_ck")
    w = Window.partitionBy(*keys, "_ck").orderBy(pos)
    out = {name: (F.lag(c, -o) if o < 0 else F.lead(c, o)).over(w) for name, (c, o) in cols.items()}
    return d.withColumns(out).where("_ck = _home").select(*df.columns, *cols)


def prefix_sums(
    df: DataFrame,
    sums: Mapping[str, Column],
    keys: Sequence[str] = SERIES,
    size: int = CHUNK,
    pos: str = "pos",
) -> DataFrame:
    """Attach inclusive running sums, so any interval's sum is a difference of two lookups."""
    d = df.withColumns({"_ck": _chunk(pos, size)} | {f"_s_{k}": c for k, c in sums.items()})
    part = [*keys, "_ck"]
    before = Window.partitionBy(*keys).orderBy("_ck").rowsBetween(Window.unboundedPreceding, -1)
    totals = d.groupBy(*part).agg(*[F.sum(f"_s_{k}").alias(f"_t_{k}") for k in sums])
    totals = totals.select(*part, *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in sums])
    w = Window.partitionBy(*part).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    local = spread(d, *part).withColumns({f"_l_{k}": F.sum(f"_s_{k}").over(w) for k in sums})
    return local.join(totals, part, "left").select(
        *df.columns, *[(F.coalesce(f"_l_{k}", F.lit(0)) + F.col(f"_o_{k}")).alias(k) for k in sums]
    )


def observed_neighbours(panel: DataFrame, keys: Sequence[str] = SERIES, value: str = "value", size: int = CHUNK) -> DataFrame:
    """prev_pos/prev_val: nearest observation at or before; next_pos/next_val: at or after."""
    at = F.when(F.col(value).isNotNull(), F.col("pos"))
    return carry(
        panel,
        keys,
        prev={"prev_pos": at, "prev_val": F.col(value)},
        next={"next_pos": at, "next_val": F.col(value)},
        size=size,
    )


def lowest_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int, salts: int = 64) -> DataFrame:
    """Exactly the ``k`` first rows of each group in ``order``, with rank ``rn``.

    A hot group is cut into salted sub-groups first, each keeping its own ``k`` first rows, so the
    final ordering sees at most ``salts * k`` rows per group however large the group is.
    """
    d = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    part = Window.partitionBy(*keys, "_salt").orderBy(*order)
    d = d.withColumn("_r0", F.row_number().over(part)).where(F.col("_r0") <= k).drop("_r0", "_salt")
    return d.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rn") <= k)
