"""Choosing, validating and applying hidden intervals. Every random choice is an order on a hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gapweave.functions.exprs import from_micros, hash_order, hash_unit, literal, micros
from gapweave.operators.series import CHUNK, SERIES, carry, lowest_per_group, prefix_sums


def scenario_table(spark: SparkSession, variables: Sequence[str], group_b: Sequence[str]) -> DataFrame:
    """Scenario A hides each variable alone, B the indoor group, C all variables."""
    rows = [("A", [v]) for v in sorted(variables)] + [("B", sorted(group_b)), ("C", sorted(variables))]
    values = ", ".join(f"({literal(s)}, array({', '.join(map(literal, names))}))" for s, names in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(scenario, masked_vars)")  # a local relation: reading it starts no job


def observed_bits(panel: DataFrame, variables: Sequence[str], size: int = CHUNK) -> DataFrame:
    """(site, pos, bits, _ck): bit ``i`` is set where ``variables[i]`` is observed. Rows are dealt by (site, chunk of positions) before they are combined, the only time that the panel moves."""
    place = F.array_position(F.array(*[F.lit(v) for v in variables]), F.col("variable")) - 1
    bit = F.when(F.col("value").isNotNull(), F.pow(F.lit(2), place).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    rows = panel.where(F.col("variable").isin(list(variables))).select("site", "pos", bit.alias("bit"), F.expr(f"pos div {int(size)}").alias("_ck"))
    return rows.repartition("site", "_ck").groupBy("site", "_ck", "pos").agg(F.bit_or("bit").alias("bits"))


def feasible_starts(
    panel: DataFrame, combos: DataFrame, gaps: Sequence[int], ctx: int, size: int = CHUNK, extra: Column | None = None
) -> DataFrame:
    """Starts with ``ctx`` positions before them and every masked variable observed over the whole gap.

    One row a position carries the observed variables as bits; the next position at which a combination misses one is carried for all combinations at once,
    and answers every gap length. ``combos`` (the scenario definitions) is read on the driver; at most 63 variables take part in them.
    """
    need = [(r.scenario, r.masked_vars) for r in combos.select("scenario", "masked_vars").collect()]
    variables = sorted({v for _, names in need for v in names})
    if len(variables) > 63:
        raise ValueError(f"{len(variables)} masked variables; at most 63 fit one mask")
    keys = ("site", "scenario", "vars_key")
    masks = [sum(1 << variables.index(v) for v in names) for _, names in need]
    whole = lambda m: F.col("bits").bitwiseAND(F.lit(m).cast("bigint")) == m
    bits = observed_bits(panel, variables, size)
    d = carry(bits, ("site",), next={f"bad{m}": F.when(~whole(m), F.col("pos")) for m in sorted(set(masks))}, size=size)
    n = panel.groupBy("site").agg((F.max("pos") + 1).alias("n"))
    d = d.where(F.col("pos") >= ctx).join(n, "site")
    starts = [
        F.when(
            F.col("pos") + g <= F.coalesce(F.col(f"bad{m}"), F.col("n")),  # a bad position itself carries its own number
            F.struct(F.lit(s).alias("scenario"), F.lit(",".join(names)).alias("vars_key"), F.lit(int(g)).cast("bigint").alias("gap_len")),
        )
        for (s, names), m in zip(need, masks, strict=True)
        for g in gaps
    ]
    out = d.withColumn("_c", F.explode(F.array_compact(F.array(*starts)))) if starts else d.withColumn("_c", F.lit(None).cast("struct<scenario:string,vars_key:string,gap_len:bigint>")).where("false")
    out = out.select("site", "_c.scenario", "_c.vars_key", "_c.gap_len", "pos", "n")
    out = out if extra is None else out.where(extra)
    return out.select(*keys, "gap_len", F.col("pos").alias("start_pos"))


def select_nonoverlapping(cand: DataFrame, k: int, seed: int = 42, group: Sequence[str] = ("site", "scenario", "vars_key", "gap_len")) -> DataFrame:
    """Greedy choice in hash order: keep a start unless it overlaps a kept one, stop at ``k``.

    A kept interval of length h rules out at most 2h-1 starts, so the k picks always lie among the
    first (k-1)(2h-1)+1 candidates in hash order. Only that bounded head of a group is gathered.
    """
    h = hash_order(seed, *[F.col(g) for g in group], F.col("start_pos"))
    d = cand.withColumn("_h", h)
    need = (k - 1) * (2 * F.col("gap_len") - 1) + 1
    d = _heads(d, list(group), need)
    picks = d.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("_h", "start_pos"))).alias("_c"))
    gap = F.col("gap_len")
    fold = F.aggregate(
        F.transform("_c", lambda c: c["start_pos"]),
        F.array().cast("array<bigint>"),
        lambda acc, s: F.when(
            (F.size(acc) < k) & ~F.exists(acc, lambda a: F.abs(a - s) < gap), F.array_append(acc, s)
        ).otherwise(acc),
    )
    out = picks.select(*group, F.posexplode(F.array_sort(fold)).alias("repeat", "start_pos"))
    return out.withColumn("repeat", F.col("repeat").cast("bigint"))


def _heads(d: DataFrame, group: list[str], need: Column, salts: int = 16) -> DataFrame:
    """First ``need`` rows of each group in hash order, hot groups cut by salt before the final order."""
    order = ["_h", "start_pos"]
    d = d.withColumn("_salt", F.pmod(F.xxhash64("start_pos"), F.lit(salts)))
    d = d.withColumn("_r", F.row_number().over(Window.partitionBy(*group, "_salt").orderBy(*order))).where(F.col("_r") <= need)
    return d.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_r") <= need).drop("_r", "_salt")


def manifest_rows(panel: DataFrame, combos: DataFrame, gaps: Sequence[int], ctx: int, k: int, seed: int = 42, size: int = CHUNK, extra: Column | None = None) -> DataFrame:
    """Chosen intervals of every site x combination x gap, without case ids."""
    picks = select_nonoverlapping(feasible_starts(panel, combos, gaps, ctx, size, extra), k, seed)
    end = F.col("start_pos") + F.col("gap_len") - 1
    d = picks.withColumn("end_pos", end).join(site_clock(panel), "site")
    d = d.withColumns({"start_ts": _stamp("start_pos"), "end_ts": _stamp("end_pos")})
    return d.select(
        "site", "scenario", "vars_key", F.split("vars_key", ",").alias("masked_vars"), "gap_len", "repeat", "start_pos", "end_pos", "start_ts", "end_ts"
    )


def site_clock(panel: DataFrame) -> DataFrame:
    """First stamp and step of each site, read from its first two positions only."""
    us = lambda p: F.min(F.when(F.col("pos") == p, micros("ts")))
    return panel.where("pos in (0, 1)").groupBy("site").agg(us(0).alias("_t0"), F.coalesce(us(1) - us(0), F.lit(0)).alias("_dt"))


def _stamp(pos: str) -> Column:
    return from_micros(F.col("_t0") + F.col(pos) * F.col("_dt"))


MANIFEST_ORDER = ["site", "scenario", "vars_key", "gap_len", "repeat"]


def build_manifest(panel: DataFrame, combos: DataFrame, gaps: Sequence[int], ctx: int, k: int, seed: int = 42, size: int = CHUNK) -> DataFrame:
    """Mask manifest with sequential case ids in (site, scenario, variables, gap, repeat) order."""
    from gapweave.plans.storage import sequential_ids

    return sequential_ids(manifest_rows(panel, combos, gaps, ctx, k, seed, size), MANIFEST_ORDER, "case_id", "manifest")


def build_validation_manifest(
    panel: DataFrame, combos: DataFrame, gaps: Sequence[int], max_ctx: int, min_ctx: int, k: int = 3, seed: int = 42, frac: float = 0.8, size: int = CHUNK
) -> DataFrame:
    """Intervals in the suffix of training sites.

    start >= max(cut, max_ctx); combinations with a variable whose prefix range is zero or undefined
    are skipped; each masked variable needs an observation within ``min_ctx`` before the start.
    """
    from gapweave.plans.storage import sequential_ids

    n = panel.groupBy("site").agg(F.floor(F.lit(frac) * (F.max("pos") + 1)).cast("bigint").alias("cut"))
    ranges = (
        panel.join(n, "site").where("pos < cut").groupBy(*SERIES).agg((F.max("value") - F.min("value")).alias("range"))
    )
    usable = ranges.where("range > 0").select(*SERIES)
    combos_sites = combos.withColumn("variable", F.explode("masked_vars")).withColumn("vars_key", F.array_join("masked_vars", ","))
    good = (
        combos_sites.join(usable, "variable")
        .groupBy("site", "scenario", "vars_key")
        .agg(F.count(F.lit(1)).alias("have"), F.max(F.size("masked_vars")).alias("need"))
        .where("have = need")
        .select("site", "scenario", "vars_key")
    )
    cand = feasible_starts(panel, combos, gaps, max_ctx, size).join(n, "site").where("start_pos >= cut").drop("cut")
    cand = cand.join(good, ["site", "scenario", "vars_key"], "left_semi")
    sums = prefix_sums(panel, {"c": F.col("value").isNotNull().cast("bigint")}, size=size).select(*SERIES, "pos", "c")
    look = cand.withColumn("variable", F.explode(F.split("vars_key", ",")))
    hi = sums.select(*SERIES, (F.col("pos") + 1).alias("start_pos"), F.col("c").alias("_hi"))
    lo = sums.select(*SERIES, (F.col("pos") + 1 + min_ctx).alias("start_pos"), F.col("c").alias("_lo"))
    seen = look.join(hi, [*SERIES, "start_pos"]).join(lo, [*SERIES, "start_pos"], "left")
    bad = seen.where(F.col("_hi") - F.coalesce("_lo", F.lit(0)) < 1)
    cand = cand.join(bad, ["site", "scenario", "vars_key", "gap_len", "start_pos"], "left_anti")
    picks = select_nonoverlapping(cand, k, seed)
    d = picks.join(site_clock(panel), "site").withColumn("start_ts", _stamp("start_pos"))
    d = d.join(n.withColumnRenamed("cut", "validation_start"), "site")
    d = d.withColumn("end_pos", F.col("start_pos") + F.col("gap_len") - 1)
    d = d.select("site", "scenario", "vars_key", F.split("vars_key", ",").alias("masked_vars"), "gap_len", "repeat", "start_pos", "end_pos", "start_ts", "validation_start")
    return sequential_ids(d, MANIFEST_ORDER, "case_id", "validation")


def hidden_cells(cases: DataFrame) -> DataFrame:
    """case_id, site, variable, pos of every artificially hidden cell."""
    d = cases.withColumn("variable", F.explode("masked_vars"))
    return d.select("case_id", "site", "variable", F.explode(F.sequence("start_pos", "end_pos")).alias("pos"))


def interval_join(intervals: DataFrame, panel: DataFrame, lo: str, hi: str, keys: Sequence[str] = ("site",), bucket: int = 512) -> DataFrame:
    """panel rows with lo <= pos <= hi as an equi join on position buckets."""
    iv = intervals.withColumn("_bk", F.explode(F.sequence(F.expr(f"`{lo}` div {bucket}"), F.expr(f"`{hi}` div {bucket}"))))
    rows = panel.withColumn("_bk", F.expr(f"pos div {bucket}"))
    return iv.join(rows, [*keys, "_bk"]).where(F.col("pos").between(F.col(lo), F.col(hi))).drop("_bk")


def home_bucket(lo: str, reach: int) -> Column:
    """Bucket ``_bk`` of an interval of at most ``reach`` positions that begins at ``lo``, see ``home_rows``."""
    return F.expr(f"`{lo}` div {int(reach)}")


def home_rows(panel: DataFrame, reach: int) -> DataFrame:
    """``panel`` with every row in each bucket ``_bk`` whose intervals can hold it: all rows of an interval meet in its one bucket, so sums over an interval need no second exchange."""
    return panel.withColumn("_bk", F.explode(F.sequence(F.expr(f"greatest(pos - {int(reach) - 1}, 0) div {int(reach)}"), F.expr(f"pos div {int(reach)}"))))


def apply_case(cases: DataFrame, panel: DataFrame, before: int, after: int, value: str = "value") -> DataFrame:
    """Flags and masked values over each case's window, all variables of the site.

    artificial: not hidden by the case; effective: also naturally observed; eval: hidden and observed.
    """
    iv = cases.withColumns({"_lo": F.greatest(F.col("start_pos") - before, F.lit(0)), "_hi": F.col("end_pos") + after})
    iv = iv.select("case_id", "site", "masked_vars", "start_pos", "end_pos", "_lo", "_hi")
    d = interval_join(iv, panel, "_lo", "_hi")
    hidden = F.array_contains("masked_vars", F.col("variable")) & F.col("pos").between(F.col("start_pos"), F.col("end_pos"))
    seen = F.col(value).isNotNull()
    return d.select(
        "case_id",
        "site",
        "variable",
        "pos",
        (~hidden).alias("artificial"),
        (~hidden & seen).alias("effective"),
        (hidden & seen).alias("eval"),
        F.when(~hidden, F.col(value)).alias("masked_value"),
    )


def mask_individual(panel: DataFrame, rate: float, seed: int = 42) -> DataFrame:
    """Hide exactly int(n_valid * rate) observed points of each series."""
    h = hash_order(seed, F.col("site"), F.col("variable"), F.col("pos"))
    # threshold search by hash bucket: ranks are only computed inside the one bucket the cut falls in
    # missing cells take no part, so they never meet in one window however many there are
    d = panel.where(F.col("value").isNotNull()).withColumn("_h", h).withColumn("_b", F.shiftright("_h", 16))
    counts = d.groupBy(*SERIES, "_b").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*SERIES).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    all_rows = Window.partitionBy(*SERIES)
    counts = counts.select(
        *SERIES,
        "_b",
        (F.sum("_c").over(w) - F.col("_c")).alias("_before"),
        F.floor(F.sum("_c").over(all_rows) * F.lit(float(rate))).cast("bigint").alias("_want"),
    )
    d = d.join(counts, [*SERIES, "_b"])
    rank = F.col("_before") + F.row_number().over(Window.partitionBy(*SERIES, "_b").orderBy("_h", "pos"))
    seen = d.select(*panel.columns, (rank <= F.col("_want")).alias("hidden"))
    return seen.unionByName(panel.where(F.col("value").isNull()).withColumn("hidden", F.lit(False)))


def block_points(block_hours: float, step_us: int) -> int:
    return max(1, int(round(block_hours * 3_600_000_000 / step_us)))


def mask_blocks(sites: DataFrame, rate: float, block: int, seed: int = 42, groups: int = 256) -> DataFrame:
    """All variables hidden together in random disjoint blocks, round(n * rate) positions a site.

    ``sites`` is (site, n). Placement by order statistics: as many numbers as there are blocks are drawn from 0 to the free length; sorted, the ``j``-th
    plus the lengths of the blocks before it is where block ``j`` starts. Blocks may stand anywhere, touch but never overlap, at any rate up to 1 and without state from
    one to the next. All have ``block`` positions except the last one drawn, which takes what is left of the target.
    """
    target = F.least(F.col("n"), F.round(F.col("n") * F.lit(float(rate))).cast("bigint"))
    d = sites.withColumn("target", target).where("target > 0")
    d = d.withColumns({"blocks": F.expr(f"(target + {block - 1}) div {block}"), "free": F.col("n") - F.col("target")})
    d = d.withColumn("short", F.col("blocks") * block - F.col("target"))
    d = d.withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).where("_g < blocks")
    d = d.withColumn("block", F.explode(F.expr(f"sequence(cast(_g as bigint), blocks - 1, cast({groups} as bigint))")))
    d = d.withColumn("_h", hash_order(seed, F.col("site"), F.lit("block"), F.col("block")))
    ranked = _global_rank(d, ["site"], "_h", "block")
    last = ranked.where("block = blocks - 1").select("site", F.col("rank").alias("_last"))
    d = ranked.join(last, "site")
    drawn = F.expr("(_h * (free + 1)) div 4294967296")
    start = drawn + (F.col("rank") - 1) * block - F.when(F.col("rank") > F.col("_last"), F.col("short")).otherwise(F.lit(0))
    size = block - F.when(F.col("rank") == F.col("_last"), F.col("short")).otherwise(F.lit(0))
    return d.select("site", start.alias("start_pos"), (start + size - 1).alias("end_pos"), "target")


def _global_rank(d: DataFrame, keys: Sequence[str], h: str, tie: str, shift_bits: int = 16) -> DataFrame:
    """row_number by a uniform hash, ordered only inside hash-prefix buckets."""
    d = d.withColumn("_b", F.shiftright(h, shift_bits))
    c = d.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    c = c.select(*keys, "_b", F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_before"))
    inner = Window.partitionBy(*keys, "_b").orderBy(h, tie)
    return d.join(c, [*keys, "_b"]).withColumn("rank", F.col("_before") + F.row_number().over(inner)).drop("_b", "_before")


def corrupt_mixture(windows: DataFrame, variables: Sequence[str], indoor: Sequence[str], gaps: Sequence[int], length: int, seed: int = 42) -> DataFrame:
    """Training corruption of windows (window_id, pos_in, variable, value): one of four kinds per window.

    kind 0 hides 20 % of cells at random, 1 a block of one variable, 2 a block of the indoor group,
    3 a block of all variables. Everything derives from the window id, so it is a projection.
    """
    wid = F.col("window_id")
    pick = lambda tag, m: F.pmod(hash_order(seed, wid, F.lit(tag)), F.lit(m))
    lens = F.array(*[F.lit(int(min(g, length))) for g in gaps])
    d = windows.withColumns(
        {
            "kind": pick("kind", 4),
            "_len": F.element_at(lens, (pick("len", len(gaps)) + 1).cast("int")),
            "_var": F.element_at(F.array(*[F.lit(v) for v in variables]), (pick("var", len(variables)) + 1).cast("int")),
        }
    )
    d = d.withColumn("_start", F.pmod(hash_order(seed, wid, F.lit("start")), F.lit(length) - F.col("_len") + 1))
    block = (F.col("pos_in") >= F.col("_start")) & (F.col("pos_in") < F.col("_start") + F.col("_len"))
    mcar = hash_unit(seed, wid, F.col("variable"), F.col("pos_in")) < 0.2
    hit = (
        F.when(F.col("kind") == 0, mcar)
        .when(F.col("kind") == 1, block & (F.col("variable") == F.col("_var")))
        .when(F.col("kind") == 2, block & F.col("variable").isin(list(indoor)))
        .otherwise(block)
    )
    seen = F.col("value").isNotNull()
    return d.select(
        *windows.columns,
        "kind",
        F.when(seen & ~hit, F.col("value")).otherwise(F.lit(0.0)).alias("x"),
        (seen & ~hit).alias("mask"),
        F.when(seen, F.col("value")).otherwise(F.lit(0.0)).alias("holdout"),
        (seen & hit).alias("indicator"),
    )


def alternating_blocks(df: DataFrame, block: int, phase: int | None = None) -> DataFrame:
    """Hide every other block of positions; phases 0 and 1 together cover everything."""
    ph = F.expr(f"(pos div {block}) % 2")
    return df.withColumn("phase", ph) if phase is None else df.withColumn("hidden", ph == phase)


def scan_and_split(profile: DataFrame, n_test: int, seed: int = 42, require: Column | None = None) -> DataFrame:
    """Role per site: the pool is complete sites with summer and winter; the first n_test in hash order test."""
    ok = (F.col("completeness") >= F.col("min_completeness")) & F.col("has_summer") & F.col("has_winter")
    if require is not None:
        ok = ok & require
    d = profile.where("n_variables > 0").withColumns({"in_pool": F.coalesce(ok, F.lit(False)), "_h": hash_order(seed, F.col("site"))})
    test = lowest_per_group(d.where("in_pool").select(F.lit(1).alias("_g"), "site", "_h"), ["_g"], ["_h", "site"], n_test)
    d = d.join(test.select("site", F.lit(True).alias("_t")), "site", "left")
    role = F.when(F.col("_t"), "test").otherwise("train")
    return d.select("site", "in_pool", role.alias("role"))


def rebind_cases(cases: DataFrame, src: str, dst: str, shared: Sequence[str]) -> DataFrame:
    """The intervals of scenario ``src`` with only the shared variables hidden, relabelled ``dst``."""
    keep = F.array(*[F.lit(v) for v in sorted(shared)])
    return cases.where(F.col("scenario") == src).withColumns(
        {"scenario": F.lit(dst), "masked_vars": keep, "vars_key": F.lit(",".join(sorted(shared)))}
    )


def training_windows(
    panel: DataFrame, window: int, stride_prefix: int, stride_suffix: int, frac: float = 0.8, min_fraction: float = 0.8, min_each: int = 48, size: int = CHUNK
) -> DataFrame:
    """Windows inside the prefix or inside the suffix, never across, with enough observed cells.

    Coverage of a window is a difference of running counts at its two ends.
    """
    sites = panel.groupBy("site").agg((F.max("pos") + 1).alias("n")).withColumn("cut", F.floor(F.lit(frac) * F.col("n")).cast("bigint"))
    last = lambda hi: hi - window
    prefix = sites.where(last(F.col("cut")) >= 0).select(
        "site", F.lit("prefix").alias("part"), F.explode(F.sequence(F.lit(0).cast("bigint"), last(F.col("cut")), F.lit(stride_prefix).cast("bigint"))).alias("start_pos")
    )
    suffix = sites.where(last(F.col("n")) >= F.col("cut")).select(
        "site", F.lit("suffix").alias("part"), F.explode(F.sequence(F.col("cut"), last(F.col("n")), F.lit(stride_suffix).cast("bigint"))).alias("start_pos")
    )
    sums = prefix_sums(panel, {"c": F.col("value").isNotNull().cast("bigint")}, size=size).select(*SERIES, "pos", "c")
    hi = sums.select(*SERIES, (F.col("pos") - window + 1).alias("start_pos"), F.col("c").alias("_hi"))
    lo = sums.select(*SERIES, (F.col("pos") + 1).alias("start_pos"), F.col("c").alias("_lo"))
    w = prefix.unionByName(suffix).join(hi, ["site", "start_pos"]).join(lo, [*SERIES, "start_pos"], "left")
    seen = F.col("_hi") - F.coalesce("_lo", F.lit(0))
    return (
        w.groupBy("site", "part", "start_pos")
        .agg(F.sum(seen).alias("finite"), F.min(seen).alias("min_each"), F.count(F.lit(1)).alias("n_vars"))
        .where((F.col("finite") >= min_fraction * window * F.col("n_vars")) & (F.col("min_each") >= min_each))
        .select("site", "part", "start_pos", (F.col("start_pos") + window - 1).alias("end_pos"), "finite", "min_each")
    )


def centered_start(length: int) -> Column:
    """First position of a window of ``length`` centred on [start_pos, end_pos] and shifted to stay inside a series of ``n`` positions."""
    return F.greatest(F.lit(0), F.least(F.expr(f"(start_pos + end_pos + 1) div 2 - {length // 2}"), F.col("n") - length))


def centered_window(cases: DataFrame, panel: DataFrame, length: int = 512, value: str = "value") -> DataFrame:
    """A window of ``length`` positions centred on the hidden span and shifted to stay inside the series."""
    n = panel.groupBy("site").agg((F.max("pos") + 1).alias("n"))
    span = F.col("end_pos") - F.col("start_pos") + 1
    lo = centered_start(length)
    d = cases.join(n, "site").withColumn(
        "win_start", F.when(span > length, F.raise_error(F.lit("hidden span longer than the window")).cast("bigint")).otherwise(lo)
    )
    d = d.withColumn("win_end", F.col("win_start") + length - 1).select("case_id", "site", "masked_vars", "start_pos", "end_pos", "win_start", "win_end")
    rows = interval_join(d, panel, "win_start", "win_end")
    hidden = F.array_contains("masked_vars", F.col("variable")) & F.col("pos").between(F.col("start_pos"), F.col("end_pos"))
    seen = F.col(value).isNotNull() & ~hidden
    return rows.select(
        "case_id", "site", "variable", "pos", (F.col("pos") - F.col("win_start")).alias("pos_in"),
        F.when(seen, F.col(value)).otherwise(F.lit(0.0)).alias("x"), seen.alias("mask"), F.lit(True).alias("valid_time"),
    )


def pick_middle_case(cases: DataFrame, panel: DataFrame, scenario: str, gap: int, before: int, after: int, min_cov: float = 0.9, size: int = CHUNK) -> DataFrame:
    """The middle (index n div 2) of the eligible cases in (site, start) order.

    Eligible: coverage of [start-before, end+after] at least ``min_cov`` for each masked variable.
    """
    from gapweave.plans.storage import sequential_ids

    sums = prefix_sums(panel, {"c": F.col("value").isNotNull().cast("bigint")}, size=size).select(*SERIES, "pos", "c")
    n = panel.groupBy("site").agg((F.max("pos") + 1).alias("n"))
    c = cases.where((F.col("scenario") == scenario) & (F.col("gap_len") == gap)).join(n, "site")
    c = c.withColumns({"_lo": F.col("start_pos") - before, "_hi": F.col("end_pos") + after}).where("_lo >= 0 and _hi < n")
    v = c.withColumn("variable", F.explode("masked_vars"))
    hi = sums.select(*SERIES, F.col("pos").alias("_hi"), F.col("c").alias("_ch"))
    lo = sums.select(*SERIES, (F.col("pos") + 1).alias("_lo"), F.col("c").alias("_cl"))
    v = v.join(hi, [*SERIES, "_hi"]).join(lo, [*SERIES, "_lo"], "left")
    cov = (F.col("_ch") - F.coalesce("_cl", F.lit(0))) / (F.col("_hi") - F.col("_lo") + 1)
    good = v.groupBy("case_id", "site", "start_pos", "end_pos").agg(F.min(cov).alias("coverage")).where(F.col("coverage") >= min_cov)
    ids = sequential_ids(good, ["site", "start_pos", "case_id"], "_i", "middle")
    count = ids.agg(F.count(F.lit(1)).alias("_n"))
    return ids.join(count, F.expr("_i = _n div 2")).select("case_id", "site", "start_pos", "end_pos", "coverage", F.col("_n").alias("n_eligible"))


def probe_gaps(panel: DataFrame, gaps: Sequence[int], ctx: int, repeats: int, masked: Sequence[str], tail: int = 24, seed: int = 42, size: int = CHUNK) -> DataFrame:
    """Per site, gap and repeat the first start in hash order, of all in [ctx, n - h - tail) where every masked variable is observed throughout.

    Every feasible start takes part, so a site that has one is never left out.
    """
    ok = panel.where(F.col("variable").isin(list(masked))).groupBy("site", "pos").agg((F.count("value") == len(masked)).alias("ok"))
    bad = carry(ok, ("site",), next={"bad": F.when(~F.col("ok"), F.col("pos"))}, size=size)
    n = panel.groupBy("site").agg((F.max("pos") + 1).alias("n"))
    g = F.explode(F.array(*[F.lit(int(x)).cast("bigint") for x in gaps]))
    t = bad.where("ok").select("site", "pos", "bad").join(n, "site").withColumn("gap_len", g)
    t = t.where((F.col("pos") >= ctx) & (F.col("pos") < F.col("n") - F.col("gap_len") - tail) & (F.col("pos") + F.col("gap_len") <= F.coalesce(F.col("bad"), F.col("n"))))
    t = t.withColumn("repeat", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(repeats - 1).cast("bigint"))))
    draw = hash_order(seed, F.col("site"), F.col("gap_len"), F.col("repeat"), F.col("pos"))
    first = t.groupBy("site", "gap_len", "repeat").agg(F.min(F.struct(draw.alias("h"), F.col("pos"))).alias("first"))
    names = F.lit(",".join(sorted(masked)))
    return first.select("site", names.alias("masked_vars"), "gap_len", "repeat", F.col("first.pos").alias("start_pos"), (F.col("first.pos") + F.col("gap_len") - 1).alias("end_pos"))


def content_hash(panel: DataFrame) -> DataFrame:
    """Order-independent content hash per site: sums of two 32-bit row hashes, and the row count."""
    text = [F.col("variable"), micros("ts"), F.col("value")]
    return panel.groupBy("site").agg(
        F.sum(hash_order("a", *text)).alias("h1"), F.sum(hash_order("b", *text)).alias("h2"), F.count(F.lit(1)).alias("rows")
    )


def roles_by_name(panel: DataFrame, train: Sequence[str] | Column) -> DataFrame:
    cond = train if isinstance(train, Column) else F.col("site").isin(list(train))
    return panel.select("site").distinct().withColumn("role", F.when(cond, "train").otherwise("test"))
