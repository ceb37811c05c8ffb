"""Residual-based spike detection, injection and restoration."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapweave.functions.exprs import hash_order, hash_unit, ratio
from gapweave.functions.ranks import exact_quantiles
from gapweave.operators.masking import _global_rank
from gapweave.operators.series import SERIES
from gapweave.plans.storage import materialize

# (panel with NULLs at hidden cells, value column, output column) -> panel with the fill
PanelImputer = Callable[[DataFrame, str, str], DataFrame]


def scan_residuals(panel: DataFrame, imputer: PanelImputer, block: int = 6, targets: Sequence[str] | None = None) -> DataFrame:
    """Observation minus reconstruction, each cell reconstructed while its block is hidden.

    Both phases run as one job: the phase is part of the series key. Natural gaps have no residual;
    variables outside ``targets`` are never hidden and not scored.
    """
    is_target = F.lit(True) if targets is None else F.col("variable").isin(list(targets))
    d = panel.select(*SERIES, "pos", "value").withColumn("phase", F.explode(F.array(F.lit(0), F.lit(1))))
    hidden = is_target & (F.expr(f"(pos div {block}) % 2") == F.col("phase"))
    d = d.withColumns({"_hid": hidden, "_masked": F.when(~hidden, F.col("value"))})
    d = d.withColumn("_site", F.col("site")).withColumn("site", F.concat_ws("#", "site", "phase"))
    out = imputer(d, "_masked", "recon").where("_hid")
    return out.select(F.col("_site").alias("site"), "variable", "pos", "value", "recon", (F.col("value") - F.col("recon")).alias("residual"))


def mad_zscore(res: DataFrame, keys: Sequence[str] = SERIES, col: str = "residual") -> DataFrame:
    """|r - median| / (1.4826 MAD); NULL with fewer than five values or a vanishing MAD.

    The medians, a row per key, are written before the deviations are counted from them.
    """
    med = materialize(exact_quantiles(res, keys, F.col(col), {"_med": 0.5}), "medians")
    d = res.join(med, list(keys), "left")
    mad = materialize(exact_quantiles(d, keys, F.abs(F.col(col) - F.col("_med")), {"_m": 0.5}), "deviations")
    d = d.join(mad.select(*keys, (F.col("_m") * 1.4826).alias("_mad")), list(keys), "left")
    ok = (F.col("_n") >= 5) & (F.col("_mad") >= 1e-9)
    return d.withColumn("z", F.when(ok, F.try_divide(F.abs(F.col(col) - F.col("_med")), F.col("_mad")))).drop("_med", "_n", "_mad")


def spike_flag(df: DataFrame, tau: float = 3.5) -> DataFrame:
    return df.withColumn("flag", F.coalesce(F.col("z") > tau, F.lit(False)))


def consensus(flags: DataFrame, keys: Sequence[str] = (*SERIES, "pos"), report_from: float = 0.5) -> DataFrame:
    """Share of models flagging each cell; ``reported`` from one half."""
    c = flags.groupBy(*keys).agg(F.avg(F.col("flag").cast("double")).alias("consensus"), F.count(F.lit(1)).alias("n_models"))
    return c.withColumn("reported", F.col("consensus") >= report_from)


def inject_spikes(panel: DataFrame, n: int = 20, seed: int = 42) -> DataFrame:
    """``n`` distinct observed positions per series move by +-(4..8) sd; true_value keeps the original."""
    stats = panel.groupBy(*SERIES).agg(F.stddev_samp("value").alias("_sd"))
    stats = stats.withColumn("_sd", F.when(F.coalesce("_sd", F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col("_sd")))
    key = [F.col("site"), F.col("variable"), F.col("pos")]
    seen = panel.where("value is not null").select(*SERIES, "pos", hash_order(seed, *key).alias("_h"))
    chosen = _global_rank(seen, SERIES, "_h", "pos").where(F.col("rank") <= n).select(*SERIES, "pos", F.lit(True).alias("injected"))
    d = panel.join(chosen, [*SERIES, "pos"], "left").join(stats, list(SERIES))
    sign = F.when(hash_order(seed, F.lit("sign"), *key) % 2 == 0, 1.0).otherwise(-1.0)
    size = 4.0 + 4.0 * hash_unit(seed, F.lit("size"), *key)
    hit = F.coalesce("injected", F.lit(False))
    return d.select(
        *[c for c in panel.columns if c != "value"],
        F.when(hit, F.col("value") + sign * size * F.col("_sd")).otherwise(F.col("value")).alias("value"),
        hit.alias("injected"),
        F.when(hit, F.col("value")).alias("true_value"),
    )


def _prf(flag: Column, truth: Column) -> dict[str, Column]:
    return {"tp": F.count_if(flag & truth), "fp": F.count_if(flag & ~truth), "fn": F.count_if(~flag & truth)}


def detection_prf(df: DataFrame, keys: Sequence[str], flag: Column | None = None) -> DataFrame:
    """Precision, recall and F1; undefined is NULL, and F1 is also NULL when either is zero."""
    f = F.col("flag") if flag is None else flag
    d = df.groupBy(*keys).agg(*[c.alias(k) for k, c in _prf(f, F.col("injected")).items()], F.count_if("injected").alias("n_injected"))
    d = d.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    p, r = F.col("precision"), F.col("recall")
    return d.withColumn("f1", F.when((p > 0) & (r > 0), ratio(2 * p * r, p + r)))


def tau_sweep(df: DataFrame, taus: Sequence[float], keys: Sequence[str]) -> DataFrame:
    """Detection quality on a grid of thresholds.

    Each cell only counts once, under the number of thresholds it exceeds; the totals per threshold
    are sums over that small histogram.
    """
    hist = _tau_histogram(df, taus, keys)
    t = hist.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(len(taus) - 1))))
    tau = F.element_at(F.array(*[F.lit(float(x)) for x in taus]), F.col("_k") + 1)
    over = F.col("_over") > F.col("_k")
    g = t.groupBy(*keys, tau.alias("tau")).agg(
        F.sum(F.when(over, F.col("pos_n")).otherwise(0)).alias("tp"),
        F.sum(F.when(over, F.col("neg_n")).otherwise(0)).alias("fp"),
        F.sum(F.when(~over, F.col("pos_n")).otherwise(0)).alias("fn"),
        F.sum("pos_n").alias("n_injected"),
        F.sum("neg_n").alias("n_clean"),
    )
    g = g.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    p, r = F.col("precision"), F.col("recall")
    return g.withColumn("f1", F.when((p > 0) & (r > 0), ratio(2 * p * r, p + r)))


def _tau_histogram(df: DataFrame, taus: Sequence[float], keys: Sequence[str]) -> DataFrame:
    over = sum((F.coalesce((F.col("z") > float(t)).cast("int"), F.lit(0)) for t in sorted(taus)), F.lit(0))
    return df.groupBy(*keys, over.alias("_over")).agg(F.count_if("injected").alias("pos_n"), F.count_if(~F.col("injected")).alias("neg_n"))


def roc_auc(df: DataFrame, taus: Sequence[float], keys: Sequence[str]) -> DataFrame:
    """Trapezoid area under (FPR, TPR) of z > tau over the threshold grid, points ordered by FPR."""
    from pyspark.sql import Window

    t = tau_sweep(df, taus, keys)
    pts = t.select(*keys, "tau", ratio(F.col("fp"), F.col("n_clean")).alias("fpr"), ratio(F.col("tp"), F.col("n_injected")).alias("tpr"))
    w = Window.partitionBy(*keys).orderBy("fpr", "tpr")
    area = (F.col("fpr") - F.lag("fpr").over(w)) * (F.col("tpr") + F.lag("tpr").over(w)) / 2.0
    return pts.withColumn("_a", area).groupBy(*keys).agg(F.sum("_a").alias("auc"), F.count(F.lit(1)).alias("n_points"))


def restore_flagged(panel: DataFrame, flags: DataFrame, imputer: PanelImputer) -> DataFrame:
    """Flagged cells become missing and are filled by the same imputer; ``restored`` is the full series."""
    f = flags.where("flag").select(*SERIES, "pos", F.lit(True).alias("_f"))
    d = panel.join(f, [*SERIES, "pos"], "left").withColumn("_masked", F.when(F.col("_f").isNull(), F.col("value")))
    out = imputer(d, "_masked", "restored")
    return out.select(*panel.columns, F.coalesce("_f", F.lit(False)).alias("was_flagged"), "restored")


def restoration_error(restored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """MAE at injected positions before and after restoration."""
    d = restored.where("injected")
    return d.groupBy(*keys).agg(
        F.avg(F.abs(F.col("value") - F.col("true_value"))).alias("mae_before"),
        F.avg(F.abs(F.col("restored") - F.col("true_value"))).alias("mae_after"),
        F.count(F.lit(1)).alias("n"),
    )
