"""One global lag-tree model over all series, predicted recursively for all runs at once."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapweave.operators.forecast import _emit, _hidden_only, context_arrays
from gapweave.operators.series import CHUNK, shift


def lag_table(panel: DataFrame, lags: int, season: int, value: str, size: int = CHUNK) -> DataFrame:
    """Training rows: target y with its last ``lags`` filled values and phase."""
    cols = {f"lag{i}": (value, -i) for i in range(1, lags + 1)}
    d = shift(panel, cols, size=size).where(f"lag{lags} is not null")
    return d.withColumn("phase", (F.col("pos") % season).cast("double"))


def fit_tabular(rows: DataFrame, lags: int, value: str, kind: str = "gbt", seed: int = 42, rounds: int = 10, depth: int = 4):
    names = [f"lag{i}" for i in range(1, lags + 1)] + ["phase"]
    train = VectorAssembler(inputCols=names, outputCol="features").transform(rows).select("features", F.col(value).alias("label"))
    if kind == "gbt":
        learner = GBTRegressor(maxIter=rounds, maxDepth=depth, seed=seed)
    elif kind == "forest":
        learner = RandomForestRegressor(numTrees=rounds, maxDepth=depth, seed=seed)
    else:
        raise ValueError(f"unknown kind {kind!r}")
    return learner.fit(train)


def impute_tabular(spans: DataFrame, panel: DataFrame, model, lags: int, season: int, value: str = "value", steps: int = 24) -> DataFrame:
    """Recursive prediction to the end of every run: a run is a row with its last values as an array, each step a projection.

    A context shorter than ``lags`` is padded with its oldest value, a missing one with the nearest value right of the run; only a series
    without any value gives no rows. After every ``steps`` steps the runs that go on are written out, so the plan stays short and
    finished runs are not carried along.
    """
    from gapweave.plans.storage import materialize

    d = context_arrays(spans, panel, lags, value)
    pad = lambda x: F.array_repeat(x, F.greatest(F.lit(lags) - F.size("left"), F.lit(0)))
    oldest = F.when(F.size("left") > 0, F.get("left", F.lit(0))).otherwise(F.element_at("right", -1))
    d = d.where((F.size("left") > 0) | (F.size("right") > 0)).withColumn("_hist", F.concat(pad(oldest), F.slice("left", F.greatest(F.size("left") - lags + 1, F.lit(1)), lags)))
    d = d.withColumns({"_out": F.array().cast("array<double>"), "_len": F.col("run_end") - F.col("run_start") + 1})
    names = [f"lag{i}" for i in range(1, lags + 1)] + ["phase"]
    asm = VectorAssembler(inputCols=names, outputCol="features")
    base = list(d.columns)
    d = materialize(d, "tabular-runs")
    longest = int(d.agg(F.max("_len")).first()[0] or 0)
    done = d.where("false")
    for at in range(0, longest, steps):
        for step in range(at, min(at + steps, longest)):
            d = d.withColumns({f"lag{i}": F.element_at("_hist", -i) for i in range(1, lags + 1)})
            d = d.withColumn("phase", ((F.col("run_start") + step) % season).cast("double"))
            d = model.transform(asm.transform(d))
            d = d.withColumns({"_hist": F.concat(F.slice("_hist", 2, lags - 1), F.array("prediction")), "_out": F.array_append("_out", F.col("prediction"))}).select(*base)
        d = materialize(d, "tabular-steps")
        done = done.unionByName(d.where(F.col("_len") <= at + steps))
        d = d.where(F.col("_len") > at + steps)
    return _hidden_only(_emit(done, F.slice("_out", F.lit(1), F.col("_len").cast("int"))))
