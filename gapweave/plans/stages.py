"""The life cycle as tables: observations -> panel -> scaled panel -> manifest -> fills -> scores.

Each stage is written once to the session's shared folder and read back by everything after it,
so an analysis never recomputes the scan and a lost executor re-reads files instead of replaying
the whole lineage.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapweave.operators import grid, impute, masking, scaling
from gapweave.operators.forecast import Step
from gapweave.plans.storage import materialize, materialize_all
from gapweave.sources.events import event_observations

VARIABLES = ("click", "error", "purchase", "signup", "view")
GROUP_B = ("click", "error", "view")
BOUNDS = {v: (0.5, 250.0) for v in VARIABLES}
#: Events of a site on average; there are as many sites as the events give, eight at least. The first half of them trains.
EVENTS_PER_SITE, LEAST_SITES = 1250, 8
STEP6 = 6 * grid.HOUR
STEP3 = 3 * grid.HOUR
GAPS = (2, 4, 8)
LEFT_CTX = 24
SEASON = 4
SEASON_CTX = 40
REPEATS = 3
SEED = 42
MIN_COVERAGE = 0.6
MIN_PAIRS = 40
MIN_SIDE = 8
CONTEXT = 32
CONTEXTS = (4, 8, 16)
SCORED_MODELS = ("bidir", "linear", "ridge", "seasonal")


class _Memo(dict):
    """Stages by application and folder. A copy that travels with a pickled module starts empty: a session cannot be pickled."""

    def __reduce__(self):
        return _Memo, ()


_MEMO: dict[tuple[str, str], Stages] = _Memo()


class Stages:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def n_sites(self) -> int:
        """Sites grow with the events, so the panel does, and natural gaps stay as frequent as they are."""
        return max(LEAST_SITES, -(-self.table("events").count() // EVENTS_PER_SITE))

    @cached_property
    def obs6(self) -> DataFrame:
        """Step means per site and variable: the one pass over the raw events, pre-aggregated map-side."""
        return materialize(event_observations(self.table("events"), self.n_sites, STEP6), "obs6")

    @cached_property
    def obs3(self) -> DataFrame:
        return materialize(event_observations(self.table("events"), self.n_sites, STEP3), "obs3")

    @cached_property
    def panel6(self) -> DataFrame:
        return materialize(grid.regularize(self.obs6, STEP6), "panel6")

    @cached_property
    def panel3(self) -> DataFrame:
        return materialize(grid.regularize(self.obs3, STEP3), "panel3")

    @cached_property
    def roles(self) -> DataFrame:
        """Written, since the optimizer carries the condition on names over to every panel that meets it, and names of copies cost try_cast an exception a row."""
        return materialize(masking.roles_by_name(self.panel6, F.substring("site", 2, 10).try_cast("int") < self.n_sites // 2), "roles")

    @cached_property
    def scaler(self) -> DataFrame:
        return materialize(scaling.fit_minmax(self.panel6, "pooled_prefix", 0.8, self.roles), "scaler")

    @cached_property
    def scaled(self) -> DataFrame:
        return materialize(scaling.transform_minmax(self.panel6, self.scaler), "scaled")

    def of_role(self, df: DataFrame, role: str) -> DataFrame:
        return df.join(self.roles.where(F.col("role") == role).select("site"), "site", "left_semi")

    @property
    def combos(self) -> DataFrame:
        return masking.scenario_table(self.spark, VARIABLES, GROUP_B)

    @cached_property
    def manifest(self) -> DataFrame:
        test = self.of_role(self.panel6, "test")
        return materialize(masking.build_manifest(test, self.combos, GAPS, LEFT_CTX, REPEATS, SEED), "manifest")

    @cached_property
    def spans(self) -> DataFrame:
        """Case x variable anchors on the scaled panel."""
        return materialize(impute.merged_spans(self.manifest, self.scaled, "z"), "spans")

    @cached_property
    def references(self) -> DataFrame:
        from gapweave.operators import references as refs

        return materialize(refs.select_references(self.spans, self.scaled, self.roles, "z", 3, MIN_COVERAGE, MIN_PAIRS), "references")

    @cached_property
    def filled(self) -> DataFrame:
        """Scaled panel with natural gaps filled linearly (column z becomes complete)."""
        f = impute.impute_linear(self.scaled, "z", "zf")
        return materialize(f, "filled")

    @cached_property
    def predictions(self) -> DataFrame:
        """case_id, model, site, variable, pos, y_hat (scaled units)."""
        from gapweave.operators import forecast, references as refs

        self.warm()
        refs_of = lambda: refs.case_ridge(self.spans, self.references, self.scaled, "z", 1.0, MIN_PAIRS)
        init = lambda: forecast.bidirectional_init(
            self.spans, self.filled, forecast.seasonal_mean(SEASON), CONTEXT, MIN_SIDE, "zf"
        )
        linear = impute.case_linear(self.spans)
        fills = {
            "linear": lambda: linear,
            "seasonal": lambda: impute.case_seasonal(self.spans, self.scaled, SEASON, SEASON_CTX, "z"),
            "ridge": lambda: impute.final_fill(refs_of(), linear),
            "bidir": lambda: impute.final_fill(init(), linear),
        }
        label = lambda m, fn: lambda: fn().select("case_id", F.lit(m).alias("model"), "site", "variable", "pos", "y_hat")
        parts = materialize_all({m: label(m, fn) for m, fn in fills.items()}, "predictions")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def warm(self) -> None:
        """Build the inputs of the imputers side by side."""
        self.panel6  # noqa: B018
        with ThreadPoolExecutor(max_workers=2) as pool:
            for job in [pool.submit(lambda: self.manifest), pool.submit(lambda: self.filled)]:
                job.result()
        self.references  # noqa: B018

    @cached_property
    def cells(self) -> DataFrame:
        """Scored cells: prediction and truth in scaled and physical units (hidden and observed)."""
        truth = self.scaled.where("value is not null").select("site", "variable", "pos", "ts", "value", "z")
        d = self.predictions.join(truth, ["site", "variable", "pos"])
        d = scaling.inverse_minmax(d, self.scaler, "y_hat", "pred")
        case = self.manifest.select("case_id", "scenario", "vars_key", "gap_len", "repeat", "start_pos", "end_pos")
        return materialize(d.join(case, "case_id"), "cells", ("model",))

    def initial(self, bidirectional: bool = True, spans: DataFrame | None = None) -> DataFrame:
        """Estimate of round 0 over whole merged runs."""
        from gapweave.operators import forecast

        sp = self.spans if spans is None else spans
        p = forecast.bidirectional_init(sp, self.filled, forecast.seasonal_mean(SEASON), CONTEXT, MIN_SIDE, "zf", bidirectional, whole_run=True)
        return p.select("case_id", "site", "variable", "pos", "y_hat")

    def reference_values(self) -> DataFrame:
        """The chosen references over every case's run and contexts, in pieces."""
        from gapweave.operators import references as refs

        reach = self.spans.withColumns({"_lo": F.greatest(F.col("run_start") - CONTEXT, F.lit(0)), "_hi": F.col("run_end") + CONTEXT})
        return refs.reference_windows(reach, self.references, self.scaled, "z", "_lo", "_hi")

    def ridge_step(self, use_refs: bool = True, use_calendar: bool = True, bidirectional: bool = True) -> Step:
        """One refinement pass: ridge on the other variables, the calendar and three references."""
        from gapweave.operators import moments

        vals = self.reference_values() if use_refs else None
        design = moments.run_design(self.spans, self.filled, CONTEXT, "zf", VARIABLES, vals, 3, use_calendar, bidirectional)
        return design.step(1.0, MIN_SIDE, bidirectional)

    def refinement(self, both_sides: bool = True, **design: bool) -> tuple[DataFrame, Step]:
        """The written estimate of round 0 and the pass that follows, prepared side by side."""
        self.filled, self.references  # noqa: B018
        with ThreadPoolExecutor(max_workers=2) as pool:
            init = pool.submit(lambda: materialize(self.initial(both_sides), "init"))
            step = pool.submit(lambda: self.ridge_step(bidirectional=both_sides, **design))
            return init.result(), step.result()

    @cached_property
    def trace(self) -> DataFrame:
        """Estimates of refinement rounds 0-2; after round 0 the cells that changed, with what they were before."""
        from gapweave.operators import forecast

        return materialize(forecast.refine_trace(*self.refinement(), 2, written=True), "trace")

    @cached_property
    def round_scores(self) -> DataFrame:
        """MAE and NMAE of every case and variable after every round, physical units, hidden cells."""
        from gapweave.operators.report import round_errors

        bounds = self.manifest.select("case_id", "start_pos", "end_pos")
        d = self.trace.join(bounds, "case_id").where("pos between start_pos and end_pos")
        d = scaling.inverse_minmax(scaling.inverse_minmax(d, self.scaler, "y_hat", "pred"), self.scaler, "before", "pred_before")
        return materialize(round_errors(d, self.panel6, self.ranges, 2), "round-scores")

    @cached_property
    def ranges(self) -> DataFrame:
        return self.panel6.groupBy("site", "variable").agg((F.max("value") - F.min("value")).alias("full_range"))

    @cached_property
    def scores(self) -> DataFrame:
        from gapweave.operators.metrics import case_scores

        return materialize(case_scores(self.cells, self.ranges), "scores", ("model",))

    @cached_property
    def context_scores(self) -> DataFrame:
        """Variable-case scores of two forecasters at several context lengths (model, context, ...)."""
        from gapweave.operators import forecast
        from gapweave.operators.metrics import case_scores

        out = None
        for model, fc in (("last", forecast.last_value), ("seasonal_mean", forecast.seasonal_mean(SEASON))):
            for c in CONTEXTS:
                p = forecast.impute_forecast(self.spans, self.scaled, fc, c, value="z")
                p = p.withColumns({"model": F.lit(model), "context": F.lit(c).cast("bigint")})
                out = p if out is None else out.unionByName(p)
        truth = self.scaled.where("value is not null").select("site", "variable", "pos", "value")
        d = scaling.inverse_minmax(out.join(truth, ["site", "variable", "pos"]), self.scaler, "y_hat", "pred")
        d = d.join(self.manifest.select("case_id", "gap_len"), "case_id")
        return materialize(case_scores(d, self.ranges, ("model", "context", "case_id", "site", "variable", "gap_len")), "context_scores")


def stages(spark: SparkSession, sf_dir: str) -> Stages:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MEMO:
        _MEMO[key] = Stages(spark, sf_dir)
    return _MEMO[key]


def forget() -> None:
    """Drop the memo so the next query rebuilds every stage (used for honest timings)."""
    _MEMO.clear()

