"""Refinement by moments: the ridge of every run from Gram sums, solved in columns.

A run's two contexts enter its forecast only through sums: counts, sums and products of the covariates and the target. Those are added up once from
the panel. In a pass only cells inside runs of the case read estimates; context cells among them (another variable's run reaches
into this one's context) correct the sums by the difference of their products, all other context cells are never read again. The normal equations are
solved by elimination over arrays, and the gap's cells are one product of coefficients and covariates each. No Python worker takes part, and no row is as long as a run.

The sums are not centred before they are added, so values should be scaled (as the panel of the benchmark is). A covariate without any value, and the target's own place
among the covariates, are zero columns, which the ridge leaves out.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapweave.functions.exprs import literal
from gapweave.operators.forecast import Step, fuse_cell, interval_cells
from gapweave.operators.impute import CASE_VAR
from gapweave.operators.series import spread


@dataclass(frozen=True)
class RunDesign:
    """``sums(case_id, site, variable, side, moves, s)``: moments of the contexts as the panel gives them, not computed yet; a context ``moves`` if it has live cells.

    ``live``: the cells that read estimates; ``runs``: all runs. A design for forward passes alone has no contexts right of a run.
    """

    runs: DataFrame
    sums: DataFrame
    live: DataFrame
    variables: tuple[str, ...]
    width: int
    both_sides: bool = True

    def step(self, alpha: float = 1.0, min_side: int = 48, bidirectional: bool = True) -> Step:
        """One synchronous pass of the ridge with penalty ``alpha``. Fits of the contexts as the panel gives them are solved where their sums are made, which are written only for contexts with live cells; a pass corrects those."""
        from gapweave.plans.storage import materialize

        if bidirectional and not self.both_sides:
            raise ValueError("the design has no contexts right of a run")
        k = len(self.variables) + self.width
        side = "side = 'L'" if not bidirectional else "side <> 'G'"
        known = materialize(_fits(self.sums.where(side), k, alpha, min_side, ("moves",)).select(*CASE_VAR, "side", "b", F.when(F.col("moves"), F.col("s")).alias("s")), "fits")
        fits, moving = known.where("b is not null").drop("s"), known.where("s is not null").drop("b")

        def run(snapshot: DataFrame, active: DataFrame | None = None) -> DataFrame:
            some = lambda d: d if active is None else d.join(active, list(CASE_VAR), "left_semi")
            return _ridge_pass(self, some(moving), some(self.live), some(fits), snapshot, alpha, min_side, side)

        return Step(self.runs, run)


def _fits(sums: DataFrame, k: int, alpha: float, min_side: int, keep: Sequence[str] = ()) -> DataFrame:
    """``sums`` with intercept and coefficients ``b`` of every context that is long enough."""
    rows = sums.select(*CASE_VAR, "side", *keep, "s", F.when(F.expr("s[0]") >= min_side, F.expr(normal_rows("s", k, alpha))).alias("rows"))
    return rows.select(*CASE_VAR, "side", *keep, "s", F.when(F.col("rows").isNotNull(), F.expr(solve_sql("rows"))).alias("b"))


def moment_sums(x: str, y: str, k: int, weight: str = "1D") -> Column:
    """Sums of 1, x, y, the upper triangle of xx' and xy as one array: the system of an intercept and ``k`` coefficients, see ``normal_rows``.

    Written as text: some hundred products are parsed at once instead of being built call by call.
    """
    cells = ["1D", *[f"{x}[{i}]" for i in range(k)], y]
    return F.expr("array(" + ", ".join(f"sum({weight} * {cells[i]} * {cells[j]})" for i in range(k + 1) for j in range(i, k + 2)) + ")")


def normal_rows(s: str, k: int, alpha: float) -> str:
    """Rows of the normal equations (intercept first and free, ``k`` coefficients with penalty ``alpha``, right side last) from the sums ``s``."""
    place, n = {}, 0
    for i in range(k + 1):
        for j in range(i, k + 2):
            place[i, j] = place[j, i] = n
            n += 1
    cell = lambda i, j: f"{s}[{place[i, j]}]" + (f" + {float(alpha)}D" if i == j and i else "")
    return "array(" + ", ".join("array(" + ", ".join(cell(i, j) for j in range(k + 2)) + ")" for i in range(k + 1)) + ")"


def solve_sql(rows: str) -> str:
    """Solution of a positive definite system given as an array of rows, each with its right side at the end.

    Elimination without pivoting; the pivot row and column leave the system at every step, so the work is that of a triangle.
    """
    triangle = f"""aggregate(sequence(1, size({rows})), struct({rows} AS todo, slice({rows}, 1, 0) AS done),
        (acc, _) -> struct(transform(slice(acc.todo, 2, greatest(size(acc.todo) - 1, 0)),
            r -> zip_with(slice(r, 2, size(r) - 1), slice(acc.todo[0], 2, size(r) - 1), (a, b) -> a - r[0] / acc.todo[0][0] * b)) AS todo, concat(done, array(acc.todo[0])) AS done), acc -> acc.done)"""
    triangle = triangle.replace("concat(done,", "concat(acc.done,")
    return f"""aggregate(reverse({triangle}), cast(array() AS array<double>), (acc, r) -> concat(array(
        (element_at(r, -1) - aggregate(zip_with(slice(r, 2, size(r) - 2), acc, (a, b) -> a * b), 0D, (t, v) -> t + v)) / r[0]), acc))"""


def _vectors(est: str, variables: Sequence[str]) -> str:
    """Covariates with the target's own place at zero, then the fixed ones."""
    others = ", ".join(f"CASE WHEN target = {i} THEN 0D ELSE coalesce({est}[{i}], 0D) END" for i in range(len(variables)))
    return f"concat(array({others}), fixed)"


def run_design(
    spans: DataFrame, panel: DataFrame, ctx: int, value: str, variables: Sequence[str], refs: DataFrame | None = None, n_refs: int = 3, use_calendar: bool = True, both_sides: bool = True,
) -> RunDesign:
    """Design of every run of ``spans``: other variables, calendar and at most ``n_refs`` references; cells that read estimates are written once, read by every pass.

    The rows of a context are added up in the task where they meet the panel, so neither they nor their sums are shuffled. ``both_sides=False`` leaves the contexts right of a run out.
    """
    from gapweave.plans.storage import materialize

    width = (4 if use_calendar else 0) + (n_refs if refs is not None else 0)
    runs = spans.groupBy("case_id", "site").agg(F.collect_list(F.struct("run_start", "run_end")).alias("runs"))  # one a variable
    iv = spans.select(*CASE_VAR, "run_start", "run_end").join(runs, ["case_id", "site"])
    left = F.struct(F.greatest(F.col("run_start") - ctx, F.lit(0)).alias("a"), (F.col("run_start") - 1).alias("b"))
    right = F.struct((F.col("run_end") + 1).alias("a"), (F.col("run_end") + ctx).alias("b"))
    moves = F.exists("runs", lambda r: (r["run_start"] <= F.col("_w.b")) & (r["run_end"] >= F.col("_w.a")))
    contexts = iv.withColumn("_w", F.explode(F.array(left, right) if both_sides else F.array(left))).where("_w.a <= _w.b")
    contexts = contexts.select(*CASE_VAR, "run_start", "run_end", moves.alias("moves"), F.col("_w.a").alias("_lo"), F.col("_w.b").alias("_hi"))
    ahead = F.col("run_end") + ctx if both_sides else F.col("run_end")
    within = {"_lo": F.greatest(F.col("run_start") - ctx, F.lit(0), F.array_min("runs.run_start")), "_hi": F.least(ahead, F.array_max("runs.run_end"))}
    # read twice: by the contexts' sums and by the live cells
    refs = refs if refs is None or "values" not in refs.columns else materialize(refs, "design-references")
    rows = _design(interval_cells(contexts, panel, value, refs, use_calendar, ctx), variables, width, ("moves", "_bk"))
    rows = rows.select(*CASE_VAR, "side", "moves", "_bk", F.expr(_vectors("est", variables)).alias("x"), F.expr("est[target]").alias("y")).where("y is not null")
    sums = rows.groupBy(*CASE_VAR, "side", "moves", "_bk").agg(moment_sums("x", "y", len(variables) + width).alias("s")).drop("_bk")
    live = interval_cells(iv.withColumns(within), panel, value, refs, use_calendar).where(F.exists("runs", lambda r: F.col("pos").between(r["run_start"], r["run_end"])))
    return RunDesign(spans.select(*CASE_VAR).distinct(), sums, materialize(_design(live, variables, width), "design-live"), tuple(variables), width, both_sides)


def _design(cells: DataFrame, variables: Sequence[str], width: int, keep: Sequence[str] = ()) -> DataFrame:
    """Design rows with the panel's values of ``variables`` as ``est`` and ``width`` fixed covariates; ``i`` counts from the run's start, ``n`` is its length."""
    est = F.array(*[F.element_at("vals", F.lit(v)) for v in variables])
    fixed = F.expr(f"slice(concat(transform(fixed, v -> coalesce(v, 0D)), array_repeat(0D, {width})), 1, {width})")
    target = (F.array_position(F.array(*[F.lit(v) for v in variables]), F.col("variable")) - 1).cast("int")
    return cells.select(
        *CASE_VAR, *keep, "pos", "side", (F.col("pos") - F.col("run_start")).alias("i"), (F.col("run_end") - F.col("run_start") + 1).alias("n"), target.alias("target"), est.alias("est"), fixed.alias("fixed"),
    )


def _ridge_pass(design: RunDesign, moving: DataFrame, live: DataFrame, fits: DataFrame, snapshot: DataFrame, alpha: float, min_side: int, side: str) -> DataFrame:
    """Every run forecast from both contexts as one frozen snapshot of estimates has them; a run without a long enough side keeps its estimate."""
    names, k = design.variables, len(design.variables) + design.width
    snap = snapshot.groupBy("case_id", "site", "pos").agg(F.expr("map_from_entries(collect_list(struct(variable, y_hat)))").alias("snap"))
    now = ", ".join(f"coalesce(snap[{literal(v)}], est[{i}])" for i, v in enumerate(names))
    d = spread(live, "case_id", "site", "pos").join(snap, ["case_id", "site", "pos"], "left").withColumn("now", F.expr(f"array({now})"))
    # a context cell that moved counts once with its estimate and once, taken away, with the panel's value
    both = F.expr(f"inline(array(struct(1D AS sign, {_vectors('now', names)} AS x, now[target] AS y), struct(-1D AS sign, {_vectors('est', names)} AS x, est[target] AS y)))")
    moved = d.where(side).select(*CASE_VAR, "side", both).where("y is not null").groupBy(*CASE_VAR, "side").agg(moment_sums("x", "y", k, "sign").alias("ds"))
    sums = moving.join(moved, [*CASE_VAR, "side"]).withColumn("s", F.expr("zip_with(s, ds, (a, b) -> a + b)"))
    # few bytes, much work: without dealing them adaptive execution would leave all systems to one task
    anew = _fits(spread(sums, *CASE_VAR, "side"), k, alpha, min_side).select(*CASE_VAR, "side", F.col("b").alias("_b")).where("_b is not null")
    fits = fits.join(anew, [*CASE_VAR, "side"], "full").select(*CASE_VAR, "side", F.coalesce("_b", "b").alias("b"))
    gap = d.where("side = 'G'").select(*CASE_VAR, "pos", "i", "n", F.expr(_vectors("now", names)).alias("x"))
    value = F.expr("b[0] + " + " + ".join(f"b[{i + 1}] * x[{i}]" for i in range(k)))
    made = gap.join(fits, list(CASE_VAR)).select(*CASE_VAR, "pos", "i", "n", "side", value.alias("y")).groupBy(*CASE_VAR, "pos", "i", "n")
    made = made.agg(F.max(F.when(F.col("side") == "L", F.col("y"))).alias("f"), F.max(F.when(F.col("side") == "R", F.col("y"))).alias("g"))
    made = made.select(*CASE_VAR, "pos", fuse_cell(F.col("f"), F.col("g"), F.col("i"), F.col("n")).alias("y_hat"))
    keys = [*CASE_VAR, "pos"]
    before = snapshot.select(*keys, F.col("y_hat").alias("_old"))
    return before.join(made, keys, "left").select(*keys, F.coalesce("y_hat", "_old").alias("y_hat"))
