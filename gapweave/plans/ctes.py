"""Building blocks of the DuckDB comparison queries: named CTEs with dependencies.

They state the semantics directly (per-case joins, plain windows) and deliberately do not follow
the Spark plans, so that agreement means something.
"""

from __future__ import annotations

CTES: dict[str, tuple[tuple[str, ...], str]] = {}
KEPT: set[str] = set()


def cte(name: str, deps: str, body: str, kept: bool = False) -> None:
    """``kept``: worked out once however often it is read."""
    CTES[name] = (tuple(deps.split()), body.strip())
    if kept:
        KEPT.add(name)


def sql(needs: str, select: str) -> str:
    """SELECT with every CTE it needs, dependencies first."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)

    for n in needs.split():
        visit(n)
    if not order:
        return select.strip()
    body = select.strip()  # a body starting with a comma adds CTEs of its own
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS {'MATERIALIZED ' * (n in KEPT)}({CTES[n][1]})" for n in order) + "\n" + body


def r(expr: str, alias: str, digits: int = 6) -> str:
    """Output column rounded with the same tie guard as the engine; adding zero turns -0.0 into 0.0."""
    return f"round(CAST({expr} AS DOUBLE) + 1e-9::DOUBLE, {digits}) + 0.0 AS {alias}"


def hsh(*parts: str) -> str:
    return "CAST('0x' || substr(md5(concat_ws('|', " + ", ".join(parts) + ")), 1, 8) AS BIGINT)"


def unit(*parts: str) -> str:
    return f"({hsh(*parts)} / 4294967296.0::DOUBLE)"


cte("nsites", "", "SELECT greatest(8, (count(*) + 1249) // 1250) AS k FROM events", True)
for n, h in (("6", 6), ("3", 3)):
    us = h * 3600
    cte(f"obs{n}", "nsites", f"""
SELECT 's' || CAST(user_id % (SELECT k FROM nsites) AS VARCHAR) AS site, event_type AS variable, time_bucket(INTERVAL '{h} hours', ts) AS ts,
       CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / CAST(100 * count(*) AS DOUBLE) AS value
FROM events GROUP BY 1, 2, 3""")
    cte(f"span{n}", f"obs{n}", f"SELECT site, min(ts) AS lo, max(ts) AS hi, CAST(epoch(max(ts) - min(ts)) / {us} AS BIGINT) + 1 AS n FROM obs{n} GROUP BY 1")
    cte(f"panel{n}", f"obs{n} span{n}", f"""
SELECT g.site, v.variable, g.pos, g.ts, o.value
FROM (SELECT site, pos, lo + CAST(pos AS INTEGER) * INTERVAL '{h} hours' AS ts FROM (SELECT site, lo, unnest(range(n)) AS pos FROM span{n})) g
JOIN (SELECT DISTINCT site, variable FROM obs{n}) v ON v.site = g.site
LEFT JOIN obs{n} o ON o.site = g.site AND o.variable = v.variable AND o.ts = g.ts""")
    cte(f"nb{n}", f"panel{n}", f"""
SELECT *, max(CASE WHEN value IS NOT NULL THEN pos END) OVER pre AS prev_pos, min(CASE WHEN value IS NOT NULL THEN pos END) OVER post AS next_pos,
       max(pos) OVER (PARTITION BY site, variable) + 1 AS n
FROM panel{n}
WINDOW pre AS (PARTITION BY site, variable ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
       post AS (PARTITION BY site, variable ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
    cte(f"lin{n}", f"nb{n}", f"""
SELECT b.*, p.value AS prev_val, q.value AS next_val,
       CASE WHEN b.value IS NOT NULL THEN b.value WHEN b.prev_pos IS NULL THEN q.value WHEN b.next_pos IS NULL THEN p.value
            ELSE p.value + (q.value - p.value) * (CAST(b.pos - b.prev_pos AS DOUBLE) / (b.next_pos - b.prev_pos)) END AS filled
FROM nb{n} b LEFT JOIN panel{n} p ON p.site = b.site AND p.variable = b.variable AND p.pos = b.prev_pos
LEFT JOIN panel{n} q ON q.site = b.site AND q.variable = b.variable AND q.pos = b.next_pos""")
    cte(f"runs{n}", f"nb{n}", f"""
SELECT site, variable, coalesce(prev_pos, -1) + 1 AS start_pos, coalesce(next_pos, n) - 1 AS end_pos, n
FROM nb{n} WHERE value IS NULL GROUP BY ALL""")
    cte(f"roles{n}", f"panel{n} nsites", f"SELECT DISTINCT site, CASE WHEN CAST(substr(site, 2) AS BIGINT) < (SELECT k FROM nsites) // 2 THEN 'train' ELSE 'test' END AS role FROM panel{n}")
    cte(f"cut{n}", f"span{n}", f"SELECT site, n, CAST(floor(0.8::DOUBLE * n) AS BIGINT) AS cut FROM span{n}")

cte("scaler", "panel6 roles6 cut6", """
SELECT variable, min(value) AS lo, max(value) AS hi, count(value) AS n_obs
FROM panel6 JOIN roles6 USING (site) JOIN cut6 USING (site) WHERE role = 'train' AND pos < cut GROUP BY 1""")
cte("scaled", "panel6 scaler", """
SELECT p.*, CASE WHEN s.lo IS NULL THEN p.value ELSE (p.value - s.lo) / (CASE WHEN s.hi = s.lo THEN 1.0::DOUBLE ELSE s.hi - s.lo END) END AS z
FROM panel6 p LEFT JOIN scaler s USING (variable)""")
cte("combos", "", """
SELECT scenario, vars_key, len(string_split(vars_key, ',')) AS n_vars, unnest(string_split(vars_key, ',')) AS variable
FROM (VALUES ('A', 'click'), ('A', 'error'), ('A', 'purchase'), ('A', 'signup'), ('A', 'view'), ('B', 'click,error,view'),
             ('C', 'click,error,purchase,signup,view')) t(scenario, vars_key)""")
cte("gaps", "", "SELECT CAST(unnest([2, 4, 8]) AS BIGINT) AS gap_len")
cte("okpos", "panel6 combos", """
SELECT p.site, c.scenario, c.vars_key, p.pos, count(p.value) = max(c.n_vars) AS ok FROM panel6 p JOIN combos c USING (variable) GROUP BY 1, 2, 3, 4""")
cte("feasall", "okpos gaps span6", """
SELECT o.site, o.scenario, o.vars_key, g.gap_len, o.pos AS start_pos
FROM (SELECT *, min(CASE WHEN NOT ok THEN pos END) OVER (PARTITION BY site, scenario, vars_key ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bad FROM okpos) o
JOIN span6 s USING (site) CROSS JOIN gaps g
WHERE o.pos >= 24 AND o.ok AND o.pos + g.gap_len <= coalesce(o.bad, s.n)""")
cte("feas", "feasall roles6", "SELECT f.* FROM feasall f JOIN roles6 USING (site) WHERE role = 'test'")


def greedy(src: str, out: str) -> None:
    """Three picks in hash order, each round the smallest hash that overlaps no earlier pick."""
    key = hsh("42", "site", "scenario", "vars_key", "gap_len", "start_pos") + " * 1048576 + start_pos"
    g = "site, scenario, vars_key, gap_len"
    cte(f"{out}_h", src, f"SELECT *, {key} AS k FROM {src}")
    cte(f"{out}_1", f"{out}_h", f"SELECT {g}, min(k) % 1048576 AS s1 FROM {out}_h GROUP BY ALL")
    cte(f"{out}_2", f"{out}_h {out}_1", f"SELECT {g}, min(k) % 1048576 AS s2 FROM {out}_h JOIN {out}_1 USING ({g}) WHERE abs(start_pos - s1) >= gap_len GROUP BY ALL")
    cte(f"{out}_3", f"{out}_h {out}_1 {out}_2", f"""
SELECT {g}, min(k) % 1048576 AS s3 FROM {out}_h JOIN {out}_1 USING ({g}) JOIN {out}_2 USING ({g})
WHERE abs(start_pos - s1) >= gap_len AND abs(start_pos - s2) >= gap_len GROUP BY ALL""")
    cte(out, f"{out}_1 {out}_2 {out}_3", f"""
SELECT *, row_number() OVER (PARTITION BY {g} ORDER BY start_pos) - 1 AS repeat
FROM (SELECT {g}, s1 AS start_pos FROM {out}_1 UNION ALL SELECT {g}, s2 FROM {out}_2 UNION ALL SELECT {g}, s3 FROM {out}_3)""")


greedy("feas", "picks")
cte("manifest", "picks panel6", """
SELECT row_number() OVER (ORDER BY site, scenario, vars_key, gap_len, repeat) - 1 AS case_id, *, start_pos + gap_len - 1 AS end_pos,
       (SELECT min(ts) FROM panel6 p WHERE p.site = k.site AND p.pos = k.start_pos) AS start_ts,
       (SELECT min(ts) FROM panel6 p WHERE p.site = k.site AND p.pos = k.start_pos + k.gap_len - 1) AS end_ts,
       len(string_split(vars_key, ',')) AS n_vars
FROM picks k""")
cte("cv", "manifest", "SELECT *, unnest(string_split(vars_key, ',')) AS variable FROM manifest")
cte("hid", "cv", "SELECT case_id, site, variable, unnest(range(start_pos, end_pos + 1)) AS pos FROM cv")
cte("spans", "cv scaled", """
SELECT c.*, a.n, a.lp AS left_pos, a.lv AS left_val, a.rp AS right_pos, a.rv AS right_val, coalesce(a.lp + 1, 0) AS run_start, coalesce(a.rp - 1, a.n - 1) AS run_end
FROM cv c JOIN (
  SELECT c.case_id, c.variable, max(p.pos) + 1 AS n,
         max(p.pos) FILTER (WHERE p.z IS NOT NULL AND p.pos < c.start_pos) AS lp, arg_max(p.z, p.pos) FILTER (WHERE p.z IS NOT NULL AND p.pos < c.start_pos) AS lv,
         min(p.pos) FILTER (WHERE p.z IS NOT NULL AND p.pos > c.end_pos) AS rp, arg_min(p.z, p.pos) FILTER (WHERE p.z IS NOT NULL AND p.pos > c.end_pos) AS rv
  FROM cv c JOIN scaled p ON p.site = c.site AND p.variable = c.variable GROUP BY 1, 2) a
ON a.case_id = c.case_id AND a.variable = c.variable""")
LINE = """CASE WHEN {lp} IS NULL THEN {rv} WHEN {rp} IS NULL THEN {lv} WHEN {lp} = {rp} THEN {lv}
 ELSE {lv} + ({rv} - {lv}) * (CAST({p} - {lp} AS DOUBLE) / ({rp} - {lp})) END"""
cte("p_linear", "spans", "SELECT case_id, site, variable, pos, " + LINE.format(p="pos", lp="left_pos", lv="left_val", rp="right_pos", rv="right_val") + """ AS y_hat
FROM (SELECT *, unnest(range(start_pos, end_pos + 1)) AS pos FROM spans)""")
cte("p_seasonal", "spans scaled", """
SELECT case_id, site, variable, pos, coalesce(f, """ + LINE.format(p="pos", lp="pp", lv="pv", rp="np", rv="nv") + """) AS y_hat FROM (
  SELECT *, coalesce(last_value(CASE WHEN f IS NOT NULL THEN pos END IGNORE NULLS) OVER a, left_pos) AS pp, coalesce(last_value(f IGNORE NULLS) OVER a, left_val) AS pv,
         coalesce(first_value(CASE WHEN f IS NOT NULL THEN pos END IGNORE NULLS) OVER b, right_pos) AS np, coalesce(first_value(f IGNORE NULLS) OVER b, right_val) AS nv
  FROM (
    SELECT m.case_id, m.site, m.variable, m.pos, m.start_pos, m.end_pos, m.left_pos, m.left_val, m.right_pos, m.right_val,
      coalesce(arg_max(p.z, p.pos) FILTER (WHERE p.pos < m.run_start AND p.pos >= greatest(0, m.run_start - 40)),
               arg_min(p.z, p.pos) FILTER (WHERE p.pos > m.run_end AND p.pos < least(m.n, m.run_end + 1 + 40))) AS f
    FROM (SELECT *, unnest(range(run_start, run_end + 1)) AS pos FROM spans) m
    LEFT JOIN scaled p ON p.site = m.site AND p.variable = m.variable AND p.z IS NOT NULL AND p.pos % 4 = m.pos % 4 GROUP BY ALL)
  WINDOW a AS (PARTITION BY case_id, variable ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         b AS (PARTITION BY case_id, variable ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
WHERE pos BETWEEN start_pos AND end_pos""")
cte("bank", "scaled roles6", "SELECT s.site AS ref, s.variable, s.ts, s.z AS y FROM scaled s JOIN roles6 r ON r.site = s.site WHERE r.role = 'train' AND s.z IS NOT NULL")
cte("aligned", "scaled bank", """
SELECT t.site, t.variable, b.ref, count(*) AS ref_finite, (SELECT count(*) FROM scaled u WHERE u.site = t.site AND u.variable = t.variable) AS length
FROM scaled t JOIN bank b ON b.variable = t.variable AND b.ts = t.ts AND b.ref <> t.site GROUP BY t.site, t.variable, b.ref""")
cte("refcorr", "spans scaled bank aligned", """
SELECT case_id, site, variable, ref, pairs, abs((n * sxy - sx * sy) / (sqrt(n * sxx - sx * sx) * sqrt(n * syy - sy * sy))) AS abs_r FROM (
  SELECT s.case_id, s.site, s.variable, b.ref, count(*) AS pairs, CAST(count(*) AS DOUBLE) AS n, sum(t.z) AS sx, sum(b.y) AS sy, sum(t.z * t.z) AS sxx, sum(b.y * b.y) AS syy, sum(t.z * b.y) AS sxy
  FROM spans s JOIN scaled t ON t.site = s.site AND t.variable = s.variable AND t.z IS NOT NULL AND t.pos NOT BETWEEN s.start_pos AND s.end_pos
  JOIN bank b ON b.variable = t.variable AND b.ts = t.ts AND b.ref <> t.site
  JOIN aligned a ON a.site = s.site AND a.variable = s.variable AND a.ref = b.ref AND CAST(a.ref_finite AS DOUBLE) / a.length >= 0.6
  GROUP BY ALL) WHERE pairs >= 40 AND n * sxx - sx * sx > 1e-12 AND n * syy - sy * sy > 1e-12""")
cte("refs", "refcorr", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id, variable ORDER BY round(abs_r, 9) DESC, ref DESC) AS rank FROM refcorr) WHERE rank <= 3""")
cte("refser", "refs scaled", """
SELECT site, variable, ref, pos, ts, CASE WHEN y IS NOT NULL THEN y ELSE """ + LINE.format(p="pos", lp="pp", lv="pv", rp="np", rv="nv") + """ END AS x FROM (
  SELECT *, last_value(CASE WHEN y IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS pp, last_value(y IGNORE NULLS) OVER a AS pv,
         first_value(CASE WHEN y IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS np, first_value(y IGNORE NULLS) OVER b AS nv
  FROM (SELECT t.site, t.variable, t.ref, s.pos, s.ts, q.z AS y FROM (SELECT DISTINCT site, variable, ref FROM refs) t
        JOIN scaled s ON s.site = t.site AND s.variable = t.variable LEFT JOIN scaled q ON q.site = t.ref AND q.variable = t.variable AND q.ts = s.ts)
  WINDOW a AS (PARTITION BY site, variable, ref ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         b AS (PARTITION BY site, variable, ref ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""")
cte("design", "refs refser scaled spans", """
SELECT s.case_id, s.site, s.variable, t.pos, t.z AS y, t.pos BETWEEN s.start_pos AND s.end_pos AS inside,
       coalesce(max(x.x) FILTER (WHERE f.rank = 1), 0) AS x1, coalesce(max(x.x) FILTER (WHERE f.rank = 2), 0) AS x2, coalesce(max(x.x) FILTER (WHERE f.rank = 3), 0) AS x3
FROM spans s JOIN refs f ON f.case_id = s.case_id AND f.variable = s.variable
JOIN refser x ON x.site = s.site AND x.variable = s.variable AND x.ref = f.ref
JOIN scaled t ON t.site = s.site AND t.variable = s.variable AND t.pos = x.pos GROUP BY ALL""")
cte("gram", "design", """
SELECT case_id, variable, m, sy / m AS ym, s1 / m AS m1, s2 / m AS m2, s3 / m AS m3, q11 - s1 * s1 / m + 1 AS a, q12 - s1 * s2 / m AS b, q13 - s1 * s3 / m AS c,
       q22 - s2 * s2 / m + 1 AS d, q23 - s2 * s3 / m AS e, q33 - s3 * s3 / m + 1 AS f, p1 - s1 * sy / m AS u, p2 - s2 * sy / m AS v, p3 - s3 * sy / m AS w
FROM (SELECT case_id, variable, CAST(count(*) AS DOUBLE) AS m, sum(y) AS sy, sum(x1) AS s1, sum(x2) AS s2, sum(x3) AS s3, sum(x1*x1) AS q11, sum(x1*x2) AS q12, sum(x1*x3) AS q13,
             sum(x2*x2) AS q22, sum(x2*x3) AS q23, sum(x3*x3) AS q33, sum(x1*y) AS p1, sum(x2*y) AS p2, sum(x3*y) AS p3
      FROM design WHERE NOT inside AND y IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 40)""")
cte("beta", "gram", """
SELECT *, (u*(d*f-e*e) - b*(v*f-w*e) + c*(v*e-w*d)) / det AS w1, (a*(v*f-w*e) - u*(b*f-c*e) + c*(b*w-c*v)) / det AS w2, (a*(d*w-e*v) - b*(b*w-c*v) + u*(b*e-c*d)) / det AS w3
FROM (SELECT *, a*(d*f-e*e) - b*(b*f-c*e) + c*(b*e-c*d) AS det FROM gram)""")
cte("p_ridge", "design beta p_linear", """
SELECT l.case_id, l.site, l.variable, l.pos, coalesce(r.y_hat, l.y_hat) AS y_hat FROM p_linear l LEFT JOIN (
  SELECT g.case_id, g.variable, g.pos, b.ym + b.w1 * (g.x1 - b.m1) + b.w2 * (g.x2 - b.m2) + b.w3 * (g.x3 - b.m3) AS y_hat
  FROM design g JOIN beta b ON b.case_id = g.case_id AND b.variable = g.variable WHERE g.inside) r
ON r.case_id = l.case_id AND r.variable = l.variable AND r.pos = l.pos""")
cte("zfill", "lin6 scaler", "SELECT p.site, p.variable, p.pos, p.ts, (p.filled - s.lo) / (s.hi - s.lo) AS zf, (p.value - s.lo) / (s.hi - s.lo) AS z, p.n FROM lin6 p JOIN scaler s USING (variable)")
cte("runcells", "spans", "SELECT *, unnest(range(run_start, run_end + 1)) AS pos, run_start - greatest(0, run_start - 32) AS n_left, least(n - 1, run_end + 32) - run_end AS n_right FROM spans")
cte("sidefc", "runcells zfill", """
SELECT c.case_id, c.site, c.variable, c.pos, c.start_pos, c.end_pos, c.run_start, c.run_end, c.n_left, c.n_right,
       coalesce(avg(q.zf) FILTER (WHERE q.pos < c.run_start AND q.pos % 4 = c.pos % 4), max(q.zf) FILTER (WHERE q.pos = c.run_start - 1)) AS fw,
       coalesce(avg(q.zf) FILTER (WHERE q.pos > c.run_end AND q.pos % 4 = c.pos % 4), max(q.zf) FILTER (WHERE q.pos = c.run_end + 1)) AS bw
FROM runcells c JOIN zfill q ON q.site = c.site AND q.variable = c.variable AND q.pos BETWEEN c.run_start - 32 AND c.run_end + 32 AND q.pos NOT BETWEEN c.run_start AND c.run_end
GROUP BY ALL""")
cte("bidir_run", "sidefc", """
SELECT case_id, site, variable, pos, start_pos, end_pos,
       CASE WHEN ff IS NULL THEN bb WHEN bb IS NULL THEN ff ELSE wt * ff + (1 - wt) * bb END AS y_hat
FROM (SELECT *, CASE WHEN n_left >= 8 OR (n_right < 8 AND n_left > 0) THEN fw END AS ff,
             CASE WHEN n_right >= 8 OR (n_left < 8 AND n_left = 0 AND n_right > 0) THEN bw END AS bb,
             CASE WHEN run_end > run_start THEN 1.0::DOUBLE - CAST(pos - run_start AS DOUBLE) / (run_end - run_start) ELSE 0.5::DOUBLE END AS wt FROM sidefc)""")
cte("p_bidir", "bidir_run p_linear", """
SELECT l.case_id, l.site, l.variable, l.pos, coalesce(b.y_hat, l.y_hat) AS y_hat FROM p_linear l
LEFT JOIN bidir_run b ON b.case_id = l.case_id AND b.variable = l.variable AND b.pos = l.pos""")
cte("preds", "p_linear p_seasonal p_ridge p_bidir", """
SELECT 'linear' AS model, * FROM p_linear UNION ALL SELECT 'seasonal', * FROM p_seasonal UNION ALL SELECT 'ridge', * FROM p_ridge UNION ALL SELECT 'bidir', * FROM p_bidir""")
cte("cellsx", "preds scaled scaler manifest", """
SELECT p.model, p.case_id, p.site, p.variable, p.pos, p.y_hat, t.ts, t.value, t.z, p.y_hat * (CASE WHEN s.hi = s.lo THEN 1 ELSE s.hi - s.lo END) + s.lo AS pred,
       m.scenario, m.vars_key, m.gap_len, m.repeat, m.start_pos, m.end_pos
FROM preds p JOIN scaled t ON t.site = p.site AND t.variable = p.variable AND t.pos = p.pos AND t.value IS NOT NULL
JOIN scaler s ON s.variable = p.variable JOIN manifest m ON m.case_id = p.case_id""")
cte("ranges", "panel6", "SELECT site, variable, max(value) - min(value) AS full_range FROM panel6 GROUP BY 1, 2")
METRICS = """
CASE WHEN count(*) >= 2 THEN sum((pred - value) ** 2) / count(*) END AS mse0,
CASE WHEN count(*) >= 2 THEN avg(abs(pred - value)) END AS mae0,
CASE WHEN count(*) >= 2 THEN sqrt(sum((pred - value) ** 2) / count(*)) END AS rmse0,
CASE WHEN count(*) >= 2 AND max(value) - min(value) > 1e-8 THEN sqrt(sum((pred - value) ** 2) / count(*)) / (max(value) - min(value)) END AS nrmse0,
CASE WHEN count(*) >= 2 AND sum(value * value) - count(*) * avg(value) * avg(value) > 1e-12
     THEN 1 - sum((pred - value) ** 2) / (sum(value * value) - count(*) * avg(value) * avg(value)) END AS r20,
CAST(CASE WHEN count(*) >= 2 THEN count(*) ELSE 0 END AS BIGINT) AS n_eval, max(value) - min(value) AS truth_range"""
SCORE_COLS = ", ".join(r(f"{a}0", b) for a, b in (("mse", "MSE"), ("mae", "MAE"), ("rmse", "RMSE"), ("nrmse", "nRMSE"), ("r2", "R2"))) + ", " + r(
    "mae0 / CASE WHEN full_range > 1e-8 THEN full_range WHEN truth_range > 1e-8 THEN truth_range END", "NMAE"
) + ", n_eval"
cte("scores", "cellsx ranges", f"""
SELECT case_id, model, site, scenario, vars_key, gap_len, repeat, variable, {SCORE_COLS} FROM (
  SELECT case_id, model, site, scenario, vars_key, gap_len, repeat, variable, {METRICS} FROM cellsx GROUP BY ALL) JOIN ranges USING (site, variable)""")
cte("site_s", "scores", "SELECT model, site, sum(NMAE * n_eval) / sum(n_eval) AS NMAE FROM scores WHERE NMAE IS NOT NULL GROUP BY 1, 2")


def boot(src: str, keys: str, cols: str, draws: int = 10000, unit_col: str = "site") -> str:
    """CTE text fragment: bootstrap means of ``cols`` per keys and draw."""
    ks = [k.strip() for k in keys.split(",")]
    on = " AND ".join(f"d.{k} = j.{k}" for k in ks)
    avgs = ", ".join(f"avg(d.{c.strip()}) AS {c.strip()}" for c in cols.split(","))
    sel = ", ".join(f"j.{k}" for k in ks)
    return f"""SELECT {sel}, j.b, {avgs}
FROM (SELECT *, {hsh('42', 'b', 'j')} % n AS i FROM (SELECT *, unnest(range(n)) AS j FROM (SELECT {keys}, count(*) AS n, unnest(range({draws})) AS b FROM {src} GROUP BY {keys}))) j
JOIN (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {unit_col}) - 1 AS i FROM {src}) d ON {on} AND d.i = j.i GROUP BY {sel}, j.b"""


cte("scr", "panel3", "SELECT site, variable, pos, CASE WHEN value IS NOT NULL THEN greatest(0.5::DOUBLE, least(100.0::DOUBLE, value)) END AS value FROM panel3")
cte("coarse", "panel3", "SELECT site, variable, pos, floor(value / 25) * 25 AS value FROM panel3")
cte("construns", "coarse", """
SELECT site, variable, min(pos) AS start_pos, max(pos) AS end_pos, count(*) AS steps, max(value) AS value FROM (
  SELECT *, sum(CASE WHEN prev = value THEN 0 ELSE 1 END) OVER (PARTITION BY site, variable ORDER BY pos) AS g
  FROM (SELECT *, lag(value) OVER (PARTITION BY site, variable ORDER BY pos) AS prev FROM coarse))
WHERE value IS NOT NULL GROUP BY site, variable, g""")
cte("valfeas", "feasall roles6 cut6 panel6", """
SELECT f.* FROM feasall f JOIN roles6 USING (site) JOIN cut6 USING (site)
WHERE role = 'train' AND start_pos >= cut AND start_pos >= 48
AND NOT EXISTS (SELECT 1 FROM (SELECT unnest(string_split(f.vars_key, ',')) AS v) u WHERE NOT EXISTS (
  SELECT 1 FROM panel6 p WHERE p.site = f.site AND p.variable = u.v AND p.value IS NOT NULL AND p.pos >= f.start_pos - 4 AND p.pos < f.start_pos))""")
greedy("valfeas", "valpicks")
cte("valmanifest", "valpicks panel6 cut6", """
SELECT row_number() OVER (ORDER BY site, scenario, vars_key, gap_len, repeat) - 1 AS case_id, k.*, start_pos + gap_len - 1 AS end_pos,
       (SELECT min(ts) FROM panel6 p WHERE p.site = k.site AND p.pos = k.start_pos) AS start_ts, c.cut AS validation_start
FROM valpicks k JOIN cut6 c USING (site)""")
cte("middle", "cv panel6 span6", """
SELECT case_id, site, start_pos, end_pos, min(cover) AS coverage FROM (
  SELECT c.case_id, c.site, c.variable, c.start_pos, c.end_pos, count(p.value) / (c.end_pos - c.start_pos + 1 + 16) AS cover FROM cv c JOIN span6 s USING (site)
  JOIN panel6 p ON p.site = c.site AND p.variable = c.variable AND p.pos BETWEEN c.start_pos - 12 AND c.end_pos + 4
  WHERE c.scenario = 'C' AND c.gap_len = 2 AND c.start_pos >= 12 AND c.end_pos + 4 < s.n GROUP BY c.case_id, c.site, c.variable, c.start_pos, c.end_pos) GROUP BY 1, 2, 3, 4 HAVING min(cover) >= 0.7""")
cte("seas3", "nb3 panel3", """
SELECT b.site, b.variable, b.pos, coalesce(b.value,
  arg_max(p.value, p.pos) FILTER (WHERE p.pos < b.pos AND p.pos >= greatest(0, coalesce(b.prev_pos + 1, 0) - 16)),
  arg_min(p.value, p.pos) FILTER (WHERE p.pos > b.pos AND p.pos < least(b.n, coalesce(b.next_pos - 1, b.n - 1) + 1 + 16))) AS f
FROM nb3 b LEFT JOIN panel3 p ON p.site = b.site AND p.variable = b.variable AND p.pos % 8 = b.pos % 8 AND p.value IS NOT NULL AND b.value IS NULL
GROUP BY b.site, b.variable, b.pos, b.value, b.prev_pos, b.next_pos, b.n""")
cte("ctx16", "spans scaled", """
SELECT case_id, variable, pos, run_start, coalesce(last_value(z IGNORE NULLS) OVER a, first_value(z IGNORE NULLS) OVER b, 0) AS c FROM (
  SELECT s.case_id, s.variable, s.run_start, p.pos, p.z FROM spans s JOIN scaled p ON p.site = s.site AND p.variable = s.variable AND p.pos BETWEEN s.run_start - 16 AND s.run_start - 1)
WINDOW a AS (PARTITION BY case_id, variable ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
       b AS (PARTITION BY case_id, variable ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
cte("fc_left", "spans ctx16", """
SELECT s.case_id, s.site, s.variable, s.pos, s.run_start, count(*) AS n_ctx, arg_max(q.c, q.pos) AS lv, arg_min(q.c, q.pos) AS fv, avg(q.c) AS cm,
       max(q.c) FILTER (WHERE q.pos = s.run_start - 4 + (s.pos - s.run_start) % 4) AS sl,
       coalesce(avg(q.c) FILTER (WHERE (q.pos - s.pos) % 4 = 0), arg_max(q.c, q.pos)) AS sm
FROM (SELECT *, unnest(range(start_pos, end_pos + 1)) AS pos FROM spans) s JOIN ctx16 q ON q.case_id = s.case_id AND q.variable = s.variable
GROUP BY s.case_id, s.site, s.variable, s.pos, s.run_start""")
cte("fc_roll", "spans fc_left", "SELECT f.*, f.lv AS y_hat, s.start_pos, s.end_pos FROM fc_left f JOIN spans s ON s.case_id = f.case_id AND s.variable = f.variable")
cte("wo_cover", "panel3", "SELECT *, unnest([pos // 16 - 1, pos // 16]) AS w FROM panel3")
cte("wo_pm", "panel3", """
SELECT site, variable, w, pos % 8 AS phase, avg(value) AS pm FROM (SELECT *, unnest([pos // 16 + 1, pos // 16 + 2]) AS w FROM panel3 WHERE value IS NOT NULL) GROUP BY 1, 2, 3, 4""")
cte("wo_d", "wo_cover wo_pm", """
SELECT c.site, c.variable, c.pos, c.value, c.w, p.pm, (c.pos - c.w * 16) // 8 AS patch FROM wo_cover c
LEFT JOIN wo_pm p ON p.site = c.site AND p.variable = c.variable AND p.w = c.w AND p.phase = c.pos % 8 WHERE c.w >= 0""")
cte("wo_y", "wo_d", """
SELECT d.site, d.variable, d.pos, avg(d.pm + b.bias) AS y FROM wo_d d JOIN (
  SELECT site, variable, w, patch, CASE WHEN count(value - pm) >= 2 THEN avg(value - pm) ELSE 0 END AS bias FROM wo_d GROUP BY 1, 2, 3, 4) b
ON b.site = d.site AND b.variable = d.variable AND b.w = d.w AND b.patch = d.patch WHERE d.value IS NULL GROUP BY 1, 2, 3""")
cte("wo_fill", "panel3 wo_y", """
SELECT site, variable, pos, CASE WHEN f IS NOT NULL THEN f WHEN pp IS NULL THEN nv WHEN np IS NULL THEN pv ELSE pv + (nv - pv) * (CAST(pos - pp AS DOUBLE) / (np - pp)) END AS filled FROM (
  SELECT *, last_value(CASE WHEN f IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS pp, last_value(f IGNORE NULLS) OVER a AS pv,
         first_value(CASE WHEN f IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS np, first_value(f IGNORE NULLS) OVER b AS nv
  FROM (SELECT p.site, p.variable, p.pos, coalesce(p.value, y.y) AS f FROM panel3 p LEFT JOIN wo_y y ON y.site = p.site AND y.variable = p.variable AND y.pos = p.pos)
  WINDOW a AS (PARTITION BY site, variable ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         b AS (PARTITION BY site, variable ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""")
cte("wu_pm", "panel3", "SELECT site, variable, w, avg(value) AS pm FROM (SELECT *, unnest([pos // 16 + 1, pos // 16 + 2]) AS w FROM panel3 WHERE value IS NOT NULL) GROUP BY 1, 2, 3")
cte("wu_d", "wo_cover wu_pm", """
SELECT c.site, c.variable, c.pos, c.value, c.w, p.pm, (c.pos - c.w * 16) // 8 AS patch FROM wo_cover c
LEFT JOIN wu_pm p ON p.site = c.site AND p.variable = c.variable AND p.w = c.w WHERE c.w >= 0""")
for name, needs in (("y", "wu_d"), ("fill", "panel3 wu_y")):
    cte(f"wu_{name}", needs, CTES[f"wo_{name}"][1].replace("wo_", "wu_"))
cte("mctx", "spans scaled", """
SELECT case_id, variable, c AS context, pos, run_start, coalesce(last_value(z IGNORE NULLS) OVER a, first_value(z IGNORE NULLS) OVER b, 0) AS v FROM (
  SELECT s.case_id, s.variable, s.run_start, k.c, p.pos, p.z FROM spans s, (SELECT unnest([4, 8, 16])::BIGINT AS c) k, scaled p
  WHERE p.site = s.site AND p.variable = s.variable AND p.pos BETWEEN s.run_start - k.c AND s.run_start - 1)
WINDOW a AS (PARTITION BY case_id, variable, c ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
       b AS (PARTITION BY case_id, variable, c ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
cte("mpred", "spans mctx scaled scaler", """
SELECT q.model, q.context, q.case_id, q.site, q.variable, q.gap_len, t.value, q.y * (c.hi - c.lo) + c.lo AS pred FROM (
  SELECT m.model, x.context, s.case_id, s.site, s.variable, s.gap_len, s.pos,
         CASE m.model WHEN 'last' THEN arg_max(x.v, x.pos) ELSE coalesce(avg(x.v) FILTER (WHERE (x.pos - s.pos) % 4 = 0), arg_max(x.v, x.pos)) END AS y
  FROM (SELECT *, unnest(range(start_pos, end_pos + 1)) AS pos FROM spans) s JOIN mctx x ON x.case_id = s.case_id AND x.variable = s.variable,
       (SELECT unnest(['last', 'seasonal_mean']) AS model) m GROUP BY m.model, x.context, s.case_id, s.site, s.variable, s.gap_len, s.pos) q
JOIN scaled t ON t.site = q.site AND t.variable = q.variable AND t.pos = q.pos AND t.value IS NOT NULL JOIN scaler c ON c.variable = q.variable""")
cte("mscores", "mpred ranges", f"""
SELECT model, context, case_id, site, variable, gap_len, {SCORE_COLS} FROM (
  SELECT model, context, case_id, site, variable, gap_len, {METRICS} FROM mpred GROUP BY ALL) JOIN ranges USING (site, variable)""")
cte("msite", "mscores", "SELECT model, context, site, sum(NMAE * n_eval) / sum(n_eval) AS NMAE FROM mscores WHERE NMAE IS NOT NULL GROUP BY 1, 2, 3")
cte("msum", "msite", "SELECT model, context, avg(NMAE) AS mean, stddev_samp(NMAE) AS sd, count(*) AS n_sites FROM msite GROUP BY 1, 2")
cte("mbest", "msum", "SELECT * FROM msum QUALIFY row_number() OVER (PARTITION BY model ORDER BY round(mean, 12), context) = 1")
# refinement: every run's design from the estimates of a snapshot, centred normal equations, elimination row by row
cte("rwin", "spans zfill", """
SELECT s.case_id, s.site, s.variable, s.run_start, s.run_end, q.pos, q.ts, q.variable AS v, q.zf,
       CASE WHEN q.pos < s.run_start THEN 'L' WHEN q.pos > s.run_end THEN 'R' ELSE 'G' END AS side
FROM spans s JOIN zfill q ON q.site = s.site AND q.pos BETWEEN s.run_start - 32 AND s.run_end + 32""", True)
cte("rref", "rwin refs refser", """
SELECT w.case_id, w.variable, w.pos, list(q.x ORDER BY f.rank) AS xs FROM (SELECT DISTINCT case_id, site, variable, pos FROM rwin) w
JOIN refs f ON f.case_id = w.case_id AND f.variable = w.variable JOIN refser q ON q.site = w.site AND q.variable = w.variable AND q.ref = f.ref AND q.pos = w.pos GROUP BY ALL""", True)
cte("init2", "bidir_run", "SELECT case_id, site, variable, pos, y_hat FROM bidir_run", True)
cte("init1", "sidefc", "SELECT case_id, site, variable, pos, CASE WHEN n_left > 0 THEN fw ELSE bw END AS y_hat FROM sidefc WHERE CASE WHEN n_left > 0 THEN fw ELSE bw END IS NOT NULL", True)
_CAL = ["sin(2 * pi() * hour({0}) / 24)", "cos(2 * pi() * hour({0}) / 24)", "sin(2 * pi() * dayofyear({0}) / 365.25)", "cos(2 * pi() * dayofyear({0}) / 365.25)"]


def refinement_pass(name: str, snap: str, refs: bool = True, calendar: bool = True, both_sides: bool = True) -> None:
    """CTE ``name``: the estimates of ``snap`` after one synchronous ridge pass."""
    cal = "[" + ", ".join(c.format("w.ts") for c in _CAL) + "]" if calendar else "[]::DOUBLE[]"
    ref = "coalesce(any_value(g.xs), []::DOUBLE[])" if refs else "[]::DOUBLE[]"
    join = "LEFT JOIN rref g ON g.case_id = w.case_id AND g.variable = w.variable AND g.pos = w.pos" if refs else ""
    cte(f"{name}_x", f"rwin rref {snap}", f"""
SELECT w.case_id, w.variable, w.pos, w.side, any_value(w.run_start) AS run_start, any_value(w.run_end) AS run_end,
       max(coalesce(p.y_hat, w.zf)) FILTER (WHERE w.v = w.variable) AS y,
       list_concat(list_concat(list(coalesce(p.y_hat, w.zf) ORDER BY w.v) FILTER (WHERE w.v <> w.variable), {cal}), {ref}) AS x
FROM rwin w LEFT JOIN {snap} p ON p.case_id = w.case_id AND p.variable = w.v AND p.pos = w.pos {join} GROUP BY w.case_id, w.variable, w.pos, w.side, w.ts""", True)
    cte(f"{name}_u", f"{name}_x", f"SELECT case_id, variable, side, pos, y, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS i FROM {name}_x WHERE side <> 'G'")
    cte(f"{name}_c", f"{name}_u", f"""
SELECT *, avg(v) OVER w AS mv, avg(y) OVER w AS my, count(*) OVER w AS n FROM {name}_u WINDOW w AS (PARTITION BY case_id, variable, side, i)""", True)
    cte(f"{name}_a", f"{name}_c", f"""
SELECT case_id, variable, side, i, n, mv, my, list_append(list(a ORDER BY j), any_value(b)) AS line FROM (
  SELECT p.case_id, p.variable, p.side, p.i, q.i AS j, any_value(p.n) AS n, any_value(p.mv) AS mv, any_value(p.my) AS my,
         sum((p.v - p.mv) * (q.v - q.mv)) + CASE WHEN p.i = q.i THEN 1 ELSE 0 END AS a, sum((p.v - p.mv) * (p.y - p.my)) AS b
  FROM {name}_c p JOIN {name}_c q ON q.case_id = p.case_id AND q.variable = p.variable AND q.side = p.side AND q.pos = p.pos GROUP BY p.case_id, p.variable, p.side, p.i, q.i) GROUP BY ALL""")
    sides = "" if both_sides else "AND side = 'L'"
    cte(f"{name}_e", f"{name}_a", f"""
SELECT case_id, variable, side, 1 AS p, list(line ORDER BY i) AS m, list(mv ORDER BY i) AS mx, any_value(my) AS my FROM {name}_a WHERE n >= 8 {sides} GROUP BY case_id, variable, side
UNION ALL SELECT case_id, variable, side, p + 1, list_transform(range(1, len(m) + 1), lambda i: CASE WHEN i = p THEN list_transform(m[p], lambda v: v / m[p][p])
  ELSE list_transform(range(1, len(m) + 2), lambda j: m[i][j] - m[i][p] * m[p][j] / m[p][p]) END), mx, my FROM {name}_e WHERE p <= len(m)""")
    cte(f"{name}_b", f"{name}_e", f"SELECT case_id, variable, side, mx, my, list_transform(m, lambda r: r[len(r)]) AS beta FROM {name}_e WHERE p > len(m)", True)
    fit = "b.my + list_sum(list_transform(range(1, len(x.x) + 1), lambda i: (x.x[i] - b.mx[i]) * b.beta[i]))"
    cte(f"{name}_y", f"{name}_x {name}_b", f"""
SELECT x.case_id, x.variable, x.pos, any_value(CASE WHEN x.run_end > x.run_start THEN 1 - CAST(x.pos - x.run_start AS DOUBLE) / (x.run_end - x.run_start) ELSE 0.5 END) AS wt,
       max({fit}) FILTER (WHERE b.side = 'L') AS f, max({fit}) FILTER (WHERE b.side = 'R') AS g
FROM {name}_x x JOIN {name}_b b ON b.case_id = x.case_id AND b.variable = x.variable WHERE x.side = 'G' GROUP BY x.case_id, x.variable, x.pos""")
    cte(name, f"{snap} {name}_y", f"""
SELECT s.case_id, s.site, s.variable, s.pos, coalesce(wt * f + (1 - wt) * g, f, g, s.y_hat) AS y_hat
FROM {snap} s LEFT JOIN {name}_y y ON y.case_id = s.case_id AND y.variable = s.variable AND y.pos = s.pos""", True)


refinement_pass("pass1", "init2")
refinement_pass("pass2", "pass1")
refinement_pass("noref1", "init2", refs=False)
refinement_pass("nocal1", "init2", calendar=False)
refinement_pass("once0", "init1", both_sides=False)
cte("once1", "once0 init1 spans", """
SELECT o.case_id, o.site, o.variable, o.pos, CASE WHEN s.run_start = 0 THEN i.y_hat ELSE o.y_hat END AS y_hat FROM once0 o
JOIN init1 i ON i.case_id = o.case_id AND i.variable = o.variable AND i.pos = o.pos JOIN spans s ON s.case_id = o.case_id AND s.variable = o.variable""")
# rounds until a case settles: pairs (case, variable) go on while the case's distance to the linear fill and their own estimate still move
cte("conv0", "init1", "SELECT * FROM init1", True)
cte("act0", "spans", "SELECT case_id, variable FROM spans", True)
for i in range(1, 6):
    refinement_pass(f"try{i}", f"conv{i - 1}", refs=False, both_sides=False)
    cte(f"conv{i}", f"try{i} conv{i - 1} act{i - 1}", f"""
SELECT o.case_id, o.site, o.variable, o.pos, CASE WHEN a.case_id IS NULL THEN o.y_hat ELSE t.y_hat END AS y_hat FROM conv{i - 1} o
JOIN try{i} t ON t.case_id = o.case_id AND t.variable = o.variable AND t.pos = o.pos LEFT JOIN act{i - 1} a ON a.case_id = o.case_id AND a.variable = o.variable""", True)
    cte(f"act{i}", f"act{i - 1} conv{i} conv{i - 1} p_linear", f"""
SELECT a.case_id, a.variable FROM act{i - 1} a JOIN (SELECT case_id, coalesce(abs(after - before) / nullif(before, 0), 0) AS rel FROM (
  SELECT l.case_id, sqrt(avg((n.y_hat - l.y_hat) ** 2)) AS after, sqrt(avg((o.y_hat - l.y_hat) ** 2)) AS before FROM p_linear l
  JOIN conv{i} n ON n.case_id = l.case_id AND n.variable = l.variable AND n.pos = l.pos JOIN conv{i - 1} o ON o.case_id = l.case_id AND o.variable = l.variable AND o.pos = l.pos GROUP BY 1)) c USING (case_id)
JOIN (SELECT n.case_id, n.variable, sqrt(avg((n.y_hat - o.y_hat) ** 2)) AS rms FROM conv{i} n JOIN conv{i - 1} o ON o.case_id = n.case_id AND o.variable = n.variable AND o.pos = n.pos GROUP BY 1, 2) d
ON d.case_id = a.case_id AND d.variable = a.variable WHERE rel >= 1e-3 AND rms >= 5e-4""", True)
cte("rounds", "init2 pass1 pass2 spans scaled scaler ranges", """
SELECT round, site, case_id, variable, CASE WHEN n >= 2 THEN e END AS mae, CASE WHEN n >= 2 THEN e / CASE WHEN full_range > 1e-8 THEN full_range WHEN truth_range > 1e-8 THEN truth_range END END AS NMAE, CASE WHEN n >= 2 THEN n ELSE 0 END AS n_eval FROM (
  SELECT p.round, p.site, p.case_id, p.variable, avg(abs(p.y_hat * (CASE WHEN c.hi = c.lo THEN 1 ELSE c.hi - c.lo END) + c.lo - t.value)) AS e, count(*) AS n, max(t.value) - min(t.value) AS truth_range
  FROM (SELECT 0 AS round, * FROM init2 UNION ALL SELECT 1, * FROM pass1 UNION ALL SELECT 2, * FROM pass2) p
  JOIN spans s ON s.case_id = p.case_id AND s.variable = p.variable AND p.pos BETWEEN s.start_pos AND s.end_pos
  JOIN scaled t ON t.site = p.site AND t.variable = p.variable AND t.pos = p.pos AND t.value IS NOT NULL JOIN scaler c ON c.variable = p.variable GROUP BY ALL) JOIN ranges USING (site, variable)""", True)
# vector autoregression of lag 1 on the past of all variables, filled inside the context only
cte("vctx", "spans scaled", """
SELECT case_id, variable, pos, list(z ORDER BY v) AS z FROM (
  SELECT case_id, variable, v, pos, coalesce(last_value(z IGNORE NULLS) OVER (PARTITION BY case_id, variable, v ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(z IGNORE NULLS) OVER (PARTITION BY case_id, variable, v ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS z
  FROM (SELECT s.case_id, s.variable, q.variable AS v, q.pos, q.z FROM spans s JOIN scaled q ON q.site = s.site AND q.pos BETWEEN s.run_start - 32 AND s.run_start - 1)) GROUP BY ALL""", True)
cte("vpair", "vctx", "SELECT a.case_id, a.variable, a.pos, b.z AS x, a.z AS y FROM vctx a JOIN vctx b ON b.case_id = a.case_id AND b.variable = a.variable AND b.pos = a.pos - 1", True)
cte("vlong", "vpair", "SELECT case_id, variable, pos, unnest(x) AS x, unnest(y) AS y, unnest(range(1, len(x) + 1)) AS i FROM vpair")
cte("vcen", "vlong", "SELECT *, avg(x) OVER w AS mx, avg(y) OVER w AS my, count(*) OVER w AS n FROM vlong WINDOW w AS (PARTITION BY case_id, variable, i)", True)
cte("vsys", "vcen", """
SELECT case_id, variable, i, any_value(n) AS n, any_value(mx) AS mx, any_value(my) AS my, list_concat(list(a ORDER BY j), list(b ORDER BY j)) AS line FROM (
  SELECT p.case_id, p.variable, p.i, q.i AS j, any_value(p.n) AS n, any_value(p.mx) AS mx, any_value(p.my) AS my, sum((p.x - p.mx) * (q.x - q.mx)) + CASE WHEN p.i = q.i THEN 1 ELSE 0 END AS a, sum((p.x - p.mx) * (q.y - q.my)) AS b
  FROM vcen p JOIN vcen q ON q.case_id = p.case_id AND q.variable = p.variable AND q.pos = p.pos GROUP BY p.case_id, p.variable, p.i, q.i) GROUP BY case_id, variable, i""")
cte("velim", "vsys", """
SELECT case_id, variable, 1 AS p, list(line ORDER BY i) AS m, list(mx ORDER BY i) AS mx, list(my ORDER BY i) AS my FROM vsys WHERE n + 1 >= 8 GROUP BY 1, 2
UNION ALL SELECT case_id, variable, p + 1, list_transform(range(1, len(m) + 1), lambda i: CASE WHEN i = p THEN list_transform(m[p], lambda v: v / m[p][p])
  ELSE list_transform(range(1, len(m[1]) + 1), lambda j: m[i][j] - m[i][p] * m[p][j] / m[p][p]) END), mx, my FROM velim WHERE p <= len(m)""")
cte("vroll", "velim vctx spans", """
SELECT s.case_id, s.variable, s.run_start - 1 AS pos, s.run_end, c.z, e.m, e.mx, e.my FROM spans s JOIN vctx c ON c.case_id = s.case_id AND c.variable = s.variable AND c.pos = s.run_start - 1
JOIN (SELECT * FROM velim WHERE p > len(m)) e ON e.case_id = s.case_id AND e.variable = s.variable
UNION ALL SELECT case_id, variable, pos + 1, run_end, list_transform(range(1, len(z) + 1), lambda j: my[j] + list_sum(list_transform(range(1, len(z) + 1), lambda i: (z[i] - mx[i]) * m[i][len(z) + j]))), m, mx, my FROM vroll WHERE pos < run_end""")
cte("var_fill", "p_linear init1 vroll scaled", """
SELECT l.case_id, l.site, l.variable, l.pos, coalesce(v.z[o.i], i.y_hat, l.y_hat) AS y_hat FROM p_linear l
JOIN (SELECT variable, row_number() OVER (ORDER BY variable) AS i FROM (SELECT DISTINCT variable FROM scaled)) o ON o.variable = l.variable
LEFT JOIN vroll v ON v.case_id = l.case_id AND v.variable = l.variable AND v.pos = l.pos LEFT JOIN init1 i ON i.case_id = l.case_id AND i.variable = l.variable AND i.pos = l.pos""")
cte("coarse6", "panel6", "SELECT site, variable, pos, floor(value / 40) * 40 AS value FROM panel6")
cte("const6", "coarse6", """
SELECT * FROM (SELECT site, variable, min(pos) AS a, max(pos) AS b, count(*) AS c FROM (
  SELECT *, sum(CASE WHEN prev = value THEN 0 ELSE 1 END) OVER (PARTITION BY site, variable ORDER BY pos) AS g
  FROM (SELECT *, lag(value) OVER (PARTITION BY site, variable ORDER BY pos) AS prev FROM coarse6))
WHERE value IS NOT NULL GROUP BY site, variable, g) WHERE c >= 4""")
cte("flagged", "hid const6", "SELECT case_id, variable, count(*) AS flagged_steps FROM hid h WHERE EXISTS (SELECT 1 FROM const6 k WHERE k.site = h.site AND k.variable = h.variable AND h.pos BETWEEN k.a AND k.b) GROUP BY 1, 2")
cte("norms", "panel6 cut6", """
SELECT *, p99 - p01 AS robust_range, coalesce(full_range > 0 AND p99 - p01 > 0, false) AS common_valid FROM (
SELECT site, variable, count(value) AS n_observations, max(value) - min(value) AS full_range, max(value) FILTER (WHERE pos < cut) - min(value) FILTER (WHERE pos < cut) AS prefix_range,
       quantile_cont(value, 0.01) AS p01, quantile_cont(value, 0.99) AS p99 FROM panel6 JOIN cut6 USING (site) GROUP BY 1, 2)""")
cte("nscores", "scores norms", """
SELECT s.*, k.normalizer, s.MAE / CASE k.normalizer WHEN 'p01_p99_common' THEN n.robust_range ELSE n.full_range END AS score FROM scores s JOIN norms n USING (site, variable),
(SELECT unnest(['full_range_all', 'full_range_common', 'p01_p99_common']) AS normalizer) k WHERE k.normalizer = 'full_range_all' OR n.common_valid""")
cte("pairs", "", "SELECT * FROM (VALUES ('bidir', 'linear'), ('bidir', 'seasonal'), ('bidir', 'ridge'), ('ridge', 'linear')) t(model, reference)")
cte("null_w", "", """
SELECT 0 AS n, [CASE WHEN i = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FOR i IN range(1, 1277)] AS c
UNION ALL SELECT n + 1, [c[i] + CASE WHEN i > n + 1 THEN c[i - n - 1] ELSE 0.0::DOUBLE END FOR i IN range(1, 1277)] FROM null_w WHERE n < 50""")
POLY = "t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))"


def paired(xy: str, keys: str) -> str:
    """Paired comparison of CTE ``xy`` (keys, site, x, y): bootstrap, signed-rank p (exact up to 50 differences without ties, else the normal approximation with tie correction) and base columns."""
    j = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    return f"""SELECT b.*, ci.low, ci.high, coalesce(w.p, 1.0) AS p FROM (
  SELECT {keys}, avg(x) AS mx, avg(y) AS my, count(*) AS n_sites, count(*) FILTER (WHERE x < y) AS sites_improved, 100 * (1 - avg(x) / avg(y)) AS reduction FROM {xy} GROUP BY {keys}) b
JOIN (SELECT {keys}, quantile_cont(CAST(100 * (1 - x / y) AS DOUBLE), 0.025) AS low, quantile_cont(CAST(100 * (1 - x / y) AS DOUBLE), 0.975) AS high FROM ({boot(xy, keys, 'x, y')}) GROUP BY {keys}) ci USING ({keys})
LEFT JOIN (SELECT {keys}, CASE WHEN ties = 0 AND q.n <= 50 THEN least(1.0, 2 * list_sum(z.c[1:CAST(floor(q.stat) AS BIGINT) + 1]) / pow(2, q.n)) ELSE least(1.0, 2 * exp(-a * a / 2) * 0.3989422804014327 * {POLY}) END AS p FROM (
  SELECT *, 1 / (1 + 0.2316419 * a) AS t FROM (SELECT *, -(stat - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS a FROM (
    SELECT {keys}, CAST(sum(dc) AS DOUBLE) AS n, least(sum(rk * pc), sum(dc) * (sum(dc) + 1) / 2 - sum(rk * pc)) AS stat, sum(CAST(dc AS DOUBLE) ** 3 - dc) AS ties FROM (
      SELECT *, sum(dc) OVER (PARTITION BY {keys} ORDER BY ad) - (dc - 1) / 2 AS rk FROM (
        SELECT {keys}, round(abs(x - y), 12) AS ad, count(*) AS dc, count(*) FILTER (WHERE x > y) AS pc FROM {xy} WHERE x <> y GROUP BY {keys}, ad)) GROUP BY {keys}))) q LEFT JOIN null_w z ON z.n = q.n) w USING ({keys})"""


def holm_sql(inner: str, family: str = "") -> str:
    part = f"PARTITION BY {family}" if family else ""
    return f"""SELECT *, least(1.0, max(s) OVER ({part} ORDER BY p, model, reference ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS holm_p FROM (
SELECT *, p * (count(*) OVER ({part}) - row_number() OVER ({part} ORDER BY p, model, reference) + 1) AS s FROM ({inner}))"""


cte("xy", "pairs site_s", "SELECT p.model, p.reference, a.site, a.NMAE AS x, b.NMAE AS y FROM pairs p JOIN site_s a ON a.model = p.model JOIN site_s b ON b.model = p.reference AND b.site = a.site")
KEY = "site, variable, pos"
cte("inj", "panel6", f"""
SELECT p.site, p.variable, p.pos, p.ts, p.value IS NOT NULL AND rk <= 6 AS injected, CASE WHEN p.value IS NOT NULL AND rk <= 6 THEN p.value END AS true_value,
       CASE WHEN p.value IS NOT NULL AND rk <= 6 THEN p.value + (CASE WHEN {hsh('42', "'sign'", 'site', 'variable', 'pos')} % 2 = 0 THEN 1 ELSE -1 END)
            * (4 + 4 * {unit('42', "'size'", 'site', 'variable', 'pos')}) * sd ELSE p.value END AS value
FROM (SELECT *, row_number() OVER (PARTITION BY site, variable, value IS NULL ORDER BY {hsh('42', 'site', 'variable', 'pos')}, pos) AS rk,
             stddev_samp(value) OVER (PARTITION BY site, variable) AS sd FROM panel6) p""")
cte("ph", "inj", "SELECT *, CASE WHEN (pos // 4) % 2 <> phase THEN value END AS masked FROM (SELECT *, unnest([0, 1]) AS phase FROM inj)")
cte("phn", "ph", """
SELECT *, last_value(CASE WHEN masked IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS pp, last_value(masked IGNORE NULLS) OVER a AS pv,
       first_value(CASE WHEN masked IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS np, first_value(masked IGNORE NULLS) OVER b AS nv, max(pos) OVER (PARTITION BY site, variable) + 1 AS n
FROM ph WINDOW a AS (PARTITION BY site, variable, phase ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
               b AS (PARTITION BY site, variable, phase ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
L2 = LINE.format(p="pos", lp="pp", lv="pv", rp="np", rv="nv")
cte("res_linear", "phn", f"SELECT site, variable, pos, value, injected, {L2} AS recon FROM phn WHERE (pos // 4) % 2 = phase")
cte("phs", "phn", """
SELECT h.site, h.variable, h.phase, h.pos, h.value, h.injected, coalesce(h.masked,
  arg_max(q.masked, q.pos) FILTER (WHERE q.pos < h.pos AND q.pos >= greatest(0, coalesce(h.pp + 1, 0) - 16)),
  arg_min(q.masked, q.pos) FILTER (WHERE q.pos > h.pos AND q.pos < least(h.n, coalesce(h.np - 1, h.n - 1) + 1 + 16))) AS f
FROM phn h LEFT JOIN ph q ON q.site = h.site AND q.variable = h.variable AND q.phase = h.phase AND q.masked IS NOT NULL AND q.pos % 4 = h.pos % 4 AND h.masked IS NULL
GROUP BY h.site, h.variable, h.phase, h.pos, h.value, h.injected, h.masked, h.pp, h.np, h.n""")
cte("res_seasonal", "phs", f"""
SELECT site, variable, pos, value, injected, coalesce(f, {L2}) AS recon FROM (
  SELECT *, last_value(CASE WHEN f IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS pp, last_value(f IGNORE NULLS) OVER a AS pv,
         first_value(CASE WHEN f IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS np, first_value(f IGNORE NULLS) OVER b AS nv
  FROM phs WINDOW a AS (PARTITION BY site, variable, phase ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                  b AS (PARTITION BY site, variable, phase ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
WHERE (pos // 4) % 2 = phase""")
cte("resid", "res_linear res_seasonal", "SELECT 'linear' AS model, *, value - recon AS residual FROM res_linear UNION ALL SELECT 'seasonal', *, value - recon FROM res_seasonal")
cte("zs", "resid", """
SELECT r.*, CASE WHEN n >= 5 AND mad >= 1e-9 THEN abs(residual - med) / mad END AS z FROM resid r
JOIN (SELECT model, site, variable, quantile_cont(residual, 0.5) AS med, count(residual) AS n FROM resid GROUP BY 1, 2, 3) m USING (model, site, variable)
JOIN (SELECT r.model, r.site, r.variable, quantile_cont(abs(r.residual - q.med), 0.5) * 1.4826::DOUBLE AS mad FROM resid r
      JOIN (SELECT model, site, variable, quantile_cont(residual, 0.5) AS med FROM resid GROUP BY 1, 2, 3) q USING (model, site, variable) GROUP BY 1, 2, 3) d USING (model, site, variable)""")
cte("flags", "zs", "SELECT *, coalesce(z > 3.5, false) AS flag FROM zs")
cte("restored", "inj flags", f"""
SELECT m.model, {', '.join('m.' + k for k in ('site', 'variable', 'pos', 'value', 'injected', 'true_value'))}, m.fl, CASE WHEN m.mk IS NOT NULL THEN m.mk ELSE {L2.replace('pos', 'm.pos')} END AS restored FROM (
  SELECT *, last_value(CASE WHEN mk IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS pp, last_value(mk IGNORE NULLS) OVER a AS pv,
         first_value(CASE WHEN mk IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS np, first_value(mk IGNORE NULLS) OVER b AS nv
  FROM (SELECT f.model, i.*, f.flag AS fl, CASE WHEN NOT f.flag THEN i.value END AS mk FROM inj i JOIN flags f ON f.site = i.site AND f.variable = i.variable AND f.pos = i.pos WHERE f.model = 'linear')
  WINDOW a AS (PARTITION BY model, site, variable ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         b AS (PARTITION BY model, site, variable ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) m""")
PRF = """count(*) FILTER (WHERE {f} AND injected) AS tp, count(*) FILTER (WHERE {f} AND NOT injected) AS fp, count(*) FILTER (WHERE NOT {f} AND injected) AS fn, count(*) FILTER (WHERE injected) AS n_injected"""
PRF_OUT = (
    "tp, fp, fn, n_injected, " + r("tp / nullif(tp + fp, 0)", "precision") + ", " + r("tp / nullif(tp + fn, 0)", "recall") + ", "
    + r("CASE WHEN tp > 0 THEN 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) END", "f1")
)
cte("scr6", "lin6", "SELECT site, variable, pos, CASE WHEN value IS NOT NULL OR pos - prev_pos <= 3 OR next_pos - pos <= 3 THEN filled END AS value FROM lin6")
