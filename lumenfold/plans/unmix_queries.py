"""Queries on spectra, unmixing, and assignment of background and variants."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenfold.functions import arrays as A
from lumenfold.functions.ranks import array_quantiles
from lumenfold.functions.stats import weights_of
from lumenfold.operators import kernels, unmix
from lumenfold.operators.events import WIDTH, all_classes, class_medians, class_spectra, dyes_and_background, events
from lumenfold.plans import sql
from lumenfold.plans.registry import query
from lumenfold.plans.sql import AF, BASE, DYES, DYES9, pinv, wide

U10 = [f"u{i}" for i in range(10)]
U9 = [f"u{i}" for i in range(9)]


def _long(df, *keys, name="v"):
    return df.select(*keys, F.posexplode("spectrum").alias("pos", "v")).select(*keys, "pos", A.rounded(F.col("v")).alias(name))


@query("class_spectra_mean", f"{BASE} SELECT label, pos::INT AS pos, round(v, 6) + 0.0 AS v FROM mn")
def class_spectra_mean(spark, sf):
    return _long(class_spectra(events(spark, sf)), "label")


@query("class_spectra_median", f"{BASE} SELECT label, pos::INT AS pos, round(median(v), 6) + 0.0 AS v FROM lg GROUP BY ALL")
def class_spectra_median(spark, sf):
    return _long(class_medians(events(spark, sf)), "label")


@query("linf_normalise", f"{BASE} SELECT label, pos::INT AS pos, round(v / max(v) OVER (PARTITION BY label), 6) + 0.0 AS v FROM mn")
def linf_normalise(spark, sf):
    s = class_spectra(events(spark, sf))
    return _long(s.withColumn("spectrum", A.linf(F.col("spectrum"))), "label")


@query("peak_detector", f"{BASE} SELECT label, min(pos)::INT AS peak FROM mn JOIN (SELECT label, max(v) AS v FROM mn GROUP BY label) USING (label, v) GROUP BY label")
def peak_detector(spark, sf):
    return class_spectra(events(spark, sf)).select("label", A.peak(F.col("spectrum")).alias("peak"))


def _pairs(s, cosine):
    a = s.select(F.col("label").alias("a"), F.col("spectrum").alias("sa"))
    b = s.select(F.col("label").alias("b"), F.col("spectrum").alias("sb"))
    return a.join(b, F.col("a") > F.col("b")).select("a", "b", cosine(F.col("sa"), F.col("sb")).alias("c"))  # spectra x spectra: a small matrix


COS = "list_dot_product(x.s, y.s) / (sqrt(list_dot_product(x.s, x.s) + 1e-9) * sqrt(list_dot_product(y.s, y.s) + 1e-9))"


@query("cosine_matrix", f"{BASE} SELECT x.label AS a, y.label AS b, round({COS}, 6) + 0.0 AS cosine FROM sp x JOIN sp y ON x.label > y.label")
def cosine_matrix(spark, sf):
    return _pairs(class_spectra(events(spark, sf)), A.cosine_guarded).select("a", "b", A.rounded(F.col("c")).alias("cosine"))


@query("cosine_rows", f"{BASE} SELECT vec_id, round(list_dot_product(x, s) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(s, s)) + 1e-9), 6) + 0.0 AS cosine FROM ev JOIN sp USING (label)")
def cosine_rows(spark, sf):
    """Cosine of every event with its own class spectrum."""
    ev = events(spark, sf)
    return ev.join(F.broadcast(class_spectra(ev)), "label").select("vec_id", A.rounded(A.cosine_rows(F.col("x"), F.col("spectrum"))).alias("cosine"))


@query("similar_pairs", f"{BASE}, c AS (SELECT x.label AS a, y.label AS b, {COS} AS c FROM sp x JOIN sp y ON x.label > y.label) SELECT a, b, round(c, 6) + 0.0 AS cosine FROM c WHERE c > 0.2")
def similar_pairs(spark, sf):
    return _pairs(class_spectra(events(spark, sf)), A.cosine_guarded).where("c > 0.2").select("a", "b", A.rounded(F.col("c")).alias("cosine"))


def _largest(of: str, rows: str) -> str:
    """CTEs up to top_{of}(l): the largest eigenvalue of a symmetric matrix given as rows(i, v) of vectors, entries their inner
    products: 24 squarings, scaled."""
    return f"""m_{of} AS (SELECT list(r ORDER BY i) AS m FROM (SELECT a.i, list(list_dot_product(a.v, b.v) ORDER BY b.i) AS r FROM {rows} a, {rows} b GROUP BY a.i)),
    q_{of} AS (SELECT 0 AS k, m, 0.0::DOUBLE AS lg FROM m_{of} UNION ALL
      SELECT k + 1, list_transform(m, lambda r: list_transform(m, lambda c: list_dot_product(r, c) / z)), 2 * lg + ln(z)
      FROM (SELECT *, list_max(list_transform(m, lambda r: list_dot_product(r, r))) AS z FROM q_{of} WHERE k < 24)),
    top_{of} AS (SELECT exp((lg + ln(list_max(list_transform(m, lambda r: list_max(r))))) / pow(2, 24)) AS l FROM q_{of} WHERE k = 24)"""


@query(
    "condition_number",
    f"""{BASE}, {DYES}, {pinv(10)}, va AS (SELECT i, s AS v FROM dy), vb AS (SELECT i, p AS v FROM pp), {_largest("a", "va")}, {_largest("b", "vb")}
    SELECT round(sqrt(top_a.l * top_b.l), 2) AS condition FROM top_a, top_b""",
)
def condition_number(spark, sf):
    return spark.createDataFrame([(all_classes(events(spark, sf)).condition(),)], "condition double")


@query(
    "hotspot",
    f"""{BASE}, {DYES}, dn AS (SELECT i, list_transform(s, lambda z: z / sqrt(list_dot_product(s, s) + 1e-9)) AS s FROM dy), {pinv(10, "dn")}
    SELECT a.i::INT AS a, b.i::INT AS b, round(sqrt(abs(list_dot_product(a.p, b.p))), 6) AS hotspot FROM pp a, pp b""",
)
def hotspot(spark, sf):
    """sqrt(|pseudo-inverse of the cosine matrix|)."""
    S = all_classes(events(spark, sf)).S
    n = np.sqrt((S**2).sum(1) + A.EPS)
    h = np.sqrt(np.abs(np.linalg.pinv((S @ S.T) / np.outer(n, n))))
    return spark.createDataFrame([(i, j, round(float(h[i, j]), 6)) for i in range(len(h)) for j in range(len(h))], "a int, b int, hotspot double")


SLOPE = f"""{BASE}, pk AS (SELECT label, min(pos) AS peak FROM mn JOIN (SELECT label, max(v) AS v FROM mn GROUP BY label) USING (label, v) GROUP BY label),
w AS (SELECT l.label, l.vec_id, l.pos, l.v, p.v AS at_peak FROM lg l JOIN pk USING (label) JOIN lg p ON p.vec_id = l.vec_id AND p.label = l.label AND p.pos = pk.peak)
SELECT label, pos::INT AS pos, round(regr_slope(v, at_peak), 6) + 0.0 AS v FROM w GROUP BY ALL"""


def _against_peak(ev):
    """(label, pos, v, at_peak): every detector of every event beside the value at its class's peak detector."""
    peaks = class_spectra(ev).select("label", A.peak(F.col("spectrum")).alias("peak"))
    e = ev.join(F.broadcast(peaks), "label").withColumn("at_peak", F.get("x", F.col("peak")))
    return e.select("label", "at_peak", F.posexplode("x").alias("pos", "v"))


@query("ols_slope_spectra", SLOPE)
def ols_slope_spectra(spark, sf):
    w = _against_peak(events(spark, sf))
    return w.groupBy("label", "pos").agg(A.rounded(F.regr_slope("v", "at_peak")).alias("v"))


@query("rlm_spectra")
def rlm_spectra(spark, sf):
    """Robust slopes against the peak detector, peak-normalised: the spectrum of each control sample."""
    from lumenfold.operators.spectra import robust_spectra

    return _long(robust_spectra(events(spark, sf), "label", "x", WIDTH), "label")


# --- unmixing ---------------------------------------------------------------------------------------------


@query("unmix_ols", f"{BASE}, {DYES}, {pinv(10)} SELECT vec_id, {wide(10, 'list_dot_product(x, (SELECT p FROM pp WHERE i = {i}))')} FROM ev")
def unmix_ols(spark, sf):
    ev = events(spark, sf)
    out = unmix.unmix_ols(ev.select("vec_id", "x"), all_classes(ev), "x", U10)
    return out.select("vec_id", *[A.rounded(F.col(u)).alias(u) for u in U10])


WEIGHTS = "ww AS (SELECT list(w ORDER BY pos) AS w FROM (SELECT pos, 1 / greatest(abs(avg(v)), 1e-3) AS w FROM lg GROUP BY pos))"


@query("unmix_weights", f"{BASE} SELECT pos::INT AS pos, round(avg(v), 6) + 0.0 AS mean, round(1 / greatest(abs(avg(v)), 1e-3), 4) + 0.0 AS weight FROM lg GROUP BY pos")
def unmix_weights(spark, sf):
    return weights_of(events(spark, sf), "x", 1e-3).select("pos", A.rounded(F.col("mean")).alias("mean"), A.rounded(F.col("weight"), 4).alias("weight"))


@query("unmix_wls", f"{BASE}, {DYES}, {WEIGHTS}, {pinv(10, weights='ww')} SELECT vec_id, {wide(10, 'list_dot_product(x, (SELECT p FROM pp WHERE i = {i}))')} FROM ev")
def unmix_wls(spark, sf):
    ev = events(spark, sf)
    w = kernels.weights(unmix.column_mean(ev, "x", WIDTH), 1e-3)
    out = unmix.unmix_wls(ev.select("vec_id", "x"), all_classes(ev), "x", w, U10)
    return out.select("vec_id", *[A.rounded(F.col(u)).alias(u) for u in U10])


FIT = """fit AS (SELECT vec_id, x, list(list_dot_product(x, p) ORDER BY i) AS u FROM ev, pp GROUP BY vec_id, x),
back AS (SELECT vec_id, pos, sum(u[i + 1] * s[pos + 1]) AS y FROM fit, dy, (SELECT unnest(range(64)) AS pos) GROUP BY vec_id, pos)"""


@query("residual_norm", f"{BASE}, {DYES}, {pinv(10)}, {FIT} SELECT vec_id, round(sqrt(sum((v - y) ** 2)), 6) + 0.0 AS residual FROM lg JOIN back USING (vec_id, pos) GROUP BY vec_id")
def residual_norm(spark, sf):
    ev = events(spark, sf)
    S = all_classes(ev).S
    P = kernels.ols(S)
    out = unmix.apply_kernel(ev.select("vec_id", "x"), "x", WIDTH, lambda X: [np.linalg.norm(X - (X @ P.T) @ S, axis=1)], [("residual", "double")])
    return out.select("vec_id", A.rounded(F.col("residual")).alias("residual"))


def _counts(ev):
    """Non-negative counts out of signed vectors."""
    return ev.select("vec_id", "label", F.transform("x", lambda v: F.round((v + 1) * 1000)).alias("x"))


COUNTS = "cx AS (SELECT vec_id, label, list_transform(x, lambda z: round((z + 1) * 1000)) AS x FROM ev)"


@query(
    "unmix_ols_fast",
    f"{BASE}, {DYES}, {pinv(10)} SELECT vec_id, {wide(10, 'list_dot_product(x, (SELECT p FROM pp WHERE i = {i}))')} FROM ev",
)
def unmix_ols_fast(spark, sf):
    """By the normal equations."""
    ev = events(spark, sf)
    out = unmix.project(ev.select("vec_id", "x"), "x", kernels.ols_normal(all_classes(ev).S), U10)
    return out.select("vec_id", *[A.rounded(F.col(u)).alias(u) for u in U10])


@query(
    "unmix_wls_fast",
    f"{BASE}, {DYES}, {WEIGHTS}, {pinv(10, weights='ww')} SELECT vec_id, {wide(10, 'list_dot_product(x, (SELECT p FROM pp WHERE i = {i}))')} FROM ev",
)
def unmix_wls_fast(spark, sf):
    ev = events(spark, sf)
    w = kernels.weights(unmix.column_mean(ev, "x", WIDTH), 1e-3)
    out = unmix.project(ev.select("vec_id", "x"), "x", kernels.wls_normal(all_classes(ev).S, w), U10)
    return out.select("vec_id", *[A.rounded(F.col(u)).alias(u) for u in U10])


@query(
    "unmixing_matrix",
    f"""{BASE}, {DYES}, {WEIGHTS}, {pinv(10)}, {pinv(10, out='pw', weights='ww')}, b AS (SELECT 'OLS' AS method, i, p FROM pp UNION ALL SELECT 'WLS', i, p FROM pw)
    SELECT method, i::INT AS label, unnest(range(64))::INT AS pos, round(unnest(p), 5) + 0.0 AS v FROM b""",
)
def unmixing_matrix(spark, sf):
    """What is saved beside unmixed files: (A'A)^-1 A' and, with weights, (A'WA)^-1 A'W."""
    from lumenfold.sources.spectra_files import unmixing_matrix as run

    ev = events(spark, sf)
    panel, w = all_classes(ev), kernels.weights(unmix.column_mean(ev, "x", WIDTH), 1e-3)
    rows = [(m, int(n), d, round(float(v), 5) + 0.0) for m, q in (("OLS", run(panel)), ("WLS", run(panel, w))) for n, s in zip(q.names, q.S, strict=True) for d, v in enumerate(s)]
    return spark.createDataFrame(rows, "method string, label int, pos int, v double")


@query(
    "unmix_wls_per_cell",
    f"""{BASE}, {COUNTS}, dy AS (SELECT label AS i, list(v ORDER BY pos) AS s FROM (SELECT label, pos, avg(v) AS v FROM (SELECT label, unnest(range(64)) AS pos, unnest(x) AS v FROM cx) GROUP BY ALL) GROUP BY label),
    sw AS (SELECT vec_id, i, x, list_transform(list_zip(s, x), lambda z: z[1] / greatest(abs(z[2]), 1e-6)) AS sw FROM cx, dy),
    e AS (SELECT 0 AS k, vec_id, sw.i AS i, list_append(list(list_dot_product(sw, b.s) ORDER BY b.i), any_value(list_dot_product(sw, x))) AS r FROM sw, dy b GROUP BY vec_id, sw.i
      UNION ALL SELECT e.k + 1, e.vec_id, e.i, CASE WHEN e.i = q.i THEN list_transform(q.r, lambda z: z / q.r[q.i + 1])
        ELSE list_transform(list_zip(e.r, q.r), lambda z: z[1] - z[2] * e.r[q.i + 1] / q.r[q.i + 1]) END
      FROM e JOIN e q ON q.k = e.k AND q.vec_id = e.vec_id AND q.i = e.k WHERE e.k < 10),
    u AS (SELECT vec_id, list(r[11] ORDER BY i) AS u FROM e WHERE k = 10 GROUP BY vec_id) SELECT vec_id, {wide(10, 'u[{i} + 1]', digits=4)} FROM u""",
)
def unmix_wls_per_cell(spark, sf):
    ev = _counts(events(spark, sf))
    out = unmix.unmix_wls_per_cell(ev.select("vec_id", "x"), all_classes(ev), "x", names=U10)
    return out.select("vec_id", *[A.rounded(F.col(u), 4).alias(u) for u in U10])


def _cramer(weights: str) -> str:
    """The normal equations of y against a1, a2, a3 with weights 1 / (a list)."""
    dot = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}, {weights}), lambda z: z[1] * z[2] / z[3]))"
    g = {(i, j): dot(f"a{i}", f"a{j}") for i in (1, 2, 3) for j in (1, 2, 3) if i <= j}
    fields = ", ".join([*[f"m{i}{j} := {v}" for (i, j), v in g.items()], *[f"r{i} := {dot(f'a{i}', 'y')}" for i in (1, 2, 3)]])
    return f"struct_pack({fields})"


def _det(columns) -> str:
    (a, b, c), (d, e, f), (g, h, i) = zip(*columns, strict=True)
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


def _solved(n: str) -> str:
    cols = [[f"{n}.m11", f"{n}.m12", f"{n}.m13"], [f"{n}.m12", f"{n}.m22", f"{n}.m23"], [f"{n}.m13", f"{n}.m23", f"{n}.m33"]]
    r = [f"{n}.r1", f"{n}.r2", f"{n}.r3"]
    whole = _det(cols)
    return "[" + ", ".join(f"{_det([r if k == j else cols[k] for k in range(3)])} / {whole}" for j in range(3)) + "]"


MEAN3 = "list_transform(list_zip(a1, a2, a3), lambda z: z[1] * {c}[1] + z[2] * {c}[2] + z[3] * {c}[3])"
DEVIANCE = "2 * list_sum(list_transform(list_zip(y, {m}), lambda z: z[1] * ln(z[1] / z[2]) - (z[1] - z[2])))"


@query(
    "poisson_three_dyes",
    f"""{BASE}, {COUNTS}, ab AS (SELECT label, list_transform(s, lambda z: abs(z)) AS a FROM sp), vw AS (SELECT list(v ORDER BY pos) AS w FROM (SELECT pos, greatest(avg(v), 1e-6) AS v FROM (SELECT unnest(range(64)) AS pos, unnest(x) AS v FROM cx) GROUP BY pos)),
    b0 AS (SELECT vec_id, x AS y, (SELECT a FROM ab WHERE label = 1) AS a1, (SELECT a FROM ab WHERE label = 2) AS a2, (SELECT a FROM ab WHERE label = 3) AS a3, (SELECT w FROM vw) AS w FROM cx),
    b1 AS (SELECT *, {_cramer("w")} AS n FROM b0), b2 AS (SELECT * EXCLUDE n, list_transform({_solved("n")}, lambda z: CASE WHEN z <= 0 THEN 1e-6 ELSE z END) AS c FROM b1),
    b3 AS (SELECT *, {MEAN3.format(c="c")} AS m FROM b2), b4 AS (SELECT *, {DEVIANCE.format(m="m")} AS old, {_cramer("m")} AS n FROM b3),
    st AS (SELECT 0 AS k, vec_id, y, a1, a2, a3, c, {_solved("n")} AS d, old, false AS done FROM b4
      UNION ALL SELECT k + 1, vec_id, y, a1, a2, a3, CASE WHEN ok THEN d ELSE c END, CASE WHEN NOT ok THEN list_transform(list_zip(c, d), lambda z: (z[1] + z[2]) / 2) WHEN ends THEN d ELSE {_solved("n")} END,
        CASE WHEN ok THEN dev ELSE old END, ends
      FROM (SELECT *, ok AND abs(dev - old) < 1e-8 * (abs(dev) + 0.1) AS ends FROM (SELECT *, CASE WHEN ok THEN {DEVIANCE.format(m="m")} END AS dev, CASE WHEN ok THEN {_cramer("m")} END AS n
        FROM (SELECT *, list_min(m) > 0 AS ok FROM (SELECT *, {MEAN3.format(c="d")} AS m FROM st WHERE NOT done AND k < 200)))))
    SELECT vec_id, round(d[1], 4) + 0.0 AS u0, round(d[2], 4) + 0.0 AS u1, round(d[3], 4) + 0.0 AS u2 FROM st WHERE done""",
)
def poisson_three_dyes(spark, sf):
    """Poisson fits of counts with three dyes (few enough for SQL to solve event by event)."""
    ev = _counts(events(spark, sf))
    S = np.abs(all_classes(events(spark, sf)).S[1:4])
    out = unmix.unmix_poisson(ev.select("vec_id", "x"), unmix.Panel([1, 2, 3], S), "x", names=U9[:3])
    return out.select("vec_id", *[A.rounded(F.col(u), 4).alias(u) for u in U9[:3]])


@query("unmix_poisson")
def unmix_poisson(spark, sf):
    ev = _counts(events(spark, sf))
    out = unmix.unmix_poisson(ev.select("vec_id", "x"), all_classes(ev), "x", names=U10)
    return out.select("vec_id", *[A.rounded(F.col(u), 4).alias(u) for u in U10])


# --- background and variants ------------------------------------------------------------------------------

SCENE = f"""{BASE}, {DYES9}, {AF}, {pinv(9)},
eu AS (SELECT vec_id, x, list(list_dot_product(x, p) ORDER BY i) AS u FROM ev, pp GROUP BY vec_id, x),
av AS (SELECT j, a, list(list_dot_product(a, p) ORDER BY i) AS v FROM af, pp GROUP BY j, a),
arl AS (SELECT j, pos, any_value(a[pos + 1]) - sum(v[i + 1] * s[pos + 1]) AS r FROM av, dy, (SELECT unnest(range(64)) AS pos) GROUP BY j, pos),
ar AS (SELECT j, list(r ORDER BY pos) AS r FROM arl GROUP BY j)"""
PICK = "row_number() OVER (PARTITION BY vec_id ORDER BY score, j) = 1"


RESIDUALS = """back AS (SELECT vec_id, pos, sum(u[i + 1] * s[pos + 1]) AS y FROM eu, dy, (SELECT unnest(range(64)) AS pos) GROUP BY vec_id, pos),
    res AS (SELECT vec_id, list(v - y ORDER BY pos) AS e FROM lg JOIN back USING (vec_id, pos) GROUP BY vec_id),
    sc AS (SELECT vec_id, j, -list_dot_product(e, a) AS score FROM res, af)"""


@query("af_residuals", f"{SCENE}, {RESIDUALS} SELECT vec_id, (j + 1)::INT AS af_index FROM sc QUALIFY {PICK}")
def af_residuals(spark, sf):
    ev = events(spark, sf)
    dyes, af = dyes_and_background(ev)
    return unmix.assign_af(ev.select("vec_id", "x"), dyes, af, "x", "residuals")


SPILL = """sc AS (SELECT vec_id, j, list_sum(list_transform(list_zip(u, v), lambda z: abs(z[1] - k * z[2]))) AS score
  FROM (SELECT vec_id, u, v, j, list_dot_product(x, r) / list_dot_product(r, r) AS k FROM eu, av JOIN ar USING (j)))"""


@query("af_fluorophores", f"{SCENE}, {SPILL} SELECT vec_id, (j + 1)::INT AS af_index FROM sc QUALIFY {PICK}")
def af_fluorophores(spark, sf):
    ev = events(spark, sf)
    dyes, af = dyes_and_background(ev)
    return unmix.assign_af(ev.select("vec_id", "x"), dyes, af, "x", "fluorophores")


JOINT_COV = """al AS (SELECT j, unnest(range(64)) AS pos, unnest(a) AS v FROM af),
    cv AS (SELECT x.pos AS p1, y.pos AS p2, covar_samp(x.v, y.v) AS c FROM al x JOIN al y USING (j) GROUP BY x.pos, y.pos),
    wt AS (SELECT list(w ORDER BY i) AS w FROM (SELECT i, sqrt(abs(sum(p[p1 + 1] * c * p[p2 + 1]))) AS w FROM pp, cv GROUP BY i)),
    up AS (SELECT vec_id, x, u, list_transform(u, lambda z: greatest(z, 0.0)) AS uc FROM eu),
    back AS (SELECT vec_id, pos, sum(uc[i + 1] * s[pos + 1]) AS y FROM up, dy, (SELECT unnest(range(64)) AS pos) GROUP BY vec_id, pos),
    res AS (SELECT vec_id, list(v - y ORDER BY pos) AS e FROM lg JOIN back USING (vec_id, pos) GROUP BY vec_id),
    ks AS (SELECT vec_id, u, e, v, r, j, greatest(list_dot_product(x, r) / list_dot_product(r, r), 0.0) AS k FROM up JOIN res USING (vec_id), av JOIN ar USING (j)),
    sc AS (SELECT vec_id, j,
      list_sum(list_transform(list_zip(u, v, w), lambda z: abs(z[1] - k * z[2]) * z[3])) / (list_sum(list_transform(list_zip(u, w), lambda z: abs(z[1]) * z[2])) + 1e-6)
      * (sqrt(list_sum(list_transform(list_zip(e, r), lambda z: (z[1] - k * z[2]) ** 2))) / (sqrt(list_dot_product(e, e)) + 1e-6)) AS score FROM ks, wt)"""


@query("af_joint_cov", f"{SCENE}, {JOINT_COV} SELECT vec_id, (j + 1)::INT AS af_index FROM sc QUALIFY {PICK}")
def af_joint_cov(spark, sf):
    ev = events(spark, sf)
    dyes, af = dyes_and_background(ev)
    return unmix.assign_af(ev.select("vec_id", "x"), dyes, af, "x", "joint_cov")


#: Events of class 1 in four parts are the variants of dye 1, scored against dyes 2 to 9.
VARIANTS = f"""{BASE}, dy AS (SELECT label - 2 AS i, s FROM sp WHERE label > 1),
afl AS (SELECT vec_id % 4 AS j, pos, avg(v) AS v FROM lg WHERE label = 1 GROUP BY ALL),
af AS (SELECT j, list(v ORDER BY pos) AS a FROM afl GROUP BY j), {pinv(8)},
eu AS (SELECT vec_id, x, list(list_dot_product(x, p) ORDER BY i) AS u FROM ev, pp GROUP BY vec_id, x),
av0 AS (SELECT j, a, list(list_dot_product(a, p) ORDER BY i) AS v FROM af, pp GROUP BY j, a),
arl AS (SELECT j, pos, any_value(a[pos + 1]) - sum(v[i + 1] * s[pos + 1]) AS r FROM av0, dy, (SELECT unnest(range(64)) AS pos) GROUP BY j, pos),
ar AS (SELECT j, list(r ORDER BY pos) AS r FROM arl GROUP BY j)"""


def _variants(ev):
    dyes, _ = dyes_and_background(ev)
    parts = class_spectra(ev.where("label = 1").withColumn("j", F.col("vec_id") % 4), "j")
    return dyes, unmix.Panel.collect(parts, "j", "spectrum").S


@query("variant_assign", f"{VARIANTS}, av AS (FROM av0), {SPILL} SELECT vec_id, (j + 1)::INT AS variant FROM sc QUALIFY {PICK}")
def variant_assign(spark, sf):
    ev = events(spark, sf)
    dyes, V = _variants(ev)
    return unmix.assign_variants(ev.select("vec_id", "x"), dyes, 1, V, "x")


@query(
    "variant_assign_cosine",
    f"""{VARIANTS}, cs AS (SELECT list(list_dot_product(s, a) / (sqrt(list_dot_product(s, s) + 1e-9) * sqrt(list_dot_product(a, a) + 1e-9)) ORDER BY i) AS c FROM dy, af WHERE j = 0),
    av AS (SELECT j, a, list_transform(list_zip(v, c), lambda z: z[1] * z[2]) AS v FROM av0, cs), {SPILL} SELECT vec_id, (j + 1)::INT AS variant FROM sc QUALIFY {PICK}""",
)
def variant_assign_cosine(spark, sf):
    ev = events(spark, sf)
    dyes, V = _variants(ev)
    return unmix.assign_variants(ev.select("vec_id", "x"), dyes, 1, V, "x", by_cosine=True)


def _grouped_sql() -> str:
    """Least squares on [dyes; a_j] through the block inverse: the background's coefficient is k = x.r / r.r, the dyes' u - k v."""
    cols = ", ".join(f"round(u[{i + 1}] - k * v[{i + 1}], 6) + 0.0 AS u{i}" for i in range(9))
    return f"""{SCENE}, {SPILL}, best AS (SELECT vec_id, j FROM sc QUALIFY {PICK})
    SELECT vec_id, {cols}, round(k, 6) + 0.0 AS af, (j + 1)::INT AS af_index
    FROM (SELECT vec_id, u, v, j, list_dot_product(x, r) / list_dot_product(r, r) AS k FROM best JOIN eu USING (vec_id) JOIN av USING (j) JOIN ar USING (j))"""


@query("unmix_af_grouped", _grouped_sql())
def unmix_af_grouped(spark, sf):
    ev = events(spark, sf)
    dyes, af = dyes_and_background(ev)
    out = unmix.unmix_per_cell_af(ev.select("vec_id", "x"), dyes, af, "x", names=U9)
    return out.select("vec_id", *[A.rounded(F.col(u)).alias(u) for u in U9], A.rounded(F.col("AF")).alias("af"), F.col("AF Index").alias("af_index"))


def _library(ev):
    """Variants of every dye: its events in four parts; thresholds: the 0.9 quantile of each dye on background events."""
    dyes, af = dyes_and_background(ev)
    parts = class_spectra(ev.where("label > 0").withColumn("j", F.col("label") * 4 + F.col("vec_id") % 4), "j").orderBy("j").collect()
    library = {f: np.array([r["spectrum"] for r in parts if r["j"] // 4 == f + 1]) for f in range(len(dyes.S))}
    neg = unmix.unmix_ols(ev.where("label = 0"), dyes, "x", U9)
    limits = array_quantiles(neg.select(F.lit(0).alias("k"), F.array(*U9).alias("x")), "k", "x", len(U9), [0.9])[1]
    return dyes, af, library, limits[0, 0]


@query("unmix_greedy")
def unmix_greedy(spark, sf):
    ev = events(spark, sf)
    dyes, af, library, thresholds = _library(ev)
    out = unmix.unmix_per_cell_af(ev.select("vec_id", "x"), dyes, af, "x", library=library, thresholds=thresholds, names=U9)
    return out.select("vec_id", *[A.rounded(F.col(u)).alias(u) for u in U9], A.rounded(F.col("AF")).alias("af"), F.col("AF Index").alias("af_index"))


@query("unmix_joint")
def unmix_joint(spark, sf):
    ev = events(spark, sf)
    dyes, af, library, thresholds = _library(ev)
    out = unmix.unmix_joint(ev.select("vec_id", "x"), dyes, af, library, thresholds, "x", af_passes=2, names=U9)
    return out.select("vec_id", *[A.rounded(F.col(u)).alias(u) for u in U9], A.rounded(F.col("AF")).alias("af"), F.col("AF Index").alias("af_index"))


@query(
    "optimize_necessity",
    f"""{BASE}, {DYES9}, {pinv(9)}, h AS (SELECT a.i, b.i AS j, list_dot_product(a.p, b.p) AS h FROM pp a, pp b),
    vv AS (SELECT f, j, list(v ORDER BY pos) AS v FROM (SELECT label - 1 AS f, vec_id % 4 AS j, pos, avg(v) AS v FROM lg WHERE label > 0 GROUP BY ALL) GROUP BY f, j),
    pd AS (SELECT f, j, pp.i AS g, list_dot_product(p, v) - list_dot_product(p, s) AS c FROM vv JOIN dy ON dy.i = f, pp),
    cc AS (SELECT x.f, x.g, x.j, x.c - hg.h / hf.h * y.c AS c, hh.h - hg.h ** 2 / hf.h AS n FROM pd x JOIN pd y ON y.f = x.f AND y.j = x.j AND y.g = x.f
      JOIN h hg ON hg.i = x.g AND hg.j = x.f JOIN h hf ON hf.i = x.f AND hf.j = x.f JOIN h hh ON hh.i = x.g AND hh.j = x.g WHERE x.g <> x.f),
    sc AS (SELECT f, sum(w) AS w FROM (SELECT f, g, sqrt(abs(var_samp(c) + 1e-4 * any_value(n))) AS w FROM cc GROUP BY f, g) GROUP BY f)
    SELECT (f + 1)::INT AS label, round(w / max(w) OVER (), 6) AS score, w / max(w) OVER () >= 0.01 AS recommended FROM sc""",
)
def optimize_necessity(spark, sf):
    """How much each dye's variation disturbs the other dyes, and whether optimising it is worth while."""
    dyes, _, library, _ = _library(events(spark, sf))
    score = kernels.necessity(dyes.S, {f: v - dyes.S[f] for f, v in library.items()})
    return spark.createDataFrame([(int(n), round(float(s), 6), bool(s >= 0.01)) for n, s in zip(dyes.names, score, strict=True)], "label int, score double, recommended boolean")
