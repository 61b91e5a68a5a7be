"""Queries on libraries of background and variants, evaluation, simulation, event files, and whole workflows."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import functions as F

from lumenfold.functions import arrays as A
from lumenfold.operators import evaluate, kernels, library, spectra, unmix
from lumenfold.operators.events import WIDTH, class_spectra, dyes_and_background, events
from lumenfold.operators.simulate import simulate
from lumenfold.operators.unmix import Panel
from lumenfold.plans import sql
from lumenfold.plans.registry import query
from lumenfold.plans.sql import AF, BASE, DYES9
from lumenfold.plans.unmix_queries import JOINT_COV, RESIDUALS, SCENE, SPILL

r6 = A.rounded


def _rows(spark, S, first="row"):
    return spark.createDataFrame([(i, j, round(float(v), 6) + 0.0) for i, s in enumerate(S) for j, v in enumerate(s)], f"{first} int, pos int, v double")


@query(
    "dedup_spectra",
    f"""{BASE}, cm AS (SELECT list(r ORDER BY a) AS m FROM (SELECT x.label AS a, list(list_dot_product(x.s, y.s) / (sqrt(list_dot_product(x.s, x.s) + 1e-9) * sqrt(list_dot_product(y.s, y.s) + 1e-9)) ORDER BY y.label) AS r FROM sp x, sp y GROUP BY x.label)),
    st AS (SELECT 0 AS k, []::INT[] AS kept UNION ALL SELECT k + 1, CASE WHEN len(list_filter(kept, lambda q: m[k + 1][q + 1] >= 0.15)) = 0 THEN list_append(kept, k) ELSE kept END FROM st, cm WHERE k < 10)
    SELECT unnest(kept)::INT AS label FROM st WHERE k = 10""",
)
def dedup_spectra(spark, sf):
    """Class means kept in order while unlike all kept before (cosine below 0.15: these classes are far apart)."""
    s = Panel.collect(class_spectra(events(spark, sf)), "label", "spectrum")
    return spark.createDataFrame([(int(s.names[i]),) for i in spectra.deduplicate(s.S, 0.15)], "label int")


@query(
    "qc_af",
    f"""{BASE}, {DYES9}, {AF}, c AS (SELECT j, i + 1 AS dye, list_dot_product(a, s) / (sqrt(list_dot_product(a, a) + 1e-9) * sqrt(list_dot_product(s, s) + 1e-9)) AS c FROM af, dy)
    SELECT j AS af_row, arg_max(dye, c)::INT AS dye, round(max(c), 6) + 0.0 AS cosine, max(c) <= 0.99 AS keep FROM c GROUP BY j""",
)
def qc_af(spark, sf):
    """The dye each background row is most like, and whether the row stays."""
    dyes, af = dyes_and_background(events(spark, sf))
    _, best, who = spectra.qc_background(af.S, dyes.S)
    return spark.createDataFrame([(int(j), int(dyes.names[w]), round(float(b), 6) + 0.0, bool(b <= 0.99)) for j, w, b in zip(af.names, who, best, strict=True)], "af_row long, dye int, cosine double, keep boolean")


@query("cosine_cross", f"{BASE}, {DYES9}, {AF} SELECT j AS af_row, (i + 1)::INT AS dye, round(list_dot_product(a, s) / (sqrt(list_dot_product(a, a) + 1e-9) * sqrt(list_dot_product(s, s) + 1e-9)), 6) + 0.0 AS cosine FROM af, dy")
def cosine_cross(spark, sf):
    dyes, af = dyes_and_background(events(spark, sf))
    c = spectra.cosine_cross(af.S, dyes.S)
    return spark.createDataFrame([(int(j), int(d), round(float(c[a, b]), 6) + 0.0) for a, j in enumerate(af.names) for b, d in enumerate(dyes.names)], "af_row long, dye int, cosine double")


@query("som_codebook")
def som_codebook(spark, sf):
    """A 4 x 4 map of one control's events."""
    return _rows(spark, library.som(events(spark, sf).where("label = 1"), "x", WIDTH, 4, "vec_id"), "node")


@query("af_library")
def af_library(spark, sf):
    """Background spectra of the unstained events, mean first. The unstained class alone is small, so all classes serve."""
    ev = events(spark, sf)
    dyes, _ = dyes_and_background(ev)
    return _rows(spark, library.background_library(ev, "x", dyes.S, "vec_id", dim=4, contaminant=2.0, refine=False))


@query("af_library_refined")
def af_library_refined(spark, sf):
    ev = events(spark, sf)
    dyes, _ = dyes_and_background(ev)
    return _rows(spark, library.background_library(ev, "x", dyes.S, "vec_id", dim=3, contaminant=2.0, refine=True))


@query("variant_library")
def variant_library(spark, sf):
    """Variants of each dye from its own events against all unstained ones, dimmed to a tenth: all classes are equally bright."""
    ev = events(spark, sf)
    dyes, _ = dyes_and_background(ev)
    neg, out = ev.where("label = 0").withColumn("x", F.transform("x", lambda v: v * 0.1)), []
    scaled = {int(n): s / s.max() for n, s in zip(dyes.names, dyes.S, strict=True)}
    for n, lib in library.variant_libraries(ev, neg, scaled, "label", "x", "vec_id", dim=2, least_cosine=0.1, least=2).items():
        out += [(n, i, float(np.linalg.norm(v - lib[0]).round(6))) for i, v in enumerate(lib)]
    return spark.createDataFrame(out, "label int, variant int, delta_norm double")


@query(
    "af_scatter_match",
    f"""{BASE}, {DYES9}, {sql.pinv(9)}, kn AS (SELECT q.vec_id, r.vec_id AS ref_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY (q.x[1] - r.x[1]) ** 2 + (q.x[2] - r.x[2]) ** 2, r.vec_id) AS rank FROM ev q JOIN ev r ON q.label > 0 AND r.label = 0),
    bg AS (SELECT kn.vec_id, pos, avg(v) AS b FROM kn JOIN lg ON lg.vec_id = ref_id WHERE rank <= 5 GROUP BY kn.vec_id, pos),
    bl AS (SELECT vec_id, list(b ORDER BY pos) AS b, max(abs(b)) AS m FROM bg GROUP BY vec_id),
    n AS (SELECT vec_id, x, b, list_transform(b, lambda z: z / m) AS a FROM bl JOIN ev USING (vec_id)),
    av AS (SELECT vec_id, list(list_dot_product(a, p) ORDER BY i) AS v, list(list_dot_product(x, p) ORDER BY i) AS u FROM n, pp GROUP BY vec_id),
    fit AS (SELECT n.vec_id, pos, any_value(x[pos + 1]) AS xv, any_value(a[pos + 1]) - sum(v[i + 1] * s[pos + 1]) AS r FROM n JOIN av USING (vec_id), dy, (SELECT unnest(range(64)) AS pos) GROUP BY n.vec_id, pos),
    k AS (SELECT vec_id, sum(xv * r) / sum(r * r) AS k FROM fit GROUP BY vec_id)
    SELECT vec_id, round(greatest(0.0, least(1.0, list_dot_product(x, b) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(b, b)) + 1e-9))), 6) + 0.0 AS cosine, round(k, 6) + 0.0 AS af, round(u[1] - k * v[1], 6) + 0.0 AS u0 FROM n JOIN av USING (vec_id) JOIN k USING (vec_id)""",
)
def af_scatter_match(spark, sf):
    """Background from the five unstained events nearest in scatter, as an extra row of each event's own fit."""
    ev = events(spark, sf)
    dyes, _ = dyes_and_background(ev)
    two = ev.select("vec_id", "label", F.get("x", F.lit(0)).alias("a"), F.get("x", F.lit(1)).alias("b"), "x")
    out = evaluate.scatter_match(two.where("label > 0"), two.where("label = 0"), dyes, None, ["a", "b"], "x", 5, scale=False)
    return out.select("vec_id", r6(F.col("cosine")).alias("cosine"), r6(F.col("AF")).alias("af"), r6(F.col("u0")).alias("u0"))


def _named(ctes: str, names: str, mark: str) -> str:
    """CTEs with the given names marked, so that two versions stand side by side."""
    return re.sub(rf"\b({names})\b(?!\()", rf"\1{mark}", ctes)


def _accuracy(rules: list[str], test: str = "label = 0", more: str = "") -> str:
    """CTEs up to ac(rule, vec_id, cosine, left): each test event with the background that a rule assigns, and the mean one."""
    pieces = {"residuals": RESIDUALS, "fluorophores": SPILL, "joint_cov": JOINT_COV}
    parts = [_named(pieces[r], "sc|back|res|ks|up", f"_{r}") for r in rules]
    picks = " UNION ALL ".join(f"SELECT '{r}' AS rule, vec_id, j FROM (SELECT vec_id, j, row_number() OVER (PARTITION BY vec_id ORDER BY score, j) AS rn FROM sc_{r}) WHERE rn = 1" for r in rules)
    return f"""{SCENE}, {", ".join(parts)}, pk AS ({picks}),
    ma AS (SELECT list(v ORDER BY pos) AS a FROM (SELECT pos, avg(v) AS v FROM (SELECT unnest(range(64)) AS pos, unnest(a) AS v FROM af) GROUP BY pos)),
    mv AS (SELECT a, list(list_dot_product(a, p) ORDER BY i) AS v FROM ma, pp GROUP BY a),
    mr AS (SELECT any_value(a) AS a, any_value(v) AS v, list(r ORDER BY pos) AS r FROM (SELECT pos, any_value(a) AS a, any_value(v) AS v, any_value(a[pos + 1]) - sum(v[i + 1] * s[pos + 1]) AS r FROM mv, dy, (SELECT unnest(range(64)) AS pos) GROUP BY pos)),
    bg AS (SELECT rule, vec_id, a, v, r FROM pk JOIN av USING (j) JOIN ar USING (j) UNION ALL SELECT 'baseline', vec_id, a, v, r FROM ev, mr),
    ac AS (SELECT rule, vec_id, list_dot_product(x, a) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(a, a)) + 1e-9) AS cosine,
      list_avg(list_transform(list_zip(u, v), lambda z: abs(z[1] - list_dot_product(x, r) / list_dot_product(r, r) * z[2]))) AS "left"
      FROM bg JOIN eu USING (vec_id) JOIN (SELECT vec_id, label FROM ev) USING (vec_id) WHERE {test}){more}"""


@query(
    "af_accuracy",
    f"""{_accuracy(["residuals", "fluorophores", "joint_cov"])}
    SELECT rule, round(avg(cosine), 6) + 0.0 AS mean_cosine, round(stddev_samp(cosine), 6) + 0.0 AS sd_cosine, round(avg("left"), 6) + 0.0 AS mean_abs, count(*) AS n FROM ac GROUP BY rule""",
)
def af_accuracy(spark, sf):
    ev = events(spark, sf)
    dyes, af = dyes_and_background(ev)
    out = evaluate.background_accuracy(ev.where("label = 0"), dyes, af)
    return out.select("rule", *[r6(F.col(c)).alias(c) for c in ("mean_cosine", "sd_cosine", "mean_abs")], "n")


@query("af_benchmark")
def af_benchmark(spark, sf):
    """Background accuracy over random panels of three sizes, summarised by size and rule."""
    ev = events(spark, sf)
    dyes, af = dyes_and_background(ev)
    runs = evaluate.panel_benchmark(ev.where("label = 0"), dyes, af, (3, 6), 2, rules=["residuals", "fluorophores"])
    return runs.groupBy("n_dyes", "rule").agg(r6(F.avg("mean_cosine")).alias("mean"), r6(F.stddev_samp("mean_cosine")).alias("sd"))


@query(
    "compare_af",
    f"""{SCENE}, {SPILL}, pk AS (SELECT 'five' AS library, vec_id, j FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score, j) AS rn FROM sc) WHERE rn = 1
      UNION ALL SELECT 'two', vec_id, j FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score, j) AS rn FROM sc WHERE j < 2) WHERE rn = 1),
    c AS (SELECT library, list_dot_product(x, a) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(a, a)) + 1e-9) AS c FROM pk JOIN ev USING (vec_id) JOIN af USING (j) WHERE label = 0),
    m AS (SELECT library, c, median(c) OVER (PARTITION BY library) AS md FROM c)
    SELECT library, round(avg(c), 6) + 0.0 AS mean, round(1.4826 * median(abs(c - md)), 6) + 0.0 AS mad FROM m GROUP BY library""",
)
def compare_af(spark, sf):
    ev = events(spark, sf)
    dyes, af = dyes_and_background(ev)
    libraries = {"five": af, "two": Panel(af.names[:2], af.S[:2])}
    return evaluate.compare_backgrounds(ev.where("label = 0"), dyes, libraries).select("library", r6(F.col("mean")).alias("mean"), r6(F.col("mad")).alias("mad"))


def _spill(panel: str, dyes: str) -> str:
    """CTEs up to out_{panel}: spill and index of the events unmixed with a panel; its dyes are the detectors."""
    n = panel
    return f"""{dyes}, {sql.pinv(10, f"dy_{n}", f"pp_{n}")}, l_{n} AS (SELECT vec_id, label, i AS pos, list_dot_product(x, p) AS v FROM ev, pp_{n}),
    m_{n} AS (SELECT label, pos, avg(v) AS v FROM l_{n} GROUP BY ALL), k_{n} AS (SELECT label, arg_max(pos, v) AS peak FROM m_{n} GROUP BY label),
    t_{n} AS (SELECT pos, quantile_cont(v, 0.95) AS q, median(v) AS mn0, 1.4826 * mad(v) AS md0 FROM l_{n} WHERE label = 0 GROUP BY pos),
    p_{n} AS (SELECT l.label, l.vec_id, k.peak FROM l_{n} l JOIN k_{n} k ON l.label = k.label AND l.pos = k.peak JOIN t_{n} t ON t.pos = k.peak WHERE l.label > 0 AND v > q QUALIFY row_number() OVER (PARTITION BY l.label ORDER BY v DESC, vec_id) <= 500),
    d_{n} AS (SELECT l.label, l.pos, any_value(peak) AS peak, median(v) - any_value(mn0) AS dm, any_value(md0) AS md0 FROM l_{n} l JOIN p_{n} USING (label, vec_id) JOIN t_{n} USING (pos) GROUP BY l.label, l.pos),
    o_{n} AS (SELECT '{n}' AS panel, label, pos::INT AS pos, round(dm / df, 6) + 0.0 AS spill, CASE WHEN pos = peak THEN 0.0 ELSE round(dm / (2 * md0), 6) + 0.0 END AS ssi FROM d_{n} JOIN (SELECT label, dm AS df FROM d_{n} WHERE pos = peak) USING (label))"""


@query(
    "compare_unmix",
    f"""{BASE}, {_spill("mean", "dy_mean AS (SELECT label AS i, s FROM sp)")},
    {_spill("median", "dy_median AS (SELECT label AS i, list(v ORDER BY pos) AS s FROM (SELECT label, pos, median(v) AS v FROM lg GROUP BY ALL) GROUP BY label)")} FROM o_mean UNION ALL FROM o_median""",
)
def compare_unmix(spark, sf):
    """Spill and stain index of means against medians as the mixing matrix."""
    from lumenfold.operators.events import class_medians

    ev = events(spark, sf)
    mean = Panel.collect(class_spectra(ev), "label", "spectrum")
    median = Panel.collect(class_medians(ev), "label", "spectrum")
    out = evaluate.compare_unmixing(ev, {"mean": mean, "median": median})
    return out.select("panel", "label", "pos", r6(F.col("spill")).alias("spill"), r6(F.col("ssi")).alias("ssi"))


MIX = " + ".join(f"((vec_id * {7 + 3 * i}) % {11 + i})::DOUBLE * s{i + 1}.v" for i in range(3))


@query(
    "simulate_clean_mix",
    f"""{BASE}, mx AS (SELECT vec_id, s1.pos, {MIX} AS y FROM ev, mn s1 JOIN mn s2 USING (pos) JOIN mn s3 USING (pos) WHERE s1.label = 1 AND s2.label = 2 AND s3.label = 3)
    SELECT vec_id, round(sum(y), 6) + 0.0 AS total, round(sum(y) FILTER (pos = 5), 6) + 0.0 AS d5, round(sum(y) FILTER (pos = 40), 6) + 0.0 AS d40 FROM mx GROUP BY vec_id""",
)
def simulate_clean_mix(spark, sf):
    """Noise-free mixtures of three spectra with abundances in closed form of the id."""
    ev = events(spark, sf)
    p = Panel.collect(class_spectra(ev.where("label IN (1, 2, 3)")), "label", "spectrum")
    u = [((F.col("vec_id") * (7 + 3 * i)) % (11 + i)).cast("double") for i in range(3)]
    at = lambda q: sum((u[i] * float(p.S[i, q]) for i in range(3)), F.lit(0.0))
    total = sum((u[i] * float(p.S[i].sum()) for i in range(3)), F.lit(0.0))
    return ev.select("vec_id", r6(total).alias("total"), r6(at(5)).alias("d5"), r6(at(40)).alias("d40"))


@query("simulate_noisy")
def simulate_noisy(spark, sf):
    """Simulated events unmixed with the true spectra: recovered against true abundance, by dye."""
    p = Panel.collect(class_spectra(events(spark, sf).where("label > 0")), "label", "spectrum")
    S = np.abs(p.S) / np.abs(p.S).max(1, keepdims=True)
    sim = simulate(spark, S, 4096, seed=3)
    out = unmix.project(sim.select("event_id", "abundance", "spectral"), "spectral", kernels.ols(S), [f"u{i}" for i in range(len(S))])
    pairs = out.select(F.posexplode(F.arrays_zip(F.col("abundance").alias("a"), F.array(*[f"u{i}" for i in range(len(S))]).alias("u"))).alias("dye", "z"))
    return pairs.groupBy("dye").agg(F.round(F.corr("z.a", "z.u"), 4).alias("corr"), F.count(F.lit(1)).alias("n"))


@query("simulated_af_recovery")
def simulated_af_recovery(spark, sf):
    """How often each rule finds the true background row of simulated events."""
    dyes, af = dyes_and_background(events(spark, sf))
    S, B = np.abs(dyes.S) / np.abs(dyes.S).max(1, keepdims=True), np.abs(af.S)
    sim = simulate(spark, S, 2048, af=B, seed=5).select("af_row", "spectral")
    out = None
    for rule in unmix.ASSIGNMENTS:
        one = unmix.assign_af(sim, Panel(dyes.names, S), Panel(af.names, B), "spectral", rule)
        one = one.agg(F.round(F.avg((F.col("af_index") == F.col("af_row")).cast("double")), 4).alias("share")).select(F.lit(rule).alias("rule"), "share")
        out = one if out is None else out.unionByName(one)
    return out


@query("spectra_to_wide", f"{BASE} SELECT label, round(s[1], 6) + 0.0 AS d0, round(s[32], 6) + 0.0 AS d31, round(s[64], 6) + 0.0 AS d63 FROM sp")
def spectra_to_wide(spark, sf):
    """The wide form at the edges of the engine: one column a detector."""
    s = class_spectra(events(spark, sf))
    return s.select("label", *[r6(F.get("spectrum", F.lit(i))).alias(f"d{i}") for i in (0, 31, 63)])


@query("unmix_projection", f"{BASE} SELECT vec_id, label, round(x[1], 6) + 0.0 AS \"D0-A\", round(x[2], 6) + 0.0 AS \"D1-A\" FROM ev WHERE label <> 0")
def unmix_projection(spark, sf):
    """Carried columns of the unmixed sink beside the suffixed dye columns; the background's own rows left out."""
    ev = events(spark, sf).where("label <> 0")
    return ev.select("vec_id", "label", *[r6(F.get("x", F.lit(i))).alias(f"D{i}-A") for i in (0, 1)])


@query("unmix_poisson_counts")
def unmix_poisson_counts(spark, sf):
    """Poisson fits of simulated counts, the mean absolute relative error by dye."""
    dyes, _ = dyes_and_background(events(spark, sf))
    S = np.abs(dyes.S) / np.abs(dyes.S).max(1, keepdims=True)
    sim = simulate(spark, S, 2048, complexity=1.0, top=40000.0, cytometer="xenith", seed=9).select("event_id", "abundance", "spectral")
    out = unmix.unmix_poisson(sim, Panel(dyes.names, S), "spectral", names=[f"u{i}" for i in range(len(S))])
    pairs = out.select(F.posexplode(F.arrays_zip(F.col("abundance").alias("a"), F.array(*[f"u{i}" for i in range(len(S))]).alias("u"))).alias("dye", "z"))
    return pairs.groupBy("dye").agg(F.round(F.percentile(F.abs(F.col("z.u") - F.col("z.a")) / F.col("z.a"), F.lit(0.5)), 4).alias("error"))


@query(
    "automated_spectra",
    f"""{BASE}, nb AS (SELECT list(m ORDER BY pos) AS b FROM (SELECT pos, median(v + 1) AS m FROM lg WHERE label = 0 GROUP BY pos)),
    s1 AS (SELECT label, list_transform(s, lambda z: z + 1) AS s FROM sp WHERE label > 0),
    pj AS (SELECT label, list_transform(list_zip(s, b), lambda z: z[1] - z[2] * list_dot_product(s, b) / list_dot_product(b, b)) AS o FROM s1, nb),
    pk AS (SELECT label, list_position(o, list_max(o)) AS peak FROM pj),
    ca AS (SELECT label, vec_id, x, list_transform(x, lambda z: z + 1) AS y FROM ev JOIN pk USING (label) QUALIFY row_number() OVER (PARTITION BY label ORDER BY x[peak] + 1 DESC, vec_id) <= 1000),
    cb AS (SELECT label, vec_id, x FROM ca, nb QUALIFY row_number() OVER (PARTITION BY label ORDER BY list_dot_product(y, b) / (sqrt(list_dot_product(y, y)) * sqrt(list_dot_product(b, b)) + 1e-9), vec_id) <= 200),
    kn AS (SELECT cb.vec_id, r.vec_id AS ref, row_number() OVER (PARTITION BY cb.vec_id ORDER BY (cb.x[1] - r.x[1]) ** 2 + (cb.x[2] - r.x[2]) ** 2) AS rank FROM cb, ev r WHERE r.label = 0),
    bk AS (SELECT kn.vec_id, pos, avg(v) AS b FROM kn JOIN lg ON lg.vec_id = ref WHERE rank <= 2 GROUP BY kn.vec_id, pos),
    md AS (SELECT cb.label, bk.pos, median(x[bk.pos + 1] - b) AS m FROM cb JOIN bk USING (vec_id) GROUP BY cb.label, bk.pos),
    mx AS (SELECT label, max(m) AS t FROM md GROUP BY label),
    fs AS (SELECT label, list(greatest(m / t, 0.0) ORDER BY pos) AS s FROM md JOIN mx USING (label) GROUP BY label),
    lr AS (SELECT a.label, list_transform(list_zip(a.s, b.s), lambda z: greatest(z[1] - z[2], 0.0)) AS r FROM sp a, sp b WHERE b.label = 0 AND a.label > 0),
    lb AS (SELECT k.label, list_transform(r, lambda z: z / list_max(r)) AS r FROM (SELECT label, CASE label WHEN 3 THEN 4 WHEN 7 THEN 8 ELSE label END AS src FROM sp WHERE label > 0) k JOIN lr ON lr.label = k.src),
    cs AS (SELECT label, s, list_dot_product(s, r) / (sqrt(list_dot_product(s, s) + 1e-9) * sqrt(list_dot_product(r, r) + 1e-9)) AS c FROM fs JOIN lb USING (label))
    SELECT 'dye' || label AS fluorophore, CASE WHEN c < 0.6 THEN 'LEGACY_REFINEMENT' ELSE 'OK' END AS status, round(c, 6) + 0.0 AS similarity, pos::INT AS pos, round(s[pos + 1], 6) + 0.0 AS v
    FROM cs, (SELECT unnest(range(64)) AS pos)""",
)
def automated_spectra(spark, sf):
    """Spectra straight from controls, with the first two detectors as scatter; the library has wrong spectra of two dyes."""
    return _automated(spark, sf, False)


@query("refined_spectra")
def refined_spectra(spark, sf):
    """The same, and a second route for the dyes that are little like the library."""
    return _automated(spark, sf, True)


def _automated(spark, sf, refine):
    from lumenfold.params import Parameters
    from lumenfold.plans.flow import automated_spectra as run

    e, library = controls_and_library(spark, sf)
    panel, log = run(e, Parameters(cosine_fail=0.6), library, refine=refine)
    of = {n: (s, c) for n, s, c in log}
    rows = [(n, of[n][0], round(of[n][1], 6) + 0.0, i, round(float(v), 6) + 0.0) for n, s in zip(panel.names, panel.S, strict=True) for i, v in enumerate(s)]
    return spark.createDataFrame(rows, "fluorophore string, status string, similarity double, pos int, v double")


def controls_and_library(spark, sf):
    """The classes as controls, class 0 unstained; and a library of their means less its mean, those of dyes 3 and 7 mistaken
    for their neighbours'."""
    ev = events(spark, sf)
    name = F.when(F.col("label") == 0, "AF").otherwise(F.concat(F.lit("dye"), F.col("label")))
    e = ev.select(F.col("vec_id").alias("event_id"), name.alias("fluorophore"), F.get("x", F.lit(0)).alias("FSC-A"), F.get("x", F.lit(1)).alias("SSC-A"), F.transform("x", lambda v: v + 1).alias("spectral"))
    means = Panel.collect(class_spectra(ev), "label", "spectrum")
    raw = np.maximum(means.S[1:] - means.S[0], 0)
    scaled = raw / raw.max(1, keepdims=True)
    return e, Panel([f"dye{k}" for k in range(1, 10)], scaled[[{3: 4, 7: 8}.get(k, k) - 1 for k in range(1, 10)]])


@query("worst_channels", f"{BASE} SELECT label, pos::INT AS pos, round(sd, 6) + 0.0 AS sd FROM (SELECT label, pos, stddev_samp(v) AS sd, row_number() OVER (PARTITION BY label ORDER BY round(stddev_samp(v), 9) DESC, pos) AS r FROM lg GROUP BY label, pos) WHERE r <= 2")
def worst_channels(spark, sf):
    """The two detectors with the largest deviation in each class."""
    from lumenfold.operators import clean

    s = class_spectra(events(spark, sf), how=F.stddev_samp).select("label", F.posexplode("spectrum").alias("pos", "sd"))
    return clean.top(s.withColumn("k", F.round("sd", 9)), "k", 2, ["label"], "pos").select("label", "pos", r6(F.col("sd")).alias("sd"))


@query("bootstrap_sample", "WITH n AS (SELECT count(*) AS n FROM embeddings), d AS (SELECT vec_id AS i, (vec_id * 7919 + 104729) % n AS place FROM embeddings, n), r AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS place FROM embeddings) SELECT i, vec_id FROM d JOIN r USING (place)")
def bootstrap_sample(spark, sf):
    """A sample with replacement of the same size: draw i takes the row at a position that a multiplicative hash gives."""
    from lumenfold.functions.stats import positions

    e = events(spark, sf).select("vec_id")
    n = e.count()
    rows = positions(e, "vec_id", "at")
    return e.select(F.col("vec_id").alias("i"), ((F.col("vec_id") * 7919 + 104729) % n).alias("at")).join(rows, "at").select("i", "vec_id")


@query(
    "scatter_match_benchmark",
    f"""{_accuracy(["residuals", "fluorophores"], "label = 0 AND vec_id % 2 = 1")},
    rf AS (SELECT vec_id, x FROM ev WHERE label = 0 AND vec_id % 2 = 0), ce AS (SELECT avg(x[1]) AS c1, avg(x[2]) AS c2, 1.4826 * mad(x[1]) AS s1, 1.4826 * mad(x[2]) AS s2 FROM rf),
    kn AS (SELECT q.vec_id, rf.vec_id AS ref, row_number() OVER (PARTITION BY q.vec_id ORDER BY ((q.x[1] - rf.x[1]) / s1) ** 2 + ((q.x[2] - rf.x[2]) / s2) ** 2) AS rank FROM ev q, rf, ce WHERE q.label = 0 AND q.vec_id % 2 = 1),
    mb AS (SELECT vec_id, list(b ORDER BY pos) AS b FROM (SELECT kn.vec_id, pos, avg(v) AS b FROM kn JOIN lg ON lg.vec_id = ref WHERE rank <= 5 GROUP BY kn.vec_id, pos) GROUP BY vec_id),
    lb AS (SELECT vec_id, a AS b FROM mb, af QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY list_dot_product(b, a) / (sqrt(list_dot_product(a, a)) + 1e-9) DESC, j) = 1),
    sm AS (SELECT 'scatter' AS rule, * FROM mb UNION ALL SELECT 'scatter_library', * FROM lb)
    SELECT rule, round(avg(cosine), 6) + 0.0 AS mean_cosine FROM ac GROUP BY rule UNION ALL
    SELECT rule, round(avg(greatest(0.0, least(1.0, list_dot_product(x, b) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(b, b)) + 1e-9)))), 6) + 0.0 FROM sm JOIN ev USING (vec_id) GROUP BY rule""",
)
def scatter_match_benchmark(spark, sf):
    """Background by scatter, with and without a library, against the rules on spectra: mean cosine of unstained events."""
    ev = events(spark, sf)
    dyes, af = dyes_and_background(ev)
    test = ev.where("label = 0 AND vec_id % 2 = 1")  # the other half of the control is the reference
    two, ref = (df.select("vec_id", F.get("x", F.lit(0)).alias("a"), F.get("x", F.lit(1)).alias("b"), "x") for df in (test, ev.where("label = 0 AND vec_id % 2 = 0")))
    out = evaluate.background_accuracy(test, dyes, af, ["residuals", "fluorophores"]).select("rule", "mean_cosine")
    for name, lib in (("scatter", None), ("scatter_library", af)):
        one = evaluate.scatter_match(two, ref, dyes, lib, ["a", "b"], "x").agg(F.avg("cosine").alias("mean_cosine"))
        out = out.unionByName(one.select(F.lit(name).alias("rule"), "mean_cosine"))
    return out.select("rule", r6(F.col("mean_cosine")).alias("mean_cosine"))


@query("remove_background")
def remove_background(spark, sf):
    """Events of each control that stay once its background events are removed."""
    from lumenfold.operators.af_removal import remove_background as run

    ev = events(spark, sf)
    peaks = {f"dye{r['label']}": r["peak"] for r in class_spectra(ev.where("label > 0")).select("label", A.peak(F.col("spectrum")).alias("peak")).collect()}
    neg = np.array([r["x"] for r in ev.where("label = 0").orderBy("vec_id").select("x").collect()])
    rows = ev.where("label > 0").select(F.concat(F.lit("dye"), F.col("label")).alias("sample"), "vec_id", F.col("x").alias("spectral"))
    return run(rows, neg, peaks).groupBy("sample").agg(F.count(F.lit(1)).alias("kept"))


@query("landmark_gate")
def landmark_gate(spark, sf):
    from lumenfold.operators import gate
    from lumenfold.operators.events import lineitem

    li = lineitem(spark, sf, "l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_extendedprice")
    g = gate.landmark_gate(li, "l_extendedprice", "l_quantity", "l_extendedprice", (0.0, 0.0), (51.0, 110000.0), sample="l_returnflag", id_col=["l_orderkey", "l_linenumber"], n=40)
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(g)], "ord int, x double, y double")


@query("density_palette", "SELECT event_type, greatest(0, least(11, floor(value / (500.0::DOUBLE / 12))::INT))::INT AS colour, count(*) AS n FROM events GROUP BY ALL")
def density_palette(spark, sf):
    from lumenfold.operators.events import table
    from lumenfold.operators.gate import palette

    return table(spark, sf, "events").groupBy("event_type", palette(F.col("value"), 0.0, 500.0).alias("colour")).agg(F.count(F.lit(1)).alias("n"))


@query("unmix_fast_poisson")
def unmix_fast_poisson(spark, sf):
    ev = events(spark, sf)
    counts = ev.select("vec_id", F.transform("x", lambda v: F.round((v + 1) * 1000)).alias("x"))
    panel = Panel.collect(class_spectra(ev), "label", "spectrum")
    out = unmix.unmix_fast_poisson(counts, panel, "x", names=[f"u{i}" for i in range(10)])
    return out.select("vec_id", *[r6(F.col(f"u{i}"), 4).alias(f"u{i}") for i in range(10)])
