"""Queries on control cleaning, gating, robust statistics, and the data behind plots."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenfold.functions import arrays as A
from lumenfold.functions.stats import column_quantiles, histogram, quantile, with_mad
from lumenfold.operators import clean, gate
from lumenfold.operators.events import class_medians, class_spectra, events, lineitem, table
from lumenfold.operators.knn import knn_join
from lumenfold.plans.registry import query
from lumenfold.plans.sql import BASE, EV

r6 = A.rounded

# --- cleaning ---------------------------------------------------------------------------------------------


@query("saturation_filter", f"WITH {EV} SELECT vec_id FROM ev WHERE list_max(x) < 0.3")
def saturation_filter(spark, sf):
    return clean.unsaturated(events(spark, sf), "x", 0.3).select("vec_id")


@query("scatter_ceiling", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 40 AND l_extendedprice < 60000")
def scatter_ceiling(spark, sf):
    li = lineitem(spark, sf, "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return clean.below_ceiling(li, "l_quantity", "l_extendedprice", 40, 60000).select("l_orderkey", "l_linenumber")


@query(
    "singlets",
    """WITH a AS (SELECT *, l_extendedprice / (l_quantity + 1e-9) AS r1, l_extendedprice / (l_tax + 1 + 1e-9) AS r2 FROM lineitem),
    b AS (SELECT * FROM a JOIN (SELECT l_returnflag, quantile_cont(r1, 0.85) AS q FROM a GROUP BY l_returnflag) USING (l_returnflag) WHERE r1 < q),
    c AS (SELECT l_returnflag, quantile_cont(r2, 0.975) AS q2 FROM b GROUP BY l_returnflag)
    SELECT l_orderkey, l_linenumber FROM b JOIN c USING (l_returnflag) WHERE r2 < q2""",
)
def singlets(spark, sf):
    li = lineitem(spark, sf, "l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice", "l_quantity", (F.col("l_tax") + 1).alias("h2"))
    out = clean.singlets(li, ["l_returnflag"], [("l_extendedprice", "l_quantity", 0.85), ("l_extendedprice", "h2", 0.975)])
    return out.select("l_orderkey", "l_linenumber")


@query(
    "contaminant_filter",
    f"""{BASE}, c AS (SELECT vec_id, list_transform(x, lambda z: z - list_avg(x)) AS y FROM ev),
    k AS (SELECT vec_id, max(list_dot_product(y, s) / (sqrt(list_dot_product(y, y)) * sqrt(list_dot_product(s, s)) + 1e-9)) AS m FROM c, sp WHERE label > 0 GROUP BY vec_id)
    SELECT vec_id FROM k WHERE m < 0.7""",
)
def contaminant_filter(spark, sf):
    ev = events(spark, sf)
    dyes = [r["spectrum"] for r in class_spectra(ev.where("label > 0")).orderBy("label").collect()]
    return clean.not_like(ev, "x", dyes, 0.7).select("vec_id")


@query("positivity", "SELECT event_id, event_type, value FROM events WHERE event_type <> 'view' AND value > (SELECT quantile_cont(value, 0.95) FROM events WHERE event_type = 'view')")
def positivity(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", "value")
    return clean.positives(e.where("event_type <> 'view'"), "value", e.where("event_type = 'view'"), 0.95)


def _scatter(ev):
    return ev.select("vec_id", "label", "x", F.get("x", F.lit(0)).alias("a"), F.get("x", F.lit(1)).alias("b"))


def _near(ev, k):
    """The k nearest unstained events of each stained one in the scatter plane."""
    at = _scatter(ev)
    return knn_join(at.where("label > 0"), at.where("label = 0"), k, "vec_id", "vec_id", ["a", "b"])


KNN = """kn AS (SELECT q.vec_id, r.vec_id AS ref_id, (q.x[1] - r.x[1]) ** 2 + (q.x[2] - r.x[2]) ** 2 AS d2,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY (q.x[1] - r.x[1]) ** 2 + (q.x[2] - r.x[2]) ** 2, r.vec_id) AS rank
  FROM ev q JOIN ev r ON q.label > 0 AND r.label = 0)"""


@query("knn_scatter", f"WITH {EV}, {KNN} SELECT vec_id, ref_id, rank::INT AS rank, round(d2, 9) + 0.0 AS d2 FROM kn WHERE rank <= 3")
def knn_scatter(spark, sf):
    found = _near(events(spark, sf), 3)
    return found.select("vec_id", "ref_id", "rank", r6(F.col("d2"), 9).alias("d2"))


@query(
    "knn_background",
    f"WITH {EV}, {KNN} SELECT kn.vec_id, round(avg(e.x[6]), 6) + 0.0 AS d5, round(avg(e.x[33]), 6) + 0.0 AS d32 FROM kn JOIN ev e ON e.vec_id = kn.ref_id WHERE rank <= 3 GROUP BY kn.vec_id",
)
def knn_background(spark, sf):
    """Mean background spectrum of the three nearest unstained events, at two detectors."""
    ev = events(spark, sf)
    found = _near(ev, 3)
    ref = ev.where("label = 0").select(F.col("vec_id").alias("ref_id"), F.get("x", F.lit(5)).alias("d5"), F.get("x", F.lit(32)).alias("d32"))
    return found.join(ref, "ref_id").groupBy("vec_id").agg(r6(F.avg("d5")).alias("d5"), r6(F.avg("d32")).alias("d32"))


@query(
    "knn_mad_scaled",
    f"""WITH {EV}, m AS (SELECT avg(x[1]) AS c1, avg(x[2]) AS c2, median(x[1]) AS m1, median(x[2]) AS m2 FROM ev WHERE label = 0),
    s AS (SELECT any_value(c1) AS c1, any_value(c2) AS c2, 1.4826 * median(abs(x[1] - m1)) AS s1, 1.4826 * median(abs(x[2] - m2)) AS s2 FROM ev, m WHERE label = 0),
    z AS (SELECT vec_id, label, (x[1] - c1) / s1 AS a, (x[2] - c2) / s2 AS b FROM ev, s),
    k AS (SELECT q.vec_id, r.vec_id AS ref_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY (q.a - r.a) ** 2 + (q.b - r.b) ** 2, r.vec_id) AS rank FROM z q JOIN z r ON q.label > 0 AND r.label = 0)
    SELECT vec_id, ref_id, rank::INT AS rank FROM k WHERE rank <= 5""",
)
def knn_mad_scaled(spark, sf):
    """Nearest unstained events after scaling both axes by the reference's mean and MAD (a MAD near zero counts as 1)."""
    ev = events(spark, sf)
    ref = _scatter(ev).where("label = 0")
    mean = ref.agg(F.avg("a"), F.avg("b")).first()
    med = ref.agg(quantile(F.col("a"), 0.5), quantile(F.col("b"), 0.5)).first()
    mad = ref.agg(*[1.4826 * quantile(F.abs(F.col(c) - med[i]), 0.5) for i, c in enumerate("ab")]).first()
    scale = [m if m >= 1e-9 else 1.0 for m in mad]
    at = _scatter(ev).select("vec_id", "label", *[((F.col(c) - mean[i]) / scale[i]).alias(c) for i, c in enumerate("ab")])
    return knn_join(at.where("label > 0"), at.where("label = 0"), 5, "vec_id", "vec_id", ["a", "b"]).select("vec_id", "ref_id", "rank")


PEAKS = "pk AS (SELECT label, min(pos) AS peak FROM mn JOIN (SELECT label, max(v) AS v FROM mn GROUP BY label) USING (label, v) GROUP BY label)"


@query(
    "universal_negative",
    f"""{BASE}, {PEAKS}, {KNN}, th AS (SELECT pos, quantile_cont(v, 0.95) AS q FROM lg WHERE label = 0 GROUP BY pos),
    po AS (SELECT lg.label, lg.vec_id, row_number() OVER (PARTITION BY lg.label ORDER BY v DESC, vec_id) AS rn FROM lg JOIN pk ON lg.label = pk.label AND lg.pos = pk.peak JOIN th ON th.pos = pk.peak WHERE lg.label > 0 AND v > q),
    tp AS (SELECT * FROM po WHERE rn <= 20)
    SELECT label, vec_id, 'positive' AS role FROM tp UNION ALL SELECT DISTINCT label, ref_id AS vec_id, 'negative' AS role FROM tp JOIN kn USING (vec_id) WHERE rank <= 2""",
)
def universal_negative(spark, sf):
    """Brightest positives of every dye at its peak detector, and the unstained events nearest to them in scatter."""
    ev = events(spark, sf)
    peaks = class_spectra(ev.where("label > 0")).select("label", A.peak(F.col("spectrum")).alias("peak"))
    limits = ev.where("label = 0").select(F.posexplode("x").alias("peak", "v")).groupBy("peak").agg(quantile(F.col("v"), 0.95).alias("limit"))
    at = ev.join(F.broadcast(peaks.join(limits, "peak")), "label").withColumn("at_peak", F.get("x", F.col("peak"))).where("at_peak > limit")
    pos = clean.top(at, "at_peak", 20, ["label"], "vec_id").select("label", "vec_id", "x")
    near = knn_join(_scatter(pos), _scatter(ev.where("label = 0")), 2, "vec_id", "vec_id", ["a", "b"])
    neg = pos.select("label", "vec_id").join(near, "vec_id").select("label", F.col("ref_id").alias("vec_id")).distinct()
    return pos.select("label", "vec_id", F.lit("positive").alias("role")).unionByName(neg.withColumn("role", F.lit("negative")))


@query(
    "downsample_pos_neg",
    """WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS u, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS d FROM events)
    SELECT event_type, event_id, CASE WHEN u <= 50 THEN 'positive' ELSE 'negative' END AS role FROM r WHERE u <= 50 OR d <= 100""",
)
def downsample_pos_neg(spark, sf):
    e = table(spark, sf, "events").select("event_type", "event_id", "value")
    return clean.top_and_bottom(e, "value", 50, 100, ["event_type"]).select("event_type", "event_id", "role")


@query("top_events", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 2000")
def top_events(spark, sf):
    """The brightest 2,000 events of a channel."""
    li = lineitem(spark, sf, "l_orderkey", "l_linenumber", "l_extendedprice")
    return li.orderBy(F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber").limit(2000)


@query(
    "internal_fractions",
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS d, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS u, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, round(avg(value) FILTER (d <= n * 0.1), 6) + 0.0 AS background, round(avg(value) FILTER (u <= 100), 6) + 0.0 AS signal FROM r GROUP BY event_type""",
)
def internal_fractions(spark, sf):
    """Background from the dimmest tenth, signal from the brightest hundred, when a control has no negative of its own."""
    e = table(spark, sf, "events").select("event_type", "event_id", "value")
    w = Window.partitionBy("event_type")
    e = e.withColumns({"d": F.row_number().over(w.orderBy("value", "event_id")), "u": F.row_number().over(w.orderBy(F.col("value").desc(), "event_id")), "n": F.count(F.lit(1)).over(w)})
    return e.groupBy("event_type").agg(r6(F.avg(F.when(F.col("d") <= F.col("n") * 0.1, F.col("value")))).alias("background"), r6(F.avg(F.when(F.col("u") <= 100, F.col("value")))).alias("signal"))


@query(
    "peak_by_projection",
    f"""{BASE}, a AS (SELECT s AS b FROM sp WHERE label = 0), p AS (SELECT label, list_transform(list_zip(s, b), lambda z: z[1] - z[2] * list_dot_product(s, b) / list_dot_product(b, b)) AS o FROM sp, a WHERE label > 0)
    SELECT label, (list_position(o, list_max(o)) - 1)::INT AS peak FROM p""",
)
def peak_by_projection(spark, sf):
    """Peak detector of each dye's mean once the background direction is projected out."""
    s = class_spectra(events(spark, sf))
    af = np.array(s.where("label = 0").first()["spectrum"])
    unit = af / np.linalg.norm(af)
    along = A.dot(F.col("spectrum"), A.lit_array(unit))
    o = F.zip_with("spectrum", A.lit_array(unit), lambda x, u: x - along * u)
    return s.where("label > 0").select("label", A.peak(o).alias("peak"))


@query("least_alike", f"{BASE} SELECT label, vec_id FROM (SELECT ev.label, vec_id, row_number() OVER (PARTITION BY ev.label ORDER BY list_dot_product(x, a.s) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(a.s, a.s)) + 1e-9), vec_id) AS r FROM ev JOIN sp a ON a.label = 0 WHERE ev.label > 0) WHERE r <= 10")
def least_alike(spark, sf):
    """Of every dye the ten events least like the mean background."""
    ev = events(spark, sf)
    af = class_spectra(ev).where("label = 0").first()["spectrum"]
    scored = ev.where("label > 0").withColumn("s", -A.cosine_rows(F.col("x"), A.lit_array(af)))
    return clean.top(scored, "s", 10, ["label"], "vec_id").select("label", "vec_id")


# --- gates ------------------------------------------------------------------------------------------------

POLYGON = [(10.0, 10000.0), (40.0, 10000.0), (45.0, 40000.0), (25.0, 70000.0), (10.0, 50000.0)]


def _polygon_sql(x: str, y: str, polygon) -> str:
    """The inclusive rule: on an edge, or an odd number of crossings to the right."""
    edges, crossings = [], []
    for (x1, y1), (x2, y2) in zip(polygon, polygon[1:] + polygon[:1], strict=True):
        edges.append(f"(({x} - {x1}) * ({y2 - y1}) - ({y} - {y1}) * ({x2 - x1}) = 0 AND {x} BETWEEN {min(x1, x2)} AND {max(x1, x2)} AND {y} BETWEEN {min(y1, y2)} AND {max(y1, y2)})")
        if y1 != y2:
            crossings.append(f"(CASE WHEN ({y1} > {y}) <> ({y2} > {y}) AND {x} < ({y} - {y1}) * ({x2 - x1}) / ({y2 - y1}) + {x1} THEN 1 ELSE 0 END)")
    return f"({' OR '.join(edges)} OR ({' + '.join(crossings)}) % 2 = 1)"


# fixed-point literals would make SQL compute in decimals: cast the columns' arithmetic to double
@query("polygon_gate", f"SELECT l_orderkey, l_linenumber FROM (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS x, l_extendedprice::DOUBLE AS y FROM lineitem) WHERE {_polygon_sql('x', 'y', POLYGON)}")
def polygon_gate(spark, sf):
    li = lineitem(spark, sf, "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return gate.inside(li, "l_quantity", "l_extendedprice", POLYGON).select("l_orderkey", "l_linenumber")


@query("polygon_outside", f"SELECT l_orderkey, l_linenumber FROM (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS x, l_extendedprice::DOUBLE AS y FROM lineitem) WHERE NOT {_polygon_sql('x', 'y', POLYGON)}")
def polygon_outside(spark, sf):
    """Removal of what lies in a gate."""
    li = lineitem(spark, sf, "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return li.where(~gate.in_polygon(F.col("l_quantity"), F.col("l_extendedprice"), POLYGON)).select("l_orderkey", "l_linenumber")


@query("rect_gate", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 10 AND l_quantity < 20 AND l_extendedprice > 10000 AND l_extendedprice < 30000")
def rect_gate(spark, sf):
    li = lineitem(spark, sf, "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return li.where(gate.in_rectangle(F.col("l_quantity"), F.col("l_extendedprice"), 10, 20, 10000, 30000)).select("l_orderkey", "l_linenumber")


GRID = 12
KDE = f"""g AS (SELECT i, j, 1 + i * 49.0::DOUBLE / {GRID - 1} AS x, 1 + j * 49.0::DOUBLE / {GRID - 1} AS y FROM (SELECT unnest(range({GRID})) AS i), (SELECT unnest(range({GRID})) AS j)),
c AS (SELECT l_quantity AS a, l_discount * 100 + 1 AS b, count(*) AS n FROM (SELECT l_quantity::DOUBLE AS l_quantity, round(l_discount::DOUBLE, 2) AS l_discount FROM lineitem) GROUP BY ALL),
k AS (SELECT i::INT AS i, j::INT AS j, sum(n * exp(-0.5::DOUBLE * ((x - a) / 4) ** 2) * exp(-0.5::DOUBLE * ((y - b) / 3) ** 2)) / (sum(n) * 2 * pi() * 12) AS z FROM g, c GROUP BY i, j)"""


def _kde(spark, sf):
    """Quantity against discount, both whole numbers, so that the fine cells of the estimate are exact."""
    li = lineitem(spark, sf, "l_quantity", (F.round(F.col("l_discount") * 100) + 1).alias("d"))
    return gate.kde(li, "l_quantity", "d", (1.0, 1.0), (50.0, 50.0), GRID, (4.0, 3.0), bins=(50, 50), edges=(0.5, 50.5))


@query("kde_grid", f"WITH {KDE} SELECT i, j, round(z, 9) + 0.0 AS density FROM k")
def kde_grid(spark, sf):
    return _kde(spark, sf).select("i", "j", r6(F.col("density"), 9).alias("density"))


@query("kde_local_maxima", f"WITH {KDE}, r AS (SELECT i, j, round(z, 9) AS z FROM k) SELECT a.i, a.j FROM r a JOIN r b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 WHERE a.z > 0 GROUP BY a.i, a.j, a.z HAVING a.z >= max(b.z)")
def kde_local_maxima(spark, sf):
    z = np.zeros((GRID, GRID))
    for r in _kde(spark, sf).collect():
        z[r["i"], r["j"]] = round(r["density"], 9)
    return spark.createDataFrame([(i, j) for i, j in gate.local_maxima(z)], "i int, j int")


PEAK_POINTS = [(10.0, 20000.0), (30.0, 40000.0), (45.0, 80000.0)]


@query(
    "voronoi_assign",
    """SELECT l_orderkey, l_linenumber, l_extendedprice, list_sort([{'d': (l_quantity - 10) ** 2 + (l_extendedprice - 20000) ** 2, 'i': 0},
    {'d': (l_quantity - 30) ** 2 + (l_extendedprice - 40000) ** 2, 'i': 1}, {'d': (l_quantity - 45) ** 2 + (l_extendedprice - 80000) ** 2, 'i': 2}])[1].i AS peak FROM lineitem""",
)
def voronoi_assign(spark, sf):
    li = lineitem(spark, sf, "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return gate.voronoi(li, "l_quantity", "l_extendedprice", PEAK_POINTS).select("l_orderkey", "l_linenumber", "l_extendedprice", "peak")


@query(
    "hdr_threshold",
    """WITH c AS (SELECT (l_quantity * 100 + round(l_discount * 100))::BIGINT AS cell, count(*) AS n FROM lineitem GROUP BY 1),
    s AS (SELECT cell, n, sum(n) OVER (ORDER BY n DESC, cell) / sum(n) OVER () AS share FROM c)
    SELECT cell, n, round(share, 6) + 0.0 AS share FROM s ORDER BY abs(share - 0.7), cell LIMIT 1""",
)
def hdr_threshold(spark, sf):
    """The count at which the densest cells together hold 70 % of the events."""
    c = lineitem(spark, sf, "l_quantity", "l_discount").groupBy((F.col("l_quantity") * 100 + F.round(F.col("l_discount") * 100)).cast("long").alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(F.col("n").desc(), "cell").rowsBetween(Window.unboundedPreceding, 0)  # cells of a grid, not events
    c = c.withColumn("share", F.sum("n").over(w) / F.sum("n").over(Window.partitionBy()))
    return c.orderBy(F.abs(F.col("share") - 0.7), "cell").limit(1).select("cell", "n", r6(F.col("share")).alias("share"))


@query(
    "median_mad_box",
    "SELECT l_returnflag, round(median(l_extendedprice) - 2 * 1.4826 * mad(l_extendedprice), 6) + 0.0 AS lo, round(median(l_extendedprice) + 2 * 1.4826 * mad(l_extendedprice), 6) + 0.0 AS hi FROM lineitem GROUP BY l_returnflag",
)
def median_mad_box(spark, sf):
    m = with_mad(lineitem(spark, sf, "l_returnflag", "l_extendedprice"), ["l_returnflag"], "l_extendedprice")
    return m.select("l_returnflag", r6(F.col("median") - 2 * F.col("mad")).alias("lo"), r6(F.col("median") + 2 * F.col("mad")).alias("hi"))


def _polygon_rows(spark, points):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "ord int, x double, y double")


@query("mass_threshold", f"WITH {KDE}, cu AS (SELECT z, sum(z) OVER (ORDER BY z DESC, i, j ROWS UNBOUNDED PRECEDING) / sum(z) OVER () AS share FROM k) SELECT round(z, 9) + 0.0 AS threshold FROM cu ORDER BY abs(share - 0.7), z DESC LIMIT 1")
def mass_threshold(spark, sf):
    """The density above which 70 % of the mass lies."""
    z = [r["density"] for r in _kde(spark, sf).collect()]
    return spark.createDataFrame([(round(gate.mass_threshold(np.array(z), 0.7), 9),)], "threshold double")


@query(
    "gate_bandwidth",
    """SELECT l_returnflag, round(1.06 * least(stddev_samp(q), (quantile_cont(q, 0.75) - quantile_cont(q, 0.25)) / 1.34) * count(*) ** -0.2, 6) + 0.0 AS h_x,
    round(1.06 * least(stddev_samp(p), (quantile_cont(p, 0.75) - quantile_cont(p, 0.25)) / 1.34) * count(*) ** -0.2, 6) + 0.0 AS h_y
    FROM (SELECT l_returnflag, l_quantity::DOUBLE AS q, l_extendedprice::DOUBLE AS p FROM lineitem) GROUP BY l_returnflag""",
)
def gate_bandwidth(spark, sf):
    """Reference bandwidths of each flag's events on both axes."""
    li = lineitem(spark, sf, "l_returnflag", "l_quantity", "l_extendedprice")
    rows = []
    for flag in sorted(r[0] for r in li.select("l_returnflag").distinct().collect()):  # three flags
        rows.append((flag, *(round(h, 6) for h in gate.normal_reference(gate.spreads(li.where(F.col("l_returnflag") == flag), "l_quantity", "l_extendedprice")))))
    return spark.createDataFrame(rows, "l_returnflag string, h_x double, h_y double")


@query("density_hull")
def density_hull(spark, sf):
    """Hull of the longest contour line around 70 % of the mass."""
    z = np.zeros((GRID, GRID))
    for r in _kde(spark, sf).collect():
        z[r["i"], r["j"]] = r["density"]
    g = np.linspace(1, 50, GRID)
    return _polygon_rows(spark, gate.density_hull(z, g, g))


@query("find_gate")
def find_gate(spark, sf):
    """Peaks, region, box, hull: a whole gate found, then how many events it holds."""
    li = lineitem(spark, sf, "l_quantity", "l_extendedprice")
    g = gate.find_gate(li, "l_quantity", "l_extendedprice", (0.0, 0.0), (51.0, 110000.0), 40)
    n = gate.inside(li, "l_quantity", "l_extendedprice", g).agg(F.count(F.lit(1)).alias("inside"))
    return _polygon_rows(spark, g).crossJoin(n)  # one row


@query("tune_gate")
def tune_gate(spark, sf):
    """Events inside the density hull for a grid of event numbers and mass shares."""
    li = lineitem(spark, sf, "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    tuned = gate.tune_gate(li, "l_extendedprice", "l_quantity", "l_extendedprice", (0.0, 0.0), (51.0, 110000.0), (500, 2000), (0.5, 0.7, 0.9), 20, (3.0, 5000.0), ["l_orderkey", "l_linenumber"])
    within = lambda g: gate.in_polygon(F.col("l_quantity"), F.col("l_extendedprice"), g) if len(g) > 2 else F.lit(False)
    counts = li.agg(*[F.count_if(within(g)).alias(f"c{i}") for i, (_, _, g) in enumerate(tuned)]).first()
    return spark.createDataFrame([(n, share, counts[i]) for i, (n, share, _) in enumerate(tuned)], "n_events int, share double, inside long")


# --- statistics -------------------------------------------------------------------------------------------


@query("quantile_thresholds", f"{BASE} SELECT pos::INT AS pos, round(quantile_cont(v, 0.995), 6) + 0.0 AS threshold FROM lg WHERE label = 0 GROUP BY pos")
def quantile_thresholds(spark, sf):
    long = events(spark, sf).where("label = 0").select(F.posexplode("x").alias("pos", "v"))
    return long.groupBy("pos").agg(r6(quantile(F.col("v"), 0.995)).alias("threshold"))


@query("mad", "SELECT event_type, round(median(value), 6) + 0.0 AS median, round(1.4826 * mad(value), 6) + 0.0 AS mad FROM events GROUP BY event_type")
def mad(spark, sf):
    m = with_mad(table(spark, sf, "events").select("event_type", "value"), ["event_type"], "value")
    return m.select("event_type", r6(F.col("median")).alias("median"), r6(F.col("mad")).alias("mad"))


@query("covariance", f"{BASE} SELECT a.pos::INT AS p, b.pos::INT AS q, round(covar_samp(a.v, b.v), 9) + 0.0 AS cov, round(stddev_samp(a.v), 6) + 0.0 AS sd FROM lg a JOIN lg b USING (vec_id) WHERE a.pos < 6 AND b.pos < 6 AND a.pos <= b.pos GROUP BY a.pos, b.pos")
def covariance(spark, sf):
    """Sample covariances of six detectors: one aggregate each, in one pass."""
    ev = events(spark, sf)
    pairs = [(p, q) for p in range(6) for q in range(p, 6)]
    at = lambda i: F.get("x", F.lit(i))
    one = ev.agg(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q"), F.covar_samp(at(p), at(q)).alias("cov"), F.stddev_samp(at(p)).alias("sd")) for p, q in pairs]).alias("m"))
    return one.select(F.explode("m").alias("m")).select("m.p", "m.q", r6(F.col("m.cov"), 9).alias("cov"), r6(F.col("m.sd")).alias("sd"))


@query("method_summary", "SELECT event_type, round(avg(value), 6) + 0.0 AS mean, round(stddev_samp(value), 6) + 0.0 AS sd, round(100 * avg((value > 50)::INT), 6) + 0.0 AS pct_above, count(*) AS n FROM events GROUP BY event_type")
def method_summary(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy("event_type").agg(r6(F.avg("value")).alias("mean"), r6(F.stddev_samp("value")).alias("sd"), r6(100 * F.avg((F.col("value") > 50).cast("double"))).alias("pct_above"), F.count(F.lit(1)).alias("n"))


@query("consistency", "SELECT l_returnflag, count(DISTINCT l_linestatus) AS n_values, count(DISTINCT l_linestatus) = 1 AS consistent FROM lineitem GROUP BY l_returnflag")
def consistency(spark, sf):
    """A column must have one value in each group."""
    li = lineitem(spark, sf, "l_returnflag", "l_linestatus")
    return li.groupBy("l_returnflag").agg(F.countDistinct("l_linestatus").alias("n_values")).withColumn("consistent", F.col("n_values") == 1)


@query(
    "quantile_bin_median",
    """WITH q AS (SELECT quantile_cont(l_extendedprice, [0.2, 0.4, 0.6, 0.8]) AS b FROM lineitem)
    SELECT (len(list_filter(b, lambda z: z < l_extendedprice)) + 1)::INT AS bin, round(median(l_quantity), 6) + 0.0 AS quantity, round(median(l_tax), 6) + 0.0 AS tax, count(*) AS n FROM lineitem, q GROUP BY 1""",
)
def quantile_bin_median(spark, sf):
    li = lineitem(spark, sf, "l_extendedprice", "l_quantity", "l_tax")
    breaks = column_quantiles(li, [], ["l_extendedprice"], [0.2, 0.4, 0.6, 0.8]).first()[0] or []
    b = sum((F.coalesce((F.col("l_extendedprice") > v).cast("int"), F.lit(0)) for v in breaks), F.lit(1))
    binned = li.select(b.alias("bin"), "l_quantity", "l_tax")
    medians = column_quantiles(binned, ["bin"], ["l_quantity", "l_tax"], [0.5])
    counts = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    return medians.join(F.broadcast(counts), "bin").select("bin", r6(F.get("q0", F.lit(0))).alias("quantity"), r6(F.get("q1", F.lit(0))).alias("tax"), "n")


@query(
    "ssi",
    f"""{BASE}, {PEAKS}, th AS (SELECT pos, quantile_cont(v, 0.95) AS q, median(v) AS mn0, 1.4826 * mad(v) AS md0 FROM lg WHERE label = 0 GROUP BY pos),
    po AS (SELECT lg.label, lg.vec_id, pk.peak FROM lg JOIN pk ON lg.label = pk.label AND lg.pos = pk.peak JOIN th ON th.pos = pk.peak WHERE lg.label > 0 AND v > q QUALIFY row_number() OVER (PARTITION BY lg.label ORDER BY v DESC, vec_id) <= 500),
    d AS (SELECT lg.label, lg.pos, any_value(peak) AS peak, median(v) - any_value(mn0) AS dm, any_value(md0) AS md0 FROM lg JOIN po USING (label, vec_id) JOIN th USING (pos) GROUP BY lg.label, lg.pos),
    f AS (SELECT label, dm AS df FROM d WHERE pos = peak)
    SELECT label, pos::INT AS pos, round(dm / df, 6) + 0.0 AS spill, CASE WHEN pos = peak THEN 0.0 ELSE round(dm / (2 * md0), 6) + 0.0 END AS ssi FROM d JOIN f USING (label)""",
)
def ssi(spark, sf):
    """Secondary spill of every dye into every detector: shift of the median against the negatives' spread."""
    from lumenfold.operators.evaluate import secondary_spill

    return secondary_spill(events(spark, sf), 0.95).select("label", "pos", r6(F.col("spill")).alias("spill"), r6(F.col("ssi")).alias("ssi"))


# --- plot data --------------------------------------------------------------------------------------------


@query("ribbon_hist", f"{BASE} SELECT pos::INT AS pos, greatest(1, least(20, floor((v + 0.5) / (1.0::DOUBLE / 20))::INT + 1))::INT AS bin, round(ln(1 + count(*)), 6) + 0.0 AS intensity FROM lg GROUP BY ALL")
def ribbon_hist(spark, sf):
    long = events(spark, sf).select(F.posexplode("x").alias("pos", "v"))
    h = histogram(long, ["pos"], F.col("v"), -0.5, 0.5, 20)
    return h.select("pos", "bin", r6(F.log1p("n")).alias("intensity"))


@query("spectral_trace", f"{BASE}, {PEAKS} SELECT mn.label, pos::INT AS pos, round(v, 6) + 0.0 AS v, ['UV', 'V', 'B', 'R'][peak // 16 + 1] AS laser FROM mn JOIN pk USING (label)")
def spectral_trace(spark, sf):
    """Long spectra, each with the laser of its peak detector."""
    s = class_spectra(events(spark, sf))
    laser = F.get(F.array(*[F.lit(x) for x in ("UV", "V", "B", "R")]), F.floor(A.peak(F.col("spectrum")) / 16).cast("int"))
    return s.select("label", laser.alias("laser"), F.posexplode("spectrum").alias("pos", "v")).select("label", "pos", r6(F.col("v")).alias("v"), "laser")


@query("melt_spectra", f"{BASE} SELECT label, pos::INT AS pos, round(v, 6) + 0.0 AS v FROM mn WHERE label IN (1, 2)")
def melt_spectra(spark, sf):
    s = class_spectra(events(spark, sf).where("label IN (1, 2)"))
    return s.select("label", F.posexplode("spectrum").alias("pos", "v")).select("label", "pos", r6(F.col("v")).alias("v"))


@query("triangle_heatmap", f"{BASE} SELECT a.label AS row, b.label AS col, round(list_dot_product(a.s, b.s), 6) + 0.0 AS value FROM sp a JOIN sp b ON a.label >= b.label")
def triangle_heatmap(spark, sf):
    s = class_spectra(events(spark, sf))
    a, b = s.select(F.col("label").alias("row"), F.col("spectrum").alias("sa")), s.select(F.col("label").alias("col"), F.col("spectrum").alias("sb"))
    return a.join(b, F.col("row") >= F.col("col")).select("row", "col", r6(A.dot(F.col("sa"), F.col("sb"))).alias("value"))


@query("variant_envelope", f"{BASE} SELECT label, pos::INT AS pos, round(min(v), 6) + 0.0 AS low, round(max(v), 6) + 0.0 AS high FROM lg GROUP BY label, pos")
def variant_envelope(spark, sf):
    low, high = (class_spectra(events(spark, sf), how=f) for f in (F.min, F.max))
    both = low.join(high.withColumnRenamed("spectrum", "h"), "label").select("label", F.posexplode(F.arrays_zip("spectrum", "h")).alias("pos", "z"))
    return both.select("label", "pos", r6(F.col("z.spectrum")).alias("low"), r6(F.col("z.h")).alias("high"))


@query("spectrum_difference", f"{BASE} SELECT a.pos::INT AS pos, round(a.v - b.v, 6) + 0.0 AS difference FROM mn a JOIN mn b USING (pos) WHERE a.label = 1 AND b.label = 2")
def spectrum_difference(spark, sf):
    s = {r["label"]: r["spectrum"] for r in class_spectra(events(spark, sf).where("label IN (1, 2)")).collect()}
    return spark.range(len(s[1])).select(F.col("id").cast("int").alias("pos"), r6(F.get(A.lit_array(np.array(s[1]) - np.array(s[2])), F.col("id").cast("int"))).alias("difference"))


@query(
    "reference_status",
    f"""{BASE}, md AS (SELECT label, list(m ORDER BY pos) AS m FROM (SELECT label, pos, median(v) AS m FROM lg GROUP BY ALL) GROUP BY label),
    c AS (SELECT label, list_dot_product(s, m) / (sqrt(list_dot_product(s, s)) * sqrt(list_dot_product(m, m)) + 1e-9) AS c FROM sp LEFT JOIN (FROM md WHERE label < 8) USING (label))
    SELECT label, round(c, 6) + 0.0 AS similarity, CASE WHEN c IS NULL THEN 'No Reference Available' WHEN c < 0.98 THEN 'FAIL' WHEN c < 0.99 THEN 'WARNING' ELSE 'PASS' END AS status FROM c""",
)
def reference_status(spark, sf):
    """Similarity of each spectrum with its library spectrum (here the class median), graded; dyes without one say so."""
    ev = events(spark, sf)
    library = class_medians(ev.where("label < 8")).withColumnRenamed("spectrum", "ref")
    s = class_spectra(ev).join(F.broadcast(library), "label", "left").withColumn("c", A.cosine_rows(F.col("spectrum"), F.col("ref")))
    status = F.when(F.col("c").isNull(), "No Reference Available").when(F.col("c") < 0.98, "FAIL").when(F.col("c") < 0.99, "WARNING").otherwise("PASS")
    return s.select("label", r6(F.col("c")).alias("similarity"), status.alias("status"))


@query("gate_raster", "SELECT greatest(1, least(64, floor(l_quantity / (51.0::DOUBLE / 64))::INT + 1))::INT AS i, greatest(1, least(64, floor(l_extendedprice / (110000.0::DOUBLE / 64))::INT + 1))::INT AS j, count(*) AS n FROM lineitem GROUP BY ALL")
def gate_raster(spark, sf):
    b = lambda c, hi: F.greatest(F.lit(1), F.least(F.lit(64), F.floor(F.col(c) / (hi / 64)).cast("int") + 1))
    li = lineitem(spark, sf, "l_quantity", "l_extendedprice")
    return li.groupBy(b("l_quantity", 51.0).alias("i"), b("l_extendedprice", 110000.0).alias("j")).agg(F.count(F.lit(1)).alias("n"))


@query("diagonal_hist", "SELECT event_type, greatest(1, least(60, floor(value / (500.0::DOUBLE / 60))::INT + 1))::INT AS bin, count(*) AS n FROM events GROUP BY ALL")
def diagonal_hist(spark, sf):
    return histogram(table(spark, sf, "events").select("event_type", "value"), ["event_type"], F.col("value"), 0.0, 500.0, 60)


@query("axis_setup", "SELECT event_type, round(least(2 * quantile_cont(value - 20, 0.01), -10), 6) + 0.0 AS axis_min, round(max(value), 6) + 0.0 AS axis_max FROM events GROUP BY event_type")
def axis_setup(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy("event_type").agg(r6(F.least(2 * quantile(F.col("value") - 20, 0.01), F.lit(-10.0))).alias("axis_min"), r6(F.max("value")).alias("axis_max"))


@query("biplot")
def biplot(spark, sf):
    """Two unmixed dyes on the biexponential scale, 300 events sampled by a hash of their id."""
    from lumenfold.functions.biexponential import Biexponential
    from lumenfold.operators import unmix
    from lumenfold.operators.events import all_classes

    ev = events(spark, sf)
    out = unmix.unmix_ols(ev, all_classes(ev), "x", [f"u{i}" for i in range(10)])
    part = clean.sample_rows(out.select("vec_id", F.array((F.col("u1") * 1000), (F.col("u2") * 1000)).alias("u")), 300, "vec_id")
    scale = Biexponential()
    return unmix.apply_kernel(part, "u", 2, lambda X: list(np.round(scale(X), 3).T), [("x", "double"), ("y", "double")])
