"""Queries on files (written from the tables, then read), on small operators, and on the data of panels."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import functions as F

from lumenfold.functions import arrays as A
from lumenfold.functions.stats import pct_above
from lumenfold.operators import clean, control, plots, unmix
from lumenfold.operators.events import all_classes, dyes_and_background, events, table
from lumenfold.operators.unmix import Panel
from lumenfold.plans.registry import query
from lumenfold.plans.sql import AF, BASE, DYES, DYES9, EV, pinv
from lumenfold.sources import fcs, spectra_files

r6 = A.rounded


def folder(spark) -> str:
    """A new folder that driver and executors see: in the shared checkpoint folder if that is a path, else a temporary one
    (only for local sessions)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or ""
    if not base.startswith(("file:", "/")):
        if base or not spark.conf.get("spark.master", "local").startswith("local["):
            raise ValueError("event files need a file system that driver and executors share, named in spark.checkpoint.dir")
        base = tempfile.gettempdir()
    path = f"{base.removeprefix('file://')}/{uuid.uuid4().hex}"
    os.makedirs(path)
    return path


def _file(spark, ev, path: str) -> str:
    """Events as an event file of label and four detectors."""
    fcs.register(spark)
    wide = ev.select(F.col("label").cast("double").alias("label"), *[F.get("x", F.lit(i)).alias(f"D{i}") for i in range(4)])
    return fcs.save(wide, path)


@query("fcs_round_trip", f"{BASE} SELECT label, count(*) AS n, round(avg(x[1]), 5) + 0.0 AS d0 FROM ev GROUP BY label")
def fcs_round_trip(spark, sf):
    """Events written as an event file by all tasks and read back through the source."""
    path = _file(spark, events(spark, sf), f"{folder(spark)}/events.fcs")
    back = spark.read.format("fcs").option("rows", 200).load(path)
    return back.groupBy(F.col("label").cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("D0"), 5).alias("d0"))


@query("fcs_header", "SELECT '$PAR' AS keyword, '5' AS value UNION ALL SELECT '$TOT', count(*)::VARCHAR FROM embeddings UNION ALL SELECT '$P1N', 'label' UNION ALL SELECT '$P5N', 'D3' UNION ALL SELECT '$DATATYPE', 'F'")
def fcs_header(spark, sf):
    """Chosen keywords of an event file, from its header alone."""
    path = _file(spark, events(spark, sf), f"{folder(spark)}/events.fcs")
    keys = spark.read.format("fcs_header").option("keyword", "$TOT,$PAR,$P1N,$P5N,$DATATYPE").load(path)
    return keys.select(F.explode("keywords").alias("keyword", "value"))


@query("fcs_concatenated", f"{BASE} SELECT label, 2 * count(*) AS n, round(avg(x[2]), 5) + 0.0 AS d1 FROM ev WHERE label < 5 GROUP BY label UNION ALL SELECT label, count(*), round(avg(x[2]), 5) + 0.0 FROM ev WHERE label >= 5 GROUP BY label")
def fcs_concatenated(spark, sf):
    """Three event files of one layout (the first classes twice) as one."""
    at, ev = folder(spark), events(spark, sf)
    low, high = _file(spark, ev.where("label < 5"), f"{at}/low.fcs"), _file(spark, ev.where("label >= 5"), f"{at}/high.fcs")
    back = spark.read.format("fcs").load(fcs.concatenate([low, high, low], f"{at}/all.fcs", rows=100, spark=spark))
    return back.groupBy(F.col("label").cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("D1"), 5).alias("d1"))


@query("csv_spectra", f"{BASE} SELECT label, pos::INT AS pos, round(v / max(v) OVER (PARTITION BY label), 6) + 0.0 AS v FROM mn WHERE label <> 0")
def csv_spectra(spark, sf):
    """Spectra saved as CSV and read again: rows divided by their maximum, the background's row left out."""
    path = spectra_files.write_panel(all_classes(events(spark, sf)), f"{folder(spark)}/spectra.csv")
    s = spectra_files.read_spectra(spark, path, ("0",))
    return s.select(F.col("name").cast("int").alias("label"), F.posexplode("spectrum").alias("pos", "v")).select("label", "pos", r6(F.col("v")).alias("v"))


@query("embedded_spectra", f"{BASE} SELECT 'dye' || label AS name, pos::INT AS pos, round(v, 6) + 0.0 AS v FROM mn WHERE label < 3 AND pos < 10")
def embedded_spectra(spark, sf):
    """Spectra that an instrument stored in a file's keywords: the rows of the unmixed dyes come first in the matrix."""
    S = all_classes(events(spark, sf)).S[:, :10]
    spill = ",".join(["10", *[f"D{i}" for i in range(10)], *[repr(float(v)) for v in S.ravel()]])
    path = fcs.write(f"{folder(spark)}/unmixed.fcs", ["a"], S[:1, :1], {"$SPILL": spill, "BDSPECTRAL UNMIXED": "dye0,dye1,dye2"})
    p = spectra_files.read_embedded(path)
    return spark.createDataFrame([(n, i, round(float(v), 6) + 0.0) for n, s in zip(p.names, p.S, strict=True) for i, v in enumerate(s)], "name string, pos int, v double")


@query("experiment_spectra", f"{BASE} SELECT CASE WHEN label = 0 THEN 'AF' ELSE 'Dye' || label END AS name, pos::INT AS pos, round(v / max(v) OVER (PARTITION BY label), 6) + 0.0 AS v FROM mn")
def experiment_spectra(spark, sf):
    """Spectra in an experiment's XML, named by the addresses of their controls."""
    p = all_classes(events(spark, sf))
    part = "<Control><_Url>C:\\runs\\B{n} {name} (Cells)_Controls.fcs</_Url><_SpilloverVectorArea>{values}</_SpilloverVectorArea></Control>"
    rows = [part.format(n=n + 1, name="Unstained" if n == 0 else f"Dye{n}_CD{n}", values="".join(f"<float>{float(v)!r}</float>" for v in s)) for n, s in zip(p.names, p.S, strict=True)]
    path = f"{folder(spark)}/run.Expt"
    with open(path, "w") as f:
        f.write("<Experiment xmlns='urn:x'>" + "".join(rows) + "</Experiment>")
    q = spectra_files.read_experiment(path)
    return spark.createDataFrame([(n, i, round(float(v), 6) + 0.0) for n, s in zip(q.names, q.S, strict=True) for i, v in enumerate(s)], "name string, pos int, v double")


@query("channel_names", "SELECT DISTINCT source AS channel, translate(source, ',/\\:*?\"<>|', '_________') AS safe FROM (SELECT 'a:' || p_type || '/' || p_brand AS source FROM part)")
def channel_names(spark, sf):
    """Channel names with the characters that file names forbid replaced."""
    names = [r[0] for r in table(spark, sf, "part").select(F.concat(F.lit("a:"), "p_type", F.lit("/"), "p_brand")).distinct().collect()]  # kinds of parts: a few hundred
    return spark.createDataFrame(spectra_files.read_channels(names), "channel string, safe string")


@query("spectral_channels", "SELECT DISTINCT p_brand AS channel FROM part WHERE NOT regexp_matches(p_brand, '[35]$') AND regexp_matches(p_brand, '^Brand#[1-4]')")
def spectral_channels(spark, sf):
    """Detectors by name: no exclusion pattern matches, the inclusion pattern does."""
    names = [r[0] for r in table(spark, sf, "part").select("p_brand").distinct().collect()]
    return spark.createDataFrame([(c,) for c in control.spectral_channels(names, "[35]$", "^Brand#[1-4]")], "channel string")


@query(
    "defined_keywords",
    f"""{BASE}, dy AS (SELECT label, row_number() OVER (ORDER BY label) AS i FROM sp WHERE label > 0), n AS (SELECT count(*) AS n FROM dy),
    wt AS (SELECT string_agg(w::VARCHAR, ',' ORDER BY pos) AS w FROM (SELECT pos, round(v * 1000)::BIGINT AS w FROM mn WHERE label = 0))
    SELECT '$P' || (i + 1) || 'N' AS keyword, 'dye' || label || '-A' AS value FROM dy UNION ALL SELECT '$P' || (i + 1) || 'R', '4194304.0' FROM dy
    UNION ALL SELECT 'FLUOROCHROMES', string_agg('dye' || label, ',' ORDER BY label) FROM dy UNION ALL SELECT '$P' || (n + 2) || 'S', 'Autofluorescence' FROM n UNION ALL SELECT '$P' || (n + 3) || 'N', 'AF Index' FROM n
    UNION ALL SELECT 'WEIGHTS', '64,' || (SELECT string_agg('D' || i, ',' ORDER BY i) FROM (SELECT unnest(range(64)) AS i)) || ',' || w FROM wt
    UNION ALL SELECT * FROM (VALUES ('$P1N', 'Time'), ('$P1B', '32'), ('$P1E', '0,0'), ('$P1R', '100'), ('$P2S', 'CD4'), ('$CYT', 'Aurora'), ('UNMIXINGMETHOD', 'PerCellAF'), ('$FIL', 'out.fcs'), ('$LAST_MODIFIED', '07-MAR-2026 05:06:07.89'), ('$ORIGINALITY', 'DataModified'))""",
)
def defined_keywords(spark, sf):
    """Keywords of a file unmixed with the classes' spectra: each column by its class, the method, dyes, weights, time; what
    described old columns is gone."""
    from datetime import datetime

    import numpy as np

    old = {"$P1N": "Time", "$P1R": "100", "$P1B": "32", "$P2N": "V1-A", "$P2V": "400", "$CYT": "Aurora", "$BEGINDATA": "1"}
    every = all_classes(events(spark, sf))
    dyes = Panel([f"dye{n}" for n in every.names[1:]], every.S[1:], [f"D{i}" for i in range(every.S.shape[1])])
    columns = ["Time", *[f"{n}-A" for n in dyes.names], "AF-A", "AF Index"]
    keys = spectra_files.define_keywords(old, columns, dyes, Panel(["AF1", "AF2"], every.S[:2]), "PerCellAF", "out.fcs", ["Time"], np.round(every.S[0] * 1000).astype(int) + 0.0, {"dye1": "CD4"}, when=datetime(2026, 3, 7, 5, 6, 7, 891_000))
    n = len(dyes.names)
    wanted = [*[f"$P{i}{k}" for i in range(2, n + 2) for k in "NR"], f"$P{n + 2}S", f"$P{n + 3}N", *"$P1N $P1B $P1E $P1R $P2S $P2V $CYT UNMIXINGMETHOD FLUOROCHROMES $FIL WEIGHTS $LAST_MODIFIED $ORIGINALITY $BEGINDATA".split()]
    return spark.createDataFrame([(k, keys[k]) for k in wanted if k in keys], "keyword string, value string")


@query("clamp", "SELECT event_id, greatest(10.0::DOUBLE, least(200.0::DOUBLE, value)) AS value FROM events")
def clamp(spark, sf):
    """Values held between two bounds."""
    return table(spark, sf, "events").select("event_id", F.greatest(F.lit(10.0), F.least(F.lit(200.0), F.col("value"))).alias("value"))


@query("spectra_without_background", f"{BASE} SELECT label, pos::INT AS pos, round(v, 6) + 0.0 AS v FROM mn WHERE label <> 0")
def spectra_without_background(spark, sf):
    """The panel without its background row, by name."""
    p = all_classes(events(spark, sf)).without(0)
    return spark.createDataFrame([(int(n), i, round(float(v), 6) + 0.0) for n, s in zip(p.names, p.S, strict=True) for i, v in enumerate(s)], "label int, pos int, v double")


@query("pct_above", "SELECT event_type, round(100 * avg((value > 100)::INT), 6) AS pct FROM events GROUP BY event_type")
def pct_above_threshold(spark, sf):
    return pct_above(table(spark, sf, "events"), ["event_type"], "value", 100.0).select("event_type", F.round("pct", 6).alias("pct"))


@query("variant_positives", "SELECT event_id, event_type, value FROM events WHERE event_type <> 'view' AND value > (SELECT quantile_cont(value, 0.995) FROM events WHERE event_type = 'view') ORDER BY value DESC, event_id LIMIT 40")
def variant_positives(spark, sf):
    """Events above the raw threshold of the unstained, the 2 x 20 brightest: what a variant library is made from."""
    e = table(spark, sf, "events").select("event_id", "event_type", "value")
    return clean.positives(e.where("event_type <> 'view'"), "value", e.where("event_type = 'view'"), 0.995, 2 * 20)


HEX = """SELECT {keys}, round(CASE WHEN near THEN i1 ELSE i2 + 0.5 END / {sx} + {x0}, 6) + 0.0 AS cx, round(CASE WHEN near THEN j1 ELSE j2 + 0.5 END / {sy} + {y0}, 6) + 0.0 AS cy, count(*) AS n
FROM (SELECT *, (u - i1) ** 2 + 3 * (v - j1) ** 2 <= (u - i2 - 0.5) ** 2 + 3 * (v - j2 - 0.5) ** 2 AS near FROM (SELECT *, floor(u + 0.5) AS i1, floor(v + 0.5) AS j1, floor(u) AS i2, floor(v) AS j2 FROM ({src}))) GROUP BY ALL"""


@query("hexbin", HEX.format(keys="l_returnflag", sx="(20 / 50.0)", x0="0", sy="(20 / (sqrt(3.0) * 110000.0))", y0="0", src="SELECT l_returnflag, l_quantity * (20 / 50.0) AS u, l_extendedprice * (20 / (sqrt(3.0) * 110000.0)) AS v FROM lineitem"))
def hexbin(spark, sf):
    """Events counted in hexagons."""
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    out = plots.hexagons(li, F.col("l_quantity"), F.col("l_extendedprice"), (0.0, 50.0), (0.0, 110000.0), 20, ("l_returnflag",))
    return out.select("l_returnflag", r6(F.col("cx")).alias("cx"), r6(F.col("cy")).alias("cy"), "n")


def _unmixed(spark, sf):
    ev = events(spark, sf)
    return unmix.unmix_ols(ev.select("vec_id", "x"), all_classes(ev), "x", [f"u{i}" for i in range(10)])


UN = f"{BASE}, {DYES}, {pinv(10)}, un AS (SELECT vec_id, list(list_dot_product(x, p) ORDER BY i) AS u FROM ev, pp GROUP BY vec_id, x)"


def _panels(pairs) -> str:
    src = " UNION ALL ".join(f"SELECT 'u{a}' AS x, 'u{b}' AS y, (u[{a + 1}] + 1) / 3.0 * 16 AS u, (u[{b + 1}] + 1) / 3.0 * (16 / sqrt(3.0)) AS v FROM un" for a, b in pairs)
    return f"{UN} " + HEX.format(keys="x, y", sx="16", x0="0", sy="(16 / sqrt(3.0))", y0="0", src=src)


LIMITS = {f"u{i}": (-1.0, 2.0) for i in range(10)}


@query("unmixed_triangle", _panels([(0, 1), (0, 2), (1, 2)]))
def unmixed_triangle(spark, sf):
    """Every pair of three dyes: the panels of an n x n plot."""
    return plots.triangle(_unmixed(spark, sf), ["u0", "u1", "u2"], LIMITS, 16).select("x", "y", r6(F.col("cx")).alias("cx"), r6(F.col("cy")).alias("cy"), "n")


@query("unmixed_grid", _panels([(0, 3), (1, 3), (0, 4), (1, 4)]))
def unmixed_grid(spark, sf):
    """Two dyes against two others: the panels of an m x n plot."""
    return plots.grid(_unmixed(spark, sf), ["u0", "u1"], ["u3", "u4"], LIMITS, 16).select("x", "y", r6(F.col("cx")).alias("cx"), r6(F.col("cy")).alias("cy"), "n")


@query("axis_low", f"{UN} SELECT 'u' || i AS channel, round(least(2 * quantile_cont(u[i + 1], 0.01), -0.2), 6) + 0.0 AS low FROM un, (SELECT unnest(range(3)) AS i) GROUP BY i")
def axis_low(spark, sf):
    """Where the axis of each dye begins."""
    un = _unmixed(spark, sf)
    return spark.createDataFrame([(c, round(plots.axis_low(un, c, -0.2), 6) + 0.0) for c in ("u0", "u1", "u2")], "channel string, low double")


@query(
    "background_quality",
    f"""{BASE}, {DYES9}, {AF}, c AS (SELECT j, a, i, s, list_dot_product(a, s) / (sqrt(list_dot_product(a, a) + 1e-9) * sqrt(list_dot_product(s, s) + 1e-9)) AS c FROM af, dy),
    b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY j ORDER BY c DESC, i) = 1)
    SELECT j::VARCHAR AS af, (i + 1)::VARCHAR AS dye, round(c, 6) + 0.0 AS similarity, unnest(range(64))::INT AS pos, round(unnest(a), 6) + 0.0 AS af_value, round(unnest(s), 6) + 0.0 AS dye_value FROM b WHERE c > 0.05""",
)
def background_quality(spark, sf):
    """Lines of each background row beside the dye it is most like."""
    dyes, af = dyes_and_background(events(spark, sf))
    rows = plots.background_quality(af, dyes, 0.05)
    return spark.createDataFrame([(a, d, *(round(v, 6) + 0.0 if isinstance(v, float) else v for v in r)) for a, d, *r in rows], "af string, dye string, similarity double, pos int, af_value double, dye_value double")


@query(
    "clean_controls",
    f"""WITH {EV}, ct AS (SELECT *, CASE WHEN label BETWEEN 1 AND 5 THEN 0 WHEN label IN (6, 8) THEN 9 END AS neg FROM ev WHERE label <> 8 OR vec_id % 3 = 0),
    pk AS (SELECT label, neg, arg_max(pos, v) AS peak FROM (SELECT label, neg, pos, avg(v) AS v FROM (SELECT label, neg, unnest(range(64)) AS pos, unnest(x) AS v FROM ct) GROUP BY ALL) GROUP BY label, neg),
    th AS (SELECT pk.label, quantile_cont(n.x[peak + 1], 0.9) AS q FROM pk JOIN ct n ON n.label = pk.neg GROUP BY pk.label),
    po AS (SELECT ct.label, ct.neg, vec_id, x, row_number() OVER (PARTITION BY ct.label ORDER BY x[peak + 1] DESC, vec_id) AS rn, count(*) OVER (PARTITION BY ct.label) AS n FROM ct JOIN pk USING (label) JOIN th USING (label) WHERE x[peak + 1] > q),
    br AS (SELECT * FROM po WHERE n >= 20 AND rn <= 500),
    few AS (SELECT label, neg FROM pk WHERE neg IS NOT NULL AND label NOT IN (SELECT label FROM br)),
    kn AS (SELECT br.label, r.vec_id, row_number() OVER (PARTITION BY br.vec_id ORDER BY (br.x[1] - r.x[1]) ** 2 + (br.x[2] - r.x[2]) ** 2, r.vec_id) AS rank FROM br JOIN ct r ON r.label = br.neg),
    ng AS (SELECT DISTINCT label, vec_id FROM kn WHERE rank <= 3),
    un AS (SELECT DISTINCT label, neg FROM br WHERE label NOT IN (SELECT label FROM ng GROUP BY label HAVING count(*) >= 20)),
    rs AS (SELECT label, vec_id, 'positive' AS role FROM br UNION ALL SELECT label, vec_id, 'negative' FROM ng WHERE label NOT IN (SELECT label FROM un)
        UNION ALL SELECT few.label, vec_id, 'positive' FROM few JOIN ct ON ct.label = few.label UNION ALL SELECT w.label, vec_id, 'negative' FROM (FROM few UNION ALL FROM un) w JOIN ct ON ct.label = w.neg
        UNION ALL SELECT label, vec_id, 'all' FROM ct WHERE label = 7 UNION ALL SELECT label, vec_id, 'unstained' FROM ct WHERE label IN (0, 9))
    SELECT CASE label WHEN 0 THEN 'AF' WHEN 9 THEN 'Negative' ELSE 'dye' || label END AS fluorophore, role, vec_id AS event_id FROM rs""",
)
def clean_controls(spark, sf):
    """The events that each control's spectrum is taken from: two negatives, a dye without one, a dye with few positives. The
    controls are beads, so none has background events to lose."""
    from lumenfold.params import Parameters
    from lumenfold.plans.flow import clean_controls as run

    ev = events(spark, sf).where("label <> 8 OR vec_id % 3 = 0")
    name = F.when(F.col("label") == 0, "AF").when(F.col("label") == 9, "Negative").otherwise(F.concat(F.lit("dye"), F.col("label")))
    negative = F.when(F.col("label").between(1, 5), "AF").when(F.col("label").isin(6, 8), "Negative")
    e = ev.select(F.col("vec_id").alias("event_id"), name.alias("sample"), name.alias("fluorophore"), negative.alias("negative_sample"), F.lit("beads").alias("control_type"), F.get("x", F.lit(0)).alias("FSC-A"), F.get("x", F.lit(1)).alias("SSC-A"), F.col("x").alias("spectral"))
    return run(e, Parameters(positivity=0.9, negative_n=1_000_000_000)).select("fluorophore", "role", "event_id")
