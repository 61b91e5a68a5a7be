"""The control table: drafting, name matching, validation rules, gate groups."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

COLUMNS = "filename fluorophore marker channel control_type universal_negative large_gate is_viability gate_name gate_define".split()
REQUIRED = COLUMNS[:6]
ISSUE = "severity string, rule string, filename string, column string, message string"
RESERVED = ("AF", "UNIVERSALNEGATIVE", "NEG", "N/A")


def blank_to_null(df: DataFrame) -> DataFrame:
    """Blank cells of a CSV are missing values."""
    return df.select(*[F.nullif(F.trim(c), F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def match_longest(df: DataFrame, text: str, names: DataFrame, default: str, out: str = "match") -> DataFrame:
    """df with the longest name found in `text`, first in name order among equals; `default` without one.

    names(name, term): a name and each of its synonyms, a dictionary of some hundred rows, turned into patterns on the
    driver. A term is found in any case, with any white space for its spaces, where no letter, digit or hyphen touches it.
    """
    terms = sorted(((r["name"], r["term"]) for r in names.select("name", "term").distinct().collect() if r["term"]), key=lambda t: (-len(t[1]), t[0], t[1]))
    found = F.lit(default)
    for name, term in reversed(terms):
        words = r"\s*".join(re.escape(w) for w in term.split())
        found = F.when(F.col(text).rlike(rf"(?i)(^|[^A-Za-z0-9-]){words}([^A-Za-z0-9-]|$)"), F.lit(name)).otherwise(found)
    return df.withColumn(out, found)


def draft(files: DataFrame, dyes: DataFrame, markers: DataFrame, database: DataFrame, channels: list[str], library: dict[str, list[float]] | None = None, detectors: list[str] | None = None) -> DataFrame:
    """A draft control table from file names: dye and marker by name, channel from the database, type from the name, in laser
    and wavelength order; unstained cells become AF, unstained beads Negative.

    A dye whose channel the data do not have gets the detector at which its spectrum in the library peaks, among those the
    data have; without a spectrum of its own, the peak of the mean spectrum of the dyes with the same nominal channel; else
    "No match". database(fluorophore, channel, laser_rank, wavelength): one row a dye; library: spectra over `detectors`.
    """
    t = match_longest(match_longest(files, "filename", dyes, "No match", "fluorophore"), "filename", markers, "", "marker")
    low = F.lower("filename")
    kind = F.when(low.contains("beads"), "beads").when(low.contains("cells"), "cells")
    t = t.withColumn("control_type", kind)
    bare = low.rlike("unstained")
    t = t.withColumn("fluorophore", F.when(bare & (F.col("control_type") == "beads"), "Negative").when(bare, "AF").otherwise(F.col("fluorophore")))
    known = {r["fluorophore"]: r["channel"] for r in database.select("fluorophore", "channel").collect() if r["channel"]}  # a dictionary of some hundred dyes
    moved = reassigned(known, channels, library or {}, detectors or [])
    t = t.join(F.broadcast(database), "fluorophore", "left")
    if moved:
        new = F.create_map(*[F.lit(v) for kv in moved.items() for v in kv])
        t = t.withColumn("channel", F.when(F.col("channel").isNotNull(), F.coalesce(F.element_at(new, F.col("fluorophore")), F.col("channel"))))
    return t.orderBy(F.col("laser_rank").asc_nulls_last(), F.col("wavelength").asc_nulls_last(), "filename").select("filename", "fluorophore", "marker", "channel", "control_type")


def reassigned(nominal: dict[str, str], channels: list[str], library: dict[str, list[float]], detectors: list[str]) -> dict[str, str]:
    """New channels of the dyes whose nominal channel was not acquired: see draft()."""
    have = [i for i, d in enumerate(detectors) if d in set(channels)]
    out = {}
    for dye, channel in nominal.items():
        if channel in channels or dye in ("AF", "Negative", "No match"):
            continue
        rows = [library[dye]] if dye in library else [library[d] for d, c in nominal.items() if c == channel and d in library]
        if rows and have:
            mean = [sum(r[i] for r in rows) / len(rows) for i in have]
            out[dye] = detectors[have[max(range(len(have)), key=lambda k: (mean[k], -k))]]
        else:
            out[dye] = "No match"
    return out


def _issue(severity, rule, filename=None, column=None, message=""):
    text = lambda v: F.lit(v).cast("string") if v is None or isinstance(v, str) else v
    return F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), text(filename).alias("filename"), text(column).alias("column"), text(message).alias("message"))


def _bare(c="fluorophore"):
    return F.coalesce(F.col(c).rlike("(?i)^AF$|negative"), F.lit(False))


def _row_rules(legacy: bool):
    """(severity, rule, column, when, message): rules that look at one row."""
    dye, kind = F.col("fluorophore"), F.col("control_type")
    excused = F.coalesce(dye.rlike("(?i)AF|negative"), F.lit(False))
    rules = [
        ("warning", "missing_filename", "filename", F.col("filename").isNull(), "Filename missing"),
        ("error", "non_fcs_filename", "filename", ~F.coalesce(F.col("filename").rlike(r"(?i)\.fcs$"), F.lit(False)), "Filename does not end in .fcs"),
        ("error", "missing_fluorophore", "fluorophore", dye.isNull(), "Fluorophore missing"),
        ("error", "no_match_present", "fluorophore", dye.rlike("(?i)No match"), "No match is left in the fluorophore column"),
        ("error", "af_wrong_type", "control_type", (dye == "AF") & (F.coalesce(kind, F.lit("")) != "cells"), "AF must be of type cells"),
        ("warning", "missing_marker", "marker", F.col("marker").isNull() & ~excused, "Marker missing"),
        ("error" if legacy else "warning", "missing_channel", "channel", F.col("channel").isNull() & ~excused, "Channel missing"),
        ("error", "missing_control_type", "control_type", kind.isNull(), "Control type missing"),
        ("error", "invalid_control_type", "control_type", kind.isNotNull() & ~kind.isin("cells", "beads"), "Control type must be cells or beads"),
    ]
    if legacy:
        rules += [
            ("error", "large_gate_non_cell", "large_gate", F.col("large_gate") & (F.coalesce(kind, F.lit("")) != "cells"), "Large gates are for cells"),
            ("error", "viability_non_cell", "is_viability", F.col("is_viability") & (F.coalesce(kind, F.lit("")) != "cells"), "Viability gates are for cells"),
            ("error", "invalid_gate_characters", "gate_name", F.col("gate_name").rlike("[^A-Za-z0-9_. ]"), "Illegal characters in the gate name"),
            ("error", "reserved_gate_name", "gate_name", F.upper("gate_name").isin(*RESERVED), "Reserved gate name"),
            ("error", "invalid_gate_define", "gate_define", ~F.coalesce(F.col("gate_define").isin("TRUE", "FALSE", "T", "F", ""), F.lit(True)), "gate_define must be TRUE or FALSE"),
        ]
    return rules


def validate(control: DataFrame, headers: DataFrame | None = None, voltages: DataFrame | None = None, parameters: list[str] | None = None, cytometer: str = "", legacy: bool = False, few: int = 5000, very_few: int = 1000) -> DataFrame:
    """All issues of a control table as rows (severity, rule, filename, column, message).

    headers(filename, n_events, cytometer, ok), voltages(filename, channel, voltage) and parameters, if given, are
    checked too. Rules that look at single rows share one scan.
    """
    missing = [c for c in REQUIRED if c not in control.columns]
    spark = control.sparkSession
    if missing:
        return spark.createDataFrame([("error", "missing_columns", None, ", ".join(missing), "Required columns missing")], ISSUE)
    for c in COLUMNS:
        if c not in control.columns:
            control = control.withColumn(c, F.lit(None).cast("boolean" if c in ("large_gate", "is_viability") else "string"))
    found = []

    def add(df, *args, **kw):
        found.append(df.select(_issue(*args, **kw).alias("i")).select("i.*"))

    hits = F.filter(F.array(*[F.when(w, _issue(s, r, F.col("filename"), c, m)) for s, r, c, w, m in _row_rules(legacy)]), lambda x: x.isNotNull())
    found.append(control.select(F.explode(hits).alias("i")).select("i.*"))

    one = control.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("fluorophore") == "AF").alias("n_af"),
        F.count_if(F.col("universal_negative").isNotNull()).alias("n_neg"),
        F.coalesce(F.bool_or("large_gate"), F.lit(False)).alias("any_large"),
        F.coalesce(F.bool_or("is_viability"), F.lit(False)).alias("any_viability"),
        F.count("gate_name").alias("n_named"),
    )
    add(one.where("n < 2"), "error", "too_few_rows", message="Fewer than two rows")
    add(one.where("n = 2"), "warning", "low_row_count", message="Only two rows")
    add(one.where("n_af = 0"), "error", "missing_af", column="filename", message="No AF control")
    add(one.where("n_neg = 0"), "warning", "no_universal_negative", column="universal_negative", message="No universal negative is set")

    def repeated(c):
        return control.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")

    files = control.join(repeated("filename").select("filename"), "filename", "left_semi").where(~_bare())
    add(files, "error", "duplicate_filename", F.col("filename"), "filename", "Filename occurs more than once")
    add(repeated("fluorophore"), "error", "duplicate_fluorophore", column="fluorophore", message=F.concat(F.lit("Duplicate fluorophore "), F.col("fluorophore")))
    add(control.where("fluorophore = 'AF'").crossJoin(F.broadcast(one.where("n_af > 1").select("n_af"))), "error", "duplicate_af", F.col("filename"), message="More than one AF control")  # one row

    wants = control.where("universal_negative IS NOT NULL")
    have = control.where("filename IS NOT NULL").select(F.col("filename").alias("universal_negative"), F.col("fluorophore").alias("neg_dye"), F.col("control_type").alias("neg_type"))
    add(wants.join(have, "universal_negative", "left_anti"), "error", "universal_negative_missing", F.col("filename"), "universal_negative", "The negative is not in the table")
    # a file's first row (by dye) stands for it
    first = have.groupBy("universal_negative").agg(F.min(F.struct(F.coalesce("neg_dye", F.lit("~")).alias("d"), F.coalesce("neg_type", F.lit("~")).alias("t"))).alias("f"))
    both = wants.join(first, "universal_negative")
    add(both.where(~F.col("f.d").rlike("(?i)^AF$|negative")), "error", "invalid_negative_fluorophore", F.col("filename"), "universal_negative", "The negative is neither AF nor Negative")
    add(both.where(F.col("f.t") != F.coalesce("control_type", F.lit("~"))), "error", "negative_type_mismatch", F.col("filename"), "universal_negative", "Control and negative differ in type")

    if headers is not None:
        used = control.where("filename IS NOT NULL").select("filename").distinct()
        h = used.join(headers, "filename", "left")
        good = h.where("coalesce(ok, false)")
        add(h.where("NOT coalesce(ok, false)"), "error", "fcs_header_read_failed", F.col("filename"), message="The header could not be read")
        add(good.agg(F.count(F.lit(1)).alias("n")).where("n = 0"), "error", "no_valid_fcs_headers", message="No header could be read")
        add(good.where(F.col("n_events") < few), "warning", "low_event_count", F.col("filename"), message=f"Fewer than {few} events")
        add(good.where(F.col("n_events") < very_few), "error", "very_low_event_count", F.col("filename"), message=f"Fewer than {very_few} events")
        kinds = good.agg(F.countDistinct("cytometer").alias("n"), F.min("cytometer").alias("c"))
        add(kinds.where("n > 1"), "error", "multiple_cytometers", message="More than one cytometer")
        add(kinds.where(F.col("n") == 1).where(~F.lower("c").contains(cytometer.lower())), "warning", "cytometer_mismatch", message="Another cytometer than the parameters'")
    if voltages is not None:
        ref = voltages.groupBy("channel").agg(F.min_by("voltage", "filename").alias("ref"))  # the first file's
        off = voltages.join(F.broadcast(ref), "channel").where("voltage <> ref").select("filename").distinct()
        add(off, "warning", "voltage_mismatch", F.col("filename"), message="Detector voltages differ from the first control's")
    if parameters is not None:
        lost = control.where(F.col("channel").isNotNull() & ~F.col("channel").isin(list(parameters)))
        add(lost.agg(F.count(F.lit(1)).alias("n")).where("n > 0"), "error", "channel_parameter_mismatch", column="channel", message="Channels not among the parameters")
    if legacy:
        add(one.where("NOT any_large"), "warning", "no_large_gate_set", column="large_gate", message="No large gate is set")
        add(one.where("NOT any_viability"), "warning", "no_viability_set", column="is_viability", message="No viability control is set")
        add(one.where("n_named > 0 AND n_named < n"), "error", "incomplete_gate_naming", column="gate_name", message="gate_name must be blank or filled throughout")
        defines = F.coalesce(F.col("gate_define").isin("TRUE", "T"), F.lit(False))
        stained = ~F.coalesce(F.upper("fluorophore").isin("AF", "NEGATIVE"), F.lit(False))
        gates = control.where("gate_name IS NOT NULL").groupBy("gate_name").agg(
            F.bool_or(defines).alias("defined"), F.bool_or(defines & stained).alias("by_stained"),
            F.greatest(*[F.countDistinct(c) for c in ("control_type", "large_gate", "is_viability")]).alias("values"),
        )
        name = F.col("gate_name")
        add(gates.where("NOT defined"), "error", "no_gate_definition", message=F.concat(F.lit("No sample defines gate "), name))
        add(gates.where("NOT by_stained"), "warning", "unstained_gate_definition", message=F.concat(F.lit("Only unstained samples define gate "), name))
        add(gates.where("values > 1"), "error", "gate_inconsistency", message=F.concat(F.lit("Mixed control types or gate flags in gate "), name))
    return reduce(DataFrame.unionByName, found)


def check(control: DataFrame, strict: bool = True, **options) -> DataFrame:
    """The issues; with strict, an error if any is one."""
    issues = validate(control, **options).cache()
    bad = issues.where("severity = 'error'").limit(20).collect() if strict else []
    if bad:
        raise ValueError("\n".join(f"{r['rule']}: {r['message']} ({r['filename'] or r['column'] or 'table'})" for r in bad))
    return issues


def gate_groups(control: DataFrame) -> DataFrame:
    """The table with a gate for every sample, and negatives resolved to samples.

    Samples without a gate name get one by (negative, type, viability, large), numbered in order of those; negatives
    are repeated for every gate that refers to them; negatives no gate refers to get a gate of their own kind.
    """
    t = control.withColumn("large_gate", F.coalesce("large_gate", F.lit(False))).withColumn("is_viability", F.coalesce("is_viability", F.lit(False)))
    t = t.withColumn("bare", F.coalesce(F.col("fluorophore").rlike(r"(?i)\bAF\b|\bnegative\b|\bunstained\b"), F.lit(False)))
    kinds = ["universal_negative", "control_type", "is_viability", "large_gate"]
    order = Window.orderBy(*[F.col(c).asc_nulls_first() for c in kinds])
    combos = t.select(*kinds).distinct().withColumn("group", F.row_number().over(order))  # few: one row a kind of gate
    label = F.when(F.col("is_viability"), "viabilityGate").when(F.col("large_gate"), "largeGate").otherwise("smallGate")
    same = reduce(lambda a, b: a & b, [F.col(f"t.{c}").eqNullSafe(F.col(f"g.{c}")) for c in kinds])
    t = t.alias("t").join(F.broadcast(combos.alias("g")), same).select("t.*", "group")
    stained = t.where("NOT bare").withColumn("gate_name", F.coalesce("gate_name", F.concat_ws("_", label, "group")))
    stained = stained.withColumn("sample", F.col("fluorophore"))
    refers = stained.where("universal_negative IS NOT NULL").select(F.col("universal_negative").alias("filename"), F.col("gate_name").alias("for_gate")).distinct()
    bare = t.where("bare").join(refers, "filename", "left")
    bare = bare.withColumn("gate_name", F.coalesce("for_gate", "gate_name", F.concat(label, F.lit("_density_orphan"))))
    bare = bare.withColumn("sample", F.when(F.col("fluorophore") == "AF", "AF").otherwise(F.concat_ws("_", "fluorophore", "gate_name"))).drop("for_gate")
    every = stained.unionByName(bare)
    # a sample's negative: the row of that file in the same gate, else any row of the file, lowest name first
    negatives = every.select(F.col("filename").alias("universal_negative"), F.col("gate_name").alias("neg_gate"), F.col("sample").alias("negative_sample")).where("universal_negative IS NOT NULL")
    exact = negatives.groupBy("universal_negative", F.col("neg_gate").alias("gate_name")).agg(F.min("negative_sample").alias("same_gate"))
    loose = negatives.groupBy("universal_negative").agg(F.min("negative_sample").alias("any_gate"))
    every = every.join(exact, ["universal_negative", "gate_name"], "left").join(loose, "universal_negative", "left")
    return every.withColumn("negative_sample", F.coalesce("same_gate", "any_gate")).drop("same_gate", "any_gate", "bare", "group")


def voltage_suffix(keys) -> str | None:
    """V where the file has detector voltages, G where it has gains, else None."""
    for s in "VG":
        if any(re.fullmatch(rf"\$P\d+{s}", k) for k in keys):
            return s
    return None


def spectral_voltages(keywords: dict[str, str], channels: list[str]) -> dict[str, str]:
    """Voltage (or gain) of each named detector of a file."""
    s = voltage_suffix(keywords)
    out = {}
    for k, v in keywords.items():
        m = re.fullmatch(r"\$P(\d+)N", k)
        if m and s and v in channels and f"$P{m[1]}{s}" in keywords:
            out[v] = keywords[f"$P{m[1]}{s}"]
    return out


def ordered_channels(found: list[str], database: list[str]) -> list[str]:
    """Channels in database order, unknown ones last in their own order."""
    return [c for c in database if c in found] + [c for c in found if c not in database]


def spectral_channels(columns: list[str], exclude: str, include: str | None = None) -> list[str]:
    """Detectors by name: what no exclusion pattern matches, and an inclusion pattern (if given) does."""
    return [c for c in columns if not re.search(exclude, c) and (include is None or re.search(include, c))]


def unstained_sources(values: list[str | None]) -> list[tuple[str, str | None]]:
    """Where each control's negative comes from: blank is internal, TRUE the experiment's unstained, else a file."""
    out = []
    for v in values:
        v = (v or "").strip()
        out.append(("internal", None) if not v else ("global", None) if v.upper() == "TRUE" else ("file", v))
    return out


def scatter_parameters(p, path: str | None = None) -> list[str]:
    """Scatter channels from a one-column file if there is one, else the cytometer's."""
    import os

    if path and os.path.exists(path):
        with open(path) as f:
            return [line.strip().strip('"') for line in f if line.strip()][1:]
    return list(p.scatter)


def sample_scatter(events: DataFrame, scatter: list[str], n: int, id_col: str = "event_id", seed: int = 1) -> DataFrame:
    """A uniform sample of the scatter columns; files of at most 500 events are refused."""
    from lumenfold.operators.clean import sample_rows

    if events.limit(501).count() <= 500:
        raise ValueError("at most 500 events")
    return sample_rows(events, n, id_col, seed).select(id_col, *[F.col(f"`{c}`") for c in scatter])
