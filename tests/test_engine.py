"""Event files, workflows, control rules, streaming, against known truth."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold import params
from lumenfold.operators import af_removal, clean, control, gate, kernels, unmix
from lumenfold.operators.simulate import simulate
from lumenfold.operators.unmix import Panel
from lumenfold.plans import flow
from lumenfold.sources import fcs, spectra_files
from lumenfold.streaming.unmixing import unmix_stream, windowed_counts

CHANNELS = ["Time", "FSC-A", "SSC-A", "V1-A", "V2-A", "B1-A", "B2-A", "R1-A"]
DETECTORS = CHANNELS[3:]


@pytest.fixture(scope="module")
def scene():
    rng = np.random.default_rng(2)
    S = np.array([[1, 0.3, 0.05, 0, 0.1], [0.1, 0.2, 1, 0.4, 0.05], [0.02, 0, 0.1, 0.3, 1]])
    U = rng.random((1200, 3)) * 1e4
    raw = np.hstack([np.arange(1200)[:, None], rng.normal(5e4, 5e3, (1200, 2)), U @ S])
    return S, U, raw


def test_fcs_round_trip(tmp_path):
    data = np.array([[1.5, -2, 3, 4], [5, 6, 7, 8], [9, 10, 11, 12], [0, 0, 0, 1e6], [1, 1, 1, 1]])
    path = fcs.write(str(tmp_path / "a.fcs"), ["A/b", "C", "D", "E"], data, {"$CYT": "Aurora", "note": "x/y//z", "$P1V": "400", "empty": ""})
    channels, back = fcs.read_rows(path)
    assert channels == ["A/b", "C", "D", "E"] and np.allclose(back, data)
    keys = fcs.header(path)
    assert keys["$TOT"] == "5" and keys["note"] == "x/y//z" and keys["$P1V"] == "400" and keys["FCSversion"] == "FCS3.1"
    assert np.allclose(fcs.read_rows(path, 1, 3)[1], data[1:3]) and len(fcs.read_rows(path, 5, 9)[1]) == 0
    raw = bytearray(open(path, "rb").read())
    at = int(keys["$BEGINDATA"])
    swapped = np.frombuffer(bytes(raw[at : at + data.size * 4]), "<f4").astype(">f4").tobytes()
    big = bytes(raw[:at]).replace(b"1,2,3,4", b"4,3,2,1") + swapped
    (tmp_path / "b.fcs").write_bytes(big)
    assert np.allclose(fcs.read_rows(str(tmp_path / "b.fcs"))[1], data)
    both = fcs.concatenate([path, str(tmp_path / "b.fcs")], str(tmp_path / "c.fcs"))
    assert np.allclose(fcs.read_rows(both)[1], np.vstack([data, data]))
    other = fcs.write(str(tmp_path / "d.fcs"), ["X", "C", "D", "E"], data)
    with pytest.raises(ValueError):
        fcs.concatenate([path, other], str(tmp_path / "e.fcs"))
    (tmp_path / "f.fcs").write_bytes(b"no such thing" * 9)
    with pytest.raises(ValueError):
        fcs.header(str(tmp_path / "f.fcs"))


def test_fcs_source(spark, tmp_path, scene):
    _, _, raw = scene
    fcs.register(spark)
    fcs.write(str(tmp_path / "one.fcs"), CHANNELS, raw)
    fcs.write(str(tmp_path / "two.FCS"), CHANNELS, raw[:7])
    df = spark.read.format("fcs").option("rows", 500).load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 4 and df.count() == 1207 and df.columns == ["sample", "event_id", *CHANNELS]
    some = spark.read.format("fcs").option("columns", "V1-A").option("startrow", 3).option("endrow", 10).load(str(tmp_path / "one.fcs"))
    assert some.columns == ["sample", "event_id", "V1-A"] and [r["event_id"] for r in some.collect()] == list(range(3, 10))
    heads = spark.read.format("fcs_header").option("keyword", "$TOT").load(str(tmp_path)).collect()
    assert sorted(r["keywords"]["$TOT"] for r in heads) == ["1200", "7"]
    out = str(tmp_path / "out.fcs")
    df.where("sample = 'one'").drop("sample", "event_id").repartition(3).write.format("fcs").mode("overwrite").save(out)
    assert np.allclose(np.sort(fcs.read_rows(out)[1][:, 3]), np.sort(raw[:, 3].astype("f4")))
    assert sorted(os.listdir(tmp_path)) == ["one.fcs", "out.fcs", "two.FCS"]


def test_fcs_filters_reach_the_source(spark, tmp_path, monkeypatch):
    fcs.register(spark)
    for name in "abc":
        fcs.write(str(tmp_path / f"{name}.fcs"), ["x", "y"], np.column_stack([np.arange(1000), np.full(1000, ord(name))]))
    df = spark.read.format("fcs").option("rows", 100).load(str(tmp_path))
    cases = {
        "sample = 'b'": 10, "sample IN ('a', 'c')": 20, "event_id >= 950": 3, "event_id > 99 AND event_id < 200 AND sample = 'a'": 1, "event_id = 500": 3, "event_id IN (5, 250)": 9,
        "sample = 'none'": 0, "event_id BETWEEN 10 AND 20 AND x > 15": 3, "x < 10": None, "sample <> 'a'": None, "sample IS NULL": None,
    }
    rows = [(n, i, float(i), float(ord(n))) for n in "abc" for i in range(1000)]
    whole = spark.createDataFrame(rows, "sample string, event_id long, x double, y double")
    for condition, parts in cases.items():
        got = df.where(condition)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.where(condition).collect())), condition
        assert parts is None or got.rdd.getNumPartitions() == max(1, parts), condition
    plan = df.where("sample = 'b' AND event_id > 5")._jdf.queryExecution().executedPlan().toString()
    assert " Filter (" not in plan
    # only the rows asked for are read
    read = []
    monkeypatch.setattr(fcs, "read_rows", lambda path, start, end, own=fcs.read_rows: read.append((path, start, end)) or own(path, start, end))
    reader = fcs._Reader(df.schema, {"path": str(tmp_path), "rows": "400"})
    assert list(reader.pushFilters([fcs.EqualTo(("sample",), "c"), fcs.GreaterThanOrEqual(("event_id",), 700), fcs.EqualTo(("x",), 1.0)])) == [fcs.EqualTo(("x",), 1.0)]
    n = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
    assert n == 300 and {r[0][-5:] for r in read} == {"c.fcs"} and min(r[1] for r in read) == 700


def test_fcs_saved_in_place(spark, tmp_path):
    fcs.register(spark)
    df = spark.range(0, 5000, 1, 7).select("id", F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") * 2.5).alias("v"))
    channels, data = fcs.read_rows(fcs.save(df, str(tmp_path / "s.fcs"), {"$CYT": "Aurora"}))
    want = np.array([(i, 0 if i % 3 == 0 else i * 2.5) for i in range(5000)])
    assert channels == ["id", "v"] and np.array_equal(data, want) and fcs.header(str(tmp_path / "s.fcs"))["$CYT"] == "Aurora"
    assert len(fcs.read_rows(fcs.save(df.limit(0), str(tmp_path / "e.fcs")))[1]) == 0
    files = [str(tmp_path / n) for n in ("s.fcs", "e.fcs", "s.fcs")]
    both = [fcs.read_rows(fcs.concatenate(files, str(tmp_path / f"c{k}.fcs"), 700, s))[1] for k, s in enumerate((None, spark))]
    assert np.array_equal(both[0], both[1]) and np.array_equal(both[1], np.vstack([want, want]))


def test_unmixed_files(spark, tmp_path, scene):
    S, U, raw = scene
    panel = Panel(["d1", "d2", "d3"], S, DETECTORS)
    src = tmp_path / "in"
    src.mkdir()
    for name in ("a.fcs", "b.FCS"):
        fcs.write(str(src / name), CHANNELS, raw, {"$CYT": "Aurora", "$P4V": "500"})
    p = params.parameters("aurora")
    for method in ("OLS", "WLS", "Poisson"):
        made = flow.unmix_folder(spark, str(src), str(tmp_path / method), panel, p, method=method)
        assert len(made) == 2
        channels, data = fcs.read_rows(made[0])
        assert channels == ["Time", "FSC-A", "SSC-A", "d1-A", "d2-A", "d3-A"]
        assert np.allclose(data[:, 3:], U, rtol=1e-3, atol=0.2) and np.allclose(data[:, 0], raw[:, 0])
        keys = fcs.header(made[0])
        assert keys["UNMIXINGMETHOD"] == method and keys["SPECTRA"].startswith("3,5,d1,d2,d3,V1-A") and ("WEIGHTS" in keys) == (method != "OLS")
    af = Panel(["AF1", "AF2"], np.array([[0.4, 1, 0.2, 0.1, 0.1], [0.1, 0.3, 0.3, 1, 0.6]]), DETECTORS)
    made = flow.unmix_file(spark, str(src / "a.fcs"), str(tmp_path), panel, p, "PerCellAF", af)
    assert fcs.read_rows(made)[0][-2:] == ["AF-A", "AF Index"]
    with pytest.raises(ValueError):
        flow.unmix_file(spark, str(src / "a.fcs"), str(tmp_path), panel, p, "PerCellAF", Panel(["AF1"], af.S[:1], DETECTORS))
    with pytest.raises(ValueError):
        flow.unmix_file(spark, str(src / "a.fcs"), str(tmp_path), Panel(["x"], np.ones((1, 1)), ["none"]), p)
    with pytest.raises(ValueError):
        unmix.unmix(spark.range(1), "nope", panel)


def test_literals_and_kernels_agree(spark, scene):
    S, U, raw = scene
    df = spark.createDataFrame([(i, r[3:].tolist()) for i, r in enumerate(raw[:50])] + [(99, None)], "event_id long, spectral array<double>")
    panel = Panel(["a", "b", "c"], S)
    one, two = (unmix.unmix_ols(df, panel, how=h).orderBy("event_id").select("a", "b", "c").toPandas().to_numpy() for h in ("literal", "kernel"))
    assert np.allclose(one[:50], two[:50]) and np.allclose(one[:50], U[:50]) and np.isnan(one[50]).all()
    assert unmix.assign_af(df, panel, Panel([1, 2], np.random.default_rng(1).random((2, 5)))).where("af_index IS NULL").count() == 1
    assert panel.aligned(["a"]).S is panel.S and Panel(["a"], S[:1], ["x", "y", "z", "u", "v"]).aligned(["y", "x", "z", "u", "v"]).S[0, 0] == S[0, 1]
    with pytest.raises(ValueError):
        Panel(["a"], S[:1], ["x", "y", "z", "u", "v"]).aligned(["q", "x", "z", "u", "v"])


def test_simulator(spark):
    S = np.eye(3, 6) + 0.1
    a, b = (simulate(spark, S, 3000, seed=7, partitions=n).orderBy("event_id").select("event_id", "spectral").collect() for n in (2, 5))
    assert a == b
    rows = simulate(spark, S, 1024, complexity=0.4, af=np.ones((2, 6)), variants={0: np.vstack([S[0], S[0] * 0.5])}).collect()
    assert all(sum(v >= 0 for v in r["layer"]) == 1 for r in rows) and {r["af_row"] for r in rows} == {1, 2} and {r["variant"][0] for r in rows} == {0, 1}


def test_controls_to_spectra(spark, tmp_path):
    """Known spectra come back from simulated single-stained controls, gated and cleaned."""
    rng = np.random.default_rng(5)
    S = np.array([[1, 0.3, 0.05, 0, 0.1], [0.1, 0.2, 1, 0.4, 0.05]])
    af = np.array([0.2, 0.6, 1.0, 0.5, 0.3])
    names = {"AF": None, "DyeA": 0, "DyeB": 1}
    for n, f in names.items():
        m = 3000
        x = rng.normal(1e5, 8e3, (m, 2))
        u = np.zeros(m) if f is None else rng.lognormal(9, 1, m) * (rng.random(m) < 0.6)
        D = np.outer(u, S[f or 0]) + np.outer(rng.normal(300, 30, m), af) + rng.normal(0, 20, (m, 5))
        fcs.write(str(tmp_path / f"{n} cells.fcs"), CHANNELS, np.hstack([np.arange(m)[:, None], x, D]), {"$CYT": "Aurora"})
    table = spark.createDataFrame([(f"{n} cells.fcs", n, "m", None if n == "AF" else "V1-A", "cells", None if n == "AF" else "AF cells.fcs", False, False, None, None) for n in names], ", ".join(f"{c} {'boolean' if c in ('large_gate', 'is_viability') else 'string'}" for c in control.COLUMNS))
    p = params.parameters("aurora")
    fc = flow.define_flow_control(spark, str(tmp_path), table, p)
    assert fc.detectors == DETECTORS and fc.gates
    assert fc.events.count() > 3000
    cleaned = flow.clean_controls(fc.events, p)
    got = flow.reference_spectra(cleaned.where("fluorophore <> 'AF'"))
    for n, f in (("DyeA", 0), ("DyeB", 1)):
        assert np.abs(got.S[got.names.index(n)] - S[f] / S[f].max()).max() < 0.03
    auto, log = flow.automated_spectra(fc.events, p, library=Panel(["DyeA", "DyeB"], S))
    assert {s for _, s, _ in log} == {"OK"}
    assert np.abs(auto.S - S / S.max(1, keepdims=True)).max() < 0.05
    assert flow.reload_flow_control(spark, str(tmp_path), table, p).detectors == DETECTORS
    bright = flow.clean_controls(fc.events, p, universal=False)
    assert {r["role"] for r in bright.select("role").distinct().collect()} == {"positive", "negative"}
    flow.unmix_tables(fc.events.select("sample", "event_id", "spectral"), str(tmp_path / "table"), Panel(["a", "b"], S))
    assert spark.read.parquet(str(tmp_path / "table")).count() == fc.events.count()


def control_rows(spark, *rows):
    base = dict.fromkeys(control.COLUMNS)
    kinds = ", ".join(f"{c} {'boolean' if c in ('large_gate', 'is_viability') else 'string'}" for c in control.COLUMNS)
    return spark.createDataFrame([tuple({**base, **r}[c] for c in control.COLUMNS) for r in rows], kinds)


GOOD = [
    {"filename": "AF.fcs", "fluorophore": "AF", "control_type": "cells", "gate_name": "g", "gate_define": "FALSE"},
    {"filename": "a.fcs", "fluorophore": "A", "marker": "m", "channel": "V1-A", "control_type": "cells", "universal_negative": "AF.fcs", "gate_name": "g", "gate_define": "TRUE", "large_gate": True},
    {"filename": "b.fcs", "fluorophore": "B", "marker": "n", "channel": "V2-A", "control_type": "cells", "universal_negative": "AF.fcs", "gate_name": "g", "gate_define": "TRUE", "large_gate": True},
]


def test_rules_one_by_one(spark):
    def broken(**change):
        rows = [dict(r) for r in GOOD]
        rows[change.pop("row", 1)].update(change)
        return {r["rule"] for r in control.validate(control_rows(spark, *rows), parameters=["V1-A", "V2-A"], legacy=True).collect()}

    quiet = {"gate_inconsistency", "no_viability_set"}  # the gate holds AF, which has no flags; nothing is a viability dye
    assert broken() <= quiet
    for rule, change in {
        "missing_filename": {"filename": None}, "non_fcs_filename": {"filename": "a.txt"}, "missing_fluorophore": {"fluorophore": None}, "no_match_present": {"fluorophore": "no MATCH"},
        "duplicate_fluorophore": {"fluorophore": "B"}, "duplicate_filename": {"filename": "b.fcs"}, "missing_af": {"row": 0, "fluorophore": "Negative"}, "duplicate_af": {"fluorophore": "AF"},
        "af_wrong_type": {"row": 0, "control_type": "beads"}, "missing_marker": {"marker": None}, "missing_channel": {"channel": None}, "missing_control_type": {"control_type": None},
        "invalid_control_type": {"control_type": "rocks"}, "universal_negative_missing": {"universal_negative": "zz.fcs"}, "invalid_negative_fluorophore": {"universal_negative": "b.fcs"},
        "negative_type_mismatch": {"control_type": "beads", "large_gate": False}, "large_gate_non_cell": {"control_type": "beads"}, "viability_non_cell": {"control_type": "beads", "is_viability": True},
        "channel_parameter_mismatch": {"channel": "V9-A"}, "incomplete_gate_naming": {"gate_name": None}, "invalid_gate_characters": {"gate_name": "a/b"}, "reserved_gate_name": {"gate_name": "neg"},
        "invalid_gate_define": {"gate_define": "perhaps"}, "no_gate_definition": {"gate_name": "h", "gate_define": "FALSE"}, "unstained_gate_definition": {"gate_name": "h", "gate_define": None},
    }.items():
        assert rule in broken(**change), rule
    short = lambda n: {r["rule"] for r in control.validate(control_rows(spark, *GOOD[:n])).collect()}
    assert "too_few_rows" in short(1) and "low_row_count" in short(2) and "no_universal_negative" in short(1)
    assert {r["rule"] for r in control.validate(control_rows(spark, *GOOD).drop("marker")).collect()} == {"missing_columns"}
    assert "missing_control_type" not in {r["rule"] for r in control.validate(control_rows(spark, *GOOD).limit(0)).collect()}
    with pytest.raises(ValueError):
        control.check(control_rows(spark, *GOOD[1:]))
    assert control.check(control_rows(spark, *GOOD[1:]), strict=False).count() > 0


def test_headers_and_voltages(spark):
    heads = spark.createDataFrame([("AF.fcs", 900, "Aurora", True), ("a.fcs", 4000, "ID7000", True)], "filename string, n_events long, cytometer string, ok boolean")
    volts = spark.createDataFrame([("AF.fcs", "V1-A", "400"), ("a.fcs", "V1-A", "410"), ("b.fcs", "V1-A", "400")], "filename string, channel string, voltage string")
    got = {(r["rule"], r["filename"]) for r in control.validate(control_rows(spark, *GOOD), heads, volts, cytometer="aurora").collect()}
    assert {("fcs_header_read_failed", "b.fcs"), ("low_event_count", "a.fcs"), ("low_event_count", "AF.fcs"), ("very_low_event_count", "AF.fcs"), ("multiple_cytometers", None), ("voltage_mismatch", "a.fcs")} <= got
    keys = {"$P1N": "V1-A", "$P1V": "400", "$P2N": "FSC-A", "$P2V": "100"}
    assert control.voltage_suffix(keys) == "V" and control.spectral_voltages(keys, ["V1-A"]) == {"V1-A": "400"} and control.voltage_suffix({}) is None
    assert control.ordered_channels(["z", "b", "a"], ["a", "b"]) == ["a", "b", "z"]
    assert control.spectral_channels(CHANNELS, "FSC|SSC|Time", "^V") == ["V1-A", "V2-A"]


def test_draft_and_matching(spark):
    files = spark.createDataFrame([("CD4 bv421 cells.fcs",), ("PE-Cy7 beads.fcs",), ("xPE.fcs",), ("Unstained cells.fcs",), ("unstained beads.fcs",), ("CD45 PE (cells).fcs",)], "filename string")
    dyes = spark.createDataFrame([("BV421", "BV421"), ("PE", "PE"), ("PE-Cy7", "PE-Cy7"), ("PE-Cy7", "PE Cy7")], "name string, term string")
    markers = spark.createDataFrame([("CD4", "CD4"), ("CD45", "CD45")], "name string, term string")
    data = spark.createDataFrame([("BV421", "V1-A", 2, 421), ("PE", "YG1-A", 4, 575), ("PE-Cy7", "YG9-A", 4, 775)], "fluorophore string, channel string, laser_rank int, wavelength int")
    got = {r["filename"]: tuple(r)[1:] for r in control.draft(files, dyes, markers, data, ["V1-A", "YG1-A"]).collect()}
    assert got["CD4 bv421 cells.fcs"] == ("BV421", "CD4", "V1-A", "cells") and got["PE-Cy7 beads.fcs"] == ("PE-Cy7", "", "No match", "beads")
    assert got["xPE.fcs"][0] == "No match" and got["Unstained cells.fcs"][0] == "AF" and got["unstained beads.fcs"][0] == "Negative" and got["CD45 PE (cells).fcs"][1] == "CD45"


def test_channels_that_were_not_acquired():
    nominal = {"A": "V1-A", "B": "YG1-A", "C": "YG1-A", "D": "YG9-A", "E": "YG1-A"}
    library = {"A": [1, 0, 0, 0], "B": [0.1, 0.9, 1, 0.3], "C": [0.8, 0.1, 1, 0.2]}
    detectors = ["V1-A", "B1-A", "YG1-A", "R1-A"]
    got = control.reassigned(nominal, ["V1-A", "B1-A", "R1-A"], library, detectors)
    assert got == {"B": "B1-A", "C": "V1-A", "D": "No match", "E": "B1-A"}  # E: the mean of B and C, [0.45, 0.5, 0.25]
    assert control.reassigned(nominal, ["V1-A"], {}, []) == {"B": "No match", "C": "No match", "D": "No match", "E": "No match"}


def test_experiment_names():
    for url, name in (
        (r"..\B3 BV421 (Cells)_Controls.fcs", "BV421"), (r"x\BV421_CD4 (Cells)_Controls.fcs", "BV421"), (r"C:\run 1\Unstained (Cells)_Controls.fcs", "Unstained"),
        (r"PE-Cy7 (Beads)_Controls.fcs.xml", "PE-Cy7"), (r"a\H12 APC_Controls.fcs", "APC"), ("plain", "plain"),
    ):
        assert spectra_files.clean_url(url) == name


def test_a_gate_that_cannot_be_found_is_an_error(spark, tmp_path, monkeypatch):
    rows = [{"filename": "AF.fcs", "fluorophore": "AF", "control_type": "cells"}, {"filename": "a.fcs", "fluorophore": "DyeA", "marker": "m", "control_type": "cells", "channel": "V1-A", "universal_negative": "AF.fcs"}]
    for r in rows:
        fcs.write(str(tmp_path / r["filename"]), CHANNELS, np.random.default_rng(1).random((30, len(CHANNELS))) * 1000, {})
    table = control_rows(spark, *[{"gate_name": "g", "gate_define": "TRUE", **r} for r in rows])

    def none(*_, **__):
        raise ValueError("no density peak in range")

    monkeypatch.setattr(gate, "find_gate", none)
    with pytest.raises(ValueError, match="gate g cannot be found .* samples: AF, a"):
        flow.define_flow_control(spark, str(tmp_path), table, params.Parameters(), strict=False)
    with pytest.warns(UserWarning, match="keep all events"):
        assert flow.define_flow_control(spark, str(tmp_path), table, params.Parameters(), strict=False, failing="keep").gates == {}


def test_cleaning_removes_background_first(spark):
    rng = np.random.default_rng(8)
    af = np.array([0.1, 0.2, 1.0, 0.7, 0.2, 0.1])
    dye = np.array([1.0, 0.4, 0.1, 0.0, 0.0, 0.0])
    N = rng.normal(0, 5, (1500, 6))
    N[1000:] += rng.lognormal(6.5, 0.4, 500)[:, None] * af
    X = rng.normal(0, 5, (1500, 6))
    X[500:1000] += rng.lognormal(7, 0.5, 500)[:, None] * dye
    X[1000:] += rng.lognormal(6.5, 0.4, 500)[:, None] * af
    rows = [(i, "AF", "AF", "cells", v.tolist()) for i, v in enumerate(N)] + [(2000 + i, "s", "D", "cells", v.tolist()) for i, v in enumerate(X)] + [(4000 + i, "b", "D", "beads", v.tolist()) for i, v in enumerate(X)]
    ev = spark.createDataFrame(rows, "event_id long, sample string, fluorophore string, control_type string, spectral array<double>")
    left = {r["sample"]: r["ids"] for r in flow.without_background(ev).groupBy("sample").agg(F.collect_set("event_id").alias("ids")).collect()}
    assert len(left["AF"]) == 1500 and len(left["b"]) == 1500  # the unstained control and beads stay whole
    kept = np.isin(np.arange(2000, 3500), left["s"])
    assert kept[:500].mean() > 0.95 and kept[500:1000].mean() > 0.9 and kept[1000:].mean() < 0.3


def cleaned_plainly(rows, p, stop):
    """clean_controls without background removal, one sample at a time: (sample, event, role)."""
    out, by = [], {}
    for r in rows:
        by.setdefault(r["sample"], []).append(r)
    for name, own in by.items():
        neg = by.get(own[0]["negative"])
        bare = own[0]["dye"] in ("AF", "Negative")
        if neg is None or own[0]["negative"] == name:
            out += [(name, r["id"], "unstained" if bare else "all") for r in own]
            continue
        peak = int(np.mean([r["x"] for r in own], axis=0).argmax())
        limit = np.quantile([r["x"][peak] for r in neg], p.positivity_af if bare else p.positivity)
        above = sorted((r for r in own if r["x"][peak] > limit), key=lambda r: (-r["x"][peak], r["id"]))
        if len(above) < stop:
            out += [(name, r["id"], "positive") for r in own] + [(name, r["id"], "negative") for r in neg]
            continue
        above = above[: p.positive_n]
        near = {s["id"] for r in above for s in sorted(neg, key=lambda s: ((r["s"][0] - s["s"][0]) ** 2 + (r["s"][1] - s["s"][1]) ** 2, s["id"]))[:3]}
        out += [(name, r["id"], "positive") for r in above] + [(name, i, "negative") for i in (near if len(near) >= stop else [r["id"] for r in neg])]
    return sorted(out)


def test_each_control_meets_its_own_negative(spark):
    """Two negatives, an unstained sample with a negative of its own, few positives, few matches, no negative."""
    rng = np.random.default_rng(6)
    rows = []

    def add(sample, dye, negative, n, bright=0.0, share=0.5, at=None):
        for i in range(n):
            x = rng.normal(0, 5, 4)
            x[1] += bright * rng.lognormal(0, 0.3) * (rng.random() < share)
            rows.append({"id": len(rows), "sample": sample, "dye": dye, "negative": negative, "s": (at or tuple(rng.normal(1e4, 2e3, 2))), "x": x.tolist()})

    add("cells", "AF", "blank", 150)
    add("blank", "Negative", None, 120)
    add("one", "D1", "cells", 200, 500)
    add("two", "D2", "blank", 200, 500)
    add("dim", "D3", "cells", 90, 3, 0.02)
    add("spot", "D4", "blank", 120, 500, 0.9, (1e4, 1e4))  # all in one place: three matches
    add("alone", "D5", None, 40, 500)
    add("lost", "D6", "no such file", 30, 500)
    df = spark.createDataFrame([(r["id"], r["sample"], r["dye"], r["negative"], "beads", *map(float, r["s"]), r["x"]) for r in rows], "event_id long, sample string, fluorophore string, negative_sample string, control_type string, `FSC-A` double, `SSC-A` double, spectral array<double>").repartition(3)
    p = params.Parameters(positive_n=60, negative_n=10_000, positivity=0.98, positivity_af=0.5)
    with pytest.warns(UserWarning, match="fewer than"):
        got = flow.clean_controls(df, p)
        assert sorted((r["sample"], r["event_id"], r["role"]) for r in got.collect()) == cleaned_plainly(rows, p, p.min_cells_stop)
    assert {r[0] for r in got.where("sample = 'two' AND role = 'negative'").select("fluorophore").distinct().collect()} == {"D2"}
    some = flow.clean_controls(df, params.Parameters(positive_n=60, negative_n=15, positivity=0.98)).groupBy("sample", "role").count().collect()
    n = {(r["sample"], r["role"]): r["count"] for r in some}
    assert n["spot", "negative"] == 15 and n["blank", "unstained"] == 120


def test_second_route_for_unlike_dyes(spark):
    """Two dyes that a library does not know by their first spectra: refined together; statuses, similarities and spectra by
    plain rules. Internal controls by theirs."""
    rng = np.random.default_rng(12)
    S = np.array([[1, 0.4, 0.1, 0.0, 0.05], [0.1, 1, 0.5, 0.1, 0.0], [0.0, 0.2, 1, 0.6, 0.1], [0.3, 0.0, 0.1, 1, 0.4]])
    af = np.array([0.5, 0.7, 1.0, 0.8, 0.6])
    rows = []
    for k, (name, neg) in enumerate((("AF", None), ("D0", "AF"), ("D1", "AF"), ("D2", "AF"), ("D3", None))):
        n = 400
        u = np.zeros(n) if name == "AF" else rng.lognormal(6, 1, n) * (rng.random(n) < 0.5)
        X = np.outer(u, S[k - 1]) + np.outer(rng.normal(60, 6, n), af) + rng.normal(0, 4, (n, 5))
        if name == "D1":  # a crowd of bright debris that the first route takes for the dye
            X[:220] = np.outer(rng.lognormal(7.5, 0.2, 220), [0.6, 1.0, 0.0, 0.0, 0.9]) + rng.normal(0, 4, (220, 5))
        rows += [(1000 * k + i, name, neg, "beads", *map(float, rng.normal(1e4, 1e3, 2)), x.tolist()) for i, x in enumerate(X)]
    df = spark.createDataFrame(rows, "event_id long, fluorophore string, negative_sample string, control_type string, `FSC-A` double, `SSC-A` double, spectral array<double>").repartition(3)
    library = Panel(["D0", "D1", "D2"], np.vstack([S[0], S[1], S[2][::-1]]))
    p = params.Parameters(positivity=0.95)
    first, log = flow.automated_spectra(df, p, library, refine=False)
    status = {n: s for n, s, _ in log}
    assert status == {"D0": "OK", "D1": "LEGACY_REFINEMENT", "D2": "LEGACY_REFINEMENT", "D3": "OK"}
    with pytest.warns(UserWarning, match="second route"):
        panel, log = flow.automated_spectra(df, p, library)

    by = {name: [r for r in rows if r[1] == name] for name in ("AF", "D0", "D1", "D2", "D3")}
    neg = np.array([r[6] for r in by["AF"]])
    where = np.array([r[4:6] for r in by["AF"]])
    b = np.median(neg, axis=0)
    for name in ("D0", "D1", "D2"):
        X, at = np.array([r[6] for r in by[name]]), np.array([r[4:6] for r in by[name]])
        unit = b / np.linalg.norm(b)
        m = X.mean(0)
        peak = int((m - (m @ unit) * unit).argmax())
        order = np.argsort(-X[:, peak], kind="stable")[:1000]
        cos = (X[order] @ b) / (np.linalg.norm(X[order], axis=1) * np.linalg.norm(b) + 1e-9)
        order = order[np.argsort(cos, kind="stable")[:200]]
        near = ((at[order][:, None] - where[None]) ** 2).sum(-1).argsort(1, kind="stable")[:, :2]
        want = np.median(X[order] - neg[near].mean(1), axis=0)
        assert np.allclose(first.S[first.names.index(name)], np.maximum(want / want.max(), 0), atol=1e-9)
    X = np.array([r[6] for r in by["D3"]])
    v = X[:, int(X.mean(0).argmax())]
    order = np.argsort(v, kind="stable")
    want = np.maximum(X[order[-100:]].mean(0) - X[order[:40]].mean(0), 0)
    assert np.allclose(first.S[first.names.index("D3")], want / want.max(), atol=1e-9)

    cleaned = cleaned_plainly([{"id": r[0], "sample": r[1], "dye": r[1], "negative": r[2], "s": r[4:6], "x": r[6]} for r in rows], p, p.min_cells_stop)
    of = {r[0]: np.array(r[6]) for r in rows}
    for name, s, c in log:
        if name in ("D1", "D2"):
            Y = np.array([of[i] for n, i, _ in cleaned if n == name])
            at = int(Y.mean(0).argmax())
            slopes = np.array([kernels.huber_line(Y[:, at], y)[1] for y in Y.T])
            second = slopes / slopes.max()
            known, one = library.S[library.names.index(name)], first.S[first.names.index(name)]
            likeness = [float(a @ known / np.linalg.norm(a) / np.linalg.norm(known)) for a in (one, second)]
            better = likeness[1] > likeness[0]
            assert s == ("LEGACY_USED" if better else "LEGACY_REJECTED") and abs(c - max(likeness)) < 1e-6
            assert np.allclose(panel.S[panel.names.index(name)], second if better else one, atol=1e-6)


def test_whole_single_events(spark):
    rng = np.random.default_rng(4)
    n = 400
    area = rng.random((n, 2)) * 1e5 + 1e4
    height = area / (1 + rng.random((n, 2)))
    rows = [(f"s{i % 2}", i, *map(float, (*area[i], *height[i])), [1.0, 9e9 if i % 50 == 7 else 2.0]) for i in range(n)]
    rows[3] = (*rows[3][:2], 9e9, *rows[3][3:])
    ev = spark.createDataFrame(rows, "sample string, event_id long, `FSC-A` double, `SSC-A` double, `FSC-H` double, `SSC-H` double, spectral array<double>")
    p = params.Parameters()
    want = set()
    for s in ("s0", "s1"):
        left = [r for r in rows if r[0] == s and r[6][1] < p.saturation and max(r[2:4]) < p.scatter_max]
        for a, h, q in ((2, 4, 0.85), (3, 5, 0.975)):
            ratio = np.array([r[a] / (r[h] + 1e-9) for r in left])
            left = [r for r, v in zip(left, ratio, strict=True) if v < np.quantile(ratio, q)]
        want |= {r[1] for r in left}
    assert {r["event_id"] for r in flow.whole_single_events(ev, p).collect()} == want
    assert flow.whole_single_events(ev.drop("FSC-H", "SSC-H"), p).count() == n - 8 - 1


def test_gates_hold_their_population(spark):
    """Cells beside debris and a small crowd of doublets: the gate is around the cells, larger or further left if asked."""
    rng = np.random.default_rng(9)
    cells, debris, pairs = rng.normal((50, 40), (5, 4), (3000, 2)), rng.normal((4, 2), (1, 0.7), (1500, 2)), rng.normal((90, 75), (3, 3), (400, 2))
    rows = [(i, float(x), float(y), float(i % 7 if k else 100 + i % 5), "s") for k, (i, (x, y)) in enumerate(enumerate(np.vstack([cells, debris, pairs])))]
    df = spark.createDataFrame(rows, "event_id long, x double, y double, v double, sample string").repartition(3)

    def within(polygon, points):
        return af_removal.inside(points, polygon).mean()

    g = gate.find_gate(df, "x", "y", (0.0, 0.0), (120.0, 120.0), f_mad=2.0, reach=3, trim=(0.01, 0.99, 0.01, 0.99))
    assert within(g, cells) > 0.7 and within(g, debris) == 0 and within(g, pairs) == 0
    wide = gate.find_gate(df, "x", "y", (0.0, 0.0), (120.0, 120.0), f_mad=2.0, reach=3, large=(0.25, (3.0, 6.0)))
    assert max(p[0] for p in wide) > max(p[0] for p in g) and max(p[1] for p in wide) > max(p[1] for p in g)
    dead = gate.find_gate(df, "x", "y", (0.0, 0.0), (120.0, 120.0), f_mad=1.0, reach=3, viability=True)
    assert min(p[0] for p in dead) < min(p[0] for p in gate.find_gate(df, "x", "y", (0.0, 0.0), (120.0, 120.0), f_mad=1.0, reach=3))
    second = gate.find_gate(df, "x", "y", (0.0, 0.0), (120.0, 120.0), target=1, reach=3)
    assert within(second, cells) < 0.5
    with pytest.raises(ValueError, match="peak"):
        gate.find_gate(df, "x", "y", (0.0, 0.0), (120.0, 120.0), target=50)
    with pytest.raises(ValueError, match="no event"):
        gate.find_gate(df.limit(0), "x", "y", (0.0, 0.0), (120.0, 120.0))
    corners = {tuple(np.round(p, 9)) for p in gate.hull_of_events(df, "x", "y")}
    assert corners == {tuple(np.round(p, 9)) for p in gate.hull(np.array([(r[1], r[2]) for r in rows]))}
    s = gate.spreads(df, "x", "y")
    x = np.array([r[1] for r in rows])
    assert np.isclose(gate.normal_reference(s)[0], 1.06 * min(x.std(ddof=1), np.subtract(*np.quantile(x, [0.75, 0.25])) / 1.34) * len(x) ** -0.2)
    assert within(gate.landmark_gate(df.where("event_id < 3000"), "v", "x", "y", (0, 0), (120, 120)), cells) > 0.5
    assert len(gate.scatter_gate(df.where("event_id < 3000"), "x", "y")) >= 3


def test_gate_groups(spark):
    rows = [dict(r, gate_name=None) for r in GOOD]
    rows[2]["large_gate"] = False
    got = [(r["filename"], r["gate_name"], r["sample"], r["negative_sample"]) for r in control.gate_groups(control_rows(spark, *rows, {"filename": "n.fcs", "fluorophore": "Negative", "control_type": "beads"})).collect()]
    by = {f: {g for x, g, _, _ in got if x == f} for f, *_ in got}
    assert len(by["AF.fcs"]) == 2 and by["AF.fcs"] == by["a.fcs"] | by["b.fcs"] and by["n.fcs"] == {"smallGate_density_orphan"}
    assert {n for f, _, _, n in got if f in ("a.fcs", "b.fcs")} == {"AF"}


def test_polygon_rule(spark):
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    pts = [(2, 2, True), (0, 2, True), (4, 4, True), (0, 0, True), (2, 4, True), (5, 2, False), (-1, 0, False), (2, 4.0001, False), (4, -0.1, False)]
    df = spark.createDataFrame([(float(x), float(y), w) for x, y, w in pts], "x double, y double, want boolean")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", gate.in_polygon(F.col("x"), F.col("y"), square)).collect())


@pytest.mark.parametrize("n", [0, 1, 9, 19, 20])
def test_few_events(spark, n):
    df = spark.createDataFrame([("s", i, float(i)) for i in range(n)], "sample string, event_id long, v double")
    both = clean.top_and_bottom(df, "v", 12, 12, ["sample"])
    assert both.count() == min(n, 24) and both.select("event_id").distinct().count() == both.count()
    assert clean.top(df, "v", 5, ["sample"]).count() == min(n, 5)


def test_streams(spark, tmp_path, scene):
    S, U, raw = scene
    src = str(tmp_path / "src")
    spark.createDataFrame([(i, r[3:].tolist()) for i, r in enumerate(raw)], "event_id long, spectral array<double>").repartition(3).write.parquet(src)
    stream = spark.readStream.schema("event_id long, spectral array<double>").option("maxFilesPerTrigger", 1).parquet(src)
    panel = Panel(["a", "b", "c"], S)
    for how in ("literal", "kernel"):
        q = unmix_stream(stream, panel, how=how).writeStream.format("memory").queryName(f"u_{how}").trigger(availableNow=True).start()
        q.awaitTermination()
        got = spark.table(f"u_{how}").orderBy("event_id").select("a", "b", "c").toPandas().to_numpy()
        assert np.allclose(got, U)
    with pytest.raises(ValueError):
        unmix_stream(stream, panel, "WLS")
    ts = str(tmp_path / "ts")
    spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id,0) AS ts, id % 2 AS k, CAST(id AS double) AS value FROM range(60)").write.parquet(ts)
    s = spark.readStream.schema("ts timestamp, k long, value double").parquet(ts)
    q = windowed_counts(s, "ts", "k").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("w").count() == 12 and spark.table("w").agg(F.sum("n")).first()[0] == 60


def test_spectra_files(spark, tmp_path):
    path = str(tmp_path / "s.csv")
    spectra_files.write_panel(Panel(["A", "AF"], np.array([[2.0, 1.0], [1.0, 4.0]]), ["x", "y"]), path)
    assert [r["spectrum"] for r in spectra_files.read_spectra(spark, path, ("AF",)).collect()] == [[1.0, 0.5]]
    assert spectra_files.panel(path).S[1].tolist() == [0.25, 1.0]
    m = spectra_files.unmixing_matrix(Panel(["A", "B"], np.array([[1.0, 0.1], [0.2, 1.0]])))
    assert np.allclose(m.S @ np.array([[1.0, 0.1], [0.2, 1.0]]).T, np.eye(2))
    data = np.array([[1.0, 2.0]])
    f = fcs.write(str(tmp_path / "b.fcs"), ["p", "q"], data, {"$SPILL": "2,p,q,1,0.1,0.2,1", "BDSPECTRAL UNMIXED": "DyeX"})
    got = spectra_files.read_embedded(f)
    assert got.names == ["DyeX"] and got.S.tolist() == [[1.0, 0.1]]
    xml = tmp_path / "e.expt"
    xml.write_text("<E><C><_Url>c:\\x\\A1 BV421 (Cells)_Controls.fcs</_Url><_SpilloverVectorArea><float>1</float><float>2</float></_SpilloverVectorArea></C><C><_Url>Unstained (Cells)_Controls.fcs</_Url><_SpilloverVectorArea><float>4</float><float>2</float></_SpilloverVectorArea></C></E>")
    got = spectra_files.read_experiment(str(xml))
    assert got.names == ["BV421", "AF"] and got.S.tolist() == [[0.5, 1.0], [1.0, 0.5]]
    assert spectra_files.read_channels(["a,b", "c"]) == [("a,b", "a_b"), ("c", "c")]
    assert spectra_files.carried_channels(["Time", "V1-A", "V1-H", "FSC-H", "V2-W"], ["V1-A", "V2-A"]) == ["Time", "FSC-H"]
    lib = {"A": np.array([[1.0, 0.0], [1.0, 0.5]]), "B": np.array([[0.0, 1.0]])}
    spectra_files.save_library(spark, str(tmp_path / "lib"), lib, {"A": 1, "B": 2}, {"A": 0.5, "B": 0}, {"A": True, "B": False}, {"A": lib["A"][0], "B": lib["B"][0]})
    with pytest.warns(UserWarning, match="no variation in the spectra of still"):
        assert spectra_files.usable_dyes(["b", "gone", "still", "a"], {"a": 1, "b": 1, "still": 1}, {"a": [0.0, 0.5], "b": [1e-3], "still": [0.0]}) == ["b", "a"]
    kept, thresholds, _, rec = spectra_files.load_library(spark, str(tmp_path / "lib"))
    assert list(kept) == ["A"] and thresholds["B"] == 2 and rec == {"A": True, "B": False}
    g = {"g": [(0.0, 1.0), (2.0, 3.0), (4.0, 0.0)]}
    assert spectra_files.load_gates(spectra_files.save_gates(str(tmp_path / "g.json"), g)) == g
    assert [os.path.isdir(d) for d in spectra_files.make_folders(str(tmp_path), ["x", "y"])] == [True, True]


def test_parameters():
    assert params.parameters("aurora").saturation == 4194304 and params.parameters("opteon").scatter == ("FSC-A", "VSSC-A")
    with pytest.warns(UserWarning):
        assert params.parameters("id7000").cosine_fail == 0.70
    with pytest.raises(ValueError):
        params.parameters("toaster")


def test_weights_and_batches_of_weighted_fits(spark, scene):
    S, U, raw = scene
    df = spark.createDataFrame([(i, r[3:].tolist()) for i, r in enumerate(raw)], "event_id long, spectral array<double>").repartition(5)
    mean = unmix.column_mean(df, "spectral", 5)
    assert np.allclose(mean, raw[:, 3:].mean(0)) and np.allclose(kernels.weights(np.array([0.0, 2.0])), [1e6, 0.5])
    for method in ("WLS", "WLSPerCell", "Poisson"):
        got = unmix.unmix(df, method, Panel(["a", "b", "c"], S)).orderBy("event_id").select("a", "b", "c").toPandas().to_numpy()
        assert np.allclose(got, U, rtol=1e-4, atol=1e-2)


@pytest.mark.parametrize("q", [0.0, 0.01, 0.5, 0.85, 0.975, 1.0])
def test_bracketed_quantiles_are_exact(spark, q):
    from lumenfold.functions.stats import quantiles, with_mad

    rng = np.random.default_rng(1)
    rows = [("a", float(v)) for v in rng.normal(size=5000)] + [("b", float(v)) for v in rng.integers(0, 4, 3000)] + [("c", 7.0), ("d", 1.0), ("d", 2.0), ("e", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    one, two = ({r["k"]: r["x"] for r in quantiles(df, ["k"], "v", q, "x", b).collect()} for b in (False, True))
    assert {k: v for k, v in one.items() if v is not None} == pytest.approx(two)
    assert quantiles(df, [], "v", q, "x", True).first()["x"] == pytest.approx(quantiles(df, [], "v", q, "x", False).first()["x"])
    big = spark.range(250_000).select((F.col("id") % 5).alias("k"), F.xxhash64("id").cast("double").alias("v"))
    one, two = ({r["k"]: r["x"] for r in quantiles(big.where("k = 1 OR id % 2 = 0"), [], "v", q, "x", b).withColumn("k", F.lit(0)).collect()} for b in (False, True))
    assert one == pytest.approx(two)
    if q == 0.5:
        a, b = (sorted(map(tuple, with_mad(df.where("v IS NOT NULL"), ["k"], "v", x).collect())) for x in (False, True))
        assert [r[0] for r in a] == [r[0] for r in b] and np.allclose([r[1:] for r in a], [r[1:] for r in b])


def test_small_helpers(spark, tmp_path):
    assert control.unstained_sources([None, " ", "true", "x.fcs"]) == [("internal", None), ("internal", None), ("global", None), ("file", "x.fcs")]
    p = params.parameters("opteon")
    assert control.scatter_parameters(p) == ["FSC-A", "VSSC-A"]
    (tmp_path / "s.csv").write_text("parameter\nA-A\nB-A\n")
    assert control.scatter_parameters(p, str(tmp_path / "s.csv")) == ["A-A", "B-A"]
    df = spark.range(600).select(F.col("id").alias("event_id"), F.rand(1).alias("FSC-A"))
    assert control.sample_scatter(df, ["FSC-A"], 100).count() == 100
    with pytest.raises(ValueError):
        control.sample_scatter(df.limit(500), ["FSC-A"], 100)


# --- libraries of controls of any size


def embeddings(tmp_path, X, labels):
    import pyarrow as pa
    import pyarrow.parquet as pq

    table = pa.table({"vec_id": pa.array(np.arange(len(X)), pa.int64()), "embedding": pa.array(list(X.astype(np.float32)), pa.list_(pa.float32())), "label": pa.array(labels, pa.int32())})
    pq.write_table(table, tmp_path / "embeddings.parquet")
    return str(tmp_path)


def test_libraries_use_all_events(spark, tmp_path):
    from lumenfold.operators import library, spectra
    from lumenfold.operators.events import dyes_and_background, events
    from lumenfold.plans import library_queries as q

    rng = np.random.default_rng(4)
    # one control of 50,400 events: those last in hash order are unlike the others
    order = [r["id"] for r in spark.range(50_400).orderBy(F.xxhash64("id"), "id").collect()]
    X = rng.normal(0, 0.01, (50_400, 64)) + 0.1
    X[order[50_000:], 7] += 5
    sf = embeddings(tmp_path, X, np.ones(len(X)))
    got = {r["node"]: r["v"] for r in q.som_codebook(spark, sf).where("pos = 7").collect()}
    assert len(got) == 16 and max(got.values()) > 4
    # variants against all unstained events, as from one matrix
    labels = np.arange(2000) % 10
    X = rng.normal(0, 0.02, (2000, 64)) + np.eye(64)[labels] + 0.3 * np.eye(64)[labels + 20] * rng.random((2000, 1))
    sf = embeddings(tmp_path, X, labels)
    ev = events(spark, sf)
    E = np.array([r["x"] for r in ev.orderBy("vec_id").collect()])
    dyes, _ = dyes_and_background(ev)
    got = {(r["label"], r["variant"]): r["delta_norm"] for r in q.variant_library(spark, sf).collect()}
    for n, s in zip(dyes.names, dyes.S, strict=True):
        lib = spectra.variant_library(E[labels == n], E[labels == 0] * 0.1, s / s.max(), dim=2, least_cosine=0.1, least=2)
        assert np.allclose([got[n, i] for i in range(len(lib))], np.linalg.norm(lib - lib[0], axis=1), atol=1e-5)
    # the map of sums by partition is that of one matrix from the same first nodes; libraries start with the mean
    first = np.array([r["x"] for r in ev.orderBy(F.xxhash64(F.lit(1), "vec_id"), "vec_id").limit(16).collect()])

    def sums(code):
        own = np.eye(16)[kernels.nearest(E, code)]
        return own.T @ E, own.sum(0)

    assert np.allclose(library.som(ev.repartition(5), "x", 64, 4, "vec_id"), kernels.som_epochs(first, sums, 4, 20), atol=1e-6)
    plain = library.background_library(ev, "x", dyes.S, "vec_id", dim=3, contaminant=2.0, refine=False)
    more = library.background_library(ev, "x", dyes.S, "vec_id", dim=3, contaminant=2.0)
    assert np.allclose(plain[0], spectra.scale_abs(E.mean(0, keepdims=True))[0]) and np.allclose(more[: len(plain)], plain)


def test_queries_take_the_operators_own_parameters(spark, sf, monkeypatch):
    from lumenfold.plans import library_queries, unmix_queries

    seen, tried = {}, set()
    run, greedy = flow.automated_spectra, kernels.greedy
    monkeypatch.setattr(flow, "automated_spectra", lambda *a, **k: seen.update(k) or run(*a, **k))
    assert library_queries.automated_spectra(spark, sf).count() == 9 * 64 and not {"candidates", "keep", "k"} & set(seen)
    own = unmix.unmix_per_cell_af
    monkeypatch.setattr(unmix, "unmix_per_cell_af", lambda *a, **k: tried.update(k) or own(*a, **k))
    assert unmix_queries.unmix_greedy(spark, sf).count() > 0 and "tries" not in tried and greedy.__defaults__ == (10,)


def test_file_route_equals_the_table_route(spark, tmp_path, monkeypatch):
    """Every method, file to file in several tasks, against unmixing the read table; and files joined or written in parts."""
    rng = np.random.default_rng(21)
    S = rng.random((3, 6)) + 0.1
    S /= S.max(1, keepdims=True)
    n = 1003
    X = rng.random((n, 3)) * 900 @ S + rng.normal(0, 3, (n, 6)) + 40 * rng.random((n, 1))
    detectors = [f"V{i}-A" for i in range(6)]
    path = fcs.write(str(tmp_path / "s.fcs"), ["Time", "FSC-A", *detectors], np.hstack([np.arange(n)[:, None], rng.random((n, 1)), X]), {"$CYT": "x"})
    panel, af = Panel(["a", "b", "c"], S, detectors), Panel(["AF1", "AF2"], rng.random((2, 6)), detectors)
    variants = {"library": {0: S[:1] * (1 + 0.1 * rng.normal(size=(4, 6)))}, "thresholds": [10.0] * 3}
    monkeypatch.setattr(flow, "TASK_EVENTS", 170)
    fcs.register(spark)
    table = fcs.pack(spark.read.format("fcs").load(path), detectors)
    for method, options in (("OLS", {}), ("WLS", {}), ("WLSPerCell", {}), ("Poisson", {}), ("FastPoisson", {}), ("PerCellAF", {"af": af, **variants}), ("Joint", {"af": af, "cell_weight": True, "af_passes": 2, **variants})):
        made = flow.unmix_file(spark, path, str(tmp_path), panel, params.Parameters(), method, weight_events=None, **options)
        names, got = fcs.read_rows(made)
        want = flow.unmix_events(table, panel, method, **options).orderBy("event_id").toPandas()
        assert names[0] == "Time" and (got[:, 0] == np.arange(n)).all()
        assert np.allclose(got, want[names].to_numpy(), rtol=1e-4, atol=1e-2), method
        assert fcs.header(made)["UNMIXINGMETHOD"] == method
    joined = fcs.concatenate([path, path], str(tmp_path / "two.fcs"), rows=300)
    once = fcs.read_rows(path)[1]
    assert (fcs.read_rows(joined)[1] == np.vstack([once, once])).all()
    begin = fcs.prepare(str(tmp_path / "p.fcs"), ["a", "b"], 5, {})
    for at in (3, 0, 3):  # in any order, and again
        fcs.place(str(tmp_path / "p.fcs"), begin, at, np.arange(at * 2, at * 2 + (4 if at else 6)).reshape(-1, 2))
    assert (fcs.read_rows(str(tmp_path / "p.fcs"))[1].ravel() == np.arange(10)).all()
    assert open(tmp_path / "p.fcs", "rb").read().endswith(fcs.TAIL)
