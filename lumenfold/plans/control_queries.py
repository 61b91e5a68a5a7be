"""Queries on the control table, made of the part table: every part is a control row, with flaws by its size and type."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.operators import control
from lumenfold.operators.events import table
from lumenfold.plans.registry import query

FIELDS = {
    "filename": "CASE WHEN p_size % 16 = 15 THEN NULL WHEN p_size % 31 = 1 THEN p_name || '.txt' ELSE replace(p_name, ' ', '_') || '_' || p_brand || '.fcs' END",
    "fluorophore": "CASE WHEN p_size = 1 THEN 'AF' WHEN p_size = 2 THEN 'Negative' WHEN p_size = 3 THEN 'No match' WHEN p_size = 4 THEN NULL ELSE p_brand || '-' || p_size END",
    "marker": "CASE WHEN p_size % 7 = 0 OR p_size < 3 THEN NULL ELSE p_name END",
    "channel": "CASE WHEN p_size % 11 = 0 THEN NULL ELSE 'V' || (p_size % 20) || '-A' END",
    "control_type": "CASE WHEN p_type IN ('ECONOMY', 'SMALL', 'MEDIUM') THEN 'cells' WHEN p_type IN ('PROMO', 'STANDARD') THEN 'beads' WHEN p_size % 5 = 0 THEN NULL ELSE 'particles' END",
    "universal_negative": "CASE WHEN p_size % 3 = 0 THEN NULL ELSE replace(p_name, ' ', '_') || '_Brand#' || (p_size % 30) || '.fcs' END",
    "large_gate": "CASE WHEN p_size % 13 = 0 THEN NULL ELSE p_size > 40 END",
    "is_viability": "p_size % 10 = 9",
    "gate_name": "CASE WHEN p_size % 17 = 0 THEN NULL WHEN p_size % 19 = 0 THEN 'bad/gate' WHEN p_size % 23 = 0 THEN 'Neg' ELSE 'gate ' || p_type END",
    "gate_define": "CASE WHEN p_size % 29 = 0 THEN 'maybe' WHEN p_type = 'SMALL' THEN 'FALSE' WHEN p_size % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END",
}
#: Where a rule that the plain table keeps is broken: other expressions of fields (of headers: ok, cytometer), or "rows", by
#: which the whole table is drawn together into so few rows.
BROKEN = {
    "too_few_rows": {"rows": "1"},
    "low_row_count": {"rows": "p_size > 25"},
    "missing_af": {"fluorophore": "CASE WHEN p_size = 4 THEN NULL ELSE p_brand || '-' || p_size END"},
    "no_universal_negative": {"universal_negative": "CAST(NULL AS STRING)"},
    "no_valid_fcs_headers": {"ok": "false"},
    "cytometer_mismatch": {"cytometer": "'Opteon'"},
    "no_large_gate_set": {"large_gate": "false"},
    "no_viability_set": {"is_viability": "false"},
}


def _expressions(rule: str | None) -> list[str]:
    changed = BROKEN.get(rule, {})
    fields = ["p_partkey", "p_size", "p_type", *[f"{changed.get(n, e)} AS {n}" for n, e in FIELDS.items()]]
    if "rows" not in changed:
        return fields
    return [f"min({e.rpartition(' AS ')[0] or e}) AS {e.rpartition(' AS ')[2]}" for e in fields]


def _tables(rule: str | None = None) -> str:
    """CTEs of the control table and its files' headers."""
    changed = BROKEN.get(rule, {})
    by = f" GROUP BY {changed['rows']}" if changed.get("rows", "1") != "1" else ""
    ctl = f"ctl AS (SELECT {', '.join(_expressions(rule))} FROM part{by})"
    return f"{ctl}, hd AS (SELECT filename, sum(p_size)::BIGINT * 40 AS n_events, {changed.get('cytometer', 'min(p_type)')} AS cytometer, {changed.get('ok', 'max(p_size) < 50')} AS ok FROM ctl WHERE filename IS NOT NULL GROUP BY filename)"


CTL = _tables()
PARAMETERS = [f"V{i}-A" for i in range(15)]


def _control(spark, sf, rule=None):
    part, changed = table(spark, sf, "part"), BROKEN.get(rule, {})
    if "rows" not in changed:
        return part.selectExpr(*_expressions(rule))
    grouped = part.groupBy(F.expr(changed["rows"]).alias("_g")) if changed["rows"] != "1" else part.groupBy()
    return grouped.agg(*[F.expr(e) for e in _expressions(rule)]).drop("_g")


def _headers(c, rule=None):
    changed = BROKEN.get(rule, {})
    cytometer, ok = F.expr(changed.get("cytometer", "min(p_type)")), F.expr(changed.get("ok", "max(p_size) < 50"))
    return c.where("filename IS NOT NULL").groupBy("filename").agg((F.sum("p_size") * 40).alias("n_events"), cytometer.alias("cytometer"), ok.alias("ok"))


def _voltages(c):
    return c.where("filename IS NOT NULL AND channel IS NOT NULL").groupBy("filename", "channel").agg(F.min("p_size").alias("voltage"))


def _issues(spark, sf, rule=None):
    c = _control(spark, sf, rule)
    return control.validate(c.select(control.COLUMNS), _headers(c, rule), _voltages(c), PARAMETERS, "aurora", legacy=True)


BARE = "coalesce(regexp_matches(fluorophore, '(?i)^AF$|negative'), false)"
EXCUSED = "coalesce(regexp_matches(fluorophore, '(?i)AF|negative'), false)"
NEG = "ng AS (SELECT filename AS f, min(coalesce(fluorophore, '~') || chr(1) || coalesce(control_type, '~')) AS m FROM ctl WHERE filename IS NOT NULL GROUP BY filename)"
GATE = "gt AS (SELECT gate_name, bool_or(coalesce(gate_define IN ('TRUE', 'T'), false)) AS d, bool_or(coalesce(gate_define IN ('TRUE', 'T'), false) AND NOT coalesce(upper(fluorophore) IN ('AF', 'NEGATIVE'), false)) AS st, greatest(count(DISTINCT control_type), count(DISTINCT large_gate), count(DISTINCT is_viability)) AS v FROM ctl WHERE gate_name IS NOT NULL GROUP BY gate_name)"
NONE = "NULL::VARCHAR"

#: rule -> (severity, column or None, SQL after SELECT ... : filename expression and FROM clause)
RULES = {
    "missing_filename": ("warning", "filename", "filename", "ctl WHERE filename IS NULL"),
    "non_fcs_filename": ("error", "filename", "filename", "ctl WHERE NOT coalesce(regexp_matches(filename, '(?i)\\.fcs$'), false)"),
    "missing_fluorophore": ("error", "fluorophore", "filename", "ctl WHERE fluorophore IS NULL"),
    "no_match_present": ("error", "fluorophore", "filename", "ctl WHERE fluorophore ILIKE '%no match%'"),
    "af_wrong_type": ("error", "control_type", "filename", "ctl WHERE fluorophore = 'AF' AND coalesce(control_type, '') <> 'cells'"),
    "missing_marker": ("warning", "marker", "filename", f"ctl WHERE marker IS NULL AND NOT {EXCUSED}"),
    "missing_channel": ("error", "channel", "filename", f"ctl WHERE channel IS NULL AND NOT {EXCUSED}"),
    "missing_control_type": ("error", "control_type", "filename", "ctl WHERE control_type IS NULL"),
    "invalid_control_type": ("error", "control_type", "filename", "ctl WHERE control_type NOT IN ('cells', 'beads')"),
    "large_gate_non_cell": ("error", "large_gate", "filename", "ctl WHERE large_gate AND coalesce(control_type, '') <> 'cells'"),
    "viability_non_cell": ("error", "is_viability", "filename", "ctl WHERE is_viability AND coalesce(control_type, '') <> 'cells'"),
    "invalid_gate_characters": ("error", "gate_name", "filename", "ctl WHERE regexp_matches(gate_name, '[^A-Za-z0-9_. ]')"),
    "reserved_gate_name": ("error", "gate_name", "filename", "ctl WHERE upper(gate_name) IN ('AF', 'UNIVERSALNEGATIVE', 'NEG', 'N/A')"),
    "invalid_gate_define": ("error", "gate_define", "filename", "ctl WHERE gate_define NOT IN ('TRUE', 'FALSE', 'T', 'F', '')"),
    "too_few_rows": ("error", None, NONE, "(SELECT count(*) AS n FROM ctl) WHERE n < 2"),
    "low_row_count": ("warning", None, NONE, "(SELECT count(*) AS n FROM ctl) WHERE n = 2"),
    "missing_af": ("error", "filename", NONE, "(SELECT count(*) FILTER (fluorophore = 'AF') AS n FROM ctl) WHERE n = 0"),
    "no_universal_negative": ("warning", "universal_negative", NONE, "(SELECT count(universal_negative) AS n FROM ctl) WHERE n = 0"),
    "duplicate_filename": ("error", "filename", "filename", f"ctl WHERE filename IN (SELECT filename FROM ctl GROUP BY filename HAVING count(*) > 1) AND NOT {BARE}"),
    "duplicate_fluorophore": ("error", "fluorophore", NONE, "(SELECT fluorophore FROM ctl WHERE fluorophore IS NOT NULL GROUP BY 1 HAVING count(*) > 1)"),
    "duplicate_af": ("error", None, "filename", "ctl WHERE fluorophore = 'AF' AND (SELECT count(*) FROM ctl WHERE fluorophore = 'AF') > 1"),
    "universal_negative_missing": ("error", "universal_negative", "filename", "ctl WHERE universal_negative IS NOT NULL AND NOT EXISTS (FROM ng WHERE f = universal_negative)"),
    "invalid_negative_fluorophore": ("error", "universal_negative", "filename", "ctl JOIN ng ON f = universal_negative WHERE NOT regexp_matches(split_part(m, chr(1), 1), '(?i)^AF$|negative')"),
    "negative_type_mismatch": ("error", "universal_negative", "filename", "ctl JOIN ng ON f = universal_negative WHERE split_part(m, chr(1), 2) <> coalesce(control_type, '~')"),
    "fcs_header_read_failed": ("error", None, "filename", "hd WHERE NOT ok"),
    "no_valid_fcs_headers": ("error", None, NONE, "(SELECT count(*) AS n FROM hd WHERE ok) WHERE n = 0"),
    "low_event_count": ("warning", None, "filename", "hd WHERE ok AND n_events < 5000"),
    "very_low_event_count": ("error", None, "filename", "hd WHERE ok AND n_events < 1000"),
    "multiple_cytometers": ("error", None, NONE, "(SELECT count(DISTINCT cytometer) AS n FROM hd WHERE ok) WHERE n > 1"),
    "cytometer_mismatch": ("warning", None, NONE, "(SELECT count(DISTINCT cytometer) AS n, min(cytometer) AS c FROM hd WHERE ok) WHERE n = 1 AND NOT contains(lower(c), 'aurora')"),
    "voltage_mismatch": ("warning", None, "filename", "(SELECT DISTINCT filename FROM (SELECT filename, v, arg_min(v, filename) OVER (PARTITION BY channel) AS r FROM (SELECT filename, channel, min(p_size) AS v FROM ctl WHERE filename IS NOT NULL AND channel IS NOT NULL GROUP BY ALL)) WHERE v <> r)"),
    "channel_parameter_mismatch": ("error", "channel", NONE, "(SELECT count(*) AS n FROM ctl WHERE channel NOT IN (" + ", ".join(f"'{p}'" for p in PARAMETERS) + ")) WHERE n > 0"),
    "no_large_gate_set": ("warning", "large_gate", NONE, "(SELECT coalesce(bool_or(large_gate), false) AS a FROM ctl) WHERE NOT a"),
    "no_viability_set": ("warning", "is_viability", NONE, "(SELECT coalesce(bool_or(is_viability), false) AS a FROM ctl) WHERE NOT a"),
    "incomplete_gate_naming": ("error", "gate_name", NONE, "(SELECT count(*) AS n, count(gate_name) AS g FROM ctl) WHERE g > 0 AND g < n"),
    "no_gate_definition": ("error", None, NONE, "gt WHERE NOT d"),
    "unstained_gate_definition": ("warning", None, NONE, "gt WHERE NOT st"),
    "gate_inconsistency": ("error", None, NONE, "gt WHERE v > 1"),
}


def _rule(rule, severity, column, filename, source):
    col = "NULL::VARCHAR" if column is None else f"'{column}'"
    sql = f"WITH {_tables(rule)}, {NEG}, {GATE} SELECT '{severity}' AS severity, '{rule}' AS rule, {filename} AS filename, {col} AS \"column\" FROM {source}"

    @query(f"rule_{rule}", sql)
    def run(spark, sf):
        return _issues(spark, sf, rule).where(F.col("rule") == rule).select("severity", "rule", "filename", "column")

    run.__doc__ = f"Rows of the control table that break the rule {rule}."
    return run


for _name, _parts in RULES.items():
    _rule(_name, *_parts)


@query("rule_missing_columns", "SELECT 'error' AS severity, 'missing_columns' AS rule, NULL::VARCHAR AS filename, 'marker, universal_negative' AS \"column\"")
def rule_missing_columns(spark, sf):
    return control.validate(_control(spark, sf).select("filename", "fluorophore", "channel", "control_type")).select("severity", "rule", "filename", "column")


@query("issue_summary", f"WITH {CTL}, {NEG}, {GATE} SELECT rule, severity, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{s}' AS severity, '{r}' AS rule FROM {src}" for r, (s, _, _, src) in RULES.items()) + ") GROUP BY ALL")
def issue_summary(spark, sf):
    """All rules at once: how many issues of each."""
    return _issues(spark, sf).groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n"))


DICTIONARY = [("Ring", "ring"), ("Ring", "small ring"), ("Widget", "widget"), ("Gear", "gear"), ("Gear", "hot gear"), ("Anvil", "anvil"), ("Red", "red"), ("Blue bolt", "blue bolt"), ("Bolt", "bolt")]


@query(
    "match_longest",
    "WITH t AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{t}')" for n, t in DICTIONARY) + """) t(name, term)),
    h AS (SELECT p_partkey, name, row_number() OVER (PARTITION BY p_partkey ORDER BY length(term) DESC, name, term) AS r FROM part JOIN t ON regexp_matches(p_name, '(?i)(^|[^A-Za-z0-9-])' || replace(term, ' ', '\\s*') || '([^A-Za-z0-9-]|$)'))
    SELECT p_partkey, coalesce(name, 'No match') AS match FROM part LEFT JOIN (FROM h WHERE r = 1) h USING (p_partkey)""",
)
def match_longest(spark, sf):
    names = spark.createDataFrame(DICTIONARY, "name string, term string")
    return control.match_longest(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", names, "No match").select("p_partkey", "match")


GROUPS = f"""{CTL}, t0 AS (SELECT * REPLACE (coalesce(large_gate, false) AS large_gate, coalesce(is_viability, false) AS is_viability), coalesce(regexp_matches(fluorophore, '(?i)\\bAF\\b|\\bnegative\\b|\\bunstained\\b'), false) AS bare FROM ctl),
cb AS (SELECT *, row_number() OVER (ORDER BY universal_negative NULLS FIRST, control_type NULLS FIRST, is_viability, large_gate) AS g FROM (SELECT DISTINCT universal_negative, control_type, is_viability, large_gate FROM t0)),
t1 AS (SELECT t0.*, cb.g, CASE WHEN t0.is_viability THEN 'viabilityGate' WHEN t0.large_gate THEN 'largeGate' ELSE 'smallGate' END AS lb FROM t0 JOIN cb ON t0.universal_negative IS NOT DISTINCT FROM cb.universal_negative AND t0.control_type IS NOT DISTINCT FROM cb.control_type AND t0.is_viability = cb.is_viability AND t0.large_gate = cb.large_gate),
st AS (SELECT p_partkey, filename, universal_negative, coalesce(gate_name, lb || '_' || g) AS gate_name, fluorophore AS sample FROM t1 WHERE NOT bare),
rf AS (SELECT DISTINCT universal_negative AS f, gate_name AS fg FROM st WHERE universal_negative IS NOT NULL),
br AS (SELECT p_partkey, filename, universal_negative, coalesce(fg, gate_name, lb || '_density_orphan') AS gate_name, fluorophore FROM t1 LEFT JOIN rf ON f = filename WHERE bare),
al AS (FROM st UNION ALL SELECT p_partkey, filename, universal_negative, gate_name, CASE WHEN fluorophore = 'AF' THEN 'AF' ELSE fluorophore || '_' || gate_name END FROM br)"""


def _grouped(spark, sf):
    return control.gate_groups(_control(spark, sf).drop("p_size", "p_type"))


@query("gate_groups", f"WITH {GROUPS} SELECT p_partkey, gate_name, sample FROM al")
def gate_groups(spark, sf):
    return _grouped(spark, sf).select("p_partkey", "gate_name", "sample")


@query(
    "negatives_resolved",
    f"WITH {GROUPS}, ex AS (SELECT filename AS f, gate_name AS g, min(sample) AS s FROM al GROUP BY ALL), lo AS (SELECT filename AS f, min(sample) AS s FROM al GROUP BY ALL) SELECT p_partkey, al.gate_name, coalesce(ex.s, lo.s) AS negative_sample FROM al LEFT JOIN ex ON ex.f = universal_negative AND ex.g = al.gate_name LEFT JOIN lo ON lo.f = universal_negative",
)
def negatives_resolved(spark, sf):
    return _grouped(spark, sf).select("p_partkey", "gate_name", "negative_sample")


@query("channels_intersect", f"WITH {CTL} SELECT DISTINCT channel FROM ctl WHERE channel IN (SELECT 'V' || i || '-A' FROM range(15) t(i))")
def channels_intersect(spark, sf):
    return _control(spark, sf).select("channel").intersect(spark.createDataFrame([(p,) for p in PARAMETERS], "channel string"))


@query("channels_except", f"WITH {CTL} SELECT channel FROM ctl WHERE channel IS NOT NULL EXCEPT SELECT 'V' || i || '-A' FROM range(15) t(i)")
def channels_except(spark, sf):
    known = spark.createDataFrame([(p,) for p in PARAMETERS], "channel string")
    return _control(spark, sf).where("channel IS NOT NULL").select("channel").distinct().join(known, "channel", "left_anti")


@query("channels_union", f"WITH {CTL} SELECT channel FROM ctl WHERE channel IS NOT NULL UNION SELECT 'V' || i || '-A' FROM range(15) t(i)")
def channels_union(spark, sf):
    known = spark.createDataFrame([(p,) for p in PARAMETERS], "channel string")
    return _control(spark, sf).where("channel IS NOT NULL").select("channel").union(known).distinct()


@query("laser_order", f"WITH {CTL} SELECT p_partkey, (row_number() OVER (ORDER BY list_position(['cells', 'beads', 'particles'], control_type) NULLS LAST, p_size, p_partkey))::INT AS ord FROM ctl")
def laser_order(spark, sf):
    """Rows ranked by an explicit list of kinds, then by number: the order of a control table."""
    from pyspark.sql.window import Window

    rank = F.nullif(F.array_position(F.array(F.lit("cells"), F.lit("beads"), F.lit("particles")), F.col("control_type")), F.lit(0))
    return _control(spark, sf).select("p_partkey", F.row_number().over(Window.orderBy(rank.asc_nulls_last(), "p_size", "p_partkey")).alias("ord"))  # a control table: one partition is enough


@query("lookup_left", "SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_nationkey < 20 LEFT JOIN region ON n_regionkey = r_regionkey")
def lookup_left(spark, sf):
    """Left outer lookups in small dictionaries."""
    s, n, r = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    out = s.join(n.where("n_nationkey < 20"), s["s_nationkey"] == n["n_nationkey"], "left").join(r, n["n_regionkey"] == r["r_regionkey"], "left")
    return out.select("s_suppkey", "n_name", "r_name")


@query("semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def semi_join(spark, sf):
    o = table(spark, sf, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(o, "c_custkey", "left_semi").select("c_custkey")


@query("anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def anti_join(spark, sf):
    o = table(spark, sf, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(o, "c_custkey", "left_anti").select("c_custkey")


@query("union_roles", "SELECT event_type, 'bright' AS role, count(*) AS n FROM events WHERE value > 100 GROUP BY 1 UNION ALL SELECT event_type, 'dim' AS role, count(*) AS n FROM events WHERE value <= 100 GROUP BY 1")
def union_roles(spark, sf):
    """Positives and negatives appended under a role."""
    e = table(spark, sf, "events").select("event_type", "value")
    both = e.where("value > 100").withColumn("role", F.lit("bright")).unionByName(e.where("value <= 100").withColumn("role", F.lit("dim")))
    return both.groupBy("event_type", "role").agg(F.count(F.lit(1)).alias("n"))


@query("keyword_map", "SELECT event_id, (props::JSON ->> 'k')::INT AS k, 'k' AS keys FROM events WHERE json_extract_string(props, 'k') IS NOT NULL")
def keyword_map(spark, sf):
    """Keywords as a map: a value by key, and the keys that are kept."""
    e = table(spark, sf, "events").select("event_id", F.from_json("props", "map<string,string>").alias("m"))
    kept = F.map_filter("m", lambda k, v: ~k.startswith("$P"))
    return e.where(F.map_contains_key("m", "k")).select("event_id", F.element_at("m", "k").cast("int").alias("k"), F.array_join(F.map_keys(kept), ",").alias("keys"))
