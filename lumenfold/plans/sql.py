"""Pieces of DuckDB SQL that the equivalents share: event vectors, class spectra, and inversion of small matrices."""

D = 64

EV = "ev AS (SELECT vec_id, label, list_transform(embedding, lambda z: z::DOUBLE) AS x FROM embeddings)"
LG = "lg AS (SELECT vec_id, label, unnest(range(64)) AS pos, unnest(x) AS v FROM ev)"
MN = "mn AS (SELECT label, pos, avg(v) AS v FROM lg GROUP BY ALL)"
SP = "sp AS (SELECT label, list(v ORDER BY pos) AS s FROM mn GROUP BY label)"
BASE = f"WITH RECURSIVE {EV}, {LG}, {MN}, {SP}"
#: All ten class means as spectra, numbered from 0.
DYES = "dy AS (SELECT label AS i, s FROM sp)"
#: Classes 1 to 9 as dyes, numbered from 0; class 0 in five parts as background, each divided by its largest absolute value.
DYES9 = "dy AS (SELECT label - 1 AS i, s FROM sp WHERE label > 0)"
AF = """afl AS (SELECT vec_id % 5 AS j, pos, avg(v) AS v FROM lg WHERE label = 0 GROUP BY ALL),
afm AS (SELECT j, max(abs(v)) AS m FROM afl GROUP BY j),
af AS (SELECT j, list(v / m ORDER BY pos) AS a FROM afl JOIN afm USING (j) GROUP BY j)"""


def pinv(n: int, dyes: str = "dy", out: str = "pp", weights: str | None = None) -> str:
    """CTEs up to out(i, p): rows of (S W S')^-1 S W for dyes(i, s), by Gauss-Jordan elimination. weights: a CTE with one list w."""
    if weights:
        sw = f"{out}_w AS (SELECT i, s, list_transform(list_zip(s, (SELECT w FROM {weights})), lambda z: z[1] * z[2]) AS sw FROM {dyes})"
    else:
        sw = f"{out}_w AS (SELECT i, s, s AS sw FROM {dyes})"
    return f"""{sw},
{out}_g AS (SELECT a.i, b.i AS j, list_dot_product(a.sw, b.s) AS v FROM {out}_w a, {out}_w b
  UNION ALL SELECT i, {n} + unnest(range({D})), unnest(sw) FROM {out}_w),
{out}_e AS (SELECT 0 AS k, i, list(v ORDER BY j) AS r FROM {out}_g GROUP BY i
  UNION ALL SELECT e.k + 1, e.i, CASE WHEN e.i = p.i THEN list_transform(p.r, lambda z: z / p.r[p.i + 1])
    ELSE list_transform(list_zip(e.r, p.r), lambda z: z[1] - z[2] * e.r[p.i + 1] / p.r[p.i + 1]) END
  FROM {out}_e e JOIN {out}_e p ON p.k = e.k AND p.i = e.k WHERE e.k < {n}),
{out} AS (SELECT i, r[{n + 1}:] AS p FROM {out}_e WHERE k = {n})"""


def wide(n: int, expr: str, prefix: str = "u", digits: int = 6) -> str:
    """Columns prefix0.. : expr with {i} replaced, rounded."""
    return ", ".join(f"round({expr.format(i=i)}, {digits}) + 0.0 AS {prefix}{i}" for i in range(n))
