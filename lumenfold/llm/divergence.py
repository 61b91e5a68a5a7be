"""Source divergence audit: DuckDB aggregates shards of terms, Spark merges their sums and ranks them.

1. Tasks count each document's terms and send (lang, source, term, occurrences, documents), summed over a task.
2. Rows are dealt into shards by (lang, term), so a shard has all of a term. DuckDB sums them and keeps terms of enough
   documents. Spark sums what each source and language holds (N) and the number of kept terms (V).
3. DuckDB gets each shard again with these totals and returns partial pair sums, and the best terms of each source.
4. Spark adds the partial sums, and ranks.

Pair sums stay sparse. Over all kept terms, sum f(p, q) = sum over the item's missing terms and so on: a term that both
sources lack gives f(p0, q0), a constant; one that a single source has gives f of its count against the other's constant,
so counts of counts settle it; only terms of both need their pair, and the shards send these as corrections.
All arithmetic is in integers; products that may pass 63 bits are 128-bit.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenfold.llm._common import lean, written

SCALE = 1_000_000_000
#: ASCII bytes outside A-Z and a-z part terms; A-Z become a-z; all other bytes of UTF-8 stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Terms that a task holds before it sends them on; rows of a shard that DuckDB gets at once; bytes of a text that are split at once.
HELD, CHUNK, SLICE = 300_000, 250_000, 1 << 20

COUNTS = "lang string, source string, term string, n long, docs long"
KEPT = "lang string, source string, term string, n long, first int"
PARTIAL = "lang string, source string, part string, item string, value decimal(38,0)"


def terms_of(text: str) -> Iterator[list[bytes]]:
    """A text's terms as UTF-8, a slice of the text at a time."""
    data = text.encode("utf-8", "surrogatepass").translate(FOLD)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + SLICE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) -> COUNTS, summed over the task as far as it holds them."""
    n, docs = defaultdict(Counter), defaultdict(Counter)

    def send():
        for key in n:
            terms = list(n[key])
            cols = [pa.array([k] * len(terms), pa.string()) for k in key]
            cols += [pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n[key].values(), pa.int64()), pa.array(map(docs[key].__getitem__, terms), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["lang", "source", "term", "n", "docs"])
        n.clear()
        docs.clear()

    held = 0
    for batch in lean(batches):
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            counted, own = n[lang, source], set()
            before = len(counted)
            for some in terms_of(text):
                counted.update(some)
                own.update(some)
            docs[lang, source].update(own)
            held += len(counted) - before
            if held > HELD:
                yield from send()
                held = 0
    yield from send()


def in_duckdb(shard: pa.Table, *queries: str) -> list[pa.Table]:
    import duckdb

    with duckdb.connect(config={"threads": 1, "temp_directory": ""}) as con:
        con.register("shard", shard)
        return [con.sql(q).to_arrow_table() for q in queries]


def chunked(batches: Iterator[pa.RecordBatch], fold: str | None = None, size: int = CHUNK) -> Iterator[pa.Table]:
    """Tables of some `size` rows, cut between terms; rows must come sorted by lang and term. Where one term alone fills a chunk, `fold`
    shrinks it (a query on `shard` that gives rows of the same kind)."""
    held: list[pa.RecordBatch] = []
    rows, most = 0, size
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < most:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        key = [(table["lang"][i].as_py(), table["term"][i].as_py()) for i in (0, rows - 1)]
        if key[0] == key[1]:  # one term
            if fold:
                table = in_duckdb(table, fold)[0].cast(table.schema)
            held, rows = table.to_batches(), table.num_rows
            most = max(size, 2 * rows)
            continue
        low, high = 0, rows - 1  # the first row of the last term
        while low < high:
            mid = (low + high) // 2
            if (table["lang"][mid].as_py(), table["term"][mid].as_py()) == key[1]:
                high = mid
            else:
                low = mid + 1
        yield table.slice(0, low)
        rest = table.slice(low)
        held, rows, most = rest.to_batches(), rest.num_rows, size
    if rows:
        yield pa.Table.from_batches(held)


FOLD_SQL = "SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM shard GROUP BY ALL"
KEEP_SQL = """
SELECT lang, source, term, n, (source = least_source)::INTEGER AS first FROM (
    SELECT lang, source, term, sum(n)::BIGINT AS n, sum(sum(docs)) OVER whole AS docs, min(source) OVER whole AS least_source
    FROM shard GROUP BY lang, source, term WINDOW whole AS (PARTITION BY lang, term)
) WHERE docs >= {least} ORDER BY lang, term, source
"""
#: p of a count: within 1 to SCALE + 1, so that squares of differences fit 64 bits.
P_SQL = f"(1 + {SCALE}::HUGEINT * ({{n}} + 1) // ({{total}}::HUGEINT + v))::BIGINT"
F_SQL = "(({p} - {q}) * ({p} - {q}) // {q})"


def _f(p: str, q: str) -> str:
    return F_SQL.format(p=p, q=q)


ROWS_SQL = f"""
CREATE TEMP TABLE priced AS SELECT *, {P_SQL.format(n='n', total='source_n')} AS p, {P_SQL.format(n='0', total='source_n')} AS p0, {P_SQL.format(n='lang_count', total='lang_n')} AS q
FROM (SELECT *, sum(n) OVER (PARTITION BY lang, term) AS lang_count FROM shard)
"""
PAIRS_SQL = f"""
SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum({_f('a.p', 'b.p')}::HUGEINT - {_f('a.p', 'b.p0')} - {_f('a.p0', 'b.p')} + {_f('a.p0', 'b.p0')})::DECIMAL(38, 0) AS value
FROM priced a JOIN priced b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
"""
TERMS_SQL = f"""
SELECT lang, source, 'term' AS part, term AS item, {_f('p', 'q')}::DECIMAL(38, 0) AS value FROM priced WHERE p > q
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY {_f('p', 'q')} DESC, term) <= {{top}}
"""


def keep_terms(least: int):
    def run(batches):
        for table in chunked(batches, FOLD_SQL):
            yield from in_duckdb(table, KEEP_SQL.format(least=least))[0].to_batches()

    return run


def partial_sums(top: int):
    def run(batches):
        import duckdb

        for table in chunked(batches):
            with duckdb.connect(config={"threads": 1, "temp_directory": ""}) as con:
                con.register("shard", table)
                con.execute(ROWS_SQL)
                for query in (PAIRS_SQL, TERMS_SQL.format(top=top)):
                    yield from con.sql(query).to_arrow_table().to_batches()

    return run


def wide(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(38,0)")


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank) of every (lang, source) that occurs: part `pair` ranks the language's other
    sources by the divergence of the source's terms from theirs, part `term` the up to `top` terms that mark the source in
    its language, by the same measure. Values fall with rank; equal values go by the item's bytes.

    A term is a run of letters (A-Z folded) and of characters beyond ASCII; a language keeps those of at least `least_docs`
    documents. Null text, lang and source count as ''. Repeated rows: each is a document. A source without terms still has its
    pairs; a language without kept terms gives values of 0. Empty input: no rows. Other columns are ignored.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(to) for c, to in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counts = rows.mapInArrow(count_terms, COUNTS)
    kept = counts.repartition("lang", "term").sortWithinPartitions("lang", "term", "source").mapInArrow(keep_terms(least_docs), KEPT)
    kept = written(kept, "divergence-terms")

    # totals: a row per source, and what it lacks
    held = kept.groupBy("lang", "source").agg(F.sum("n").alias("source_n"), F.count(F.lit(1)).alias("n_terms"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.sum("first").alias("v"))  # one row of a term counts it
    groups = rows.select("lang", "source").distinct().join(held, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    groups = written(groups, "divergence-groups")
    known = groups.select("lang", "source", "source_n", "lang_n", "v")
    priced = kept.drop("first").join(known, ["lang", "source"]).repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    parts = written(priced.mapInArrow(partial_sums(top), PARTIAL), "divergence-partial")

    # pairs: constants, terms of one source (by counts of counts), corrections for terms of both
    def p(n, total, v) -> Column:  # exact: decimal division by div
        return F.expr(f"CASE WHEN {v} = 0 THEN 1L ELSE 1L + (CAST({SCALE} AS DECIMAL(38,0)) * ({n} + 1)) div (CAST({total} AS DECIMAL(38,0)) + {v}) END")

    def f(p, q) -> Column:
        return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")

    # lang and v once, then a row for each ordered pair of a language's sources, which the result lists
    a = groups.select("lang", "v", "source", F.col("n_terms").alias("a_terms"), p("0", "source_n", "v").alias("a0"), "source_n")
    b = groups.select("lang", F.col("source").alias("item"), F.col("n_terms").alias("b_terms"), p("0", "source_n", "v").alias("b0"))
    pairs = a.drop("source_n").join(b, "lang").where("source <> item")
    base = pairs.select("lang", "source", "item", (wide(F.col("v") - F.col("a_terms") - F.col("b_terms")) * f("a0", "b0")).cast("decimal(38,0)").alias("value"))
    often = kept.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("times")).join(a, ["lang", "source"]).select("lang", "source", "times", p("n", "source_n", "v").alias("p"))
    single = often.join(b, "lang").where("source <> item")
    there, back = (F.struct(F.col(s).alias("source"), F.col(i).alias("item"), (wide("times") * v).cast("decimal(38,0)").alias("value")) for s, i, v in (("source", "item", f("p", "b0")), ("item", "source", f("b0", "p"))))
    single = single.select("lang", F.inline(F.array(there, back)))
    both = parts.where("part = 'pair'").select("lang", "source", "item", "value")
    sums = base.unionByName(single).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = parts.where("part = 'term'").select("lang", "source", "item", F.col("value").cast("long").alias("value"))
    pair_rows = sums.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    term_rows = best.select("lang", "source", F.lit("term").alias("part"), "item", "value", F.row_number().over(order).alias("rank")).where(F.col("rank") <= top)
    return pair_rows.unionByName(term_rows)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, all languages, all sources."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = {
    "op11_divergence": r"""
    WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    o AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    c AS (SELECT lang, source, term, count(*) AS n FROM o GROUP BY ALL),
    k AS (SELECT lang, term FROM o GROUP BY ALL HAVING count(DISTINCT r) >= 3),
    g AS (SELECT DISTINCT lang, source FROM d),
    v AS (SELECT lang, count(term) AS v FROM (SELECT DISTINCT lang FROM d) LEFT JOIN k USING (lang) GROUP BY lang),
    x AS (SELECT lang, source, term, coalesce(n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
    p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + v) AS p,
                 sum(n) OVER (PARTITION BY lang, term) AS lang_n, sum(n) OVER (PARTITION BY lang) AS total, v FROM x JOIN v USING (lang)),
    q AS (SELECT *, 1 + (1000000000::HUGEINT * (lang_n + 1)) // (total + v) AS q FROM p),
    pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
    every AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b USING (lang) LEFT JOIN pairs ON (pairs.lang, pairs.source, pairs.item) = (a.lang, a.source, b.source) WHERE a.source <> b.source)
    SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM every
    UNION ALL
    SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT, row_number() OVER (PARTITION BY lang, source ORDER BY ((p - q) * (p - q)) // q DESC, term)::INTEGER AS rank
    FROM q WHERE n > 0 AND p > q QUALIFY rank <= 200
    """
}
