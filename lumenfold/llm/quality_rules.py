"""Quality rules: a table of thresholds compiled into one projection, without user functions.

Base measures are exact counts of words, symbols, repeated lines and repeated three-word windows. The verdict's measures
are ratios of length, symbols, stop words and lines over the same words; a rule is a row (name, measure, least, most) of
the table and fails where its measure lies outside. No shuffle: a document's row is all a rule reads.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm._common import SPACE

# Frequent short words of the corpus's languages, lower case.
STOP_WORDS = (
    "the be to of and that have with is in it for was are as on by this from at not or an "
    "der die das und ist in den von zu mit im für auf des nicht eine ein dem es "
    "le la les de des et est un une que qui dans en du au pas pour sur "
    "el los las y en que del por un una con no es se para lo"
)

#: (rule, measure, least, most), either bound may be None. A measure that is null (no words, no lines) fails no rule.
RULES = (
    ("word_length", "mean_word_chars", 2.0, 14.0),
    ("symbol_ratio", "symbols_per_word", None, 0.1),
    ("stop_words", "stop_word_ratio", 0.02, None),
    ("distinct_stop_words", "n_stop_words", 2.0, None),
    ("letter_words", "letter_word_ratio", 0.7, None),
    ("exclaimed", "exclaimed_ratio", None, 0.2),
    ("duplicate_lines", "duplicate_line_chars", None, 0.3),
    ("bullet_lines", "bullet_line_ratio", None, 0.9),
    ("open_lines", "ellipsis_line_ratio", None, 0.3),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, inside one expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text) -> Column:
    """Runs of characters other than ASCII white space; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def lines_of(text) -> Column:
    """Lines that have a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: line.rlike(f"[^{SPACE}]"))


def repeated_words(words: Column) -> Column:
    """Words in three-word windows that the text has twice or more, their first occurrence included.

    Windows are sorted with their places; equal neighbours mark places, and each place adds what of its three words the
    place before does not cover.
    """
    places = F.when(F.size(words) >= 3, F.sequence(F.lit(0), F.size(words) - 3)).otherwise(F.array().cast("array<int>"))
    windows = F.transform(places, lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def covered(grams: Column) -> Column:
        ordered = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def same(a, b):
            return F.coalesce(a["g"] == b["g"], F.lit(False))

        # F.get takes no negative place: the first has no neighbour before
        twice = let(ordered, lambda o: F.filter(o, lambda x, k: ((k > 0) & same(x, F.get(o, F.greatest(k - 1, F.lit(0))))) | same(x, F.get(o, k + 1))))
        at = F.sort_array(F.transform(twice, lambda x: x["i"]))
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(at, start, lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(3), i - s["last"])).alias("n")), lambda s: s["n"])

    # most texts repeat no window: then nothing is sorted
    return let(windows, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(covered(g)))


def measured(text, words: Column, lines: Column, stop_words: str = STOP_WORDS) -> dict[str, Column]:
    """Base counts and the measures of the table's rules, as expressions over a document's words and lines."""
    n, whole = F.size(words).cast("long"), F.coalesce(text, F.lit(""))
    # as written or with a capital first, alone or before a comma or a stop: a set to look words up in
    forms = [v + mark for w in dict.fromkeys(stop_words.split()) for v in dict.fromkeys((w, w[:1].upper() + w[1:])) for mark in ("", *".,;:?")]
    found = F.filter(words, lambda w: w.isin(forms))
    n_lines = F.size(lines)

    def ratio(of, over):
        return F.try_divide(of.cast("double"), over.cast("double"))

    def share(xs, pattern):
        return ratio(F.size(F.filter(xs, lambda x: x.rlike(pattern))), F.size(xs))

    chars = F.length(F.array_join(words, "")).cast("long")
    symbols = F.regexp_count(whole, F.lit("[#*$%&|<>]")).cast("long")
    line_chars = F.length(F.array_join(lines, ""))
    repeated_lines = (n_lines - F.size(F.array_distinct(lines))).cast("long")
    return {
        "n_words": n,
        "word_chars": chars,
        "n_symbols": symbols,
        "n_dup_lines": repeated_lines,
        "n_repeat_words": repeated_words(words),
        "mean_word_chars": ratio(chars, n),
        "symbols_per_word": ratio(symbols, n),
        "stop_word_ratio": ratio(F.size(found), n),
        "n_stop_words": F.size(F.array_distinct(F.transform(found, lambda w: F.regexp_replace(F.lower(w), r"[.,;:?]\z", "")))).cast("double"),
        "letter_word_ratio": share(words, r"\p{L}"),
        "exclaimed_ratio": ratio(F.size(F.filter(words, lambda w: w.endswith("!"))), n),
        # by length: of a few short lines one may well come twice
        "duplicate_line_chars": ratio(line_chars - F.length(F.array_join(F.array_distinct(lines), "")), line_chars),
        "bullet_line_ratio": share(lines, f"^[{SPACE}]*[-*•‣·]"),
        "ellipsis_line_ratio": share(lines, rf"(\.\.\.|…)[{SPACE}]*\z"),
    }


def failures(rules=RULES) -> Column:
    """The table as one expression: the names of the rules that a row of measures fails, in the table's order."""
    tests = []
    for name, measure, least, most in rules:
        bad = F.lit(False)
        if least is not None:
            bad = bad | (F.col(measure) < F.lit(float(least)))
        if most is not None:
            bad = bad | (F.col(measure) > F.lit(float(most)))
        tests.append(F.when(bad, F.lit(name)))
    return F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES, least_words: int = 50, most_repeated: int = 50, stop_words: str = STOP_WORDS) -> DataFrame:
    """One row per document: id, base counts (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), base_failed (under
    `least_words` words, or over `most_repeated` per cent of them in repeated windows), kept, failed (names of the rules
    that fail), and the measures.

    Null and empty texts have no words: base_failed. Repeated rows: each is judged. Empty input: no rows. All columns but id
    and text are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def row(words):
        return let(lines_of(F.col("_text")), lambda lines: F.struct(*[c.alias(k) for k, c in measured(F.col("_text"), words, lines, stop_words).items()]))

    rows = rows.select("_id", let(words_of(F.col("_text")), row).alias("m")).select("_id", "m.*")
    base = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    failed = failures(rules)
    first = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rest = [c for c in rows.columns if c not in ("_id", *first)]
    return rows.select(F.col("_id").alias(id_col), *first, base.alias("base_failed"), (~base & (F.size(failed) == 0)).alias("kept"), failed.alias("failed"), *rest)


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by the table above."""
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    tests = [t for name, m, least, most in RULES for t in ([f"coalesce({m} < {least}, false)"] if least is not None else []) + ([f"coalesce({m} > {most}, false)"] if most is not None else [])]
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS.split()))
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, regexp_extract_all(t, '[^{SPACE}]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{SPACE}]')) AS ls FROM d),
    g AS (SELECT r, unnest(range(1, len(ws) - 1)) AS i, ws FROM w),
    c AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) AS n FROM g),
    p AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM c, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY r),
    f AS (
        SELECT *, list_filter(list_transform(list_transform(ws, lambda x: regexp_replace(x, '[.,;:?]\z', '')), lambda x: lower(substr(x, 1, 1)) || substr(x, 2)), lambda x: list_contains([{stops}], x)) AS found
        FROM w
    ),
    m AS (
        SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
               len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
               word_chars / nullif(n_words, 0) AS mean_word_chars, n_symbols / nullif(n_words, 0) AS symbols_per_word,
               len(found) / nullif(n_words, 0) AS stop_word_ratio, len(list_distinct(found)) AS n_stop_words,
               len(list_filter(ws, lambda x: regexp_matches(x, '\p{{L}}'))) / nullif(n_words, 0) AS letter_word_ratio,
               len(list_filter(ws, lambda x: regexp_matches(x, '!\z'))) / nullif(n_words, 0) AS exclaimed_ratio,
               (length(array_to_string(ls, '')) - length(array_to_string(list_distinct(ls), ''))) / nullif(length(array_to_string(ls, '')), 0) AS duplicate_line_chars,
               len(list_filter(ls, lambda x: regexp_matches(x, '^[{SPACE}]*[-*•‣·]'))) / nullif(len(ls), 0) AS bullet_line_ratio,
               len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[{SPACE}]*\z'))) / nullif(len(ls), 0) AS ellipsis_line_ratio
        FROM f LEFT JOIN p USING (r)
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
           n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT base_failed AND NOT ({' OR '.join(tests)}) AS kept
    FROM m
    """


ORACLE = {"op13_quality_rules": _oracle()}
