"""Quality rules against plain Python."""

import re

import pytest

from lumenfold.llm import quality_rules as qr

from .conftest import make

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed), window by window."""
    text = text or ""
    ws = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)} if len(windows) < 3000 else None
    n = len(covered) if covered is not None else 0
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), n, len(ws) < 50 or 100 * n > 50 * len(ws)


def got(spark, df):
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in qr.quality(df).collect())


def test_base_counts(spark, texts, words):
    more = [
        "a b c a b c", "a a a a", "a b c x a b c d e x a b", "# $ | x<y>\n\n \n|\n|\nb", "x\n x\nx\r\nx", "\x1c\x85 \xa0   ", "a\x0bb\x0cc", "<b>" * 40 + " *" * 60,
        "\n".join(["the same line here"] * 30), words(60, 9) + "\n" + words(60, 9), words(60, 9) + "\n" + words(60, 10), "😀 " * 70,
    ]
    df = make(spark, texts + more)
    want = sorted((r["doc_id"] if r["doc_id"] is not None else -1, *plain(r["text"])) for r in df.collect())
    assert got(spark, df) == want
    assert qr.quality(df.limit(0)).count() == 0


def test_verdict(spark):
    prose = "The sea was calm and the boats lay in the bay, waiting for a wind that came from the north. "
    clean = " ".join(prose.replace("sea", f"sea{i}").replace("boats", f"boats{i}").replace("wind", f"wind{i}").replace("calm", f"calm{i}").replace("bay", f"bay{i}").replace("came", f"came{i}") for i in range(5))
    cases = {
        "clean": (clean, []),
        "symbols": (clean.replace(" ", "%%% "), ["symbol_ratio"]),
        "shouted": (" ".join(w.upper() + "!!" for w in clean.split()), ["exclaimed"]),
        "cells": (clean.replace(" ", " | "), ["symbol_ratio", "letter_words"]),
        "bullets": ("\n".join("- " + clean[i : i + 60] for i in range(0, len(clean), 60)), ["bullet_lines"]),
        "teasers": ("\n".join(clean[i : i + 60] + "..." for i in range(0, len(clean), 60)), ["open_lines"]),
        "no stop words": (" ".join(f"wort{i}" for i in range(80)), ["stop_words", "distinct_stop_words"]),
        "long words": (clean.replace("calm", "calm" * 60), ["word_length"]),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "doc_id string, text string")
    rows = {r["doc_id"]: r for r in qr.quality(df).collect()}
    for name, (_, failing) in cases.items():
        assert set(failing) <= set(rows[name]["failed"]), name
        assert rows[name]["kept"] == (not failing), (name, rows[name])
    # another table, another verdict: one expression a row
    strict = {r["doc_id"]: r["kept"] for r in qr.quality(df, rules=(("long", "mean_word_chars", 5.5, None),)).collect()}
    assert not strict["clean"] and {r["failed"][0] for r in qr.quality(df.where("doc_id = 'clean'"), rules=(("long", "mean_word_chars", 5.5, None),)).collect()} == {"long"}
    assert all(r["kept"] != r["base_failed"] for r in qr.quality(df, rules=()).collect())


def test_one_projection(spark, texts):
    """No shuffle, no user function."""
    plan = qr.quality(make(spark, texts))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Python|Arrow|ScalaUDF", plan)


@pytest.mark.parametrize("label, least", [("quality = 1 AND toxic = 0", 0.95), ("quality = 0", None)])
def test_labelled_rows(spark, sf, label, least):
    """Of what the base leaves, clean documents stay and junk goes."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = qr.quality(docs).join(labels, "doc_id").where(f"{label} AND NOT base_failed").collect()
    share = sum(r["kept"] for r in rows) / max(1, len(rows))
    assert share >= least if least else share <= 0.05
