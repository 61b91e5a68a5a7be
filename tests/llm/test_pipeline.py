"""The pipeline's stages on small documents, each against a plain version on its own input."""

import re
from collections import defaultdict

import pytest

import corpus_pipeline as P
from lumenfold.llm._common import written
from lumenfold.llm.queries import ORACLE, QUERIES

from .conftest import make
from .test_dedup import brute_near
from .test_mixing_packing import check_places, spec_targets

SIZE = re.compile(r"[^\x20\x09-\x0d]+")


def rows_of(df):
    return sorted(map(tuple, df.select(P.COLUMNS).collect()), key=repr)


def test_stages_in_turn(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = written(P.drop_toxic(spark, docs, sf), "t")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    gone = {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in kept.collect()}
    clean = [d for d, y in labels.items() if y == 0]
    assert kept.columns == docs.columns and sum(d in gone for d in clean) <= 0.02 * len(clean)
    assert set(rows_of(kept)) <= set(rows_of(docs))

    unique = written(P.drop_copies(spark, kept, sf), "u")
    first = {}
    for r in sorted(kept.collect(), key=lambda r: r["doc_id"]):
        first.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", r["text"] or ""), r)
    assert rows_of(unique) == sorted((tuple(r[c] for c in P.COLUMNS) for r in first.values()), key=repr)

    apart = written(P.drop_near_copies(spark, unique, sf), "a")
    rows = [(r["doc_id"], r["text"]) for r in unique.collect()]
    assert {r["doc_id"] for r in apart.collect()} == {c for _, c, _ in brute_near(rows)}

    mixed = written(P.mix_sources(spark, apart, sf), "m")
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in apart.collect():
        sizes[r["source"]] += len(SIZE.findall(r["text"] or ""))
    copies = defaultdict(int)
    for r in mixed.collect():
        taken[r["source"]] += len(SIZE.findall(r["text"]))
        copies[r["doc_id"]] += 1
    for s, t in spec_targets(sizes).items():
        assert abs(taken[s] - t) <= 1
    assert max(copies.values()) <= 2

    packed = P.pack_sequences(spark, mixed, sf).collect()
    assert sum(r["start"] == 0 for r in packed) == mixed.count() and check_places(packed, 2048) >= sum(r["length"] for r in packed) / 2048


def test_hard_rows(spark, texts, sf):
    """Null, empty, very long and repeated rows, null ids and foreign columns, and no rows at all, in every stage."""
    docs = make(spark, [*texts, *texts])
    for name, stage in P.STAGES:
        out = stage(spark, docs, sf)
        if name != "packing":
            assert out.columns == P.COLUMNS
        assert out.count() > 0
        assert stage(spark, docs.limit(0), sf).count() == 0
    once = P.drop_copies(spark, docs, sf)
    assert once.count() == len({re.sub(r"[\x20\x09-\x0d]+", " ", r["text"] or "") for r in docs.collect()})
    assert P.drop_near_copies(spark, docs, sf).count() == len({c[1:] for c in brute_near([(r["doc_id"], r["text"]) for r in docs.collect()])})


def test_run_is_registered(spark, sf):
    assert QUERIES["pipeline"] is P.run and ("pipeline" in ORACLE) == (P.ORACLE_SQL is not None)
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    assert P.run(spark, sf).count() > 0


@pytest.mark.parametrize("name", [n for n in QUERIES if n.startswith("op") and not n.startswith("op11_")])  # op11's rows are pairs and terms
def test_queries_cover_their_table(spark, sf, name):
    out = QUERIES[name](spark, sf)
    table, key = ("pages", "page_id") if "page_id" in out.columns else ("documents", "doc_id")
    ids = {r[0] for r in spark.read.parquet(f"{sf}/{table}.parquet").select(key).collect()}
    assert {r[0] for r in out.select(key).collect()} == ids
