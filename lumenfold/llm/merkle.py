"""Merkle manifest of a dataset: a sparse-forest monoid reduced over partitions.

A document's leaf is the hash of its fields. Leaves of a source, in order of id, are a tree of runs of ARITY children; the
sources' roots, in order of source, are one more. The size of every level follows from the number of leaves, so each run's
arity is known beforehand.

A fragment holds nodes, keyed by (tree, level, index), whose run is not complete in it. Joining two fragments puts their nodes
together and, wherever a run is complete, replaces it by its parent, as long as one completes: associative, with the empty
fragment as unit. Partitions hold consecutive leaves, so a fragment of some consecutive partitions has a few nodes a level.

1. Leaves are hashed in the JVM, ordered by (source, id) into range partitions of bounded size, and written.
2. Each partition folds its leaves into a fragment; fragments are joined FAN at a time, round by round, down to one (a tree
   reduce whose rounds are written tables). Every node that a fragment ever held open is kept: a logarithmic number a partition.
3. Proofs: each partition folds its leaves again and takes from those kept nodes what its leaves' paths need from outside.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenfold.llm._common import written

ARITY = 3
#: Most leaves of a range partition by plan (some 500 bytes each where it is folded), fewest where the session has partitions to
#: spare, and fragments that one task joins.
ROWS, LEAST, FAN = 100_000, 1_000, 32
#: The tree of the sources' roots; all others have their source's number.
TOP = -1

NODES = "tree long, level int, idx long, digest string"


def field(c) -> Column:
    """- for null, else the UTF-8 length, a colon and the value."""
    text = F.col(c).cast("string") if isinstance(c, str) else c
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def level_sizes(n: int, arity: int = ARITY) -> list[int]:
    """Nodes on each level of a tree with n leaves, its root the last."""
    sizes = [n]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // arity))
    return sizes


class Forest:
    """The monoid: nodes by (tree, level, index), of trees whose numbers of leaves are known."""

    def __init__(self, leaves: dict[int, int], arity: int = ARITY):
        self.sizes = {tree: level_sizes(n, arity) for tree, n in leaves.items()}
        self.arity = arity

    def run(self, tree: int, level: int, index: int) -> list[tuple[int, int, int]]:
        """The keys of a node's run, itself among them."""
        first = index - index % self.arity
        return [(tree, level, i) for i in range(first, min(first + self.arity, self.sizes[tree][level]))]

    def parent(self, tree: int, level: int, index: int) -> tuple[int, int, int] | None:
        if level + 1 < len(self.sizes[tree]):
            return tree, level + 1, index // self.arity
        return (TOP, 0, tree) if tree != TOP else None

    def join(self, nodes: dict[tuple[int, int, int], str]) -> dict[tuple[int, int, int], str]:
        """All nodes that follow from these, the given ones included."""
        known = dict(nodes)
        work = list(nodes)
        while work:
            key = work.pop()
            up = self.parent(*key)
            if up is None or up in known:
                continue
            if up[0] != key[0]:  # a source's root is a leaf of the top tree as it is
                known[up] = known[key]
                work.append(up)
                continue
            run = self.run(*key)
            if all(k in known for k in run):
                known[up] = sha256("".join([known[k] for k in run]).encode()).hexdigest()
                work.append(up)
        return known

    def open(self, known: dict[tuple[int, int, int], str]) -> list[tuple[int, int, int]]:
        """Keys without a parent among them: what a fragment has to hand on. The whole forest's root is one, too."""
        return [k for k in known if (up := self.parent(*k)) is None or up not in known]

    def path(self, tree: int, index: int) -> list[list[tuple[int, int, int]]]:
        """The runs from a leaf to the root of all; runs of one node too."""
        out = []
        key: tuple[int, int, int] | None = (tree, 0, index)
        while key is not None:
            up = self.parent(*key)
            if up is not None and up[0] == key[0]:
                out.append((key, self.run(*key)))
            key = up
        return out

    def ends(self, tree: int) -> list[tuple[int, int, int]]:
        """Keys of the tree's own root and of the root of all."""
        return [(tree, len(self.sizes[tree]) - 1, 0), (TOP, len(self.sizes[TOP]) - 1, 0)]


def spans_of(ordered: DataFrame) -> DataFrame:
    """ordered(part, source): (part, source, tree, first, n, n_trees), a row for each partition and source in it: the source's
    number, the place of the partition's first leaf in it, its number of leaves, the number of sources. A row a part and
    source passes the windows, and a row a part the one over all parts."""
    spans = ordered.groupBy("part", "source").agg(F.count(F.lit(1)).alias("here"))
    own = Window.partitionBy("source")
    before = own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("part", "source", "here", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("first"), F.sum("here").over(own).alias("n"))
    spans = written(spans, "merkle-spans")
    starts = spans.groupBy("part").agg(F.count_if(F.col("first") == 0).alias("starts"))
    up_to = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    starts = starts.select("part", F.coalesce(F.sum("starts").over(up_to), F.lit(0)).alias("sources_before"), F.sum("starts").over(Window.partitionBy()).alias("n_trees"))
    inside = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_first())
    new = F.sum((F.col("first") == 0).cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # the source that a part begins with may have begun before: then it is the last one counted there
    return spans.join(starts, "part").select("part", "source", (F.col("sources_before") + new - 1).cast("long").alias("tree"), "first", "n", "n_trees")


def _forest(spans: pa.Table, arity: int) -> Forest:
    leaves = dict(zip(spans["tree"].to_pylist(), spans["n"].to_pylist(), strict=True))
    n_trees = spans["n_trees"][0].as_py() if spans.num_rows else 0
    return Forest({**leaves, TOP: n_trees}, arity)


def _leaves(rows: pa.Table, spans: pa.Table) -> tuple[pa.Table, list[tuple[int, int]]]:
    """A partition's rows in order, nulls first, and each row's (tree, place in it)."""
    rows = rows.take(pc.sort_indices(rows, sort_keys=[(k, "ascending") for k in ("source", "doc_id", "leaf")], null_placement="at_start"))
    tree, following = ({s: v for s, v in zip(spans["source"].to_pylist(), spans[c].to_pylist(), strict=True)} for c in ("tree", "first"))
    places = []
    for source in rows["source"].to_pylist():
        places.append((tree[source], following[source]))
        following[source] += 1
    return rows, places


def _fold(rows: pa.Table, spans: pa.Table, arity: int):
    forest = _forest(spans, arity)
    rows, places = _leaves(rows, spans)
    return forest, rows, places, forest.join({(t, 0, i): d for (t, i), d in zip(places, rows["leaf"].to_pylist(), strict=True)})


def _nodes_table(part: int, keys, known, forest: Forest, kind: str) -> pa.Table:
    keys = list(keys)
    return pa.table({
        "part": pa.array([part] * len(keys), pa.int64()), "kind": pa.array([kind] * len(keys), pa.string()),
        "tree": pa.array([k[0] for k in keys], pa.int64()), "level": pa.array([k[1] for k in keys], pa.int32()), "idx": pa.array([k[2] for k in keys], pa.int64()),
        "digest": pa.array([known[k] if known else None for k in keys], pa.string()),
        "n": pa.array([forest.sizes[k[0]][0] for k in keys], pa.int64()), "n_trees": pa.array([forest.sizes[TOP][0]] * len(keys), pa.int64()),
    })


FRAGMENT = "part long, kind string, tree long, level int, idx long, digest string, n long, n_trees long"


def local_fragments(arity: int):
    """Per partition: its open nodes, and the keys that its leaves' paths need from others."""

    def run(rows: pa.Table, spans: pa.Table) -> pa.Table:
        part = spans["part"][0].as_py()
        forest, _, places, known = _fold(rows, spans, arity)
        edges: dict[int, tuple[int, int]] = {}
        for t, i in places:  # first and last leaf of each tree
            edges[t] = (edges[t][0] if t in edges else i, i)
        wanted = set()
        for t, ends in edges.items():
            for i in dict.fromkeys(ends):
                wanted.update(k for _, run in forest.path(t, i) for k in run)
            wanted.update(forest.ends(t))
            wanted.add((TOP, 0, t))
        return pa.concat_tables([_nodes_table(part, forest.open(known), known, forest, "open"), _nodes_table(part, (k for k in wanted if k not in known), None, forest, "need")])

    return run


def join_fragments(arity: int):
    """Per group of fragments: the nodes that are new (kind `new`) and those still open (`open`)."""

    def run(rows: pa.Table) -> pa.Table:
        group = rows["part"][0].as_py()
        cols = {c: rows[c].to_pylist() for c in ("tree", "level", "idx", "digest", "n")}
        forest = Forest({**dict(zip(cols["tree"], cols["n"], strict=True)), TOP: rows["n_trees"][0].as_py()}, arity)
        given = dict(zip(zip(cols["tree"], cols["level"], cols["idx"], strict=True), cols["digest"], strict=True))
        known = forest.join(given)
        return pa.concat_tables([_nodes_table(group, (k for k in known if k not in given), known, forest, "new"), _nodes_table(group, forest.open(known), known, forest, "open")])

    return run


PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"


def proofs(arity: int):
    """Per partition: each row's proof, folded from its tampered or else its own leaf."""

    def run(rows: pa.Table, side: pa.Table) -> pa.Table:
        is_span = pc.equal(side["kind"], "span")
        spans, extra = side.filter(is_span), side.filter(pc.invert(is_span))
        forest, rows, places, known = _fold(rows, spans, arity)
        known.update(zip(zip(*(extra[c].to_pylist() for c in ("tree", "level", "idx")), strict=True), extra["digest"].to_pylist(), strict=True))
        tampered, leaves = rows["tampered"].to_pylist(), rows["leaf"].to_pylist()
        out: dict[str, list] = {"subroot": [], "root": [], "proof_sha256": [], "folded_root": []}
        for (tree, index), leaf, other in zip(places, leaves, tampered, strict=True):
            subroot, root = (known[k] for k in forest.ends(tree))
            proof, digest = [], other or leaf
            for key, run in forest.path(tree, index):
                around = [digest if k == key else known[k] for k in run]
                proof += [d for k, d in zip(run, around, strict=True) if k != key]
                digest = sha256("".join(around).encode()).hexdigest()
            for name, value in zip(out, (subroot, root, sha256("".join(proof).encode()).hexdigest(), digest), strict=True):
                out[name].append(value)
        return pa.table({"doc_id": rows["doc_id"], "leaf": rows["leaf"], **{k: pa.array(v, pa.string()) for k, v in out.items()}})

    return run


def manifest(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", source_col: str = "source", changed: dict[str, Column] | None = None, changed_where: Column | None = None, arity: int = ARITY, rows_per_part: int = ROWS) -> DataFrame:
    """One row per document: id, leaf, subroot (its source's), root (of all), proof_sha256 (hash of the siblings on its path,
    level by level to the root, left to right), folded_root (the path folded again, from the leaf with the `changed` columns
    where `changed_where` holds, else from the leaf itself), verified (folded_root equals root).

    Ids are whole numbers. Null fields hash as `-`; null sources are a source of their own, first in order; null ids come first
    in their source; rows with one id go by leaf, and equal rows, whose order no column shows, differ in their proofs alone. A
    source of one row has its leaf as subroot; with one source the subroot is the root. Empty input: no rows. Other columns
    are ignored, whatever their names.
    """
    leaf = leaf_of([F.col(c).cast("string") for c in columns])
    other = F.lit(None).cast("string")
    if changed:
        where = F.lit(True) if changed_where is None else changed_where
        other = F.when(where, leaf_of([changed[c].cast("string") if c in changed else F.col(c).cast("string") for c in columns]))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), leaf.alias("leaf"), other.alias("tampered"))
    rows = written(rows, "merkle-leaves")
    keys = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), "leaf", "row"]
    n = rows.count()
    parts = max(1, -(-n // rows_per_part), min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // min(LEAST, rows_per_part)))
    # a number of its own parts equal rows, too; equal hot rows would else share a range
    ordered = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).withColumn("part", F.spark_partition_id().cast("long"))
    ordered = written(ordered, "merkle-ordered")
    spans = written(spans_of(ordered.select("part", "source")), "merkle-numbers")

    first = ordered.select("part", "source", "doc_id", "leaf").groupBy("part").cogroup(spans.groupBy("part")).applyInArrow(local_fragments(arity), FRAGMENT)
    first = written(first, "merkle-fragments")
    opened = first.where("kind = 'open'")
    kept = [opened]
    left = parts
    while left > 1:  # the rounds of the tree reduce
        left = -(-left // FAN)
        grouped = opened.withColumn("part", F.floor(F.col("part") / FAN))
        joined = written(grouped.groupBy("part").applyInArrow(join_fragments(arity), FRAGMENT), "merkle-round")
        kept.append(joined.where("kind = 'new'"))
        opened = joined.where("kind = 'open'")
    nodes = kept[0]
    for more in kept[1:]:
        nodes = nodes.unionByName(more)

    key = ["tree", "level", "idx"]
    wanted = first.where("kind = 'need'").select("part", *key).join(nodes.select(*key, "digest"), key)
    nothing = {c: F.lit(None).cast(t) for c, t in (("source", "string"), ("first", "long"), ("n", "long"), ("n_trees", "long"), ("level", "int"), ("idx", "long"), ("digest", "string"))}
    side_columns = ["part", "kind", "source", "tree", "first", "n", "n_trees", "level", "idx", "digest"]
    span_rows = spans.withColumns({"kind": F.lit("span"), **{c: nothing[c] for c in ("level", "idx", "digest")}}).select(side_columns)
    node_rows = wanted.withColumns({"kind": F.lit("node"), **{c: nothing[c] for c in ("source", "first", "n", "n_trees")}}).select(side_columns)
    out = ordered.groupBy("part").cogroup(span_rows.unionByName(node_rows).groupBy("part")).applyInArrow(proofs(arity), PROOFS)
    return out.select(F.col("doc_id").alias(id_col), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; where 2 divides the checksum of the id, a copy without line ends is held against its proof."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return manifest(docs, changed={"text": F.replace("text", F.lit("\n"), F.lit(""))}, changed_where=even)


# crc32 has no function in DuckDB: eight steps a byte.
_STEP = "lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
ORACLE = {
    "op12_merkle": rf"""
    WITH RECURSIVE field AS (
        SELECT row_number() OVER () AS r, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS idx, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
               array_to_string(list_transform([doc_id::VARCHAR, source, lang, n_chars::VARCHAR], lambda x: coalesce(octet_length(encode(x)) || ':' || x, '-')), '') AS head,
               xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[], {_STEP}, xor(c, b)), 4294967295::BIGINT), 4294967295) AS crc
        FROM documents
    ),
    leaves AS (
        SELECT *, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
               sha256(head || coalesce(octet_length(encode(replace(text, chr(10), ''))) || ':' || replace(text, chr(10), ''), '-')) AS cut
        FROM field
    ),
    own(tree, level, idx, digest, n) AS (
        SELECT tree, 0, idx, leaf, count(*) OVER (PARTITION BY tree) FROM leaves
        UNION ALL
        SELECT tree, level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (n + 2) // 3 FROM own WHERE n > 1 GROUP BY tree, level, idx // 3, n
    ),
    top(level, idx, digest, n) AS (
        SELECT 0, tree, digest, (SELECT count(DISTINCT tree) FROM leaves) FROM own WHERE n = 1
        UNION ALL
        SELECT level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (n + 2) // 3 FROM top WHERE n > 1 GROUP BY level, idx // 3, n
    ),
    nodes AS (SELECT * FROM own UNION ALL SELECT -1, * FROM top),
    around AS (
        SELECT tree, level, idx, n, coalesce(string_agg(digest, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
               coalesce(string_agg(digest, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
        FROM nodes WINDOW run AS (PARTITION BY tree, level, idx // 3 ORDER BY idx)
    ),
    walk(r, tree, level, idx, digest, proof, src) AS (
        SELECT r, tree, 0, idx, CASE WHEN crc % 2 = 0 THEN cut ELSE leaf END, '', tree FROM leaves
        UNION ALL
        SELECT w.r, CASE WHEN n > 1 THEN w.tree ELSE -1 END, CASE WHEN n > 1 THEN w.level + 1 ELSE 0 END, CASE WHEN n > 1 THEN w.idx // 3 ELSE w.tree END,
               CASE WHEN n > 1 THEN sha256(a.l || digest || a.r) ELSE digest END, CASE WHEN n > 1 THEN proof || a.l || a.r ELSE proof END, src
        FROM walk w JOIN around a ON (a.tree, a.level, a.idx) = (w.tree, w.level, w.idx) WHERE n > 1 OR w.tree >= 0
    ),
    root AS (SELECT digest AS root FROM top WHERE n = 1)
    SELECT doc_id, leaf, s.digest AS subroot, root, sha256(proof) AS proof_sha256, w.digest AS folded_root, w.digest = root AS verified
    FROM walk w JOIN around a ON (a.tree, a.level, a.idx) = (w.tree, w.level, w.idx) AND w.tree = -1 AND n = 1 JOIN leaves ON leaves.r = w.r
    JOIN (SELECT tree, digest FROM own WHERE n = 1) s ON s.tree = src, root
    """
}
