"""Best-fit packing of tokenised documents into fixed-length sequences, in bulk-synchronous supersteps.

Documents become pieces of at most `capacity` tokens. Pieces of one length are interchangeable, and so are open sequences
with equal gaps (free room): both are kept as runs, so a superstep moves at most a few thousand rows whatever the corpus size.

1. Phases of falling length: first the pieces over half of the capacity, then those over a quarter, and so on.
2. In a superstep the sizes are cut into ranges; a range's pieces and gaps meet in one task, which sweeps its pieces from
   the longest down, each to its successor, the smallest gap that holds it. Pieces of equal claim are resolved by rank.
3. Gaps shrink and change ranges. Pieces without a gap in their range go to the next superstep, where ranges are twice as
   wide; those that no gap anywhere holds open sequences, best fit among the new ones.
4. At the end, ranks within each length (computed in executors) tie pieces to the places of their length.
"""

from __future__ import annotations

import bisect
import functools
import json
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm._common import lean, parts_for, process_cache, ranked, written

PIECES = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"


def tokenizer(path: str):
    """A function from text to uint32 ids of the byte-level BPE in a tokenizers JSON file; special tokens' strings are text.

    The merges run in tiktoken, over ranks read from the same file (four times faster, same ids); texts with runs of
    over 5,000 characters that are no white space, or that it fails on, go through tokenizers itself.
    """
    cache = process_cache()
    if path in cache:
        return cache[path]
    import re

    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in visible}
    byte_of |= {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(visible)))}
    special = {t["content"] for t in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    del spec
    fast = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    long_run = re.compile(r"\S{5000}|\s{5000}")

    def slow(text: str) -> list[int]:
        if "slow" not in cache:  # seldom needed
            from tokenizers import Tokenizer

            cache["slow"] = Tokenizer.from_file(path)
            cache["slow"].encode_special_tokens = True
        return cache["slow"].encode(text, add_special_tokens=False).ids

    def encode(text: str) -> np.ndarray:
        if len(text) < 5000 or not long_run.search(text):
            try:
                return fast.encode_to_numpy(text, disallowed_special=())
            except (ValueError, RuntimeError):
                pass
        return np.array(slow(text), dtype="<u4")

    cache[path] = encode
    return encode


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole if it fits, else full pieces after a first that may be shorter."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece; `row` numbers the input rows, so repeated ids stay apart. Null text: just the end token."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))

    def run(batches):
        encode = tokenizer(tokenizer_path)
        end = np.array([end_id], dtype="<u4")
        for batch in lean(batches):
            out = []
            for doc, row, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                ids = np.concatenate([encode(text or ""), end]).astype("<u4", copy=False)
                for k, (start, n) in enumerate(cut(len(ids), capacity)):
                    out.append((doc, row, k, start, n, zlib.crc32(ids[start : start + n].tobytes())))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = zip(*out, strict=True) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "row", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(run, PIECES)


#: Ranges of sizes in the first superstep of a phase; halved in each further one.
RANGES = 32
STATE = "task int, kind string, size long, first long, n long"
FOUND = "kind string, size long, first long, n long, each long, offset long"


def sweep(pieces: list[tuple[int, int]], gaps: list[tuple[int, int, int]], capacity: int, opened: int | None = None):
    """Best fit of runs of pieces (length, n), longest first, to runs of gaps (size, first sequence, n).

    Returns (places, gaps left, pieces left); a place (length, first, n, each, offset): n sequences from `first` on take
    `each` pieces from `offset` on. With `opened`, pieces that no gap holds open sequences from that number on.
    """
    sizes: list[int] = []  # gap sizes that occur, ascending
    by_size: dict[int, list[tuple[int, int]]] = {}
    places, left = [], []

    def put(size: int, first: int, n: int) -> None:
        if size and n:
            if size not in by_size:
                bisect.insort(sizes, size)
                by_size[size] = []
            by_size[size].append((first, n))

    for size, first, n in sorted(gaps):
        put(size, first, n)
    for length, count in sorted(pieces, reverse=True):
        while count:
            at = bisect.bisect_left(sizes, length)
            if at == len(sizes):
                if opened is None:
                    left.append((length, count))
                    break
                n = -(-count // (capacity // length))
                put(capacity, opened, n)
                opened += n
                continue
            size = sizes[at]
            first, n = by_size[size].pop()
            each = min(size // length, count)
            use = min(n, count // each)
            if not by_size[size]:
                del by_size[size]
                sizes.pop(at)
            put(size, first + use, n - use)
            places.append((length, first, use, each, capacity - size))
            count -= use * each
            put(size - each * length, first, use)
    return places, [(size, first, n) for size in sizes for first, n in by_size[size]], left


def superstep(spark: SparkSession, tasks: list[tuple[int, list, list, int | None]], capacity: int) -> list[tuple]:
    """Sweeps of all tasks (number, pieces, gaps, opened), as one job; tasks of no consequence are left out by the caller."""
    rows = [(k, "piece", length, 0, n) for k, pieces, _, _ in tasks for length, n in pieces]
    rows += [(k, "gap", size, first, n) for k, _, gaps, _ in tasks for size, first, n in gaps]
    rows += [(k, "open", 0, opened, 0) for k, _, _, opened in tasks if opened is not None]

    def run(pdf):
        part = {kind: list(zip(*(g[c].tolist() for c in ("size", "first", "n")), strict=True)) for kind, g in pdf.groupby("kind")}
        opened = part["open"][0][1] if "open" in part else None
        places, gaps, left = sweep([(size, n) for size, _, n in part.get("piece", [])], part.get("gap", []), capacity, opened)
        out = [("place", *p) for p in places] + [("gap", *g, 0, 0) for g in gaps] + [("piece", length, 0, n, 0, 0) for length, n in left]
        return pd.DataFrame(out, columns=["kind", "size", "first", "n", "each", "offset"])

    state = spark.createDataFrame(rows, STATE)
    return [tuple(r) for r in state.groupBy("task").applyInPandas(run, FOUND).collect()]  # runs, not pieces: a few thousand rows


def merged(gaps: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs of gaps, neighbours of one size joined."""
    out: list[list[int]] = []
    for size, first, n in sorted(gaps):
        if out and out[-1][0] == size and out[-1][1] + out[-1][2] == first:
            out[-1][2] += n
        else:
            out.append([size, first, n])
    return [tuple(g) for g in out]


def place(counts: dict[int, int], capacity: int, step) -> dict[str, np.ndarray]:
    """Places of all pieces. counts: pieces by length; step: superstep over (tasks, capacity).

    Returns runs: pieces of `length` with ranks from `rank` go `each` at a time to sequences from `seq`, at `offset`;
    sorted by (length, rank); and the number of sequences and supersteps.
    """
    gaps: list[tuple[int, int, int]] = []
    places: list[tuple] = []
    opened = steps = 0
    over = capacity // 2
    todo = dict(counts)
    while todo:
        active = [(length, todo.pop(length)) for length in sorted(todo) if length > over]
        over //= 2
        ranges = RANGES
        while active:
            width = -(-capacity // ranges)
            tasks: dict[int, tuple[list, list]] = {}
            for length, n in active:
                tasks.setdefault((length - 1) // width, ([], []))[0].append((length, n))
            least = {k: min(length for length, _ in p) for k, (p, _) in tasks.items()}
            rest = []
            for g in gaps:
                k = (g[0] - 1) // width
                if k in tasks and g[0] >= least[k]:
                    tasks[k][1].append(g)
                else:
                    rest.append(g)
            meet = [(k, p, g, None) for k, (p, g) in tasks.items() if g]
            alone = [x for p, g in tasks.values() if not g for x in p]
            largest = max((g[0] for g in gaps), default=0)
            if not meet and all(length > largest for length, _ in active):  # no gap holds any: open
                meet, alone = [(0, active, [], opened)], []
            if meet:
                active, gaps = alone, rest
                steps += 1
                for kind, size, first, n, each, offset in step(meet, capacity):
                    if kind == "piece":
                        active.append((size, n))
                    elif kind == "gap":
                        gaps.append((size, first, n))
                    else:
                        places.append((size, first, n, each, offset))
                        opened = max(opened, first + n)
                gaps = merged(gaps)
            ranges = max(1, ranges // 2)
    places.sort()
    rank, out = 0, []
    for i, (length, first, n, each, offset) in enumerate(places):
        rank = 0 if i == 0 or places[i - 1][0] != length else rank
        out.append((length, rank, each, first, offset))
        rank += n * each
    names = ("length", "rank", "each", "seq", "offset")
    return dict(zip(names, np.array(out, dtype=np.int64).reshape(-1, 5).T, strict=True)) | {"sequences": np.array([opened]), "steps": np.array([steps])}


def pack(parts: DataFrame, capacity: int) -> DataFrame:
    """parts: a written table of pieces. Adds sequence_id and offset (gapless from 0 in every sequence).

    Empty input: no rows. Ties: pieces of one length take places in the order of (hash part, doc_id, row, piece).
    """
    by_length = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    runs = place(by_length, capacity, functools.partial(superstep, parts.sparkSession))
    total = sum(by_length.values())
    # lengths with many pieces are ranked in many parts
    deal = F.get(F.from_json(F.lit(json.dumps([parts_for(by_length.get(n, 0)) for n in range(capacity + 1)])), "array<int>"), F.col("length").cast("int"))
    ordered = ranked(parts, ["length"], ["doc_id", "row", "piece"], deal)
    stride = max(total, 1) + 1
    keys = runs["length"] * stride + runs["rank"]  # ascending

    def run(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            length, rank = t["length"].to_numpy(), t["rank"].to_numpy()
            at = np.searchsorted(keys, length * stride + rank, side="right") - 1
            turn, inside = np.divmod(rank - runs["rank"][at], runs["each"][at])
            t = t.drop_columns(["rank", "row"])
            t = t.append_column("sequence_id", pa.array(runs["seq"][at] + turn)).append_column("offset", pa.array(runs["offset"][at] + inside * length))
            yield from t.to_batches()

    columns = [c for c in parts.columns if c != "row"]
    kinds = dict(parts.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns) + ", sequence_id bigint, offset bigint"
    return ordered.select(*columns, "row", "rank").mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, cut and pack: one row per piece with its checksum, sequence and place there."""
    return pack(written(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), "pieces"), capacity)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
