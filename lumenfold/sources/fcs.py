"""FCS event files as a Spark data source: ranges of rows as partitions, columns and rows pruned, headers by themselves."""

from __future__ import annotations

import glob
import os
import re
import shutil
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage


def parse_text(raw: bytes) -> dict[str, str]:
    """Keyword segment: the first byte is the delimiter; doubled, it stands for itself inside a value."""
    text = raw.decode("utf-8", "replace")
    d = text[0]
    parts = re.split(re.escape(d), text[1:].replace(d + d, "\0"))
    parts = [p.replace("\0", d) for p in parts]
    return {k.strip(): v for k, v in zip(parts[::2], parts[1::2], strict=False) if k.strip()}


def header(path: str) -> dict[str, str]:
    """Keywords of a file, and FCSversion. Only the first two segments are read."""
    with open(path, "rb") as f:
        head = f.read(58)
        if not head.startswith(b"FCS"):
            raise ValueError(f"{path}: no FCS file")
        start, end = int(head[10:18]), int(head[18:26])
        f.seek(start)
        keys = parse_text(f.read(end - start + 1))
    keys["FCSversion"] = head[:6].decode()
    if int(head[26:34].strip() or 0):
        keys.setdefault("$BEGINDATA", head[26:34].decode().strip())
    return keys


@dataclass
class Layout:
    channels: list[str]
    total: int
    begin: int
    dtype: str

    @classmethod
    def of(cls, keys: dict[str, str]) -> Layout:
        n = int(keys["$PAR"])
        bits = {keys.get(f"$P{i}B", "32").strip() for i in range(1, n + 1)}
        kind = keys.get("$DATATYPE", "F").strip()
        if kind not in "FD" or bits != {"32" if kind == "F" else "64"}:
            raise ValueError(f"data of type {kind} with {sorted(bits)} bits are not supported")
        order = "<" if keys.get("$BYTEORD", "1,2,3,4").startswith("1,2") else ">"
        begin = int(keys["$BEGINDATA"])
        names = [keys.get(f"$P{i}N") or f"Channel_{i}" for i in range(1, n + 1)]
        return cls(names, int(keys["$TOT"]), begin, order + ("f4" if kind == "F" else "f8"))


def read_rows(path: str, start: int = 0, end: int | None = None) -> tuple[list[str], np.ndarray]:
    """Channels and rows [start, end) of a file, by seeking to their bytes."""
    lay = Layout.of(header(path))
    end = lay.total if end is None else min(end, lay.total)
    width = len(lay.channels)
    size = np.dtype(lay.dtype).itemsize
    with open(path, "rb") as f:
        f.seek(lay.begin + start * width * size)
        data = np.frombuffer(f.read(max(0, end - start) * width * size), dtype=lay.dtype)
    return lay.channels, data.reshape(-1, width).astype(float)


def head(channels: list[str], total: int, keys: dict[str, str]) -> bytes:
    """All that comes before the data of an FCS 3.1 file with so many rows of little-endian 32-bit floats; offsets are found
    by repeating until their widths stop changing."""
    keys = {k: v for k, v in keys.items() if k != "FCSversion" and k not in ("$BEGINDATA", "$ENDDATA", "$BEGINANALYSIS", "$ENDANALYSIS", "$BEGINSTEXT", "$ENDSTEXT", "$NEXTDATA")}
    keys |= {"$TOT": str(total), "$PAR": str(len(channels)), "$DATATYPE": "F", "$BYTEORD": "1,2,3,4", "$MODE": "L", "$NEXTDATA": "0", "$BEGINANALYSIS": "0", "$ENDANALYSIS": "0", "$BEGINSTEXT": "0", "$ENDSTEXT": "0"}
    for i, c in enumerate(channels, 1):
        keys[f"$P{i}N"], keys[f"$P{i}B"] = c, "32"
        keys.setdefault(f"$P{i}E", "0,0")
        keys.setdefault(f"$P{i}R", "262144")
    begin = end = 0
    while True:
        full = keys | {"$BEGINDATA": str(begin), "$ENDDATA": str(end)}
        text = "/" + "".join(f"{k}/{(v or ' ').replace('/', '//')}/" for k, v in full.items())
        raw = text.encode()
        new = 58 + len(raw)
        if new == begin:
            break
        begin, end = new, new + max(4 * total * len(channels), 1) - 1
    fit = lambda v: str(v if v < 10**8 else 0).rjust(8)  # noqa: E731  offsets beyond eight digits stand in the keywords only
    return ("FCS3.1    " + fit(58) + fit(58 + len(raw) - 1) + fit(begin if end < 10**8 else 0) + fit(end) + fit(0) * 2).encode() + raw


#: What stands for the checksum at the end of a file.
TAIL = b"00000000"


def encode(channels: list[str], data: np.ndarray, keys: dict[str, str]) -> bytes:
    """A whole file."""
    return head(channels, len(data), keys) + np.ascontiguousarray(data, dtype="<f4").tobytes() + TAIL


def write(path: str, channels: list[str], data: np.ndarray, keys: dict[str, str] | None = None) -> str:
    with open(path, "wb") as f:
        f.write(encode(channels, data, keys or {}))
    return path


def prepare(path: str, channels: list[str], total: int, keys: dict[str, str]) -> int:
    """A file of full size whose rows are still to come, by place(); returns where they begin."""
    start = head(channels, total, keys)
    with open(path, "wb") as f:
        f.write(start)
        f.seek(len(start) + 4 * total * len(channels))
        f.write(TAIL)
    return len(start)


def place(path: str, begin: int, row: int, data: np.ndarray) -> None:
    """Rows from number `row` on, into a prepared file. The same rows again leave the same file, so a task may be retried."""
    with open(path, "r+b") as f:
        f.seek(begin + 4 * row * data.shape[1])
        f.write(np.ascontiguousarray(data, dtype="<f4").tobytes())


def concatenate(paths: list[str], path: str, rows: int = 100_000, spark: SparkSession | None = None) -> str:
    """One file of all rows: equal ordered channels, or an error; keywords of the first file. Headers alone are read here; with
    a session, tasks copy some rows each, else this process does. The files must lie where all executors see them."""
    layouts = [Layout.of(header(p)) for p in paths]
    for p, lay in zip(paths, layouts, strict=True):
        if lay.channels != layouts[0].channels:
            raise ValueError(f"{p}: channels differ from those of {paths[0]}")
    begin = prepare(path, layouts[0].channels, sum(lay.total for lay in layouts), header(paths[0]))
    jobs, at = [], 0
    for p, lay in zip(paths, layouts, strict=True):
        jobs += [(p, start, min(start + rows, lay.total), at + start) for start in range(0, lay.total, rows)]
        at += lay.total
    if spark is None:
        for p, start, end, to in jobs:
            place(path, begin, to, read_rows(p, start, end)[1])
        return path

    def copy(batches):
        for batch in batches:
            for p, start, end, to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                place(path, begin, to, read_rows(p, start, end)[1])
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    if jobs:
        parts = min(len(jobs), max(spark.sparkContext.defaultParallelism, len(jobs) // 8))
        spark.createDataFrame(jobs, "path string, first long, last long, target long").repartition(parts, "target").mapInArrow(copy, "n long").agg({"n": "sum"}).collect()
    return path


def save(df: DataFrame, path: str, keys: dict[str, str] | None = None) -> str:
    """df's numeric columns as an event file, rows in the order of its partitions, nulls and NaN as 0.

    Rows are numbered and counted first, the header is written with the file's full size, and then every task puts its rows in
    their place: nothing passes the driver but the counts, and a task that runs again writes the same bytes.
    """
    from pyspark.sql import functions as F

    from lumenfold.functions.tables import written

    channels = df.columns
    columns = [F.coalesce(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f"c{i}") for i, c in enumerate(channels)]
    rows = written(df.select(*columns).withColumn("_row", F.monotonically_increasing_id()), "event-rows")
    counts = rows.groupBy(F.shiftright("_row", 33).alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()  # a row a partition
    parts = np.array([r["part"] for r in counts], np.int64)
    first = np.concatenate([[0], np.cumsum([r["n"] for r in counts])]).astype(np.int64)
    begin = prepare(path, channels, int(first[-1]), keys or {})

    def put(batches):
        for batch in batches:
            number = batch.column(len(channels)).to_numpy(zero_copy_only=False)
            at = first[np.searchsorted(parts, number >> 33)] + (number & ((1 << 33) - 1))
            data = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(channels))]) if len(at) else np.zeros((0, len(channels)))
            for run in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) != 1) + 1):
                if len(run):
                    place(path, begin, int(at[run[0]]), data[run])
            yield pa.RecordBatch.from_arrays([pa.array([len(at)], pa.int64())], ["n"])

    rows.mapInArrow(put, "n long").agg(F.sum("n")).collect()
    return path


def _files(path: str) -> list[str]:
    if os.path.isdir(path):
        return sorted(os.path.join(path, f) for f in os.listdir(path) if f.lower().endswith(".fcs"))
    return sorted(glob.glob(path))


@dataclass
class Rows(InputPartition):
    path: str
    start: int
    end: int


#: Rows that a task reads at a time.
READ = 65_536


class _Reader(DataSourceReader):
    """Filters on sample choose files, those on event_id rows; both reach no file or byte that they leave out."""

    def __init__(self, schema, options):
        self.schema, self.options = schema, options
        self.samples: set[str] | None = None
        self.first, self.last = 0, (1 << 62) - 1  # event ids, both included

    def pushFilters(self, filters):
        for f in filters:
            if not self._taken(f):
                yield f

    def _taken(self, f) -> bool:
        """Does the source see to the filter? Lists of event ids bound the rows and stay filters."""
        column = f.attribute if len(getattr(f, "attribute", ())) == 1 else ("",)
        value = getattr(f, "value", None)
        if column == ("sample",):
            if isinstance(f, IsNotNull):
                return True
            if isinstance(f, (EqualTo, In)) and value is not None:
                own = {value} if isinstance(f, EqualTo) else set(value) - {None}
                self.samples = own if self.samples is None else self.samples & own
                return True
        elif column == ("event_id",):
            if isinstance(f, IsNotNull):
                return True
            if isinstance(f, In):
                own = [v for v in value if v is not None]
                self._between(min(own, default=1), max(own, default=0))
                return False
            if isinstance(value, int):
                if isinstance(f, EqualTo):
                    self._between(value, value)
                elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self._between(value + isinstance(f, GreaterThan), self.last)
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    self._between(self.first, value - isinstance(f, LessThan))
                else:
                    return False
                return True
        return False

    def _between(self, first: int, last: int) -> None:
        self.first, self.last = max(self.first, first), min(self.last, last)

    def partitions(self):
        step = int(self.options.get("rows", 500_000))
        start, stop = max(int(self.options.get("startrow", 0)), self.first), min(int(self.options.get("endrow", 1 << 62)), self.last + 1)
        out = []
        for p in _files(self.options["path"]):
            if self.samples is None or _sample(p) in self.samples:
                end = min(Layout.of(header(p)).total, stop)
                out += [Rows(p, s, min(s + step, end)) for s in range(start, end, step)]
        return out or [Rows("", 0, 0)]

    def read(self, part):
        for start in range(part.start, part.end, READ) if part.path else ():
            channels, data = read_rows(part.path, start, min(start + READ, part.end))
            n = len(data)
            columns = []
            for f in self.schema.fields:
                if f.name == "sample":
                    columns.append(pa.array([_sample(part.path)] * n, pa.string()))
                elif f.name == "event_id":
                    columns.append(pa.array(np.arange(start, start + n), pa.int64()))
                else:
                    columns.append(pa.array(data[:, channels.index(f.name)], pa.float64()))
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in self.schema.fields])


def _sample(path: str) -> str:
    return os.path.splitext(os.path.basename(path))[0]


class _HeaderReader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        return [Rows(p, 0, 0) for p in _files(self.options["path"])] or [Rows("", 0, 0)]

    def read(self, part):
        if part.path:
            keys = header(part.path)
            want = self.options.get("keyword")
            if want:
                keys = {k: v for k, v in keys.items() if k in want.split(",")}
            yield (part.path, keys)


@dataclass
class Part(WriterCommitMessage):
    path: str
    rows: int


class _Writer(DataSourceArrowWriter):
    """Each task writes its rows; the commit puts them behind one header, in task order, a buffer at a time."""

    def __init__(self, schema, options, overwrite):
        self.channels, self.target = [f.name for f in schema.fields], options["path"]
        if os.path.exists(self.target) and not overwrite:
            raise ValueError(f"{self.target} exists")

    def write(self, iterator):
        from pyspark import TaskContext

        context = TaskContext.get()
        path, n = f"{self.target}.part{context.partitionId():06d}-{context.taskAttemptId()}", 0
        with open(path, "wb") as f:
            for batch in iterator:
                data = np.column_stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in batch.columns]) if batch.num_rows else np.zeros((0, len(self.channels)))
                f.write(np.nan_to_num(data).astype("<f4").tobytes())
                n += len(data)
        return Part(path, n)

    def commit(self, messages):
        parts = sorted((m for m in messages if m), key=lambda m: m.path)
        with open(self.target, "wb") as out:
            out.write(head(self.channels, sum(m.rows for m in parts), {}))
            for m in parts:
                with open(m.path, "rb") as f:
                    shutil.copyfileobj(f, out, 1 << 24)
            out.write(TAIL)
        for m in parts:
            os.remove(m.path)

    def abort(self, messages):
        for m in messages:
            if m and os.path.exists(m.path):
                os.remove(m.path)


class FcsSource(DataSource):
    """format("fcs"): sample, event_id and one double column a channel. Options: rows (a partition), startrow, endrow,
    columns (comma-separated: only these are decoded into columns). Paths are a file, a folder or a pattern that all executors see."""

    @classmethod
    def name(cls):
        return "fcs"

    def schema(self):
        files = _files(self.options["path"])
        if not files:
            raise ValueError(f"no FCS file at {self.options['path']}")
        channels = Layout.of(header(files[0])).channels
        want = self.options.get("columns")
        if want:
            lost = set(want.split(",")) - set(channels)
            if lost:
                raise ValueError(f"no such channels: {sorted(lost)}")
            channels = want.split(",")
        return T.StructType([T.StructField("sample", T.StringType()), T.StructField("event_id", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in channels]])

    def reader(self, schema):
        return _Reader(schema, self.options)

    def writer(self, schema, overwrite):
        return _Writer(schema, self.options, overwrite)


class FcsHeaderSource(DataSource):
    """format("fcs_header"): (path, keywords) of each file. Option keyword: comma-separated names to keep."""

    @classmethod
    def name(cls):
        return "fcs_header"

    def schema(self):
        return "path string, keywords map<string,string>"

    def reader(self, schema):
        return _HeaderReader(self.options)


def register(spark: SparkSession) -> None:
    """Both sources, in a session that hands them its filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FcsSource)
    spark.dataSource.register(FcsHeaderSource)


def pack(df: DataFrame, detectors: list[str], out: str = "spectral") -> DataFrame:
    """Detector columns as one array column, in the given order."""
    from pyspark.sql import functions as F

    rest = [F.col(f"`{c}`") for c in df.columns if c not in set(detectors)]
    return df.select(*rest, F.array(*[F.col(f"`{d}`") for d in detectors]).alias(out))


__all__ = ["FcsHeaderSource", "FcsSource", "concatenate", "encode", "header", "pack", "parse_text", "place", "prepare", "read_rows", "register", "save", "write"]
