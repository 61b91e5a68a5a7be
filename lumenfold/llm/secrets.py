"""Secret scanning through nested encodings.

A worklist holds layers of text, the deepest first. Each is scanned; then what it wraps (percent and Unicode escapes of the whole layer,
base64 tokens, compressed data in them) is unwrapped into new layers, until no layer is new. Every character of a
layer knows the span of the document it came from, so findings in any depth point into the document.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm._common import lean

# The three kinds of secrets, in order of listing.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}

# Runs of %xx that are UTF-8; other bytes between them stay as they are.
_X, _MORE = "[0-9A-Fa-f]", "%[89ABab][0-9A-Fa-f]"
PERCENT = re.compile(
    rf"(?:%[0-7]{_X}|%(?:[Cc][2-9A-Fa-f]|[Dd]{_X}){_MORE}|%[Ee]0%[ABab]{_X}{_MORE}|%[Ee][1-9A-CEFa-cef]{_MORE}{_MORE}|%[Ee][Dd]%[89]{_X}{_MORE}"
    rf"|%[Ff]0%[9ABab]{_X}{_MORE}{_MORE}|%[Ff][1-3]{_MORE}{_MORE}{_MORE}|%[Ff]4%8{_X}{_MORE}{_MORE})+"
)
ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
_HEX_MASK = bytes(104 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
_B64_MASK = bytes(98 if (chr(b).isalnum() and b < 128) or chr(b) in "+/_-" else 32 for b in range(256))
#: Lines of one length and a last one: base64 as mail and command line tools wrap it.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{16,}\r?\n[ \t]*)+[A-Za-z0-9+/_-]+={0,2}")
LINE_END = re.compile(r"\r?\n[ \t]*")
SEPARATOR = re.compile(r"[/_-]+")
#: First bytes of compressed streams.
MAGIC = (b"\x1f", b"\x78", b"B", b"\xfd")
#: Decompressed data are scanned in parts of about this size, cut where no secret and no encoding can run on.
PART = 1 << 22
#: Bytes that end whatever a secret or an encoding is made of (a zero byte may be half a character).
_BREAK = re.compile(rb"[^\x00A-Za-z0-9+/_.=:\"'\x20\t\r\n%\\&#;{}-]")
#: Where a part has no such byte, neighbours share this many bytes.
OVERLAP = 1 << 20


def base_matches(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the plain matches. Cheap tests for what any match must hold come first."""
    found = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or ("api" in low and "key" in low):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    if b"h" * LEAST["hex"] in text.encode("latin-1", "replace").translate(_HEX_MASK):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
    return found


def _members(data: bytes):
    """The decompressed members of a gzip, zlib, bz2 or xz stream, one after the other, in chunks; none if it is no such stream."""
    while data:
        if data[:3] == b"\x1f\x8b\x08":
            tool, pull = zlib.decompressobj(31), lambda t, d: (t.decompress(d, PART), t.unconsumed_tail)
        elif data[:1] == b"\x78" and len(data) > 5 and int.from_bytes(data[:2], "big") % 31 == 0:
            tool, pull = zlib.decompressobj(), lambda t, d: (t.decompress(d, PART), t.unconsumed_tail)
        elif data[:3] == b"BZh":
            tool, pull = bz2.BZ2Decompressor(), lambda t, d: (t.decompress(d, PART), b"")
        elif data[:6] == b"\xfd7zXZ\x00":
            tool, pull = lzma.LZMADecompressor(), lambda t, d: (t.decompress(d, PART), b"")
        else:
            return
        try:
            while not tool.eof:
                out, data = pull(tool, data)
                if not out:
                    break
                yield out
        except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
            return
        data = tool.unused_data if tool.eof else b""


def _inflated(data: bytes):
    """Parts of what a compressed stream holds, all members together, of PART bytes or somewhat more."""
    held = b""
    for chunk in _members(data):
        held += chunk
        while len(held) >= 2 * PART:
            end = next((m.end() for m in _BREAK.finditer(held, PART)), None)
            yield held[: end or 2 * PART]
            held = held[end or 2 * PART - OVERLAP :]
    if held:
        yield held


def _readings(data: bytes) -> list[str]:
    """The texts that bytes may be. All secrets are ASCII, so for bytes that are not UTF-8 one character a byte will do;
    where there are zero bytes, UTF-16 of either order from either offset as well."""
    try:
        found = [data.decode("utf-8")]
    except UnicodeDecodeError:
        found = [data.decode("latin-1")]
    if b"\0" in data:
        found += [part.decode(order, "replace") for part in (data, data[1:]) for order in ("utf-16-le", "utf-16-be")]
    return [t for t in found if t]


def _unpacked(data: bytes) -> Iterator[str]:
    """The texts in what is compressed in data, in any depth, one after the other; a layer that holds itself ends the search."""
    seen = {hashlib.blake2b(data, digest_size=16).digest()}
    opened = [_inflated(data)]  # one stream a depth
    while opened:
        part = next(opened[-1], None)
        if part is None:
            opened.pop()
            continue
        mark = hashlib.blake2b(part, digest_size=16).digest()
        if mark in seen:
            continue
        seen.add(mark)
        yield from _readings(part)
        opened.append(_inflated(part))


def _decode64(token: str) -> Iterator[str]:
    """The texts in a base64 token, and in what is compressed there. As / - and _ may also separate words, the token is
    read from every start modulo 4 that follows one of them, and compressed data may begin after any."""
    body = token.rstrip("=")
    starts: dict[int, array] = {0: array("q", [0])}
    for m in SEPARATOR.finditer(body):
        starts.setdefault(m.end() % 4, array("q")).append(m.end())
    body = body.replace("-", "+").replace("_", "/")
    for first in (starts[k][0] for k in sorted(starts)):
        part = body[first:]
        if len(part) < 16:
            continue
        if len(part) % 4 == 1:
            if first == 0 and len(starts) == 1:
                continue
            part = part[:-1]
        try:
            data = base64.b64decode(part + "=" * (-len(part) % 4), validate=True)
        except (binascii.Error, ValueError):
            continue
        yield from _readings(data)
        for at in starts[first % 4]:
            offset = (at - first) // 4 * 3
            if data[offset : offset + 1] in MAGIC:
                yield from _unpacked(data[offset:])


class Document:
    """Where a layer's characters come from: here, the document itself."""

    def origin(self, start: int, end: int) -> tuple[int, int]:
        return start, end


class Within(Document):
    """All of the layer comes from one span."""

    def __init__(self, start: int, end: int):
        self.at = (start, end)

    def origin(self, start: int, end: int) -> tuple[int, int]:
        return self.at


class Unescaped(Document):
    """A layer of pieces of the one before: as they were, or replaced. Per piece: its place here, its span there, and the
    characters there for one here (0: each comes from all)."""

    def __init__(self, before: Document):
        self.before, self.place, self.start, self.end, self.step = before, array("q"), array("q"), array("q"), array("b")

    def add(self, place: int, start: int, end: int, step: int) -> None:
        for column, value in zip((self.place, self.start, self.end, self.step), (place, start, end, step), strict=True):
            column.append(value)

    def _one(self, i: int) -> tuple[int, int]:
        k = bisect_right(self.place, i) - 1
        first = self.start[k] + (i - self.place[k]) * self.step[k]
        return first, first + self.step[k] if self.step[k] else self.end[k]

    def origin(self, start: int, end: int) -> tuple[int, int]:
        return self.before.origin(self._one(start)[0], self._one(end - 1)[1])


def _unescape(pattern: re.Pattern, decode, text: str, spans: Document) -> tuple[str, Document] | None:
    """The layer with all escapes of one sort replaced, and where its characters came from; None if it has none."""
    out, size, last, where = [], 0, 0, Unescaped(spans)
    for m in pattern.finditer(text):
        new = decode(m[0])
        if new is None:
            continue
        if m.start() > last:
            out.append(text[last : m.start()])
            where.add(size, last, m.start(), 1)
            size += m.start() - last
        out.append(new)
        each = len(new) * 3 == len(m[0]) and new.isascii()  # one character for each %xx
        if new:
            where.add(size, m.start(), m.end(), 3 if each else 0)
        size += len(new)
        last = m.end()
    if not last:
        return None
    if last < len(text):
        out.append(text[last:])
        where.add(size, last, len(text), 1)
    return "".join(out), spans if isinstance(spans, Within) else where


def _percent(s: str) -> str:
    return bytes.fromhex(s.replace("%", "")).decode("utf-8")


def _escape(s: str) -> str | None:
    try:
        if s[0] == "&":
            return chr(int(s[3:-1], 16) if s[2] in "xX" else int(s[2:-1]))
        if s[1] == "x" or s[2] == "{":
            return chr(int(s[2:].strip("{}"), 16))
        return bytes.fromhex(s.replace("\\u", "")).decode("utf-16-be", "replace")
    except (ValueError, OverflowError):
        return None


def _layers(layer: str, spans: Document) -> Iterator[tuple[str, Document]]:
    """What a layer wraps, one after the other."""
    if "%" in layer and (one := _unescape(PERCENT, _percent, layer, spans)):
        yield one
    if ("\\" in layer or "&#" in layer) and (one := _unescape(ESCAPE, _escape, layer, spans)):
        yield one
    if b"b" * 16 in layer.encode("latin-1", "replace").translate(_B64_MASK):
        for m in BASE64.finditer(layer):
            for inner in _decode64(m[0]):
                yield inner, Within(*spans.origin(m.start(), m.end()))
        for m in WRAPPED.finditer(layer) if "\n" in layer else ():
            lines = LINE_END.split(m[0])
            if len({len(x) for x in lines[:-1]}) == 1 and len(lines[-1].rstrip("=")) <= len(lines[0]):
                for inner in _decode64("".join(lines)):
                    yield inner, Within(*spans.origin(m.start(), m.end()))


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base findings, all findings), each sorted (start, kind index, end) in code points of text.

    Layers are scanned as they are unwrapped and then dropped: at any time there is one a depth, and of inflated data one
    part of some 2 * PART bytes a depth, however much a stream holds. Of layers met, 16 bytes stay.
    """
    base = sorted(base_matches(text))
    found = set(base)
    work = [_layers(text, Document())]
    seen: set[bytes] = set()
    while work:
        one = next(work[-1], None)
        if one is None:
            work.pop()
            continue
        layer, spans = one
        if not layer:
            continue
        mark = hashlib.blake2b(layer.encode("utf-8", "surrogatepass"), digest_size=16, key=repr(spans.origin(0, 1)).encode()).digest()
        if mark in seen:  # a layer met before ends a cycle
            continue
        seen.add(mark)
        for start, kind, end in base_matches(layer):
            first, last = spans.origin(start, end)
            found.add((first, kind, last))
        work.append(_layers(layer, spans))
    return base, sorted(found)


def listed(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, counts of plain findings by kind, base (plain findings) and spans (all findings),
    each "kind:start:end" joined by commas. Null and empty texts have none. Repeated rows each get their row. Empty input: no
    rows. Compressed data are inflated and scanned whole, in parts: memory does not grow with what they hold, time does."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    key = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in lean(batches):
            counts, base_out, all_out = ([], [], []), [], []
            for text in batch.column(1).to_pylist():
                base, every = scan(text or "")
                for k in range(3):
                    counts[k].append(sum(x[1] == k for x in base))
                base_out.append(listed(base))
                all_out.append(listed(every))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(base_out, pa.string()), pa.array(all_out, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base", "spans"])

    out = rows.mapInArrow(run, f"doc_id {key}, n_assign bigint, n_access bigint, n_hex bigint, base string, spans string")
    return out.withColumnRenamed("doc_id", id_col)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")
