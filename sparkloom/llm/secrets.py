"""Secret scans: plain patterns over a text and over every layer hidden in it.

A worklist holds layers. Each is scanned, and from each come new ones: the layer with its URL escapes
resolved, the layer with its Unicode escapes resolved, and the content of every base64 run in it, also
where that is wrapped over lines, compressed (gzip, zlib, raw deflate, bzip2, xz, zstandard, with all
members and again inside each other) or in UTF-16. A layer seen before is not taken again, which ends
cycles; the list runs empty at the fixpoint. Characters of a layer know where in the text they come from,
kept as runs, so a find in any layer is a span of the text.

Defined results: a null text counts as empty; a text without finds has empty strings of spans; escapes that
stand for nothing (invalid UTF-8, half a surrogate pair) stay as they are, those beside them are resolved; a percent sign escaped
24 times or more is resolved in one step, so what only the layers between would show isn't looked for;
bytes that are no UTF-8 are read with a mark in their place; very long texts are read whole, and an opened
layer of more than WINDOW bytes in windows that overlap, so there what is hidden must fit in OVERLAP to be
sure of a find; extra columns, of any name, aren't looked at; repeated rows give repeated rows; no rows
give no rows."""

from __future__ import annotations

import base64
import bz2
import hashlib
import itertools
import lzma
import re
import urllib.parse
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame

from sparkloom.llm.common import slices

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
#: A maximal run that is too short holds no match that is long enough, so the least length can be in the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: In lower case, one of these is in every match of ASSIGN.
WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")

URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
#: What quoting makes of bytes: escapes, and the letters and marks that need none.
QUOTED = re.compile(r"(?<![A-Za-z0-9_.~/-])[A-Za-z0-9_.~/-]*+(?:%[0-9A-Fa-f]{2}[A-Za-z0-9_.~/-]*+){4,}")
#: A percent sign that was escaped so often is resolved at once, not by a layer a time.
DEEP = re.compile(r"%(?:25){24,}")
UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2})+")
UNICODE_ONE = re.compile(r"\\(?:u\{([0-9A-Fa-f]+)\}|[uUx]([0-9A-Fa-f]+))")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
NEXT_LINE = re.compile(r"[\x20\t]*\r?\n[\x20\t]*([A-Za-z0-9+/_-]+={0,2})")
PIECE = re.compile(r"[^/_-]{16,}")
URL_SAFE = str.maketrans("-_", "+/")

#: Bytes that a decompressor takes at once, so that it gives no more than some megabytes.
FEED = 256
#: Opened layers beyond this are read in windows with this overlap.
WINDOW, OVERLAP = 32 << 20, 1 << 20
#: A text of fewer characters holds no find, nor an escape or base64 of one.
LEAST = 12
BROKEN = (zlib.error, zstandard.ZstdError, lzma.LZMAError, OSError, EOFError, ValueError)

Span = tuple[str, int, int]


def scan(text: str) -> list[Span]:
    """kind, start, end of each find, leftmost and non-overlapping within a kind."""
    found: list[Span] = []
    lower = text.lower()
    if any(w in lower for w in WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


class Runs:
    """Characters that come from neighbouring stretches of one width each, in runs of equal width: where in the
    layer a run begins, where in the text it begins, and how wide each of its characters is there."""

    def __init__(self):
        self.at, self.out, self.width = array("q"), array("q"), array("q")
        self.n = 0

    def add(self, out: int, width: int, count: int = 1) -> None:
        if not (self.at and self.width[-1] == width and self.out[-1] + (self.n - self.at[-1]) * width == out):
            self.at.append(self.n)
            self.out.append(out)
            self.width.append(width)
        self.n += count

    def span(self, start: int, end: int) -> tuple[int, int]:
        a, z = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        return self.out[a] + (start - self.at[a]) * self.width[a], self.out[z] + (end - self.at[z]) * self.width[z]

    def copy(self, start: int, end: int, to: Runs) -> None:
        k = bisect_right(self.at, start) - 1
        while start < end:
            upto = min(end, self.at[k + 1] if k + 1 < len(self.at) else self.n)
            to.add(self.out[k] + (start - self.at[k]) * self.width[k], self.width[k], upto - start)
            start, k = upto, k + 1


@dataclass
class Layer:
    """A text and where it comes from: itself (neither), all of it from one span, or its characters in runs."""

    text: str
    flat: tuple[int, int] | None = None
    runs: Runs | None = None

    def outer(self, start: int, end: int) -> tuple[int, int]:
        if self.flat:
            return self.flat
        return self.runs.span(start, end) if self.runs else (start, end)


def resolved(layer: Layer, pattern: re.Pattern, chars: Callable[[str], list[tuple[str, int]]]) -> Layer | None:
    """The layer with the runs that ``pattern`` matches replaced by ``chars``: characters, each with how many it stands for."""
    parts: list[str] = []
    runs = None if layer.flat else Runs()
    done = 0

    def copy(a: int, z: int) -> None:
        parts.append(layer.text[a:z])
        if runs is not None and layer.runs:
            layer.runs.copy(a, z, runs)
        elif runs is not None and z > a:
            runs.add(a, 1, z - a)

    changed = False
    for m in pattern.finditer(layer.text):
        new = chars(m[0])
        if len(new) == len(m[0]):
            continue
        changed = True
        copy(done, m.start())
        parts.append("".join(c for c, _ in new))
        if runs is not None:
            at = m.start()
            for _, n in new:
                a, z = layer.outer(at, at + n)
                runs.add(a, z - a)
                at += n
        done = m.end()
    if not changed:
        return None
    copy(done, len(layer.text))
    return Layer("".join(parts), layer.flat, runs)


def url_chars(run: str) -> list[tuple[str, int]]:
    """Bytes that are no UTF-8 come back as lone surrogates and stay escapes."""
    out: list[tuple[str, int]] = []
    at = 0
    for c in bytes.fromhex(run.replace("%", "")).decode("utf-8", "surrogateescape"):
        if "\udc80" <= c <= "\udcff":
            out += [(x, 1) for x in run[at : at + 3]]
            at += 3
        else:
            n = 3 * len(c.encode())
            out.append((c, n))
            at += n
    return out


def unicode_chars(run: str) -> list[tuple[str, int]]:
    """Half a surrogate pair and numbers beyond the last character stay escapes."""
    codes = [(int(m[1] or m[2], 16), m[0]) for m in UNICODE_ONE.finditer(run)]
    out: list[tuple[str, int]] = []
    k = 0
    while k < len(codes):
        code, escape = codes[k]
        low, second = codes[k + 1] if k + 1 < len(codes) else (0, "")
        k += 1
        if 0xD800 <= code < 0xDC00 and 0xDC00 <= low < 0xE000:
            out.append((chr(0x10000 + (code - 0xD800 << 10) + low - 0xDC00), len(escape) + len(second)))
            k += 1
        elif 0xD800 <= code < 0xE000 or code > 0x10FFFF:
            out += [(x, 1) for x in escape]
        else:
            out.append((chr(code), len(escape)))
    return out


def opener(head: bytes) -> Callable | None:
    """What makes a decompressor for content that begins like this."""
    if head[:2] == b"\x1f\x8b" or head[:1] == b"\x78" and len(head) > 6 and (head[0] << 8 | head[1]) % 31 == 0:
        return lambda: zlib.decompressobj(47)
    if head[:4] == b"\x28\xb5\x2f\xfd" or head[1:4] == b"\x2a\x4d\x18" and head[0] >> 4 == 5:
        return lambda: zstandard.ZstdDecompressor(max_window_size=1 << 31).decompressobj()
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor
    if head[:6] == b"\xfd7zXZ\0" or head[:3] == b"\x5d\0\0":
        return lzma.LZMADecompressor
    return None


def decompressed(chunks: Iterator[bytes], new: Callable) -> Iterator[bytes]:
    """All members or streams, one after another; one that is cut short or broken gives what it holds and ends it."""
    one = new()
    for chunk in chunks:
        for at in range(0, len(chunk), FEED):
            piece = chunk[at : at + FEED]
            while piece:
                if one.eof:
                    one = new()
                try:
                    out = one.decompress(piece)
                except BROKEN:
                    return
                if out:
                    yield out
                piece = one.unused_data if one.eof else b""


def windows(chunks: Iterator[bytes]) -> Iterator[bytes]:
    held = bytearray()
    for chunk in chunks:
        held += chunk
        while len(held) > WINDOW:
            yield bytes(held[:WINDOW])
            del held[: WINDOW - OVERLAP]
    yield bytes(held)


def raw_deflate(data: bytes) -> bool:
    """It has no mark, so it must end as it should."""
    one = zlib.decompressobj(-15)
    try:
        while not one.eof and data:
            one.decompress(data, 1 << 20)
            data = one.unconsumed_tail
    except zlib.error:
        return False
    return one.eof


def texts_of(data: bytes) -> Iterator[str]:
    """In UTF-8, and with zero bytes also in UTF-16 of both byte orders, from either byte."""
    yield data.decode("utf-8", "replace")
    if b"\0" in data:
        for start in (0, 1):
            yield data[start:].decode("utf-16-le", "replace")
            yield data[start:].decode("utf-16-be", "replace")


def contents(data: bytes) -> Iterator[str]:
    """Texts that the bytes are, and that they are when opened, again and again until nothing opens."""
    yield from texts_of(data)
    seen, levels = set(), []
    while new := opener(data) or (None if levels or not raw_deflate(data) else lambda: zlib.decompressobj(-15)):
        if levels:  # ``data`` is only the beginning of what the levels give
            levels.append(new)
        elif (digest := xxhash.xxh3_128_digest(data)) in seen:
            return
        else:
            seen.add(digest)
            whole, levels = data, [new]
        chunks = iter([whole])
        for level in levels:
            chunks = decompressed(chunks, level)
        parts = windows(chunks)
        data = next(parts)
        yield from texts_of(data)
        second = next(parts, None)
        if second is None:
            levels = []
        else:
            for part in itertools.chain([second], parts):
                yield from texts_of(part)


def base64_runs(text: str) -> Iterator[tuple[str, int, int]]:
    """Base64 that may be: each run, its pieces between the marks of paths and names, and lines that are one when joined.

    Joined lines are as long as the second, but for the first and the last, which may be shorter; they are also
    joined without the first and without the last, as that may be a word of the text."""
    chained = 0
    for m in BASE64.finditer(text):
        run, start, end = m[0], *m.span()
        yield run, start, end
        if "/" in run or "-" in run or "_" in run:
            yield from ((p[0], start + p.start(), start + p.end()) for p in PIECE.finditer(run) if p[0] != run)
        if start < chained:
            continue
        lines = [(run, start, end)]
        while lines[-1][0][-1] != "=" and len(lines[-1][0]) >= len(lines[len(lines) > 1][0]) >= len(run) and (after := NEXT_LINE.match(text, lines[-1][2])):
            if len(lines) > 1 and len(after[1].rstrip("=")) > len(lines[1][0]):
                break
            lines.append((after[1], *after.span(1)))
        if len(lines) > 1:
            chained = lines[-1][1]
            for first, upto in {(0, len(lines)), (len(run) != len(lines[1][0]), len(lines)), (0, len(lines) - 1)}:
                if upto - first > 1:
                    yield "".join(x for x, _, _ in lines[first:upto]), lines[first][1], lines[upto - 1][2]


def base64_bytes(run: str) -> bytes:
    core = run.rstrip("=").translate(URL_SAFE)
    core = core[: len(core) - (len(core) % 4 == 1)]
    return base64.b64decode(core + "=" * (-len(core) % 4))


def unwrapped(layer: Layer) -> Iterator[Layer]:
    text = layer.text
    if "%" in text:
        if new := resolved(layer, DEEP, lambda run: [("%", len(run))]):
            yield new
        elif new := resolved(layer, URL, url_chars):
            yield new
            for m in QUOTED.finditer(text):
                if opener(data := urllib.parse.unquote_to_bytes(m[0])):
                    yield from (Layer(t, layer.outer(*m.span())) for t in contents(data))
    if "\\" in text:
        if new := resolved(layer, UNICODE, unicode_chars):
            yield new
            for m in UNICODE.finditer(text):
                codes = [int(x[1] or x[2], 16) for x in UNICODE_ONE.finditer(m[0])]
                if max(codes) < 256 and opener(data := bytes(codes)):
                    yield from (Layer(t, layer.outer(*m.span())) for t in contents(data))
    for run, start, end in base64_runs(text):
        span = layer.outer(start, end)
        yield from (Layer(t, span) for t in contents(base64_bytes(run)))


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{z}" for k, a, z in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def find_secrets(text: str) -> tuple[list[Span], set[Span]]:
    """Finds in the text itself, and in all layers together."""
    base = scan(text)
    key = lambda x: (xxhash.xxh3_128_digest(x.text.encode("utf-8", "surrogatepass")), x.flat)
    work = [Layer(text)]
    spans, seen = set(base), {key(work[0])}
    while work:
        for new in unwrapped(work.pop()):
            if len(new.text) < LEAST or (k := key(new)) in seen:
                continue
            seen.add(k)
            work.append(new)
            spans |= {(kind, *new.outer(a, z)) for kind, a, z in scan(new.text)}
    return base, spans


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of each row of ``docs(doc_id, text)``."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [find_secrets(t or "") for t in b.column(1).to_pylist()]
            counts = [pa.array([sum(k == kind for k, _, _ in base) for base, _ in found], pa.int64()) for kind in KINDS]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *counts, pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found]), pa.array([joined(s) for _, s in found])],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
