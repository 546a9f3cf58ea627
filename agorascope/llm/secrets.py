"""Secret scans with a worklist of decoded layers.

A text is scanned, then everything in it that looks encoded is decoded to a new layer: URL and
Unicode escapes (in place), base64 runs, and compressed data inside them. Each new layer is scanned
and searched for further encodings, until nothing new is found. A layer that was seen before, at the
same place with the same content, is not opened again, so decodings that reproduce themselves end.
Every character of a layer knows the span of the original text it came from, which gives a secret
found at any depth its place in the original.

Base64 runs are decoded line by line and joined over single line breaks, in all four alignments, so that
a run glued to a path before it is read too. Decoded bytes are opened if they hold a stretch of printable
ASCII as long as the shortest secret, as UTF-8 or, if they are not that, byte by byte; such stretches of
UTF-16 are opened as well. All members of gzip and zlib data and all frames of zstd data are read, and what
follows the last one. Escaped escapes (%252541, &amp;amp;#65;) are undone in one step. A compressed layer of over MAX_LAYER bytes is opened as a
stream of windows, cut where nothing that is looked for can go on; a stretch of over MAX_LAYER characters
without such a place is left out, and its layer counted as unopened.
"""

from __future__ import annotations

import base64
import codecs
import html
import itertools
import re
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")
MAX_LAYER = 1 << 26  # bytes a compressed layer may have to be opened as a whole; larger ones are streamed
CHUNK = 1 << 20
WINDOW = 1 << 22  # characters of a stream handled together, more where it cannot be cut

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # a shorter run fails anyway
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

_PERCENT = re.compile(r"(?:%(?:25)*[0-9A-Fa-f]{2})+")
_ONE_PERCENT = re.compile(r"%(?:25)*([0-9A-Fa-f]{2})")
_ESCAPE = re.compile(
    r"(?:\\u[0-9A-Fa-f]{4})+|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|(?:\\x[0-9A-Fa-f]{2})+"
    r"|&(?:amp;)*(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
)
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:\r?\n[ \t]*+[A-Za-z0-9+/_-]++)+={0,2}")
_LINE = re.compile(r"[A-Za-z0-9+/_=-]+")
# the shortest secret has 12 characters, and no encoding is shorter than what it encodes
_STRETCH = re.compile(rb"[\t\n\r\x20-\x7e]{12,}")
_STRETCH_16 = re.compile(rb"(?:[\t\n\r\x20-\x7e]\x00){12,}|(?:\x00[\t\n\r\x20-\x7e]){12,}")
_MEMBER = re.compile(rb"\x1f\x8b\x08|\x28\xb5\x2f\xfd")  # starts of gzip and zstd data
_CUT = re.compile(r"""[^A-Za-z0-9+/_.=\-"':%\\&#;{}\s]""")  # in none of the patterns


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the secrets written openly in ``text``."""
    found = []
    low = text.lower()
    if any(word in low for word in _KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


@dataclass
class Layer:
    text: str
    first: np.ndarray | None  # original start and end of each character; None: the original itself
    last: np.ndarray | None
    depth: int = 0

    def span(self, start: int, end: int) -> tuple[int, int]:
        if self.first is None:
            return start, end
        return int(self.first[start:end].min()), int(self.last[start:end].max())

    def maps(self, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        if self.first is None:
            at = np.arange(start, end)
            return at, at + 1
        return self.first[start:end], self.last[start:end]


def _utf8(raw: bytes, places: list[int]) -> tuple[str, list[int], list[int]]:
    """Text of bytes whose codes start at the first of ``places`` and end at the next, and the places
    of each character."""
    known = _is_utf8(raw)
    text = raw.decode("utf-8" if known else "latin-1")
    ends = list(itertools.accumulate(len(c.encode()) if known else 1 for c in text))
    return text, [places[i] for i in [0, *ends[:-1]]], [places[i] for i in ends]


def _is_utf8(raw: bytes) -> bool:
    try:
        raw.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def _percent(match: re.Match) -> tuple[str, list[int], list[int]]:
    codes = list(_ONE_PERCENT.finditer(match.string, match.start(), match.end()))
    return _utf8(bytes.fromhex("".join(c[1] for c in codes)), [*(c.start() for c in codes), match.end()])


def _escape(match: re.Match) -> tuple[str, list[int], list[int]]:
    code, start = match[0], match.start()
    if code.startswith("\\x"):
        return _utf8(bytes.fromhex(code.replace("\\x", "")), list(range(start, match.end() + 1, 4)))
    if code.startswith("\\u") and "{" not in code:
        units = [int(code[i + 2 : i + 6], 16) for i in range(0, len(code), 6)]
        text = b"".join(u.to_bytes(2, "little") for u in units).decode("utf-16-le", "replace")
        starts, at = [], start
        for c in text:
            starts.append(at)
            at += 12 if ord(c) > 0xFFFF else 6
        return text, starts, [*starts[1:], match.end()]
    if code.startswith("&"):
        text = html.unescape("&" + code[1:].replace("amp;", "")) if code.count(";") > 1 else html.unescape(code)
    else:
        number = int(code.strip("\\uU{}"), 16)
        text = chr(number) if number < 0x110000 and not 0xD800 <= number < 0xE000 else "�"
    return text, [start] * len(text), [match.end()] * len(text)


def _replaced(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with all escapes of one family decoded in place."""
    parts, firsts, lasts, at = [], [], [], 0
    for match in pattern.finditer(layer.text):
        text, starts, ends = decode(match)
        parts += [layer.text[at : match.start()], text]
        for low, high in ((at, match.start()),):
            first, last = layer.maps(low, high)
            firsts.append(first)
            lasts.append(last)
        first, last = layer.maps(match.start(), match.end())
        firsts.append(first[np.array(starts, int) - match.start()])
        lasts.append(last[np.array(ends, int) - match.start() - 1])
        at = match.end()
    if not parts:
        return None
    first, last = layer.maps(at, len(layer.text))
    return Layer(
        "".join(parts) + layer.text[at:],
        np.concatenate([*firsts, first]),
        np.concatenate([*lasts, last]),
        layer.depth + 1,
    )


def _packing(head: bytes) -> str | None:
    if head[:4] == b"\x28\xb5\x2f\xfd":
        return "zstd"
    if head[:2] == b"\x1f\x8b" or head[:1] == b"\x78" and len(head) > 1 and (head[0] << 8 | head[1]) % 31 == 0:
        return "zlib"
    return None


def _chunks(source: Iterator[bytes], packing: str) -> Iterator[bytes]:
    """The decompressed data of all members or frames, and what follows the last one on a line of its own."""
    import zstandard

    def fresh():
        return zstandard.ZstdDecompressor().decompressobj() if packing == "zstd" else zlib.decompressobj(47)

    tool, first, rest = fresh(), True, b""
    while True:
        if tool is None:  # a member has ended: is there another?
            while len(rest) < 4 and (more := next(source, None)) is not None:
                rest = bytes(rest) + more
            packing = _packing(rest)
            if packing is None:
                yield from itertools.chain([b"\n", bytes(rest)] if rest else [], source)
                return
            tool, first = fresh(), False
        if not rest:
            more = next(source, None)
            if more is None:
                return
            rest = memoryview(more)  # its slices are no copies
        try:
            if packing == "zstd":
                out, rest = tool.decompress(rest[:64]), rest[64:]  # a few bytes may be very many
                rest = tool.unused_data + bytes(rest) if tool.eof else rest
            else:
                out = tool.decompress(rest, CHUNK)
                rest = tool.unused_data if tool.eof else tool.unconsumed_tail
        except Exception:
            if first:
                raise
            yield from itertools.chain([b"\n", bytes(rest)], source)
            return
        if out:
            yield out
        if tool.eof:
            tool = None


def _layers_of(raw: bytes) -> Iterator[bytes] | None:
    """The innermost decompressed data of ``raw``; None if it is not compressed."""
    source, head = iter([raw]), raw[:4]
    seen = False
    while (packing := _packing(head)) is not None:
        inner = _chunks(source, packing)
        start = b""
        try:
            while len(start) < 4 and (more := next(inner, None)) is not None:
                start += more
        except Exception:  # not what its first bytes promise
            if not seen:
                return None
            break
        if start[:4] == head and start == raw:  # reproduces itself
            break
        seen, head, source = True, start[:4], itertools.chain([start], inner)
        raw = start
    return source if seen else None


def _inflated(raw: bytes) -> tuple[bytes | None, bool]:
    """Decompressed gzip, zlib or zstd data, or None; and whether it is too large for one layer."""
    chunks = _layers_of(raw)
    if chunks is None:
        return None, False
    out, size = [], 0
    try:
        for chunk in chunks:
            out.append(chunk)
            size += len(chunk)
            if size > MAX_LAYER:
                return None, True
    except Exception:
        return None, False
    return b"".join(out), False


class Stream:
    """The windows of a large compressed layer, as layers; ``closed`` tells of parts not opened."""

    def __init__(self, raw: bytes, low: int, high: int, depth: int):
        self.span, self.depth, self.closed = (low, high), depth, False
        self.windows = self._read(raw)

    def _read(self, raw: bytes) -> Iterator[Layer]:
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        held, after = [], 0

        def layer(text: str) -> Layer:
            return _flat(text, *self.span, self.depth)

        chunks = _layers_of(raw)
        while True:
            try:
                chunk = next(chunks, None)
            except Exception:  # damaged from here on
                self.closed, chunk = True, None
            held.append(decoder.decode(chunk or b"", chunk is None))
            after += len(held[-1])
            if chunk is None:
                yield layer("".join(held))
                return
            if after <= min(WINDOW, MAX_LAYER):
                continue
            text = "".join(held)
            last = None
            for last in _CUT.finditer(text, max(0, len(text) - 2 * CHUNK)):
                pass
            if last is not None:
                yield layer(text[: last.end()])
                held = [text[last.end() :]]
                after = len(held[0])
            elif len(text) > MAX_LAYER:
                self.closed, held, after = True, [], 0
            else:
                held, after = [text], len(text) - CHUNK


def _flat(text: str, low: int, high: int, depth: int) -> Layer:
    """A layer whose characters all come from the same span."""
    return Layer(text, np.broadcast_to(np.int64(low), len(text)), np.broadcast_to(np.int64(high), len(text)), depth)


def _runs(text: str) -> Iterator[list[tuple[int, int]]]:
    """The base64 runs of a text, each as the (start, end) of its lines: every run within a line; every
    run over single line breaks, whole, from its second line on, and each block of lines of equal
    length with a shorter last one."""
    for match in _BASE64.finditer(text):
        yield [match.span()]
    if "\n" not in text:
        return
    for match in _WRAPPED.finditer(text):
        lines = [m.span() for m in _LINE.finditer(text, *match.span())]
        yield lines
        if len(lines) > 2:
            yield lines[1:]
        size = [b - a for a, b in lines]
        first = 0
        for i in range(1, len(lines) + 1):
            if i == len(lines) or size[i] != size[first]:
                stop = i + 1 if i < len(lines) and size[i] < size[first] else i
                if stop - first > 1 and (first, stop) not in ((0, len(lines)), (1, len(lines))):
                    yield lines[first:stop]
                first = i


def _unpacked(layer: Layer) -> tuple[list[Layer], list[Stream]]:
    """Layers inside the base64 runs of a layer, and those too large to be opened as a whole."""
    out, streams = [], []
    for lines in _runs(layer.text):
        whole = "".join(layer.text[a:b] for a, b in lines).rstrip("=").replace("-", "+").replace("_", "/")
        maps = None
        for shift in range(4):
            code = whole[shift:]
            code = code[: len(code) - (len(code) % 4 == 1)]
            raw = base64.b64decode(code + "=" * (-len(code) % 4))
            packed = [m.start() for m in _MEMBER.finditer(raw)]
            if not shift and _packing(raw) == "zlib" and packed[:1] != [0]:
                packed.insert(0, 0)
            opened = large = None
            for at in packed:  # what is inside a member is not looked for apart
                opened, large = _inflated(raw[at:])
                if large or opened is not None:
                    break
            if large or opened is not None:
                low, high = layer.span(lines[0][0], lines[-1][1])
                if large:
                    streams.append(Stream(raw[at:], low, high, layer.depth + 1))
                else:
                    out.append(_flat(opened.decode("utf-8", "replace"), low, high, layer.depth + 1))
                raw = raw[:at]
            wide = list(_STRETCH_16.finditer(raw))
            if not wide and not _STRETCH.search(raw):
                continue
            if maps is None:
                maps = tuple(np.concatenate(m) for m in zip(*(layer.maps(a, b) for a, b in lines)))
            # byte i is written by the characters 4i/3 to 4(i+1)/3 of the run
            first, last = (m[shift:] for m in maps)

            def opens(text: str, begins: np.ndarray, ends: np.ndarray) -> Layer:
                return Layer(text, first[begins * 4 // 3], last[-(-ends * 4 // 3) - 1], layer.depth + 1)

            for match in wide:
                begins = np.arange(match.start(), match.end(), 2)
                out.append(opens(match[0].replace(b"\0", b"").decode("ascii"), begins, begins + 2))
            if _STRETCH.search(raw):
                known = _is_utf8(raw)
                text = raw.decode("utf-8" if known else "latin-1")
                ends = np.cumsum([len(c.encode()) for c in text]) if known else np.arange(1, len(raw) + 1)
                out.append(opens(text, np.concatenate([[0], ends[:-1]]), ends))
    return out, streams


def find(text: str) -> tuple[list[tuple[int, int, int, int]], int]:
    """(start, kind, end, depth) of all secrets, each span and kind once with its least depth, by
    start, kind and end; and the number of layers with a part that was not opened."""
    found: dict[tuple[int, int, int], int] = {}
    seen: dict[tuple[int, int, int], int] = {}
    work, streams, closed = deque([Layer(text, None, None)]), deque(), 0
    while work or streams:
        if not work:  # a window and all that is in it, then the next one
            window = next(streams[-1].windows, None)
            if window is None:
                closed += streams.pop().closed
                continue
            work.append(window)
        layer = work.popleft()
        for start, kind, end in scan(layer.text):
            low, high = layer.span(start, end)
            key = (low, kind, high)
            found[key] = min(found.get(key, layer.depth), layer.depth)
        inner, large = _unpacked(layer)
        streams += large
        if "%" in layer.text:
            inner.append(_replaced(layer, _PERCENT, _percent))
        if "\\" in layer.text or "&" in layer.text:
            inner.append(_replaced(layer, _ESCAPE, _escape))
        for new in inner:
            if new is None or not new.text:
                continue
            key = (hash(new.text), int(new.first[0]), int(new.last[-1]))
            if new.text != layer.text and seen.get(key, new.depth + 1) > new.depth:
                seen[key] = new.depth
                work.append(new)
    return sorted((*k, depth) for k, depth in found.items()), closed


SECRETS = (
    "doc_id long, secrets array<struct<kind: string, start: long, end: long, depth: int>>, n_unopened long"
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("depth", pa.int32())]))
    for batch in batches:
        rows, unopened = [], []
        for text in batch.column("text"):
            found, closed = find(text.as_py() or "")
            rows.append([{"kind": KINDS[k], "start": s, "end": e, "depth": d} for s, k, e, d in found])
            unopened.append(closed)
        yield pa.record_batch(
            [batch.column("doc_id"), pa.array(rows, kind), pa.array(unopened, pa.int64())],
            names=["doc_id", "secrets", "n_unopened"],
        )


def secrets(docs: DataFrame) -> DataFrame:
    """Secrets of every row of ``docs`` (doc_id, text): columns of SECRETS, spans in code points of the
    original text, end exclusive, by start and kind; depth 0 means written openly.

    Null and empty texts have none; null and repeated doc_ids are kept; other columns are ignored.
    """
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(_scan, SECRETS)


def summary(found: DataFrame) -> DataFrame:
    """Counts and digests of the secrets written openly, and the spans of all."""

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def listed(column: str):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.withColumn("base", F.filter("secrets", lambda s: s["depth"] == 0)).select(
        "doc_id",
        *[count(kind) for kind in KINDS],
        F.sha2(listed("base"), 256).alias("base_sha256"),
        listed("secrets").alias("spans"),
        "n_unopened",
    )
