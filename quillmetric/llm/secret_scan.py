"""Secret scans with a recursive decoding worklist.

A text is the first layer. URL escapes, Unicode escapes, base64 runs and compressed data in a layer give further layers, which
are scanned and unwrapped in their turn until nothing new appears. Every layer knows where its letters come from, so
each find is reported as a span of the document.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import html
import lzma
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from io import StringIO
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmetric.llm.work import slices, text_or_empty

KINDS = ("assign", "access", "hex")

#: What counts as a secret.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_VALUE = 8

_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|(?:\\x[0-9A-Fa-f]{2})+|&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_WRAPPED = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:(?:\r?\n|(?:\\r)?\\n)[ \t]*[A-Za-z0-9+/_-]+)+={0,2}")
_BREAK = re.compile(r"(?:\r?\n|(?:\\r)?\\n)[ \t]*")
_URL_BYTES = re.compile(r"[A-Za-z0-9_.~!*'()+/-]*%[0-9A-Fa-f]{2}(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9_.~!*'()+/-])*")
_X_BYTES = re.compile(r"(?:[\x20-\x5b\x5d-\x7e]|\\(?:x[0-9A-Fa-f]{2}|[\\'\"abfnrtv0]))+")
_URL_BYTE = re.compile(r"%([0-9A-Fa-f]{2})()|.")
_X_BYTE = re.compile(r"\\(?:x([0-9A-Fa-f]{2})|(.))|.")
_X_LETTERS = dict(zip("abfnrtv0", b"\x07\x08\x0c\n\r\t\x0b\0"))
_PACKED = re.compile(rb"\x1f\x8b\x08|BZh[1-9]|\xfd7zXZ\x00|[\x08\x18\x28\x38\x48\x58\x68\x78](?=[\x00-\xff])")
_WIDE = re.compile(r"(?:[\x01-\x7f]\x00){4,}|(?:\x00[\x01-\x7f]){4,}")
_UNPRINTABLE = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]")
_TO_STANDARD = str.maketrans("-_", "+/")

#: A compressed layer may grow to so many bytes; a larger one is counted as oversized and goes through in windows.
LAYER_BYTES = 64 * 1024 * 1024
#: Windows take so many new bytes after as many of those before.
WINDOW_BYTES = 4 * 1024 * 1024
BLOCK_BYTES = 1024 * 1024
#: What a place where compressed data may begin is tried with; most are no such data.
FIRST_BYTES = 1024
#: Places of letters are worked out for so many letters at a time.
BLOCK_LETTERS = 256 * 1024

FOUND = ("doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
         "n_layers long, n_oversized long")


def scan(text: str) -> list[tuple[int, int, int]]:
    """Spans ``(start, kind, end)`` of plain secrets, leftmost and not overlapping within a kind."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return found


@dataclass
class Layer:
    """A decoded text; letter k comes from ``starts[k]`` to ``ends[k]`` of the document, or all letters from ``span``.
    Without either it is the document."""

    text: str
    starts: array | None = None
    ends: array | None = None
    readable: bool = True
    span: tuple[int, int] | None = None

    def origin(self, start: int, end: int) -> tuple[int, int]:
        if self.span is not None:
            return self.span
        if self.starts is None:
            return start, end
        return self.starts[start], self.ends[end - 1]

    def key(self) -> tuple:
        place = self.origin(0, len(self.text)) if self.text else (0, 0)
        return (hashlib.sha256(self.text.encode("utf-8", "surrogatepass")).digest(), *place)


def _replaced(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with every match decoded; ``decode`` gives (letter, start, end in the match) triples, or None to leave it."""
    letters, starts, ends, at, changed = StringIO(newline=""), array("i"), array("i"), 0, False

    def copy(a: int, b: int) -> None:
        letters.write(layer.text[a:b])
        if layer.span is not None:
            return
        starts.extend(range(a, b) if layer.starts is None else layer.starts[a:b])
        ends.extend(range(a + 1, b + 1) if layer.ends is None else layer.ends[a:b])

    for m in pattern.finditer(layer.text):
        decoded = decode(m.group())
        if decoded is None:
            continue
        copy(at, m.start())
        for letter, a, b in decoded:
            start, end = layer.origin(m.start() + a, m.start() + b)
            letters.write(letter)
            starts.append(start)
            ends.append(end)
        at, changed = m.end(), True
    if not changed:
        return None
    copy(at, len(layer.text))
    if layer.span is not None:
        return Layer(letters.getvalue(), span=layer.span)
    return Layer(letters.getvalue(), starts, ends)


def _blocks_of_letters(raw: bytes) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Letters of UTF-8 bytes, in blocks, and the places among the bytes where each begins and ends; what is no UTF-8 counts byte by byte."""
    text, at = raw.decode("utf-8", "surrogateescape"), 0
    for k in range(0, len(text), BLOCK_LETTERS):
        codes = np.frombuffer(text[k:k + BLOCK_LETTERS].encode("utf-32-le", "surrogatepass"), "<u4")
        alone = (codes >= 0xDC80) & (codes <= 0xDCFF)  # a byte by itself: UTF-8 has no surrogates
        sizes = np.where(alone, 1, 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000))
        after = at + np.cumsum(sizes)
        at = int(after[-1])
        yield np.where(alone, codes - 0xDC00, codes).astype("<u4").tobytes().decode("utf-32-le"), after - sizes, after


def _letters_of_bytes(raw: bytes, width: int) -> Iterator[tuple[str, int, int]]:
    """Letters of UTF-8 bytes that are written ``width`` characters each; what is no UTF-8 counts byte by byte."""
    if raw.isascii():
        yield from zip(raw.decode(), range(0, len(raw) * width, width), range(width, len(raw) * width + 1, width))
        return
    for letters, first, after in _blocks_of_letters(raw):
        yield from zip(letters, (first * width).tolist(), (after * width).tolist())


def _text(raw: bytes) -> tuple[str, bool]:
    """The text of all bytes, what is no UTF-8 byte by byte, and whether it reads as plain text."""
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return "".join(letters for letters, _, _ in _blocks_of_letters(raw)), False
    return text, bool(text) and not _UNPRINTABLE.search(text)


def _wide(run: str) -> Iterator[tuple[str, int, int]]:
    """Letters of a run of UTF-16, in either order of bytes; each comes from two letters of the run."""
    return ((letter, 2 * k, 2 * k + 2) for k, letter in enumerate(run.replace("\0", "")))


def _url(run: str) -> Iterator[tuple[str, int, int]]:
    return _letters_of_bytes(bytes.fromhex(run.replace("%", "")), 3)


def _units(run: str) -> Iterator[tuple[str, int, int]]:
    """Letters of a run of four-digit escapes; two halves of a surrogate pair are one."""
    k = 0
    while k < len(run):
        unit, size = int(run[k + 2:k + 6], 16), 6
        if 0xD800 <= unit < 0xDC00 and k + 6 < len(run):
            low = int(run[k + 8:k + 12], 16)
            if 0xDC00 <= low < 0xE000:
                unit, size = 0x10000 + ((unit - 0xD800) << 10) + (low - 0xDC00), 12
        yield chr(unit), k, k + size
        k += size


def _unicode(run: str) -> Iterator[tuple[str, int, int]] | list[tuple[str, int, int]] | None:
    if run.startswith("&#"):
        return [(letter, 0, len(run)) for letter in html.unescape(run)]
    if run.startswith("\\x"):
        return _letters_of_bytes(bytes.fromhex(run.replace("\\x", "")), 4)
    if run.startswith("\\u") and run[2] != "{":
        return _units(run)
    code = int(run[3:-1] if run[2] == "{" else run[2:], 16)
    return [(chr(code), 0, len(run))] if code < 0x110000 else None


def _stream(raw: bytes, at: int):
    """A decompressor if gzip, zlib, bzip2 or xz data may begin there."""
    if raw[at] == 0x1F:
        return zlib.decompressobj(wbits=47)
    if raw[at] == 0x42:
        return bz2.BZ2Decompressor()
    if raw[at] == 0xFD:
        return lzma.LZMADecompressor()
    return zlib.decompressobj() if (raw[at] * 256 + raw[at + 1]) % 31 == 0 and not raw[at + 1] & 0x20 else None


def _plain_blocks(raw: bytes, at: int) -> Iterator[tuple[bytes, int | None]]:
    """Blocks of decompressed bytes from there on, members in a row as one; with the last whole member comes the place where it ends.

    Data that stop short or break give what comes before.
    """
    stream, fed, step = _stream(raw, at), at, FIRST_BYTES
    while stream is not None:
        try:
            while not stream.eof:
                data = getattr(stream, "unconsumed_tail", b"")
                if not data and getattr(stream, "needs_input", True):
                    data = raw[fed:fed + step]
                    fed, step = fed + len(data), min(BLOCK_BYTES, 4 * step)
                    if not data:
                        break
                block = stream.decompress(data, BLOCK_BYTES)
                if block:
                    yield block, None
        except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError):
            return
        if not stream.eof:
            return
        fed -= len(stream.unused_data)
        yield b"", fed
        while raw[fed:fed + 1] == b"\0":  # padding between members
            fed += 1
        stream = _stream(raw, fed) if _PACKED.match(raw, fed) else None


def _windows(kept: list[bytes], blocks: Iterator[tuple[bytes, int | None]], size: int) -> Iterator[tuple[bytes, int | None]]:
    """The bytes of the kept and the further blocks in windows that begin with ``size`` bytes of the one before, and where whole members end."""
    before, new = b"", bytearray()
    for block, end in chain(((k, None) for k in kept), blocks):
        new += block
        while len(new) >= size:
            window = before + new[:size]
            yield window, None
            before, new = window[-size:], new[size:]
        if end is not None:
            yield b"", end
    if new:
        yield before + bytes(new), None


def _packed_layers(raw: bytes, origin: Callable[[int, int], tuple[int, int]], limit: int | None,
                   outer: tuple[int, int] | None = None, seen: set[bytes] | None = None) -> Iterator[Layer | None]:
    """A layer for all compressed data that begin anywhere in the bytes, and for those inside. An oversized one gives None and, unless
    the caller set the limit, its windows.

    ``origin``: the span of the document that some of the bytes come from; ``outer``: the span of all of them.
    """
    waiting, seen = [(raw, outer)], set() if seen is None else seen
    most = LAYER_BYTES if limit is None else limit
    while waiting:
        raw, outer = waiting.pop()
        digest = hashlib.sha256(raw).digest()
        if digest in seen:  # a stream that holds itself
            continue
        seen.add(digest)
        at = 0
        while m := _PACKED.search(raw, at):
            at = m.start() + 1
            if len(raw) < at + 1 or _stream(raw, m.start()) is None:
                continue
            kept, size, whole, stop = [], 0, False, len(raw)
            blocks = _plain_blocks(raw, m.start())
            for block, end in blocks:
                if end is not None:
                    at, whole, stop = end, True, end
                size += len(block)
                kept.append(block)
                if size > most:
                    break
            if size > most:
                yield None
                if limit is not None:
                    continue
                place = outer or origin(m.start(), len(raw))
                for window, end in _windows(kept, blocks, WINDOW_BYTES):
                    if end is not None:
                        at = end
                        continue
                    yield Layer(_text(window)[0], readable=False, span=place)
                    yield from _packed_layers(window, origin, limit, place, seen)
                continue
            plain = b"".join(kept)
            if not plain:
                continue
            place = outer or origin(m.start(), stop)
            waiting.append((plain, place))
            text, readable = _text(plain)
            yield Layer(text, readable=readable and whole, span=place)


def _escaped_layers(layer: Layer, limit: int | None) -> Iterator[Layer | None]:
    """Layers of compressed data that are spelt in URL or byte escapes, letters that need none among them."""
    found = []
    if "%" in layer.text:
        found += [(m, _URL_BYTE) for m in _URL_BYTES.finditer(layer.text)]
    if "\\x" in layer.text:
        found += [(m, _X_BYTE) for m in _X_BYTES.finditer(layer.text) if "\\x" in m.group()]
    for m, unit in found:
        raw, places = bytearray(), array("i", [m.start()])
        pluses = []
        for x in unit.finditer(m.group()):
            if x[0] == "+":
                pluses.append(len(raw))
            raw.append(int(x[1], 16) if x[1] else _X_LETTERS.get(x[2], ord(x[2])) if x[2] else ord(x[0]))
            places.append(m.start() + x.end())
        readings = [bytes(raw)]
        if unit is _URL_BYTE and pluses:  # a plus stands for itself or for a blank
            for k in pluses:
                raw[k] = 0x20
            readings.append(bytes(raw))
        for data in readings:
            yield from _packed_layers(data, lambda a, b: layer.origin(places[a], places[b]), limit)


def _base64_runs(text: str) -> Iterator[tuple[str, array | range]]:
    """Base64 letters and their places, those of the padding last: every run of a line, and every run that goes on over line ends."""
    for m in _BASE64.finditer(text):
        yield m.group().rstrip("="), range(m.start(), m.end())
    if "\n" in text or "\\n" in text:
        for m in _WRAPPED.finditer(text):
            letters, places, at = StringIO(newline=""), array("i"), m.start()
            for gap in _BREAK.finditer(text, m.start(), m.end()):
                letters.write(text[at:gap.start()])
                places.extend(range(at, gap.start()))
                at = gap.end()
            letters.write(text[at:m.end()].rstrip("="))
            places.extend(range(at, m.end()))
            yield letters.getvalue(), places


def _mapped(layer: Layer, raw: bytes, places: array | range, skip: int) -> tuple[array, array]:
    """Where the letters of bytes come from that the base64 letters at ``places``, but for the first ``skip``, decode to: three bytes
    are four of these."""
    starts, ends = array("i"), array("i")
    for _, first, after in _blocks_of_letters(raw):
        a = skip + first // 3 * 4
        b = np.minimum(skip + (after - 1) // 3 * 4 + 4, len(places)) - 1
        if isinstance(places, range):
            a, b = a + places.start, b + places.start
        else:
            known = np.frombuffer(places, np.int32)
            a, b = known[a], known[b]
        if layer.starts is None:
            b = b + 1
        else:
            a, b = np.frombuffer(layer.starts, np.int32)[a], np.frombuffer(layer.ends, np.int32)[b]
        starts.frombytes(a.astype(np.int32).tobytes())
        ends.frombytes(b.astype(np.int32).tobytes())
    return starts, ends


def _base64_layers(layer: Layer, limit: int | None) -> Iterator[Layer | None]:
    """Layers for every base64 run, plain or compressed, begun at each of four letters, as a prefix may belong to the run;
    None for an oversized one."""
    for whole, places in _base64_runs(layer.text):
        whole = whole.translate(_TO_STANDARD)
        for skip in range(4):
            size = len(whole) - skip
            size -= size % 4 == 1
            raw = base64.b64decode(whole[skip:skip + size] + "=" * (-size % 4))
            if not raw:
                continue

            def origin(first: int, after: int) -> tuple[int, int]:
                return layer.origin(places[skip + first // 3 * 4], places[min(skip + (after - 1) // 3 * 4 + 4, len(places)) - 1] + 1)

            yield from _packed_layers(raw, origin, limit)
            text, readable = _text(raw)
            if layer.span is not None:
                yield Layer(text, readable=readable, span=layer.span)
            else:
                yield Layer(text, *_mapped(layer, raw, places, skip), readable)


def _inner_layers(layer: Layer, limit: int | None) -> Iterator[Layer | None]:
    """What one step of decoding gives, one layer at a time; None for an oversized one."""
    ways = [("\0" in layer.text, _WIDE, _wide), ("%" in layer.text, _URL, _url),
            ("\\" in layer.text or "&#" in layer.text, _UNICODE, _unicode)]
    for there, pattern, decode in ways:
        replaced = _replaced(layer, pattern, decode) if there else None
        if replaced is not None:
            yield replaced
    yield from chain(_base64_layers(layer, limit), _escaped_layers(layer, limit))


def unwrap(text: str, limit: int | None = None) -> tuple[set[tuple[int, int, int]], int, int]:
    """Spans of secrets in decoded layers, the number of layers that read as text or hold one, and how many were oversized.

    The worklist is a stack of steps that are not yet done: a layer is made when its turn comes and goes when all inside it is done, so
    a text's layers are in memory only along one path of decoding, with four bytes for each letter's beginning and end.
    """
    found: set[tuple[int, int, int]] = set()
    seen, layers, oversized = set(), 0, 0
    waiting: list[Iterator[Layer | None]] = [_inner_layers(Layer(text), limit)]
    while waiting:
        for layer in waiting[-1]:
            if layer is None:
                oversized += 1
                continue
            key = layer.key()
            if key in seen:  # the same text from the same place: a cycle or another order of decoding
                continue
            seen.add(key)
            spans = scan(layer.text)
            layers += layer.readable or bool(spans)
            for start, kind, end in spans:
                a, b = layer.origin(start, end)
                found.add((a, kind, b))
            waiting.append(_inner_layers(layer, limit))
            break
        else:
            waiting.pop()
    return found, layers, oversized


def _joined(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def find_secrets(docs: DataFrame, limit: int | None = None) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: counts and digest of plain secrets, and all spans with those of decoded layers.

    Offsets count code points, ends are exclusive. Null texts are empty. Spans found several times, by different orders of decoding,
    are listed once. ``n_layers``: decoded layers that read as text or hold a secret; other bytes are scanned as well, what is no UTF-8 byte by byte; ``n_oversized``: compressed runs beyond ``LAYER_BYTES``, which are
    scanned and unwrapped in overlapping windows of bounded size. Only with a ``limit`` those beyond so many bytes stay closed.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in FOUND.split(", ")]
        types = [pa.string() if f.endswith("string") else pa.int64() for f in FOUND.split(", ")]
        for batch in slices(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                base = scan(text)
                more, layers, oversized = unwrap(text, limit)
                counts = [sum(kind == k for _, kind, _ in base) for k in range(3)]
                rows.append((*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(more.union(base)), layers, oversized))
            columns = list(zip(*rows)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, types[1:])]], names)

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
            .mapInArrow(each, FOUND))
