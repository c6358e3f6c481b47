"""Secrets in texts, also below layers of encoding.

Three rules find secrets in the text itself. Then a worklist unwraps it: stretches
in URL, Unicode or base64 encoding, UTF-16 within decoded bytes, and what is
compressed (gzip, zlib, bzip2) within any decoded bytes become new layers, which are
searched by the same rules and unwrapped in turn until nothing new comes up. A layer that a text has had before is not opened again, so texts
that decode to themselves or to each other end. Every character of a layer knows
the stretch of the text it came from; a find is reported at that stretch, unless a
rule found the same kind there already.

Bytes that are no text break a layer's words and nothing else. Base64 is read over
line ends and from any character of a run, whatever stands in front of it.

Rules for odd rows: a null text is empty and has no spans. Rows that repeat a
doc_id are searched each. Compressed layers of any size are opened in windows of
about ``WINDOW`` bytes, cut only where nothing that is looked for goes on; memory
grows with the longest stretch without such a place. What is compressed again as a
whole is read as a stream, however large; compressed data that begins in the midst
of a larger layer is read up to the end of its window.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritlens.llm.textbuf import Texts, small_slices

KINDS = ("assign", "access", "hex")
WINDOW, OVERLAP = 1 << 22, 1 << 12

# What counts as a secret.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a shorter run of these is no match, and a run has only one
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

URL = re.compile(r"(?:[A-Za-z0-9._~+/=:&?@!$'()*,;-]|%[0-9A-Fa-f]{2})*%[0-9A-Fa-f]{2}(?:[A-Za-z0-9._~+/=:&?@!$'()*,;-]|%[0-9A-Fa-f]{2})*")
URL_UNIT = re.compile(r"%[0-9A-Fa-f]{2}")
UNICODE_UNIT = re.compile(r"\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
# Such runs parted only by line ends and what the lines are indented by.
BLOCK = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
# How gzip and zlib begin in base64.
PACKED = re.compile(r"H4[s-v]|eA[E-H]|eF[4-7]|eJ[w-z]|eN[o-r]")
PIECE = 1 << 10
# Where a window may end: behind a byte that is no readable text; behind a line that no base64 run
# ends; at a space that stands neither in a row of white space nor at the sign of an assignment.
CUT = re.compile(rb"[^\t\n\r\x20-\x7e]|(?<![A-Za-z0-9+/_\r-])\n|(?<=[^\s:=]) (?=[^\s:=])")
# No secret, and no layer that could hold one, is shorter.
READABLE = re.compile(rb"[\t\n\r\x20-\x7e]{12}")
# How compressed data begins, and text of two bytes a character.
MAGIC = re.compile(rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9]1AY&SY")
HEAD = 10  # bytes of the longest
WIDE = re.compile("(?:[\t\n\r\x20-\x7e]\0){12,}|(?:\0[\t\n\r\x20-\x7e]){12,}")
WIDE_BYTES = re.compile(WIDE.pattern.encode())
_WORDS = ("passw", "secret", "token", "api")

_RUN = np.zeros(256, bool)
_RUN[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"]] = True


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what the rules find in a text, in the order of report."""
    found = []
    if ("=" in text or ":" in text) and any(w in text.lower() for w in _WORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=_order)


def _order(span):
    return span[0], KINDS.index(span[2]), span[1]


class Layer:
    """A decoded text, and for each character the stretch of the original that it came from."""

    __slots__ = ("text", "start", "end", "decoded")

    def __init__(self, text: str, start, end, decoded: bool = True):
        self.text, self.start, self.end, self.decoded = text, start, end, decoded

    def stretch(self, a: int, b: int) -> tuple[int, int]:
        return self.start[a], self.end[b - 1]

    def same(self) -> tuple[_Same, _Same] | None:
        """The places if every character has the same."""
        return (self.start, self.end) if isinstance(self.start, _Same) else None


def _may_hold(data: bytes) -> bool:
    """Whether there can be a secret or a further layer in decoded bytes."""
    return bool(READABLE.search(data) or MAGIC.search(data) or WIDE_BYTES.search(data))


def _from_bytes(layer: Layer, data: bytes, place) -> Layer | None:
    """A layer of text below ``layer``; ``place`` gives each byte's stretch. Every odd byte is a character that no rule takes."""
    if not _may_hold(data):
        return None
    text = data.decode("utf-8", "surrogateescape")
    if same := layer.same():
        return Layer(text, *same)
    start, end, at = [], [], 0
    for c in text:
        size = 1 if c < "\x80" or "\udc80" <= c <= "\udcff" else len(c.encode())
        start.append(place(at)[0])
        end.append(place(at + size - 1)[1])
        at += size
    return Layer(text, start, end)


def _url_decoded(layer: Layer, a: int, b: int) -> Layer | None:
    """The stretch a to b, which is ASCII, with its escapes undone."""
    raw, places, at = bytearray(), [], a
    for m in URL_UNIT.finditer(layer.text, a, b):
        raw += layer.text[at : m.start()].encode()
        places += [(i, i + 1) for i in range(at, m.start())]
        raw.append(int(m[0][1:], 16))
        places.append(m.span())
        at = m.end()
    raw += layer.text[at:b].encode()
    places += [(i, i + 1) for i in range(at, b)]
    return _from_bytes(layer, bytes(raw), lambda k: layer.stretch(*places[k]))


def _unescaped(layer: Layer, a: int, b: int) -> Layer:
    """The stretch a to b with its Unicode escapes undone; two halves of a character become one."""
    chars, places, at = [], [], a
    for m in UNICODE_UNIT.finditer(layer.text, a, b):
        chars += layer.text[at : m.start()]
        places += [(i, i + 1) for i in range(at, m.start())]
        code = min(int(m[0][2:].strip("{}"), 16), 0x110000)
        if code == 0x110000:  # no character
            chars.append("\ufffd")
            places.append(m.span())
        elif 0xDC00 <= code < 0xE000 and m.start() == at > a and "\ud800" <= chars[-1] <= "\udbff":
            chars[-1] = chr(0x10000 + (ord(chars[-1]) - 0xD800 << 10) + code - 0xDC00)
            places[-1] = places[-1][0], m.end()
        else:
            chars.append(chr(code))
            places.append(m.span())
        at = m.end()
    chars += layer.text[at:b]
    places += [(i, i + 1) for i in range(at, b)]
    found = [layer.stretch(*place) for place in places]
    return Layer("".join(chars), [x for x, _ in found], [y for _, y in found])


def _decoded(raw: str) -> bytes:
    """Base64 without padding; a last character that is no whole byte is left out."""
    raw = raw[: len(raw) - (len(raw) % 4 == 1)]
    return binascii.a2b_base64(raw + "=" * (-len(raw) % 4))


def _opened(raw: str, at: int) -> Iterator[tuple[int, bytes]]:
    """What gzip or zlib members from place ``at`` of a base64 run hold, in pieces up to the end or first fault.

    With each piece comes the place up to which the run was read for it.
    """
    opener, size, start = zlib.decompressobj(47), PIECE, at
    try:
        while at < len(raw):
            data = _decoded(raw[at : at + size])
            at, size = min(at + size, len(raw)), min(2 * size, 1 << 20)
            used = (at - start) * 3 // 4
            while data:
                out = opener.decompress(data, WINDOW)
                data = opener.unused_data if opener.eof else opener.unconsumed_tail
                yield start - (used - len(data)) * 4 // -3, out
                if opener.eof:
                    opener = zlib.decompressobj(47)
        while out := opener.decompress(b"", WINDOW):
            yield at, out
    except zlib.error:
        return


def _inflated(raw: str, at: int, stretch) -> Iterator[Layer]:
    """Windows of what is compressed from place ``at``; every character stands for the whole stretch."""
    end = max((place for place, _ in _opened(raw, at)), default=at)
    if end == at:
        return
    whole = stretch(at, min(end, len(raw)))
    yield from _streamed(lambda: (piece for _, piece in _opened(raw, at)), whole)


def _streamed(opened: Callable[[], Iterator[bytes]], whole: tuple[int, int]) -> Iterator[Layer]:
    """The windows of a stream, and those of the streams it is made of as long as each is compressed again."""
    seen = set()
    while True:
        for window in _windows(opened()):
            if _may_hold(window):
                yield Layer(window.decode("utf-8", "surrogateescape"), _Same(whole[0]), _Same(whole[1]))
        head = b""
        for piece in opened():
            head += piece[: WINDOW - len(head)]
            if len(head) >= WINDOW:
                break
        mark = hashlib.sha1(head).digest()
        if mark in seen or not MAGIC.match(head):
            return
        seen.add(mark)
        opened = lambda below=opened: _Reader().members(below())


class _Reader:
    """Reads compressed members one behind the other; ``used`` counts the bytes that were read for what came out."""

    def __init__(self):
        self.used = 0

    def members(self, pieces: Iterator[bytes]) -> Iterator[bytes]:
        data, opener = b"", None
        try:
            for piece in pieces:
                data += piece
                while data:
                    if opener is None:
                        if len(data) < HEAD and len(piece) >= HEAD:
                            break
                        if not MAGIC.match(data):
                            return
                        opener = bz2.BZ2Decompressor() if data[:1] == b"B" else zlib.decompressobj(47)
                    before = len(data)
                    if isinstance(opener, bz2.BZ2Decompressor):
                        out = opener.decompress(data, WINDOW)
                        while out and not opener.eof and not opener.needs_input:
                            yield out
                            out = opener.decompress(b"", WINDOW)
                        data = opener.unused_data if opener.eof else b""
                    else:
                        out = opener.decompress(data, WINDOW)
                        data = opener.unused_data if opener.eof else opener.unconsumed_tail
                    self.used += before - len(data)
                    if out:
                        yield out
                    if opener.eof:
                        opener = None
        except (zlib.error, OSError, EOFError, ValueError):
            return


def _members(layer: Layer) -> Iterator[Layer]:
    """What is compressed within the bytes of a layer, wherever it begins."""
    views = [(layer.text.encode("utf-8", "surrogateescape"), True)] if _encodable(layer.text) else []
    if not layer.text.isascii() and max(layer.text) < "\u0100":
        views.append((layer.text.encode("latin-1"), False))  # escapes that stand for bytes
    for data, wide in views:
        ends, until = None, 0
        for m in MAGIC.finditer(data):
            at, reader = m.start(), _Reader()
            if at < until:  # read as a part of what begins before
                continue
            size = sum(len(out) for out in reader.members(iter([data[at:]])))
            if size < HEAD:
                continue
            until = at + reader.used
            low, high = at, until
            if wide and not layer.same():
                ends = ends or list(accumulate(1 if c < "\x80" or "\udc80" <= c <= "\udcff" else len(c.encode()) for c in layer.text))
                low, high = bisect_right(ends, low), bisect_right(ends, high - 1) + 1
            elif wide:
                low, high = 0, 1
            yield from _streamed(lambda a=at, d=data: _Reader().members(iter([d[a:]])), layer.stretch(low, high))


def _encodable(text: str) -> bool:
    try:
        text.encode("utf-8", "surrogateescape")
    except UnicodeEncodeError:
        return False
    return True


def _narrowed(layer: Layer) -> Iterator[Layer]:
    """Text of two bytes a character, as one of one."""
    for m in WIDE.finditer(layer.text):
        a, b = m.span()
        text = m[0].replace("\0", "")
        if same := layer.same():
            yield Layer(text, *same)
        else:
            pairs = [layer.stretch(i, i + 2) for i in range(a, b, 2)]
            yield Layer(text, [x for x, _ in pairs], [y for _, y in pairs])


def _windows(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The pieces in windows of about ``WINDOW`` bytes or more, each up to the last CUT in it.

    What overlaps into the next window is what stands behind the cut. Rows of spaces
    are shortened to ``OVERLAP``: no rule counts them.
    """
    spaces = re.compile(rb" {%d,}" % OVERLAP)
    parts, size, least = [], 0, WINDOW
    for piece in pieces:
        parts.append(piece)
        size += len(piece)
        if size < least:
            continue
        data = spaces.sub(b" " * OVERLAP, b"".join(parts))
        at = 0
        for back in (1 << 12, 1 << 16, len(data)):
            at = at or max((m.end() for m in CUT.finditer(data, max(0, len(data) - back))), default=0)
        if at:
            yield data[:at]
        parts, size = [data[at:]], len(data) - at
        least = max(WINDOW, 2 * size)  # a stretch without a cut is not looked through at every piece
    yield spaces.sub(b" " * OVERLAP, b"".join(parts))


class _Same:
    """The same place for every character."""

    def __init__(self, value: int):
        self.value = value

    def __getitem__(self, _):
        return self.value


def _unwrapped(layer: Layer) -> Iterator[Layer]:
    text = layer.text
    if layer.decoded:
        yield from _members(layer)
        if "\0" in text:
            yield from _narrowed(layer)
    if "%" in text:
        for m in URL.finditer(text):
            found = _url_decoded(layer, *m.span())
            if found:
                yield found
    if "\\" in text:
        stretch = None
        for m in UNICODE_UNIT.finditer(text):
            # neighbouring escapes and what no space parts from them belong together
            if stretch and not re.search(r"\s", text[stretch[1] : m.start()]):
                stretch = (stretch[0], m.end())
                continue
            if stretch:
                yield _around(layer, stretch)
            stretch = m.span()
        if stretch:
            yield _around(layer, stretch)
    joined = 0
    blocks = BLOCK.finditer(text) if "\n" in text else iter(())
    block = next(blocks, None)
    for m in BASE64.finditer(text):
        while block and block.start() <= m.start():
            places = [i for i in range(*block.span()) if text[i] not in "\r\n\t ="]
            yield from _base64_layers(layer, "".join([text[i] for i in places]), places, True)
            joined, block = block.end(), next(blocks, None)
        yield from _base64_layers(layer, m[0].rstrip("="), range(*m.span()), m.start() >= joined)


def _base64_layers(layer: Layer, raw: str, places, whole: bool) -> Iterator[Layer]:
    """What a run holds that begins with any of its characters: all four ways to count them off.

    Compressed data is opened in whole runs, not in single lines of them.
    """
    raw = raw.translate(_URL_SAFE)
    for m in PACKED.finditer(raw) if whole else ():
        yield from _inflated(raw, m.start(), lambda a, b: layer.stretch(places[a], places[b - 1] + 1))
    for shift in range(4):
        found = _from_bytes(
            layer,
            _decoded(raw[shift:]),
            lambda k, a=shift: layer.stretch(places[a + k * 8 // 6], places[a + (k * 8 + 7) // 6] + 1),
        )
        if found:
            yield found


_URL_SAFE = str.maketrans("-_", "+/")


def _around(layer: Layer, stretch: tuple[int, int]) -> Layer:
    """The word that a stretch of escapes lies in, decoded."""
    a, b = stretch
    while a and not layer.text[a - 1].isspace():
        a -= 1
    while b < len(layer.text) and not layer.text[b].isspace():
        b += 1
    return _unescaped(layer, a, b)


def hidden_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans of the text below which some layer holds a secret."""
    taken = {kind: [(a, b) for a, b, k in base if k == kind] for kind in KINDS}
    found: set[tuple[int, int, str]] = set()
    seen = {hashlib.sha1(text.encode("utf-8", "surrogatepass")).digest()}
    work = [Layer(text, range(len(text)), range(1, len(text) + 1), decoded=False)]
    while work:
        for inner in _unwrapped(work.pop()):
            mark = hashlib.sha1(inner.text.encode("utf-8", "surrogatepass") + repr((inner.start[0], inner.end[0])).encode()).digest()
            if mark in seen:
                continue
            seen.add(mark)
            work.append(inner)
            for a, b, kind in base_spans(inner.text):
                a, b = inner.stretch(a, b)
                if not any(a < y and x < b for x, y in taken[kind]):
                    found.add((a, b, kind))
    # a secret that goes on in the next line of its block was also found up to the line's end
    longest = {(a, kind): b for a, b, kind in sorted(found)}
    return sorted(((a, b, kind) for (a, kind), b in longest.items()), key=_order)


def _named(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def _long_runs(texts: Texts, least: int = 16) -> np.ndarray:
    """Whether each text has a run of ``least`` bytes that could be encoded data."""
    inside = np.concatenate([[False], _RUN[texts.data], [False]])
    edge = inside[1:] != inside[:-1]
    edge[texts.offsets] |= inside[texts.offsets] | inside[texts.offsets + 1]  # a run ends with its text
    edges = np.flatnonzero(edge)
    start = edges[:-1][(np.diff(edges) >= least) & inside[edges[:-1] + 1]]
    found = np.zeros(len(texts) + 1, bool)
    found[np.searchsorted(texts.offsets, start, "right") - 1] = True
    return found[: len(texts)]


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, texts in small_slices(batch, 1):
            column, base, every = rows.column(1), [], []
            for i, run in enumerate(_long_runs(texts).tolist()):
                text = column[i].as_py() or ""
                if not (run or "=" in text or ":" in text or "%" in text or "\\" in text):
                    base.append([]), every.append([])
                    continue
                spans = base_spans(text)
                base.append(spans)
                more = hidden_spans(text, spans) if run or "%" in text or "\\" in text else []
                every.append(sorted([*spans, *more], key=_order) if more else spans)
            names = [_named(x) for x in base]
            yield pa.record_batch({
                "doc_id": rows.column(0),
                **{f"n_{kind}": pa.array([sum(k == kind for _, _, k in x) for x in base], pa.int64()) for kind in KINDS},
                "base_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in names], pa.string()),
                "spans": pa.array([_named(x) for x in every], pa.string()),
            })


def secret_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for each document, where it lies."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        _find, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
    )
