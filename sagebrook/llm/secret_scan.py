"""Secrets in texts and in what is encoded in them: a worklist of layers, unwrapped to the fixpoint.

A layer is a text with a map back to the code points of the document. The
document is the first layer. From each layer come the layer with its URL and
Unicode escapes resolved, and one for each base64 run that holds a text or a
compressed text. Every layer is scanned for all kinds; a span found in it counts
at the place in the document that the layer, or the part of it, came from.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import io
import re
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Fixed patterns of the three kinds, in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: One of these is in every name of an assignment.
_IN_EVERY = ("passw", "secret", "token", "api")
#: With the least length in the pattern these two find the same as when shorter matches are dropped: a run begins where it begins.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_VALUE = 12

_ESCAPE = re.compile(r"(?:%[0-9A-Fa-f]{2})+|\\u\{[0-9A-Fa-f]{1,6}\}|(?:\\u[0-9A-Fa-f]{4})+|\\U[0-9A-Fa-f]{8}|(?:\\x[0-9A-Fa-f]{2})+|&#[xX][0-9A-Fa-f]{1,6};|&#[0-9]{1,7};")
#: Base64 of 12 bytes and more, either alphabet.
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: First bytes of gzip and zlib.
_PACKED = (b"\x1f\x8b", b"\x78\x01", b"\x78\x5e", b"\x78\x9c", b"\x78\xda")
_CONTROL = re.compile(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]")
#: Bytes that the layers of one document may unwrap to; a document beyond it is marked unfinished.
BUDGET = 1 << 28


class _Layer:
    """A text, and where its code points lie in the layer that it came from."""

    def __init__(self, text: str, parent: _Layer | None = None, codec: str | None = None):
        self.text, self.parent = text, parent
        self.codecs: tuple[str, ...] = (*parent.codecs, codec) if parent else ()

    def outer(self, start: int, end: int) -> tuple[int, int]:
        """Where the code points from ``start`` to ``end`` (not empty) come from, in the parent."""
        raise NotImplementedError

    def span(self, start: int, end: int) -> tuple[int, int]:
        """The same in the document."""
        layer = self
        while layer.parent is not None:
            (start, end), layer = layer.outer(start, end), layer.parent
        return start, end


class _Unescaped(_Layer):
    """The parent with its escapes resolved. A run of escapes, at ``at`` to ``upto``, comes from ``first`` to ``last`` of the parent."""

    def __init__(self, text: str, parent: _Layer, runs: tuple[array, array, array, array]):
        super().__init__(text, parent, "escape")
        self.at, self.upto, self.first, self.last = runs

    def _place(self, p: int) -> tuple[int, int]:
        i = bisect.bisect_right(self.at, p) - 1
        if i < 0:
            return p, p + 1
        if p >= self.upto[i]:
            return (q := self.last[i] + p - self.upto[i]), q + 1
        wide, signs = self.upto[i] - self.at[i], self.last[i] - self.first[i]
        unit = {"%": 3, "\\u": 6, "\\x": 4}.get(self.parent.text[self.first[i] : self.first[i] + 2].rstrip("0123456789abcdefABCDEF"))
        if unit and wide * unit == signs:  # an escape for each code point
            return (q := self.first[i] + (p - self.at[i]) * unit), q + unit
        return self.first[i], self.last[i]

    def outer(self, start: int, end: int) -> tuple[int, int]:
        return self._place(start)[0], self._place(end - 1)[1]


class _Decoded(_Layer):
    """What the base64 run from ``first`` to ``last`` of the parent holds, ``packed`` if compressed."""

    def __init__(self, text: str, parent: _Layer, first: int, last: int, packed: int):
        super().__init__(text, parent, "base64")
        self.codecs += ("compressed",) * packed
        self.first, self.last, self.packed = first, last, packed

    def outer(self, start: int, end: int) -> tuple[int, int]:
        if self.packed:  # any part of it needs the whole run
            return self.first, self.last
        a, b = len(self.text[:start].encode()), len(self.text[:end].encode())
        return self.first + a // 3 * 4, min(self.first + ((b - 1) // 3 + 1) * 4, self.last)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each match in a text, in order; of an assignment the whole match."""
    found, low = [], text.lower()
    if any(word in low for word in _IN_EVERY):  # far faster than the pattern, which most texts needn't see
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= LEAST_VALUE]
    found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return in_order(found)


def in_order(spans) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def _resolved(match: str) -> str:
    """What a run of escapes of one sort stands for; itself if that is no text."""
    try:
        if match[0] == "%":
            return bytes.fromhex(match.replace("%", "")).decode()
        if match[0] == "&":
            return chr(int(match[3:-1], 16) if match[2] in "xX" else int(match[2:-1]))
        if match[1] == "x":
            return bytes.fromhex(match.replace("\\x", "")).decode()
        if match[2] == "{":
            return chr(int(match[3:-1], 16))
        if match[1] == "U":
            return chr(int(match[2:], 16))
        return bytes.fromhex(match.replace("\\u", "")).decode("utf-16-be")
    except (ValueError, OverflowError):
        return match


def _unescaped(layer: _Layer) -> _Layer | None:
    """The layer with all escapes resolved; None if that changes nothing. Surrogates that stand alone stay escaped."""
    if not any(sign in layer.text for sign in ("%", "\\u", "\\U", "\\x", "&#")):
        return None
    runs = tuple(array("q") for _ in range(4))
    out, size, done = io.StringIO(), 0, 0
    for m in _ESCAPE.finditer(layer.text):
        new = _resolved(m.group())
        if new == m.group() or any("\ud800" <= c <= "\udfff" for c in new):
            continue
        out.write(layer.text[done : m.start()])
        out.write(new)
        size += m.start() - done
        for places, p in zip(runs, (size, size + len(new), m.start(), m.end())):
            places.append(p)
        size, done = size + len(new), m.end()
    if not done:
        return None
    out.write(layer.text[done:])
    return _Unescaped(out.getvalue(), layer, runs)


def _inflated(data: bytes, most: int) -> bytes | None:
    """The content of a gzip or zlib stream, None if it is none; OverflowError beyond ``most`` bytes."""
    try:
        stream = zlib.decompressobj(wbits=47)  # either header
        out = stream.decompress(data, most + 1)
        if len(out) > most:
            raise OverflowError
        return out if stream.eof else None
    except zlib.error:
        return None


def _encoded(layer: _Layer, left: int) -> Iterator[_Layer]:
    """A layer for each base64 run that holds a text, or a compressed one; OverflowError beyond ``left`` bytes of compressed ones."""
    for m in _BASE64.finditer(layer.text):
        run = m.group().rstrip("=")
        if len(run) % 4 == 1:
            continue
        data = base64.urlsafe_b64decode(run.replace("+", "-").replace("/", "_") + "=" * (-len(run) % 4))
        packed, met = 0, set()
        while data.startswith(_PACKED) and (mark := hashlib.sha256(data).digest()) not in met:  # a stream may inflate to itself
            met.add(mark)
            if (inner := _inflated(data, left)) is None:
                break
            left -= len(inner)
            data, packed = inner, packed + 1
        try:
            text = data.decode()
        except UnicodeDecodeError:
            continue
        if text and not _CONTROL.search(text):
            yield _Decoded(text, layer, m.start(), m.end(), packed)


def scan(text: str, budget: int = BUDGET) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str, tuple[str, ...]]], int, bool]:
    """Base spans of a text; spans that only its layers have, with their codecs; the number of layers; whether all layers were unwrapped.

    A layer that was met at the same place with the same text isn't worked again, so that texts that unwrap to themselves end.
    """
    base = base_spans(text)
    known, added = set(base), {}
    work = [_Layer(text)]
    seen: set[tuple[int, int, bytes]] = set()
    layers, whole = 1, True
    while work:
        layer = work.pop()
        fresh: list[_Layer] = []
        try:
            if (plain := _unescaped(layer)) is not None:
                fresh.append(plain)
            fresh.extend(_encoded(layer, budget))
        except OverflowError:
            whole = False
        for new in fresh:
            if not new.text:
                continue
            mark = (*new.span(0, len(new.text)), hashlib.sha256(new.text.encode()).digest())
            if mark in seen:
                continue
            seen.add(mark)
            budget -= len(new.text)
            if budget < 0:
                whole = False
                break
            layers += 1
            for start, end, kind in base_spans(new.text):
                span = (*new.span(start, end), kind)
                if span not in known:
                    known.add(span)
                    added[span] = new.codecs
            work.append(new)
    return base, [(*s, added[s]) for s in in_order(added)], layers, whole


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, added, layers, finished) for each row of ``docs``.

    ``spans`` lists base and added spans as kind:start:end; ``added`` has the spans that
    only a decoded layer shows, with the codecs that lead to it. Places are code points of the
    document, ends exclusive. Null and empty texts have no spans (the hash of the empty text); null ids and repeated rows
    give a row each; other columns of ``docs`` don't matter; an empty table gives an empty one. A row is worked by itself,
    so no group meets in a task. ``finished`` is false where layers unwrap to more than ``budget`` bytes (an archive
    made to explode): base spans and those of the layers so far are there, and a larger budget finds the rest.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("codecs", pa.list_(pa.string()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(1):
                base, added, layers, whole = scan(value.as_py(), budget)
                every = in_order([*base, *(a[:3] for a in added)])
                counts = [sum(s[2] == k for s in base) for k in KINDS]
                detail = [{"kind": k, "start": a, "end": b, "codecs": list(codecs)} for a, b, k, codecs in added]
                out.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), detail, layers, whole))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(item), pa.int64(), pa.bool_())
            columns = [pa.array([r[n] for r in out], t) for n, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "added", "layers", "finished"])

    return rows.mapInArrow(work, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
                                 "added array<struct<kind:string,start:long,end:long,codecs:array<string>>>, layers long, finished boolean")
