"""Secrets in texts, also inside URL, Unicode, base64 and compressed layers.

A text is a worklist of layers. Each layer is scanned, then everything in it that decodes becomes
a layer of its own, until none is new. A layer knows which code points of the original text each of
its characters came from, so every finding is a span of the original.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lineamix.llm.common import table

#: Kinds in the order of results: pattern, group whose length counts, and that length at least.
KINDS = {
    "assign": (re.compile(
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
    ), 2, 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile(r"[0-9a-f]{16,}"), 0, 16),
}
#: A base64 run shorter than this holds no secret: the shortest one has 16 characters.
BASE64_RUN = 22
#: Decompressed layers are read in windows of so many bytes, which overlap.
WINDOW, OVERLAP = 16 << 20, 64 << 10

_ANY_BASE = (
    r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12}""",
    r"AKIA[A-Z0-9]{14}",
    r"[0-9a-f]{16}",
)
#: Letters in other shapes, and signs without width.
_ODD = "\uff01-\uff5e\U0001d400-\U0001d7ff\u200b-\u200d\u2060\ufeff\u00ad"
_ANY_LAYER = (r"%[0-9A-Fa-f]{2}|\\[uUx][0-9A-Fa-f{]|&#[0-9xX]", "[A-Za-z0-9+/_-]{22}", rf"[{_ODD}]")

_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(
    r"\\u[dD][89abAB][0-9A-Fa-f]{2}\\u[dD][c-fC-F][0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}"
    rf"|\\U[0-9A-Fa-f]{{8}}|(?:\\x[0-9A-Fa-f]{{2}})+|&#[0-9]{{1,7}};|&#[xX][0-9A-Fa-f]{{1,6}};|[{_ODD}]"
)
_BASE64 = re.compile(
    r"(?:(?:[A-Za-z0-9+/]{76}\r?\n)+|(?:[A-Za-z0-9+/]{64}\r?\n)+)[A-Za-z0-9+/]+={0,2}|[A-Za-z0-9+/_-]{22,}={0,2}"
)
_PARTS = re.compile(r"[A-Za-z0-9]{22,}={0,2}")
_DAMAGED = (zlib.error, lzma.LZMAError, zstandard.ZstdError, OSError, EOFError, ValueError)
_URL_SAFE = bytes.maketrans(b"-_", b"+/")


@dataclass
class Places:
    """Where the characters (or bytes) of a layer stand in the original text.

    One place for all of them, a place for each, or, with neither, the original itself.
    """

    whole: tuple[int, int] | None = None
    starts: np.ndarray | None = None
    ends: np.ndarray | None = None

    def span(self, begin: int, end: int) -> tuple[int, int]:
        if self.whole:
            return self.whole
        if self.starts is None:
            return begin, end
        return int(self.starts[begin]), int(self.ends[end - 1])

    def of(self, begins: np.ndarray, ends: np.ndarray) -> Places:
        """The places of a layer whose character i comes from characters ``begins[i]:ends[i]`` here."""
        if self.whole:
            return self
        if self.starts is None:
            return Places(None, begins, ends)
        return Places(None, self.starts[begins], self.ends[ends - 1])


@dataclass
class Layer:
    content: str | bytes
    places: Places
    path: tuple[str, ...] = ()

    def key(self) -> tuple:
        """Layers of equal content from the same stretch are the same: a cycle ends here."""
        data = self.content if isinstance(self.content, bytes) else self.content.encode("utf-8", "surrogatepass")
        span = self.places.span(0, len(self.content)) if self.content else (0, 0)
        return type(self.content), len(data), hashlib.blake2b(data, digest_size=16).digest(), span


def matches(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end): leftmost matches that do not overlap, per kind; short ones are dropped."""
    for kind, (pattern, group, least) in KINDS.items():
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                yield kind, m.start(), m.end()


def _substituted(layer: Layer, name: str, pattern: re.Pattern, decode: Callable) -> Iterator[Layer]:
    """The layer with all matches decoded; ``decode`` gives (text, begins, ends), or bytes to look into."""
    text, texts, begins, ends, at, changed = layer.content, [], [], [], 0, False
    for m in pattern.finditer(text):
        found = decode(m)
        if isinstance(found, bytes):
            step = (m.end() - m.start()) // len(found)
            first = m.start() + step * np.arange(len(found))
            yield Layer(found, layer.places.of(first, first + step), (*layer.path, name))
        elif found is not None:
            changed = True
            texts += [text[at:m.start()], found[0]]
            kept = np.arange(at, m.start())
            begins += [kept, m.start() + found[1]]
            ends += [kept + 1, m.start() + found[2]]
            at = m.end()
    if changed:
        kept = np.arange(at, len(text))
        begin, end = np.concatenate([*begins, kept]), np.concatenate([*ends, kept + 1])
        yield Layer("".join(texts) + text[at:], layer.places.of(begin, end), (*layer.path, name))


def _as_text(data: bytes, step: int) -> tuple[str, np.ndarray, np.ndarray] | None:
    """UTF-8 text and, per character, where its bytes stand when each takes ``step`` characters."""
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    sizes = np.array([len(c.encode()) for c in text], np.int64)
    ends = np.cumsum(sizes) * step
    return text, ends - sizes * step, ends


def _url(m: re.Match) -> tuple | bytes | None:
    data = bytes.fromhex(m[0].replace("%", ""))
    return _as_text(data, 3) or data


def _unicode(m: re.Match) -> tuple | None:
    token, n = m[0], m.end() - m.start()
    if token.startswith("\\x"):
        data = bytes.fromhex(token.replace("\\x", ""))
        at = 4 * np.arange(len(data))
        return _as_text(data, 4) or (data.decode("latin-1"), at, at + 4)
    if len(token) == 1:
        out = unicodedata.normalize("NFKC", token)
        out = "" if unicodedata.category(token) == "Cf" else out
    elif len(token) == 12 and token.startswith("\\u"):
        out = chr(0x10000 + ((int(token[2:6], 16) & 0x3FF) << 10) + (int(token[8:], 16) & 0x3FF))
    else:
        digits = token[2:].strip("{};")
        code = int(digits.lstrip("xX"), 16) if token[0] == "\\" or digits[:1] in "xX" else int(digits)
        if code > 0x10FFFF or 0xD800 <= code < 0xE000:
            return None
        out = chr(code)
    return out, np.zeros(len(out), np.int64), np.full(len(out), n, np.int64)


def _from_base64(layer: Layer) -> Iterator[Layer]:
    def decoded(begin: int, run: str) -> Layer | None:
        places = np.array([i for i, c in enumerate(run) if c not in "\r\n="], np.int64) + begin
        letters = run.replace("\r", "").replace("\n", "").rstrip("=").encode().translate(_URL_SAFE)
        if len(letters) % 4 == 1:
            return None
        data = base64.b64decode(letters + b"=" * (-len(letters) % 4))
        at = np.arange(len(data))
        made = Layer(data, layer.places.of(places[at * 4 // 3], places[at * 4 // 3 + 1] + 1), (*layer.path, "base64"))
        return made if _readable(data) else None

    for m in _BASE64.finditer(layer.content):
        whole = decoded(m.start(), m[0])
        if whole:
            yield whole
        else:  # the run may have begun with signs of a path or a name
            yield from filter(None, (decoded(m.start() + p.start(), p[0]) for p in _PARTS.finditer(m[0]) if p[0] != m[0]))


def _gzip(data: bytes) -> Iterator[bytes]:
    return _inflate(data, 31)


def _inflate(data: bytes, bits: int = 15) -> Iterator[bytes]:
    while data:
        engine = zlib.decompressobj(bits)
        yield from _drain(engine, data, lambda: engine.unconsumed_tail)
        data = engine.unused_data if bits > 15 and engine.eof else b""


def _drain(engine, data: bytes, rest: Callable[[], bytes]) -> Iterator[bytes]:
    while data and not engine.eof:
        out = engine.decompress(data, WINDOW)
        yield out
        data = rest() if out else b""


def _stepwise(engine) -> Callable[[bytes], Iterator[bytes]]:
    def run(data: bytes) -> Iterator[bytes]:
        decoder = engine()
        yield decoder.decompress(data, WINDOW)
        while not decoder.eof and not decoder.needs_input:
            yield decoder.decompress(b"", WINDOW)
    return run


def _zstd(data: bytes) -> Iterator[bytes]:
    yield from zstandard.ZstdDecompressor().read_to_iter(data, write_size=WINDOW)


def _packing(data: bytes) -> tuple[str, Callable[[bytes], Iterator[bytes]]] | None:
    if data[:2] == b"\x1f\x8b":
        return "gzip", _gzip
    if data[:3] == b"BZh":
        return "bzip2", _stepwise(bz2.BZ2Decompressor)
    if data[:6] == b"\xfd7zXZ\x00":
        return "xz", _stepwise(lzma.LZMADecompressor)
    if data[:4] == b"\x28\xb5\x2f\xfd":
        return "zstd", _zstd
    if len(data) > 2 and data[0] & 0x8F == 0x08 and (data[0] << 8 | data[1]) % 31 == 0:
        return "zlib", _inflate
    return None


def _readable(data: bytes) -> bool:
    """Could these bytes be a text or a compressed layer? Judged by their beginning."""
    if _packing(data):
        return True
    head = data[:32]
    return not any(b < 9 or 13 < b < 32 or b == 127 for b in (head[::2] if head[1::2].strip(b"\0") == b"" else head))


def _from_bytes(layer: Layer) -> Iterator[Layer]:
    """What bytes hold: a compressed stream, UTF-8, or ASCII as UTF-16."""
    data, packing = layer.content, _packing(layer.content)
    if packing:
        name, unpack = packing
        places = Places(layer.places.span(0, len(data)))
        before, out, found = b"", bytearray(), False
        try:
            for piece in unpack(data):
                out += piece
                found |= bool(piece)
                while len(out) >= WINDOW:
                    yield Layer(before + bytes(out[:WINDOW]), places, (*layer.path, name))
                    before = bytes(out[WINDOW - OVERLAP:WINDOW])
                    del out[:WINDOW]
        except _DAMAGED:
            pass  # what came before the damage counts
        if out:
            yield Layer(before + bytes(out), places, (*layer.path, name))
        if found:
            return
    if len(data) >= 2 and not data[1::2].strip(b"\0") and len(data) % 2 == 0:
        at = 2 * np.arange(len(data) // 2)
        yield Layer(data[::2].decode("latin-1"), layer.places.of(at, at + 2), (*layer.path, "utf-16"))
        return
    if layer.places.whole:  # a window may begin and end inside a character
        yield Layer(data.decode(errors="replace"), layer.places, layer.path)
        return
    found = _as_text(data, 1)
    if found:
        yield Layer(found[0], layer.places.of(found[1], found[2]), layer.path)


def inner_layers(layer: Layer) -> Iterator[Layer]:
    """Everything in a layer that decodes."""
    if isinstance(layer.content, bytes):
        yield from _from_bytes(layer)
        return
    if "%" in layer.content:
        yield from _substituted(layer, "url", _URL, _url)
    yield from _substituted(layer, "unicode", _UNICODE, _unicode)
    yield from _from_base64(layer)


def find(text: str) -> list[tuple[str, int, int, bool, str]]:
    """(kind, start, end, base, layers) by start, kind and end; ``layers`` is empty for base findings.

    The worklist ends when no layer is new. Decoding shrinks a layer except for decompression; a
    stream that unpacks to itself is a layer that was seen already.
    """
    found = {(kind, a, b): (True, "") for kind, a, b in matches(text)}
    work, seen = [Layer(text, Places())], set()
    while work:
        layer = work.pop()
        for inner in inner_layers(layer):
            key = inner.key()
            if key in seen or not inner.content:
                continue
            seen.add(key)
            work.append(inner)
            if isinstance(inner.content, str):
                for kind, a, b in matches(inner.content):
                    found.setdefault((kind, *inner.places.span(a, b)), (False, ">".join(inner.path)))
    order = list(KINDS)
    return sorted(
        ((kind, a, b, base, path) for (kind, a, b), (base, path) in found.items()),
        key=lambda f: (f[1], order.index(f[0]), f[2]),
    )


_FINDING = pa.struct([
    ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("layers", pa.string()),
])
SCAN_DDL = "doc_id bigint, findings array<struct<kind:string,start:bigint,end:bigint,base:boolean,layers:string>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, findings), a row per document, whatever its text; NULL texts are empty.

    Spans count code points of the text. Texts in which no pattern and nothing that decodes can be
    are passed over by three vectorised tests; all others are scanned whole, one at a time. A
    layer's content never leaves its task, so results hold no secrets. Decompressed layers above
    16 MB are read in windows that overlap by 64 KB; a nested layer longer than that is seen in parts.
    Repeated rows and ids are rows of their own; other columns play no part.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
            worth = np.zeros(len(texts), bool)
            for pattern in (*_ANY_BASE, *_ANY_LAYER):
                worth |= pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False)
            findings = [[] for _ in range(len(texts))]
            for i in np.flatnonzero(worth):
                findings[i] = [dict(zip(("kind", "start", "end", "base", "layers"), f)) for f in find(texts[int(i)].as_py())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(findings, pa.list_(_FINDING))], names=["doc_id", "findings"])

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(run, SCAN_DDL)


def _joined(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts and digest of the plain findings, spans of all."""
    base = F.filter("findings", lambda f: f["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda f: f["kind"] == kind)).cast("bigint")

    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id", *(count(kind).alias(f"n_{kind}") for kind in KINDS),
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("findings")).alias("spans"),
    )
