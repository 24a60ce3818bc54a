"""Secrets in whole texts, also inside encodings.

Three kinds of secret are searched: assignments, access keys and long hexadecimal runs. A worklist then unwraps what is
encoded (percent escapes, Unicode and character escapes, base64, compressed bytes), searches each layer the same way and
unwraps it again until nothing new appears; a layer whose content was seen before is not entered again, so cycles end.
Characters of a layer keep the span of the original text they come from, and findings in a layer carry that span.

Base64 is also read across line breaks. Compressed bytes are inflated as a stream, through every member and any depth, and
searched in overlapping windows, so that memory does not grow with what a text unfolds to; only an unbroken encoded run
is held whole. Bytes that are not UTF-8 (or UTF-16 with its mark) are read as Latin-1.

A run of base64 that begins inside a longer run (behind a path, say) is read from each of the first four characters on.

Defined results: null and empty texts have no spans; spans are code points, end exclusive; columns base and spans are
replaced."""

from __future__ import annotations

import base64
import binascii
import codecs
import hashlib
import io
import itertools
import re
import tempfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, without

KINDS = ("assign", "access", "hex")
#: Characters searched at once in unwrapped bytes, those that the next window repeats, and bytes inflated at once.
WINDOW, OVERLAP, CHUNK = 1 << 20, 1 << 12, 1 << 18
#: Bytes of a compressed layer inside another that are kept in memory; more go to a temporary file.
IN_MEMORY = 16 << 20

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Whole runs of 32 characters and more: what is left of [0-9a-f]+ once shorter runs are dropped.
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Base64 over several lines: from the end of one line, over lines that hold nothing else.
BREAK = re.compile(r"""[ \t]*(?:\r?\n|(?:\\r)?\\n|\r)[ \t>"'+]*""")
WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:{BREAK.pattern}[A-Za-z0-9+/_-]++)++={{0,2}}")
#: What a window does not end in: an encoded run.
RUN = re.compile(rf"{WRAPPED.pattern}|[A-Za-z0-9+/_=%\\&#;{{}}-]++")
PACKED_HEX = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){16,}(?![0-9A-Fa-f])")

#: Bytes of a layer that is worth a look: what the kinds begin with, encoded runs, or the mark of a compressed stream.
LIKELY = re.compile(rb"(?i:passw|secret|token|api_?key)|AKIA[A-Z0-9]{12}|[0-9a-f]{32}|[A-Za-z0-9+/_-]{24}|(?:%[0-9A-Fa-f]{2}){4}|\\[uUx][0-9A-Fa-f]{2}|&#|^\x1f\x8b|^\x78[\x01\x5e\x9c\xda]")

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


def _latin(e: UnicodeDecodeError) -> tuple[str, int]:
    return e.object[e.start : e.end].decode("latin-1"), e.end


def _packed(head: bytes) -> int:
    """The window bits of the gzip or zlib stream that may begin so, or 0."""
    if head[:2] == b"\x1f\x8b":
        return 31
    return 15 if len(head) > 2 and head[0] & 15 == 8 and (head[0] << 8 | head[1]) % 31 == 0 else 0


def _inflate(held: io.IOBase, at: int, bits: int, stop: list) -> Iterator[bytes]:
    """Bytes behind the stream at a place of held; stop takes the place after it, or nothing where the stream is broken."""
    held.seek(at)
    z = zlib.decompressobj(bits)
    try:
        while not z.eof and (data := z.unconsumed_tail or held.read(CHUNK)):
            new = z.decompress(data, CHUNK)
            if new:
                yield new
        if not z.eof and (new := z.flush()):
            yield new
        if z.eof:
            stop.append(held.tell() - len(z.unused_data))
    except zlib.error:
        return


def _rest(held: io.IOBase, at: int) -> Iterator[bytes]:
    held.seek(at)
    while data := held.read(CHUNK):
        yield data


def _plain(raw: bytes) -> Iterator[Iterator[bytes]]:
    """The byte streams in raw that are not compressed themselves: of every member at every depth, and what follows them.
    Each is to be read before the next is asked for."""
    work, seen = [io.BytesIO(raw)], set()
    while work:
        held = work.pop()
        mark = hashlib.blake2b(digest_size=16)
        for data in _rest(held, 0):
            mark.update(data)
        if mark.digest() in seen:
            held.close()
            continue
        seen.add(mark.digest())
        at, inner = 0, []
        while True:
            held.seek(at)
            head = held.read(3)
            if not head:
                break
            if not (bits := _packed(head)):
                if at and head[:1] == b"\0":  # padding between members
                    at += 1
                    continue
                yield _rest(held, at)
                break
            stop: list[int] = []
            out = _inflate(held, at, bits, stop)
            first = b""
            for data in out:
                first += data
                if len(first) > 2:
                    break
            if _packed(first):
                below = tempfile.SpooledTemporaryFile(IN_MEMORY)  # noqa: SIM115
                below.write(first)
                for data in out:
                    below.write(data)
                inner.append(below)
            elif first:
                yield itertools.chain([first], out)
            if not stop:  # broken or cut short, or no such stream at all
                yield _rest(held, at)
                break
            at = stop[0]
        held.close()
        work += inner


def _windows(stream: Iterator[bytes]) -> Iterator[str]:
    """The text of a byte stream in overlapping pieces, none of which begins inside an encoded run."""
    codecs.register_error("moetrace-latin", _latin)  # here, as executors may hold this function without its module
    text, least, decoder = "", WINDOW, None
    for data in itertools.chain(stream, [b""]):
        if decoder is None:
            name = "utf-16" if data[:2] in (b"\xff\xfe", b"\xfe\xff") else "utf-8"
            decoder = codecs.getincrementaldecoder(name)("moetrace-latin")
        text += decoder.decode(data, not data)
        if not data:
            break
        if len(text) < least:
            continue
        cut = len(text) - OVERLAP
        for m in RUN.finditer(text):
            if m.end() > cut:
                cut = min(cut, m.start())
                break
        if cut <= 0:  # one run from the start: wait for its end, looking again after twice as much
            least = 2 * len(text)
            continue
        yield text
        text = text[cut:]
        least = max(WINDOW, 2 * len(text))
    if text:
        yield text


def _texts(raw: bytes) -> Iterator[str]:
    if raw and len(raw) <= CHUNK and not _packed(raw):  # nearly all: words that only look like base64
        yield from _windows(iter([raw]))
        return
    for stream in _plain(raw):
        yield from _windows(stream)


def _unbase64(word: str) -> bytes:
    """The bytes of a base64 word; none where it is not one."""
    word = word.rstrip("=").replace("-", "+").replace("_", "/")
    word = word[: len(word) - (len(word) % 4 == 1)]
    try:
        return base64.b64decode(word + "=" * (-len(word) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def _wrapped(m: re.Match) -> Iterator[tuple[int, int, str]]:
    """(start, end, word) of base64 over lines: the whole of it, and what begins where the width of lines changes (words
    before the first line have another), up to a line shorter than the one before it."""
    whole, at, parts = m.group(), 0, []
    for b in BREAK.finditer(whole):
        parts.append((at, b.start()))
        at = b.end()
    parts.append((at, len(whole)))
    wide = [e - s for s, e in parts]
    starts = [i for i in range(len(parts) - 1) if not i or wide[i] != wide[i - 1]]
    ends = {len(parts)} if 0 in starts else set()
    done = set()
    for i in starts:
        j = i + 2
        while j < len(parts) and wide[j] == wide[j - 1]:
            j += 1
        if j < len(parts) and wide[j] < wide[j - 1]:
            j += 1
        for upto in {j} | (ends if i == 0 else set()):
            if (i, upto) not in done and sum(wide[i:upto]) >= 16:
                done.add((i, upto))
                yield m.start() + parts[i][0], m.start() + parts[upto - 1][1], "".join(whole[s:e] for s, e in parts[i:upto])


def _unescape(m: str) -> str:
    if m[0] == "&":
        n = int(m[3:-1], 16) if m[2] in "xX" else int(m[2:-1])
    else:
        n = int(m[2:].strip("{}"), 16)
    return chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 else "\ufffd"


class _Layer:
    """A text and, for each of its characters, the span of the original that it comes from."""

    __slots__ = ("ends", "starts", "text")

    def __init__(self, text: str, starts, ends):  # noqa: ANN001
        self.text, self.starts, self.ends = text, starts, ends

    def span(self, start: int, end: int) -> tuple[int, int]:
        return self.starts[start], self.ends[end - 1]


def _rewrite(layer: _Layer, found: list[tuple[int, int, str]]) -> Iterator[_Layer]:
    """Layers with the found (start, end, decoded) put in place, one for each stretch without white space that has any."""
    text, i = layer.text, 0
    while i < len(found):
        low = found[i][0]
        while low and not text[low - 1].isspace():
            low -= 1
        # Secrets may have spaces about = and quotes: a stretch takes in the words on either side of it too.
        for _ in range(3):
            while low and text[low - 1] in " ":
                low -= 1
            while low and not text[low - 1].isspace():
                low -= 1
        out, starts, ends, at = [], [], [], low
        while True:
            s, e, new = found[i]
            out += [text[at:s], new]
            starts += [*layer.starts[at:s], *[layer.starts[s]] * len(new)]
            ends += [*layer.ends[at:s], *[layer.ends[e - 1]] * len(new)]
            at, i = e, i + 1
            if i == len(found) or re.search(r"(?:\s+\S+){4}", text[at : found[i][0]]):
                break
        m = re.compile(r"\S*(?: +\S+){0,3}").match(text, at)
        stop = min(m.end(), found[i][0]) if i < len(found) else m.end()
        out.append(text[at:stop])
        starts += layer.starts[at:stop]
        ends += layer.ends[at:stop]
        yield _Layer("".join(out), starts, ends)


def _unwrap(layer: _Layer) -> Iterator[_Layer]:
    text = layer.text
    if "%" in text:
        found = []
        for m in PERCENT.finditer(text):
            raw = bytes.fromhex(m.group().replace("%", ""))
            new = raw.decode("utf-8", "replace")
            if all(b < 128 for b in raw):  # character by character, so that spans stay exact
                found += [(m.start() + 3 * j, m.start() + 3 * j + 3, c) for j, c in enumerate(new)]
            else:
                found.append((m.start(), m.end(), new))
        yield from _rewrite(layer, found)
    if "\\" in text or "&#" in text:
        yield from _rewrite(layer, [(m.start(), m.end(), _unescape(m.group())) for m in ESCAPE.finditer(text)])
    found = [(m.start(), m.end(), m.group()) for m in BASE64.finditer(text) if len(m.group().rstrip("=")) % 4 != 1]
    shifted = [(m.start(), m.end(), m.group()) for m in BASE64.finditer(text) if len(m.group()) >= 24]
    if "\n" in text or "\r" in text or "\\n" in text:
        found += [x for m in WRAPPED.finditer(text) for x in _wrapped(m)]
    raws = itertools.chain(((s, e, _unbase64(word)) for s, e, word in found), ((m.start(), m.end(), bytes.fromhex(m.group())) for m in PACKED_HEX.finditer(text)))
    # Three in four runs that are read from inside give noise: only what may hold something is a layer.
    inside = ((s + k, e, raw) for s, e, word in shifted for k in (1, 2, 3) if LIKELY.search(raw := _unbase64(word[k:])))
    for start, end, raw in itertools.chain(raws, inside):
        s, e = layer.span(start, end)
        for new in _texts(raw):
            yield _Layer(new, [s] * len(new), [e] * len(new))


def all_spans(text: str, base: list[Span] | None = None) -> list[Span]:
    """Spans of the text and of every layer inside it, without repeats."""
    found = set(base_spans(text) if base is None else base)
    first = _Layer(text, range(len(text)), range(1, len(text) + 1))
    seen = {hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()}
    # Depth first, one layer of each depth at a time: a long stream is never held as a list of layers.
    work = [_unwrap(first)]
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        where = f"{layer.starts[0]}:{layer.ends[-1]}:" if layer.text else ""
        mark = hashlib.blake2b((where + layer.text).encode("utf-8", "surrogatepass"), digest_size=16).digest()
        if mark in seen:
            continue
        seen.add(mark)
        found.update((*layer.span(s, e), kind) for s, e, kind in base_spans(layer.text))
        work.append(_unwrap(layer))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def find_secrets(docs: DataFrame) -> DataFrame:
    """docs with base and spans: arrays of (start, end, kind), of the text itself and with those of its layers."""
    small_batches(docs.sparkSession)
    span = "array<struct<start:int,end:int,kind:string>>"

    @F.pandas_udf(f"base {span}, spans {span}")
    def find(text: pd.Series) -> pd.DataFrame:
        base = [base_spans(t or "") for t in text]
        full = [all_spans(t or "", b) for t, b in zip(text, base, strict=True)]
        as_rows = lambda x: [{"start": s, "end": e, "kind": k} for s, e, k in sorted(x, key=lambda y: (y[0], KINDS.index(y[2]), y[1]))]
        return pd.DataFrame({"base": [as_rows(x) for x in base], "spans": [as_rows(x) for x in full]})

    docs = without(docs, "base", "spans")
    return docs.withColumn("_found", find("text")).select(*docs.columns, "_found.*")
