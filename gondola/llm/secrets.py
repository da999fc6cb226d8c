"""Secret scans: Aho-Corasick keywords, expressions anchored at their hits, checksums inside the tokens.

One pass of an Aho-Corasick automaton over the text finds all keywords. An expression is only ever matched at the
start of a hit, from left to right, skipping hits inside the previous match of its kind, which is what a leftmost
search gives, as no match can begin elsewhere. Hex strings have no keyword: runs of 24 hex digits or more come from
one vectorised comparison. Token kinds with an embedded checksum are reported only if it is right; web tokens only if
their header and payload decode to JSON objects.

No text takes more than time in proportion to its length: an attempt at a web token that fails remembers the run of
characters it failed in, where later hits would fail alike, and key blocks look up their end marks and the next character
that no key has, each found once.

Kinds, in this order at equal starts: assign, access, hex (the base ones), github, npm, jwt, pem.
Offsets are code points, ends exclusive.

Defined cases: null counts as empty, empty texts have no spans, overlapping spans of different kinds are all reported
(redaction replaces their union), repeated rows give repeated results, doc_id may be null, an empty table gives an empty
result; extra columns are ignored by scan and kept, whatever their names, by redact.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import json
import re
import string
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.llm.common import bounded, released

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "github", "npm", "jwt", "pem")
ASSIGN_LENGTH, ACCESS_LENGTH, HEX_LENGTH = 6, 20, 24
CLEAN = "<secret>"
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_NPM = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_JWT = re.compile(r"(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.[A-Za-z0-9_-]*")
_JWT_RUN = re.compile(r"[A-Za-z0-9_-]+")
#: A key block: a begin mark, characters of keys and their headers, and the first end mark of that name.
_PEM_BEGIN = re.compile(r"-----BEGIN ([A-Z ]{0,40}PRIVATE KEY)-----")
_PEM_END = re.compile(r"(?=-----END ([A-Z ]{0,40}PRIVATE KEY)-----)")
_PEM_OTHER = re.compile(r"[^A-Za-z0-9+/=\s:,-]")
_DIGITS = string.digits + string.ascii_uppercase + string.ascii_lowercase


def checksum(body: str) -> str:
    """CRC-32 of the body in base 62, six digits."""
    n, out = binascii.crc32(body.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = _DIGITS[r] + out
    return out


def _is_json(part: str) -> bool:
    try:
        return isinstance(json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))), dict)
    except (ValueError, RecursionError):
        return False


def _anchored(expression: re.Pattern, valid: Callable[[re.Match], bool]) -> Callable[[str, list[int]], Iterator[tuple[int, int]]]:
    """Matches at the hits, from left to right, that pass the test; hits inside a match are skipped."""

    def found(text: str, starts: list[int]) -> Iterator[tuple[int, int]]:
        after = 0
        for start in starts:
            if start >= after and (m := expression.match(text, start)):
                after = m.end()
                if valid(m):
                    yield start, after

    return found


def _web_tokens(text: str, starts: list[int]) -> Iterator[tuple[int, int]]:
    after = 0
    for start in starts:
        if start < after:
            continue
        if m := _JWT.match(text, start):
            after = m.end()
            if _is_json(m[1]) and _is_json(m[2]):
                yield start, after
        else:  # so does any start in the rest of this run
            after = _JWT_RUN.match(text, start).end() if text.startswith("eyJ", start) else start + 1


def _key_blocks(text: str, starts: list[int]) -> Iterator[tuple[int, int]]:
    ends: dict[str, list[int]] = {}
    for m in _PEM_END.finditer(text):
        ends.setdefault(m[1], []).append(m.start())
    after, other = 0, -1
    for start in starts:
        if start < after or not (m := _PEM_BEGIN.match(text, start)):
            continue
        own = ends.get(m[1], [])
        k = bisect.bisect_left(own, m.end())
        if k == len(own):
            continue
        if other < m.end():
            found = _PEM_OTHER.search(text, m.end())
            other = found.start() if found else len(text)
        if own[k] <= other:
            after = own[k] + len("-----END -----") + len(m[1])
            yield start, after


#: kind -> keywords (lower case), and what finds the spans at their hits.
RULES = {
    "assign": (("password", "passwd", "secret", "token", "apikey", "api_key"), _anchored(_ASSIGN, lambda m: len(m[2]) >= ASSIGN_LENGTH)),
    "access": (("akia",), _anchored(_ACCESS, lambda m: len(m[0]) >= ACCESS_LENGTH)),
    "github": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), _anchored(_GITHUB, lambda m: checksum(m[1]) == m[2])),
    "npm": (("npm_",), _anchored(_NPM, lambda m: checksum(m[1]) == m[2])),
    "jwt": (("eyj",), _web_tokens),
    "pem": (("-----begin",), _key_blocks),
}


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, (words, _) in RULES.items():
        for word in words:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def _lower(text: str) -> str:
    """ASCII letters lowered; the length stays."""
    if text.isascii():
        return text.lower()
    low = text.lower()
    return low if len(low) == len(text) else text.translate({k: k + 32 for k in range(65, 91)})


def _hex_runs(text: str) -> list[tuple[int, int]]:
    if len(text) < HEX_LENGTH:
        return []
    a = np.frombuffer(text.encode("ascii"), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    # a run of so many digits covers a place of every stride of that length
    if not (((g := a[HEX_LENGTH - 1 :: HEX_LENGTH]) - 48 < 10) | (g - 97 < 6)).any():
        return []
    inside = np.zeros(len(a) + 2, np.int8)
    inside[1:-1] = (a - 48 < 10) | (a - 97 < 6)
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = ends - starts >= HEX_LENGTH
    return list(zip(starts[long].tolist(), ends[long].tolist()))


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end), by start, then kind as listed."""
    if not text:
        return []
    hits: dict[str, set[int]] = {}
    for end, (kind, size) in _automaton().iter(_lower(text)):
        hits.setdefault(kind, set()).add(end - size + 1)
    out = [("hex", a, b) for a, b in _hex_runs(text)]
    for kind, starts in hits.items():
        out += [(kind, a, b) for a, b in RULES[kind][1](text, sorted(starts))]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redacted(text: str | None) -> str | None:
    """The text with the union of its spans replaced, each run by one mark."""
    found = spans(text)
    if not found:
        return text
    out, at = [], 0
    for _, a, b in found:
        if a >= at:
            out += [text[at:a], CLEAN]
        at = max(at, b)
    return "".join([*out, text[at:]])


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [[{"kind": k, "start": a, "end": b} for k, a, b in spans(t.as_py())] for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _SPANS)], names=["doc_id", "spans"])


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id and its spans, an array of kind, start, end."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(released(_scan), "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def _redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        k = batch.schema.get_field_index("text")
        yield batch.set_column(k, batch.schema.field(k), pa.array([redacted(t.as_py()) for t in batch.column(k)], batch.schema.field(k).type))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span in text replaced; n_chars, if there, follows."""
    bounded(docs.sparkSession)
    out = docs.mapInArrow(released(_redact), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
