"""Secret scan: an Aho-Corasick automaton finds keywords, expressions are anchored at its hits, checksums decide.

Kinds, in this order: assign, access, hex (by pattern), then github and npm (tokens that carry a base-62
CRC-32 of their own body in the last six characters).
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds in report order, keywords of each, and prefixes of tokens with a checksum.
KINDS = ("assign", "access", "hex", "github", "npm")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS_WORDS = ("akia",)
CHECKED = {"ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm"}

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+", re.ASCII)
HEX = re.compile(r"[0-9a-f]{24,}", re.ASCII)
BODY = re.compile(r"[A-Za-z0-9]{36}(?![A-Za-z0-9_])", re.ASCII)
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
Span = tuple[int, int, int]


def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for word in (*ASSIGN_WORDS, *ACCESS_WORDS, *CHECKED):
        out.add_word(word, word)
    out.make_automaton()
    return out


def checksum(body: str) -> str:
    """CRC-32 of the text in base 62, six digits."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, digit = divmod(n, 62)
        out = DIGITS[digit] + out
    return out


def find(text: str, lower: str, words: ahocorasick.Automaton) -> Iterator[Span]:
    """Spans (start, kind, end) in code points.  ``lower`` is the text with A-Z in lower case, as long as the text.

    Within a kind a match starts where the one before it ended or later, also where that one failed its length.
    """
    free = dict.fromkeys(KINDS, 0)
    hits = sorted((end - len(word) + 1, word) for end, word in words.iter(lower))
    for start, word in hits:
        if word in ASSIGN_WORDS:
            if start >= free["assign"] and (m := ASSIGN.match(text, start)):
                free["assign"] = m.end()
                if len(m[2]) >= 6:
                    yield start, 0, m.end()
        elif word in ACCESS_WORDS:
            if start >= free["access"] and (m := ACCESS.match(text, start)):
                free["access"] = m.end()
                if m.end() - start >= 20:
                    yield start, 1, m.end()
        else:
            kind = CHECKED[word]
            if start >= free[kind] and text.startswith(word, start) and (m := BODY.match(text, start + 4)) and checksum(m[0][:30]) == m[0][30:]:
                free[kind] = m.end()
                yield start, KINDS.index(kind), m.end()
    for m in HEX.finditer(text):
        yield m.start(), 2, m.end()


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def _scan(batches):
    words = automaton()
    for batch in batches:
        out = []
        for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            raw = raw or b""
            spans = list(find(raw.decode("utf-8", "replace"), raw.lower().decode("utf-8", "replace"), words))
            base = [s for s in spans if s[1] < 3]
            n = [sum(s[1] == k for s in base) for k in range(3)]
            out.append((doc_id, *n, hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans)))
        columns = zip(*out, strict=True) if out else ((),) * 6
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])


def scan(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_assign, n_access, n_hex, base_sha256, spans.

    Whole texts are scanned; null counts as empty.  Spans are ``kind:start:end`` in code points, end exclusive, by start then
    kind; base_sha256 is that of the first three kinds' list.  Every row is reported, also where a doc_id comes
    again or is null; an empty table gives an empty result.  Columns other than doc_id and text are not read.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return plain.mapInArrow(_scan, SCHEMA)
