"""Secret scans: three fixed patterns, and novelty by a dictionary-primed zstandard compressor.

The patterns give the base spans, leftmost and without overlaps for each kind. The method adds
strings that a pattern misses: in a document with a sensitive word, each long string less than
``NEAR`` characters from such a word, on either side, is a candidate. Common identifiers, made by
rule from a word list, and the text around the candidate are compressed with and without it, in
one frame, so that what the surroundings' letters cost is known; the bytes that it adds, for each
of its characters, are its novelty. What "=" joins is told apart, so in NAME=value the value is the
candidate and a sensitive word in the name is close to it however long the name is; if no part of
such a string is reported, the string is judged as a whole. A candidate of ``NOVELTY`` or more is
reported as kind ``novel``, unless a base span overlaps it. Letters of one case alone can't be told
from a long word by what they cost, and are reported only where "=" gives them to a sensitive name.
Base spans carry their novelty too, but stay whatever it is. Spans are in code points, the end exclusive.

Defined cases: null or empty text has no spans; repeated rows are scanned each for itself.
Whole texts are read, in one pass, and a candidate costs the same however long its text is.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ("assign", "access", "hex", "novel")

#: Lower-case stems without one of which ASSIGN can't match.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
SENSITIVE = re.compile(r"passw|passwd|secret|token|api[_ -]?key|credential|private[_ -]?key|access[_ -]?key|bearer|signature", re.IGNORECASE | re.ASCII)
SENSITIVE_WORDS = ("passw", "secret", "token", "api", "credential", "private", "access", "bearer", "signature")
LEAST = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
#: What "=" joins in a candidate (padding stays with its value), and a name with "=" before a value.
PART = re.compile(r"[A-Za-z0-9+/_-]+=*")
ASSIGNED = re.compile(r"""(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++["']?\x20*=+\x20*["']?\Z""")
#: How far from a candidate a sensitive word may be; characters on each side of it that are compressed with it.
NEAR, AROUND = 256, 256
#: Added bytes for each character from which a candidate is incompressible: identifiers and dates mostly cost 0.4 to 0.7, random letters and digits 0.75 to 0.95.
NOVELTY = 0.75
# Words of identifiers.
WORDS = (
    "password secret token key access private public client id credential authorization signature user name session request response header content type "
    "application json value string object array number function return import export default static class const config settings environment development "
    "production localhost database connection endpoint service account example change null true false http https www com org net release version candidate "
    "update index migration add remove file path docs section figure final draft test build server host port image layer model data train table column row replace with your insert here ssh rsa cert sha hash"
).split()


def identifiers(n: int = 120) -> bytes:
    """``n`` identifiers in common styles, some with numbers and dates, by a fixed rule."""
    out = []
    for i in range(n):
        a, b, c = (WORDS[(i * m + i // len(WORDS)) % len(WORDS)] for m in (7, 11, 29))
        x, y = ":-"[i // 8 % 2], i * 7919 % 10_000_000
        stamp = f"20{i % 40:02}-{i % 12 + 1:02}-{i % 28 + 1:02}T{i % 24:02}{x}{i * 7 % 60:02}{x}{i * 13 % 60:02}Z"
        styles = (f"{a}_{b}_{c}", f"{a}-{b}-{i}", a + b.capitalize() + c.capitalize(), f"{a}/{b}{i * 37 % 100}/{c}.{b}", f"{a}_{y}", f"{stamp} {a.upper()}_{b.upper()}", f"{y}-{y * 3 % 9_973}-{y * 7 % 997}", stamp)
        out.append(styles[i % len(styles)])
    return " ".join(out).encode()


_HEX_BYTES = bytes(120 if chr(i) in "0123456789abcdef" else 32 for i in range(256))
_HEX_RUN = b"x" * HEX_LEAST
SPANS = "array<struct<kind:string,start:int,end:int,novelty:double>>"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found: list[tuple[str, int, int]] = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS) or not text.isascii() and any(w in text.casefold() for w in ASSIGN_WORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    if _HEX_RUN in text.encode().translate(_HEX_BYTES):
        found += [("hex", m.start(), m.end()) for m in HEX.finditer(text) if len(m[0]) >= HEX_LEAST]
    return found


@lru_cache(maxsize=1)
def compressor() -> tuple[bytes, zstandard.ZstdCompressor]:
    found = zstandard.ZstdCompressionParameters.from_level(19, source_size=16_384, min_match=3, strategy=zstandard.STRATEGY_BTOPT, write_checksum=0, write_content_size=0, write_dict_id=0)
    return identifiers() + b" ", zstandard.ZstdCompressor(compression_params=found)


def one_case(s: str) -> bool:
    """No capitals, only capitals, or one at the start."""
    return s in (s.lower(), s.upper()) or s[1:] == s[1:].lower()


def novelty(text: str, start: int, end: int) -> float:
    """Bytes that the candidate adds to its compressed surroundings, for each of its characters. Case counts only where it is mixed."""
    first, pack = compressor()
    around = first + (text[max(0, start - AROUND) : start] + " " + text[end : end + AROUND] + " ").encode()
    s = text[start:end]
    added = (s.lower() if one_case(s) else s).encode() + b" "
    return (len(pack.compress(around + added)) - len(pack.compress(around))) / (end - start)


def novel_spans(text: str, base: list[tuple]) -> Iterator[tuple[str, int, int, float]]:
    low = text.lower()
    if not any(w in low for w in SENSITIVE_WORDS):
        return
    words = [m.span() for m in SENSITIVE.finditer(text)]
    word_ends = [b for _, b in words]
    taken = sorted((a, b) for _, a, b, *_ in base)
    starts, ends = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))

    def judged(a: int, b: int, lead: int) -> Iterator[tuple[str, int, int, float]]:
        """The candidate from a to b as a span if it is one; ``lead`` is the start of a name that is joined to it, else a."""
        i = bisect_left(word_ends, min(a - NEAR, lead))
        before = bisect_left(starts, b)
        if i == len(words) or words[i][0] > b + NEAR or before and ends[before - 1] > a:
            return
        s = text[a:b]
        named = ASSIGNED.search(text[min(lead, max(0, a - NEAR)) : a])
        sure = named and SENSITIVE.search(named[0])  # the value of a sensitive name: the compressor alone decides
        if (sure or not (s.isalpha() and one_case(s))) and (score := novelty(text, a, b)) >= NOVELTY:
            yield "novel", a, b, score

    for m in CANDIDATE.finditer(text) if words else ():
        parts = [p.span() for p in PART.finditer(text, *m.span())]
        found = []
        for n, (a, b) in enumerate(parts):
            if n + 1 < len(parts):  # what stands before "=" and more is a name, or a value without its padding
                b = a + len(text[a:b].rstrip("="))
            if b - a >= LEAST:
                found += judged(a, b, parts[n - 1][0] if n else a)
        yield from found or (judged(*m.span(), m.start()) if len(parts) != 1 or parts[0] != m.span() else ())


def all_spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """Base and novel spans by start, then kind."""
    if not text:
        return []
    base = [(kind, a, b, novelty(text, *((m.span(2) if (m := ASSIGN.match(text, a, b)) else (a, b)) if kind == "assign" else (a, b)))) for kind, a, b in base_spans(text)]
    return sorted([*base, *novel_spans(text, base)], key=lambda s: (s[1], KINDS.index(s[0])))


def scan_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) for every row; spans: kind, start, end and the added bytes a character."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("novelty", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[dict(zip(("kind", "start", "end", "novelty"), s)) for s in all_spans(t.as_py())] for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(spans, kind)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(lean(run), f"doc_id bigint, spans {SPANS}")


def redact(text: str | None) -> str | None:
    """The text with every span replaced by a mark; overlapping spans give one mark."""
    out, at, cut = [], 0, 0
    for _, a, b, _ in all_spans(text):
        if a >= cut:
            out += [text[at:a], "[secret]"]
        at = cut = max(cut, b)
    return text if not out else "".join(out) + text[at:]


def redact_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with secrets replaced in text, and n_chars set anew where it is a column and the text changed."""
    at = docs.columns.index("text")
    n = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column(at).to_pylist()
            new = [redact(t) for t in old]
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if n is not None:
                columns[n] = pa.array([c if a == b else len(b) for a, b, c in zip(old, new, batch.column(n).to_pylist())], batch.schema.field(n).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(lean(run), docs.schema)
