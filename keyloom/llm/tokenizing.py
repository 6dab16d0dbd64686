"""Byte-level BPE encoding by overlapping chunks, and decoding.

A text is cut into chunks of ``CHUNK`` characters that run ``OVERLAP`` further into the next
one. Each chunk is pre-tokenised by itself, from its first character on. Whether a match starts
at a place depends only on the text after it, so as soon as two neighbours share a boundary all
later ones agree: the stitch follows one chunk up to the first boundary that its successor has
too. A chunk's boundaries count only while the pattern has seen what decides them (a match that
ends ``AHEAD`` characters before the chunk's end); where two chunks share none in the overlap
(a run longer than it), the stretch is pre-tokenised again from the last sure boundary. Then the
pieces are merged by rank. Texts of one chunk never leave their task; the chunks of longer ones
are dealt over the cluster and meet again by document as boundaries.

Defined cases: null text counts as empty: no tokens, and the digests of empty bytes. Special
tokens are ordinary text. Repeated rows give repeated results. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

CHUNK, OVERLAP = 65_536, 2_048
#: The longest contraction of the pattern: what a match may need to see after its end.
AHEAD = 3
#: Pieces whose tokens a task remembers, and the longest of them.
MEMORY, LONGEST = 120_000, 64
#: Longer pieces are merged by a heap; the library's own loop is quadratic.
HEAP_FROM = 400
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Stands for a character that the library's older Unicode tables take for neither letter nor number.
SYMBOL = "\u2603"
WIDE = re.compile("[\U00010000-\U0010ffff]")
SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def latin_pattern(pattern: str) -> re.Pattern:
    """The same pattern for texts of the first 256 characters, its classes written out for the faster engine."""
    own = {name: "".join(re.escape(c) for c in map(chr, range(256)) if regex.match(name, c)) for name in (r"\p{L}", r"\p{N}", r"\s")}
    parts = regex.split(r"(\[[^\]]*\])", pattern)  # classes of the pattern stay classes
    for i, part in enumerate(parts):
        for name, members in own.items():
            part = part.replace(name, members if i % 2 else f"[{members}]")
        parts[i] = part.replace(r"\S", rf"[^{own[r'\s']}]")
    return re.compile("".join(parts))


class Codec:
    """Ranks of one vocabulary file with a bounded memory of pieces."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN) -> None:
        import tiktoken

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        top = max(self.ranks.values()) + 1
        self.bytes_of: list[bytes | None] = [None] * top
        for raw, i in self.ranks.items():
            self.bytes_of[i] = raw
        self.text_of = list(map(str, range(top)))
        self.pattern = regex.compile(pattern)
        self.latin = latin_pattern(pattern)
        library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.merge = library._core_bpe.encode_single_piece
        self.known: dict[str, tuple[int, ...]] = {}
        self.newer: dict[int, str] = {}
        self.newer_seen = None
        self._learn_newer(library.encode_ordinary)

    def _learn_newer(self, encode) -> None:
        """The runs of recent letters and numbers that the library's regular expressions don't know as such, found by asking it."""
        run: list[str] = []
        for c in [*regex.findall(r"[\p{L}\p{N}]", "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)), ""]:
            if run and (not c or ord(c) != ord(run[-1]) + 1 or unicodedata.category(c) != "Cn"):
                if any(encode(t) != self.encode_pieces(self.pattern.findall(t)) for x in run for t in (f"a{x}a 1{x}1",)):
                    self.newer |= {ord(x): SYMBOL for x in run}
                run = []
            if c and unicodedata.category(c) == "Cn":
                run.append(c)
        plane = "".join(chr(c) for c in self.newer if c < 0x10000)
        self.newer_seen = re.compile(f"[{plane}]") if plane else None
        self.known.clear()

    def piece(self, text: str) -> tuple[int, ...]:
        found = self.known.get(text)
        if found is None:
            raw = text.encode()
            found = (self.ranks[raw],) if raw in self.ranks else tuple(self.merge(raw) if len(raw) < HEAP_FROM else self.merge_long(raw))
            if len(text) <= LONGEST:
                if len(self.known) >= MEMORY:
                    self.known.clear()
                self.known[text] = found
        return found

    def merge_long(self, raw: bytes) -> list[int]:
        """Merges the pair of least rank, the leftmost on ties, until none has a rank: n log n."""
        n = len(raw)
        parts: list[bytes | None] = [raw[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, raw[i : i + 2]) for i in range(n - 1) if (r := self.ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            if parts[i] is None or (j := after[i]) >= n or parts[i] + parts[j] != pair:
                continue
            parts[i], parts[j] = pair, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for at in (before[i], i):
                if at >= 0 and after[at] < n and (r := self.ranks.get(x := parts[at] + parts[after[at]])) is not None:
                    heapq.heappush(heap, (r, at, x))
        return [self.ranks[p] for p in parts if p is not None]

    def plain(self, text: str) -> str:
        """The text as the pattern should see it; places stay. Texts of Latin letters, the most, are told apart by a fast encoder."""
        try:
            text.encode("latin-1")
            return text
        except UnicodeEncodeError:
            strange = self.newer and (self.newer_seen and self.newer_seen.search(text) or WIDE.search(text))
            return text.translate(self.newer) if strange else text

    def split(self, text: str) -> list[str]:
        """The matches of the pattern."""
        try:
            text.encode("latin-1")
            return self.latin.findall(text)
        except UnicodeEncodeError:
            seen = self.plain(text)
            return self.pattern.findall(text) if seen is text else pieces_of(text, self.ends(text))

    def ends(self, text: str) -> list[int]:
        return [m.end() for m in self.pattern.finditer(self.plain(text))]

    def encode_pieces(self, pieces: list[str]) -> list[int]:
        ids: list[int] = []
        known, more = self.known.get, ids.extend
        for p in pieces:
            more(known(p) or self.piece(p))
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def encode(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
        """The whole route for one text."""
        if len(text) <= chunk:
            return self.encode_pieces(self.split(text))
        parts = [(s, self.ends(text[s : s + chunk + overlap])) for s in range(0, len(text), chunk)]
        return self.encode_pieces(pieces_of(text, stitch(text, parts, chunk + overlap, self.ends)))


def pieces_of(text: str, ends: list[int]) -> list[str]:
    return [text[a:b] for a, b in zip([0, *ends], ends)]


def stitch(text: str, parts: list[tuple[int, list[int]]], span: int, ends_of) -> list[int]:
    """The boundaries of the whole text from (start, boundaries from there) of its chunks in order."""
    out: list[int] = []
    at = 0  # the last sure boundary
    for k, (start, ends) in enumerate(parts):
        last = k == len(parts) - 1
        sure = len(text) if start + span >= len(text) else start + span - AHEAD
        own = [start + e for e in ends if start + e <= sure]
        if at != start and at not in set(own):  # not in step: go on from the last sure boundary
            if at > sure:
                continue
            stop = min(len(text), start + span)
            own = [at + e for e in ends_of(text[at:stop])]
            own = [e for e in own if e <= (len(text) if stop == len(text) else stop - AHEAD)]
        following = set() if last else {parts[k + 1][0], *(parts[k + 1][0] + e for e in parts[k + 1][1])}
        for e in own:
            if e > at:
                out.append(e)
                at = e
                if e in following:
                    break
    while at < len(text):  # a run beyond every chunk
        size = span
        while True:
            stop = min(len(text), at + size)
            own = [at + e for e in ends_of(text[at:stop])]
            own = [e for e in own if e <= (len(text) if stop == len(text) else stop - AHEAD)]
            if own:
                break
            size *= 2
        out += own
        at = own[-1]
    return out


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def digests(c: Codec, ids: list[int]) -> tuple[int, str, str]:
    return len(ids), hashlib.sha256(",".join(map(c.text_of.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()


def encode_documents(docs: DataFrame, path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP, keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) for every row; ``path`` is the vocabulary file on every executor."""
    path = path or public_tokenizers.path(VOCABULARY)
    schema = SCHEMA + ", ids array<int>" * keep_ids
    names = [x.split()[0] for x in schema.split(", ")]
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def rows(found: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())][: len(names)]
        columns = list(zip(*found)) if found else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(columns, kinds)], names)

    def finished(c: Codec, doc_id, ids: list[int]) -> tuple:
        return (doc_id, *digests(c, ids), *([ids] if keep_ids else []))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            yield rows([finished(c, d.as_py(), c.encode(t.as_py(), chunk, overlap)) for d, t in zip(batch["doc_id"], batch["text"])])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, u, t in zip(batch["doc_id"], batch["uid"], batch["text"]):
                text = t.as_py()
                starts = range(0, len(text), chunk)
                for some in range(0, len(starts), 16):
                    part = starts[some : some + 16]
                    yield pa.RecordBatch.from_arrays([pa.array([d.as_py()] * len(part), pa.int64()), pa.array([u.as_py()] * len(part), pa.int64()), pa.array(list(part), pa.int64()), pa.array([text[s : s + chunk + overlap] for s in part], pa.string())], ["doc_id", "uid", "start", "text"])

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            ends = [c.ends(t.as_py()) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends, pa.list_(pa.int32()))], [*batch.schema.names, "ends"])

    def joined(key: tuple, table: pa.Table) -> pa.Table:
        c = codec(path)
        found = sorted(zip(table["start"].to_pylist(), table["text"].to_pylist(), table["ends"].to_pylist()), key=lambda x: x[0])
        text = "".join(t[:chunk] for _, t, _ in found)
        ends = stitch(text, [(s, e) for s, _, e in found], chunk + overlap, c.ends)
        return pa.Table.from_batches([rows([finished(c, table["doc_id"][0].as_py(), c.encode_pieces(pieces_of(text, ends)))])])

    short = narrow.filter(F.octet_length("text") <= chunk).mapInArrow(lean(whole), schema)
    long = narrow.filter(F.octet_length("text") > chunk).withColumn("uid", F.monotonically_increasing_id())
    chunks = long.mapInArrow(lean(cut), "doc_id bigint, uid bigint, start bigint, text string").repartition("uid", "start")
    stitched = chunks.mapInArrow(lean(bounded), "doc_id bigint, uid bigint, start bigint, text string, ends array<int>").groupBy("uid").applyInArrow(joined, schema)
    return short.unionByName(stitched)


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, decoded binary) from (doc_id, ids): the tokens' raw bytes, end to end. Null ids give null."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            raw = [None if (ids := x.as_py()) is None else c.decode(ids) for x in batch["ids"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(raw, pa.binary())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(lean(run), "doc_id bigint, decoded binary")
