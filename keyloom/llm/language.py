"""Language identification by unigrams marginalised over all segmentations.

A fixed public byte-level vocabulary gives the pieces (all single bytes are among them, so any
text can be segmented). A word is a run of letters in lower
case behind a blank, and no piece goes beyond one. Each language has a probability for each
piece; a word's probability is the sum over all of its segmentations, by a forward algorithm,
and a text's log probability is the sum over its words. The prediction is the language of the
greatest posterior under equal priors, which is the score.

Training is one expectation step over the learning texts: with all pieces equally likely, the
forward-backward algorithm gives the expected number of times that each piece is used, tasks add
these up by language, and counts are smoothed towards those of all languages together. All labelled
texts that aren't held out are learnt from, so every language of theirs can be predicted. What
reaches the driver is a row for each piece and language at most.

Words are worked on in batches of equal length as arrays: places, not words, are looped over.
Words beyond ``ARRAY_BYTES`` take the same recursions one by one, whole, in logarithms.

Defined cases: null text, or one without a letter, is ``und`` with score 0, as is every text when
nothing can be learnt from; on equal posteriors the least language in code-point order wins; a
null doc_id is held out of nothing and not learnt from. Predictions read the text alone.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
ARRAY_BYTES = 32
#: Words that a task counts or remembers before it starts afresh, texts' characters and words worked on at a time.
MEMORY, AT_ONCE, BATCH, LEARN_BATCH = 150_000, 4_000_000, 65_536, 8_192
#: Sums below this are formed again in logarithms.
TINY = 1e-280
#: Pseudo-counts spread over the pieces as all languages together use them, and the share of an even spread.
PSEUDO, EVEN = 500.0, 1e-3
WORDS = re.compile(r"[^\W\d_]+")
IN_WORDS = re.compile(rb" ?[a-z\x80-\xff]*")
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
_BASE = np.uint64(0x100000001B3)


class Pieces:
    """Numbers of the vocabulary's pieces, for byte strings and for arrays of rolling hashes."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            pieces = sorted(base64.b64decode(a) for a, _ in map(bytes.split, lines))
        self.number = {p: i for i, p in enumerate(pieces)}
        #: Lengths of pieces that words can hold: a blank comes first only, other ASCII bytes are lower-case letters.
        self.lengths = sorted({len(p) for p in pieces if IN_WORDS.fullmatch(p)})
        self.longest = self.lengths[-1]
        self.size = len(pieces)
        key = np.zeros(self.size, np.uint64)
        for i, p in enumerate(pieces):
            h = 0
            for b in p:
                h = (h * int(_BASE) + b + 1) % 2**64
            key[i] = h
        if len(np.unique(key)) < self.size:
            raise ValueError("two pieces share a hash")
        self.tables, left, bits = [], np.arange(self.size), 19
        for m in _MULTIPLIERS:  # a piece whose place is taken goes to the next table
            at = (key[left] * np.uint64(m)) >> np.uint64(64 - bits)
            _, first = np.unique(at, return_index=True)
            keys, ids = np.zeros(1 << bits, np.uint64), np.full(1 << bits, self.size, np.int32)
            keys[at[first]], ids[at[first]] = key[left[first]], left[first]
            self.tables.append((np.uint64(m), np.uint64(64 - bits), keys, ids))
            left = np.delete(left, first)
            if len(self.tables) == 1:
                self.later = np.zeros(1 << bits, bool)  # places of the first table that pieces of the others fall on too
                self.later[(key[left] * np.uint64(m)) >> np.uint64(64 - bits)] = True
            bits = 13
            if not len(left):
                break
        if len(left):
            raise ValueError("the hash tables don't hold the vocabulary")

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers of hashes; ``size`` where there is none."""
        m, shift, keys, ids = self.tables[0]
        at = (h * m) >> shift
        out = np.where(keys[at] == h, ids[at], self.size)
        for m, shift, keys, ids in self.tables[1:]:  # few pieces, which a coarse map tells apart from the rest
            rows = np.nonzero(self.later[at])
            if not len(rows[0]):
                break
            rest = h[rows]
            place = (rest * m) >> shift
            hit = (keys[place] == rest) & (ids[place] < self.size)
            out[tuple(r[hit] for r in rows)] = ids[place[hit]]
        return out

    def spans(self, words: list[bytes]) -> dict[tuple[int, int], np.ndarray]:
        """(start, end) -> piece numbers, for words of one length."""
        n = len(words[0])
        b = np.frombuffer(b"".join(words), np.uint8).reshape(-1, n).T.astype(np.uint64) + np.uint64(1)
        h, out = np.zeros_like(b), {}
        for size in range(1, min(n, self.longest) + 1):
            h = h[: n - size + 1] * _BASE + b[size - 1 :]
            if size not in self.lengths:
                continue
            found = self.find(h)
            for s in np.flatnonzero((found < self.size).any(axis=1)).tolist():
                out[s, s + size] = found[s]
        return out


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def _by_length(words: list[bytes]) -> tuple[dict[int, list[int]], list[int]]:
    short: dict[int, list[int]] = {}
    long = []
    for i, w in enumerate(words):
        if len(w) <= ARRAY_BYTES:
            short.setdefault(len(w), []).append(i)
        else:
            long.append(i)
    return short, long


def _ending(pieces: Pieces, word: bytes, e: int) -> list[tuple[int, int]]:
    """(start, piece number) of the pieces that end at place ``e`` of the word."""
    found = [(e - size, pieces.number.get(word[e - size : e])) for size in pieces.lengths if size <= e]
    return [(s, number) for s, number in found if number is not None]


def log_words(pieces: Pieces, words: list[bytes], p: np.ndarray) -> np.ndarray:
    """log probability of each word for each column of ``p`` (pieces x languages): the sum over segmentations."""
    out = np.zeros((len(words), p.shape[1]))
    padded = np.vstack([p, np.zeros((1, p.shape[1]))])
    short, long = _by_length(words)
    for n, own in short.items():
        spans = pieces.spans([words[i] for i in own])
        alpha = np.zeros((n + 1, len(own), p.shape[1]))
        alpha[0] = 1.0
        for (s, e), found in sorted(spans.items()):
            alpha[e] += alpha[s] * padded[found]
        small = (alpha[n] < TINY).any(axis=1)
        long += [i for i, x in zip(own, small) if x] if small.any() else []
        out[own] = np.log(np.maximum(alpha[n], TINY))
    with np.errstate(divide="ignore"):
        logs = np.log(p) if long else p
    for i in long:
        recent = [np.zeros(p.shape[1])]  # the logarithms of the sums that a piece may follow
        for e in range(1, len(words[i]) + 1):
            ends = [recent[s - e] + logs[number] for s, number in _ending(pieces, words[i], e)]
            recent = [*recent[1 - pieces.longest :], np.logaddexp.reduce(ends, axis=0) if ends else np.full(p.shape[1], -np.inf)]
        out[i] = recent[-1]
    return out


def expected_counts(pieces: Pieces, words: list[bytes], counts: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Expected uses of each piece (pieces x languages) by forward-backward; ``counts`` is words x languages."""
    out = np.zeros((pieces.size + 1, counts.shape[1]))
    padded = np.append(p, 0.0)
    short, long = _by_length(words)
    for n, own in short.items():
        spans = sorted(pieces.spans([words[i] for i in own]).items())
        alpha, beta = np.zeros((n + 1, len(own))), np.zeros((n + 1, len(own)))
        alpha[0] = beta[n] = 1.0
        for (s, e), found in spans:
            alpha[e] += alpha[s] * padded[found]
        for (s, e), found in reversed(spans):
            beta[s] += padded[found] * beta[e]
        used = [(found, alpha[s] * padded[found] * beta[e] / alpha[n]) for (s, e), found in spans]
        number, use = np.concatenate([x for x, _ in used]), np.concatenate([x for _, x in used])
        repeat = np.tile(np.arange(len(own)), len(used))
        for c in range(counts.shape[1]):
            out[:, c] += np.bincount(number, use * counts[own, c][repeat], minlength=pieces.size + 1)
    with np.errstate(divide="ignore"):
        logs = np.log(p) if long else p
    for i in long:
        w, n = words[i], len(words[i])
        edges = [(s, e, number) for e in range(1, n + 1) for s, number in _ending(pieces, w, e)]
        start, end, number = (np.array(x) for x in zip(*edges))
        cost = logs[number]
        alpha, beta = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        alpha[0] = beta[n] = 0.0
        cuts = np.searchsorted(end, np.arange(n + 2))  # edges come by their ends
        for e in range(1, n + 1):
            own = slice(cuts[e], cuts[e + 1])
            alpha[e] = np.logaddexp.reduce(alpha[start[own]] + cost[own])
        by_start = np.argsort(start, kind="stable")
        cuts = np.searchsorted(start[by_start], np.arange(n + 2))
        for s in range(n - 1, -1, -1):
            own = by_start[cuts[s] : cuts[s + 1]]
            beta[s] = np.logaddexp.reduce(cost[own] + beta[end[own]])
        use = np.bincount(number, np.exp(alpha[start] + cost + beta[end] - alpha[n]), minlength=pieces.size + 1)
        out += use[:, None] * counts[i]
    return out[:-1]


def held_out(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    """Whether crc32 of the id as text leaves remainder ``fold``; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("bigint").cast("string").cast("binary")) % folds == fold, F.lit(False))


def words_of(text: str | None) -> list[str]:
    found = WORDS.findall(text.lower()) if text else []
    return found if any(c.isalpha() for w in found for c in w) else []


def train(docs: DataFrame, path: str | None = None) -> tuple[list[str], np.ndarray]:
    """(languages, pieces x languages) from the text and lang of ``docs``."""
    path = path or public_tokenizers.path(VOCABULARY)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(path)
        even = np.full(pieces.size, 1.0 / pieces.size)
        seen: dict[str, Counter] = {}
        total: dict[str, np.ndarray] = {}

        def settle() -> None:
            for lang, words in seen.items():
                keys = [b" " + w.encode() for w in words]
                number = np.fromiter(words.values(), float, len(words))[:, None]
                for a in range(0, len(keys), LEARN_BATCH):
                    some = slice(a, a + LEARN_BATCH)
                    total[lang] = total.get(lang, 0) + expected_counts(pieces, keys[some], number[some], even)
            seen.clear()

        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                seen.setdefault(lang.as_py(), Counter()).update(words_of(text.as_py()))
                if sum(map(len, seen.values())) > MEMORY:
                    settle()
        settle()
        for lang, sums in total.items():
            some = np.flatnonzero(sums[:, 0] > 0)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some), pa.array(sums[some, 0])], ["lang", "piece", "uses"])

    labelled = docs.select(F.col("lang").cast("string").alias("lang"), "text").filter("lang IS NOT NULL AND text IS NOT NULL")
    rows = labelled.mapInArrow(count, "lang string, piece bigint, uses double")
    sums = rows.groupBy("lang", "piece").agg(F.sum("uses").alias("uses")).orderBy("lang", "piece")
    found = sums.toArrow()  # pieces x languages rows at most
    languages = sorted(set(found["lang"].to_pylist()))
    pieces = pieces_of(path)
    uses = np.zeros((pieces.size, len(languages)))
    place = {x: i for i, x in enumerate(languages)}
    uses[found["piece"].to_numpy(), [place[x] for x in found["lang"].to_pylist()]] = found["uses"].to_numpy()
    if not languages:
        return [], uses
    common = uses.sum(axis=1) / uses.sum()
    common = (1 - EVEN) * common + EVEN / pieces.size
    return languages, (uses + PSEUDO * common[:, None]) / (uses.sum(axis=0) + PSEUDO)


def predict(docs: DataFrame, languages: list[str], p: np.ndarray, path: str | None = None) -> DataFrame:
    """(doc_id, lang_pred, score) for every row, from its text alone."""
    path = path or public_tokenizers.path(VOCABULARY)
    model = docs.sparkSession.sparkContext.broadcast(p)

    class Remembered:
        def __init__(self) -> None:
            self.clear()

        def clear(self) -> None:
            self.place: dict[str, int] = {}
            self.score = np.empty((4096, len(languages)))

        def learn(self, new: list[str]) -> None:
            n = len(self.place)
            while n + len(new) > len(self.score):
                self.score = np.concatenate([self.score, np.empty_like(self.score)])
            for a in range(0, len(new), BATCH):
                some = new[a : a + BATCH]
                self.score[n + a : n + a + len(some)] = log_words(pieces_of(path), [b" " + w.encode() for w in some], model.value)
            self.place.update(zip(new, range(n, n + len(new))))

    def judge(known: Remembered, words: list[str]) -> tuple[str, float]:
        if not words or not languages:
            return "und", 0.0
        total = known.score[np.array([known.place[w] for w in words])].sum(axis=0)
        best = int(total.argmax())
        return languages[best], float(1.0 / np.exp(total - total[best]).sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Remembered()
        for batch in batches:
            ids, found, held, chars = [], [], [], 0

            def settle() -> None:
                if languages:
                    if len(known.place) > MEMORY:
                        known.clear()
                    known.learn(list(dict.fromkeys(w for words in held for w in words if w not in known.place)))
                found.extend(judge(known, words) for words in held)

            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids.append(doc_id)
                held.append(words_of(t := text.as_py()))
                chars += len(t or "")
                if chars > AT_ONCE:
                    settle()
                    held, chars = [], 0
            settle()
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def learning_rows(docs: DataFrame) -> DataFrame:
    """All labelled documents that aren't held out."""
    return docs.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull())


def identify(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learns from documents that aren't held out and predicts all."""
    languages, p = train(learning_rows(docs), path)
    return predict(docs, languages, p, path).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
