"""N-gram Jaccard join by grouped prefixes, and the classes that its links form.

A document's set holds its distinct 5-word shingles as 64-bit hashes (A-Z in lower case, words
split at ASCII white space; fewer words make one shingle). Two documents link when their sets'
Jaccard similarity is 0.75 or more.

1. One pass gives each document its class (a 128-bit hash of the whole set: equal sets are one
   class) and counts frequent shingles within tasks. The most frequent ones (``FREQUENT`` at
   most) only shape the global order: rare shingles first. Any order gives the same links.
2. Documents with the same prefix (the first n - ceil(0.75 n) + 1 shingles in that order) and
   the same size form one group. Postings (shingle, group, size, place) are packed by range of
   hashes; a frequent shingle's are salted by group. Per range, shingles that only one group has
   are dropped. A shingle that ``SHORT`` groups or fewer have gives all pairs of them; from a
   longer list each group only meets the first ``HUBS``, and the list's postings are kept.
3. Pairs of groups that pass the size, position and prefix filters are expanded and verified on
   whole sets, which gives provisional components. A long list that lies in one component is then
   done with. In the others, each class outside the list's main component is verified with its
   likeliest partners by a sketch; in the end all that is still outside is held against the whole
   list by the same filters, and every pair of different components that passes is verified. So
   no link is lost, and a large group of near copies costs about its size, not its square.
4. Connected components over the verified links name each class by its smallest doc_id.

Verification reads whole sets, made again from the texts of one document of each class that has
a candidate (found through a bitmap of fixed size, then joined exactly).

Defined cases: null, empty or blank text has no shingles, links with nothing and is its own
component; a null doc_id takes part and gets its component's smallest id (null if it has none);
repeated rows are one class. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, fresh, lean, written

WORDS = 5
#: Similarity in hundredths.
LIKE = 75
#: Shingles that the order puts last, at most; local counts from which a task reports one.
FREQUENT, REPORTED = 200_000, 2
#: Shingles that a task counts at a time, classes that it remembers, texts and bytes that it hashes at a time.
COUNTED, MEMORY, SOME, BLOCK = 1_000_000, 200_000, 500, 1 << 20
#: Postings of a range of hashes, about; those of a frequent shingle that stay together.
RANGE_POSTINGS, TOGETHER = 200_000, 20_000
#: Groups of a short list, all of whose pairs are formed; groups of a long one that each of it meets first.
SHORT, HUBS = 8, 8
#: Partners whose sets go to one place; classes of a long list that are compared by sketches together.
PARTNERS, LISTED = 256, 4_096
#: Likeliest partners of a class in a list that are tried first, rounds of that, bytes of a sketch, and the least similarity by it.
BEST, ROUNDS, SKETCH, LIKELY = 4, 1, 64, 0.6
#: Bits of the map of wanted documents: one megabyte.
BITMAP = 23

# Odd multipliers of the shingle hash and its final mix.
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0x27D4EB2F165667C5], np.uint64)
SKETCH_STARTS = np.arange(SKETCH, dtype=np.uint64) << np.uint64(58)
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
POSTING = np.dtype([("token", "<u8"), ("group", "<i8"), ("n", "<i4"), ("place", "<u4")])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX_1
    h = (h ^ (h >> np.uint64(27))) * MIX_2
    return h ^ (h >> np.uint64(31))


def _byte_values() -> np.ndarray:
    """A random number for each byte; A-Z count as a-z."""
    values = mixed(np.arange(1, 257, dtype=np.uint64) * ODD[0])
    values[65:91] = values[97:123]
    return values


BYTE = _byte_values()
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Multiplier of the rolling word hash, and its inverse modulo 2**64.
ROLL = 0xD1342543DE82EF95
UNROLL = pow(ROLL, -1, 2**64)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n + 1, ROLL, np.uint64), np.full(n + 1, UNROLL, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def word_places(raw: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the words in a stretch of bytes. ``breaks``: where a text starts, which also ends a word."""
    blank = BLANK[raw]
    first, last = ~blank, ~blank
    first[1:] &= blank[:-1]
    last[:-1] &= blank[1:]
    inside = breaks[(breaks > 0) & (breaks < len(raw))]
    first[inside] = ~blank[inside]
    last[inside - 1] = ~blank[inside - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def stretch_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end]: stretches of a running sum of values times powers, shifted to their start."""
    up, down = _powers(max(BLOCK, 1 << int(len(values)).bit_length()))
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mixed((total[end] - total[start]) * down[start])


def word_hashes(raw: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the words, by a few array operations for all bytes together."""
    start, end = word_places(raw, breaks)
    return start, stretch_hashes(BYTE[raw], start, end)


def stretches(texts: pa.Array) -> tuple[np.ndarray, Iterator[tuple[int, np.ndarray, np.ndarray]]]:
    """(offsets of the texts, stretches of their bytes): (offset, bytes, starts of texts in them). Nulls count as empty.

    A stretch has ``BLOCK`` bytes or a few more: it ends at white space or at the end of a text.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)

    def cut() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        at, stop = int(ends[0]), int(ends[-1])
        while at < stop:
            to = min(stop, at + BLOCK)
            while to < stop:
                near = np.flatnonzero(BLANK[raw[to : to + BLOCK]])
                text_end = int(ends[np.searchsorted(ends, to)])
                to = min(to + int(near[0]) if len(near) else to + BLOCK, text_end, stop)
                if len(near) or to == text_end:
                    break
            yield at, raw[at:to], ends[np.searchsorted(ends, at) : np.searchsorted(ends, to)] - at
            at = to

    return ends, cut()


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of ``SOME``: arrays over all words of a batch stay small."""
    for batch in batches:
        for at in range(0, batch.num_rows, SOME):
            yield batch.slice(at, SOME)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; empty for null."""
    starts, hashes = [], []
    ends, parts = stretches(texts)
    for at, raw, breaks in parts:
        start, h = word_hashes(raw, breaks)
        starts.append(start + at)
        hashes.append(h)
    if not starts:
        return [np.empty(0, np.uint64)] * len(texts)
    word, h = np.concatenate(starts), np.concatenate(hashes)
    bound = np.searchsorted(word, ends)
    windows = max(0, len(h) - WORDS + 1)
    total = h[:windows] * ODD[0]
    for j in range(1, WORDS):
        total += h[j : windows + j] * ODD[j]
    total = mixed(total)
    out = []
    for a, b in zip(bound[:-1].tolist(), bound[1:].tolist()):
        if b - a >= WORDS:
            s = np.sort(total[a : b - WORDS + 1])
            new = np.ones(len(s), bool)
            np.not_equal(s[1:], s[:-1], out=new[1:])
            out.append(s[new])
        elif b > a:
            out.append(mixed((h[a:b] * ODD[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(h[:0])
    return out


def class_of(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def prefix_size(n):
    return n - (LIKE * n + 99) // 100 + 1


def in_order(shingles: np.ndarray, tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Shingles that aren't frequent by hash, then frequent ones by count and hash."""
    if not len(tokens):
        return shingles
    at = np.searchsorted(tokens, shingles)
    at[at == len(tokens)] = 0
    often = tokens[at] == shingles
    if not often.any():
        return shingles
    late = shingles[often]
    return np.concatenate([shingles[~often], late[np.lexsort((late, counts[at[often]]))]])


def packed(posts: np.ndarray) -> bytes:
    """Postings column by column, small numbers byte by byte: what is mostly zero or repeats then compresses."""
    columns = [np.ascontiguousarray(posts[f]).view(np.uint8).reshape(len(posts), -1) for f in POSTING.names]
    return b"".join((c if f in ("token", "group") else c.T).tobytes() for f, c in zip(POSTING.names, columns))


def unpacked(raw: pa.Buffer) -> np.ndarray:
    own, at = np.empty(raw.size // POSTING.itemsize, POSTING), 0
    for f in POSTING.names:
        size = len(own) * POSTING[f].itemsize
        column = np.frombuffer(raw[at : at + size], np.uint8)
        column = column.reshape(len(own), -1) if f in ("token", "group") else column.reshape(-1, len(own)).T
        own[f] = np.ascontiguousarray(column).reshape(-1).view(POSTING[f])
        at += size
    return own


def _batch(schema: str, **columns) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    n = max(len(x) for x in columns.values())
    return pa.RecordBatch.from_arrays([pa.array(columns[name], kinds[kind]) if name in columns else pa.nulls(n, kinds[kind]) for name, kind in fields], [name for name, _ in fields])


CLASSED = "doc_id bigint, text_key bigint, n int, class binary, token bigint, seen bigint"


def classify(docs: DataFrame) -> DataFrame:
    """A row (doc_id, text_key, n, class) for every document, and rows (token, seen) of shingles frequent within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, np.ndarray] = {}
        size = 0

        def report() -> pa.RecordBatch:
            all_ = np.sort(np.concatenate(list(held.values())))
            first = np.flatnonzero(np.concatenate([[True], all_[1:] != all_[:-1]]))
            seen = np.diff(np.append(first, len(all_)))
            often = seen >= REPORTED
            return _batch(CLASSED, token=all_[first[often]].view(np.int64), seen=seen[often])

        for batch in slices(batches):
            sets = shingle_sets(batch["text"])
            classes = [class_of(s) for s in sets]
            yield _batch(CLASSED, doc_id=batch["doc_id"], text_key=batch["text_key"], n=[len(s) for s in sets], **{"class": classes})
            for c, s in zip(classes, sets):
                if len(s) and c not in held:
                    held[c] = s
                    size += len(s)
                if size >= COUNTED:
                    yield report()
                    held, size = {}, 0
        if held:
            yield report()

    return docs.withColumn("text_key", F.xxhash64("text")).mapInArrow(lean(run), CLASSED)


PACKED = "range bigint, data binary"


def pack_postings(docs: DataFrame, tokens: np.ndarray, counts: np.ndarray, ranges: int) -> DataFrame:
    """Rows (range, data): postings of a range of hashes; ranges below 0 hold (group, class, sketch) instead."""
    order = docs.sparkSession.sparkContext.broadcast((tokens, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = order.value
        seen: set[bytes] = set()
        held: list[np.ndarray] = []
        members: list[tuple[int, bytes]] = []
        size = 0

        def send() -> pa.RecordBatch:
            all_ = np.concatenate(held)
            at = all_["token"].copy()
            if len(tokens):  # postings of a frequent shingle go by group as well
                i = np.searchsorted(tokens, at)
                i[i == len(tokens)] = 0
                salts = np.where(tokens[i] == at, counts[i] // TOGETHER, 0).astype(np.uint64)
                hot = salts > 0
                at[hot] = mixed(at[hot] + mixed(all_["group"][hot].view(np.uint64) ^ at[hot]) % (salts[hot] + np.uint64(1)))
            part = ((at >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
            by = np.argsort(part, kind="stable")
            part, all_ = part[by], all_[by]
            first = np.flatnonzero(np.diff(part, prepend=-1))
            data = [packed(x) for x in np.split(all_, first[1:])]
            groups: dict[int, list[bytes]] = {}
            for g, c in members:
                groups.setdefault(-1 - g % ranges, []).append(g.to_bytes(8, "little", signed=True) + c)
            return _batch(PACKED, range=[*part[first].tolist(), *groups], data=[*data, *(b"".join(x) for x in groups.values())])

        for batch in slices(batches):
            for s in shingle_sets(batch["text"]):
                if not len(s) or (c := class_of(s)) in seen:
                    continue
                if len(seen) > MEMORY:
                    seen.clear()
                seen.add(c)
                n, p = len(s), prefix_size(len(s))
                prefix = in_order(s, tokens, counts)[:p]
                group = xxhash.xxh3_64_intdigest(prefix.tobytes(), n) - 2**63
                own = np.empty(p, POSTING)
                own["token"], own["group"], own["n"], own["place"] = prefix, group, n, np.arange(p)
                held.append(own)
                members.append((group, c + sketched(s)))
                size += p
                if size >= COUNTED:
                    yield send()
                    held, members, size = [], [], 0
        if held:
            yield send()

    return docs.select("text").mapInArrow(lean(run), PACKED)


def may_link(n1, n2, place1, place2):
    """Size and position filters on arrays, for the first shingle in the order that two sets have in common."""
    small, large = np.minimum(n1, n2), np.maximum(n1, n2)
    return (100 * small >= LIKE * large) & ((100 + LIKE) * np.minimum(n1 - place1, n2 - place2) >= LIKE * (n1 + n2))


SHARED = "kind string, token bigint, a bigint, b bigint, n int, m int, place int, common int, passes boolean, class binary, sketch binary"


def listed_pairs(posts: np.ndarray, short: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
    """Rows of kind 'pair' (a, b, n, m, common, passes) from postings sorted by (token, group).

    Short lists give all their pairs, with the number of lists that a pair has in ``common``; long
    ones give each group with the list's first ``HUBS`` groups, if the filters pass.
    """
    found = []
    n, place = posts["n"].astype(np.int64), posts["place"].astype(np.int64)

    def add(i: np.ndarray, j: np.ndarray, common: int) -> None:
        fit = 100 * np.minimum(n[i], n[j]) >= LIKE * np.maximum(n[i], n[j])
        i, j = i[fit], j[fit]
        passes = may_link(n[i], n[j], place[i], place[j])
        if not common:
            i, j, passes = i[passes], j[passes], passes[passes]
        found.append((posts["group"][i], posts["group"][j], n[i], n[j], np.full(len(i), common), passes))

    at = np.arange(len(posts))
    for d in range(1, SHORT):
        i = at[: max(0, len(at) - d)]
        add(*(x[short[i] & (first[i] == first[i + d])] for x in (i, i + d)), 1)
    rest = at[~short]
    for r in range(HUBS):
        later = rest[rest - first[rest] > r]
        add(first[later] + r, later, 0)
    a, b, n, m, common, passes = (np.concatenate(x) for x in zip(*found))
    by = np.lexsort((b, a))
    a, b = a[by], b[by]
    new = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.empty(0, np.int64)
    if not len(new):
        return _batch(SHARED, kind=pa.array([], pa.string()))
    common, passes = np.add.reduceat(common[by], new), np.logical_or.reduceat(passes[by], new)
    return _batch(SHARED, kind=["pair"] * len(new), a=a[new], b=b[new], n=n[by][new].astype(np.int32), m=m[by][new].astype(np.int32), common=common.astype(np.int32), passes=passes)


def shared_postings(packed: DataFrame, salted: np.ndarray) -> DataFrame:
    """Of each range: kind 'pair' (see ``listed_pairs``), 'post' (token, a, n, place) of long lists, 'member' (a, class, sketch).

    A list is long if it has more than ``SHORT`` groups or is ``salted`` (a range has a part of it).
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        part = key[0].as_py()
        if part < 0:
            rows = sorted({x[i : i + 24 + SKETCH] for chunk in table["data"] for x in [chunk.as_py()] for i in range(0, len(x), 24 + SKETCH)})
            return pa.Table.from_batches([_batch(SHARED, kind=["member"] * len(rows), a=[int.from_bytes(r[:8], "little", signed=True) for r in rows], sketch=[r[24:] for r in rows], **{"class": [r[8:24] for r in rows]})])
        posts = np.concatenate([unpacked(chunk.as_buffer()) for chunk in table["data"]])
        posts = posts[np.argsort(posts["token"], kind="stable")]
        same = posts["token"][1:] == posts["token"][:-1]
        posts = posts[np.append(same, False) | np.append(False, same)]  # most shingles are in one prefix only
        posts = posts[np.lexsort((posts["group"], posts["token"]))]
        twice = np.zeros(len(posts), bool)  # the same group from several tasks
        twice[1:] = (posts["token"][1:] == posts["token"][:-1]) & (posts["group"][1:] == posts["group"][:-1])
        posts = posts[~twice]
        first = np.flatnonzero(np.append(True, posts["token"][1:] != posts["token"][:-1])) if len(posts) else np.empty(0, np.int64)
        size = np.diff(np.append(first, len(posts)))
        first, size = np.repeat(first, size), np.repeat(size, size)
        long = (size > SHORT) | np.isin(posts["token"], salted)
        kept = posts[long]
        held = _batch(SHARED, kind=["post"] * len(kept), token=kept["token"].view(np.int64), a=kept["group"], n=kept["n"], place=kept["place"].astype(np.int32))
        return pa.Table.from_batches([listed_pairs(posts, ~long, first), held])

    return packed.groupBy("range").applyInArrow(run, SHARED)


def id_bitmap(doc_ids: DataFrame) -> np.ndarray:
    """A map of ids of fixed size: the bit of each id is set."""
    bit = F.col("doc_id").bitwiseXOR(F.shiftright("doc_id", BITMAP)).bitwiseAND(F.lit((1 << BITMAP) - 1))
    words = doc_ids.filter("doc_id IS NOT NULL").select(F.shiftright(bit, 6).cast("int").alias("w"), F.expr(f"shiftleft(1L, int((doc_id ^ shiftright(doc_id, {BITMAP})) & 63))").alias("m"))
    rows = words.groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()  # 2**17 rows at most
    bits = np.zeros(1 << (BITMAP - 6), np.int64)
    bits[rows["w"].to_numpy()] = rows["m"].to_numpy()
    return bits


def in_bitmap(ids: pa.Array, bits: np.ndarray) -> np.ndarray:
    """Whether the map may hold each id; nulls always count."""
    known = ids.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
    low = (known ^ (known >> BITMAP)) & ((1 << BITMAP) - 1)
    return ((bits[low >> 6] >> (low & 63)) & 1).astype(bool) | ids.is_null().to_numpy(zero_copy_only=False)


def wanted_sets(docs: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """(class, shingles) of the documents whose ids are wanted (more may pass the bitmap), and of all without an id."""
    bitmap = docs.sparkSession.sparkContext.broadcast(id_bitmap(doc_ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in slices(batches):
            wanted = in_bitmap(batch["doc_id"], bitmap.value)
            texts = batch["text"].take(pa.array(np.flatnonzero(wanted)))
            sets = {class_of(s): s for s in shingle_sets(texts) if len(s)}
            fresh_ones = [c for c in sets if c not in seen]
            if len(seen) > MEMORY:
                seen.clear()
            seen.update(fresh_ones)
            for at in range(0, len(fresh_ones), 256):
                some = fresh_ones[at : at + 256]
                yield _batch("class binary, shingles binary", shingles=[sets[c].tobytes() for c in some], **{"class": some})

    return docs.mapInArrow(lean(run), "class binary, shingles binary")


def verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of the written pairs of classes (a, b), none twice, those whose whole sets are alike; written.

    The set of a goes once to the place where its partners' sets are sent one by one; a class with
    more than ``PARTNERS`` of them has several such places.
    """
    many = written(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > PARTNERS))
    part = F.coalesce(F.expr(f"pmod(xxhash64(b), k div {PARTNERS} + 1)"), F.lit(0).cast("bigint"))
    dealt = pairs.select("a", "b").join(many, "a", "left").select("a", "b", part.alias("part"))
    asked = written(dealt.select("a", "part", F.lit(False).alias("other"), F.col("a").alias("class")).distinct().union(dealt.select("a", "part", F.lit(True), "b")))
    wanted = written(asked.select("class").distinct().join(classes, "class").select("class", F.col("head")["doc_id"].alias("doc_id")))
    sent = asked.join(wanted_sets(docs, wanted.select("doc_id")), "class")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = own_class = last = None
        for batch in batches:
            found: list[tuple[bytes, bytes]] = []
            for row in range(batch.num_rows):
                a, part, other, c = (batch[name][row].as_py() for name in ("a", "part", "other", "class"))
                if (a, part, other, c) == last:  # the set of a class from several tasks
                    continue
                last = a, part, other, c
                s = np.frombuffer(batch["shingles"][row].as_buffer(), np.uint64)
                if not other:
                    own, own_class = s.copy(), a
                elif own_class == a:
                    both = len(np.intersect1d(own, s, assume_unique=True))
                    if 100 * both >= LIKE * (len(own) + len(s) - both):
                        found.append((a, c))
            yield _batch("a binary, b binary", a=[a for a, _ in found], b=[b for _, b in found])

    compared = sent.repartition("a", "part").sortWithinPartitions("a", "part", "other", "class").mapInArrow(lean(run), "a binary, b binary")
    out = written(compared)
    discard(many, asked, wanted)
    return out


def enough(common, n1: str = "n", n2: str = "m"):
    """Whether sets of these sizes may be alike, by what their prefixes have in common.

    Of two prefixes, let x's end first in the order. A shared shingle then lies in both prefixes
    or behind x's, so the overlap is at most the common part of the prefixes and the rest of x.
    """
    behind = F.greatest(*[F.expr(f"ceil({LIKE} * {n} / 100) - 1") for n in (n1, n2)])
    return (100 + LIKE) * (common + behind) >= LIKE * (F.col(n1) + F.col(n2))


def group_pairs(shared: DataFrame, longs: DataFrame) -> DataFrame:
    """(g, h) of groups that a list names together and that pass the filters. ``longs``: a group's shingles with long lists."""
    pairs = shared.filter("kind = 'pair'").groupBy(F.col("a").alias("g"), F.col("b").alias("h")).agg(F.first("n").alias("n"), F.first("m").alias("m"), F.sum("common").alias("common"), F.max("passes").alias("passes")).filter("passes")
    one = longs.select(F.col("group").alias("g"), F.col("tokens").alias("t1"))
    two = longs.select(F.col("group").alias("h"), F.col("tokens").alias("t2"))
    more = F.coalesce(F.greatest(F.size(F.array_intersect("t1", "t2")), F.lit(0)), F.lit(0))
    return pairs.join(one, "g", "left").join(two, "h", "left").filter(enough(F.col("common") + more)).select("g", "h")


def sketched(shingles: np.ndarray) -> bytes:
    """A byte from the least hash of each of ``SKETCH`` equal ranges, 0 for an empty one: tells how alike two sets may be."""
    at = np.searchsorted(shingles, SKETCH_STARTS)
    there = at < np.append(at[1:], len(shingles))
    out = np.zeros(SKETCH, np.uint8)
    out[there] = (mixed(shingles[at[there]]) % np.uint64(255)).astype(np.uint8) + 1
    return out.tobytes()


def likeliest(lists: DataFrame, sketches: DataFrame) -> DataFrame:
    """(a, b): the ``BEST`` partners in each part of a list that are likeliest by their sketches, for each class outside the list's main component.

    ``lists`` has (token, part, main, class, n, place, component). Only a choice of what is verified first.
    """

    def chosen(rows: list[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        part = pa.Table.from_batches(rows).combine_chunks()
        n, place = (part[c].to_numpy().astype(np.int64) for c in ("n", "place"))
        kind, component = np.unique(part["component"].to_numpy(), return_inverse=True)
        sketch = np.frombuffer(b"".join(part["sketch"].to_pylist()), np.uint8).reshape(len(n), SKETCH)
        outside = np.flatnonzero(kind[component] != part["main"][0].as_py())
        for some in np.array_split(outside, max(1, len(outside) * len(n) >> 18)):
            fit = may_link(n[some][:, None], n, place[some][:, None], place) & (component[some][:, None] != component)
            o, m = np.nonzero(fit)
            x, y = sketch[some[o]], sketch[m]
            score = ((x == y) & (x > 0)).sum(axis=1) / np.maximum(1, ((x > 0) | (y > 0)).sum(axis=1))
            likely = score >= LIKELY
            o, m, score = o[likely], m[likely], score[likely]
            by = np.lexsort((-score, o))
            o, m = o[by], m[by]
            keep = np.arange(len(o)) - np.searchsorted(o, o) < BEST
            yield part["class"].take(pa.array(some[o[keep]])), part["class"].take(pa.array(m[keep]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def settled() -> Iterator[pa.RecordBatch]:
            for a, b in chosen(held) if held else ():
                yield pa.RecordBatch.from_arrays([a.combine_chunks(), b.combine_chunks()], ["a", "b"])

        for batch in batches:
            token, part = batch["token"].to_numpy(), batch["part"].to_numpy()
            new = np.flatnonzero(np.append(True, (token[1:] != token[:-1]) | (part[1:] != part[:-1])))
            for i, j in zip(new.tolist(), [*new[1:].tolist(), batch.num_rows]):
                if (token[i], part[i]) != last:
                    yield from settled()
                    held, last = [], (token[i], part[i])
                held.append(batch.slice(i, j - i))
        yield from settled()

    kind = lists.schema["class"].dataType.simpleString()
    lists = lists.select("token", "part", "main", "class", "n", "place", "component").join(sketches, "class")
    return lists.repartition("token", "part").sortWithinPartitions("token", "part").mapInArrow(lean(run), f"a {kind}, b {kind}").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def open_lists(entries: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of ``entries`` in lists of several components, with component and the list's main one, that of most of its classes; written."""
    at = known.select(F.col("node").alias("class"), "component")
    placed = written(entries.join(at, "class", "left").withColumn("component", F.coalesce("component", "class")))
    by_list = placed.groupBy("token", "component").agg(F.count(F.lit(1)).alias("k")).groupBy("token").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.count(F.lit(1)).alias("parts"), F.sum("k").alias("k"))
    mixed_lists = written(by_list.filter("parts > 1").select("token", "main", "k"))
    out = written(placed.join(mixed_lists, "token").withColumn("part", F.expr(f"pmod(xxhash64(class), k div {LISTED} + 1)")))
    discard(placed, mixed_lists)
    return out


def open_pairs(lists: DataFrame, longs: DataFrame) -> DataFrame:
    """(a, b): all pairs of classes that a list names together, that are in different components and that pass the filters.

    What is outside a list's main component is held against the whole list. The position filter holds for
    the first shingle that two prefixes share, so a pair passes it in one list at least; a pair that a short
    list has too was settled there. Pairs in a whole list pass.
    """
    out = lists.filter("component <> main").select("token", F.col("class").alias("a"), "n", "place", F.col("group").alias("g"), F.col("component").alias("c1"))
    all_ = lists.select("token", F.col("class").alias("b"), F.col("n").alias("m"), F.col("place").alias("place2"), F.col("group").alias("h"), F.col("component").alias("c2"), "main", "whole")
    apart = F.expr(f"c1 <> c2 AND (c2 = main OR a < b) AND 100 * least(n, m) >= {LIKE} * greatest(n, m) AND {100 + LIKE} * least(n - place, m - place2) >= {LIKE} * (n + m)")
    pairs = out.join(all_, "token").filter(apart)
    ends = F.struct("a", "g", "n"), F.struct(F.col("b").alias("a"), F.col("h").alias("g"), F.col("m").alias("n"))
    pairs = pairs.groupBy(F.least(*ends).alias("x"), F.greatest(*ends).alias("y")).agg(F.max("whole").alias("whole"))
    pairs = pairs.select(F.col("x.a").alias("a"), F.col("x.g").alias("g"), F.col("x.n").alias("n"), F.col("y.a").alias("b"), F.col("y.g").alias("h"), F.col("y.n").alias("m"), "whole")
    one = longs.select(F.col("group").alias("g"), F.col("tokens").alias("t1"))
    two = longs.select(F.col("group").alias("h"), F.col("tokens").alias("t2"))
    return pairs.join(one, "g", "left").join(two, "h", "left").filter(F.col("whole") | enough(F.size(F.array_intersect("t1", "t2")))).select("a", "b").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_shingles, class, head, component_id) for every row of ``docs``.

    text_key is xxhash64 of the text, head the first (doc_id is null, doc_id, text_key) of the component
    (null without shingles) and component_id its smallest doc_id."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    first = written(classify(docs))
    rows = first.filter("class IS NOT NULL").select("doc_id", "text_key", "n", "class")
    often = first.filter("token IS NOT NULL").groupBy("token").agg(F.sum("seen").alias("seen")).orderBy(F.col("seen").desc(), "token").limit(FREQUENT).toArrow()
    tokens, counts = often["token"].to_numpy().view(np.uint64), often["seen"].to_numpy()
    by = np.argsort(tokens)
    tokens, counts = tokens[by], counts[by]
    classes = written(rows.filter("n > 0").groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")).alias("head"), F.first("n").alias("n")))
    postings = classes.agg(F.sum(F.expr(f"n - ceil({LIKE} * n / 100) + 1"))).first()[0] or 0
    ranges = max(2 * spark.sparkContext.defaultParallelism, -(-int(postings) // RANGE_POSTINGS))
    shared = written(shared_postings(pack_postings(docs, tokens, counts, ranges), tokens[counts >= TOGETHER]))

    members = written(shared.filter("kind = 'member'").select(F.col("a").alias("group"), "class", "sketch").distinct())
    posts = shared.filter("kind = 'post'").select("token", F.col("a").alias("group"), "n", "place")
    one = written(members.groupBy("group").agg(F.min("class").alias("class"), F.count(F.lit(1)).alias("several")))
    longs = written(posts.groupBy("group").agg(F.collect_list("token").alias("tokens")))
    pairs = written(group_pairs(shared, longs))
    inner = members.select("group", "class").join(one.filter("several > 1").select("group", F.col("class").alias("head")), "group")
    named = pairs.join(one.select(F.col("group").alias("g"), F.col("class").alias("a")), "g").join(one.select(F.col("group").alias("h"), F.col("class").alias("b")), "h")
    candidates = written(named.select("a", "b").union(inner.filter("class <> head").select(F.col("head").alias("a"), F.col("class").alias("b"))))
    links = verified(docs, candidates, classes)
    known = components(links)

    # what is open: long lists, and groups of several members, among themselves and with a group that passed
    several = one.filter("several > 1").select("group")
    beside = pairs.join(several.select(F.col("group").alias("g")), "g", "left_semi").union(pairs.join(several.select(F.col("group").alias("h")), "h", "left_semi").select("g", "h")).distinct()
    beside = beside.select(F.xxhash64("g", "h").alias("token"), F.explode(F.array("g", "h")).alias("group")).union(several.select(F.xxhash64("group", "group"), "group"))
    entries = posts.withColumn("whole", F.lit(False)).union(beside.select("token", "group", F.lit(1), F.lit(0), F.lit(True))).join(members.select("group", "class"), "group")
    normal = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    done = normal(candidates)
    sketches = members.select("class", "sketch")
    for choose in [lambda lists: likeliest(lists, sketches)] * ROUNDS + [lambda lists: open_pairs(lists, longs)]:
        lists = open_lists(entries, known)
        more = written(choose(lists).join(done, ["a", "b"], "left_anti"))
        discard(lists)
        if more.isEmpty():
            continue
        found = verified(docs, more, classes)
        done = done.union(more.select("a", "b"))
        if not found.isEmpty():
            known = components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).union(found))
    discard(shared, members, longs, one, pairs)

    placed = known.withColumnRenamed("node", "class").join(classes.select("class", "head"), "class")
    least = written(placed.groupBy("component").agg(F.min("head").alias("least")))
    labels = written(classes.select("class", "head").join(placed.select("class", "component").join(least, "component"), "class", "left").select("class", F.coalesce("least", "head").alias("head")))
    out = rows.join(labels, "class", "left")
    return out.select("doc_id", "text_key", F.col("n").cast("bigint").alias("n_shingles"), "class", "head", F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("head")["doc_id"]).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` but one document for each component: its smallest doc_id (null last, then the smallest text hash).

    Rows are named by (doc_id, text hash); of rows that repeat the kept one exactly, one stays.
    Documents without shingles link with nothing and all stay.
    """
    key, id_ = fresh(docs, "_text_key", "_id")
    found = written(near_duplicates(docs).filter("n_shingles > 0").select("doc_id", "text_key", "head"))
    rest = found.filter(~(F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("text_key") == F.col("head.text_key"))))
    named = lambda df: df.select(F.col("text_key").alias(key), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias(id_))
    again = written(named(found).groupBy(key, id_).count().filter("count > 1").drop("count").join(named(rest).distinct(), [key, id_], "left_anti"))
    judged = rest.select("doc_id").union(again.select(F.nullif(F.col(id_), F.lit("")).cast("bigint")))
    bitmap, at = docs.sparkSession.sparkContext.broadcast(id_bitmap(judged)), docs.columns.index("doc_id")

    def part(chosen: bool) -> DataFrame:
        """The rows whose ids the map of what goes or repeats may hold, or the others, which stay where they are read."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(in_bitmap(batch.column(at), bitmap.value) == chosen))

        return docs.mapInArrow(lean(run), docs.schema)

    keyed = part(True).withColumn(key, F.xxhash64("text")).withColumn(id_, F.coalesce(F.col("doc_id").cast("bigint").cast("string"), F.lit("")))
    kept = keyed.join(named(rest).distinct(), [key, id_], "left_anti")
    if not again.isEmpty():
        kept = kept.join(again, [key, id_], "left_anti").unionByName(kept.join(again, [key, id_], "left_semi").dropDuplicates([key, id_]))
    return kept.select(*docs.columns).unionByName(part(False))
