"""Language, quality, near duplicates, secrets, tokens and the pipeline."""

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from keyloom.llm import language, neardup, quality, secrets, tokenizing

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, w string, class int, _id int"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, lang, "s", len(t or ""), "w", 1, 2) for d, t, lang in rows], SCHEMA)


def words(rng, n, prefix="w", most=4000):
    return " ".join(f"{prefix}{rng.randrange(most)}" for _ in range(n))


# ---- tokens


@pytest.fixture(scope="module")
def codec():
    return tokenizing.Codec(public_tokenizers.path(tokenizing.VOCABULARY))


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(tokenizing.VOCABULARY), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_chunks_encode_as_the_library(codec, library):
    rng = random.Random(1)
    parts = ["a", "é", "'s", "'re", "'", " ", "   ", "\n", "\t", "12", "ß", "漢", "!", "　", "\x1c", "\x85", "😀", " the", "<|endoftext|>", chr(0x3D027)]
    for _ in range(800):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(120)))
        ids = codec.encode(text, rng.choice([3, 7, 16, 40]), rng.choice([1, 4, 8, 20]))
        assert ids == library.encode_ordinary(text) and codec.decode(ids) == text.encode()


def test_long_pieces_merge_alike(codec):
    rng = random.Random(2)
    for raw in ["ab" * 700, "x" * 900, "".join(rng.choice("abcdefgh") for _ in range(1500)), "é漢" * 300]:
        assert codec.merge_long(raw.encode()) == codec.merge(raw.encode())
    assert codec.decode(codec.encode("z" * 300_000, 65_536, 2_048)) == b"z" * 300_000


def test_encode_documents(spark, codec, library):
    rng = random.Random(3)
    rows = [(1, words(rng, 5000), None), (2, None, None), (3, "", None), (None, "a b", "x"), (3, "", None), (4, "q" * 3000 + " tail " * 900, "x")]
    got = tokenizing.encode_documents(frame(spark, rows), chunk=700, overlap=60, keep_ids=False).collect()
    want = Counter()
    for d, t, _ in rows:
        ids = library.encode_ordinary(t or "")
        want[(d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert Counter(map(tuple, got)) == want
    kept = tokenizing.encode_documents(frame(spark, rows), chunk=700, overlap=60, keep_ids=True)
    back = tokenizing.decode_documents(kept).collect()
    assert Counter(bytes(r["decoded"]) for r in back) == Counter((t or "").encode() for _, t, _ in rows)
    assert tokenizing.encode_documents(frame(spark, [])).count() == 0


# ---- secrets


def test_base_patterns():
    text = "Token: abcdef api_key='xyz12' AKIA" + "Z" * 16 + " AKIA" + "Z" * 15 + " " + "0f" * 12 + " " + "0f" * 11 + "e passwd=\"q\" ſecret=abcdefgh"
    found = [(k, text[a:b]) for k, a, b, _ in secrets.all_spans(text)]
    assert found == [("assign", "Token: abcdef"), ("access", "AKIA" + "Z" * 16), ("hex", "0f" * 12)]


def test_short_group_uses_up_its_match():
    assert secrets.base_spans("token=a:token=abcdefg") == [("assign", 8, 21)]
    assert secrets.base_spans("token=token=abcdefgh")[0][:3] == ("assign", 0, 20)


def test_novelty_reports_random_strings_only():
    rng = random.Random(5)
    key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(32))
    text = f"the credential for this host is {key} and the backup path is /usr/lib/x"
    assert [(k, text[a:b]) for k, a, b, _ in secrets.all_spans(text)] == [("novel", key)]
    assert not secrets.all_spans(f"the checksum of the host is {key}")
    assert not secrets.all_spans("the credential is xyzxyzxyzxyzxyzxyzxyz123123123123123")
    assert secrets.novelty(text, text.index(key), text.index(key) + 32) > 0.8


@pytest.mark.parametrize("name", ["aws_secret_access_key", "SECRET_KEY", "private_key", "credential", "secret_" + "of_a_long_name_" * 5])
def test_values_joined_to_a_sensitive_name(name):
    rng = random.Random(6)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    few = "".join(rng.choice(alphabet) for _ in range(18))
    many = "".join(rng.choice(alphabet + "0123456789+/") for _ in range(38))
    for value in (many, many + "==", few[:9] + "7" + few[9:], few):
        for text in (f"{name}={value}", f"set x=1 {name}={value} then go", f"a={name}={value}\n"):
            assert [(k, text[a:b]) for k, a, b, _ in secrets.all_spans(text)] == [("novel", value)]
            assert secrets.redact(text) == text.replace(value, "[secret]")


def test_novel_strings_with_few_digits():
    for key in ("qXvJtRzLmWbKpDhYcG4s", "qXvJtRzLmWbKpD2hYcG4s"):
        assert [k for k, *_ in secrets.all_spans(f"the credential is {key} today")] == ["novel"]
    assert not secrets.all_spans("the credential is characteristically short")
    text = "credentials: user=q7Xv2JtR9zLm4 x"  # no part is long, the whole is
    assert [text[a:b] for _, a, b, _ in secrets.all_spans(text)] == ["user=q7Xv2JtR9zLm4"]


BENIGN = ["release-2024-01-15-candidate", "2024-11-26T10-22-33Z", "ssh-ed25519-cert-v01", "sha256_of_file_version_1234567", "migration_0042_add_index_users", "docs/section12/figure34_final", "internationalization", "getUserAuthenticationHandler", "com/example/service/Handler", "CONFIGURATION_DIRECTORY_PATH", "REPLACE_WITH_YOUR_KEY", "Geschwindigkeitsbegrenzung"]
PLACES = ["the credential is {}", "{} is the private key", "the credential of that host, which nobody has changed since the move to the new hall, is {}", "private key: {}"]


@pytest.mark.parametrize("place", PLACES)
def test_planted_keys_and_benign_strings(place):
    rng = random.Random(7)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    found = total = 0
    for s in BENIGN:
        assert not secrets.all_spans(place.format(s) + " and so on"), s
    for alphabet in (letters, letters + "0123456789", letters + "0123456789+/"):
        for n in (16, 24, 40):
            for _ in range(6):
                s, total = "".join(rng.choice(alphabet) for _ in range(n)), total + 1
                text = place.format(s) + " and so on"
                found += [text[a:b] for _, a, b, _ in secrets.all_spans(text)] == [s]
    assert found >= 0.95 * total
    assert secrets.all_spans(place.format("ZxQwErTyUiOpAsDfGhJkLzXcVbNm"))


def plain_spans(text):
    """The base patterns tried at each place from the left, written out."""
    out = []
    for kind, pattern, group, least in (("assign", r"(?ai:(?:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 6), ("access", "(AKIA[A-Z0-9]+)", 1, 20), ("hex", "([0-9a-f]+)", 1, 24)):
        at = 0
        while at < len(text):
            m = re.compile(pattern).match(text, at)
            if m and len(m[group]) >= least:
                out.append((kind, at, m.end()))
            at = m.end() if m else at + 1
    return sorted(out)


@given(st.lists(st.sampled_from(["password", "Passwd", "SECRET", "token", "apikey", "api_key", "=", ":", " ", '"', "'", "AKIA", "Z9" * 8, "0f" * 12, "abc", "é", "ſ", "x.y", "\n"]), max_size=24))
@settings(max_examples=300, deadline=None)
def test_base_spans_equal_plain_patterns(parts):
    text = "".join(parts)
    assert sorted(secrets.base_spans(text)) == plain_spans(text)


def test_scan_and_redact_documents(spark):
    key = "ab12" * 10
    rows = [(1, f"é token = '{key}' x", "en"), (2, None, None), (3, "", "en"), (1, f"é token = '{key}' x", "en"), (None, "plain", None), (9, "password=hunter22 " + "z " * 50_000, "en")]
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in secrets.scan_documents(frame(spark, rows)).collect()}
    assert got[1] == [("assign", 2, 2 + len(f"token = '{key}")), ("hex", 11, 51)] and got[2] == got[3] == got[None] == []
    out = secrets.redact_documents(frame(spark, rows))
    assert out.schema == frame(spark, rows).schema
    texts = {r["doc_id"]: r for r in out.collect()}
    assert texts[1]["text"] == "é [secret]' x" and texts[1]["n_chars"] == 13 and texts[2]["text"] is None and texts[None]["text"] == "plain"
    assert texts[9]["text"].startswith("[secret] z") and secrets.scan_documents(frame(spark, [])).count() == 0


# ---- near duplicates


def brute_components(rows):
    sets = []
    for d, t, _ in rows:
        w = t.encode().lower().split() if t else []
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = root(i), root(j)
                group[max(x, y)] = min(x, y)
    least = defaultdict(list)
    for i, (d, _, _) in enumerate(rows):
        least[root(i)].append(d)
    ids = lambda x: min((d for d in least[x] if d is not None), default=None)
    return Counter((d, len(sets[i]), d if not sets[i] else ids(root(i))) for i, (d, _, _) in enumerate(rows))


def near_rows(seed):
    rng = random.Random(seed)
    rows = [(0, None, None), (1, "", None), (2, " \n", None), (3, "one two", None), (4, "ONE\ttwo", None), (5, "one two three", None), (None, "one two", None), (None, "lonely words here", None), (3, "one two", None), (6, "É one two three four five six", None), (7, "é one two three four five six", None)]
    common = words(rng, 30)
    for n in range(12):
        base = words(rng, rng.randrange(5, 120)).split()
        rows.append((100 + 10 * n, " ".join(base), None))
        for k in range(1, 9):  # chains of changed copies, some beyond the limit
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4, 8])):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            rows.append((100 + 10 * n + k, common * (n % 2) + " " + " ".join(w), None))
            base = w if rng.random() < 0.5 else base
    rng.shuffle(rows)
    return rows


def crowd(seed, n=150):
    """A large group of near copies, many of which are like few others, and texts that hold the same passage."""
    rng = random.Random(seed)
    base, passage = words(rng, 80).split(), words(rng, 60)
    rows = [(1000 + i, f"{passage} {words(rng, rng.randrange(10, 40), 'p')}", None) for i in range(30)]
    for i in range(n):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 4])):
            at = rng.randrange(len(w) - 2)
            w[at : at + 2] = [f"x{rng.randrange(40)}"] * rng.choice([1, 2, 3])
        rows.append((i, " ".join(w), None))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_components_equal_brute_force(spark, seed, monkeypatch):
    rows = crowd(seed) if seed > 2 else near_rows(seed)
    changes = {2: {"REPORTED": 1, "FREQUENT": 50, "COUNTED": 200, "TOGETHER": 2}, 4: {"SHORT": 2, "HUBS": 1, "BEST": 1, "LISTED": 5, "PARTNERS": 3, "RANGE_POSTINGS": 100}}
    for name, value in changes.get(seed, {}).items():  # frequent shingles, salting, many small batches and rounds
        monkeypatch.setattr(neardup, name, value)
    got = neardup.near_duplicates(frame(spark, rows)).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows)


def test_one_of_a_component_stays(spark):
    rows = near_rows(3)
    kept = neardup.keep_one(frame(spark, rows))
    assert kept.schema.names == frame(spark, rows).schema.names
    components = defaultdict(set)
    for (d, n, c), _ in brute_components(rows).items():
        if n and c is not None:
            components[c].add(d)
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert all(ids[c] == 1 and not any(ids[d] for d in members if d not in (c, None)) for c, members in components.items())
    assert all(ids[d] == 1 for d in (0, 1, 2)) and ids[None] == 1
    assert neardup.near_duplicates(frame(spark, [])).count() == 0 and neardup.keep_one(frame(spark, [])).count() == 0


# ---- language


@pytest.fixture(scope="module")
def pieces():
    return language.pieces_of(public_tokenizers.path(language.VOCABULARY))


def test_forward_sums_all_segmentations(pieces):
    rng = np.random.default_rng(1)
    p = rng.random((pieces.size, 2)) / pieces.size

    def every(word):
        if not word:
            return np.ones(2)
        return sum((p[pieces.number[word[:k]]] * every(word[k:]) for k in range(1, min(len(word), pieces.longest) + 1) if word[:k] in pieces.number), np.zeros(2))

    some = [b" the", " été".encode(), b" a", b" thing", " straße".encode()]
    assert np.allclose(language.log_words(pieces, some, p), [np.log(every(w)) for w in some])
    long = b" " + b"abcde" * 9
    short = language.ARRAY_BYTES
    try:
        language.ARRAY_BYTES = 100
        whole = language.log_words(pieces, [long], p)
    finally:
        language.ARRAY_BYTES = short
    assert np.allclose(language.log_words(pieces, [long], p), whole)


def test_expected_counts_cover_each_word(pieces):
    some = [b" the", b" thing", b" " + b"xyz" * 30]
    uses = language.expected_counts(pieces, some, np.array([[1.0], [2.0], [1.0]]), np.full(pieces.size, 1 / pieces.size))
    size = np.array([len(x) for x in sorted(pieces.number)])
    assert np.isclose((uses[:, 0] * size).sum(), 4 + 2 * 6 + 91)


def test_long_pieces_and_words_are_counted_whole(pieces):
    p = np.full(pieces.size, 1 / pieces.size)
    number = pieces.number[b" relationship"]
    assert language.expected_counts(pieces, [b" relationship"], np.ones((1, 1)), p)[number, 0] > 0.9
    long = [b" " + b"relationships" * 5, " отношения".encode() * 1 + "отношения".encode() * 4]
    counts = np.array([[1.0, 2.0], [3.0, 0.0]])
    got, sums = language.expected_counts(pieces, long, counts, p), language.log_words(pieces, long, p[:, None])
    short = language.ARRAY_BYTES
    try:
        language.ARRAY_BYTES = 200
        assert np.allclose(got, language.expected_counts(pieces, long, counts, p))
        assert np.allclose(sums, language.log_words(pieces, long, p[:, None]))
    finally:
        language.ARRAY_BYTES = short


def test_identify(spark):
    rng = random.Random(7)
    bags = {"en": "the of and thing water under house".split(), "de": "der und nicht straße wasser haus über".split()}
    rows = [(i, " ".join(rng.choice(bags[x]) for _ in range(rng.randrange(3, 20))), x) for i in range(120) for x in [rng.choice(["en", "de"])]]
    odd = [(1000, None, "en"), (1001, "", "de"), (1002, "12 ½ !?", None), (None, "the water", "de"), (1003, "Ünder" * 3000, None), (5, *rows[5][1:])]
    got = language.identify(frame(spark, rows + odd)).collect()
    assert len(got) == 126 and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got}
    assert np.mean([by[i]["lang_pred"] == x for i, _, x in rows]) > 0.97
    import zlib

    assert all(by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in rows)
    assert all((by[i]["lang_pred"], by[i]["score"]) == ("und", 0.0) for i in (1000, 1001, 1002)) and by[None]["lang_pred"] == "en"
    assert language.identify(frame(spark, [])).count() == 0
    assert {r["lang_pred"] for r in language.identify(frame(spark, [(0, "the", None)])).collect()} == {"und"}


def test_rare_languages_are_learnt(spark):
    ids = spark.range(31_000).filter(~language.held_out(F.col("id"))).orderBy(F.xxhash64("id").desc()).limit(3)
    rare = [r["id"] for r in ids.collect()]
    docs = spark.range(31_000).select(F.col("id").alias("doc_id"), F.when(F.col("id").isin(rare), "vesi talo puu").otherwise("the water").alias("text"), F.when(F.col("id").isin(rare), "fi").otherwise("en").alias("lang"))
    assert {r["lang_pred"] for r in language.identify(docs).filter(F.col("doc_id").isin(rare)).collect()} == {"fi"}


# ---- quality


def test_resampling_keeps_the_like_of_the_target(spark):
    rng = random.Random(8)
    good = [(i, " ".join(rng.choice("aa bb cc dd ee ff".split()) for _ in range(40)) + ".", "en") for i in range(150)]
    bad = [(1000 + i, " ".join(rng.choice("AA!! BB!! CC!!".split()) for _ in range(40)), "en") for i in range(40)]
    odd = [(5000, None, None), (5001, "", None), (None, "aa bb cc", "en"), (3, *good[3][1:])]
    labels = spark.createDataFrame([(i, 1) for i in range(60)] + [(1000 + i, 0) for i in range(20)] + [(None, 1), (7, None), (3, 1)], "doc_id bigint, quality int")
    got = quality.resample(frame(spark, good + bad + odd), labels)
    ids = Counter(r["doc_id"] for r in got.collect())
    assert sum(ids[i] > 0 for i in range(150)) >= 148 and ids[3] == 2 and not any(ids[1000 + i] for i in range(40)) and not ids[5000] and not ids[5001]
    assert sorted(map(str, got.collect())) == sorted(map(str, quality.resample(frame(spark, good + bad + odd).repartition(3), labels).collect()))
    assert quality.resample(frame(spark, good), labels, k=10).count() == 10
    assert quality.resample(frame(spark, []), labels).count() == 0
    assert quality.resample(frame(spark, good[:5] + odd[:2]), labels.limit(0)).count() == 5


def test_resampling_equals_brute_force(spark):
    import pyarrow as pa

    rng = random.Random(21)
    rows = [(i, " ".join(rng.choice(["aa", "bb", "Cc", "d1"] if i % 3 else ["XX!", "aa", "9"]) for _ in range(rng.randrange(1, 60))), "en") for i in range(240)]
    rows += [(500, None, None), (501, "", None), (None, "aa bb", "en"), rows[7], (600, "aa bb Cc " * 30_000, "en")]
    good = {i for i in range(0, 240, 2) if i % 3}
    labels = spark.createDataFrame([(i, int(i in good)) for i in range(100)], "doc_id bigint, quality int")
    buckets = [quality.features(pa.array([t], pa.string()))[0].tolist() for _, t, _ in rows]
    raw, target = Counter(), Counter()
    for (i, _, _), f in zip(rows, buckets):
        raw.update(f)
        if i is not None and i < 100 and i in good:
            target.update(f)
    mass = sum(target.values()) / sum(raw.values())
    ratio = {b: np.log((target[b] + quality.PSEUDO) / (n * mass + quality.PSEUDO)) for b, n in raw.items()}
    noise = {r[0]: r[1] for r in spark.createDataFrame([(i,) for i, _, _ in rows], "i bigint").select("i", quality.gumbel(F.col("i"), 3)).collect()}
    scored = [(sum(ratio[b] for b in f), i) for (i, _, _), f in zip(rows, buckets) if f]
    keys = sorted((w + noise[i] for w, i in scored), reverse=True)
    last = keys[sum(w >= -quality.SLACK for w, _ in scored) - 1]
    want = sorted(((i, w) for w, i in scored if w + noise[i] >= last - 1e-9), key=str)
    clash = frame(spark, rows).withColumns({"w": F.lit("x"), "key": F.lit(1), "log_importance": F.lit(2), "Gumbel_Key": F.lit(3)})
    got = quality.resample(clash, labels)
    assert got.columns == [*clash.columns, "log_importance_", "gumbel_key_"]
    found = sorted(((r["doc_id"], r["log_importance_"]) for r in got.collect()), key=str)
    assert Counter(i for i, _ in found) == Counter(i for i, _ in want) and 0 < len(want) < len(scored)
    close = dict(want)
    assert all(w == pytest.approx(close[i], abs=1e-6) for i, w in found)


def test_gumbel_noise_is_standard(spark):
    x = np.array([r[0] for r in spark.range(20_000).select(quality.gumbel(F.col("id"), 3)).collect()])
    assert abs(x.mean() - 0.5772) < 0.05 and abs(x.std() - 1.2825) < 0.05


def test_features():
    import pyarrow as pa

    texts = ["The cat", "A!! A!!", None, "", "the the", "The dog ", " é\tx9"]
    found = quality.features(pa.array(texts))
    assert [len(f) for f in found] == [5, 5, 0, 0, 5, 5, 5]
    one = [quality.features(pa.array([t], pa.string()))[0].tolist() for t in texts]
    assert [f.tolist() for f in found] == one  # neighbours don't matter
    shape = lambda t: quality.features(pa.array([t]))[0][1]  # noqa: E731  of a single word
    assert shape("The") == shape("Dogs") == shape("Élan".replace("É", "E")) and shape("cat") == shape("été") != shape("CAT") == shape("NDOU")
    assert shape("on%%%") == shape("ab%") != shape("ab$") and shape("a1") == shape("zz77") != shape("a")
    assert found[4][3] != found[0][3]  # a repeated word has its own shape


# ---- pipeline


def test_stages_keep_the_columns(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "secrets", "mixing", "encoding"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        assert 0 < out.count() <= 3 * docs.count()
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_pipeline_of_odd_rows(spark, tmp_path, library):
    """run() against its stages one by one: nulls, empty and long texts, repeated rows, clashing columns; then an empty table."""
    rng = random.Random(31)
    rows = [(i, words(rng, 60, most=30), "en") for i in range(60)]
    key = "password = hunter2hunter2"
    rows += [(100 + i, rows[5][1], "en") for i in range(20)] + [rows[6], rows[6], (200, rows[7][1] + " " + key, None), (201, words(rng, 40_000, most=30), "en")]
    rows += [(300, None, None), (301, "", "en"), (302, " \t", "en"), (None, words(rng, 50, most=30), None), (None, None, None), (303, "one two", "de")]
    docs = frame(spark, rows).withColumn("source", F.when(F.col("doc_id") % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit("s"), F.col("doc_id") % 3)))
    docs = docs.withColumns({"_text_key": F.lit(1), "copies": F.lit("c"), "size": F.lit(0.5), "head": F.lit(True), "uid": F.lit(4)})
    docs.write.parquet(f"{tmp_path}/odd/documents.parquet")
    labels = spark.createDataFrame([(i, 1, 0) for i in [*range(0, 60, 2), 201]] + [(None, 1, None), (3, None, 1)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/odd/labels.parquet")
    sf_dir, now, kept = f"{tmp_path}/odd", spark.read.parquet(f"{tmp_path}/odd/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, sf_dir)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = [(r["doc_id"], r["text"], r["source"]) for r in now.collect()]
    ids = {name: Counter(i for i, _, _ in found) for name, found in kept.items()}
    assert ids["quality"][6] == 3 and ids["quality"][201] == 1 and sum(ids["quality"][100 + i] for i in range(20)) == 20
    assert not any(ids["quality"][i] for i in (300, 301, 302)) and ids["quality"][None] == 1  # without words
    assert ids["near_duplicates"] == Counter({i: 1 for i in [*range(60), 201, 303, None] if ids["quality"][i]})
    assert [t for _, t, _ in sorted(kept["secrets"], key=str)] == [secrets.redact(t) for _, t, _ in sorted(kept["near_duplicates"], key=str)]
    assert set(kept["mixing"]) <= set(kept["secrets"]) and max(ids["mixing"].values()) <= 3
    texts = Counter((i, len(library.encode_ordinary(t or ""))) for i, t, _ in kept["mixing"])
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == texts
    for name, table in (("documents", docs), ("labels", labels)):
        table.limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
