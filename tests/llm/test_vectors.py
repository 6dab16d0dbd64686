"""Exact and approximate search against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.llm import ann, topk
from keyloom.llm import vectors as tiled

SCHEMA = "vec_id bigint, embedding array<float>, score string, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "s", 0) for i, v in rows], SCHEMA)


def random_rows(n, dim=12, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, dim))
    return [(i, (centres[i % 6] + 0.6 * rng.standard_normal(dim)).astype(np.float32).tolist()) for i in range(n)]


ODD = [(5000, None), (5050, [None] * 12), (5100, [math.nan] * 12), (5150, [math.inf] + [0.0] * 11), (None, [1.0] * 12), (5200, []), (5250, [0.0] * 12), (5300, [1.0] * 3), (5350, [2.0] * 3)]


def brute(rows, every, k, score, zero):
    clean = {(i, *v) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and (zero or np.any(v))}
    clean = [(i, np.array(v, float)) for i, *v in sorted(clean)]
    out = set()
    for q in {i for i, _ in clean if i % every == 0}:
        best = sorted((-score(x, v), i) for own, x in clean if own == q for i, v in clean if i != q and len(v) == len(x))[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


#: Other vectors under ids that ``random_rows`` has as well: queries and candidates.
TWINS = [(i, random_rows(40, seed=9)[j][1]) for j, i in enumerate([0, 50, 50, 3, 60, 60, 61, 399])]


def test_exact_top_k(spark):
    rows = random_rows(400) + [(600 + i, random_rows(1)[0][1]) for i in range(60)] + ODD + [(3, random_rows(400)[3][1])] + TWINS
    score = lambda a, b: int((np.floor(256 * a) * np.floor(256 * b)).sum())
    want = brute(rows, 50, 5, score, True)
    assert {tuple(r) for r in topk.exact_top_k(frame(spark, rows)).collect()} == want
    small = tiled.nearest(frame(spark, rows), F.col("vec_id") % 50 == 0, 5, topk.matcher(5), "bigint", True, rows=64, query_rows=5)
    assert {tuple(r) for r in small.collect()} == want
    assert topk.exact_top_k(frame(spark, [])).count() == 0 and topk.exact_top_k(frame(spark, rows[:1])).count() == 0


def test_small_tiles_and_large_numbers():
    rng = np.random.default_rng(3)
    big = rng.integers(-(2**40), 2**40, (30, 4)).astype(float)
    ids = np.arange(30)
    q, v, s = topk.matcher(3)(ids[:4], big[:4], ids, big)
    whole = [[int(256 * x) for x in row] for row in big]
    clip = lambda x: max(-(2**63), min(2**63 - 1, x))
    want = {(a, b, clip(sum(x * y for x, y in zip(whole[a], whole[b])))) for a in range(4) for b in sorted((j for j in range(30) if j != a), key=lambda j: (-clip(sum(x * y for x, y in zip(whole[a], whole[j]))), j))[:3]}
    assert set(zip(q.tolist(), v.tolist(), s.tolist())) == want


def test_first_k_breaks_ties_by_place():
    score = np.array([[1.0, 3, 3, 3, 2], [-np.inf, -np.inf, 0, -np.inf, -np.inf]])
    assert [x.tolist() for x in tiled.first_k(score, 2)] == [[0, 0, 1], [1, 2, 2]]


def test_recall_of_collision_counting(spark):
    rows = random_rows(3000, 32) + [(4000 + i, random_rows(3000, 32)[40][1]) for i in range(50)] + [(i, v) for i, v in ODD if v is None or len(v) != 12]
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in ann.approximate_top_k(frame(spark, rows)).collect()}
    want = {(q, i): s for q, _, i, s in brute(rows, 20, 20, lambda a, b: float(np.einsum("i,i->", a, b)), False)}
    assert len(got.keys() & want.keys()) / len(want) >= 0.9
    assert len(got) == len(want) and all(abs(got[k] - want[k]) < 1e-9 for k in got.keys() & want.keys())
    ranks = {}
    for r in ann.approximate_top_k(frame(spark, rows)).collect():
        ranks.setdefault(r["query_id"], []).append((r["rank"], -r["score"], r["vec_id"]))
    for x in ranks.values():
        assert [(s, i) for _, s, i in sorted(x)] == sorted((s, i) for _, s, i in x) and sorted(r for r, _, _ in x) == list(range(1, len(x) + 1))


def test_ann_of_little(spark):
    assert ann.approximate_top_k(frame(spark, [])).count() == 0
    assert ann.approximate_top_k(frame(spark, ODD[:7])).count() == 0
    two = ann.approximate_top_k(frame(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (0, [1.0, 0.0])])).collect()
    assert [tuple(r) for r in two] == [(0, 1, 1, 0.5)]


@pytest.mark.parametrize("bad", [[], [None, 1.0], [-math.inf, 0.0], [math.nan, 0.0], None])
def test_invalid_rows_hide_no_vector_of_their_id(spark, bad):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (0, bad), (1, bad)]
    assert [tuple(r) for r in ann.approximate_top_k(frame(spark, rows)).collect()] == [(0, 1, 1, 0.5)]
    assert [tuple(r) for r in topk.exact_top_k(frame(spark, rows)).collect()] == [(0, 1, 1, 256 * 128)]


def test_zero_rows_hide_no_vector_of_their_id(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.0, 0.0])]  # zero is one more vector of id 1, and takes part in exact search alone
    assert [tuple(r) for r in ann.approximate_top_k(frame(spark, rows)).collect()] == [(0, 1, 1, 0.5)]
    assert [tuple(r) for r in topk.exact_top_k(frame(spark, rows)).collect()] == [(0, 1, 1, 256 * 128), (0, 2, 1, 0)]


def test_every_vector_of_an_id_is_a_candidate(spark):
    rows = [(0, [1.0, 0.0]), (2, [0.9, 0.1]), (2, [None, 0.1]), (3, [0.8, 0.2]), (3, [-math.inf, 0.0]), (4, [0.2, 0.1]), (4, [0.7, 0.7]), (4, [0.7, 0.7])]
    near = sorted(tuple(r) for r in ann.approximate_top_k(frame(spark, rows)).collect())
    assert [(q, r, v) for q, r, v, _ in near] == [(0, 1, 2), (0, 2, 3), (0, 3, 4), (0, 4, 4)]
    got = {tuple(r) for r in topk.exact_top_k(frame(spark, rows)).collect()}
    assert {(q, r, v) for q, r, v, _ in got} == {(0, 1, 2), (0, 2, 3), (0, 3, 4), (0, 4, 4)}
    some = random_rows(500) + TWINS
    want = brute(some, 20, 20, lambda a, b: float(np.einsum("i,i->", a, b)), False)
    found = [tuple(r) for r in ann.approximate_top_k(frame(spark, some)).collect()]
    assert len(found) == len(want) and all(q != v for q, _, v, _ in found)
    near = lambda rows: {(q, v, round(s, 9)) for q, _, v, s in rows}
    assert len(near(found) & near(want)) >= 0.9 * len(near(want))


@pytest.mark.parametrize("sure", [0.8, 0.97])
def test_reach_is_monotone(sure):
    assert ann.reach(96, 66, sure) < ann.reach(96, 66, sure + 0.02)
