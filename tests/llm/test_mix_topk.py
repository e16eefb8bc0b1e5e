"""Source mixing and exact top-k search."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrascout.llm import balance, topk


def want_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s.encode() if s else b""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed, left = {}, share * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in fixed]
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > cap * sizes[s] + 1e-9] if open_ else []
        if not over:
            return fixed | {s: left * weight[s] / total for s in open_}
        for s in over:
            fixed[s] = cap * sizes[s]
        left = share * sum(sizes.values()) - sum(fixed.values())


@pytest.mark.parametrize("piece_rows", [3, 4096])
def test_mix(docs, rows, piece_rows):
    got = balance.mix(docs, piece_rows=piece_rows).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    sizes = {}
    for r in got:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or ""))
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
    want = want_targets(sizes)
    for s, size in sizes.items():
        own = [r for r in got if r.source == s]
        assert {r.source_size for r in own} == {size}
        assert math.isclose(own[0].target, want[s], rel_tol=1e-9)
        spare = [r.size for r in own if r.copies < math.floor(r.rate) + 1 and r.copies < 2 and r.size]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(1, min(spare, default=0))
    again = sorted((r.doc_id, r.taken) for r in balance.mix(docs.repartition(3), piece_rows=piece_rows).collect())
    assert again == sorted((r.doc_id, r.taken) for r in got)


def test_many_sources_at_their_caps(spark):
    rng = random.Random(8)
    rows = [(k, " ".join(["w"] * rng.randint(1, 40)), f"s{min(rng.randrange(40), 12):02}") for k in range(900)]
    got = balance.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = want_targets(sizes)
    for r in got:
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9)


def test_mix_of_nothing(spark, no_docs):
    assert balance.mix(no_docs).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, "", None), (None, " ", "a")], "doc_id long, text string, source string")
    assert [r.taken for r in balance.mix(blank).collect()] == [0, 0, 0]


def test_newton_solves_the_dual(spark):
    sources = spark.createDataFrame([("a", 1000, 1e-3), ("b", 10, 20.0), ("c", 0, 0.0), ("d", 5, 5.0)], "source string, source_size long, target double")
    for r in balance.newton(sources).collect():
        if r.source_size:
            assert math.isclose(r.source_size * math.exp(r.multiplier), r.target, rel_tol=1e-8)
        else:
            assert r.multiplier is None


def brute_top(rows, k):
    fine = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in fine if i % 20 == 0}):
        a = next(v for i, v in fine if i == q)
        found = sorted(((-sum(x * y for x, y in zip(a, v)), i) for i, v in fine if i != q and len(v) == len(a)))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return out


@pytest.mark.parametrize("cells,scale", [(1, 1.0), (5, 1.0), (3, 1e6)])
def test_top_k(spark, cells, scale):
    rng = np.random.default_rng(6)
    hot = rng.normal(size=8).astype(np.float32) * scale
    rows = [(int(i), [float(x) for x in (hot if i % 3 == 0 else rng.normal(size=8).astype(np.float32) * scale)]) for i in range(260)]
    rows += [(1001, None), (1002, [float("nan")] * 8), (1003, [None] * 8), (1020, [float("inf")] * 8), (None, [1.0] * 8), (1004, [1.0] * 3), (1005, [])]
    vectors = spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], "vec_id long, embedding array<float>, id string, dim int").repartition(3)
    got = sorted(tuple(r) for r in topk.top_k(vectors, F.pmod("id", F.lit(20)) == 0, 20, cells=cells).collect())
    stored = [(r.vec_id, r.embedding) for r in vectors.collect()]
    assert got == brute_top(stored, 20)


def test_top_k_of_few(spark):
    vectors = spark.createDataFrame([(0, [1.0, 2.0]), (3, [0.5, 0.5]), (5, [1.0, 2.0])], "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in topk.top_k(vectors, F.pmod("id", F.lit(20)) == 0, 20).collect())
    assert got == [(0, 1, 5, 64 * 64 * 5), (0, 2, 3, 64 * 32 * 3)]
    assert topk.top_k(vectors.limit(0), F.col("id") == 0, 20).count() == 0
    assert topk.top_k(vectors.filter("vec_id = 0"), F.col("id") == 0, 20).count() == 0
