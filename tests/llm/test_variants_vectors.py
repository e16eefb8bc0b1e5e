"""Spelling variants, hard negatives and near copies of vectors against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrascout.llm import embed_dedup, hard_negatives, spelling, topk

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ------------------------------------------------------------------ spelling

def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(rows, least_length, least_count, typos, ratio=5):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % typos == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= least_length and n >= least_count}
    near = {w: [v for v in words if v != w and one_edit(v, w)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= ratio * words[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w, ""), root(w), n, len(near[w]), words[form[w]] if w in form else -1) for w, n in words.items())


def spelled(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.collect())


@pytest.mark.parametrize("groups,part_rows", [(3, 4), (5, 2048)])
def test_variants(spark, groups, part_rows):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randint(3, 8))) for _ in range(150)] + ["colour", "color", "Ünder", "Straße", "abcabc"]
    rows = []
    for i in range(300):
        text = " ".join(rng.choice(words[:20] if rng.random() < 0.7 else words) for _ in range(rng.randint(0, 60)))
        rows.append((i, text.upper() if i % 9 == 0 else text))
    rows += [(7, rows[7][1]), (900, None), (901, ""), (902, "×÷ 漢字 x-y_z 12"), (None, rows[3][1]), (903, "a" * 30_000), (904, "colour " * 20_000)]
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], "doc_id long, text string, word string, n string").repartition(3)
    got = spelled(spelling.variants(docs, typos=7, least_length=4, least_count=3, groups=groups, part_rows=part_rows))
    assert got == brute_variants(rows, 4, 3, 7)
    assert any(f for _, f, *_ in got) and any(f and r != f for _, f, r, *_ in got)


def test_variants_of_nothing(no_docs):
    assert spelling.variants(no_docs).count() == 0


def test_one_edit_on_random_words():
    rng = random.Random(2)
    words = ["".join(rng.choice("ab") for _ in range(n)) for n in (4, 5) for _ in range(40)]
    block = spelling.Words(words, np.ones(len(words)), 5)
    pairs = [(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if 0 <= len(b) - len(a) <= 1]
    i, j = map(np.array, zip(*pairs))
    got = spelling.one_edit(block.codes[i], block.codes[j])
    assert got.tolist() == [one_edit(words[a], words[b]) for a, b in pairs]


# ------------------------------------------------------------ hard negatives

def brute_negatives(rows, anchors, scale=256):
    fine = [(i, l, [math.floor(scale * float(x)) for x in v]) for i, l, v in rows
            if None not in (i, l, v) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a in sorted({i for i, _, _ in fine if i % anchors == 0}):
        _, label, own = min(r for r in fine if r[0] == a)
        scored = sorted((-sum(x * y for x, y in zip(own, v)), i, l) for i, l, v in fine if i != a and len(v) == len(own))
        for p, positive, _ in [x for x in scored if x[2] == label][:5]:
            window = [x for x in scored if x[2] != label and -50 * p <= -100 * x[0] <= -95 * p][:3]
            out += [(a, positive, n + 1, i, -p, -s) for n, (s, i, _) in enumerate(window)]
    return sorted(out)


@pytest.mark.parametrize("tile_rows,block,spread", [(7, 3, 1.0), (4096, 4096, 0.1), (50, 20, 1e6)])
def test_hard_negatives(spark, tile_rows, block, spread):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(4, 6))
    rows = []
    for i in range(240):
        v = base[0] if i % 3 == 0 and i % 2 else base[i % 4] + rng.normal(size=6) * 0.4  # a third is one vector
        rows.append((i, f"l{i % 3}", [float(np.float32(x * spread)) for x in v]))
    rows += [rows[10], rows[11], (500, None, [1.0] * 6), (600, "l1", None), (650, "l1", [None] * 6), (700, "l1", [float("inf")] * 6),
             (None, "l1", [1.0] * 6), (750, "l1", [1.0, 2.0]), (800, "l1", []), (850, "l2", [0.0] * 6), (851, "l2", [0.0] * 6), (852, "l0", [0.0] * 6)]
    vectors = spark.createDataFrame([(i, l, v, "clash", 1) for i, l, v in rows],
                                    "vec_id long, label string, embedding array<double>, id string, v int").repartition(3)
    got = sorted(tuple(r) for r in hard_negatives.mine(vectors, F.pmod("id", F.lit(10)) == 0, tile_rows=tile_rows, anchors_per_block=block).collect())
    assert got == brute_negatives(rows, 10)
    assert len(got) > 20


def test_bounds_save_products():
    """Close anchors: a child's bounds leave few candidates to score again."""
    rng = np.random.default_rng(1)
    anchors = np.round(rng.normal(size=6) * 1000 + rng.normal(size=(40, 6))).astype(np.int64)
    far = np.round(rng.normal(size=(3000, 6)) * 1000).astype(np.int64)
    least = np.full((40, 1), np.iinfo(np.int64).min)
    best = hard_negatives.Best(least, np.full((40, 1), np.iinfo(np.int64).max), 3)
    done = []
    kept = hard_negatives.exact_products

    def counted(q, c):
        done.append(len(q) * len(c))
        return kept(q, c)

    hard_negatives.exact_products = counted
    try:
        hard_negatives.search(np.arange(40), np.array(["a"] * 40, object), anchors, best,
                              [(np.arange(100, 3100), np.array(["a"] * 3000, object), far)], True)
    finally:
        hard_negatives.exact_products = kept
    assert sum(done) < 40 * 3000 / 3
    for a in range(40):
        score = far @ anchors[a]
        want = sorted(zip((-score).tolist(), range(100, 3100)))[:3]
        mine = best.rows[:, best.rows[0] == a]
        assert [(-s, i) for s, i in zip(mine[2].tolist(), mine[3].tolist())] == want


def test_numbers_beyond_64_bits_are_errors(spark):
    def vectors(x):
        return spark.createDataFrame([(0, 0, [x, 1.0]), (20, 0, [x, 1.0]), (50, 1, [x, 1.0])], "vec_id long, label int, embedding array<double>")

    for run in (lambda v: topk.top_k(v, F.pmod("id", F.lit(20)) == 0, 3), lambda v: hard_negatives.mine(v, F.pmod("id", F.lit(50)) == 0)):
        for x in (1e18, 1e300, 1e12):
            with pytest.raises(Exception, match="beyond 64 bits"):
                run(vectors(x)).collect()
        run(vectors(1e6)).collect()


def test_hard_negatives_of_nothing(spark):
    vectors = spark.createDataFrame([(0, 1, [1.0, 2.0])], "vec_id long, label int, embedding array<float>")
    assert hard_negatives.mine(vectors, F.col("id") == 0).count() == 0
    assert hard_negatives.mine(vectors.limit(0), F.col("id") == 0).count() == 0


# --------------------------------------------------------------- near copies

def brute_copies(rows, threshold):
    def cosine(a, b):
        x, y = np.array(a, float), np.array(b, float)
        x, y = x / np.abs(x).max(), y / np.abs(y).max()
        return float(x @ y / (np.linalg.norm(x) * np.linalg.norm(y)))

    def good(r):
        return r[1] is not None and r[2] and all(x is not None and math.isfinite(x) for x in r[2]) and any(r[2])

    linked = defaultdict(set)
    for x, a in enumerate(rows):
        for y, b in enumerate(rows):
            if x != y and good(a) and good(b) and a[1] == b[1] and len(a[2]) == len(b[2]) and cosine(a[2], b[2]) >= threshold:
                linked[x].add(y)
    out, seen = [], {}
    for x in range(len(rows)):
        if x not in seen:
            group, todo = {x}, [x]
            while todo:
                todo += [y for y in linked[todo.pop()] if y not in group and not group.add(y)]
            low = min((rows[y][0] for y in group if rows[y][0] is not None), default=None)
            seen |= dict.fromkeys(group, low)
        i, c = rows[x][0], seen[x]
        out.append((i if i is not None else -1, len(linked[x]), -1 if c is None else c, None if i is None or c is None else i == c))
    return sorted(out, key=repr)


@pytest.mark.parametrize("tile_rows", [5, 40, 4096])
def test_near_copies(spark, tile_rows):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(5, 12))
    rows = []
    for i in range(260):
        v = base[0] + rng.normal(size=12) * 0.002 if i % 3 == 0 else base[i % 5] + rng.normal(size=12) * (0.13 if i % 2 else 0.9)
        rows.append((i * 3 % 263, int(i % 4 == 1), [float(np.float32(x)) for x in v]))
    rows += [(300 + i, 1, rows[4][2]) for i in range(6)] + [(320, 1, [2 * x for x in rows[4][2]]), (321, 1, [1e300 * x for x in rows[4][2]])]
    rows += [rows[8], (None, 1, rows[4][2]), (None, 0, [float(x) for x in rng.normal(size=12)]), (400, None, rows[4][2]), (401, 1, None), (402, 1, [0.0] * 12),
             (403, 1, [float("nan")] * 12), (404, 1, [None] * 12), (405, 1, []), (406, 0, [1.0, 0.0]), (407, 0, [0.98, math.sqrt(1 - 0.98 ** 2) - 1e-9]),
             (408, 0, [0.0, -0.0])]
    vectors = spark.createDataFrame([(i, l, v, "clash", "clash") for i, l, v in rows],
                                    "vec_id long, label int, embedding array<double>, key string, n string").repartition(3)
    got = embed_dedup.near_copies(vectors, tile_rows=tile_rows).collect()
    assert sorted(((-1 if r.vec_id is None else r.vec_id, r.n_links, -1 if r.component_id is None else r.component_id, r.kept) for r in got),
                  key=repr) == brute_copies(rows, 0.98)


def test_near_copies_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert embed_dedup.near_copies(none).count() == 0
    one = spark.createDataFrame([(5, 1, [0.5, 0.5])], none.schema)
    assert [tuple(r) for r in embed_dedup.near_copies(one).collect()] == [(5, 0, 5, True)]


def test_forest():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 400, 300), rng.integers(0, 400, 300)
    forest = embed_dedup.Forest(400)
    for s in range(0, 300, 40):
        forest.join(a[s:s + 40], b[s:s + 40])
    low = np.arange(400)
    for _ in range(400):
        m = np.minimum(low[a], low[b])
        np.minimum.at(low, a, m)
        np.minimum.at(low, b, m)
    assert (low == forest.root).all()
