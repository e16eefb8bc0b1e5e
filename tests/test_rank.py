import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrascout.operators import rank


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(0)
    n = 3000
    s = np.round(rng.uniform(0, 1, n), 2)
    s[:1000] = 0.5  # one score holds a third of all rows
    pdf = pd.DataFrame({"id": np.arange(n), "s": s, "g": np.arange(n) % 3,
                        "l": (rng.uniform(0, 1, n) < s).astype(int)})
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("by", [[], ["g"]])
@pytest.mark.parametrize("desc", [False, True])
def test_cumulate_in_many_pieces(scored, by, desc):
    pdf, df = scored
    got = rank.cumulate(df, "s", "id", {"l": F.col("l")}, by=by, desc=desc, piece_rows=150).toPandas()
    got = got.sort_values(["s", "id"], ascending=[not desc, True])
    groups = got.groupby("g") if by else got.groupby(lambda _: 0)
    assert len(got) == len(pdf)
    assert (groups.cumcount() + 1 == got.rn).all()
    assert (groups["l"].cumsum() == got.cum_l).all()
    assert (groups["l"].transform("sum") == got.tot_l).all()


def test_cumulate_cuts_a_heavy_score_by_id(scored):
    _, df = scored
    # 20 pieces of about 150 rows: none may hold the thousand equal scores with ids in a row.
    pieces = rank._pieces(df.withColumn("_k", F.col("s")), ["_k", "id"], 150)
    sizes = [r["count"] for r in pieces.groupBy("_b").count().collect()]
    assert sum(sizes) == 3000 and max(sizes) < 450


@pytest.mark.parametrize("desc", [False, True])
@pytest.mark.parametrize("ids", ["long", "string"])
def test_cumulate_is_the_same_in_any_number_of_pieces(spark, ids, desc):
    base = 1 << 60  # neighbouring ids that doubles can't tell apart
    rows = [(base + i, None if i % 7 == 0 else float("nan") if i % 11 == 0 else float(i % 5), i % 3) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, s double, v long").withColumn("id", F.col("id").cast(ids))
    runs = [sorted((r.rn, r.id, r.n, r.cum_v) for r in rank.cumulate(df, "s", "id", {"v": F.col("v")}, desc=desc, piece_rows=p).collect())
            for p in (1_000, 100, 1)]
    assert len(runs[0]) == 400 and runs[0] == runs[1] == runs[2]
    assert [r[0] for r in runs[0]] == list(range(1, 401))


@pytest.mark.parametrize("piece_rows", [10_000, 60, 1])
def test_strict_percentiles_in_pieces(spark, piece_rows):
    values = [None if i % 9 == 0 else float("nan") if i == 5 else 0.5 if i % 2 else i / 200 for i in range(200)]
    df = spark.createDataFrame(list(enumerate(values)), "id long, s double")
    got = {r.id: r.pct for r in rank.pct_strict(df, "s", piece_rows=piece_rows).collect()}
    known = [v for v in values if v is not None]
    order = lambda v: (v != v, v if v == v else 0.0)  # noqa: E731  NaN is the largest
    for i, v in enumerate(values):
        want = None if v is None else 100 * sum(order(w) < order(v) for w in known) / len(known)
        assert got[i] == want or np.isclose(got[i], want)


def test_quantiles(scored):
    pdf, df = scored
    got = rank.quantiles(df, "s", [0.1, 0.5, 0.9], by=["g"]).toPandas().set_index("g").sort_index()
    want = pdf.groupby("g").s.quantile([0.1, 0.5, 0.9]).unstack()
    assert np.allclose(got.values, want.values)


def pairwise_auroc(s, l):
    pos, neg = s[l == 1], s[l == 0]
    return ((pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean())


def test_metrics_against_direct_formulas(scored):
    pdf, df = scored
    s, l = pdf.s.values, pdf.l.values
    row = rank.metric_bundle(df, "s", "l", "id").first()
    assert np.isclose(row.auroc, pairwise_auroc(s, l))
    marks = np.unique(s)[::-1]
    tp = np.array([l[s >= t].sum() for t in marks])
    called = np.array([(s >= t).sum() for t in marks])
    precision, recall = tp / called, tp / l.sum()
    assert np.isclose(row.auprc, np.sum(np.diff(np.r_[0, recall]) * precision))
    f1 = 2 * precision * recall / (precision + recall + 1e-12)
    assert np.isclose(row.f1, f1.max()) and np.isclose(row.best_threshold, marks[f1.argmax()])
    order = np.lexsort((pdf.id.values, -s))
    assert np.isclose(row.precision_at_k, l[order[:50]].mean())
    assert np.isclose(row.capture_top_5pct, l[order[:150]].sum() / l.sum())
    quick = rank.best_f1_at(df, "s", "l").first()
    assert np.isclose(quick.f1, f1.max())


def test_one_class_has_no_auroc(spark):
    df = spark.createDataFrame([(0, 0.1, 1), (1, 0.2, 1)], "id long, s double, l int")
    assert rank.auroc(df, "s", "l").first().auroc is None


def test_percentiles(scored):
    pdf, df = scored
    strict = rank.pct_strict(df, "s").toPandas().sort_values("id").pct.values
    assert np.allclose(strict, [100 * (pdf.s < v).mean() for v in pdf.s])
    ordinal = rank.pct_ordinal(df, "s", "id").toPandas().sort_values("id").pct.values
    place = np.empty(len(pdf))
    place[np.lexsort((pdf.id, pdf.s))] = np.arange(len(pdf))
    assert np.allclose(ordinal, 100 * place / (len(pdf) - 1))


def test_holm(spark):
    p = [0.01, 0.04, 0.03, 0.005]
    df = spark.createDataFrame(list(enumerate(p)), "id long, p double")
    got = [r.p_holm for r in rank.holm(df, "p", "id").orderBy("id").collect()]
    assert np.allclose(got, [0.03, 0.06, 0.06, 0.02])


def test_top_sizes_do_not_round_past_the_exact_value(spark):
    df = spark.createDataFrame([(30,), (10,), (3,)], "n long")
    sizes = [tuple(r) for r in df.select(rank.top_sizes(0.1), rank.top_sizes(0.1, "floor")).collect()]
    assert sizes == [(3, 3), (1, 1), (1, 1)]


@pytest.mark.parametrize("select_rows", [1, 40, 100_000])
def test_quantiles_by_histograms_are_exact(spark, select_rows, monkeypatch):
    rng = np.random.default_rng(17)
    wild = np.concatenate([rng.normal(size=300), 10.0 ** rng.uniform(-300, 300, 200) * rng.choice([-1, 1], 200), np.full(250, 0.25), [1.7e308, -1.7e308, 5e-324, 0.0]])
    rows = [("a", float(x)) for x in wild] + [(None, float(x)) for x in rng.integers(0, 5, 90)] + [("one", 3.5)] + [("b", None)] * 3
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    names = [f"p{i}" for i in range(len(probs))]
    got = {r.g: list(r)[1:] for r in rank.quantiles(df, "v", probs, by=["g"], names=names, select_rows=select_rows).collect()}
    assert set(got) == {"a", None, "one"}
    for g in got:
        own = sorted(v for k, v in rows if k == g and v is not None)
        for p, x in zip(probs, got[g]):
            at = (len(own) - 1) * p
            low, high = own[math.floor(at)], own[math.ceil(at)]
            assert x == low + (high - low) * (at - math.floor(at))
    alone = rank.quantiles(df.filter("g = 'a'"), "v", [0.5], names=["m"], select_rows=select_rows).first()
    assert alone.m == got["a"][3]
    monkeypatch.setattr(rank, "SELECT_GROUPS", 1)
    ranked = {r.g: list(r)[1:] for r in rank.quantiles(df, "v", probs, by=["g"], names=names).collect()}
    assert ranked == got


def test_quantiles_of_odd_numbers(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([(x,) for x in [nan, inf, -inf, 2.0, 1.0, None, 3.0]], "v double")
    got = rank.quantiles(df, "v", [0.0, 0.2, 0.4, 0.6, 0.8, 1.0], names=list("abcdef")).first()
    assert list(got)[1:5] == [1.0, 2.0, 3.0, inf] and math.isnan(got.f)
    assert rank.quantiles(df.limit(0), "v", [0.5]).count() == 0
    assert rank.quantiles(df.filter("v is null"), "v", [0.5]).count() == 0


def test_metric_bundle_ranks_only_what_it_needs(scored, monkeypatch):
    seen, real = [], rank.cumulate
    monkeypatch.setattr(rank, "cumulate", lambda df, *a, **kw: seen.append(set(df.columns)) or real(df, *a, **kw))
    rank.metric_bundle(scored[1].withColumn("unused", F.lit("x")), "s", "l", "id")
    assert seen and all("unused" not in columns for columns in seen)
