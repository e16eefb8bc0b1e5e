"""The chain against enumeration; held-out accuracy on planted words."""

import random
from itertools import product

import numpy as np
from pyspark.sql import functions as F

from terrascout.llm import toxicity as tox


def test_marginals_against_enumeration():
    rng = np.random.default_rng(0)
    lengths = np.array([0, 3, 1, 5])
    layout, u, trans = tox.Layout(lengths), rng.normal(size=9), np.array([[0, -0.7], [0.3, 0.5]])
    odds, at = tox.marginals(layout, u, trans)[3], 0
    for n in lengths.tolist():
        mass = np.zeros((n, 2))
        for path in product((0, 1), repeat=n):
            score = sum(trans[p, y] + u[at + t] * y for t, (p, y) in enumerate(zip((0, *path), path)))
            for t, y in enumerate(path):
                mass[t, y] += np.exp(score)
        if n:
            assert np.allclose(mass[:, 1] / mass[:, 0], odds[at:at + n])
        at += n


def test_blocks_equal_one_by_one():
    rng = np.random.default_rng(1)
    u, trans = rng.normal(size=333) * 3, np.array([[0, -2.0], [-0.5, 0.4]])
    odds = tox.marginals(tox.Layout(np.array([333])), u, trans)[3]
    a, r, q, forward, backward = np.exp(trans), 0.0, 1.0, [], [0.0] * 333
    for t in range(333):
        r = np.exp(u[t]) * (a[0, 1] + r * a[1, 1]) / (1 + r * a[1, 0])
        forward.append(r)
    for t in reversed(range(333)):
        backward[t], e = q, np.exp(u[t]) * q
        q = (a[1, 0] + a[1, 1] * e) / (1 + a[0, 1] * e)
    assert np.allclose(np.array(forward) * backward, odds)


def test_gradient():
    rng = np.random.default_rng(2)
    layout = tox.Layout(np.array([4, 0, 90]))
    ev = np.abs(rng.normal(size=(94, 2))) * (rng.random((94, 1)) < 0.2)
    y, weight, theta = (ev.max(1) > 0).astype(int), np.array([1.0, 1, 2]), rng.normal(size=6) * 0.3
    _, g = tox.loss(theta, layout, ev, y, weight, 0.1)
    for i, step in enumerate(np.eye(6) * 1e-5):
        up, down = (tox.loss(theta + s, layout, ev, y, weight, 0.1)[0] for s in (step, -step))
        assert abs((up - down) / 2e-5 - g[i]) < 1e-5


def planted(n=500):
    rng, rows, labels = random.Random(5), [], []
    common = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(200)]
    for i in range(n):
        words = [rng.choice(common) for _ in range(rng.randint(20, 200))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["vilexx", "badword", "gluedstem" + rng.choice(common), "nasty"]))
        rows.append((i, " ".join(words), "clash"))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = planted()
    docs = spark.createDataFrame([*rows, (900, None, "c"), (901, "", "c"), (None, "nasty nasty", "c"), (902, "1 2 3", "c")],
                                 "doc_id long, text string, score string")
    marks = spark.createDataFrame([*labels, (None, 1, 1), (901, 1, None)], "doc_id long, quality int, toxic int")
    model = tox.fit(docs, marks.filter(~tox.held_out()))
    got = {r.doc_id: r for r in tox.score(docs, model).withColumn("out", tox.held_out()).collect()}
    out = [(got[i].score >= 0.3, bool(t)) for i, _, t in labels if got[i].out]
    assert len(out) > 80 and sum(a == b for a, b in out) >= 0.97 * len(out)
    texts = {i: t for i, t, _ in rows}
    for i, _, t in labels[:60]:
        for s in got[i].spans:
            assert all(w in ("vilexx", "badword", "nasty") or w.startswith("gluedstem") for w in texts[i][s["start"]:s["end"]].split())
    assert got[900].score == got[901].score == got[902].score < 0.1 and got[900].spans == []
    assert got[None].score > 0.3
    again = {r.doc_id: r.score for r in tox.score(docs.repartition(4), tox.fit(docs.repartition(3), marks.filter(~tox.held_out()))).collect()}
    assert all(abs(again[i] - r.score) < 1e-9 for i, r in got.items())


def test_held_out_rows_are_not_learned_from(spark):
    rows, labels = planted(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    turned = marks.withColumn("toxic", F.when(tox.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (tox.fit(docs, m.filter(~tox.held_out())) for m in (marks, turned))
    assert a.evidence == b.evidence and np.array_equal(a.theta, b.theta)


def test_nothing_to_learn(spark, no_docs):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    one = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    assert all(r.score < 1e-9 for r in tox.score(docs, tox.fit(docs, none)).collect())
    assert all(0 < r.score < 0.3 for r in tox.score(docs, tox.fit(docs, one)).collect())
    assert tox.score(no_docs, tox.fit(docs, one)).count() == 0


def test_offsets_after_lower_casing(spark):
    model = tox.Model({"=badword": 8.0}, np.array([-6.0, 2, 1, -1, 0, 0]), np.array([1.0, 0, 0, 0]))
    docs = spark.createDataFrame([(1, "ok BADWORD, badword İ fine")], "doc_id long, text string")
    spans = tox.score(docs, model).first().spans
    assert ["ok BADWORD, badword İ fine"[s["start"]:s["end"]] for s in spans] == ["BADWORD, badword"]
