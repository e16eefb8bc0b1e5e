"""Toxic spans by a linear-chain conditional random field.

Labels are given for documents only.  Words, and beginnings of longer words, that
occur mostly in toxic documents get an evidence weight; a word with evidence in a toxic document
is a token labelled 1, every other token 0.  A two-state chain is fitted to these
labelled tokens.  Forward-backward marginals tag spans, and the chance that at
least one token is toxic, calibrated on the same sample, is the document's score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrascout.llm.common import map_batches, return_memory
from terrascout.session import cut

TOKEN = re.compile(r"[^\W\d_]+")
BLOCK = 64            # tokens that one matrix product of the scan covers
SPAN = 0.5            # marginal from which a token belongs to a span
BEGINNINGS = range(3, 9)
CACHE_WORDS = 500_000


@dataclass
class Model:
    """Evidence by feature, chain weights (bias, word, beginning, t01, t10, t11) and calibration."""

    evidence: dict[str, float] = field(default_factory=dict)
    theta: np.ndarray = field(default_factory=lambda: np.array([-8.0, 1, 1, -4, -1, 0]))
    calibration: np.ndarray = field(default_factory=lambda: np.array([0.0, 0, 0, -1e3]))


def features(word: str) -> list[str]:
    """The word itself, and its first 3 to 8 letters as far as more letters follow."""
    return ["=" + word, *[word[:n] for n in BEGINNINGS if len(word) > n]]


def token_evidence(word: str, evidence: dict[str, float]) -> tuple[float, float]:
    """Evidence of the word itself and of its strongest beginning."""
    own, *rest = features(word)
    return evidence.get(own, 0.0), max((evidence.get(f, 0.0) for f in rest), default=0.0)


def signature(text: str) -> int:
    """Smallest hash of three consecutive words: near copies mostly share it."""
    words = TOKEN.findall(text)
    if len(words) < 3:
        return xxhash.xxh64_intdigest(" ".join(words)) >> 1
    return min(xxhash.xxh64_intdigest(" ".join(words[i:i + 3])) for i in range(len(words) - 2)) >> 1


# ----------------------------------------------------------------- the chain

class Layout:
    """Tokens of many documents as a matrix of blocks, so that a scan takes BLOCK + longest / BLOCK steps."""

    def __init__(self, lengths: np.ndarray):
        lengths = np.asarray(lengths, np.int64)
        self.lengths, self.blocks = lengths, -(-lengths // BLOCK)
        self.first = np.concatenate([[0], np.cumsum(self.blocks)])
        total = int(self.first[-1])
        doc = np.repeat(np.arange(len(lengths)), lengths)
        inside = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.row, self.col, self.doc = self.first[doc] + inside // BLOCK, inside % BLOCK, doc
        self.real = np.zeros((total, BLOCK), bool)
        self.real[self.row, self.col] = True
        self.order = [np.flatnonzero(self.blocks > k) for k in range(int(self.blocks.max(initial=0)))]

    def spread(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(self.real.shape)
        out[self.row, self.col] = values
        return out


def marginals(layout: Layout, emission: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each token: ratio of forward messages before it and at it, ratio of backward messages, marginal odds.

    trans[i, j] is the weight of going from state i to j; a clean state stands before the first token.
    """
    a, g = np.exp(trans), np.exp(layout.spread(np.clip(emission, -25, 25)))
    n = len(g)
    p00, p01, p10, p11 = np.ones(n), np.zeros(n), np.zeros(n), np.ones(n)
    for k in range(BLOCK):  # products of the blocks' matrices; padding is the identity
        real, e = layout.real[:, k], g[:, k]
        m00, m01, m10, m11 = (np.where(real, x, y) for x, y in
                              ((a[0, 0], 1.0), (a[0, 1] * e, 0.0), (a[1, 0], 0.0), (a[1, 1] * e, 1.0)))
        p00, p01, p10, p11 = p00 * m00 + p01 * m10, p00 * m01 + p01 * m11, p10 * m00 + p11 * m10, p10 * m01 + p11 * m11
        top = np.maximum(np.maximum(p00, p01), np.maximum(p10, p11))
        p00, p01, p10, p11 = p00 / top, p01 / top, p10 / top, p11 / top
    before, behind = np.zeros(n), np.ones(n)
    carry = np.zeros(len(layout.lengths))
    for k, docs in enumerate(layout.order):  # from block to block
        b = layout.first[docs] + k
        r = before[b] = carry[docs]
        carry[docs] = (p01[b] + r * p11[b]) / (p00[b] + r * p10[b])
    carry = np.ones(len(layout.lengths))
    for k in range(len(layout.order) - 1, -1, -1):
        docs = layout.order[k]
        b = layout.first[docs] + k
        q = behind[b] = carry[docs]
        carry[docs] = (p10[b] + p11[b] * q) / (p00[b] + p01[b] * q)
    prior, ahead = np.empty_like(g), np.empty_like(g)
    r, q = before, behind
    at = np.empty_like(g)
    for k in range(BLOCK):  # inside all blocks at once
        prior[:, k] = r
        r = np.where(layout.real[:, k], g[:, k] * (a[0, 1] + r * a[1, 1]) / (a[0, 0] + r * a[1, 0]), r)
        at[:, k] = r
    for k in range(BLOCK - 1, -1, -1):
        ahead[:, k] = q
        e = g[:, k] * q
        q = np.where(layout.real[:, k], (a[1, 0] + a[1, 1] * e) / (a[0, 0] + a[0, 1] * e), q)
    pick = layout.row, layout.col
    return prior[pick], at[pick], ahead[pick], at[pick] * ahead[pick]


def _transitions(theta: np.ndarray) -> np.ndarray:
    return np.array([[0.0, theta[3]], [theta[4], theta[5]]])


def loss(theta: np.ndarray, layout: Layout, ev: np.ndarray, y: np.ndarray, weight: np.ndarray,
         ridge: float) -> tuple[float, np.ndarray]:
    """Negative log-likelihood of the labelled tokens a document, and its gradient."""
    trans = _transitions(theta)
    a = np.exp(trans)
    u = np.clip(theta[0] + ev @ theta[1:3], -25, 25)
    prior, _, ahead, odds = marginals(layout, u, trans)
    p, e, w = odds / (1 + odds), np.exp(u), weight[layout.doc]
    starts = np.cumsum(layout.lengths) - layout.lengths
    last = np.concatenate([[0], y[:-1]])
    last[starts[layout.lengths > 0]] = 0
    z = np.log((a[0, 0] + a[0, 1] * e + prior * (a[1, 0] + a[1, 1] * e)) / (1 + prior))
    joint = np.stack([a[0, 0] + 0 * e, a[0, 1] * e * ahead, prior * a[1, 0], prior * a[1, 1] * e * ahead])
    joint /= joint.sum(0)
    total = weight.sum()
    value = float((w * (z - trans[last, y] - u * y)).sum()) / total + ridge * float(theta @ theta) / 2
    miss = w * (p - y)
    grad = np.array([miss.sum(), *(miss @ ev),
                     *(float((w * (joint[i] - ((last == s) & (y == t)))).sum()) for i, s, t in ((1, 0, 1), (2, 1, 0), (3, 1, 1)))])
    return value, grad / total + ridge * theta


def minimise(f, x: np.ndarray, steps: int = 40) -> np.ndarray:
    """BFGS with backtracking for a handful of parameters."""
    h, (v, g) = np.eye(len(x)), f(x)
    for _ in range(steps):
        d = -h @ g
        t = min(1.0, 4.0 / (np.linalg.norm(d) + 1e-12))
        while True:
            v2, g2 = f(x + t * d)
            if v2 <= v + 1e-4 * t * (g @ d) or t < 1e-6:
                break
            t /= 2
        s, y = t * d, g2 - g
        x, gain, v, g = x + s, v - v2, v2, g2
        if (sy := s @ y) > 1e-12:
            m = np.eye(len(x)) - np.outer(s, y) / sy
            h = m @ h @ m.T + np.outer(s, s) / sy
        if gain < 1e-9 or np.abs(g).max() < 1e-6:
            break
    return x


# ------------------------------------------------------------------ learning

def _evidence(train: DataFrame, g_least: float, max_features: int) -> list[dict[str, float]]:
    """Log odds ratio of features that occur significantly more often, and mostly, in toxic documents.

    Three of them: from all documents, and without those of fold 0 and of fold 1.
    """
    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen: list[Counter] = [Counter() for _ in range(4)]
        for text, toxic, fold in zip(*(c.to_pylist() for c in batch.columns)):
            words = set(TOKEN.findall(text.lower()))
            seen[2 * fold + toxic].update({f for w in words for f in features(w)})
        names = list(set().union(*seen))
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), *(pa.array([c[f] for f in names], pa.int64()) for c in seen)],
            names=["feature", "n0", "t0", "n1", "t1"])

    rows = train.groupBy("fold", "toxic").count().collect()  # four numbers
    sizes = {(r["fold"], r["toxic"]): float(r["count"]) for r in rows}
    counts = map_batches(train.select("text", "toxic", "fold"), count, "feature string, n0 long, t0 long, n1 long, t1 long") \
        .groupBy("feature").agg(*[F.sum(c).cast("double").alias(c) for c in ("n0", "t0", "n1", "t1")])

    def found(folds: list[int], g_min: float) -> dict[str, float]:
        pos, neg = (sum(sizes.get((k, label), 0.0) for k in folds) for label in (1, 0))
        if not pos or not neg:
            return {}
        t, n = (sum((F.col(f"{c}{k}") for k in folds), F.lit(0.0)) for c in "tn")

        def rate(k: Column, total: float) -> Column:
            return (k + 0.5) / (F.lit(total + 0.5) - k)

        def part(k: Column, total: float, margin: Column) -> Column:
            return F.when(k > 0, k * F.log(k * F.lit(pos + neg) / (margin * F.lit(total)))).otherwise(0.0)

        # Likelihood-ratio statistic of the 2 x 2 table; right for small counts too.
        both = F.lit(pos + neg) - t - n
        g = 2 * (part(t, pos, t + n) + part(n, neg, t + n) + part(F.lit(pos) - t, pos, both) + part(F.lit(neg) - n, neg, both))
        best = counts.filter(t > 4 * n).withColumns({"g": g, "d": F.log(rate(t, pos) / rate(n, neg))}).filter(F.col("g") >= g_min) \
            .orderBy(F.desc("g"), "feature").limit(max_features).collect()
        return {r["feature"]: r["d"] for r in best}

    counts = cut(counts)
    return [found([0, 1], g_least), found([1], g_least / 2), found([0], g_least / 2)]


def fit(docs: DataFrame, labels: DataFrame, *, train_rows: int = 20_000, chain_rows: int = 600, chain_chars: int = 50_000,
        g_least: float = 30.0, max_features: int = 50_000, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic") -> Model:
    """Learn a model from a bounded sample of labelled rows.

    ``train_rows`` labels are drawn by a hash of their id (so at most that many rows are
    broadcast); near copies among them count once.  The chain's six weights are fitted on
    the driver to at most ``chain_rows`` documents of each class, of at most ``chain_chars``
    characters.  Rows without id, text or label are not learned from; labels that
    contradict each other count as toxic.  With one class or none the model is constant.
    """
    chosen = (labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
              .groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
              .orderBy(F.xxhash64("_id"), "_id").limit(train_rows))
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull()) \
        .join(F.broadcast(chosen), "_id")  # at most train_rows rows

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        marks = [signature(t) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks, pa.int64())], names=[*batch.schema.names, "mark"])

    kind = found.schema["_id"].dataType.simpleString()
    rows = cut(map_batches(found.select("_id", "text", "toxic"), sign, f"_id {kind}, text string, toxic int, mark long"))
    once = rows.groupBy("mark", "toxic").agg(F.min("_id").alias("_id")).select("_id").distinct()
    train = cut(rows.join(once, "_id").dropDuplicates(["_id"])
                .select("_id", "text", "toxic", (F.col("mark") % 2).cast("int").alias("fold")))
    evidence = _evidence(train, g_least, max_features)
    model = Model(evidence[0])
    short = train.filter(F.length("text") <= chain_chars)
    sample = [r for label in (0, 1) for r in short.filter(F.col("toxic") == label)
              .orderBy(F.xxhash64("_id", F.lit(7)), "_id").limit(chain_rows).collect()]
    totals = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}  # two rows
    size, pos = sum(totals.values()), totals.get(1, 0)
    base = (pos + 0.5) / (size + 1) if size else 0.0
    if not all(evidence) or not pos or pos == size:
        model.evidence = {}
        model.calibration[3] = math.log(base / (1 - base)) if size else -1e3
        return model

    words = [TOKEN.findall(r["text"].lower()) for r in sample]
    toxic = np.array([r["toxic"] for r in sample])
    layout = Layout(np.array([len(w) for w in words]))
    # What the chain and the calibration see of a document was learned without its fold.
    known: list[dict[str, tuple[float, float]]] = [{}, {}]
    ev = np.array([known[k].get(w) or known[k].setdefault(w, token_evidence(w, evidence[1 + k]))
                   for doc, k in zip(words, (r["fold"] for r in sample)) for w in doc]).reshape(-1, 2)
    y = ((ev.max(1, initial=0) > 0) & (toxic[layout.doc] == 1)).astype(np.int64)
    # The sample has as many documents of either class; weights restore their shares.
    have = np.bincount(toxic, minlength=2)
    share = np.array([1 - pos / size, pos / size]) / np.maximum(have, 1) * len(sample)
    weight = share[toxic]
    model.theta = minimise(lambda t: loss(t, layout, ev, y, weight, 1e-3), model.theta)
    x = doc_features(layout, marginals(layout, model.theta[0] + ev @ model.theta[1:3], _transitions(model.theta))[3])

    def logistic(t: np.ndarray) -> tuple[float, np.ndarray]:
        s = x @ t
        value = (weight * (np.logaddexp(0, s) - toxic * s)).sum() / len(x) + 5e-5 * t @ t
        miss = weight * (1 / (1 + np.exp(-np.clip(s, -700, 700))) - toxic)
        return float(value), miss @ x / len(x) + 1e-4 * t

    model.calibration = minimise(logistic, np.zeros(x.shape[1]), 80)
    return model


# ------------------------------------------------------------------- scoring

def doc_features(layout: Layout, odds: np.ndarray) -> np.ndarray:
    """A document's marginals in four numbers: log odds of any toxic token, log of the expected number, log length, 1."""
    docs = len(layout.lengths)
    none = -np.bincount(layout.doc, np.log1p(odds), minlength=docs)
    many = np.bincount(layout.doc, odds / (1 + odds), minlength=docs)
    some = np.log(np.maximum(-np.expm1(none), 1e-9)) - none
    return np.stack([np.clip(some, -12, 6), np.log(many + 1e-3), np.log(layout.lengths + 50.0), np.ones(docs)], axis=1)


class Tagger:
    """A model with the emissions of known words."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}
        self.background = float(model.theta[0])

    def emission(self, word: str) -> float:
        u = self.known.get(word)
        if u is None:
            ev, theta = self.model.evidence, self.model.theta
            own, begins = token_evidence(word, ev)
            u = self.background + float(theta[1]) * own + float(theta[2]) * begins
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            self.known[word] = u
        return u

    def score(self, texts: list[str]) -> tuple[list[float], list[list[dict]]]:
        words = [TOKEN.findall(t.lower()) for t in texts]
        layout = Layout(np.array([len(w) for w in words], np.int64))
        u = np.fromiter((e for doc in words for e in map(self.emission, doc)), float, int(layout.lengths.sum()))
        odds = marginals(layout, u, _transitions(self.model.theta))[3] if self.model.evidence else np.zeros(len(u))
        s = doc_features(layout, odds) @ self.model.calibration
        scores = 1 / (1 + np.exp(-np.clip(s, -700, 700)))
        spans: list[list[dict]] = [[] for _ in texts]
        p, ends = odds / (1 + odds), np.cumsum(layout.lengths)
        for d in np.unique(layout.doc[p >= SPAN]):
            own, out, going = p[ends[d] - layout.lengths[d]:ends[d]], spans[d], False
            # Lower-casing may change a text's length; offsets are those of the text itself.
            places = list(TOKEN.finditer(texts[d]))
            if len(places) != len(own):
                places = list(TOKEN.finditer(texts[d].lower()))
            for m, chance in zip(places, own):
                if chance >= SPAN and going:
                    out[-1].update(end=m.end(), p=max(out[-1]["p"], float(chance)))
                elif chance >= SPAN:
                    out.append({"start": m.start(), "end": m.end(), "p": float(chance)})
                going = chance >= SPAN
        return scores.tolist(), spans


def _portions(texts: list[str | None], chars: int = 1 << 20) -> Iterator[list[str]]:
    """Texts in order, about ``chars`` at a time or one: the messages of a token take many times its own room."""
    some: list[str] = []
    held = 0
    for text in texts:
        some.append(text or "")
        held += len(some[-1])
        if held >= chars:
            yield some
            some, held = [], 0
    if some:
        yield some


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text",
          keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, score, spans, and the columns of ``keep``) for every row; spans are character offsets of toxic passages with their highest marginal.

    A NULL or empty text, or one without letters, scores lowest (the model's value for no
    evidence) and has no spans.  Repeated rows score alike; other columns are not read.
    The model travels with the task: at most ``max_features`` weights.
    """
    holder: list[Tagger] = []
    kept = [c for c in keep if c != text_col]
    with_text = [1] if text_col in keep else []

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not holder:
            holder.append(Tagger(model))
        scores, spans = [], []
        for texts in _portions(batch.column(1).to_pylist()):
            for out, made in zip((scores, spans), holder[0].score(texts)):
                out += made
        return_memory()
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
        extra = [batch.column(i) for i in [*with_text, *range(2, batch.num_columns)]]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, kind), *extra],
                                          names=["doc_id", "score", "spans", *[text_col] * len(with_text), *kept])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *kept)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    more = [f"`{text_col}` string"] * len(with_text) + [f"`{c}` {kinds[c]}" for c in kept]
    return map_batches(rows, each, ", ".join([f"doc_id {kinds['doc_id']}", "score double",
                                              "spans array<struct<start:int,end:int,p:double>>", *more]))


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text leaves 2 when divided by 4; such rows are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
