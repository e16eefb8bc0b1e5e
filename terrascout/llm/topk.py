"""Exact top-k search by distributed histogram selection.

All scores of blocks of queries against blocks of candidates are computed; what
leaves a task are histograms.  Rounds narrow, for each query, the range of scores
that holds its k-th highest one down to a single integer; a last round keeps the
rows above it and breaks ties by id.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrascout.session import cut

BLOCK = 4096       # candidates scored at a time
QUERY_BLOCK = 4096  # queries that one task holds
BINS = 1024        # bins of one round of refinement
EXACT = 1 << 53    # below this, sums of products are whole in double precision


def quantize(vectors: DataFrame, scale: float, id_col: str, vec_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """(id, v): floor(scale * x) of each component as long; rows without a whole, finite vector go.

    A component that leaves the range of whole numbers raises an error.
    """
    def whole(a):
        x = F.lit(float(scale)) * a.cast("double")
        return F.when(F.abs(x) < F.lit(float(1 << 63)), F.floor(x)).otherwise(
            F.raise_error(F.lit("a component of a vector is beyond 64 bits")).cast("long"))

    fine = F.forall(F.col(vec_col), lambda a: a.isNotNull() & ~F.isnan(a.cast("double"))
                    & (F.abs(a.cast("double")) < F.lit(math.inf)))
    x = F.when(F.coalesce(fine, F.lit(False)), F.transform(F.col(vec_col), whole))
    return vectors.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), x.alias("v"), *keep) \
        .filter("v is not null")


def _matrix(rows: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.int64) for v in rows]) if len(rows) else np.zeros((0, 0), np.int64)


def exact_products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Whole inner products: by BLAS where doubles are exact, in integers elsewhere; beyond 64 bits an error."""
    def largest(x: np.ndarray) -> int:
        return max(int(x.max(initial=0)), -int(x.min(initial=0)))

    bound = largest(q) * largest(c) * max(1, q.shape[1])
    if bound < 1 << 24:
        return (q.astype(np.float32) @ c.astype(np.float32).T).astype(np.int64)
    if bound < EXACT:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if bound < 1 << 63:
        return q @ c.T
    raise OverflowError("inner products of these vectors may be beyond 64 bits")


def top_k(vectors: DataFrame, is_query, k: int = 20, *, scale: float = 64.0, id_col: str = "vec_id",
          vec_col: str = "embedding", cells: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query.

    ``is_query`` is a condition on ``id``.  A query is no candidate of its own; ties go to the
    smaller id; a query with fewer candidates lists all.  Vectors that are NULL, hold NULL or
    non-finite components, or have no id take no part; vectors of another length than the
    query's are no candidates of it.  Repeated rows are candidates each, and a repeated query
    answers once.  Components or scores that may be beyond 64 bits raise an error.  Nothing but
    ids and vectors is read.

    Every task holds ``QUERY_BLOCK`` queries and streams a share of the candidates past them.
    """
    rows = cut(quantize(vectors, scale, id_col, vec_col).withColumn("dim", F.size("v")))
    queries = rows.filter(is_query).dropDuplicates(["id"]).select("id", "v", "dim")
    counts = queries.groupBy("dim").count().collect()  # one row for each length of vector
    if not counts:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    blocks = max(1, math.ceil(sum(r["count"] for r in counts) / QUERY_BLOCK))
    shares = cells or max(1, math.ceil(rows.sparkSession.sparkContext.defaultParallelism / blocks),
                          math.ceil(rows.count() / (64 * BLOCK)))
    block_of = F.pmod(F.xxhash64("id"), F.lit(blocks))
    every_share = F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))
    every_block = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    # Candidates are dealt by their hash and copies of a vector by their id: shares are even.
    right = rows.select(every_block.alias("qb"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(shares)).cast("int").alias("cs"),
                        "id", "v", "dim")
    grid = blocks * shares

    def cell(state: DataFrame, work, schema: str) -> DataFrame:
        """Run ``work`` on every (block of queries, share of candidates)."""
        left = state.select(block_of.alias("qb"), every_share.alias("cs"), "*")
        return (left.repartition(grid, "qb", "cs").groupBy("qb", "cs")
                .cogroup(right.repartition(grid, "qb", "cs").groupBy("qb", "cs")).applyInPandas(work, schema))

    def each_block(q: pd.DataFrame, c: pd.DataFrame):
        """(queries, candidate ids, scores) with the query's own row masked out."""
        for dim, own in q.groupby("dim"):
            other = c[c["dim"] == dim]
            if not len(other):
                continue
            m, ids, qid = _matrix(own["v"]), other["id"].to_numpy(), own["id"].to_numpy()
            table = _matrix(other["v"])
            for i in range(0, len(m), 512):
                for j in range(0, len(ids), BLOCK):
                    s = exact_products(m[i:i + 512], table[j:j + BLOCK])
                    yield own.iloc[i:i + 512], ids[j:j + BLOCK], s, qid[i:i + 512, None] != ids[None, j:j + BLOCK]

    def ranges(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"id": part["id"].to_numpy(), "n": keep.sum(1),
                             "lo": np.where(keep, s, np.iinfo(np.int64).max).min(1),
                             "hi": np.where(keep, s, np.iinfo(np.int64).min).max(1)})
               for part, _, s, keep in each_block(q, c)]
        if not out:
            return pd.DataFrame({"id": [], "n": [], "lo": [], "hi": []}).astype("int64")
        return pd.concat(out).groupby("id", as_index=False).agg({"n": "sum", "lo": "min", "hi": "max"})

    def histogram(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        """Counts of scores by bin of the query's range [lo, lo + width * BINS), the highest bins only.

        The k-th score of all is at least that of any share, so a share reports its
        bins down to the one that holds its own k-th score in the range.
        """
        total: dict[int, np.ndarray] = {}
        for part, _, s, keep in each_block(q, c):
            lo, width = part["lo"].to_numpy()[:, None], part["width"].to_numpy()[:, None]
            keep = keep & (s >= lo) & (s < part["end"].to_numpy()[:, None])
            line = np.arange(len(s))[:, None] * BINS
            flat = (line + (s - lo) // width)[keep]
            hist = np.bincount(flat, minlength=len(s) * BINS).reshape(len(s), BINS)
            for i, name in enumerate(part["id"].to_numpy()):
                total[name] = total[name] + hist[i] if name in total else hist[i].astype(np.int64)
        ids, bins, n = [], [], []
        for name, hist in total.items():
            full = np.flatnonzero(hist)[::-1]
            upto = full[:np.searchsorted(np.cumsum(hist[full]), k) + 1]
            ids += [name] * len(upto)
            bins += upto.tolist()
            n += hist[upto].tolist()
        return pd.DataFrame({"id": np.array(ids, np.int64), "bin": np.array(bins, np.int64), "n": np.array(n, np.int64)})

    def select(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        """Rows above the k-th score and, of those equal to it, the smallest ids that can be needed."""
        out = []
        for part, ids, s, keep in each_block(q, c):
            kth = part["lo"].to_numpy()[:, None]
            i, j = np.nonzero(keep & (s >= kth))
            out.append(pd.DataFrame({"query_id": part["id"].to_numpy()[i], "vec_id": ids[j], "score": s[i, j]}))
            if len(out) > 16:
                out = [best(pd.concat(out))]
        return best(pd.concat(out)) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    def best(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
        return rows[rows.groupby("query_id").cumcount() < k]

    span = cell(queries, ranges, "id long, n long, lo long, hi long") \
        .groupBy("id").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("n > 0")
    # ``need`` counts down as higher scores are set aside; lo <= k-th score < end.
    state = cut(queries.join(span, "id").withColumns({
        "need": F.least(F.col("n"), F.lit(k)), "end": F.col("hi") + 1}).drop("n", "hi"))
    while True:
        widest = state.agg(F.max(F.col("end") - F.col("lo"))).first()[0]  # one number
        if widest is None or widest <= 1:
            break
        state = state.withColumn("width", F.ceil((F.col("end") - F.col("lo")) / F.lit(BINS)).cast("long"))
        bins = cell(state, histogram, "id long, bin long, n long").groupBy("id", "bin").agg(F.sum("n").alias("n"))
        # At most a few times k bins of each query.
        down = Window.partitionBy("id").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        passed = bins.withColumn("upto", F.sum("n").over(down)).join(state.select("id", "need"), "id") \
            .filter((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need"))) \
            .select("id", "bin", (F.col("upto") - F.col("n")).alias("above"))
        state = cut(state.join(passed, "id").withColumns({
            "need": F.col("need") - F.col("above"),
            "end": F.least(F.col("end"), F.col("lo") + (F.col("bin") + 1) * F.col("width")),
            "lo": F.col("lo") + F.col("bin") * F.col("width")}).drop("bin", "above", "width"))
    found = cell(state, select, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k) \
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
