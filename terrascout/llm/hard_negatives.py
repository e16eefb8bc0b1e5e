"""Hard-negative mining with bounds along a spanning tree of anchors.

Anchors and candidates are packed in tiles; a task holds a block of anchors and streams
tiles of candidates past it.  Inside a task the anchors are joined by a minimum spanning
tree.  A candidate's score at a parent, plus and minus the length of the edge times the
candidate's norm, bounds its score at the child; only candidates whose bounds reach into
a window of scores that the child still needs are scored again.  Windows close as better
rows come in.

The first pass finds each anchor's best rows of its own label; the second the best rows
of other labels in the window that each of those positives opens.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrascout.llm.common import bounded_batches, return_memory
from terrascout.llm.topk import exact_products, quantize
from terrascout.session import cut, steps

ANCHORS = 4096       # anchors of a block
TILE = 2048          # candidates of a tile
TREE = 512           # anchors under one spanning tree
CHUNK = 1024         # candidates bounded at a time
FIRST = 128          # candidates of the first such step
CELL = 16            # tiles that one task takes at most
BUCKETS = 64         # groups of labels that positives are searched in
_NONE = np.iinfo(np.int64)


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(parent, length of the edge to it, nodes level by level) of a minimum spanning tree; node 0 is the root."""
    n = len(points)
    square = (points ** 2).sum(1)
    parent, length = np.zeros(n, np.int64), np.full(n, np.inf)
    depth, out = np.zeros(n, np.int64), np.ones(n, bool)
    node = 0
    length[0] = 0.0
    for _ in range(n):
        out[node] = False
        depth[node] = depth[parent[node]] + 1
        gap = np.sqrt(np.maximum(0.0, square + square[node] - 2.0 * (points @ points[node])))
        nearer = out & (gap < length)
        length[nearer], parent[nearer] = gap[nearer], node
        node = int(np.where(out, length, np.inf).argmin())
    # As the products above round, lengths are taken again from differences.
    length = np.linalg.norm(points - points[parent], axis=1)
    return parent, length, [np.flatnonzero(depth == d) for d in range(1, int(depth.max(initial=0)) + 1)]


class Best:
    """The k best (score, id) of each (anchor, window) so far, and what a score must reach to enter."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low, high, k
        self.floor = low.copy()
        self.rows = np.zeros((4, 0), np.int64)  # anchor, window, score, id

    def take(self, parts: list[np.ndarray]) -> None:
        if not parts:
            return
        rows = np.concatenate([self.rows, *parts], axis=1)
        group = rows[0] * self.low.shape[1] + rows[1]
        rows = rows[:, np.lexsort((rows[3], -rows[2], group))]
        group = rows[0] * self.low.shape[1] + rows[1]
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        place = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
        self.rows = rows[:, place < self.k]
        last = rows[:, place == self.k - 1]
        self.floor[last[0], last[1]] = np.maximum(self.low[last[0], last[1]], last[2])


def search(ids: np.ndarray, labels: np.ndarray, points: np.ndarray, best: Best, tiles: list, same_label: bool) -> None:
    """Take the rows of ``tiles`` into ``best``; anchors are ``ids`` with ``labels`` and ``points``."""
    real = points.astype(np.float64)
    parent, length, levels = spanning_tree(real)
    length = length * (1 + 1e-9)
    windows = range(best.low.shape[1])
    for tile_ids, tile_labels, tile in tiles:
        stop = 0
        while stop < len(tile_ids):
            # The first candidates close the windows; there are few, as all of them are scored.
            start, stop = stop, stop + (CHUNK if best.rows.shape[1] else FIRST)
            cid, clabel, rows = tile_ids[start:stop], tile_labels[start:stop], tile[start:stop]
            norm = np.linalg.norm(rows.astype(np.float64), axis=1)
            low, high, place = None, None, np.zeros(len(ids), np.int64)
            found: list[np.ndarray] = []
            for level in levels:
                want = ((labels[level, None] == clabel) == same_label) & (ids[level, None] != cid)
                if low is not None:
                    wide = length[level, None] * norm
                    up = place[parent[level]]
                    low, high = low[up] - wide, high[up] + wide
                    slack = 2.0 + 1e-9 * np.maximum(np.abs(low), np.abs(high))
                    low, high = low - slack, high + slack
                    want &= (high >= best.floor[level].min(1)[:, None]) & (low <= best.high[level].max(1)[:, None])
                place[level] = np.arange(len(level))
                if low is None or want.mean() > 0.05:
                    score = exact_products(points[level], rows)
                    low = high = score.astype(np.float64)
                    i, j = np.nonzero(want)
                    s = score[i, j]
                else:
                    i, j = np.nonzero(want)
                    s = np.empty(len(i), np.int64)
                    for node in np.unique(i):  # one product a node; its candidates only
                        own = i == node
                        s[own] = exact_products(points[level[node]][None], rows[j[own]])[0]
                    low[i, j] = high[i, j] = s
                for w in windows:
                    ok = (s >= best.floor[level[i], w]) & (s <= best.high[level[i], w])
                    if ok.any():
                        found.append(np.stack([level[i[ok]], np.full(int(ok.sum()), w), s[ok], cid[j[ok]]]))
            best.take(found)


def _pack(rows: DataFrame, keys: list[str], extra: str = "") -> DataFrame:
    """Rows of equal keys as one row: ids, labels and vectors side by side."""
    types = dict(rows.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", ids binary, labels array<string>, v binary"
    if extra:
        schema += f", {extra} array<array<array<long>>>"

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        v = np.stack([np.asarray(x, np.int64) for x in frame["v"]])
        row = {k: frame[k].iloc[0] for k in keys} | {"ids": frame["id"].to_numpy(np.int64).tobytes(), "labels": frame["label"].tolist(),
                                                      "v": v.tobytes()}
        if extra:
            row[extra] = [[[int(n) for n in pair] for pair in x] for x in frame[extra]]
        return pd.DataFrame([row])

    return rows.groupBy(*keys).applyInPandas(pack, schema)


def _unpack(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(row.ids, np.int64)
    return ids, np.array(list(row.labels), object), np.frombuffer(row.v, np.int64).reshape(len(ids), -1)


def _meet(anchors: DataFrame, tiles: DataFrame, blocks: DataFrame, shares: int, cells: int, work, schema: str) -> DataFrame:
    """Run ``work`` on every block of anchors with every share of the tiles in its group."""
    every = F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))
    left = anchors.withColumn("share", every)
    right = tiles.join(F.broadcast(blocks), "grp").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .withColumn("share", F.pmod(F.xxhash64("tile"), F.lit(shares)).cast("int")).drop("blocks")
    keys = ["grp", "block", "share"]
    return left.repartition(cells, *keys).groupBy(*keys).cogroup(right.repartition(cells, *keys).groupBy(*keys)).applyInPandas(work, schema)


def _blocks_of(rows: DataFrame, per: int) -> DataFrame:
    """(grp, blocks): how many blocks of at most about ``per`` rows each group has; there are as many groups as
    lengths of vectors, times ``BUCKETS`` at most."""
    return rows.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / F.lit(per)).cast("int").alias("blocks"))


def _best_rows(frame, tiles, windows, k: int, same_label: bool) -> Iterator[tuple]:
    held = [_unpack(t) for t in tiles.itertuples()]
    for row in frame.itertuples():
        ids, labels, points = _unpack(row)
        low, high = windows(row, len(ids))
        for a in range(0, len(ids), TREE):
            b = slice(a, a + TREE)
            best = Best(low[b], high[b], k)
            search(ids[b], labels[b], points[b], best, held, same_label)
            anchor, window, score, other = best.rows
            yield ids[b][anchor], window, score, other


def mine(vectors: DataFrame, is_anchor, *, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0,
         id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", anchors_per_block: int = ANCHORS,
         tile_rows: int = TILE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Scores are whole inner products of floor(``scale`` * component).  ``is_anchor`` is a condition
    on ``id``.  An anchor's positives are its ``positives`` best other rows of its label; for each,
    the ``negatives`` best rows of other labels with ``low`` * positive <= 100 * negative <=
    ``high`` * positive are returned, ranked from 1.  Higher scores come first, ties by smaller id.
    Rows without id, label or vector, or with a NULL or non-finite component, take no part;
    vectors of another length are not compared.  Repeated rows are candidates each; an id that
    is an anchor several times answers once, by its smallest label and vector.  Scores
    beyond 64 bits raise an error.  An empty table gives no rows; other columns are not read.
    """
    spark = bounded_batches(vectors.sparkSession)
    label = F.col(label_col).cast("string")
    with steps(spark) as own:
        given = vectors.filter(label.isNotNull()).select(F.col(id_col).alias("id"), label.alias("label"), F.col(vec_col).alias("v"))
        rows = cut(quantize(given, scale, "id", "v", keep=["label"]))
        hashed = F.pmod(F.xxhash64("label"), F.lit(BUCKETS))
        rows = rows.withColumn("grp", F.concat(F.size("v").cast("string"), F.lit("-"), hashed))
        anchors = cut(rows.filter(is_anchor).groupBy("id").agg(F.min(F.struct("label", "v", "grp")).alias("m")).select("id", "m.*"))
        cores = spark.sparkContext.defaultParallelism

        def dealt(df: DataFrame, name: str, per: int) -> tuple[DataFrame, DataFrame]:
            counts = cut(_blocks_of(df, per))
            return df.join(F.broadcast(counts), "grp").withColumn(name, F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")).cast("int")) \
                .drop("blocks"), counts

        def grid(counts: DataFrame, tiles: int) -> tuple[int, int]:
            blocks = max(1, counts.agg(F.sum("blocks")).first()[0] or 0)
            shares = max(1, math.ceil(tiles / CELL), min(tiles, math.ceil(2 * cores / blocks)))
            return shares, min(20_000, blocks * shares)

        tiled, tile_counts = dealt(rows, "tile", tile_rows)
        tiles = cut(_pack(tiled, ["grp", "tile"]).withColumn("tile", F.concat_ws(".", "grp", "tile")))
        largest = tile_counts.agg(F.max("blocks")).first()[0] or 0

        # First pass: inside the groups of labels.
        blocked, counts = dealt(anchors, "block", anchors_per_block)
        shares, cells = grid(counts, largest)

        def first(keys, frame: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
            def windows(_, n):
                return np.full((n, 1), _NONE.min), np.full((n, 1), _NONE.max)
            made = [pd.DataFrame({"anchor_id": a, "positive_id": o, "score": s})
                    for a, _, s, o in _best_rows(frame, others, windows, positives, True)]
            return_memory()
            return pd.concat(made) if made else pd.DataFrame({"anchor_id": [], "positive_id": [], "score": []}).astype("int64")

        near = _meet(_pack(blocked, ["grp", "block"]), tiles, counts, shares, cells, first, "anchor_id long, positive_id long, score long")
        best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id")
        # At most ``positives`` an anchor.
        pairs = cut(near.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= positives).groupBy("anchor_id").agg(
            F.sort_array(F.collect_list(F.struct("n", "score", "positive_id"))).alias("found")))

        # Second pass: all labels of a length against all its anchors.
        by_length = F.substring_index("grp", "-", 1)
        scored = F.transform("found", lambda x: F.array(x["score"], x["positive_id"]))
        asking, counts = dealt(anchors.join(pairs.withColumnRenamed("anchor_id", "id"), "id").select("id", "label", "v", by_length.alias("grp"),
                                                                                                      scored.alias("wins")), "block", anchors_per_block)
        shares, cells = grid(counts, tiles.count())

        def second(keys, frame: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
            made = []

            def windows(row, n):
                least, most = np.full((n, positives), _NONE.max), np.full((n, positives), _NONE.min)
                for i, wins in enumerate(row.wins):
                    for w, (p, _) in enumerate(wins):
                        least[i, w], most[i, w] = -(-low * int(p) // 100), high * int(p) // 100
                return least, most

            opened = {int(i): wins for row in frame.itertuples() for i, wins in zip(np.frombuffer(row.ids, np.int64), row.wins)}
            for a, w, s, o in _best_rows(frame, others, windows, negatives, False):
                wins = [opened[int(i)][int(x)] for i, x in zip(a, w)]
                made.append(pd.DataFrame({"anchor_id": a, "n": w, "positive_id": [int(x[1]) for x in wins],
                                          "positive_score": [int(x[0]) for x in wins], "negative_id": o, "negative_score": s}))
            return_memory()
            names = ["anchor_id", "n", "positive_id", "positive_score", "negative_id", "negative_score"]
            return pd.concat(made) if made else pd.DataFrame({c: [] for c in names}).astype("int64")

        found = _meet(_pack(asking, ["grp", "block"], "wins"), tiles.withColumn("grp", by_length), counts, shares, cells, second,
                      "anchor_id long, n long, positive_id long, positive_score long, negative_id long, negative_score long")
        order = Window.partitionBy("anchor_id", "n").orderBy(F.desc("negative_score"), "negative_id")
        return own.keep(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives).select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"))
