"""Near copies among embeddings by PCA-ordered tiled comparison.

Equal vectors of one label are compared as one.  Unit vectors are turned so that their
components stand in order of variance (the turning comes from the second moments of all
vectors).  Vectors of a label are cut into tiles along the leading components, box by
box; only tiles that come as near as a link allows meet.  Two tiles are compared in
blocks: products of the leading components first, and after each stage a pair goes on
only if the norms of the components still to come let its cosine reach the threshold.

Tiles have a bounded size.  A pair of tiles leaves a count for each of its vectors and the
edges of a spanning forest, never its links: a cluster of n copies costs n rows per tile
that it meets.  Two tiles so narrow that all their pairs are links are not multiplied.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrascout.llm.common import bounded_batches, map_batches, return_memory
from terrascout.operators.cluster import connected_components
from terrascout.operators.joins import frequent_keys, look_up
from terrascout.session import cut, steps

LEAD = 8            # leading components that boxes of tiles are cut along
FAN = 16            # children of a box
TILE_ROWS = 4096    # vectors of a tile, less if they are long
TILE_BYTES = 32 << 20
BLOCK = 512         # rows of a tile compared at a time
SLACK = 1e-9        # products this near to the threshold are taken again from the vectors as given


def finite(vec_col: str):
    """Not NULL, without NULL or non-finite components, and not zero."""
    x = F.col(vec_col)
    fine = F.forall(x, lambda a: a.isNotNull() & ~F.isnan(a.cast("double")) & (F.abs(a.cast("double")) < F.lit(math.inf)))
    return F.coalesce(fine & F.exists(x, lambda a: a != 0), F.lit(False))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows at length 1."""
    rows = scaled(rows)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def scaled(rows: np.ndarray) -> np.ndarray:
    """Rows times a power of two, which rounds nothing: squares of large or small numbers leave the range."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(1, keepdims=True))[1])


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as a matrix of doubles."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return values.reshape(len(column), -1)


def _by_length(column: pa.Array):
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        yield int(d), at, unit(matrix(column.take(pa.array(at))))


def turning(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vector, the directions of the second moments, largest first.

    Tasks add up products of their batches; d * d numbers come back for each length d.
    """
    def moments(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [[], [], [], []]
        for d, _, u in _by_length(batch.column("v")):
            i, j = np.triu_indices(d)
            for column, values in zip(out, (np.full(len(i), d), i, j, (u.T @ u)[i, j])):
                column.append(values)
        d, i, j, x = (np.concatenate(c) for c in out)
        return pa.RecordBatch.from_pydict({"d": d.astype(np.int32), "i": i.astype(np.int32), "j": j.astype(np.int32), "x": x})

    sums = map_batches(vectors.select("v"), moments, "d int, i int, j int, x double").groupBy("d", "i", "j").agg(F.sum("x").alias("x"))
    found = {}
    for d, own in sums.toPandas().groupby("d"):
        m = np.zeros((d, d))
        m[own["i"], own["j"]] = m[own["j"], own["i"]] = own["x"]
        found[int(d)] = np.ascontiguousarray(np.linalg.eigh(m)[1][:, ::-1])
    return found


def _boxes(rows: DataFrame, tile_rows: int) -> DataFrame:
    """(key, tile): boxes cut at quantiles of one leading component after the other until they are small.

    What equal components keep together is dealt over tiles with the same box by a hash.
    """
    rows = cut(rows.withColumn("tile", F.col("grp")))
    for level in range(LEAD):
        steps_ = [i / FAN for i in range(1, FAN)]
        # As many slabs as it takes, but no more than FAN: every cut, every second, fourth or eighth.
        every = F.greatest(F.lit(1.0), F.lit(float(FAN)) / F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n") / F.lit(tile_rows)))))
        sizes = rows.groupBy("tile").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(F.col("lead")[level], steps_).alias("cuts"))
        large = cut(sizes.filter(F.col("n") > tile_rows).select("tile", F.filter("cuts", lambda _, i: (i + 1) % every == 0).alias("cuts")))
        if large.isEmpty():
            break
        slab = F.size(F.filter("cuts", lambda c: c < F.col("lead")[level]))
        rows = cut(look_up(rows, "tile", large, frequent_keys(rows, "tile")).withColumn(
            "tile", F.when(F.col("cuts").isNull(), F.col("tile")).otherwise(F.concat_ws(".", "tile", slab))).drop("cuts"))
    sizes = rows.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / F.lit(tile_rows)).cast("int").alias("parts")).filter("parts > 1")
    dealt = look_up(rows, "tile", sizes, frequent_keys(rows, "tile"))
    part = F.pmod(F.xxhash64("key"), F.col("parts"))
    return dealt.select("key", F.when(F.col("parts").isNull(), F.col("tile")).otherwise(F.concat(F.col("tile"), F.lit(".part"), part)).alias("tile"))


def _tiles(vectors: DataFrame, axes: dict[int, np.ndarray], tile_rows: int) -> DataFrame:
    """One row a tile: its vectors, what they stand for, and its box in the leading components."""
    def lead(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = np.zeros((batch.num_rows, LEAD))
        for d, at, u in _by_length(batch.column("v")):
            y = u @ axes[d][:, :LEAD]
            out[at, :y.shape[1]] = y
        column = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), LEAD).cast(pa.list_(pa.float64()))
        return pa.RecordBatch.from_pydict({"key": batch.column("key"), "grp": batch.column("grp"), "lead": column})

    placed = map_batches(vectors.select("key", "grp", "v"), lead, "key string, grp string, lead array<double>")
    boxes = _boxes(placed, tile_rows)

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("key")
        v = np.stack([np.asarray(x, np.float64) for x in frame["v"]])
        y = np.zeros((len(v), LEAD))
        turned = unit(v) @ axes[v.shape[1]][:, :LEAD]
        y[:, :turned.shape[1]] = turned
        row = {"tile": frame["tile"].iloc[0], "grp": frame["grp"].iloc[0], "low": y.min(0).tolist(), "high": y.max(0).tolist(),
               "keys": frame["key"].tolist(), "times": frame["times"].tolist(), "v": v.tobytes()}
        return pd.DataFrame([row])

    return cut(vectors.join(boxes, "key").groupBy("tile").applyInPandas(
        pack, "tile string, grp string, low array<double>, high array<double>, keys array<string>, "
              "times array<long>, v binary"))


def _meetings(tiles: DataFrame, near: float) -> DataFrame:
    """(a, b), a <= b: tiles of one group whose boxes come within ``near``, found by going down box by box."""
    meta = tiles.select("tile", "grp", F.split("tile", r"\.").alias("path"), "low", "high")
    depth = meta.agg(F.max(F.size("path"))).first()[0] or 0  # one number
    pairs = meta.select(F.col("grp").alias("a"), F.col("grp").alias("b")).distinct()

    def prefix(n: int):
        return F.when(F.size("path") <= n, F.col("tile")).otherwise(F.array_join(F.slice("path", 1, n), "."))

    for level in range(1, depth):
        boxes = meta.groupBy(prefix(level).alias("up"), prefix(level + 1).alias("box")).agg(
            *[F.min(F.col("low")[i]).alias(f"l{i}") for i in range(LEAD)], *[F.max(F.col("high")[i]).alias(f"h{i}") for i in range(LEAD)])

        def side(s: str) -> DataFrame:
            return boxes.select(*[F.col(c).alias(s if c == "up" else s + c) for c in boxes.columns])

        gap = reduce(lambda x, y: x + y, [
            F.pow(F.greatest(F.col(f"al{i}") - F.col(f"bh{i}"), F.col(f"bl{i}") - F.col(f"ah{i}"), F.lit(0.0)), 2) for i in range(LEAD)])
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        pairs = cut(both.filter((gap <= near * near + SLACK) & ((F.col("a") != F.col("b")) | (F.col("abox") <= F.col("bbox"))))
                    .select(F.col("abox").alias("a"), F.col("bbox").alias("b")))
    return pairs


class Forest:
    """Smallest member of each connected set of numbered nodes, as edges come in."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while (up := self.root[self.root]).tolist() != self.root.tolist():
                self.root = up


def _pairs_in(ya, yb, va, vb, threshold: float, same: bool):
    """Blocks of (i, j) of rows whose cosine reaches the threshold; within one tile i < j."""
    d = ya.shape[1]
    ends = sorted({min(d, max(1, d // 4)), min(d, max(1, d // 2)), d})
    tail_a, tail_b = ([np.sqrt(np.maximum(0.0, (y[:, e:] ** 2).sum(1))) for e in ends] for y in (ya, yb))
    for s in range(0, len(ya), BLOCK):
        for t in range(s if same else 0, len(yb), BLOCK):
            a, b = slice(s, s + BLOCK), slice(t, t + BLOCK)
            total = ya[a, :ends[0]] @ yb[b, :ends[0]].T
            alive = total + np.outer(tail_a[0][a], tail_b[0][b]) >= threshold - SLACK
            if same and s == t:
                alive &= np.triu(np.ones_like(alive), 1)
            i, j = np.nonzero(alive)
            sums = total[i, j]
            for k in range(1, len(ends)):
                if not len(i):
                    break
                lo, hi = ends[k - 1], ends[k]
                if len(i) * 16 > total.size:  # many are left: the whole block is faster
                    sums = sums + (ya[a, lo:hi] @ yb[b, lo:hi].T)[i, j]
                else:
                    sums = sums + np.einsum("ij,ij->i", ya[a, lo:hi][i], yb[b, lo:hi][j])
                keep = sums + tail_a[k][a][i] * tail_b[k][b][j] >= threshold - SLACK
                i, j, sums = i[keep], j[keep], sums[keep]
            close = np.abs(sums - threshold) <= SLACK
            if close.any():
                p, q = va[a][i[close]], vb[b][j[close]]
                sums[close] = np.einsum("ij,ij->i", p, q) / (np.linalg.norm(p, axis=1) * np.linalg.norm(q, axis=1))
            ok = sums >= threshold
            if ok.any():
                yield i[ok] + s, j[ok] + t


def _compare(batch: pa.RecordBatch, axes: dict[int, np.ndarray], threshold: float) -> pa.RecordBatch:
    keys, links, roots = [], [], []
    reach = math.sqrt(max(0.0, 2.0 - 2.0 * threshold))
    for row in batch.to_pylist():
        same = row["a"] == row["b"]
        na, nb = len(row["akeys"]), len(row["bkeys"])
        va = np.frombuffer(row["av"]).reshape(na, -1)
        vb = va if same else np.frombuffer(row["bv"]).reshape(nb, -1)
        va, vb = scaled(va), scaled(vb)
        ya, yb = (unit(x) @ axes[x.shape[1]] for x in (va, vb))
        ta, tb = np.array(row["atimes"]), np.array(row["btimes"])
        own, other = np.zeros(na, np.int64), np.zeros(nb, np.int64)
        forest = Forest(na if same else na + nb)
        ma, mb = ya.mean(0), yb.mean(0)
        far = np.linalg.norm(ma - mb) + np.linalg.norm(ya - ma, axis=1).max() + np.linalg.norm(yb - mb, axis=1).max()
        if far <= reach - 1e-6:
            own += tb.sum() - (ta if same else 0)
            other += ta.sum()
            forest.root[:] = 0
        else:
            for i, j in _pairs_in(ya, yb, va, vb, threshold, same):
                np.add.at(own, i, tb[j])
                np.add.at(own if same else other, j, ta[i])
                forest.join(i, j if same else j + na)
        names = np.array(row["akeys"] if same else row["akeys"] + row["bkeys"], object)
        n = own if same else np.concatenate([own, other])
        linked = np.flatnonzero(n)
        keys += names[linked].tolist()
        links += n[linked].tolist()
        roots += names[forest.root[linked]].tolist()
    return_memory()
    return pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.string()), "n": pa.array(links, pa.int64()), "root": pa.array(roots, pa.string())})


def near_copies(vectors: DataFrame, *, threshold: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding",
                label_col: str = "label", tile_rows: int = TILE_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each input row.

    Two rows link if their labels are equal and not NULL and the cosine of their vectors, of one
    length, is at least ``threshold`` (above 0); NULL, zero and empty vectors and those with
    NULL or non-finite components link with nothing.  ``n_links`` counts the other rows
    linked, repeated rows each.  ``component_id`` is the smallest id reachable by links, the
    row's own included.  Rows without id count and link like others; ``kept`` is NULL for
    them, and so is the component if it holds no id.  An empty table gives no rows; other
    columns are not read.
    """
    if not 0.0 < threshold <= 1.0:
        raise ValueError("the threshold must be above 0 and at most 1")
    spark = bounded_batches(vectors.sparkSession)
    with steps(spark) as own:
        taken = finite(vec_col) & F.col(label_col).isNotNull()
        v = F.when(taken, F.transform(vec_col, lambda a: a.cast("double") + F.lit(0.0)))
        rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), v.alias("v"))
        rows = cut(rows.withColumn("key", F.when(F.col("v").isNotNull(), F.sha2(F.concat_ws(",", "label", F.col("v").cast("array<string>")), 256))))
        grp = F.concat(F.sha2("label", 256), F.lit("-"), F.size("v"))
        copies = cut(rows.filter("key is not null").groupBy("key").agg(
            F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("times"), F.first("v").alias("v"), F.first(grp).alias("grp")))
        axes = turning(copies)
        if axes:
            tile_rows = max(1, min(tile_rows, TILE_BYTES // (8 * max(axes))))
        tiles = _tiles(copies, axes, tile_rows)
        pairs = cut(_meetings(tiles, math.sqrt(2.0 - 2.0 * threshold)))
        meet = max(1, pairs.count())

        def side(s: str) -> DataFrame:
            return tiles.select(F.col("tile").alias(s), *[F.col(c).alias(s + c) for c in ("keys", "times", "v")])

        # As many partitions as meetings: a partition's size says nothing of its work.
        full = pairs.join(side("a"), "a").repartition(meet, "b").join(side("b").repartition(meet, "b"), "b")
        found = cut(map_batches(full, lambda batch: _compare(batch, axes, threshold), "key string, n long, root string"))
        links = found.groupBy("key").agg(F.sum("n").alias("n"))
        classes = cut(connected_components(copies.select("key"), found.select(F.col("key").alias("src"), F.col("root").alias("dst")), "key")
                      .join(copies.select("key", "rep", "times"), "key").join(links, "key", "left"))
        lowest = classes.groupBy("component").agg(F.min("rep").alias("lowest"))
        classes = look_up(classes, "component", lowest, frequent_keys(classes, "component")) \
            .select("key", "lowest", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"))
        named = look_up(rows.select("vec_id", "key"), "key", classes, frequent_keys(rows, "key"))
        component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("lowest"))
        return own.keep(named.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                                     component.alias("component_id"), (F.col("vec_id") == component).alias("kept")))
