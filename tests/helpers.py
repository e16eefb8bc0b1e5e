"""Brute-force answers on small tables."""

import numpy as np
import pandas as pd


def cloud(n, seed, hot=False):
    """Points in a 500 km square; ``hot`` puts a third of them in one spot, some in one place."""
    rng = np.random.default_rng(seed)
    xy = rng.uniform(0, 500, (n, 2))
    if hot:
        third = n // 3
        xy[:third] = rng.normal([100, 100], 0.05, (third, 2))
        xy[third:third + third // 4] = [333.0, 44.0]
    return xy


def distances(a, b):
    return np.round(np.sqrt(((a[:, None, :] - b[None]) ** 2).sum(-1)), 9)


def table(spark, xy, key, **cols):
    return spark.createDataFrame(pd.DataFrame({key: np.arange(len(xy)), "x": xy[:, 0], "y": xy[:, 1], **cols}))


def as_degrees(df, key):
    """Plane kilometres as degrees around latitude 0, for operators that project."""
    return df.selectExpr(key, "x / 111.32 as lon", "y / 111.32 as lat")
