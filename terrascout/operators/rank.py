"""Global ranks, running sums, quantiles and ranking metrics.

A window without PARTITION BY sends every row to one task.  ``cumulate`` deals the
rows out by ranges of (key, id) instead, sums the pieces, and runs the window inside
the pieces; equal keys are cut by their ids.  All metrics below build on it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrascout.session import cut, steps

PIECE_ROWS = 500_000  # rows one window task should sort
SELECT_ROWS = 100_000  # rows left around a wanted rank that one task may sort
SELECT_GROUPS = 10_000  # groups whose intervals are broadcast
SELECT_ROUNDS = 8     # refinements of a histogram
BINS = 1024           # bins of one refinement
MAX_PIECES = 20_000   # bound on ranges; every offset table has at most a few times as many rows per group


def _pieces(df: DataFrame, order: Sequence[str], piece_rows: int) -> DataFrame:
    """Rows with ``_b``, the number of their range of ``order``; written, so that the ranges hold for all readers.

    Columns are compared in their own types; NULL has its place first and NaN last.
    The rows lie on disk once: the table that ranges are cut from goes when they are written.
    """
    with steps(df.sparkSession) as own:
        staged = cut(df)
        pieces = min(MAX_PIECES, math.ceil(staged.count() / piece_rows))
        if pieces > 1:
            return own.keep(staged.repartitionByRange(pieces, *order).withColumn("_b", F.spark_partition_id()))
        own.release()
    return staged.withColumn("_b", F.lit(0))


def cumulate(df: DataFrame, key: str, id_col: str, sums: dict[str, Column] | None = None, *,
             by: Sequence[str] = (), desc: bool = False, most: dict[str, Column] | None = None,
             piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Rows with ``rn`` (1-based rank by key, then id) and inclusive running sums.

    Adds ``rn``, ``n`` (rows of the group), ``cum_<name>`` and ``tot_<name>`` for
    every entry of ``sums``, and ``max_<name>`` of the group for every entry of ``most``.
    ``by`` restarts the order per group.  ``key`` counts as
    double; NULL keys come first and NaN last in either direction.  ``id_col`` breaks
    ties in its own type and is ascending always.
    """
    sums, most = sums or {}, most or {}
    value = F.col(key).cast("double")
    df = df.withColumn("_k", F.when(F.isnan(value), value).otherwise(-value) if desc else value)
    df = _pieces(df.withColumns({f"_s_{n}": c for n, c in sums.items()} | {f"_m_{n}": c for n, c in most.items()}), [*by, "_k", id_col], piece_rows)

    names = list(sums)
    groups = [*by, "_b"]
    part = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("_pn"),
                                   *[F.sum(f"_s_{n}").alias(f"_p_{n}") for n in names],
                                   *[F.max(f"_m_{n}").alias(f"_q_{n}") for n in most])
    # Offsets: at most MAX_PIECES rows per group.
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumns({
        "_on": F.coalesce(F.sum("_pn").over(before), F.lit(0)),
        "_tn": F.sum("_pn").over(whole),
        **{f"_o_{n}": F.coalesce(F.sum(f"_p_{n}").over(before), F.lit(0)) for n in names},
        **{f"_t_{n}": F.sum(f"_p_{n}").over(whole) for n in names},
        **{f"max_{n}": F.max(f"_q_{n}").over(whole) for n in most},
    }).select(*groups, "_on", "_tn", *[f"_o_{n}" for n in names], *[f"_t_{n}" for n in names], *[f"max_{n}" for n in most])

    if by:
        # NULL group keys must meet again after the split.
        cond = [df[g].eqNullSafe(part[g]) for g in groups]
        joined = df.join(part, cond).select(
            df["*"], *[part[c] for c in part.columns if c not in groups])
    else:
        joined = df.join(part, groups)
    inner = Window.partitionBy(*groups).orderBy("_k", id_col)
    run = inner.rowsBetween(Window.unboundedPreceding, 0)
    ranked = joined.withColumns({
        "rn": F.col("_on") + F.row_number().over(inner),
        "n": F.col("_tn"),
        **{f"cum_{n}": F.col(f"_o_{n}") + F.sum(f"_s_{n}").over(run) for n in names},
        **{f"tot_{n}": F.col(f"_t_{n}") for n in names},
    })
    return ranked.drop("_k", "_b", "_on", "_tn", *[f"_s_{n}" for n in names], *[f"_m_{n}" for n in most],
                       *[f"_o_{n}" for n in names], *[f"_t_{n}" for n in names])


# -------------------------------------------------------------- per-score table

def score_table(df: DataFrame, score: str, label: str | None = None,
                by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """One row per distinct score with counts and strict prefix counts.

    Columns: score, cnt, pos, below (rows with a smaller score), pos_below,
    n (all rows), n_pos.  Ties collapse before the shuffle.
    """
    w = F.col(weight) if weight else F.lit(1)
    p = F.when(F.col(label) == 1, w).otherwise(0) if label else F.lit(0)
    table = (df.filter(F.col(score).isNotNull())
             .withColumns({"_w": w, "_p": p})
             .groupBy(*by, F.col(score).cast("double").alias("score"))
             .agg(F.sum("_w").alias("cnt"), F.sum("_p").alias("pos")))
    ranked = cumulate(table, "score", "score",
                      {"cnt": F.col("cnt"), "pos": F.col("pos")}, by=by)
    return ranked.select(
        *by, "score", "cnt", "pos",
        (F.col("cum_cnt") - F.col("cnt")).alias("below"),
        (F.col("cum_pos") - F.col("pos")).alias("pos_below"),
        F.col("tot_cnt").alias("n"), F.col("tot_pos").alias("n_pos"))


def pct_strict(df: DataFrame, score: str, out: str = "pct", piece_rows: int = PIECE_ROWS) -> DataFrame:
    """100 * share of all scores strictly below the row's score; NULL for NULL scores.

    The rank within a range is enough but for scores that began in an earlier one;
    those take the place where the first range that ends with them reached them.
    """
    keyed = df.withColumns({"_k": F.col(score).cast("double"), "_t": F.monotonically_increasing_id()})
    some = _pieces(keyed.filter(F.col("_k").isNotNull()), ["_k", "_t"], piece_rows)
    ranked = cut(some.withColumn("_r", F.rank().over(Window.partitionBy("_b").orderBy("_k")) - 1))
    before = Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    part = ranked.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"), F.min("_k").alias("_lo"), F.max("_k").alias("_hi"),
                                    F.max("_r").alias("_top")).withColumn("_on", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    part = cut(part.withColumn("_all", F.sum("_n").over(Window.partitionBy(F.lit(0)))))
    reached = part.groupBy(F.col("_hi").alias("_lo")).agg(F.min(F.col("_on") + F.col("_top")).alias("_at"))
    starts = part.join(reached, "_lo", "left").select(
        "_b", F.col("_lo").alias("_first"), "_on", "_all", F.least(F.coalesce("_at", "_on"), "_on").alias("_begin"))
    below = F.when(F.col("_k") == F.col("_first"), F.col("_begin")).otherwise(F.col("_on") + F.col("_r"))
    known = ranked.join(starts, "_b").withColumn(out, 100.0 * below / F.col("_all")).select(*df.columns, out)
    rest = df.filter(F.col(score).cast("double").isNull()).withColumn(out, F.lit(None).cast("double"))
    return known.unionByName(rest)


def pct_ordinal(df: DataFrame, score: str, id_col: str, out: str = "pct") -> DataFrame:
    """100 * rank / (n - 1) with ranks from 0, ties by id; 0 for a single row."""
    ranked = cumulate(df, score, id_col)
    return (ranked.withColumn(out, F.when(F.col("n") > 1, 100.0 * (F.col("rn") - 1) / (F.col("n") - 1))
                              .otherwise(0.0))
            .drop("rn", "n"))


def auroc(df: DataFrame, score: str, label: str, by: Sequence[str] = (),
          weight: str | None = None) -> DataFrame:
    """Tie-averaged rank statistic; NULL when a group has only one class."""
    return auroc_from(score_table(df, score, label, by, weight), by)


def auroc_from(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    neg_below = F.col("below") - F.col("pos_below")
    ties = F.col("cnt") - F.col("pos")
    return (table.groupBy(*by).agg(
        F.sum(F.col("pos") * (neg_below + ties / 2)).alias("_u"),
        F.max("n").alias("n"), F.max("n_pos").alias("n_pos"))
        .select(*by, F.col("n").cast("bigint").alias("n"), F.col("n_pos").cast("bigint").alias("n_pos"),
                (F.col("_u") / F.nullif(F.col("n_pos") * (F.col("n") - F.col("n_pos")), F.lit(0)))
                .alias("auroc")))


def _curve(table: DataFrame) -> DataFrame:
    """Precision and recall when everything scoring >= ``score`` is called positive."""
    tp = F.col("n_pos") - F.col("pos_below")
    called = F.col("n") - F.col("below")
    return table.withColumns({
        "precision": tp / called,
        "recall": F.when(F.col("n_pos") > 0, tp / F.col("n_pos")).otherwise(0.0)})


def auprc_from(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sum of recall steps times precision; NULL without a positive."""
    step = F.col("pos") / F.nullif(F.col("n_pos"), F.lit(0))
    return _curve(table).groupBy(*by).agg(F.sum(step * F.col("precision")).alias("auprc"))


def auprc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    return auprc_from(score_table(df, score, label, by), by)


def best_f1_from(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Largest F1 over all thresholds and the lowest threshold that reaches it."""
    f1 = (2 * F.col("precision") * F.col("recall")
          / (F.col("precision") + F.col("recall") + F.lit(1e-12)))
    best = F.max(F.struct(F.round("_f1", 12).alias("f"), (-F.col("score")).alias("s")))
    return (_curve(table).withColumn("_f1", f1).groupBy(*by).agg(best.alias("_m"))
            .select(*by, F.col("_m.f").alias("f1"), (-F.col("_m.s")).alias("best_threshold")))


def best_f1(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Best F1 over every distinct score as the threshold."""
    return best_f1_from(score_table(df, score, label, by), by)


def best_f1_at(df: DataFrame, score: str, label: str, thresholds: int = 200) -> DataFrame:
    """Best F1 over evenly spaced quantiles between 1 % and 99 %, whatever the number of scores.

    The first best threshold wins; 0 and 0.5 are reported when none beats 0.
    """
    table = cut(score_table(df, score, label))
    marks = _quantile_values(table, [0.01 + 0.98 * i / (thresholds - 1) for i in range(thresholds)])
    # ``thresholds`` numbers, each with the rows that score below it.
    grid = marks.select("t").distinct()
    bounds = sorted(r[0] for r in grid.collect())
    steps = table.withColumn("_z", F.explode(F.filter(F.array(*[F.lit(float(t)) for t in bounds]), lambda t: F.col("score") < t))) \
        .groupBy(F.col("_z").alias("t")).agg(F.max(F.col("below") + F.col("cnt")).alias("_b"), F.max(F.col("pos_below") + F.col("pos")).alias("_pb"))
    totals = table.agg(F.max("n").alias("n"), F.max("n_pos").alias("n_pos"))
    called = grid.join(steps, "t", "left").join(F.broadcast(totals))  # one row
    tp = F.col("n_pos") - F.coalesce("_pb", F.lit(0))
    k = F.col("n") - F.coalesce("_b", F.lit(0))
    f = F.when(k > 0, 2 * tp / (k + F.col("n_pos"))).otherwise(0.0)
    best = called.agg(F.max(F.struct(F.round(f, 12).alias("f"), (-F.col("t")).alias("s"))).alias("m"))
    return best.select(F.col("m.f").alias("f1"), F.when(F.col("m.f") > 0, -F.col("m.s")).otherwise(0.5).alias("best_threshold"))


def top_sizes(fraction: float, rounding: str = "ceil") -> Column:
    """How many rows the top ``fraction`` of ``n`` holds, at least one."""
    size = F.col("n") * F.lit(float(fraction))
    # A product such as 0.1 * 10 must not round up past the exact value.
    whole = F.ceil(F.round(size, 9)) if rounding == "ceil" else F.floor(F.round(size, 9))
    return F.greatest(F.lit(1), whole.cast("bigint"))


def capture(df: DataFrame, score: str, label: str, id_col: str,
            fractions: Sequence[float] = (0.01, 0.05, 0.10, 0.25), rounding: str = "ceil",
            by: Sequence[str] = ()) -> DataFrame:
    """Share of positives among the top fraction of scores; ties by id."""
    ranked = cumulate(df.filter(F.col(score).isNotNull()), score, id_col, by=by, desc=True)
    hit = (F.col(label) == 1).cast("int")
    aggs = [F.sum(F.when(F.col("rn") <= top_sizes(f, rounding), hit).otherwise(0))
            .alias(f"_c{i}") for i, f in enumerate(fractions)]
    out = ranked.groupBy(*by).agg(F.sum(hit).alias("_p"), *aggs)
    return out.select(*by, *[
        (F.col(f"_c{i}") / F.greatest(F.col("_p"), F.lit(1)))
        .alias(f"capture_top_{round(f * 100)}pct") for i, f in enumerate(fractions)])


def precision_recall_at(df: DataFrame, score: str, label: str, id_col: str, k: int = 50,
                        by: Sequence[str] = ()) -> DataFrame:
    ranked = cumulate(df.filter(F.col(score).isNotNull()), score, id_col, by=by, desc=True)
    hit = (F.col(label) == 1).cast("int")
    return (ranked.groupBy(*by).agg(
        F.sum(F.when(F.col("rn") <= k, hit).otherwise(0)).alias("_h"),
        F.least(F.max("n"), F.lit(k)).alias("_k"), F.sum(hit).alias("_p"))
        .select(*by, (F.col("_h") / F.col("_k")).alias("precision_at_k"),
                (F.col("_h") / F.greatest(F.col("_p"), F.lit(1))).alias("recall_at_k")))


def metric_bundle(df: DataFrame, score: str, label: str, id_col: str, k: int = 50,
                  by: Sequence[str] = ()) -> DataFrame:
    """AUROC, AUPRC, best F1, precision/recall at k and capture rates per group.

    Curve metrics share one score table, top-k metrics one ranking.
    """
    df = df.filter(F.col(score).isNotNull())
    keys = list(by) or ["_all"]
    df = df if by else df.withColumn("_all", F.lit(1))
    df = df.select(*dict.fromkeys([*keys, score, label, id_col]))  # the ranking writes its rows
    table = cut(score_table(df, score, label, keys))
    ranked = cumulate(df, score, id_col, by=keys, desc=True)
    hit = (F.col(label) == 1).cast("int")
    fractions = (0.01, 0.05, 0.10, 0.25)
    tops = ranked.groupBy(*keys).agg(
        F.sum(hit).alias("_p"), F.least(F.max("n"), F.lit(k)).alias("_k"),
        F.sum(F.when(F.col("rn") <= k, hit).otherwise(0)).alias("_h"),
        *[F.sum(F.when(F.col("rn") <= top_sizes(f), hit).otherwise(0)).alias(f"_c{i}")
          for i, f in enumerate(fractions)])
    pos = F.greatest(F.col("_p"), F.lit(1))
    tops = tops.select(*keys, (F.col("_h") / F.col("_k")).alias("precision_at_k"),
                       (F.col("_h") / pos).alias("recall_at_k"),
                       *[(F.col(f"_c{i}") / pos).alias(f"capture_top_{round(f * 100)}pct")
                         for i, f in enumerate(fractions)])
    out = (auroc_from(table, keys).join(auprc_from(table, keys), keys)
           .join(best_f1_from(table, keys), keys).join(tops, keys))
    return out if by else out.drop("_all")


# -------------------------------------------------------------------- quantiles

def quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (),
              names: Sequence[str] | None = None, *, select_rows: int = SELECT_ROWS) -> DataFrame:
    """Exact, linearly interpolated quantiles per group, selected by refined histograms.

    No rows are sorted or shuffled while more than ``select_rows`` are left around a wanted rank:
    each round counts ``BINS`` bins of its interval and goes on with the one that holds it,
    between that bin's least and largest value.  -inf comes first, then numbers, inf, NaN;
    NULLs don't count.  With more than ``SELECT_GROUPS`` groups all values are ranked instead.
    """
    names = names or [f"q{round(100 * p)}" for p in probs]
    keys = [f"_g{i}" for i in range(len(by))]
    spark, v, inf = df.sparkSession, F.col("_v"), F.lit(math.inf)
    real = ~F.isnan("_v") & (F.abs("_v") < inf)
    with steps(spark) as own:
        rows = cut(df.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(value).cast("double").alias("_v")).filter(v.isNotNull()))
        counts = cut(rows.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"), F.count_if(v == -inf).alias("below"), F.count_if(real).alias("m"), F.count_if(v == inf).alias("above"),
            F.min(F.when(real, v)).alias("lo"), F.max(F.when(real, v)).alias("hi")).filter("n > 0"))
        if counts.count() > SELECT_GROUPS:
            return own.keep(_ranked_quantiles(rows, keys, probs, by, names))
        wanted = []
        for i, p in enumerate(probs):
            at = (F.col("n") - 1) * F.lit(float(p))
            wanted += [F.struct(F.lit(2 * i + s).alias("t"), f(at).cast("long").alias("r")) for s, f in enumerate((F.floor, F.ceil))]
        first = counts.withColumn("w", F.explode(F.array(*wanted)))
        need = F.col("w.r") - F.col("below")
        beyond = F.when(need < 0, -inf).when(need >= F.col("m") + F.col("above"), F.lit(math.nan)).when(need >= F.col("m"), inf)
        state = cut(first.select(*keys, F.col("w.t").alias("t"), need.alias("need"), F.when(beyond.isNull(), F.col("m")).otherwise(F.lit(0)).alias("m"),
                                 F.coalesce(beyond, "lo").alias("lo"), F.coalesce(beyond, "hi").alias("hi")))

        def around(targets: DataFrame) -> DataFrame:
            """Rows in the interval of each target; there are at most SELECT_GROUPS times the probabilities, twice."""
            few = targets.withColumnsRenamed({k: f"{k}_" for k in keys})
            same = [rows[k].eqNullSafe(few[f"{k}_"]) for k in keys]
            return rows.join(F.broadcast(few), [*same, rows["_v"].between(few["lo"], few["hi"])]).drop(*[f"{k}_" for k in keys])

        for _ in range(SELECT_ROUNDS):
            wide = (F.col("lo") < F.col("hi")) & (F.col("m") > select_rows)
            if state.filter(wide).isEmpty():
                break
            # Shares of the halves, as the whole range may be beyond the largest number.
            share = F.try_divide(v / BINS - F.col("lo") / BINS, F.col("hi") / BINS - F.col("lo") / BINS)
            bin_ = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * BINS), F.lit(BINS - 1))
            bins = around(state.filter(wide)).groupBy(*keys, "t", "need", bin_.alias("b")).agg(
                F.count(F.lit(1)).alias("m"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
            upto = F.sum("m").over(Window.partitionBy(*keys, "t").orderBy("b").rowsBetween(Window.unboundedPreceding, 0))
            chosen = bins.withColumn("upto", upto).filter((F.col("upto") > F.col("need")) & (F.col("upto") - F.col("m") <= F.col("need")))
            narrow = chosen.select(*keys, "t", (F.col("need") - F.col("upto") + F.col("m")).alias("need"), "m", "lo", "hi")
            state = cut(state.filter(~wide).unionByName(narrow))
        settled = state.filter(~(F.col("lo") < F.col("hi"))).select(*keys, "t", F.col("lo").alias("x"))
        left = around(state.filter(F.col("lo") < F.col("hi"))).groupBy(*keys, "t", "need", "_v").agg(F.count(F.lit(1)).alias("c"))
        if (state.agg(F.max(F.when(F.col("lo") < F.col("hi"), F.col("m")))).first()[0] or 0) <= select_rows:
            placed = left.withColumn("cum_c", F.sum("c").over(Window.partitionBy(*keys, "t").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))
        else:
            placed = cumulate(left, "_v", "_v", {"c": F.col("c")}, by=[*keys, "t"])
        picked = placed.filter((F.col("cum_c") > F.col("need")) & (F.col("cum_c") - F.col("c") <= F.col("need"))).select(*keys, "t", F.col("_v").alias("x"))
        ends = settled.unionByName(picked).groupBy(*keys).agg(*[F.max(F.when(F.col("t") == i, F.col("x"))).alias(f"_e{i}") for i in range(2 * len(probs))])
        few = ends.withColumnsRenamed({k: f"{k}_" for k in keys})
        both = counts.join(few, [counts[k].eqNullSafe(few[f"{k}_"]) for k in keys]) if keys else counts.crossJoin(few)  # one row each
        cols = []
        for i, (p, nm) in enumerate(zip(probs, names)):
            at = (F.col("n") - 1) * F.lit(float(p))
            low, high = F.col(f"_e{2 * i}"), F.col(f"_e{2 * i + 1}")
            cols.append(F.when(low == high, low).otherwise(low + (high - low) * (at - F.floor(at))).alias(nm))
        return own.keep(both.select(*[F.col(k).alias(c) for c, k in zip(by, keys)], *cols))


def _ranked_quantiles(rows: DataFrame, keys: Sequence[str], probs: Sequence[float], by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """The same from a running count over all distinct values."""
    ranked = cumulate(rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_m")), "_v", "_v", {"m": F.col("_m")}, by=keys)
    aggs = []
    for i, p in enumerate(probs):
        at = (F.col("tot_m") - 1) * F.lit(float(p))
        low, high = F.floor(at), F.ceil(at)
        first, last = F.col("cum_m") - F.col("_m"), F.col("cum_m") - 1
        aggs += [F.max(F.when(low.between(first, last), F.col("_v"))).alias(f"_l{i}"),
                 F.max(F.when(high.between(first, last), F.col("_v"))).alias(f"_h{i}"),
                 F.max(at - low).alias(f"_w{i}")]
    out = ranked.groupBy(*keys).agg(*aggs)
    cols = [(F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * F.col(f"_w{i}")).alias(nm)
            for i, nm in enumerate(names)]
    return out.select(*[F.col(k).alias(c) for c, k in zip(by, keys)], *cols)


def _quantile_values(table: DataFrame, probs: Sequence[float]) -> DataFrame:
    """Quantiles of the scores in a score table, one row ``t`` each.

    Every score picks the probabilities whose position it covers.
    """
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    first, last = F.col("below"), F.col("below") + F.col("cnt") - 1

    def at(p: Column) -> Column:
        return p * (F.col("n") - 1)

    hits = F.filter(wanted, lambda p: F.floor(at(p)).between(first, last) | F.ceil(at(p)).between(first, last))
    rows = table.withColumn("_q", F.explode(hits))
    low, high = F.floor(at(F.col("_q"))), F.ceil(at(F.col("_q")))
    ends = rows.groupBy("_q").agg(F.max(F.when(low.between(first, last), F.col("score"))).alias("_l"),
                                  F.max(F.when(high.between(first, last), F.col("score"))).alias("_h"),
                                  F.max(at(F.col("_q")) - low).alias("_w"))
    return ends.select((F.col("_l") + (F.col("_h") - F.col("_l")) * F.col("_w")).alias("t"))


# ------------------------------------------------------------------ other ranks

def running(df: DataFrame, order: str, id_col: str, cols: Sequence[str]) -> DataFrame:
    """Rank by ``order`` descending with running totals of ``cols``."""
    out = cumulate(df, order, id_col, {c: F.col(c) for c in cols}, desc=True)
    return out.drop("n", *[f"tot_{c}" for c in cols])


def running_by(df: DataFrame, order: str, id_col: str, group: str, value: str,
               groups: Sequence[str]) -> DataFrame:
    """Running contribution of each listed group along the global rank."""
    share = {f"g{i}": F.when(F.col(group) == g, F.col(value)).otherwise(0.0)
             for i, g in enumerate(groups)}
    ranked = cumulate(df, order, id_col, share, desc=True)
    pairs = F.array(*[F.struct(F.lit(g).alias("g"), F.col(f"cum_g{i}").alias("v"))
                      for i, g in enumerate(groups)])
    return (ranked.select("rn", F.explode(pairs).alias("_e"))
            .select(F.col("rn").alias("rank"), F.col("_e.g").alias(group),
                    F.col("_e.v").alias("running")))


def top_n(df: DataFrame, order: str, id_col: str, n: int) -> DataFrame:
    """The n largest rows with a 1-based rank (L2)."""
    head = df.orderBy(F.desc(order), F.asc(id_col)).limit(n)
    return head.withColumn(
        "rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(order), F.asc(id_col))))


def first_match(df: DataFrame, key: str, order: str, cols: Sequence[str]) -> DataFrame:
    """The first row per key in ``order``; combines before the shuffle."""
    best = F.min(F.struct(order, *cols)).alias("_b")
    return df.groupBy(key).agg(best).select(key, F.col(f"_b.{order}").alias(order),
                                            *[F.col(f"_b.{c}").alias(c) for c in cols])


def iou_top(df: DataFrame, a: str, b: str, id_col: str, fraction: float = 0.01) -> DataFrame:
    """|A and B| / |A or B| for the top rows of two scores (U2, floor sizes)."""
    one = cumulate(df, a, id_col, desc=True)
    one = one.withColumn("_ta", F.col("rn") <= top_sizes(fraction, "floor")).drop("rn", "n")
    two = cumulate(one, b, id_col, desc=True)
    two = two.withColumn("_tb", F.col("rn") <= top_sizes(fraction, "floor"))
    both = F.count_if(F.col("_ta") & F.col("_tb"))
    either = F.count_if(F.col("_ta") | F.col("_tb"))
    return two.agg(both.alias("n_both"), either.alias("n_either"),
                   (both / F.greatest(either, F.lit(1))).alias("iou"))


def holm(df: DataFrame, p: str, id_col: str) -> DataFrame:
    """Holm step-down adjusted p-values."""
    ranked = cumulate(df, p, id_col)
    scaled = ranked.withColumn("_a", F.col(p) * (F.col("n") - F.col("rn") + 1))
    return running_max(scaled, "rn", "_a", "p_holm").withColumn(
        "p_holm", F.least(F.lit(1.0), F.col("p_holm"))).drop("_a", "rn", "n")


def running_max(df: DataFrame, rank: str, value: str, out: str,
                piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Running maximum along a dense 1-based rank, piece by piece."""
    df = df.withColumn("_z", F.floor((F.col(rank) - 1) / F.lit(piece_rows)))
    tops = df.groupBy("_z").agg(F.max(value).alias("_m"))
    before = Window.partitionBy(F.lit(0)).orderBy("_z").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("_z", F.max("_m").over(before).alias("_c"))
    run = Window.partitionBy("_z").orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    return (df.join(tops, "_z")
            .withColumn(out, F.greatest(F.max(value).over(run), F.col("_c"))).drop("_z", "_c"))
