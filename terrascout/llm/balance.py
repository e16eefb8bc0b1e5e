"""Mixing sources to target weights by entropy balancing, with DataFrame functions only.

Each document gets a rate that differs as little as possible (in relative entropy
over words) from the uniform rate, under one word constraint for each source.
The convex dual has one multiplier for each constraint; Newton steps solve it for
all sources at once, as columns of a table with one row for each source.  Rates
are exp(multiplier); rounding makes whole copies of whole documents of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrascout.llm.common import WORD
from terrascout.session import cut

PIECE_ROWS = 4096     # rows of one window task; pieces of one source are few enough for one task at 10^10 rows
TOLERANCE = 1e-9      # relative error of a word constraint at which Newton's method ends
MAX_STEPS = 60
FILL_ROUNDS = 4       # single documents that close the gap left by rounding


def words(text: str = "text") -> Column:
    """Number of words; 0 for NULL."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sources: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Adds ``target``: weights by code-point order of ``source`` (NULL last), repeating.

    All targets together make ``share`` times all words.  A target stops at ``cap``
    times its source's words, and what it leaves is shared by weight among the rest:
    with t[s] = min(cap * size[s], weight[s] * level) the level is where the sum is
    right, so sources ordered by cap * size / weight are capped up to some point.
    """
    # One row for each source: these windows see the source table, never documents.
    line = Window.partitionBy(F.lit(0))
    order = line.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sources.withColumn("_i", F.row_number().over(order) - 1).withColumns({
        "_w": F.element_at(cycle, (F.col("_i") % len(weights) + 1).cast("int")),
        "_limit": F.lit(float(cap)) * F.col("source_size")})
    by_level = line.orderBy(F.col("_limit") / F.col("_w"), "_i")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.lit(float(share)) * F.sum("source_size").over(line)
    # The level if exactly the sources before this one are capped; the first row whose
    # own cap is not below it gives the level.
    level = (total - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))) / F.sum("_w").over(after)
    reached = F.struct((F.col("_limit") / F.col("_w")).alias("r"), "_i", F.col("_level").alias("level"))
    holds = F.col("_limit") / F.col("_w") >= F.col("_level") * (1 - 1e-12)
    found = ranked.withColumn("_level", level).withColumn("_level", F.min(F.when(holds, reached)).over(line)["level"])
    return found.withColumn("target", F.when(F.col("_level").isNull(), F.col("_limit"))
                            .otherwise(F.least(F.col("_limit"), F.col("_w") * F.col("_level")))) \
        .drop("_i", "_w", "_limit", "_level")


def newton(sources: DataFrame) -> DataFrame:
    """Adds ``multiplier``: the dual solution of sum(size * exp(multiplier)) = target.

    The dual's gradient is size * exp(m) - target and its Hessian size * exp(m); the
    step is damped to 1 so that no multiplier leaves the range of exp.  A source
    without words or without a target has no constraint to solve: NULL, rate 0.
    """
    solvable = (F.col("source_size") > 0) & (F.col("target") > 0)
    state = sources.withColumn("multiplier", F.when(solvable, F.lit(0.0)))
    for _ in range(MAX_STEPS // 6):
        for _ in range(6):
            now = F.col("source_size") * F.exp("multiplier")
            step = (now - F.col("target")) / now
            state = state.withColumn("multiplier", F.col("multiplier") - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), step)))
        state = cut(state)
        now = F.col("source_size") * F.exp("multiplier")
        worst = state.agg(F.max(F.abs(now - F.col("target")) / F.col("target"))).first()[0]  # one number
        if worst is None or worst <= TOLERANCE:
            return state
    raise RuntimeError(f"entropy balancing did not converge: {worst}")


def _draw(seed: int, *cols: str) -> Column:
    """A number in [0, 1) from the leading 52 bits of a hash; equal for equal values."""
    key = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), *, share: float = 1.5, cap: float = 2.0,
        seed: int = 0, piece_rows: int = PIECE_ROWS, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, taken), one row for each input row.

    ``size`` counts words, ``copies`` is a whole number of whole documents and
    ``taken = copies * size``.  Every document gets floor(rate) copies; of the rest of
    the rate, documents in the order of a hash get one more until the source's words
    are used up, and then up to ``FILL_ROUNDS`` single documents close the gap: each time
    the one whose size is nearest to it, if that brings the source nearer to its target.

    NULL texts have size 0 and are taken once at rates of 1 and more (0 words), NULL sources
    are one source, sorted last; a source without words has target 0.  Repeated rows
    are rounded one by one; an empty table gives an empty result.  Other columns are not read.
    """
    base = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(text_col).alias("size"))
               .withColumn("_u", _draw(seed, "doc_id", "source")))
    sums = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    solved = newton(targets(cut(sums), weights, share, cap)).withColumns({
        "rate": F.least(F.lit(float(cap)), F.coalesce(F.round(F.exp("multiplier"), 9), F.lit(0.0))),
        "_pieces": F.ceil(F.col("_rows") / F.lit(piece_rows))})
    solved = cut(solved.withColumns({
        "_whole": F.floor("rate"),
        "_extra": F.col("target") - F.floor("rate") * F.col("source_size")}).drop("_rows", "multiplier"))

    keyed = base.join(solved, base["source"].eqNullSafe(solved["source"])).drop(solved["source"])
    keyed = keyed.withColumn("_p", F.floor(F.col("_u") * F.col("_pieces")))
    # Hash pieces of even size: all but the one in which the words run out are decided whole.
    sums = keyed.groupBy("source", "_p").agg(F.sum("size").alias("_s"))
    upto = Window.partitionBy("source").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    start = cut(sums.withColumn("_start", F.coalesce(F.sum("_s").over(upto), F.lit(0))))
    both = keyed["source"].eqNullSafe(start["source"]) & (keyed["_p"] == start["_p"])
    placed = keyed.join(start, both).drop(start["source"], start["_p"])
    edge = F.col("_start") + F.col("_s") > F.col("_extra")
    run = Window.partitionBy("source", "_p").orderBy("_u", "doc_id", "size") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = placed.filter(edge & (F.col("_start") < F.col("_extra"))).withColumn("_end", F.col("_start") + F.sum("size").over(run))
    more = inside.withColumn("_more", (F.col("_end") <= F.col("_extra")).cast("int")).drop("_end").unionByName(
        placed.filter(~edge).withColumn("_more", F.lit(1))).unionByName(
        placed.filter(edge & (F.col("_start") >= F.col("_extra"))).withColumn("_more", F.lit(0)))
    state = cut(more.drop("_s", "_start", "_p", "_pieces"))

    # The document that fits best into what is left of each source, a few times over.
    for _ in range(FILL_ROUNDS):
        gap = state.groupBy("source").agg((F.max("_extra") - F.sum(F.col("_more") * F.col("size"))).alias("_gap"))
        open_rows = state.filter((F.col("_more") == 0) & (F.col("size") > 0) & (F.col("_whole") + 1 <= cap))
        fits = open_rows.join(gap, open_rows["source"].eqNullSafe(gap["source"])).drop(gap["source"]) \
            .filter(F.col("size") < 2 * F.col("_gap"))
        nearest = F.struct(F.abs(F.col("_gap") - F.col("size")).alias("off"), F.struct("size", "_u", "doc_id").alias("b"))
        best = cut(fits.groupBy("source").agg(F.min(nearest)["b"].alias("_b"))
                   .select(F.col("source").alias("_bs"), "_b"))
        if best.isEmpty():
            break
        hit = (F.col("_more") == 0) & F.struct("size", "_u", "doc_id").eqNullSafe(F.col("_b"))
        same = Window.partitionBy("source", "_u", "doc_id", "size").orderBy(F.lit(0))
        joined = state.join(best, state["source"].eqNullSafe(best["_bs"]), "left")
        # Of repeated rows only one is taken.
        chosen = joined.filter(hit).withColumn("_more", (F.row_number().over(same) == 1).cast("int"))
        state = cut(joined.filter(~F.coalesce(hit, F.lit(False))).unionByName(chosen).drop("_bs", "_b"))
    copies = F.least(F.lit(int(cap)), F.col("_whole") + F.col("_more")).cast("int")
    return state.withColumn("copies", copies).select(
        "doc_id", "source", "size", "source_size", "target", "rate", "copies",
        (F.col("copies") * F.col("size")).alias("taken"))
