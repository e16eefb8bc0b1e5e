"""Spelling variants by blocked Gram matrices of letter counts.

Words at most one edit apart have letter counts at most two apart in squared distance, and
that distance is |a|^2 + |b|^2 - 2ab, a product of matrices.  Blocks are words of one
length; a block meets itself and the block of the next length.  Blocks are cut further
by how many letters of each of a few groups a word has: an edit moves one letter from a
group to another, or adds one to a group, so a cell meets few others.  Large cells are
dealt over parts.  Pairs that the product keeps are verified letter by letter; a task
gives back one row for each word and meeting, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrascout.llm.common import bounded_batches, map_batches
from terrascout.operators.joins import frequent_keys, look_up
from terrascout.session import cut, steps

RUN = r"([A-Za-zÀ-ÿ]+)"
TYPOS = 199      # one run in so many loses a letter, by hash
GROUPS = 5       # groups of letters that cells are cut by
PART = 2048      # words of a cell's part
BLOCK = 1024     # rows of a Gram matrix at a time
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, run): every maximal run of letters, A-Z as a-z; NULL texts have none."""
    lower = F.translate(F.coalesce(F.col(text_col), F.lit("")), _UPPER, _LOWER)
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(F.regexp_extract_all(lower, F.lit(RUN), F.lit(1))).alias("run"))


def with_typos(found: DataFrame, every: int = TYPOS) -> DataFrame:
    """(word): runs, of which those whose hash with the document ``every`` divides lose one letter."""
    h = F.crc32(F.encode(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")), "UTF-8"))
    hashed = found.select("run", h.alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut_run = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return hashed.select(F.when(F.col("h") % F.lit(every) == 0, cut_run).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, least_length: int = 6, least_count: int = 5) -> DataFrame:
    """(word, n) of words long and frequent enough."""
    return words.filter(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")) \
        .filter(F.col("n") >= least_count)


# ---------------------------------------------------------------- meetings

def moves(groups: int) -> list[tuple[int, list[int]]]:
    """(difference in length, difference in letters of each group) between a cell and those after it that it meets."""
    def step(**by: int) -> list[int]:
        return [by.get(f"g{i}", 0) for i in range(groups)]

    own = [(0, step())]
    swaps = [(0, step(**{f"g{a}": 1, f"g{b}": -1})) for a in range(groups) for b in range(groups) if a < b]
    longer = [(1, step(**{f"g{a}": 1})) for a in range(groups)]
    return own + swaps + longer


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of code points (zeros behind the end) of a and b differ by exactly one replaced or inserted letter.

    ``b`` has the length of ``a``, or one letter more.
    """
    width = b.shape[1]
    la, lb = (a > 0).sum(1), (b > 0).sum(1)
    same = a[:, :width] == b
    # Letters in common from the left; from the right after the one that differs.
    left = np.logical_and.accumulate(same | (np.arange(width) >= la[:, None]), 1) & (np.arange(width) < la[:, None])
    left = left.sum(1)
    place = np.arange(width)
    shift = (lb - la)[:, None]
    beyond = place + 1 + left[:, None]
    other = np.take_along_axis(b, np.minimum(beyond, width - 1), 1)
    mine_at = beyond - shift
    mine = np.take_along_axis(a[:, :width], np.clip(mine_at, 0, width - 1), 1)
    rest = (other == mine) | (beyond >= lb[:, None])
    return rest.all(1) & ((la != lb) | (left < la))


class Words:
    """Words of one length as code points and letter counts."""

    def __init__(self, words: list[str], n: np.ndarray, width: int):
        self.words, self.n = np.array(words, object), n
        self.codes = np.zeros((len(words), width), np.int32)
        for i, w in enumerate(words):
            self.codes[i, :len(w)] = np.frombuffer(w.encode("utf-32-le"), np.int32)

    def counts(self, letters: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.words), len(letters)), np.float32)
        row, place = np.nonzero(self.codes)
        np.add.at(out, (row, np.searchsorted(letters, self.codes[row, place])), 1)
        return out


def near_pairs(a: Words, b: Words, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of pairs exactly one edit apart, from Gram matrices; within one block i < j."""
    letters = np.unique(np.concatenate([a.codes.ravel(), b.codes.ravel()]))
    letters = letters[letters > 0]
    ca, cb = a.counts(letters), b.counts(letters)
    sa, sb = (ca ** 2).sum(1), (cb ** 2).sum(1)
    for s in range(0, len(ca), BLOCK):
        for t in range(s if same else 0, len(cb), BLOCK):
            square = sa[s:s + BLOCK, None] + sb[t:t + BLOCK] - 2 * (ca[s:s + BLOCK] @ cb[t:t + BLOCK].T)
            keep = square <= 2
            if same and s == t:
                keep &= np.triu(np.ones_like(keep), 1)
            i, j = np.nonzero(keep)
            for at in range(0, len(i), 1 << 16):  # anagrams of each other can be many
                p, q = i[at:at + (1 << 16)] + s, j[at:at + (1 << 16)] + t
                ok = one_edit(a.codes[p], b.codes[q])
                if ok.any():
                    yield p[ok], q[ok]


class Nearest:
    """Of each word of a block the number of near words, and the most frequent of them."""

    def __init__(self, block: Words):
        self.block = block
        self.near, self.n = np.zeros(len(block.words), np.int64), np.zeros(len(block.words), np.int64)
        self.form = np.full(len(block.words), None, object)

    def add(self, mine: np.ndarray, other: Words, theirs: np.ndarray) -> None:
        np.add.at(self.near, mine, 1)
        order = np.lexsort((-other.n[theirs], mine))
        for x, y in zip(mine[order].tolist(), theirs[order].tolist()):
            n, w = int(other.n[y]), other.words[y]
            if n > self.n[x] or (n == self.n[x] and (self.form[x] is None or w < self.form[x])):
                self.n[x], self.form[x] = n, w

    def rows(self) -> list[tuple]:
        at = np.flatnonzero(self.near)
        return list(zip(self.block.words[at].tolist(), self.near[at].tolist(), self.n[at].tolist(), self.form[at].tolist()))


def nearest(words: DataFrame, *, groups: int = GROUPS, part_rows: int = PART) -> DataFrame:
    """(word, n_near, form, form_n): for each word with near ones in ``words`` (word, n), how many, and the most
    frequent of them (ties: the first in code-point order)."""
    spark = bounded_batches(words.sparkSession)
    with steps(spark) as own:
        # How many letters of each group: by code point, so that neighbours in the alphabet are apart.
        code = F.transform(F.filter(F.split("word", ""), lambda c: c != ""), lambda c: F.pmod(F.ascii(c), F.lit(groups)))
        of_group = F.array(*[F.size(F.filter(code, lambda c: c == g)) for g in range(groups)])
        cells = cut(words.select("word", "n", F.length("word").alias("len"), of_group.alias("g")))
        sizes = cut(cells.groupBy("len", "g").agg(F.ceil(F.count(F.lit(1)) / F.lit(part_rows)).cast("int").alias("parts")))
        cell = F.concat_ws(" ", "len", F.array_join(F.col("g").cast("array<string>"), " "))
        named = sizes.select(cell.alias("cell"), "len", "g", "parts")
        rows = cut(cells.select("word", "n", cell.alias("cell")))
        hot = frequent_keys(rows, "cell")
        dealt = look_up(rows, "cell", named.select("cell", "parts"), hot) \
            .select("word", "n", "cell", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int").alias("part"))

        def pack(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("word")
            return pd.DataFrame([{"cell": frame["cell"].iloc[0], "part": frame["part"].iloc[0], "words": frame["word"].tolist(),
                                  "n": frame["n"].tolist()}])

        blocks = cut(dealt.groupBy("cell", "part").applyInPandas(pack, "cell string, part int, words array<string>, n array<long>"))
        # Which cells meet, and then which of their parts.
        step = F.explode(F.array(*[F.struct(F.lit(d).alias("len"), F.array(*map(F.lit, g)).alias("g")) for d, g in moves(groups)]))
        target = named.withColumn("m", step).select(
            F.col("cell").alias("a"), F.col("parts").alias("parts_a"),
            F.concat_ws(" ", F.col("len") + F.col("m.len"),
                        F.array_join(F.zip_with("g", "m.g", lambda x, y: x + y).cast("array<string>"), " ")).alias("b"))
        meet = target.join(named.select(F.col("cell").alias("b"), F.col("parts").alias("parts_b")), "b")
        pairs = cut(meet.withColumn("pa", F.explode(F.sequence(F.lit(0), F.col("parts_a") - 1)))
                    .withColumn("pb", F.explode(F.sequence(F.lit(0), F.col("parts_b") - 1)))
                    .filter((F.col("a") != F.col("b")) | (F.col("pa") <= F.col("pb"))).select("a", "pa", "b", "pb"))
        size = cells.count()

        def side(s: str) -> DataFrame:
            return blocks.select(F.col("cell").alias(s), F.col("part").alias("p" + s), F.col("words").alias("w" + s), F.col("n").alias("n" + s))

        # A bounded number of meetings a task; the sizes of partitions say little of their work.
        tasks = max(1, min(pairs.count(), size // 500 + 1))
        full = pairs.join(side("a"), ["a", "pa"]).repartition(tasks, "b", "pb").join(side("b").repartition(tasks, "b", "pb"), ["b", "pb"])

        def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[tuple] = []
            for row in batch.to_pylist():
                same = (row["a"], row["pa"]) == (row["b"], row["pb"])
                width = max(map(len, (row["wa"][0], row["wb"][0])))
                left = Words(row["wa"], np.array(row["na"]), width)
                right = left if same else Words(row["wb"], np.array(row["nb"]), width)
                near_left = Nearest(left)
                near_right = near_left if same else Nearest(right)
                for i, j in near_pairs(left, right, same):
                    near_left.add(i, right, j)
                    near_right.add(j, left, i)
                out += near_left.rows() + ([] if same else near_right.rows())
            columns = list(zip(*out)) or [(), (), (), ()]
            return pa.RecordBatch.from_pydict({"word": pa.array(columns[0], pa.string()), "near": pa.array(columns[1], pa.int64()),
                                               "form_n": pa.array(columns[2], pa.int64()), "form": pa.array(columns[3], pa.string())})

        found = map_batches(full, compare, "word string, near long, form_n long, form string")
        # The largest count first, then the first form: -n and the form in one order.
        best = F.min(F.struct((-F.col("form_n")).alias("m"), "form"))
        return own.keep(found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("best")).select(
            "word", "n_near", F.col("best.form").alias("form"), (-F.col("best.m")).alias("form_n")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): from each word along its form (word, form or NULL) to the last; the steps double each round."""
    with steps(forms.sparkSession) as own:
        up = cut(forms.select("word", F.coalesce("form", "word").alias("root")))
        while True:
            nxt = up.select(F.col("word").alias("root"), F.col("root").alias("far"))
            moved = cut(look_up(up, "root", nxt, frequent_keys(up, "root")).select("word", "root", F.coalesce("far", "root").alias("far")))
            if moved.filter("root <> far").isEmpty():
                return own.keep(up)
            up = moved.select("word", F.col("far").alias("root"))


def variants(docs: DataFrame, *, ratio: int = 5, least_length: int = 6, least_count: int = 5, typos: int = TYPOS, id_col: str = "doc_id",
             text_col: str = "text", groups: int = GROUPS, part_rows: int = PART) -> DataFrame:
    """(word, form, root, n, n_near, form_n): every word long and frequent enough, with its more usual spelling.

    Words are runs of letters of whole texts, A-Z as a-z; one in ``typos`` occurrences loses a
    letter by a hash of document and run.  Two words are near if exactly one letter is
    inserted, left out or replaced.  ``form`` is the near word of largest count, the first in
    code-point order among equal ones, if that count is at least ``ratio`` times the word's (and
    so above it), else NULL; ``root`` is the last word along forms.  NULL and empty texts have
    no words; rows count as often as they occur; runs of rows without id lose no letter; a
    word of any length counts.  An empty table gives no rows; other columns are not read.
    """
    with steps(docs.sparkSession) as own:
        words = cut(vocabulary(with_typos(runs(docs, id_col, text_col), typos), least_length, least_count))
        near = nearest(words, groups=groups, part_rows=part_rows)
        usual = F.coalesce(F.col("form_n") >= F.lit(ratio) * F.col("n"), F.lit(False))
        found = cut(words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(usual, F.col("form")).alias("form"),
            F.when(usual, F.col("form_n")).alias("form_n")))
        return own.keep(found.join(roots(found), "word").select("word", "form", "root", "n", "n_near", "form_n"))
