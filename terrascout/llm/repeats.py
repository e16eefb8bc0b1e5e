"""Windows that repeat across documents, found through shared anchors.

1. Texts are packed into batches, one row each, in a table of the shared folder.
2. Every batch sends its distinct anchor hashes, as sorted blobs, to buckets by
   hash.  A bucket tells the batches which of their anchors also occur elsewhere.
3. Runs of windows at shared anchors go to shards by anchor, each distinct piece of
   a batch once, with its first place.  An anchor that more than ``HOT`` documents
   share sends each window to a shard of its own hash instead, so that no shard
   grows with the number of documents at one anchor.
4. A solver (a suffix array, an automaton) finds in each shard, for each window of its
   distinct pieces, the first place where an equal window starts.
5. The answers go back to the batches, which mark what an earlier window covers.

What is gathered in a task is a batch, a bucket or a shard, whose sizes are
parameters; their number grows with the data.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrascout.llm import anchors
from terrascout.llm.common import bounded_batches, return_memory, stage

BATCH = 1 << 20        # bytes of text in a batch, unless one text is longer
BUCKET = 8 << 20       # bytes of text whose anchors one bucket compares
SHARD = 2 << 20        # bytes of text behind one shard
HOT = 1000             # documents from which an anchor's windows are dealt one by one
NO_ID = (1 << 63) - 1  # stands for a NULL id: later than every other

_PACKED = "batch long, size long, ids binary, ends binary, data binary"


# ------------------------------------------------------------------- batches

@dataclass
class Batch:
    """Concatenated UTF-8 texts, the id of each and where it ends."""

    ids: np.ndarray
    ends: np.ndarray
    data: bytes

    @classmethod
    def of(cls, row: pd.Series) -> Batch:
        return cls(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["ends"], np.int64),
                   zstandard.ZstdDecompressor().decompress(row["data"], max_output_size=int(row["size"]) or 1))

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], self.ends[:-1]]).astype(np.int64)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH) -> DataFrame:
    """Batches of whole texts, written to the shared folder; NULL texts are empty."""
    bounded_batches(docs.sparkSession)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        ids: list[int] = []
        texts: list[bytes] = []
        size = 0

        def row() -> pa.RecordBatch:
            ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
            data = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
            return pa.RecordBatch.from_pydict({
                "batch": pa.array([number], pa.int64()), "size": pa.array([size], pa.int64()),
                "ids": pa.array([np.array(ids, np.int64).tobytes()], pa.binary()),
                "ends": pa.array([ends.tobytes()], pa.binary()), "data": pa.array([data], pa.binary())})

        for frame in frames:
            for i, text in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist()):
                raw = (text or "").encode("utf-8")
                if texts and size + len(raw) > batch_bytes:
                    yield row()
                    number, ids, texts, size = number + 1, [], [], 0
                ids.append(NO_ID if i is None else i)
                texts.append(raw)
                size += len(raw)
        if texts:
            yield row()

    return stage(docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, _PACKED))


def total_bytes(batches: DataFrame) -> int:
    return int(batches.agg(F.sum("size")).first()[0] or 0)  # one number


def planes(values: np.ndarray) -> bytes:
    """Numbers of eight bytes with equal bytes side by side, which compresses well."""
    return np.ascontiguousarray(values, "<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().view("<i8").ravel()


# ------------------------------------------------- which hashes occur elsewhere

def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as differences, equal bytes side by side, which compresses well."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    steps = np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().view("<u8").ravel()
    return np.cumsum(steps, dtype=np.uint64)


def shared_hashes(batches: DataFrame, hashes: Callable[[Batch], tuple[np.ndarray, np.ndarray]],
                  buckets: int, hot: int = HOT) -> DataFrame:
    """(batch, shared, hot): hashes of a batch that occur twice or more in all, and those more than ``hot`` times.

    ``hashes`` gives the distinct sorted hashes of a batch and how often each occurs.
    """
    edges = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, row in frame.iterrows():
                found, times = hashes(Batch.of(row))
                cuts = np.searchsorted(found, edges)
                parts = [(b, f, t) for b, (f, t) in enumerate(zip(np.split(found, cuts), np.split(times, cuts))) if len(f)]
                yield pd.DataFrame({
                    "bucket": np.array([p[0] for p in parts], np.int32), "batch": np.full(len(parts), row["batch"], np.int64),
                    "hashes": [pack_sorted(p[1]) for p in parts],
                    "times": [np.minimum(p[2], 65535).astype(np.uint16).tobytes() for p in parts]})
                del found, times, parts
                return_memory()

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack_sorted(h) for h in frame["hashes"]]
        found = np.concatenate(parts)
        times = np.concatenate([np.frombuffer(t, np.uint16) for t in frame["times"]]).astype(np.int64)
        order = np.argsort(found, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], found[order][1:] != found[order][:-1]]))
        sums = np.add.reduceat(times[order], first)
        total = np.empty(len(found), np.int64)
        total[order] = np.repeat(sums, np.diff(np.append(first, len(found))))
        out, at = [], 0
        for batch, part in zip(frame["batch"], parts):
            n = total[at:at + len(part)]
            at += len(part)
            if (n > 1).any():
                out.append((batch, pack_sorted(part[n > 1]), pack_sorted(part[n > hot])))
        del found, times, order, total, sums
        return_memory()
        return pd.DataFrame(out, columns=["batch", "shared", "hot"])

    sent = batches.mapInPandas(send, "bucket int, batch long, hashes binary, times binary")
    return stage(sent.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(compare, "batch long, shared binary, hot binary"))


def short(hashes: np.ndarray) -> np.ndarray:
    """The leading 40 bits, which halve what buckets get and give; equal hashes stay equal, few others become so."""
    return hashes & np.uint64(0xFFFFFFFFFF000000)


def scattered(hashes: np.ndarray) -> np.ndarray:
    """Short hashes over the whole range.  Anchors are the smallest hashes of their windows: as they are, a few
    buckets would get most of them, and the more so the more buckets there are."""
    return short(anchors.mix(hashes))


def _gather(frame: pd.DataFrame, column: str) -> np.ndarray:
    """Sorted hashes of a batch from all buckets."""
    if not len(frame):
        return np.zeros(0, np.uint64)
    return np.sort(np.concatenate([unpack_sorted(x) for x in frame[column]]))


def _member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(values), bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


def one_batch(batches: DataFrame, answers: DataFrame, work: Callable[[pd.Series, pd.DataFrame], pd.DataFrame],
              schema: str) -> DataFrame:
    """Run ``work`` on every batch with its answers."""
    empty = {f.split()[0]: [] for f in schema.split(", ")}

    def run(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        made = work(rows.iloc[0], found) if len(rows) else pd.DataFrame(empty)
        return_memory()
        return made

    return batches.groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(run, schema)


# ------------------------------------------------------------------- windows

class Units:
    """What windows are made of: by default bytes.  Subclasses cut texts into other units."""

    def __init__(self, window: int, k: int):
        self.window, self.k = window, k

    def units(self, batch: Batch) -> tuple[np.ndarray, np.ndarray, object]:
        """(a hash of each unit, end of each text in units, what ``pieces`` needs)."""
        return np.frombuffer(batch.data, np.uint8), batch.ends, batch.data

    def pieces(self, held: object, start: np.ndarray, stop: np.ndarray) -> list[bytes]:
        """The units from each start to its stop as bytes that equal units share."""
        return [held[a:b] for a, b in zip(start.tolist(), stop.tolist())]

    def anchors(self, batch: Batch):
        units, ends, held = self.units(batch)
        start, stop, anchor = anchors.runs(anchors.kgrams(units, self.k), ends, self.k, self.window)
        return start, stop, anchor, ends, held

    def hashes(self, batch: Batch) -> tuple[np.ndarray, np.ndarray]:
        """Distinct short anchors of a batch and their occurrences."""
        return np.unique(short(self.anchors(batch)[2]), return_counts=True)


Solver = Callable[[list[bytes], np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def first_places(batches: DataFrame, units: Units, solve: Solver, *, bucket: int = BUCKET, shard: int = SHARD,
                 hot: int = HOT) -> DataFrame:
    """(batch, answer, n): blobs of (piece, lo, hi, doc, pos), and with n below 0 the places of a batch's pieces; both as ``planes``.

    For windows lo <= w < hi of a piece, the first equal window starts in document ``doc``
    at unit ``pos + w``.  ``solve`` gets the pieces of a shard with the document and unit of
    their first places, and returns for all their windows, piece by piece: number of windows
    of each piece, and document and unit of the first equal window.
    """
    size = total_bytes(batches)
    shards = max(1, math.ceil(size / shard))
    window = units.window

    def pieces(row: pd.Series, found: pd.DataFrame) -> pd.DataFrame:
        batch = Batch.of(row)
        start, stop, anchor, ends, held = units.anchors(batch)
        sent = scattered(short(anchor))
        keep = _member(sent, _gather(found, "shared"))
        start, stop, anchor = start[keep], stop[keep], anchor[keep]
        crowded = _member(sent[keep], _gather(found, "hot"))
        # Windows at a crowded anchor go one by one.
        times = np.where(crowded, stop - start, 1)
        inside = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        alone = np.repeat(crowded, times)
        start, stop, anchor = (np.repeat(x, times) for x in (start, stop, anchor))
        start = np.where(alone, start + inside, start)
        stop = np.where(alone, start + 1, stop)
        text = np.searchsorted(ends, start, side="right")
        origin = np.concatenate([[0], ends[:-1]])
        # Occurrences by document and unit, so that a piece's first one is its first place.
        doc, pos = batch.ids[text], start - origin[text]
        order = np.lexsort((pos, doc))
        found_here = units.pieces(held, start[order], stop[order] + window - 1)
        listed = list(dict.fromkeys(found_here))
        known = dict(zip(listed, range(len(listed))))
        in_order = np.fromiter(map(known.__getitem__, found_here), np.int32, len(found_here))
        number = np.empty(len(start), np.int32)
        number[order] = in_order
        # Pieces are numbered as they first come.
        firsts = order[np.flatnonzero(np.diff(np.maximum.accumulate(in_order), prepend=-1))]
        del found_here, known
        target = (anchor[firsts] % np.uint64(shards)).astype(np.int64)
        lone = np.flatnonzero(alone[firsts])
        target[lone] = [xxhash.xxh64_intdigest(listed[j]) % shards for j in lone.tolist()]
        zipped = zstandard.ZstdCompressor(level=3).compress
        # The places need no solver: any shard hands them on.
        shard_of = xxhash.xxh64_intdigest(int(row["batch"]).to_bytes(8, "little")) % shards
        rows = [(shard_of, row["batch"], zipped(planes(np.diff(number, prepend=0))), zipped(planes(np.diff(start, prepend=0))), None, None)] \
            if len(start) else []
        lens = np.fromiter(map(len, listed), np.int64, len(listed))
        place = np.stack([doc[firsts], pos[firsts]]).astype(np.int64)
        by_shard = np.argsort(target, kind="stable")
        for s in np.split(by_shard, np.flatnonzero(np.diff(target[by_shard])) + 1):
            if len(s):
                rows.append((int(target[s[0]]), row["batch"], zipped(planes(np.diff(s, prepend=0))),
                             zipped(planes(np.concatenate([np.diff(place[0, s], prepend=0), place[1, s]]))), zipped(planes(lens[s])), zipped(b"".join([listed[j] for j in s.tolist()]))))
        return pd.DataFrame(rows, columns=["shard", "batch", "piece", "place", "lens", "data"])

    def evenly(batch: Batch) -> tuple[np.ndarray, np.ndarray]:
        found, times = units.hashes(batch)
        found, of = np.unique(scattered(found), return_inverse=True)
        return found, np.bincount(of, times, len(found)).astype(np.int64)

    shared = shared_hashes(batches, evenly, max(1, math.ceil(size / bucket)), hot)

    def solved(frame: pd.DataFrame) -> pd.DataFrame:
        # Two rows for the places of a batch: the number of the piece at each, and where it starts.
        bare = frame["data"].isna().to_numpy()
        out = [(batch, blob, n) for batch, *blobs in zip(frame["batch"][bare], frame["piece"][bare], frame["place"][bare])
               for blob, n in zip(blobs, (-1, -2))]
        frame = frame[~bare]
        if len(frame):
            out += answered(frame)
        return_memory()
        return pd.DataFrame(out, columns=["batch", "answer", "n"])

    def answered(frame: pd.DataFrame) -> list[tuple[int, bytes, int]]:
        known: dict[bytes, int] = {}
        codes, docs, poss, sizes = [], [], [], []
        unzip = zstandard.ZstdDecompressor().decompress
        for place, lens, data in zip(frame["place"], frame["lens"], frame["data"]):
            ends = np.cumsum(from_planes(unzip(lens))).tolist()
            whole = unzip(data)
            codes += [known.setdefault(whole[a:b], len(known)) for a, b in zip([0, *ends[:-1]], ends)]
            d, p = from_planes(unzip(place)).reshape(2, -1)
            docs.append(np.cumsum(d))
            poss.append(p)
            sizes.append(len(d))
        # Batches that have the same piece share one, at its first place in all.
        code, doc, pos = np.array(codes), np.concatenate(docs), np.concatenate(poss)
        order = np.lexsort((pos, doc, code))
        lead = order[np.searchsorted(code[order], np.arange(len(known)))]
        n, doc, pos = solve(list(known), doc[lead], pos[lead])
        del known, codes
        ends = np.cumsum(n)
        offset = np.arange(int(ends[-1])) - np.repeat(ends - n, n)
        owner = np.repeat(np.arange(len(n)), n)
        base = pos - offset
        # Stretches of windows whose first places follow each other too.
        new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (doc[1:] != doc[:-1]) | (base[1:] != base[:-1])]))
        last = np.append(new[1:], len(owner)) - 1
        table = np.stack([offset[new], offset[last] + 1, doc[new], base[new]]).astype(np.int64)
        from_, times = np.searchsorted(owner[new], code), np.bincount(owner[new], minlength=len(n))[code]
        zipped = zstandard.ZstdCompressor(level=1).compress
        out, at = [], 0
        for piece, batch, size in zip(frame["piece"], frame["batch"], sizes):
            f, t = from_[at:at + size], times[at:at + size]
            at += size
            line = np.repeat(f, t) + np.arange(int(t.sum())) - np.repeat(np.cumsum(t) - t, t)
            own = np.repeat(np.cumsum(from_planes(unzip(piece))), t)
            lines = np.vstack([np.diff(own, prepend=0), table[:, line]])
            out.append((batch, zipped(planes(lines.ravel())), len(line)))
        return out

    # The pieces go straight to their shards: they are never on disk twice.
    made = one_batch(batches, shared, pieces, "shard int, batch long, piece binary, place binary, lens binary, data binary")
    return made.repartition(shards, "shard").groupBy("shard").applyInPandas(solved, "batch long, answer binary, n long")


def earlier(batch: Batch, ends: np.ndarray, answers: pd.DataFrame, window: int) -> np.ndarray:
    """True for each unit of a batch that a window with an earlier equal one covers."""
    covered = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, np.int64)
    mine = {int(n): a for a, n in zip(answers["answer"], answers["n"]) if n < 0}
    if mine:
        unzip = zstandard.ZstdDecompressor().decompress
        number, start = (np.cumsum(from_planes(unzip(mine[n]))) for n in (-1, -2))
        tables = [from_planes(unzip(a)).reshape(5, -1) for a, n in zip(answers["answer"], answers["n"]) if n > 0]
        for t in tables:
            np.cumsum(t[0], out=t[0])
        piece, lo, hi, doc, base = np.concatenate(tables, axis=1)
        order = np.argsort(piece, kind="stable")
        piece, lo, hi, doc, base = (x[order] for x in (piece, lo, hi, doc, base))
        a, b = np.searchsorted(piece, number), np.searchsorted(piece, number, side="right")
        times = b - a
        line = np.repeat(a, times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        at = np.repeat(start, times)
        text = np.searchsorted(ends, at, side="right")
        origin = np.concatenate([[0], ends[:-1]])[text]
        own = batch.ids[text]
        hit = (doc[line] < own) | ((doc[line] == own) & (base[line] < at - origin))
        np.add.at(covered, (at + lo[line])[hit], 1)
        np.add.at(covered, (at + hi[line] + window - 1)[hit], -1)
    return np.cumsum(covered)[:-1] > 0


def mask_runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of stretches of True."""
    step = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)
