"""Recurring phrases located by sharded Aho-Corasick automata.

Windows of 20 consecutive words that may recur are brought together by anchors (see
``repeats``): every document is streamed, as pieces around the anchors it shares,
past the shards that hold phrases of these anchors.  A shard confirms which windows
recur, compiles them into one automaton over its words, and runs the pieces through
it; the hits give each window's first place.
"""

from __future__ import annotations

from itertools import product

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrascout.llm import repeats
from terrascout.llm.anchors import mix
from terrascout.session import steps

WINDOW = 20
ANCHOR = 8             # words of an anchor
_R = 0xB5297A4D3F84D5A5  # odd
_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
LONG_WORD = 64         # bytes from which a word is hashed by itself
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
DIGITS = "".join(map(chr, range(48, 112)))  # a word is a number in these: an automaton's nodes have few children


def word_places(batch: repeats.Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and stop of each word in bytes, and the end of each text in words; words end with their text."""
    data = np.frombuffer(batch.data, np.uint8)
    solid = ~_BLANK[data]
    first = np.ones(len(data) + 1, bool)
    first[1:] = np.concatenate([~solid[:-1], [True]]) if len(data) else first[1:]
    first[batch.ends] = True
    begin = np.flatnonzero(solid & first[:-1])
    last = np.ones(len(data), bool)
    if len(data):
        last[:-1] = ~solid[1:] | first[1:-1]
    stop = np.flatnonzero(solid & last) + 1
    return begin, stop, np.searchsorted(begin, batch.ends)


def word_hashes(data: bytes, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch of bytes: eight bytes at a time, scrambled after each; long ones by xxh64."""
    x = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(8, np.uint8)])
    size = stop - begin
    out = mix(size.astype(np.uint64) * np.uint64(_R))
    live, place = np.arange(len(begin)), 0
    with np.errstate(over="ignore"):
        while len(live := live[size[live] > place]) and place < LONG_WORD:
            left = size[live] - place
            chunk = x[(begin[live] + place)[:, None] + np.arange(8)].view("<u8").ravel()
            chunk &= _LOW_BYTES[np.minimum(left, 8)]
            out[live] = mix((out[live] ^ chunk) * np.uint64(_R))
            place += 8
    for i in live.tolist():
        out[i] = xxhash.xxh64_intdigest(data[begin[i]:stop[i]], seed=len(data[begin[i]:stop[i]]))
    return out


class Words(repeats.Units):
    def units(self, batch: repeats.Batch):
        begin, stop, ends = word_places(batch)
        return word_hashes(batch.data, begin, stop), ends, (batch.data, begin, stop)

    def pieces(self, held, start: np.ndarray, stop: np.ndarray) -> list[bytes]:
        data, begin, end = held
        words = b" ".join([data[a:b] for a, b in zip(begin.tolist(), end.tolist())])
        last = np.cumsum(end - begin + 1) - 1  # where each word ends when one blank parts them
        first = last - (end - begin)
        return [words[a:b] for a, b in zip(first[start].tolist(), last[stop - 1].tolist())]


def locate(window: int) -> repeats.Solver:
    """First place of each window of a shard, from an automaton of the recurring ones."""
    def solve(pieces: list[bytes], doc: np.ndarray, pos: np.ndarray):
        split = [p.split(b" ") for p in pieces]
        words = set().union(*split)
        wide = 1
        while len(DIGITS) ** wide < len(words):
            wide += 1
        codes = dict(zip(words, map("".join, product(DIGITS, repeat=wide))))
        texts = ["".join(map(codes.__getitem__, p)) for p in split]
        size = window * wide
        n = np.array([len(p) - window + 1 for p in split], np.int64)
        ends = np.cumsum(n)
        offset = np.arange(int(ends[-1])) - np.repeat(ends - n, n)
        first_doc, first_pos = np.repeat(doc, n), np.repeat(pos, n) + offset
        seen: set[str] = set()
        recurring: dict[str, int] = {}
        for text in texts:
            for j in range(0, len(text) - size + 1, wide):
                w = text[j:j + size]
                if w in seen:
                    recurring.setdefault(w, len(recurring))
                else:
                    seen.add(w)
        del seen
        if not recurring:
            return n, first_doc, first_pos
        automaton = ahocorasick.Automaton()
        for w, number in recurring.items():
            automaton.add_word(w, number)
        automaton.make_automaton()
        line: list[int] = []
        phrase: list[int] = []
        for base, text in zip((ends - n).tolist(), texts):
            found = list(automaton.iter(text))
            # A hit must end with a word.
            found = [((end + 1) // wide - 1, number) for end, number in found if (end + 1) % wide == 0]
            line += [base + end - window + 1 for end, _ in found]
            phrase += [number for _, number in found]
        at, number = np.array(line), np.array(phrase)
        order = np.lexsort((first_pos[at], first_doc[at], number))
        at, number = at[order], number[order]
        lead = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
        winner = at[np.repeat(lead, np.diff(np.append(lead, len(at))))]
        new_doc, new_pos = first_doc[winner], first_pos[winner]
        first_doc[at], first_pos[at] = new_doc, new_pos
        return n, first_doc, first_pos

    return solve


def remove(docs: DataFrame, *, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text",
           **sizes: int) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, spans) for every row.

    A word goes if a ``window``-word sequence that covers it also starts earlier: in a document
    with a smaller id, or before in the same document.  Sequences are judged on the input.
    ``kept`` joins the remaining words by one space; ``spans`` are maximal removed runs of
    words [start, end).  NULL texts have no words; short texts lose nothing; copies lose all
    but in the document with the smallest id; rows of the same id and text are the same
    document; a NULL id is larger than all others.  Other columns are not read.
    """
    batch_bytes = sizes.pop("batch_bytes", repeats.BATCH)
    units = Words(window, anchor)
    batches = repeats.pack(docs, id_col, text_col, batch_bytes)
    # The pieces go as soon as the answers are written.
    with steps(docs.sparkSession) as own:
        answers = own.keep(repeats.first_places(batches, units, locate(window), **sizes))

    def finish(row: pd.Series, found: pd.DataFrame) -> pd.DataFrame:
        batch = repeats.Batch.of(row)
        begin, stop, ends = word_places(batch)
        mask = repeats.earlier(batch, ends, found, window)
        out = []
        for i, a, b, x, y in zip(batch.ids.tolist(), [0, *ends[:-1].tolist()], ends.tolist(), batch.starts.tolist(), batch.ends.tolist()):
            gone = mask[a:b]
            if not gone.any():
                out.append((i, b - a, 0, b" ".join(batch.data[x:y].split()).decode(), []))
                continue
            lo, hi = repeats.mask_runs(gone)
            kept = [batch.data[s:e] for s, e in zip(begin[a:b][~gone].tolist(), stop[a:b][~gone].tolist())]
            out.append((i, b - a, int(gone.sum()), b" ".join(kept).decode(),
                        [{"start": s, "end": e} for s, e in zip(lo.tolist(), hi.tolist())]))
        return pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept", "spans"])

    rows = repeats.one_batch(batches, answers, finish,
                             "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start:long,end:long>>")
    return rows.withColumn("doc_id", F.nullif("doc_id", F.lit(repeats.NO_ID)))
