"""Encoding with seeded merge-dropout and lossless decoding for SentencePiece BPE models.

Merging takes the best-scored adjacent pair from an agenda.  A candidate is skipped when a
hash of (seed, document, occurrence, piece, place) falls below the dropout rate: every
occurrence of a word is segmented on its own, repeatably, and decodes to the same bytes.

The agendas of many units go on side by side in numpy: units of one length are the rows of
a table with the place on the agenda of every pair, and each step pops the best pair of
every row.  Long runs without a space have an agenda of their own.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrascout.llm.common import map_batches

SPACE = "▁"          # stands for a space inside pieces
LETTERS = 48         # of the longest unit whose agenda is a row of a table
STEP = 1 << 18       # characters whose agendas go on side by side
_NONE = np.int32(2 ** 31 - 1)  # place on the agenda of a pair that can't merge
# A unit is a run of spaces with what follows up to the next space, and a line break
# is one of its own: merging can't make a piece that goes over such a border, as the
# codec checks against the model.

_WORD, _PLACE, _MIX, _MIX2 = 0x3FFFFFFF, 0x1E3779B1, 0x25EBCA6B, 0x2C1B3C6D  # numbers of 30 bits
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def unit_starts(points: np.ndarray) -> np.ndarray:
    """Where the units of a text of code points begin."""
    space, line = points == 0x20, points == 0x0A
    first = line.copy()
    first[1:] |= line[:-1] | (space[1:] & ~space[:-1])
    first[:1] = True
    return np.flatnonzero(first)


def occurrence_keys(document: int, first: int, last: int) -> np.ndarray:
    """30-bit keys of a document's units from number ``first`` up to ``last``."""
    with np.errstate(over="ignore"):
        x = np.uint64(document) + np.arange(first, last, dtype=np.uint64) * _GOLDEN
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return (x ^ x >> np.uint64(31)) >> np.uint64(34)


def draw(marks: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """A number below 2^30 for each candidate from its mark and its occurrence's key."""
    x = (marks ^ keys) * np.uint64(_MIX)
    return ((x ^ x >> np.uint64(29)) & np.uint64(_WORD)) * np.uint64(_MIX2) >> np.uint64(15) & np.uint64(_WORD)


def draw_one(mark: int, key: int) -> int:
    """The same of one candidate."""
    x = (mark ^ key) * _MIX
    return ((x ^ x >> 29) & _WORD) * _MIX2 >> 15 & _WORD


class Pairs:
    """Which symbol two neighbours make: a table with open addresses, looked up in numpy."""

    BITS = 20

    def __init__(self, made: dict[int, int]):
        while len(made) * 4 > 1 << self.BITS:
            self.BITS += 1
        self.keys, self.values, self.probes = np.full(1 << self.BITS, -1, np.int64), np.full(1 << self.BITS, -1, np.int32), 1
        for key, value in made.items():
            at, n = int(self._slot(np.array([key]))[0]), 1
            while self.keys[at] >= 0:
                at, n = (at + 1) & (1 << self.BITS) - 1, n + 1
            self.keys[at], self.values[at], self.probes = key, value, max(self.probes, n)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * _GOLDEN >> np.uint64(64 - self.BITS)).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The symbol made of each two, or -1."""
        keys = left.astype(np.int64) << 32 | right
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], np.int32(-1))
        more = np.flatnonzero((held != keys) & (held >= 0))
        for n in range(1, self.probes):
            if not len(more):
                break
            at = (slot[more] + n) & (1 << self.BITS) - 1
            held = self.keys[at]
            hit = held == keys[more]
            out[more[hit]] = self.values[at[hit]]
            more = more[~hit & (held >= 0)]
        return out


class Codec:
    """Segments and decodes with the pieces and scores of one model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        pieces = [model.id_to_piece(i) for i in range(size)]
        plain = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(size)]
        self.ids = {p: i for i, p in enumerate(pieces) if plain[i]}
        # Of each piece that merging can make: place on the agenda, and its share of a candidate's mark.
        self.makes = {p: (-model.get_score(i), xxhash.xxh32_intdigest(p) & _WORD) for p, i in self.ids.items() if len(p) > 1}
        self.byte_ids = {int(pieces[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        if len(self.byte_ids) < 256:
            raise ValueError("lossless decoding needs a model with byte fallback")
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.ids):
            raise ValueError("units need a model without line breaks, or spaces after other characters, in pieces")
        self.raw = [p.replace(SPACE, " ").encode() if plain[i] else b"" for i, p in enumerate(pieces)]
        for b, i in self.byte_ids.items():
            self.raw[i] = bytes([b])
        if SPACE not in self.ids:
            raise ValueError("units need a piece for the space")
        # Symbols: the id of a piece; a character that is none has a number above all ids.
        self.size = size
        self.symbol = np.arange(size, size + 0x110000, dtype=np.int32)
        for p, i in self.ids.items():
            if len(p) == 1 and p != SPACE:
                self.symbol[ord(p)] = i
        # A literal U+2581 goes to bytes and merges with nothing, as its piece would decode to a space.
        self.symbol[ord(" ")] = self.ids[SPACE]

        def of(p: str) -> int | None:
            return self.ids.get(p, size + ord(p) if len(p) == 1 else None)

        made = {}
        for p in self.makes:
            for k in range(1, len(p)):
                left, right = of(p[:k]), of(p[k:])
                if left is not None and right is not None:
                    made[left << 32 | right] = self.ids[p]
        self.pairs = Pairs(made)
        self.order, self.share = np.full(size, _NONE, np.int32), np.zeros(size, np.uint64)
        ranks = {x: r for r, x in enumerate(sorted({x for x, _ in self.makes.values()}))}
        for p, (x, share) in self.makes.items():
            self.order[self.ids[p]], self.share[self.ids[p]] = ranks[x], share

    def on_agenda(self, made: np.ndarray, place: np.ndarray, keys: np.ndarray, threshold: int) -> np.ndarray:
        """Places on the agenda of candidates that make these symbols; skipped ones and -1 have none."""
        out = np.where(made >= 0, self.order[made], _NONE)
        if threshold:
            marks = self.share[made] + place.astype(np.uint64) * np.uint64(_PLACE) & np.uint64(_WORD)
            out[draw(marks, keys) < np.uint64(threshold)] = _NONE
        return out

    def merge_rows(self, rows: np.ndarray, keys: np.ndarray, threshold: int) -> np.ndarray:
        """Symbols left in each row, at the place where each begins; -1 where one goes on."""
        count, n = rows.shape
        out, which = rows.copy(), np.arange(count)
        made, agenda = np.full((count, n), -1, np.int32), np.full((count, n), _NONE, np.int32)
        if n > 1:
            made[:, :-1] = self.pairs.look_up(rows[:, :-1].ravel(), rows[:, 1:].ravel()).reshape(count, n - 1)
            agenda[:, :-1] = self.on_agenda(made[:, :-1], np.arange(n - 1)[None, :], keys[:, None], threshold)
        after = np.tile(np.arange(1, n + 1, dtype=np.int16), (count, 1))
        before = np.tile(np.arange(-1, n - 1, dtype=np.int16), (count, 1))
        part = rows.copy()
        while True:
            i = agenda.argmin(1)
            live = agenda[np.arange(len(i)), i] != _NONE
            if not live.all():
                done = ~live
                out[which[done]] = part[done]
                if not live.any():
                    return out
                which, keys, i = which[live], keys[live], i[live]
                part, made, agenda, after, before = (x[live] for x in (part, made, agenda, after, before))
            base = np.arange(len(i)) * n
            flat_part, flat_made, flat_agenda, flat_after, flat_before = (x.reshape(-1) for x in (part, made, agenda, after, before))
            here = base + i
            gone = flat_after[here].astype(np.int64)
            flat_part[here] = flat_made[here]
            flat_part[base + gone] = -1
            flat_agenda[base + gone] = _NONE
            flat_agenda[here] = _NONE
            right = flat_after[base + gone].astype(np.int64)
            flat_after[here] = right
            some = np.flatnonzero(right < n)
            at, to = here[some], base[some] + right[some]
            flat_before[to] = i[some]
            new = self.pairs.look_up(flat_part[at], flat_part[to])
            flat_made[at] = new
            flat_agenda[at] = self.on_agenda(new, i[some], keys[some], threshold)
            left = flat_before[here].astype(np.int64)
            some = np.flatnonzero(left >= 0)
            at, to = base[some] + left[some], here[some]
            new = self.pairs.look_up(flat_part[at], flat_part[to])
            flat_made[at] = new
            flat_agenda[at] = self.on_agenda(new, left[some], keys[some], threshold)

    def merge_long(self, part: np.ndarray, key: int, threshold: int) -> np.ndarray:
        """The same for one long unit, with a heap of (place on the agenda, place in the unit, left, right).

        An entry whose sides were merged meanwhile is passed over.
        """
        n, own = len(part), np.uint64(key)
        made = self.pairs.look_up(part[:-1], part[1:])
        order = self.on_agenda(made, np.arange(n - 1), own, threshold)
        first = np.flatnonzero(order != _NONE)
        symbols, makes = part.tolist(), {}
        agenda = list(zip(order[first].tolist(), first.tolist(), part[first].tolist(), part[first + 1].tolist()))
        heapq.heapify(agenda)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def offer(i: int, j: int) -> None:
            a, b = symbols[i], symbols[j]
            if (a, b) not in makes:
                makes[a, b] = int(self.pairs.look_up(np.array([a]), np.array([b]))[0])
            new = makes[a, b]
            if new >= 0 and draw_one(int(self.share[new]) + i * _PLACE & _WORD, key) >= threshold:
                heapq.heappush(agenda, (int(self.order[new]), i, a, b))

        while agenda:
            _, i, a, b = heapq.heappop(agenda)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue
            symbols[i] = makes[a, b] if (a, b) in makes else int(self.pairs.look_up(np.array([a]), np.array([b]))[0])
            symbols[j] = -1
            j = after[i] = after[j]
            if j < n:
                before[j] = i
                offer(i, j)
            if before[i] >= 0:
                offer(before[i], i)
        return np.array(symbols, np.int32)

    def merged(self, symbols: np.ndarray, starts: np.ndarray, keys: np.ndarray, threshold: int) -> np.ndarray:
        """Symbols left of all units that begin at ``starts``, -1 at places inside of them."""
        lengths = np.diff(starts, append=len(symbols))
        out = symbols.copy()
        order = np.argsort(lengths, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
            n = int(lengths[some[0]])
            if n <= LETTERS:
                at = starts[some][:, None] + np.arange(n)
                out[at] = self.merge_rows(symbols[at], keys[some], threshold)
            else:
                for u in some.tolist():
                    out[starts[u]:starts[u] + n] = self.merge_long(symbols[starts[u]:starts[u] + n], int(keys[u]), threshold)
        return out

    def ids_of(self, symbols: np.ndarray) -> np.ndarray:
        """Token ids; a character that is no piece becomes its bytes."""
        odd = np.flatnonzero(symbols >= self.size)
        if not len(odd):
            return symbols.astype("<u4")
        names, kind = np.unique(symbols[odd], return_inverse=True)
        coded = [np.array([self.byte_ids[b] for b in chr(c - self.size).encode()], np.int64) for c in names.tolist()]
        table, sizes = np.concatenate(coded), np.array(list(map(len, coded)))
        counts = np.ones(len(symbols), np.int64)
        counts[odd] = sizes[kind]
        begin = np.cumsum(counts) - counts
        out = np.repeat(symbols.astype(np.int64), counts)
        spread = np.repeat(np.arange(len(odd)), sizes[kind])
        step = np.arange(len(spread)) - np.repeat(np.cumsum(sizes[kind]) - sizes[kind], sizes[kind])
        out[begin[odd][spread] + step] = table[(np.cumsum(sizes) - sizes)[kind[spread]] + step]
        return out.astype("<u4")

    def encode_all(self, texts: Sequence[str | None], names: Sequence[str], seed: int = 0, dropout: float = 0.0) -> list[np.ndarray]:
        """Ids of each text; ``names`` tell occurrences in different documents apart."""
        threshold = round(dropout * (_WORD + 1))
        made: list[list[np.ndarray]] = [[] for _ in texts]
        held: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> None:
            offsets = np.cumsum([0, *[len(h[1]) for h in held]])
            out = self.merged(np.concatenate([h[1] for h in held]), np.concatenate([h[2] + o for h, o in zip(held, offsets)]),
                              np.concatenate([h[3] for h in held]), threshold)
            for (d, *_), a, b in zip(held, offsets, offsets[1:]):
                own = out[a:b]
                made[d].append(self.ids_of(own[own >= 0]))
            held.clear()

        waiting = 0
        for d, (text, name) in enumerate(zip(texts, names)):
            if not text:
                continue
            # As the model does, a space goes before the text; decoding takes it off.
            points = np.frombuffer((" " + text).encode("utf-32-le"), np.uint32)
            starts = unit_starts(points)
            symbols = self.symbol[points]
            keys = occurrence_keys(xxhash.xxh64_intdigest(name, seed=seed), 0, len(starts))
            # A long text goes in pieces of whole units.
            cuts = np.unique(np.append(np.searchsorted(starts, np.arange(0, len(points), STEP)), len(starts)))
            for a, b in zip(cuts, cuts[1:]):
                low, high = starts[a], starts[b] if b < len(starts) else len(points)
                held.append((d, symbols[low:high], starts[a:b] - low, keys[a:b]))
                waiting += high - low
                if waiting >= STEP:
                    flush()
                    waiting = 0
        if held:
            flush()
        return [np.concatenate(x) if x else np.zeros(0, "<u4") for x in made]

    def encode(self, text: str, seed: int = 0, dropout: float = 0.0, name: str = "") -> np.ndarray:
        return self.encode_all([text], [name], seed, dropout)[0]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.raw.__getitem__, ids.tolist()))[1:].decode("utf-8")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec for each worker and model."""
    return Codec(path)


def model_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, model: str = "piece_bpe_32k.model", *, seed: int = 17, dropout: float = 0.1,
           id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, ids array<int>, and the columns of ``keep``) for every row.

    Every occurrence of a word draws its own skipped merges, by a hash of ``seed``, the id and
    the word's number in the text.  Rate 0 gives the model's own segmentation.  A NULL or
    empty text has no ids; NULL ids count as the text "None"; repeated rows are encoded
    alike, equal texts of different ids each in their own way; any string decodes to
    itself, literal U+2581 and NUL included.  Texts of any length are encoded whole, in time
    in proportion to it; a run without spaces or line breaks goes through one agenda.
    """
    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(model_path(model))
        out = own.encode_all(batch.column(1).to_pylist(), [str(i) for i in batch.column(0).to_pylist()], seed, dropout)
        ends = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
        flat = np.concatenate(out).astype(np.int32) if out else np.zeros(0, np.int32)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), *batch.columns[2:]],
            names=["doc_id", "ids", *kept])

    kept = list(keep)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *kept)
    return map_batches(rows, each, _schema(rows, "ids array<int>", kept))


def _schema(rows: DataFrame, made: str, kept: list[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return ", ".join([f"doc_id {kinds['doc_id']}", made, *[f"`{c}` {kinds[c]}" for c in kept]])


def decode(encoded: DataFrame, model: str = "piece_bpe_32k.model", *, keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, text, and the columns of ``keep``) from ids; NULL ids give NULL, no ids the empty text."""
    kept = list(keep)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(model_path(model))
        texts = [None if x.values is None else own.decode(x.values.to_numpy(zero_copy_only=False)) if len(x.values) else ""
                 for x in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()),
                                           *[batch.column(2 + i) for i in range(len(kept))]], names=["doc_id", "text", *kept])

    rows = encoded.select("doc_id", "ids", *kept)
    return map_batches(rows, each, _schema(rows, "text string", kept))
