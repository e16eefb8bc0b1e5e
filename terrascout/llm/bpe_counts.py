"""Token counts by heap-and-linked-list byte-pair merging.

The count of a piece of text is its number of initial symbols less the merges
made, so no identifier is ever looked up or emitted.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrascout.llm.common import map_batches

CACHE_WORDS = 400_000  # counts a Python worker remembers before it starts anew


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves; the rest take 256, 257, ... in order.
    """
    own = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in own else next(spare)) for b in range(256)]


def merged_length(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols left after merging: pop the lowest-ranked adjacent pair (leftmost on ties) until none is left."""
    n = left = len(symbols)
    if n < 2:
        return n
    part, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    agenda = [(rank, i, part[i], part[i + 1]) for i in range(n - 1)
              if (rank := ranks.get((part[i], part[i + 1]))) is not None]
    heapq.heapify(agenda)
    while agenda:
        _, i, a, b = heapq.heappop(agenda)
        j = after[i]
        if part[i] != a or j >= n or part[j] != b:
            continue  # one of the two was merged meanwhile
        part[i], part[j] = a + b, ""
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        left -= 1
        for k, m in ((before[i], i), (i, after[i])):
            if k >= 0 and m < n and (rank := ranks.get((part[k], part[m]))) is not None:
                heapq.heappush(agenda, (rank, k, part[k], part[m]))
    return left


@cache
def _ranges(name: str) -> str:
    """The characters of the basic plane that the library's own patterns count to a class, as ranges.

    Its Unicode tables are not those of Python or of any other package.
    """
    from tokenizers import Regex, pre_tokenizers
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    runs = pre_tokenizers.Split(Regex(f"{name}+"), "removed", invert=True).pre_tokenize_str(every)
    return "".join(f"\\u{ord(run[0]):04x}-\\u{ord(run[-1]):04x}" for run, _ in runs)


@cache
def _unassigned() -> re.Pattern:
    """Characters of the basic plane that Python's tables don't have: the library may compose or lower-case them."""
    return re.compile("[" + "".join(f"\\u{c:04x}" for c in range(0x10000) if unicodedata.category(chr(c)) == "Cn") + "]")


BEYOND = re.compile("[\U00010000-\U0010ffff]")


def own_classes(pattern: str) -> re.Pattern:
    """A pattern with \\s and \\p{..}, which stand in brackets, spelled out for texts of the basic plane."""
    return re.compile(re.sub(r"\\s|\\p\{\w+\}", lambda m: _ranges(m[0]), pattern))


class Counter:
    """Counts as the tokenizer file's own library does (special strings in a text are one token each)."""

    def __init__(self, path: str):
        from tokenizers import Regex, Tokenizer, pre_tokenizers
        self.normalize = Tokenizer.from_file(path).normalizer.normalize_str
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        self.ranks = {tuple(pair if isinstance(pair, list) else pair.split(" ")): i
                      for i, pair in enumerate(model["merges"])}
        self.end = model["end_of_word_suffix"] or ""
        pattern = pre[0]["pattern"]["Regex"]
        self.basic = own_classes(pattern)
        self.split = pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, self.added)))
        self.symbols = byte_symbols()
        self.known: dict[str, int] = {}

    def word(self, word: str) -> int:
        n = self.known.get(word)
        if n is None:
            symbols = [self.symbols[b] for b in word.encode("utf-8")]
            symbols[-1] += self.end
            n = merged_length(symbols, self.ranks)
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            if len(word) < 100:
                self.known[word] = n
        return n

    def plain(self, text: str) -> int:
        # Python's normal forms are fast; texts with characters that its tables lack take the library's, and texts
        # beyond the basic plane are split by the library too.
        if text.isascii():
            return sum(map(self.word, self.basic.findall(text.lower())))
        if BEYOND.search(text):
            return sum(self.word(w) for w, _ in self.split(self.normalize(text)))
        if _unassigned().search(text):
            text = self.normalize(text)
        else:
            # Lower case character by character: a final capital sigma is no exception.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return sum(map(self.word, self.basic.findall(text)))

    def count(self, text: str) -> int:
        if not any(t in text for t in self.added):
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One counter for each worker and file."""
    return Counter(path)


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_counts(docs: DataFrame, vocab: str = "word_bpe_49k.json", limit: int = 2048, *,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row; only id and text are read.

    A NULL or empty text has 0 bytes and 0 tokens, a NULL id stays NULL, repeated
    rows are counted one by one, and an empty table gives an empty result.  The
    vocabulary is looked up on each worker; memory holds one batch of texts and
    ``CACHE_WORDS`` words.
    """
    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        count = counter(vocabulary(vocab)).count
        texts = [t or "" for t in batch.column(1).to_pylist()]
        tokens = [count(t) for t in texts]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()),
             pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
            names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(rows, each, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
