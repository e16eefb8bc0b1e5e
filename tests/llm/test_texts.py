"""Token counts, media, HTML and merge-dropout against the libraries and brute force."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from terrascout.llm import bpe_counts, html_text, ogg, sp_dropout

VOCAB = bpe_counts.vocabulary("word_bpe_49k.json")


def test_counts_equal_the_library(docs, rows):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(VOCAB)
    got = sorted(bpe_counts.token_counts(docs, limit=100).collect())
    want = sorted((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    assert [tuple(r)[:3] for r in got] == want
    assert all(r.over_limit == (r.n_tokens > 100) for r in got)


def test_counts_of_odd_characters():
    from tokenizers import Tokenizer
    library, own, rng = Tokenizer.from_file(VOCAB), bpe_counts.counter(VOCAB), random.Random(4)
    for _ in range(400):
        text = "".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x370, 0x3000), 0x1F600, 0x301, 9, 10, 0x3A3, 0x85]))
                       for _ in range(rng.randrange(30)))
        assert own.count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_counts_of_every_plane_and_of_new_letters():
    """Characters of every block, and those that the tables of Python and the library tell apart, next to others."""
    from tokenizers import Tokenizer
    library, own, rng = Tokenizer.from_file(VOCAB), bpe_counts.counter(VOCAB), random.Random(5)
    new = [0xA7CB, 0xA7DC, 0x1C89, 0x208F, 0x209F, 0x558, 0x58B, 0xCDC, 0xC5C, 0x88F, 0x897, 0x10D50, 0x11DE0, 0x105C9, 0x1C, 0x1F, 0xA0, 0x2028]
    plain = [ord(c) for c in "ab Z9'!+s"]
    for k in range(6000):
        pick = (lambda: rng.choice(new + plain)) if k % 2 else (
            lambda: rng.choice([*plain, rng.randrange(0x20, 0xD800), rng.randrange(0xE000, 0x10000), rng.randrange(0x10000, 0x20000)]))
        text = "".join(chr(pick()) for _ in range(rng.randrange(12)))
        assert own.count(text) == len(library.encode(text, add_special_tokens=False).ids), ascii(text)


def test_counts_of_a_very_long_text():
    from tokenizers import Tokenizer
    text = "Straße naïve 12345 don't \u4e2d\u6587 \U0001F600 <|endoftext|> " * 20_000 + "x" * 20_000
    assert bpe_counts.counter(VOCAB).count(text) == len(Tokenizer.from_file(VOCAB).encode(text, add_special_tokens=False).ids)


def test_empty_tables(no_docs):
    assert bpe_counts.token_counts(no_docs).count() == 0
    assert ogg.inspect(ogg.media(no_docs)).count() == 0
    assert sp_dropout.decode(sp_dropout.encode(no_docs)).count() == 0
    assert html_text.extract(no_docs, id_col="doc_id", html_col="text").count() == 0


def test_media_round_trip(docs, rows):
    stored = ogg.media(docs)
    got = {r.doc_id: r for r in ogg.inspect(stored).collect()}
    files = {r.doc_id: bytes(r.media) for r in stored.collect()}
    for i, t in rows:
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = got[i]
        assert r.error is None and r.n_bytes == len(raw) and r.payload_bytes == len(padded)
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest() and r.tail_crc32 == zlib.crc32(padded[-64:])
        assert r.media_bytes == len(files[i]) and r.media_sha256 == hashlib.sha256(files[i]).hexdigest()


def test_page_checksum_bit_by_bit():
    data, crc = bytes(range(256)) * 2, 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    assert ogg.page_checksum(data) == crc


@pytest.mark.parametrize("size", [64, 255 * 255, 16384, 16448, 70400])
def test_pages_and_damage(size):
    payload = random.Random(size).randbytes(size)
    data = ogg.write(payload)
    sound = ogg.read(data)
    assert sound.payload == payload and sound.page_times[-1] == size / ogg.RATE and sound.streams == 2
    for broken in (data[:-1], data[:100] + bytes([data[100] ^ 4]) + data[101:], data[27:], data[:len(data) // 2] + data):
        with pytest.raises(ogg.MediaError):
            ogg.read(broken)


def test_html_layout():
    page = ("<title>no</title><h1>Head</h1><p>a  b<br>c<p>d <b>e</b>f<ul><li>one<li>two<ol start=3><li>x<li>y</ol></ul>"
            "<table><tr><th>Name<th>N<tr><td>alpha<td>1<tr><td>b<td>22</table>tail<pre>\n a\n  b</pre><div hidden>no</div>"
            "<span style='display: none'>no</span><script>var x='</p>'</script>&amp;&lt;<!-- no -->")
    assert html_text.render(page) == ("Head\n\na b\nc\n\nd ef\n\n- one\n- two\n  3. x\n  4. y\n\nName   N\nalpha  1\nb      22\n\n"
                                      "tail\n\n a\n  b\n\n&<")


def test_html_keeps_every_visible_word():
    rng = random.Random(2)
    for _ in range(200):
        words, parts = [], []
        for k in range(30):
            word = f"w{k}q"
            words.append(word)
            parts.append(rng.choice(["<p>", "</p>", "<div>", "</div>", "<li>", "<ul>", "</ul>", "<table>", "<tr>", "<td>", "</table>", "<b>",
                                     "</b>", "<h2>", "</h1>", "<dd>", "<select><option>", "</i>", "<br/>", "< "]) + f" {word} ")
        text = html_text.render("".join(parts))
        assert sorted(w for w in text.split() if w.endswith("q")) == sorted(words), "".join(parts)


def test_html_odd_input(spark):
    pages = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (None, "<p>a", "x"), (2, "<div>" * 20000 + "deep", "x"), (3, "<!--", "x"),
                                   (4, "<a b='", "x"), (4, "a<b", "x")], "page_id long, html string, text string")
    got = [r.text for r in html_text.extract(pages).collect()]
    assert sorted(got) == sorted(["", "", "a", "deep", "", "", "a"])


def test_without_dropout_equals_the_library(rows):
    import sentencepiece
    path = sp_dropout.model_path("piece_bpe_32k.model")
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), sp_dropout.Codec(path)
    for _, t in rows:
        if t and sp_dropout.SPACE not in t and len(t) < 5000:
            assert own.encode(t).tolist() == library.encode(t)


def test_dropout_is_lossless_seeded_and_varied(docs, rows):
    texts = {i: t or "" for i, t in rows}
    one, again, other = (sp_dropout.encode(docs, seed=s, dropout=0.2) for s in (1, 1, 2))
    a, b, c = ({r.doc_id: r.ids for r in x.collect()} for x in (one, again, other))
    assert a == b and a != c
    for x in (one, other):
        assert {r.doc_id: r.text for r in sp_dropout.decode(x).collect()} == texts
    plain = {r.doc_id: r.ids for r in sp_dropout.encode(docs, dropout=0.0).collect()}
    assert sum(map(len, a.values())) > sum(map(len, plain.values()))


def slow_segments(own, text, seed, rate, name):
    """Agenda without a heap: look through all pairs for the best, skipping by one number a candidate."""
    out, word = [], 2 ** 30 - 1
    for number, unit in enumerate(re.findall(r" *[^ \n]+| +|\n", " " + text)):
        key = int(sp_dropout.occurrence_keys(xxhash.xxh64_intdigest(name, seed=seed), number, number + 1)[0])
        symbols = [(i, sp_dropout.SPACE if c == " " else "\0literal" if c == sp_dropout.SPACE else c) for i, c in enumerate(unit)]
        while True:
            pairs = []
            for k in range(len(symbols) - 1):
                place, piece = symbols[k][0], symbols[k][1] + symbols[k + 1][1]
                if piece in own.makes:
                    mark = (xxhash.xxh32_intdigest(piece) & word) + place * 0x1E3779B1 & word
                    if sp_dropout.draw_one(mark, key) >= round(rate * 2 ** 30):
                        pairs.append((own.makes[piece][0], place, k))
            if not pairs:
                break
            _, _, k = min(pairs)
            symbols[k:k + 2] = [(symbols[k][0], symbols[k][1] + symbols[k + 1][1])]
        for _, p in symbols:
            p = sp_dropout.SPACE if p == "\0literal" else p
            literal = p == sp_dropout.SPACE and unit.find(" ") < 0
            out += [own.ids[p]] if p in own.ids and not literal else [own.byte_ids[b] for b in p.encode()]
    return out


def test_dropout_equals_a_slow_agenda(rows):
    """Letters, odd characters, words beyond the memory's limits, and words that come again."""
    own, rng = sp_dropout.Codec(sp_dropout.model_path("piece_bpe_32k.model")), random.Random(8)
    texts = [t for _, t in rows if t and len(t) < 1500 and sp_dropout.SPACE not in t][:30]
    texts += ["".join(rng.choice("aeinrst  lmou'\n-.1\u00e9") for _ in range(rng.randrange(1, 60))) for _ in range(200)]
    texts += ["internationalization" * 8, "straightforwardness, undergraduate-representatives " * 3, "the the the the the", "abc\u4e2d\u6587def"]
    for rate in (0.1, 0.5):
        for k, got in enumerate(own.encode_all(texts, [str(k) for k in range(len(texts))], 3, rate)):
            assert got.tolist() == slow_segments(own, texts[k], 3, rate, str(k)), texts[k]


def test_dropout_depends_on_the_occurrence():
    """One word has many segmentations in one text and over documents; the share skipped is the rate."""
    own = sp_dropout.Codec(sp_dropout.model_path("piece_bpe_32k.model"))
    ids = own.encode("understanding\n" * 3000, 1, 0.1)
    ends = np.flatnonzero(ids == own.encode("\n", 1, 0.1)[-1])
    assert len(ends) == 3000
    assert len({tuple(x.tolist()) for x in np.split(ids, ends + 1)}) > 12
    docs = {own.encode("understanding representation", 1, 0.1, str(k)).tobytes() for k in range(500)}
    assert len(docs) > 12
    marks = np.array([x + place * 0x1E3779B1 & 2 ** 30 - 1 for _, x in list(own.makes.values())[:5] for place in range(5)], np.uint64)
    assert sp_dropout.draw(marks, np.uint64(99)).tolist() == [sp_dropout.draw_one(m, 99) for m in marks.tolist()]
    drawn = np.stack([sp_dropout.draw(marks, key) < 2 ** 30 // 10 for key in sp_dropout.occurrence_keys(9, 0, 20_000)])
    assert abs(drawn.mean(0) - 0.1).max() < 0.012
    both = np.corrcoef(drawn.T.astype(float)) - np.eye(len(marks))
    assert abs(both).max() < 0.05


def test_dropout_is_alike_in_steps_of_any_size(monkeypatch, rows):
    texts = [t or "" for _, t in rows][:60]
    path, names = sp_dropout.model_path("piece_bpe_32k.model"), [str(k) for k in range(60)]
    whole = sp_dropout.Codec(path).encode_all(texts, names, 3, 0.1)
    for limit in ("STEP", "LETTERS"):
        monkeypatch.setattr(sp_dropout, limit, 5)
        assert [x.tolist() for x in sp_dropout.Codec(path).encode_all(texts, names, 3, 0.1)] == [x.tolist() for x in whole]


def test_dropout_of_very_long_texts():
    own = sp_dropout.Codec(sp_dropout.model_path("piece_bpe_32k.model"))
    for text in ("some words again and again\n" * 40_000, "x" * 100_000 + " end"):
        assert own.decode(own.encode(text, 1, 0.1)) == text


def test_everything_dropped_gives_characters():
    own = sp_dropout.Codec(sp_dropout.model_path("piece_bpe_32k.model"))
    for text in ("ab c", "▁ ▁", "\0", "   ", "日本\n", "🎉"):
        ids = own.encode(text, 0, 1.0)
        assert own.decode(ids) == text
    assert len(own.encode("ab c", 0, 1.0)) == 5


def test_decoding_null(spark):
    encoded = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in sp_dropout.decode(encoded).collect()} == {1: None, 2: ""}


def test_other_columns_are_left_out(docs):
    assert bpe_counts.token_counts(docs).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sp_dropout.encode(docs, keep=["score"]).filter(F.col("score") == "clash").count() == docs.count()


def plain_table(rows):
    """Column by column, as the layout was first written: cells of one column, then spans, then starts."""
    places = [[sum(n for _, n in row[:i]) for i in range(len(row))] for row in rows]
    width = [0] * max(p[-1] + row[-1][1] for p, row in zip(places, rows))
    for span in (False, True):
        for at, row in zip(places, rows):
            for i, (text, n) in zip(at, row):
                if (n > 1) == span:
                    width[i + n - 1] += max(0, len(text) - sum(width[i:i + n]) - 2 * (n - 1))
    lines = []
    for at, row in zip(places, rows):
        line = ""
        for i, (text, _) in zip(at, row):
            if text:
                line = line.ljust(sum(width[:i]) + 2 * sum(w > 0 for w in width[:i])) + text
        lines.append(line)
    return "\n".join(lines)


def test_html_tables_with_spans_equal_a_plain_layout():
    rng = random.Random(6)
    for _ in range(300):
        rows = [[(rng.choice("abc") * rng.randrange(1, 9), rng.choice([1, 1, 1, 2, 3, 7])) for _ in range(rng.randrange(1, 6))]
                for _ in range(rng.randrange(1, 6))]
        page = "<table>" + "".join("<tr>" + "".join(f"<td colspan={n}>{t}" for t, n in row) for row in rows) + "</table>"
        assert html_text.render(page) == plain_table(rows), page


def test_html_wide_spans_and_deep_nesting_stay_in_proportion():
    start = time.perf_counter()
    wide = html_text.render("<table><tr>" + "<td colspan=1000>x" * 2000 + "</table>")
    assert wide.count("x") == 2000
    for tag in ("<blockquote>x", "<ul><li>x", "<dl><dd>x", "<table><tr><td>x<td>"):
        page = tag * (100_000 // len(tag))
        text = html_text.render(page)
        assert text.count("x") == 100_000 // len(tag) and len(text) < 20 * len(page), tag
    assert time.perf_counter() - start < 60
