import random

import pytest

CLASHES = ["score", "size", "batch", "_row", "id", "rep", "key", "copies", "target", "rank", "kept", "spans"]


def sentence(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "Aha", "tion", "wörter", "x1", "ble", "idea", "stone", "river", "moss", "ash"])
                    + rng.choice(["", "", "s", "ing", "ly", ".", ","]) for _ in range(n))


def corpus(seed=3, n=60):
    """Texts with copies, near copies, shared passages, a repeated line, odd and empty ones."""
    rng = random.Random(seed)
    base = [sentence(rng, rng.randint(1, 160)) for _ in range(n)]
    passage = sentence(rng, 70)
    texts = list(base)
    for i in range(12):
        words = base[i % 4].split(" ")
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += [base[1]] * 9
    texts += [sentence(rng, 15) + " " + passage + " " + sentence(rng, rng.randint(0, 30)) for _ in range(14)]
    texts += [passage + "\n" + passage, "ab " * 300, "a" * 400, "\t\n", "", "", "é" * 120, "ＡΣ \x00 ▁ <|endoftext|>", "one two", "One TWO",
              " ".join([sentence(rng, 25)] * 4)]
    texts += [sentence(rng, 6000)]
    rng.shuffle(texts)
    return texts


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text): ids out of order, a repeated row, a NULL text."""
    texts = corpus()
    ids = list(range(0, 3 * len(texts), 3))
    random.Random(1).shuffle(ids)
    found = list(zip(ids, texts))
    return [*found, found[5], (1_000_003, None)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The same rows with a hot source and columns whose names clash with those that operators make."""
    full = [(i, t, "en", None if i % 11 == 0 else "hot" if i % 3 == 0 and i % 2 else f"s{i % 5}", 0 if t is None else len(t),
             *["clash"] * len(CLASHES)) for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, "
                                 + ", ".join(f"`{c}` string" for c in CLASHES)).repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
