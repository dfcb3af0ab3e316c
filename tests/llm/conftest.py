import random

import pytest

from kbforge.llm.common import prepare

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept string, score string, row string, key string, size string"


@pytest.fixture(scope="session")
def docs(spark):
    """A small corpus with nulls, empty and long texts, ties, repeated rows and
    columns named like the operators' own."""
    prepare(spark)
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(400)]

    def prose(n):
        return " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ".", ",", ".\n"]) for _ in range(n))

    base = [prose(rng.randint(5, 300)) for _ in range(60)]
    passage = prose(80)
    texts = [*base, *base[:8], base[0], base[0]]
    for k in range(12):
        words = base[k].split(" ")
        for _ in range(1 + k // 4):
            words[rng.randrange(len(words))] = "Changed"
        texts.append(" ".join(words))
    texts += [base[k][:40] + " " + passage + " " + base[k][50:120] for k in range(10, 25)]
    texts += [None, "", "  \n\t ", "one", "Two Words", "é" * 500, "a" * 1500, "ab " * 900, prose(20_000), "The cat. " * 60]
    texts += ["Mail me: jo.doe+x@mail.example.com or +1 (415) 555-0100, 10.0.0.255.", "4111 1111 1111 1111 no 4111 1111 1111 1112 256.1.1.1"]
    sources = ["b", "a", None, "ä", "c"]
    rows = [(i, t, "en", sources[i % 5] if i % 3 else "hot", len(t or ""), -1, "x", "y", "r", "k", "s") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "no id here", None, None, None, None, None, None, None, None, None), (None, base[1], None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
