"""Documents with everything that a stage has to survive."""

import random

CLASHING = "key string, n int, start int, count int, ids string, score string, n_removed string, value int"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"
EXTRA = ("k", 1, 2, 3, "i", "s", "r", 9)


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(words))


def edge_rows() -> list[tuple]:
    shared = prose(1, 120)
    texts = [
        None, "", " ", "\n\n", "a", "word", shared, shared, shared + " tail one", prose(2, 30) + " " + shared + " " + prose(3, 30),
        "x" * 3000, "x" * 3000 + "y", "ab " * 2000, prose(4, 6000), "é" * 500 + " 日本語 " * 100, "line one\nline two\n\nline one",
        "mail me: a.b@c.example now 4111 1111 1111 1111 or +1 (555) 123-4567 at 10.0.0.1", "<|endoftext|> and <|startoftext|>x",
    ]
    rows = [(i, t, "en", f"src{i % 4}", len(t) if t is not None else None, *EXTRA) for i, t in enumerate(texts)]
    rows += [rows[6], rows[9]]  # repeated rows
    rows += [(None, shared, None, None, None, *EXTRA), (None, None, None, None, None, *[None] * 8)]
    return rows


def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
