"""Small fixtures with the awkward cases that every operator has to stand."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string, slot string"


def prose(seed: int, n: int, letters: str = "abcdefghij") -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


def documents(spark, texts, langs=None, sources=None):
    """A documents table with extra columns whose names clash with added ones; ids count up, repeated rows at the end."""
    rows = [
        (i, t, (langs or {}).get(i, "en"), (sources or {}).get(i, f"s{i % 3}"), len(t or ""), "x", "y", "z") for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, DOCS)


AWKWARD = [None, "", " \n\t ", "one", "two words", "x" * 50_000, "é ß \U0001f600  non-breaking", prose(1, 3000)]
