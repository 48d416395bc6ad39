"""Small document tables with the awkward cases."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank int, key string, h string"


def awkward_texts() -> list[str | None]:
    r = random.Random(5)
    words = ["the", "of", "and", "Thing", "other", "Éa", "über", "n0", "x,", "日本", "a", "don't", "--"]
    passage = " ".join(r.choice(words) + str(k) for k in range(60))
    base = " ".join(r.choice(words) + str(r.randrange(400)) for _ in range(300))
    near = [" ".join(w if r.random() > 0.01 else "edited" for w in base.split(" ")) for _ in range(30)]
    texts: list[str | None] = [None, "", " ", "\n\n", "one", "one two three four", "one two three four", "ONE two Three four", base, base, *near]
    texts += [f"{passage}\n" + " ".join(r.choice(words) + str(r.randrange(900)) for _ in range(80)) + f" {passage}" for _ in range(25)]
    texts += ["word " * 500, ("same line here\n" * 50).strip(), "a\tb\x0bc\x0cd\r\ne  f   g ", "<|endoftext|> tail <|startoftext|>x", "### $$$ %%% |||", "é" * 3000, "z" * 5000]
    texts += [" ".join(r.choice(words) for _ in range(r.randrange(200))) for _ in range(60)]
    texts += ["\n".join(" ".join(r.choice(words) + str(r.randrange(50)) for _ in range(12)) for _ in range(6)) for _ in range(20)]
    texts += [" ".join(r.choice(words) + str(k % 37) for k in range(20000))]
    return texts


def awkward_documents(spark, partitions: int = 3):
    """Unique ids from 0; extra columns with clashing names."""
    rows = [(k, t, "en", "hot" if k % 3 else f"s{k % 5}", len(t or ""), k, "k", "h") for k, t in enumerate(awkward_texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(partitions)


def repeated_documents(spark):
    """Repeated ids and rows, null ids, null hosts."""
    t = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 4
    rows = [(1, t, None, None, 1, 1, "k", "h"), (1, t, None, None, 1, 1, "k", "h"), (1, "other words", None, "a", 1, 1, "k", "h"), (None, t, None, "a", None, None, None, None), (None, None, None, None, None, None, None, None), (7, "other words", None, "b", 1, 1, "k", "h")]
    return spark.createDataFrame(rows, SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
