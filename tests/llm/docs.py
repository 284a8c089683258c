"""Documents with nulls, empty and long texts, ties, repeated rows and columns of clashing names."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean, node long, hash string, tokens string"
WORDS = {"en": "the of and to in that was with for on are this have from".split(), "de": "der die und von zu das mit sich des auf für ist im dem".split()}


def sentence(rng: random.Random, lang: str, n: int) -> str:
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "er", "ung", "ing", "ed", "s"]) + rng.choice(["", "a", "o", "ti", "re", "un"]) for _ in range(n))


def rows() -> list[tuple]:
    rng = random.Random(11)
    out = []
    for i in range(60):
        lang = ["en", "de"][i % 2]
        out.append((i, sentence(rng, lang, 80 + i % 7), lang, f"s{i % 3}"))
    base = out[0][1].split()
    near = base.copy()
    near[40] = "changed"
    out += [(100, " ".join(base), "en", "s0"), (101, " ".join(near).upper(), "en", "s1"), (102, "  " + "\n".join(base) + " ", None, None)]
    out += [(103, None, "en", "s0"), (104, "", "en", None), (105, " \t\n\x0b\f\r", "de", "s1"), (106, "one two", "en", "s2"), (107, "one two", "en", "s2"), (108, "123 456 !!", "en", "s0")]
    out += [(109, "lòng " * 30_000, "en", "s2"), (110, "same line of words here\n" * 60, "en", "s0"), (111, "x###*** " * 70 + sentence(rng, "en", 60), "en", "s0")]
    out += [(None, sentence(rng, "en", 90), "en", "s1"), (None, None, None, None), (None, out[1][1], "de", "s1")]
    out += [out[2], out[2], (5, "another text under the same number " * 12, "en", "s0"), (112, "😀 emoji and   no-break <|endoftext|> 'll", "en", "ü")]
    return out


def frame(spark: SparkSession, data: list[tuple] | None = None) -> DataFrame:
    data = rows() if data is None else data
    return spark.createDataFrame([(*r, len(r[1] or ""), 7, False, -1, "h", "t") for r in data], SCHEMA).repartition(3)
