"""A small corpus with the cases that every operator must stand: nulls, empty and very long texts, ties, repeats, odd columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, digest string, gone_digest string"


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))


def documents(seed=0, n=40):
    rng = random.Random(seed)
    passage = sentence(rng, 70)
    rows = [(i, sentence(rng, rng.randint(30, 160)) + ".\n" + sentence(rng, 20)) for i in range(n)]
    rows[3] = (3, rows[2][1])  # an exact copy
    near = rows[5][1].split()
    near[len(near) // 2] = "changed"
    rows[6] = (6, " ".join(near))
    rows[10] = (10, rows[10][1] + " " + passage)
    rows[12] = (12, passage + " " + rows[12][1])
    rows += [(n, None), (n + 1, ""), (n + 2, " \n\t "), (n + 3, "x"), (n + 4, "é" * 3000 + " ß " + "0" * 5000), (n + 5, "word " * 3000), (n + 6, "Ünï 日本語 текст <|endoftext|> <|startoftext|> 'S don't  \x0b"), (None, "no number but some words here"), (0, rows[0][1]), (n + 7, sentence(rng, 4000))]
    return rows


def table(spark, rows, schema=SCHEMA):
    width = schema.count(",") + 1
    return spark.createDataFrame([(*r, *["x", "y", 1, "r", "d", "g"][: width - 2]) for r in rows], schema).repartition(3)


def empty(spark, schema=SCHEMA):
    return spark.createDataFrame([], schema)
