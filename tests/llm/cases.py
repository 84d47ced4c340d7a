"""Small texts that every operator must take: null, empty, blanks, very long, repeated rows, other alphabets."""

import random

WORDS = "the of and river stone light carry window yellow market under history signal paper".split()


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + ("\n" if r.random() < 0.1 else "") for _ in range(n))


TEXTS = [
    (1, prose(60, 1)), (2, None), (3, ""), (4, " \n\t "), (5, prose(60, 1)), (6, prose(60, 1) + " extra"), (7, "word"), (8, "two  words"), (9, "Ünïcode 中文 текст   nbsp\x85end"),
    (10, prose(3000, 2)), (10, prose(3000, 2)), (None, prose(20, 3)), (12, "a" * 5000), (13, "x y z " * 300), (14, "line one here is it\nline one here is it\n\nother"), (15, "don't we'll 's 12 345,6 !!! <|endoftext|> ok  \n\n end "),
]
SCHEMA = "doc_id bigint, text string"


def frame(spark, rows=TEXTS):
    """The texts with extra columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "a", 1, True) for i, t in rows], f"{SCHEMA}, row string, score int, removed boolean")


def empty(spark):
    return frame(spark, [])
