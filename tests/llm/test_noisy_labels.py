"""Toxicity under noisy labels and texts of uneven length."""

import random

import pytest

pytest.importorskip("pyarrow")

from tests.llm.cases import WORDS  # noqa: E402
from tidewater.llm import toxicity  # noqa: E402

BAD = "idiot scum moron trash loser clown pathetic worthless stupid disgusting".split()


def test_few_toxic_words_in_long_texts_are_caught_among_noisy_labels(spark):
    r = random.Random(5)

    def text(k: int) -> str:
        words = [r.choice(WORDS) + r.choice(("", "a", "en", "ou", "ist", "er")) + r.choice(("", "th", "ing")) for _ in range(r.choice((40, 120, 200, 400)))]
        if k % 16 == 0:
            for _ in range(r.choice((1, 2, 4, 6))):
                words.insert(r.randrange(len(words)), r.choice(BAD))
        if k % 16 == 1:  # one word or two, again and again, and labelled toxic now and then
            words = [f"{r.choice(WORDS)}{k % 7}"] * r.randrange(50, 300)
        return " ".join(words)

    docs = [(k, text(k)) for k in range(3200)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, int(k % 16 == 0 or k % 32 == 1 or k % 40 == 7)) for k in range(1600)], "doc_id bigint, toxic int")
    toxic = {row["doc_id"]: row["toxic"] for row in toxicity.score(df, toxicity.fit(df, labels)).collect()}
    planted, clean = [k for k in range(1600, 3200) if k % 16 == 0], [k for k in range(1600, 3200) if k % 16 > 1]
    assert sum(toxic[k] for k in planted) >= 0.8 * len(planted)
    assert sum(not toxic[k] for k in clean) >= 0.98 * len(clean)
