"""Small tables for the operators' tests."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "stone river cloud ember willow marsh copper lantern meadow harbor thistle canyon velvet orchard glacier pepper saddle timber walnut zephyr".split()


def prose(seed: int, words: int = 60) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(words))


def rows(texts: list[str | None], langs: list[str | None] | None = None, sources: list[str | None] | None = None) -> list[tuple]:
    return [(k, t, langs[k] if langs else "en", sources[k] if sources else f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]


def table(spark, texts, **more):
    return spark.createDataFrame(rows(texts, **more), SCHEMA)


#: Null, empty and white-space texts, ties, repeats and one very long text.
ODD = [None, "", " ", "\n\n", "a", "a", "A  b\tc", "a b c", prose(1), prose(1), prose(1) + " tail", prose(2, 30_000), "é ß 漢字 😀", "\x0b\x0c\r x"]
