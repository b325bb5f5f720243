"""Collocations against plain counts."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

from sieveline.llm import collocations as C
from sieveline.llm.collocations import Tally, collocations, parts_of
from tests.llm.helpers import ODD, SCHEMA, rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(texts, langs, least, top, longest=5, percent=100):
    f, n = defaultdict(Counter), Counter()
    for text, lang in zip(texts, langs):
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f[lang].update(tuple(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    out = []
    for lang, count in f.items():
        kept = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        holder = Counter()
        for p, a in kept.items():
            for part in {p[b : b + k] for k in range(2, len(p)) for b in range(len(p) - k + 1)}:
                holder[part] = max(holder[part], a)
        scored = []
        for p, a in kept.items():
            score, _, left, right = min((1000 * a * n[lang] // (count[p[:k]] * count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
            if 100 * holder[p] < percent * a or not holder[p]:
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, k, p.decode(), -a, left, right, n[lang], -s) for k, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def corpus(seed, size):
    r = random.Random(seed)
    words = ["A", "b", "c", "der", "Öl", "漢", "x\x1fy", "it's", "😀", "\x00"]
    fixed = ["new york city hall park", "of the", "b c b c b"]
    texts = []
    for _ in range(size):
        parts = [r.choice(fixed) if r.random() < 0.3 else r.choice(words) for _ in range(r.randrange(0, 60))]
        texts.append("".join(p + r.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\r\x0b", "!?"]) for p in parts))
    return texts


def test_equals_plain_counts(spark):
    texts = [*corpus(1, 150), *ODD, *ODD]
    r = random.Random(2)
    langs = [r.choice(["en", "en", "de", None, "und", ""]) for _ in texts]
    docs = spark.createDataFrame(rows(texts, langs), SCHEMA).withColumnRenamed("source", "phrase").withColumnRenamed("n_chars", "score").repartition(5)
    for least, top, percent in ((4, 50, 100), (2, 10**6, 60)):
        found = sorted(tuple(x) for x in collocations(docs, least=least, top=top, inside_percent=percent).collect())
        assert found == plain(texts, langs, least, top, percent=percent) and found


def test_empty(spark):
    assert collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert collocations(spark.createDataFrame(rows([None, "", " "]), SCHEMA)).collect() == []


def test_long_texts_are_cut_between_pieces():
    text = "a b, c d. e f g h i j; " * 50
    parts = list(parts_of(text, 40))
    assert "".join(parts) == text and len(parts) > 10 and all(p[-1] in ".,;" for p in parts[:-1])
    assert list(parts_of("a b " * 100, 40)) == ["a b " * 100]


def test_hashes_depend_on_the_word_alone():
    import pyarrow as pa

    words = ["a", "", "ab", "ba", "aa", "漢字", "b", "a" * 300, "\x00", "\x00\x00"]
    whole = C.word_hashes(pa.array(words))
    assert len(set(whole.tolist())) == len(words)
    assert C.word_hashes(pa.array(["x", *words, "y"]).slice(1, len(words))).tolist() == whole.tolist()
    assert C.word_hashes(pa.array([], pa.string())).tolist() == []


def test_counts_are_handed_out_when_they_are_many(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(C, "HELD", 10)
    tally, total = Tally(100), Counter()
    tally.most = 10
    batches = []
    for k in range(40):
        batches += tally.add(pa.table({"lang": ["x"] * 5, "phrase": [f"p{(k * 5 + j) % (7 if k < 20 else 90)}" for j in range(5)], "c": [1] * 5}))
    batches += tally.emit(tally.merged())
    for b in batches:
        for x in b.to_pylist():
            total[x["phrase"]] += x["c"]
    assert sum(total.values()) == 200 and tally.rows < 100


def test_no_task_unpacks_many_segments(spark):
    import numpy as np
    from pyspark.sql import functions as F

    least, one = 100, np.zeros(1 << C.SEGMENT, np.uint8)
    one[5], one[7] = 60, 2
    packed = F.lit(C.squeezed(one))
    rows = spark.range(64 * C.SALTS).select(F.lit(None).cast("string").alias("phrase"), (F.col("id") % 64).cast("int").alias("segment"), F.floor(F.col("id") / 64).cast("int").alias("salt"), packed.alias("counts"))
    made = C.salted_segments(rows.where("salt < 2").union(rows), least)
    # Packed they are a few bytes each; still they stay in as many tasks.
    held = [r.n for r in made.groupBy(F.spark_partition_id()).agg(F.count("salt").alias("n")).collect()]
    assert sum(held) == 64 * C.SALTS and max(held) <= 2 * 64 * C.SALTS / C.MERGERS
    found = np.flatnonzero(np.unpackbits(C.merged_buckets(rows.where("salt < 2"), least)))
    assert found.tolist() == [s * (1 << C.SEGMENT) + 5 for s in range(64)]
    assert not C.merged_buckets(rows.where("salt < 1"), least).any()
