"""Scores of the attention model: base against plain counts, the network against a
plain version place by place, gradients against differences, and held-out texts."""

from __future__ import annotations

import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.llm import lm_scoring as L
from sieveline.llm.lm_scoring import BEFORE, SPAN, TOLD, Network, Vocabulary, first_parameters, flat, lm_scores, shaped, split_words, windows
from sieveline.llm.packing import WordIds, word_ids
from tests.llm.helpers import ODD, SCHEMA, prose, rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def model(seed=1, ids=40, n=4000):
    r = np.random.default_rng(seed)
    counts = np.bincount(r.zipf(1.5, n) % ids, minlength=ids).astype(float)
    counts[-4:] = [0, 1, 2, 0]
    words = Vocabulary(counts, r.normal(0, 1, (ids, 2 * L.SKETCH)) * counts[:, None], 50)
    text = r.choice(ids, 3000, p=counts / counts.sum()).astype(np.int32)
    first, second = words.pairs(text, np.array([1000, 0, 2000]))
    assert len(first) == 3003
    words.follow(np.bincount(first, minlength=(ids + 1) * L.CLASSES), np.bincount(second, minlength=(L.CLASSES + 2) * L.PLACES))
    p = first_parameters()
    p |= {k: r.normal(0, 0.3, L.SHAPES[k]).astype(np.float32) for k in ("w2", "w3")}
    p["far"] = r.normal(0, 1, SPAN).astype(np.float32)
    return Network(p, words), r


def chances(net, inputs):
    """Plain: log probability of every next id and the end after the ids ``inputs`` of a window."""
    p, of = net.p, net.of
    x = np.array([p["emb"][of.cls[i]] + of.near[i] @ p["near"] for i in inputs], float)
    q = x[-1] @ p["q"] / math.sqrt(L.WIDTH)
    s = np.array([q @ (x[j] @ p["k"]) + p["far"][len(x) - 1 - j] for j in range(len(x))])
    a = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
    h = x[-1] @ p["r"] + sum(a[j] * (x[j] @ p["v"]) for j in range(len(x)))
    g = np.maximum(h @ p["w1"] + p["b1"], 0)
    log = lambda y: y - y.max() - np.log(np.exp(y - y.max()).sum())
    out, top = [], log(g @ p["w2"] + of.next_group[inputs[-1]])
    slots = [log(g @ p["w3"][k] + of.next_slot[k][of.cls[inputs[-1]]]) for k in range(L.GROUPS)]
    for i in range(of.size + 1):
        c = of.goal[i]
        out.append(top[c] + of.within[i] + (slots[c][of.slot[i]] if of.slot[i] >= 0 else 0))
    return np.array(out)


def test_windows_hold_each_id_once():
    r = np.random.default_rng(3)
    sizes = np.array([0, 1, TOLD - 1, TOLD, TOLD + 1, 5 * TOLD, 0, 77])
    ids = r.integers(0, 9, sizes.sum()).astype(np.int32)
    seq, start, goal, of = windows(ids, sizes, 9, 10, 9)
    text = np.split(ids, np.cumsum(sizes)[:-1])
    for t, own in enumerate(text):
        seen, told = [], []
        for at in start[of == t]:
            span = seq[at : at + SPAN]
            target = goal[at + BEFORE : at + SPAN]
            told += target[target >= 0].tolist()
            for i in np.flatnonzero(target >= 0):
                before = span[: BEFORE + i + 1]
                before = before[before != 10].tolist()
                assert before == [9, *own][: len(seen) + 1][-len(before) :] and len(before) >= min(len(seen) + 1, BEFORE)
                seen.append(target[i])
        assert told == [*own, 9]


def test_equals_a_plain_version_and_sums_to_one():
    net, r = model()
    net.tables()
    sizes = np.array([0, 3, 40, 70])
    ids = r.integers(0, net.of.size, sizes.sum()).astype(np.int32)
    found, expected = net.log_chances(ids, sizes), []
    for own in np.split(ids, np.cumsum(sizes)[:-1]):
        total, inputs = 0.0, [net.of.begin, *own]
        for t, goal in enumerate([*own, net.of.end]):
            first = max(0, t // TOLD * TOLD - BEFORE)
            log = chances(net, inputs[first : t + 1])
            assert abs(np.exp(log).sum() - 1) < 1e-5
            total += log[goal]
        expected.append(total)
    assert np.allclose(found, expected, rtol=1e-4)


def test_gradient_equals_differences():
    net, r = model(2)
    sizes = np.array([50, 20])
    seq, at, goal, _ = windows(r.integers(0, net.of.size, 70).astype(np.int32), sizes, net.of.begin, net.of.pad, net.of.end)
    where = at[:, None] + np.arange(SPAN)
    inputs, target = seq[where], goal[where[:, BEFORE:]]
    start = flat(net.p).astype(float)
    n = (target >= 0).sum()
    loss, d = net.gradient(inputs, target)
    along = flat({k: v for k, v in d.items()}).astype(float)
    for seed in range(4):
        # Directions that share the gradient, so that differences stand out from rounding.
        way = along * np.random.default_rng(seed).uniform(0, 2, len(along))
        way[np.abs(start) > 1e3] = 0
        step = 1e-2 / np.linalg.norm(way)
        up, down = (Network(shaped(start + s * step * way), net.of).gradient(inputs, target)[0] for s in (1, -1))
        assert (up - down) / (2 * step * n) == pytest.approx(along @ way, rel=0.02)


@pytest.mark.parametrize("rounds, share", [(1, 3), (2, 2)])
def test_every_training_window_is_learned(spark, rounds, share):
    texts = [*ODD, *[prose(k, 3 * k) for k in range(40)]]
    docs = spark.createDataFrame([(k, t or "", k % 7 != 2) for k, t in enumerate(texts)], "id long, text string, train boolean").repartition(3)
    blocks = L.blocks_of(docs, "word_bpe_49k.json")
    known = word_ids("word_bpe_49k.json")
    words = L.vocabulary(blocks, known.tokenizer.get_vocab_size(), sum(k % 7 != 2 for k in range(len(texts))))
    _, learned = L.fitted(blocks, words, rounds=rounds, share=share, batch=64, rate=0.03)
    windows_of = [sum(len(L.Block(r.asDict(), np.array(r.train)).sizes) and L.Block(r.asDict(), np.array(r.train)).sizes // TOLD + 1) for r in blocks.collect() if any(r.train)]
    assert learned == rounds * sum(windows_of)


def test_base_and_model(spark):
    r = random.Random(4)
    texts = [*ODD, *[prose(k, r.randrange(1, 90)) for k in range(150)]]
    docs = spark.createDataFrame([*rows(texts), (None, "lost id", "en", "s", 1), (3, "ember", "en", "s", 1)], SCHEMA).withColumnRenamed("n_chars", "score").repartition(3)
    train = lambda i: zlib.crc32(str(i).encode()) % 7 != 2 and i is not None
    found = lm_scores(docs, F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) != 2, share=4).collect()
    assert len(found) == len(texts) + 2
    count = Counter()
    known = [*enumerate(texts), (3, "ember")]
    for i, t in known:
        if train(i):
            count.update([*words_of(t), None])
    n, v = count.total(), len(count)
    expected = sorted((i if i is not None else -1, len(words_of(t)) + 1, sum(count[w] > 0 for w in [*words_of(t), None]), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in [*words_of(t), None]), 6)) for i, t in [*known, (None, "lost id")])
    assert sorted((x.doc_id if x.doc_id is not None else -1, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6)) for x in found) == expected
    assert all(x.score < 0 and math.isfinite(x.score) for x in found)
    # Texts of the language that was learned are likelier, a token, than what wasn't.
    each = {x.doc_id: x.score / x.n_tokens for x in found}
    likely = [each[i] for i in range(len(ODD), len(texts)) if not train(i)]
    assert sum(likely) / len(likely) > each[12]


def test_empty_and_without_training(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert lm_scores(empty, F.lit(True)).collect() == []
    found = lm_scores(spark.createDataFrame(rows(["a b", None]), SCHEMA), F.lit(None).cast("boolean")).collect()
    assert sorted((x.doc_id, x.n_tokens, x.n_known, x.train_tokens, x.base_score) for x in found) == [(0, 3, 0, 0, 0.0), (1, 1, 0, 0, 0.0)]


def test_words():
    known, code, sizes = split_words(["A b\tA", "", "É\x0bx\x1fy", " "])
    assert [known[c].as_py() for c in code] == ["a", "b", "a", "É", "x\x1fy"] and sizes.tolist() == [3, 0, 2, 0]
    table = word_ids("word_bpe_49k.json")
    chunks = ["stone", "stone,", "don't", "é", "漢字", "<|endoftext|>", "a1.", "...", "marsh.", "\x1f"]
    ids, sizes = table.each(chunks)
    assert isinstance(table, WordIds) and ids.tobytes() == b"".join(table[c] for c in chunks) and sizes.tolist() == [len(table[c]) // 4 for c in chunks]


def test_plain_words_are_merged_by_one_call(monkeypatch):
    table = word_ids("word_bpe_49k.json")
    chunks = [*(f"mar{chr(97 + k)}st{c}on{end}" for k in range(26) for c in "aéßz" for end in ("", ",", ".")), "÷", "a..", "x1", "ª,", "漢字"]
    expected = [table[c] for c in chunks]
    one_by_one = []
    monkeypatch.setattr(table, "merge", lambda piece: one_by_one.append(piece) or [])
    ids, sizes = table.each(chunks)
    assert one_by_one == [] and ids.tobytes() == b"".join(expected) and sizes.tolist() == [len(x) // 4 for x in expected]
    assert [x.tolist() for x in table.each([])] == [[], []]


def test_gradient_works_in_little_memory():
    net, r = model(5)
    seq, at, goal, _ = windows(r.integers(0, net.of.size, 4000).astype(np.int32), np.array([1000, 3000]), net.of.begin, net.of.pad, net.of.end)
    where = at[:, None] + np.arange(SPAN)
    inputs, target = seq[where], goal[where[:, BEFORE:]]
    net.gradient(inputs, target)
    tracemalloc.start()
    net.gradient(inputs, target)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8.5e6  # 9.4e6 when all rows of all groups were told at once
