"""Packing, mixing and the pipeline."""

from __future__ import annotations

import json
import random
import zlib
from array import array
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from sieveline.llm.langid import UNKNOWN
from sieveline.llm.mixing import mix_sources, route, targets
from sieveline.llm.packing import pack, pack_documents, sum_of_squares, tokenised_pieces, word_ids
from tests.llm.helpers import ODD, SCHEMA, prose, rows, table
from tests.llm.test_dedup import plain_exact, plain_near

NAME = "word_bpe_49k.json"


def reference_ids(text):
    return Tokenizer.from_file(public_tokenizers.path(NAME)).encode(text or "", add_special_tokens=False).ids + [0]


def test_ids_match_the_tokenizer():
    r, words = random.Random(4), word_ids(NAME)
    signs = "abcdeéüßÀÞ÷×ªºµ²½¼ 12\t\n\r\x0b\x0c\x1c\x1d\x85\xa0\xad'’sStT,.!|<>İΣςａ́ä̈漢字😀​ %$#d'll're"
    tokenizer = Tokenizer.from_file(public_tokenizers.path(NAME))
    texts = [prose(1, 500), "<|endoftext|> x <|startoftext|>"] + ["".join(r.choice(signs) for _ in range(r.randrange(60))) for _ in range(1500)]
    assert all(words.of(t) == array("I", tokenizer.encode(t, add_special_tokens=False).ids).tobytes() for t in texts)


def check_packed(out, texts, capacity):
    ids = {k: reference_ids(t) for k, t in enumerate(texts)}
    held, places = defaultdict(list), defaultdict(list)
    for x in out:
        part = ids[x.doc_id][x.start : x.start + x.length]
        assert len(part) == x.length and x.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        held[x.doc_id].append((x.piece, x.start, x.length))
        places[x.sequence_id].append((x.offset, x.length))
    for k, all_ids in ids.items():
        assert sorted(held[k]) == [(p, p * capacity, min(capacity, len(all_ids) - p * capacity)) for p in range(-(-len(all_ids) // capacity))]
    for spots in places.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_packing_is_a_round_trip(spark):
    texts = ODD + [prose(k, random.Random(k).randrange(1, 700)) for k in range(300)]
    docs = table(spark, texts)
    n = check_packed(pack_documents(docs, tokenizer=NAME, capacity=512).collect(), texts, 512)
    total = sum(len(reference_ids(t)) for t in texts)
    assert n <= 1.03 * total / 512 + 1


def test_packing_rounds(spark):
    texts = [prose(k, random.Random(k).randrange(1, 60)) for k in range(400)]
    pieces = tokenised_pieces(table(spark, texts), tokenizer=NAME, capacity=128)
    check_packed(pack(pieces, capacity=128, shard_rows=50).collect(), texts, 128)


def test_packing_edges(spark):
    assert pack_documents(spark.createDataFrame([], SCHEMA), tokenizer=NAME).count() == 0
    odd = spark.createDataFrame([(None, "a"), (2, "b c"), (2, "b c"), (3, None)], "doc_id long, text string")
    out = pack_documents(odd, tokenizer=NAME).collect()
    assert len(out) == 4 and sorted((x.offset, x.length) for x in out)[0][0] == 0


def test_sum_of_squares_follows_the_rule():
    r = np.random.default_rng(0)
    sizes, cap = r.integers(1, 21, 300), 20
    where, offset, level = sum_of_squares(sizes, cap)
    bins: list[int] = []
    for s, w, o in zip(sizes, where, offset):
        count = [sum(b == h for b in bins) for h in range(cap + 1)]
        square = lambda c: sum(c[h] ** 2 for h in range(1, cap))

        def after(h, s=s, count=count):
            c = count.copy()
            c[h] -= h > 0
            c[h + s] += 1
            return square(c)

        choices = {h: after(h) for h in {0, *bins} if h + s <= cap and (h == 0 or count[h])}
        assert after(o) == min(choices.values())
        if w == len(bins):
            bins.append(int(s))
        else:
            assert bins[w] == o
            bins[w] += int(s)
    assert bins == level.tolist()


def test_targets_and_flow():
    assert targets([10, 100, 100], [5, 1, 1], 210, 3) == [30.0, 90.0, 90.0]
    assert targets([0, 50], [1, 1], 50, 3) == [0.0, 50.0]


def cheapest(patterns, quota, most):
    """Plain: shortest paths one by one over a network with a node for each pattern and source; (flow, cost)."""
    names = list(quota)
    sink = 1 + len(patterns) + len(names)
    edges = []  # [from, to, room, cost]; the next one is its reverse

    def edge(a, b, room, cost):
        edges.extend([[a, b, room, cost], [b, a, 0, -cost]])

    for k, (sources, size) in enumerate(patterns):
        for copy in range(most):
            edge(0, 1 + k, size, copy * copy)
        for s in set(sources):
            edge(1 + k, 1 + len(patterns) + names.index(s), most * size, 0)
    for k, s in enumerate(names):
        edge(1 + len(patterns) + k, sink, round(quota[s]), 0)
    flow = cost = 0
    while True:
        far, by = [0] + [float("inf")] * sink, {}
        for _ in range(sink + 1):
            for n, (a, b, room, c) in enumerate(edges):
                if room and far[a] + c < far[b]:
                    far[b], by[b] = far[a] + c, n
        if sink not in by:
            return flow, cost
        path, at = [], sink
        while at:
            path.append(by[at])
            at = edges[by[at]][0]
        moved = min(edges[n][2] for n in path)
        for n in path:
            edges[n][2] -= moved
            edges[n ^ 1][2] += moved
        flow, cost = flow + moved, cost + moved * far[sink]


@pytest.mark.parametrize("seed", range(25))
def test_routes_cost_as_little_as_by_shortest_paths(seed):
    r = random.Random(seed)
    names = ["a", "b", "c", None, "d"][: r.randrange(1, 6)]
    patterns = [(r.sample(names, r.randrange(1, len(names) + 1)), r.randrange(0, 30)) for _ in range(r.randrange(1, 9))]
    quota = {s: r.uniform(0, 80) for s in names}
    sent = route(patterns, quota, most=3)
    cost = lambda x, n: sum(c * c * min(max(x - c * n, 0), n) for c in range(3)) if n else 0
    assert all(0 <= x <= 3 * n for x, (_, n) in zip(sent, patterns))
    assert (sum(sent), sum(cost(x, n) for x, (_, n) in zip(sent, patterns))) == cheapest(patterns, quota, 3)


@pytest.mark.parametrize("kind", ["any", "chain"])
def test_routes_of_many_memberships(kind):
    """100,000 memberships of one group within a minute."""
    import time

    r = random.Random(8)
    n = 33_334 if kind == "any" else 50_000
    sources = [f"s{k:05d}" for k in range(2000 if kind == "any" else n + 1)]
    patterns = [(r.sample(sources, 3) if kind == "any" else sources[k : k + 2], r.randrange(1, 10_000)) for k in range(n)]
    total = sum(x for _, x in patterns)
    quota = {s: (1, 2, 3)[k % 3] * total / (2 * len(sources)) for k, s in enumerate(sources)}
    began = time.time()
    sent = route(patterns, quota, most=3)
    assert time.time() - began < 60
    assert all(0 <= x <= 3 * m for x, (_, m) in zip(sent, patterns)) and sum(sent) <= sum(round(q) for q in quota.values())
    assert sum(sent) > 0.9 * total


def test_every_pattern_is_routed(spark, monkeypatch):
    """A document table with one source a row enters the flow as well."""
    from sieveline.llm import mixing

    docs = table(spark, [prose(k, 10) for k in range(30)])
    monkeypatch.setattr(mixing, "route", lambda patterns, quota, most: [most * n for _, n in patterns])
    assert {x.copies for x in mix_sources(docs).collect()} == {3}


def test_flow_serves_overlapping_sources():
    assert route([(("a",), 1000), (("a", "b"), 1000), (("b",), 100)], {"a": 1050.0, "b": 1050.0}, most=3) == [1000, 1000, 100]
    assert route([(("a",), 1000), (("b",), 100)], {"a": 800.0, "b": 300.0}, most=3) == [800, 300]


def test_overlapping_patterns_match_one_network(spark):
    r = random.Random(11)
    kinds = [["a"], ["a", "b"], ["b", "c"], [None], [None, "d"], ["e"], ["f", "g"], ["g"]]
    docs = spark.createDataFrame([(k, prose(k, r.randrange(1, 60)), r.choice(kinds)) for k in range(400)], "doc_id long, text string, source array<string>")
    out = mix_sources(docs, bucket_docs=16).collect()
    size = defaultdict(int)
    for x in out:
        size[json.dumps(sorted(x.source, key=lambda s: (s is None, s)))] += x.size
    names = sorted({s for p in size for s in json.loads(p)}, key=lambda s: (s is None, s or ""))
    total = {s: sum(v for p, v in size.items() if s in json.loads(p)) for s in names}
    want = dict(zip(names, targets([total[s] for s in names], [(1, 2, 3)[k % 3] for k in range(len(names))], sum(size.values()), 3)))
    flows = dict(zip(size, route([(json.loads(p), v) for p, v in size.items()], want, most=3)))
    taken = defaultdict(int)
    for x in out:
        assert abs(x.target - sum(want[s] for s in x.source)) < 1e-6 and x.source_size == sum(total[s] for s in x.source)
        taken[json.dumps(sorted(x.source, key=lambda s: (s is None, s)))] += x.taken
    assert abs(sum(flows.values()) - sum(taken.values())) <= 60 * len(flows)
    for s in names:  # the routes may differ, the sources' quotas may not be passed
        assert sum(taken.values()) <= sum(want.values()) + 60 * len(flows)
    with pytest.raises(Exception, match="most_memberships"):
        mix_sources(docs, most_memberships=3).count()


@pytest.mark.parametrize("bucket_docs", [8, 1000])
def test_mix_meets_its_targets(spark, bucket_docs):
    r = random.Random(3)
    texts = [prose(k, r.randrange(1, 40)) for k in range(600)]
    sources = [r.choice(["a", "b", "c", None, "é"]) if k % 3 else "hot" for k in range(600)]
    docs = table(spark, texts, sources=sources)
    out = mix_sources(docs, bucket_docs=bucket_docs).collect()
    assert len(out) == 600 and all(x.size == len(texts[x.doc_id].split()) and 0 <= x.taken <= 3 * x.size and x.taken == x.copies * x.size for x in out)
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for x in out:
        size[x.source] += x.size
        taken[x.source] += x.taken
        target[x.source] = x.target
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    want = targets([size[s] for s in names], [(1, 2, 3)[k % 3] for k in range(len(names))], sum(size.values()), 3)
    for s, t in zip(names, want):
        assert abs(target[s] - t) < 1e-6 and abs(taken[s] - t) <= 20
    assert all(x.source_size == size[x.source] for x in out)
    again = mix_sources(docs.repartition(7), bucket_docs=bucket_docs).collect()
    assert {x.doc_id: x.taken for x in again} == {x.doc_id: x.taken for x in out}


def test_mix_edges(spark):
    assert mix_sources(spark.createDataFrame([], SCHEMA)).count() == 0
    odd = spark.createDataFrame([(None, "a b", None, 1), (1, None, "s", 1), (2, "x y z", "s", 1), (2, "x y z", "s", 1)], "doc_id long, text string, source string, size int")
    out = mix_sources(odd).collect()
    assert len(out) == 4 and {x.size for x in out} == {0, 2, 3}
    arrays = spark.createDataFrame([(k, prose(k, 10), ["a", "b"] if k % 2 else ["b"]) for k in range(40)] + [(99, "q", None)], "doc_id long, text string, source array<string>")
    assert mix_sources(arrays).count() == 41


@pytest.fixture
def small_corpus(tmp_path, spark):
    r = random.Random(8)
    base = [prose(k, 80) for k in range(40)]
    near = [b.replace(" river ", " lake ", 1) for b in base[:10]]
    texts = base + base[:8] + near + [None, "", "12 34", "..."] + [prose(200 + k, 15) for k in range(30)]
    langs = [r.choice(["en", "de", None]) for _ in texts]
    spark.createDataFrame(rows(texts, langs), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path), texts


def test_pipeline_matches_plain(spark, small_corpus):
    folder, texts = small_corpus
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
        seen[name] = docs.collect()
    kept = [k for k, t in enumerate(texts) if any(c.isalpha() for c in t or "")]
    assert sorted(x.doc_id for x in seen["language_id"]) == kept
    exact = plain_exact([texts[k] for k in kept])
    kept = [k for i, k in enumerate(kept) if exact[i][2]]
    assert sorted(x.doc_id for x in seen["exact_dedup"]) == kept
    near = plain_near([texts[k] for k in kept], 5, 80)
    kept = [k for i, k in enumerate(kept) if near[i][2]]
    assert sorted(x.doc_id for x in seen["near_dedup"]) == kept
    assert {x.doc_id for x in seen["mixing"]} <= set(kept)
    mixed = sum(len(reference_ids(x.text)) for x in seen["mixing"])
    assert sum(x.length for x in seen["packing"]) == mixed
    run = corpus_pipeline.run(spark, folder)
    assert sorted((x.doc_id, x.piece, x.ids_crc32) for x in run.collect()) == sorted((x.doc_id, x.piece, x.ids_crc32) for x in seen["packing"])
    assert corpus_pipeline.ORACLE_SQL is None and UNKNOWN == "und"
