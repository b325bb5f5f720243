"""Exact, line and near deduplication against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sieveline.llm.exact_dedup import exact_dedup
from sieveline.llm.line_dedup import LineRuns, batch_bounds, line_dedup, line_hashes
from sieveline.llm.minhash import _merged, near_duplicates
from sieveline.operators.graph import components
from tests.llm.helpers import ODD, SCHEMA, prose, table

WS = re.compile(r"[\x20\x09-\x0D]+")


def plain_exact(texts):
    groups = defaultdict(list)
    for k, t in enumerate(texts):
        groups[WS.sub(" ", t or "")].append(k)
    return {k: (g[0], len(g), k == g[0]) for g in groups.values() for k in g}


@pytest.mark.parametrize("most_buckets", [1 << 22, 4])
def test_exact_matches_plain(spark, most_buckets):
    r = random.Random(5)
    texts = ODD + [prose(r.randrange(40), 12) for _ in range(200)] + [prose(3, 400) + str(k % 3) for k in range(30)]
    out = exact_dedup(table(spark, texts), most_buckets=most_buckets).collect()
    assert {x.doc_id: (x.keep_id, x.group_size, x.kept) for x in out} == plain_exact(texts)
    read = {x.doc_id: x.full_hash for x in out if x.full_hash}
    assert all(h == hashlib.sha256(WS.sub(" ", texts[k] or "").encode()).hexdigest() for k, h in read.items())


def test_exact_reads_only_survivors_in_full(spark):
    out = exact_dedup(table(spark, [prose(k, 50 + k) for k in range(40)] + ["same", "same"])).collect()
    assert sum(x.full_hash is not None for x in out) <= 4


def test_exact_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_dedup(empty).count() == 0
    odd = spark.createDataFrame([(None, "x", "a"), (None, "x", "b"), (3, "x", "c"), (4, None, "d"), (4, None, "d")], "doc_id long, text string, kept string")
    out = exact_dedup(odd)
    assert sorted(out.columns) == sorted(["doc_id", "text", "kept", "keep_id", "group_size", "full_hash"])
    got = sorted(((x.doc_id, x.keep_id, x.group_size, x.kept) for x in out.collect()), key=str)
    assert got == sorted([(None, 3, 3, False), (None, 3, 3, False), (3, 3, 3, True), (4, 4, 2, True), (4, 4, 2, True)], key=str)


def plain_lines(texts, least=10):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    owner, docs = {}, defaultdict(set)
    for k, t in enumerate(texts):
        for x in (t or "").split("\n"):
            owner.setdefault(key(x), k)
            docs[key(x)].add(k)
    out = {}
    for k, t in enumerate(texts):
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= least and len(docs[key(x)]) > 1 and owner[key(x)] != k)]
        out[k] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize("batches,fanout", [(1, 3), (7, 2)])
def test_lines_match_plain(spark, batches, fanout):
    r = random.Random(2)
    pool = [prose(k, 4) for k in range(60)] + ["short", "", "  Padded line of text \t", "padded LINE of text", "Äpfel und Birnen", "äpfel und Birnen"]
    texts = ODD + ["\n".join(r.choice(pool) for _ in range(r.randrange(1, 30))) for _ in range(120)]
    out = line_dedup(table(spark, texts), batches=batches, fanout=fanout).collect()
    assert {x.doc_id: (x.n_lines, x.n_dropped, x.kept_text) for x in out} == plain_lines(texts)


def test_line_runs_compact_and_go_on(spark):
    runs = LineRuns(spark, fanout=2)
    for k in range(5):
        docs = spark.createDataFrame([(10 * k, f"common line here\nonly in batch {k}!!")], "doc_id long, text string")
        runs.add(line_hashes(docs, "doc_id", "text", 10))
    assert sum(map(len, runs.levels)) <= 3 and sum(t.count() for t in runs.tables()) == 6
    more = spark.createDataFrame([(99, "Common line here\nfresh line here")], "doc_id long, text string")
    out = line_dedup(more, runs=runs).first()
    assert (out.n_dropped, out.kept_text) == (1, "fresh line here")


def test_runs_are_merged_as_they_lie(spark):
    runs = LineRuns(spark, fanout=3)
    docs = [spark.createDataFrame([(100 * k + i, prose(50 * k + i, 8)) for i in range(50)], "doc_id long, text string") for k in range(3)]
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for d in docs[:2]:
            runs.add(line_hashes(d, "doc_id", "text", 10))
        plan = runs.new_lines(line_hashes(docs[2], "doc_id", "text", 10))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert plan.count("SortMergeJoin") == 2 and plan.count("Exchange ") == 1 and plan.count("Sort [") == 1


def test_lines_of_text_ids_and_outliers(spark):
    rows = [(f"d{k:03d}", f"common line here\nown line number {k}") for k in range(40)]
    out = line_dedup(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert {x.doc_id: x.n_dropped for x in out} == {d: int(d != "d000") for d, _ in rows}
    ids = spark.createDataFrame([(k if k < 99 else 1 << 60, prose(k, 5)) for k in range(100)], "doc_id long, text string")
    bounds = batch_bounds(ids, "doc_id", 4)
    assert len(bounds) == 3 and all(abs(b - want) <= 8 for b, want in zip(bounds, (25, 50, 75)))


def test_lines_edges(spark):
    assert line_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    odd = spark.createDataFrame([(None, "a common line\nx", 1), (2, "a common line", 1), (3, "a common line\na common line", 1), (3, "y\na common line", 1)], "doc_id long, text string, n_lines int")
    out = [(x.doc_id, x.n_lines, x.n_dropped) for x in line_dedup(odd).collect()]
    assert (None, 2, 0) in out and (2, 1, 0) in out and (3, 2, 2) in out


def plain_near(texts, words, percent):
    sets = []
    for t in texts:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = [x for x in WS.split(w) if x]
        sets.append({tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {k: (len(s), find(k), find(k) == k) for k, s in enumerate(sets)}


def edited(text, changes, seed):
    r, w = random.Random(seed), text.split()
    for _ in range(changes):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("leaf,part_rows,depth", [(160, 96, 4), (6, 8, 1)])
def test_near_matches_plain(spark, leaf, part_rows, depth):
    texts = [t for t in ODD if len(t or "") < 10_000] + ["one two three", "One  TWO three", "x y"]
    for k in range(12):
        base = prose(100 + k, 120)
        texts += [base] + [edited(base, n, 7 * k + n) for n in (1, 2, 3, 4, 6, 9)]
    hub = prose(999, 200)
    texts += [edited(hub, 1 + k % 6, 5000 + k) for k in range(60)]
    shared = prose(77, 40)
    texts += [f"{shared} {prose(3000 + k, 60)}" for k in range(30)]
    out = near_duplicates(table(spark, texts), words=4, leaf=leaf, part_rows=part_rows, depth=depth).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in out} == plain_near(texts, 4, 80)


def test_near_edges(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    odd = spark.createDataFrame([(None, prose(1), 1), (5, prose(1), 1), (6, prose(1), 1), (6, prose(1), 1), (7, None, 1), (8, " ", 1)], "doc_id long, text string, kept int")
    out = near_duplicates(odd)
    got = sorted(((x.doc_id, x.component_id, x.kept) for x in out.collect()), key=str)
    assert got == sorted([(None, None, True), (5, 5, True), (6, 5, False), (6, 5, False), (7, 7, True), (8, 8, True)], key=str)
    assert out.where(F.col("doc_id") == 5).first().n_shingles == 56  # five-word shingles


def test_near_of_long_texts_and_repeated_ids(spark):
    long = prose(4, 40_000)
    data = [(1, long), (2, edited(long, 30, 1)), (3, prose(9, 40_000)), (5, prose(1)), (5, prose(2)), (4, prose(2)), (5, prose(1))]
    want = [(1, 1), (2, 1), (3, 3), (4, 4), (5, 4), (5, 5), (5, 5)]
    plain = near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert sorted((x.doc_id, x.component_id) for x in plain) == want
    more = near_duplicates(spark.createDataFrame([(*d, 0) for d in data], "doc_id long, text string, n_shingles int")).collect()
    assert sorted((x.doc_id, x.component_id) for x in more) == want
    assert {x.doc_id: x.n_shingles for x in plain} == {x.doc_id: x.n_shingles for x in more}


def test_later_links_join_classes(spark):
    first, later = [(2, 1), (3, 2), (6, 5), (9, 8)], [(3, 6), (9, 20), (31, 30), (1, 3), (31, 20)]
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    got = {r.node: r.root for r in _merged(components(frame(first)), frame(later)).collect()}
    assert got == {r.node: r.root for r in components(frame(first + later)).collect()}
    assert {r.node: r.root for r in _merged(components(frame(first)), frame([(3, 1)])).collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 8: 8, 9: 8}
