"""Close codes of any number: every pair that a band of equal bits brings together, without a cap.

Equal codes meet as one.  A band whose codes are too many for one comparison is
split by further bits: codes that differ in at most ``d`` of them agree in one
of ``d + 1`` parts, so a code goes on once for each part, together with the
codes that agree with it there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.operators.curate import hamming
from sieveline.sources.scratch import materialise, rekeyed

LEVELS = 3
BLOCK = 4096


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def part_masks(parts: int, level: int) -> list[int]:
    """64 bits dealt to ``parts`` masks, otherwise on each level."""
    order = np.random.default_rng([parts, level]).permutation(64)
    return [sum(1 << int(i) for i in order[k::parts]) for k in range(parts)]


def band_masks(n_bands: int) -> list[int]:
    width = 64 // n_bands
    return [((1 << width) - 1) << (width * b) for b in range(n_bands)]


def _spread(rows: DataFrame, masks: list[int], node: Column) -> DataFrame:
    """(code, node): a row for each mask, with codes that agree in it and in ``node`` in one node."""
    keys = [F.xxhash64(node, F.lit(k), F.col("code").bitwiseAND(F.lit(_signed(m)).cast("long"))) for k, m in enumerate(masks)]
    return rows.select("code", F.explode(F.array(*keys)).alias("node"))


def _compared(codes: np.ndarray, masks: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Places i < j of the codes that share a band and differ in at most ``distance`` bits."""
    found = []
    for i in range(len(codes) - 1):
        differ = codes[i] ^ codes[i + 1 :]
        near = np.flatnonzero(np.bitwise_count(differ) <= distance)
        near = near[((differ[near, None] & masks[None]) == 0).any(axis=1)]
        found.append(np.stack([np.full(len(near), i), near + i + 1]))
    i, j = np.concatenate(found, axis=1) if found else np.zeros((2, 0), int)
    return i, j


def _starred(codes: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each place and the first place that its links reach, for places that aren't first."""
    first = np.arange(len(codes))
    while True:
        low = np.minimum(first[i], first[j])
        then = first.copy()
        np.minimum.at(then, i, low)
        np.minimum.at(then, j, low)
        then = then[then]
        if np.array_equal(then, first):
            break
        first = then
    b = np.flatnonzero(first != np.arange(len(codes)))
    return first[b], b


def _of_nodes(rows: DataFrame, n_bands: int, distance: int, stars: bool) -> DataFrame:
    """(x, y): what the codes of each node have in common; a task meets one node at a time."""
    masks = np.array(band_masks(n_bands), np.uint64)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = pd.DataFrame({"code": [], "node": []}, dtype=np.int64)
        for frame in frames:
            held = pd.concat([left, frame])
            ends = np.flatnonzero(np.diff(held["node"].to_numpy())) + 1
            cut = ends[-1] if len(ends) else 0
            left = held.iloc[cut:]  # the last node may go on
            yield from nodes(held.iloc[:cut])
        yield from nodes(left)

    def nodes(held: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if held.empty:
            return
        code, node = held["code"].to_numpy(np.int64), held["node"].to_numpy()
        x, y = [], []
        for own in np.split(code, np.flatnonzero(np.diff(node)) + 1):
            own = np.sort(own)
            i, j = _compared(own.view(np.uint64), masks, distance)
            if stars and len(i):
                i, j = _starred(own, i, j)
            x.append(own[i])
            y.append(own[j])
        yield pd.DataFrame({"x": np.concatenate(x), "y": np.concatenate(y)})

    return rows.repartition("node").sortWithinPartitions("node").mapInPandas(run, "x long, y long")


def close_codes(codes: DataFrame, *, distance: int = 5, n_bands: int = 4, node: int = 400, stars: bool = True, levels: int = LEVELS) -> DataFrame:
    """(x, y) with x < y over the distinct values of ``code``: links of codes that share one of
    ``n_bands`` bands and differ in at most ``distance`` bits.

    With ``stars`` each comparison tells only a star for what it has linked: the
    components are those of all pairs, in at most as many rows as codes met.
    Without, all pairs.  Nodes of up to ``node`` codes are compared in a task;
    larger ones are split by ``distance`` + 1 parts of the bits, level by level.
    Each level makes up to that many rows of one, which spares nothing among
    codes that are all close to each other.  So after ``levels`` levels nodes that
    are still too large are compared with all of themselves, in blocks: quadratic
    in the distinct codes of a node, whose codes by then agree in half their bits.
    Null codes are ignored.
    """
    rows = materialise(codes.select("code").where("code IS NOT NULL").distinct(), "codes")
    rows = materialise(_spread(rows, band_masks(n_bands), F.lit(0).cast("long")), "nodes")
    out = None
    for level in range(levels + 1):
        sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        sizes = sizes.select(rekeyed(F.col("node")).alias("__node"), "n")
        rows = materialise(rows.join(sizes, rows.node == sizes["__node"]).drop("__node"), "nodes")
        large = rows.where(F.col("n") > node)
        found = _of_nodes(rows.where(F.col("n") <= node).select("code", "node"), n_bands, distance, stars)
        out = found if out is None else out.union(found)
        if large.isEmpty():
            break
        if level == levels:
            out = out.union(_joined(large, n_bands, distance))
            break
        # A code that went to one node by several parts of a level goes on once.
        rows = materialise(_spread(large, part_masks(distance + 1, level), F.col("node")).distinct(), "nodes")
    return materialise(out.distinct(), "close")


def _joined(rows: DataFrame, n_bands: int, distance: int) -> DataFrame:
    """(x, y) of large nodes, whose codes are dealt to blocks of about ``BLOCK``; each block meets the node."""
    blocks = F.ceil(F.col("n") / BLOCK)
    a = rows.select("node", F.col("code").alias("x"), F.pmod(F.xxhash64("code"), blocks).alias("block"))
    b = rows.select(F.col("node").alias("of"), F.col("code").alias("y"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("met"))
    differ = F.col("x").bitwiseXOR(F.col("y"))
    shared = F.lit(False)
    for m in band_masks(n_bands):
        shared |= differ.bitwiseAND(F.lit(_signed(m)).cast("long")) == 0
    near = (hamming(F.col("x"), F.col("y")) <= distance) & shared
    return a.join(b, (F.col("node") == F.col("of")) & (F.col("block") == F.col("met")) & (F.col("x") < F.col("y")) & near).select("x", "y")


def close_links(codes: DataFrame, **how) -> DataFrame:
    """(a, b) over the ids of ``codes`` (id, code): each id to the first id with its code, and
    the first ids of codes that ``close_codes`` links.  Ids without a code have no link."""
    rows = codes.select(F.col("id").alias("b"), "code").where("code IS NOT NULL")
    first = rows.groupBy("code").agg(F.min("b").alias("a"))
    first = materialise(first, "first")
    keyed = first.select(rekeyed(F.col("code")).alias("k"), "a")
    own = rows.join(keyed, rows.code == F.col("k")).where("a <> b").select("a", "b")
    links = close_codes(first, **how)
    x, y = (first.select(F.col("code").alias(c), F.col("a").alias(f"id_{c}")) for c in "xy")
    return own.union(links.join(x, "x").join(y, "y").select("id_x", "id_y"))
