"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A cell holds a count, the xor of digests and the xor of their checks.  Two
sketches of one size subtract cell by cell; peeling cells with a single digest
recovers the digests in which two versions differ.  A fingerprint is large
enough for the edit of ``fingerprint_versions``.  Where peeling gets stuck, both
are sketched again at twice the size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.shared import documents, or_empty
from sieveline.sources.scratch import materialise

U64 = np.uint64
HASHES = 3
#: A paragraph ends at a line feed, and within long ones after a word whose hash falls in one of so many classes.
PIECE_WORDS = 16


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U64(29))) * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(32))


def _check(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys ^ U64(0xA0761D6478BD642F)) >> U64(32)).astype(np.uint32)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_WORDS = _WordHash()


def digests(text: str) -> np.ndarray:
    """Distinct 64-bit digests of a text's paragraphs; a repeated paragraph is
    told apart by how often it came before."""
    h, last = [], []
    for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
        words = line.split()
        if words:
            h += map(_WORDS.__getitem__, words)
            last.append(len(h) - 1)
    if not h:
        return np.empty(0, U64)
    h = np.array(h, U64)
    ends = h % U64(PIECE_WORDS) == 0
    ends[last] = True
    begin = np.r_[0, np.flatnonzero(ends)[:-1] + 1]
    place = np.arange(len(h)) - np.repeat(begin, np.diff(np.r_[begin, len(h)]))
    d = _mix(np.add.reduceat(_mix(h + place.astype(U64) * U64(0x9E3779B97F4A7C15)), begin))
    order = np.argsort(d, kind="stable")
    s = d[order]
    new = np.r_[True, s[1:] != s[:-1]]
    copy = np.arange(len(s)) - np.repeat(np.flatnonzero(new), np.diff(np.r_[np.flatnonzero(new), len(s)]))
    return np.where(copy > 0, _mix(s + copy.astype(U64) * U64(0xD6E8FEB86659FD93)), s)


class Sketches:
    """Several sketches side by side: sketch k has ``size[k]`` cells for each of the hashes."""

    def __init__(self, size: np.ndarray):
        self.size = size.astype(np.int64)
        self.begin = HASHES * (np.cumsum(self.size) - self.size)
        cells = int(HASHES * self.size.sum())
        self.count, self.key, self.check = np.zeros(cells, np.int8), np.zeros(cells, U64), np.zeros(cells, np.uint32)

    def cells(self, keys: np.ndarray, of: np.ndarray) -> list[np.ndarray]:
        size, begin = self.size[of].astype(U64), self.begin[of]
        return [begin + j * self.size[of] + (_mix(keys + U64(j + 1)) % size).astype(np.int64) for j in range(HASHES)]

    def change(self, keys: np.ndarray, of: np.ndarray, by: np.ndarray | int) -> None:
        """Insert (by = 1) or remove (by = -1) keys; counts are modulo 256."""
        check = _check(keys)
        for at in self.cells(keys, of):
            np.add.at(self.count, at, np.int8(by) if np.isscalar(by) else by.astype(np.int8))
            np.bitwise_xor.at(self.key, at, keys)
            np.bitwise_xor.at(self.check, at, check)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Empty the sketches: (sketch, sign) of each digest found, and which sketches came out empty."""
        of_cell = np.repeat(np.arange(len(self.size)), HASHES * self.size)
        found, signs, taken = [], [], 0
        look = np.flatnonzero(self.count)
        while len(look) and taken <= len(self.count):  # a digest that isn't one, let through by its check, could come and go for ever
            pure = look[np.abs(self.count[look]) == 1]
            pure = pure[self.check[pure] == _check(self.key[pure])]
            if len(pure):
                pure = pure[np.any([at == pure for at in self.cells(self.key[pure], of_cell[pure])], axis=0)]
            if not len(pure):
                break
            # A digest may be alone in several of its cells: take it once.
            pair = np.stack([of_cell[pure].astype(U64), self.key[pure]])
            _, first = np.unique(pair, axis=1, return_index=True)
            pure = pure[first]
            keys, of, sign = self.key[pure].copy(), of_cell[pure], self.count[pure].astype(np.int64)
            found.append(of)
            signs.append(sign)
            taken += len(of)
            self.change(keys, of, -sign)
            look = np.unique(np.concatenate(self.cells(keys, of)))
        left = np.bincount(of_cell, weights=(self.count != 0) | (self.key != 0), minlength=len(self.size))
        none = np.empty(0, np.int64)
        return np.concatenate([none, *found]), np.concatenate([none, *signs]), left == 0

    def packed(self, number: np.ndarray) -> list[bytes]:
        """Each sketch as bytes: cells a hash and digests (4 each), then 13 for each
        cell, its count modulo 256, the digests' xor and the xor of their checks."""
        out = []
        for b, s, n in zip(self.begin.tolist(), self.size.tolist(), number.tolist()):
            part = slice(b, b + HASHES * s)
            out.append(np.array([s, n], "<u4").tobytes() + self.count[part].tobytes() + self.key[part].astype("<u8").tobytes() + self.check[part].astype("<u4").tobytes())
        return out


def unpacked(print_: bytes) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
    """Cells a hash, digests, and the cells' counts, xors of digests and of checks, a row for each hash."""
    s, n = np.frombuffer(print_, "<u4", 2).tolist()
    cells = HASHES * s
    count, key, check = np.frombuffer(print_, np.int8, cells, 8), np.frombuffer(print_, "<u8", cells, 8 + cells), np.frombuffer(print_, "<u4", cells, 8 + 9 * cells)
    return s, n, count.reshape(HASHES, s), key.reshape(HASHES, s), check.reshape(HASHES, s)


def subtracted(a: list[bytes], b: list[bytes]) -> Sketches:
    """The differences of pairs of fingerprints.

    Sizes are powers of two, so that the larger of a pair folds to the smaller
    one's size.
    """
    pairs = [(unpacked(x), unpacked(y)) for x, y in zip(a, b)]
    made = Sketches(np.array([min(x[0], y[0]) for x, y in pairs], np.int64))
    for (x, y), begin, s in zip(pairs, made.begin.tolist(), made.size.tolist()):
        part = slice(begin, begin + HASHES * s)
        fold = lambda v, how: (v if v.shape[1] == s else how.reduce(v.reshape(HASHES, -1, s), axis=1, dtype=v.dtype)).ravel()  # noqa: B023, E731
        made.count[part] = fold(x[2], np.add) - fold(y[2], np.add)
        made.key[part] = fold(x[3], np.bitwise_xor) ^ fold(y[3], np.bitwise_xor)
        made.check[part] = fold(x[4], np.bitwise_xor) ^ fold(y[4], np.bitwise_xor)
    return made


def sketch_size(n: np.ndarray) -> np.ndarray:
    """Cells a hash for n digests: a power of two, 8 at least.

    The edit of a third of a text removes n / 3 digests, adds as many and
    changes those at its ends.  Three hashes peel from 1.22 cells a difference
    on if there are many; this has 1.5, and 15 more for small texts.
    """
    cells = 1.5 * (2 * n / 3 + 2) + 15
    return (1 << np.maximum(3, np.ceil(np.log2(cells / HASHES)).astype(np.int64))).astype(np.int64)


def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    size = [len(s) for s in sets]
    return np.concatenate([np.empty(0, U64), *sets]), np.repeat(np.arange(len(sets)), size)


def sketches(sets: list[np.ndarray]) -> list[bytes]:
    """The fingerprint of each set of digests."""
    n = np.array([len(s) for s in sets], np.int64)
    made = Sketches(sketch_size(n))
    made.change(*_flat(sets), 1)
    return made.packed(n)


def likeness(a: list[np.ndarray], b: list[np.ndarray], prints: tuple[list[bytes], list[bytes]] | None = None, tries: int = 12) -> np.ndarray:
    """Jaccard likeness of pairs of digest sets from their fingerprints' differences.

    The fingerprints (``prints``, or else made here) are subtracted and peeled;
    pairs that aren't recovered are sketched again at twice the larger one's
    size, and so on.  Two empty sets are alike.
    """
    na, nb = (np.array([len(s) for s in x], np.int64) for x in (a, b))
    differ, todo = np.zeros(len(a), np.int64), np.arange(len(a))
    size = sketch_size(np.maximum(na, nb))
    made = subtracted(*(prints or (sketches(a), sketches(b))))
    for k in range(tries):
        of, _, whole = made.peel()
        differ[todo] = np.bincount(of, minlength=len(todo))
        todo = todo[~whole]
        if not len(todo):
            break
        size[todo] *= 2
        made = Sketches(size[todo])
        made.change(*_flat([a[i] for i in todo]), 1)
        made.change(*_flat([b[i] for i in todo]), -1)
    for i in todo:  # never seen: two digests that share all cells at every size
        differ[i] = len(np.setxor1d(a[i], b[i]))
    common = (na + nb - differ) / 2
    return np.where(na + nb > 0, common / np.maximum(common + differ, 1), 1.0)


#: What the tasks return: digest and sketches as bytes, written as text in the end.
RESULT = "n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _versions(ids: pa.Array, texts: list[str], after: list[str], chunk: int = 128) -> Iterator[list]:
    """Result columns for documents with their next documents' texts."""
    for at in range(0, len(texts), chunk):
        text, follow = texts[at : at + chunk], after[at : at + chunk]
        cut = [len(t) // 3 for t in text]
        edited = [t[: len(t) - n] + f[:n] for t, f, n in zip(text, follow, cut)]
        # Mostly a document's next one is the row below it.
        below = [k + 1 < len(text) and follow[k] is text[k + 1] for k in range(len(text))]
        others = [f for f, near in zip(follow, below) if not near]
        n, sets = len(text), [digests(t) for t in [*text, *others]]
        prints = sketches(sets)
        rest = iter(range(n, len(sets)))
        after_of = [k + 1 if near else next(rest) for k, near in enumerate(below)]
        changed = [digests(t) for t in edited]
        changed_prints = sketches(changed)
        yield [
            ids.slice(at, chunk),
            pa.array([len(t) for t in text], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in edited]),
            pa.array(prints[:n]),
            pa.array(changed_prints),
            pa.array(likeness(sets[:n], changed, (prints[:n], changed_prints))),
            pa.array(likeness(sets[:n], [sets[k] for k in after_of], (prints[:n], [prints[k] for k in after_of]))),
        ]


#: Bytes of text in a part.
PART_BYTES = 12_000_000


def fingerprint_versions(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last third of the code points replaced by as many
    of the next document's first ones, in descending order of ids; after the
    last document comes the first.  Bounds come from ranges of the ids alone.
    Each range's texts go to one task, the only exchange of texts, together
    with a copy of the next range's first document, so that fingerprints are
    made after the exchange and never written between steps.

    Null texts count as empty.  Null ids come last; rows that repeat an id are
    ordered by a hash of their text.  An empty table gives an empty result, and
    a single document is its own next one.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), or_empty(F.col(f"`{text_col}`")).alias("text"))
    order = F.col("doc_id").desc_nulls_last()
    result = f"doc_id {id_type}, {RESULT}"
    n_bytes = rows.agg(F.sum(F.octet_length("text").cast("long") + 16)).first()[0]
    if n_bytes is None:
        return spark.createDataFrame([], result.replace("binary", "string"))

    def first_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), batch.column(0).slice(0, 1)], names=["part", "doc_id"])
                return

    ids = rows.select("doc_id").repartitionByRange(max(1, -(-n_bytes // part_bytes)), order).sortWithinPartitions(order)
    firsts = [r[1] for r in sorted(ids.mapInArrow(first_of, f"part int, doc_id {id_type}").collect(), key=lambda r: r[0])]
    n = len(firsts)
    bounds = F.broadcast(spark.createDataFrame([(firsts,)], f"firsts array<{id_type}>"))  # an id for each part

    def reached(k: Column) -> Column:
        return (k < n) & (F.col("doc_id").isNull() | F.coalesce(F.col("doc_id") <= F.get("firsts", k), F.lit(False)))

    halves = F.array(*[F.lit(1 << b) for b in reversed(range(n.bit_length()))])
    part = F.aggregate(halves, F.lit(0), lambda at, step: F.when(reached(at + step), at + step).otherwise(at))
    own = rows.crossJoin(bounds).select(part.alias("part"), F.lit(0).alias("role"), F.xxhash64("text").alias("h"), "doc_id", "text")
    starts = spark.createDataFrame([((k - 1) % n, i) for k, i in enumerate(firsts)], f"part int, first {id_type}")
    heads = rows.join(F.broadcast(starts), F.col("doc_id").eqNullSafe(F.col("first"))).groupBy("part").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    heads = materialise(heads, "heads").select("part", F.lit(1).alias("role"), F.lit(0).cast("long").alias("h"), F.lit(None).cast(id_type).alias("doc_id"), "text")
    dealt = own.unionByName(heads).repartitionById(n, F.col("part")).sortWithinPartitions("role", order, "h")
    names = ["doc_id", *(c.split()[0] for c in RESULT.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not len(batch):
                continue
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            if held is not None:
                ids, texts = pa.concat_arrays([held[0], ids]), [held[1], *texts]
            held = (ids.slice(len(ids) - 1), texts[-1])  # in the end the head of the next part, which has no row here
            for columns in _versions(ids.slice(0, len(ids) - 1), texts[:-1], texts[1:]):
                yield pa.RecordBatch.from_arrays(columns, names=names)

    out = dealt.select("doc_id", "text").mapInArrow(run, result)
    text = {"edited_sha256": F.lower(F.hex("edited_sha256")), "fingerprint": F.base64("fingerprint"), "edited_fingerprint": F.base64("edited_fingerprint")}
    return out.select(*[text.get(c, F.col(c)).alias(c) for c in names])


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_versions(documents(spark, sf_dir).select("doc_id", "text"))
