"""Phrase collocations by hashed bucket counts and Apriori pruning.

Pass 1 counts words exactly and, by hash bucket, pairs of words.  Pass k counts
exactly the phrases of k words whose two parts of k - 1 words may be frequent
and whose bucket is, and by bucket the phrases of k + 1 words whose two parts
are such candidates.  What passes hand on is two bitmaps of fixed size, so
nothing that is broadcast grows with the corpus; counts of phrases stay in
tables.  Bucket counts stop at the threshold, which keeps every decision.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieveline.llm.shared import BATCH_BYTES, documents, or_empty, small_batches
from sieveline.sources.scratch import materialise, rekeyed

U64 = np.uint64
#: Buckets of a pass, as bits, and of a segment, in which counts are merged.
BITS, SEGMENT = 24, 14
#: Ways that the counts of a segment are first merged in, tasks that do it, and rows of counts that a task holds.
SALTS, MERGERS, HELD = 64, 16, 500_000
#: What ends a piece (fixed).
END_OF_PIECE = re.compile(r"[.,;:!?\x0A-\x0D]")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: 0: part of a word, 1: between words, 2: between pieces.
KIND = np.zeros(256, np.uint8)
KIND[[9, 32]] = 1
KIND[[*b".,;:!?", *range(10, 14)]] = 2

EMITTED = "lang string, phrase string, c long, segment int, salt int, counts binary"


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(31))) * U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U64(29))) * U64(0xBF58476D1CE4E5B9)
    return x ^ (x >> U64(32))


def word_hashes(words: pa.Array) -> np.ndarray:
    """Hashes of strings: their bytes times powers of an odd number, summed and mixed with the length."""
    joined = pa.concat_arrays([words])  # starts at its buffers' beginning
    offsets = np.frombuffer(joined.buffers()[1], np.int32, len(words) + 1) if len(words) else np.zeros(1, np.int32)
    size = np.diff(offsets)
    data = np.frombuffer(joined.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    power = np.cumprod(np.full(int(size.max(initial=0)), 0x9E3779B97F4A7C15, U64))
    place = np.arange(len(data)) - np.repeat(offsets[:-1] - offsets[0], size)
    upto = np.concatenate([np.zeros(1, U64), np.cumsum((data.astype(U64) + U64(1)) * power[place], dtype=U64)])
    at = offsets - offsets[0]
    return mixed(upto[at[1:]] - upto[at[:-1]] + size.astype(U64))


def longer(gram: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases with a word more."""
    return mixed(gram * U64(0xD6E8FEB86659FD93) + word)


def bucket_of(gram: np.ndarray, lang: np.ndarray) -> np.ndarray:
    return (mixed(gram ^ lang) >> U64(64 - BITS)).astype(np.int64)


class Words:
    """The words of some parts of texts in order: ``code`` in ``known``, ``piece`` and ``lang``."""

    def __init__(self, parts: list[tuple[int, str]], langs: list[str]):
        data = "\n".join([t for _, t in parts]).encode("utf-8", "surrogatepass")
        raw = LOWER[np.frombuffer(data, np.uint8)]
        kind = KIND[raw]
        inside = kind == 0
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        start, size = edge[::2], edge[1::2] - edge[::2]
        offsets = np.zeros(len(start) + 1, np.int32)
        np.cumsum(size, out=offsets[1:])
        found = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(raw[inside])).dictionary_encode()
        self.known = found.dictionary
        self.code = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[start]
        length = np.array([len(t.encode("utf-8", "surrogatepass")) + 1 for _, t in parts])
        of = np.searchsorted(np.cumsum(length), start, side="right")
        self.lang = np.array([n for n, _ in parts], np.int64)[of]
        self.langs = langs
        self.word = word_hashes(self.known)[self.code]
        self.salt = word_hashes(pa.array(langs, pa.string()))[self.lang]

    def __len__(self) -> int:
        return len(self.code)

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each place on, as far as there are so many."""
        out = self.word[: max(len(self) - k + 1, 0)].copy()
        for j in range(1, k):
            out = longer(out, self.word[j : j + len(out)])
        return out

    def whole(self, k: int) -> np.ndarray:
        """Whether the k words from a place on lie in one piece."""
        n = max(len(self) - k + 1, 0)
        return self.piece[:n] == self.piece[k - 1 : k - 1 + n]

    def buckets(self, gram: np.ndarray) -> np.ndarray:
        return bucket_of(gram, self.salt[: len(gram)])

    def counted(self, at: np.ndarray, k: int) -> pa.Table:
        """(lang, phrase, c) of the phrases of k words at the places ``at``, told apart by their words."""
        code = self.lang[at]
        for j in range(k):
            code = np.unique(code * len(self.known) + self.code[at + j], return_inverse=True)[1] if len(at) else code
        _, first, c = np.unique(code, return_index=True, return_counts=True)
        place = at[first]
        parts = [self.known.take(pa.array(self.code[place + j])) for j in range(k)]
        phrase = pc.binary_join_element_wise(*parts, " ") if k > 1 else parts[0]
        return pa.table({"lang": pa.array(self.langs, pa.string()).take(pa.array(self.lang[place])), "phrase": phrase, "c": pa.array(c.astype(np.int64))})


class Tally:
    """Counts of a task: exact ones, handed out beyond ``HELD`` rows, and one byte for each bucket."""

    def __init__(self, most: int):
        self.tables: list[pa.Table] = []
        self.rows, self.most, self.ceiling = 0, HELD, most
        self.buckets = np.zeros(1 << BITS, np.uint8)

    def add(self, table: pa.Table) -> Iterator[pa.RecordBatch]:
        self.tables.append(table)
        self.rows += len(table)
        if self.rows > self.most:
            merged = self.merged()
            if len(merged) > HELD:
                yield from self.emit(merged)
                merged = merged.slice(0, 0)
            self.tables, self.rows, self.most = [merged], len(merged), len(merged) + HELD

    def merged(self) -> pa.Table:
        joined = pa.concat_tables(self.tables)
        return joined.group_by(["lang", "phrase"]).aggregate([("c", "sum")]).rename_columns(["lang", "phrase", "c"])

    def emit(self, t: pa.Table) -> Iterator[pa.RecordBatch]:
        for b in t.combine_chunks().to_batches(50_000):
            none = [pa.nulls(len(b), k) for k in (pa.int32(), pa.int32(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns, *none], names=["lang", "phrase", "c", "segment", "salt", "counts"])

    def count_buckets(self, found: np.ndarray) -> None:
        which, c = np.unique(found, return_counts=True)
        self.buckets[which] = np.minimum(self.buckets[which] + c, self.ceiling).astype(np.uint8)

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.tables:
            yield from self.emit(self.merged())
        parts, salt = self.buckets.reshape(-1, 1 << SEGMENT), TaskContext.get().partitionId() % SALTS
        some = np.flatnonzero(parts.any(axis=1))
        for begin in range(0, len(some), 64):
            which = some[begin : begin + 64]
            empty = [pa.nulls(len(which), k) for k in (pa.string(), pa.string(), pa.int64())]
            packed = pa.array([squeezed(parts[n]) for n in which], pa.binary())
            yield pa.RecordBatch.from_arrays([*empty, pa.array(which.astype(np.int32)), pa.array(np.full(len(which), salt, np.int32)), packed], names=["lang", "phrase", "c", "segment", "salt", "counts"])


def has(bits: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Whether the bit of a bucket is set."""
    return (bits[bucket >> 3] >> (7 - (bucket & 7)).astype(np.uint8)) & 1 > 0


def squeezed(counts: np.ndarray) -> bytes:
    return pa.compress(counts.tobytes(), codec="lz4_raw", asbytes=True)


def expanded(data: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, decompressed_size=1 << SEGMENT, codec="lz4_raw", asbytes=True), np.uint8)


def parts_of(text: str, most: int = BATCH_BYTES // 8) -> Iterator[str]:
    """A text, cut between pieces where it is long."""
    at = 0
    while len(text) - at > most and (cut := END_OF_PIECE.search(text, at + most)):
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:]


def word_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    """The words of (text, lang) rows, half a million characters at a time."""
    for batch in batches:
        parts: list[tuple[int, str]] = []
        numbers: dict[str, int] = {}
        size = 0
        for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
            for part in parts_of(text.as_py()):
                parts.append((numbers.setdefault(lang, len(numbers)), part))
                size += len(part)
                if size > BATCH_BYTES // 8:
                    yield Words(parts, list(numbers))
                    parts, size = [], 0
        if parts:
            yield Words(parts, list(numbers))


def one_pass(k: int, last: bool, least: int, known: Callable[[], tuple[np.ndarray, np.ndarray]]) -> Callable:
    """Pass k: counts candidates of k words and, unless it is the ``last``, buckets of k + 1 words.

    ``known`` gives the bitmaps: buckets of frequent phrases of k - 1 words, and frequent buckets of phrases of k words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shorter, frequent = known() if k > 1 else (None, None)
        tally = Tally(least)
        for words in word_lists(batches):
            candidate = words.whole(k)
            if not len(candidate):
                continue
            gram = words.grams(k - 1) if k > 1 else words.word
            if k > 1:
                part = has(shorter, words.buckets(gram))
                candidate &= part[: len(candidate)] & part[1 : len(candidate) + 1]
                gram = longer(gram[: len(candidate)], words.word[k - 1 :])
                candidate &= has(frequent, words.buckets(gram))
            yield from tally.add(words.counted(np.flatnonzero(candidate), k))
            if not last and len(candidate) > 1:
                wider = words.whole(k + 1) & candidate[:-1] & candidate[1:]
                at = np.flatnonzero(wider)
                tally.count_buckets(bucket_of(longer(gram[at], words.word[at + k]), words.salt[at]))
        yield from tally.rest()
        pa.default_memory_pool().release_unused()

    return run


def _summed(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """A row for each segment and salt: the sum of its counts, up to ``least``."""
    held: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for segment, salt, counts in zip(*(batch.column(c).to_pylist() for c in ("segment", "salt", "counts"))):
            found = expanded(counts)
            if (segment, salt) in held:
                found = np.minimum(found.astype(np.uint16) + held[segment, salt], least).astype(np.uint8)
            held[segment, salt] = found
    rows = [(*key, squeezed(v)) for key, v in held.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["segment", "salt", "counts"])


def salted_segments(emitted: DataFrame, least: int) -> DataFrame:
    """(segment, salt, counts): the counts of segments, merged in ``SALTS`` ways.

    The number of tasks is fixed, so Spark doesn't join tasks whose packed counts
    are few: unpacked, all segments and salts take a gigabyte, of which a task holds about 64 MB.
    """
    segments = emitted.where("segment IS NOT NULL").select("segment", "salt", "counts")
    return segments.repartition(MERGERS, "segment", "salt").mapInArrow(lambda b: _summed(b, least), "segment int, salt int, counts binary")


def merged_buckets(emitted: DataFrame, least: int) -> np.ndarray:
    """The bitmap of the buckets that reach ``least``; counts are merged in ``SALTS`` ways, then in one."""

    def flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _summed(batches, least):
            bits = [np.packbits(expanded(x) >= least).tobytes() for x in batch.column("counts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("segment"), pa.array(bits, pa.binary())], names=["segment", "bits"])

    once = salted_segments(emitted, least).withColumn("salt", F.lit(0))
    rows = once.repartition("segment").mapInArrow(flagged, "segment int, bits binary").collect()  # 2 MB at most
    out = np.zeros((1 << (BITS - SEGMENT), 1 << (SEGMENT - 3)), np.uint8)
    for r in rows:
        out[r["segment"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def bitmap(phrases: DataFrame, k: int) -> np.ndarray:
    """The bitmap of the buckets of given phrases of k words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << BITS, bool)
        for batch in batches:
            word = word_hashes(pc.split_pattern(batch.column("phrase"), " ").flatten()).reshape(-1, k)
            gram = word[:, 0].copy()
            for j in range(1, k):
                gram = longer(gram, word[:, j])
            seen[bucket_of(gram, word_hashes(batch.column("lang")))] = True
        found = np.flatnonzero(seen).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(found)], names=["bucket"])

    made = phrases.select("lang", "phrase").mapInArrow(run, "bucket int").distinct().toArrow()  # 64 MB at most
    seen = np.zeros(1 << BITS, bool)
    seen[made["bucket"].to_numpy()] = True
    return np.packbits(seen)


def frequent_phrases(texts: DataFrame, *, longest: int, least: int) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases of 1 to ``longest`` words that
    occur ``least`` times at least, and (lang, n) of all words; ``texts``: (text, lang)."""
    if not 1 <= least <= 255:
        raise ValueError("least must lie between 1 and 255: bucket counts are bytes")
    spark = texts.sparkSession
    small_batches(spark)
    counts, total, known = [], None, None
    for k in range(1, longest + 1):
        shared = known and spark.sparkContext.broadcast(known)
        run = one_pass(k, k == longest, least, lambda shared=shared: shared.value)
        emitted = materialise(texts.mapInArrow(run, EMITTED), "phrases-emitted")
        exact = emitted.where("phrase IS NOT NULL").groupBy("lang", "phrase").agg(F.sum("c").alias("f"))
        if k == 1:
            exact = materialise(exact, "words")
            total = materialise(exact.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
        kept = materialise(exact.where(F.col("f") >= least).select("lang", "phrase", F.lit(k).alias("words"), "f"), "frequent")
        counts.append(kept)
        if k < longest:
            known = (bitmap(kept, k), merged_buckets(emitted, least))
    out = counts[0]
    for x in counts[1:]:
        out = out.unionByName(x)
    return out, total


def collocations(
    docs: DataFrame,
    *,
    least: int = 100,
    longest: int = 5,
    top: int = 2000,
    inside_percent: int = 100,
    text_col: str = "text",
    lang_col: str = "lang",
    salts: int = 32,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language.

    Phrases of 2 to ``longest`` words within a piece that occur ``least`` times
    at least in their language; ``score`` is floor(1000 * a * n / (l * r)) at
    the cut where it is lowest, ties at the first cut.  A phrase goes if a longer
    one that holds its words, dropped or not, occurs ``inside_percent`` percent
    as often.  Order: score, then a, falling, then the phrase by UTF-8 bytes.

    Null texts count as empty, null languages as ``und``.  Repeated rows count
    each; other columns are ignored; an empty table gives an empty result.
    Products are decimals of 38 digits.
    """
    texts = docs.select(or_empty(f"`{text_col}`").alias("text"), F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"))
    frequent, total = frequent_phrases(texts, longest=longest, least=least)
    words = F.split("phrase", " ")
    candidates = frequent.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), words.alias("w"))
    text = lambda begin, n: F.array_join(F.slice("w", begin, n), " ")
    # The key of the counts is handed over, so that both sides are exchanged for the join and hot keys can be split.
    of = lambda name: frequent.select(F.col("lang").alias(f"{name}_lang"), rekeyed(F.col("phrase"), "string").alias(f"{name}_phrase"), F.col("f").alias(name))
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumn("left", text(F.lit(1), F.col("k"))).withColumn("right", text(F.col("k") + 1, F.col("words") - F.col("k"))).drop("w")
    for name, part in (("l", "left"), ("r", "right")):
        cuts = cuts.join(of(name), (F.col("lang") == F.col(f"{name}_lang")) & (F.col(part) == F.col(f"{name}_phrase"))).drop(f"{name}_lang", f"{name}_phrase", part)
    cuts = cuts.join(F.broadcast(total) if total.count() <= 100_000 else total, "lang")
    wide = lambda c: f"cast({c} as decimal(19,0))"
    score = F.expr(f"cast((cast({wide('a')} * {wide('n')} as decimal(34,0)) * 1000BD) div (cast({wide('l')} * {wide('r')} as decimal(38,0))) as long)")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("best"))

    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda b: F.array_join(F.slice("w", b, n), " "))))
    inside = candidates.where("words > 2").select("lang", F.explode(inner).alias("part"), "a").groupBy("lang", "part").agg(F.max("a").alias("holder"))
    inside = inside.select(F.col("lang").alias("h_lang"), rekeyed(F.col("part"), "string").alias("h_part"), "holder")
    left = scored.join(inside, (F.col("lang") == F.col("h_lang")) & (F.col("phrase") == F.col("h_part")), "left")
    left = left.where(F.col("holder").isNull() | (F.col("holder") * 100 < F.col("a") * inside_percent))
    left = left.select("lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").alias("score"))
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    # A language may hold most phrases: the first of each salt, at most salts * top rows, then the first of these.
    salt = F.pmod(F.xxhash64("phrase"), F.lit(salts))
    some = left.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.drop("salt").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir).select("text", "lang"))


OP12_SQL = r"""
WITH p AS (
  SELECT lang, p, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (
    SELECT lang, row_number() OVER () AS p, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM (
      SELECT coalesce(lang, 'und') AS lang,
        unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
      FROM documents))),
g AS (SELECT lang, p, w AS w1, lead(w, 1) OVER s AS w2, lead(w, 2) OVER s AS w3, lead(w, 3) OVER s AS w4, lead(w, 4) OVER s AS w5 FROM p WINDOW s AS (PARTITION BY p ORDER BY i)),
n AS (SELECT lang, count(*) AS n FROM g GROUP BY lang),
f AS (
  SELECT lang, 1 AS k, w1 AS phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100
  UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM g WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 100
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 100
  UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, count(*) FROM g WHERE w4 IS NOT NULL GROUP BY ALL HAVING count(*) >= 100
  UNION ALL SELECT lang, 5, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 || ' ' || w5, count(*) FROM g WHERE w5 IS NOT NULL GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cut AS (SELECT *, array_to_string(w[1:j], ' ') AS x, array_to_string(w[j + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
s AS (
  SELECT cut.lang, cut.phrase, a, l.f AS l, r.f AS r, n, CAST((CAST(1000 AS HUGEINT) * a * n) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = x JOIN f r ON r.lang = cut.lang AND r.phrase = y JOIN n ON n.lang = cut.lang
  QUALIFY row_number() OVER (PARTITION BY cut.lang, cut.phrase ORDER BY score, j) = 1),
h AS (
  SELECT lang, part, max(a) AS holder FROM (
    SELECT lang, a, k, m, array_to_string(w[b:b + m - 1], ' ') AS part FROM (
      SELECT *, unnest(range(1, k - m + 2)) AS b FROM (SELECT *, unnest(range(2, k)) AS m FROM c))) GROUP BY lang, part)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank, s.phrase, a, l, r, n, score
FROM s LEFT JOIN h ON h.lang = s.lang AND h.part = s.phrase
WHERE holder IS NULL OR 100 * holder < 100 * a
QUALIFY rank <= 2000
"""
