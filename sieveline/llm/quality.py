"""Quality by perplexity under an interpolated modified Kneser-Ney model.

The model is over characters as they are, of every script and case, so what it
counts grows with the trusted text.  Documents stay in blocks: a block asks for
the costs of its distinct n-grams, which are joined with the sharded counts of
the trusted text, and answers come back to the block.  So n-grams are aggregated
before any exchange, and no text is exchanged at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.shared import chunks, documents, small_batches, with_columns
from sieveline.sources.scratch import bucketed, materialise, rekeyed

U64 = np.uint64
ORDER = 4
#: What stands before a text, ``ORDER - 1`` times, and after it.
BEGIN, END = "\x02", "\x03"
#: Characters of text in a block and in a step of work on a block.
BLOCK_CHARS, STEP_CHARS = 32_000_000, 1_000_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def _hashes(points: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of ``ORDER`` code points, by the run's last place from ``ORDER - 1`` on."""
    n = len(points) - ORDER + 1
    h = np.zeros(max(n, 0), U64)
    for k in range(ORDER):
        h = (h + points[k : k + n]) * U64(0x9E3779B97F4A7C15)
        h ^= h >> U64(29)
    return _mix(h)


class Grams:
    """The n-grams of some texts: one ends at each character and one at each text's end.

    ``code[i]`` numbers the i-th n-gram among the distinct ones, whose hashes
    are ``hashes``; ``size[t]`` is how many text t has.
    """

    def __init__(self, texts: list[str]):
        begin = BEGIN * (ORDER - 1)
        joined = "".join([f"{begin}{t}{END}" for t in texts])
        self.points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.size = np.array([len(t) + 1 for t in texts], np.int64)
        starts = np.cumsum(self.size + ORDER - 1) - (self.size + ORDER - 1)
        keep = np.ones(len(self.points), bool)
        for k in range(ORDER - 1):  # the marks before a text; an n-gram that ends there would reach into another text
            keep[starts + k] = False
        self.last = np.flatnonzero(keep)
        found = pa.array(_hashes(self.points)[keep[ORDER - 1 :]]).dictionary_encode()
        self.code = found.indices.to_numpy(zero_copy_only=False)
        self.hashes = found.dictionary.to_numpy(zero_copy_only=False)

    def strings(self, which: np.ndarray) -> list[str]:
        """The distinct n-grams numbered ``which``."""
        first = np.empty(len(self.hashes), np.int64)
        first[self.code[::-1]] = self.last[::-1]  # the first place is written last
        places = first[which][:, None] + np.arange(1 - ORDER, 1)
        flat = self.points[places].tobytes().decode("utf-32-le", "surrogatepass")
        return [flat[at : at + ORDER] for at in range(0, len(flat), ORDER)]


class DistinctGrams:
    """The distinct n-grams of the texts that were added."""

    def __init__(self) -> None:
        self.seen, self.strings = np.empty(0, U64), pa.array([], pa.string())

    def add(self, texts: list[str]) -> None:
        for part in chunks(texts, len(texts), STEP_CHARS):
            grams = Grams(texts[part])
            new = ~np.isin(grams.hashes, self.seen)
            self.strings = pa.concat_arrays([self.strings, pa.array(grams.strings(np.flatnonzero(new)), pa.string())])
            self.seen = np.concatenate([self.seen, grams.hashes[new]])


def blocks_of(docs: DataFrame, *, id_col: str, text_col: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Blocks of rows: (block, rows, ids, grams), bucketed by block.

    ``rows`` holds whole rows of ``docs``, compressed.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = out = grams = None
        ids: list = []
        chars, number = 0, 0

        def block() -> pa.RecordBatch:
            out.close()
            columns = [
                pa.array([(TaskContext.get().partitionId() << 32) + number]),
                pa.array([sink.getvalue().to_pybytes()], pa.binary()),
                pa.ListArray.from_arrays(pa.array([0, sum(map(len, ids))], pa.int32()), pa.concat_arrays(ids)),
                pa.ListArray.from_arrays(pa.array([0, len(grams.strings)], pa.int32()), grams.strings),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["block", "rows", "ids", "grams"])

        for batch in batches:
            if not len(batch):
                continue
            if out is None:
                sink, grams, ids, chars = pa.BufferOutputStream(), DistinctGrams(), [], 0
                out = pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 5)))
            out.write_batch(batch)
            ids.append(batch.column(id_col))
            grams.add(_texts(batch, text_col))
            chars += batch.column(text_col).nbytes
            if chars >= block_chars:
                yield block()
                out, number = None, number + 1
        if out is not None:
            yield block()

    made = docs.mapInArrow(run, f"block long, rows binary, ids array<{id_type}>, grams array<string>")
    return bucketed(made, "quality-blocks", ["block"])


def _texts(rows: pa.RecordBatch, text_col: str) -> list[str]:
    return [t or "" for t in rows.column(text_col).to_pylist()]


def _rows(blob: pa.Scalar) -> Iterator[tuple[int, pa.RecordBatch]]:
    """A block's batches of rows, each with the place of its first row."""
    place = 0
    for batch in pa.ipc.open_stream(blob.as_buffer()):
        yield place, batch
        place += len(batch)


def _within(places: np.ndarray, first: int, batch: pa.RecordBatch) -> np.ndarray:
    return places[(places >= first) & (places < first + len(batch))] - first


def _places(value: pa.Scalar) -> np.ndarray:
    return np.sort(np.array(value.as_py() or [], np.int64))


def count_grams(blocks: DataFrame, marks: DataFrame, text_col: str) -> DataFrame:
    """(gram, c) over the rows at ``train`` of each block, summed in the block and then by n-gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, train in zip(batch.column(0), batch.column(1)):
                places = _places(train)
                for first, rows in _rows(blob):
                    texts = _texts(rows.take(pa.array(_within(places, first, rows))), text_col)
                    for part in chunks(texts, len(texts), STEP_CHARS):
                        grams = Grams(texts[part])
                        every = np.arange(len(grams.hashes))
                        counts = np.bincount(grams.code, minlength=len(every))
                        yield pa.RecordBatch.from_arrays([pa.array(grams.strings(every)), pa.array(counts)], names=["gram", "c"])

    trained = blocks.join(marks.where(F.size("train") > 0), "block").select("rows", "train")
    return trained.mapInArrow(run, "gram string, c long").groupBy("gram").agg(F.sum("c").alias("c"))


def suffix(gram: str | Column, length: int) -> Column:
    gram = F.col(gram) if isinstance(gram, str) else gram
    return F.substring(gram, -length, length)


class KneserNey:
    """Tables of an interpolated modified Kneser-Ney model.

    ``chance[k]`` has (gram, p) of the n-grams of k characters that were seen,
    ``back[k]`` (ctx, weight) of the contexts of k - 1 characters.  Both are
    scratch tables, sharded by their keys when they are joined.
    """

    def __init__(self, counts: DataFrame):
        """From the counts of the longest n-grams.

        Shorter ones count the distinct characters before them.  The three
        discounts of an order come from its counts of counts; where these don't
        allow it (a count that never occurs), 0.5, 0.75 and 1 are used.  The
        lowest order is backed by an equal chance for each character seen and
        one unseen.
        """
        tables = {ORDER: materialise(counts, "grams")}
        for k in range(ORDER - 1, 0, -1):
            shorter = tables[k + 1].groupBy(suffix("gram", k).alias("gram")).agg(F.count(F.lit(1)).alias("c"))
            tables[k] = materialise(shorter, "grams")
        self.chance: dict[int, DataFrame] = {}
        self.back: dict[int, DataFrame] = {}
        self.least = 1 / (tables[1].count() + 1)
        for k in range(1, ORDER + 1):
            n = [float(x or 0) for x in tables[k].agg(*[F.count_if(F.col("c") == j) for j in (1, 2, 3, 4)]).first()]
            discount = [0.5, 0.75, 1.0]
            if all(n):
                y = n[0] / (n[0] + 2 * n[1])
                found = [j + 1 - (j + 2) * y * n[j + 1] / n[j] for j in range(3)]
                discount = [min(max(d, 0.05), j + 0.95) for j, d in enumerate(found)]
            d = F.when(F.col("c") == 1, discount[0]).when(F.col("c") == 2, discount[1]).otherwise(discount[2])
            rows = tables[k].select("gram", F.left("gram", F.lit(k - 1)).alias("of"), F.col("c").cast("double").alias("c"), d.alias("d"))
            context = rows.groupBy(F.col("of").alias("ctx")).agg(F.sum("c").alias("total"), F.sum("d").alias("off"))
            context = materialise(context, "contexts")
            self.back[k] = context.select("ctx", (F.col("off") / F.col("total")).alias("weight"))
            # A context has at most as many rows as there are characters; its key is handed over so that a hot one can be split.
            keyed = context.select(rekeyed(F.col("ctx"), "string").alias("ctx"), "total", "off")
            joined = rows.join(keyed, F.col("of") == F.col("ctx"))
            low: Column = F.lit(self.least)
            if k > 1:
                joined = joined.withColumn("tail", suffix("gram", k - 1))
                joined = joined.join(self.chance[k - 1].select(F.col("gram").alias("shorter"), F.col("p").alias("low")), F.col("tail") == F.col("shorter"))
                low = F.col("low")
            p = (F.col("c") - F.col("d") + F.col("off") * low) / F.col("total")
            self.chance[k] = materialise(joined.select("gram", p.alias("p")), "chances")

    def costs(self, grams: DataFrame) -> DataFrame:
        """(gram, cost) of distinct n-grams: what was seen has its chance, what
        wasn't that of its suffix, weighed by its context."""
        found, p = grams.select("gram"), F.lit(self.least)
        for k in range(1, ORDER + 1):
            weight = self.back[k].select(F.col("ctx").alias(f"ctx{k}"), F.col("weight").alias(f"w{k}"))
            chance = self.chance[k].select(F.col("gram").alias(f"gram{k}"), F.col("p").alias(f"p{k}"))
            found = found.join(weight, F.left(suffix("gram", k), F.lit(k - 1)) == F.col(f"ctx{k}"), "left")
            found = found.join(chance, suffix("gram", k) == F.col(f"gram{k}"), "left")
            p = F.coalesce(F.col(f"p{k}"), F.coalesce(F.col(f"w{k}"), F.lit(1.0)) * p)
        return found.select("gram", (-F.log(p)).cast("float").alias("cost"))


def answers(blocks: DataFrame, model: KneserNey) -> DataFrame:
    """(block, costs): the costs of each block's n-grams in their order, bucketed by block."""
    asked = blocks.select("block", F.posexplode("grams").alias("place", "asked"))
    distinct = blocks.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.lit(1).alias("one"))
    costs = materialise(model.costs(materialise(distinct.select("gram"), "asked")), "costs")
    told = asked.join(costs.select("gram", "cost"), F.col("asked") == F.col("gram")).select("block", "place", "cost")
    # As many as a block's text has distinct n-grams: bounded by the block's size.
    pairs = told.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("place", "cost"))).alias("told"))
    return bucketed(pairs.select("block", F.col("told.cost").alias("costs")), "quality-answers", ["block"])


def perplexities(blocks: DataFrame, told: DataFrame, marks: DataFrame, docs: DataFrame, text_col: str, *, returned: list[str], only: str | None = None) -> DataFrame:
    """The columns ``returned`` of all rows of the blocks, or of those at the
    places ``only`` of ``marks``, with ``perplexity`` over the whole text and ``trusted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, grams, cost, trusted, places in zip(*batch.columns):
                flat = np.frombuffer("".join(grams.values.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
                value = cost.values.to_numpy(zero_copy_only=False).astype(float)
                if len(flat) != ORDER * len(value):
                    raise RuntimeError("a block's answers lack some of its n-grams")
                keys = _hashes(flat)[::ORDER]
                order = np.argsort(keys)
                keys, value = keys[order], value[order]
                marked, wanted = _places(trusted), _places(places)
                for first, rows in _rows(blob):
                    mark = np.zeros(len(rows), bool)
                    mark[_within(marked, first, rows)] = True
                    if only:
                        some = _within(wanted, first, rows)
                        rows, mark = rows.take(pa.array(some)), mark[some]
                    texts = _texts(rows, text_col)
                    for part in chunks(texts, len(texts), STEP_CHARS):
                        got = Grams(texts[part])
                        total = np.add.reduceat(value[np.searchsorted(keys, got.hashes)][got.code], np.cumsum(got.size) - got.size)
                        kept = rows.slice(part.start, part.stop - part.start)
                        columns = [*(kept.column(c) for c in returned), pa.array(np.exp(total / got.size)), pa.array(mark[part])]
                        yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [*returned, "perplexity", "trusted"]
    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in returned)
    rows = blocks.select("block", "rows", "grams").join(told, "block").join(marks, "block", "left")
    if only:
        rows = rows.where(F.size(only) > 0)
    rows = rows.select("rows", "grams", "costs", "trusted", F.col(only or "trusted").alias("places"))
    return rows.mapInArrow(run, f"{schema}perplexity double, trusted boolean")


def score_quality(
    docs: DataFrame,
    trusted: DataFrame,
    *,
    quantile: float = 0.99,
    folds: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    with_text: bool = True,
) -> DataFrame:
    """All rows of ``docs`` with ``perplexity``, ``threshold``, ``trusted`` and ``kept``;
    the text itself only ``with_text``.

    The model is trained on the texts whose id is in ``trusted``, but for one id
    in ``folds``: a text is no fair measure of a model that was trained on it.
    A language's threshold is the ``quantile`` of the perplexities of its trusted
    documents left out; that of all of these where a language is null or has
    none.  Rows above it aren't kept.

    Null texts count as empty, which are scored by their end alone.  Without
    trusted rows the threshold is null and everything is kept.  Rows that repeat
    an id are scored each.  An empty table gives an empty result; columns named
    like a result are replaced.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("perplexity", "threshold", "trusted", "kept")])
    blocks = blocks_of(docs, id_col=id_col, text_col=text_col)
    ids = trusted.select(F.col(f"`{id_col}`").cast("long").alias("t")).where("t IS NOT NULL").groupBy("t").agg(F.lit(1).alias("one"))
    ids = ids.select(rekeyed(F.col("t")).alias("t"))
    # Which places of a block are trusted: ids alone are exchanged.
    placed = blocks.select("block", F.posexplode("ids").alias("place", "id"))
    placed = placed.select("block", "place", F.col("id").cast("long").alias("id")).where("id IS NOT NULL").join(ids, F.col("id") == F.col("t"))
    out = F.pmod(F.xxhash64("id", F.lit(4)), F.lit(folds)) == 0
    places = lambda c: F.collect_list(F.when(c, F.col("place")))
    marks = placed.groupBy("block").agg(places(F.lit(True)).alias("trusted"), places(~out).alias("train"), places(out).alias("held"))
    marks = bucketed(marks, "quality-marks", ["block"])

    told = answers(blocks, KneserNey(count_grams(blocks, marks, text_col)))
    measured = perplexities(blocks, told, marks, docs, text_col, returned=[lang_col], only="held")
    lang = F.col(f"`{lang_col}`").cast("string")
    measured = materialise(measured.select(lang.alias("lang"), "perplexity"), "held-out")
    cut = F.percentile_approx("perplexity", quantile, 10_000)
    overall = measured.agg(cut).first()[0]
    cuts = materialise(measured.where("lang IS NOT NULL").groupBy(F.col("lang").alias("__lang")).agg(cut.alias("__cut")), "cuts")
    returned = [c for c in docs.columns if with_text or c != text_col]
    scored = perplexities(blocks, told, marks, docs, text_col, returned=returned).join(cuts, lang == F.col("__lang"), "left")
    threshold = F.coalesce(F.col("__cut"), F.lit(overall).cast("double"))
    return with_columns(scored, {"threshold": threshold, "kept": F.coalesce(F.col("perplexity") <= threshold, F.lit(True))}).drop("__lang", "__cut")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    return score_quality(docs, trusted, with_text=False).select("doc_id", "lang", "perplexity", "threshold", "trusted", "kept")
