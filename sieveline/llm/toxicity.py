"""Toxicity: noisy-channel deobfuscation, then a linear score of restored words.

Words written with digits and symbols, with letters repeated, or with their
letters set apart are read as a lattice of characters.  Viterbi decoding under a
character trigram model of the whole corpus restores the likeliest word.  The
score adds up the evidence of restored words and their beginnings.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby, repeat
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.shared import chunks, crc32_of_id, documents, or_empty, small_batches, with_columns
from sieveline.sources.scratch import materialise

SYMBOLS = 64
EDGE = 26
#: What a digit or symbol may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "*": "", "#": "", ".": "", "-": "", "_": ""}
#: Costs of reading a sign as a letter, of dropping a sign, and of dropping a letter from a run of two or of more.
AS_LETTER, NO_SIGN, ONE_OF_TWO, ONE_OF_MORE = 1.0, 4.0, 6.0, 0.5
#: Single letters set apart.  What separates is never a letter, so that matching takes linear time.
SPACED = re.compile(r"(?<!\S)[^\W_](?:[\s.\-_*]{1,3}[^\W_]){2,}(?!\w)")
#: Letters of a learned word that may be written as two pieces with a space between them.
TWO_PIECES = 5
_FOLD: list[np.ndarray] = []


def symbol(ch: str) -> int:
    """a-z 0-25, other letters 27-63, everything else is the edge of a word."""
    return ord(ch) - 97 if "a" <= ch <= "z" else 27 + ord(ch) % (SYMBOLS - 27) if ch.isalpha() else EDGE


def _fold() -> np.ndarray:
    if not _FOLD:
        _FOLD.append(np.fromiter((symbol(chr(c)) for c in range(0x110000)), np.int32, 0x110000))
    return _FOLD[0]


def character_model(docs: DataFrame, *, text_col: str = "text", strength: float = 20.0) -> np.ndarray:
    """Negative log probabilities of a character after two others, over the words of all texts.

    Counts are summed in each task and then by trigram: at most ``SYMBOLS ** 3``
    numbers reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for part in chunks(texts, 256):
                text = "  ".join(texts[part]).lower()
                s = _fold()[np.frombuffer(f"  {text}  ".encode("utf-32-le", "surrogatepass"), np.uint32)]
                total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["gram", "c"])

    small_batches(docs.sparkSession)
    counts = docs.select(F.col(f"`{text_col}`")).mapInArrow(run, "gram int, c long").groupBy("gram").agg(F.sum("c").alias("c")).toPandas()
    n = np.zeros(SYMBOLS**3)
    n[counts["gram"].to_numpy(int)] = counts["c"]
    n = n.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    one = (n.sum(axis=(0, 1)) + 1) / (n.sum() + SYMBOLS)
    two = (n.sum(axis=0) + strength * one) / (n.sum(axis=(0, 2))[:, None] + strength)
    three = (n + strength * two[None]) / (n.sum(axis=2, keepdims=True) + strength)
    return -np.log(three)


def decode(word: str, cost: np.ndarray) -> str:
    """The likeliest spelling of an obfuscated word.

    A run of equal letters offers one or two of them, each other character
    letters or nothing, at a cost; the path with the least sum of these and of
    the character model's costs wins.  A state is the last two symbols, so the
    search is exact; where a single state is left, what led to it is settled.
    Time is linear in the word's length.
    """
    settled: list[str] = []
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(EDGE, EDGE): (0.0, None)}

    def path(node: tuple | None) -> list[str]:
        letters = []
        while node:
            letters.append(node[0])
            node = node[1]
        return letters[::-1]

    for ch, group in groupby(word):
        run = sum(1 for _ in group)
        if run == 1 and len(states) == 1 and ch.isalpha():  # nothing to choose
            ((at, _),) = states.items()
            settled.append(ch)
            states = {(at[1], symbol(ch)): (0.0, None)}
            continue
        if ch.isalpha():
            dropped = ONE_OF_TWO if run == 2 else ONE_OF_MORE
            steps = [[(ch * n, (run - n) * dropped) for n in (1, 2) if n <= run]]
        else:
            read = LEET.get(ch, "")
            steps = repeat([*((c, AS_LETTER) for c in read), ("", NO_SIGN if read else 0.0)], run if read else 1)
        for offers in steps:
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (spent, node) in states.items():
                for letters, extra in offers:
                    x, y, value, to = a, b, spent + extra, node
                    for letter in letters:
                        c = symbol(letter)
                        value, x, y, to = value + float(cost[x, y, c]), y, c, (letter, to)
                    if (x, y) not in new or value < new[x, y][0]:
                        new[x, y] = (value, to)
            states = new
            if len(states) == 1:
                ((at, (_, node)),) = states.items()
                settled += path(node)
                states = {at: (0.0, None)}
    _, best = min(((spent + float(cost[a, b, EDGE]), node) for (a, b), (spent, node) in states.items()), key=lambda e: e[0])
    return "".join([*settled, *path(best)])


_TRIM = ".,;:?!\"'()[]{}<>%&*#=~`^/\\"
_RUN = re.compile(r"(.)\1+")
_ODD = re.compile(r"[0-9@$!|+€*#._-]|([^\W\d_])\1")


def restored(token: str, cost: np.ndarray) -> list[str]:
    """The readings of a white-space separated token, lower-cased: its letters as
    they are, and its decoded form where it has a digit or sign or a repeated
    letter, once more with each letter once.  A sign before it that may be a
    letter makes one reading more."""
    token = token.lower()
    core = token.strip(_TRIM)
    if core.isalpha() and core[0] == token[0]:  # most tokens
        if not _RUN.search(core):
            return [core]
        best = decode(core, cost)
        return list(dict.fromkeys((core, best, _RUN.sub(r"\1", best))))
    before = token[: token.index(core)] if core else ""
    tail = len(core) - len(core.rstrip("$@+|"))
    if tail > 2:  # a row of signs is decoration
        core = core[:-tail]
    plain = [w for w in re.split(r"[\W\d_]+", core) if w]
    if not plain:
        return plain
    if LEET.get(before[-1:]):
        plain.append(decode(before[-1] + core, cost))
    if _ODD.search(core):
        plain.append(best := decode(core, cost))
        plain.append(_RUN.sub(r"\1", best))
    return list(dict.fromkeys(plain))


def features(word: str) -> list[str]:
    """A word and its beginnings."""
    return [f"={word}", *(word[:n] for n in range(4, min(len(word), 8) + 1))] if len(word) > 2 else []


def tokens(text: str) -> set[str]:
    """Distinct tokens of a whole text; letters set apart become one token more."""
    found = set(text.split())
    if any(len(t) == 1 for t in found) or "." in text:
        for m in SPACED.finditer(text):
            if any(c.isalpha() for c in m[0]):
                found.add("".join(re.split(r"[\s.\-_*]+", m[0])))
    return found


@dataclass(frozen=True)
class ToxicityModel:
    """Character costs, feature weights, and the line from evidence to log odds."""

    cost: np.ndarray
    weight: dict[str, float]
    slope: float = 0.0
    base: float = -2.0


class _Evidence(dict):
    """Token -> evidence; starts anew when it holds ``limit`` tokens."""

    def __init__(self, model: ToxicityModel, limit: int = 300_000):
        super().__init__()
        self.model, self.limit = model, limit
        self.words = {f[1:] for f in model.weight if f[0] == "=" and len(f) > TWO_PIECES}

    def __missing__(self, token: str) -> float:
        if len(self) >= self.limit:
            self.clear()
        value = 0.0
        if len(token) > 2:
            weight = self.model.weight
            value = max((weight.get(f, 0.0) for w in restored(token, self.model.cost) for f in features(w)), default=0.0)
        self[token] = value
        return value

    def of(self, text: str) -> float:
        """The evidences of a text's distinct tokens, and of learned words written
        in two pieces: the greatest counts in full, the k-th by 1 / k."""
        found = tokens(text)
        pieces = text.lower().split()
        found |= self.words.intersection(map(add, pieces, pieces[1:]))
        values = sorted((v for v in map(self.__getitem__, found) if v > 0), reverse=True)
        return sum(v / k for k, v in enumerate(values, 1))


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    *,
    cost: np.ndarray,
    fit_rows: int = 20_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> ToxicityModel:
    """Learn from labelled documents: at most ``fit_rows`` of them, those with
    the smallest hashes of their ids.

    A feature's weight is the lower bound, two standard errors below, of its
    log odds in toxic against other documents; those above 1 stay, of which
    ``fit_rows`` documents have a bounded number.  A logistic line through the documents' evidence follows.
    Rows with a null id or label don't count; an id labelled twice is toxic if
    any label says so.  Without both labels every score is the base rate.
    """
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("l"), F.col(f"`{label_col}`").cast("int").alias("y")).where("l IS NOT NULL AND y IS NOT NULL")
    known = known.groupBy("l").agg(F.max("y").alias("y")).orderBy(F.xxhash64("l"), "l").limit(fit_rows)
    known = materialise(known, "fit-labels")
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), or_empty(F.col(f"`{text_col}`")).alias("text"))
    fit = materialise(own.join(F.broadcast(known), F.col("id") == F.col("l")).select("text", "y"), "fit-texts")  # fit_rows at most
    n1, n0 = fit.agg(F.count_if(F.col("y") == 1), F.count_if(F.col("y") != 1)).first()
    if not n1 or not n0:
        return ToxicityModel(cost, {}, 0.0, math.log((n1 + 1) / (n0 + 9)))
    spark = docs.sparkSession
    shared_cost = spark.sparkContext.broadcast(cost)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: list[Counter] = [Counter(), Counter()]
        words: dict[str, list[str]] = {}
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found: set[str] = set()
                for token in tokens(text):
                    if token not in words:
                        if len(words) > 300_000:
                            words.clear()
                        words[token] = [f for w in restored(token, shared_cost.value) for f in features(w)]
                    found.update(words[token])
                sums[y == 1].update(found)
        names = list(sums[0].keys() | sums[1].keys())
        for at in range(0, len(names), 50_000):
            part = names[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([sums[1][f] for f in part], pa.int64()), pa.array([sums[0][f] for f in part], pa.int64())], names=["f", "a", "b"])

    sums = fit.repartition(max(1, -(-(n1 + n0) // 512))).mapInArrow(count, "f string, a long, b long").groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    odds = f"ln((a + 0.5) / {n1 + 1}) - ln((b + 0.5) / {n0 + 1}) - 2 * sqrt(1 / (a + 0.5) + 1 / (b + 0.5))"
    best = sums.where("a >= 2").select("f", F.expr(odds).alias("w")).where("w > 1").collect()
    model = ToxicityModel(cost, {r[0]: float(r[1]) for r in best})
    seen = evidence(fit, model).select("evidence", "y").toPandas()  # fit_rows at most
    slope, base = _logistic(seen["evidence"].to_numpy(float), (seen["y"] == 1).to_numpy(float))
    return ToxicityModel(cost, model.weight, slope, base)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 60) -> tuple[float, float]:
    """Slope (at least 0) and base of a ridge logistic line, by damped Newton steps."""
    w = np.array([0.0, math.log((y.sum() + 1) / (len(y) - y.sum() + 1))])
    design = np.stack([x, np.ones_like(x)], axis=1)
    penalty = np.diag([ridge, 1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + penalty, design.T @ (p - y) + penalty @ w)
        w -= step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
    return max(0.0, float(w[0])), float(w[1])


def evidence(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text") -> DataFrame:
    """All rows of ``docs`` with ``evidence``, from the whole text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # weights from fit_rows documents and SYMBOLS ** 3 costs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Evidence(shared.value)
        for batch in batches:
            value = [table.of(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(value, pa.float64())], names=[*batch.schema.names[:-1], "evidence"])

    kept = [c for c in docs.columns if c != "evidence"]
    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in kept)
    return docs.select(*[f"`{c}`" for c in kept], or_empty(F.col(f"`{text_col}`")).alias("__text")).mapInArrow(run, f"{schema}evidence double")


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text") -> DataFrame:
    """All rows of ``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).

    Null texts count as empty and get the score of a text without evidence.  An
    empty table gives an empty result; columns named like a result are replaced.
    """
    score = 1 / (1 + F.exp(-(F.lit(model.slope) * F.col("evidence") + F.lit(model.base))))
    found = evidence(docs, model, text_col=text_col)
    return with_columns(found, {"score": score, "predicted": (score >= 0.5).cast("int")}).drop("evidence")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.pmod(crc32_of_id("doc_id"), F.lit(5)) == 0
    model = fit_toxicity(docs, labels.where(~held_out), cost=character_model(docs))
    return score_toxicity(docs.withColumn("held_out", held_out), model).select("doc_id", "held_out", "score", "predicted")
