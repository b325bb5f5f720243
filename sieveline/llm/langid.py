"""Language identification by multilingual mixture inference.

Each language has a character trigram model.  Expectation-maximisation gives a
document's language proportions under a mixture of these models; of the nested
sets of its strongest languages the one with the best penalised likelihood
stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.shared import chunks, crc32_of_id, documents, small_batches

#: Trigrams are hashed to so many features: a model is this times the languages, whatever the corpus.
FEATURES = 1 << 15
UNKNOWN = "und"
_ALPHA: list[np.ndarray] = []


def _alpha() -> np.ndarray:
    """For each code point whether it is a letter; built once a worker."""
    if not _ALPHA:
        _ALPHA.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _ALPHA[0]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all trigrams of whole texts: the text's number and the feature; and for
    each text whether it has a letter.

    Letters are lower-cased, everything else reads as a space, and a space is
    added at both ends.  Trigrams without a letter in the middle or at both
    sides don't count.
    """
    points = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    size = np.array([len(p) for p in points], np.int64)
    flat = np.concatenate(points) if points else np.empty(0, np.uint32)
    of = np.repeat(np.arange(len(texts)), size)
    letter = _alpha()[flat]
    flat = np.where(letter, flat, np.uint32(32))
    a, b, c = flat[:-2], flat[1:-1], flat[2:]
    good = (of[:-2] == of[2:]) & (letter[1:-1] | (letter[:-2] & letter[2:]))
    h = (a[good] * np.uint32(0x9E3779B1)) ^ (b[good] * np.uint32(0x85EBCA77)) ^ (c[good] * np.uint32(0xC2B2AE3D))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    has = np.bincount(of, weights=letter, minlength=len(texts)) > 0
    return of[:-2][good], (h >> np.uint32(17)).astype(np.int64), has


@dataclass(frozen=True)
class LanguageModel:
    """``probability[l, g]`` of feature g in language l."""

    languages: list[str]
    probability: np.ndarray


def fit_languages(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", smoothing: float = 0.5) -> LanguageModel:
    """Trigram models of all rows with a language and a text.

    Counts are summed in each task and then by (language, feature), so what
    meets in one place is at most languages times ``FEATURES`` numbers.  A table
    without such rows gives a model without languages.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, n in sums.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "feature", "n"])
            sums.clear()

        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for lang in sorted(set(langs)):
                rows = np.flatnonzero(langs == lang)
                texts = batch.column(1).take(pa.array(rows)).to_pylist()
                for part in chunks(texts, 256):
                    n = np.bincount(trigrams(texts[part])[1], minlength=FEATURES)
                    sums[lang] = sums[lang] + n if lang in sums else n
            if len(sums) > 64:
                yield from flush()
        yield from flush()

    small_batches(docs.sparkSession)
    lang, text = F.col(f"`{lang_col}`").cast("string"), F.col(f"`{text_col}`")
    known = docs.where(lang.isNotNull() & text.isNotNull()).select(lang.alias("lang"), text.alias("text"))
    sums = known.mapInArrow(count, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(sums["lang"].unique().tolist())
    counts = np.zeros((len(languages), FEATURES))
    if len(sums):
        counts[np.searchsorted(languages, sums["lang"].to_numpy(str)), sums["feature"]] = sums["n"]
    counts += smoothing
    return LanguageModel(languages, counts / counts.sum(axis=1, keepdims=True))


def infer_mixtures(texts: list[str], model: LanguageModel, *, tolerance: float = 1e-3, penalty: float = 6.0) -> tuple[np.ndarray, np.ndarray]:
    """Language proportions of each text (texts x languages), and whether it has a letter.

    A first fit over all languages ranks them.  The strongest language alone is
    the first set; the next strongest is added, and the proportions are fitted
    again, as long as
    ``log likelihood - penalty * languages * log(1 + trigrams)`` rises.  Every
    fit goes on until no proportion of the text changes by ``tolerance``.  Rows
    of texts without trigrams are 0.
    """
    of, feature, has = trigrams(texts)
    n, langs = len(texts), len(model.languages)
    if not langs or not len(of):
        return np.zeros((n, langs)), has
    pair, times = np.unique(of * FEATURES + feature, return_counts=True)
    of, feature = pair // FEATURES, pair % FEATURES
    docs, begin = np.unique(of, return_index=True)
    size = np.diff(np.r_[begin, len(of)])
    p, times = model.probability.T[feature], times.astype(float)  # features x languages
    total = np.add.reduceat(times, begin)

    def of_docs(which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of some documents: features' rows of p, their times, each one's document, and where documents begin."""
        n = size[which]
        first = np.cumsum(n) - n
        at = np.arange(n.sum()) - np.repeat(first - begin[which], n)
        return p[at], times[at], np.repeat(np.arange(len(which)), n), first

    def fit(share: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Expectation-maximisation from ``share``; documents leave when they have converged."""
        share, todo = share.copy(), np.arange(len(which))
        q, t, row, first = of_docs(which)
        while len(todo):
            now = share[todo]
            joint = q * now[row]
            new = np.add.reduceat(joint * (t / joint.sum(axis=1))[:, None], first) / total[which[todo]][:, None]
            share[todo] = new
            moving = np.abs(new - now).max(axis=1) >= tolerance
            if moving.sum() <= 0.75 * len(todo):  # fewer rows are worth taking anew
                todo = todo[moving]
                q, t, row, first = of_docs(which[todo])
        return share

    def value(share: np.ndarray, which: np.ndarray, languages: int) -> np.ndarray:
        q, t, row, first = of_docs(which)
        fits = np.add.reduceat(t * np.log((q * share[row]).sum(axis=1)), first)
        return fits - penalty * languages * np.log1p(total[which])

    every = np.arange(len(docs))
    mixed = fit(np.full((len(docs), langs), 1 / langs), every)
    rank = np.argsort(np.argsort(-mixed, axis=1, kind="stable"), axis=1, kind="stable")
    best = np.where(rank < 1, 1.0, 0.0)
    best_at, growing = value(best, every, 1), every
    for k in range(2, langs + 1):
        start = np.where(rank[growing] < k, np.maximum(mixed[growing], 1e-6), 0)
        share = fit(start / start.sum(axis=1, keepdims=True), growing)
        now = value(share, growing, k)
        better = now > best_at[growing]
        growing, share, now = growing[better], share[better], now[better]
        best[growing], best_at[growing] = share, now
        if not len(growing):
            break
    out = np.zeros((n, langs))
    out[docs] = best
    return out, has


def identify(docs: DataFrame, model: LanguageModel, *, text_col: str = "text", chunk: int = 128) -> DataFrame:
    """All rows of ``docs`` with ``lang_pred``, ``score`` and ``lang_mix``.

    ``lang_mix`` maps the languages of the selected set to their proportions,
    ``lang_pred`` is the greatest (the first by name if equal) and ``score`` its
    proportion.  Null texts, texts without a letter, and all texts under a model
    without languages are ``und`` with score 0 and an empty map.  An empty table
    gives an empty result; columns named like a result are replaced.
    """
    languages = np.array(model.languages, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = [t or "" for t in batch.column(kept.index(text_col)).to_pylist()]
            for some in chunks(every, chunk):
                part, texts = batch.slice(some.start, some.stop - some.start), every[some]
                share, has = infer_mixtures(texts, model)
                top = share.argmax(axis=1) if len(languages) else np.zeros(len(texts), np.int64)
                score = share.max(axis=1) if len(languages) else np.zeros(len(texts))
                known = has & (score > 0)
                pred = [languages[k] if ok else UNKNOWN for k, ok in zip(top, known)]
                mix = [[(languages[k], float(share[r, k])) for k in np.flatnonzero(share[r])] if ok else [] for r, ok in enumerate(known)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(pred, pa.string()), pa.array(np.where(known, np.clip(score, 0, 1), 0.0)), pa.array(mix, pa.map_(pa.string(), pa.float64()))],
                    names=[*part.schema.names, "lang_pred", "score", "lang_mix"],
                )

    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "lang_mix")]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return rows.mapInArrow(run, f"{schema}, lang_pred string, score double, lang_mix map<string,double>")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held_out: Column = F.pmod(crc32_of_id("doc_id"), F.lit(4)) == 2
    model = fit_languages(docs.where(~held_out))
    found = identify(docs.select("doc_id", "text").withColumn("held_out", held_out), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "lang_mix")
