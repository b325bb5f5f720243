"""Queries of dense kernels, federated fitting and the stream monitor."""

from __future__ import annotations

from dataclasses import replace
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sieveline.config import Config
from sieveline.functions import images as I
from sieveline.functions.arrays import argmax, entropy
from sieveline.operators import federated as FED
from sieveline.operators import inference as R
from sieveline.operators import vectors as V
from sieveline.operators.pictures import overlay_free_boxes
from sieveline.plans.tables import table
from sieveline.streaming.drift import window_moments


def _square(v) -> np.ndarray:
    """An 8 x 8 gray picture of a vector, stretched to bytes."""
    a = np.asarray(v, float).reshape(8, 8)
    return np.round(255 * (a - a.min()) / max(np.ptp(a), 1e-12))


def phash_dct(spark, sf):
    @F.pandas_udf("long")
    def code(v: pd.Series) -> pd.Series:
        return v.map(lambda x: I.perceptual_code(np.kron(_square(x), np.ones((5, 5)))))

    return table(spark, sf, "embeddings").select("vec_id", code("embedding").alias("code"))


def inscribed_rect(spark, sf):
    @F.pandas_udf("struct<x:int,y:int,w:int,h:int>")
    def rect(v: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([I.inscribed_rectangle(_square(x) > 96) for x in v], columns=["x", "y", "w", "h"])

    return table(spark, sf, "embeddings").select("vec_id", rect("embedding").alias("r")).select("vec_id", "r.*")


def residual_score(spark, sf):
    @F.pandas_udf("double")
    def score(v: pd.Series) -> pd.Series:
        return v.map(lambda x: round(I.overlay_residual(_square(x), bright=200, dark=120, window=5), 9))

    return table(spark, sf, "embeddings").select("vec_id", score("embedding").alias("residual"))


def redaction_boxes(spark, sf):
    """The largest part of each label's pictures that varies, from merged sums of their pixels."""

    def drawn(frames):
        for frame in frames:
            for vec_id, v, label in frame.itertuples(index=False):
                # A label's pictures are those of one size: the label sets how much the width is enlarged.
                gray = np.kron(_square(v), np.ones((4, 4 + label))).astype(np.uint8)
                yield pd.DataFrame({"path": [str(vec_id)], "width": [gray.shape[1]], "height": [32], "channels": [1], "data": [gray.tobytes()], "decodable": [True]})

    rows = table(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    found = overlay_free_boxes(rows.mapInPandas(drawn, "path string, width int, height int, channels int, data binary, decodable boolean"))
    label = (F.col("width") / 8 - 4).cast("int")
    return found.select(label.alias("label"), F.col("n").alias("n_sampled"), "reason", *[F.col(c).alias(f"box_{c}") for c in "xywh"])


FIT = Config().fit


def _fit_rows(spark, sf):
    """(vec_id, client, y, embedding): rows of five clients, of whom the last fifth of ids validates."""
    return table(spark, sf, "embeddings").select("vec_id", (F.col("vec_id") % 5).cast("int").alias("client"), "embedding", (F.col("label") % 5).cast("int").alias("y"))


def _is_validation():
    return F.pmod(F.xxhash64(F.lit("validation"), "vec_id"), F.lit(5)) == 0


def federated_fit(spark, sf):
    """Loss, validation AUC and traffic by round of a federated head over five clients, by each of the seven methods."""
    rows = _fit_rows(spark, sf)
    _, history = FED.train(rows.where(~_is_validation()), client="client", vector="embedding", label="y", id_col="vec_id", cfg=FIT, validation=rows.where(_is_validation()), abnormal=(0, 1))
    return FED.history_rows(spark, history)


@cache
def _fitted(spark, sf):
    cfg = replace(FIT, rounds=5)
    rows = _fit_rows(spark, sf)
    return FED.train(rows.where(~_is_validation()), client="client", vector="embedding", label="y", id_col="vec_id", methods=("fedavg", "fedper"), cfg=cfg)[0]


def head_predictions(spark, sf):
    """Class chances of every row under fitted heads: the shared one, the personal one that its nearest centroid names, and all."""
    fit, rows = _fitted(spark, sf), _fit_rows(spark, sf)
    near = V.nearest(rows, V.centroids(rows.where(~_is_validation()), "client", "embedding", 64), "client", "embedding")
    out = FED.predict_test(near, fit.heads("fedavg"), vector="embedding").withColumnRenamed("logp", "shared")
    out = FED.predict_test(out, fit.heads("fedper"), vector="embedding", mode="route", assigned="assigned").withColumnRenamed("logp", "routed")
    out = FED.predict_test(out, fit.heads("fedper"), vector="embedding", mode="ensemble").withColumnRenamed("logp", "ensemble")
    return out.select("vec_id", "assigned", *[F.round(F.get(c, F.lit(0)), 5).alias(c) for c in ("shared", "routed", "ensemble")])


def adapted_entropy(spark, sf):
    """Mean entropy and accuracy of a shifted table under the shared head, the head adapted on a window, and 8-bit heads."""
    fit, rows = _fitted(spark, sf), _fit_rows(spark, sf)
    shifted = R.inject_drift(rows, "embedding", "vec_id", 64, 1.0, seed=3)
    state = fit.heads("fedavg")[FED.POOLED]
    adapted = FED.window_adapt(state, R.window_sample(shifted, "vec_id", 256, 5), "embedding")
    out = None
    for name, head in (("plain", state), ("adapted", adapted), ("8 bit", FED.quantised_head(state)), ("adapted, 8 bit", FED.quantised_head(adapted))):
        p = FED.ensemble_posteriors(shifted, {FED.POOLED: head}, vector="embedding").withColumn("p", F.transform("logp", F.exp))
        one = p.agg(F.lit(name).alias("head"), F.round(F.avg(entropy(F.col("p"), 5)), 5).alias("entropy"), F.round(F.avg((argmax(F.col("p")) == F.col("y")).cast("double")), 7).alias("accuracy"))
        out = one if out is None else out.unionByName(one)
    return out


def event_windows(spark, sf):
    return window_moments(table(spark, sf, "events")).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("mean", 7).alias("mean"))


QUERIES = {f.__name__: f for f in (phash_dct, inscribed_rect, residual_score, redaction_boxes, federated_fit, head_predictions, adapted_entropy, event_windows)}
ORACLES = {
    "event_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(value) AS n, round(avg(value), 7) AS mean FROM events GROUP BY ALL",
}
