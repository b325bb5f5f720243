"""Federated fitting of a small classification head, all methods in one pass.

A step works on a seeded mini-batch of every client.  Tasks sum the gradients of
their own rows under each state; the sums and the states' optimisers meet on the
driver, which holds one state, some hundred kilobytes, for each method and
client.  Batch norm needs the mean and variance of a hidden layer over the whole
mini-batch; as the layer before it is linear, both follow from the mini-batch's
moments, which are summed once.  So no task ever holds a client's rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions.arrays import doubles
from sieveline.functions.batches import small_batches
from sieveline.operators import metrics
from sieveline.sources.scratch import materialise

METHODS = ("centralized", "local", "fedavg", "fedprox", "fedper", "pfedme", "fedgim")
#: Methods whose clients end with a model of their own.
PERSONAL = ("local", "fedper", "pfedme", "fedgim")
LEARNED = ("fc1.w", "fc1.b", "bn.g", "bn.b", "fc2.w", "fc2.b")
State = dict[str, np.ndarray]
Key = tuple[str, int]  # method and client; -1 for a method's only model
POOLED = -1
#: Ways in which sums meet on the driver, and bytes of states that are broadcast at once.
WAYS, STATES_AT_ONCE = 4, 64_000_000
#: Rows that a task works on at once.
ROWS_AT_ONCE = 512


@dataclass(frozen=True)
class FitConfig:
    # The head and its optimisers.
    classes: int = 5
    hidden: int = 256
    dropout: float = 0.3
    rounds: int = 20
    epochs: int = 2
    lr: float = 1e-3
    decay: float = 1e-4
    mu: float = 0.01
    lam: float = 15.0
    inner: int = 5
    outer_lr: float = 1e-2
    outer_beta: float = 1.0
    beta: float = 0.999
    clip: float = 5.0
    momentum: float = 0.1
    private: str = "fc2"
    seed: int = 42
    #: Mini-batches an epoch; a client's rows are dealt to them by a seeded hash.
    batches: int = 1


def initial_state(dim: int, cfg: FitConfig) -> State:
    r = np.random.default_rng(cfg.seed)
    lin = lambda a, b: r.uniform(-1, 1, (a, b)) / np.sqrt(a)
    h, c = cfg.hidden, cfg.classes
    out = {"fc1.w": lin(dim, h), "fc1.b": np.zeros(h), "bn.g": np.ones(h), "bn.b": np.zeros(h), "fc2.w": lin(h, c), "fc2.b": np.zeros(c)}
    return out | {"bn.mean": np.zeros(h), "bn.var": np.ones(h), "bn.steps": np.zeros(1, np.int64)}


def copied(s: State) -> State:
    return {k: v.copy() for k, v in s.items()}


def erf(x: np.ndarray, bell: np.ndarray | None = None) -> np.ndarray:
    """By a rational form with fixed coefficients, to 1.5e-7; ``bell`` is exp(-x * x) where it is known."""
    t = 1 / (1 + 0.3275911 * np.abs(x))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return np.sign(x) * (1 - poly * (np.exp(-x * x) if bell is None else bell))


def gelu(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The exact form and its derivative."""
    bell = np.exp(-x * x / 2)
    half = 0.5 * (1 + erf(x / np.sqrt(2), bell))
    return x * half, half + x * bell / np.sqrt(2 * np.pi)


def softmax_rows(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def head_logits(s: State, x: np.ndarray) -> np.ndarray:
    """At inference: running statistics, no dropout; a row's logits don't depend on its batch."""
    n = (x @ s["fc1.w"] + s["fc1.b"] - s["bn.mean"]) / np.sqrt(s["bn.var"] + 1e-5)
    return gelu(n * s["bn.g"] + s["bn.b"])[0] @ s["fc2.w"] + s["fc2.b"]


def keep_mask(ids: np.ndarray, hidden: int, step: int, share: float) -> np.ndarray:
    """Dropout of each (row, unit, step): zeros, or what keeps the mean; it doesn't depend on how rows are dealt."""
    u64 = np.uint64
    x = ids.astype(u64)[:, None] * u64(0x9E3779B97F4A7C15) + (np.arange(hidden, dtype=u64) + u64(step * hidden + 1)) * u64(0xD1B54A32D192ED03)
    x = (x ^ (x >> u64(30))) * u64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> u64(27))) * u64(0x94D049BB133111EB)
    u = ((x ^ (x >> u64(31))) >> u64(11)) * 2.0**-53
    return (u >= share) / (1 - share)


@dataclass
class Moments:
    """Of a mini-batch: rows, sums, sums of products and rows by class."""

    n: float
    total: np.ndarray
    square: np.ndarray
    classes: np.ndarray

    @staticmethod
    def of(x: np.ndarray, y: np.ndarray, classes: int) -> np.ndarray:
        return np.concatenate([[len(x)], x.sum(0), (x.T @ x).reshape(-1), np.bincount(y, minlength=classes)])

    @staticmethod
    def from_flat(v: np.ndarray, dim: int) -> Moments:
        return Moments(v[0], v[1 : 1 + dim], v[1 + dim : 1 + dim + dim * dim].reshape(dim, dim), v[1 + dim + dim * dim :])

    def norm(self, s: State) -> tuple[np.ndarray, np.ndarray]:
        """Mean and variance of the layer before the norm."""
        mean = self.total / self.n
        spread = self.square / self.n - np.outer(mean, mean)
        return mean @ s["fc1.w"] + s["fc1.b"], np.maximum(((spread @ s["fc1.w"]) * s["fc1.w"]).sum(0), 0)


def partial_gradient(s: State, mu: np.ndarray, var: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray, mask: np.ndarray | float) -> np.ndarray:
    """What some rows of a mini-batch add: loss, weight, and the sums that ``whole_gradient`` takes."""
    n = (x @ s["fc1.w"] + s["fc1.b"] - mu) / np.sqrt(var + 1e-5)
    h, slope = gelu(n * s["bn.g"] + s["bn.b"])
    h = h * mask
    p = softmax_rows(h @ s["fc2.w"] + s["fc2.b"])
    w = weight[y]
    row = np.arange(len(y))
    loss = -(w * np.log(np.maximum(p[row, y], 1e-300))).sum()
    p[row, y] -= 1
    d = p * w[:, None]
    a = (d @ s["fc2.w"].T) * slope * mask
    parts = [np.array([loss, w.sum()]), h.T @ d, d.sum(0), (a * n).sum(0), a.sum(0), x.T @ a]
    return np.concatenate([q.reshape(-1) for q in parts])


def whole_gradient(s: State, mu: np.ndarray, var: np.ndarray, m: Moments, sums: np.ndarray) -> tuple[float, State]:
    """Mean loss and its gradient from the sums over a mini-batch, through the norm's own statistics."""
    dim, hidden = s["fc1.w"].shape
    classes = s["fc2.w"].shape[1]
    w2, b2, g, b, xa = np.split(sums[2:] / sums[1], np.cumsum([hidden * classes, classes, hidden, hidden]))
    sd = np.sqrt(var + 1e-5)
    gain = s["bn.g"]
    xn = (m.square @ s["fc1.w"] + np.outer(m.total, s["fc1.b"] - mu)) / sd
    w1 = (xa.reshape(dim, hidden) * gain - np.outer(m.total, gain * b / m.n) - xn * (gain * g / m.n)) / sd
    # A shift of the layer is taken away by the norm: its gradient is zero.
    return sums[0] / sums[1], {"fc1.w": w1, "fc1.b": np.zeros(hidden), "bn.g": g, "bn.b": b, "fc2.w": w2.reshape(hidden, classes), "fc2.b": b2}


class Adam:
    """Adam with decoupled decay, after clipping the gradient's norm."""

    def __init__(self, cfg: FitConfig, state: State):
        self.cfg, self.t = cfg, 0
        self.m, self.v = ({k: np.zeros_like(state[k]) for k in LEARNED} for _ in range(2))

    def step(self, s: State, g: State) -> None:
        cfg = self.cfg
        norm = np.sqrt(sum((a * a).sum() for a in g.values()))
        scale = min(1.0, cfg.clip / (norm + 1e-6))
        self.t += 1
        for k in LEARNED:
            self.m[k] = 0.9 * self.m[k] + 0.1 * scale * g[k]
            self.v[k] = 0.999 * self.v[k] + 0.001 * (scale * g[k]) ** 2
            s[k] = s[k] * (1 - cfg.lr * cfg.decay) - cfg.lr * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


def class_weights(counts: np.ndarray, cfg: FitConfig, balanced: bool) -> np.ndarray:
    w = (1 - cfg.beta) / (1 - cfg.beta ** np.maximum(counts, 1)) if balanced else np.ones(cfg.classes)
    return w * cfg.classes / w.sum()


def is_private(key: str, method: str, cfg: FitConfig) -> bool:
    return method in ("fedper", "fedgim") and key.startswith(f"{cfg.private}.")


def payload_bytes(state: State, method: str, cfg: FitConfig) -> int:
    """Bytes that a client sends up in a round: its shared floats, four bytes each."""
    return sum(4 * v.size for k, v in state.items() if v.dtype != np.int64 and not is_private(k, method, cfg))


def averaged(states: Sequence[State], weights: np.ndarray, method: str, cfg: FitConfig) -> State:
    """The weighted mean of shared parts; whole numbers come from the first."""
    w = weights / weights.sum()
    return {k: v.copy() if v.dtype == np.int64 else sum(a * s[k] for a, s in zip(w, states)) for k, v in states[0].items() if not is_private(k, method, cfg)}


def summed(parts: DataFrame, keys: Sequence[str]) -> dict[tuple, np.ndarray]:
    """Sums of arrays of doubles (``x``, binary) by whole-number keys: tasks add as rows come, the driver adds ``WAYS`` rows a key."""
    kind = ", ".join([*(f"{k} int" for k in keys), "x binary"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for *key, x in zip(*(c.to_pylist() for c in batch.columns)):
                held[tuple(key)] = held.get(tuple(key), 0) + np.frombuffer(x)
        yield from _binary_rows(held, keys)

    dealt = parts.withColumn("way", F.pmod(F.monotonically_increasing_id(), F.lit(WAYS))).repartition(*keys, "way").drop("way")
    out: dict[tuple, np.ndarray] = {}
    for *key, x in dealt.mapInArrow(add, kind).collect():
        out[tuple(key)] = out.get(tuple(key), 0) + np.frombuffer(x)
    return out


def _binary_rows(held: dict[tuple, np.ndarray], keys: Sequence[str]) -> Iterator[pa.RecordBatch]:
    for key, x in held.items():
        yield pa.RecordBatch.from_arrays([*(pa.array([k], pa.int32()) for k in key), pa.array([x.tobytes()], pa.binary())], names=[*keys, "x"])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows, ``ROWS_AT_ONCE`` at a time: hidden layers are larger than the rows."""
    for batch in batches:
        for at in range(0, len(batch), ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


class Fit:
    """Methods being fitted: their states, and the steps that the driver leads."""

    def __init__(self, df: DataFrame, methods: Sequence[str], cfg: FitConfig, *, client: str, vector: str, label: str, id_col: str):
        unknown = set(methods) - set(METHODS)
        if unknown:
            raise ValueError(f"unknown methods {sorted(unknown)}")
        self.cfg, self.methods, self.spark = cfg, list(methods), df.sparkSession
        q = lambda c: F.col(f"`{c}`")
        batch = F.pmod(F.xxhash64(F.lit(cfg.seed), q(id_col)), F.lit(cfg.batches)).cast("int")
        usable = q(client).isNotNull() & q(vector).isNotNull() & q(label).between(0, cfg.classes - 1)
        rows = df.where(usable).select(q(client).cast("int").alias("client"), batch.alias("batch"), doubles(q(vector)).alias("v"), q(label).cast("int").alias("y"), F.xxhash64(q(id_col)).alias("h"))
        self.rows = materialise(rows, "fit-rows")
        first = self.rows.select(F.size("v").alias("d")).first()
        self.dim, classes = (first["d"] if first else 0), cfg.classes

        def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple, np.ndarray] = {}
            for b in _slices(batches):
                x, y, code = _matrix(b.column("v")), b.column("y").to_numpy(), np.stack([b.column("client").to_numpy(), b.column("batch").to_numpy()], 1)
                for key in np.unique(code, axis=0):
                    some = (code == key).all(1)
                    held[tuple(key.tolist())] = held.get(tuple(key.tolist()), 0) + Moments.of(x[some], y[some], classes)
            yield from _binary_rows(held, ("client", "batch"))

        found = summed(self.rows.mapInArrow(moments, "client int, batch int, x binary"), ("client", "batch"))
        for batch_no in {b for _, b in found}:
            found[POOLED, batch_no] = sum(x for (_, b), x in list(found.items()) if b == batch_no)
        self.moments = {k: Moments.from_flat(v, self.dim) for k, v in found.items()}
        self.clients = sorted({c for c, _ in self.moments} - {POOLED})
        self.n = {c: sum(m.n for (k, _), m in self.moments.items() if k == c) for c in [*self.clients, POOLED]}
        self.counts = {c: sum((m.classes for (k, _), m in self.moments.items() if k == c), np.zeros(classes)) for c in [*self.clients, POOLED]}
        begin = initial_state(self.dim, cfg)
        self.shared = {m: copied(begin) for m in self.methods}
        self.own = {(m, c): copied(begin) for m in self.methods if m in PERSONAL for c in self.clients}
        self.step = 0

    def keys(self) -> list[Key]:
        return [(m, c) for m in self.methods for c in ([POOLED] if m == "centralized" else self.clients)]

    def gradients(self, states: dict[Key, State], batch: int) -> dict[Key, tuple[float, State]]:
        """Loss and gradient of every state on its client's mini-batch, by one job; running statistics move on."""
        cfg, step = self.cfg, self.step
        work: list[tuple] = []
        for (method, c), s in states.items():
            m = self.moments.get((c, batch))
            if m is not None and m.n >= 2:  # a norm needs two rows
                work.append((method, c, s, *m.norm(s), class_weights(self.counts[c], cfg, method == "fedgim")))
        if not work:
            return {}
        known = self.spark.sparkContext.broadcast([(c, {k: s[k] for k in LEARNED}, mu, var, w) for _, c, s, mu, var, w in work])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple, np.ndarray] = {}
            for b in _slices(batches):
                x, y, own = _matrix(b.column("v")), b.column("y").to_numpy(), b.column("client").to_numpy()
                mask = keep_mask(b.column("h").to_numpy(), cfg.hidden, step, cfg.dropout) if cfg.dropout else np.ones((len(x), cfg.hidden))
                for number, (c, s, mu, var, weight) in enumerate(known.value):
                    some = slice(None) if c == POOLED else own == c
                    if len(y[some]):
                        held[number,] = held.get((number,), 0) + partial_gradient(s, mu, var, x[some], y[some], weight, mask[some])
            yield from _binary_rows(held, ("number",))

        sums = summed(self.rows.where(F.col("batch") == batch).mapInArrow(run, "number int, x binary"), ("number",))
        known.destroy()
        out = {}
        for number, (method, c, s, mu, var, _) in enumerate(work):
            m = self.moments[c, batch]
            out[method, c] = whole_gradient(s, mu, var, m, sums[number,])
            s["bn.mean"] = (1 - cfg.momentum) * s["bn.mean"] + cfg.momentum * mu
            s["bn.var"] = (1 - cfg.momentum) * s["bn.var"] + cfg.momentum * var * m.n / (m.n - 1)
            s["bn.steps"] = s["bn.steps"] + 1
        return out

    def round(self, number: int) -> dict[str, float]:
        """A round of every method: local epochs, then averages; the mean loss of each method."""
        cfg = self.cfg
        at = {k: copied(self.shared[k[0]]) for k in self.keys()}
        for (m, c), s in at.items():
            if m == "local":
                at[m, c] = copied(self.own[m, c])
            s.update({k: self.own[m, c][k].copy() for k in s if is_private(k, m, cfg)})
        anchor = {k: copied(s) for k, s in at.items()}
        opt = {k: Adam(cfg, s) for k, s in at.items() if k[0] != "pfedme"}
        losses: dict[Key, list[float]] = {k: [] for k in at}
        theta: dict[Key, State] = {}
        for epoch in range(cfg.epochs):
            for batch in np.random.default_rng([cfg.seed, number, epoch]).permutation(cfg.batches).tolist():
                inner = {k: copied(s) for k, s in at.items() if k[0] == "pfedme"}
                own = {k: Adam(cfg, s) for k, s in inner.items()}
                for turn in range(cfg.inner if inner else 1):
                    self.step += 1
                    asked = inner | ({k: at[k] for k in opt} if turn == 0 else {})
                    for k, (loss, g) in self.gradients(asked, batch).items():
                        if k in inner:
                            own[k].step(inner[k], {x: g[x] + cfg.lam * (inner[k][x] - at[k][x]) for x in LEARNED})
                            if turn == cfg.inner - 1:
                                losses[k].append(loss)
                            continue
                        if k[0] in ("fedprox", "fedgim"):
                            g = {x: g[x] + cfg.mu * (at[k][x] - anchor[k][x]) for x in LEARNED}
                        opt[k].step(at[k], g)
                        losses[k].append(loss)
                for k, s in inner.items():
                    theta[k] = s
                    at[k] = {x: v if v.dtype == np.int64 else v - cfg.outer_lr * cfg.lam * (v - s[x]) for x, v in at[k].items()}
        out = {}
        for m in self.methods:
            own = [k for k in at if k[0] == m]
            weights = np.array([self.n[c] for _, c in own], float)
            mean = np.array([np.mean(losses[k]) if losses[k] else 0.0 for k in own])
            out[m] = float((mean * weights).sum() / weights.sum()) if own else float("nan")
            if m == "centralized" and own:
                self.shared[m] = at[own[0]]
            elif m == "local":
                self.own.update({k: at[k] for k in own})
            elif own:
                found = averaged([at[k] for k in own], weights, m, cfg)
                if m == "pfedme":
                    found = {k: v if v.dtype == np.int64 else (1 - cfg.outer_beta) * self.shared[m][k] + cfg.outer_beta * v for k, v in found.items()}
                self.shared[m] |= found
                if m in PERSONAL:
                    self.own.update({k: theta.get(k, at[k]) for k in own})
        return out

    def heads(self, method: str) -> dict[int, State]:
        """The models that a method deploys, by client; one under ``POOLED`` if clients share it.

        A personal model takes the private part of its client and the rest of
        the shared one; without a private part it is all its client's.
        """
        if method not in PERSONAL:
            return {POOLED: self.shared[method]}
        whole = method in ("local", "pfedme")
        return {c: self.own[method, c] if whole else self.shared[method] | {k: v for k, v in self.own[method, c].items() if is_private(k, method, self.cfg)} for c in self.clients}


def train(
    df: DataFrame,
    *,
    client: str,
    vector: str,
    label: str,
    id_col: str,
    methods: Sequence[str] = METHODS,
    cfg: FitConfig = FitConfig(),
    validation: DataFrame | None = None,
    abnormal: Sequence[int] = (),
) -> tuple[Fit, list[tuple]]:
    """(what was fitted, history): (method, round, train_loss, val_auc, comm_mb_round, comm_mb_cum) rows.

    ``val_auc`` is that of the chance of the ``abnormal`` classes on the rows of
    ``validation``, the mean over a method's personal models; null without rows
    of both kinds.  Rows with a null client or vector or a label outside of the
    classes aren't used.  An empty table gives the beginning state and no client.
    Each row counts, repeats of an id too.
    """
    fit = Fit(df, methods, cfg, client=client, vector=vector, label=label, id_col=id_col)
    if validation is not None:
        y = F.col(f"`{label}`").isin(list(abnormal)).cast("int")
        validation = materialise(validation.where(F.col(f"`{vector}`").isNotNull()).select(doubles(F.col(f"`{vector}`")).alias("v"), y.alias("y")), "fit-validation")
    # Heads of many rounds are validated together: states of ``STATES_AT_ONCE`` bytes, or the last ones.
    losses: dict[int, dict[str, float]] = {}
    held: dict[tuple, State] = {}
    aucs: dict[tuple, float | None] = {}
    for number in range(1, cfg.rounds + 1 if fit.clients else 1):
        losses[number] = fit.round(number)
        if validation is not None:
            held |= {(number, m, c): dict(s) for m in fit.methods for c, s in fit.heads(m).items()}
            if sum(v.nbytes for s in held.values() for v in s.values()) >= STATES_AT_ONCE:
                aucs, held = aucs | head_aucs(validation, held, abnormal), {}
    aucs |= head_aucs(validation, held, abnormal) if held else {}
    history, spent = [], dict.fromkeys(fit.methods, 0.0)
    for number, loss in losses.items():
        for m in fit.methods:
            alone = m in ("centralized", "local")
            mb = 0.0 if alone else payload_bytes(fit.shared[m], m, cfg) * len(fit.clients) * 2 / 2**20
            spent[m] += mb
            own = [aucs.get((number, m, c)) for c in fit.heads(m)]
            auc = None if not own or None in own else float(np.mean(own))
            history.append((m, number, loss[m], auc, mb, spent[m]))
    return fit, history


HISTORY = "method string, round int, train_loss double, val_auc double, comm_mb_round double, comm_mb_cum double"


def _chunks(heads: dict) -> Iterator[list[tuple]]:
    """States of at most ``STATES_AT_ONCE`` bytes together."""
    held, size = [], 0
    for key, s in heads.items():
        own = sum(v.nbytes for v in s.values())
        if held and size + own > STATES_AT_ONCE:
            yield held
            held, size = [], 0
        held.append((key, s))
        size += own
    if held:
        yield held


def head_aucs(rows: DataFrame, heads: dict[tuple, State], abnormal: Sequence[int]) -> dict[tuple, float | None]:
    """AUC of every head's chance of the abnormal classes on (v, y) rows."""
    keys = list(heads)
    number = {k: n for n, k in enumerate(keys)}
    out: dict[Key, float | None] = {}
    for chunk in _chunks(heads):
        known = rows.sparkSession.sparkContext.broadcast([(number[k], s) for k, s in chunk])

        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            for b in _slices(batches):
                x, y = _matrix(b.column("v")), b.column("y")
                for n, s in known.value if len(y) else []:
                    score = np.round(softmax_rows(head_logits(s, x))[:, list(abnormal)].sum(1), 9)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), n, np.int32)), pa.array(score), y], names=["head", "s", "y"])

        scores = rows.mapInArrow(run, "head int, s double, y int")
        out |= {keys[r["head"]]: r["auc"] for r in metrics.auc(scores, F.col("s"), F.col("y"), ["head"]).collect()}
    return out


def _scored(df: DataFrame, vector: str, heads: dict[int, State], fold: Callable, extra: str) -> DataFrame:
    """``df`` with ``__p``, worked out in Arrow batches chunk by chunk of the heads; ``fold(p, state, x, some)``."""
    small_batches(df.sparkSession)
    out = df.withColumn("__v", doubles(F.col(f"`{vector}`"))).withColumn("__p", F.lit(None).cast("array<double>"))
    schema = out.schema
    for chunk in _chunks(heads):
        known = df.sparkSession.sparkContext.broadcast(chunk)

        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            for b in _slices(batches):
                p = [None if x is None else np.array(x) for x in b.column("__p").to_pylist()]
                valid = [n for n, v in enumerate(b.column("__v").to_pylist()) if v is not None]
                x = _matrix(b.column("__v").take(pa.array(valid, pa.int64())))
                wanted = b.column(extra).to_pylist() if extra else None
                for key, s in known.value if valid else []:
                    some = [k for k, n in enumerate(valid) if wanted is None or wanted[n] == key]
                    if some:
                        for k, row in zip(some, softmax_rows(head_logits(s, x[some]))):
                            p[valid[k]] = fold(p[valid[k]], row)
                yield b.set_column(b.schema.get_field_index("__p"), "__p", pa.array([None if q is None else q.tolist() for q in p], pa.list_(pa.float64())))

        out = out.mapInArrow(run, schema)
    return out


def routed_posteriors(df: DataFrame, heads: dict[int, State], *, vector: str, assigned: str, name: str = "p") -> DataFrame:
    """``name``: each row's class chances under the head that ``assigned`` names; null for other names and null vectors."""
    return _scored(df, vector, heads, lambda _, new: new, assigned).drop("__v").withColumnRenamed("__p", name)


def ensemble_posteriors(df: DataFrame, heads: dict[int, State], *, vector: str, name: str = "logp") -> DataFrame:
    """``name``: the logarithm of the mean chances over all heads, clipped at 1e-12."""
    total = _scored(df, vector, heads, lambda old, new: new if old is None else old + new, "")
    return total.withColumn(name, F.transform("__p", lambda x: F.ln(F.greatest(x / len(heads), F.lit(1e-12))))).drop("__v", "__p")


def predict_test(df: DataFrame, heads: dict[int, State], *, vector: str, mode: str = "route", assigned: str | None = None) -> DataFrame:
    """``logp`` of every row: under the shared head, the head it is ``assigned`` (``route``), or all (``ensemble``)."""
    if mode not in ("route", "ensemble"):
        raise ValueError(f"unknown mode {mode}")
    if len(heads) == 1 or mode == "ensemble":
        return ensemble_posteriors(df, heads, vector=vector)
    if assigned is None:
        raise ValueError("route needs the column of each row's head")
    own = routed_posteriors(df, heads, vector=vector, assigned=assigned, name="__own")
    return own.withColumn("logp", F.transform("__own", lambda x: F.ln(F.greatest(x, F.lit(1e-12))))).drop("__own")


def entropy_gradient(s: State, x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean entropy of a batch under its own norm statistics, and its gradient by the norm's gain and bias."""
    z = x @ s["fc1.w"] + s["fc1.b"]
    n = (z - z.mean(0)) / np.sqrt(z.var(0) + 1e-5)
    h, slope = gelu(n * s["bn.g"] + s["bn.b"])
    p = softmax_rows(h @ s["fc2.w"] + s["fc2.b"])
    log = np.log(np.maximum(p, 1e-12))
    entropy = -(p * log).sum(1, keepdims=True)
    d = -p * (log + entropy) / len(x)
    a = (d @ s["fc2.w"].T) * slope
    return float(entropy.mean()), (a * n).sum(0), a.sum(0)


def entropy_adapt(state: State, x: np.ndarray, *, steps: int = 3, lr: float = 1e-3) -> State:
    """A head whose norm's gain and bias lower the entropy of an unlabelled window, by Adam.

    Batches hold 64 to 256 rows; one of a single row is passed over.  The
    adapted head scores with the window's statistics in place of the running ones.
    """
    s, m, v, t = copied(state), np.zeros((2, len(state["bn.g"]))), np.zeros((2, len(state["bn.g"]))), 0
    size = max(64, min(256, len(x)))
    for _ in range(steps):
        for at in range(0, len(x), size):
            if len(x[at : at + size]) < 2:
                continue
            _, *g = entropy_gradient(s, x[at : at + size])
            t += 1
            m, v = 0.9 * m + 0.1 * np.array(g), 0.999 * v + 0.001 * np.array(g) ** 2
            move = lr * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            s["bn.g"], s["bn.b"] = s["bn.g"] - move[0], s["bn.b"] - move[1]
    if len(x) > 1:
        z = x @ s["fc1.w"] + s["fc1.b"]
        s["bn.mean"], s["bn.var"] = z.mean(0), z.var(0)
    return s


def window_adapt(state: State, window: DataFrame, vector: str, *, most: int = 4096, steps: int = 3, lr: float = 1e-3) -> State:
    """``entropy_adapt`` on a window of at most ``most`` rows, which the driver holds, in the order of ``place``."""
    rows = window.where(F.col(f"`{vector}`").isNotNull()).select("place", doubles(F.col(f"`{vector}`")).alias("v")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the window has more than {most} rows")
    x = np.array([r["v"] for r in sorted(rows, key=lambda r: r["place"])])
    return entropy_adapt(state, x.reshape(len(rows), -1), steps=steps, lr=lr) if rows else copied(state)


def quantised(w: np.ndarray) -> np.ndarray:
    """Symmetric 8-bit weights, as floats again."""
    scale = np.abs(w).max() / 127 if w.size else 0.0
    return np.round(w / scale) * scale if scale else w


def quantised_head(state: State) -> State:
    """A head whose two linear layers have 8-bit weights."""
    return state | {k: quantised(state[k]) for k in ("fc1.w", "fc2.w")}


def history_rows(spark: SparkSession, history: Sequence[tuple]) -> DataFrame:
    return spark.createDataFrame(list(history), HISTORY)
