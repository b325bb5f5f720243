"""Language-model scores by causal self-attention over subword ids, in numpy.

The network tells the group of the next id and its slot in the group from the
ids before it; ids that share a slot are told by their counts in the training
texts.  Groups hold ids with like neighbours.  Groups, slots and what usually
follows an id or a group, which the network starts from, come from counts over
all training texts.  Tasks fit the network on all windows of their blocks, a part
at a time; their parameters are averaged between parts.  Texts are scored in overlapping windows, each id once, with
a third of a window or more before it.

Documents stay in blocks that hold their words as codes: a block asks for the
counts of its distinct words, so words are aggregated before any exchange.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.collocations import LOWER
from sieveline.llm.packing import forget_ids, word_ids
from sieveline.llm.shared import crc32_of_id, documents, emptied_after, or_empty, small_batches
from sieveline.sources.scratch import materialise

F32 = np.float32
#: Characters of text in a block; a longer text is a block of its own.
BLOCK_CHARS = 12_000_000
#: Places of a window that are scored and those before them; windows scored at once by the attention and by the groups.
TOLD, BEFORE, STEP, LONG = 16, 8, 256, 2048
SPAN = BEFORE + TOLD
#: Width of the model and of its hidden layer, random directions for neighbours on either side.
WIDTH, HIDDEN, SKETCH = 12, 24, 8
#: Groups of ids with like neighbours, one more for ids seen less than ``RARE`` times and one for the end.
GROUPS, RARE = 46, 3
CLASSES = GROUPS + 2
#: Slots of a group: its most frequent ids each have one, the others share the last.
SLOTS = 40
PLACES = GROUPS * SLOTS
#: What is added to an id's count in its slot; how many followers the next wider count stands for.
SMOOTH, PRIOR = 0.1, 20.0
#: Ways in which parameters of tasks are summed before they meet.
WAYS = 64
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True


def squeeze(x: np.ndarray) -> bytes:
    return len(x).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(x).tobytes(), codec="zstd", asbytes=True)


def expand(data: bytes, kind: str) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], decompressed_size=n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


def split_words(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, A-Z lower-cased, the code of each word, and the number of words of each text."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    raw = LOWER[np.frombuffer(b"\n".join(parts), np.uint8)]
    inside = ~WHITE[raw]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start = edge[::2]
    offsets = np.zeros(len(start) + 1, np.int32)
    np.cumsum(edge[1::2] - start, out=offsets[1:])
    found = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(raw[inside])).dictionary_encode()
    of = np.searchsorted(np.cumsum([len(p) + 1 for p in parts]), start, side="right")
    return found.dictionary, found.indices.to_numpy(zero_copy_only=False), np.bincount(of, minlength=len(texts))


def blocks_of(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Blocks of (id, text, train) rows: ids, marks and word numbers of the rows,
    the words' codes, and for each distinct word its count in training and its subword ids."""
    id_type = docs.schema["id"].dataType.simpleString()
    small_batches(docs.sparkSession)

    @emptied_after(forget_ids)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, number = word_ids(tokenizer), 0
        ids, texts, train, chars = [], [], [], 0

        def block() -> pa.RecordBatch:
            words, code, sizes = split_words(texts)
            mark = np.array(train, bool)
            counts = np.bincount(code[np.repeat(mark, sizes)], minlength=len(words))
            pieces, length = table.each(words)
            row = {
                "block": (TaskContext.get().partitionId() << 32) + number,
                "ids": ids,
                "train": train,
                "sizes": sizes.tolist(),
                "codes": squeeze(code.astype("<i4")),
                "lengths": squeeze(length),
                "pieces": squeeze(pieces),
            }
            columns = [pa.array([v], kinds[k]) for k, v in row.items()]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), x) for x in (words, pa.array(counts.astype(np.int64)))]
            return pa.RecordBatch.from_arrays([*columns, *lists], names=[*row, "words", "counts"])

        for batch in batches:
            kinds = {"block": pa.int64(), "ids": pa.list_(batch.schema.field("id").type), "train": pa.list_(pa.bool_()), "sizes": pa.list_(pa.int64()), "codes": pa.binary(), "lengths": pa.binary(), "pieces": pa.binary()}
            for key, text, learn in zip(*(batch.column(c) for c in ("id", "text", "train"))):
                ids.append(key.as_py())
                texts.append(text.as_py())
                train.append(learn.as_py())
                chars += len(texts[-1])
                if chars >= BLOCK_CHARS:
                    yield block()
                    number, chars = number + 1, 0
                    ids, texts, train = [], [], []
        if ids:
            yield block()

    schema = f"block long, ids array<{id_type}>, train array<boolean>, sizes array<long>, codes binary, lengths binary, pieces binary, words array<string>, counts array<long>"
    return materialise(docs.select("id", "text", "train").mapInArrow(run, schema), "lm-blocks")


class Block:
    """The texts of a block as ids: ``ids`` end to end, ``sizes`` ids of each text."""

    def __init__(self, row: dict, only: np.ndarray | None = None):
        code, length, pieces = expand(row["codes"], "<i4").astype(np.int64), expand(row["lengths"], "<i4"), expand(row["pieces"], "<u4")
        self.words = np.array(row["sizes"], np.int64)
        self.code = code
        if only is not None:
            code = code[np.repeat(only, self.words)]
        words = self.words if only is None else self.words[only]
        n = length[code].astype(np.int64)
        ends = np.cumsum(n)
        begin = (np.cumsum(length) - length)[code]
        self.ids = pieces[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - n), n)].astype(np.int32)
        until = np.concatenate([[0], ends])[np.cumsum(words)]
        self.sizes = np.diff(until, prepend=0)


def windows(ids: np.ndarray, sizes: np.ndarray, begin: int, pad: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Padded ids, the place in them of each window, targets in windows (-1 where there is none) and the text of each window."""
    count = sizes // TOLD + 1  # of the places 0 .. sizes, each of which tells the next id
    room = count * TOLD + BEFORE
    first = np.cumsum(room) - room + BEFORE  # of a text's begin mark
    seq = np.full(int(room.sum()), pad, np.int32)
    seq[first] = begin
    offset = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(ids))
    seq[offset + 1] = ids  # the last place of a text is its own last window's
    target = np.full(len(seq), -1, np.int32)
    target[offset] = ids
    target[first + sizes] = end
    of = np.repeat(np.arange(len(sizes)), count)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    return seq, first[of] - BEFORE + nth * TOLD, target, of


DISTANCE = BEFORE + np.arange(TOLD)[:, None] - np.arange(SPAN)
CAUSAL = np.where(DISTANCE < 0, F32(-1e4), F32(0))
SCALE = F32(WIDTH**-0.5)
#: Which columns are told together: those of all places of a window, and those of groups and of slots.
EVERY, HEADS = np.ones((SPAN, 1), F32), np.repeat(np.eye(2, dtype=F32), [CLASSES, SLOTS], 0)
SHAPES = {
    "emb": (CLASSES + 2, WIDTH), "near": (2 * SKETCH, WIDTH), "q": (WIDTH, WIDTH), "k": (WIDTH, WIDTH), "v": (WIDTH, WIDTH), "r": (WIDTH, WIDTH),
    "far": (SPAN,), "w1": (WIDTH, HIDDEN), "b1": (HIDDEN,), "w2": (HIDDEN, CLASSES), "w3": (GROUPS, HIDDEN, SLOTS),
}
EMB_AT = np.arange(np.prod(SHAPES["emb"])).reshape(SHAPES["emb"])


def first_parameters(seed: int = 13) -> dict[str, np.ndarray]:
    """Small random weights; the last layers add nothing yet."""
    r = np.random.default_rng(seed)
    p = {k: (r.normal(0, s[-2] ** -0.5 if len(s) > 1 and k not in ("w2", "w3") else 0.0, s)).astype(F32) for k, s in SHAPES.items()}
    p["emb"] = r.normal(0, 0.5, SHAPES["emb"]).astype(F32)
    return p


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].reshape(-1) for k in SHAPES])


def shaped(x: np.ndarray) -> dict[str, np.ndarray]:
    sizes = [int(np.prod(s)) for s in SHAPES.values()]
    return {k: part.reshape(s).astype(F32, copy=False) for (k, s), part in zip(SHAPES.items(), np.split(x, np.cumsum(sizes)[:-1]))}


class Vocabulary:
    """Groups and slots of ids, their neighbours' directions and their chance within the slot.

    Two marks follow the ids: begin and padding as inputs; as a target the first is the end.
    """

    def __init__(self, counts: np.ndarray, sketch: np.ndarray, texts: int):
        n = len(counts)
        near = sketch / np.maximum(counts, 1)[:, None]
        seen = np.flatnonzero(counts >= RARE)
        cls, slot = np.full(n, GROUPS), np.full(n, -1)
        if len(seen):
            near = near - (near[seen] * counts[seen, None]).sum(0) / counts[seen].sum()
            near /= np.maximum(np.linalg.norm(near, axis=1, keepdims=True), 1e-9)
            cls[seen] = groups(near[seen], counts[seen])
            order = seen[np.lexsort((seen, -counts[seen], cls[seen]))]
            rank = np.arange(len(order)) - np.searchsorted(cls[order], cls[order])
            slot[order] = np.minimum(rank, SLOTS - 1)
        near[counts < RARE] = 0
        self.size, self.begin, self.pad, self.end = n, n, n + 1, n
        self.cls = np.concatenate([cls, [CLASSES, CLASSES + 1]]).astype(np.int16)
        self.goal, self.slot = np.concatenate([cls, [CLASSES - 1]]).astype(np.int16), np.concatenate([slot, [-1]])
        self.near = np.concatenate([near, np.zeros((2, near.shape[1]))]).astype(F32)
        smooth = counts + SMOOTH
        place = cls * SLOTS + np.maximum(slot, 0)
        total = np.bincount(place, smooth, CLASSES * SLOTS)
        self.within = np.concatenate([np.log(smooth / total[place]), [0.0]])
        self.slots = np.where(np.bincount(place, minlength=CLASSES * SLOTS) > 0, total, 0).reshape(CLASSES, SLOTS)[:GROUPS]
        self.mass = np.bincount(cls, counts + 1, CLASSES)
        self.mass[-1] = texts + 1

    def pairs(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the pairs of an id and the group behind it, and of those of a group and the slot behind it."""
        ends = np.cumsum(sizes)
        first = np.insert(ids, ends - sizes, self.begin)
        then = np.insert(ids, ends, self.end)
        slot = self.slot[then]
        second = self.cls[first].astype(np.int64) * PLACES + self.goal[then] * SLOTS + slot
        return first.astype(np.int64) * CLASSES + self.goal[then], second[slot >= 0]

    def follow(self, groups_behind: np.ndarray, slots_behind: np.ndarray) -> None:
        """Logarithms of the chance of each group behind each id, and of each slot of a group
        behind each group: counts, with those of the id's group, the group and all as a prior."""
        every = self.mass / self.mass.sum()
        behind = groups_behind.reshape(-1, CLASSES)
        of = self.cls[: self.size + 1]
        group = np.array([np.bincount(of, behind[:, k], CLASSES + 2) for k in range(CLASSES)]).T + PRIOR * every
        group /= group.sum(1, keepdims=True)
        behind = behind + PRIOR * group[of]
        with np.errstate(divide="ignore"):
            told = np.log(behind / behind.sum(1, keepdims=True))
            self.next_group = np.concatenate([np.maximum(told, -1e4), np.zeros((1, CLASSES))]).astype(F32)
            usual = self.slots / np.maximum(self.slots.sum(1, keepdims=True), 1e-9)
            slots = slots_behind.reshape(-1, GROUPS, SLOTS) + PRIOR * usual
            told = np.log(slots / np.maximum(slots.sum(2, keepdims=True), 1e-9))
            self.next_slot = np.ascontiguousarray(np.maximum(told, -1e4).transpose(1, 0, 2)).astype(F32)  # by group, then by the group before

    def by_group(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the targets, group by group, and where each group begins among them; those without a slot are last."""
        goal = np.where(target >= 0, self.goal.take(target), np.int16(CLASSES))
        order = np.argsort(goal, kind="stable")
        ends = np.searchsorted(goal.take(order), np.arange(CLASSES + 1))
        return order[: ends[-1]], ends


def few_rows(ends: np.ndarray, least: int = 1024) -> Iterator[tuple[slice, list[tuple[int, slice]]]]:
    """Groups that lie together in about ``least`` rows, which fit a core's own memory: their rows, and those of each among them."""
    ends, parts, first = ends.tolist(), [], 0
    for one, (begin, end) in enumerate(pairwise(ends)):
        if end > begin:
            parts.append((one, slice(begin - first, end - first)))
        if parts and (end - first >= least or end == ends[-1]):
            yield slice(first, end), parts
            parts, first = [], end


def groups(x: np.ndarray, weight: np.ndarray, rounds: int = 20) -> np.ndarray:
    """Weighted k-means on directions, seeded by the heaviest that lie apart."""
    order = np.argsort(-weight, kind="stable")
    centres = x[order[:1]]
    far = 1 - x @ centres[0]
    for _ in range(min(GROUPS, len(x)) - 1):
        centres = np.concatenate([centres, x[[np.argmax(far * np.sqrt(weight))]]])
        far = np.minimum(far, 1 - x @ centres[-1])
    for _ in range(rounds):
        of = np.argmax(x @ centres.T, axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, of, x * np.sqrt(weight)[:, None])
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(norm > 0, total / np.maximum(norm, 1e-9), centres)
    return np.argmax(x @ centres.T, axis=1)


class Network:
    """One layer of causal self-attention, a hidden layer and a softmax over classes."""

    def __init__(self, p: dict[str, np.ndarray], vocabulary: Vocabulary):
        self.p, self.of = p, vocabulary

    def gradient(self, inputs: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Summed loss over the targets, and the gradient of its mean."""
        p, of, shape = self.p, self.of, (len(inputs), SPAN, WIDTH)
        cls, near = of.cls.take(inputs.reshape(-1)), of.near.take(inputs.reshape(-1), 0)
        x = near @ p["near"]
        x += p["emb"].take(cls, 0)
        x2 = x.reshape(shape)[:, BEFORE:].reshape(-1, WIDTH)
        gives, asks = np.concatenate([p["k"], p["v"]], 1), np.concatenate([p["q"] * SCALE, p["r"]], 1)
        kv, qr = (x @ gives).reshape(*shape[:2], -1), (x2 @ asks).reshape(len(inputs), TOLD, -1)
        k, v, q = kv[..., :WIDTH], kv[..., WIDTH:], qr[..., :WIDTH]
        a = self.attend(q, k, inputs)
        o = a @ v
        target = target.reshape(-1)
        order, ends = of.by_group(target)
        target, last, n = target.take(order), inputs[:, BEFORE:].reshape(-1).take(order), max(len(order), 1)
        h = np.ones((len(order), WIDTH + 1), F32)  # the last column is for what is added
        h[:, :WIDTH] = (qr[..., WIDTH:] + o).reshape(-1, WIDTH).take(order, 0)
        g = h @ np.concatenate([p["w1"], p["b1"][None]])
        np.maximum(g, 0, out=g)
        heads, loss, dg = self.heads(), 0.0, np.empty_like(g)
        d_heads = np.zeros_like(heads)
        for some, parts in few_rows(ends):
            y, at = self.told(g[some], heads, parts, last[some], target[some])
            y = shares(y, HEADS, n)
            y[max(ends[GROUPS] - some.start, 0) :, CLASSES:] = 0  # these have no slot
            share = y.reshape(-1).take(at)
            loss -= np.log(np.maximum(share * F32(n), 1e-30)).sum(dtype=float)
            y.reshape(-1)[at] = share - F32(1 / n)
            rows, d_rows = g[some], dg[some]
            for one, part in parts:
                np.matmul(rows[part].T, y[part], out=d_heads[one])
                np.matmul(y[part], heads[one].T, out=d_rows[part])
        d = {"w2": d_heads[..., :CLASSES].sum(0), "w3": d_heads[:GROUPS, :, CLASSES:]}
        dg *= g > 0
        d_w1 = h.T @ dg
        d |= {"w1": d_w1[:WIDTH], "b1": d_w1[WIDTH]}
        dh = np.zeros((len(inputs) * TOLD, WIDTH), F32)
        dh[order] = dg @ p["w1"].T
        dh = dh.reshape(len(inputs), TOLD, WIDTH)
        d_kv, d_qr = np.empty_like(kv), np.empty_like(qr)
        np.matmul(a.transpose(0, 2, 1), dh, out=d_kv[..., WIDTH:])
        ds = dh @ v.transpose(0, 2, 1)
        ds -= ((dh * o).reshape(-1, WIDTH) @ np.ones(WIDTH, F32)).reshape(*ds.shape[:2], 1)  # each row's mean of ds by its shares
        ds *= a
        d["far"] = np.bincount(np.maximum(DISTANCE, 0).reshape(-1), (ds.sum(0) * (DISTANCE >= 0)).reshape(-1), SPAN).astype(F32)
        np.matmul(ds.transpose(0, 2, 1), q, out=d_kv[..., :WIDTH])
        np.matmul(ds, k, out=d_qr[..., :WIDTH])
        d_qr[..., WIDTH:] = dh
        d_kv, d_qr = d_kv.reshape(-1, 2 * WIDTH), d_qr.reshape(-1, 2 * WIDTH)
        d["k"], d["v"] = np.split(x.T @ d_kv, 2, 1)
        d["q"], d["r"] = np.split(x2.T @ d_qr, 2, 1)
        d["q"] = d["q"] * SCALE
        dx = d_kv @ gives.T
        dx.reshape(shape)[:, BEFORE:] += (d_qr @ asks.T).reshape(len(inputs), TOLD, WIDTH)
        d["near"] = near.T @ dx
        d["emb"] = np.bincount(EMB_AT.take(cls, 0).reshape(-1), dx.reshape(-1), EMB_AT.size).reshape(EMB_AT.shape).astype(F32)
        return loss, d

    def heads(self) -> np.ndarray:
        """For each group as a target the weights of all groups and of its slots."""
        heads = np.zeros((CLASSES, HIDDEN, CLASSES + SLOTS), F32)
        heads[..., :CLASSES], heads[:GROUPS, :, CLASSES:] = self.p["w2"], self.p["w3"]
        return heads

    def told(self, g: np.ndarray, heads: np.ndarray, parts: list[tuple[int, slice]], last: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What is told of groups and slots from hidden rows that lie group by group, and the flat places of the targets' groups and slots."""
        of, y = self.of, np.empty((len(g), CLASSES + SLOTS), F32)
        for one, part in parts:
            np.matmul(g[part], heads[one], out=y[part])
        goal, slot = of.goal.take(target), of.slot.take(target)
        n = np.searchsorted(goal, GROUPS)  # those that have a slot
        y[:, :CLASSES] += of.next_group.take(last, 0)
        y[:n, CLASSES:] += of.next_slot.reshape(-1, SLOTS).take(goal[:n] * np.int64(CLASSES + 2) + of.cls.take(last[:n]), 0)
        at = np.arange(len(g)) * (CLASSES + SLOTS)
        return y, np.concatenate([at + goal, at[:n] + (CLASSES + slot[:n])])

    def attend(self, q: np.ndarray, k: np.ndarray, inputs: np.ndarray) -> np.ndarray:
        s = q @ k.transpose(0, 2, 1)
        s += self.p["far"][np.maximum(DISTANCE, 0)] + CAUSAL
        # Padding behind a text's end is seen from dead places only.
        padded = np.flatnonzero(inputs[:, 0] == self.of.pad)
        s[padded] += np.where(inputs[padded] == self.of.pad, F32(-1e4), F32(0))[:, None, :]
        return shares(s.reshape(-1, SPAN), EVERY).reshape(s.shape)

    def fit(self, seq: np.ndarray, goal: np.ndarray, start: np.ndarray, *, batch: int, rate: float) -> None:
        """A pass of Adam over the windows that begin at ``start``; the rate falls to a tenth."""
        now = flat(self.p)
        self.p = shaped(now)  # views
        first, second = np.zeros_like(now), np.zeros_like(now)
        steps = -(-len(start) // batch)
        for t in range(steps):
            where = start[t * batch : (t + 1) * batch, None] + np.arange(SPAN)
            g = flat(self.gradient(seq.take(where), goal.take(where[:, BEFORE:]))[1])
            step = rate * (1 - 0.9 * t / steps) / (1 - 0.9 ** (t + 1))
            first *= F32(0.9)
            first += F32(0.1) * g
            second *= F32(0.99)
            np.multiply(g, g, out=g)
            g *= F32(0.01)
            second += g
            np.sqrt(second, out=g)
            g *= F32((1 - 0.99 ** (t + 1)) ** -0.5)
            g += F32(1e-6)
            np.divide(first, g, out=g)
            g *= F32(step)
            now -= g

    def tables(self) -> None:
        """What the layers give for each id, worked out once; a last column masks padding and sums weights."""
        p, x = self.p, self.p["emb"][self.of.cls] + self.of.near @ self.p["near"]
        mask = np.zeros((len(x), 1), F32)
        ask = [x @ p["q"] * F32(WIDTH**-0.5), mask + 1, x @ p["r"]]
        mask[self.of.pad] = -1e4
        self.asks = np.concatenate(ask, 1)
        self.gives = np.concatenate([x @ p["k"], mask, x @ p["v"], np.ones_like(mask)], 1)
        self.weights = self.heads()
        self.place = p["far"][np.maximum(DISTANCE, 0)] + CAUSAL

    def log_chances(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Natural log probability of each text, its end included."""
        seq, start, goal, of = windows(ids, sizes, self.of.begin, self.of.pad, self.of.end)
        out = np.zeros(len(sizes))
        for at in range(0, len(start), LONG):
            some = slice(at, at + LONG)
            out += np.bincount(of[some], self.windows_log(seq, start[some], goal), len(sizes))
        return out

    def windows_log(self, seq: np.ndarray, start: np.ndarray, goal: np.ndarray) -> np.ndarray:
        """Of the targets of each window, together; they are told for all windows group by group."""
        p, span, hidden = self.p, np.arange(SPAN), np.empty((len(start), TOLD, WIDTH), F32)
        told = start[:, None] + span[BEFORE:]
        targets, last = goal.take(told.reshape(-1)), seq.take(told.reshape(-1))
        for at in range(0, len(start), STEP):
            inputs = seq.take(start[at : at + STEP, None] + span)
            ask, give = self.asks.take(inputs[:, BEFORE:], 0), self.gives.take(inputs, 0)
            s = ask[..., : WIDTH + 1] @ give[..., : WIDTH + 1].transpose(0, 2, 1)
            s += self.place
            if s.max() > 60:  # beyond what sums of exponentials hold
                s -= s.max(-1, keepdims=True)
            np.exp(s, out=s)
            h = s @ give[..., WIDTH + 1 :]
            part = hidden[at : at + STEP]
            np.divide(h[..., :WIDTH], h[..., WIDTH:], out=part)
            part += ask[..., WIDTH + 1 :]
        order, ends = self.of.by_group(targets)
        hidden, targets, last = hidden.reshape(-1, WIDTH).take(order, 0), targets.take(order), last.take(order)
        log = self.of.within.take(targets)
        for some, parts in few_rows(ends):
            g = hidden[some] @ p["w1"]
            g += p["b1"]
            np.maximum(g, 0, out=g)
            y, at = self.told(g, self.weights, parts, last[some], targets[some])
            log[some] += log_shares(y, at)
        return np.bincount(order // TOLD, log, len(start))


def log_shares(y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each row of ``y``, which is used up, the logarithms of the softmax of groups and of slots at the flat places ``at``, together;
    first rows have a place among the slots."""
    told, n = y.reshape(-1).take(at).astype(float), len(y)
    if y.max() > 60:  # beyond what sums of exponentials hold
        for k, part in enumerate(HEADS.T > 0):
            top = y[:, part].max(-1)
            y[:, part] -= top[:, None]
            told[k * n : (k + 1) * n] -= top[: len(told) - k * n]
    np.exp(y, out=y)
    told -= np.log(y @ HEADS).T.reshape(-1)[: len(told)]
    told[: len(told) - n] += told[n:]
    return told[:n]


def shares(y: np.ndarray, parts: np.ndarray, n: int = 1) -> np.ndarray:
    """The softmax of the parts of the rows of ``y``, over ``n``; a column of ``parts`` marks those of one part."""
    e = np.exp(y)
    total = e @ parts
    if len(y) and not 1e-30 < total.min() <= total.max() < 1e30:  # beyond what sums of exponentials hold
        for k, part in enumerate(parts.T > 0):
            e[:, part] = np.exp(y[:, part] - y[:, part].max(-1, keepdims=True))
        total = e @ parts
    total *= F32(n)
    ends = np.cumsum(parts.sum(0, dtype=int))
    for k, end in enumerate(ends):
        e[:, ends[k - 1] if k else 0 : end] /= total[:, k : k + 1]
    return e


def directions(n: int, seed: int = 7) -> np.ndarray:
    """A random direction for each id, begin and end, as a neighbour before and as one behind."""
    return np.random.default_rng(seed).normal(0, 1, (n + 1, 2 * SKETCH)).astype(F32)


def vocabulary(blocks: DataFrame, size: int, texts: int) -> Vocabulary:
    """Counts of ids, sums of their neighbours' directions and what follows them, over all training texts; the driver holds rows for the ids of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums, random = np.zeros(size), np.zeros((size, 2 * SKETCH)), np.ascontiguousarray(directions(size).T, float)
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row, np.array(row["train"], bool))
                if not len(block.ids):
                    continue
                first, last = np.cumsum(block.sizes) - block.sizes, np.cumsum(block.sizes) - 1
                some = block.sizes > 0
                ids = block.ids.astype(np.int64)
                before, behind = np.roll(ids, 1), np.roll(ids, -1)
                before[first[some]] = behind[last[some]] = size
                counts += np.bincount(ids, minlength=size)
                for k in range(2 * SKETCH):
                    sums[:, k] += np.bincount(ids, random[k].take(before if k < SKETCH else behind), size)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(counts[seen]), *[pa.array(sums[seen, k]) for k in range(2 * SKETCH)]], names=["id", "c", *names])

    names = [f"s{k}" for k in range(2 * SKETCH)]
    made = blocks.select("train", "sizes", "codes", "lengths", "pieces").mapInArrow(run, "id int, c double, " + ", ".join(f"{x} double" for x in names))
    found = made.groupBy("id").agg(F.sum("c").alias("c"), *[F.sum(x).alias(x) for x in names]).orderBy("id").toArrow()
    counts, sums, ids = np.zeros(size), np.zeros((size, 2 * SKETCH)), found["id"].to_numpy()
    counts[ids] = found["c"].to_numpy()
    for k, x in enumerate(names):
        sums[ids, k] = found[x].to_numpy()
    words = Vocabulary(counts, sums, texts)
    known = blocks.sparkSession.sparkContext.broadcast(words)
    sizes = ((size + 1) * CLASSES, (CLASSES + 2) * PLACES)

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(n, np.int64) for n in sizes]
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row, np.array(row["train"], bool))
                for total, codes in zip(totals, known.value.pairs(block.ids, block.sizes)):
                    total += np.bincount(codes, minlength=len(total))
        for kind, total in enumerate(totals):
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), kind, np.int32)), pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["kind", "code", "c"])

    made = blocks.select("train", "sizes", "codes", "lengths", "pieces").mapInArrow(follow, "kind int, code int, c long")
    found = made.groupBy("kind", "code").agg(F.sum("c").alias("c")).toArrow()  # bounded by the vocabulary, 48 rows an id at most
    totals = [np.zeros(n) for n in sizes]
    kinds, codes, c = (found[x].to_numpy() for x in ("kind", "code", "c"))
    for kind, total in enumerate(totals):
        total[codes[kinds == kind]] = c[kinds == kind]
    words.follow(*totals)
    return words


def fitted(blocks: DataFrame, words: Vocabulary, *, rounds: int, share: int, batch: int, rate: float) -> tuple[dict[str, np.ndarray], int]:
    """Parameters, and the number of windows learned from, after ``rounds`` passes over all training windows.  A pass deals them
    to ``share`` parts; after each part the tasks' parameters are averaged by their windows' number."""
    spark = blocks.sparkSession
    known = spark.sparkContext.broadcast(words)
    p, learned = first_parameters(), 0
    for n in range(rounds * share):
        start = flat(p)

        def run(batches: Iterator[pa.RecordBatch], n: int = n, start: np.ndarray = start) -> Iterator[pa.RecordBatch]:
            of, weight = known.value, 0
            network = Network(shaped(start), of)
            for rows in batches:
                for row in rows.to_pylist():
                    block = Block(row, np.array(row["train"], bool))
                    if not len(block.sizes):
                        continue
                    seq, at, goal, _ = windows(block.ids, block.sizes, of.begin, of.pad, of.end)
                    pick = np.random.default_rng([row["block"], 5]).permutation(len(at))
                    pick = pick[n % share * len(at) // share : (n % share + 1) * len(at) // share]
                    if len(pick):
                        network.fit(seq, goal, at[pick], batch=batch, rate=rate / (n + 1))
                        weight += len(pick)
            if weight:
                yield pa.RecordBatch.from_arrays([pa.array([float(weight)]), pa.array([(weight * flat(network.p).astype(float)).tobytes()], pa.binary())], names=["weight", "p"])

        made = blocks.select("block", "train", "sizes", "codes", "lengths", "pieces").mapInArrow(run, "weight double, p binary")
        found = made.repartition(WAYS).mapInArrow(summed, "weight double, p binary").collect()  # a row for each way at most
        if found:
            weight = sum(r["weight"] for r in found)
            p, learned = shaped(sum(np.frombuffer(r["p"]) for r in found) / weight), learned + int(weight)
    return p, learned


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    weight, total = 0.0, None
    for batch in batches:
        for w, p in zip(*(c.to_pylist() for c in batch.columns)):
            weight, total = weight + w, np.frombuffer(p) + (0 if total is None else total)
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([weight]), pa.array([total.tobytes()], pa.binary())], names=["weight", "p"])


def lm_scores(
    docs: DataFrame,
    is_training: Column,
    *,
    tokenizer: str = "word_bpe_49k.json",
    rounds: int = 1,
    share: int = 2,
    batch: int = 256,
    rate: float = 0.03,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs``.

    Tokens are white-space separated words, A-Z lower-cased, and one end.
    ``base_score`` sums log10((c + 1) / (N + V + 1)) over them, with a token's
    count c, all N and V distinct tokens of the training rows; ``n_known`` counts
    tokens with c > 0.  ``score`` is the model's log10 probability of the ids of
    the words, in order, and the end.

    Rows where ``is_training`` is true train the model; counts and classes cover
    all of them, the network's fit every window ``rounds`` times.  Null texts count as empty, of which the end is told.  Rows that
    repeat an id are scored each; null ids are returned as they are.  Without
    training rows all counts are 0 and the network is as it begins.  Other
    columns are ignored; an empty table gives an empty result.
    """
    key = F.col(f"`{id_col}`")
    blocks = blocks_of(docs.select(key.alias("id"), or_empty(f"`{text_col}`").alias("text"), F.coalesce(is_training, F.lit(False)).alias("train")), tokenizer)
    spark = docs.sparkSession
    pairs = blocks.select(F.explode(F.arrays_zip("words", "counts")).alias("x"))
    counts = materialise(pairs.select(F.col("x.words").alias("word"), F.col("x.counts").alias("c")).where("c > 0").groupBy("word").agg(F.sum("c").alias("c")), "lm-words")
    texts = blocks.agg(F.sum(F.size(F.filter("train", lambda x: x)))).first()[0] or 0
    total, distinct = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    total, distinct = (total or 0) + texts, distinct + (texts > 0)

    words = vocabulary(blocks, word_ids(tokenizer).tokenizer.get_vocab_size(), texts)
    shared = spark.sparkContext.broadcast((words, fitted(blocks, words, rounds=rounds, share=share, batch=batch, rate=rate)[0]))

    asked = blocks.select("block", F.posexplode("words").alias("place", "asked"))
    told = asked.join(counts, F.col("asked") == F.col("word")).groupBy("block").agg(F.collect_list("place").alias("places"), F.collect_list("c").alias("found"))
    names = ["ids", "train", "sizes", "codes", "lengths", "pieces"]
    met = blocks.select("block", *names).join(told, "block", "left").select(*names, "places", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = None
        for batch in batches:
            if network is None:
                of, p = shared.value
                network = Network(p, of)
                network.tables()
            for n in range(len(batch)):
                row = {c: batch.column(c)[n].as_py() for c in names[1:]}
                block = Block(row)
                c = np.zeros(int(block.code.max(initial=-1)) + 1)
                if batch.column("places")[n].is_valid:
                    places, found = (batch.column(x)[n].values.to_numpy(zero_copy_only=False) for x in ("places", "found"))
                    c[places] = found
                cost, of_text = np.log10((c + 1) / (total + distinct + 1)), np.repeat(np.arange(len(block.words)), block.words)
                base = np.bincount(of_text, cost[block.code], len(block.words)) + np.log10((texts + 1) / (total + distinct + 1))
                seen = np.bincount(of_text, c[block.code] > 0, len(block.words)).astype(np.int64) + (texts > 0)
                score = network.log_chances(block.ids, block.sizes) / np.log(10)
                columns = [batch.column("ids")[n].values, pa.array(block.words + 1), pa.array(seen), pa.array(np.full(len(seen), total, np.int64)), pa.array(base), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    id_type = docs.schema[id_col].dataType.simpleString()
    out = met.mapInArrow(run, f"id {id_type}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(crc32_of_id("doc_id"), F.lit(7)) == 2
    scored = lm_scores(documents(spark, sf_dir).select("doc_id", "text"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
