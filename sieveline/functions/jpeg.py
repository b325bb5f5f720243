"""Baseline JPEG, written from arrays: full colour resolution, Huffman codes fitted to the picture."""

from __future__ import annotations

import heapq
import struct

import numpy as np

# The example quantisation tables of the standard, in rows of eight.
LUMINANCE = (
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
)
CHROMINANCE = (
    17, 18, 24, 47, 99, 99, 99, 99,
    18, 21, 26, 66, 99, 99, 99, 99,
    24, 26, 56, 99, 99, 99, 99, 99,
    47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
)

#: Places of a block from low to high frequencies: diagonals, every other one upwards.
ZIGZAG = np.array([8 * i + j for i, j in sorted(np.ndindex(8, 8), key=lambda p: (sum(p), p[0] if sum(p) % 2 else -p[0]))])
_K = np.arange(8)
COSINES = np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16) * np.where(_K == 0, np.sqrt(1 / 8), 0.5)[:, None]
#: Rows give lightness and the two colour differences of a pixel in BGR order.
PLANES = np.array([[0.114, 0.587, 0.299], [0.5, -0.331264, -0.168736], [-0.081312, -0.418688, 0.5]])


def quantisers(quality: int) -> np.ndarray:
    """(2, 64): the tables scaled to a quality from 1 to 100."""
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array([LUMINANCE, CHROMINANCE]) * scale + 50) // 100, 1, 255)


def prefix_code(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int], list[int]]:
    """(codes, lengths, codes of each length, symbols) of an optimal prefix code of at most 16 bits.

    A symbol of no weight takes the code of all ones, which the format forbids.
    """
    counts = np.append(np.asarray(counts, np.int64), 0)
    used = np.append(np.flatnonzero(counts), 256)
    while True:
        heap = [(int(counts[s]), int(s), (int(s),)) for s in used]
        heapq.heapify(heap)
        depth = dict.fromkeys(map(int, used), 0)
        while len(heap) > 1:
            (a, x, left), (b, y, right) = heapq.heappop(heap), heapq.heappop(heap)
            for s in left + right:
                depth[s] += 1
            heapq.heappush(heap, (a + b, max(x, y), left + right))
        if max(depth.values()) <= 16:
            break
        counts = (counts + 1) // 2
        counts[256] = 0
    order = sorted(depth, key=lambda s: (depth[s], s))
    codes, lengths, code, last = np.zeros(256, np.int64), np.zeros(256, np.int64), 0, 0
    for s in order:
        code, last = code << (depth[s] - last), depth[s]
        if s < 256:
            codes[s], lengths[s] = code, last
        code += 1
    symbols = [s for s in order if s < 256]
    return codes, lengths, [sum(depth[s] == k for s in symbols) for k in range(1, 17)], symbols


def _sizes(values: np.ndarray) -> np.ndarray:
    """Bits of the absolute values."""
    return np.ceil(np.log2(np.abs(values) + 1)).astype(np.int64)


def _extra(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.where(values < 0, values + (1 << sizes) - 1, values)


def _packed(values: np.ndarray, lengths: np.ndarray) -> bytes:
    """The lowest ``lengths`` bits of each value, one after the other, ended by ones."""
    parts = []
    for a in range(0, len(values), 1 << 16):
        v, n = values[a : a + (1 << 16)], lengths[a : a + (1 << 16)]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        parts.append(((np.repeat(v, n) >> (np.repeat(n, n) - 1 - place)) & 1).astype(np.uint8))
    bits = np.concatenate(parts)
    bits = np.append(bits, np.ones(-len(bits) % 8, np.uint8))
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\0")


def _segment(mark: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body


def encode(image: np.ndarray, quality: int = 95) -> bytes:
    """The JPEG file of a (height, width) gray or (height, width, 3) BGR array of bytes."""
    image = np.atleast_3d(np.asarray(image, np.uint8))
    height, width, channels = image.shape
    if channels not in (1, 3) or not 0 < height < 65536 or not 0 < width < 65536:
        raise ValueError(f"no JPEG of shape {image.shape}")
    padded = np.pad(image, ((0, -height % 8), (0, -width % 8), (0, 0)), "edge").astype(np.float64)
    planes = padded @ PLANES.T if channels == 3 else padded
    planes[..., 0] -= 128
    tables = quantisers(quality)
    rows, columns = padded.shape[0] // 8, padded.shape[1] // 8
    blocks = planes.reshape(rows, 8, columns, 8, channels).transpose(0, 2, 4, 1, 3).reshape(-1, channels, 8, 8)
    kind = np.minimum(np.arange(channels), 1)
    units = np.rint((COSINES @ blocks @ COSINES.T).reshape(-1, channels, 64) / tables[kind]).astype(np.int64)[..., ZIGZAG]
    steps = np.diff(units[..., 0], axis=0, prepend=0).ravel()
    units, kinds = units.reshape(-1, 64), np.tile(kind, len(units))
    # Symbols in order: a unit's step, its values with runs of zeros before them, its end.
    u, k = np.nonzero(units[:, 1:])
    value, k = units[u, k + 1], k + 1
    before = np.where(np.append(True, u[1:] != u[:-1]), 0, np.append(0, k[:-1])) if len(u) else k
    run, size = k - before - 1, _sizes(value)
    long = np.repeat(np.arange(len(u)), run // 16)  # sixteen zeros each
    last = np.zeros(len(units), np.int64)
    np.maximum.at(last, u, k)
    open_ = np.flatnonzero(last < 63)
    here, step_size = np.arange(len(units)), _sizes(steps)
    none = lambda a: np.zeros(len(a), np.int64)
    at = np.concatenate([260 * here, 260 * u[long] + 4 * k[long], 260 * u + 4 * k + 3, 260 * open_ + 256])
    table = np.concatenate([2 * kinds, 2 * kinds[u[long]] + 1, 2 * kinds[u] + 1, 2 * kinds[open_] + 1])
    symbol = np.concatenate([step_size, np.full(len(long), 0xF0), 16 * (run % 16) + size, none(open_)])
    extra = np.concatenate([_extra(steps, step_size), none(long), _extra(value, size), none(open_)])
    width_of = np.concatenate([step_size, none(long), size, none(open_)])
    order = np.argsort(at, kind="stable")
    table, symbol, extra, width_of = table[order], symbol[order], extra[order], width_of[order]
    out, code, length = [], none(table), none(table)
    for t in range(2 * int(kind[-1]) + 2):
        mine = table == t
        codes, lengths, number, symbols = prefix_code(np.bincount(symbol[mine], minlength=256))
        code[mine], length[mine] = codes[symbol[mine]], lengths[symbol[mine]]
        out.append(_segment(0xC4, bytes([16 * (t % 2) + t // 2, *number, *symbols])))
    quantised = b"".join(_segment(0xDB, bytes([t, *map(int, tables[t][ZIGZAG])])) for t in range(int(kind[-1]) + 1))
    frame = struct.pack(">BHHB", 8, height, width, channels) + b"".join(bytes([c + 1, 0x11, int(kind[c])]) for c in range(channels))
    scan = bytes([channels]) + b"".join(bytes([c + 1, 17 * int(kind[c])]) for c in range(channels)) + bytes([0, 63, 0])
    head = b"\xff\xd8" + _segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0") + quantised + _segment(0xC0, frame)
    return head + b"".join(out) + _segment(0xDA, scan) + _packed((code << width_of) | extra, length + width_of) + b"\xff\xd9"
