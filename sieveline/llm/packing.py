"""Best-fit packing of token sequences by the sum-of-squares rule.

A piece is placed where the sum, over residual gaps, of the squared number of
open bins with that gap becomes smallest.  Pieces are dealt to shards of equal
size that pack on their own; what lies in bins left too empty is dealt again to
fewer shards, until one shard holds the rest.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.shared import documents, emptied_after, materialise, small_batches

PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long"


class WordIds(dict):
    """White-space separated chunk -> its ids as little-endian bytes.

    The tokenizer drops white space and never merges across it, so a text's ids
    are those of its chunks in order.  A chunk that isn't known is split by the
    tokenizer's own pattern and merged by an equal byte-pair table; chunks with
    characters outside the plain Latin range go to the tokenizer itself.
    ``limit`` bounds the memory; the table starts anew when it is full.
    """

    def __init__(self, path: str, limit: int = 100_000):
        import json
        import re

        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        with open(path) as f:
            vocab = json.load(f)["model"]["vocab"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in printable]
        of_char = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(hidden)}
        # A word's end is written as a space, which no chunk holds.
        ranks = {bytes(of_char[c] for c in t.removesuffix("</w>")) + b" " * t.endswith("</w>"): i for t, i in vocab.items()}
        self.pairs = tiktoken.Encoding("word", pat_str=r"[^ ]+ ", mergeable_ranks=ranks, special_tokens={})
        self.merge = self.pairs._core_bpe.encode_single_piece
        self.ends_word = np.zeros(max(ranks.values()) + 1, bool)
        self.ends_word[[i for t, i in ranks.items() if t.endswith(b" ")]] = True
        letters = "a-zªµºß-öø-ÿ"
        self.parts = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[0-9²³¹¼½¾]|[^\s0-9²³¹¼½¾{letters}]+").findall
        # Latin-1 without the odd control characters: lower case and pattern are certain there.
        self.plain = re.compile(r"[!-~¡-¬®-ÿ]+").fullmatch
        self.split = re.compile(r"[ \t\n\r\x0b\x0c]+").split
        self.words: dict[str, bytes] = {}

    def part(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            if len(self.words) >= self.limit:
                self.words.clear()
            self.words[word] = found = array("I", self.merge(word.encode() + b" ")).tobytes()
        return found

    def __missing__(self, chunk: str) -> bytes:
        word, tail = (chunk, "") if chunk.isalpha() else (chunk[:-1], chunk[-1:])
        if word.isalpha() and tail in ("", ",", ".") and (word.isascii() or self.plain(word)):
            out = self.part(word.lower()) + (self.part(tail) if tail else b"")
        elif self.plain(chunk):
            out = b"".join(map(self.part, self.parts(chunk.lower())))
        else:
            out = array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        if len(self) >= self.limit:
            self.clear()
        self[chunk] = out
        return out

    def each(self, chunks: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks end to end and how many each has; for chunks that don't repeat.
        Words of lower-case Latin letters, which may end in a comma or a stop, are merged by one call and aren't kept."""
        chunks = chunks if isinstance(chunks, pa.Array) else pa.array(chunks, pa.string())
        easy = pc.match_substring_regex(chunks, "^[a-zß-öø-ÿ]+[,.]?$")
        words = chunks.filter(easy)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py()
        # A word's end is the last of its ids and of no other's; a comma or a stop is a word of its own.
        ids = self.pairs.encode_to_numpy(joined.replace(",", " ,").replace(".", " .") + " " * bool(joined), disallowed_special=())
        parts = 1 + pc.match_substring_regex(words, "[,.]$").to_numpy(zero_copy_only=False)
        until = np.append(0, np.flatnonzero(self.ends_word[ids]) + 1)[np.cumsum(parts)]
        easy, sizes = easy.to_numpy(zero_copy_only=False), np.empty(len(chunks), np.int32)
        sizes[easy] = np.diff(until, prepend=0)
        found = [self[c] for c in chunks.filter(pa.array(~easy)).to_pylist()]
        sizes[~easy] = [len(x) // 4 for x in found]
        of_easy, out = np.repeat(easy, sizes), np.empty(sizes.sum(), np.uint32)
        out[of_easy], out[~of_easy] = ids, np.frombuffer(b"".join(found), np.uint32)
        return out, sizes

    def of(self, text: str) -> bytes:
        if "<|" in text:  # special tokens in a text are found before anything else
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        # str.split() also splits at other white space, which the tokenizer drops alike
        chunks = text.split() if text.isascii() and "\x1c" not in text and "\x1d" not in text and "\x1e" not in text and "\x1f" not in text else self.split(text)
        return b"".join(map(self.__getitem__, chunks))


_WORDS: dict[str, WordIds] = {}


def forget_ids() -> None:
    """Drop what was looked up; the tokenizers themselves stay."""
    for table in _WORDS.values():
        table.clear()
        table.words.clear()


def word_ids(tokenizer: str) -> WordIds:
    """The table for a tokenizer file or a name in ``public_tokenizers``, once a worker."""
    if tokenizer not in _WORDS:
        path = tokenizer
        if "/" not in tokenizer:
            import public_tokenizers

            path = public_tokenizers.path(tokenizer)
        _WORDS[tokenizer] = WordIds(path)
    return _WORDS[tokenizer]


def tokenised_pieces(
    docs: DataFrame,
    *,
    tokenizer: str,
    capacity: int = 2048,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """A row for each piece of each document: doc_id, piece, start, length, ids_crc32.

    A document is its text's ids and then ``end_id``.  Only documents longer
    than ``capacity`` are cut.  Null texts count as empty, so every document has
    a piece; rows that repeat an id have pieces of their own.
    """
    ids_type = docs.schema[id_col].dataType
    schema = PIECES.format(id=ids_type.simpleString())

    small_batches(docs.sparkSession)

    @emptied_after(forget_ids)
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, last = word_ids(tokenizer), array("I", [end_id]).tobytes()
        for batch in batches:
            ids, piece, start, length, crc = [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = table.of(text.as_py() or "") + last
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    ids.append(doc)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.schema.field(0).type), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`")).mapInArrow(cut, schema)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pack lengths in the given order: (bin, offset) of each, and each bin's level.

    ``open_at[h]`` counts open bins filled to level h.  Moving a bin from h to
    h + s changes the sum of squares by 2 * (open_at[h + s] - open_at[h]) + 2, a
    new bin by 2 * open_at[s] + 1, closing one by 1 - 2 * open_at[h].  Ties go to
    the fullest bin, and to an open bin before a new one.
    """
    open_at = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset, level = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    for k, size in enumerate(lengths.tolist()):
        best, at = 2 * open_at[size] + 1 if size < capacity else -1, 0
        if size < capacity:
            change = 2 * (open_at[size:] - open_at[: capacity + 1 - size]) + 2
            change[-1] = 1 - 2 * open_at[capacity - size]
            change[open_at[: capacity + 1 - size] == 0] = np.iinfo(np.int64).max
            change[0] = np.iinfo(np.int64).max
            h = len(change) - 1 - int(change[::-1].argmin())
            if change[h] <= best:
                best, at = change[h], h
        if at:
            number = stacks[at].pop()
            open_at[at] -= 1
        else:
            number = len(level)
            level.append(0)
        where[k], offset[k] = number, at
        level[number] = at + size
        if at + size < capacity:
            open_at[at + size] += 1
            stacks[at + size].append(number)
    return where, offset, np.array(level, np.int64)


def pack(pieces: DataFrame, *, capacity: int = 2048, shard_rows: int = 4096) -> DataFrame:
    """All rows of ``pieces`` with ``sequence_id`` and ``offset``.

    Every ``length`` must be from 1 to ``capacity``.  In a sequence the offsets
    are gapless from 0.  A round deals the rows evenly to shards of about
    ``shard_rows``, whatever their keys.  Bins that aren't full are opened again
    for the next round, which has fewer shards; one shard closes all.  Where
    half of the rows or more come back, few of them fill bins: from then on each
    such round accepts twice as many free tokens in a closed bin, so that rounds
    end without closing half-empty bins while others could be filled.  Rows are
    carried as they are, so repeated rows are packed each; an empty table gives
    an empty result.
    """
    schema = pieces.schema
    out_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", sequence_id long, offset long, __closed boolean"

    def shard(round_no: int, last: bool, slack: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [b for b in batches if len(b)]
            if not held:
                return
            rows = pa.Table.from_batches(held)
            lengths = rows.column("length").to_numpy()
            # Long pieces first: the short ones then fill the gaps; within a length the order is fixed.
            order = np.argsort(-lengths, kind="stable")
            where, offset, level = sum_of_squares(lengths[order], capacity)
            number = (round_no << 56) + (TaskContext.get().partitionId() << 24)
            closed = np.full(len(where), last) | (level[where] >= capacity - slack)
            rows = rows.take(pa.array(order)).append_column("sequence_id", pa.array(number + where)).append_column("offset", pa.array(offset)).append_column("__closed", pa.array(closed))
            yield from rows.combine_chunks().to_batches()

        return run

    done, rest, before, slack, round_no = [], pieces, None, 0, 0
    while True:
        count = rest.count()
        shards = max(1, -(-count // shard_rows))
        if before is not None and 2 * count >= before:
            slack = max(1, 2 * slack)
        last = shards == 1
        placed = rest.repartition(shards).mapInArrow(shard(round_no, last, slack), out_schema)
        if last:
            done.append(placed)
            break
        placed = materialise(placed, "packed")
        done.append(placed.where("__closed"))
        rest, before, round_no = placed.where("NOT __closed").select(*[f"`{c}`" for c in pieces.columns]), count, round_no + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("__closed")


def pack_documents(docs: DataFrame, *, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, cut and pack ``docs``; see ``tokenised_pieces`` and ``pack``."""
    pieces = tokenised_pieces(docs, tokenizer=tokenizer, capacity=capacity, end_id=end_id, id_col=id_col, text_col=text_col)
    return pack(materialise(pieces, "pieces"), capacity=capacity)


def op3_packing(spark: SparkSession, sf_dir: str, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    return pack_documents(documents(spark, sf_dir), tokenizer=tokenizer).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
