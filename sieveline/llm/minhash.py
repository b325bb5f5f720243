"""MinHash near-deduplication by a chosen-path set similarity join.

Every document becomes its set of word shingles.  A tree sends a document down
the branches of selected minwise tokens: documents stay together in a node only
if they agree on every token chosen on its path.  Nodes that are small enough
are compared exhaustively on signatures; larger ones branch again.  Independent
trees bring the recall to its target.  What looks similar is then confirmed on
full sets, and the links' components are the classes.

Copies never become pairs.  Equal sets are one node of the search; documents
that resemble a large node's leader leave its exhaustive part; and a part of a
class is compared with all documents of the class that aren't linked yet, not
with those that are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.shared import documents, emptied_after, in_buckets, small_batches, with_columns
from sieveline.operators.graph import components
from sieveline.sources.scratch import materialise, rekeyed

U64 = np.uint64
COORDINATES = 128


class _WordHash(dict):
    """Word -> 64-bit hash; starts anew when it holds ``limit`` words."""

    def __init__(self, limit: int = 150_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_WORDS = _WordHash()


def forget_words() -> None:
    _WORDS.clear()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U64(29))) * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(32))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles.

    A text with fewer words has its whole sequence as one shingle; one without
    words has none.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z, only ASCII white space
    if not found:
        return np.empty(0, U64)
    h = np.fromiter(map(_WORDS.__getitem__, found), U64, len(found))
    if len(h) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), seed=1)], U64)
    n = len(h) - words + 1
    s = np.zeros(n, U64)
    for k in range(words):
        s = s * U64(0x9E3779B97F4A7C15) + h[k : k + n]
    return np.unique(_mixed(s))


_RNG = np.random.default_rng(20_240_607)
_A = _RNG.integers(0, 1 << 63, COORDINATES, dtype=U64) * U64(2) + U64(1)
_B = _RNG.integers(0, 1 << 63, COORDINATES, dtype=U64)


def minwise(shingles: np.ndarray) -> np.ndarray:
    """The least of each of the ``COORDINATES`` hashes of a set's members."""
    out = np.full(COORDINATES, np.iinfo(U64).max, U64)
    for at in range(0, len(shingles), 512):
        np.minimum(out, (shingles[None, at : at + 512] * _A[:, None] + _B[:, None]).min(axis=1), out=out)
    return out


def signatures(docs: DataFrame, *, words: int, trees: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, a hash of the text, n_shingles, set digest (d1, d2), the trees' first tokens and a byte for each coordinate."""
    id_type = docs.schema[id_col].dataType.simpleString()

    small_batches(docs.sparkSession)

    @emptied_after(forget_words)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = _mixed(np.arange(1, trees + 1, dtype=U64))
        for batch in batches:
            n, d1, d2, roots, sig = [], [], [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), words)
                n.append(len(s))
                digest = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                d1.append(digest[0])
                d2.append(digest[1])
                low = minwise(s) if len(s) else np.zeros(COORDINATES, U64)
                roots.append(_mixed(low[:trees] ^ salt).view(np.int64) if len(s) else np.empty(0, np.int64))
                sig.append((_mixed(low) >> U64(56)).astype(np.uint8).tobytes())
            found = [*(pa.array(c, pa.int64()) for c in (n, d1, d2)), pa.array(roots, pa.list_(pa.int64())), pa.array(sig, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *found], names=names)

    text = F.col(f"`{text_col}`")
    picked = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    names = ["doc_id", "text_hash", "n_shingles", "d1", "d2", "roots", "sig"]
    return picked.mapInArrow(run, f"doc_id {id_type}, text_hash long, n_shingles long, d1 long, d2 long, roots array<long>, sig binary")


def _by_group(rows: DataFrame, key: list[str], work: Callable[[pa.Table, np.ndarray], list], schema: str, names: list[str]) -> DataFrame:
    """Bring the rows of each group into one task and hand ``work`` a table of
    whole groups and where they begin.  Groups must be small; a task holds one
    batch of them at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def groups(table: pa.Table) -> np.ndarray:
            cols = [table.column(k).to_numpy() for k in key]
            change = np.zeros(len(table), bool)
            change[:1] = True
            for c in cols:
                change[1:] |= c[1:] != c[:-1]
            return np.flatnonzero(change)

        def give(table: pa.Table, begin: np.ndarray) -> Iterator[pa.RecordBatch]:
            columns = work(table, np.append(begin, len(table)))
            if len(columns[0]):
                yield pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            begin = groups(held)
            if len(begin) > 1:  # all but the last group are whole
                yield from give(held.slice(0, begin[-1]), begin[:-1])
                held = held.slice(begin[-1])
        if held is not None and len(held):
            yield from give(held, groups(held))

    return rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(emptied_after(forget_words)(run), schema)


def _roots_of(adjacent: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix the smallest index of its component."""
    root = np.full(len(adjacent), -1)
    for k in range(len(adjacent)):
        if root[k] < 0:
            todo = adjacent[k].copy()
            todo[k] = True
            seen = todo.copy()
            while todo.any():
                more = adjacent[todo].any(axis=0) & ~seen
                seen |= more
                todo = more
            root[seen] = k
    return root


EDGES = "a long, b long"


def _alike(least: int):
    """Work for small nodes: edges to the first document of each group of documents whose signatures agree."""

    def work(table: pa.Table, begin: np.ndarray) -> list:
        rep = table.column("rep").to_numpy()
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(-1, COORDINATES)
        free = table.column("free").to_numpy() if "free" in table.column_names else None
        size = np.diff(begin)
        two = begin[:-1][size == 2]
        good = two[(sig[two] == sig[two + 1]).sum(axis=1) >= least]
        a, b = [rep[good + 1]], [rep[good]]
        for at, n in zip(begin[:-1][size > 2], size[size > 2]):
            own = sig[at : at + n]
            near = np.zeros((n, n), bool)
            for k in range(n):
                if free is None or free[at + k]:
                    near[k] = (own == own[k]).sum(axis=1) >= least
            root = _roots_of(near | near.T)
            a.append(rep[at : at + n][root != np.arange(n)])
            b.append(rep[at + root[root != np.arange(n)]])
        a, b = np.concatenate(a), np.concatenate(b)
        keep = a != b
        return [pa.array(a[keep]), pa.array(b[keep])]

    return work


def _led(rows: DataFrame, reps: DataFrame, least: int) -> DataFrame:
    """Mark the rows of large nodes that don't resemble the node's leader as free."""
    leaders = reps.select(rekeyed(F.col("rep")).alias("of_lead"), F.col("sig").alias("lead_sig"))
    both = rows.join(leaders, F.col("lead") == F.col("of_lead"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            sig, led = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, COORDINATES)
                for c in ("sig", "lead_sig")
            )
            free = (sig == led).sum(axis=1) < least
            kept = [batch.column(c) for c in ("node", "rep", "sig", "cnt", "lead")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(free)], names=["node", "rep", "sig", "cnt", "lead", "free"])

    slim = both.select("node", "rep", "sig", "cnt", "lead", "lead_sig")
    return slim.mapInArrow(run, "node long, rep long, sig binary, cnt long, lead long, free boolean")


def _counted(rows: DataFrame) -> DataFrame:
    """Rows of nodes with at least two members, with the node's count and its
    leader, the member of the least hash.  One join attaches both."""
    stat = rows.groupBy("node").agg(F.count(F.lit(1)).alias("cnt"), F.min_by("rep", F.xxhash64("node", "rep")).alias("lead"))
    stat = stat.where("cnt > 1").select(rekeyed(F.col("node")).alias("of"), "cnt", "lead")
    return rows.join(stat, F.col("node") == F.col("of")).drop("of")


def candidate_edges(reps: DataFrame, *, least: int, leaf: int, branches: int, depth: int) -> list[DataFrame]:
    """Edges between documents that look alike, from all trees at once."""
    skinny = reps.select("rep", F.explode("roots").alias("node"))
    sigs = reps.select(F.col("rep").alias("r"), "sig")
    rows = _counted(skinny).join(sigs, F.col("rep") == F.col("r")).select("node", "rep", "sig", "cnt", "lead")
    edges, small = [], []
    for level in range(depth + 1):
        rows = materialise(rows, f"nodes-{level}")
        small.append(rows.where(F.col("cnt") <= leaf).select("node", "rep", "sig", F.lit(True).alias("free")))
        large = rows.where(F.col("cnt") > leaf)
        if large.isEmpty():
            break
        led = materialise(_led(large, reps, least), "led")
        alike = led.where(~F.col("free") & (F.col("rep") != F.col("lead")))
        edges.append(alike.select(F.col("rep").alias("a"), F.col("lead").alias("b")))
        alone = led.groupBy("node").agg(F.count_if("free").alias("alone")).where("alone > 0")
        alone = alone.select(rekeyed(F.col("node")).alias("of"), "alone")
        open_ = materialise(led.join(alone, F.col("node") == F.col("of")).drop("of", "lead"), "open")
        ends = F.lit(True) if level == depth else F.col("alone") <= leaf
        # Blocks of the node; each meets all members that don't resemble the leader, in blocks too.
        blocks = F.ceil(F.col("cnt") / leaf).cast("int")
        others = F.ceil(F.col("alone") / leaf).cast("int")
        of = lambda n, seed: F.pmod(F.xxhash64("rep", F.lit(seed)), n).cast("int")
        spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        last = open_.where(ends)
        members = last.select("node", "rep", "sig", F.lit(False).alias("free"), of(blocks, 1).alias("x"), spread(others).alias("y"))
        singles = last.where("free").select("node", "rep", "sig", "free", of(others, 2).alias("y"), spread(blocks).alias("x"))
        small.append(members.unionByName(singles).select(F.xxhash64("node", "x", "y").alias("node"), "rep", "sig", "free"))
        if level == depth:
            break
        at = F.pmod(F.xxhash64("node", "branch"), F.lit(COORDINATES)).cast("int")
        child = open_.where(~ends).select("node", "rep", "sig", F.explode(F.sequence(F.lit(1), F.lit(branches))).alias("branch"))
        child = child.select(F.xxhash64("node", "branch", F.substring(F.col("sig"), at + 1, 1)).alias("node"), "rep", "sig")
        rows = _counted(child)
    # Nodes of all levels are compared in one go: their hashes differ.
    every = small[0]
    for part in small[1:]:
        every = every.unionByName(part)
    edges.append(_by_group(every, ["node"], _alike(least), EDGES, ["a", "b"]))
    return edges


def _linked(words: int, percent: int):
    """Work for parts of a class: edges to the first document of each group that full sets link."""

    def links(texts: list[str]) -> np.ndarray:
        sets = [shingle_set(t, words) for t in texts]
        size = np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), size)
        value, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = times[inverse] > 1
        number = np.cumsum(times > 1) - 1
        row, owner = number[inverse[shared]], owner[shared]
        both = np.zeros((len(sets), len(sets)), np.int64)
        order = np.argsort(row, kind="stable")
        row, owner = row[order], owner[order]
        step = max(1, 4_000_000 // len(sets))
        for at in range(0, int(row[-1]) + 1 if len(row) else 0, step):
            lo, hi = np.searchsorted(row, (at, at + step))
            x = np.zeros((step, len(sets)), np.float32)
            x[row[lo:hi] - at, owner[lo:hi]] = 1
            both += (x.T @ x).astype(np.int64)
        union = size[:, None] + size[None, :] - both
        return (100 * both >= percent * union) & (both > 0)

    def work(table: pa.Table, begin: np.ndarray) -> list:
        rep, text = table.column("rep").to_numpy(), table.column("text")
        a, b = [], []
        for at, to in zip(begin[:-1], begin[1:]):
            if to - at > 1:
                root = _roots_of(links(text.slice(at, to - at).to_pylist()))
                moved = root != np.arange(to - at)
                a.append(rep[at:to][moved])
                b.append(rep[at + root[moved]])
        none = np.empty(0, np.int64)
        a, b = np.concatenate([none, *a]), np.concatenate([none, *b])
        keep = a != b
        return [pa.array(a[keep]), pa.array(b[keep])]

    return work


def _confirmed(docs: DataFrame, parts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links on full sets within each (comp, part) of ``parts`` (rep, comp, part).

    The texts of candidates are found by hash buckets of their ids, a broadcast
    of bounded size, and then joined by id.
    """
    texts = in_buckets(docs, "doc_id", parts, "rep")
    rows = parts.join(texts, parts.rep == texts.doc_id).select("comp", "part", "rep", "text")
    return _by_group(rows, ["comp", "part"], _linked(words, percent), EDGES, ["a", "b"])


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, root) after further links; only links between different roots are followed."""

    def rooted(rows: DataFrame, end: str) -> DataFrame:
        known = labels.select(rekeyed(F.col("node")).alias("of"), F.col("root").alias("r"))
        joined = rows.join(known, F.col(end) == F.col("of"), "left")
        return joined.withColumn(end, F.coalesce("r", end)).drop("of", "r")

    across = materialise(rooted(rooted(links.select("a", "b"), "a"), "b").where("a <> b").distinct(), "across")
    if across.isEmpty():
        return labels
    joined = materialise(components(across), "merged").select(rekeyed(F.col("node")).alias("of"), F.col("root").alias("to"))
    old = labels.join(joined, labels.root == F.col("of"), "left").select("node", F.coalesce("to", "root").alias("root"))
    known = labels.select(rekeyed(F.col("node")).alias("node"))
    new = joined.join(known, F.col("of") == F.col("node"), "left_anti").select(F.col("of").alias("node"), F.col("to").alias("root"))
    return materialise(old.unionByName(new), "labels")


def near_duplicates(
    docs: DataFrame,
    *,
    words: int = 5,
    percent: int = 80,
    trees: int = 10,
    leaf: int = 1000,
    branches: int = 2,
    depth: int = 12,
    part_rows: int = 96,
    leaders: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """All rows of ``docs`` with ``n_shingles``, ``component_id`` and ``kept``.

    Two documents are linked if their shingle sets' intersection is at least
    ``percent`` per cent of their union; ``component_id`` is the smallest id
    reachable over links and ``kept`` marks the rows with that id.

    A pair at the threshold misses a tree with probability 0.2 at its root and
    0.04 at each further level, which only nodes of more than ``leaf`` documents
    have: it misses all ten trees with a probability of one in ten million, or of
    two in a million two levels down.  A token that many documents share is
    branched ``branches`` ways at a level, so where it is a third of their tokens
    the rows of large nodes fall by a third each level.  Signatures only propose: a pair is proposed from 4.5 standard
    deviations below the threshold, and full sets decide.

    Null texts and texts without words have no shingles and link with nothing.
    Rows with a null id aren't searched and keep a null ``component_id``; their
    shingles are counted.  Rows that repeat an id are documents of their own:
    each has the component of its text.  An empty table gives an empty result;
    columns named like a result are replaced.  Ids must be integers.  What other
    columns ``docs`` has makes no difference.
    """
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    sigs = materialise(signatures(own, words=words, trees=trees, id_col="doc_id", text_col="text"), "signatures")
    known = sigs.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = known.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.any_value("roots").alias("roots"), F.any_value("sig").alias("sig"))
    reps = materialise(classes, "classes")

    sure = percent / 100
    least = int(np.floor(COORDINATES * (sure - 4.5 * np.sqrt(sure * (1 - sure) / COORDINATES))))
    edges = candidate_edges(reps.select("rep", "roots", "sig"), least=least, leaf=leaf, branches=branches, depth=depth)
    proposed = edges[0]
    for more in edges[1:]:
        proposed = proposed.union(more)
    comps = materialise(components(proposed), "proposed").select(F.col("node").alias("rep"), F.col("root").alias("comp"))

    # Parts of a class; a large class has the same few leaders in each of its parts.
    picks = [F.min_by("rep", F.xxhash64("rep", F.lit(k))).alias(f"l{k}") for k in range(leaders)]
    sizes = comps.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias("parts"), *picks)
    sizes = materialise(sizes, "class-sizes")
    keyed = sizes.select(rekeyed(F.col("comp")).alias("of"), "parts")
    member = comps.join(keyed, comps.comp == keyed.of).select("rep", "comp", "parts", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("part"))
    member = materialise(member, "members")
    lead = sizes.where("parts > 1").select(F.explode(F.array_distinct(F.array(*[f"l{k}" for k in range(leaders)]))).alias("rep"), "comp", F.col("parts").alias("n"))
    lead = lead.select("rep", "comp", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("part"))
    links = _confirmed(own, member.select("rep", "comp", "part").union(lead).distinct(), words, percent)
    links = materialise(links, "links")
    labels = materialise(components(links), "labels")

    many = member.where("parts > 1")
    if not many.isEmpty():
        # In a class of several parts, documents outside its largest linked group meet every part.
        at = many.join(labels, many.rep == labels.node, "left").select("rep", "comp", "part", "parts", F.coalesce("root", "rep").alias("label"))
        at = materialise(at, "class-labels")
        main = at.groupBy("comp", "label").count().groupBy("comp").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
        main = main.select(rekeyed(F.col("comp")).alias("of"), "main")
        rest = materialise(at.join(main, at.comp == main.of).where("label <> main").select("rep", "comp", "parts"), "rest")
        if not rest.isEmpty():
            n = rest.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias("blocks")).select(rekeyed(F.col("comp")).alias("of"), "blocks")
            n = materialise(n, "rest-blocks")
            code = F.col("x") + F.col("y").cast("long") * F.lit(1 << 32)
            rows = at.join(n, at.comp == n.of).select("rep", "comp", F.col("part").alias("x"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("y"))
            alone = rest.join(n, rest.comp == n.of).select("rep", "comp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("x"), F.pmod(F.xxhash64("rep", F.lit(9)), F.col("blocks")).cast("int").alias("y"))
            again = rows.unionByName(alone).select("rep", "comp", code.alias("part")).distinct()
            labels = _merged(labels, materialise(_confirmed(own, again, words, percent), "links"))

    named = reps.select("d1", "d2", "rep").join(labels.select(F.col("node").alias("of"), "root"), F.col("rep") == F.col("of"), "left")
    named = named.select(rekeyed(F.col("d1")).alias("c1"), rekeyed(F.col("d2")).alias("c2"), F.coalesce("root", "rep").alias("component"))
    # Documents without shingles get a key of their own instead of meeting in one task.
    found = sigs.withColumn("k1", F.when(F.col("n_shingles") > 0, F.col("d1")).otherwise(F.xxhash64("doc_id", F.lit(3))))
    found = found.join(named, (F.col("k1") == F.col("c1")) & (F.col("d2") == F.col("c2")) & (F.col("n_shingles") > 0), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    found = found.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"))
    found = found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    if set(docs.columns) <= {id_col, text_col} and id_col == "doc_id":  # nothing else to bring back
        return found.drop("text_hash")
    # Rows with one id and one text have one verdict; a row's key is never null.
    verdict = found.groupBy(row_key("doc_id", F.col("text_hash")).alias("__k"), "doc_id", "text_hash").agg(
        F.any_value("n_shingles").alias("__n"), F.any_value("component_id").alias("__c")
    )
    verdict = verdict.select(rekeyed(F.col("__k")).alias("__k"), F.col("doc_id").alias("__id"), F.col("text_hash").alias("__h"), "__n", "__c")
    this, h = F.col(f"`{id_col}`").cast("long"), F.xxhash64(F.col(f"`{text_col}`"))
    on = (row_key(this, h) == F.col("__k")) & this.eqNullSafe(F.col("__id")) & (h == F.col("__h"))
    joined = docs.join(verdict, on, "left")
    out = with_columns(joined, {"n_shingles": F.col("__n"), "component_id": F.col("__c"), "kept": this.eqNullSafe(F.col("__c"))})
    return out.select(*[f"`{c}`" for c in docs.columns if c not in ("n_shingles", "component_id", "kept")], "n_shingles", "component_id", "kept")


def row_key(doc_id: str | Column, text_hash: Column) -> Column:
    """A hash of a row's id and text."""
    return F.xxhash64(doc_id, text_hash)


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir).select("doc_id", "text"), words=4, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


OP6_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s
  FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM pairs p JOIN sizes a ON a.doc_id = p.x JOIN sizes b ON b.doc_id = p.y
  WHERE 100 * common >= 80 * (a.n + b.n - common)
), edges AS (
  SELECT x, y FROM links UNION SELECT y, x FROM links
), reach AS (
  SELECT x AS doc_id, y AS other FROM edges
  UNION
  SELECT r.doc_id, e.y FROM reach r JOIN edges e ON e.x = r.other
), least AS (
  SELECT doc_id, min(other) AS m FROM reach GROUP BY doc_id
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, coalesce(l.m, d.doc_id)) AS component_id,
       least(d.doc_id, coalesce(l.m, d.doc_id)) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN least l USING (doc_id)
"""
