"""Secret scans: fixed patterns and sliding-window entropy, as SQL expressions.

Positions come from markers: a pattern's matches are wrapped in a private-use
character, the text is split there, and the lengths of the parts add up to code
point offsets.  One projection over the scan, no exchange and no Python.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.shared import documents, or_empty, with_columns

EDGE, INNER = "", ""
KINDS = ("assign", "access", "hex", "entropy")
SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"

# The patterns of the base scan and the least lengths of what they find.
ASSIGN_HEAD = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ASSIGN_VALUE = r"[A-Za-z0-9+/_.=-]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24

#: Candidates for the entropy scan: runs of token characters.
CANDIDATE = r"[A-Za-z0-9+/_=-]{%d,}"
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"
#: Least bits a character in a window, by the class of the candidate's characters; the README has the miss rates on
#: random keys.  A long mixed candidate has many windows to reach its bits in; one made like words needs the most.
HEX_BITS, LOWER_BITS, UPPER_BITS, SHORT_MIXED_BITS, MIXED_BITS, WORD_BITS = 2.9, 3.4, 3.3, 3.6, 3.9, 3.9
SHORT_MIXED = 31
#: Pieces of candidates that are no secrets: UUIDs, placeholders and documented sample keys, dates and versions.
ALLOWED = (
    r"(?<![0-9a-zA-Z])[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}(?![0-9a-zA-Z])",
    r"wJalrXUtnFEMI/K7MDENG/",
    r"(?<![0-9a-zA-Z])[0-9a-zA-Z]*?(?:EXAMPLE|example|sample|placeholder|your_|xxxx|XXXX)[0-9a-zA-Z]*",
    r"^[0-9/_=+-]+$",
)
#: What words don't have: digits other than up to four at the end, and capitals that come and go.
NO_WORDS = r"[0-9][/_=+-]*[A-Za-z]|[0-9]{5}|[0-9][/_=+-]+[0-9]|[A-Z][a-z][A-Z]"
FILL = "="


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once: an expression that a lambda
    refers to would be worked out again for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(numbers: Column) -> Column:
    """Running sums of an array of bigints, by doubling: n log n steps and no array that grows."""
    rounds = F.sequence(F.lit(0), F.length(F.bin(F.size(numbers).cast("bigint"))))

    def further(sums: Column, k: Column) -> Column:
        step = F.pow(F.lit(2), k).cast("int")
        return _bound(step, lambda d: F.transform(sums, lambda x, i: x + F.coalesce(F.get(sums, i - d), F.lit(0).cast("bigint"))))

    return F.aggregate(rounds, numbers, further)


def _matches(text: Column, pattern: str, groups: bool = False) -> Column:
    """(start, end, value) of ``pattern``'s matches in order; with ``groups`` the
    pattern has two groups and ``value`` is the second."""
    mark = f"{EDGE}$1{INNER}$2{EDGE}" if groups else f"{EDGE}$0{EDGE}"
    empty = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")

    def found(parts: Column) -> Column:
        # Every second part is a match; one marker inside it doesn't count.
        sizes = F.transform(parts, lambda p, k: (F.length(p) - (F.pmod(k, F.lit(2)) if groups else F.lit(0))).cast("bigint"))

        def spans(ends: Column) -> Column:
            value = lambda p: F.substring_index(p, INNER, -1) if groups else p
            rows = F.transform(parts, lambda p, k: F.struct(F.get(ends, k - 1).alias("start"), F.get(ends, k).alias("end"), F.when(F.pmod(k, F.lit(2)) == 1, value(p)).alias("value")))
            return F.filter(rows, lambda r: r["value"].isNotNull())

        return F.when(F.size(parts) > 1, _bound(_bound(sizes, _running), spans)).otherwise(empty)

    return _bound(F.split(F.regexp_replace(text, pattern, mark), EDGE, -1), found)


def _spans(text: Column, pattern: str, kind: int, least_inner: int | None = None) -> Column:
    """Spans of ``pattern``'s matches.  With ``least_inner`` the pattern has two
    groups and a match counts if the second has that many characters."""
    found = _matches(text, pattern, bool(least_inner))
    if least_inner:
        found = F.filter(found, lambda m: F.length(m["value"]) >= least_inner)
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))


def entropy_windows(value: Column, window: int, least_bits: Column) -> Column:
    """Spans (start, end) inside ``value`` covered by windows of ``window``
    characters whose Shannon entropy reaches ``least_bits``.

    A window's entropy is log2(w) - sum(c * log2 c) / w over its character
    counts.  The sum is kept while the window slides: the character that comes
    in and the one that goes out each change one count.  The counts are a string
    with a character for each count, so that a step costs the same wherever it is.
    """
    codes = F.transform(F.split(value, ""), lambda ch: F.instr(F.lit(ALPHABET), ch))
    return _bound(F.filter(codes, lambda c: c > 0), lambda c: _slide(c, window, least_bits))


#: The character that stands for a count of 0; a count of c is the c-th after it.
ZERO = 48


def _slide(codes: Column, window: int, least_bits: Column) -> Column:
    table = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def bump(s: Column, code: Column, by: int) -> Column:
        """One character more or less in the window."""

        def changed(count: Column) -> Column:
            total = s["total"] + F.element_at(table, count + 1 + by) - F.element_at(table, count + 1)
            return _state(F.overlay(s["counts"], F.char(count + by + ZERO), code, F.lit(1)), total, s["open"], s["spans"])

        return _bound(F.ascii(F.substring(s["counts"], code, F.lit(1))) - ZERO, changed)

    def note(s: Column, i: Column) -> Column:
        """A window that reaches its bits goes on with the open span or closes it."""
        high = (i >= window) & (F.lit(math.log2(window)) - s["total"] / window >= least_bits)
        start, end = (i - window).cast("bigint"), i.cast("bigint")
        joins = s["open"]["end"] >= start
        span = F.struct(F.when(joins, s["open"]["start"]).otherwise(start).alias("start"), end.alias("end"))
        closed = F.when(joins | (s["open"]["end"] < 0), s["spans"]).otherwise(F.concat(s["spans"], F.array(s["open"])))
        return F.when(high, _state(s["counts"], s["total"], span, closed)).otherwise(s)

    def step(state: Column, i: Column) -> Column:
        came = bump(state, F.element_at(codes, i), 1)
        gone = F.element_at(codes, F.greatest(i - window, F.lit(1)))
        both = _bound(came, lambda s: F.when(i > window, bump(s, gone, -1)).otherwise(s))
        return _bound(both, lambda s: note(s, i))

    nothing = F.struct(F.lit(-1).cast("bigint").alias("start"), F.lit(-1).cast("bigint").alias("end"))
    zero = _state(F.lit(chr(ZERO) * len(ALPHABET)), F.lit(0.0), nothing, none)
    finish = lambda s: F.when(s["open"]["end"] < 0, none).otherwise(F.concat(s["spans"], F.array(s["open"])))
    return F.when(F.size(codes) >= window, F.aggregate(F.sequence(F.lit(1), F.size(codes)), zero, step, finish)).otherwise(none)


def _state(counts: Column, total: Column, open_: Column, spans: Column) -> Column:
    return F.struct(counts.alias("counts"), total.alias("total"), open_.alias("open"), spans.alias("spans"))


def _blanked(value: Column, allowed: Sequence[str]) -> Column:
    """``value`` with the pieces that an ``allowed`` pattern finds filled up."""
    if not allowed:
        return value
    pattern = "|".join(f"(?:{p})" for p in allowed)
    parts = F.split(F.regexp_replace(value, pattern, f"{EDGE}$0{EDGE}"), EDGE, -1)
    filled = F.transform(parts, lambda part, k: F.when(k % 2 == 1, F.repeat(F.lit(FILL), F.length(part))).otherwise(part))
    return F.when(value.rlike(pattern), F.array_join(filled, "")).otherwise(value)


def _entropy_spans(text: Column, window: int, allowed: Sequence[str]) -> Column:
    kind = KINDS.index("entropy")

    def inside(found: Column) -> Column:
        def scan(v: Column) -> Column:
            bits = (
                F.when(v.rlike("^[0-9a-fA-F=]+$") & v.rlike("[0-9]"), HEX_BITS)
                .when(~v.rlike(NO_WORDS), WORD_BITS)
                .when(v.rlike("^[0-9a-z_=-]+$"), LOWER_BITS)
                .when(v.rlike("^[0-9A-Z_=-]+$"), UPPER_BITS)
                .when(F.length(v) <= SHORT_MIXED, SHORT_MIXED_BITS)
                .otherwise(MIXED_BITS)
            )
            high = _bound(bits, lambda b: entropy_windows(v, window, b))  # the class is found once
            shifted = lambda s: F.struct((found["start"] + s["start"]).alias("start"), F.lit(kind).alias("kind"), (found["start"] + s["end"]).alias("end"))
            return F.transform(high, shifted)

        return _bound(_blanked(found["value"], allowed), scan)

    return F.flatten(F.transform(_matches(text, CANDIDATE % window), inside))


def scan_secrets(
    docs: DataFrame,
    *,
    text_col: str = "text",
    window: int = 20,
    allowed: Sequence[str] = ALLOWED,
) -> DataFrame:
    """All rows of ``docs`` with ``base_spans`` and ``entropy_spans``.

    Both are arrays of (start, kind, end) in code points, end exclusive; kind
    indexes ``KINDS``.  Base spans are the matches of the fixed patterns,
    leftmost and not overlapping within a kind, that reach their least length.
    Entropy spans cover the windows of ``window`` characters of a candidate that
    are too random for its class of characters.  Pieces that an ``allowed``
    pattern finds count as filled with one character; base spans always stay.

    Null texts count as empty.  An empty table gives an empty result; columns
    named like a result are replaced.
    """
    clean = docs.withColumn("__t", F.translate(or_empty(F.col(f"`{text_col}`")), EDGE + INNER, "\x01\x01"))
    text = F.col("__t")
    base = F.concat(
        _spans(text, f"({ASSIGN_HEAD})({ASSIGN_VALUE})", 0, ASSIGN_LEAST),
        # A longer least length gives the same spans as a filter on whole runs, without a match for each short run.
        _spans(text, r"AKIA[A-Z0-9]{%d,}" % (ACCESS_LEAST - 4), 1),
        _spans(text, r"[0-9a-f]{%d,}" % HEX_LEAST, 2),
    )
    out = with_columns(clean, {"base_spans": F.array_sort(base), "entropy_spans": F.array_sort(_entropy_spans(text, window, allowed))})
    return out.drop("__t")


def span_text(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(documents(spark, sf_dir))
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("bigint")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(span_text(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"),
        span_text(F.array_sort(F.concat("base_spans", "entropy_spans"))).alias("spans"),
    )
