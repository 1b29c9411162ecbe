"""Suffix-array dedup: every byte covered by a window of ``WINDOW`` bytes that also starts elsewhere is removed.

1. Each window names an anchor inside it: its gram of ``GRAM`` bytes that comes first in a global order, rare cells
   of a fixed-size count sketch before frequent ones. Equal windows name equal anchors, and a passage of many
   documents is anchored apart from the text around it. Runs of windows with one anchor make a context.
2. Contexts whose anchor and bytes both occur more than once are repeated as a whole. Of the others that share an
   anchor, one text of each goes to a shard chosen by the anchor, so equal windows meet.
3. A shard sorts the suffixes of its contexts by induced sorting and computes permuted common prefixes; windows
   with ``WINDOW`` bytes in common with a neighbour are repeated.
4. Repeated windows go back to all documents with their context; overlapping ones make spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwave.llm.common import mark, marks, slices, text_bytes, written
from cellwave.llm.words import mixed, powers

WINDOW = 200
GRAM = 32
CELL_BITS = 18
POSITION_BITS = 28
SHARD_BYTES = 1 << 20
SLICE_BYTES = 1 << 20
MOST_KINDS = 4096
SEPARATOR = 0xFF  # in no UTF-8 text
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class Prefixes:
    """Hashes of any stretches of a byte array."""

    def __init__(self, data: np.ndarray) -> None:
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(data)), out=self.sums[1:])
        self.back = powers(_INVERSE, len(data) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` keys in a row, from block-wise running minima."""
    count = len(keys) - width + 1
    blocks = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[: len(keys)] = keys
    blocks = blocks.reshape(-1, width)
    left = np.minimum.accumulate(blocks, 1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[:count], left[width - 1 : width - 1 + count])


def contexts(data: np.ndarray, at: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, ...]:
    """``text, lo, hi, anchor, bytes``: text number, first and last window start, and hashes of each context."""
    sizes = np.diff(at)
    counts = np.maximum(sizes - WINDOW + 1, 0)
    total = int(counts.sum())
    if not total:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    starts = np.arange(total) + np.repeat(at[:-1] - np.append(0, np.cumsum(counts)[:-1]), counts)
    prefixes = Prefixes(data)
    grams = np.arange(len(data) - GRAM + 1)
    names = mixed(prefixes.of(grams, grams + GRAM))
    order = level[(names >> np.uint64(64 - CELL_BITS)).astype(np.int64)] << np.uint64(58)
    order |= (names & np.uint64((1 << 30) - 1)) << np.uint64(POSITION_BITS)
    if len(data) >= 1 << POSITION_BITS:
        raise ValueError("a text of 256 MB or more")
    best = sliding_min(order | grams.astype(np.uint64), WINDOW - GRAM + 1)[starts]
    best = (best & np.uint64((1 << POSITION_BITS) - 1)).astype(np.int64)
    first = np.ones(total, bool)
    first[1:] = (best[1:] != best[:-1]) | (starts[1:] != starts[:-1] + 1)
    heads = np.flatnonzero(first)
    lo, hi = starts[heads], starts[np.append(heads[1:], total) - 1]
    anchor = best[heads]
    place = (anchor - lo).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + (hi - lo).astype(np.uint64)
    whole = mixed(prefixes.of(lo, hi + WINDOW) + mixed(place))
    text = np.searchsorted(at, lo, "right") - 1
    return text, lo - at[text], hi - at[text], names[anchor].view(np.int64), whole.view(np.int64)


def text_key(text: Column) -> Column:
    return F.xxhash64(text, F.octet_length(text))


def anchor_levels(documents: DataFrame) -> np.ndarray:
    """Logarithm of how many anchors over all documents fall in each of ``2 ** CELL_BITS`` cells."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << CELL_BITS, np.int64)
        flat = np.zeros(1 << CELL_BITS, np.uint64)
        for batch in slices(batches, "text", SLICE_BYTES):
            anchors = contexts(*text_bytes(batch.column(0)), flat)[3].view(np.uint64)
            total += np.bincount((anchors >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=1 << CELL_BITS)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], ["cell", "n"])

    cells = documents.select("text").mapInArrow(counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    table = cells.toArrow()  # one row per cell at most
    out = np.zeros(1 << CELL_BITS, np.uint64)
    out[table["cell"].to_numpy()] = np.log2(1.0 + table["n"].to_numpy()).astype(np.uint64)
    return out


def context_rows(documents: DataFrame) -> DataFrame:
    """``anchor, bytes, key, lo, hi`` of every context of every row."""
    levels = documents.sparkSession.sparkContext.broadcast(anchor_levels(documents))
    text = F.coalesce("text", F.lit(""))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            row, lo, hi, anchor, whole = contexts(*text_bytes(batch.column(1)), levels.value)
            keys = batch.column(0).to_numpy()[row] if len(row) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor), pa.array(whole), pa.array(keys), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))],
                ["anchor", "bytes", "key", "lo", "hi"],
            )

    rows = documents.select(text_key(text).alias("key"), text.alias("text"))
    return rows.mapInArrow(found, "anchor long, bytes long, key long, lo int, hi int")


# ---- suffix array of one shard


def suffix_types(text: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than the next one; the last is."""
    n = len(text)
    differs = np.flatnonzero(text[1:] != text[:-1])
    after = np.searchsorted(differs, np.arange(n - 1))
    small = np.ones(n, bool)
    known = after < len(differs)
    at = differs[after[known]]
    small[:-1][known] = text[at] < text[at + 1]
    small[:-1][~known] = False  # a run up to the end
    return small


def induce(text: np.ndarray, small: np.ndarray, leftmost: np.ndarray) -> np.ndarray:
    """All suffixes in the order that sorted leftmost-smaller suffixes induce, a bucket of one byte at a time."""
    marks = text[leftmost]
    seeds = np.split(leftmost, np.searchsorted(marks, np.arange(1, 256)))
    larger: list[list[np.ndarray]] = [[] for _ in range(256)]
    smaller: list[list[np.ndarray]] = [[] for _ in range(256)]

    def deal(found: np.ndarray, to: list[list[np.ndarray]]) -> None:
        chars = text[found]
        order = np.argsort(chars, kind="stable")
        found, chars = found[order], chars[order]
        cuts = np.flatnonzero(chars[1:] != chars[:-1]) + 1
        for part in np.split(found, cuts):
            to[text[part[0]]].append(part)

    def before(found: np.ndarray, kind: bool) -> np.ndarray:
        found = found[found > 0] - 1
        return found[small[found] == kind]

    for c in range(256):
        done = 0
        while done < len(larger[c]):  # runs of one byte add to their own bucket
            some = np.concatenate(larger[c][done:])
            done = len(larger[c])
            if len(found := before(some, False)):
                deal(found, larger)
        if len(found := before(seeds[c], False)):
            deal(found, larger)
    for c in range(255, -1, -1):
        done = 0
        while done < len(smaller[c]):
            some = np.concatenate(smaller[c][done:])
            done = len(smaller[c])
            if len(found := before(some, True)):
                deal(found, smaller)
        if larger[c] and len(found := before(np.concatenate(larger[c])[::-1], True)):
            deal(found, smaller)
    end = np.array([len(text) - 1])  # the last suffix has no one after it to induce it
    out = [end]
    for c in range(256):
        out += larger[c]
        if smaller[c]:
            out.append(np.concatenate(smaller[c])[::-1])
    return np.concatenate(out)


def rank_names(names: np.ndarray, reach: int = 1) -> np.ndarray:
    """Rank of each suffix of the reduced string, by recursion on pairs of names that cover twice as much."""
    if reach >= 2 * WINDOW or len(names) < 2 or names.max() == len(names) - 1:
        return names
    after = np.zeros(len(names), np.int64)
    after[: max(len(names) - reach, 0)] = names[reach:] + 1
    pairs = names * (len(names) + 1) + after
    return rank_names(np.unique(pairs, return_inverse=True)[1].astype(np.int64), 2 * reach)


def suffix_array(text: np.ndarray, prefixes: Prefixes) -> np.ndarray:
    """Suffixes of a byte array that ends in its only 0, by induced sorting; alike ones are told apart by over 2 windows."""
    small = suffix_types(text)
    left = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(left) > 1:
        # substrings from one leftmost-smaller suffix to the next
        ends = np.append(left[1:] + 1, len(text))
        order = induce(text, small, left[np.argsort(text[left], kind="stable")])
        is_left = np.zeros(len(text), bool)
        is_left[left] = True
        order = order[is_left[order]]
        number = np.zeros(len(text), np.int64)
        number[left] = np.arange(len(left))
        sizes, hashes = ends - left, prefixes.of(left, ends)
        at = number[order]
        new = np.ones(len(order), bool)
        new[1:] = (sizes[at[1:]] != sizes[at[:-1]]) | (hashes[at[1:]] != hashes[at[:-1]])
        names = np.zeros(len(left), np.int64)
        names[at] = np.cumsum(new) - 1
        left = left[np.argsort(rank_names(names), kind="stable")]
    return induce(text, small, left)


def permuted_prefixes(text: np.ndarray, order: np.ndarray, prefixes: Prefixes) -> np.ndarray:
    """For each suffix how many bytes it shares with the one before it in ``order``, up to 1023."""
    n = len(text)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    here = np.arange(n)
    # where the bytes in front agree, one byte less is shared than one place to the left
    free = np.ones(n, bool)
    inner = (here > 0) & (before > 0)
    free[inner] = (text[here[inner] - 1] != text[before[inner] - 1]) | (before[here[inner] - 1] != before[inner] - 1)
    p = np.flatnonzero(free & (before >= 0))
    q = before[p]
    shared = np.zeros(len(p), np.int64)
    step = 1 << (4 * WINDOW).bit_length()  # no two parts are alike, so more can't be shared
    while step := step // 2:
        fits = np.maximum(p, q) + shared + step <= n
        i, j = (p + shared)[fits], (q + shared)[fits]
        fits[fits] = prefixes.of(i, i + step) == prefixes.of(j, j + step)
        shared[fits] += step
    out = np.zeros(n, np.int64)
    out[p] = shared + p
    last = np.maximum.accumulate(np.where(free, here, 0))
    return np.maximum(out[last] - here, 0)


def repeated_starts(parts: list[bytes]) -> np.ndarray:
    """For the parts, each closed by ``SEPARATOR``, in one array: which bytes start a repeated window."""
    text = np.frombuffer(b"".join(p + bytes([SEPARATOR]) for p in parts) + b"\xfe", np.uint8)
    # up by one, so that the end is the only 0; UTF-8 has no byte above 0xF4
    text = np.where(text == SEPARATOR, text, text + np.uint8(1))
    text[-1] = 0
    prefixes = Prefixes(text)
    order = suffix_array(text, prefixes)
    shared = permuted_prefixes(text, order, prefixes)
    again = np.zeros(len(text), bool)
    both = shared[order[1:]] >= WINDOW
    again[order[1:][both]] = True
    again[order[:-1][both]] = True
    return again


def ranges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each run of true flags."""
    edges = np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1


# ---- all documents


def _texts(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """``key, text`` once for each wanted key; other texts but a few are left out before they move."""
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(text_key(text).alias("key"), text.alias("text"))
    rows = rows.join(marks(wanted, "key"), mark("key") == F.col("mark"), "left_semi")
    return rows.join(wanted, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))


def repeated_ranges(documents: DataFrame) -> DataFrame:
    """``key, lo, hi``: first and last starts of repeated windows in the texts with that key."""
    rows = written(context_rows(documents), "suffix-contexts")
    often = rows.groupBy("anchor").count().filter("count > 1").select("anchor")
    rows = rows.join(often, "anchor").groupBy("anchor", "bytes", "key", "lo", "hi").agg(F.count("*").alias("n"))
    rows = written(rows, "suffix-shared")
    kinds = rows.groupBy("anchor", "bytes").agg(F.sum("n").alias("n"), F.min(F.struct("key", "lo", "hi")).alias("at"))
    kinds = written(kinds, "suffix-kinds")
    # whole contexts that occur again
    whole = kinds.filter("n > 1").select("anchor", "bytes", F.lit(0).alias("first"), (F.col("at.hi") - F.col("at.lo")).alias("last"))
    groups = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).filter("kinds > 1 and least = 1")
    mixed_kinds = kinds.join(groups.select("anchor", "kinds"), "anchor")
    mixed_kinds = mixed_kinds.select("anchor", "bytes", "n", "kinds", "at.key", "at.lo", "at.hi")
    total = mixed_kinds.agg(F.sum(F.col("hi") - F.col("lo") + WINDOW)).first()[0] or 0
    part = F.expr(f"substring(encode(text, 'utf-8'), lo + 1, hi - lo + {WINDOW})")
    parts = mixed_kinds.join(_texts(documents, mixed_kinds.select("key").distinct()), "key")
    parts = parts.select("anchor", "bytes", "n", "kinds", part.alias("part"))

    def sorted_shard(table: pa.Table) -> pa.Table:
        table = table.sort_by([("anchor", "ascending"), ("bytes", "ascending")])
        texts = table["part"].to_pylist()
        again = repeated_starts(texts)
        places, firsts, lasts, at = [], [], [], 0
        for k, (own, n) in enumerate(zip(texts, table["n"].to_pylist(), strict=True)):
            if n == 1:
                lo, hi = ranges(again[at : at + len(own) - WINDOW + 1])  # those further on meet the separator
                places += [k] * len(lo)
                firsts += lo.tolist()
                lasts += hi.tolist()
            at += len(own) + 1
        out = table.select(["anchor", "bytes"]).take(pa.array(places, pa.int64()))
        return out.append_column("first", pa.array(firsts, pa.int32())).append_column("last", pa.array(lasts, pa.int32()))

    shards = -(-int(total) // SHARD_BYTES) or 1
    shard = F.pmod(F.xxhash64("anchor"), F.lit(shards))
    inside = (
        parts.filter(F.col("kinds") <= MOST_KINDS)
        .groupBy(shard.alias("shard"))
        .applyInArrow(sorted_shard, "anchor long, bytes long, first int, last int")
    )
    found = whole.unionByName(inside).unionByName(_by_window(parts.filter(F.col("kinds") > MOST_KINDS)))
    return rows.join(found, ["anchor", "bytes"]).select(
        "key", (F.col("lo") + F.col("first")).alias("lo"), (F.col("lo") + F.col("last")).alias("hi")
    )


def _by_window(parts: DataFrame) -> DataFrame:
    """The same for anchors of too many contexts for one shard: windows are counted by their digest."""
    starts = parts.select("anchor", "bytes", "n", "part", F.explode(F.sequence(F.lit(1), F.octet_length("part") - (WINDOW - 1))).alias("p"))
    windows = starts.select(
        "anchor", "bytes", "n", (F.col("p") - 1).alias("first"), F.md5(F.expr(f"substring(part, p, {WINDOW})")).alias("window")
    )
    again = windows.groupBy("anchor", "window").count().filter("count > 1").select("anchor", "window")
    found = windows.filter("n = 1").join(again, ["anchor", "window"])
    return found.select("anchor", "bytes", "first", F.col("first").alias("last"))


def removed_spans(documents: DataFrame) -> DataFrame:
    """``key, spans``: the removed byte ranges ``[start, end)`` of the texts that hold any, in order and apart."""
    found = written(repeated_ranges(documents).distinct(), "suffix-ranges")
    spans = found.groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct(F.col("lo").alias("start"), (F.col("hi") + WINDOW).alias("end")))).alias("spans")
    )

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for spans in batch.column(1).to_pylist():
                own: list[dict] = []
                for s in spans:
                    if own and s["start"] <= own[-1]["end"]:
                        own[-1]["end"] = max(own[-1]["end"], s["end"])
                    else:
                        own.append(s)
                out.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["key", "spans"])

    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    return spans.mapInArrow(merged, "key long, spans array<struct<start:int,end:int>>")


def strip_repeats(documents: DataFrame) -> DataFrame:
    """All rows and columns with ``suffix_kept`` (binary, the remaining bytes) and ``suffix_spans`` (removed ranges).

    A null text is empty. Texts shorter than a window stay whole; a repeated row is a copy, so both lose all
    windows. Windows never cross documents.
    """
    spans = written(removed_spans(documents), "suffix-spans")
    places = marks(spans, "key")
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(F.struct("*").alias("document"), text_key(text).alias("key"), F.encode(text, "utf-8").alias("raw"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    far = rows.join(places, mark("key") == F.col("mark"), "left_anti").withColumn("spans", none)
    near = rows.join(places, mark("key") == F.col("mark"), "left_semi").join(spans, "key", "left")
    near = near.select("document", "key", "raw", F.coalesce("spans", none).alias("spans"))
    starts = F.concat(F.array(F.lit(0)), F.col("spans.end"))
    kept = F.transform(
        starts,
        lambda s, k: F.substring(F.col("raw"), s + 1, F.coalesce(F.get("spans", k)["start"], F.octet_length("raw")) - s),
    )
    joined = F.aggregate(kept, F.lit(b"").cast("binary"), lambda a, b: F.concat(a, b))
    near = near.withColumn("kept", F.when(F.size("spans") > 0, joined).otherwise(F.col("raw")))
    both = near.drop("raw").unionByName(far.withColumnRenamed("raw", "kept"))
    return both.select("document.*", F.col("kept").alias("suffix_kept"), F.col("spans").alias("suffix_spans"))
