"""SimHash near duplicates by deletion-variant signatures.

1. A text's fingerprint has a bit set if more than half of its shingles' hashes have it. Equal fingerprints are one row.
2. With at most ``DISTANCE`` differing bits, one of ``SEGMENTS`` segments differs in one bit at most. So fingerprints that
   link share a signature: a segment of which one bit is left out, with the place of that bit. Each is indexed by all
   its 64 signatures, and those that meet on one are verified by their bits.
3. Sorted by signature, groups pass through a task one by one. Of one with at most ``GROUP`` fingerprints those links
   are kept that join something. A larger one is handed on as it comes, and never held: every member close to the
   smallest one is linked with that; if the group is joined as a whole by then, its other links change nothing and it
   is done. Otherwise its members meet by further bits: those not yet used are cut into parts of which one must be
   equal. Each round fixes bits, so groups end.
4. Components of the links get their smallest document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellwave.llm.common import shipped, slices, text_bytes, written
from cellwave.llm.components import components
from cellwave.llm.words import IS_SPACE, LOWER

WORDS = 4
SEED = 42
DISTANCE = 4
SEGMENTS = 3
GROUP = 2048
SLICE_BYTES = 1 << 20
#: Shingles hashed at a time, also of one long text.
PART = 1 << 17


def squeezed_words(data: np.ndarray, at: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Texts lower-cased (A-Z) with one space after each word: bytes, starts and ends of words, first word of each text."""
    inside = ~IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    begin, close = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    close[:-1] &= ~inside[1:] | edge[1:-1]
    first = np.flatnonzero(begin)
    size = np.flatnonzero(close) + 1 - first
    ends = np.cumsum(size + 1) - 1
    # each byte moves by the spaces put in before its word
    out = np.full(int(size.sum()) + len(size), 32, np.uint8)
    out[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = LOWER[data[inside]]
    return out.tobytes(), ends - size, ends, np.searchsorted(first, at)


def fingerprints(column: pa.Array, words: int = WORDS) -> np.ndarray:
    """Fingerprint of each text as unsigned 64-bit number; 0 for a text without words."""
    joined, starts, ends, cut = squeezed_words(*text_bytes(column))
    counts = np.diff(cut)
    own = np.where(counts > 0, np.maximum(counts - words + 1, 1), 0)
    ones = np.zeros((len(counts), 64), np.int64)
    digest, before, total = xxhash.xxh64_intdigest, np.cumsum(own) - own, int(own.sum())
    for low in range(0, total, PART):
        number = np.arange(low, min(low + PART, total))
        text = np.searchsorted(before + own, number, "right")
        lead = number - before[text] + cut[text]
        last = np.minimum(lead + words, cut[text + 1]) - 1
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[lead].tolist(), ends[last].tolist(), strict=True)]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1)
        heads = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
        ones[text[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > own[:, None], axis=1).view("<u8").ravel()


def with_fingerprints(documents: DataFrame) -> DataFrame:
    """All rows and columns with ``fingerprint`` (long, the bits of the unsigned number). A null text has no words."""
    shipped(documents.sparkSession)
    names = [f"c{k}" for k in range(len(documents.columns))]
    text = names[documents.columns.index("text")]
    rows = documents.toDF(*names)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, SLICE_BYTES):
            own = pa.array(fingerprints(batch.column(names.index(text))).astype(np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, own], [*names, "fingerprint"])

    schema = T.StructType([*rows.schema.fields, T.StructField("fingerprint", T.LongType())])
    return rows.mapInArrow(marked, schema).toDF(*documents.columns, "fingerprint")


def cuts(bits: int, parts: int) -> list[tuple[int, int]]:
    """First bit and width of each of ``parts`` even parts of ``bits`` bits."""
    edges = [bits * k // parts for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def signatures(fp: Column) -> Column:
    """Array of ``segment, part, used``: for each bit left out, its number, the segment's other bits, and bits used."""
    out = []
    for low, width in cuts(64, SEGMENTS):
        whole = ((1 << width) - 1) << low
        for bit in range(low, low + width):
            out.append((bit, _signed(whole & ~(1 << bit)), _signed(whole)))
    return F.array(*[
        F.struct(F.lit(bit).alias("segment"), fp.bitwiseAND(F.lit(mask)).alias("part"), F.lit(used).alias("used")) for bit, mask, used in out
    ])


def further_cuts(used: int) -> list[int]:
    """The bits that are not in the mask ``used``, as masks of ``DISTANCE + 1`` parts: one is equal in two that link."""
    free = [b for b in range(64) if not used >> b & 1]
    return [sum(1 << b for b in free[low : low + width]) for low, width in cuts(len(free), DISTANCE + 1)]


def further(fp: Column, used: Column, known: set[int]) -> Column:
    """Array of ``segment, part, used`` by the next cuts of each mask of ``known``, of which ``used`` is one."""
    at = None
    for mask in sorted(known):
        own = F.array(*[
            F.struct(F.lit(k).alias("segment"), fp.bitwiseAND(F.lit(_signed(part))).alias("part"), F.lit(_signed(mask | part)).alias("used"))
            for k, part in enumerate(further_cuts(mask))
        ])
        fits = used == F.lit(_signed(mask))
        at = F.when(fits, own) if at is None else at.when(fits, own)
    return at


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def joining_links(own: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Pairs at most ``distance`` bits apart that join the members as all such pairs do: a spanning forest.

    Members reached from one start are taken out, so a dense group takes few rounds over what is left.
    """
    left = np.arange(len(own))
    links: list[tuple[int, int]] = []
    while len(left):
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            at = todo.pop()
            near = np.bitwise_count(own[left] ^ own[at]) <= distance
            reached = left[near].tolist()
            links += [(at, k) for k in reached]
            todo += reached
            left = left[~near]
    return links


def group_links(fp: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Pairs that join the members of each group as its links do; group ``k`` is ``fp[at[k] : at[k + 1]]``."""
    twos = fp[at[:-1][np.diff(at) == 2, None] + [0, 1]]
    pairs = [twos[np.bitwise_count(twos[:, 0] ^ twos[:, 1]) <= DISTANCE]]
    for k in np.flatnonzero(np.diff(at) > 2).tolist():
        own = fp[at[k] : at[k + 1]]
        if links := joining_links(own):
            pairs.append(own[np.array(links)])
    return np.unique(np.sort(np.concatenate(pairs).view(np.int64), 1), axis=0)


def _met(rows: DataFrame, group: int) -> DataFrame:
    """Of ``fp, key, used`` rows: links (``a, b``, no key), and the members ``a`` of groups above ``group`` with key and used."""

    def out(a: np.ndarray, b: np.ndarray | None, key: np.ndarray | None, used: np.ndarray | None) -> pa.RecordBatch:
        columns = [pa.nulls(len(a), pa.int64()) if c is None else pa.array(c) for c in (a, b, key, used)]
        return pa.RecordBatch.from_arrays(columns, ["a", "b", "key", "used"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3  # the last group, which may go on
        passing = None  # the key of a group that is too large to hold
        for batch in batches:
            fp, key, used = (np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns, strict=True))
            if passing is not None:
                more = int(np.searchsorted(key, passing, "right"))
                yield out(fp[:more], None, key[:more], used[:more])
                fp, key, used = fp[more:], key[more:], used[more:]
                passing = passing if not len(key) else None
            heads = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            last = int(heads[-1]) if len(heads) else 0
            sizes = np.diff(heads)
            wide = np.repeat(sizes > group, sizes)
            yield out(fp[:last][wide], None, key[:last][wide], used[:last][wide])
            small = sizes[sizes <= group]
            links = group_links(fp[:last][~wide].view(np.uint64), np.append(0, np.cumsum(small)))
            yield out(links[:, 0], links[:, 1], None, None)
            held = [fp[last:], key[last:], used[last:]]
            if len(held[0]) > group:
                passing = int(key[-1])
                yield out(held[0], None, held[1], held[2])
                held = [h[:0] for h in held]
        links = group_links(held[0].view(np.uint64), np.array([0, len(held[0])]))
        yield out(links[:, 0], links[:, 1], None, None)

    sorted_ = rows.select("fp", "key", "used").repartition("key").sortWithinPartitions("key")
    return written(sorted_.mapInArrow(found, "a long, b long, key long, used long"), "simhash-met")


def links_between(prints: DataFrame, group: int = GROUP) -> DataFrame:
    """``a, b``: links of distinct fingerprints (``fp``) that give the same components as all links.

    A group that is larger than ``group`` (64 at least) has at least as many bits left to cut as there are parts.
    """
    group = max(group, 64)
    index = prints.select("fp", F.explode(signatures(F.col("fp"))).alias("s"))
    rows = index.select("fp", F.xxhash64("s.segment", "s.part").alias("key"), F.col("s.used").alias("used"))
    links: list[DataFrame] = []
    known = {((1 << width) - 1) << low for low, width in cuts(64, SEGMENTS)}
    while True:
        met = _met(rows, group)
        links.append(met.filter("key is null").select("a", "b"))
        large = met.filter("key is not null").select("key", F.col("a").alias("fp"), "used")
        if large.isEmpty():
            return _all(links).distinct()
        large = large.join(large.groupBy("key").agg(F.min("fp").alias("pivot")), "key")
        near = F.bit_count(F.col("fp").bitwiseXOR(F.col("pivot"))) <= DISTANCE
        close = large.filter(near & (F.col("fp") != F.col("pivot"))).select(F.col("pivot").alias("a"), F.col("fp").alias("b"))
        links.append(written(close.distinct(), "simhash-links"))
        roots = written(components(_all(links)), "simhash-roots")
        large = large.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
        large = written(large.select("key", "fp", "used", "root"), "simhash-large")
        apart = large.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
        again = large.join(apart, "key").select("key", "fp", F.explode(further(F.col("fp"), F.col("used"), known)).alias("s"))
        rows = written(again.select("fp", F.xxhash64("key", "s.segment", "s.part").alias("key"), F.col("s.used").alias("used")), "simhash-rows")
        known = {mask | part for mask in known for part in further_cuts(mask)}


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def link_documents(documents: DataFrame, group: int = GROUP) -> DataFrame:
    """All rows and columns with ``fingerprint`` (long) and ``component_id``, the smallest ``doc_id`` reachable by links.

    Rows with equal fingerprints are linked, those without words among themselves (fingerprint zero) and with any other
    close to zero. Null ids are never the smallest; a component of null ids only has a null ``component_id``. Repeated
    rows stay. Columns of the same names stay beside the new ones.
    """
    return link_prints(with_fingerprints(documents), group)


def link_prints(marked: DataFrame, group: int = GROUP) -> DataFrame:
    """The same for rows that have a ``fingerprint`` as their last column; they are read twice."""
    place = marked.columns.index("doc_id")
    names = [f"c{k}" for k in range(len(marked.columns) - 1)]
    rows = marked.toDF(*names, "fp")
    prints = written(rows.groupBy("fp").agg(F.min(names[place]).alias("least")), "simhash-prints")
    roots = written(components(links_between(prints.select("fp"), group)), "simhash-roots")
    named = prints.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select(F.col("fp").alias("own"), "component_id")
    out = rows.join(named, F.col("fp") == F.col("own")).select(*names, "fp", "component_id")
    return out.toDF(*marked.columns, "component_id")
