"""Periodic run detection: stretches of words that repeat with a short period, and texts without the repeats.

A run of period ``q`` and length ``L`` is the maximal pair ``(s, s + q)`` of equal word strings of length ``L - q``:
they differ in the word before and in the word after. So with ``LEAST_PERIODS`` periods asked for, maximal pairs whose
distance is at most ``1 / (LEAST_PERIODS - 1)`` of their length are exactly the runs, and none has to be extended.

1. The words of a batch of texts are numbered, each text is closed by an end of its own, and suffixes are sorted by
   doubled ranks. The ranks of every round are kept; they give common prefixes of neighbours exactly.
2. Suffixes that share too little, or only with places too far away, can't be in a fitting pair and are left out.
3. The tree of LCP intervals is visited bottom-up. An interval holds its places in one ordered list in which each place
   has its left word as class. The smaller list goes into the larger one, and a place meets the neighbours it finds
   there: strings that overlap by more than half lie a period apart, so those of a run's pair are neighbours. Pairs of
   one class are not maximal to the left; pairs of one child were seen in it.

A text is searched as a whole in one task, texts are independent. Null and empty texts have no words and no runs.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cellwave.llm.common import shipped, slices

LEAST_WORDS = 6
LEAST_PERIODS = 4
SLICE_BYTES = 1 << 20
#: Suffixes that do not share their first ``2 ** FIRST_ROUND`` words with another are in no pair.
FIRST_ROUND = 2

RUN = T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")])


def split_words(column: pa.Array | pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """All words ``[^\\x20\\x09-\\x0D]+`` of a text column, and where each text's begin and the last ends."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lists = pc.ascii_split_whitespace(pc.fill_null(column.cast(pa.large_string()), ""))
    flat = lists.flatten()
    at = lists.offsets.to_numpy().astype(np.int64)
    at = at - at[0]
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    return flat.filter(pa.array(full)), np.append(0, np.cumsum(full))[at]


def doubled_ranks(key: np.ndarray) -> list[np.ndarray]:
    """Rank of each suffix by its first 1, 2, 4, ... keys, until no two are equal; no key but the ends' may end one."""
    n = len(key)
    order = np.argsort(key, kind="stable")
    heads = np.ones(n, bool)
    heads[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    open_ = order[~_alone(heads)]
    ranks = [rank]
    while len(open_):
        own, reach = rank[open_], 1 << (len(ranks) - 1)
        pair = own * n + rank[open_ + reach]
        order = np.argsort(pair, kind="stable")
        open_, own, pair = open_[order], own[order], pair[order]
        heads, outer = np.ones(len(pair), bool), np.ones(len(pair), bool)
        heads[1:], outer[1:] = pair[1:] != pair[:-1], own[1:] != own[:-1]
        place = np.arange(len(pair))
        rank = rank.copy()
        rank[open_] = own + np.maximum.accumulate(np.where(heads, place, 0)) - np.maximum.accumulate(np.where(outer, place, 0))
        ranks.append(rank)
        open_ = open_[~_alone(heads)]
    return ranks


def _alone(heads: np.ndarray) -> np.ndarray:
    """Which members of a sorted sequence are a group of one, from where groups begin."""
    return heads & np.append(heads[1:], True)


def shared_prefixes(ranks: list[np.ndarray], p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """How many keys the suffixes ``p`` and ``q`` have in common."""
    shared = np.zeros(len(p), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        shared += (ranks[k][p + shared] == ranks[k][q + shared]) * np.int64(1 << k)
    return shared


def candidate_suffixes(ranks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted suffixes that may be in a fitting pair, and what each shares with the one before."""
    none = np.zeros(0, np.int64)
    if len(ranks) <= FIRST_ROUND:
        return none, none
    group = ranks[FIRST_ROUND]
    n = len(group)
    many = np.bincount(group, minlength=n)[group] > 1
    found = np.flatnonzero(many)
    if not len(found):
        return none, none
    # distance to the next place of the same first words
    near = found[np.lexsort((found, group[found]))]
    gap = np.where(group[near[1:]] == group[near[:-1]], near[1:] - near[:-1], n)
    gaps = np.empty(n, np.int64)
    gaps[near] = np.minimum(np.append(gap, n), np.append(n, gap))
    order = found[np.argsort(ranks[-1][found], kind="stable")]
    shared = np.append(0, shared_prefixes(ranks, order[:-1], order[1:]))
    most = np.maximum(shared, np.append(shared[1:], 0))
    keep = np.flatnonzero(((LEAST_PERIODS - 1) * gaps[order] <= most) & (most + most // (LEAST_PERIODS - 1) >= LEAST_WORDS))
    if not len(keep):
        return none, none
    between = np.minimum.reduceat(shared[: keep[-1] + 1], np.append(0, keep[:-1] + 1))
    between[0] = 0
    return order[keep], between


def close_pairs(order: np.ndarray, shared: np.ndarray, left: np.ndarray) -> list[tuple[int, int, int]]:
    """``start, length, period`` of the maximal pairs of neighbours that fit, by the tree of LCP intervals."""
    found: list[tuple[int, int, int]] = []
    stack: list[tuple[int, list[int]]] = []
    left_of = dict(zip(order.tolist(), left[order].tolist(), strict=True))

    def joined(a: list[int], b: list[int], same: int) -> list[int]:
        large, small = (a, b) if len(a) >= len(b) else (b, a)
        if same + same // (LEAST_PERIODS - 1) >= LEAST_WORDS:
            for p in small:
                k = bisect_left(large, p)
                for x in large[max(k - 1, 0) : k + 1]:
                    period = abs(p - x)
                    if (LEAST_PERIODS - 1) * period <= same and same + period >= LEAST_WORDS and left_of[p] != left_of[x]:
                        found.append((min(p, x), same + period, period))
        if 8 * len(small) > len(large):
            large += small
            large.sort()
        else:
            for p in small:
                large.insert(bisect_left(large, p), p)
        return large

    last: list[int] = []
    for place, common in zip([*order.tolist(), -1], [*shared.tolist(), 0], strict=True):
        while stack and stack[-1][0] > common:
            same, own = stack.pop()
            last = joined(own, last, same)
        if common and stack and stack[-1][0] == common:
            last = joined(stack.pop()[1], last, common)
        if common:
            stack.append((common, last))
        last = [place]
    return found


def find_runs(numbers: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``text, start, length, period`` rows of all runs of texts of numbered words, in order."""
    texts = len(at) - 1
    sizes = np.diff(at)
    # every text is closed by an end of its own
    ends = at[1:] + np.arange(texts)
    text_of = np.repeat(np.arange(texts), sizes + 1)
    words = np.ones(len(text_of), bool)
    words[ends] = False
    kinds = int(numbers.max(initial=0)) + 2
    key = text_of * kinds + (kinds - 1)
    key[words] += numbers - (kinds - 1)
    order, shared = candidate_suffixes(doubled_ranks(key))
    if not len(order):
        return np.zeros((0, 4), np.int64)
    left = np.append(-1, key[:-1])
    left[at[:-1] + np.arange(texts)] = -1
    pairs = np.array(close_pairs(order, shared, left), np.int64).reshape(-1, 3)
    # a pair some periods apart spans the same stretch as the pair one period apart
    pairs = pairs[np.lexsort((pairs[:, 2], pairs[:, 1], pairs[:, 0]))]
    first = np.ones(len(pairs), bool)
    first[1:] = (pairs[1:, :2] != pairs[:-1, :2]).any(1)
    pairs = pairs[first]
    text = text_of[pairs[:, 0]]
    pairs[:, 0] -= at[text] + text
    runs = np.column_stack([text, pairs])
    return runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]


def _spread(offsets: np.ndarray) -> pa.Array:
    return pa.array(offsets.astype(np.int32))


def collapse_runs(documents: DataFrame) -> DataFrame:
    """All rows and columns with ``runs`` (``start, length, period`` in words, by start and period) and ``collapsed``.

    A run is a stretch of at least ``LEAST_WORDS`` words and ``LEAST_PERIODS`` periods that keeps its smallest period
    and can't be extended. ``collapsed`` holds the words that are in no run or in the first period of each of their
    runs, joined by one space. A null or empty text has no runs and an empty ``collapsed``. Repeated rows and rows
    that share an id are texts of their own; columns of the same names stay beside the new ones.
    """
    shipped(documents.sparkSession)
    names = [f"c{k}" for k in range(len(documents.columns))]
    text = names[documents.columns.index("text")]
    rows = documents.toDF(*names)
    schema = T.StructType([*rows.schema.fields, T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])

    def collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, SLICE_BYTES):
            words, at = split_words(batch.column(names.index(text)))
            coded = words.dictionary_encode()
            runs = find_runs(coded.indices.to_numpy().astype(np.int64), at)
            begin = at[runs[:, 0]] + runs[:, 1]
            depth = np.zeros(len(words) + 1, np.int64)
            np.add.at(depth, begin + runs[:, 3], 1)
            np.add.at(depth, begin + runs[:, 2], -1)
            kept = np.cumsum(depth)[:-1] == 0
            rest = pa.ListArray.from_arrays(_spread(np.append(0, np.cumsum(kept))[at]), words.filter(pa.array(kept)).cast(pa.string()))
            fields = [pa.array(runs[:, k]) for k in (1, 2, 3)]
            found = pa.ListArray.from_arrays(
                _spread(np.searchsorted(runs[:, 0], np.arange(batch.num_rows + 1))), pa.StructArray.from_arrays(fields, RUN.names)
            )
            yield pa.RecordBatch.from_arrays([*batch.columns, found, pc.binary_join(rest, " ")], [*names, "runs", "collapsed"])

    return rows.mapInArrow(collapsed, schema).toDF(*documents.columns, "runs", "collapsed")
