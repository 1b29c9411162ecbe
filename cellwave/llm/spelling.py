"""Spelling variants: words one edit apart, by dynamic programming over sorted vocabulary lists.

1. Two near words agree before and after their edit. For the size ``s`` of the shorter one, words meet by what lies
   before or after half of ``s``; groups above ``GROUP`` words are cut again inside the range where the edit may be,
   so that words share more. A pair counts only in the group whose range holds its first difference, so in one.
2. Groups are packed into tasks. There, the sorted list of a group's words is scanned for all of them at once: a row of
   the edit matrix (three cells wide, as one edit allows) belongs to a word and a prefix of the list, and is computed
   once for all entries that have the prefix, from the row of the prefix one shorter. Where adjacent common prefixes
   end the list branches. A prefix that no cell reaches with one edit ends there, and its entries are skipped.
3. A word's form is its most frequent near word if that is much more frequent; pointers are doubled up to the root.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwave.llm.common import shipped, written

GROUP = 1 << 14
TASK_WORDS = 1 << 15
SCAN_WORDS = 1 << 12
RATIO = 10
_FAR = np.int8(2)


class SortedList:
    """Words in order, by group: where each branches off from those before it."""

    def __init__(self, groups: np.ndarray, words: pa.Array) -> None:
        self.sizes = pc.utf8_length(words).to_numpy().astype(np.int64)
        self.begin = np.append(0, np.cumsum(self.sizes))
        self.codes = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
        count = len(self.sizes)
        self.roots = np.maximum.accumulate(np.where(np.append(True, groups[1:] != groups[:-1]), np.arange(count), 0))
        shared = self._shared()
        # the entry from which each branches off: the last one before it that shares less with its own predecessor
        parent, last = np.zeros(count, np.int64), []
        for k, s in enumerate(shared.tolist()):
            if s < 0:
                last = []
            while last and shared[last[-1]] >= s:
                last.pop()
            parent[k] = last[-1] if last else k
            last.append(k)
        inner = np.flatnonzero(shared >= 0)
        self.width = int(self.sizes.max(initial=0)) + 1
        key = parent[inner] * self.width + shared[inner]
        order = np.argsort(key, kind="stable")
        self.keys, self.branches = key[order], inner[order]

    def _shared(self) -> np.ndarray:
        """How many codes each word shares with the one before it in its group; -1 for the first."""
        count = len(self.sizes)
        shared = np.full(count, -1)
        open_ = np.flatnonzero(self.roots != np.arange(count))
        shared[open_] = 0
        depth = 0
        while len(open_):
            open_ = open_[np.minimum(self.sizes[open_], self.sizes[open_ - 1]) > depth]
            open_ = open_[self.codes[self.begin[open_] + depth] == self.codes[self.begin[open_ - 1] + depth]]
            depth += 1
            shared[open_] = depth
        return shared

    def one_edit(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a wanted entry and another one of its group that differ by exactly one edit."""
        own, node = wanted, self.roots[wanted]
        row = [np.full(len(own), _FAR), np.zeros(len(own), np.int8), np.ones(len(own), np.int8)]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        depth = 0
        while len(own):
            # the entries of a prefix branch by their next code
            low, high = (np.searchsorted(self.keys, node * self.width + depth, side) for side in ("left", "right"))
            more = high - low
            at = np.repeat(np.arange(len(own)), more)
            step = np.arange(len(at)) - np.repeat(np.cumsum(more) - more, more)
            straight = np.flatnonzero(self.sizes[node] > depth)
            at = np.concatenate([straight, at])
            node = np.concatenate([node[straight], self.branches[low[at[len(straight) :]] + step]])
            own = own[at]
            code, size, start = self.codes[self.begin[node] + depth], self.sizes[own], self.begin[own]
            old, new, left = row, [], np.full(len(own), _FAR)
            for k in range(3):  # the cell of the word's first depth + k codes
                j = depth + k
                inside = (j >= 1) & (j <= size)
                differs = self.codes[np.where(inside, start + j - 1, 0)] != code
                cell = np.minimum(old[k][at] + differs, left + 1)
                if k < 2:
                    cell = np.minimum(cell, old[k + 1][at] + 1)
                if j == 0:
                    cell = np.full(len(own), depth + 1)
                left = np.where(inside | (j == 0), np.minimum(cell, _FAR), _FAR).astype(np.int8)
                new.append(left)
            alive = np.flatnonzero((new[0] < _FAR) | (new[1] < _FAR) | (new[2] < _FAR))
            own, node, row = own[alive], node[alive], [cells[alive] for cells in new]
            depth += 1
            gap = self.sizes[own] - depth
            cells = np.choose(np.clip(gap + 1, 0, 2), row)
            done = (self.sizes[node] == depth) & (np.abs(gap) <= 1) & (cells == 1)
            found.append((own[done], node[done]))
        return tuple(np.concatenate(side) if found else np.zeros(0, np.int64) for side in (zip(*found, strict=True) if found else ((), ())))


def _near(table: pa.Table) -> pa.Table:
    """``word, near, near_n`` for the groups of one task."""
    table = table.sort_by([("key", "ascending"), ("word", "ascending")]).combine_chunks()
    words = table["word"].combine_chunks()
    listed = SortedList(table["key"].to_numpy(), words)
    size, low, high = (table[name].to_numpy() for name in ("size", "low", "high"))
    xs, ys = [], []
    for at in range(0, len(words), SCAN_WORDS):
        x, y = listed.one_edit(np.arange(at, min(at + SCAN_WORDS, len(words))))
        first = _first_difference(listed, x, y)
        here = (first >= low[x]) & ((first < high[x]) | (high[x] == size[x])) & (np.minimum(listed.sizes[x], listed.sizes[y]) == size[x])
        xs.append(x[here])
        ys.append(y[here])
    x, y = (pa.array(np.concatenate(side) if side else np.zeros(0, np.int64)) for side in (xs, ys))
    return pa.table({"word": words.take(x), "near": words.take(y), "near_n": table["n"].combine_chunks().take(y)})


def _first_difference(listed: SortedList, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    first = np.zeros(len(x), np.int64)
    open_ = np.arange(len(x))
    while len(open_):
        open_ = open_[np.minimum(listed.sizes[x[open_]], listed.sizes[y[open_]]) > first[open_]]
        same = listed.codes[listed.begin[x[open_]] + first[open_]] == listed.codes[listed.begin[y[open_]] + first[open_]]
        open_ = open_[same]
        first[open_] += 1
    return first


def _keyed(rows: DataFrame, low: Column, high: Column) -> DataFrame:
    """Rows with the key of the range ``[low, high)``: what lies before it, and after it from the word's end."""
    before, after = F.substring("word", F.lit(1), low), F.right("word", F.col("size") - high)
    key = F.xxhash64("size", low, high, before, F.when(F.col("size") > high, after))
    return rows.select("word", "n", "size", low.alias("low"), high.alias("high"), key.alias("key"))


def near_words(words: DataFrame, group: int = GROUP) -> DataFrame:
    """``word, near, near_n`` for every two words of ``words`` (``word, n``, distinct) one edit apart, both ways."""
    sizes = F.array(F.char_length("word"), F.char_length("word") - 1)
    rows = words.select("word", F.col("n").cast("long").alias("n"), F.explode(sizes).alias("size")).filter("size > 0")
    half = F.floor(F.col("size") / 2).cast("int")
    rows = _keyed(rows, F.lit(0), half).filter("high > 0").unionByName(_keyed(rows, half, F.col("size")))
    ready = None
    while True:
        sizes = rows.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
        met = written(rows.join(sizes, "key"), "spelling-met")
        wide = (F.col("members") > group) & (F.col("high") - F.col("low") > 1)
        some = met.filter(~wide).drop("members")
        ready = some if ready is None else ready.unionByName(some)
        rows = met.filter(wide)
        if rows.isEmpty():
            break
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        rows = rows.select("word", "n", "size", "low", "high")
        rows = written(_keyed(rows, F.col("low"), middle).unionByName(_keyed(rows, middle, F.col("high"))), "spelling-cut")
    tasks = -(-ready.count() // TASK_WORDS) or 1
    task = F.pmod(F.xxhash64("key"), F.lit(tasks)).alias("task")
    return ready.groupBy(task).applyInArrow(_near, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: the last word that forms (``word, form``) lead to. Forms rise in frequency, so none lead back."""
    state = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = state.select(F.col("word").alias("at"), F.col("root").alias("next"))
        moved = state.join(ahead, F.col("root") == F.col("at"), "left")
        moved = written(moved.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        state = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return state


def group_spellings(words: DataFrame, ratio: int = RATIO, group: int = GROUP) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` for a vocabulary ``words`` (``word, n``).

    Near words differ by exactly one inserted, deleted or replaced code point. The form is the near word of largest
    ``n`` (ties: the smallest in code-point order) if that is at least ``ratio`` times the word's; ``root`` is where
    forms lead, the word itself where it has none. Rows of one word add up; null words and counts are left out, and
    the empty word is near to none. Other columns are not looked at.
    """
    shipped(words.sparkSession)
    words = words.filter("word is not null and n is not null").groupBy("word").agg(F.sum("n").cast("long").alias("n"))
    words = written(words, "spelling-words")
    best = F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near").alias("near")))
    stats = near_words(words, group).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    out = words.join(stats, "word", "left")
    fits = -F.col("best.order") >= ratio * F.col("n")
    out = out.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.order")).alias("form_n"),
    )
    out = written(out, "spelling-forms")
    led = roots(out.filter("form is not null").select("word", "form"))
    return out.join(led, "word", "left").withColumn("root", F.coalesce("root", "word"))
