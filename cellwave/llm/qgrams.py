"""Benchmark decontamination: texts that hold a benchmark item up to a budget of edits.

Texts and items are lower-cased and marks and white space become single spaces; lengths and edits count UTF-8
bytes of that form. An item of m bytes allows ``EDITS`` of them. By the q-gram lemma a place within e edits
shares at least m - q + 1 - q * e q-grams with the item on diagonals at most e apart, so shared q-grams are counted
in overlapping diagonal bands, bands that reach the bound are kept and a banded alignment decides.

Items are taken in blocks of ``BLOCK_BYTES``; each block's index is broadcast, which bounds it, and every document is
held against every block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwave.llm.common import slices, text_bytes

Q = 8
EDITS = 0.1
LEAST_BAND = 64
BLOCK_BYTES = 16 << 20
SLICE = 2 << 20
ALIGNED = 512
_FILTER = 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PLAIN = np.full(256, 32, np.uint8)
for _c in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    _PLAIN[_c] = _c


def normalised(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in plain form, and where each begins and the last ends."""
    data, at = text_bytes(pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), "")))
    data = _PLAIN[data]
    keep = data != 32
    if len(keep):
        keep[1:] |= keep[:-1] & (data[1:] == 32)
        # a text does not begin with the space after another's last word
        first = at[:-1][(at[:-1] < len(data))]
        keep[first] = data[first] != 32
    sums = np.append(0, np.cumsum(keep))
    return data[keep], sums[at]


def qgrams(data: np.ndarray) -> np.ndarray:
    """The ``Q`` bytes from each place on as one number."""
    x = data.astype(np.uint64)
    for step in (1, 2, 4):
        x = x[:-step] | (x[step:] << np.uint64(8 * step))
    return x


class ItemIndex:
    """The q-grams of a block of items, and how many of them a place must share."""

    def __init__(self, ids: list, texts: list[str | None]) -> None:
        data, at = normalised(pa.array(texts, pa.string()))
        sizes = np.diff(at)
        # a final space is no part of an item
        tail = np.array([s > 0 and data[e - 1] == 32 for s, e in zip(sizes, at[1:], strict=True)], bool)
        sizes = sizes - tail
        used = np.flatnonzero(sizes >= Q)
        self.ids = [ids[k] for k in used]
        self.items = [data[at[k] : at[k] + sizes[k]] for k in used]
        self.size = sizes[used]
        self.edits = np.minimum((self.size * EDITS).astype(np.int64), np.maximum(self.size - Q, 0) // Q)
        self.least = self.size - Q + 1 - Q * self.edits
        self.band = np.maximum(LEAST_BAND, 1 << np.ceil(np.log2(np.maximum(self.edits, 1))).astype(np.int64))
        grams = [qgrams(x) for x in self.items]
        flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.grams, first = np.unique(flat, return_index=True) if len(flat) else (flat, np.zeros(0, np.int64))
        sorted_flat = flat[order]
        self.first = np.searchsorted(sorted_flat, self.grams, "left")
        self.count = np.searchsorted(sorted_flat, self.grams, "right") - self.first
        self.item, self.place = item[order], place[order]
        self.filter = np.zeros(1 << _FILTER, bool)
        self.filter[self._cell(self.grams)] = True

    @staticmethod
    def _cell(grams: np.ndarray) -> np.ndarray:
        return ((grams * _MIX) >> np.uint64(64 - _FILTER)).astype(np.int64)

    def regions(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``item, diagonal``: bands, by the diagonal they begin at, with as many shared q-grams as an item asks for."""
        none = np.zeros(0, np.int64)
        if len(data) < Q or not len(self.grams):
            return none, none
        grams = qgrams(data)
        at = np.flatnonzero(self.filter[self._cell(grams)])
        slot = np.minimum(np.searchsorted(self.grams, grams[at]), len(self.grams) - 1)
        right = self.grams[slot] == grams[at]
        at, slot = at[right], slot[right]
        counts = self.count[slot]
        total = int(counts.sum())
        if not total:
            return none, none
        flat = np.arange(total) + np.repeat(self.first[slot] - np.append(0, np.cumsum(counts)[:-1]), counts)
        item = self.item[flat]
        # diagonals from 0 on: items may begin before the bytes do
        diagonal = np.repeat(at, counts) - self.place[flat] + int(self.size.max())
        width = self.band[item]
        band = diagonal // width
        near = diagonal - band * width < self.edits[item]
        item = np.concatenate([item, item[near]])
        band = np.concatenate([band, band[near] - 1])
        keys, shared = np.unique(item * (int(band.max()) + 2) + band + 1, return_counts=True)
        item, band = keys // (int(band.max()) + 2), keys % (int(band.max()) + 2) - 1
        kept = shared >= self.least[item]
        item, band = item[kept], band[kept]
        return item, band * self.band[item] - int(self.size.max())

    def distances(self, ks: np.ndarray, texts: list[np.ndarray], starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edits between items and the likest stretches of their texts in bands from the diagonals ``starts``, and their ends.

        Bands are aligned side by side, a byte of every item at a time; longer items come first, so that the
        others end before them.
        """
        sizes = self.size[ks]
        starts = starts - self.edits[ks]
        width = int((self.band[ks] + 2 * self.edits[ks] + 1).max())
        padded = np.zeros((len(ks), width + int(sizes[0])), np.uint8)  # 0 is in no plain text
        items = np.ones((len(ks), int(sizes[0])), np.uint8)
        for c, (k, text, start) in enumerate(zip(ks, texts, starts.tolist(), strict=True)):
            lo, hi = max(start, 0), min(start + padded.shape[1], len(text))
            if hi > lo:
                padded[c, lo - start : hi - start] = text[lo:hi]
            items[c, : self.size[k]] = self.items[k]
        steps = np.arange(width, dtype=np.int32)
        row = np.zeros((len(ks), width), np.int32)
        active = np.searchsorted(-sizes, -np.arange(int(sizes[0])), "left")
        for i, c in enumerate(active.tolist()):
            own = row[:c]
            # the same diagonal, then a byte of the item left out, then bytes of the text left out
            now = own + (padded[:c, i : i + width] != items[:c, i, None])
            np.minimum(now[:, :-1], own[:, 1:] + 1, out=now[:, :-1])
            now -= steps
            row[:c] = np.minimum.accumulate(now, axis=1, out=now) + steps
        best = row.argmin(1)
        ends = np.minimum(starts + best + sizes, [len(t) for t in texts])
        return row[np.arange(len(ks)), best], ends

    def leaks(self, data: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int]]:
        """``text, item, edits, end``: for each text and item within its budget the likest place."""
        item, diagonal = self.regions(data)
        first = np.maximum(np.searchsorted(at, diagonal, "right") - 1, 0)
        high = diagonal + self.band[item] + self.edits[item] + self.size[item]
        last = np.minimum(np.searchsorted(at, high, "left"), len(at) - 1)
        # a band may lie over several texts
        counts = np.maximum(last - first, 0)
        which = np.repeat(np.arange(len(item)), counts)
        text = np.arange(len(which)) + np.repeat(first - np.append(0, np.cumsum(counts)[:-1]), counts)
        order = np.argsort(-self.size[item[which]], kind="stable")
        which, text = which[order], text[order]
        found: dict[tuple[int, int], tuple[int, int]] = {}
        for start in range(0, len(which), ALIGNED):
            some, own = which[start : start + ALIGNED], text[start : start + ALIGNED]
            texts = [data[at[t] : at[t + 1]] for t in own.tolist()]
            edits, ends = self.distances(item[some], texts, diagonal[some] - at[own])
            near = np.flatnonzero(edits <= self.edits[item[some]])
            for t, k, e, end in zip(*(x[near].tolist() for x in (own, item[some], edits, ends)), strict=True):
                found[t, k] = min(found.get((t, k), (e, end)), (e, end))
        return [(t, k, *v) for (t, k), v in sorted(found.items())]


def _blocks(benchmark: DataFrame) -> Iterator[ItemIndex]:
    """Indexes of all items, each of a block of items of about ``BLOCK_BYTES``."""
    rows = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-total // BLOCK_BYTES) or 1
    for block in range(count):
        own = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == block).toArrow()
        yield ItemIndex(own["item_id"].to_pylist(), own["text"].to_pylist())


def find_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, edits, text_end`` of every document and item that it holds within the item's budget.

    ``text_end`` is where the likest place ends in the plain text. Null and empty texts hold nothing; items with
    fewer than ``Q`` plain bytes are not looked for; repeated rows and repeated items are each reported.
    """
    out = None
    for index in _blocks(benchmark):
        found = _scan(documents.select("doc_id", "text"), index, benchmark)
        out = found if out is None else out.unionByName(found)
    return out


def _scan(documents: DataFrame, index: ItemIndex, benchmark: DataFrame) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(index)
    kinds = [documents.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()]

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches, "text", SLICE):
            rows = own.leaks(*normalised(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())),
                    pa.array([own.ids[r[1]] for r in rows], pa.int64() if kinds[1] == "bigint" else None),
                    pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64()),
                ],
                ["doc_id", "item_id", "edits", "text_end"],
            )

    return documents.mapInArrow(scanned, f"doc_id {kinds[0]}, item_id {kinds[1]}, edits long, text_end long")


def keep_clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows, with all columns, that hold no item; nothing is shuffled."""
    for index in _blocks(benchmark):
        shared = documents.sparkSession.sparkContext.broadcast(index)
        place = documents.columns.index("text")

        def clean(batches: Iterator[pa.RecordBatch], shared=shared, place=place) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text", SLICE):
                keep = np.ones(batch.num_rows, bool)
                keep[[r[0] for r in shared.value.leaks(*normalised(batch.column(place)))]] = False
                yield batch.filter(pa.array(keep))

        documents = documents.mapInArrow(clean, documents.schema)
    return documents
