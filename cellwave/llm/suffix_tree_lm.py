"""Language-model scores from a probabilistic suffix tree over words.

Tokens are words, A-Z lower-cased, and an end after each text. A context of one to ``DEPTH`` words becomes a state of the
tree when the divergence of its next-token counts from its parent's distribution is ``LEAST_GAIN`` nats or more; counts
of ``LEAST`` or more make it, however large the input. A state gives its kept counts and, for the rest of its count and
``PRIOR`` more, its parent's distribution; the root is add-one over words. A token is scored by the longest suffix that
is a state.

1. Words are counted; those with a share of ``WORD_SHARE`` or more are broadcast with their counts, and have short ids.
2. Every position, with the words before it, moves once to a shard that its nearest word names, so the whole subtree of
   a word lies in one shard, where it is counted, tested and used. Positions move packed by block and shard.
3. A word of over ``HOT_TOKENS`` positions is hot: its positions are dealt by their two nearest words, and so on. Next
   words of hot contexts are counted in a table; a position below one gives a + b x, with x joined from that table. The
   same join brings root chances of rare words.
"""

from __future__ import annotations

import gc
import math
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwave.llm.common import dropped, slices, text_bytes, written
from cellwave.llm.words import mixed, word_hashes

WORD_SHARE = 2.5e-7
ENTRY_SHARE = 1e-5
LEAST_GAIN = 5.0
PRIOR = 1.0
HELD_OUT = (7, 2)
#: Words of a context at most, and the least count of a next word that a state keeps.
DEPTH, LEAST = 4, 2
#: Positions of a shard on average, and of one context above which its longer contexts are dealt to shards of their own.
SHARD_TOKENS = HOT_TOKENS = 1 << 19
#: Shards are filled and used in so many turns, so that only a part of the positions is on disk.
TURNS = 2
BLOCK_TOKENS, BLOCK_TEXTS = 1 << 19, 1 << 15
#: Ids of rare words begin here; below are ranks of the frequent ones.
RARE = 1 << 24
MERGE = 2 << 20
#: Arrays over the bytes and tokens of a slice take some 60 times its size.
SLICE_BYTES = 1 << 20
END = mixed(np.array([0x5BD1E9955BD1E995], np.uint64))[0]


def tokens_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each with its end, and where each text's tokens begin and the last end."""
    words, cuts = word_hashes(data, at)
    texts = len(at) - 1
    starts = cuts + np.arange(texts + 1)
    out = np.full(len(words) + texts, END, np.uint64)
    of = np.repeat(np.arange(texts), np.diff(cuts))
    out[np.arange(len(words)) + of] = words
    return out, starts


class Tally:
    """Counts by number, merged now and then so that memory follows the distinct ones."""

    def __init__(self) -> None:
        self.keys, self.counts, self.held = [], [], 0

    def add(self, keys: np.ndarray) -> None:
        own, counts = np.unique(keys, return_counts=True)
        self.keys.append(own)
        self.counts.append(counts)
        self.held += len(own)
        if self.held > MERGE:
            self.merge()
            self.held = 0

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, back = np.unique(np.concatenate(self.keys), return_inverse=True)
        counts = np.bincount(back, np.concatenate(self.counts), len(keys)).astype(np.int64)
        self.keys, self.counts = [keys], [counts]
        return keys, counts


def tallied(batches: Iterator[pa.RecordBatch], keys_of) -> Iterator[pa.RecordBatch]:
    """``key, n`` of all texts of a task; ``keys_of`` gives the keys of a slice."""
    tally = Tally()
    for batch in slices(batches, "text", SLICE_BYTES):
        tally.add(keys_of(*tokens_of(*text_bytes(batch.column(0)))))
    keys, counts = tally.merge()
    for k in range(0, len(keys), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + (1 << 16)]), pa.array(counts[k : k + (1 << 16)])], ["key", "n"])


def _counted(training: DataFrame, keys_of) -> DataFrame:
    """``key, n`` summed over all training documents."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return tallied(batches, keys_of)

    return training.select("text").mapInArrow(counted, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _lookup(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key in an ascending table, -1 where it is not there."""
    if not len(table):
        return np.full(len(keys), -1)
    slot = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[slot] == keys, slot, -1)


class SuffixTree:
    """Frequent words, kept pairs and triples, and the states that the divergence test left."""

    def __init__(self, total: int, distinct: int, words: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(words)
        self.total, self.distinct = total, distinct
        self.words, self.counts = words[order], counts[order]
        self.least = max(2, math.ceil(ENTRY_SHARE * total))
        by_count = np.argsort(-self.counts, kind="stable")
        self.rank, self.ranked = np.empty_like(by_count), self.counts[by_count]
        self.rank[by_count] = np.arange(len(by_count))
        # words that may stand in kept counts have a short number
        able = np.flatnonzero(self.counts >= self.least)
        self.short = np.full(len(self.words) + 1, -1)
        self.short[able] = np.arange(len(able))
        self.able = able
        self.count_of = self.counts[able]
        end = _lookup(self.words, np.array([END]).view(np.int64))[0]
        self.end = int(self.short[end]) if end >= 0 else -1
        self.pairs = self.triples = np.zeros(0, np.int64)
        self.pair_counts = self.triple_counts = np.zeros(0, np.int64)
        self.weight1 = self.weight2 = None

    def root(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 1.0) / (self.total + self.distinct + 1.0)

    def _numbers(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = _lookup(self.words, tokens.view(np.int64))
        return place, self.short[place]

    def pair_keys(self, tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Pairs of able words, each as one number, by the place of the second; -1 for others."""
        _, own = self._numbers(tokens)
        before = np.append(-1, own[:-1])
        before[starts[:-1]] = -1
        return np.where((own >= 0) & (before >= 0), before * len(self.able) + own, -1)

    def triple_keys(self, tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Triples whose two pairs are kept: the place of the first pair and the last word as one number."""
        _, own = self._numbers(tokens)
        pair = _lookup(self.pairs, self.pair_keys(tokens, starts))
        before = np.append(-1, pair[:-1])
        before[starts[:-1]] = -1
        return np.where((pair >= 0) & (before >= 0), before * len(self.able) + own, -1)

    def keep_pairs(self, keys: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(keys)
        self.pairs, self.pair_counts = keys[order], counts[order]

    def keep_triples(self, keys: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(keys)
        self.triples, self.triple_counts = keys[order], counts[order]

    def grow(self) -> None:
        """States by the divergence of kept counts: each kept count adds c ln(c / (n q)) - c + n q, which is never below 0."""
        size = len(self.able)
        first, second = self.pairs // max(size, 1), self.pairs % max(size, 1)
        held = self.count_of[first] if len(first) else np.zeros(0)
        self.total1 = self.count_of.astype(float)
        self.weight1, self.share1 = self._states(
            size, first, held, self.pair_counts, self.root(self.count_of[second]) if len(second) else np.zeros(0), self.total1
        )
        context, last = self.triples // max(size, 1), self.triples % max(size, 1)
        self.total2 = self.pair_counts.astype(float)
        if len(context):
            middle = second[context]
            parent = self._one(middle, last, self.root(self.count_of[last]))
            held = self.total2[context]
        else:
            parent = held = np.zeros(0)
        self.weight2, self.share2 = self._states(len(self.pairs), context, held, self.triple_counts, parent, self.total2)

    @staticmethod
    def _states(size, context, held, counts, parent, totals) -> tuple[np.ndarray, np.ndarray]:
        gain = counts * np.log(np.maximum(counts, 1) / np.maximum(held * parent, 1e-300)) - counts + held * parent
        gains = np.bincount(context, gain, size) if size else np.zeros(0)
        kept = np.bincount(context, counts, size) if size else np.zeros(0)
        # the parent's weight is 1 where there is no state
        weight = np.where(gains >= LEAST_GAIN, (totals - kept + PRIOR) / (totals + PRIOR), 1.0)
        share = np.where(gains >= LEAST_GAIN, 1.0 / (totals + PRIOR), 0.0)
        return weight, share

    def _one(self, before: np.ndarray, own: np.ndarray, root: np.ndarray) -> np.ndarray:
        """Probability after one word; ``before`` -1: no context, ``own`` -1: in no kept count."""
        there = before >= 0
        pair = _lookup(self.pairs, np.where(there & (own >= 0), before * len(self.able) + own, -1))
        counts = np.where(pair >= 0, np.append(self.pair_counts, 0)[pair], 0)
        weight = np.where(there, np.append(self.weight1, 1.0)[before], 1.0)
        share = np.where(there, np.append(self.share1, 0.0)[before], 0.0)
        return counts * share + weight * root

    def score(self, tokens: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``place, base, model``: the frequent word or -1, and log10 probabilities.

        For a rare word ``base`` is 0 and ``model`` the weight before its root probability.
        """
        place, own = self._numbers(tokens)
        known = place >= 0
        root = np.where(known, self.root(np.append(self.counts, 0)[place]), 1.0)
        before = np.append(-1, own[:-1])
        before[starts[:-1]] = -1
        one = self._one(before, own, root)
        pair = _lookup(self.pairs, self.pair_keys(tokens, starts))
        context = np.append(-1, pair[:-1])
        context[starts[:-1]] = -1
        there = context >= 0
        triple = _lookup(self.triples, np.where(there & (own >= 0), context * len(self.able) + own, -1))
        counts = np.where(triple >= 0, np.append(self.triple_counts, 0)[triple], 0)
        weight = np.where(there, np.append(self.weight2, 1.0)[context], 1.0)
        share = np.where(there, np.append(self.share2, 0.0)[context], 0.0)
        return place, np.log10(root), np.log10(counts * share + weight * one)


def split_mark(documents: DataFrame) -> DataFrame:
    """``doc_id, text, held_out``; a null id counts as an empty one."""
    by, rest = HELD_OUT
    mark = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % by == rest
    return documents.select("doc_id", "text", mark.alias("held_out"))


def frequent_words(rows: DataFrame) -> tuple[SuffixTree, DataFrame]:
    """A tree that has words alone, and ``key, n`` of all training tokens."""
    vocabulary = written(_counted(rows.filter("not held_out"), lambda tokens, starts: tokens.view(np.int64)), "lm-words")
    total, distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    often = vocabulary.filter(F.col("n") >= _often(total)).toArrow()
    return SuffixTree(total, distinct, often["key"].to_numpy(), often["n"].to_numpy()), vocabulary


def _often(total: int) -> int:
    return max(1, math.ceil(WORD_SHARE * total))


def _hot(total: int) -> int:
    """Positions of a context that is not yet hot: on smaller tables a share, so that as much is hot there."""
    return min(HOT_TOKENS, max(total // 256, 4096))


def fit(rows: DataFrame) -> tuple[SuffixTree, DataFrame]:
    """The tree of frequent contexts of one or two words alone, and ``key, n`` of all training tokens.

    On small tables, where ``ENTRY_SHARE`` leaves nothing out, it holds what ``score_documents`` gives at a depth of two.
    """
    training = rows.filter("not held_out")
    tree, vocabulary = frequent_words(rows)
    for keys_of, keep in ((tree.pair_keys, tree.keep_pairs), (tree.triple_keys, tree.keep_triples)):

        def kept_keys(tokens: np.ndarray, starts: np.ndarray, keys_of=keys_of) -> np.ndarray:
            keys = keys_of(tokens, starts)
            return keys[keys >= 0]

        found = _counted(training, kept_keys).filter(F.col("n") >= tree.least).toArrow()
        keep(found["key"].to_numpy(), found["n"].to_numpy())
    tree.grow()
    return tree, vocabulary


class Hot:
    """Contexts of over ``_hot`` positions by length, and the frequent next words after them.

    A context is hot only if all its shorter ones are. There are few: all tokens over that number, of each length.
    """

    def __init__(self, least: int) -> None:
        #: Words and next words of fewer training tokens are not listed.
        self.least = least
        self.contexts: list[np.ndarray] = []
        self.totals: list[np.ndarray] = []
        self.keys, self.chances = np.zeros(0, np.int64), np.zeros(0)

    def add(self, contexts: np.ndarray, totals: np.ndarray) -> None:
        order = np.argsort(contexts)
        self.contexts.append(contexts[order])
        self.totals.append(totals[order])

    def near(self, keys: np.ndarray, chances: np.ndarray) -> None:
        keys, chances = np.append(self.keys, keys), np.append(self.chances, chances)
        order = np.argsort(keys)
        self.keys, self.chances = keys[order], chances[order]


def _longer(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of contexts with one more word before them."""
    return mixed(context * np.uint64(3) + word.view(np.uint64) + np.uint64(1))


def _entry(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of a context and the word after it."""
    return mixed(context * np.uint64(5) + mixed(word.view(np.uint64) + np.uint64(7)) * np.uint64(0x9E3779B97F4A7C15))


def word_ids(tree: SuffixTree, tokens: np.ndarray) -> np.ndarray:
    place = _lookup(tree.words, tokens.view(np.int64))
    return np.where(place >= 0, np.append(tree.rank, 0)[place], RARE + (tokens >> np.uint64(24)).astype(np.int64))


def places_in(starts: np.ndarray) -> np.ndarray:
    """The place of each token in its text."""
    return np.arange(starts[-1]) - np.repeat(starts[:-1], np.diff(starts))


def before(ids: np.ndarray, place: np.ndarray, far: int) -> np.ndarray:
    """The id ``far`` places earlier in the same text, -1 before its first."""
    out = np.full(len(ids), -1)
    out[far:] = ids[:-far]
    out[place < far] = -1
    return out


def hot_depth(hot: Hot, ids: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length of the shortest context that is not hot, and its hash; one more than ``DEPTH`` where all are."""
    context = np.zeros(len(ids), np.uint64)
    level, at = np.ones(len(ids), np.int64), np.arange(len(ids))
    for k in range(1, DEPTH + 1):
        context[at] = _longer(context[at], before(ids, place, k)[at])
        if k > len(hot.contexts):
            break
        at = at[_lookup(hot.contexts[k - 1], context[at].view(np.int64)) >= 0]
        level[at] += 1
    return level, context


def hot_contexts(rows: DataFrame, tree: SuffixTree, vocabulary: DataFrame) -> tuple[Hot, DataFrame]:
    """``Hot``, and ``key, p, root`` by which positions after a hot context, or with a rare word, find what is above them.

    Level by level: next words of the hot contexts of one length are counted, joined with their chances after the
    shorter context, and tested as states; counts of the contexts a word longer tell which of those are hot.
    """
    hot, spark = Hot(_often(tree.total)), rows.sparkSession
    root = (F.col("n") + 1.0) / (tree.total + tree.distinct + 1.0)
    above = vocabulary.select("key", root.alias("p"), root.alias("root"))
    chances = above
    most = _hot(tree.total)
    words = int((tree.ranked > most).sum())
    found = np.sort(_longer(np.zeros(words, np.uint64), np.arange(words)).view(np.int64))
    for k in range(1, DEPTH + 1):
        if not len(found):
            break
        shared = spark.sparkContext.broadcast((tree, found, words))

        def counted(batches: Iterator[pa.RecordBatch], shared=shared, k=k) -> Iterator[pa.RecordBatch]:
            tree, found, words = shared.value
            for batch in slices(batches, "text", SLICE_BYTES):
                tokens, starts = tokens_of(*text_bytes(batch.column(0)))
                ids, held = word_ids(tree, tokens), batch.column(1).to_numpy(zero_copy_only=False)
                train = np.repeat(~held, np.diff(starts)).astype(np.int64)
                place = places_in(starts)
                near = before(ids, place, 1)
                at = np.flatnonzero((near >= 0) & (near < words) & (place >= k))  # hot words have the first ranks
                parent, own = None, _longer(np.zeros(len(at), np.uint64), near[at])
                for j in range(2, k + 1):
                    parent, own = own, _longer(own, before(ids, place, j)[at])
                some = _lookup(found, own.view(np.int64)) >= 0
                at, own = at[some], own[some]
                w = ids[at]
                up = tokens[at] if k == 1 else _entry(parent[some], w)
                keys, first, back = np.unique(_entry(own, w), return_index=True, return_inverse=True)
                n = np.bincount(back, train[at], len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x.view(np.int64)) for x in (keys, up[first], own[first], n)] + [pa.array(np.full(len(keys), True))],
                    ["key", "up", "context", "n", "entry"],
                )
                if k < DEPTH:
                    # a word that is not hot makes no context hot
                    far = before(ids, place, k + 1)[at]
                    keys, n = np.unique(_longer(own, far)[(far >= 0) & (far < words)], return_counts=True)
                    none = pa.nulls(len(keys), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys.view(np.int64)), none, none, pa.array(n), pa.array(np.full(len(keys), False))],
                        ["key", "up", "context", "n", "entry"],
                    )

        tally = rows.select("text", "held_out").mapInArrow(counted, "key long, up long, context long, n long, entry boolean")
        tally = written(
            tally.groupBy("key", "entry").agg(F.sum("n").alias("n"), F.first("up").alias("up"), F.first("context").alias("context"))
            .filter(F.col("entry") | (F.col("n") > most)), "lm-hot",
        )
        entries = tally.filter("entry").select("key", "up", "context", "n")
        nothing = 1.0 / (tree.total + tree.distinct + 1.0)
        joined = entries.join(above.withColumnsRenamed({"key": "up", "p": "q"}), "up", "left").select(
            "key", "context", "n", F.coalesce("q", F.lit(nothing)).alias("q"), F.coalesce("root", F.lit(nothing)).alias("root")
        )
        totals = F.broadcast(entries.groupBy("context").agg(F.sum("n").alias("total")))
        joined = written(joined.join(totals, "context"), "lm-hot-entries")
        c, mass = F.col("n"), F.col("total") * F.col("q")
        kept = F.when(c >= LEAST, c).otherwise(0)
        gain = F.when(c >= LEAST, c * F.log(c / mass) - c + mass).otherwise(0.0)
        states = joined.groupBy("context").agg(F.first("total").alias("total"), F.sum(kept).alias("kept"), F.sum(gain).alias("gain"))
        states = written(states, "lm-hot-states")  # one row a hot context
        state, size = F.col("gain") >= LEAST_GAIN, F.col("total") + PRIOR
        weights = states.select(
            "context", F.when(state, (size - F.col("kept")) / size).otherwise(1.0).alias("weight"), F.when(state, 1 / size).otherwise(0.0).alias("share")
        )
        above = joined.join(F.broadcast(weights), "context").select("key", "n", (kept * F.col("share") + F.col("weight") * F.col("q")).alias("p"), "root")
        above = written(above, "lm-hot-chances")
        table = states.toArrow()
        hot.add(table["context"].to_numpy(), table["total"].to_numpy())
        near = above.filter(F.col("n") >= hot.least).toArrow()
        hot.near(near["key"].to_numpy(), near["p"].to_numpy())
        above = above.drop("n")
        chances = chances.unionByName(above)
        found = np.sort(tally.filter("not entry").toArrow()["key"].to_numpy())
        dropped(tally, joined)
    return hot, chances


def _planes(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each number, all first ones first."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


class _Reader:
    def __init__(self, body: bytes) -> None:
        self.body, self.at = np.frombuffer(body, np.uint8), 0

    def numbers(self, count: int, width: int) -> np.ndarray:
        out = np.zeros((count, 8), np.uint8)
        out[:, :width] = self.body[self.at : self.at + count * width].reshape(width, count).T
        self.at += count * width
        return out.reshape(-1).view("<i8")

    def ids(self, count: int) -> np.ndarray:
        code = self.numbers(count, 3)
        rare = code == 0
        out = code - 2
        out[rare] = RARE + self.numbers(int(rare.sum()), 5)
        return out


def _packed_ids(x: np.ndarray) -> bytes:
    rare = x >= RARE
    return _planes(np.where(rare, 0, x + 2), 3) + _planes(x[rare] - RARE, 5)


def pieces_of(
    tree: SuffixTree, hot: Hot, shards: int, turn: int, tokens: np.ndarray, starts: np.ndarray, held: np.ndarray
) -> Iterator[tuple[int, int, bytes]]:
    """``shard, n, body`` of the positions of a block that have a context, packed by the shards of a turn.

    Bodies have ``DEPTH`` words before each position.
    """
    ids, place = word_ids(tree, tokens), places_in(starts)
    level, context = hot_depth(hot, ids, place)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    # positions whose contexts are all hot need no shard of theirs
    deal = np.where(level > DEPTH, np.arange(len(ids)).astype(np.uint64), context)
    shard = (mixed(deal) % np.uint64(shards)).astype(np.int64)
    near = before(ids, place, 1)
    order = np.flatnonzero((near >= 0) & (shard % TURNS == turn))
    order = order[np.argsort(shard[order] << 42 | near[order], kind="stable")]
    cuts = np.flatnonzero(np.diff(shard[order], prepend=-1, append=shards))
    text = text + np.where(held, 0, BLOCK_TEXTS)[text]
    others = [before(ids, place, k) for k in range(2, DEPTH + 1)]
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        at = order[a:b]
        own = ids[at]
        body = _planes(text[at], 2) + _planes(level[at], 1) + _packed_ids(own) + _planes(tokens[at][own >= RARE], 3)
        # equal words follow each other
        body += _packed_ids(near[at]) + b"".join(_packed_ids(x[at]) for x in others)
        yield int(shard[at[0]]), len(at), np.array([len(body)], "<u4").tobytes() + pa.compress(body, codec="zstd", asbytes=True)


def _unpacked(n: int, body: bytes) -> list[np.ndarray]:
    """``text, level, id, token`` and the words before, nearest first."""
    read = _Reader(pa.decompress(body[4:], int(np.frombuffer(body[:4], "<u4")[0]), codec="zstd", asbytes=True))
    text, level, own = read.numbers(n, 2), read.numbers(n, 1), read.ids(n)
    rare = own >= RARE
    token = np.zeros(n, np.int64)
    token[rare] = (own[rare] - RARE) << 24 | read.numbers(int(rare.sum()), 3)
    return [text, level.astype(np.int8), own, token, *(read.ids(n) for _ in range(DEPTH))]


def score_positions(tree: SuffixTree, hot: Hot, train: np.ndarray, level: np.ndarray, own: np.ndarray, token: np.ndarray, words: list[np.ndarray]):
    """``a, b, known, key``: a position's chance is a + b times its chance after the longest hot context.

    That one is ``known`` and in a, or found by ``key``. States are tested from the shortest context on; where a chance
    is not known the test takes the most that an unlisted word can have.
    """
    n, least = len(own), hot.least
    key, known, start, limit = token.copy(), own < RARE, np.zeros(n), np.full(n, min(1.0, least / max(tree.total, 1)))
    start[known] = tree.root(tree.ranked[own[known]])
    context = np.zeros(n, np.uint64)
    for k in range(1, DEPTH + 1):
        at = np.flatnonzero(level > k)
        if not len(at):
            break
        context[at] = _longer(context[at], words[k - 1][at])
        deep = at[level[at] == k + 1]
        key[deep] = _entry(context[deep], own[deep]).view(np.int64)
        place = _lookup(hot.keys, key[deep])
        known[deep] = place >= 0
        start[deep] = np.append(hot.chances, 0.0)[place]
        place = _lookup(hot.contexts[k - 1], context[deep].view(np.int64))
        limit[deep] = np.minimum(1.0, least / np.maximum(hot.totals[k - 1][place], 1))
    a, b, test = np.where(known, start, 0.0), np.where(known, 0.0, 1.0), np.where(known, start, limit)
    alive, context[:] = np.ones(n, bool), 0
    for k in range(1, DEPTH + 1):
        alive &= words[k - 1] >= 0
        every = np.flatnonzero(alive)
        context[every] = _longer(context[every], words[k - 1][every])
        at = every[level[every] <= k]
        if not len(at):
            continue
        contexts, of = np.unique(context[at], return_inverse=True)
        total = np.bincount(of, train[at], len(contexts))
        entries, back = np.unique(_entry(context[at], own[at]), return_inverse=True)
        count, first = np.bincount(back, train[at], len(entries)), np.empty(len(entries), np.int64)
        first[back] = np.arange(len(at))
        kept = np.flatnonzero(count >= LEAST)
        c, where = count[kept], of[first[kept]]
        mass = total[where] * test[at[first[kept]]]
        gain = np.bincount(where, c * np.log(c / np.maximum(mass, 1e-300)) - c + mass, len(contexts))
        held = np.bincount(where, c, len(contexts))
        state = gain >= LEAST_GAIN
        share = np.where(state, 1.0 / (total + PRIOR), 0.0)[of]
        weight = np.where(state, (total - held + PRIOR) / (total + PRIOR), 1.0)[of]
        share *= np.where(count >= LEAST, count, 0.0)[back]
        a[at], b[at], test[at] = share + weight * a[at], weight * b[at], share + weight * test[at]
        # a context without a repeated next word has none in any longer one
        alive[at[held[of] == 0]] = False
    return a, b, known, key


def context_terms(rows: DataFrame, tree: SuffixTree, hot: Hot) -> DataFrame:
    """Log10 chances of all positions after a word.

    By block and shard ``block, texts, sums``; and ``row, key, a, b, rare`` of positions that must still be joined. A rare
    word's root chance is left out of the sums.
    """
    shared = rows.sparkSession.sparkContext.broadcast((tree, hot))
    shards = tree.total * 7 // 6 // SHARD_TOKENS + 1

    def cut(batches: Iterator[pa.RecordBatch], turn: int) -> Iterator[pa.RecordBatch]:
        (tree, hot), part, count = shared.value, TaskContext.get().partitionId(), 0
        parts, held, texts = [], [], 0

        def block() -> pa.RecordBatch:
            tokens = np.concatenate([t for t, _ in parts])
            shift = np.cumsum([0, *(len(t) for t, _ in parts)])
            starts = np.append(np.concatenate([s[:-1] + o for (_, s), o in zip(parts, shift[:-1], strict=True)]), len(tokens))
            found = list(pieces_of(tree, hot, shards, turn, tokens, starts, np.concatenate(held)))
            first = np.full(len(found), (part << 40) + count - texts)
            columns = ([x[0] for x in found], [x[1] for x in found], [x[2] for x in found])
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int32()), pa.array(first, pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary())],
                ["shard", "block", "n", "body"],
            )

        for batch in slices(batches, "text", SLICE_BYTES):
            for small in (batch.slice(k, BLOCK_TEXTS // 2) for k in range(0, batch.num_rows, BLOCK_TEXTS // 2)):
                parts.append(tokens_of(*text_bytes(small.column(0))))
                held.append(small.column(1).to_numpy(zero_copy_only=False))
                texts += small.num_rows
                count += small.num_rows
                if texts >= BLOCK_TEXTS // 2 or sum(len(t) for t, _ in parts) >= BLOCK_TOKENS:
                    yield block()
                    parts, held, texts = [], [], 0
        if parts:
            yield block()

    def scored(table: pa.Table) -> pa.Table:
        tree, hot = shared.value
        ns, blocks = table["n"].to_numpy(), table["block"].to_numpy()
        text, level, own, token, *words = (np.empty(int(ns.sum()), np.int8 if k == 1 else np.int64) for k in range(4 + DEPTH))
        into = np.cumsum([0, *ns.tolist()])
        for start, n, body in zip(into.tolist(), ns.tolist(), table["body"], strict=False):
            for whole, piece in zip((text, level, own, token, *words), _unpacked(n, body.as_py()), strict=True):
                whole[start : start + n] = piece
        train = (text >= BLOCK_TEXTS).astype(np.float64)
        a, b, known, key = score_positions(tree, hot, train, level, own, token, words)
        # a rare word's own root chance is added with those of its text
        plain = known | ((level == 1) & (a == 0.0))
        late = np.flatnonzero(~plain)
        term = np.where(plain, np.log10(np.where(known, a, b)), 0.0)
        text %= BLOCK_TEXTS
        at, piece = np.repeat(blocks, ns) + text, np.repeat(np.arange(len(ns)), ns)
        places, back = np.unique(piece.astype(np.int64) * BLOCK_TEXTS + text, return_inverse=True)
        sums = np.bincount(back, term, len(places)).astype(np.float32)
        ends = np.searchsorted(places, np.arange(len(ns) + 1) * BLOCK_TEXTS).astype(np.int32)
        some = len(late)
        rare = own[late] >= RARE
        return pa.table({
            "block": pa.concat_arrays([pa.array(blocks), pa.nulls(some, pa.int64())]),
            "texts": pa.concat_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array((places % BLOCK_TEXTS).astype(np.int16))), pa.nulls(some, pa.list_(pa.int16()))]),
            "sums": pa.concat_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(sums)), pa.nulls(some, pa.list_(pa.float32()))]),
            "row": pa.concat_arrays([pa.nulls(len(ns), pa.int64()), pa.array(at[late])]),
            "key": pa.concat_arrays([pa.nulls(len(ns), pa.int64()), pa.array(key[late])]),
            "a": pa.concat_arrays([pa.nulls(len(ns), pa.float64()), pa.array(a[late])]),
            "b": pa.concat_arrays([pa.nulls(len(ns), pa.float64()), pa.array(b[late])]),
            "rare": pa.concat_arrays([pa.nulls(len(ns), pa.bool_()), pa.array(rare)]),
        })

    kinds = "block long, texts array<short>, sums array<float>, row long, key long, a double, b double, rare boolean"
    terms = None
    for turn in range(min(TURNS, shards)):
        pieces = rows.select("text", "held_out").mapInArrow(lambda batches, turn=turn: cut(batches, turn), "shard int, block long, n int, body binary")
        found = written(pieces.groupBy("shard").applyInArrow(scored, kinds), "lm-terms")
        terms = terms.unionByName(found) if terms else found
        del pieces
        _swept(rows)
    return terms


def _swept(rows: DataFrame) -> None:
    """Lets Spark remove the shuffle files of jobs that are over; its cleaner runs beside."""
    for _ in range(2):
        gc.collect()
        rows.sparkSession._jvm.System.gc()
        time.sleep(0.5)


def _block_sums(table: pa.Table) -> pa.Table:
    texts = table["texts"].combine_chunks().flatten().to_numpy()
    sums = np.bincount(texts, table["sums"].combine_chunks().flatten().to_numpy())
    some = np.flatnonzero(np.bincount(texts))
    return pa.table({"row": table["block"][0].as_py() + some, "model": sums[some]})


def score_documents(documents: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    A null text is empty and has its end alone. Repeated rows are scored, and learnt from, each by itself. Rows are
    numbered in two passes, so ``documents`` has to give each partition in the same order again, as files do.
    """
    rows = split_mark(documents)
    tree, vocabulary = frequent_words(rows)
    hot, chances = hot_contexts(rows, tree, vocabulary)
    _swept(rows)
    terms = context_terms(rows, tree, hot)
    shared = rows.sparkSession.sparkContext.broadcast(tree)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, count = shared.value, TaskContext.get().partitionId(), 0
        for batch in slices(batches, "text", SLICE_BYTES):
            tokens, starts = tokens_of(*text_bytes(batch.column(1)))
            place = _lookup(own.words, tokens.view(np.int64))
            known = place >= 0
            base = np.log10(np.where(known, own.root(np.append(own.counts, 0)[place]), 1.0))
            heads = starts[:-1]
            rare = np.flatnonzero(~known)
            ends = np.searchsorted(rare, starts).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((part << 40) + count + np.arange(batch.num_rows)), batch.column(0), batch.column(2),
                    pa.array(np.diff(starts)), pa.array(np.add.reduceat(known.astype(np.int64), heads)),
                    pa.array(np.add.reduceat(base, heads)), pa.array(base[heads]),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(tokens[rare].view(np.int64))),
                ],
                ["row", "doc_id", "held_out", "n_tokens", "n_often", "base", "model", "rare"],
            )
            count += batch.num_rows

    out = rows.mapInArrow(
        scored,
        f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_often long, base double, model double, rare array<long>",
    )
    out = written(out, "lm-scored")
    nothing = F.lit(1.0 / (tree.total + tree.distinct + 1.0))
    words = out.select("row", F.explode("rare").alias("key")).join(vocabulary, "key", "left")
    chance = F.log10((F.coalesce("n", F.lit(0)) + 1.0) / (tree.total + tree.distinct + 1.0))
    words = words.groupBy("row").agg(F.sum(chance).alias("rare_score"), F.count("n").alias("n_rare"), F.lit(0.0).alias("model_more"))
    late = terms.filter("row is not null").join(chances, "key", "left")
    late_term = F.log10(F.col("a") + F.col("b") * F.coalesce("p", nothing)) - F.when(F.col("rare"), F.log10(F.coalesce("root", nothing))).otherwise(0.0)
    late = late.select("row", late_term.alias("model"))
    sums = terms.filter("row is null").select("block", "texts", "sums").groupBy("block").applyInArrow(_block_sums, "row long, model double")
    more = late.unionByName(sums).groupBy("row").agg(F.sum("model").alias("model_more"))
    more = more.select("row", F.lit(0.0).alias("rare_score"), F.lit(0).cast("long").alias("n_rare"), "model_more").unionByName(words)
    more = more.groupBy("row").agg(F.sum("rare_score").alias("rare_score"), F.sum("n_rare").alias("n_rare"), F.sum("model_more").alias("model_more"))
    rare = F.coalesce("rare_score", F.lit(0.0))
    return out.join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_often") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(tree.total).cast("long").alias("train_tokens"), (F.col("base") + rare).alias("base_score"),
        (F.col("model") + F.coalesce("model_more", F.lit(0.0)) + rare).alias("score"),
    )
