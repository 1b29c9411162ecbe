"""Scores of the suffix tree against brute force, and repeats of any corpus size."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from cellwave.llm import suffix_tree_lm as lm


def brute_force(texts, often, hot_tokens):
    """Log10 probabilities of ``(doc_id, text)``; next words below ``often`` and contexts above ``hot_tokens`` as the module treats them."""
    docs = [((t or "").lower().split() + [None], zlib.crc32(str(k).encode()) % 7 == 2) for k, t in texts]
    words = Counter(w for ws, held in docs if not held for w in ws)
    total, distinct = sum(words.values()), len(words)
    seen, follow, every = Counter(), Counter(), Counter()
    for ws, held in docs:
        for t in range(len(ws)):
            for k in range(1, min(lm.DEPTH, t) + 1):
                context = tuple(reversed(ws[t - k : t]))
                every[context] += 1
                if not held:
                    seen[context] += 1
                    follow[context, ws[t]] += 1
    nexts = {}
    for (context, w), n in follow.items():
        if n >= lm.LEAST:
            nexts.setdefault(context, []).append((w, n))

    def hot(context):
        return all(words[w] > hot_tokens for w in context) and all(every[context[:k]] > hot_tokens for k in range(2, len(context) + 1))

    def root(w):
        return (words[w] + 1) / (total + distinct + 1)

    def tested(context, w):
        """The parent's chance of ``w`` as the test of ``context`` takes it."""
        up = context[:-1]
        if hot(context):
            return chance(up, w)
        if not up or hot(up):
            listed = (follow[up, w] if up else words[w]) >= often
            return chance(up, w) if listed else min(1.0, often / (seen[up] if up else total))
        q, (weight, share) = tested(up, w), state(up)
        return share * follow[up, w] * (follow[up, w] >= lm.LEAST) + weight * q

    states = {}

    def state(context):
        if context not in states:
            n, found = seen[context], nexts.get(context, [])
            gain = sum(c * math.log(c / (n * tested(context, w))) - c + n * tested(context, w) for w, c in found)
            is_one = gain >= lm.LEAST_GAIN
            states[context] = ((n - sum(c for _, c in found) + lm.PRIOR) / (n + lm.PRIOR), 1 / (n + lm.PRIOR)) if is_one else (1.0, 0.0)
        return states[context]

    def chance(context, w):
        if not context:
            return root(w)
        weight, share = state(context)
        return share * follow[context, w] * (follow[context, w] >= lm.LEAST) + weight * chance(context[:-1], w)

    scores = [
        sum(math.log10(chance(tuple(reversed(ws[max(0, t - lm.DEPTH) : t])), ws[t])) for t in range(len(ws))) for ws, _ in docs
    ]
    return scores, states


def corpus():
    pick = np.random.default_rng(5)
    words = [f"w{k}" for k in range(300)]
    share = 1 / np.arange(1, 301) ** 1.1
    passages = [" ".join(pick.choice(words, 12)) for _ in range(6)] + ["w0 w1 w0 w1 w2 w0 w0"]
    texts = []
    for k in range(160):
        parts = [" ".join(pick.choice(words, pick.integers(1, 40), p=share / share.sum())) for _ in range(pick.integers(1, 4))]
        parts += [passages[i] for i in pick.integers(0, 7, pick.integers(0, 4))] + [f"once{k} Twice{k // 2}"] * (k % 2)
        texts.append((k, " ".join(parts)))
    return texts + [(200, None), (201, ""), (202, "one"), (203, "w0")]


@pytest.mark.parametrize(("share", "hot_tokens", "shard"), [(1e-6, 1 << 20, 1 << 20), (1e-6, 1 << 20, 500), (4e-3, 60, 700), (2e-3, 12, 300)])
def test_scores_are_those_of_brute_force(spark, monkeypatch, share, hot_tokens, shard):
    monkeypatch.setattr(lm, "WORD_SHARE", share)
    monkeypatch.setattr(lm, "HOT_TOKENS", hot_tokens)
    monkeypatch.setattr(lm, "SHARD_TOKENS", shard)
    texts = corpus()
    total = sum(len((t or "").split()) + 1 for k, t in texts if zlib.crc32(str(k).encode()) % 7 != 2)
    want, states = brute_force(texts, lm._often(total), hot_tokens)
    depths = Counter(len(c) for c, (_, s) in states.items() if s)
    assert all(depths[k] for k in (range(1, lm.DEPTH + 1) if share < 1e-3 else [1]))
    rows = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    marked = lm.split_mark(rows)
    hot, _ = lm.hot_contexts(marked, *lm.frequent_words(marked))
    assert len(hot.contexts) >= {1 << 20: 0, 60: 2, 12: 3}[hot_tokens]
    got = {r.doc_id: r.score for r in lm.score_documents(rows).collect()}
    assert [got[k] for k, _ in texts] == pytest.approx(want, rel=1e-6)


def test_what_occurs_twice_is_learnt_whatever_is_read(spark):
    pick = np.random.default_rng(6)
    words = np.array([f"w{k}" for k in range(20000)])
    texts = [(k, " ".join(pick.choice(words, 250))) for k in range(1600)]
    twice = [k for k in range(2000, 2040) if zlib.crc32(str(k).encode()) % 7 != 2 and zlib.crc32(str(k + 100).encode()) % 7 != 2]
    copies = {k: " ".join(pick.choice(words, 250)) for k in twice}
    texts += [(k + far, copies[k]) for k in twice for far in (0, 100)]
    got = lm.score_documents(spark.createDataFrame(texts, "doc_id long, text string").repartition(4)).collect()
    per_token = {r.doc_id: r.score / r.n_tokens for r in got}
    # over 400000 tokens; two occurrences are far less than a share of 1e-5
    assert min(per_token[k] for k in twice) > 1.0 + max(v for k, v in per_token.items() if k < 1600)
