"""Periodic runs, spelling variants and SimHash links against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from conftest_rows import odd_rows
from hypothesis import given, settings
from hypothesis import strategies as st

from cellwave.llm import periodic_runs, simhash_links, spelling, workload

FOLDER = "/root/testdata/sf0.001"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def texts_of(folder):
    import pyarrow.parquet as pq

    table = pq.read_table(f"{folder}/documents.parquet")
    return list(zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), strict=True))


# ---- periodic runs


def plain_runs(w):
    out, n = [], len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            size = i - s + q
            part = w[s : s + size]
            if size >= max(6, 4 * q) and not any(part[:-p] == part[p:] for p in range(1, q)):
                out.append((s, size, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapsed(w, runs):
    gone = {k for s, size, q in runs for k in range(s + q, s + size)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def numbered(texts):
    return np.array([x for t in texts for x in t], np.int64), np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=50), max_size=4), st.integers(0, 30), st.integers(1, 6))
def test_runs_are_those_of_brute_force(texts, a, p):
    texts = [[x if i < a or a + (i - a) % p >= len(t) else t[a + (i - a) % p] for i, x in enumerate(t)] for t in texts]
    got = periodic_runs.find_runs(*numbered(texts))
    assert [tuple(r) for r in got.tolist()] == [(k, *r) for k, t in enumerate(texts) for r in plain_runs(t)]


def test_long_and_regular_texts():
    fibonacci, after = [0], [0, 1]
    while len(after) < 3000:
        fibonacci, after = after, after + fibonacci
    thue = [k.bit_count() & 1 for k in range(2048)]
    laughs = [x for k in range(300) for x in (k + 9, 7, 7, 7, 7, 7, 7)]
    for text in ([3] * 40000, [1, 2] * 20000):
        assert [tuple(r) for r in periodic_runs.find_runs(*numbered([text])).tolist()] == [(0, 0, len(text), len(set(text)))]
    for text in (after, thue, laughs, after * 5):
        got = periodic_runs.find_runs(*numbered([text]))
        assert [tuple(r[1:]) for r in got.tolist()] == plain_runs(text)


def test_collapsed_texts(spark, odd, clashing, empty):
    want = Counter()
    for doc, text, *_ in odd_rows():
        w = words_of(text)
        runs = plain_runs(w) if len(w) < 9000 else []
        if text and text.startswith("x x"):
            runs = [(0, 4000, 1)]
        want[doc, plain_collapsed(w, runs), tuple(runs)] += 1
    for docs in (odd, clashing.withColumn("runs", clashing.doc_id).withColumn("collapsed", clashing.text)):
        got = periodic_runs.collapse_runs(docs)
        assert got.columns == [*docs.columns, "runs", "collapsed"]
        names = [f"c{k}" for k in range(len(got.columns))]
        rows = got.toDF(*names).collect()
        assert Counter((r[0], r[-1], tuple(tuple(x) for x in r[-2])) for r in rows) == want
    assert periodic_runs.collapse_runs(empty).collect() == []


@pytest.mark.parametrize("folder", [FOLDER])
def test_op11(spark, folder):
    got = {r.doc_id: r for r in workload.op11_periodic_runs(spark, folder).collect()}
    docs = texts_of(folder)
    assert len(got) == len(docs)
    planted = 0
    for doc, text in docs:
        w = words_of(text)
        h, n = zlib.crc32(str(doc).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        runs = plain_runs(w)
        planted += h % 10 == 0 and bool(runs)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        row = got[doc]
        assert row.n_runs == len(runs)
        assert (row.start, row.length, row.period) == (best or (None, None, None))
        assert row.exponent_milli == (best and 1000 * best[1] // best[2])
        lines = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
        assert row.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(plain_collapsed(w, runs).encode()).hexdigest()
    assert planted > 3


# ---- spelling variants


def one_edit(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    x, y = sorted((x, y), key=len)
    return len(y) - len(x) == 1 and any(y[:k] + y[k + 1 :] == x for k in range(len(y)))


def plain_spellings(counts, ratio=10):
    cut = {}
    for w in counts:
        for k in range(len(w)):
            cut.setdefault((w[:k] + w[k + 1 :], k), []).append(w)
            cut.setdefault((w[:k] + w[k + 1 :], None), []).append(w)
    near = {w: set() for w in counts}
    for (rest, k), own in cut.items():
        for a in own:
            if k is not None:
                near[a] |= {b for b in own if b != a}
            elif rest in counts and rest != a:
                near[a].add(rest)
                near[rest].add(a)
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
    out = {}
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (n, len(near[w]), form[w], form[w] and counts[form[w]], root)
    return out


def spelled(rows):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}


def made_words(seed, count, letters="abé", most=9):
    pick = random.Random(seed)
    return {"".join(pick.choice(letters) for _ in range(pick.randint(0, most))): int(10 ** pick.uniform(0, 4)) for _ in range(count)}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab😀", max_size=7), min_size=1, max_size=30, unique=True))
def test_sorted_list_scan(words):
    words.sort()
    listed = spelling.SortedList(np.zeros(len(words), np.int64), pa.array(words))
    x, y = listed.one_edit(np.arange(len(words)))
    want = {(a, b) for a in words for b in words if one_edit(a, b)}
    # the empty word has no codes to scan by
    assert len(x) == len(set(zip(x.tolist(), y.tolist(), strict=True)))
    assert {(words[a], words[b]) for a, b in zip(x.tolist(), y.tolist(), strict=True)} == {(a, b) for a, b in want if b}


@pytest.mark.parametrize("group", [3, 40, spelling.GROUP])
def test_spellings(spark, group):
    counts = made_words(1, 300) | made_words(2, 200, "abcdefgh", 12) | {"x" * 3000: 1, "x" * 2999: 50, "x" * 2998 + "y": 7}
    counts.pop("", None)
    rows = spark.createDataFrame([(w, n, "z") for w, n in counts.items()], "word string, n long, root string").repartition(3)
    got = spelling.group_spellings(rows, group=group).collect()
    assert len(got) == len(counts) and spelled(got) == plain_spellings(counts)


def test_odd_vocabularies(spark):
    rows = [("", 5), (None, 3), ("a", None), ("a", 4), ("a", 6), ("b", 200), ("ab", 1), ("nul\x00x", 1), ("nul\x00y", 10)]
    df = spark.createDataFrame(rows, "word string, n long")
    got = spelled(spelling.group_spellings(df).collect())
    assert got["a"] == (10, 2, "b", 200, "b") and got["ab"] == (1, 2, "b", 200, "b")
    assert got[""] == (5, 0, None, None, "") and got["nul\x00x"] == (1, 1, "nul\x00y", 10, "nul\x00y")
    assert len(got) == 6
    assert spelling.group_spellings(df.filter("false")).collect() == []


def test_chains_of_forms(spark):
    counts = {"a" * k: 10**k for k in range(1, 12)}
    rows = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert {r.root for r in spelling.group_spellings(rows).collect()} == {"a" * 11}


def test_op12(spark):
    seen = Counter()
    for doc, text in texts_of(FOLDER):
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            seen[run] += 1
    counts = {w: n for w, n in seen.items() if len(w) >= 7 and n >= 2}
    got = workload.op12_spelling_variants(spark, FOLDER).collect()
    want = plain_spellings(counts)
    assert len(got) == len(want) and spelled(got) == want
    assert any(v[2] is not None for v in want.values())


def test_altered_words_of_odd_rows(spark, odd, empty):
    assert workload.altered_words(odd).count() > 0
    assert workload.altered_words(empty).count() == 0


# ---- SimHash links


def plain_print(text):
    words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words_of(text)]
    own = [" ".join(words[k : k + 4]) for k in range(max(len(words) - 3, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in own]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(docs, distance=4):
    prints = [plain_print(t) for _, t in docs]
    return prints, plain_roots(prints, [d for d, _ in docs], distance)


def plain_roots(prints, ids, distance=4):
    top = list(range(len(prints)))

    def find(k):
        while top[k] != k:
            top[k] = top[top[k]]
            k = top[k]
        return k

    values = np.array(prints, np.uint64)
    for k in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(values[k + 1 :] ^ values[k]) <= distance).tolist():
            top[find(k)] = find(k + 1 + j)
    least = {}
    for k, d in enumerate(ids):
        if d is not None:
            least[find(k)] = min(d, least.get(find(k), d))
    return [least.get(find(k)) for k in range(len(prints))]


def test_two_that_link_share_a_signature(spark):
    pick = random.Random(5)
    pairs = []
    for _ in range(200):
        a, b = pick.getrandbits(64), 0
        b = a
        for k in pick.sample(range(64), pick.randint(0, 4)):
            b ^= 1 << k
        pairs.append((simhash_links._signed(a), simhash_links._signed(b)))
    rows = spark.createDataFrame(pairs, "a long, b long")
    from pyspark.sql import functions as F

    met = F.arrays_overlap(simhash_links.signatures(F.col("a")), simhash_links.signatures(F.col("b")))
    assert rows.filter(met).count() == 200
    mask = (1 << 22) - 1
    used = F.lit(mask)
    base = [c for c in pairs if (c[0] ^ c[1]) & ((1 << 22) - 1) == 0] + [(5, 5), (1 << 40, 3 << 40)]
    rows = spark.createDataFrame(base, "a long, b long")
    a, b = (simhash_links.further(F.col(c), used, {mask, mask << 22}) for c in "ab")
    assert rows.filter(F.arrays_overlap(a, b)).count() == len(base)


def test_links_of_dense_and_sparse_groups(spark):
    pick = random.Random(7)
    centres = [pick.getrandbits(64) for _ in range(6)]
    prints = set(centres) | {pick.getrandbits(64) for _ in range(300)} | {0, (1 << 64) - 1}
    for c in centres[:3]:
        for _ in range(500):
            x = c
            for k in pick.sample(range(64), pick.randint(1, 9)):
                x ^= 1 << k
            prints.add(x)
    # groups that share a segment and little else
    prints |= {(centres[4] & ((1 << 30) - 1)) | pick.getrandbits(34) << 30 for _ in range(400)}
    prints = sorted(prints)
    signed = [simhash_links._signed(x) for x in prints]
    rows = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = plain_roots(prints, list(range(len(prints))))
    for group in (64, 100000):
        links = [(r.a, r.b) for r in simhash_links.links_between(rows, group).collect()]
        number = {x: k for k, x in enumerate(signed)}
        assert all((a ^ b) % (1 << 64) and ((a ^ b) % (1 << 64)).bit_count() <= 4 for a, b in links)
        assert _joined(len(prints), [(number[a], number[b]) for a, b in links]) == want


def _joined(count, links):
    top = list(range(count))

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return [find(k) for k in range(count)]


def test_linked_documents(spark, odd, clashing, empty):
    docs = [(r[0], r[1]) for r in odd_rows()]
    prints, roots = plain_components(docs)
    want = Counter((d, simhash_links._signed(p), c) for (d, _), p, c in zip(docs, prints, roots, strict=True))
    for rows in (odd, clashing):
        got = simhash_links.link_documents(rows)
        assert got.columns == [*rows.columns, "fingerprint", "component_id"]
        plain = got.toDF(*[f"c{k}" for k in range(len(got.columns))]).collect()
        assert Counter((r[0], r[-2], r[-1]) for r in plain) == want
    assert simhash_links.link_documents(empty).collect() == []


def test_prints_of_long_texts_in_parts(monkeypatch):
    texts = [r[1] for r in odd_rows()]
    monkeypatch.setattr(simhash_links, "PART", 1000)
    assert simhash_links.fingerprints(pa.array(texts)).tolist() == [plain_print(t) for t in texts]


def test_op13(spark):
    docs = texts_of(FOLDER)
    prints, roots = plain_components(docs)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in workload.op13_simhash_links(spark, FOLDER).collect()}
    assert got == {d: (f"{p:016x}", c) for (d, _), p, c in zip(docs, prints, roots, strict=True)}
    assert any(d != c for (d, _), c in zip(docs, roots, strict=True))
