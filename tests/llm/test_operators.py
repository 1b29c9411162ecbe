import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest_rows import odd_rows, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cellwave.llm import chat_trees, components, jaccard, qgrams, quality, suffix, suffix_tree_lm, url_trie, warc

FOLDER = "/root/testdata/sf0.001"


# ---- url trie


@settings(max_examples=200, deadline=None)
@given(
    st.lists(st.sampled_from(["com", "a", "b", "", "x"]), min_size=1, max_size=4),
    st.text(alphabet="/ab7", max_size=8),
)
def test_trie_finds_the_longest_rule(labels, tail):
    rules = [("block", "com", "/a/"), ("allow", "a.com", "/a/7"), ("allow", "b", ""), ("block", "a.com", "/a/7"), ("block", "x.b", "/b")]
    host, path = ".".join(labels), "/" + tail
    fits = [(len(h + p), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    want = max(fits)[2] if fits else None
    found = url_trie.UrlTrie(rules).find(host, path)
    assert (found and found[1]) == want
    if want == "a.com/a/7":
        assert found[0] == "block"


def test_urls(spark):
    urls = ["HTTP://A.Com/en/1?x#y", "no scheme", None, "", "x://", "x://É.COM", "a://b?c/d", "a://h/p#://", "s://h://q/en/"]
    rows = spark.createDataFrame([(k, u, "z", "z") for k, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = {r.page_id: r for r in url_trie.judge_urls(rows, [("block", "com", "/en/")]).collect()}
    assert [(got[k].host, got[k].path) for k in range(len(urls))] == [
        ("a.com", "/en/1"), ("", ""), ("", ""), ("", ""), ("", ""), ("É.com", ""), ("b", ""), ("h", "/p"), ("h:", "//q/en/"),
    ]
    assert got[0].verdict == "block" and got[0].rule == "com/en/" and got[1].verdict == "allow" and got[1].rule is None
    assert url_trie.judge_urls(rows.filter("false"), []).count() == 0


# ---- quality


def plain_quality(text):
    words = (text or "").encode().decode().replace("\t", " ")
    for c in "\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    runs = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    seen = Counter(runs)
    covered = {k + j for k, r in enumerate(runs) if seen[r] > 1 for j in range(5)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_quality_counts(spark, clashing, empty):
    got = quality.judge_quality(clashing).collect()
    assert len(got) == len(odd_rows())
    want = Counter((r[0], *plain_quality(r[1])) for r in odd_rows())
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert Counter(tuple(r[n] for n in names) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed)
    assert quality.judge_quality(empty).count() == 0
    kept = quality.keep_good(clashing)
    assert kept.columns == clashing.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.kept)


def test_lines_of_many_documents(spark):
    menu = "home news contact about us and a few more words here to fill"
    rows = [(k, prose(100 + k, 30) + "\n  " + menu.upper(), "a") for k in range(6)]
    rows += [(6, menu, "a"), (7, menu, "b"), (8, menu + "\n" + prose(300, 12), "a")] + [(k, menu + " copy", "a") for k in range(20, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality.judge_quality(docs, most_documents=5).collect()}
    assert not got[6].kept and not got[6].base_failed and got[6].removed_chars == len(menu)
    assert all(got[k].kept for k in got if k != 6)  # another host, text left over, copies of one text
    assert {r.doc_id for r in quality.keep_good(docs, most_documents=5).collect()} == set(got) - {6}


def test_common_lines_leave_the_texts_but_not_groups_of_copies(spark):
    menu, article = "Home news contact about us and more", "\n".join(prose(700 + k, 12).replace("\n", " ") for k in range(8))
    texts = {k: prose(800 + k, 30) + "\n  " + menu.upper() + "\n\nend of document " + str(k) for k in range(8)}
    texts |= {20 + k: article.replace("\n", "\n" * (k % 3 + 1)) + f" \nown {k}" for k in range(12)}  # each with a short own line
    texts |= {40 + k: (article.upper() if k % 2 else article).replace("\n", " " * k + "\n") for k in range(12)}
    hosts = {k: "a" if k < 20 else "b" if k < 40 else "c" for k in texts}
    docs = spark.createDataFrame([(k, t, hosts[k], len(t)) for k, t in texts.items()], "doc_id long, text string, source string, n_chars int")
    got = {r.doc_id: r for r in quality.keep_good(docs, most_documents=5).collect()}
    want = {k: t.replace("\n  " + menu.upper(), "") if k < 20 else t for k, t in texts.items()}
    assert {k: r.text for k, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())


# ---- suffix array


def plain_spans(texts, window):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[k : k + window] for b in raw for k in range(len(b) - window + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - window + 1):
            if seen[b[k : k + window]] > 1:
                gone[k : k + window] = b"\1" * window
        spans = [(k, k + len(list(g))) for k, g in []]
        at = 0
        for flag, group in itertools.groupby(gone):
            n = len(list(group))
            if flag:
                spans.append((at, at + n))
            at += n
        out.append((spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab\x00é", min_size=1, max_size=120), min_size=1, max_size=4))
def test_suffix_order_and_prefixes(parts):
    text = np.frombuffer(b"".join(p.encode() + b"\xff" for p in parts) + b"\xfe", np.uint8)
    text = np.where(text == 255, text, text + np.uint8(1))
    text[-1] = 0
    raw, prefixes = text.tobytes(), suffix.Prefixes(text)
    order = suffix.suffix_array(text, prefixes)
    assert order.tolist() == sorted(range(len(raw)), key=lambda k: raw[k:])
    shared = suffix.permuted_prefixes(text, order, prefixes)
    for a, b in zip(order, order[1:], strict=False):
        same = next((k for k in range(len(raw)) if raw[a + k : a + k + 1] != raw[b + k : b + k + 1]), 0)
        assert shared[b] == min(same, 1023)


@pytest.mark.parametrize("kinds", [4096, 1])
def test_suffix_dedup(spark, clashing, empty, monkeypatch, kinds):
    monkeypatch.setattr(suffix, "MOST_KINDS", kinds)  # 1: all by windows, the way for hot anchors
    rows = odd_rows()
    want = Counter((r[0], tuple(s), k) for r, (s, k) in zip(rows, plain_spans([r[1] for r in rows], 200), strict=True))
    found = suffix.strip_repeats(clashing)
    assert found.columns == [*clashing.columns, "suffix_kept", "suffix_spans"]
    got = Counter((r.doc_id, tuple((s.start, s.end) for s in r.suffix_spans), bytes(r.suffix_kept)) for r in found.collect())
    assert got == want
    assert sum(n for (_, s, _), n in want.items() if s) >= 8
    assert suffix.strip_repeats(empty).count() == 0


def test_suffix_query(spark):
    from cellwave.llm.workload import all_queries

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    want = {
        d.doc_id: (len((d.text or "").encode()), sum(b - a for a, b in s), len(s), hashlib.sha256(k).hexdigest())
        for d, (s, k) in zip(docs, plain_spans([d.text for d in docs], 200), strict=True)
    }
    got = all_queries()["op5_suffix_array_dedup"](spark, FOLDER).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want


# ---- WARC


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300), st.integers(1, 50))
def test_chunks_round_trip(payload, size):
    assert warc.dechunked(warc.chunked(payload, size)) == payload


def test_archives_round_trip(spark, tmp_path):
    html = ["<p>é</p>\r\n\r\nWARC/1.1\r\n" * 3000, "", None, "a", "a", "é" * 20000, "HTTP/1.1 200 OK\r\n\r\n"]
    rows = [(k, f"http://h/{k} \r\nX: y", h, "z") for k, h in enumerate(html)] + [(4, None, "a", "z"), (None, "u", "a", "z"), (None, "u", "lone", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string").repartition(3)
    warc.write_archives(warc.assign_revisits(pages), str(tmp_path / "w"), segment=4096)
    got = warc.read_pages(spark, str(tmp_path / "w")).collect()
    want = []
    for k, _, h, _ in rows:
        raw = (h or "").encode()
        first = min((r[0] for r in rows if (r[2] or "") == (h or "") and r[0] is not None), default=None)
        kind = "revisit" if k is not None and k != first else "response"
        want.append((k, len(raw), warc.digest(raw), kind, first if kind == "revisit" else None, None if kind == "revisit" else raw))
    plain = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got]
    assert Counter(plain) == Counter(want)
    stored = warc.assign_revisits(pages, least_bytes=2)
    assert stored.filter("page_id = 4 and refers_to is null").count() == 2
    records = warc.read_records(spark, str(tmp_path / "w"))
    assert records.filter("number > 1").count() > 10
    with pytest.raises(PySparkException, match="segments don't add up"):
        warc.reassemble(records.filter("number is null or number <> 2")).collect()
    warc.write_archives(warc.assign_revisits(pages.filter("false")), str(tmp_path / "e"))
    assert warc.read_pages(spark, str(tmp_path / "e")).count() == 0


# ---- Jaccard


def plain_links(rows, size, share):
    sets = []
    for text in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) or (frozenset([tuple(w)]) if w else frozenset()))
    top = list(range(len(rows)))

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= share * (len(sets[a]) + len(sets[b]) - both):
            top[max(find(a), find(b))] = min(find(a), find(b))
    return [len(s) for s in sets], [find(k) for k in range(len(rows))]


def variants(seed, base, count, most):
    pick = random.Random(seed)
    out = []
    for _ in range(count):
        words = base.split()
        for _ in range(pick.randint(0, most)):
            k = pick.randrange(len(words))
            words[k : k + 1] = pick.choice([[], ["new"], [words[k], "more"]])
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("size,share,route", [(3, 90, "parts"), (5, 80, "prefix"), (1, 50, "parts")])
@pytest.mark.parametrize("most", [4 << 20, 200])
def test_jaccard_components(spark, monkeypatch, size, share, route, most):
    monkeypatch.setattr(jaccard, "UNIT_SHINGLES", most)  # small: groups are cut into cells
    texts = [r[1] for r in odd_rows() if r[1] is None or len(r[1]) < 20000]
    texts += variants(1, prose(40, 120), 25, 8) + variants(2, prose(41, 40), 15, 3) + variants(3, "a b c d e f g", 10, 2)
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, cls string")
    sizes, tops = plain_links(texts, size, share)
    got = {r.doc_id: r for r in jaccard.jaccard_classes(docs, size, f"{share}/100", route).collect()}
    assert [got[k].n_shingles for k in range(len(texts))] == sizes
    assert [got[k].component_id for k in range(len(texts))] == tops
    assert len(set(tops)) < len(texts) - 15


@pytest.mark.parametrize("most", [4 << 20, 200])
def test_jaccard_counts_every_link(spark, monkeypatch, most):
    monkeypatch.setattr(jaccard, "UNIT_SHINGLES", most)
    texts = variants(1, prose(40, 120), 25, 8) + variants(2, prose(41, 40), 15, 3) + [prose(42, 30)] * 3 + [None, "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = []
    for text in texts:
        w = (text or "").lower().split()
        sets.append(frozenset(tuple(w[k : k + 3]) for k in range(len(w) - 2)))
    want = [sum(bool(a) and j != k and 10 * len(a & b) >= 9 * len(a | b) for j, b in enumerate(sets)) for k, a in enumerate(sets)]
    got = {r.doc_id: r for r in jaccard.jaccard_classes(docs).collect()}
    assert [got[k].n_links for k in range(len(texts))] == want
    assert max(want) > 5 and want[-6:] == [2, 2, 2, 0, 0, 0]
    assert len({got[k].class_id for k in range(len(texts))}) == len({*sets})


def test_jaccard_keeps_one_of_each_group(spark, clashing, empty):
    got = jaccard.keep_first(clashing)
    assert got.columns == clashing.columns
    want = Counter(r[0] for r in odd_rows())
    for gone in (2, 3, 10):
        del want[gone]
    want[14] = 1
    assert Counter(r.doc_id for r in got.collect()) == want
    assert jaccard.keep_first(empty).count() == 0
    assert jaccard.jaccard_classes(empty).count() == 0


def test_jaccard_keeps_different_texts_of_one_id(spark):
    a, b, c = prose(500, 60), prose(501, 60), prose(502, 60)
    near = a.replace(a.split()[30], "other", 1)
    rows = [(None, a), (None, a), (None, near), (None, b), (None, b), (7, b + " x"), (7, c), (7, c), (None, ""), (None, " "), (None, None), (8, ""), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.text) for r in jaccard.keep_first(docs).collect()]
    words = [(i, t) for i, t in got if (t or "").strip()]
    assert len(words) == 3 and {(7, b + " x"), (7, c)} < set(words) and {t for i, t in words if i is None} <= {a, near}
    assert Counter(x for x in got if x not in words) == Counter([(None, ""), (None, " "), (None, None), (8, ""), (8, "")])


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (300, 299), (300, 299)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100), 299: 299, 300: 299}


# ---- decontamination


def edit_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, e in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != e), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_leaks_are_those_within_the_budget(spark):
    pick = random.Random(3)
    items = [prose(60 + k, 12) for k in range(6)] + ["short", "", None, "tiny one"]
    texts = []
    for k in range(40):
        item = list(items[k % 6])
        for _ in range(pick.randint(0, int(len(item) * 0.13))):
            at = pick.randrange(len(item))
            item[at : at + 1] = pick.choice(["", "q", item[at] + "z"])
        texts.append(prose(200 + k, pick.randint(0, 20)) + pick.choice([" ", "\n", " -- "]) + "".join(item).upper() + " " + prose(400 + k, 5))
    texts += [None, "", items[0], "x" + items[1]]
    index = qgrams.ItemIndex(list(range(len(items))), items)
    plain = lambda t: qgrams.normalised(pa.array([t]))[0].tobytes().rstrip(b" ")
    want = set()
    for k, t in enumerate(texts):
        for j, item in enumerate(index.items):
            edits = edit_distance(item.tobytes(), plain(t or ""))
            if edits <= index.edits[j]:
                want.add((k, index.ids[j], edits))
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.edits) for r in qgrams.find_leaks(docs, bench).collect()} == want
    assert len({w[0] for w in want}) > 20
    clean = qgrams.keep_clean(docs, bench)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == set(range(len(texts))) - {w[0] for w in want}
    assert qgrams.find_leaks(docs.filter("false"), bench).count() == 0
    assert qgrams.find_leaks(docs, bench.filter("false")).count() == 0


def test_leaks_by_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(qgrams, "BLOCK_BYTES", 100)
    docs, bench = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/benchmark.parquet").limit(8)
    found = {(r.doc_id, r.item_id) for r in qgrams.find_leaks(docs, bench).collect()}
    texts, items = docs.collect(), bench.collect()
    assert {(d.doc_id, b.item_id) for d in texts for b in items if b.text in (d.text or "")} <= found


# ---- language model


def test_scores(spark, clashing, empty):
    got = suffix_tree_lm.score_documents(clashing).collect()
    tokens = [((r[1] or "").encode().lower().split() + [None], zlib.crc32(str(r[0] if r[0] is not None else "").encode()) % 7 == 2) for r in odd_rows()]
    seen = Counter(t for ts, held in tokens if not held for t in ts)
    total, distinct = sum(seen.values()), len(seen)
    base = [sum(math.log10((seen[t] + 1) / (total + distinct + 1)) for t in ts) for ts, _ in tokens]
    rounded = lambda x: float(f"{x:.9g}")
    want = Counter((r[0], h, len(ts), sum(seen[t] > 0 for t in ts), total, rounded(b)) for r, (ts, h), b in zip(odd_rows(), tokens, base, strict=True))
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, rounded(r.base_score)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert suffix_tree_lm.score_documents(empty).count() == 0


def test_states_are_distributions_and_help_on_held_out_text(spark):
    rows = suffix_tree_lm.split_mark(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    tree, vocabulary = suffix_tree_lm.fit(rows)
    assert (tree.weight1 < 1).sum() > 20 and len(tree.triples)
    # the next token's probabilities after any two words sum to one, an unseen word's share included
    size, words = len(tree.able), len(tree.words)
    root = tree.root(np.append(tree.counts, 0))
    assert words == tree.distinct and abs(root.sum() - 1) < 1e-9
    own = np.append(tree.short[:words], -1)
    for pair in [None, *np.argsort(-tree.pair_counts)[:20].tolist()]:
        before = -1 if pair is None else int(tree.pairs[pair] % size)
        if before == tree.end and before >= 0:
            continue
        one = tree._one(np.full(len(own), before), own, root)
        assert abs(one.sum() - 1) < 1e-9
        if pair is not None:
            slot = suffix_tree_lm._lookup(tree.triples, np.where(own >= 0, pair * size + own, -1))
            counts = np.where(slot >= 0, np.append(tree.triple_counts, 0)[slot], 0)
            assert abs((counts * tree.share2[pair] + tree.weight2[pair] * one).sum() - 1) < 1e-9
    held = suffix_tree_lm.score_documents(spark.read.parquet(f"{FOLDER}/documents.parquet")).filter("held_out")
    score, base = held.agg(F.sum("score"), F.sum("base_score")).first()
    assert score > base


# ---- reply trees


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="us\\<|/>\nr", max_size=8), st.text(alphabet="ab\\<|im_end>\n/é", max_size=20)), min_size=1, max_size=5))
def test_chats_round_trip(spark, turns):
    rows = [(1, k, role, text) for k, (role, text) in enumerate(turns)]
    nodes = spark.createDataFrame([(c, k, k - 1 if k else None, r, t, 0.0) for c, k, r, t in rows],
                                  "conv_id long, node long, parent long, role string, text string, score double")
    ordered = nodes.withColumn("depth", F.col("node"))
    before = chat_trees.best_paths
    chat_trees.best_paths = lambda df: ordered.select("conv_id", "node", "depth")
    try:
        back = chat_trees.read_back(chat_trees.format_paths(nodes)).orderBy("position").collect()
    finally:
        chat_trees.best_paths = before
    assert [(r.role, r.text) for r in back] == turns


def test_best_branch(spark):
    tree = [
        (1, 10, None, "user", "q", 0.0), (1, 11, 10, "assistant", "low", 1.0), (1, 12, 10, "assistant", "high", 2.0),
        (1, 13, 11, "user", "deep", 0.5), (1, 14, 12, "user", "x", 0.0), (1, 15, 12, "user", "y", 0.0),
        (2, 20, 99, "user", "lost parent", 0.0), (3, 30, 31, "user", "cycle", 0.0), (3, 31, 30, "user", "cycle", 0.0),
        (None, 40, None, None, None, 0.0),
    ]
    nodes = spark.createDataFrame(tree, "conv_id long, node long, parent long, role string, text string, score double")
    got = {(r.conv_id, r.node, r.depth) for r in chat_trees.best_paths(nodes).collect()}
    assert got == {(1, 10, 1), (1, 12, 2), (1, 14, 3), (2, 20, 1), (None, 40, 1)}


def test_threads_of_odd_rows(spark):
    turns = [(1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, None, None, None), (None, 1, "assistant", "n"), (2, 1, "a\nb", "")]
    rows = spark.createDataFrame([(*t, "x", 1) for t in turns], "conv_id long, turn long, role string, text string, node string, depth int")
    formatted = chat_trees.format_paths(chat_trees.linear_threads(rows))
    back = chat_trees.read_back(formatted).collect()
    want = {(1, 0, "", "", None), (1, 1, "user", "a", None), (1, 2, "assistant", "b", "b"), (1, 3, "assistant", "b", "b"),
            (None, 0, "assistant", "n", "n"), (2, 0, "a\nb", "", None)}
    assert {(r.conv_id, r.position, r.role, r.text, r.loss_text) for r in back} == want
    assert chat_trees.format_paths(chat_trees.linear_threads(rows.filter("false"))).count() == 0


def test_pages_are_read_and_decoded_by_one_worker_a_task(spark, tmp_path):
    rows = [(k, "u", "<p>" + "x" * (40 * k)) for k in range(60)] + [(60, "u", None), (61, "u", "<p>")]
    place = str(tmp_path / "w")
    warc.write_archives(warc.assign_revisits(spark.createDataFrame(rows, "page_id long, url string, html string")), place, segment=1024)
    got = warc.read_pages(spark, place)
    # a Python step right above another would need two workers in each task
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan
    assert {r.page_id: r.payload_bytes for r in got.collect()} == {k: len(h or "") for k, _, h in rows}
    single, parts = (warc.read_records(spark, place, s) for s in (False, True))
    assert single.filter("number is not null").count() == 0 < parts.count() == parts.filter("number is not null").count()


def test_counting_holds_little_text_at_once():
    text = "some words " * 30000
    batch = pa.RecordBatch.from_pydict({"text": [text] * 20 + [None]})
    seen = []

    def keys_of(tokens, starts):
        seen.append(len(tokens))
        return tokens.view(np.int64)

    out = list(suffix_tree_lm.tallied(iter([batch]), keys_of))
    # 60000 words and an end each; three texts of 330 kB make a slice of 1 MB
    assert max(seen) <= 3 * 60001 + 1 and sum(seen) == 20 * 60001 + 1
    counts = dict(zip(*(np.concatenate([b.column(k).to_numpy() for b in out]).tolist() for k in (0, 1)), strict=True))
    assert sorted(counts.values()) == [21, 600000, 600000]
