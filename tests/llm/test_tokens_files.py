import zlib

import numpy as np
import pytest
from conftest_rows import odd_rows
from hypothesis import given, settings
from hypothesis import strategies as st

from cellwave.llm import packing, token_files, tokens

ODD = [
    "", None, " a", "a ", "a  b", "a \n b", "\n", "x\n\ny", "a<|endoftext|>b", "it's 12,5% ok... (no) — “q”", "İstanbul ŉ ǅ", "a\tb",
    "a\x0bb c", "\x00z \x01", "don't. Stop! é ́x ﬁ", "ß.\nß", "日本語 テキスト。 ok", "😀 😀! x😀", " .", ". .", "a.\nb,", "ΑΣ ΣΑΣ.",
]


@pytest.mark.parametrize("name", [tokens.BYTE_BPE, tokens.WORD_BPE])
def test_ids_are_the_library_s(name):
    tool = tokens.Encoder(name)
    texts = ODD + [r[1] for r in odd_rows()]
    want = [np.array(tool.tool.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert tool.encode(texts) == want
    assert tool.encode(texts) == want  # from the cache


@pytest.mark.parametrize("name", [tokens.BYTE_BPE, tokens.WORD_BPE])
@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab .,\n\t'Éßé1!Σ́"), max_size=30), max_size=5))
def test_ids_of_any_text(name, texts):
    tool = tokens.encoder(name)
    want = [np.array(tool.tool.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert tool.encode(texts) == want


def ids_of(text, name):
    tool = tokens.encoder(name).tool
    return tool.encode(text or "", add_special_tokens=False).ids + [1]


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 31), st.lists(st.integers(0, 2**31 - 1), max_size=50))
def test_bits_round_trip(bits, values):
    ids = np.array([v % (1 << bits) for v in values], np.uint32)
    raw = token_files.pack_bits(ids, bits)
    assert len(raw) == -(-len(ids) * bits // 8) or bits in (8, 16, 32)
    assert token_files.unpack_bits(raw, len(ids), bits).tolist() == ids.tolist()


def test_segment_gives_any_range():
    rng = np.random.default_rng(5)
    ids = rng.integers(0, 1 << 13, 10_000).astype(np.uint32)
    s = token_files.Segment(memoryview(token_files.segment_bytes(0, 0, [3, None], [4000, 6000], ids, 13)))
    assert s.docs.tolist() == [3, 0] and s.null.tolist() == [0, 1]
    for a, b in [(0, 1), (4095, 4097), (8192, 10_000), (5, 5), (0, 10_000)]:
        assert s.ids(a, b).tolist() == ids[a:b].tolist()


def test_files_round_trip(spark, clashing, tmp_path):
    token_files.write_tokens(clashing, str(tmp_path / "t"))
    got = token_files.read_tokens(spark, str(tmp_path / "t")).collect()
    rows = sorted(odd_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at, want = 0, []
    for doc, text, *_ in rows:
        ids = ids_of(text, tokens.WORD_BPE)
        want.append((doc, at, len(ids), np.array(ids, "<u4").tobytes()))
        at += len(ids)
    key = lambda r: (r[1], r[2])
    assert sorted(((r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in got), key=key) == sorted(want, key=key)


def test_files_of_no_rows(spark, empty, tmp_path):
    token_files.write_tokens(empty, str(tmp_path / "e"))
    assert token_files.read_tokens(spark, str(tmp_path / "e")).count() == 0


def plain_best_fit(lengths, window):
    rooms, out = [], []
    for n in lengths:
        fits = [(r, k) for k, r in enumerate(rooms) if r >= n]
        room = min(r for r, _ in fits) if fits else None
        if room is None:
            rooms.append(window - n)
        else:
            rooms[next(k for k, r in enumerate(rooms) if r == room)] -= n
        out.append(room)
    return len(rooms), out


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 37), max_size=80))
def test_best_fit_takes_the_tightest_window(lengths):
    lengths = sorted(lengths, reverse=True)
    windows, offsets = packing.best_fit(lengths, 37)
    count, rooms = plain_best_fit(lengths, 37)
    assert len(set(windows)) == count
    # every piece goes where exactly as much room is left as in the plain form
    assert [None if o == 0 else 37 - o for o in offsets] == rooms


def test_packing_keeps_every_id_once(spark, clashing):
    pieces = packing.pack_documents(clashing, window=256).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        assert len(p.ids) == 4 * p.length and 0 < p.length <= 256
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 256
    for doc, text, *_ in odd_rows():
        if doc is not None and doc != 14:
            own = sorted(by_doc[doc], key=lambda p: p.start)
            assert b"".join(bytes(p.ids) for p in own) == np.array(ids_of(text, tokens.BYTE_BPE), "<u4").tobytes()
            assert [p.start for p in own] == list(range(0, own[0].doc_tokens, 256))
    assert sum(p.length for p in by_doc[14]) == 2 * len(ids_of(odd_rows()[14][1], tokens.BYTE_BPE))
    total = sum(p.length for p in pieces)
    assert len(by_sequence) - total / 256 < 2
    whole = packing.sequences(packing.pack_documents(clashing, window=256)).collect()
    assert sum(len(r.ids) for r in whole) == 4 * total


def test_packing_of_no_rows(empty):
    assert packing.pack_documents(empty).count() == 0


def test_query_digests(spark):
    from cellwave.llm.workload import all_queries

    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    at = 0
    got = {r.doc_id: r for r in all_queries()["op10_bit_packed_tokens"](spark, folder).collect()}
    for doc in sorted(texts):
        ids = ids_of(texts[doc], tokens.WORD_BPE)
        assert (got[doc].start, got[doc].n_tokens) == (at, len(ids))
        assert got[doc].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    for p in all_queries()["op1_best_fit_packing"](spark, folder).collect():
        ids = ids_of(texts[p.doc_id], tokens.BYTE_BPE)
        assert p.doc_tokens == len(ids)
        assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())


def test_words_of_letters_are_not_taken_apart():
    from cellwave.llm import tokens

    class Whole(str):
        def __getitem__(self, at):
            raise AssertionError("a word of letters was cut")

    tool = tokens.Encoder(tokens.WORD_BPE)
    words = [Whole(w) for w in ("plain", "Größe", "zyx")]
    assert tool._fresh(set(words)) == dict(zip(words, tool._each([str(w) for w in words]), strict=True))
    assert set(tool._fresh({"plain.", "a1", "zyx"})) == {"plain.", "plain", "a1", "zyx"}


def test_ascii_words_go_to_the_model_alone(monkeypatch):
    tool = tokens.Encoder(tokens.WORD_BPE)
    words = ["plain", "Words", "ZYX", "a", "unbelievably", "q" * 300]
    want = tool._each(words)
    monkeypatch.setattr(tool, "_letters", lambda words, by: [b"?"] * len(words))
    assert tool.encode(words) == want and tool.encode([" ".join(words)]) == [b"".join(want)]


def test_words_are_looked_up_once(monkeypatch):
    tool = tokens.Encoder(tokens.WORD_BPE)
    asked = []
    monkeypatch.setattr(tool, "_fresh", lambda missing, own=tool._fresh: asked.append(set(missing)) or own(missing))
    monkeypatch.setattr(tokens, "CACHE_WORDS", 2)
    long = "long" * 20
    want = [np.array(tool.tool.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in (f"one two {long}", f"two three. {long}")]
    for _ in range(2):
        assert tool.encode([f"one two {long}", f"two three. {long}"]) == want
        assert len(tool.words) <= 2 and long not in tool.words
    assert len(asked) == 2 and long in asked[1] and len(asked[1]) < len(asked[0])
