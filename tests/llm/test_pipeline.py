"""The stages against plain versions, each on what the one before it kept."""

import ast
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from conftest_rows import SCHEMA, odd_rows, prose
from test_operators import edit_distance, plain_links, plain_quality, plain_spans

import corpus_pipeline
from cellwave.llm import qgrams, tokens

ITEMS = [prose(60, 14), prose(61, 20)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    place = tmp_path_factory.mktemp("corpus")
    rows = [r for r in odd_rows() if r[0] is not None]
    leak = ITEMS[1].replace("ta", "te", 1)
    rows += [
        (50, prose(70, 40) + "\n" + ITEMS[0].upper() + ", " + prose(71, 10), "en", "s0", 1),
        (51, prose(72, 40) + " " + leak, "en", "s0", 1),
    ]
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame(list(enumerate(ITEMS)), "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    return str(place), rows


def plain_stages(rows):
    docs = [(r[0], r[1]) for r in rows]
    kept = []
    for doc, text in docs:
        words, *_, repeated = plain_quality(text)
        if words >= 10 and 100 * repeated <= 20 * words:
            kept.append((doc, text))
    kept.sort()
    yield kept
    _, tops = plain_links([t for _, t in kept], 5, 80)
    kept = [d for k, d in enumerate(kept) if tops[k] == k]
    yield kept
    texts = [k.decode("utf-8", "ignore") for _, k in plain_spans([t for _, t in kept], 200)]
    kept = [(d, t) for (d, _), t in zip(kept, texts, strict=True) if t.strip(" \t\n\x0b\x0c\r")]
    yield kept
    index = qgrams.ItemIndex([0, 1], ITEMS)
    plain = lambda t: qgrams.normalised(pa.array([t]))[0].tobytes().rstrip(b" ")
    # the long document is far from both items, which the operator's own test covers
    kept = [
        (d, t) for d, t in kept
        if len(t) > 20000 or not any(edit_distance(i.tobytes(), plain(t)) <= e for i, e in zip(index.items, index.edits, strict=True))
    ]
    yield kept


def test_stages(spark, folder):
    place, rows = folder
    docs = spark.read.parquet(f"{place}/documents.parquet")
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], plain_stages(rows), strict=True):
        docs = corpus_pipeline.written(stage(spark, docs, place), "pipeline-test")
        assert docs.columns == list(corpus_pipeline.COLUMNS), name
        assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted(want), name
    ids = [d for d, _ in want]
    assert 1 in ids and not {2, 3, 13, 50, 51} & set(ids)
    _, pack = corpus_pipeline.STAGES[-1]
    tool = tokens.encoder(tokens.BYTE_BPE)
    for pieces in (pack(spark, docs, place).collect(), corpus_pipeline.run(spark, place).collect()):
        for doc, text in want:
            own = b"".join(bytes(p.ids) for p in sorted((p for p in pieces if p.doc_id == doc), key=lambda p: p.start))
            assert own == tool.encode([text])[0] + np.array([1], "<u4").tobytes()


def test_stages_of_no_rows(spark, folder, empty):
    place, _ = folder
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, place)
    assert docs.count() == 0


def test_registered():
    import __spark_entry__

    found = __spark_entry__.queries()
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality rules", "n-gram Jaccard join", "suffix-array dedup", "benchmark decontamination", "packing"
    ]
    assert {n.split("_")[0] for n in found if n.startswith("op")} == {f"op{k}" for k in range(1, 11)} and "pipeline" in found
    assert set(__spark_entry__.oracle_sql()) <= set(found)


def test_nothing_else_imports_the_subpackage():
    root = Path(corpus_pipeline.__file__).parent
    for file in (root / "cellwave").rglob("*.py"):
        if "llm" not in file.parts:
            for node in ast.walk(ast.parse(file.read_text())):
                names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
                assert not any(".llm" in n for n in names), file


@pytest.mark.parametrize("name", ["op3_url_filter", "op4_quality_rules", "op6_warc_segments", "op9_chat_trees"])
def test_queries_match_sql(spark, name):
    from oracle import compare, connect

    from cellwave.llm.workload import all_queries, all_sql

    folder = "/root/testdata/sf0.001"
    rows, problems = compare(spark, connect(folder), folder, all_queries()[name], all_sql()[name])
    assert rows > 0 and not problems
