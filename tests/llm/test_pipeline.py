"""The pipeline's rows against its stages done by brute force."""

from __future__ import annotations

import zlib

import numpy as np

import corpus_pipeline
from barloom.llm.queries import WORD_BPE


def test_pipeline(spark, tmp_path):
    from tokenizers import Tokenizer

    a = " ".join(f"word{i}" for i in range(40))
    texts = {1: a, 2: a.replace("word20", "other"), 3: "clean text that stays\nsecond line stays too", 4: None, 5: "123 456", 6: "second line stays too", 7: "prefix " + " ".join(f"bench{i}" for i in range(12)), 8: "x\n\ny unlike the others here"}
    cols = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], cols).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(f"bench{i}" for i in range(12)))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # 4 and 5 have no language, 6 loses its only line, 2 is a near copy of 1, 7 has a benchmark window.
    want = {1: texts[1], 3: texts[3], 8: texts[8]}
    t = Tokenizer.from_file(WORD_BPE)
    crc = {i: zlib.crc32(np.array([*t.encode(x, add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, x in want.items()}
    assert {g.doc_id: g.ids_crc32 for g in got} == crc and {g.sequence_id for g in got} == {0}
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def test_stages_on_odd_tables(spark, tmp_path):
    """Empty tables, repeated rows, clashing column names, very long texts and ties."""
    cols = "doc_id long, text string, n_lines string, n_words string, hits string, kept string, component_id string, `a.b` string, gone string, n_chars long, lang string"
    long = " ".join(f"z{i}" for i in range(60_000))
    base = " ".join(f"w{i}" for i in range(50))
    texts = [(1, "same text here\nwith lines"), (1, "same text here\nwith lines"), (2, None), (3, ""), (4, long), (None, "no id"), (5, base), (6, base), (7, base + " more"), (8, "½ ² 12")]
    rows = [(i, t, "L", "W", "H", "K", "C", "AB", "G", -1, "en") for i, t in texts]
    bench = spark.createDataFrame([], "item_id long, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, empty = spark.createDataFrame(rows, cols), spark.createDataFrame([], cols)
    got = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert stage(spark, empty, str(tmp_path)).count() == 0
        got[name] = sorted(out.collect(), key=lambda g: (g.doc_id is None, g.doc_id or 0))
        if name != "packing":
            assert out.columns == docs.columns and all((g.n_lines, g.n_words, g.hits, g.kept, g.component_id, g["a.b"], g.gone) == ("L", "W", "H", "K", "C", "AB", "G") for g in got[name])
    assert [g.doc_id for g in got["language_id"]] == [1, 1, 4, 5, 6, 7, None]
    assert [(g.doc_id, g.n_chars) for g in got["line_dedup"]] == [(1, 25), (1, 25), (2, -1), (3, 0), (4, len(long)), (5, len(base)), (7, len(base) + 5), (8, 6), (None, 5)]
    assert [g.doc_id for g in got["near_dedup"]] == [1, 2, 3, 4, 5, 8, None]
    assert len(got["decontaminate"]) == len(rows)
    assert {g.doc_id for g in got["packing"]} == {i for i, _ in texts} and sum(g.doc_id == 1 for g in got["packing"]) == 2
