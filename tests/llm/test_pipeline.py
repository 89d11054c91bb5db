"""The corpus pipeline against a plain version of its stages, on a small corpus with every case planted."""

import numpy as np
import pytest

from tamarack.llm import sampling

from .helpers import documents, long_words
from .test_dedup import brute, covered

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def corpus():
    rows, labels = [], []
    bench = [(j, " ".join(long_words(24, 9000 + j))) for j in range(4)]
    for i in range(120):
        w = long_words(90, i)
        if i % 6 == 0:
            w[10:12] = ["vile", "scum"]
            w[40] = "scum"
        labels.append((i, int(i % 6 == 0), 1))
        rows.append((i, " ".join(w)))
    for i in range(6):  # near copies of clean documents, and exact ones
        w = long_words(90, 6 * i + 1)
        w[45] = "changed"
        rows.append((200 + i, " ".join(w)))
        rows.append((300 + i, " ".join(long_words(90, 6 * i + 1))))
    shared = long_words(60, 8000)
    for i in range(4):  # a passage that four documents share
        rows.append((400 + i, " ".join(long_words(50, 500 + i) + shared + long_words(40, 600 + i))))
    for j, text in bench:
        rows.append((500 + j, " ".join(long_words(40, 700 + j) + text.split() + long_words(40, 800 + j))))
    rows += [(600, None), (601, ""), (602, "short"), (603, " ".join(long_words(20_000, 77)))]
    return rows, labels, bench


def test_stages_equal_a_plain_version(spark, tmp_path):
    rows, labels, bench = corpus()
    documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = [(i, t) for i, t in rows if "vile scum" not in (t or "")]
    groups = brute(kept, 5)
    kept = [(i, t) for i, t in kept if groups[i][1] == i]
    gone = covered([(i, t or "") for i, t in kept])
    cut = {i: [w for k, w in enumerate((t or "").split()) if (i, k) not in gone] for i, t in kept}
    kept = [(i, t) for i, t in kept if cut[i] or not (t or "").strip()]
    clean = {i: cut[i] for i, t in kept if not any(item in (t or "") for _, item in bench)}
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(seen["toxicity"]) == {i for i, t in rows if "vile scum" not in (t or "")}
    assert {i: (t or "").split() for i, t in seen["benchmark_decontamination"].items()} == clean
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    voc = sampling.vocabulary(sampling.model_path())
    texts = {i: t or "" for i, t in seen["benchmark_decontamination"].items()}
    assert {r["doc_id"] for r in pieces} == set(texts)
    for r, text in zip(pieces, voc.decode_all([np.array(r["ids"], dtype="int64") for r in pieces]), strict=True):
        assert text == texts[r["doc_id"]]
    assert all(len({tuple(r["ids"]) for r in pieces if r["doc_id"] == i}) == (2 if t else 1) for i, t in texts.items())


def test_an_empty_corpus(spark, tmp_path):
    documents(spark, []).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_the_passage_stage_cuts_edited_passages_that_only_later_documents_share(spark):
    left, right = long_words(30, 91), long_words(36, 92)
    texts = [long_words(40, 93) + left, right + long_words(40, 94)] + [long_words(30, 95 + i) + left + [f"edit{i}"] + right + long_words(20, 99 + i) for i in range(2)]
    out = corpus_pipeline.cut_repeated_passages(spark, documents(spark, [(i, " ".join(w)) for i, w in enumerate(texts)]), "")
    assert {r["doc_id"]: len(r["text"].split()) for r in out.collect()} == {0: 70, 1: 76, 2: 117, 3: 50}
