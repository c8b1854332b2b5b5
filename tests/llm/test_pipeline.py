"""The five stages against what brute force says of each stage's own input, and the driver's contract."""

from __future__ import annotations

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lexspan.llm import queries
from lexspan.llm.simhash import fingerprint
from tests.conftest import DATA
from tests.llm.test_dedup import naive_components, removed_spans
from tests.llm.test_scans import naive_leaks
from tests.llm.test_tokens import digests


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows of documents and of every stage's result, each written and read again as the next one's documents."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, DATA).write.parquet(path)
        docs = spark.read.parquet(path)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.append(docs.collect())
    return out


def test_quality_keeps_labelled_good_documents(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages[1]}
    good, bad = ({i for i, q in labels.items() if q == v} for v in (1, 0))
    assert len(good & kept) >= 0.99 * len(good) and len(bad - kept) >= 0.7 * len(bad)
    assert {tuple(r) for r in stages[1]} <= {tuple(r) for r in stages[0]}


def test_one_of_each_group_stays(stages):
    rows = sorted(stages[1], key=lambda r: r.doc_id)
    first = naive_components([fingerprint(r.text or "") for r in rows])
    assert sorted(r.doc_id for r in stages[2]) == sorted({rows[i].doc_id for i in first})


def test_repeated_passages_are_cut(stages):
    rows = sorted(stages[2], key=lambda r: r.doc_id)
    after = {r.doc_id: r for r in stages[3]}
    assert set(after) == {r.doc_id for r in rows}
    for r, raw, cover in zip(rows, *removed_spans([r.text for r in rows]), strict=True):
        left = bytes(b for b, gone in zip(raw, cover, strict=True) if not gone).decode("utf-8", "ignore")
        assert after[r.doc_id].text == left and after[r.doc_id].n_chars == len(left)


def test_leaks_go(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    assert {r.doc_id for r in stages[4]} == {r.doc_id for r in stages[3] if not naive_leaks(r.text, items)}


def test_ids(stages):
    tok = Tokenizer.from_file(public_tokenizers.path(queries.WORD_BPE))
    tok.no_truncation()
    tok.no_padding()
    assert {tuple(r) for r in stages[5]} == {(r.doc_id, *digests(tok, r.text)) for r in stages[4]}


def test_run_is_its_stages(spark, stages):
    assert {tuple(r) for r in corpus_pipeline.run(spark, DATA).collect()} == {tuple(r) for r in stages[5]}


def test_ten_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_nothing_else_imports_the_subpackage():
    from pathlib import Path

    root = Path(corpus_pipeline.__file__).parent
    for p in (root / "lexspan").rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "llm" not in p.read_text(), p
