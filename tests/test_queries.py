import pytest
from docwright.plans import registry

from .oracle import agree


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_agrees_with_sql(spark, data, name):
    agree(spark, data, registry.queries()[name], registry.oracle_sql()[name])


#: What queries without SQL must hold: key columns that are never null and never repeated, and columns that are never null.
HOLDS = {
    "chunk_dispatcher": (("doc", "chunk_index"), ("chunk_id", "text", "chunk_type", "token_count", "total_chunks")),
    "ivf_assign": (("id",), ("list_id",)),
    "ivf_probe_topk": (("qid", "rank"), ("id", "distance")),
    "ivf_recall_at_k": (("qid",), ("recall",)),
    "keyword_topk_stemmed": (("qid", "rank"), ("id", "score")),
    "answer_path": (("qid",), ("answer", "n_sources", "from_cache", "cacheable")),
    "ingest_pdf_path": (("document_id", "chunk_index"), ("id", "content", "chunk_type")),
}


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_holds(spark, data, name):
    keys, full = HOLDS[name]
    rows = [r.asDict() for r in registry.queries()[name](spark, data).collect()]
    asks = name in ("answer_path", "keyword_topk_stemmed")
    assert rows or asks and registry.questions(spark, data).isEmpty()
    assert all(r[c] is not None for r in rows for c in (*keys, *full))
    assert len({tuple(r[c] for c in keys) for r in rows}) == len(rows)
    if name == "chunk_dispatcher":
        count = {}
        for r in rows:
            count[r["doc"]] = count.get(r["doc"], 0) + 1
            assert 0 <= r["chunk_index"] < r["total_chunks"] and r["text"] == r["text"].strip() and r["chunk_type"] in ("text", "ocr", "table")
        assert all(count[r["doc"]] == r["total_chunks"] for r in rows)
    if name == "ivf_recall_at_k":
        assert sum(r["recall"] for r in rows) / len(rows) >= 0.9
    if name == "answer_path":
        assert any(r["from_cache"] and r["answer"].startswith("known: ") for r in rows) or not any((r["qid"] // 100) % 6 == 3 for r in rows)


def test_stemmed_search_finds_what_the_plain_one_does(spark, data):
    from docwright.operators import fulltext

    texts, q = registry.chunks(spark, data, "content"), registry.questions(spark, data)
    plain = {tuple(r) for r in fulltext.match(fulltext.tsvector(texts), q).collect()}
    assert plain <= {tuple(r) for r in fulltext.match(fulltext.tsvector(texts, True), q, True).collect()}
