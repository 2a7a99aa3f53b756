from docwright.functions import models
from docwright.operators import cache as C
from docwright.operators import extraction as E
from docwright.operators import fulltext as X
from docwright.operators import store as S
from docwright.operators import vector as V
from docwright.plans import pipelines as P
from docwright.plans import registry
from pyspark.sql import functions as F


def small(spark):
    texts = [(1, "The valve was sealed by hand. It held."), (2, "The pump failed last spring."), (3, "Nobody answered the letter.")]
    chunks = spark.createDataFrame(texts, "id long, content string").withColumn("embedding", models.embed(F.col("content")))
    q = spark.createDataFrame([(1, "valve sealed", 5, None, "keyword"), (2, "pump failed spring", 5, 2.0, "semantic"), (3, "zebra", 5, None, "keyword"), (4, "pump failed", 2, 2.0, "hybrid")], "qid long, question string, top_k int, threshold double, search_mode string")
    return chunks, q.withColumn("qvec", models.embed(F.col("question")).cast("array<double>"))


def test_answers_and_cache(spark):
    chunks, q = small(spark)
    now = F.lit("2024-01-01").cast("timestamp")
    empty = spark.createDataFrame([], "key string, value string, expires_at timestamp")
    first = P.answer_questions(q, chunks, empty, now)
    got = {r["qid"]: r for r in first.collect()}
    assert got[1]["answer"] == "The valve was sealed by hand." and got[2]["answer"] == got[4]["answer"] == "The pump failed last spring."
    assert not got[3]["cacheable"] and not any(r["from_cache"] for r in got.values())
    cache = P.new_entries(first, now)
    again = {r["qid"]: r for r in P.answer_questions(q, chunks, cache, now).collect()}
    assert [again[i]["from_cache"] for i in (1, 2, 3, 4)] == [True, True, False, True] and again[1]["answer"] == got[1]["answer"]
    late = P.answer_questions(q, chunks, cache, now + F.expr("interval 3600 seconds"))
    assert not any(r["from_cache"] for r in late.collect())


def test_answers_match_inflected_words(spark):
    chunks, _ = small(spark)
    now, empty = F.lit("2024-01-01").cast("timestamp"), spark.createDataFrame([], "key string, value string, expires_at timestamp")
    q = spark.createDataFrame([(1, "sealing valves", 5, None, "keyword"), (2, "pumps failing", 5, None, "hybrid"), (3, "valves pumps", 5, None, "keyword")], "qid long, question string, top_k int, threshold double, search_mode string")
    q = q.withColumn("qvec", F.lit(None).cast("array<double>"))  # only words can match
    got = {r["qid"]: r["cacheable"] for r in P.answer_questions(q, chunks, empty, now).collect()}
    assert got == {1: True, 2: True, 3: False}
    assert not any(r["cacheable"] for r in P.answer_questions(q, chunks, empty, now, stem=False).collect())


def test_embedding_cache(spark):
    now = F.lit("2024-01-01").cast("timestamp")
    t = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c")], "id long, text string")
    rows = t.where("id = 3").select(C.cache_key("embedding", F.col("text")).alias("key"), F.lit("[1.0,2.0]").alias("value"))
    got = {r["id"]: r["embedding"] for r in P.embed_through_cache(t, C.entries(rows, now, C.EMBEDDING_TTL), now).collect()}
    assert got[3] == [1.0, 2.0] and got[1] == got[2] and len(got[1]) == 384


def test_ingest(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(300))), (2, None), (3, " ")], "id long, content string")
    rows = P.ingest_texts(docs).collect()
    assert len(rows) == 2 and len({r["id"] for r in rows}) == 2 and all(len(r["embedding"]) == 384 for r in rows)
    spans = spark.createDataFrame([(1, 1, 0, 0, "Title", 14.0, 16, "F", 0), (1, 1, 1, 0, "Body text that is long enough. " * 6, 10.0, 0, "F", 0), (1, 2, 0, 0, "few", 10.0, 0, "F", 0)], "document_id long, page_number int, block_pos int, pos int, text string, size double, flags int, font string, type int")
    tables = spark.createDataFrame([(1, 1, 0, [["Name", "Qty"], ["a", "1"]], None), (1, 2, 0, [["x", "y"], ["1", "2"]], 90.0), (1, 1, 1, [["only"]], None), (1, 1, 2, [["a", "b"], ["c", "d"]], 10.0)], "document_id long, page_number int, table_index int, cells array<array<string>>, confidence double")
    ocr = spark.createDataFrame([(1, 2, "Scanned words here.")], "document_id long, page_number int, text string")
    got = [(r["chunk_index"], r["chunk_type"], r["page_number"]) for r in P.ingest_pages(spans, tables, ocr).orderBy("chunk_index").collect()]
    assert got == [(0, "table", 1), (1, "text", 1), (2, "ocr", 2)]


def test_stored_indexes(spark, tmp_path):
    vectors = spark.createDataFrame([(i, [float(i % 3 == k) for k in range(3)]) for i in range(30)], "id long, embedding array<float>")
    c = V.ivf_fit(vectors, 3)
    S.save_vector_lists(V.ivf_assign(vectors, c), str(tmp_path / "v"))
    assert S.probe_lists(spark, str(tmp_path / "v"), [0]).count() == 10
    q = spark.createDataFrame([(1, [1.0, 0.0, 0.0], 4)], "qid long, qvec array<double>, top_k int")
    exact = [r["id"] for r in V.exact_topk(vectors, q).orderBy("rank").collect()]
    assert [r["id"] for r in V.ivf_topk(V.ivf_assign(vectors, c), c, q, 3).orderBy("rank").collect()] == exact
    posts = X.postings(spark.createDataFrame([(1, "alpha beta alpha")], "id long, content string"))
    S.save_postings(posts, str(tmp_path / "p"), 8)
    assert sorted(r["pos"] for r in S.read_postings(spark, str(tmp_path / "p"), ["alpha"], 8).collect()) == [1, 3]


def test_probes_reach_the_recall(spark, data):
    run = lambda name: {(r["qid"], r["id"]) for r in registry.queries()[name](spark, data).select("qid", "id").collect()}
    exact, got = run("semantic_topk"), run("ivf_probe_topk")
    assert exact and len(exact & got) / len(exact) >= V.RECALL
    vectors = spark.createDataFrame([(i, [float(i % 3 == k) for k in range(3)]) for i in range(30)], "id long, embedding array<float>")
    c = V.ivf_fit(vectors, 3)
    a = V.ivf_assign(vectors, c)
    assert V.ivf_probes(a, c, k=10) == 1 and V.ivf_probes(a, c, least=1.1) == 3 and V.ivf_probes(a.where("false"), c) == 3


def test_extraction_helpers(spark):
    df = spark.createDataFrame([([(1, " A ", 1), (2, "  ", 2), (1, None, 3)], [], [["x"]])], "toc array<struct<level:int,title:string,page:int>>, a array<array<string>>, b array<array<string>>")
    r = df.select(E.table_of_contents(F.col("toc")).alias("t"), E.first_tables(F.col("a"), F.col("b")).alias("f"), E.first_tables(F.col("a"), F.col("a")).alias("n")).first()
    assert [tuple(x) for x in r["t"]] == [(1, "A", 1)] and r["f"] == [["x"]] and r["n"] == []
    words = spark.createDataFrame([(1, 1, 0, "a", 90.0, "tesseract"), (1, 1, 1, " ", 5.0, "tesseract"), (1, 1, 2, "b", -1.0, "tesseract"), (1, 2, 0, "c", 0.2, "easyocr"), (1, 2, 1, "d", 0.5, "easyocr"), (1, 3, 0, "z", 0.0, "tesseract")], "document_id long, page_number int, pos int, word string, score double, backend string")
    got = {x["page_number"]: (x["text"], x["confidence"]) for x in E.page_from_words(words).collect()}
    assert got == {1: ("a b", 90.0), 2: ("d", 50.0), 3: ("z", None)}


def test_answers_tell_their_sources_and_use_plug_ins(spark):
    from docwright.operators import answer as A
    from docwright.operators import retrieval as R

    chunks, q = small(spark)
    now, empty = F.lit("2024-01-01").cast("timestamp"), spark.createDataFrame([], "key string, value string, expires_at timestamp")
    got = {r["qid"]: r for r in P.answer_questions(q, chunks, empty, now).collect()}
    assert [s["id"] for s in got[1]["sources"]] == [1] and got[1]["sources"][0]["fts_rank"] == 0.05 and got[1]["reason"] and got[1]["filtered_count"] == 0
    assert got[3]["sources"] is None and got[3]["filtered_count"] == 0
    assert {s["id"] for s in got[2]["sources"]} == {1, 2, 3} and got[2]["sources"][0]["distance"] is not None

    def reply():
        return lambda prompts: ['{"faithfulness": 0.9, "reason": "fine"}' if "fact-checker" in p else f"said {len(p)}" for p in prompts]

    def longest():
        return lambda questions, contents: [float(len(c)) for c in contents]

    index = X.tsvector(chunks.select("id", "content"), True)
    c = V.ivf_fit(chunks.select("id", "embedding"), 2)
    search = R.inverted_file(V.ivf_assign(chunks.select("id", "embedding"), c), c, 2)
    own = P.answer_questions(q, chunks, empty, now, lambda texts, prompt: models.generated(prompt, reply), A.judged_by(reply), True, lambda a, b: models.scored(a, b, longest), search, index)
    rows = {r["qid"]: r for r in own.collect()}
    assert rows[1]["answer"].startswith("said ") and rows[1]["score"] == 0.9 and rows[1]["reason"] == "fine"


def test_a_model_is_made_once_a_worker(spark, tmp_path):
    made = str(tmp_path / "made")

    def factory():
        import os

        with open(made, "a") as f:
            f.write(f"{os.getpid()}\n")
        return lambda texts: [[float(len(t))] for t in texts]

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        rows = spark.range(500).repartition(4).select("id", models.embed(F.col("id").cast("string"), factory).alias("v")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    workers = open(made).read().split()
    assert all(r["v"] == [len(str(r["id"]))] for r in rows) and len(workers) == len(set(workers))


def test_windows_of_a_tokenizer(spark):
    from docwright.operators import chunking as K

    def letters():
        return (lambda t: [ord(c) for c in t.lower()]), (lambda ids: "".join(map(chr, ids)))

    df = spark.createDataFrame([(1, "ABCDEFGHIJ"), (2, " " * 9), (3, None), (4, "")], "id long, content string")
    got = [(r["id"], r["chunk_index"], r["text"]) for r in K.token_windows(df, letters, 4, 1).orderBy("id", "chunk_index").collect()]
    assert got == [(1, 0, "abcd"), (1, 1, "defg"), (1, 2, "ghij"), (1, 3, "j")]
    assert [r[0] for r in df.select(K.split_by(F.col("content"), lambda: lambda t: t.split("E"))).collect()] == [["ABCD", "FGHIJ"], [], None, []]


def test_ingest_statuses_and_versions(spark, tmp_path):
    from docwright.schemas import CHUNK, DOCUMENT, conform

    docs = conform(spark.createDataFrame([(1, "a"), (2, "b")], "id long, title string"), DOCUMENT)
    chunks = conform(spark.createDataFrame([(10, 1, 2), (11, 1, 1)], "id long, document_id long, page_number int"), CHUNK)
    P.ingest(docs, chunks, str(tmp_path))
    back = {r["id"]: r for r in S.read_current(spark, str(tmp_path / "document")).collect()}
    assert back[1]["extraction_status"] == "completed" and back[2]["extraction_status"] == "failed" and back[1]["updated_at"] is not None
    changed = {r["id"]: r for r in S.rewritten(docs, spark.createDataFrame([(2, "new")], "id long, title string")).collect()}
    assert (changed[1]["title"], changed[1]["updated_at"]) == ("a", None) and changed[2]["title"] == "new" and changed[2]["updated_at"] is not None
    assert "title" not in S.without_columns(docs, "title").columns


def test_extraction_plug_ins(spark, tmp_path):
    import json

    from docwright import __main__ as job
    from docwright.sources import readers

    for name, text in (("a.pdf", b"one two"), ("b.pdf", b"bad")):
        (tmp_path / name).write_bytes(text)

    def words(raw):
        if raw == b"bad":
            raise ValueError("no file")
        return [(1, 0, i, w, 10.0, 16, "F", 0) for i, w in enumerate(raw.decode().split())]

    files = readers.pdf_files(spark, str(tmp_path))
    spans, rejects = readers.extracted(files, words)
    assert [r["text"] for r in spans.orderBy("pos").collect()] == ["one", "two"] and [r["error"] for r in rejects.collect()] == ["ValueError: no file"]

    def first(raw):
        if raw == b"bad":
            raise ValueError
        return [(1, [["a", "b"]], None, 40.0), (2, [["c", "d"]], [0.0, 0.0, 1.0, 1.0], None)]

    tables = readers.extract_tables(files, {"first": first, "second": lambda raw: [(1, [["e", "f"]], None, 90.0), (2, [["g", "h"]], None, 90.0)]})
    got = {(r["path"][-5:], r["page_number"], r["extractor"], r["cells"][0][0]) for r in tables.collect()}
    assert got == {("a.pdf", 1, "second", "e"), ("a.pdf", 2, "first", "c"), ("b.pdf", 1, "second", "e"), ("b.pdf", 2, "second", "g")}
    pages = files.select(F.lit(7).cast("long").alias("document_id"), "path", F.lit(3).alias("page_number"))
    read = readers.recognise(files, pages, lambda raw, page: [(w, page / 10) for w in words(raw) for w in [w[3]]], "easyocr")
    assert {(r["word"], r["score"]) for r in read.collect()} == {("one", 0.3), ("two", 0.3)}
    typed = E.blocks(spans.withColumn("document_id", F.lit(1).cast("long")))
    none = spark.createDataFrame([(1, 2, 0, "| t |")], "document_id long, page_number int, table_index int, markdown string")
    ocr = spark.createDataFrame([(1, 3, "scan")], "document_id long, page_number int, text string")
    r = E.results(typed, none, ocr).first()
    assert [p["page_number"] for p in r["pages"]] == [1, 2, 3] and r["full_text"] == "one two" and r["pages"][0]["blocks"][0]["is_bold"] and r["pages"][1]["tables"][0]["markdown"] == "| t |" and r["pages"][2]["ocr_text"] == "scan"
    assert E.extract_page(typed, 1).count() == 1 and E.extract_page(typed, 0).count() == 0 and E.extract_page(typed, 1, F.lit(0)).count() == 0
    boxes = spark.range(1).select(E.paired(F.array(F.lit("t"), F.lit("u")), F.array(F.lit(1.0))).alias("p")).first()["p"]
    assert [(x["cells"], x["bbox"]) for x in boxes] == [("t", 1.0), ("u", None)]
    job.main([str(tmp_path), str(tmp_path / "out"), "tests.test_pipelines:_spans_of"])
    rows = [json.loads(line) for f in (tmp_path / "out" / "results").glob("*.json") for line in f.read_text().splitlines()]
    assert sorted(r["full_text"] for r in rows) == ["bad", "one two"]


def _spans_of(raw):
    return [(1, 0, 0, raw.decode(), 10.0, 0, "F", 0)]
