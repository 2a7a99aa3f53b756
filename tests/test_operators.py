import math

from docwright.functions import text as T
from docwright.operators import answer as A
from docwright.operators import cache as C
from docwright.operators import extraction as E
from docwright.operators import fulltext as X
from docwright.operators import retrieval as R
from docwright.operators import store as S
from docwright.operators import vector as V
from pyspark.sql import functions as F


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'int'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


def test_scalars(spark):
    assert [one(spark, T.approx_tokens(F.col("t")), t=t) for t in ("", "abc", "abcdefgh")] == [1, 1, 2]
    assert one(spark, T.strip(F.col("t")), t="   a b \n") == "a b"
    assert one(spark, T.chunk_uuid(F.lit("a"), F.lit(0), F.lit("x")), t="") == "85a683d1-28a6-7835-a0e9-db65793049ba"
    dates = {"D:20240102030405+05'30'": "2024-01-02T03:04:05+05:30", "D:20240102": "2024-01-02T00:00:00", "D:202401020304": "2024-01-02T03:00:04", "D:2024": "2024", "": None, None: None}
    assert {k: one(spark, T.pdf_date(F.col("t")), t=k) for k in dates} == dates
    numeric = {"1,234": True, "12%": True, "$5": False, "1_000": True, "nan": True, "1d": False, "": False, " 3.5 ": True, "1e5": True}
    assert {k: one(spark, T.is_numeric(F.col("t")), t=k) for k in numeric} == numeric


def test_fusion_of_two_lists(spark):
    sem = spark.createDataFrame([(1, 10, 0.1, 1), (1, 11, 0.2, 2)], "qid long, id long, distance double, rank int")
    kw = spark.createDataFrame([(1, 11, 0.5, 1), (1, 12, 0.4, 2)], "qid long, id long, score double, rank int")
    q = spark.createDataFrame([(1, 5)], "qid long, top_k int")
    got = [(r["id"], round(r["rrf_score"], 6)) for r in R.fuse(sem, kw, q).orderBy("rank").collect()]
    assert got == [(11, 0.016208), (10, 0.011475), (12, 0.004839)]


def test_keyword_only_floor(spark):
    none = spark.createDataFrame([], "qid long, id long, distance double, rank int")
    kw = spark.createDataFrame([(1, i, 1.0 / i, i) for i in range(1, 401)], "qid long, id long, score double, rank int")
    for k, dropped in ((100, 10), (80, 0)):
        fused = R.fuse(none, kw, spark.createDataFrame([(1, k)], "qid long, top_k int"))
        assert fused.where(F.col("rrf_score") < R.RRF_FLOOR).count() == dropped


def test_threshold_comes_after_the_limit(spark):
    angles = [0.1, 0.5, 0.8, 0.9, 1.2]
    vec = lambda d: [1 - d, math.sqrt(max(0, 1 - (1 - d) ** 2))]
    vectors = spark.createDataFrame([(i, vec(d)) for i, d in enumerate(angles)] + [(7, None), (8, [1.0]), (9, [None, 1.0]), (6, [0.0, 0.0])], "id long, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0], 4, 0.800001), (2, [1.0, 0.0], 4, None), (3, [1.0, 0.0], 4, 0.0), (4, [1.0, 0.0], 0, None), (5, None, 4, None)], "qid long, qvec array<double>, top_k int, threshold double")
    counts = {r["qid"]: (r["kept"], r["filtered_count"]) for r in R.filtered_count(R.semantic_hits(vectors, q), q).collect()}
    assert counts[1] == (3, 1) and counts[4] == (0, 0) and counts[5] == (0, 0) and counts[2] == counts[3]


def test_ties_rank_by_id_and_repeated_rows_count_once(spark):
    vectors = spark.createDataFrame([(3, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0])], "id long, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0], 2)], "qid long, qvec array<double>, top_k int")
    assert [r["id"] for r in V.exact_topk(vectors, q).orderBy("rank").collect()] == [1, 2]
    assert V.exact_topk(vectors.limit(0), q).count() == 0 and V.exact_topk(vectors, q.limit(0)).count() == 0


def test_cover_density(spark):
    texts = spark.createDataFrame([(1, "alpha beta x x alpha"), (2, "alpha"), (3, "alpha alpha alpha"), (4, None), (5, "the of")], "id long, content string")
    q = spark.createDataFrame([(1, "alpha beta", 5), (2, "Alpha", 5), (3, "the of", 5), (4, "", 5)], "qid long, question string, top_k int")
    got = {(r["qid"], r["id"]): round(r["score"], 6) for r in X.rank_cd(X.tsvector(texts), q).collect()}
    assert got == {(1, 1): round(0.1 + 0.1 / 3, 6), (2, 1): 0.2, (2, 2): 0.1, (2, 3): 0.3}


def test_block_types(spark):
    cases = [(12.0, "Intro", "heading"), (10.0, "1. x", "list_item"), (9.0, "Fig one", "caption"), (9.0, "Fig one.", "paragraph"), (20.0, "  ", "paragraph"), (9.0, None, "paragraph")]
    df = spark.createDataFrame([(s, t) for s, t, _ in cases], "s double, t string")
    assert [r[0] for r in df.select(E.classify(F.col("s"), F.lit(10.0), F.col("t"))).collect()] == [k for _, _, k in cases]


def test_markdown(spark):
    df = spark.createDataFrame([([["Name", "Qty"], ["apple", "3"]],), ([["1", "2"], ["3", "4"]],), ([["a\nb", None], ["1", "2"]],)], "c array<array<string>>")
    got = [r[0] for r in df.select(E.markdown(F.col("c"))).collect()]
    assert got[0] == "| Name  | Qty |\n| ----- | --- |\n| apple | 3   |"
    assert got[1].split("\n")[0] == "| col_0 | col_1 |" and len(got[1].split("\n")) == 4
    assert got[2].split("\n")[0] == "| a b |   |"


def test_spans_to_blocks(spark):
    spans = spark.createDataFrame([(1, 1, 0, 0, "Big", 14.0, 16, "F", 0), (1, 1, 1, 0, "some  body", 10.0, 0, "", 0), (1, 1, 1, 1, "text here.", 10.0, 0, "G", 0), (1, 1, 2, 0, " ", 10.0, 0, "G", 0), (1, 1, 3, 0, "image", 10.0, 0, "G", 1)], "document_id long, page_number int, block_pos int, pos int, text string, size double, flags int, font string, type int")
    got = [(r["block_pos"], r["text"], r["block_type"], r["is_bold"], r["font_name"], r["section_heading"]) for r in E.blocks(spans).orderBy("block_pos").collect()]
    assert got == [(0, "Big", "heading", True, "F", None), (1, "some body text here.", "paragraph", False, "G", "Big")]


def test_judge_replies(spark):
    cases = {'{"faithfulness":0.4}': (0.4, ""), "{}": (0.0, ""), '```json {"faithfulness": 1}': (0.5, "parse error"), None: (0.5, "parse error"), "[1]": (0.5, "parse error"), '{"faithfulness":"x"}': (0.5, "parse error"), '{"faithfulness":1,"reason":"r"}': (1.0, "r")}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert [tuple(r[0]) for r in df.select(A.parse_verdict(F.col("t"))).collect()] == list(cases.values())
    assert one(spark, A.gate(F.lit("a"), F.lit(0.49)), t="") == A.NOT_SUPPORTED and one(spark, A.gate(F.lit("a"), F.lit(0.5)), t="") == "a"


def test_sources_can_exceed_what_was_kept(spark):
    hits = spark.createDataFrame([(1, 1, "same text", 1), (1, 2, "other", 2), (1, 3, "same text", 3)], "qid long, id long, content string, rank int")
    q = spark.createDataFrame([(1, "same text")], "qid long, question string")
    kept = A.rerank(hits, q, 1)
    assert kept.count() == 1 and sorted(r["id"] for r in A.sources(hits, kept).collect()) == [1, 3]
    assert A.prompts(q, kept).first()["prompt"].endswith("Context:\n[1] same text\n\nQuestion: same text\n\nAnswer:")


def test_cache(spark):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    c = C.entries(spark.createDataFrame([("response:a", "1"), ("embedding:b", "2")], "key string, value string"), now, 10)
    hits = C.lookup(spark.createDataFrame([(1, "response:a"), (2, "response:z"), (3, None)], "qid long, key string"), c, now)
    assert {r["qid"]: (r["value"], r["hit"]) for r in hits.collect()} == {1: ("1", True), 2: (None, False), 3: (None, False)}
    assert C.live(c, now + F.expr("interval 10 seconds")).count() == 0
    assert [r["key"] for r in C.invalidate(c).collect()] == ["embedding:b"]


def test_store_round_trip_and_validation(spark, tmp_path):
    from docwright.schemas import CHUNK, DOCUMENT

    df = spark.createDataFrame([(1, "t", "c")], "id long, title string, content string")
    S.write_version(df, str(tmp_path / "d"), DOCUMENT)
    S.write_version(df.withColumn("title", F.lit("new")), str(tmp_path / "d"), DOCUMENT)
    back = S.read_current(spark, str(tmp_path / "d"))
    assert back.schema.fieldNames() == DOCUMENT.fieldNames() and back.first()["title"] == "new" and back.first()["extraction_status"] == "pending"
    assert "chunk_type" in CHUNK.fieldNames()
    r = spark.createDataFrame([("q", 5, "hybrid"), (" ", 5, "hybrid"), (None, 5, None), ("q", 0, None), ("q", 21, "hybrid"), ("q", 5, "x"), ("q", None, None)], "q string, k int, m string")
    got = [x[0] for x in r.select(S.problem(F.col("q"), F.col("k"), F.col("m"))).collect()]
    assert got == [None, "blank question", "blank question", "top_k out of 1..20", "top_k out of 1..20", "unknown mode", "top_k out of 1..20"]


def test_sources(spark, tmp_path):
    from docwright.sources import readers

    (tmp_path / "a.pdf").write_bytes(b"x y")
    (tmp_path / "b.PDF").write_bytes(b"no")
    (tmp_path / "c.pdf").write_bytes(b"")
    files = readers.pdf_files(spark, str(tmp_path))
    assert files.count() == 1
    spans = readers.extract_pdf(files, lambda raw: [(1, 0, i, w, 10.0, 0, "F", 0) for i, w in enumerate(raw.decode().split())])
    assert [r["text"] for r in spans.orderBy("pos").collect()] == ["x", "y"]
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "d.json").write_text('{"title":"t","content":"c"}\n{"title":"","content":"c"}\n{"title":"t","content":" "}\n')
    good, bad = readers.text_documents(spark, str(tmp_path / "j"))
    assert good.count() == 1 and bad.count() == 2


def test_streams(spark, tmp_path):
    from docwright.schemas import DOCUMENT, conform
    from docwright.streaming import ingest

    conform(spark.createDataFrame([(1, "a b c")], "id long, content string"), DOCUMENT).write.parquet(str(tmp_path / "in"))
    q = ingest.chunk_stream(ingest.incoming_documents(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert [r["text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["a b c"]
