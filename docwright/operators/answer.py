"""From hits to answers: rerank, sources, prompts, faithfulness and its gate. Models are plug-ins; see functions.models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.models import generated, lexical_score
from ..functions.text import tokens

#: Texts and prompts of the answer contract.
NOTHING_FOUND = "I could not find relevant information in the documents."
NOT_SUPPORTED = "I was unable to produce a fully supported answer from the provided documents. Please rephrase your question or consult the source material directly."
ASK = """You are a helpful assistant. Answer the question using only the context provided below.
If the answer is not in the context, say "I could not find relevant information in the documents."

Context:
{context}

Question: {question}

Answer:"""
JUDGE = """You are a strict fact-checker.
Given a CONTEXT and an ANSWER, score how well the answer is supported by the context.
Rules:
- Score 1.0 if every claim in the answer is directly supported by the context
- Score 0.5 if most claims are supported but some are vague or slightly beyond context
- Score 0.0 if the answer contains claims not found in the context, or contradicts it
- Output ONLY a JSON object like: {"faithfulness": 0.8, "reason": "one sentence"}
- No preamble, no markdown, just the JSON
CONTEXT:
{context}
ANSWER:
{answer}"""
LEAST_FAITHFUL, UNREADABLE = 0.5, 0.5


Scored = Callable[[Column, Column], Column]


def rerank(hits: DataFrame, queries: DataFrame, keep: Column | int = 5, score: Scored = lexical_score) -> DataFrame:
    """(qid, id, content, rank, score, place): the best by the scorer's score; equal scores keep their retrieval order. hits: qid, id, content, rank.

    score: of (question, content), for instance `lambda q, c: models.scored(q, c, factory)` with a cross-encoder's factory.
    """
    scored = hits.join(queries.select("qid", "question", *(c for c in ("top_k",) if c in queries.columns)), "qid").withColumn("score", F.round(score(F.col("question"), F.col("content")), 6))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "rank", "id")
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= keep).select("qid", "id", "content", "rank", "score", "place")


def sources(hits: DataFrame, reranked: DataFrame) -> DataFrame:
    """All hits whose text was kept, in retrieval order: equal texts all come along, so there can be more than were kept."""
    return hits.join(reranked.select("qid", "content").distinct(), ["qid", "content"], "left_semi")


def source_rows(chosen: DataFrame) -> DataFrame:
    """(qid, sources): the chosen hits of every question in retrieval order, rounded for display. A question has no more hits than its search fetched."""
    row = F.struct("rank", "id", "content", F.round("distance", 4).alias("distance"), F.round("rrf_score", 6).alias("rrf_score"), F.round("fts_rank", 6).alias("fts_rank"))
    return chosen.groupBy("qid").agg(F.sort_array(F.collect_set(row)).alias("sources"))


def filled(template: str, **columns: Column) -> Column:
    """The template with its {names} taken from columns."""
    parts, rest = [], template
    for name in sorted(columns, key=lambda n: template.index("{" + n + "}")):
        before, rest = rest.split("{" + name + "}", 1)
        parts += [F.lit(before), columns[name]]
    return F.concat(*parts, F.lit(rest))


def contexts(reranked: DataFrame) -> DataFrame:
    """(qid, context): the kept texts numbered from 1, blank lines between them."""
    ordered = F.sort_array(F.collect_list(F.struct("place", "content")))
    return reranked.groupBy("qid").agg(F.array_join(F.transform(ordered, lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), c["content"])), "\n\n").alias("context"))


def prompts(queries: DataFrame, reranked: DataFrame) -> DataFrame:
    """(qid, prompt) for the generator."""
    return queries.select("qid", "question").join(contexts(reranked), "qid").select("qid", filled(ASK, context=F.col("context"), question=F.col("question")).alias("prompt"))


def judge_prompts(answers: DataFrame, reranked: DataFrame) -> DataFrame:
    """(qid, prompt) for the judge; answers: qid, answer."""
    return answers.select("qid", "answer").join(contexts(reranked), "qid").select("qid", filled(JUDGE, context=F.col("context"), answer=F.col("answer")).alias("prompt"))


def faithfulness(answer: Column, context: Column) -> Column:
    """Stand-in for a judge: the share of the answer's words that the context has."""
    a = F.array_distinct(tokens(answer))
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.round(F.size(F.array_intersect(a, tokens(context))) / F.size(a), 6))


def stand_in_judge(answer: Column, context: Column) -> Column:
    """struct<score, reason> by `faithfulness`."""
    return F.struct(faithfulness(answer, context).alias("score"), F.lit("share of the answer's words in the context").alias("reason"))


def judged_by(factory: Callable[[], Callable[[list[str]], list[str]]]) -> Scored:
    """A judge by a model plug-in that answers the judge's prompt with JSON."""
    return lambda answer, context: parse_verdict(generated(filled(JUDGE, context=context, answer=answer), factory))


def parse_verdict(reply: Column) -> Column:
    """struct<score, reason> of a judge's JSON: missing score 0, missing reason ''; a reply that is no JSON object, or whose score is no number, is 0.5 and 'parse error'."""
    v = F.try_parse_json(reply)
    kind = F.schema_of_variant(v)
    score = F.try_variant_get(v, "$.faithfulness", "double")
    has = F.try_variant_get(v, "$.faithfulness", "variant")
    bad = v.isNull() | ~kind.startswith("OBJECT") | (has.isNotNull() & score.isNull())
    return F.when(bad, F.struct(F.lit(UNREADABLE).alias("score"), F.lit("parse error").alias("reason"))).otherwise(F.struct(F.coalesce(score, F.lit(0.0)).alias("score"), F.coalesce(F.try_variant_get(v, "$.reason", "string"), F.lit("")).alias("reason")))


def gate(answer: Column, score: Column) -> Column:
    return F.when(score < LEAST_FAITHFUL, F.lit(NOT_SUPPORTED)).otherwise(answer)


def with_fallback(queries: DataFrame, answers: DataFrame) -> DataFrame:
    """Every question with its answer; those without a hit get the fixed text and are not to be cached."""
    return queries.select("qid").join(answers.select("qid", "answer"), "qid", "left").select("qid", F.coalesce("answer", F.lit(NOTHING_FOUND)).alias("answer"), F.col("answer").isNotNull().alias("cacheable"))
