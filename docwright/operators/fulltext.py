"""Full-text search: analysis, AND match, cover-density rank.

The index is one row a text, (id, words array<struct<pos, lexeme>>) in order of position, as a stored tsvector column; positions count stop words.
A question is looked up by its rarest lexeme, so common words cost nothing, and positions are read only of texts that have every lexeme. Nothing but
(question, text) pairs is shuffled. `save_postings` keeps the same index by lexeme on disk, and `from_postings` takes it back.

Null contents have an empty row and match nothing; so does a question of stop words only. Texts and questions must be analysed alike (`stem`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import STOP_WORDS, let, stem_all, tokens
from ..session import cut_lineage

CLASS_WEIGHT = 0.1


def lexemes(text: Column, stem: bool = False) -> Column:
    """The lexemes of a text at their places; stop words are null."""
    kept = F.transform(tokens(text), lambda w: F.when(~w.isin(STOP_WORDS), w))
    return stem_all(kept) if stem else kept


def tsvector(texts: DataFrame, stem: bool = False) -> DataFrame:
    """(id, words) of texts (id, content), each once; stemming is the English Snowball's, in Python by batches, the rest stays in the JVM."""
    own = texts.where("id is not null").select("id", lexemes(F.coalesce("content", F.lit("")), stem).alias("own"))
    return own.select("id", F.filter(F.transform("own", lambda w, i: F.struct((i + 1).alias("pos"), w.alias("lexeme"))), lambda x: x["lexeme"].isNotNull()).alias("words"))


def postings(texts: DataFrame, stem: bool = False) -> DataFrame:
    """(id, lexeme, pos) of texts (id, content); positions start at 1."""
    return tsvector(texts, stem).select("id", F.explode("words").alias("w")).select("id", "w.lexeme", "w.pos")


def from_postings(rows: DataFrame) -> DataFrame:
    """(id, words) of postings, for instance of those of a few lexemes that were read from disk."""
    return rows.groupBy("id").agg(F.sort_array(F.collect_set(F.struct("pos", "lexeme"))).alias("words"))


def query_lexemes(queries: DataFrame, stem: bool = False) -> DataFrame:
    """(qid, lexeme, needed): the distinct lexemes of every question, and how many there are."""
    sets = queries.where("qid is not null").select("qid", F.array_distinct(F.array_compact(lexemes(F.col("question"), stem))).alias("all"))
    return sets.select("qid", F.explode("all").alias("lexeme"), F.size("all").cast("long").alias("needed"))


def matched(index: DataFrame, queries: DataFrame, stem: bool = False) -> DataFrame:
    """(qid, id, all, words) of the texts that have every lexeme of a question; `words` are the question's own."""
    asked = query_lexemes(queries, stem)
    every = index.select("id", F.explode(F.array_distinct(F.col("words.lexeme"))).alias("lexeme"))
    has = cut_lineage(every.join(asked.select("lexeme").distinct(), "lexeme", "left_semi"))  # read twice: for the frequencies, and for the rarest
    often = has.groupBy("lexeme").agg(F.count("*").alias("texts"))
    told = asked.join(often, "lexeme", "left")
    sets = told.groupBy("qid").agg(F.sort_array(F.collect_set("lexeme")).alias("all"), F.min_by("lexeme", F.struct(F.coalesce("texts", F.lit(0)), "lexeme")).alias("lexeme"))
    wide = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = has.join(sets, "lexeme").select("qid", "id", "all").repartition(wide, "id")  # small rows that much work hangs on: adaptive execution must not put them into one task
    own = index.join(pairs, "id")
    return own.where(F.size(F.array_except("all", F.col("words.lexeme"))) == 0).select("qid", "id", "all", F.filter("words", lambda w: F.array_contains("all", w["lexeme"])).alias("words")).dropDuplicates(["qid", "id"])


def match(index: DataFrame, queries: DataFrame, stem: bool = False) -> DataFrame:
    return matched(index, queries, stem).select("qid", "id")


def covers_score(every: Column, words: Column) -> Column:
    """Over all minimal covers of the lexemes, 0.1 / (1 + words in between that match nothing). One pass; it remembers where each lexeme stood last."""
    places = F.transform(words, lambda w, i: F.struct(w["pos"].alias("pos"), i.alias("i"), (F.array_position(every, w["lexeme"]) - 1).cast("int").alias("k")))
    none = F.transform(every, lambda _: F.lit(None).cast("struct<pos:int,i:int>"))

    def step(acc: Column, w: Column) -> Column:
        lasts = F.transform(acc["lasts"], lambda x, j: F.when(j == w["k"], F.struct(w["pos"].alias("pos"), w["i"].alias("i"))).otherwise(x))

        def covered(last: Column) -> Column:
            start = F.when(F.forall(last, lambda x: x.isNotNull()), F.array_min(last))
            return let(start, lambda s: F.struct(last.alias("lasts"), F.coalesce(s["pos"], acc["start"]).alias("start"), (acc["score"] + F.when(s["pos"] > acc["start"], F.lit(CLASS_WEIGHT) / (1 + (w["pos"] - s["pos"]) - (w["i"] - s["i"]))).otherwise(0.0)).alias("score")))

        return let(lasts, covered)

    begin = F.struct(none.alias("lasts"), F.lit(0).alias("start"), F.lit(0.0).alias("score"))
    return F.aggregate(places, begin, step, lambda acc: acc["score"])


def rank_cd(index: DataFrame, queries: DataFrame, stem: bool = False) -> DataFrame:
    """(qid, id, score) of every match."""
    return matched(index, queries, stem).select("qid", "id", F.round(covers_score(F.col("all"), F.col("words")), 12).alias("score"))


def keyword_topk(index: DataFrame, queries: DataFrame, stem: bool = False) -> DataFrame:
    """(qid, id, score, rank); queries: qid, question, top_k. The rank is first cut at the greatest top_k, a constant that reaches into the window, then at each question's own."""
    most = queries.agg(F.max("top_k")).first()[0] or 0
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    best = rank_cd(index, queries, stem).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    return best.join(queries.select("qid", "top_k"), "qid").where("rank <= top_k").select("qid", "id", "score", "rank")
