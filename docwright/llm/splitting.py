"""Problem 2: oversized items cut into pieces at natural boundaries, by dynamic programming; and an audit of stored pieces.

Places where a text may be cut have a penalty: an empty line 0, a sentence end 1, white space inside a sentence 12, any
character 60. Inner places are offered only inside sentences that could not stand in one piece with an overlap. A cut
fixes what the next piece repeats: the longest run of whole sentences before it of at most `OVERLAP` characters. The
program minimises the sum of the penalties and of the squared imbalance of the pieces' sizes (as shares of the limit),
under the hard limit of `LIMIT` characters a piece, its overlap included. `no_boundary` tells that the path cut a sentence above the limit.

Sentences are problem 6's, with the documents' own texts as corpus and without the notices of sites.

Nulls, empty and blank contents give no piece; a content within the limit is one piece, its ends trimmed. Repeated rows of one id
count once. An audited piece without its document, or that does not stand in the document's content, can only have a wrong
overlap; a null `overlap_tokens_prev` is never right. Lengths are code points. Empty tables give empty results.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WHITE, strip
from .sentences import NOTHING, Knowledge, knowledge, sentences

LIMIT, OVERLAP = 1_600, 243
PENALTY = {"paragraph": 0.0, "sentence": 1.0, "space": 12.0, "inside": 60.0}
BALANCE = 4.0
#: Where a stretch without white space must be cut, places stand this often a limit.
GRID = 64
BLANK = re.compile(r"\s+")


def places(text: str, units: list[tuple[int, int]], limit: int, overlap: int) -> list[tuple[int, int, float]]:
    """(end of the left side, start of the right side, penalty) of every place where text may be cut."""
    out = []
    for k, (s, e) in enumerate(units):
        if e - s > limit - overlap:
            blank = [(m.start(), m.end()) for m in BLANK.finditer(text, s, e)]
            words = [s, *(r for _, r in blank)], [*(l for l, _ in blank), e]
            for a, b, cut in zip(*words, [*blank, None]):
                if b - a > limit - overlap:  # nothing but characters, all alike: a fine grid of them
                    out += [(i, i, PENALTY["inside"]) for i in range(a + max(1, limit // GRID), b, max(1, limit // GRID))]
                if cut:
                    out.append((*cut, PENALTY["space"]))
        if k + 1 < len(units):
            gap = text[e : units[k + 1][0]]
            out.append((e, units[k + 1][0], PENALTY["paragraph" if gap.count("\n") > 1 else "sentence"]))
    return out


def split(text: str | None, limit: int = LIMIT, overlap: int = OVERLAP, corpus: Knowledge = NOTHING) -> tuple[list[tuple[int, int, int]], bool]:
    """(start, end, characters shared with the piece before) of the pieces, and whether the path had to cut a sentence longer than the limit."""
    if not text or not text.strip():
        return [], False
    first = len(text) - len(text.lstrip())
    last = len(text.rstrip())
    if last - first <= limit:
        return [(first, last, 0)], False
    units = sentences(text, corpus)
    starts = [s for s, _ in units]
    nodes = [(first, first, 0.0), *places(text, units, limit, overlap), (last, last, 0.0)]

    def repeat(left: int, right: int) -> int:
        """Where the piece that follows a cut starts."""
        k = bisect_left(starts, left - overlap)
        return starts[k] if k < len(starts) and starts[k] < left else right

    begin = [first] + [repeat(a, b) for a, b, _ in nodes[1:]]
    best: list[tuple[float, int]] = [(0.0, -1)] + [(float("inf"), -1)] * (len(nodes) - 1)
    low = 0
    for j in range(1, len(nodes)):
        end, _, penalty = nodes[j]
        while low < j and end - nodes[low][1] > limit:
            low += 1
        for i in range(low, j):
            start = begin[i]
            if end - start > limit:
                start = nodes[i][1]  # this piece can't take the overlap
                if end - start > limit:
                    continue
            fill = (end - start) / limit
            cost = best[i][0] + penalty + BALANCE * (1 - fill) ** 2
            if cost < best[j][0]:
                best[j] = (cost, i)
    path, j = [], len(nodes) - 1
    while j > 0:
        path.append((best[j][1], j))
        j = best[j][1]
    pieces, forced, cuts = [], False, []
    for i, j in reversed(path):
        end, start = nodes[j][0], begin[i]
        if end - start > limit:
            start = nodes[i][1]
        pieces.append((start, end, max(0, nodes[i][0] - start) if i else 0))
        if nodes[j][2] >= PENALTY["space"]:
            cuts.append(end)
    for at in cuts:  # a cut inside a sentence was forced if the whole sentence would stand in no piece
        s, e = units[bisect_right(starts, at - 1) - 1]
        forced |= e - s > limit
    return pieces, forced


def approx_tokens(n: int) -> int:
    return max(1, n // 4) if n else 0


def split_documents(documents: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, longer_only: bool = False) -> DataFrame:
    """(document_id, chunk_index, content, overlap_tokens_prev, start, forced) of every document (or of those above the limit): its pieces, and whether its path cut a sentence above the limit."""
    good = documents.where("id is not null and content is not null").select("id", "content")
    corpus = knowledge(good.select(F.col("content").alias("text")))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t in zip(b["id"].tolist(), b["content"].tolist()):
                pieces, forced = split(t, limit, overlap, corpus)
                rows += [(i, k, t[s:e], approx_tokens(n), s, forced) for k, (s, e, n) in enumerate(pieces)]
            yield pd.DataFrame(rows, columns=["document_id", "chunk_index", "content", "overlap_tokens_prev", "start", "forced"])

    asked = good.where(F.length(strip(F.col("content"))) > limit) if longer_only else good
    return asked.mapInPandas(cut, "document_id long, chunk_index int, content string, overlap_tokens_prev int, start int, forced boolean")


def checked(documents: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(document_id, digest, within, few_shared, numbered) of every document with pieces: the digest of what the pieces say without their overlaps and without white space, which must be the document's own, and whether every piece keeps the rules."""
    rows = split_documents(documents, limit, overlap).distinct()
    of = Window.partitionBy("document_id").orderBy("chunk_index")
    shared = F.greatest(F.coalesce(F.lag(F.col("start") + F.length("content")).over(of) - F.col("start"), F.lit(0)), F.lit(0))
    own = rows.withColumn("shared", shared).withColumn("new", F.struct("chunk_index", F.expr("substr(content, shared + 1)").alias("text")))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list("new")), lambda x: x["text"]), "")
    return own.groupBy("document_id").agg(
        F.md5(F.regexp_replace(whole, f"[{WHITE}]+", "")).alias("digest"), F.bool_and(F.length("content") <= limit).alias("within"),
        F.bool_and((F.col("shared") <= overlap) & (F.col("overlap_tokens_prev") == F.when(F.col("shared") == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.col("shared") / 4))))).alias("few_shared"),
        (F.max("chunk_index") + 1 == F.count("*")).alias("numbered"),
    )


def oversized(documents: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(document_id, kind): `oversized` where the program made more than one piece, and `no_boundary` where its path had to cut a sentence above the limit."""
    second = split_documents(documents, limit, longer_only=True).where("chunk_index = 1")
    kinds = F.when(F.col("forced"), F.array(F.lit("oversized"), F.lit("no_boundary"))).otherwise(F.array(F.lit("oversized")))
    return second.select("document_id", F.explode(kinds).alias("kind")).distinct()


def shared(before: str, here: str) -> int:
    """The length of the longest text that ends one and starts the other."""
    n = min(len(before), len(here))
    if not n:
        return 0
    head, at = here[: min(12, n)], len(before) - n
    while (at := before.find(head, at)) >= 0:
        if here.startswith(before[at:]):
            return len(before) - at
        at += 1
    for k in range(len(head) - 1, 0, -1):
        if before.endswith(here[:k]):
            return k
    return 0


def in_word(a: Column, b: Column) -> Column:
    """Whether two neighbouring characters are letters or digits of a script that has words."""
    word, free = r"^[\p{L}\p{N}]$", r"^[\x{3040}-\x{30ff}\x{3400}-\x{9fff}]$"
    return a.rlike(word) & b.rlike(word) & ~a.rlike(free) & ~b.rlike(free)


def audit(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(document_id, chunk_index, kind) of stored text pieces cut in a word or with a wrong overlap."""
    stored = chunks.where("document_id is not null and chunk_index is not null and content is not null and content <> ''")
    text = stored.where("chunk_type = 'text'").select("document_id", "chunk_index", "content", "overlap_tokens_prev")
    whole = documents.where("id is not null and content is not null").groupBy(F.col("id").alias("document_id")).agg(F.max("content").alias("whole"))
    at, size = F.col("at"), F.length("content")
    cut = (
        text.select("document_id", "chunk_index", "content").join(whole, "document_id")
        .withColumn("at", F.expr("instr(whole, content)")).where(at > 0)
        .where(((at > 1) & in_word(F.expr("substr(whole, at - 1, 1)"), F.substring("content", 1, 1))) | in_word(F.expr("right(content, 1)"), F.substring("whole", at + size, F.lit(1))))
        .select("document_id", "chunk_index", F.lit("cut_in_word").alias("kind"))
    )

    @F.pandas_udf("int")
    def right(before: pd.Series, here: pd.Series) -> pd.Series:
        return pd.Series([approx_tokens(shared(a, b)) for a, b in zip(before, here)], dtype="int32")

    previous = stored.select("document_id", (F.col("chunk_index") + 1).alias("chunk_index"), F.col("content").alias("before"))
    wrong = text.join(previous, ["document_id", "chunk_index"]).where(~F.col("overlap_tokens_prev").eqNullSafe(right("before", "content"))).select("document_id", "chunk_index", F.lit("wrong_overlap").alias("kind"))
    return cut.unionByName(wrong).distinct()


def found(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(document_id, chunk_index, kind) as problem 2 asks."""
    return oversized(documents).select("document_id", F.lit(-1).alias("chunk_index"), "kind").unionByName(audit(chunks, documents))
