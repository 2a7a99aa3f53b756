"""Problem 4: records that differ by small edits, as a set similarity join over runs of `RUN` characters.

Sets: the distinct runs of 16 consecutive characters of a normalised content (lower case, white-space runs one space, ends
trimmed, at least 800 characters). Similarity is Jaccard's; threshold 0.6.

1. One pass over the contents gives each record the hash of its text, the size of its set and `BANDS` list keys, each of
   `ROWS` minima of a one-permutation hash. Records of one text are one class; only its least id goes on, and the class
   takes over that set's answers as they are (a set's answers derived from an equal set's).
2. Index lists: the records of one list key, in blocks by set size (`BLOCK_STEPS` steps of the threshold wide). A record
   visits its own block, and the next only where a partner's size can reach into it; all other blocks are skipped, and
   inside the sizes' ratio must reach the threshold. Lists are joined by key, so adaptive execution splits a hot one.
3. Each record's least partner is its leader, and their similarity is computed from the whole sets. Where two partners
   have one leader, their answer is derived from those two similarities if it can be: Jaccard's distance is a metric, so two
   that are near enough to the leader are near enough to each other, and two whose distances to it differ by more than the
   limit are not. Only pairs this leaves open are computed.

At a similarity of 0.6 a pair shares a list with a probability of 0.998, at 0.65 of 0.9998. `exact=True` takes lists that lose nothing in the place
of step 1's: a list a run, of the runs in each set's prefix in the order of their hashes (two sets as similar as the threshold share one there), with each
record's position. Entries of a list meet only at positions from which the rest of both sets could still make up the overlap that the
threshold asks; those behind are skipped. These lists hold 0.4 of every set, some hundred times as many entries.

Null ids and null contents take no part. Repeated rows of one id count once. Texts are used whole. Empty tables: no rows.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

RUN, LEAST, THRESHOLD, BANDS, ROWS, BLOCK_STEPS = 16, 800, 0.6, 44, 4, 4
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def normal(content: str) -> str:
    """Lower case, white-space runs of Unicode one space, ends trimmed. Python does it in a tenth of the time that the JVM's patterns take."""
    return " ".join(content.lower().split())


def scrambled(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX[1]
    h = (h ^ (h >> np.uint64(27))) * MIX[2]
    return h ^ (h >> np.uint64(31))


def run_hashes(text: str, run: int = RUN) -> np.ndarray:
    """Hashes of the runs of a text, one for each place; doubling over the length of the run (a power of two)."""
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    k, factor = 1, MIX[0]
    with np.errstate(over="ignore"):
        while k < run:
            h = h[:-k] * factor + h[k:]
            factor = factor * factor + np.uint64(2 * k)
            factor |= np.uint64(1)
            k *= 2
        return scrambled(h)


def run_set(text: str) -> np.ndarray:
    return np.unique(run_hashes(text))


def list_keys(h: np.ndarray) -> np.ndarray:
    """BANDS keys from one-permutation minima; an empty bin takes the next filled one's minimum."""
    bins = BANDS * ROWS
    low = np.full(bins, np.iinfo(np.uint64).max, np.uint64)
    which = (h % np.uint64(bins)).astype(np.intp)
    order = np.argsort(which, kind="stable")
    w = which[order]
    first = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
    low[w[first]] = np.minimum.reduceat(h[order], first)
    empty = low == np.iinfo(np.uint64).max
    if empty.any():
        full = np.flatnonzero(~empty)
        low[empty] = low[full[np.searchsorted(full, np.flatnonzero(empty)) % len(full)]] + np.uint64(1)
    key = np.zeros(BANDS, np.uint64)
    for r in range(ROWS):
        key = scrambled(key * MIX[0] + low[r::ROWS])
    return (key.astype(np.uint64) ^ scrambled(np.arange(BANDS, dtype=np.uint64))).view(np.int64)


def contents(records: DataFrame) -> DataFrame:
    """(kind, id, text) of the records that can take part, not yet normalised. records: kind, id, content. Lower case at most triples a length."""
    return records.where("id is not null and content is not null").select("kind", "id", F.col("content").alias("text")).where(F.length("text") * 3 >= LEAST)


def signatures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import xxhash

    for b in batches:
        rows = []
        for kind, id_, text in zip(b["kind"].tolist(), b["id"].tolist(), b["text"].tolist()):
            text = normal(text)
            if len(text) < LEAST:
                continue
            h = run_set(text)
            rows.append((kind, id_, xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass")), len(h), list_keys(h)))
        yield pd.DataFrame(rows, columns=["kind", "id", "same", "size", "keys"])


class Sets:
    """The run sets of the texts seen last."""

    def __init__(self, most: int = 256):
        self.kept: OrderedDict[tuple, np.ndarray] = OrderedDict()
        self.most = most

    def get(self, key: tuple, text: str) -> np.ndarray:
        s = self.kept.pop(key, None)
        self.kept[key] = s = run_set(normal(text)) if s is None else s
        if len(self.kept) > self.most:
            self.kept.popitem(last=False)
        return s


def similarities(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sets = Sets()
    for b in batches:
        rows = []
        for kind, a, c, ta, tc in b.itertuples(index=False, name=None):
            x, y = sets.get((kind, a), ta), sets.get((kind, c), tc)
            both = len(np.intersect1d(x, y, assume_unique=True))
            rows.append((kind, a, c, both / (len(x) + len(y) - both)))
        yield pd.DataFrame(rows, columns=["kind", "id_a", "id_b", "similarity"])


def prefix_lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(kind, id, size, key, place): the runs of every set's prefix, by hash order."""
    for b in batches:
        for kind, id_, text in zip(b["kind"].tolist(), b["id"].tolist(), b["text"].tolist()):
            h = run_set(normal(text))
            most = len(h) - int(np.ceil(THRESHOLD * len(h) - 1e-9)) + 1
            yield pd.DataFrame({"kind": kind, "id": id_, "size": len(h), "key": h[:most].view(np.int64), "place": np.arange(most, dtype=np.int32)})


def exact_candidates(leaders: DataFrame, texts: DataFrame) -> DataFrame:
    """(kind, id_a, id_b) of all pairs that share a prefix run at places from which the overlap asked for can still be reached."""
    own = texts.join(leaders.select("kind", F.col("leader").alias("id")), ["kind", "id"], "left_semi").dropDuplicates(["kind", "id"])
    lists = cut_lineage(own.mapInPandas(prefix_lists, "kind string, id long, size int, key long, place int"))
    side = lambda x: lists.select("kind", "key", F.col("id").alias(x), F.col("size").alias(f"size_{x}"), F.col("place").alias(f"place_{x}"))
    asked = (F.col("size_a") + F.col("size_b")) * (THRESHOLD / (1 + THRESHOLD)) - 1e-6
    left = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b"))
    ordered = (F.col("size_a") < F.col("size_b")) | ((F.col("size_a") == F.col("size_b")) & (F.col("a") < F.col("b")))
    near = side("a").join(side("b"), ["kind", "key"]).where(ordered & (F.col("size_a") >= F.col("size_b") * THRESHOLD - 1e-9) & (left >= asked))
    return near.select("kind", F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()


def banded_candidates(leaders: DataFrame) -> DataFrame:
    """(kind, id_a, id_b) of the pairs that share a min-hash list and fit by size; size blocks out of reach are skipped."""
    step = -BLOCK_STEPS * float(np.log(THRESHOLD))
    block = lambda size: F.floor(F.log(size) / step).cast("int")
    lists = leaders.select("kind", F.col("leader").alias("id"), "size", F.explode("keys").alias("key"))
    reach = F.array_distinct(F.array(block(F.col("size")), block(F.col("size") / THRESHOLD)))
    left = lists.select("kind", "key", F.col("id").alias("a"), F.col("size").alias("size_a"), F.explode(reach).alias("block"))
    right = lists.select("kind", "key", F.col("id").alias("b"), F.col("size").alias("size_b"), block(F.col("size")).alias("block"))
    fits = (F.col("size_a") >= F.col("size_b") * THRESHOLD) & ((F.col("size_a") < F.col("size_b")) | ((F.col("size_a") == F.col("size_b")) & (F.col("a") < F.col("b"))))
    return left.join(right, ["kind", "key", "block"]).where(fits).select("kind", F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()


def similar(records: DataFrame, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """Pairs of class representatives (kind, id_a, id_b), and membership (kind, leader, id) of all records that take part. exact: lists that lose no pair."""
    texts = contents(records)
    signed = cut_lineage(texts.mapInPandas(signatures, "kind string, id long, same binary, size int, keys array<long>"))
    leaders = signed.groupBy("kind", "same").agg(F.min("id").alias("leader"), F.first("size").alias("size"), F.first("keys").alias("keys"))
    members = signed.select("kind", "same", "id").distinct().join(leaders.select("kind", "same", "leader"), ["kind", "same"]).select("kind", "leader", "id")
    candidates = exact_candidates(leaders, texts) if exact else banded_candidates(leaders)
    candidates = cut_lineage(candidates)
    taking = candidates.select("kind", F.explode(F.array("id_a", "id_b")).alias("id")).distinct()
    held = cut_lineage(texts.join(taking, ["kind", "id"], "left_semi").dropDuplicates(["kind", "id"]))

    stars = candidates.groupBy("kind", "id_b").agg(F.min("id_a").alias("id_a"))
    near = cut_lineage(measured(stars, held))
    known = near.select("kind", F.col("id_b").alias("id"), F.col("id_a").alias("of"), (1 - F.col("similarity")).alias("d"))
    side = lambda x: known.select("kind", F.col("id").alias(f"id_{x}"), F.col("of").alias(f"of_{x}"), F.col("d").alias(f"d_{x}"))
    rest = candidates.join(stars, ["kind", "id_a", "id_b"], "left_anti").join(side("b"), ["kind", "id_b"]).join(side("a"), ["kind", "id_a"], "left")
    shared, far = F.col("of_a") == F.col("of_b"), 1 - THRESHOLD
    surely = shared & (F.col("d_a") + F.col("d_b") <= far - 1e-9)
    never = shared & (F.abs(F.col("d_a") - F.col("d_b")) > far + 1e-9)
    judged = cut_lineage(rest.select("kind", "id_a", "id_b", F.when(surely, "yes").when(never, "no").otherwise("open").alias("derived")))
    ids = ("kind", "id_a", "id_b")
    enough = F.col("similarity") >= THRESHOLD - 1e-12
    opened = measured(judged.where("derived = 'open'").select(*ids), held).where(enough)
    return near.where(enough).select(*ids).unionByName(judged.where("derived = 'yes'").select(*ids)).unionByName(opened.select(*ids)), members


def measured(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """(kind, id_a, id_b, similarity) of pairs, by their whole sets; pairs of one id_a stand together, so its set is built once."""
    side = lambda x: held.select("kind", F.col("id").alias(f"id_{x}"), F.col("text").alias(f"text_{x}"))
    rows = pairs.join(side("b"), ["kind", "id_b"]).join(side("a"), ["kind", "id_a"])
    return rows.select("kind", "id_a", "id_b", "text_a", "text_b").sortWithinPartitions("kind", "id_a").mapInPandas(similarities, "kind string, id_a long, id_b long, similarity double")


def expanded(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(record_kind, id_a, id_b): every pair of records, copies among themselves included."""
    a = members.select("kind", F.col("leader").alias("id_a"), F.col("id").alias("x"))
    b = members.select("kind", F.col("leader").alias("id_b"), F.col("id").alias("y"))
    across = pairs.join(a, ["kind", "id_a"]).join(b, ["kind", "id_b"]).select("kind", "x", "y")
    within = a.join(b.withColumnRenamed("id_b", "id_a"), ["kind", "id_a"]).where("x < y").select("kind", "x", "y")
    return across.unionByName(within).select(F.col("kind").alias("record_kind"), F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def both_kinds(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    part = lambda df, kind: df.select(F.lit(kind).alias("kind"), "id", "content")
    return part(documents, "document").unionByName(part(chunks, "chunk"))


def membership(records: DataFrame) -> DataFrame:
    """(record_kind, id, class_id, links): each record that takes part, the least id of its text's class, and the class's links to others."""
    pairs, members = similar(records)
    ends = pairs.select("kind", F.explode(F.array("id_a", "id_b")).alias("leader")).groupBy("kind", "leader").agg(F.count("*").alias("links"))
    return members.join(ends, ["kind", "leader"], "left").select(F.col("kind").alias("record_kind"), "id", F.col("leader").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
