"""Cosine search: exact in blocks of queries, and by an inverted file.

Null vectors, vectors of another size and vectors with a null take no part; a zero vector's distance is null, and null
distances rank last. Equal distances rank by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Queries whose vectors are sent to the workers at once; more queries take more blocks.
QUERY_BLOCK = 2_048
#: The reference's probes, for parity only: they find about 0.6 of the exact neighbours.
PARITY_PROBES = 3
#: What an index must find of the exact neighbours, what its sample must find beyond that (a few queries stray from the sample), and vectors in the sample.
RECALL, MARGIN, SAMPLE = 0.9, 0.03, 512
#: Vectors a list should hold, and vectors that the centroids are fitted on.
LIST, FIT = 1_000, 16_384
FOUND = "qid long, id long, distance double, k long"


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalised(v: Column) -> Column:
    return F.when(norm(v) > 0, F.transform(v, lambda x: x.cast("double") / norm(v)))


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.lit(1.0) - dot / F.nullif(norm(a) * norm(b), F.lit(0.0))


def _ranked(df: DataFrame, k: Column | str, most: int) -> DataFrame:
    """Ranks by distance; first cut at a constant, which the window takes over to the map side, then at each query's own k."""
    w = Window.partitionBy("qid").orderBy(F.col("distance").asc_nulls_last(), F.col("id"))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).where(F.col("rank") <= k)


Block = tuple[np.ndarray, np.ndarray, np.ndarray]


def blocks(queries: DataFrame, size: int = QUERY_BLOCK) -> Iterator[Block]:
    """(qid, unit vectors, k) of the queries, block by block, so that what is broadcast has a fixed bound."""
    rows: list = []
    for r in queries.select("qid", "qvec", "top_k").where("qid is not null and qvec is not null").toLocalIterator():
        rows.append(r)
        if len(rows) == size:
            yield _block(rows)
            rows = []
    if rows:
        yield _block(rows)


def _block(rows: list) -> Block:
    q = np.array([r[1] for r in rows], np.float64)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.array([r[0] for r in rows], np.int64), q / np.linalg.norm(q, axis=1, keepdims=True), np.array([r[2] for r in rows], np.int64)


def _best(ids: np.ndarray, x: np.ndarray, qid: np.ndarray, q: np.ndarray, k: np.ndarray) -> pd.DataFrame:
    """Of each query the k nearest of one batch of vectors."""
    with np.errstate(invalid="ignore", divide="ignore"):
        d = np.round(1 - q @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T, 12)
    parts = []
    for i in range(len(qid)):
        m = int(min(k[i], len(ids)))
        if m > 0:
            top = np.lexsort((ids, np.where(np.isnan(d[i]), np.inf, d[i])))[:m]
            parts.append((np.full(m, qid[i]), ids[top], d[i, top], np.full(m, k[i])))
    return pd.DataFrame({c: np.concatenate(v) for c, v in zip(("qid", "id", "distance", "k"), zip(*parts))}) if parts else pd.DataFrame({"qid": [], "id": [], "distance": [], "k": []})


def _good(b: pd.DataFrame, dim: int) -> pd.DataFrame:
    return b[[len(e) == dim and not any(x is None for x in e) for e in b["embedding"]]].drop_duplicates("id")


def exact_topk(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, id, distance, rank). vectors: id, embedding; queries: qid, qvec, top_k. One scan for any number of queries: every Arrow batch keeps its own best of each block, then one small window ranks them."""
    spark = vectors.sparkSession
    every = [(spark.sparkContext.broadcast(block), int(block[2].max())) for block in blocks(queries)]
    sent, most = [b for b, _ in every], max((m for _, m in every), default=0)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for block in sent:
                qid, q, k = block.value
                own = _good(b, q.shape[1])
                if len(own):
                    yield _best(own["id"].to_numpy(), np.vstack(own["embedding"].to_numpy()).astype(np.float64), qid, q, k)

    good = vectors.where("id is not null and embedding is not null").select("id", "embedding")
    once = good.mapInPandas(best, FOUND).distinct().withColumn("distance", F.when(F.isnan("distance"), None).otherwise(F.col("distance")))
    return _ranked(once, F.col("k"), most).select("qid", "id", "distance", "rank")


def lists_for(rows: int) -> int:
    """As many lists as keep one near `LIST` vectors, at least the reference's ten."""
    return max(10, rows // LIST)


def ivf_fit(vectors: DataFrame, lists: int | None = None, seed: int = 7) -> DataFrame:
    """(list_id, centroid): spherical k-means on at most `FIT` of the vectors (drawn by a hash of the id), made after the load; more lists than a quarter of the sample take a larger one."""
    good = vectors.where("id is not null and embedding is not null and exists(embedding, x -> x <> 0) and forall(embedding, x -> x is not null)")
    rows = good.count()
    lists = lists or lists_for(rows)
    share = max(1, rows // max(FIT, 4 * lists))
    drawn = good.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0).select("embedding").toPandas() if rows else pd.DataFrame({"embedding": []})
    if not len(drawn):
        drawn = good.limit(lists).select("embedding").toPandas()
    x = np.vstack(drawn["embedding"].to_numpy()).astype(np.float64) if len(drawn) else np.zeros((0, 1))
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
    c = _spread(x, min(lists, len(x)), np.random.default_rng(seed))
    for _ in range(15 if len(c) else 0):
        home = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, home, x)
        some = np.linalg.norm(sums, axis=1) > 0
        c[some] = sums[some] / np.linalg.norm(sums[some], axis=1, keepdims=True)
    return vectors.sparkSession.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "list_id int, centroid array<double>")


def _spread(x: np.ndarray, lists: int, rng: np.random.Generator) -> np.ndarray:
    """Starting centroids, each drawn by its distance from those before."""
    if not lists:
        return x[:0].copy()
    chosen = [int(rng.integers(len(x)))]
    far = 1 - x @ x[chosen[0]]
    for _ in range(lists - 1):
        weight = np.maximum(far, 0)
        chosen.append(int(rng.choice(len(x), p=weight / weight.sum())) if weight.sum() > 0 else int(rng.integers(len(x))))
        far = np.minimum(far, 1 - x @ x[chosen[-1]])
    return x[chosen].copy()


def _centres(centroids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(ids, unit vectors) of the lists; a table as small as their number."""
    rows = centroids.orderBy("list_id").collect()
    c = np.array([r["centroid"] for r in rows], np.float64).reshape(len(rows), -1)
    return np.array([r["list_id"] for r in rows], np.int32), c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-30)


def ivf_assign(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """(id, embedding, list_id): the nearest centroid's list; equal distances go to the smaller list."""
    ids, c = _centres(centroids)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = _good(b, c.shape[1])
            if len(b):
                x = np.vstack(b["embedding"].to_numpy()).astype(np.float64)
                yield b.assign(list_id=ids[np.argmax(np.round(x @ c.T / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30), 12), axis=1)])

    good = vectors.where("id is not null and embedding is not null").select("id", "embedding")
    return good.mapInPandas(nearest, "id long, embedding array<float>, list_id int") if len(ids) else good.withColumn("list_id", F.lit(0)).where("false")


def _order(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The lists of each query, nearest first."""
    return np.argsort(np.round(1 - np.nan_to_num(q) @ c.T, 12), axis=1, kind="stable")


def ivf_recall(assigned: DataFrame, centroids: DataFrame, queries: DataFrame) -> list[float]:
    """The share of exact_topk's rows that lie in the nearest list, the two nearest, and so on up to all lists; empty without any row. queries: few, they reach the driver."""
    ids, c = _centres(centroids)
    true = exact_topk(assigned, queries).select("qid", "id").join(assigned.select("id", "list_id"), "id").groupBy("qid", "list_id").count().toPandas()
    if not len(true):
        return []
    place = {qid: {int(ids[l]): n for n, l in enumerate(o)} for block in blocks(queries) for qid, o in zip(block[0].tolist(), _order(block[1], c))}
    nth = np.array([place[q][l] for q, l in zip(true["qid"].tolist(), true["list_id"].tolist())])
    return (np.cumsum(np.bincount(nth, true["count"], len(ids))) / true["count"].sum()).tolist()


def ivf_probes(assigned: DataFrame, centroids: DataFrame, k: int = 10, least: float = RECALL + MARGIN) -> int:
    """The fewest probes that find `least` of the exact k nearest, measured on SAMPLE vectors of the index itself; all lists if it is empty."""
    good = assigned.where("exists(embedding, x -> x <> 0)")
    some = good.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select(F.col("id").alias("qid"), F.col("embedding").cast("array<double>").alias("qvec"), F.lit(k).alias("top_k"))
    found = ivf_recall(assigned, centroids, some)
    return next((i for i, r in enumerate(found, 1) if r >= least), max(1, centroids.count()))


def ivf_topk(assigned: DataFrame, centroids: DataFrame, queries: DataFrame, probes: int = PARITY_PROBES) -> DataFrame:
    """(qid, id, distance, rank) from the `probes` nearest lists of every query. `ivf_probes` tells how many reach the recall.

    The queries' lists are worked out on the driver, block by block; only folders of lists that some query asks are read, and a batch multiplies a list's
    vectors with the queries that ask it. No vector is shuffled.
    """
    spark = assigned.sparkSession
    ids, c = _centres(centroids)
    sent, most, asked = [], 0, set()
    for block in blocks(queries):
        near = ids[_order(block[1], c)[:, :probes]]
        asked.update(near.ravel().tolist())
        most = max(most, int(block[2].max()))
        sent.append(spark.sparkContext.broadcast((*block, {int(l): np.flatnonzero((near == l).any(axis=1)) for l in np.unique(near)})))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for list_id, part in b.groupby("list_id"):
                for block in sent:
                    qid, q, k, of = block.value
                    rows, own = of.get(int(list_id), ()), _good(part, q.shape[1])
                    if len(rows) and len(own):
                        yield _best(own["id"].to_numpy(), np.vstack(own["embedding"].to_numpy()).astype(np.float64), qid[rows], q[rows], k[rows])

    read = assigned.where(F.col("list_id").isin(sorted(asked))) if len(asked) < len(ids) else assigned
    found = read.select("id", "embedding", "list_id").mapInPandas(best, FOUND).distinct().withColumn("distance", F.when(F.isnan("distance"), None).otherwise(F.col("distance")))
    return _ranked(found, F.col("k"), most).select("qid", "id", "distance", "rank")
