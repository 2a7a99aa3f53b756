"""Problem 5: the k most similar vectors of every vector, by collision counting.

1. Vectors that are null, all zero, of another size or with a null or NaN element take no part. Copies of one vector beyond
   k + 1 are set apart: their k nearest are the k smallest other ids of the same vector, so a vector that a third of all
   rows share never fills a cell.
2. Cells: centroids of a spherical k-means on a bounded sample (`SAMPLE` rows), and second-level ones in cells that would be
   large, fitted on the workers from one row in 375 (nothing else is fitted on a sample). Every
   vector asks its `probes` nearest cells as far as their cosines are within `MARGIN`, and is indexed in the nearest `STORED` of these. A cell expected to hold more than `BLOCK`
   rows is dealt to blocks of data and of queries, so no task gets an unbounded group.
3. In a block every vector has one projection on each of `LINES` fixed random lines, and each line is a sorted array. A
   query's window on a line is centred on the query and found by binary search; virtual rehashing widens all windows with the
   radius, round by round, and counts only what they grew by. The windows are bitmaps (those below the upper end without those below
   the lower), so 64 vectors are counted by one machine operation. Vectors that reach the collision threshold, and no others, are verified: exact
   cosine (of 16-bit levels an error below 1e-4). A query ends when k verified vectors stand within the round's radius, or when
   `VERIFY` (in its own cell) or `VERIFY_AWAY` vectors beyond k would be verified; where more collide, those that collide most often are taken.
4. The best k of all probed cells are a graph. The more cells there are, the oftener two neighbours ask different ones, so vectors that stand within
   `HOPS` steps of one another meet once more: each takes the smallest hash that its strong links reach, and all of one hash are compared exactly.
5. The best k of both are kept; equal cosines go to the smaller id.

Vectors travel as whole numbers: exactly, a byte a number, where a power of two makes them such, else as 16-bit levels.

Repeated rows of one id count once. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, pairwise
from math import erf, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut_lineage

K, DIM = 5, 384
SAMPLE, CELL, CELLS, SUBS, BLOCK, PROBES, STORED, MARGIN = 16_384, 2_000, 2_048, 65_536, 12_000, 4, 2, 0.1
#: Steps along links that bring vectors together; a link is strong up to so many times the squared distance of the farthest neighbour of either end; rows compared at once.
HOPS, STRONG, MEET = 3, 1.5, 4_096
#: Random lines, boundaries of a sorted array, half width of a window in radii, standard deviations below the mean at which a count still passes, steps
#: of the tighter threshold, queries counted at once.
LINES, STEPS, WIDTH, DOUBT, TIGHTER, QUERIES, SEED = 255, 128, 1.3, 2.0, 6, 512, 11
#: Radii of the rounds, as distances of unit vectors; at 2 every vector is inside.
RADII = (0.85, 1.0, 1.2, 1.42, 2.0)
#: A query ends once so many vectors beyond k are verified, in its own cell and in others.
VERIFY, VERIFY_AWAY = 160, 40
#: Kinds of vectors with many copies that are sent to all workers at most; more of them are joined by hash.
HOT_SENT = 50_000


def usable(vectors: DataFrame, dim: int) -> DataFrame:
    good = f"size(embedding) = {dim} and exists(embedding, x -> x <> 0) and forall(embedding, x -> x is not null and not isnan(x))"
    return vectors.where("id is not null and embedding is not null").where(good).select("id", "embedding")


def unit(rows: pd.Series) -> np.ndarray:
    x = np.vstack(rows.to_numpy()).astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def packed(rows: pd.Series) -> list[bytes]:
    """Each vector as whole numbers in its direction: int8 if a power of two times it is that exactly, else int16 levels."""
    x = np.vstack(rows.to_numpy()).astype(np.float32)
    part, power = np.frexp(x)
    whole = np.ldexp(part, 24).astype(np.int32)
    low = np.frexp((whole & -whole).astype(np.float32))[1] + power  # of the lowest bit that is set
    grid = np.ldexp(x.astype(np.float64), 25 - np.where(x != 0, low, 9999).min(axis=1)[:, None])
    most = np.abs(x).max(axis=1, keepdims=True)
    levels = np.rint(x / most * 32767).astype(np.int16)
    small = np.abs(grid).max(axis=1) <= 127
    return [(g.astype(np.int8) if s else v).tobytes() for g, v, s in zip(grid, levels, small)]


def unpacked(sent: pd.Series, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The whole numbers of packed vectors, and what makes each vector one of length 1."""
    x = np.empty((len(sent), dim), np.int16)
    short = (sent.str.len() == dim).to_numpy()
    for some, kind in ((short, np.int8), (~short, np.int16)):
        x[some] = np.frombuffer(b"".join(sent[some]), kind).reshape(-1, dim)
    return x, 1 / np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64))


def centroids(sample: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    c = sample[rng.choice(len(sample), count, replace=False)].copy()
    for _ in range(rounds):
        home = np.argmax(sample @ c.T, axis=1)
        order = np.argsort(home, kind="stable")
        sums = np.add.reduceat(sample[order], np.searchsorted(home[order], np.arange(count)).clip(max=len(order) - 1), axis=0)
        some = np.bincount(home, minlength=count) > 0
        c[some] = sums[some] / np.maximum(np.linalg.norm(sums[some], axis=1, keepdims=True), 1e-30)
    return c


def sub_centroids(vectors: DataFrame, dim: int, c: np.ndarray, share: np.ndarray) -> list[np.ndarray]:
    """Of each cell its second-level centres: cells expected to hold more than two times CELL vectors are split by a k-means over their
    own sample (one row in CELL / 8), fitted cell by cell on the workers. At most SUBS centres in all."""
    wanted = np.where(share > 2 * CELL, np.ceil(share / CELL), 1)
    wanted = np.maximum(1, wanted * min(1.0, SUBS / wanted.sum())).astype(int)
    out = [c[i : i + 1] for i in range(len(c))]
    if (wanted > 1).any():
        first = vectors.sparkSession.sparkContext.broadcast(c)

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    x = unit(b["embedding"])
                    home = np.argmax(x @ first.value.T, axis=1)
                    some = wanted[home] > 1
                    yield pd.DataFrame({"cell": home[some], "v": [v.tobytes() for v in x[some]]})

        def fit(b: pd.DataFrame) -> pd.DataFrame:
            x = np.frombuffer(b"".join(b["v"]), np.float32).reshape(len(b), -1)
            cell = int(b["cell"].iloc[0])
            return pd.DataFrame({"cell": [cell], "v": [centroids(x, min(int(wanted[cell]), max(1, len(x) // 3))).astype(np.float32).tobytes()]})

        rows = usable(vectors, dim).where(F.pmod(F.xxhash64("id"), F.lit(max(1, CELL // 8))) == 1 % max(1, CELL // 8))
        made = rows.mapInPandas(assign, "cell int, v binary").groupBy("cell").applyInPandas(fit, "cell int, v binary")
        for r in made.toLocalIterator():
            out[r["cell"]] = np.frombuffer(bytes(r["v"]), np.float32).reshape(-1, c.shape[1])
    return out


def nearest_cells(x: np.ndarray, c: np.ndarray, subs: list[np.ndarray], base: np.ndarray, ask: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each vector its up to `ask` nearest second-level cells, best first, and how many of them are within MARGIN of the best."""
    near = x @ c.T
    top = np.argsort(-near, axis=1, kind="stable")[:, :ask]
    near = np.take_along_axis(near, top, 1)
    ids = np.full((len(x), ask * ask), -1)
    sims = np.full((len(x), ask * ask), -9.0, np.float32)
    open_ = near >= near[:, :1] - MARGIN
    for cell in np.unique(top[open_]).tolist():
        rows, place = np.nonzero((top == cell) & open_)
        s = x[rows] @ subs[cell].T
        m = min(ask, s.shape[1])
        best = np.argsort(-s, axis=1, kind="stable")[:, :m]
        for j in range(m):
            ids[rows, place * ask + j] = base[cell] + best[:, j]
            sims[rows, place * ask + j] = s[np.arange(len(rows)), best[:, j]]
    order = np.argsort(-sims, axis=1, kind="stable")[:, :ask]
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    return ids, ((sims >= sims[:, :1] - MARGIN) & (ids >= 0)).sum(axis=1)


class Counts:
    """Collision counts of many (query, vector) pairs at once, one bit plane a binary digit: 64 pairs a machine word, added by full adders."""

    def __init__(self, queries: int, words: int, digits: int):
        self.planes = [np.zeros((queries, words), np.uint64) for _ in range(digits)]
        self.waiting: list[np.ndarray | None] = [None] * digits
        self.idle: list[np.ndarray] = []
        self.part = np.empty((queries, words), np.uint64)

    def room(self) -> np.ndarray:
        """An array for a bitmap, taken over from one that was counted."""
        return self.idle.pop() if self.idle else np.empty_like(self.part)

    def add(self, bits: np.ndarray) -> None:
        """Counts one more collision for every pair whose bit is set; `bits` is used up."""
        for i, plane in enumerate(self.planes):
            other, self.waiting[i] = self.waiting[i], None
            if other is None:
                self.waiting[i] = bits
                return
            np.bitwise_and(other, bits, out=self.part)
            other ^= bits
            np.bitwise_and(other, plane, out=bits)
            bits |= self.part
            plane ^= other
            self.idle.append(other)

    def settle(self) -> None:
        for i in range(len(self.planes)):
            bits, self.waiting[i] = self.waiting[i], None
            for plane in self.planes[i:] if bits is not None else ():
                carry = plane & bits
                plane ^= bits
                bits = carry

    def at_least(self, least: int, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        """The bitmap of the pairs that collided on at least so many lines."""
        planes = [p[rows] for p in self.planes]
        more = np.zeros_like(planes[0])
        if least >> len(planes):
            return more
        same = ~more
        for i in range(len(planes) - 1, -1, -1):
            if least >> i & 1:
                same &= planes[i]
            else:
                more |= same & planes[i]
                same &= ~planes[i]
        return more | same

    def keep(self, rows: np.ndarray) -> None:
        self.planes = [p[rows] for p in self.planes]
        self.idle, self.part = [], np.empty_like(self.planes[0])


class Lines:
    """The sorted arrays of one block: a projection a line. Of each, every n / STEPS-th value, and the bitmap of the vectors that stand below it."""

    def __init__(self, x: np.ndarray):
        self.lines = np.random.default_rng(SEED).standard_normal((x.shape[1], LINES)).astype(np.float32)
        n, levels = len(x), x @ self.lines
        self.words = -(-n // 64)
        cuts = np.linspace(0, n, min(STEPS, n) + 1).round().astype(int)
        self.values: list[np.ndarray] = []
        self.below: list[np.ndarray] = []
        step = np.searchsorted(cuts, np.arange(n), "right")  # of each rank the first boundary above it
        word, bit = np.divmod(np.arange(n), 64)
        bit = np.uint64(1) << bit.astype(np.uint64)
        for j in range(LINES):
            order = np.argsort(levels[:, j], kind="stable")
            below = np.zeros((len(cuts), self.words), np.uint64)
            np.bitwise_or.at(below, (step, word[order]), bit[order])
            self.values.append(levels[order[cuts[1:-1]], j])
            self.below.append(np.bitwise_or.accumulate(below, axis=0))

    def window(self, j: int, at: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
        """The window around each query on a line, as places in the sorted array."""
        return np.searchsorted(self.values[j], at - width), np.searchsorted(self.values[j], at + width) + 1


def needed_collisions(doubt: float = DOUBT) -> int:
    """The collision threshold: what a vector just inside the radius reaches but for `doubt` standard deviations. Windows grow with the radius, so it serves all rounds."""
    p = erf(WIDTH / sqrt(2))
    return int(LINES * p - doubt * sqrt(LINES * p * (1 - p)))


def search(qid: np.ndarray, q: np.ndarray, most: np.ndarray, xid: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query its up to k best (row, id, cosine) in one block, of the vectors that reached the collision threshold."""
    own, least = Lines(x), needed_collisions()
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(q), QUERIES):
        rows = np.arange(at, min(at + QUERIES, len(q)))
        levels = np.ascontiguousarray((q[rows] @ own.lines).T)
        counts, open_ = Counts(len(rows), own.words, LINES.bit_length()), rows
        near, verified = np.zeros(len(rows), int), np.zeros(len(rows), int)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        done = before = None
        for radius in RADII:
            windows = []
            for j in range(LINES):
                low, high = own.window(j, levels[j, open_ - at], WIDTH * radius)
                ring, below = counts.room(), own.below[j]
                np.take(below, high, axis=0, out=ring, mode="clip")
                for edge in (low, *before[j]) if before is not None else (low,):  # of a wider window only what it grew by
                    ring ^= np.take(below, edge, axis=0, out=counts.part, mode="clip")
                counts.add(ring)
                windows.append((low, high))
            counts.settle()
            hits = counts.at_least(least)
            fresh = hits & ~done if done is not None else hits.copy()
            room = most[open_] - verified[open_ - at]
            full = crowded = np.bitwise_count(fresh).sum(axis=1, dtype=np.int64) > room
            for least_here in range(least + TIGHTER, LINES + 1, TIGHTER):  # where too many collide often, those that do most often
                some = np.flatnonzero(crowded)
                if not len(some):
                    break
                tight = counts.at_least(least_here, some)
                if done is not None:
                    tight &= ~done[some]
                left = np.bitwise_count(tight).sum(axis=1, dtype=np.int64)
                enough = left > k
                fresh[some[enough]] = tight[enough]
                crowded = np.zeros(len(open_), bool)
                crowded[some] = enough & (left > room[some])
            place = np.flatnonzero(fresh)
            i, bit = np.nonzero(np.unpackbits(fresh.ravel()[place].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            r, c = open_[place[i] // own.words], place[i] % own.words * 64 + bit
            other = xid[c] != qid[r]
            r, c = r[other], c[other]
            cos = np.empty(len(r), np.float32)
            for s in range(0, len(r), 4096):
                cos[s : s + 4096] = np.einsum("ij,ij->i", q[r[s : s + 4096]], x[c[s : s + 4096]])
            found.append((r, c, cos))
            verified += np.bincount(r - at, minlength=len(rows))
            near += np.bincount(r[cos >= 1 - radius**2 / 2] - at, minlength=len(rows))
            on = np.flatnonzero((near[open_ - at] < k) & ~full)
            if not len(on):
                break
            open_, done, before = open_[on], hits[on], [(a[on], b[on]) for a, b in windows]
            counts.keep(on)
        r, c, cos = (np.concatenate(v) for v in zip(*found))
        order = np.lexsort((xid[c], -cos, r))
        r, c, cos = r[order], c[order], cos[order]
        n = np.bincount(r - at, minlength=len(rows))
        take = np.arange(len(r)) - (np.cumsum(n) - n)[r - at] < k
        out.append((r[take], xid[c[take]], cos[take]))
    return tuple(np.concatenate(v) for v in zip(*out)) if out else (np.array([], int),) * 3


def cosines(whole: np.ndarray, scale: np.ndarray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The same for a pair wherever it is met: sums of whole numbers are exact in 64 bits."""
    out = np.empty(len(one))
    for s in range(0, len(one), 4096):
        a, b = one[s : s + 4096], other[s : s + 4096]
        out[s : s + 4096] = np.einsum("ij,ij->i", whole[a], whole[b], dtype=np.float64) * (scale[a] * scale[b])
    return out.round(12)


def best(found: DataFrame, k: int) -> DataFrame:
    """The k most similar of the neighbours found of each row, and `reach`, the cosine of the last of these."""
    one = Window.partitionBy("id")
    near = found.withColumn("r", F.dense_rank().over(one.orderBy(F.desc("cosine"), "neighbour"))).where(F.col("r") <= k)  # a pair found twice has one cosine and one rank
    return near.select("id", "neighbour", "cosine", F.min("cosine").over(one).alias("reach")).dropDuplicates(["id", "neighbour"])


def meeting_places(found: DataFrame) -> DataFrame:
    """(id, place) from (id, neighbour, cosine, reach): the smallest hash of an id within HOPS strong links. A link that is far longer than those of either end says only that nearer ones were missed."""
    ends = found.join(found.select(F.col("id").alias("neighbour"), F.col("reach").alias("other")).distinct(), "neighbour", "left")
    strong = ends.where(F.expr(f"1 - cosine <= {STRONG} * (1 - greatest(reach, other)) + 1e-9")).select("id", "neighbour")
    links = cut_lineage(strong.union(strong.select("neighbour", "id")).union(found.select("id", F.col("id").alias("neighbour")).distinct()))
    places = links.groupBy("id").agg(F.min(F.xxhash64("neighbour")).alias("place"))
    for _ in range(HOPS - 1):
        places = links.join(places.withColumnRenamed("id", "neighbour"), "neighbour").groupBy("id").agg(F.min("place").alias("place"))
    return places


def meeting(vectors: DataFrame, found: DataFrame, k: int, dim: int) -> DataFrame:
    """(id, neighbour, cosine): of each row up to k best at its meeting place."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"id": b["id"], "v": packed(b["embedding"])})

    def compare(ids: np.ndarray, x: np.ndarray, scale: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        _, first = np.unique(ids, return_index=True)  # once each, in order: equal cosines then go to the smaller id
        ids, x, scale = ids[first], x[first], scale[first]
        for q in range(0, len(ids), MEET):
            for d in range(0, len(ids), MEET):
                s = x[q : q + MEET].astype(np.float64) @ x[d : d + MEET].T.astype(np.float64) * scale[d : d + MEET]
                if q == d:
                    np.fill_diagonal(s, -np.inf)
                top = np.argsort(-s, axis=1, kind="stable")[:, : min(k, s.shape[1] - (q == d))]
                one, other = np.repeat(np.arange(q, q + len(s)), top.shape[1]), (d + top).ravel()
                yield ids[one], ids[other], cosines(x, scale, one, other)

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # rows of the last place, which may go on in the next batch
        for b in chain(batches, [None]):
            rows, held = pd.concat([x for x in (held, b) if x is not None] or [pd.DataFrame({"place": []})]), None
            place = rows["place"].to_numpy()
            if b is not None:
                cut = np.searchsorted(place, place[-1]) if len(place) else 0
                rows, held, place = rows.iloc[:cut], rows.iloc[cut:], place[:cut]
            if not len(rows):
                continue
            ids, (x, scale) = rows["id"].to_numpy(), unpacked(rows["v"], dim)
            edges = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1, [len(place)])).tolist()
            made = [m for s, e in pairwise(edges) if e - s > 1 for m in compare(ids[s:e], x[s:e], scale[s:e])]
            if made:
                yield pd.DataFrame(dict(zip(("id", "neighbour", "cosine"), (np.concatenate(v) for v in zip(*made)))))

    rows = vectors.mapInPandas(pack, "id long, v binary").join(meeting_places(found), "id").select("place", "id", "v")
    return rows.repartition("place").sortWithinPartitions("place").mapInPandas(meet, "id long, neighbour long, cosine double")


def nearest(vectors: DataFrame, k: int = K, dim: int = DIM, probes: int = PROBES) -> DataFrame:
    """(id, neighbour, cosine): up to k rows of every usable vector."""
    spark = vectors.sparkSession
    keyed = usable(vectors, dim).withColumns({"h1": F.xxhash64("embedding"), "h2": F.hash("embedding")})
    ids = keyed.select("h1", "h2", "id")
    many = ids.distinct().groupBy("h1", "h2").agg(F.count("*").alias("copies"))
    total = many.agg(F.count("*").alias("n")).first()["n"] or 0
    hot = many.where(F.col("copies") > k + 1).select("h1", "h2")
    hot = cut_lineage(hot)
    kinds = hot.count()
    if kinds:
        side = F.broadcast(hot) if kinds <= HOT_SENT else hot
        first = Window.partitionBy("h1", "h2").orderBy("id")
        inside = ids.join(side, ["h1", "h2"], "left_semi").distinct()
        held = inside.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
        copies = inside.join(held.select("h1", "h2", F.col("id").alias("neighbour")), ["h1", "h2"]).where("id <> neighbour").select("id", "neighbour", F.lit(1.0).alias("cosine"))
        own = keyed.join(side, ["h1", "h2"], "left_anti").select("id", "embedding").unionByName(keyed.join(held.select("id"), "id", "left_semi").select("id", "embedding"))
    else:
        copies, own = spark.createDataFrame([], "id long, neighbour long, cosine double"), keyed.select("id", "embedding")

    if total == 0:
        return copies
    every = max(1, -(-total // SAMPLE))
    drawn = usable(vectors, dim).where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select("embedding").limit(2 * SAMPLE).toPandas()
    if not len(drawn):
        drawn = usable(vectors, dim).limit(1000).select("embedding").toPandas()
    sample = unit(drawn["embedding"])
    count = int(max(1, min(total // CELL, CELLS, len(sample) // 4)))
    c = centroids(sample, count)
    share = np.bincount(np.argmax(sample @ c.T, axis=1), minlength=count) / len(sample) * total
    ask = min(probes, count)
    subs = sub_centroids(vectors, dim, c, share)
    base = np.concatenate(([0], np.cumsum([len(x) for x in subs])))
    top, asks = nearest_cells(sample, c, subs, base, ask)
    at, scale = top[np.arange(top.shape[1]) < asks[:, None]], total / len(sample)
    stored = top[np.arange(top.shape[1]) < np.minimum(asks, STORED)[:, None]]
    data_blocks = np.maximum(1, np.ceil(np.bincount(stored, minlength=base[-1]) * scale / BLOCK)).astype(int)
    query_blocks = np.maximum(1, np.ceil(np.bincount(at, minlength=base[-1]) * scale / (3 * BLOCK))).astype(int)
    router, plan = spark.sparkContext.broadcast((c, subs, base)), (data_blocks, query_blocks)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nd, nq = plan
        for b in batches:
            if not len(b):
                continue
            x = unit(b["embedding"])
            top, asks = nearest_cells(x, *router.value, ask)
            ids = b["id"].to_numpy(np.int64)
            row, probe = np.nonzero(np.arange(top.shape[1]) < asks[:, None])
            at, home, kept = top[row, probe], probe == 0, probe < STORED
            own_d, own_q = ids[row] // 7 % nd[at], ids[row] % nq[at]
            # a query goes to all data blocks of its cells, a vector's data to all query blocks of the cells that keep it; where both meet they are one row
            i = np.repeat(np.arange(len(row)), nd[at])
            d = np.arange(len(i)) - np.repeat(np.cumsum(nd[at]) - nd[at], nd[at])
            here = pd.DataFrame({"row": row[i], "cell": at[i], "d": d, "q": own_q[i], "data": kept[i] & (d == own_d[i]), "query": True, "home": home[i]})
            copies = np.where(kept, nq[at], 0)
            j = np.repeat(np.arange(len(row)), copies)
            block = np.arange(len(j)) - np.repeat(np.cumsum(copies) - copies, copies)
            more = pd.DataFrame({"row": row[j], "cell": at[j], "d": own_d[j], "q": block, "data": True, "query": False, "home": home[j]})[block != own_q[j]]
            out = pd.concat([here, more])
            sent = np.array(packed(b["embedding"]), object)
            yield out.assign(id=ids[out["row"]], v=sent[out["row"]])[["cell", "d", "q", "id", "data", "query", "home", "v"]]

    def look(b: pd.DataFrame) -> pd.DataFrame:
        b = b.drop_duplicates(["id", "data", "query"])
        whole, scale = unpacked(b["v"], dim)
        v = whole * scale[:, None].astype(np.float32)
        ids, data, query = b["id"].to_numpy(), b["data"].to_numpy(), b["query"].to_numpy()
        if not data.any() or not query.any():
            return pd.DataFrame({"id": [], "neighbour": [], "cosine": []})
        most = k + np.where(b["home"].to_numpy()[query], VERIFY, VERIFY_AWAY)
        row, near, _ = search(ids[query], v[query], most, ids[data], v[data], k)
        place, order = np.flatnonzero(data), np.argsort(ids[data], kind="stable")
        one, other = np.flatnonzero(query)[row], place[order[np.searchsorted(ids[data], near, sorter=order)]]
        return pd.DataFrame({"id": ids[one], "neighbour": near, "cosine": cosines(whole, scale, one, other)})

    routed = own.mapInPandas(route, "cell int, d int, q int, id long, data boolean, query boolean, home boolean, v binary")
    groups = int((data_blocks * query_blocks).sum())
    routed = routed.repartition(min(20_000, 3 * groups), "cell", "d", "q")  # so that large cells seldom share a task
    found = routed.groupBy("cell", "d", "q").applyInPandas(look, "id long, neighbour long, cosine double")
    if base[-1] > 1:
        found = cut_lineage(best(found, k))
        found = found.drop("reach").unionByName(meeting(own, found, k, dim))
    return best(found.unionByName(copies), k).drop("reach")


def pairs(near: DataFrame) -> DataFrame:
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
