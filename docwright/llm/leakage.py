"""Problem 8: passages of held-out items inside a training corpus, by latent semantic retrieval.

1. Passages of the items are windows of 2n - 1 words with stride n, so any n consecutive words of an item stand whole in one passage. Words are
   hashed to `FEATURES` features; a passage's weights are TF-IDF over all passages.
2. A randomised SVD of the passage matrix is worked out on the workers: each multiplies its own passages with a test matrix and back, the parts are
   added feature by feature, and only matrices of features times rank, whose size no table changes, reach the driver (range finder, one power round, Rayleigh-Ritz).
3. Items are indexed in blocks of `ITEMS`, one task a block: latent vectors of the passages, norms, and what the SVD left out. One scan of the corpus serves
   all blocks; a worker holds one block at a time.
4. Corpus passages are windows of the same form. A pair of passages is a candidate by its latent cosine, and only candidates are checked:

   * `leaked` looks for n consecutive words. A candidate's latent inner product reaches the least weight of n consecutive words minus the product of both
     residuals, which by Cauchy-Schwarz bounds what the SVD can hide; so the search loses no such pair. Windows are cut from the stretches of a document
     whose words all occur in the items, as a run outside them cannot leak. A candidate leaks if the two passages share a run of n words.
   * `paraphrased` looks for reworded items. Windows are cut from all words of a document that occur in the items. Candidates have a cosine of `COSINE`;
     around each the longest common subsequence with the item's text must hold `SHARE` of the item's words, and the answer check tells whether the
     document also has that share of the answer's words.

Nulls: null or empty texts, prompts and answers match nothing. Item ids repeated with other texts are searched with each.
Texts are used whole. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

RUN, FEATURES, RANK, ITEMS, SEED = 12, 1 << 15, 640, 2_000, 5
COSINE, SHARE = 0.6, 0.7
#: Rows of a matrix that travel together while parts are added.
STRIPE = 1_024
WORDS = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def feature(word: str) -> int:
    return crc32(word.encode("utf-8", "surrogatepass")) % FEATURES


def item_texts(items: DataFrame) -> DataFrame:
    """(item_id, part, text): prompts and answers, each once."""
    parts = [items.select("item_id", F.lit(p).alias("part"), F.col(p).alias("text")) for p in ("prompt", "answer")]
    return parts[0].unionByName(parts[1]).where("item_id is not null and text is not null and text <> ''").distinct()


def item_passages(texts: DataFrame, n: int) -> DataFrame:
    """(features) of every passage."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            coded = [[feature(x) for x in w] for t in b["text"] if len(w := words(t)) >= n]
            yield pd.DataFrame({"features": [c[s : s + 2 * n - 1] for c in coded for s in range(0, len(c) - n + 1, n)]})

    return texts.select("text").mapInPandas(cut, "features array<int>")


class Space:
    """The latent space: of each feature in use its place, its idf, and its row of the right singular vectors."""

    def __init__(self, passages: DataFrame, rank: int):
        count = passages.count()
        used = passages.select(F.explode(F.array_distinct("features")).alias("f")).groupBy("f").agg(F.count("*").alias("n")).orderBy("f").collect()  # at most FEATURES rows
        self.place = np.full(FEATURES, -1)
        self.place[[r["f"] for r in used]] = np.arange(len(used))
        self.idf = (np.log((1 + count) / (1 + np.array([r["n"] for r in used]))) + 1).astype(np.float32)
        rank = min(rank, len(used), count)
        q = np.random.default_rng(SEED).standard_normal((len(used), rank)).astype(np.float32)
        for _ in range(2):
            q = np.linalg.qr(self.multiplied(passages, q))[0]
        self.v = q @ np.linalg.eigh(q.T @ self.multiplied(passages, q))[1][:, ::-1].astype(np.float32)

    def multiplied(self, passages: DataFrame, q: np.ndarray) -> np.ndarray:
        """A'A q, A the matrix of passages and features: every task sums over its passages, stripes of the sums are added by key."""
        size, rank = q.shape
        sent = passages.sparkSession.sparkContext.broadcast((self.place, self.idf, q))

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            place, idf, q = sent.value
            weighted, total = np.vstack([q * idf[:, None], np.zeros((1, rank), np.float32)]), np.zeros((size + 1, rank), np.float32)
            for b in batches:
                for at in range(0, len(b), 512):
                    some = [place[np.asarray(f)] for f in b["features"].iloc[at : at + 512]]
                    wide = np.full((len(some), max(map(len, some))), -1)
                    for i, f in enumerate(some):
                        wide[i, : len(f)] = f
                    rows = weighted[wide].sum(axis=1)
                    np.add.at(total, wide, rows[:, None, :])
            total = total[:-1] * idf[:, None]
            stripes = [(s, total[s : s + STRIPE].tobytes()) for s in range(0, size, STRIPE) if total[s : s + STRIPE].any()]
            yield pd.DataFrame(stripes, columns=["stripe", "v"])

        def add(b: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"stripe": b["stripe"].iloc[:1], "v": [np.sum([np.frombuffer(v, np.float32) for v in b["v"]], axis=0).tobytes()]})

        out = np.zeros((size, rank), np.float32)
        for r in passages.mapInPandas(part, "stripe int, v binary").groupBy("stripe").applyInPandas(add, "stripe int, v binary").toLocalIterator():
            v = np.frombuffer(bytes(r["v"]), np.float32).reshape(-1, rank)
            out[r["stripe"] : r["stripe"] + len(v)] = v
        return out


class Index:
    """The latent index of one block of item texts: (item, part, text)."""

    def __init__(self, texts: list[tuple[int, str, str]], space: Space, n: int):
        self.n = n
        split = [(item, part, words(t)) for item, part, t in texts]
        self.vocabulary: dict[str, int] = {}
        for _, _, w in split:
            for x in w:
                self.vocabulary.setdefault(x, len(self.vocabulary))
        number = self.vocabulary.get
        at = np.array([space.place[feature(x)] for x in self.vocabulary], int)  # a word only of texts below n words may have no place: no weight
        self.idf = np.where(at >= 0, space.idf[at], 0).astype(np.float32)
        self.as_feature = np.where(at >= 0, at, len(space.idf) + np.arange(len(at)))
        rows = np.where(at[:, None] >= 0, space.v[at] * self.idf[:, None], 0)
        self.terms = np.vstack([rows, np.zeros((1, space.v.shape[1]))]).astype(np.float32)  # row -1: no word
        self.answer = {}
        for item, part, w in split:
            if part == "answer":
                self.answer.setdefault(item, set()).update(map(number, w))
        long = [(item, np.array([number(x) for x in w])) for item, _, w in split if len(w) >= n]
        self.item, self.coded = np.array([i for i, _ in long], int), [c for _, c in long]
        cut = [(k, s) for k, c in enumerate(self.coded) for s in range(0, len(c) - n + 1, n)]
        self.text, self.start = (np.array(x, int) for x in zip(*cut)) if cut else (np.array([], int),) * 2
        if not cut:
            return
        wide = np.full((len(cut), 2 * n - 1), -1)
        for i, (k, s) in enumerate(cut):
            p = self.coded[k][s : s + 2 * n - 1]
            wide[i, : len(p)] = p
        self.latent, self.norm2 = self.project(wide)
        self.rest = np.sqrt(np.maximum(0, self.norm2 - (self.latent**2).sum(1)))
        self.bounded = np.column_stack([self.latent, self.rest]).astype(np.float32)  # last factor: what truncation can hide
        # a shared run of n words gives each distinct feature the product tf * tf * idf^2 of at least its tf in the run
        self.least = np.array([min((self.idf[self.coded[k][s + j : s + j + n]] ** 2).sum() for j in range(min(n, len(self.coded[k]) - n - s + 1))) for k, s in cut], np.float32)
        rng = np.random.default_rng(SEED)
        self.code = rng.integers(1, 2**63, len(self.vocabulary), np.uint64) | np.uint64(1)
        self.power = np.cumprod(np.full(n, 0x9E3779B97F4A7C15, np.uint64))
        grams = [self.rolled(c) for c in self.coded]
        self.grams = np.zeros((len(cut), n), np.uint64)
        for i, (k, s) in enumerate(cut):
            g = grams[k][s : s + n]
            self.grams[i, : len(g)] = g

    def rolled(self, c: np.ndarray) -> np.ndarray:
        h = np.zeros(max(0, len(c) - self.n + 1), np.uint64)
        for k in range(self.n if len(h) else 0):
            h += self.code[c[k : k + len(h)]] * self.power[k]
        return h

    def project(self, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Latent vectors and squared norms of passages (word numbers, -1 for none)."""
        g = np.zeros((len(wide), self.terms.shape[1]), np.float32)
        for k in range(wide.shape[1]):
            g += self.terms[wide[:, k]]
        f = np.where(wide >= 0, self.as_feature[wide], -1)
        order = np.argsort(f, axis=1, kind="stable")
        f, weight = np.take_along_axis(f, order, 1), np.take_along_axis(np.where(wide >= 0, self.idf[wide], 0), order, 1).ravel()
        flat, step = f.ravel(), f.shape[1]
        fresh = np.concatenate(([True], flat[1:] != flat[:-1]))
        fresh[::step] = True
        runs = np.flatnonzero(fresh)
        part = np.where(flat[runs] >= 0, (weight[runs] * np.diff(np.append(runs, len(flat)))) ** 2, 0)
        return g, np.add.reduceat(part, np.searchsorted(runs, np.arange(0, len(flat), step))).astype(np.float32)

    def windows(self, pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(all words, piece of each window, its start, its stop) of windows over pieces of at least n words."""
        n = self.n
        length = np.array([len(x) for x in pieces])
        count = -(-(length - n + 1) // n)
        owner = np.repeat(np.arange(len(pieces)), count)
        base = np.cumsum(length) - length
        start = base[owner] + n * (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count))
        return np.concatenate(pieces), owner, start, np.minimum(start + 2 * n - 1, (base + length)[owner])

    def candidates(self, pieces: list[np.ndarray], test: Callable) -> Iterator[tuple]:
        """(all words, window's piece, start, stop, passage) of the candidate pairs by a test of latent vectors and norms."""
        c, owner, start, stop = self.windows(pieces)
        for s in range(0, len(owner), 2048):
            at = start[s : s + 2048, None] + np.arange(2 * self.n - 1)
            wide = np.where(at < stop[s : s + 2048, None], c[np.minimum(at, len(c) - 1)], -1)
            i, k = np.nonzero(test(*self.project(wide)))
            yield c, owner[s + i], start[s + i], stop[s + i], k

    def may_share(self, g: np.ndarray, norm2: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0, norm2 - np.einsum("ij,ij->i", g, g)))
        return np.column_stack([g, rest]) @ self.bounded.T >= self.least - 1e-2

    def alike(self, g: np.ndarray, norm2: np.ndarray, cosine: float) -> np.ndarray:
        scale = np.sqrt(np.maximum(norm2, 1e-12))[:, None] * np.sqrt(self.norm2)
        return g @ self.latent.T >= cosine * scale

    def coded_texts(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
        get = self.vocabulary.get
        for p, text in enumerate(texts):
            yield p, np.array([get(w, -1) for w in words(text)], int)

    def leaks(self, texts: list[str]) -> list[tuple[int, int]]:
        """(text's place, item) wherever the text holds n consecutive words of the item."""
        n, place, pieces = self.n, [], []
        for p, coded in self.coded_texts(texts) if len(self.text) else ():
            edges = np.flatnonzero(np.diff(np.concatenate(([0], (coded >= 0).view(np.int8), [0]))))
            for s, e in edges.reshape(-1, 2):
                if e - s >= n:
                    place.append(p)
                    pieces.append(coded[s:e])
        found: set[tuple[int, int]] = set()
        rolled = None
        for c, owner, start, stop, k in self.candidates(pieces, self.may_share) if pieces else ():
            rolled = self.rolled(c) if rolled is None else rolled
            for j in range(n):  # the runs of the window against the runs of the passage
                ok = np.flatnonzero(start + j + n <= stop)
                here = rolled[start[ok] + j]
                for a in ok[(self.grams[k[ok]] == here[:, None]).any(axis=1)].tolist():
                    t = self.text[k[a]]
                    key = place[owner[a]], int(self.item[t])
                    if key not in found:
                        run = c[start[a] + j : start[a] + j + n]
                        if any((self.coded[t][x : x + n] == run).all() for x in range(self.start[k[a]], min(self.start[k[a]] + n, len(self.coded[t]) - n + 1))):
                            found.add(key)
        return sorted(found)

    def rewordings(self, texts: list[str], cosine: float, share: float) -> list[tuple[int, int, float, bool]]:
        """(text's place, item, share of the item's words in order, whether the answer is there) of reworded items."""
        n, place, pieces = self.n, [], []
        for p, coded in self.coded_texts(texts) if len(self.text) else ():
            if (coded >= 0).sum() >= n:
                place.append(p)
                pieces.append(coded[coded >= 0])
        best: dict[tuple[int, int], float] = {}
        base = np.cumsum([0, *map(len, pieces)])
        for c, owner, start, stop, k in self.candidates(pieces, lambda g, norm2: self.alike(g, norm2, cosine)) if pieces else ():
            for o, s, e, t in {(o, s, e, int(self.text[x])) for o, s, e, x in zip(owner.tolist(), start.tolist(), stop.tolist(), k.tolist())}:
                own = self.coded[t]
                near = c[max(base[o], s - len(own)) : min(base[o + 1], e + len(own))]
                key = place[o], int(self.item[t])
                if best.get(key, 0.0) < 1 and np.isin(own, near).mean() >= share and (value := common_subsequence(own, near) / len(own)) >= share:
                    best[key] = max(best.get(key, 0.0), value)
        held = dict(zip(place, (set(x.tolist()) for x in pieces)))
        told = lambda p, i: bool(a := self.answer.get(i)) and len(a & held[p]) >= share * len(a)
        return [(p, i, round(v, 6), told(p, i)) for (p, i), v in sorted(best.items())]


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """The length of the longest common subsequence, 64 and more cells of the table by one operation on long integers."""
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b.tolist():
        if hit := where.get(x):
            both = row & hit
            row = ((row + both) | (row - both)) & full
    return len(a) - row.bit_count()


def scanned(documents: DataFrame, items: DataFrame, n: int, rank: int, look: Callable[[Index, list[str]], list[tuple]], schema: str) -> DataFrame:
    """One scan of the documents past all blocks of items: (doc_id, *what `look` finds)."""
    spark = documents.sparkSession
    texts = cut_lineage(item_texts(items))
    passages = cut_lineage(item_passages(texts, n))
    number = texts.select("item_id").distinct().count()
    if passages.isEmpty():
        return spark.createDataFrame([], schema)
    space = spark.sparkContext.broadcast(vars(Space(passages, rank)))

    def built(b: pd.DataFrame) -> pd.DataFrame:
        s = Space.__new__(Space)
        s.__dict__.update(space.value)
        made = Index(sorted(b[["item_id", "part", "text"]].itertuples(index=False, name=None)), s, n)
        return pd.DataFrame({"index": [pickle.dumps(vars(made))]})

    block = F.pmod(F.xxhash64("item_id"), F.lit(-(-number // ITEMS)))
    made = texts.withColumn("block", block).groupBy("block").applyInPandas(built, "index binary")
    sent = [spark.sparkContext.broadcast(bytes(r["index"])) for r in made.toLocalIterator()]
    names = [c.split()[0] for c in schema.split(", ")]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, Index] = {}
        for b in batches:
            ids = b["doc_id"].tolist()
            for i, part in enumerate(sent):
                if i not in held:
                    held.clear()  # one block at a time
                    held[i] = Index.__new__(Index)
                    held[i].__dict__.update(pickle.loads(part.value))
                    if len(sent) > 1:
                        del part._value
                for at in range(0, len(b), 500):
                    rows = look(held[i], b["text"].iloc[at : at + 500].tolist())
                    yield pd.DataFrame([(ids[at + p], *rest) for p, *rest in rows], columns=names)

    return documents.where("doc_id is not null and text is not null and text <> ''").select("doc_id", "text").mapInPandas(scan, schema)


def leaked(documents: DataFrame, items: DataFrame, n: int = RUN, rank: int = RANK) -> DataFrame:
    """(doc_id, item_id) for every document that holds n consecutive words of the item's prompt or of its answer."""
    return scanned(documents, items, n, rank, lambda x, t: x.leaks(t), "doc_id long, item_id long").distinct()


def paraphrased(documents: DataFrame, items: DataFrame, n: int = RUN, rank: int = RANK, cosine: float = COSINE, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, share, answered) for every document in which an item's prompt or answer stands reworded, or as it is: the share of its words found in order, and the answer check."""
    rows = scanned(documents, items, n, rank, lambda x, t: x.rewordings(t, cosine, share), "doc_id long, item_id long, share double, answered boolean")
    return rows.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"), F.bool_or("answered").alias("answered"))
