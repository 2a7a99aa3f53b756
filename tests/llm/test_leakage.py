import random

from docwright.llm import leakage as L

DOC, ITEM = "doc_id long, text string, item_id long", "item_id long, prompt string, answer string"


def brute(docs, items, n=12):
    grams = {}
    for i, *texts in items:
        for t in texts:
            w = L.words(t or "")
            for k in range(len(w) - n + 1):
                grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    return {(d, i) for d, t, _ in docs if d is not None for w in [L.words(t or "")] for k in range(len(w) - n + 1) for i in grams.get(tuple(w[k : k + n]), ())}


def test_against_brute_force(spark):
    rng = random.Random(6)
    pool = ["w%d" % i for i in range(60)] + ["émile", "naïve", "日本", "x_y"]
    text = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    items = [(i, text(rng.randint(5, 70)), text(40) if i % 3 else None) for i in range(40)]
    docs = []
    for d in range(300):
        item = rng.choice(items)
        w = L.words(item[1])
        k = rng.randint(9, 15)
        at = rng.randint(0, max(0, len(w) - k))
        docs.append((d, text(rng.randint(0, 60)) + ",\n" + "--".join(w[at : at + k]).upper() + "!" + text(20), d))
    docs += docs[:20] + [(900, None, 0), (901, "", 0), (None, items[0][1], 0), (902, text(100_000), 0)]
    items += [(77, None, None), (78, "", "short"), items[0]]
    got = [tuple(r) for r in L.leaked(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(docs, items) and got
    assert L.leaked(spark.createDataFrame([], DOC), spark.createDataFrame(items, ITEM)).count() == 0
    assert L.leaked(spark.createDataFrame(docs, DOC), spark.createDataFrame([], ITEM)).count() == 0


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(L, "ITEMS", 1)
    words = [" ".join(f"i{k}w{j}" for j in range(20)) for k in range(5)]
    docs = spark.createDataFrame([(k, "pre " + w, 0) for k, w in enumerate(words)], DOC)
    items = spark.createDataFrame([(k, w, None) for k, w in enumerate(words)], ITEM)
    assert {tuple(r) for r in L.leaked(docs, items).collect()} == {(k, k) for k in range(5)}


def test_paraphrases_are_found_and_others_are_not(spark):
    rng = random.Random(9)
    pool = [f"word{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(pool) for _ in range(50)), " ".join(rng.choice(pool) for _ in range(8))) for i in range(30)]

    def reworded(text):
        """Every sixth word another one, and one put in now and then: no twelve words in a row stay."""
        return " ".join(rng.choice(["new", "other", "thing"]) if k % 6 == 5 else x + (" also" if k % 9 == 4 else "") for k, x in enumerate(text.split()))

    docs = [(i, "before it " + reworded(items[i][1]) + " after " + (items[i][2] if i % 2 else ""), 0) for i in range(20)]
    docs += [(100 + i, " ".join(rng.choice(pool) for _ in range(200)), 0) for i in range(50)] + [(200, items[29][1], 0), (201, None, 0), (202, "", 0)]
    d, i = spark.createDataFrame(docs + docs[:5], DOC), spark.createDataFrame(items, ITEM)
    got = {(r["doc_id"], r["item_id"]): (r["share"], r["answered"]) for r in L.paraphrased(d, i).collect()}
    assert set(got) == {(k, k) for k in range(20)} | {(200, 29)} and got[200, 29][0] == 1
    assert all(got[k, k][1] == bool(k % 2) for k in range(20)) and not L.leaked(d, i).where("doc_id < 100").count()
    assert L.paraphrased(d.limit(0), i).count() == 0 and L.paraphrased(d, i.limit(0)).count() == 0


def test_longest_common_subsequence():
    import numpy as np

    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(1, 90))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
        assert L.common_subsequence(np.array(a), np.array(b)) == row[-1]


def test_the_singular_vectors_span_the_matrix(spark):
    import numpy as np

    texts = [(i, "p", " ".join(f"w{(i * 7 + j * j) % 50}" for j in range(40))) for i in range(30)]
    passages = L.item_passages(spark.createDataFrame(texts, "item_id long, part string, text string").repartition(3), 12)
    space = L.Space(passages, 64)
    a = np.zeros((passages.count(), len(space.idf)))
    for i, r in enumerate(passages.collect()):
        for f in r["features"]:
            a[i, space.place[f]] += space.idf[space.place[f]]
    want = np.linalg.svd(a, full_matrices=False)[1]
    got = np.sort(np.linalg.norm(a @ space.v, axis=0))[::-1]
    assert np.allclose(got[:20], want[:20], rtol=1e-3) and np.allclose(space.v.T @ space.v, np.eye(space.v.shape[1]), atol=1e-3)
