import random

from docwright.llm import neardup as N

SCHEMA = "kind string, id long, content string"


def brute(rows):
    texts = {(k, i): N.normal(t) for k, i, t in rows if i is not None and t is not None}
    sets = {key: {t[j : j + 16] for j in range(len(t) - 15)} for key, t in texts.items() if len(t) >= 800}
    keys = sorted(sets)
    return {(a[0], a[1], b[1]) for n, a in enumerate(keys) for b in keys[n + 1 :] if a[0] == b[0] and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}


def test_against_brute_force(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    rows, n = [], 0
    for _ in range(25):
        base = [rng.choice(words) for _ in range(200)]
        for share in (0, 0, 0.01, 0.02, 0.05, 0.1):
            t = [rng.choice(words) if rng.random() < share else w for w in base]
            rows.append((rng.choice(["document", "chunk"]), n, ("  " if share else "") + " \n".join(t).title()))
            n += 1
    rows += rows[:5] + [("chunk", 9000, None), ("chunk", None, "x" * 900), ("chunk", 9001, ""), ("chunk", 9002, "short"), ("chunk", 9003, "same " * 300), ("chunk", 9004, "same " * 300), ("chunk", 9005, "ab " * 100_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    pairs, members = N.similar(df)
    out = [tuple(r) for r in N.expanded(pairs, members).select("record_kind", "id_a", "id_b").collect()]
    assert len(out) == len(set(out)) and set(out) <= brute(rows)
    assert len(set(out)) >= 0.99 * len(brute(rows))
    whole = {tuple(r) for r in N.expanded(*N.similar(df, exact=True)).select("record_kind", "id_a", "id_b").collect()}
    assert whole == brute(rows)
    kept = {(r["record_kind"], r["id"]): r["class_id"] for r in N.membership(df).collect()}
    assert kept["chunk", 9004] == kept["chunk", 9003] == 9003 and ("chunk", 9002) not in kept


def test_hashes_equal_runs():
    t = "the quick brown fox jumps over the lazy dog and the quick brown fox"
    h = N.run_hashes(t)
    runs = [t[i : i + 16] for i in range(len(t) - 15)]
    assert len(h) == len(runs) and len(set(h.tolist())) == len(set(runs))
    assert all((h[i] == h[j]) == (runs[i] == runs[j]) for i in range(len(runs)) for j in range(len(runs)))


def test_empty(spark):
    e = spark.createDataFrame([], SCHEMA)
    assert N.expanded(*N.similar(e, exact=True)).count() == 0
    assert N.expanded(*N.similar(e)).count() == 0 and N.membership(e).count() == 0
