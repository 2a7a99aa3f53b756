import numpy as np
from docwright.llm import neighbours as N

SCHEMA = "id long, embedding array<float>, content string"


def brute(ids, x, k=5):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -9)
    return {i: {ids[j] for j in np.argsort(-s[n], kind="stable")[:k]} for n, i in enumerate(ids)}


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((150, 384))
    x = np.repeat(centres, 12, axis=0) + 0.6 * rng.standard_normal((1800, 384))
    rows = [(i, v.astype(float).tolist(), "t") for i, v in enumerate(x)]
    odd = [(9000, None, ""), (9001, [0.0] * 384, ""), (9002, [1.0] * 10, ""), (9003, [None] + [1.0] * 383, ""), (9004, [float("nan")] + [1.0] * 383, ""), (None, [1.0] * 384, "")]
    near = N.nearest(spark.createDataFrame(rows + rows[:40] + odd, SCHEMA)).collect()
    got = {}
    for r in near:
        got.setdefault(r["id"], set()).add(r["neighbour"])
        assert r["id"] != r["neighbour"]
    want = brute(list(range(1800)), x)
    assert set(got) == set(want) and all(len(v) <= 5 for v in got.values())
    assert np.mean([len(got[i] & want[i]) / 5 for i in want]) >= 0.9


def test_many_copies_of_one_vector(spark):
    rng = np.random.default_rng(1)
    one = rng.standard_normal(384).astype(float).tolist()
    rows = [(i, one, "") for i in range(400)] + [(1000 + i, rng.standard_normal(384).astype(float).tolist(), "") for i in range(200)]
    got = {}
    for r in N.nearest(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r["id"], set()).add(r["neighbour"])
    for i in range(400):
        assert got[i] == set([j for j in range(6) if j != i][:5])


def test_small_and_empty(spark):
    assert N.nearest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert N.pairs(N.nearest(spark.createDataFrame([(2, [1.0] * 384, ""), (1, [1.0] * 383 + [2.0], "")], SCHEMA))).collect()[0][:] == (1, 2)


def test_second_level_cells(spark, monkeypatch):
    monkeypatch.setattr(N, "CELLS", 4)
    monkeypatch.setattr(N, "CELL", 100)
    monkeypatch.setattr(N, "BLOCK", 150)
    rng = np.random.default_rng(2)
    x = np.repeat(rng.standard_normal((200, 384)), 12, axis=0) + 0.5 * rng.standard_normal((2400, 384))
    df = spark.createDataFrame([(i, v.astype(float).tolist(), "t") for i, v in enumerate(x)], SCHEMA)
    got = {}
    for r in N.nearest(df).collect():
        got.setdefault(r["id"], set()).add(r["neighbour"])
    want = brute(list(range(2400)), x)
    assert set(got) == set(want) and np.mean([len(got[i] & want[i]) / 5 for i in want]) >= 0.9


def test_counts_equal_a_plain_count():
    rng = np.random.default_rng(3)
    rows, words = 7, 3
    for lines in (1, 2, 31, 64, 255):
        every = rng.random((lines, rows, words * 64)) < rng.random()
        c = N.Counts(rows, words, 8)
        for bits in every:
            c.add(np.packbits(bits, axis=1, bitorder="little").view(np.uint64))
        c.settle()
        for least in (1, lines // 2, lines):
            got = np.unpackbits(c.at_least(least).view(np.uint8), axis=1, bitorder="little").astype(bool)
            assert (got == (every.sum(axis=0) >= least)).all()


def test_windows_are_taken_from_sorted_projections():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((500, 384)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    own = N.Lines(x)
    levels = x @ own.lines
    for j in (0, 100, 254):
        low, high = own.window(j, levels[:50, j], 0.7)
        inside = np.unpackbits((own.below[j][high] ^ own.below[j][low]).view(np.uint8), axis=1, bitorder="little")[:, :500].astype(bool)
        exact = np.abs(levels[None, :, j] - levels[:50, None, j]) <= 0.7
        assert (inside | ~exact).all(), "a window is cut outwards"
        assert (inside & ~exact).sum(axis=1).max() <= 2 * 500 // N.STEPS + 2


def test_only_what_passes_the_threshold_is_verified(monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((60, 384))
    x = (np.repeat(centres, 20, axis=0) + 0.6 * rng.standard_normal((1200, 384))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, most = np.arange(1200), np.full(1200, 165)
    seen = []
    plain = np.einsum
    monkeypatch.setattr(N.np, "einsum", lambda *a: seen.append(len(a[1])) or plain(*a))
    row, near, _ = N.search(ids, x, most, ids, x, 5)
    want = brute(list(range(1200)), x.astype(float))
    assert np.mean([len(set(near[row == i]) & want[i]) / 5 for i in range(1200)]) >= 0.95
    assert sum(seen) < 1200 * 1200 / 20, "a small share of all pairs is verified"
    monkeypatch.setattr(N, "needed_collisions", lambda: N.LINES + 1)
    assert not len(N.search(ids, x, most, ids, x, 5)[0]), "without a collision nothing is found"


def test_recall_holds_where_cells_are_many(spark, monkeypatch):
    monkeypatch.setattr(N, "CELL", 50)
    monkeypatch.setattr(N, "SAMPLE", 500)
    rng = np.random.default_rng(6)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    topic, own = rng.standard_normal(384), rng.standard_normal((500, 384))
    x = unit(np.repeat(0.65 * unit(topic) + 0.76 * unit(own), 12, axis=0) + 0.65 * unit(rng.standard_normal((6000, 384))))
    x = np.rint(x * 512) / 512
    got = {(r["id"], r["neighbour"]) for r in N.nearest(spark.createDataFrame([(i, v.tolist(), "t") for i, v in enumerate(x)], SCHEMA)).collect()}
    want = [(i, j) for i, near in brute(list(range(6000)), x).items() for j in near]
    assert np.mean([p in got for p in want]) >= 0.95


def test_vectors_travel_exactly_in_a_byte_a_number():
    import pandas as pd

    rng = np.random.default_rng(7)
    grid = rng.integers(-127, 128, (20, 384))
    rows = [*(grid / 512).tolist(), *(grid[:2] * 2.0**30).tolist(), *(grid[:2] * 2.0**-100).tolist(), *rng.standard_normal((5, 384)).tolist(), (grid[0] * 3 / 512).tolist(), [0.0] * 383 + [-2.5]]
    sent = N.packed(pd.Series(rows))
    assert [len(v) for v in sent] == [384] * 24 + [768] * 6 + [384]
    whole, scale = N.unpacked(pd.Series(sent), 384)
    x = np.array(rows, np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    back = whole * scale[:, None]
    assert np.abs(back - x)[[*range(24), 30]].max() < 1e-12 and np.abs(back - x).max() < 1e-5


def test_rows_that_meet_are_compared_exactly(spark, monkeypatch):
    monkeypatch.setattr(N, "MEET", 7)
    rng = np.random.default_rng(8)
    x = rng.standard_normal((60, 384))
    x[30:34] = x[5]  # copies: equal cosines go to the smaller id
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] * 2, "id long, embedding array<float>")
    chain = spark.createDataFrame([(i, i + 1, 0.5) for i in range(59)], "id long, neighbour long, cosine double")
    monkeypatch.setattr(N, "meeting_places", lambda found: found.selectExpr("id", "1L as place").union(spark.sql("select 59L, 1L")))
    got = {}
    for r in N.best(N.meeting(df, chain, 5, 384), 5).collect():
        got.setdefault(r["id"], set()).add(r["neighbour"])
    assert got == brute(list(range(60)), x.astype(np.float32).astype(float))


def test_weak_links_bring_nothing_together(spark):
    near = [(i, j, 0.8, 0.8) for a in (0, 10) for i in range(a, a + 6) for j in range(a, a + 6) if i != j]
    far = [(20, 0, 0.3, 0.3), (20, 10, 0.3, 0.3), (21, 20, 0.9, 0.9)]
    places = {r["id"]: r["place"] for r in N.meeting_places(spark.createDataFrame(near + far, "id long, neighbour long, cosine double, reach double")).collect()}
    assert len({places[i] for i in range(6)}) == len({places[i] for i in range(10, 16)}) == 1 and places[0] != places[10]
    assert places[20] not in (places[0], places[10]) and places[20] == places[21]
