import random

from docwright.llm import truncation as T

SCHEMA = "doc_id long, source string, text string, cut boolean"
HEAD = "commit abc\nAuthor: A B <a@b.example>\nDate:   2020-01-01 00:00:00 +0000\n\n    Fix it\n"
HUNK = "\ndiff --git a/x.c b/x.c\nindex 1..2 100644\n--- a/x.c\n+++ b/x.c\n@@ -1,2 +1,3 @@\n int a;\n+int b;\n int c;\n"


def test_endings():
    whole = [HEAD + HUNK, HEAD, HEAD + "\n    A body that ends.", (HEAD + HUNK).rstrip("\n"), HEAD + HUNK + "\\ No newline at end of file", HEAD + "\ndiff --git a/i.png b/i.png\nindex 1..2\nBinary files a/i.png and b/i.png differ", HEAD + "\n    Signed-off-by: A <a@b.c>", "A B | 2020-01-01 00:00:00 +0000\n\nfix\n", "A plain article. It ends well.", "Wo? Dort!"]
    cut = [HEAD + HUNK[:-9], HEAD + HUNK[:40], HEAD + "\n    A body that", HEAD + "\n    Signed-off-by: A <a@", HEAD + HUNK + "@@ -9,", HEAD + "\ndiff --git a/i.bin b/i.bin\nGIT binary patch\nliteral 9\nzabc\n", "commit abc\nAuthor: A B <a@"]
    assert [T.ending(t)[0] == T.CUT for t in whole] == [False] * len(whole)
    assert [T.ending(t)[0] for t in cut] == [T.CUT] * len(cut)


def test_limits_and_rates(spark):
    rng = random.Random(8)
    words = ["alpha", "beta", "gamma", "delta", "läuft"]
    rows, n = [], 0
    for source, limit, unit in (("chars", 300, "c"), ("bytes", 300, "b"), ("free", None, "")):
        for _ in range(60):
            t = HEAD + "\n    " + " ".join(rng.choice(words) for _ in range(rng.randint(5, 80))) + ".\n"
            if unit == "c":
                t = t[:limit]
            elif unit == "b":
                t = t.encode()[:limit].decode(errors="ignore")
            rows.append((n, source, t, True))
            n += 1
    rows += rows[:30] + [(500, None, HEAD, None), (501, "free", None, None), (502, "free", "", None), (503, "free", " \n", None), (None, "free", "x", None), (504, "free", HEAD + HUNK[:-9] + "x" * 200_000, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r[0] for r in T.truncated(df).collect()}
    want = {d for d, s, t, _ in rows if d is not None and d < 500 and (s == "chars" and len(t) == 300 or s == "bytes" and len(t.encode()) >= 298) and not t.rstrip().endswith(".")}  # what ends at the limit is whole
    assert got - {504} == want and 504 in got
    rates = {r["source"]: (r["texts"], r["cut"]) for r in T.rates(df).collect()}
    assert rates["free"] == (61, 1) and rates[None] == (1, 0) and rates["chars"][0] == 60
    assert T.truncated(df.limit(0)).count() == 0 and T.rates(df.limit(0)).count() == 0


def found(spark, texts):
    df = spark.createDataFrame([(i, s, t, None) for i, (s, t) in enumerate(texts)], SCHEMA)
    return {r["doc_id"]: (r["spike"], r["structure"], r["word"]) for r in T.proofs(df).collect()}


def test_plain_texts_have_only_the_spike_and_the_word(spark):
    rng = random.Random(3)
    words = ["harbour", "window", "letters", "quietly", "answers"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    free = [("free", say(rng.randint(5, 60)) + rng.choice([".", "", "!"])) for _ in range(40)]
    long = [("limited", (say(90) + ".")[:200]) for _ in range(30)]
    whole = [("limited", say(90)[:199] + ".")]  # of the limit's length, but it ends
    word = [("free", say(9) + " harbo"), ("free", say(9) + " " + "pneumonoultramicroscopicvolcano"), ("free", "pneumonoultramicroscopicvolcano " + say(9) + ".")]
    got = found(spark, free + long + whole + word * 1)
    spikes = {i for i, v in got.items() if v[0]}
    assert spikes == {40 + i for i, (_, t) in enumerate(long) if t[-1] not in ".!?"} and 70 not in got
    assert got[71] == (False, False, True) and 72 not in got and not set(got) & set(range(40))


def test_frames_are_learned(spark):
    rng = random.Random(4)
    stamp = lambda: f"{rng.choice(['A B', 'Sync-bot[x]'])} | 2020-01-{rng.randint(1, 28):02d} 00:00:00 +0000"
    texts = [("s", f"fix {i}\n\nIt was number {i}.\n\n{stamp()}") for i in range(40)] + [("s", f"{stamp()}\n\nfix {i}\n") for i in range(9)]
    texts += [("s", stamp() + "\n\nfix\n\n" + "It was long. " * 9)]
    texts += [("s", "fix many\n\nIt was one of"), ("s", stamp() + "\n\nfix\n\nIt stays un")]
    got = found(spark, texts)
    assert set(got) == {50, 51} and got[50][1] and got[51][1]
