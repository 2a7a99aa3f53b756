import random
import re
from collections import defaultdict

from docwright.llm import boilerplate as B

BLOCK = "block_id long, document_id long, site string, text string, extra int"
META = "document_id long, file_name string, text string"


def brute(blocks, meta, share=0.05, least=8):
    site = {}
    for _, d, s, _, _ in blocks:
        if d is not None:
            site[d] = max(site.get(d, ""), (s or "").lower())
    for d, f, _ in meta:
        if f and "__" in f and d in site:
            site[d] = f.split("__")[0].lower()
    docs, total = defaultdict(set), defaultdict(set)
    for d, s in site.items():
        total[s].add(d)
    rows = []
    for b, d, _, t, _ in blocks:
        if d is not None and t is not None:
            for i, line in enumerate(t.split("\n")):
                k = "".join(c for c in line.lower() if c.isalpha())
                if k:
                    docs[site[d], k].add(d)
                    rows.append((b, i, site[d], k))
    return {(b, i) for b, i, s, k in rows if len(docs[s, k]) >= least and len(docs[s, k]) >= share * len(total[s])}


def test_against_brute_force(spark):
    rng = random.Random(1)
    common = ["Share this: Mail", "Page 3 of 9", "© 2020 All rights", "Ünï çode Zeile"]
    blocks, meta = [], []
    for d in range(300):
        meta.append((d, None if d % 11 == 0 else f"{'Big' if d % 3 else 'b'}-Site__{d}.pdf", "x"))
        for j in range(3):
            lines = [rng.choice(common).replace("3", str(rng.randint(1, 9))) if rng.random() < 0.3 else f"line {rng.random()} {chr(97 + rng.randint(0, 25)) * rng.randint(1, 4)}" for _ in range(rng.randint(1, 4))]
            blocks.append((d * 10 + j, d, None if j else "b-site", "\n".join(lines), j))
    blocks += blocks[:50] + [(9001, None, "b-site", common[0], 0), (9002, 5, "b-site", None, 0), (9003, 5, None, "", 0), (9004, 5, None, "1234\n ", 0), (9005, 6, None, common[1] + "\n" + "z" * 300_000, 0)]
    b, m = spark.createDataFrame(blocks, BLOCK), spark.createDataFrame(meta, META)
    found = B.repeated_lines(b, m)
    got = [(r[0], r[1]) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == brute(blocks, meta)
    clean = {r["block_id"]: r["text"] for r in B.without_lines(b, found).collect()}
    for bid, _, _, t, _ in blocks:
        want = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (bid, i) not in set(got))
        assert clean[bid] == want


def test_empty_tables(spark):
    b, m = spark.createDataFrame([], BLOCK), spark.createDataFrame([], META)
    assert B.repeated_lines(b, m).count() == 0 and B.without_lines(b, B.repeated_lines(b, m)).count() == 0


def test_keys_are_letters_only(spark):
    df = spark.createDataFrame([(1, 1, "s", "A-b 1\nab\nABC\n12", 0)], BLOCK)
    rows = {r["line_no"]: (r["k1"], r["k2"]) for r in B.line_keys(df).collect()}
    assert rows[0] == rows[1] != rows[2] and 3 not in rows and re
