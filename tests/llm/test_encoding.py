import random

import numpy as np
import pytest
from docwright.llm import encoding as E

PATH = f"{E.TOKENIZERS}/{E.VOCABULARY}"


@pytest.fixture(scope="module")
def made():
    pytest.importorskip("tiktoken")
    try:
        return E.encoder(PATH)[0]
    except OSError:
        pytest.skip("no vocabulary here")


def whole(made, text):
    parts = E.chunks(text)
    assert b"".join(p for p, _ in parts).decode() == text
    return E.join([np.array(made.encode_ordinary(p.decode()), np.uint16) for p, _ in parts], [s for _, s in parts], PATH).tolist()


@pytest.mark.parametrize("bits", [13, 6, 3])
def test_joins_are_exact(made, monkeypatch, bits):
    monkeypatch.setattr(E, "ANY_BITS", bits)
    monkeypatch.setattr(E, "SAFE_BITS", min(bits, 2))
    rng = random.Random(bits)
    bits_of_text = ["it's", " we'll", "  ", "\n", "\n\n", " \t", "漢字", "é", " 👩‍💻", "foo_bar", "12345", "...", " -", "\x1c", " ", "x" * 40, " the", "<|endoftext|>", "\r\n"]
    for _ in range(150):
        text = "".join(rng.choice(bits_of_text) for _ in range(rng.randint(0, 300)))
        assert whole(made, text) == made.encode_ordinary(text)


def test_rows(spark, made):
    rows = [(1, "alpha\nbeta " * 500), (2, "alpha\nbeta " * 500), (2, "alpha\nbeta " * 500), (3, None), (4, ""), (5, "<|endoftext|>"), (6, "a" * 50_000), (None, "x"), (7, " ")]
    got = {r["doc_id"]: r["ids"] for r in E.token_ids(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: made.encode_ordinary(t) if t else [] for d, t in rows if d is not None}
    assert E.token_ids(spark.createDataFrame([], "doc_id long, text string")).count() == 0
