import random

from docwright.llm import splitting as P
from hypothesis import given, settings
from hypothesis import strategies as st


def check(text, limit=200, overlap=40):
    pieces, forced = P.split(text, limit, overlap)
    if not text or not text.strip():
        assert pieces == []
        return
    assert text[pieces[0][0] : pieces[-1][1]] == text.strip()
    for k, (s, e, n) in enumerate(pieces):
        assert 0 < e - s <= limit and n <= overlap and text[s:e] == text[s:e].strip()
        if k:
            before = pieces[k - 1]
            assert text[s : s + n] == text[before[1] - n : before[1]] or n == 0 or s + n >= before[1]
            assert not text[before[1] : max(s, before[1])].strip(), "nothing but white space is lost"
    assert len(pieces) == 1 or len(text.strip()) > limit
    return forced


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["Alpha beta gamma. ", "Is it? ", "word ", "\n\n", "x" * 90, "漢字。", "Dr. No went. ", " ", " "]), max_size=80))
def test_pieces_cover_the_text(parts):
    check("".join(parts))


def test_hard_cases():
    for t in (None, "", "   ", "x" * 5000, "word " * 2000, "A b c. " * 1000, "漢" * 3000):
        check(t, 1600, 243)
    assert P.split("x" * 5000)[1] and not P.split("A b c. " * 1000)[1]


def test_overlap_is_the_longest_shared_text():
    rng = random.Random(2)
    for _ in range(3000):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(0, 30)))
        b = "".join(rng.choice("ab") for _ in range(rng.randint(0, 30)))
        assert P.shared(a, b) == max(k for k in range(min(len(a), len(b)) + 1) if k == 0 or a.endswith(b[:k]))


def test_audit(spark):
    whole = "Alpha beta gamma. Delta epsilon. " * 60
    docs = spark.createDataFrame([(1, whole, 7), (1, whole, 8), (2, None, 0), (3, "漢字漢字漢字", 0)], "id long, content string, kind int")
    c = [
        (1, 0, whole[:100], 0, "text"), (1, 0, whole[:100], 0, "text"), (1, 1, whole[103:200], 5, "text"), (1, 2, whole[180:300], 5, "text"), (1, 4, whole[303:306], 9, "ocr"),
        (1, 5, "not in the text", None, "text"), (2, 0, "orphan", 0, "text"), (3, 0, "漢字", 0, "text"), (3, 1, None, 0, "text"), (None, 0, "x", 0, "text"), (9, 1, "no document", 3, "text"),
    ]
    chunks = spark.createDataFrame(c, "document_id long, chunk_index int, content string, overlap_tokens_prev int, chunk_type string")
    got = {tuple(r) for r in P.audit(chunks, docs).select("document_id", "chunk_index", "kind").collect()}
    word = lambda x: x.isalnum()
    want = {(1, k, "cut_in_word") for k, a, b in ((0, 0, 100), (1, 103, 200), (2, 180, 300)) if (p := whole.find(whole[a:b])) >= 0 and (p > 0 and word(whole[p - 1]) and word(whole[p]) or word(whole[p + b - a - 1]) and word(whole[p + b - a]))}
    n1 = P.approx_tokens(P.shared(whole[:100], whole[103:200]))
    n2 = P.approx_tokens(P.shared(whole[103:200], whole[180:300]))
    want |= {(1, 1, "wrong_overlap")} if n1 != 5 else set()
    want |= {(1, 2, "wrong_overlap")} if n2 != 5 else set()
    want |= {(1, 5, "wrong_overlap")}
    assert got == want
    assert P.found(docs.limit(0), chunks.limit(0)).count() == 0
    kinds = {tuple(r) for r in P.oversized(spark.createDataFrame([(1, whole), (2, "y" * 1700), (3, " " * 2000 + "short"), (4, None)], "id long, content string")).collect()}
    assert kinds == {(1, "oversized"), (2, "oversized"), (2, "no_boundary")}
