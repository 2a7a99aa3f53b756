from docwright.llm import ocr as O

SCHEMA = "ocr_id long, document_id long, page_number int, text string, confidence double, extra string"
BODY = ["the valve was sealed by the operator near the bridge", "every harbour was documented by the nurse near the bridge", "the operator sealed the valve and the nurse sealed the bridge"]


def pages():
    rows = [(i, i // 8, i % 8 + 1, f"Quiet Ledger: Parish\n{BODY[i % 3]}\n{BODY[(i + 1) % 3]}.\n{i % 8 + 1}", 95.0, "x") for i in range(64)]
    # pages that teach the channel: each has one word read wrongly
    taught = ["scaled", "opcrator", "bridgc", "cvery", "documcnted", "riear", "documerited", "plarited", "sea1ed", "severa1", "c1erks", "ye1low", "se@led", "ne@r", "c@nal"]
    rows += [(300 + i, 200 + i, 1, "several clerks planted yellow lilies near the canal\nand the harbour", 95.0, None) for i in range(40)]
    rows += [(200 + i, 80 + i, 1, f"{BODY[0]}\n{BODY[1]}\n{w} {BODY[2]}", 95.0, None) for i, w in enumerate(taught)]
    rows += [
        (100, 50, 1, "Quiet Ledger: Parish\nthe va1ve was sealed by the oper-\nator near the bridge\nthe harbour was docu¬\nmented by the nursc.\n- 1 -", 70.0, None),
        (101, 50, 2, "Qu1et Ledger: Parish   2\nthe riurse sealed the bridge\nevery harbour near the valve.", None, None),
        (102, 51, 3, "every harbour was sea- led by the nurse near the v@lve. [3]", 0.7, None),
        (103, 52, 1, None, None, None), (104, 52, 2, "", None, None), (105, None, None, "7312\nthe valve was sealed.", 99.0, None), (106, 53, 1, "the valve " * 20_000, 99.0, None),
    ]
    return rows + rows[-7:-3]


def test_kinds(spark):
    P = O.Pages(spark.createDataFrame(pages(), SCHEMA))
    rows = P.examine().collect()
    got = {(r["ocr_id"], r["line_no"], r["kind"]) for r in rows if r["line_no"] >= 0 and 100 <= r["ocr_id"] < 200}
    assert got == {
        (100, 0, "header"), (100, 1, "misread"), (100, 1, "hyphen"), (100, 3, "hyphen"), (100, 4, "misread"), (100, 5, "page_number"),
        (101, 0, "header"), (101, 1, "misread"), (102, 0, "hyphen"), (102, 0, "misread"), (102, 0, "page_number"),
    }
    text = {r["ocr_id"]: r["text"] for r in rows if r["line_no"] < 0}
    assert text[100] == "the valve was sealed by the operator near the bridge the harbour was documented by the nurse."
    assert text[101].startswith("the nurse sealed") and 103 not in text and 104 not in text
    clean = {(r["line_no"], r["kind"]) for r in rows if 0 <= r["ocr_id"] < 64 and r["line_no"] >= 0}
    assert clean == {(0, "header"), (3, "page_number")}
    assert len(rows) == len({(r["ocr_id"], r["line_no"], r["kind"]) for r in rows})


def test_empty(spark):
    e = spark.createDataFrame([], SCHEMA)
    assert O.noise(e).count() == 0 and O.repaired(e).count() == 0


def test_numbers_and_words():
    assert [O.number(t) for t in ("12", "l2", "lO", "iv", "xii", "abc")] == [12, 12, 10, 4, 12, None]
    assert [O.core(t) for t in ("(Valve,", "KX-7736", "v1.2.3", "a@b.de", "12.5", "procès-verbal")] == ["valve", "", "", "", "", "procès-verbal"]
    channel = {"m": (("rn", -5.0),), "d": (("cl", -5.0),), "c": (("e", -4.0),)}
    assert "modern" in O.meant("modem", channel) and O.meant("derk", channel) == {"clerk": -5.0} and O.meant_twice("dcrk", channel)["clerk"] == -9.0
    assert O.wrong_lines([(1, "docu"), (2, "mcnted")], "documcnted", "documented") == {2}


def test_the_channel_is_learned(spark):
    """Confusions and their rates come from the words alone; inflections and rare words teach nothing."""
    words = {w: 1000 for w in ("sealed", "window", "letters", "harbour", "evening", "between", "several")}
    words |= {w: 3 for w in ("scaled", "lcttcrs", "cvening", "evcning", "bctween", "sevcral", "wiridow", "everiing", "betweeri")} | {w: 200 for w in ("window's", "letter", "evenings")} | {"zebra": 1}
    words |= {"seven": 60, "scven": 1, "sevcn": 1, "scveral": 12, "sevcral": 12}  # alike by nature, misread by the same scanner
    channel = O.learned(spark.createDataFrame(list(words.items()), "w string, n long"))
    assert {(s, m) for s, ms in channel.items() for m, _ in ms} == {("c", "e"), ("ri", "n")}
    e, n = channel["c"][0][1], channel["ri"][0][1]
    assert -9 < e < -5 and -9 < n < -5
    assert O.learned(spark.createDataFrame([], "w string, n long")) == {}


def test_word_pairs_decide():
    """Two readings are equally frequent and equally likely misread; what stands beside them tells."""
    known = {"fcrm": (1, [("firm", 50, -5.0, 1), ("form", 50, -5.0, 1)])}
    for before, after, right in (("the", "signed", "firm"), ("fill", "out", "form")):
        pairs = {("the", "firm"): 9, ("firm", "signed"): 9, ("fill", "form"): 9, ("form", "out"): 9}
        assert O.decode([before, "fcrm", after], known, pairs, 1.0) == [before, right, after]
        assert O.decode([before, "fcrm", after], known, {}, 1.0)[1] in ("firm", "form")
