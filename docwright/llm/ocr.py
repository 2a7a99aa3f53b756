"""Problem 3: noise in text from scanned pages, by noisy-channel correction.

1. Lines have roles. Page numbers stand alone at a page's edge in one of the usual forms; running headers are edge lines that
   repeat on the document's pages (compared by a folding of characters that are easily confused). All other lines are body. A body
   line's last word that goes on after a mark is joined with the next line's first. Every page is read once into its words.
2. Language model: in how many pages' bodies the words and word pairs of the corpus stand.
3. Channel: which characters are read for which, and how often, is learned from the corpus (`learned`). Words that differ from a much more frequent
   word in one short stretch are aligned with it; expectation-maximisation shares each rare word's count among the words it may stand for and
   itself, and counts the stretches. A page's confidence scales the rate.
4. Readings of a word are the words that the corpus has one learned confusion away, and two away for words without any; a reading stays if the misreadings
   expected of it can account for the word (`WORTH`). Each page gets those of its own words and the pair counts they need by joins, so nothing that
   grows with the corpus is sent to all workers. A page's words are decoded by Viterbi over word and pair counts; counts of the word as it was
   read leave out the reading itself. A digit or sign between letters that decoding leaves is a misread character all the same.

Nulls: pages with a null or empty text give nothing; a null confidence counts as `CONFIDENCE`; one of at most 1 is a share.
Repeated rows of one ocr_id count once. A page without line breaks is line 0. Empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from math import log

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut_lineage

#: A confusion: what may have been meant, and the logarithm of its probability, by what was read.
Channel = dict[str, tuple[tuple[str, float], ...]]
MARKS = "-‐­¬"
PUNCTUATION = ".,;:!?()[]{}\"'“”„«»‹›¿¡…–—’‘/*•"
SIGNS = set("0123456789@+$|!")
NUMBER = r"(?:[0-9lIOoSB|]{1,3}|[ivxlcIVXLC1]{1,6})"
FORMS = rf"[-–—]\s*{NUMBER}\s*[-–—]|\[\s*{NUMBER}\s*[\]\)l1]|(?:[pP]|pp|S)\.\s*{NUMBER}|[PF][a@]g[ec]\s+{NUMBER}\s+(?:[o0][ft]|/)\s+{NUMBER}|{NUMBER}\s*/\s*{NUMBER}"
PAGE_LINE = re.compile(rf"\s*(?:{FORMS}|{NUMBER})\s*$")
PAGE_START = re.compile(rf"\s*({FORMS})(?=\s)")
PAGE_END = re.compile(rf"(?<=\s)({FORMS})\s*$")
BARE_START, BARE_END = re.compile(rf"\s*({NUMBER})(?=\s)"), re.compile(rf"(?<=\s)({NUMBER})\s*$")
HEAD_NUMBER, TAIL_NUMBER = re.compile(rf"^\s*{NUMBER}\s*\|\s*"), re.compile(rf"(?:\s{{2,}}|\s*\|\s*){NUMBER}\s*$")
CODE = re.compile(r"^(?:[A-Z]{1,3}-\w*\d\w*(?:\.\w+)?|v\d[\w.]*|\S+@\S+\.\w+|[\W\d_]+|\d+\S*)$")
FOLD = str.maketrans("1i|!0589@+hcfq6", "llllosbgatbetgb")
#: Letters that are often read for one, made one before lines are compared.
FOLD_PAIRS = (("rn", "m"), ("ri", "n"), ("cl", "d"), ("vv", "w"), ("ii", "u"))
CONFIDENCE, SMOOTH, REPEATED = 85.0, 0.5, 0.05
#: Learning: letters that a word and what it shares with another have at least, how much more frequent the other is, rounds, the first guess of a
#: probability, how likely such a rare word is one of its own, different meant words that a confusion must be seen in, and its least share of all misreadings (so at most 1 / LEAST_SHARE are kept).
LONG, RATIO, ROUNDS, GUESS, OWN, SEEN_IN, LEAST_SHARE = 3, 10, 3, 0.002, 0.1, 3, 0.0005
#: Readings: how far the expected number of misreadings is trusted (texts bear noise in clusters), and the share of a word's count that it must reach.
TRUST, WORTH = 25.0, 0.1
ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}


def number(text: str, plain: bool = True) -> int | None:
    """The value of a page number as read; letters for digits are allowed."""
    t = text.strip()
    digits = t.translate(str.maketrans("lI|OoSB", "1110058"))
    if plain and digits.isdigit():
        return int(digits)
    low, total = t.lower().replace("1", "i"), 0
    for a, b in zip(low, low[1:] + " "):
        if a not in ROMAN:
            return None
        total += -ROMAN[a] if ROMAN.get(b, 0) > ROMAN[a] else ROMAN[a]
    return total


def folded(line: str) -> str:
    """The letters of a line without page numbers, characters that are easily confused made one."""
    bare = TAIL_NUMBER.sub("", HEAD_NUMBER.sub("", line)).lower()
    for two, one in FOLD_PAIRS:
        bare = bare.replace(two, one)
    bare = bare.translate(FOLD)
    return "".join(c for c in bare if c.isalpha())


def edges(lines: list[str], most: int = 2) -> list[int]:
    real = [i for i, x in enumerate(lines) if x.strip()]
    return sorted({*real[:most], *real[-most:]}) if len(real) > 1 else []


def like(a: str, b: str) -> bool:
    return abs(len(a) - len(b)) <= 0.3 * max(len(a), len(b), 1) and SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.8


def roles(text: str, page: int | None, headers: list[str]) -> tuple[list[str], list[str | None], set[str]]:
    """The body's lines, each line's role (body, header, page_number or None), and the kinds of a page without line breaks."""
    lines = text.split("\n")
    role: list[str | None] = ["body" if x.strip() else None for x in lines]
    keys = [folded(h) for h in headers]
    if sum(r is not None for r in role) > 1:
        for i in edges(lines):
            if PAGE_LINE.match(lines[i]):
                role[i] = "page_number"
        inner = [i for i in range(len(lines)) if role[i] == "body"]
        for i in {*inner[:1], *inner[-1:]} if len(inner) > 1 else ():
            key = folded(lines[i])
            if key and any(like(key, k) for k in keys) and lines[i].rstrip()[-1:] not in ".?!":
                role[i] = "header"
        return lines, role, set()
    kinds: set[str] = set()
    body = text
    for _ in range(2):
        for start in (True, False):
            pattern, bare = (PAGE_START, BARE_START) if start else (PAGE_END, BARE_END)
            for h in headers if "header" not in kinds else ():
                size = len(TAIL_NUMBER.sub("", HEAD_NUMBER.sub("", h)).strip())
                lead = HEAD_NUMBER.match(body)
                at = lead.end() if lead and start else len(body) - len(body.lstrip()) if start else max(0, len(body.rstrip()) - size)
                part = body[at : at + size] if start else TAIL_NUMBER.sub("", body.rstrip())[-size:]
                if size > 6 and like(folded(part), folded(h)):
                    body = body[at + size :] if start else TAIL_NUMBER.sub("", body.rstrip())[:-size]
                    kinds.add("header")
                    if start and (tail := re.match(rf"\s{{2,}}{NUMBER}(?=\s)", body)):
                        body = body[tail.end() :]
                    break
            if "page_number" not in kinds:
                hit = pattern.match(body) if start else pattern.search(body)
                if hit is None and (hit := bare.match(body) if start else bare.search(body)):
                    value, word = number(hit[1]), hit[1]
                    roman = re.fullmatch(r"[ivx1]+|[IVX]+", word) and not word.isdigit()
                    near = body[: hit.start()].rstrip()[-1:] if not start else "."
                    if not (value == page or roman and near in ".?!…" and (page is None or abs((number(word, False) or 99) - page) <= 3)):
                        hit = None
                if hit:
                    kinds.add("page_number")
                    body = body[hit.end() :] if start else body[: hit.start()]
    return [body], ["body"], kinds


def body_words(lines: list[str], role: list[str | None]) -> list[tuple[str, list[tuple[int, str]]]]:
    """(word, its parts by line) of the body, in order; a word that goes on after a mark is one."""
    out: list[tuple[str, list[tuple[int, str]]]] = []
    held: tuple[int, str] | None = None
    for i, line in enumerate(lines):
        if role[i] != "body":
            continue
        tokens = re.sub(rf"(?<=[^\W\d_])[{MARKS}]\s+(?=[^\W\d_])", "\x00", line).split() if len(lines) == 1 else line.split()
        for k, t in enumerate(tokens):
            if held and k == 0:
                n, first = held
                held = None
                out.append((first + t, [(n, first), (i, t)]))
                continue
            if k == len(tokens) - 1 and len(t) > 1 and t[-1] in MARKS and t[-2].isalpha() and len(lines) > 1:
                held = (i, t[:-1])
                continue
            out.append((t.replace("\x00", ""), [(i, t.replace("\x00", ""))]))
    if held:
        out.append((held[1], [held]))
    return out


def core(token: str) -> str:
    """What is looked up: punctuation at the ends off, lower case; '' for codes, numbers and single characters."""
    t = token.strip(PUNCTUATION)
    return "" if len(t) < 2 or CODE.match(t) else t.lower()


def hyphens(lines: list[str], role: list[str | None]) -> list[int]:
    """Body lines whose last word goes on in the next line, with a mark at the break."""
    if len(lines) == 1:
        return [0] if re.search(rf"[^\W\d_][{MARKS}]\s+[a-zà-ÿ]", lines[0]) else []
    out = []
    inner = [i for i in range(len(lines)) if role[i] == "body"]
    for a, b in zip(inner, inner[1:]):
        x, y = lines[a].rstrip(), lines[b].lstrip()
        if len(x) > 1 and x[-1] in MARKS and (x[-2].isalpha() or x[-2] in SIGNS) and y and (y[0].islower() or y[0] in SIGNS) and not re.search(r"[A-Z]{2}-$", x):
            out.append(a)
    return out


def meant(word: str, channel: Channel) -> dict[str, float]:
    """(candidate, logarithm of the probability) one confusion away from a word."""
    out: dict[str, float] = {}
    for size in (1, 2, 3):
        for i in range(len(word) - size + 1):
            for m, p in channel.get(word[i : i + size], ()):
                c = word[:i] + m + word[i + size :]
                out[c] = max(out.get(c, p), p)
    return out


def meant_twice(word: str, channel: Channel) -> dict[str, float]:
    out: dict[str, float] = {}
    for c, p in meant(word, channel).items():
        for d, q in meant(c, channel).items():
            if d != word:
                out[d] = max(out.get(d, p + q), p + q)
    return out


def stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(w, n, rest, sub): every word without each stretch of one to three characters."""
    for b in batches:
        rows = [(w, n, w[:i] + "\x00" + w[i + k :], w[i : i + k]) for w, n in zip(b["w"], b["n"]) for k in (1, 2, 3) for i in range(len(w) - k + 1) if len(w) - k >= LONG]
        yield pd.DataFrame(rows, columns=["w", "n", "rest", "sub"])


def learned(words: DataFrame) -> Channel:
    """The channel from the words of a corpus (w, n), by expectation-maximisation over aligned words."""
    cut = words.mapInPandas(stretches, "w string, n long, rest string, sub string")
    often = words.where(F.col("n") >= RATIO).mapInPandas(stretches, "w string, n long, rest string, sub string")
    side = lambda x, df: df.select("rest", F.col("w").alias(x), F.col("n").alias(f"n_{x}"), F.col("sub").alias(f"sub_{x}"))
    apart = (F.left("sub_w", F.lit(1)) != F.left("sub_v", F.lit(1))) & (F.right("sub_w", F.lit(1)) != F.right("sub_v", F.lit(1)))
    pairs = cut_lineage(side("w", cut).join(side("v", often), "rest").where((F.col("n_v") >= F.col("n_w") * RATIO) & apart).select("w", "n_w", "v", "n_v", F.col("sub_w").alias("seen"), F.col("sub_v").alias("meant")).distinct())
    pairs = cut_lineage(pairs.join(pairs.select(F.col("w").alias("v")).distinct(), "v", "left_anti"))  # a word that may be a misreading itself teaches nothing
    chances = cut_lineage(often.groupBy(F.col("sub").alias("meant")).agg(F.sum("n").alias("chances")))
    table = pairs.select("seen", "meant").distinct().withColumn("p", F.lit(GUESS))
    of = Window.partitionBy("w")
    for _ in range(ROUNDS):
        expected = pairs.join(table, ["seen", "meant"]).withColumn("expected", F.col("n_v") * F.col("p"))
        shared = expected.withColumn("part", F.col("n_w") * F.col("expected") / (F.col("n_w") * OWN + F.sum("expected").over(of)))
        by_word = shared.groupBy("seen", "meant", "v").agg(F.sum("part").alias("part"))
        # what one word alone shows is left out: two real words ("seven", "several") are alike only once
        counted = by_word.groupBy("seen", "meant").agg((F.sum("part") - F.max("part")).alias("part"), F.count("*").alias("seen_in"))
        table = cut_lineage(counted.join(chances, "meant").select("seen", "meant", (F.col("part") / F.col("chances")).alias("p"), "part", "seen_in"))
    total = table.agg(F.sum("part")).first()[0] or 0.0
    out: dict[str, list[tuple[str, float]]] = {}
    for r in table.where((F.col("seen_in") >= SEEN_IN) & (F.col("part") >= total * LEAST_SHARE) & (F.col("p") > 0)).select("seen", "meant", "p").orderBy("seen", "meant").collect():
        out.setdefault(r["seen"], []).append((r["meant"], log(r["p"])))
    return {k: tuple(v) for k, v in out.items()}


def lattice(words: list[str], known: dict[str, tuple[int, list[tuple[str, int, float, int]]]]) -> list[list[tuple[str, int, float, int]]]:
    """Of each word the readings (word, count, logarithm of the probability, confusions), the one that was read first, its count without itself."""
    return [[(w, max(0, known[w][0] - 1), 0.0, 0), *known[w][1]] if w in known else [(w, 0, 0.0, 0)] for w in words]


def decode(words: list[str], known: dict, pair: dict[tuple[str, str], int], rate: float) -> list[str]:
    """Viterbi over the readings of a page's words; only stretches around doubtful words have a choice."""
    nodes = lattice(words, known)
    best: list[list[tuple[float, int]]] = []
    for i, options in enumerate(nodes):
        row = []
        for w, n, p, steps in options:
            own = p + (log(TRUST) + log(rate)) * steps
            if len(options) == 1 and (i == 0 or len(nodes[i - 1]) == 1):
                row.append((best[-1][0][0] if i else 0.0, 0))
                continue
            score = (-1e18, 0)
            for j, (v, *_) in enumerate(nodes[i - 1] if i else [("", 0, 0.0, 0)]):
                seen = pair.get((v, w), 0)
                if i and (w == words[i] and v == words[i - 1]):
                    seen = max(0, seen - 1)
                base = log(SMOOTH * (n + 0.02) + seen) if len(options) > 1 else log(0.02 + seen)
                score = max(score, ((best[-1][j][0] if i else 0.0) + own + base, j))
            row.append(score)
        best.append(row)
    out, at = [], max(range(len(best[-1])), key=lambda k: best[-1][k][0]) if best else 0
    for i in range(len(nodes) - 1, -1, -1):
        out.append(nodes[i][at][0])
        at = best[i][at][1]
    return out[::-1]


def rate_of(confidence: float | None) -> float:
    c = CONFIDENCE if confidence is None or pd.isna(confidence) else confidence * 100 if confidence <= 1 else confidence
    return min(3.0, max(0.3, (101 - c) / 12))


def wrong_lines(parts: list[tuple[int, str]], seen: str, right: str) -> set[int]:
    """The lines on which a word differs from what was meant."""
    if len(parts) == 1:
        return {parts[0][0]}
    whole = "".join(p for _, p in parts)
    lead = len(whole) - len(whole.lstrip(PUNCTUATION))
    a = 0
    while a < min(len(seen), len(right)) and seen[a] == right[a]:
        a += 1
    z = 0
    while z < min(len(seen), len(right)) - a and seen[-1 - z] == right[-1 - z]:
        z += 1
    cut = len(parts[0][1]) - lead
    return {parts[0][0] if a < cut else parts[1][0], parts[1][0] if len(seen) - z > cut else parts[0][0]}


def recased(token: str, seen: str, right: str) -> str:
    """The token with its word put right, capitals and punctuation kept."""
    low = token.lower()
    at = low.find(seen)
    word = token[at : at + len(seen)]
    new = right.upper() if word.isupper() and len(word) > 1 else right[:1].upper() + right[1:] if word[:1].isupper() else right
    return token[:at] + new + token[at + len(seen) :]


def read_pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each page once: its noise by layout, and its body's words by line; words broken over two lines with the size of their first part."""
    for b in batches:
        rows = []
        for i, text, page, confidence, headers in b[["ocr_id", "text", "page_number", "confidence", "headers"]].itertuples(index=False, name=None):
            lines, role, kinds = roles(text, None if pd.isna(page) else int(page), list(headers) if headers is not None else [])
            found = {(0, k) for k in kinds} | {(n, r) for n, r in enumerate(role) if r in ("header", "page_number")} | {(n, "hyphen") for n in hyphens(lines, role)}
            words = body_words(lines, role)
            rows.append((i, confidence, [{"line": n, "kind": k} for n, k in sorted(found)], [core(w) for w, _ in words], [w for w, _ in words], [parts[0][0] for _, parts in words], [{"word": k, "size": len(parts[0][1]), "line": parts[1][0]} for k, (_, parts) in enumerate(words) if len(parts) > 1]))
        yield pd.DataFrame(rows, columns=["ocr_id", "confidence", "found", "cores", "tokens", "lines", "broken"])


READ = "ocr_id long, confidence double, found array<struct<line:int,kind:string>>, cores array<string>, tokens array<string>, lines array<int>, broken array<struct<word:int,size:int,line:int>>"


class Pages:
    """The stages over one table of scanned pages (ocr_id, document_id, page_number, text, confidence)."""

    def __init__(self, ocr: DataFrame):
        good = ocr.where("ocr_id is not null and text is not null and text <> ''").select("ocr_id", "document_id", "page_number", "text", "confidence").dropDuplicates(["ocr_id"])

        def edge_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = []
                for d, p, t in zip(b["document_id"], b["page_number"], b["text"]):
                    lines = t.split("\n")
                    rows += [(d, p, key, lines[i].strip()) for i in edges(lines) if not PAGE_LINE.match(lines[i]) and len(key := folded(lines[i])) >= 6]
                yield pd.DataFrame(rows, columns=["document_id", "page_number", "key", "line"])

        seen = good.where("document_id is not null").mapInPandas(edge_lines, "document_id long, page_number int, key string, line string")
        total = good.groupBy("document_id").agg(F.count_distinct("page_number").alias("total"))
        often = seen.groupBy("document_id", "key").agg(F.count_distinct("page_number").alias("pages"), F.min("line").alias("line")).where("pages >= 2").join(total, "document_id")
        often = often.where(F.col("pages") >= F.col("total") * REPEATED)  # so a document has at most 4 / REPEATED of them
        headers = often.groupBy("document_id").agg(F.collect_set("line").alias("headers"))
        self.pages = cut_lineage(good.join(headers, "document_id", "left").mapInPandas(read_pages, READ))
        self.single = cut_lineage(self.pages.select(F.explode(F.array_distinct("cores")).alias("w")).where("w <> ''").groupBy("w").agg(F.count("*").alias("n")))
        beside = F.expr("transform(sequence(1, size(cores) - 1), i -> struct(cores[i - 1] as v, cores[i] as w))")
        both = self.pages.where("size(cores) > 1").select(F.explode(F.array_distinct(beside)).alias("p")).select("p.v", "p.w")
        self.pairs = cut_lineage(both.where("v <> '' and w <> ''").groupBy("v", "w").agg(F.count("*").alias("n")))

    def doubtful(self) -> DataFrame:
        """(w, n, cands): words that the corpus has a likelier reading of, with all their readings."""
        channel = learned(self.single)

        def readings(batches: Iterator[pd.DataFrame], away, steps: int) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame([(w, n, c, p, steps) for w, n in zip(b["w"], b["n"]) for c, p in away(w, channel).items()], columns=["w", "own", "cand", "p", "steps"])

        schema = "w string, own long, cand string, p double, steps int"
        corpus = self.single.select(F.col("w").alias("cand"), "n")
        weight = F.col("n") * F.exp("p") * F.pow(F.lit(TRUST), F.col("steps"))
        kept = lambda df: df.join(corpus, "cand").where((F.col("n") > F.col("own")) & (weight >= F.col("own") * WORTH))
        first = cut_lineage(kept(self.single.mapInPandas(lambda x: readings(x, meant, 1), schema)))
        rest = self.single.join(first.select("w").distinct(), "w", "left_anti")
        found = first.unionByName(kept(rest.mapInPandas(lambda x: readings(x, meant_twice, 2), schema)))
        return found.groupBy("w").agg(F.max("own").alias("n"), F.collect_list(F.struct("cand", "n", "p", "steps")).alias("cands"))

    def examine(self) -> DataFrame:
        """(ocr_id, line_no, kind, text): noise by line, and with line_no -1 the repaired text."""
        doubt = cut_lineage(self.doubtful())
        of_page = self.pages.select("ocr_id", F.explode(F.array_distinct("cores")).alias("w")).join(doubt, "w").groupBy("ocr_id").agg(F.collect_list(F.struct("w", "n", "cands")).alias("doubtful"))
        rows = self.pages.join(of_page, "ocr_id", "left")

        def needed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = []
                for i, words, doubtful in zip(b["ocr_id"], b["cores"], b["doubtful"]):
                    known = {d["w"]: [d["w"], *(c["cand"] for c in d["cands"])] for d in doubtful}
                    out += [(i, v, w) for v, w in {(v, w) for x, y in zip(words, words[1:]) if x and y and (x in known or y in known) for v in known.get(x, [x]) for w in known.get(y, [y])}]
                yield pd.DataFrame(out, columns=["ocr_id", "v", "w"])

        asked = rows.where("doubtful is not null").select("ocr_id", "cores", "doubtful").mapInPandas(needed, "ocr_id long, v string, w string")
        pairs = asked.join(self.pairs, ["v", "w"]).groupBy("ocr_id").agg(F.collect_list(F.struct("v", "w", "n")).alias("pairs"))

        def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = []
                for i, *row in b[["ocr_id", "confidence", "found", "cores", "tokens", "lines", "broken", "doubtful", "pairs"]].itertuples(index=False, name=None):
                    found, text = examined(*row)
                    out += [(i, n, k, None) for n, k in found] + [(i, -1, "text", text)]
                yield pd.DataFrame(out, columns=["ocr_id", "line_no", "kind", "text"])

        return rows.join(pairs, "ocr_id", "left").mapInPandas(look, "ocr_id long, line_no int, kind string, text string")


def examined(confidence, found, cores, tokens, lines, broken, doubtful, pairs) -> tuple[list[tuple[int, str]], str]:
    """(line, kind) of a page's noise, and its repaired text."""
    noise_ = {(f["line"], f["kind"]) for f in found}
    known = {d["w"]: (d["n"], [(c["cand"], c["n"], c["p"], c["steps"]) for c in d["cands"]]) for d in (doubtful if doubtful is not None else ())}
    pair = {(p["v"], p["w"]): p["n"] for p in (pairs if pairs is not None else ())}
    second = {x["word"]: (x["size"], x["line"]) for x in broken}
    repaired = []
    for k, (seen, right) in enumerate(zip(cores, decode(list(cores), known, pair, rate_of(confidence)) if len(cores) else ())):
        token, own = tokens[k], [(lines[k], tokens[k])]
        if k in second:
            size, line = second[k]
            own = [(lines[k], token[:size]), (line, token[size:])]
        wrong = seen and seen != right
        if wrong:
            noise_ |= {(i, "misread") for i in wrong_lines(own, seen, right)}
            token = recased(token, seen, right)
        elif seen and len(seen) > 3 and re.search(r"[^\W\d_][0-9@+$|][^\W\d_]", seen) and not CODE.match(token.strip(PUNCTUATION)):
            noise_.add((own[0][0], "misread"))
        repaired.append(token)
    return sorted(noise_), " ".join(repaired)


def noise(ocr: DataFrame) -> DataFrame:
    return Pages(ocr).examine().where("line_no >= 0").select("ocr_id", "line_no", "kind")


def repaired(ocr: DataFrame) -> DataFrame:
    """(ocr_id, text): the body of every page as one continuous text."""
    return Pages(ocr).examine().where("line_no < 0").select("ocr_id", "text")
