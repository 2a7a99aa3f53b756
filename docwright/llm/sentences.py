"""Problem 6: sentence units of documents in many languages and scripts.

Document-centred disambiguation: whether a period ends a sentence is decided from unambiguous occurrences elsewhere, first in the
document itself, then in the corpus. No word lists are used.

* A word that stands with its period before a small letter or a comma is an abbreviation; so is one that (twice or more) stands only with a capital and its period, never at
  the end of a paragraph, and before capitals of different words that the document does not have in small letters (unless the corpus ends paragraphs with it). Abbreviations of the second kind, and those
  that never end a paragraph and go on with a number, a small letter or a comma, end no sentence. An abbreviation that may end one does so before a
  capital, unless the capital's word is a name.
* A word with a capital inside a sentence is a name here, unless the document also has it in small letters.
* The corpus tells the same from all its texts (`knowledge`), for words the document leaves open, and which words follow ordinals ("3. Mai").
* Initials, halves of pairs ("z. B.", "E. U.") and the terminators of scripts without case or spaces go by the script's rules alone.

Rules: an empty line ends a unit; a site's notice on a line of its own starts one and ends one. Notices are the lines that problem 1 finds
repeated in the site's documents. A single line break ends nothing. Nothing ends inside a quotation; after one that ends with a mark, a unit ends
only if what follows can start a sentence. A list item's bullet or number belongs to its first sentence. Units never have white space at their ends.

Nulls, empty and blank texts have no units. Texts are read whole. Repeated rows of one id count once. Positions are code
points. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boilerplate import document_sites, excessive_lines, line_bitmaps, line_keys, sited
from .common import cut_lineage

#: Texts that must show a word before the corpus speaks of it: at least so many, and at least this share of all.
LEAST, SHARE = 5, 0.001
#: Of a word's periods: the share at ends of paragraphs that one that ends no sentence may have (errors of writing), the share before small letters
#: and commas that proves an abbreviation, the share of a word that may stand without its period, the share that one follower may have before it is a fixed phrase.
STRAY, PROOF, BARE, FROZEN = 0.01, 0.2, 0.05, 0.5
#: Of all places of a word with a capital, the share after a number and a period that makes the period an ordinal's.
ORDINAL = 0.5
GAP = re.compile(r"\n[^\S\n]*\n\s*")
MARK = re.compile(r"[.!?…]+|[。！？｡।॥؟]+[.!?…]*")
CLOSERS = "\"'”’»)]}“」』）】›"
OPENERS = "([“„«\"'‘"
SPACES = "     "
QUOTES = re.compile(r"“[^“”\"]+”?|„[^„“”]+[“”]|«[^«»]+»|「[^「」]+」|『[^『』]+』|\"[^\"]+\"", re.S)
BULLET = re.compile(r"\s*(?:[•·▪▸◦*–—-]+|\(?(?:\d{1,3}|[A-Za-z]|[ivxIVX]{1,4})[.)]|\d{1,3}(?:\.\d{1,3})+\.?)\s+")
HAN = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]")
NAME_INSIDE = re.compile(r"(?<=[a-zà-öø-ÿ,;] )([A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ]{2,})")
#: Where a word with its period stands: at a paragraph's end, before a small letter or a comma, before a digit, before another word.
END, INNER, DIGIT, OTHER = range(4)


@dataclass
class Knowledge:
    """What is known of words: abbreviations that end no sentence, that may end one, words that are none, and what follows an ordinal."""

    never: set[str] = field(default_factory=set)
    may: set[str] = field(default_factory=set)
    plain: set[str] = field(default_factory=set)
    ordinal: set[str] = field(default_factory=set)


def bare(token: str) -> str:
    return token.lstrip(OPENERS).rstrip(".,;:!?" + CLOSERS)


def lexical(token: str) -> str:
    """The word of a token that ends with a period or before it: openers and elisions ("l’") off."""
    return token.lstrip(OPENERS).rsplit("’", 1)[-1].rsplit("'", 1)[-1]


def periods(text: str) -> Iterator[tuple[str, int, str]]:
    """(word, where, follower) of every word with a single period; words as they stand."""
    for paragraph in GAP.split(text):
        if "." not in paragraph:
            continue
        tokens = paragraph.split()
        for i, token in enumerate(tokens):
            if token[-1] == "." and token[-2:] != "..":
                word = lexical(token[:-1])
                if not word or not (word[0].isalpha() or word[0].isdigit()):
                    continue
                follower = tokens[i + 1].lstrip(OPENERS) if i + 1 < len(tokens) else ""
                first = follower[:1]
                yield word, END if not first else INNER if first.islower() and (w := bare(follower)) == w.lower() else DIGIT if first.isdigit() else OTHER, follower
            elif token[-2:] == ".," and (word := lexical(token[:-2]))[:1].isalpha():
                yield word, INNER, ""


def spoken(text: str, corpus: Knowledge) -> tuple[Knowledge, set[str]]:
    """What a document itself tells: of its abbreviations, and which words after those that may end a sentence are names (capitals inside sentences, never small)."""
    known, names = Knowledge(), set()
    places: dict[str, tuple[list[int], set[str]]] = {}
    after: dict[str, set[str]] = {}
    for word, where, follower in periods(text):
        if word[0].isdigit():
            continue
        n, followers = places.setdefault(word.lower(), ([0, 0, 0, 0], set()))
        n[where] += 1
        if where == OTHER:
            after.setdefault(word.lower(), set()).add(bare(follower))
            followers.add(bare(follower) if word[0].isupper() and follower[0].isupper() else "")
    words: set[str] | None = None
    for word, (n, followers) in places.items():
        if n[INNER]:
            known.may.add(word)
        elif n[END]:
            known.plain.add(word)
        elif len(followers) > 1 and "" not in followers and not n[DIGIT]:
            words = {bare(t) if t[-1] != "." else t.lstrip(OPENERS) for t in text.split()} if words is None else words
            if not words & {word, word.capitalize()} and not words & {f.lower() for f in followers}:
                known.never.add(word)
    if asked := {f for w, fs in after.items() if w in known.may or w in corpus.may for f in fs}:
        small = {bare(t) for t in text.split()}
        names = {x for x in asked & set(NAME_INSIDE.findall(text)) if x.lower() not in small}
    return known, names


def evidence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(kind, word, follower, n, texts): of each batch the words' places by kind, how often a word stands at all ('any'), and the number of texts ('')."""
    for b in batches:
        seen: Counter[tuple[str, str, str]] = Counter()
        held: Counter[tuple[str, str, str]] = Counter()
        tokens: Counter[str] = Counter()
        for text in b["text"]:
            own: Counter[tuple[str, str, str]] = Counter()
            for word, where, follower in periods(text):
                if word[0].isdigit():
                    if where == OTHER and follower[0].isupper():
                        own["ordinal", bare(follower), ""] += 1
                else:
                    own["EIDO"[where], word.lower(), bare(follower) if where == OTHER else ""] += 1
            seen.update(own)
            held.update(dict.fromkeys(own, 1))
            tokens.update(text.split())
        asked = {w for k, w, _ in seen if k != "ordinal"}
        capital = {w for k, w, _ in seen if k == "ordinal"}
        for token, n in tokens.items():
            w = token.lstrip(OPENERS).rstrip(",;:!?" + CLOSERS)
            if (low := w.lower()) in asked:
                seen["bare", low, ""] += n
            if (w := w.rstrip(".")) in capital:
                seen["any", w, ""] += n
        rows = [(k, w, f, n, held.get((k, w, f), 0)) for (k, w, f), n in seen.items()]
        yield pd.DataFrame([*rows, ("", "", "", len(b), len(b))], columns=["kind", "word", "follower", "n", "texts"])


def knowledge(texts: DataFrame) -> Knowledge:
    """What the corpus tells, from all texts (text).

    Only words that at least `LEAST` texts and one text in a thousand (`SHARE`) show with a period. A text shows a bounded number of words
    (it has as many as periods), so with E of them a text on average at most E / SHARE words pass, however large the corpus: what is
    collected and sent to the workers does not grow with it.
    """
    rows = texts.select("text").mapInPandas(evidence, "kind string, word string, follower string, n long, texts long").groupBy("kind", "word", "follower").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts"))
    rows = cut_lineage(rows)
    total = rows.where("kind = ''").agg(F.sum("n")).first()[0] or 0
    least = max(LEAST, total * SHARE)
    of = lambda *kinds: F.sum(F.when(F.col("kind").isin(*kinds), F.col("n")).otherwise(0))
    shown = F.sum(F.when(F.col("kind").isin("E", "I", "D", "O"), F.col("texts")).otherwise(0))
    words = rows.where("kind not in ('', 'ordinal', 'any')").groupBy("word").agg(
        of("E", "I", "D", "O").alias("n"), of("E").alias("end"), of("I").alias("inner"), of("D").alias("digit"), of("bare").alias("bare"),
        F.sum(F.when(F.col("kind") == "O", 1).otherwise(0)).alias("followers"), F.max(F.when(F.col("kind") == "O", F.col("n"))).alias("often"), shown.alias("texts"),
    ).where(F.col("texts") >= least)
    ends, inner = F.col("end") > F.col("n") * STRAY, F.col("inner") >= F.col("n") * PROOF
    leads = F.col("inner") + F.col("digit") >= F.col("n") / 2
    titles = (F.col("bare") <= F.col("n") * BARE) & (F.col("followers") >= LEAST) & (F.col("often") <= F.col("n") * FROZEN)
    kind = F.when(~ends & (leads | titles), "never").when(inner, "may").when(ends, "plain")
    out = Knowledge()
    for r in words.select("word", kind.alias("kind")).where("kind is not null").collect():
        getattr(out, r["kind"]).add(r["word"])
    dates = rows.where("kind in ('ordinal', 'any')").groupBy("word").agg(of("ordinal").alias("n"), of("any").alias("any"), F.sum("texts").alias("texts"))
    out.ordinal = {r["word"] for r in dates.where((F.col("texts") >= least) & (F.col("n") >= F.col("any") * ORDINAL)).select("word").collect()}
    return out


def can_start(text: str, at: int, end: int) -> str:
    """What stands at a place: 'upper', 'lower', 'digit', 'caseless', 'open' or 'other'."""
    c = text[at]
    if c in "“„«\"「『¿¡‘(（[":
        return "open"
    if c.isdigit():
        return "digit"
    if c.isalpha():
        if c.isupper() or c.istitle():
            return "upper"
        if c.islower():
            word = re.match(r"\w+", text[at:end])[0]
            return "upper" if any(x.isupper() for x in word) else "lower"
        return "caseless"
    return "other"


def ends(text: str, start: int, m_start: int, m_end: int, after: int, end: int, own: Knowledge, names: set[str], corpus: Knowledge) -> bool:
    """Whether the marks at m_start..m_end, with their closers up to `after`, end a sentence; text[after:end] holds more."""
    nxt = after
    while nxt < end and text[nxt].isspace():
        nxt += 1
    if nxt >= end:
        return True
    mark, gap = text[m_start:m_end], nxt > after
    kind = can_start(text, nxt, end)
    closed = after > m_end
    if mark[0] in "。！？｡।॥؟":
        if closed:
            return gap or kind in ("open", "upper")  # a quotation goes on with its verb
        return kind != "other" or gap or True
    before = text[m_start - 1] if m_start > start else " "
    if not gap:
        if closed or not (before.isalnum() or before in CLOSERS):
            return False
        if kind == "caseless":
            return bool(before.isalpha() and not mark.startswith(".") or (HAN.match(text[nxt]) and mark != "."))
        if kind == "open":
            return before.isalpha() and text[nxt] in "“„«¿¡「"
        following = text[nxt + 1 : nxt + 2]
        small = before.islower() and m_start - start > 2 and text[m_start - 3 : m_start].isalpha()
        return kind == "upper" and (following.islower() or following in "’' " and bool(following)) and (small or mark != "." and before.isalnum() or before.isdigit() and following.islower())
    if "!" in mark or "?" in mark or "…" in mark or len(mark) > 1:
        return kind != "lower" and not (kind == "other" and text[nxt] in ",;:)»”–-")
    # a single period, white space after it
    if closed:
        return kind in ("upper", "digit", "caseless", "open") or kind == "other" and text[nxt] not in ",;:)»”–-"
    at = m_start
    while at > start and not text[at - 1].isspace():
        at -= 1
    word = lexical(text[at:m_start])
    low = word.lower()
    if kind == "lower" or kind == "other" and text[nxt] in ",;:)»”":
        return False
    if word.isdigit():
        return not (kind == "upper" and re.match(r"\w+", text[nxt:end])[0] in corpus.ordinal)
    last = word.rsplit(".", 1)[-1]
    if len(last) == 1 and last.isalpha() and (last.isupper() and kind in ("upper", "other") or text[nxt + 1 : nxt + 2] == "." and text[nxt].isalpha()):
        return False  # an initial, or the first half of a pair
    if word.isupper() and text[nxt : nxt + len(word)].isupper() and text[nxt + len(word) : nxt + len(word) + 1] == ".":
        return False  # a pair of the same length, such as "EE. UU."
    if low in own.never and low not in corpus.plain or low in corpus.never and low not in own.plain:
        return False
    if low in own.may or low in corpus.may and low not in own.plain:
        if kind == "digit":
            return False
        name = re.match(r"\w+", text[nxt:end])
        return not (name and name[0] in names)
    return True


def segments(text: str, notices: set[int] = frozenset()) -> Iterator[tuple[int, int]]:
    """Stretches that no unit crosses: between empty lines, and around notices (given by line numbers)."""
    cuts = [(g.start(), g.end()) for g in GAP.finditer(text)]
    if notices:
        at = 0
        for i, line in enumerate(text.split("\n")):
            if i in notices and line.strip():
                cuts += [(max(0, at - 1), at), (at + len(line), at + len(line) + 1)]
            at += len(line) + 1
        cuts.sort()
    at = 0
    for start, end in [*cuts, (len(text), len(text))]:
        if at < start:
            yield at, start
        at = max(at, end)


NOTHING = Knowledge()


def sentences(text: str | None, corpus: Knowledge = NOTHING, notices: set[int] = frozenset()) -> list[tuple[int, int]]:
    """[start, end) of every sentence unit of a text; corpus: what is known from elsewhere; notices: numbers of the lines that stand alone."""
    if not text:
        return []
    own, names = spoken(text, corpus) if "." in text else (NOTHING, set())
    out: list[tuple[int, int]] = []

    def add(s: int, e: int) -> None:
        while s < e and text[s].isspace():
            s += 1
        while e > s and text[e - 1].isspace():
            e -= 1
        if s < e:
            out.append((s, e))

    for start, stop in segments(text, notices):
        inside = [q.span() for q in QUOTES.finditer(text, start, stop)]
        q = 0
        bullet = BULLET.match(text, start, stop)
        first = begin = start
        if bullet:
            begin = bullet.end()
        for m in MARK.finditer(text, begin, stop):
            while q < len(inside) and inside[q][1] <= m.end():
                q += 1
            after = m.end()
            if q < len(inside) and inside[q][0] <= m.start():
                # within a quotation; only a mark at its very end can matter
                tail = after
                while tail < stop and text[tail] in SPACES:
                    tail += 1
                if tail != inside[q][1] - 1:
                    continue
                after = inside[q][1]
            while after < stop and text[after] in CLOSERS and not (text[after] in "\"“'" and after + 1 < stop and text[after + 1].isalnum()):
                after += 1
            if after < first:
                continue
            if ends(text, first, m.start(), m.end(), after, stop, own, names, corpus):
                add(first, after)
                first = after
        add(first, stop)
    return out


def sentence_units(texts: DataFrame) -> DataFrame:
    """(unit_kind, unit_id, start_char, end_char) of texts (unit_kind, unit_id, text, optionally notices array<int>). Rows repeated under one id give their units once."""
    notices = F.col("notices") if "notices" in texts.columns else F.lit(None).cast("array<int>")
    good = texts.where("unit_id is not null and text is not null and text <> ''").select("unit_kind", "unit_id", "text", notices.alias("notices"))
    corpus = knowledge(good)

    def units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for kind, i, text, lines in zip(b["unit_kind"].tolist(), b["unit_id"].tolist(), b["text"].tolist(), b["notices"].tolist()):
                rows += [(kind, i, s, e) for s, e in sentences(text, corpus, set(lines) if lines is not None else NOTHING_SET)]
            yield pd.DataFrame(rows, columns=["unit_kind", "unit_id", "start_char", "end_char"])

    return good.mapInPandas(units, "unit_kind string, unit_id long, start_char int, end_char int").distinct()


NOTHING_SET: frozenset[int] = frozenset()


def with_notices(texts: DataFrame, blocks: DataFrame, metadata: DataFrame) -> DataFrame:
    """Adds `notices`, the numbers of each text's lines that problem 1 finds repeated in its site. texts: unit_kind, unit_id, document_id, text.

    Only texts in which a line stands next to another one can need it.
    """
    sites = cut_lineage(document_sites(blocks, metadata))
    excessive = cut_lineage(excessive_lines(line_bitmaps(sited(blocks, sites)), sites))
    several = texts.where(r"document_id is not null and text rlike '\\n[^\n]*\\S'").select("unit_kind", F.col("unit_id").alias("block_id"), "document_id", "text")
    lines = line_keys(several, "unit_kind").join(sites, "document_id").join(excessive, ["site", "k1", "k2"], "left_semi")
    of_text = lines.groupBy("unit_kind", F.col("block_id").alias("unit_id")).agg(F.collect_set("line_no").alias("notices"))
    return texts.join(of_text, ["unit_kind", "unit_id"], "left")


def both_kinds(documents: DataFrame, blocks: DataFrame) -> DataFrame:
    """(unit_kind, unit_id, document_id, text) of documents and blocks."""
    return documents.select(F.lit("document").alias("unit_kind"), F.col("id").alias("unit_id"), F.col("id").alias("document_id"), F.col("content").alias("text")).unionByName(
        blocks.select(F.lit("block").alias("unit_kind"), F.col("block_id").alias("unit_id"), "document_id", "text")
    )
