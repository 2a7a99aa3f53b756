"""Problem 9: texts cut off by field limits or in mid-transfer.

Every text that is cut has at least one proof:

* `spike`: for every source the histograms of lengths in characters and in bytes (of distinct texts) are tested for a spike at the
  maximum, against the density of lengths just below it. A limit in bytes shows within three bytes of it, as a cut inside a character
  loses the rest of it. A text at its source's spike is cut unless it ends with terminal punctuation; dots of an ellipsis are none.
* `structure`: what git writes announces what is to come. A hunk with fewer lines than its head says, a file head without its change, a binary patch
  without its last block, an unfinished trailer or a header alone are cut. A message of several paragraphs under a header ends with
  punctuation. Where at least `FRAMED` of the texts without a header have a frame, a line of one of a few shapes that often close a message and
  stand at its end or its start (learned from all texts; a shape is a line without its letters and digits), one without a frame is cut.
* `word`: the text ends in a word that as a whole word is next to unknown in the corpus, measured against the longer words that it begins
  (`RATE`), so the test does not weaken as the corpus grows.

Plain texts without a known structure have only the spike and the word as proofs. Null, empty and blank texts are no case; nor is a
missing last line feed. A null source is a source of its own. Repeated rows of one doc_id count once. Texts are read whole. Empty
tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

#: A spike has at least so many distinct texts, and so many times what the lengths below it let expect.
SPIKE, TIMES = 5, 8.0
#: How far below the maximum the spike is looked for, as a mark for half a character can stand a little beyond the limit.
NEAR = 8
#: A frame's shape closes this share of the messages without a header; this share of them must have a frame.
SHAPE_SHARE, FRAMED = 0.05, 0.8
#: A last word is cut off if the longer words that it begins are so many times as frequent.
RATE = 500
#: git's formats.
HUNK = re.compile(r"^@@ -\d+(?:,(\d+))? \+\d+(?:,(\d+))? @@", re.M)
LAST_BLOCK = "HcmV?d00001"
HEAD = re.compile(r"(?:commit |From |Author:|Date:|From:|Subject:)")
TRAILER = re.compile(r"[A-Z][a-z]+(?:-[a-z]+)*-by\b")
CONFLICT = re.compile(r"#\s+\S+\.\w+$")
BINARY = re.compile(r"\nGIT binary patch\n.*?(?=\ndiff --git |\Z)", re.S)
TERMINAL, CLOSERS = ".!?。！？｡।॥؟", "\"'”’»)]」』"
#: Letters of scripts that part words with spaces: Latin, Greek, Cyrillic, Armenian, Hebrew, Arabic, Devanagari.
_L = "A-Za-zÀ-ɏͰ-ϿЀ-ӿԱ-֏א-ת؀-ۿऀ-ॿ"
LETTERS = re.compile(rf"(?<![\d{_L}])[{_L}]+(?!\d)")
LAST_WORD = re.compile(rf"(?<![\d{_L}])[{_L}]+\Z")
#: The word that ends a text, with the dots a cut may have left; it proves nothing about itself.
INNER = re.compile(rf"[{_L}]*\.{{0,3}}\Z")
WHOLE, CUT, WORD = 0, 1, 2


def terminal(text: str) -> bool:
    """Whether a text ends with terminal punctuation, closed quotations and brackets aside."""
    bare = text.rstrip().rstrip(CLOSERS)
    return bare[-1:] in TERMINAL and bool(bare) and not bare.endswith("...")


def shape(line: str) -> str:
    """A line with its words (brackets and hyphens in them included) and numbers made one letter and one digit each."""
    return re.sub(r"[^\W\d_][\w\[\]'’-]*(?: [^\W\d_][\w\[\]'’-]*)*", "a", re.sub(r"\d+", "9", line.strip()))


def hunk_rest(section: str) -> int | None:
    """Lines that the last hunk of a file's section still lacks; None without a hunk."""
    last = None
    for last in HUNK.finditer(section):  # noqa: B007
        pass
    if last is None:
        return None
    old, new = (int(x) if x else 1 for x in last.groups())
    lines = section[last.end() :].split("\n")[1:]
    for line in lines:
        if old <= 0 and new <= 0:
            break
        if line[:1] == "+":
            new -= 1
        elif line[:1] == "-":
            old -= 1
        elif line[:1] != "\\":
            old, new = old - 1, new - 1
    if section.endswith("\n") and lines and (old < 0 or new < 0):
        return 0
    return max(0, old, new)


def unfinished_line(line: str) -> bool:
    """A code line that stops inside a string or a bracket pair."""
    body = line[1:].strip()
    if body.endswith(("(", "{", "[", ",")) and not body.endswith("{"):
        return True
    return body.count("(") > body.count(")") or body.count("[") > body.count("]") or body.count('"') % 2 == 1 or body.count("`") % 2 == 1


def ending(text: str) -> tuple[int, str, str | None, str | None, bool, bool]:
    """(verdict, last word, shapes of the lines that open and close the message, whether nothing follows it, whether it is cut if its first line is a frame).

    Shapes only of texts without a header, '' for a closing sentence.
    """
    bare = text.rstrip()
    closed = text.endswith("\n")
    word = LAST_WORD.search(text)
    doubt = (WHOLE, "") if closed or not word else (WORD, word[0])
    at = 0 if text.startswith("diff --git") else text.rfind("\ndiff --git")
    start = 0 if text.startswith("diff --git") else text.find("\ndiff --git")
    message = (text[:start] if start >= 0 else text).strip()
    headed = bool(HEAD.match(message)) or not message
    last = message.rsplit("\n", 1)[-1].strip()
    opening, closing = (None, None) if headed else (shape(message.split("\n", 1)[0]), "" if terminal(message) else shape(last))
    if at >= 0:
        return *changes(text[at:].lstrip("\n"), closed, doubt), opening, closing, False, False
    verdict, word = message_end(message, last, headed, closed, doubt)
    framed = not headed and message_end("From\n\n" + message.split("\n", 1)[-1], last, True, closed, doubt)[0] == CUT
    return verdict, word, opening, closing, True, framed


def changes(section: str, closed: bool, doubt: tuple[int, str]) -> tuple[int, str]:
    """The verdict on the last file's section of a diff."""
    lines = section.rstrip().split("\n")
    last = lines[-1].strip()
    if "\nGIT binary patch" in section:
        return (WHOLE if lines[-1].endswith(LAST_BLOCK) else CUT), ""
    if last.startswith("@") and not HUNK.match(last):
        return CUT, ""
    rest = hunk_rest(section)
    if rest is not None:
        if rest > 0:
            return CUT, ""
        if last.startswith("\\"):
            return (WHOLE if last == "\\ No newline at end of file" else CUT), ""
        return (WHOLE, "") if closed else (CUT, "") if unfinished_line(lines[-1]) else doubt
    if "\nBinary files" in section:
        return (WHOLE if last.endswith("differ") else CUT), ""
    only_mode = re.search(r"^(?:old mode|new mode|rename to|deleted file mode|new file mode)", section, re.M)
    return doubt if only_mode and not re.search(r"^(?:index|---|\+\+\+|@@)", section, re.M) else (CUT, "")


def message_end(message: str, last: str, headed: bool, closed: bool, doubt: tuple[int, str]) -> tuple[int, str]:
    """The verdict on a text that ends with its message."""
    parts = [p for p in re.split(r"\n\s*\n", message.replace("\r\n", "\n")) if p.strip()]
    body = parts if not headed or "Subject:" in parts[0] else parts[1:]
    if not body or last == "---":
        return CUT, ""
    if last.startswith("#"):
        return (CUT, "") if not CONFLICT.match(last) and not closed else doubt
    if last.startswith("Merge ") and last.count("'") % 2:
        return CUT, ""
    if TRAILER.match(last):
        return (WHOLE if last.endswith(">") else CUT), ""
    if closed or terminal(message) or message.endswith(("...", "…")):
        return WHOLE, ""
    return (CUT, "") if headed and len(body) > 1 else doubt


def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import xxhash

    key = lambda raw: xxhash.xxh3_64_intdigest(raw) >> 1
    for b in batches:
        rows = []
        for d, s, t in zip(b["doc_id"].tolist(), b["source"].tolist(), b["text"].tolist()):
            if t.strip():
                raw = t.encode("utf-8", "surrogatepass")
                verdict, word, *lines, alone, framed = ending(t)
                keys = [None if x is None else key(x.encode("utf-8", "surrogatepass")) if x else 0 for x in lines]
                rows.append((d, s, len(t), len(raw), verdict, word, *keys, alone, framed, terminal(t), key(raw)))
        out = pd.DataFrame(rows, columns=["doc_id", "source", "chars", "bytes", "verdict", "word", "opening", "closing", "alone", "framed", "terminal", "same"])
        yield out.astype({"opening": "Int64", "closing": "Int64"})


def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(word, docs) of each batch: whole words inside the texts; binary patches have none."""
    for b in batches:
        seen: Counter[str] = Counter()
        for t in b["text"]:
            seen.update(set(LETTERS.findall(INNER.sub("", BINARY.sub("", t) if "\nGIT binary patch\n" in t else t))))
        yield pd.DataFrame({"word": list(seen), "docs": list(seen.values())})


def limits(facts: DataFrame) -> DataFrame:
    """(source, unit, top, slack): sources with a spike at their greatest length, in the unit in which it is higher."""
    distinct = facts.select(F.coalesce("source", F.lit("")).alias("source"), "same", F.explode(F.map_from_arrays(F.array(F.lit("chars"), F.lit("bytes")), F.array("chars", "bytes"))).alias("unit", "n")).distinct()
    counted = distinct.groupBy("source", "unit", "n").agg(F.count("*").alias("k"))
    tops = counted.groupBy("source", "unit").agg(F.max("n").alias("most"))
    joined = counted.join(tops, ["source", "unit"])
    peaks = joined.where(F.col("n") >= F.col("most") - NEAR).groupBy("source", "unit").agg(F.max(F.struct("k", "n")).alias("peak")).select("source", "unit", F.col("peak.n").alias("top"), F.col("peak.k").alias("height"))
    at = counted.join(peaks, ["source", "unit"]).withColumn("slack", F.when(F.col("unit") == "bytes", 3).otherwise(0))
    here = F.sum(F.when(F.col("n") >= F.col("top") - F.col("slack"), F.col("k")).otherwise(0)).alias("here")
    near = F.sum(F.when((F.col("n") < F.col("top") - F.col("slack")) & (F.col("n") >= F.col("top") * 0.9), F.col("k")).otherwise(0)).alias("near")
    tested = at.groupBy("source", "unit", "top", "height", "slack").agg(here, near)
    chance = F.col("near") * (F.col("slack") + 1) / (F.col("top") * 0.1)
    passed = tested.where((F.col("here") >= SPIKE) & (F.col("here") >= chance * TIMES))
    best = passed.groupBy("source").agg(F.max(F.struct("height", "unit", "top", "slack")).alias("best"))  # a field's limit has one unit
    return best.select("source", "best.unit", "best.top", "best.slack")


def frames(facts: DataFrame) -> list[int]:
    """Shapes of framing lines; none unless FRAMED of the texts without a header have one. At most 1 / SHAPE_SHARE of them."""
    own = facts.where("closing is not null").select("same", "opening", "closing").distinct()
    total = own.count()
    often = [r["closing"] for r in own.where("closing <> 0").groupBy("closing").agg(F.count("*").alias("n")).where(F.col("n") >= max(1, total * SHAPE_SHARE)).collect()]
    marked = own.where(F.col("opening").isin(often) | F.col("closing").isin(often)).count()
    return often if marked >= max(1, total * FRAMED) else []


def cut_words(texts: DataFrame, facts: DataFrame) -> DataFrame:
    """(word): last words that are the beginnings of other words rather than words."""
    last = facts.where(F.col("verdict") == WORD).select("word").distinct()
    known = cut_lineage(texts.select("text").mapInPandas(words, "word string, docs long").groupBy("word").agg(F.sum("docs").alias("docs")))
    starts = known.where("length(word) > 1").select(F.explode(F.expr("transform(sequence(1, length(word) - 1), n -> left(word, n))")).alias("word"), "docs")
    longer = starts.groupBy("word").agg(F.sum("docs").alias("longer"))
    both = last.join(known, "word", "left").join(longer, "word", "left")
    return both.where(F.coalesce("docs", F.lit(0)) * RATE <= F.coalesce("longer", F.lit(0))).select("word")


def judged(documents: DataFrame) -> DataFrame:
    """(doc_id, source, spike, structure, word) of every text that is not blank: the proofs that it is cut."""
    texts = documents.where("doc_id is not null and text is not null").select("doc_id", "source", "text")
    facts = cut_lineage(texts.mapInPandas(features, "doc_id long, source string, chars int, bytes int, verdict int, word string, opening long, closing long, alone boolean, framed boolean, terminal boolean, same long"))
    limit, frame = limits(facts), frames(facts)
    of = lambda unit: limit.where(F.col("unit") == unit).select(F.col("source").alias("key"), (F.col("top") - F.col("slack")).alias(f"{unit}_limit"))
    rows = facts.withColumn("key", F.coalesce("source", F.lit(""))).join(of("chars"), "key", "left").join(of("bytes"), "key", "left")
    rows = rows.join(cut_words(texts, facts).withColumn("rare", F.lit(True)), "word", "left")
    at_limit = F.coalesce(F.col("chars") >= F.col("chars_limit"), F.lit(False)) | F.coalesce(F.col("bytes") >= F.col("bytes_limit"), F.lit(False))
    opened, closed = (F.coalesce(F.col(c).isin(frame), F.lit(False)) for c in ("opening", "closing"))
    unframed = F.lit(bool(frame)) & F.col("alone") & F.col("closing").isNotNull() & ~opened & ~closed
    by_word = (F.col("verdict") == WORD) & F.coalesce("rare", F.lit(False))
    return rows.select("doc_id", "source", (at_limit & ~F.col("terminal")).alias("spike"), ((F.col("verdict") == CUT) | unframed | (opened & ~closed & F.col("framed"))).alias("structure"), by_word.alias("word")).distinct()


def proofs(documents: DataFrame) -> DataFrame:
    """(doc_id, spike, structure, word) of every cut text."""
    return judged(documents).where("spike or structure or word").select("doc_id", "spike", "structure", "word").distinct()


def truncated(documents: DataFrame) -> DataFrame:
    return proofs(documents).select("doc_id").distinct()


def rates(documents: DataFrame) -> DataFrame:
    """(source, texts, cut, rate) of each source."""
    cut = F.col("spike") | F.col("structure") | F.col("word")
    return judged(documents).groupBy("source").agg(F.count("*").alias("texts"), F.sum(cut.cast("long")).alias("cut"), F.round(F.avg(cut.cast("double")), 6).alias("rate"))
