"""Problem 7: token ids of a whole corpus by a public byte-level BPE, each shared chunk encoded once.

Texts are cut at content-defined points: where a gear hash over the last `WINDOW` bytes has its low bits zero. Equal passages
of different documents are thus cut alike, and chunks with one hash are encoded once. A cut between a character that is no
white space and a line feed is a border of the tokenizer's pre-tokens in every context, so such joins are exact as they
are. Long stretches without such a place are cut anywhere; there the join is repaired: the text between the last border
of the left side and the first of the right side (a border being any place where white space follows something else) is
decoded, encoded again and put in the place of the old ids; both sides agree with the whole text's encoding outside it.

Null and empty texts have the empty list. No special tokens, whatever a text spells. Ids are below 65,536 and travel as two
bytes. A chunk that a third of all documents share is one row of the encoded side; its references are skewed, which
adaptive execution splits. Repeated rows of one doc_id must agree (they count once). Rows with a null doc_id are left out.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = os.environ.get("DOCWRIGHT_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the pre-token pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WINDOW, SAFE_BITS, ANY_BITS, SEED = 16, 4, 13, 3
GEAR = np.random.default_rng(SEED).integers(0, 2**32, 256, np.uint32)


MADE: dict = {}


def encoder(path: str):
    """The encoding and its words' sizes in bytes, made once in a worker, from the copy of the vocabulary that was sent along (`token_ids`)."""
    import tiktoken
    from pyspark import SparkFiles

    if path in MADE:
        return MADE[path]
    sent = SparkFiles.get(os.path.basename(path))
    with open(sent if os.path.exists(sent) else path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    made = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for word, rank in ranks.items():
        sizes[rank] = len(word)
    MADE[path] = made, sizes
    return MADE[path]


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte the gear hash of the WINDOW bytes that end there (fewer at the start), by doubling."""
    h = GEAR[data]
    k = 1
    while k < WINDOW:
        h[k:] = h[k:] + (h[:-k] << np.uint32(k)) if len(h) > k else h[k:]
        k *= 2
    return h


def cut_points(data: bytes) -> list[tuple[int, bool]]:
    """(byte position, safe) of the inner cuts of a text."""
    b = np.frombuffer(data, np.uint8)
    h = gear_hashes(b)[:-1]
    solid = (b[:-1] > 32) & (b[:-1] < 127)
    safe = solid & (b[1:] == 10) & (h & np.uint32((1 << SAFE_BITS) - 1) == 0)
    loose = ((b[1:] & 0xC0) != 0x80) & (h & np.uint32((1 << ANY_BITS) - 1) == 0)
    at = np.flatnonzero(safe | loose)
    return list(zip((at + 1).tolist(), safe[at].tolist()))


def chunks(text: str | None) -> list[tuple[bytes, bool]]:
    """(chunk, whether the join before it is safe)."""
    data = (text or "").encode("utf-8", "replace")
    if len(data) < 2:
        return [(data, True)]
    cuts = [(0, True), *cut_points(data)]
    ends = [c for c, _ in cuts[1:]] + [len(data)]
    return [(data[s:e], safe) for (s, safe), e in zip(cuts, ends)]


def border(text: str, first: bool) -> int:
    """The first (or last but four characters) place where white space follows something else; -1 if there is none."""
    places = range(1, len(text)) if first else range(len(text) - 4, 0, -1)
    return next((i for i in places if text[i] in " \t\n\r" and not text[i - 1].isspace()), -1)


def join(parts: list[np.ndarray], safe: list[bool], path: str) -> np.ndarray:
    """The ids of the whole text from the ids of its chunks."""
    if all(safe[1:]):
        return np.concatenate(parts) if len(parts) > 1 else parts[0]
    made, sizes = encoder(path)
    done: list[np.ndarray] = []
    left = parts[0]
    for part, exact in zip(parts[1:], safe[1:]):
        if exact:
            done.append(left)
            left = part
            continue
        words = made.decode_bytes(left.tolist()).decode("utf-8")
        more = made.decode_bytes(part.tolist()).decode("utf-8")
        a, b = border(words, False), border(more, True)
        a = max(a, 0)
        b = len(more) if b < 0 else b
        i = int(np.searchsorted(np.cumsum(sizes[left]), len(words[:a].encode()), "right")) if a else 0
        j = int(np.searchsorted(np.cumsum(sizes[part]), len(more[:b].encode()))) + 1 if b else 0
        left = np.concatenate([left[:i], np.array(made.encode_ordinary(words[a:] + more[:b]), np.uint16), part[j:]])
    return np.concatenate([*done, left])


def token_ids(documents: DataFrame, directory: str = TOKENIZERS) -> DataFrame:
    """(doc_id, ids array<int>), one row for each doc_id."""
    path = os.path.join(directory, VOCABULARY)
    documents.sparkSession.sparkContext.addFile(path)  # executors need no folder of tokenizers

    def cut(batches: Iterator[pd.DataFrame], whole: bool) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, t in zip(b["doc_id"].tolist(), b["text"].tolist()):
                for seq, (chunk, safe) in enumerate(chunks(t)):
                    h = xxhash.xxh3_128_digest(chunk)
                    rows.append((h, chunk) if whole else (d, seq, safe, h))
            if whole:
                yield pd.DataFrame(rows, columns=["h", "chunk"]).drop_duplicates("h")
            else:
                yield pd.DataFrame(rows, columns=["doc_id", "seq", "safe", "h"])

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made, _ = encoder(path)
        for b in batches:
            yield pd.DataFrame({"h": b["h"], "part": [np.array(made.encode_ordinary(c.decode("utf-8")), np.uint16).tobytes() for c in b["chunk"]]})

    def assemble(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for rows in b["parts"]:
                rows = sorted(rows, key=lambda r: r["seq"])
                out.append(join([np.frombuffer(r["part"], np.uint16) for r in rows], [r["safe"] for r in rows], path).astype(np.int32))
            yield pd.DataFrame({"doc_id": b["doc_id"], "ids": out})

    texts = documents.where("doc_id is not null").select("doc_id", "text")
    encoded = (
        texts.mapInPandas(lambda x: cut(x, True), "h binary, chunk binary")
        .groupBy("h").agg(F.first("chunk").alias("chunk"))
        .mapInPandas(encode, "h binary, part binary")
    )
    named = texts.mapInPandas(lambda x: cut(x, False), "doc_id long, seq int, safe boolean, h binary")
    parts = named.join(encoded, "h").groupBy("doc_id").agg(F.collect_set(F.struct("seq", "safe", "part")).alias("parts"))
    return parts.mapInPandas(assemble, "doc_id long, ids array<int>")
