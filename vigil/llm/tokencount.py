"""Token counts with overlap resynchronisation for huge documents.

A long text is encoded in overlapping chunks with offsets. Two chunks are spliced where a token
boundary is proven stable: after ASCII white space and before an ASCII letter or digit, no token,
normalisation or pre-token of the vocabulary spans the place. The tokens between the first and the last
such place of the overlap must agree in id and offset, else the overlap is widened.

This holds for vocabularies that cut at white space and drop it, which is read from the file
(`cuts_at_space`). Texts of any other vocabulary are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import own_memory

CHUNK_CHARS, OVERLAP_CHARS = 65_536, 1024
#: Pieces of text whose counts a task remembers.
MEMO = 1_000_000
PIECES = re.compile(r"[^ \t\n\r]+")
STABLE = re.compile(r"(?<=[ \t\n\r])[A-Za-z0-9]")


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The tokenizer in `path`, loaded once in each Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


#: Parts of a tokenizer that change characters one by one or with those that combine with them, or white space to white space.
LOCAL_NORMALISERS = frozenset(["NFC", "NFD", "NFKC", "NFKD", "Lowercase"])


@lru_cache(maxsize=4)
def cuts_at_space(path: str) -> bool:
    """Whether the vocabulary in `path` never joins what white space parts: normalised character by character, cut by a pattern that leaves white space out, joined by byte pairs."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)

    def flat(part: dict | None, key: str) -> list[dict]:
        return [] if part is None else [y for x in part[key] for y in flat(x, key)] if part["type"] == "Sequence" else [part]

    for n in flat(made.get("normalizer"), "normalizers"):
        spaces = n["type"] == "Replace" and n["pattern"].get("Regex") == r"\s+" and n["content"] == " "
        if n["type"] not in LOCAL_NORMALISERS and not spaces:
            return False
    cuts = flat(made.get("pre_tokenizer"), "pretokenizers")
    drops = any(p["type"] in ("WhitespaceSplit", "Whitespace", "BertPreTokenizer") or p["type"] == "Split" and p.get("invert") and p["behavior"] == "Removed" and _spaceless(p["pattern"].get("Regex", "")) for p in cuts)
    added = [t["content"] for t in made.get("added_tokens", [])]
    return made["model"]["type"] == "BPE" and drops and not any(re.search(r"\s", t) for t in added)


def _spaceless(pattern: str) -> bool:
    """Whether no match of the pattern has white space in it, by its parts: literals, classes of letters, digits and what is neither."""
    rest = re.sub(r"\[\^[^\]]*\\s[^\]]*\]|\[(?:\\p\{[LN]\}|\\p[LN])+\]", "", pattern)
    return not re.search(r"\s|\\s|\.|\\[SDWP]|\[\^", rest)


@lru_cache(maxsize=4)
def remembered(path: str) -> dict[str, int]:
    """The counts of pieces that this Python worker has encoded, over all its tasks."""
    return {}


def _tokens(tok, text: str, at: int) -> list[tuple[int, int, int]]:
    e = tok.encode(text, add_special_tokens=False)
    return [(i, a + at, b + at) for i, (a, b) in zip(e.ids, e.offsets, strict=True)]


def encode_long(tok, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[tuple[int, int, int]]:
    """`(id, start, end)` of every token, equal to what encoding the whole text gives."""
    out: list[tuple[int, int, int]] = []
    start, n, begin = 0, len(text), 0  # `begin`: tokens before it are in `out`
    size, left = chunk, None
    while True:
        end = min(n, start + size)
        left = left or _tokens(tok, text[start:end], start)
        if end == n:
            return out + [t for t in left if t[1] >= begin]
        wide, joined = min(overlap, size // 2), False
        while wide < size:
            at = end - wide
            places = [m.start() for m in STABLE.finditer(text, at + 1, end)]
            if len(places) > 1 and places[-1] > begin:
                right_end = min(n, at + size)
                right = _tokens(tok, text[at:right_end], at)
                p, q = places[0], places[-1]
                if [t for t in left if p <= t[1] < q] == [t for t in right if p <= t[1] < q]:
                    out += [t for t in left if begin <= t[1] < q]
                    start, begin, left, joined = at, q, right, True
                    break
            wide *= 2
        if joined:
            size = chunk
        else:
            size, left = size * 2, None  # no stable place in this chunk: take a longer one


def count_short(tok, text: str, known: dict[str, int]) -> int:
    """The tokens of a text as the sum over its pieces between ASCII white space, which are stable boundaries.

    `known` keeps the counts of pieces already encoded; it is emptied when it holds MEMO pieces.
    """
    pieces = PIECES.findall(text)
    new = list({p for p in pieces if p not in known})
    if new:
        if len(known) + len(new) > MEMO:
            known.clear()
            new = list(set(pieces))
        starts = list(accumulate((len(p) + 1 for p in new), initial=0))
        known.update(dict.fromkeys(new, 0))
        owners = [bisect_right(starts, a) - 1 for a, _ in tok.encode(" ".join(new), add_special_tokens=False).offsets]
        known.update((new[i], n) for i, n in Counter(owners).items())
    return sum(map(known.__getitem__, pieces))


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """`doc_id`, `n_bytes`, `n_tokens` of every row; null text counts as empty.

    Texts of up to `chunk` characters are counted by `count_short`, longer ones by `encode_long`. Rows are
    independent, so repeated rows, ties and null ids need no care; an empty table gives an empty result.
    """

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own_memory("tokencount")
        tok, known = tokenizer(path), remembered(path)
        if not cuts_at_space(path):
            for texts in batches:
                yield pd.Series([len(tok.encode(t, add_special_tokens=False)) for t in texts], dtype="int64")
            return
        for texts in batches:
            yield pd.Series([len(encode_long(tok, t, chunk, overlap)) if len(t) > chunk else count_short(tok, t, known) for t in texts], dtype="int64")

    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), tokens(text).alias("n_tokens"))
