"""Alignment of the tokens that two vocabularies give for the same text.

A byte-level vocabulary (A) encodes space and text, a piece vocabulary (B) the text, before which it puts its word
mark. Byte offsets where tokens of both end cut them into groups; an A and a B token whose byte ranges overlap are a
link. A merge of the cumulative ends of both finds them: each stretch between neighbouring ends belongs to one
token of either side, hence is one link, and an end that both have closes a group.

Both vocabularies end a token before a single space between other characters, A by its pattern, B because no piece
has a word mark after another character (`Pair` reads that from the model, and takes whole texts if it
does not hold). So texts are merged unit by unit, and a worker remembers the units that it has merged.

Counts: the links of a block of documents leave Python as one row an id pair, with the documents that hold
it; Spark adds these up, joins the counts and the maxima of either side back to them, and sums by document.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .shared import discard, own_memory, skew_join, stored

#: Documents of a block have about so many characters together, or are one; and there are no more than so many.
BLOCK_CHARS, BLOCK_DOCS = 2_000_000, 4096
#: Units, and characters in them, that a Python worker remembers.
MEMO, MEMO_CHARS = 400_000, 40_000_000
#: Units that are encoded together.
AT_ONCE = 20_000
#: A single space between characters that are no white space for either vocabulary.
CUT = re.compile(r"(?<=[^\s\u180e]) (?=[^\s\u180e])")
SCHEMA = "block long, no int, doc_id string, n_a long, n_b long, n_groups long, n_links long, groups string, a int, b int, held array<long>"


def byte_letters() -> dict[str, int]:
    """The character that stands for each byte in the entries of a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, … of so many elements each, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def merged(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The merge of two rising lists of token ends that close together: for each link the A and the B token, and whether it closes a group."""
    ends = np.union1d(ends_a, ends_b)
    a, b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    return a, b, (ends_a[a] == ends) & (ends_b[b] == ends)


def flat(tokens: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of all units, one after the other, and how many each has."""
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    return np.fromiter(chain.from_iterable(tokens), np.int64, sizes.sum()), sizes


class Pair:
    """Two vocabularies, and the units that were merged under both."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = byte_letters()
        self.bytes_a = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.n_b, n_a = len(pieces), max(self.bytes_a) + 1
        self.sizes_a = np.array([len(self.bytes_a.get(i, b"")) for i in range(n_a)])
        self.sizes_b = np.array([len(x) for x in self.bytes_b])
        self.first_b = 2 * n_a
        self.written = [f"{i}{end}" for i in range(n_a) for end in ",|"] + [f"{i}{end}" for i in range(self.n_b) for end in ",;"]
        self.widths = np.array([len(x) for x in self.written])
        self.split = CUT.split if not any(re.search("[^▁]▁", p) for p in pieces) else lambda text: [text]
        self.clear()

    def clear(self) -> None:
        """Forgets all units."""
        self.known: dict[str, int] = {}
        self.chars = 0
        self.shown: list[str] = []  # groups of each unit, each with a semicolon
        self.sizes = np.zeros((0, 5), np.int64)  # of each unit: A tokens, B tokens, groups, links, whether both give its bytes back
        self.starts, self.links = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, units: list[str]) -> None:
        """Merges units that are new."""
        for i in range(0, len(units), AT_ONCE):
            self._learn(units[i : i + AT_ONCE])

    def _learn(self, units: list[str]) -> None:
        told = [b" " + u.encode() for u in units]
        tokens_a = [e.ids for e in self.a.encode_batch_fast([" " + u for u in units], add_special_tokens=False)]
        tokens_b = self.b.encode(units, num_threads=1)
        (ids_a, n_a), (ids_b, n_b) = flat(tokens_a), flat(tokens_b)
        # all bytes in one go: if they are the units' and each token list is as long as its unit, all fit
        sizes = np.cumsum([len(x) for x in told])
        as_told, good = b"".join(told), np.ones(len(units), bool)
        for ids, n, spelled, of in ((ids_a, n_a, self.bytes_a, self.sizes_a), (ids_b, n_b, self.bytes_b, self.sizes_b)):
            ends = np.concatenate([[0], np.cumsum(of[ids])])[np.cumsum(n)]
            if not np.array_equal(ends, sizes) or b"".join(map(spelled.__getitem__, ids.tolist())) != as_told:
                tokens = tokens_a if ids is ids_a else tokens_b
                good &= [b"".join(map(spelled.__getitem__, x)) == y for x, y in zip(tokens, told, strict=True)]
        if not good.all():
            (ids_a, n_a), (ids_b, n_b) = (flat([x if g else [] for x, g in zip(t, good, strict=True)]) for t in (tokens_a, tokens_b))
        a, b, closes = merged(np.cumsum(self.sizes_a[ids_a]), np.cumsum(self.sizes_b[ids_b]))
        of_unit = np.repeat(np.arange(len(units)), n_a)[a]
        n_links = np.bincount(of_unit, minlength=len(units))
        n_groups = np.bincount(of_unit[closes], minlength=len(units))
        # written out: A tokens of a group each with a comma, the last with a bar, then its B tokens, the last with a semicolon
        ends_a, ends_b = a[closes] + 1, b[closes] + 1
        width_a, width_b = np.diff(ends_a, prepend=0), np.diff(ends_b, prepend=0)
        order = np.empty(len(ids_a) + len(ids_b), np.int64)
        order[np.arange(len(ids_a)) + np.repeat(ends_b - width_b, width_a)] = 2 * ids_a + np.isin(np.arange(len(ids_a)), ends_a - 1)
        order[np.arange(len(ids_b)) + np.repeat(ends_a, width_b)] = self.first_b + 2 * ids_b + np.isin(np.arange(len(ids_b)), ends_b - 1)
        text = "".join(map(self.written.__getitem__, order.tolist()))
        upto = np.concatenate([[0], np.cumsum(self.widths[order])])[np.concatenate([[0], np.cumsum(n_a + n_b)])].tolist()
        self.shown.extend(text[i:j] for i, j in zip(upto, upto[1:], strict=False))
        first = len(self.known)
        self.known.update(zip(units, range(first, first + len(units)), strict=True))
        self.chars += sum(map(len, units))
        self.starts = np.concatenate([self.starts, len(self.links) + np.cumsum(n_links) - n_links])
        self.links = np.concatenate([self.links, ids_a[a] * self.n_b + ids_b[b]])
        self.sizes = np.concatenate([self.sizes, np.column_stack([n_a, n_b, n_groups, n_links, good])])

    def block(self, texts: list[str]) -> tuple[list[tuple], tuple[np.ndarray, list[list[int]]]]:
        """Of each text the numbers of A tokens, B tokens, groups and links, and the groups written out; and of the block each linked id pair (a * n_b + b) with the texts that hold it, as `no << 32 | links`."""
        split = [self.split(t) if t else [] for t in texts]
        new = set().union(*split).difference(self.known)
        if len(self.known) + len(new) > MEMO or self.chars + sum(map(len, new)) > MEMO_CHARS:
            self.clear()
            new = set().union(*split)
        if new:
            self.learn(list(new))
        told, keys = [], []
        for no, units in enumerate(split):
            at = list(map(self.known.__getitem__, units))
            if at and self.sizes[at, 4].all():
                told.append((*self.sizes[at, :4].sum(axis=0).tolist(), "".join(map(self.shown.__getitem__, at))[:-1]))
                keys.append(np.array(at, np.int64) | no << 32)
            else:
                told.append((0, 0, 0, 0, ""))
        key, times = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, np.int64),) * 2
        unit, no = key & 0xFFFFFFFF, key >> 32
        sizes = self.sizes[unit, 3]
        pair = self.links[ragged(self.starts[unit], sizes)]
        # one row a pair and text: sorted by pair, then text
        no, times = np.repeat(no, sizes), np.repeat(times, sizes)
        order = np.argsort(pair * BLOCK_DOCS + no)
        pair, no, times = pair[order], no[order], times[order]
        fresh = np.flatnonzero(np.diff(pair, prepend=-1) | np.diff(no, prepend=-1))
        held = no[fresh] << 32 | np.add.reduceat(times, fresh) if len(fresh) else fresh
        pair = pair[fresh]
        cuts = np.flatnonzero(np.diff(pair, prepend=-1))
        flat, ends = held.tolist(), [*cuts[1:].tolist(), len(pair)]
        return told, (pair[cuts], [flat[i:j] for i, j in zip(cuts.tolist(), ends, strict=len(cuts) > 0)] if len(cuts) else [])


@lru_cache(maxsize=2)
def pair_of(path_a: str, path_b: str) -> Pair:
    """One for each Python worker, kept over its tasks."""
    return Pair(path_a, path_b)


def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list, list[str]]]:
    """The ids and texts of the rows in blocks of BLOCK_CHARS and BLOCK_DOCS."""
    ids, texts, room = [], [], 0
    for rows in batches:
        for i, t in zip(rows["doc_id"], rows["t"], strict=True):
            if texts and (room + len(t) > BLOCK_CHARS or len(texts) == BLOCK_DOCS):
                yield ids, texts
                ids, texts, room = [], [], 0
            ids.append(i)
            texts.append(t)
            room += len(t)
    if texts:
        yield ids, texts


def links(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", write_groups: bool = False) -> DataFrame:
    """The groups and links of every row, by block: rows of documents (`a` is null), and rows of linked id pairs (`no` is null) with the documents that hold them.

    `groups` is the text of the groups with `write_groups`, else its SHA-256.
    """

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own_memory("alignment")
        pair = pair_of(path_a, path_b)
        task = TaskContext.get().partitionId()
        for k, (ids, texts) in enumerate(blocks(batches)):
            block = task << 32 | k
            told, (pairs, held) = pair.block(texts)
            n_a, n_b, n_groups, n_links, shown = zip(*told, strict=True)
            if not write_groups:
                shown = [sha256(x.encode()).hexdigest() if x else "" for x in shown]
            yield pd.DataFrame({"block": block, "no": np.arange(len(ids), dtype=np.int32), "doc_id": pd.Series(ids, dtype=object), "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups": shown, "a": None, "b": None, "held": None})
            if len(pairs):
                none = dict.fromkeys(("no", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"))
                yield pd.DataFrame({"block": block, **none, "a": (pairs // pair.n_b).astype(np.int32), "b": (pairs % pair.n_b).astype(np.int32), "held": pd.Series(held, dtype=object)})

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    out = rows.mapInPandas(found, SCHEMA)
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def pair_counts(found: DataFrame) -> DataFrame:
    """`a`, `b`, `n` (documents that hold them linked), and the greatest n of a (`most_a`) and of b (`most_b`), of each id pair of `links`; stored."""
    pairs = stored(found.filter("a is not null").groupBy("a", "b").agg(F.sum(F.size("held")).alias("n")), "pairs")
    counts = pairs
    for side in ("a", "b"):
        counts = counts.join(pairs.groupBy(side).agg(F.max("n").alias(f"most_{side}")), side)
    counts = stored(counts.select("a", "b", "n", "most_a", "most_b"), "counts")
    discard(pairs)
    return counts


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", write_groups: bool = False) -> DataFrame:
    """`doc_id`, `n_a`, `n_b` (tokens), `n_groups`, `n_links`, `n_best` (links whose count is the highest of their A id), `n_best_b` (of their B id), `count_sum` (of the counts over all links) and `groups` of every row.

    A link's count is the number of rows that hold its id pair linked. `groups` is `a1,a2|b1;a3|b2,b3` (ids in order) with
    `write_groups`, else the SHA-256 of that. Null and empty texts, and those that a vocabulary does not
    give back byte by byte, have no tokens: zeros, and groups ''. Each repeated row counts and has a row; a null id
    stays null; other columns of `docs` play no part. An empty table gives an empty result.
    """
    found = stored(links(docs, path_a, path_b, id_col, text_col, write_groups), "links")
    counts = pair_counts(found)
    pairs = found.filter("a is not null").select("block", "a", "b", "held")
    total = counts.agg(F.sum("n")).first()[0] or 0
    # a pair has one row a block, with all its documents there: pairs of very many documents pass by broadcast
    scored = skew_join(pairs, counts, ["a", "b"], total).select("block", "held", "n", (F.col("n") == F.col("most_a")).alias("best"), (F.col("n") == F.col("most_b")).alias("best_b"))
    each = scored.repartition("block").select("block", F.explode("held").alias("h"), "n", "best", "best_b")
    times = F.col("h").bitwiseAND(F.lit(0xFFFFFFFF))
    sums = each.groupBy("block", F.shiftright("h", 32).cast("int").alias("no")).agg(
        F.sum(F.when(F.col("best"), times).otherwise(0)).alias("n_best"), F.sum(F.when(F.col("best_b"), times).otherwise(0)).alias("n_best_b"), F.sum(times * F.col("n")).alias("count_sum")
    )
    told = found.filter("no is not null").select("block", "no", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return told.join(sums, ["block", "no"], "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("n_best_b"), zero("count_sum"), "groups")
