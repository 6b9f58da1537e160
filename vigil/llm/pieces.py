"""SentencePiece encoding with sampled segmentations, and decoding.

The text's spaces become the word mark and one is put in front, as the model's library does. The lattice
of a unit (marks and the word or signs after them) has an edge for each piece that matches; no piece of
the model spans two units. Forward filtering sums the weights of all paths to each position, backward
sampling walks from the end, taking each incoming piece with its share of that sum. The random numbers
are hashed from seed, row key, unit and step, so a row is segmented alike wherever and whenever it is.

The model ranks its pieces; a piece of rank r has weight 1 / (r + 2) ** sharpness. A character without a
piece becomes its UTF-8 bytes, as does a literal word mark, so decoding gives back every text exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import own_memory

MARK = "▁"
SHARPNESS = 1.0
#: Units whose lattices a Python worker remembers.
MEMO = 200_000
#: Characters of new units whose lattices are made together.
AT_ONCE = 25_000
#: Texts are encoded and given out in blocks of about so many characters, so that a worker holds no more than one.
BLOCK = 400_000
UNIT = re.compile(r"\n| +[^ \n]*|[^ \n]+")
#: Shorter units for a model none of whose pieces joins a Latin letter to any other character but the mark before it.
LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
LETTER_UNIT = re.compile(rf"\n| *[{LETTER}]+| *[^{LETTER} \n]+| +")
#: Keeps forward sums near 1: it multiplies a piece's weight by this for each of its characters and cancels out.
PER_CHAR = 30.0


class Lattices:
    """The pieces of a model and the lattices of the units met so far."""

    def __init__(self, path: str, sharpness: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.weights: dict[str, tuple[int, float]] = {}
        self.byte_ids = [0] * 256
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
            elif not model.is_control(i) and not model.is_unknown(i):
                self.weights[piece.replace(MARK, " ")] = (i, (2.0 - model.get_score(i)) ** -sharpness * PER_CHAR ** len(piece))
        self.size = model.vocab_size()
        self.rare = self.size ** -sharpness * PER_CHAR
        spelled = list(self.weights)
        self.longest = max(map(len, spelled))
        joins = re.compile(rf"[{LETTER}][^{LETTER}]|[^{LETTER} ][{LETTER}]")
        self.split = (UNIT if any(map(joins.search, spelled)) else LETTER_UNIT).findall
        self.ids = np.array([self.weights[p][0] for p in spelled] + [0], np.int32)
        self.scale = np.array([self.weights[p][1] for p in spelled] + [0.0])
        self.index = pd.Index(np.array([self._hashes(_codes(p))[-1][-1] for p in spelled], np.uint64))
        sizes = np.array([*map(len, spelled), 0])
        self.first = np.cumsum(sizes) - sizes
        self.letters = np.append(_codes("".join(spelled)), np.zeros(1, np.uint64))
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}  # the number of a unit's lattice
        self.node = np.empty(0, np.int32)  # by lattice: its first position
        self.lengths = np.empty(0, np.int32)  # by lattice: the characters of its unit
        self.begins = np.zeros(1, np.int32)  # by position: its first incoming edge; one more at the end
        self.shares = np.empty(0, np.float32)  # by edge: the sum of shares of its position up to it
        self.pieces, self.spans = np.empty(0, np.int32), np.empty(0, np.int16)
        self.n_positions = self.n_edges = 0

    def _append(self, name: str, size: int, more: np.ndarray) -> None:
        """Writes `more` behind the first `size` of an array, which doubles when it is full."""
        held = getattr(self, name)
        if size + len(more) > len(held):
            held = np.empty(max(2 * len(held), size + len(more)), held.dtype)
            held[:size] = getattr(self, name)[:size]
            setattr(self, name, held)
        held[size : size + len(more)] = more

    def _hashes(self, codes: np.ndarray) -> list[np.ndarray]:
        """For each length: of every position, a hash of as many characters that end there (garbage before the start)."""
        out, total = [], np.zeros(len(codes), np.uint64)
        for k in range(min(len(codes), getattr(self, "longest", len(codes)))):
            total = total.copy()
            total[k:] += _mixed(codes[: len(codes) - k] + np.uint64((k + 1) << 32))
            out.append(total)
        return out

    def _same(self, found: np.ndarray, codes: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
        """`found` with -1 where the piece of the hash is not spelled as the k + 1 characters up to `ends`."""
        hit = np.flatnonzero(found >= 0)
        at, last = self.first[found[hit]], ends[hit]
        alike = np.ones(len(hit), bool)
        for i in range(k + 1):
            alike &= self.letters[np.minimum(at + i, len(self.letters) - 1)] == codes[last - k + i]
        found[hit[~alike]] = -1
        return found

    def _learn(self, units: list[str]) -> None:
        """Forward filtering: the lattices of new units, all at once, position by position."""
        lengths = np.array([len(u) for u in units])
        codes = _codes("".join(units))
        pos = np.arange(1, len(codes) + 1) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        width = self.longest
        pieces, weights = np.zeros((len(codes), width), np.int32), np.zeros((len(codes), width))
        for k, h in enumerate(self._hashes(codes)):
            inside = np.flatnonzero(pos > k)
            found = self._same(self.index.get_indexer(h[inside]), codes, inside, k)
            pieces[inside, k], weights[inside, k] = self.ids[found], self.scale[found]
        alone = weights[:, 0] == 0
        weights[alone, 0] = self.rare
        pieces[alone, 0] = [self.byte_ids[c] if c < 128 else self.size + c for c in codes[alone].tolist()]
        sums = np.ones(len(codes))
        order = np.argsort(pos, kind="stable")
        bounds = np.searchsorted(pos[order], np.arange(1, pos.max() + 2))
        for p, (i, j) in enumerate(zip(bounds, bounds[1:], strict=False), 1):
            at, reach = order[i:j], min(p, width)
            some = weights[at, :reach]
            for k in range(1, reach if p <= width else reach + 1):
                some[:, k - 1] *= sums[at - k]
            total = some.sum(axis=1)
            sums[at] = total
            weights[at, :reach] = some / total[:, None]
            if p % 32 == 0:
                for k in range(reach):
                    sums[at - k] /= total
        used = weights > 0
        n_units = len(self.known)
        self._append("shares", self.n_edges, np.cumsum(weights, axis=1)[used])
        self._append("pieces", self.n_edges, pieces[used])
        self._append("spans", self.n_edges, np.nonzero(used)[1] + 1)
        self._append("begins", self.n_positions + 1, self.n_edges + np.cumsum(used.sum(axis=1)))
        self._append("node", n_units, self.n_positions + np.cumsum(lengths) - lengths)
        self._append("lengths", n_units, lengths)
        self.n_positions += len(codes)
        self.n_edges += int(used.sum())
        self.known.update(zip(units, range(len(self.known), len(self.known) + len(units)), strict=True))

    def encode(self, texts: list[str], keys: list[int], seed: int) -> list[np.ndarray]:
        """The ids of each text; the key chooses its sample."""
        split = [self.split(" " + t) for t in texts]
        units = list(chain.from_iterable(split))
        new = list(set(units).difference(self.known))
        if new and len(self.known) + len(new) > MEMO:
            self._forget()
            new = list(set(units))
        at, room = 0, 0
        for i, u in enumerate(new):
            room += len(u)
            if room > AT_ONCE or i + 1 == len(new):
                self._learn(new[at : i + 1])
                at, room = i + 1, 0
        owners = np.array([len(x) for x in split])
        total = len(units)
        unit = np.fromiter(map(self.known.__getitem__, units), np.int64, total)
        left = self.lengths[unit].astype(np.int64)
        owner = np.repeat(np.arange(len(texts)), owners)
        place = np.arange(total) - np.repeat(np.cumsum(owners) - owners, owners)
        state = _mixed(np.array(keys, np.uint64)[owner] + _mixed(place.astype(np.uint64) + np.uint64(((seed + 1) << 40) % 2**64)))
        base, who, out, step = self.node[unit].astype(np.int64) - 1, np.arange(total), [], 0
        while len(who):  # backward sampling: one piece of every unit that is not used up
            r = (_mixed(state[who] + np.uint64((step + 1) * 0xD1342543DE82EF95 % 2**64)) >> np.uint64(11)) * 2.0**-53
            q = base[who] + left[who]
            edge, last = self.begins[q], self.begins[q + 1] - 1
            more = np.flatnonzero((self.shares[edge] <= r) & (edge < last))
            while len(more):
                edge[more] += 1
                more = more[(self.shares[edge[more]] <= r[more]) & (edge[more] < last[more])]
            out.append((who, np.full(len(who), step), self.pieces[edge]))
            left[who] -= self.spans[edge]
            who = who[left[who] > 0]
            step += 1
        of, steps, ids = (np.concatenate(x) for x in zip(*out, strict=True))
        counts = np.bincount(of, minlength=total)
        flat = np.empty(len(ids), np.int32)
        flat[np.cumsum(counts)[of] - 1 - steps] = ids
        per_text = np.bincount(owner, weights=counts, minlength=len(texts)).astype(np.int64)
        found = np.split(flat, np.cumsum(per_text)[:-1])
        return [self._spelled(x) if len(x) and x.max() >= self.size else x for x in found]

    def _spelled(self, ids: np.ndarray) -> np.ndarray:
        """Characters without a piece written as their bytes."""
        return np.array([j for i in ids.tolist() for j in ([i] if i < self.size else [self.byte_ids[b] for b in chr(i - self.size).encode()])], np.int32)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def lattices(path: str, sharpness: float) -> Lattices:
    """One for each Python worker, kept over its tasks."""
    return Lattices(path, sharpness)


@lru_cache(maxsize=2)
def spellings(path: str) -> list[bytes]:
    """The bytes of each piece, all that decoding needs."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)

    def spelled(i: int) -> bytes:
        piece = model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) or model.is_unknown(i) else piece.replace(MARK, " ").encode()

    return [spelled(i) for i in range(model.vocab_size())]


def encode(docs: DataFrame, path: str, seed: int = 0, sharpness: float = SHARPNESS, key_col: str = "doc_id", text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """`docs` with the ids of a sampled segmentation of the text in `out_col` (in place of any column of that name).

    Null text counts as empty, whose ids are those of the word mark put in front. Rows with the same key
    and text have the same ids; a null key counts as the text "null".
    """

    @F.pandas_udf("array<int>")
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        own_memory("pieces")
        model = lattices(path, sharpness)
        for texts, names in batches:
            some, keys, room = [], [], 0
            for t, k in zip(texts, names, strict=True):
                some.append(t)
                keys.append(xxhash.xxh64_intdigest(k, seed))
                room += len(t)
                if room > BLOCK:
                    yield pd.Series(model.encode(some, keys, seed), dtype=object)
                    some, keys, room = [], [], 0
            if some:
                yield pd.Series(model.encode(some, keys, seed), dtype=object)

    key = F.coalesce(F.col(key_col).cast("string"), F.lit("null"))
    return docs.withColumn(out_col, of(F.coalesce(F.col(text_col), F.lit("")), key))


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """`encoded` with the text of the ids in `out_col`, without the word mark put in front; null for null.

    A look-up in the constant table of spellings, without Python.
    """
    table = F.split(F.lit(",".join(x.hex() for x in spellings(path))), ",")
    text = F.unhex(F.array_join(F.transform(F.col(ids_col), lambda i: F.get(table, i)), ""))
    return encoded.withColumn(out_col, F.substring(text.cast("string"), 2, 2**31 - 1))
