"""Language of whole texts and of the spans of mixed ones.

Each word (a run of letters) has a score for each language: the summed log frequencies of its character n-grams and
of itself among the language's words, hashed to a fixed number of classes. The word's script, from ranges of code
points, narrows the languages to those written in it. Viterbi finds the labels of the words with the greatest
sum of scores, less a penalty for each change of language; neighbouring words of one label are a span.

Counting is a grouped sum over all rows to learn from. The model has CLASSES numbers a language and at most LANGUAGES
languages, so that its size is bounded whatever the corpus; it is sent to the workers once.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Classes of n-grams, and the languages learned: the most frequent, ties by name.
CLASSES, LANGUAGES = 1 << 16, 128
#: N-grams of so many characters, of the word between spaces.
ORDERS = (2, 3, 4)
#: What is added to each frequency, so that rarer n-grams say little and those that no language has say nothing.
LEAST = 1e-6
#: N-grams overlap: each counts for this part. A word's scores lie at most so far apart.
PART, APART = 0.3, 8.0
#: A language is written in a script that has this share of the letters in its texts.
WRITTEN = 0.01
SWITCH = 12.0
#: Words that a Python worker remembers; words of a block that is labelled at once, unless one text has more; words counted before they are hashed.
MEMO, BLOCK, COUNTED = 400_000, 400_000, 200_000
WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"

# First and last code points of scripts, from the Unicode blocks.
RANGES = [
    (0x0041, 0x005A, "Latin"), (0x0061, 0x007A, "Latin"), (0x00AA, 0x024F, "Latin"), (0x0370, 0x03FF, "Greek"), (0x0400, 0x052F, "Cyrillic"),
    (0x0530, 0x058F, "Armenian"), (0x0590, 0x05FF, "Hebrew"), (0x0600, 0x06FF, "Arabic"), (0x0700, 0x074F, "Syriac"), (0x0750, 0x077F, "Arabic"), (0x0780, 0x07BF, "Thaana"),
    (0x0900, 0x097F, "Devanagari"), (0x0980, 0x09FF, "Bengali"), (0x0A00, 0x0A7F, "Gurmukhi"), (0x0A80, 0x0AFF, "Gujarati"), (0x0B00, 0x0B7F, "Oriya"),
    (0x0B80, 0x0BFF, "Tamil"), (0x0C00, 0x0C7F, "Telugu"), (0x0C80, 0x0CFF, "Kannada"), (0x0D00, 0x0D7F, "Malayalam"), (0x0D80, 0x0DFF, "Sinhala"),
    (0x0E00, 0x0E7F, "Thai"), (0x0E80, 0x0EFF, "Lao"), (0x0F00, 0x0FFF, "Tibetan"), (0x1000, 0x109F, "Myanmar"), (0x10A0, 0x10FF, "Georgian"),
    (0x1100, 0x11FF, "Hangul"), (0x1200, 0x137F, "Ethiopic"), (0x13A0, 0x13FF, "Cherokee"), (0x1780, 0x17FF, "Khmer"), (0x1800, 0x18AF, "Mongolian"),
    (0x1E00, 0x1EFF, "Latin"), (0x1F00, 0x1FFF, "Greek"), (0x2C60, 0x2C7F, "Latin"), (0x2D00, 0x2D2F, "Georgian"), (0x3040, 0x309F, "Kana"), (0x30A0, 0x30FF, "Kana"),
    (0x3130, 0x318F, "Hangul"), (0x3400, 0x4DBF, "Han"), (0x4E00, 0x9FFF, "Han"), (0xAC00, 0xD7AF, "Hangul"), (0xF900, 0xFAFF, "Han"),
    (0xFF21, 0xFF5A, "Latin"), (0x20000, 0x2FA1F, "Han"),
]
STARTS = [a for a, _, _ in RANGES]
SCRIPTS = [*dict.fromkeys(s for _, _, s in RANGES), "other"]
SCRIPT_NO = {s: i for i, s in enumerate(SCRIPTS)}


def script(word: str) -> int:
    """The script of most of the word's letters, of the first of those with as many; -1 without a letter."""
    if word.isascii():
        return SCRIPT_NO["Latin"] if any(map(str.isalpha, word)) else -1
    found: Counter[int] = Counter()
    for c in filter(str.isalpha, word):
        k = bisect_right(STARTS, ord(c)) - 1
        found[SCRIPT_NO[RANGES[k][2]] if k >= 0 and ord(c) <= RANGES[k][1] else SCRIPT_NO["other"]] += 1
    return found.most_common(1)[0][0] if found else -1


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The class of each n-gram of each word and of the word itself, and the word's number."""
    low = [w.lower() for w in words]
    codes = np.frombuffer(f" {' '.join(low)} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    space = codes == 32
    of = np.cumsum(space) - 1  # the word of a character, and of the space before it
    classes, owners = [np.array([crc32(w.encode()) % CLASSES for w in low], np.int64)], [np.arange(len(low))]
    h = codes
    with np.errstate(over="ignore"):
        for n in range(2, max(ORDERS) + 1):
            h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :]
            inside = np.ones(len(h), bool)
            for k in range(1, n - 1):
                inside &= ~space[k : k + len(h)]
            if n in ORDERS:
                inside &= ~(space[: len(h)] & space[n - 1 :]) if n == 2 else inside
                mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                classes.append((mixed >> np.uint64(40)).astype(np.int64)[inside] % CLASSES)
                owners.append(of[: len(h)][inside])
    return np.concatenate(classes), np.concatenate(owners)


@dataclass
class Model:
    """`scores`: log frequencies, a row a language; `written`: whether a language is written in a script; `prior`: log share of the texts."""

    names: list[str]
    scores: np.ndarray
    written: np.ndarray
    prior: np.ndarray


def counts(docs: DataFrame, text: Column, lang: Column) -> DataFrame:
    """`lang`, `class`, `n`: how often the words of each language's texts have each class; from CLASSES on, letters in each script."""

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, np.ndarray] = {}
        waiting: dict[str, Counter[str]] = {}

        def add(name: str) -> None:
            words = waiting.pop(name)
            total = totals.setdefault(name, np.zeros(CLASSES + len(SCRIPTS), np.int64))
            scripts = {w: s for w in words if (s := script(w)) >= 0}
            if not scripts:
                return
            times = np.array([words[w] for w in scripts], np.int64)
            classes, owners = ngrams(list(scripts))
            total += np.bincount(classes, times[owners], len(total)).astype(np.int64)
            letters = times * np.array([len(w) for w in scripts])
            total += np.bincount(CLASSES + np.array(list(scripts.values())), letters, len(total)).astype(np.int64)

        for batch in batches:
            for name, t in zip(batch["lang"], batch["t"], strict=True):
                waiting.setdefault(name, Counter()).update(WORD.findall(t))
                if len(waiting[name]) > COUNTED:
                    add(name)
        for name in list(waiting):
            add(name)
        for name, total in totals.items():
            some = np.flatnonzero(total)
            yield pd.DataFrame({"lang": name, "class": some.astype(np.int32), "n": total[some]})

    rows = docs.select(lang.alias("lang"), text.alias("t")).filter("lang is not null and t is not null")
    return rows.mapInPandas(found, "lang string, class int, n long").groupBy("lang", "class").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """The model of all rows of `docs` that have a text and a language; without such rows it has no language."""
    text, lang = F.col(text_col), F.col(lang_col).cast("string")
    texts = docs.select(text.alias("text"), lang.alias("lang")).filter("lang is not null and text is not null")
    share = {r.lang: r.n for r in texts.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    names = sorted(share)
    n = np.zeros((len(names), CLASSES + len(SCRIPTS)))
    if names:
        told = counts(texts.filter(F.col("lang").isin(names)), F.col("text"), F.col("lang")).toArrow().to_pandas()
        n[told["lang"].map({x: i for i, x in enumerate(names)}).to_numpy(int), told["class"].to_numpy(int)] = told["n"]
    of_class, of_script = n[:, :CLASSES], n[:, CLASSES:]
    scores = np.log(of_class / np.maximum(1, of_class.sum(axis=1, keepdims=True)) + LEAST)
    written = of_script / np.maximum(1, of_script.sum(axis=1, keepdims=True)) >= WRITTEN
    prior = np.array([share[x] for x in names], float)
    return Model(names, scores.astype(np.float32), written, np.log(prior / max(1, prior.sum())))


class Scorer:
    """The scores of words under a model, remembered."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, len(self.model.names)), np.float32)

    def learn(self, words: list[str]) -> None:
        """Scores new words. Those of a script that no language is written in, or without a letter, are the same for all."""
        m = self.model
        scripts = np.array([script(w) for w in words])
        classes, owners = ngrams(words)
        out = np.empty((len(words), len(m.names)), np.float32)
        for s in range(len(m.names)):
            out[:, s] = np.bincount(owners, m.scores[s, classes], len(words)) * PART
        may = m.written.T[scripts]  # of no script, -1: the last, "other"
        out = np.where(may, out, -np.inf)
        out = np.maximum(out - out.max(axis=1, keepdims=True, initial=-np.inf, where=may), -APART)
        out[~may.any(axis=1) | (scripts < 0)] = 0
        first = len(self.known)
        self.known.update((w, first + i) for i, w in enumerate(words))
        self.rows = np.concatenate([self.rows, out.astype(np.float32)])

    def of(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The numbers of the rows of each text's words."""
        new = set().union(*texts).difference(self.known)
        if len(self.known) + len(new) > MEMO:
            self.clear()
            new = set().union(*texts)
        if new:
            self.learn(list(new))
        return [np.fromiter(map(self.known.__getitem__, words), np.int64, len(words)) for words in texts]


def viterbi(rows: np.ndarray, texts: list[np.ndarray], prior: np.ndarray, switch: float) -> list[np.ndarray]:
    """The labels of each text's words: the greatest sum of prior, rows and -`switch` for each change; ties go to staying, then to the first language.

    All texts step together, the longest first, so that those which have ended drop off the end.
    """
    sizes = np.array([len(x) for x in texts], np.int64)
    order = np.argsort(-sizes, kind="stable")
    by_size = sizes[order]
    longest = int(by_size[0]) if len(by_size) else 0
    active = np.searchsorted(-by_size, -np.arange(longest), side="left")  # texts that have a word number t
    begins = np.concatenate([[0], np.cumsum(active)])
    place = [begins[: sizes[k]] + r for r, k in enumerate(order)]
    packed = np.empty(begins[-1], np.int64)
    for r, k in enumerate(order):
        packed[place[r]] = texts[k]
    n_langs = len(prior)
    moved, came = np.zeros((len(packed), n_langs), bool), np.zeros(len(packed), np.uint8)
    best = np.tile(prior.astype(np.float64), (len(texts), 1))
    for t in range(longest):
        a, b = begins[t], begins[t + 1]
        now = best[: b - a]
        if t:
            came[a:b] = now.argmax(axis=1)
            top = now.max(axis=1, keepdims=True) - switch
            np.greater(top, now, out=moved[a:b])
            np.maximum(now, top, out=now)
        now += rows[packed[a:b]]
    labels, state = np.zeros(len(packed), np.uint8), best.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        a, b = begins[t], begins[t + 1]
        now = state[: b - a]
        labels[a:b] = now
        if t:
            state[: b - a] = np.where(moved[np.arange(a, b), now], came[a:b], now)
    out: list[np.ndarray] = [None] * len(texts)
    for r, k in enumerate(order):
        out[k] = labels[place[r]]
    return out


def judged(scorer: Scorer, texts: list[str], switch: float) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """The language, score and spans of each text."""
    model = scorer.model
    if not model.names:
        return [(UNKNOWN, 0.0, []) for _ in texts]
    words = [WORD.findall(t) for t in texts]
    ids = scorer.of(words)
    out = []
    for text, found, rows, labels in zip(texts, words, ids, viterbi(scorer.rows, ids, model.prior, switch), strict=True):
        if not any(map(str.isalpha, text)):
            out.append((UNKNOWN, 0.0, []))
            continue
        letters = np.bincount(labels, np.fromiter(map(len, found), np.int64, len(found)), len(model.names))
        lang = int(letters.argmax())
        sums = scorer.rows[rows].sum(axis=0, dtype=np.float64)
        rival = np.delete(sums, lang).max(initial=-np.inf)
        score = letters[lang] / letters.sum() * (1 - np.exp(-max(0.0, sums[lang] - rival)))
        cuts = np.flatnonzero(np.diff(labels)) + 1
        starts = [0]
        if len(cuts):
            at = [m.start() for m in WORD.finditer(text)]
            starts += [at[c] for c in cuts]
        spans = [(a, b, model.names[labels[c]]) for a, b, c in zip(starts, [*starts[1:], len(text)], [0, *cuts], strict=True)]
        out.append((model.names[lang], float(score), spans))
    return out


def blocks(texts: Iterator[str]) -> Iterator[list[str]]:
    """The texts in runs of about BLOCK words, guessed from their length."""
    some, room = [], 0
    for t in texts:
        if some and room + len(t) > 6 * BLOCK:
            yield some
            some, room = [], 0
        some.append(t)
        room += len(t)
    if some:
        yield some


def identify(docs: DataFrame, model: Model, text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """`docs` with `lang_pred`, `lang_score` and `spans` (in place of columns of these names).

    `spans` part the whole text: start, end (code points) and language of each stretch. `lang_pred` has the most letters in
    them, ties to the first name; `lang_score` is its share of the letters, times 1 - exp(-m) where m is by how much
    the whole text's scores for it exceed those for any other language (0: undecided, to 1). `und`, 0 and no spans for null
    texts, texts without a letter, and a model without languages. Rows are independent of each other, so repeated
    rows, null ids and an empty table need no care; very long texts are labelled whole.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, lang_score double, spans array<struct<start:int,end:int,lang:string>>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(sent.value)
        for batch in batches:
            out = [x for some in blocks(iter(batch)) for x in judged(scorer, some, switch)]
            spans = [[{"start": a, "end": b, "lang": c} for a, b, c in x[2]] for x in out]
            yield pd.DataFrame({"lang_pred": [x[0] for x in out], "lang_score": [x[1] for x in out], "spans": pd.Series(spans, dtype=object)})

    rest = [c for c in docs.columns if c.lower() not in ("lang_pred", "lang_score", "spans")]
    found = f"_found{uuid.uuid4().hex}"
    return docs.withColumn(found, of(F.coalesce(F.col(text_col), F.lit("")))).select(*rest, f"{found}.*")


def held_out(id_col: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    """Whether a row's id falls into the part held out from learning; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % parts == part


def split_and_identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """`doc_id`, `held_out`, `lang_pred`, `score` and `spans` of every row, learned from the rows not held out.

    A row with a null id is neither held out nor learned from.
    """
    model = train(docs.filter(~held_out(id_col)), text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return identify(rows, model).select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), "spans")
