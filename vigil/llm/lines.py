"""Line deduplication with a segment-partition edit join.

A line goes if a line of an earlier document (by id) is the same or within EDITS edits. Lines within t edits
share one of t + 1 segments: each line is cut into EDITS + 1 segments, which index it, and probes with the
substrings at which a segment of each possible length can still lie (the multi-match-aware positions).
Index and probe meet by a hash of length, segment number and substring, if their sketches differ by no more
bits than the edits can flip; what meets is verified with a banded bit-parallel edit distance.

Lines of fewer than MIN_CHARS characters are too short to tell apart and are left alone, repeated or not.

A segment that many different lines have would bring them all into one task, pair by pair. The rows of such
keys are dealt once more by the masked bits of their sketches: the masks cover the bits that edits can
flip, so every pair that could be near still meets, and others no longer do.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Sketch, blocks_of, discard, own_memory, skew_join, stored
from .simhash import covering_masks

EDITS, MIN_CHARS = 2, 20
#: A task forgets which lines it has indexed after so many.
SEEN = 500_000
#: Characters of lines whose keys a task gives out at a time.
BLOCK = 250_000
#: Index entries of a segment beyond which its rows are dealt by their sketches as well.
HOT_SEGMENT = 500
CLASSES = 16
#: A document is a copy of one earlier document if the lines it repeats from that one are more than this share of that document's characters, and of its own without what it repeats from others.
COPY_SHARE = 0.5


@lru_cache(maxsize=8192)
def spans(length: int, edits: int, index: bool) -> tuple[tuple[int, int, int], ...]:
    """Start, end and seed of each substring that stands for a line of this length, as index entry or as probe."""
    out = {}
    for size in range(length if index else max(edits + 1, length - edits), length + 1):
        shift, base, extra = length - size, size // (edits + 1), size % (edits + 1)
        start = 0
        for i in range(1, edits + 2):
            width = base + (i > edits + 1 - extra)
            low = max(start - (i - 1), start + shift - (edits + 1 - i), 0)
            high = min(start + (i - 1), start + shift + (edits + 1 - i), length - width)
            for at in range(start, start + 1) if index else range(low, high + 1):
                out[at, at + width, size * (edits + 2) + i] = None
            start += width
    return tuple(out)


def within(a: str, b: str, edits: int) -> bool:
    """Whether the edit distance is at most `edits`: bit vectors of the 2 * edits + 1 cells around the diagonal.

    Bit d of row e says that e edits can align a prefix of `a` with the prefix of `b` that is d - edits
    longer; a row follows from the one before with shifts, and matches run along the diagonals.
    """
    if abs(len(a) - len(b)) > edits:
        return False
    if a == b:
        return True
    band, n, m = 2 * edits + 1, len(a), len(b)
    mask, goal = (1 << band) - 1, 1 << (m - n + edits)
    where: dict[str, int] = {}
    for j, c in enumerate(b):
        where[c] = where.get(c, 0) | 1 << (j + edits)
    # rows[e]: diagonals alive after i characters of `a`; diagonal d is at character i + d - edits of `b`
    rows = [1 << edits]
    for _ in range(edits):
        rows.append((rows[-1] | rows[-1] << 1) & mask)
    for i, c in enumerate(a):
        match = where.get(c, 0) >> i & mask
        new = [rows[0] & match]
        for e in range(1, edits + 1):
            cell = rows[e] & match | rows[e - 1] | rows[e - 1] >> 1  # match, substitution, deletion from `a`
            new.append((cell | new[e - 1] << 1) & mask)  # insertion
        rows = new
        if not rows[edits]:
            return False
    return bool(rows[edits] & goal)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def sketches(lines: list[str]) -> np.ndarray:
    """Counts of characters by CLASSES classes, modulo 4, two bits each in Gray code: an edit flips two bits at most."""
    codes = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32) % CLASSES
    owners = np.repeat(np.arange(len(lines), dtype=np.int32), np.fromiter(map(len, lines), np.int64, len(lines)))
    counts = np.bincount(owners * CLASSES + codes.astype(np.int32), minlength=len(lines) * CLASSES).reshape(-1, CLASSES) % 4
    return ((counts ^ counts >> 1) << np.arange(0, 2 * CLASSES, 2)).sum(axis=1)


def segment_keys(docs: DataFrame, text_col: str, edits: int, min_chars: int, index: bool) -> DataFrame:
    """`k`, `line`, `sketch`: the hash of a substring, that of its line, and the line's sketch.

    A task gives each line once as long as it remembers it, so that frequent lines do not reach the shuffle.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own_memory("lines")
        seen: set[int] = set()
        digest = xxhash.xxh64_intdigest
        keys, hashes, counts, found, room = [], [], [], [], 0

        def block() -> pd.DataFrame:
            line = np.repeat(np.array(hashes, np.uint64).view(np.int64), counts)
            out = pd.DataFrame({"k": np.array(keys, np.uint64).view(np.int64), "line": line, "sketch": np.repeat(sketches(found), counts)})
            for x in (keys, hashes, counts, found):
                x.clear()
            return out

        for pdf in batches:
            for text in pdf["t"]:
                for line in text.split("\n"):
                    if len(line) < min_chars:
                        continue
                    h = digest(line.encode(), 42)
                    if h in seen:
                        continue
                    seen.add(h)
                    raw = line.encode("utf-32-le")
                    some = [digest(raw[4 * start : 4 * end], seed) for start, end, seed in spans(len(line), edits, index)]
                    keys += some
                    hashes.append(h)
                    counts.append(len(some))
                    found.append(line)
                    room += len(line)
                    if room > BLOCK:
                        yield block()
                        room = 0
            if len(seen) > SEEN:
                seen.clear()
        if keys:
            yield block()

    return docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("t")).mapInPandas(run, "k long, line long, sketch long")


def _dealt(rows: DataFrame, hot: DataFrame, edits: int) -> DataFrame:
    """`rows` with the keys in `hot` replaced by one for each mask that covers what `edits` edits can flip in a sketch."""
    masks = covering_masks(2 * edits, 2 * CLASSES)
    keys = F.array(*[F.xxhash64("k", F.lit(i), F.col("sketch").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)])
    return rows.join(hot.withColumn("hot", F.lit(True)), "k", "left").select(F.explode(F.when(F.col("hot"), keys).otherwise(F.array("k"))).alias("k"), "line", "sketch")


def candidates(docs: DataFrame, text_col: str, edits: int, min_chars: int) -> DataFrame:
    """`a`, `b`: the pairs of different lines (hashes) that share a segment and have sketches that edits could explain."""
    own = stored(segment_keys(docs, text_col, edits, min_chars, index=True).distinct(), "index")
    hot = stored(own.groupBy("k").agg(F.count("*").alias("n")).filter(F.col("n") > HOT_SEGMENT).select("k"), "hot")
    probe = _dealt(segment_keys(docs, text_col, edits, min_chars, index=False), hot, edits)
    index = _dealt(own, hot, edits).toDF("other_k", "other", "other_sketch")
    alike = F.bit_count(F.col("sketch").bitwiseXOR(F.col("other_sketch"))) <= 2 * edits
    met = probe.join(index, (F.col("k") == F.col("other_k")) & (F.col("line") != F.col("other")) & alike)
    pairs = stored(met.select(F.least("line", "other").alias("a"), F.greatest("line", "other").alias("b")).distinct(), "pairs")
    discard(own, hot)
    return pairs


def first_texts(docs: DataFrame, known: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`h`, `h2`, `doc`, `size`, `n`, `no`, `t` of each line whose hash is in `wanted`, from the first document that has it."""
    places = stored(known.join(wanted, "h").select("doc", "h", "h2", "size", "n"), "wanted")
    # lines leave their text where it lies, and only such as may be wanted
    each = docs.select(F.col(id_col).alias("doc"), F.posexplode(F.split(text_col, "\n")).alias("no", "t")).select("doc", "no", "t", F.xxhash64("t").alias("h"))
    wanted_here = Sketch(places.select(F.xxhash64("doc", "h").alias("at")), "at")
    each = each.filter(wanted_here.holds(F.xxhash64("doc", "h"))).withColumn("h2", F.xxhash64(F.lit(1), "t"))
    some = each.groupBy("doc", "h", "h2").agg(F.min_by("t", "no").alias("t"), (F.min("no") + 1).cast("long").alias("no"))
    out = stored(some.join(places, ["doc", "h", "h2"]).select("h", "h2", "size", "n", "doc", "no", "t"), "texts")
    discard(places)
    return out


def near_lines(docs: DataFrame, known: DataFrame, id_col: str, text_col: str, edits: int, min_chars: int) -> DataFrame:
    """`h`, `h2`, `n`, `first`, `size`: lines that have another line of an earlier document (then: earlier place, then smaller hash) within `edits`, and the earliest such document."""
    pairs = candidates(docs, text_col, edits, min_chars)
    texts = first_texts(docs, known, pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct(), id_col, text_col)

    @F.pandas_udf("boolean")
    def close(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([within(x, y, edits) for x, y in zip(left, right, strict=True)], dtype=bool)

    side = lambda n: texts.select(F.col("h").alias(n), F.struct("doc", "no", "h", "h2", "n", "size").alias(f"{n}_at"), F.col("t").alias(f"{n}_t"))
    found = pairs.join(side("a"), "a").join(side("b"), "b").filter(close("a_t", "b_t"))
    found = found.select(F.greatest("a_at", "b_at").alias("x"), F.least("a_at", "b_at").alias("of")).select("x.h", "x.h2", "x.n", F.col("of.doc").alias("of"), F.col("of.size").alias("of_size"))
    near = stored(found.groupBy("h", "h2").agg(F.max("n").alias("n"), F.min("of").alias("first"), F.min_by("of_size", "of").alias("size")), "near")
    discard(pairs, texts)
    return near


def deduplicate(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", spare_copies: bool = False) -> DataFrame:
    """`docs` with repeated lines taken out of the text, and `n_lines`, `n_removed` (in place of columns of those names).

    A line of at least `min_chars` characters goes if it came before in its own text, or if a document
    with a smaller id has it or (then also in the first document that has it) a line within `edits` of it.
    A document of which nothing remains has the empty text. With `spare_copies`, a copy of one earlier
    document (see COPY_SHARE) keeps the lines that it shares with that one, for document deduplication, and
    loses what it repeats from others. Null text stays null. Rows with
    a null id lose only what their own text repeats; rows that share an id count as one document.
    Other columns pass through, whatever their names.
    """
    split = docs.select(F.col(id_col).alias("doc"), F.length(text_col).cast("long").alias("size"), F.explode(F.split(text_col, "\n")).alias("line"))
    lines = split.filter(F.col("doc").isNotNull() & (F.length("line") >= min_chars)).select("doc", "size", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("h2"))
    lines = stored(lines, "lines")
    known = lines.groupBy("h", "h2").agg(F.min("doc").alias("doc"), F.min_by("size", "doc").alias("size"), F.max("doc").alias("last"), F.count("*").alias("n"))
    known = stored(known, "known")
    near = near_lines(docs.filter(F.col(id_col).isNotNull()), known, id_col, text_col, edits, min_chars)
    exact = known.filter("doc <> last").select("h", "h2", "n", F.col("doc").alias("first"), "size", F.lit(True).alias("first_stays"))
    verdicts = stored(exact.unionByName(near.withColumn("first_stays", F.lit(False))), "verdicts")
    discard(known, near)
    gone = skew_join(lines.select("doc", "h", "h2"), verdicts, ["h", "h2"], lines.count()).filter("not first_stays or doc <> first")
    entry = F.struct("h", F.xxhash64("first").alias("first"), "size") if spare_copies else F.struct("h")
    per_doc = stored(gone.groupBy("doc").agg(F.collect_set(entry).alias("gone")), "gone")
    discard(lines, verdicts)

    @F.pandas_udf("text string, n_lines long, n_removed long")
    def rewritten(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        own_memory("lines")
        for texts, sets in batches:
            for i, j in blocks_of(texts):
                rows = [rewrite(t, () if g is None else [tuple(x.values()) for x in g], min_chars, spare_copies) for t, g in zip(texts[i:j], sets[i:j], strict=True)]
                yield pd.DataFrame(rows, columns=["text", "n_lines", "n_removed"])

    touched = Sketch(per_doc.select(F.xxhash64("doc").alias("at")), "at")

    @F.pandas_udf("here boolean, text string, n_lines long, n_removed long")
    def rewritten_here(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        own_memory("lines")
        for texts, hashes, without_id in batches:
            here = without_id.to_numpy(bool) | ~touched.has(hashes.to_numpy(np.int64))
            for i, j in blocks_of(texts):
                rows = [(True, *rewrite(t, (), min_chars, spare_copies)) if h else (False, None, 0, 0) for t, h in zip(texts[i:j], here[i:j], strict=True)]
                yield pd.DataFrame(rows, columns=["here", "text", "n_lines", "n_removed"])

    # documents that surely lose nothing to others are rewritten where they lie, and so are those without an id
    whole, doc = docs.select(F.struct("*").alias("row")), F.col(f"row.`{id_col}`")
    text = F.col(f"row.`{text_col}`")
    here = whole.select("row", rewritten_here(text, F.xxhash64(doc), doc.isNull()).alias("new")).filter("new.here")
    dealt = whole.filter(doc.isNotNull()).filter(touched.holds(F.xxhash64(doc))).join(per_doc, doc == F.col("doc"), "left").select("row", rewritten(text, F.col("gone")).alias("new"))
    new = lambda rows: rows.select("row", *[F.col(f"new.{c}").alias(f"new_{c}") for c in ("text", "n_lines", "n_removed")])
    out = new(here).unionByName(new(dealt))
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return out.select(*[F.col("new_text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in kept], F.col("new_n_lines").alias("n_lines"), F.col("new_n_removed").alias("n_removed"))


def rewrite(text: str | None, gone, min_chars: int, spare_copies: bool = False) -> tuple[str | None, int, int]:
    """The text without its repeated lines, their number before, and how many went.

    `gone` has the hash of each line that goes; with `spare_copies` the document it repeats and that document's characters as well.
    """
    if text is None:
        return None, 0, 0
    others, seen, own, marks, sizes, shared = {}, set(), [], [], {}, {}
    for h, *of in gone:
        first, size = of or (0, 0)
        others.setdefault(int(h), set()).add(int(first))
        sizes[int(first)] = int(size)
    for line in text.split("\n"):
        long = len(line) >= min_chars
        if long and line in seen:
            continue
        seen.add(line) if long else None
        own.append(line)
        marks.append(others.get(_signed(xxhash.xxh64_intdigest(line.encode(), 42)), ()) if long and others else ())
    n = text.count("\n") + 1
    copied = None
    if spare_copies and others:
        fresh = sum(len(x) for x, m in zip(own, marks, strict=True) if not m)
        for x, m in zip(own, marks, strict=True):
            for first in m:
                shared[first] = shared.get(first, 0) + len(x)
        most = max(sorted(shared), key=shared.get, default=None)
        if most is not None and shared[most] > COPY_SHARE * max(sizes[most], shared[most] + fresh):
            copied = most
    left = [x for x, m in zip(own, marks, strict=True) if not m or copied in m]
    return "\n".join(left), n, n - len(left)
