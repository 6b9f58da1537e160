"""Which entries of a dictionary occur in which texts: a join on q-grams, for dictionaries that are tables of any size.

Every entry is found by one of its q-grams, its anchor: the one that fewest texts have. Texts are joined with the
dictionary on anchors, then each candidate is verified. An entry with a q-gram that no text has can't occur and is dropped.
So what is compared follows from how rare the entries are, not from how many there are.

A dictionary of few words is looked for word by word instead.

Frequent anchors don't meet in one task: those that over a 1,024th of all q-grams are pass by broadcast.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import stored

#: Length of the q-grams; shorter entries are their own.
Q = 4
#: A dictionary of so many characters, anchors included, is broadcast; what is larger is dealt by q-gram.
SMALL_CHARS = 8_000_000
#: A dictionary of so many words and characters at most is looked for word by word, which costs less than a text's q-grams.
FEW_WORDS, FEW_CHARS = 256, 4096
#: Keys with more than this part of all rows pass by broadcast: fewer than so many, whatever the size.
HOT_KEYS = 1024


def grams(text: Column, sizes: list[int]) -> Column:
    """The distinct q-grams of the given lengths of a text."""
    return F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in sizes])))


def entries(dictionary: DataFrame, word_col: str) -> DataFrame:
    """`word`, lower case and distinct; null and empty ones are left out."""
    return dictionary.select(F.lower(F.col(word_col)).alias("word")).filter("word is not null and word <> ''").distinct()


def anchored(words: DataFrame, found: DataFrame, q: int = Q) -> DataFrame:
    """`gram`, `n`, `word`: of each word the q-gram with the fewest texts (`found`: gram, n), ties by the q-gram; without the words of which no text has some q-gram."""
    own = words.select("word", F.explode(F.when(F.length("word") < q, F.array("word")).otherwise(grams(F.col("word"), [q]))).alias("gram"))
    known = own.join(found, "gram", "left").groupBy("word").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("a"))
    return known.filter("a.n > 0").select("a.gram", "a.n", "word")


def matches(texts: DataFrame, dictionary: DataFrame, id_col: str, text_col: str, word_col: str = "word", q: int = Q) -> DataFrame:
    """`id_col` and `word` (lower case) of every text and entry that occurs in it, any case; a pair once, however often it occurs.

    Rows with one id count as one text each; their pairs appear once. Null and empty texts and entries match nothing.
    """
    words = stored(entries(dictionary, word_col), "words")
    said = words.groupBy(F.least(F.length("word"), F.lit(q)).alias("size")).agg(F.count("*").alias("n"), F.sum(F.length("word")).alias("chars")).collect()
    sizes = sorted(r["size"] for r in said)
    rows = texts.select(F.col(id_col).alias("id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("low"))
    if not sizes:
        return rows.select(F.col("id").alias(id_col), F.lit("").alias("word")).filter("false")
    if sum(r["n"] for r in said) <= FEW_WORDS and sum(r["chars"] for r in said) <= FEW_CHARS:
        few = T.literals(sorted(r.word for r in words.collect()))
        hits = T.let(F.col("low"), lambda t: F.filter(few, lambda w: F.contains(t, w)))
        return rows.select(F.col("id").alias(id_col), F.explode(hits).alias("word")).distinct()
    counts = rows.select(F.explode(grams(F.col("low"), sizes)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    anchors = stored(anchored(words, counts.join(words_grams(words, q), "gram", "left_semi"), q), "anchors")
    # every word has one anchor, and n texts stand behind it: how many rows the join makes is known beforehand
    total, chars = anchors.agg(F.sum("n"), F.sum(F.length("word") + F.length("gram"))).first()
    gram = F.explode(grams(F.col("low"), sizes)).alias("gram")
    has = F.contains("low", F.col("word"))
    if (chars or 0) <= SMALL_CHARS:
        found = rows.select("id", "low", gram).join(F.broadcast(anchors), "gram").filter(has)
    else:
        # ids and q-grams are dealt, not texts: these move once, to the entries that they may hold
        pairs = lookup(rows.select("id", gram), anchors, "gram", total).groupBy("id").agg(F.collect_set("word").alias("words"))
        found = rows.join(pairs, "id").select("id", "low", F.explode("words").alias("word")).filter(has)
    return found.select(F.col("id").alias(id_col), "word").distinct()


def words_grams(words: DataFrame, q: int) -> DataFrame:
    return words.select(F.explode(F.when(F.length("word") < q, F.array("word")).otherwise(grams(F.col("word"), [q]))).alias("gram")).distinct()


def lookup(rows: DataFrame, groups: DataFrame, key: str, total: int, n_col: str = "n") -> DataFrame:
    """`rows` joined with `groups` (several rows a key, each with the key's `n_col` of the `total` rows).

    Rows whose key is in no group are dropped before any shuffle where the keys fit Spark's broadcast threshold. Keys
    of more than a 1,024th of `total` pass by broadcast.
    """
    frequent = groups.filter(F.col(n_col) > total / HOT_KEYS)
    rest = groups.filter(F.col(n_col) <= total / HOT_KEYS)
    hot_rows = rows.join(F.broadcast(frequent), key)
    return hot_rows.unionByName(rows.join(rest, key))


def hits(texts: DataFrame, dictionary: DataFrame, id_col: str, text_col: str, word_col: str = "word", out_col: str = "hits") -> DataFrame:
    """`texts` with the sorted array of the entries that occur in it; `id_col` should be unique."""
    found = matches(texts, dictionary, id_col, text_col, word_col).groupBy(id_col).agg(F.sort_array(F.collect_set("word")).alias("_hits"))
    return texts.join(found, id_col, "left").withColumn(out_col, F.coalesce("_hits", F.array().cast("array<string>"))).drop("_hits")


def aliases(texts: DataFrame, names: DataFrame, id_col: str, text_col: str, alias_col: str = "alias", name_col: str = "name", rank_col: str | None = None, out_col: str = "actors") -> DataFrame:
    """`texts` with the names of which an alias occurs, in order of `rank_col` or of the names: a table of aliases in place of the fixed list."""
    found = matches(texts, names, id_col, text_col, alias_col)
    rank = F.col(rank_col) if rank_col else F.lit(0)
    known = names.select(F.lower(F.col(alias_col)).alias("word"), F.col(name_col).alias("_name"), rank.alias("_rank")).filter("word is not null and word <> '' and _name is not null")
    named = found.join(known, "word").groupBy(id_col).agg(F.sort_array(F.collect_set(F.struct("_rank", "_name"))).alias("_named"))
    # a name of two ranks appears once, at its first
    return texts.join(named, id_col, "left").withColumn(out_col, F.array_distinct(F.coalesce(F.transform("_named", lambda x: x["_name"]), F.array().cast("array<string>")))).drop("_named")
