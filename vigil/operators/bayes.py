"""Multinomial naive Bayes over hashed words: fitted by grouped sums, applied by a look-up join.

A word's class is the first 16 bits of its MD5. Labels are dealt, in order of their names, to blocks of WIDTH. The model is a
table with a row a class and block: for each label of the block, by how many millionths the log probability exceeds that
of a class the label never had. Scores are sums of whole numbers, so they are the same in any order of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import shared_dir, stored
from .textindex import tokens

#: Labels in a block; what a row of the model holds, whatever the number of labels.
WIDTH = 64
#: Rows of the model, and labels, that are broadcast at once.
SENT = 1 << 16
#: Labels that a task sorts.
SORTED = 1 << 16
CLASSES, UNIT = 1 << 16, 1_000_000
#: In the place of a class: stands once in every text, so that a text meets every block.
TEXT = -1


def word_class(word: Column) -> Column:
    return F.conv(F.substring(F.md5(word), 1, 4), 16, 10).cast("int")


@dataclass
class Model:
    """`table`: `block`, `class`, `gains` (of each label); `blocks`: `block`, `labels` (`name`, `prior`, `least`: millionths of the log share of a label, and of the log probability of a class it never had), `rows` of the table."""

    table: DataFrame
    blocks: DataFrame


def train(rows: DataFrame, text_col: str, label_col: str) -> Model:
    """Learns from the rows that have a label, every label that occurs. With Laplace's one more of each class."""
    known = rows.select(F.col(label_col).cast("string").alias("label"), tokens(F.col(text_col)).alias("words")).filter("label is not null")
    shares = stored(known.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.size("words")).alias("words")), "shares")
    many, total = shares.agg(F.count("*"), F.sum("n")).first()
    dealt = shares.coalesce(1) if many <= SORTED else shares.repartitionByRange(-(-many // SORTED), "label")
    # a partition's rows are numbered from a multiple of 1 << 33 on, so a block is of one partition
    labels = stored(dealt.sortWithinPartitions("label").withColumn("at", F.monotonically_increasing_id()), "labels")
    labels = labels.select("*", F.floor(F.col("at") / WIDTH).alias("block"), F.pmod("at", F.lit(WIDTH)).cast("int").alias("place"))
    counts = known.select("label", F.explode("words").alias("w")).groupBy("label", word_class(F.col("w")).alias("class")).agg(F.count("*").alias("n"))
    gains = [F.coalesce(F.max(F.when(F.col("place") == i, millionths(F.log(F.col("n") + 1.0)))), F.lit(0).cast("long")) for i in range(min(WIDTH, many))]
    table = stored(counts.join(labels.select("label", "block", "place"), "label").groupBy("block", "class").agg((F.array(*gains) if gains else F.array().cast("array<bigint>")).alias("gains")), "bayes")
    said = F.struct("place", F.col("label").alias("name"), millionths(F.log(F.col("n") / F.lit(total or 1))).alias("prior"), millionths(-F.log(F.col("words") + F.lit(float(CLASSES)))).alias("least"))
    blocks = labels.groupBy("block").agg(F.sort_array(F.collect_list(said)).alias("labels")).join(table.groupBy("block").agg(F.count("*").alias("rows")), "block", "left")
    return Model(table, stored(blocks.select("block", "labels", F.coalesce("rows", F.lit(0)).alias("rows")), "blocks"))


def millionths(x: Column) -> Column:
    return F.round(x * UNIT).cast("long")


def classify(rows: DataFrame, model: Model, id_col: str, text_col: str) -> DataFrame:
    """`id_col`, `label` and `confidence` of every row: the label of the greatest score, ties to the first name, and its share of the probability.

    The model of a block, at most CLASSES rows of WIDTH numbers, is broadcast, and a text's sums combine before the shuffle, so what
    a task holds follows from its rows, not from their words. More labels than a block's are weighed block by block. Rows with
    one id count as one text; a text without words has the most frequent label; a model without labels gives null. Null texts count as empty.
    """
    few = model.blocks.limit(2).collect()
    if not few:
        return rows.select(id_col, F.lit(None).cast("string").alias("label"), F.lit(None).cast("double").alias("confidence"))
    if len(few) > 1:
        return _among_blocks(rows, model, id_col, text_col)
    names, prior, leasts = zip(*[(x.name, x.prior, x.least) for x in few[0].labels], strict=True)
    words = rows.select(F.col(id_col).alias("id"), F.explode_outer(tokens(F.col(text_col))).alias("w")).select("id", word_class(F.col("w")).alias("class"))
    gains = [F.when(F.col("class").isNotNull(), F.coalesce(F.get("gains", F.lit(i)), F.lit(0)) + F.lit(least)) for i, least in enumerate(leasts)]
    found = words.join(F.broadcast(model.table.select("class", "gains")), "class", "left").groupBy("id").agg(*[F.sum(g).alias(f"s{i}") for i, g in enumerate(gains)])
    score = [F.coalesce(F.col(f"s{i}"), F.lit(0)) + F.lit(p) for i, p in enumerate(prior)]
    best = F.greatest(*score) if len(score) > 1 else score[0]
    label = F.coalesce(*[F.when(s == F.col("best"), F.lit(n)) for s, n in zip(score, names, strict=True)])
    mass = sum((F.exp((s - F.col("best")) / UNIT) for s in score[1:]), F.exp((score[0] - F.col("best")) / UNIT))
    return found.withColumn("best", best).select(F.col("id").alias(id_col), label.alias("label"), F.round(1 / mass, 6).alias("confidence"))


def _among_blocks(rows: DataFrame, model: Model, id_col: str, text_col: str) -> DataFrame:
    """`classify` for any number of labels: blocks are sent in waves of SENT rows of the model, or of one block; of each wave a text keeps its best label and the mass."""
    texts = stored(rows.select(F.col(id_col).alias("id"), F.transform(tokens(F.col(text_col)), word_class).alias("classes")), "texts")
    waves, room = [], 0
    for r in model.blocks.select("block", F.greatest("rows", F.lit(WIDTH)).alias("size")).orderBy("block").toLocalIterator():
        room += r["size"]
        if not waves or room > SENT:
            waves.append([r.block, r.block])
            room = r["size"]
        waves[-1][1] = r.block
    words = texts.select("id", F.size("classes").alias("n"), F.explode(F.concat(F.array(F.lit(TEXT)), "classes")).alias("class"))
    folder = f"{shared_dir(rows.sparkSession)}/waves"
    for first, last in waves:
        part = _wave(words, model, F.col("block").between(first, last))
        part.write.mode("append").parquet(folder)
    found = _best(rows.sparkSession.read.schema(part.schema).parquet(folder))
    return found.select(F.col("id").alias(id_col), F.col("best.label").alias("label"), F.round(1 / F.col("mass"), 6).alias("confidence"))


def _wave(words: DataFrame, model: Model, wanted: Column) -> DataFrame:
    """Of each id, among some blocks: `best` (`score` and `label`), and `mass`: the sum of all labels' probabilities as parts of the best one's."""
    blocks, none = model.blocks.filter(wanted), F.array_repeat(F.lit(0).cast("long"), WIDTH)
    sent = model.table.filter(wanted).select("block", "class", "gains").unionByName(blocks.select("block", F.lit(TEXT).alias("class"), none.alias("gains")))
    sums = [F.sum(F.get("gains", F.lit(i))).alias(f"s{i}") for i in range(WIDTH)]
    n = F.sum(F.when(F.col("class") == TEXT, F.col("n"))).alias("n")
    met = words.join(F.broadcast(sent), "class").groupBy("id", "block").agg(n, *sums).join(F.broadcast(blocks.select("block", "labels")), "block")
    gained = F.array(*[f"s{i}" for i in range(WIDTH)])
    scores = F.transform("labels", lambda x: F.struct((-(x["prior"] + x["least"] * F.col("n") + F.get(F.col("gained"), x["place"]))).alias("minus"), x["name"].alias("label")))
    each = met.withColumn("gained", gained).select("id", scores.alias("scores")).withColumn("top", F.array_min("scores"))
    mass = F.aggregate("scores", F.lit(0.0), lambda a, x: a + F.exp((F.col("top")["minus"] - x["minus"]) / UNIT))
    return _best(each.select("id", F.struct((-F.col("top.minus")).alias("score"), F.col("top.label").alias("label")).alias("best"), mass.alias("mass")))


def _best(parts: DataFrame) -> DataFrame:
    """The parts of each id as one."""
    top = F.min(F.struct((-F.col("best.score")).alias("minus"), F.col("best.label").alias("label")))
    masses = F.collect_list(F.struct(F.col("best.score").alias("score"), "mass"))
    found = parts.groupBy("id").agg(top.alias("top"), masses.alias("masses"))
    mass = F.aggregate("masses", F.lit(0.0), lambda a, x: a + x["mass"] * F.exp((x["score"] + F.col("top")["minus"]) / UNIT))
    return found.select("id", F.struct((-F.col("top.minus")).alias("score"), F.col("top.label").alias("label")).alias("best"), mass.alias("mass"))
