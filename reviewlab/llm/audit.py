"""Filter interaction audit: what every order of five text filters removes, and what each filter adds to the others.

The failures of a document are the bits A to E of a mask:

A  under 200 words        B  fewer distinct words than half of its words        C  over 3 % of its characters in A-Z
D  holds one of #$%&*|    E  the same text as a document with a smaller id, anywhere in the table, removed or not

A to D come from one pass over the texts, which also leaves a hash of each. E is an existential self-join: a left-semi join
on hash, exact text and smaller id. A text can only have a partner if its hash occurs twice, so the whole texts of those
rows alone are read again and joined; the side that is looked up is aggregated to one row (text, smallest id) for each
text ahead of the shuffle, so a group of copies of any size meets one row, and adaptive execution splits its other side.
The ids of E are united with those of the other failures and the bits of each id are aggregated. Counts of masks per
part (32 rows a part at most) then give every order and step by one join with the fixed table of orders.

Defined results: a null text is empty (no words: A fails, B to D do not) and equals other empty texts; rows without id
never fail E and make no other row fail it; rows that repeat id and text are documents of their own and do not fail E by
each other; a null lang is the part ``''``; a document counts as good or toxic if any of its label rows says so, rows
without id have no labels; an empty table gives no rows; columns besides ``doc_id``, ``text`` and ``lang`` are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewlab.session import control_table, durable

LETTERS = "ABCDE"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")

# The limits of the filters.
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITALS_PERCENT = 3


def _bit(letter: str) -> int:
    return 1 << LETTERS.index(letter)


def own_failures(text: Column) -> dict[str, Column]:
    """Whether a text fails A, B, C and D."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(words) < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < MIN_DISTINCT_PERCENT * F.size(words),
        "C": 100 * capitals.cast("bigint") > MAX_CAPITALS_PERCENT * F.length(text).cast("bigint"),
        "D": text.rlike("[#$%&*|]"),
    }


def _plain_rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    part = F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), part, text.alias("text"))
    return rows.withColumns({"hash": F.xxhash64("text"), "hash_2": F.xxhash64(F.lit("second"), F.col("text"))})


ID = ["doc_id", "hash", "hash_2", "part"]
"""What names a document: rows that agree in all of it fail the same filters."""


def failures(docs: DataFrame) -> DataFrame:
    """``ID`` and mask: a written row for each document with the bits of A to D. Reads the texts once."""
    bits = sum((F.when(fails, _bit(letter)).otherwise(0) for letter, fails in own_failures(F.col("text")).items()), F.lit(0))
    return durable(_plain_rows(docs).select(*ID, bits.alias("mask")))


def copies(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``ID`` of the documents that fail E. ``known`` are the ``failures`` of ``docs``."""
    seen = known.where("doc_id IS NOT NULL").groupBy("hash", "hash_2").agg(F.count("*").alias("n"))
    twice = control_table(seen.where("n > 1").select("hash", "hash_2"))
    suspects = durable(_plain_rows(docs).where("doc_id IS NOT NULL").join(twice, ["hash", "hash_2"], "left_semi"))
    # One row for each text: its smallest id stands for every smaller one. Written, so that the join can split a hot text.
    first = durable(suspects.groupBy("hash", "text").agg(F.min("doc_id").alias("first_id")))
    mine, theirs = suspects.alias("mine"), first.alias("theirs")
    same = (F.col("mine.hash") == F.col("theirs.hash")) & (F.col("mine.text") == F.col("theirs.text"))
    return mine.join(theirs, same & (F.col("theirs.first_id") < F.col("mine.doc_id")), "left_semi").select(*ID)


def masks(docs: DataFrame) -> DataFrame:
    """``ID``, mask, n: the failed filters of each document and how many rows it has."""
    own = failures(docs)
    named = own.select(*ID, "mask", F.lit(1).alias("n"))
    copied = copies(docs, own).select(*ID, F.lit(_bit("E")).alias("mask"), F.lit(0).alias("n"))
    return named.unionAll(copied).groupBy(*ID).agg(F.bit_or("mask").alias("mask"), F.sum("n").alias("n"))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents of each combination of failed filters."""
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    found = masks(docs).select("doc_id", "part", "mask", "n")
    # Rows without id stay out of the join: they have no label and would all meet in one task.
    marked = found.where("doc_id IS NOT NULL").join(marks, "doc_id", "left").select("part", "mask", "n", "good", "toxic")
    no = F.lit(None).cast("int")
    every = marked.unionByName(found.where("doc_id IS NULL").select("part", "mask", "n", no.alias("good"), no.alias("toxic")))
    sums = [F.coalesce(F.sum(F.col("n") * F.col(c)), F.lit(0)).alias(c) for c in ("good", "toxic")]
    return every.groupBy("part", "mask").agg(F.sum("n").alias("n"), *sums)


def order_steps(spark: SparkSession) -> DataFrame:
    """mask, filter_order, step, and whether a document with that mask is kept, removed, ... there: 32 x 120 x 5 rows."""
    rows = []
    for mask in range(1 << len(LETTERS)):
        for order in permutations(LETTERS):
            fails = [bool(mask & _bit(letter)) for letter in order]
            first = fails.index(True) if mask else len(order)
            for step, failed in enumerate(fails):
                rows.append((mask, "".join(order), step + 1, first > step, first == step, failed and first < step, mask == _bit(order[step])))
    schema = "mask int, filter_order string, step int, kept boolean, removed boolean, redundant boolean, unique_fails boolean"
    return spark.createDataFrame(rows, schema)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, the ``COUNTS`` and shapley for each part, each order of the filters and each step."""
    spread = mask_counts(docs, labels).join(F.broadcast(order_steps(docs.sparkSession)), "mask")

    def counted(flag: str, amount: str) -> Column:
        return F.sum(F.when(F.col(flag), F.col(amount)).otherwise(0)).cast("bigint")

    amounts = (("kept", "n"), ("removed", "n"), ("redundant", "n"), ("unique_fails", "n"), ("removed", "good"), ("removed", "toxic"))
    steps = spread.groupBy("part", "filter_order", "step").agg(*[counted(*of).alias(c) for c, of in zip(COUNTS, amounts)])
    letter = F.substring(F.col("filter_order"), F.col("step"), F.lit(1))
    shapley = F.sum("removed").over(Window.partitionBy("part", letter)).cast("bigint").alias("shapley")
    return steps.select("part", "filter_order", "step", *COUNTS, shapley)
