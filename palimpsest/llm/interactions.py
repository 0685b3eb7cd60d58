"""Operator 12: which filter removes what, for every subset and every order of the filters.

Each document gets a mask: bit k is set where filter k fails it. Documents are counted by part, mask and labels; that is
all that the audit needs. A subset-zeta transform (one butterfly a filter, in place over the 2^k counts of a part) turns
counts by mask into counts of the documents whose mask lies within a set; the survivors of a subset S of filters are
those of the complement of S. A step of an order then is the difference between the survivors of two neighbouring
subsets, for all documents, for good and for toxic ones.

Everything is made of DataFrame expressions. Texts are read once and leave their task as a digest of 32 bytes, a part
and a mask; equal rows are counted before they are shuffled, so neither a hot part nor a text with a million copies
meets in one task. What is later grouped by text holds one row for each (text, part, labels).

Odd cases. A null text is empty; a null part is ''. Texts are identical if their SHA-256 digests are. The filter for copies
fails a row if another row has an equal text and a smaller doc_id, wherever it is and whether or not another filter removes
it; rows that repeat an id with the same text are not copies of each other, and a null id is neither smaller nor larger than
any, so its row is never a copy and makes none. A document counts as good (toxic) if one of its label rows says so at least; nulls and missing
labels say nothing. An empty table gives an empty table. Other columns, whatever their names, are left out.
"""

from __future__ import annotations

import itertools
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
LABELS = ("n", "good", "toxic")
BLANK = r"[\x20\x09-\x0D]+"


def text_masks(texts: DataFrame) -> DataFrame:
    """Replaces the column text by mask: bits of the four filters that look at one text (short, repetitive, capitals, signs)."""
    rest = [c for c in texts.columns if c != "text"]
    split = texts.select(*rest, "text", F.array_remove(F.split("text", BLANK), "").alias("words"))
    sizes = split.select(*rest, "text", F.size("words").alias("n_words"), F.size(F.array_distinct("words")).alias("n_distinct"))
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    fails = [F.col("n_words") < 200, 100 * F.col("n_distinct") < 50 * F.col("n_words"), 100 * capitals > 2 * F.length("text"), F.col("text").rlike("[#$%&*|]")]
    return sizes.select(*rest, sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0)).alias("mask"))


def marked(docs: DataFrame, part: str = "source") -> DataFrame:
    """doc_id, part, digest, mask, n: equal rows counted. The one pass over the texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    return text_masks(rows).groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n"))


def mask_counts(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """part, mask, n, good, toxic: documents by the set of filters that fail them."""
    says = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("label_id")).agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"), F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"))
    rows = marked(docs, part)
    known = rows.join(says, F.col("doc_id") == F.col("label_id"), "left").fillna(0, ["good", "toxic"])
    first = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))
    texts = known.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min(first).alias("first"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("free"))
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    kept = F.col("free") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    both = texts.withColumn("least", least).withColumn("kept", kept).select(
        "part", "good", "toxic", F.explode(F.array(F.struct(F.col("mask"), F.col("kept").alias("n")), F.struct((F.col("mask") + (1 << 4)).alias("mask"), (F.col("n") - F.col("kept")).alias("n")))).alias("x"))
    n = F.col("x.n")
    return both.where("x.n > 0").groupBy("part", "x.mask").agg(F.sum(n).alias("n"), F.sum(n * F.col("good")).alias("good"), F.sum(n * F.col("toxic")).alias("toxic"))


def survivors(counts: DataFrame, k: int = len(FILTERS)) -> DataFrame:
    """counts: part, mask, n, good, toxic -> part and, for each of the three, an array by subset of filters: what is left when they are applied."""
    full = (1 << k) - 1
    by_mask = lambda c: F.array(*(F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)) for m in range(full + 1))).alias(c)
    flat = counts.groupBy("part").agg(*(by_mask(c) for c in LABELS))

    def butterfly(c: str, bit: int) -> Column:
        return F.transform(c, lambda x, i: F.when(i.bitwiseAND(F.lit(bit)) != 0, x + F.get(F.col(c), i - bit)).otherwise(x)).alias(c)

    for b in range(k):  # one projection a filter: no expression holds another one twice
        flat = flat.select("part", *(butterfly(c, 1 << b) for c in LABELS))
    return flat.select("part", *(F.reverse(c).alias(c) for c in LABELS))  # position S holds the masks within the complement of S


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: every order of the filters."""
    k = len(filters)
    full = (1 << k) - 1
    orders = F.array(*(F.lit("".join(p)) for p in itertools.permutations(filters)))
    at = lambda c, s: F.get(F.col(c), s)
    steps = survivors(counts, k).withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    # bit of the filter of a step, and the bits of those before it
    bit = lambda j: F.element_at(F.array(*(F.lit(1 << b) for b in range(k))), F.instr(F.lit(filters), F.substring("filter_order", j, 1)))
    each = steps.withColumn("bits", F.array(*(bit(j) for j in range(1, k + 1))))
    each = each.withColumn("bit", F.element_at("bits", F.col("step"))).withColumn("before", F.aggregate(F.slice("bits", F.lit(1), F.col("step") - 1), F.lit(0), lambda a, x: a + x))
    each = each.withColumn("after", F.col("before") + F.col("bit"))
    alone = F.lit(full) - F.col("bit")  # all other filters
    subsets = F.filter(F.sequence(F.lit(0), F.lit(full)), lambda s: s.bitwiseAND(F.col("bit")) == 0)
    orders_of = F.array(*(F.lit(factorial(bin(s).count("1")) * factorial(max(k - 1 - bin(s).count("1"), 0))) for s in range(full + 1)))  # orders in which exactly s comes before
    shapley = F.aggregate(subsets, F.lit(0).cast("bigint"), lambda a, s: a + F.get(orders_of, s) * (at("n", s) - at("n", s + F.col("bit"))))
    removed = at("n", F.col("before")) - at("n", F.col("after"))
    return each.select(
        "part", "filter_order", "step", at("n", F.col("after")).alias("kept"), removed.alias("removed"), (at("n", F.lit(0)) - at("n", F.col("bit")) - removed).alias("redundant"),
        (at("n", alone) - at("n", F.lit(full))).alias("unique_fails"), (at("good", F.col("before")) - at("good", F.col("after"))).alias("good_lost"),
        (at("toxic", F.col("before")) - at("toxic", F.col("after"))).alias("toxic_lost"), shapley.alias("shapley"),
    )


def filter_interactions(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    return audit(mask_counts(docs, labels, part))
