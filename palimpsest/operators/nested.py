"""Evaluation on nested corpora: the oldest 1/2, 1/4 ... of a corpus beside the whole of it, in one plan.

A fact at a place belongs to every prefix that is long enough, so one number says which: how many of the sizes reach its place. Statistics of all prefixes
are sums over that number, made once; a posting is repeated for each prefix that it is in, twice in all on average, as sizes halve.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .evalkit import prefix_sizes
from .fusion import DEPTH, topk
from .lexical import B, K1, asked_words, idf, query_terms, small
from .lineage import written


def placed(facts: DataFrame, order: list[str], least: int = 24) -> tuple[DataFrame, list[int]]:
    """facts with `levels`: in how many of the prefixes it is (the whole corpus is the first, the shortest prefix the last); and the sizes. Facts that
    are in none, of a corpus shorter than `least`, are left out. Keys alone are dealt by range and numbered; facts stay where they are and are
    compared with the last key of each prefix. Equal keys follow each other by edge_id."""
    sizes = prefix_sizes(facts.count(), least)
    keys = [*order, *({"edge_id"} - set(order))]
    dealt = written(facts.select(*keys).repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), "keys")
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a partition
    begin = dealt.groupBy("part").agg(F.count("*").alias("n")).select("part", before.alias("before"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*keys))
    last = dealt.join(F.broadcast(begin), "part").withColumn("place", place).where(F.col("place").isin(sizes)).agg(F.collect_list(F.struct(*keys)).alias("last"))
    levels = F.size(F.filter("last", lambda key: F.struct(*keys) <= key))
    return facts.join(F.broadcast(last)).withColumn("levels", levels).where("levels > 0").drop("last"), sizes


def statistics(postings: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(level, token, df) and (level, n_docs, avg_len) of all prefixes; level 1 is the whole corpus. postings: token, levels; facts: levels, and of how many
    facts (tf), how many of them with a text (n) and how many words in all (length) a row tells."""
    deeper = lambda *by: Window.partitionBy(*by).orderBy(F.desc("levels"))
    counts = postings.groupBy("token", "levels").agg(F.count("*").alias("n"))
    # between two numbers that occur the sum stays as it is, so each row also stands for the smaller numbers down to the next
    upto = counts.withColumn("df", F.sum("n").over(deeper("token"))).withColumn("down", F.coalesce(F.lead("levels").over(deeper("token")), F.lit(0)))
    terms = upto.select("token", "df", F.explode(F.sequence(F.col("down") + 1, F.col("levels"))).alias("level"))
    one = deeper(F.lit(1))
    sums = facts.groupBy("levels").agg(F.sum("tf").alias("facts"), F.sum("n").alias("n"), F.sum("length").alias("length"))
    every = sums.select("levels", F.sum("facts").over(one).alias("n_docs"), (F.sum("length").over(one) / F.sum("n").over(one)).alias("avg_len"), F.coalesce(F.lead("levels").over(one), F.lit(0)).alias("down"))
    return terms, every.select("n_docs", "avg_len", F.explode(F.sequence(F.col("down") + 1, F.col("levels"))).alias("level"))


def sweep(queries: DataFrame, facts: DataFrame, order: list[str], k: int = DEPTH, least: int = 24) -> DataFrame:
    """query_id, size, edge_id, score, rank: the k best facts by BM25 in each prefix, each ranked by the statistics of its own prefix. queries: query_id, text;
    facts: edge_id, fact and what order names. Texts are parted once; postings of asked tokens only are written."""
    found, sizes = placed(facts, order, least)
    if not sizes:
        return queries.sparkSession.createDataFrame([], "query_id long, size int, edge_id long, score double, rank int")
    asked = query_terms(queries.select("query_id", "text"))
    hint = small(asked, found.select("edge_id"))
    rows = asked_words(found.select("edge_id", "levels", "fact"), asked, hint)
    table = written(rows.groupBy("edge_id", "levels", "token").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"), F.sum("dl").alias("length"), F.count("dl").alias("n")), "swept")
    postings = table.where("token != ''").select("edge_id", "levels", "token", "tf", "dl")
    terms, scope = statistics(postings, table.where("token = ''"))
    each = postings.join(asked, "token").withColumn("level", F.explode(F.sequence(F.lit(1), F.col("levels"))))
    known = each.join(hint(terms), ["token", "level"]).join(F.broadcast(scope), "level")  # a row a size; where few tokens are asked, no frequent one meets in a task
    tf = F.col("tf")
    part = idf(F.col("n_docs"), F.col("df")) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.greatest(F.col("avg_len"), F.lit(1.0))))
    scores = known.groupBy("query_id", "level", "edge_id").agg(F.round(F.sum(part), 6).alias("score"))
    size = F.element_at(F.array(*(F.lit(n) for n in sizes)), F.col("level"))
    return topk(scores, ["query_id", "level"], [F.desc("score"), F.col("edge_id")], k).select("query_id", size.alias("size"), "edge_id", "score", "rank")


def arms(ranked: DataFrame, facts: DataFrame, budget: int, times: tuple[int, ...] = (1, 2, 4, 8, 16)) -> DataFrame:
    """query_id, arm, n_facts, spent: what of a ranked list fits into 1, 2, 4 ... times the budget of tokens (four characters each). Lengths are added up
    once; an arm is a prefix of the list, which ends with the first fact that does not fit."""
    upto = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    told = ranked.select("query_id", "edge_id", "rank").join(facts.select("edge_id", F.length(F.coalesce("fact", F.lit(""))).alias("chars")), "edge_id")
    spent = told.withColumn("spent", F.floor(F.sum("chars").over(upto) / 4).cast("bigint"))
    each = spent.withColumn("arm", F.explode(F.array(*(F.lit(t) for t in times))))
    fits = F.col("spent") <= budget * F.col("arm")
    return each.groupBy("query_id", "arm").agg(F.count_if(fits).alias("n_facts"), F.coalesce(F.max(F.when(fits, F.col("spent"))), F.lit(0)).alias("spent"))
