"""Lexical channel: statistics and BM25, and the ranker used where statistics do not apply."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import prompt_terms, tokens
from .fusion import DEPTH, topk

K1 = 1.2
B = 0.75
MIN_DOCS = 50
SMALL = 1_000_000  # rows of a few numbers


def token_table(facts: DataFrame) -> DataFrame:
    """group_id, edge_id, token, tf, dl (tokens in the fact). The counts of a fact are made inside its row, so nothing is shuffled."""
    words = facts.select("group_id", "edge_id", tokens(F.col("fact")).alias("words")).withColumn("dl", F.size("words"))
    return words.select("group_id", "edge_id", "dl", F.explode("words").alias("token")).groupBy("group_id", "edge_id", "token").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def scope_stats(facts: DataFrame) -> DataFrame:
    n = F.size(tokens(F.col("fact")))
    return facts.groupBy("group_id").agg(F.count("*").alias("n_docs"), F.avg(n).alias("avg_len"))


def term_stats(table: DataFrame) -> DataFrame:
    return table.groupBy("group_id", "token").agg(F.count("*").alias("df"))


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, group_id?, token: the distinct tokens of the prompt's terms."""
    keep = [c for c in queries.columns if c != "text"]
    return queries.select(*keep, F.explode(F.array_distinct(F.flatten(F.transform(prompt_terms(F.col("text")), tokens)))).alias("token"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def small(terms: DataFrame, facts: DataFrame, by_scope: bool = False) -> Callable[[DataFrame], DataFrame]:
    """A hint to send a table to all tasks, for tables with a row for each asked token, or for each in each scope, if there are SMALL at most; else none."""
    n = terms.select("token").distinct().count()
    n_scopes = 1 if n > SMALL or "group_id" not in facts.columns else facts.select("group_id").distinct().count()
    return F.broadcast if max(n * n_scopes, terms.count() if by_scope else 0) <= SMALL else lambda df: df


def asked_words(facts: DataFrame, terms: DataFrame, hint: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The columns of facts but the text, dl and token: a row for each word that is asked for, with repeats, and one without a word ('') for the fact itself.
    Other words leave no task, and rows are dealt by edge_id, so what is counted by fact later needs no shuffle."""
    keep = [c for c in facts.columns if c != "fact"]
    words = facts.select(*keep, tokens(F.col("fact")).alias("words")).withColumn("dl", F.size("words"))
    each = words.select(*keep, "dl", F.explode(F.concat(F.coalesce("words", F.array().cast("array<string>")), F.array(F.lit("")))).alias("token"))
    asked = terms.select("token").unionAll(terms.sparkSession.range(1).select(F.lit("").alias("token"))).distinct()
    return each.join((hint or F.broadcast)(asked), "token", "left_semi").repartition("edge_id")


def bm25_scores(queries: DataFrame, facts: DataFrame, by_scope: bool = False) -> DataFrame:
    """query_id, edge_id, score of all facts with one term of the query at least. queries: query_id, text (group_id if by_scope:
    the query asks that scope only). Texts are parted once; postings of asked tokens only go on. Where few tokens are asked, their frequencies and the
    queries go to the postings, which stay where they are."""
    terms = query_terms(queries)
    hint = small(terms, facts, by_scope)
    rows = asked_words(facts.select("group_id", "edge_id", "fact"), terms, hint)
    postings = rows.groupBy("group_id", "edge_id", "token").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"), F.sum("dl").alias("length"), F.count("dl").alias("n"))
    counts = postings.groupBy("group_id", "token").agg(F.count("*").alias("df"), F.sum("tf").alias("rows"), F.sum("length").alias("length"), F.sum("n").alias("n"))
    of_scope = lambda c: F.max(F.when(F.col("token") == "", c)).over(Window.partitionBy("group_id"))  # noqa: E731  the rows without a word are the facts
    known = counts.select("group_id", "token", "df", of_scope(F.col("rows")).alias("n_docs"), of_scope(F.col("length") / F.col("n")).alias("avg_len"))
    tf, dl, avg = F.col("tf"), F.col("dl"), F.greatest(F.col("avg_len"), F.lit(1.0))
    part = idf(F.col("n_docs"), F.col("df")) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avg))
    weighed = postings.select("group_id", "edge_id", "token", "tf", "dl").join(hint(known), ["group_id", "token"]).select("group_id", "edge_id", "token", part.alias("part"))
    on = ["group_id", "token"] if by_scope else ["token"]
    keys = ["query_id", "group_id", "edge_id"]
    return weighed.join(hint(terms), on).groupBy(*keys).agg(F.sum("part").alias("score"))


def bm25(queries: DataFrame, facts: DataFrame, k: int = DEPTH, by_scope: bool = False, only: DataFrame | None = None) -> DataFrame:
    """The k best of each query (of each query and scope, if by_scope). only: edge_id of the facts that may be ranked; statistics
    describe all of them."""
    scores = bm25_scores(queries, facts, by_scope)
    scores = scores if only is None else scores.join(only, "edge_id", "left_semi")
    by = ["query_id", "group_id"] if by_scope else ["query_id"]
    return topk(scores.withColumn("score", F.round("score", 6)), by, [F.desc("score"), F.col("edge_id")], k)


def match_count(queries: DataFrame, facts: DataFrame, k: int = DEPTH, by_scope: bool = False, only: DataFrame | None = None) -> DataFrame:
    """Ranking without statistics (as-of reads): distinct matched terms, then their frequency, then id."""
    terms = query_terms(queries)
    hint = small(terms, facts, by_scope)
    rows = asked_words((facts if only is None else facts.join(only, "edge_id", "left_semi")).select("group_id", "edge_id", "fact"), terms, hint)
    table = rows.groupBy("group_id", "edge_id", "token").agg(F.count("*").alias("tf"))
    on = ["group_id", "token"] if by_scope else ["token"]
    hits = table.join(hint(terms), on).groupBy("query_id", "edge_id").agg(F.count("*").alias("matched_terms"), F.sum("tf").alias("tf"))
    return topk(hits, ["query_id"], [F.desc("matched_terms"), F.desc("tf"), F.col("edge_id")], k)


def usable(stats: DataFrame) -> DataFrame:
    """refreshed_docs, writes_since -> usable: enough documents, and not grown past a fifth (ten at least)."""
    fresh = F.col("writes_since") <= F.greatest(0.2 * F.col("refreshed_docs"), F.lit(10.0))
    return stats.withColumn("usable", (F.col("refreshed_docs") >= MIN_DOCS) & fresh)
