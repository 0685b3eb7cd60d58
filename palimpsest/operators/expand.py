"""Expansion of fused lists along the graph. A condition on either end of an edge is two equi-joins, never an OR."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fusion import DEPTH, topk
from .lineage import written

SEEDS = 5


def endpoints(edges: DataFrame) -> DataFrame:
    """edge_id, node: two rows an edge (one for a loop)."""
    return edges.select("edge_id", F.explode(F.array_distinct(F.array("start_id", "end_id"))).alias("node"))


def _first_ends(edges: DataFrame, n: int) -> DataFrame:
    """endpoints of the first n edges of each node by id."""
    nth = F.dense_rank().over(Window.partitionBy("node").orderBy("edge_id"))
    return endpoints(edges).withColumn("nth", nth).where(F.col("nth") <= n).select("edge_id", "node").distinct()


def _touched(seeds: DataFrame, edges: DataFrame, k: int) -> tuple[DataFrame, DataFrame, int]:
    """seeds (written, so that ranking happens once); query_id, node, seed_rank of their ends; and how many edges of a node can matter: of those that a node
    gives to a query one precedes another by its id, so behind k and the query's seeds none is among the first k."""
    seeds = written(seeds.select("query_id", "edge_id", "rank"), "seeds")
    most = seeds.groupBy("query_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    return seeds, seeds.join(endpoints(edges), "edge_id").groupBy("query_id", "node").agg(F.min("rank").alias("seed_rank")), k + most


def structural_hop(seeds: DataFrame, edges: DataFrame, k: int = DEPTH) -> DataFrame:
    """Facts that share a node with a seed fact (query_id, edge_id, rank), seeds left out, by best seed rank, then id."""
    seeds, touched, few = _touched(seeds, edges, k)
    near = touched.join(_first_ends(edges, few), "node").groupBy("query_id", "edge_id").agg(F.min("seed_rank").alias("seed_rank"))
    return topk(near.join(seeds.select("query_id", "edge_id"), ["query_id", "edge_id"], "left_anti"), ["query_id"], [F.col("seed_rank"), F.col("edge_id")], k)


def authored_hop(seeds: DataFrame, edges: DataFrame, k: int = DEPTH) -> DataFrame:
    """Tier 1: edges with a causal hint at a seed's end; tier 2: edges at the far end of those. By tier, seed rank, id. Far ends are found among the
    distinct pairs of nodes that hinted edges join, so neither tier has a row for each edge of a node that many share."""
    seeds, touched, few = _touched(seeds, edges, k)
    hinted = edges.where(F.col("causal_hint").isNotNull())
    one = touched.join(_first_ends(hinted, few), "node").groupBy("query_id", "edge_id").agg(F.min("seed_rank").alias("seed_rank"))
    ends = endpoints(hinted).groupBy("edge_id").agg(F.collect_set("node").alias("ends"))
    joined = ends.select(F.explode("ends").alias("node"), "ends").select("node", F.explode("ends").alias("other")).where("node != other").distinct()
    other = touched.join(joined, "node").groupBy("query_id", F.col("other").alias("node")).agg(F.min("seed_rank").alias("seed_rank"))
    far = other.join(touched.select("query_id", "node"), ["query_id", "node"], "left_anti")
    two = far.join(_first_ends(edges, few), "node").groupBy("query_id", "edge_id").agg(F.min("seed_rank").alias("seed_rank"))
    both = one.withColumn("tier", F.lit(1)).unionByName(two.withColumn("tier", F.lit(2)))
    best = both.groupBy("query_id", "edge_id").agg(F.min(F.struct("tier", "seed_rank")).alias("s")).select("query_id", "edge_id", "s.tier", "s.seed_rank")
    return topk(best.join(seeds.select("query_id", "edge_id"), ["query_id", "edge_id"], "left_anti"), ["query_id"], [F.col("tier"), F.col("seed_rank"), F.col("edge_id")], k)


GRAM = 3


def grams(df: DataFrame, text: str, size: int = GRAM, key: str | None = None) -> DataFrame:
    """text (or key in its stead) and gram: the distinct pieces of `size` characters of each text, in time linear in its length (its characters are parted once, in a
    column of their own)."""
    key = key or text
    signs = df.select(key, F.split(text, "").alias("signs"))
    piece = lambda i: F.concat(*(F.get("signs", i + k) for k in range(size)))
    return signs.where(F.size("signs") >= size).select(key, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("signs") - size), piece))).alias("gram"))


def _holding(texts: DataFrame, tokens: DataFrame) -> DataFrame:
    """text, token: which distinct texts hold which tokens (both not empty). Postings carry a text's digest; its characters travel once, to the tokens
    that may be in it."""
    sized = tokens.withColumn("size", F.least(F.length("token"), F.lit(GRAM)))
    known = texts.withColumn("id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    found = None
    for size in range(1, GRAM + 1):  # columns of one size only meet terms of that size; a size that no term has costs one scan of the texts
        asked = grams(sized.where(F.col("size") == size).select("token"), "token", size)
        held = grams(known, "text", size, "id").join(asked.select("gram").distinct(), "gram", "left_semi")
        often = held.groupBy("gram").agg(F.count("*").alias("often"))
        # a term with a piece that no text has is held by none: its rarest piece is missing from the counts
        rarest = asked.join(often, "gram", "left").groupBy("token").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "gram")).alias("r")).where("r.often > 0").select("token", F.col("r.gram").alias("gram"))
        hits = held.join(rarest, "gram").select("id", "token")
        found = hits if found is None else found.unionAll(hits)
    return known.join(found, "id").where(F.contains("text", F.col("token"))).select("text", "token")


def held_by(names: DataFrame, terms: DataFrame) -> DataFrame:
    """id, token: as names_holding, with the SHA-256 digest of a name instead of the name.

    A term without white space lies within one word of a name that holds it: so the names' distinct words are searched, each once however many names
    have it, and a name costs as many rows as it has distinct words with terms in them. Other terms are searched in whole names. Both by postings of
    pieces of three characters (of one or two for terms that are shorter), each term at its rarest piece only; what meets there is compared as a whole."""
    tokens = terms.select("token").where("token != ''").distinct()
    id_of = F.unhex(F.sha2(F.col("name").cast("binary"), 256))
    words = names.where("name != ''").select(id_of.alias("id"), F.split("name", r"\s+").alias("words"))  # digests before words, once a name
    words = words.select("id", F.explode(F.array_distinct("words")).alias("text"))
    plain, spaced = (tokens.where(F.col("token").rlike(r"\s") == with_space) for with_space in (False, True))
    within = _holding(written(words.select("text").where("text != ''").distinct(), "words"), plain)
    within = written(within, "within")  # so its size is known, and the words of all names stay where they are if it is small
    found = words.join(within, "text").select("id", "token").distinct()
    if spaced.isEmpty():
        return found
    whole = _holding(names.where("name != ''").select(F.col("name").alias("text")).distinct(), spaced)
    return found.unionAll(whole.select(F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("id"), "token"))


def names_holding(names: DataFrame, terms: DataFrame) -> DataFrame:
    """name, token: which of the distinct names (column name, lower case) holds which of the distinct terms (token)."""
    known = names.select("name").where("name != ''").distinct().withColumn("id", F.unhex(F.sha2(F.col("name").cast("binary"), 256)))
    return known.join(held_by(names, terms), "id").select("name", "token")


def needs_expansion(terms: DataFrame, nodes: DataFrame, edges: DataFrame, most: int = 8) -> DataFrame:
    """query_id, n_named, n_linked, expand: two or more nodes are named by a query of two terms at least, and no live edge joins any two
    of the first `most` of them. terms: query_id, token (and group_id, where a query asks one scope: nodes and edges need it then); a term
    names a node when the node's name holds it."""
    scoped = ["group_id"] if "group_id" in terms.columns else []
    known = nodes.withColumn("name", F.lower("name"))
    asked = terms.select("query_id", *scoped, "token").distinct()
    enough = asked.groupBy("query_id").agg(F.count_distinct("token").alias("n_terms")).where("n_terms >= 2").select("query_id")
    hits = asked.join(enough, "query_id", "left_semi").join(names_holding(known, asked), "token").join(known.select("node", "name", *scoped), ["name", *scoped])
    named = topk(hits.select("query_id", *scoped, "node").distinct(), ["query_id"], [F.col("node")], most).select("query_id", *scoped, "node")
    count = named.groupBy("query_id").agg(F.count("*").alias("n_named"))
    start = named.join(edges.select(F.col("start_id").alias("node"), "end_id", "edge_id", *scoped), ["node", *scoped]).select("query_id", "edge_id", F.col("end_id").alias("other"))
    linked = start.join(named.select("query_id", F.col("node").alias("other")), ["query_id", "other"]).groupBy("query_id").agg(F.countDistinct("edge_id").alias("n_linked"))
    out = count.join(linked, "query_id", "left").na.fill(0, ["n_linked"])
    return out.withColumn("expand", (F.col("n_named") >= 2) & (F.col("n_linked") == 0))
