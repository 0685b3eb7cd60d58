"""Evaluation of retrieval: cases, metrics, intervals, agreement, calibration."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fusion import topk
from .lineage import written

DEPTHS = (1, 5, 10, 20, 30)
THRESHOLDS = [0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.90]
CHUNK = 1100


def cases(facts: DataFrame) -> DataFrame:
    """Three queries for each fact (edge_id, source, target, fact): both names, one name, and the fact's words without the names."""
    named = facts.where((F.col("source") != F.col("target")) & (F.trim("source") != "") & (F.trim("target") != ""))
    bare = F.trim(F.regexp_replace(F.replace(F.replace(F.lower("fact"), F.lower("source"), F.lit(" ")), F.lower("target"), F.lit(" ")), r"\s+", " "))
    prose = F.array_join(F.slice(F.split(bare, " "), 1, 14), " ")
    shapes = F.array(
        F.struct(F.lit("entity_pair").alias("shape"), F.concat_ws(" ", "source", "target").alias("query")), F.struct(F.lit("entity_single").alias("shape"), F.col("source").alias("query")), F.struct(F.lit("prose").alias("shape"), prose.alias("query"))
    )
    return named.select("edge_id", F.explode(shapes).alias("c")).select("edge_id", "c.shape", "c.query").where("query != ''")


def triangles(links: DataFrame) -> DataFrame:
    """x, y, z: every three nodes that are all linked, once. links: a, b, each pair of nodes once, a != b. A link leads from the end with fewer
    links to the other, so a node has about the square root of all links going out at most, and only these are paired."""
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("d"))
    ranked = links.join(degree.select(F.col("node").alias("a"), F.col("d").alias("da")), "a").join(degree.select(F.col("node").alias("b"), F.col("d").alias("db")), "b")
    first = F.struct("da", "a") < F.struct(F.col("db").alias("da"), F.col("b").alias("a"))
    out = ranked.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("low"), F.when(first, F.struct(F.col("db").alias("d"), F.col("b").alias("n"))).otherwise(F.struct(F.col("da").alias("d"), F.col("a").alias("n"))).alias("high"))
    wedges = out.select("low", F.col("high").alias("p")).join(out.select("low", F.col("high").alias("q")), "low").where(F.col("p") < F.col("q"))
    return wedges.join(out.select(F.col("low").alias("pn"), F.col("high.n").alias("qn")), (F.col("p.n") == F.col("pn")) & (F.col("q.n") == F.col("qn"))).select(F.col("low").alias("x"), F.col("pn").alias("y"), F.col("qn").alias("z"))


def _arms(edges: DataFrame) -> DataFrame:
    return edges.select("edge_id", F.col("start_id").alias("hub"), F.col("end_id").alias("far")).unionAll(edges.select("edge_id", F.col("end_id").alias("hub"), F.col("start_id").alias("far")))


def multihop_cases(edges: DataFrame, most: int = 6) -> DataFrame:
    """hub, a, b: pairs of edges that meet in a node while their far ends are no neighbours (nor the same); the first `most` of a hub, by edge ids.

    Tried first are the pairs of a hub's first edge with the next 2 * most, or all pairs of a hub that has not more than most + 1 edges: an equi-join says which
    far ends are neighbours. These come before all other pairs of the hub, so hubs that have `most` cases there, or no other pairs, are done. For the rest
    all pairs are decided by _cases_by_triangles, along with links among those hubs and their neighbours only."""
    real = written(edges.where("start_id != end_id").select("edge_id", "start_id", "end_id"), "links")
    few = topk(_arms(real), ["hub"], [F.col("edge_id"), F.col("far")], 2 * most + 1, "nth")
    first = written(few.groupBy("hub").agg(F.array_sort(F.collect_list(F.struct("nth", "edge_id", "far"))).alias("arms")).where(F.size("arms") > 1), "arms")
    left = first.select("hub", "arms", F.explode("arms").alias("x")).where((F.col("x.nth") == 1) | (F.size("arms") <= most + 1))
    tried = left.select("hub", "x", F.explode(F.filter("arms", lambda y: y["nth"] > F.col("x.nth"))).alias("y")).where("x.far != y.far")
    ends = tried.select("hub", "x", "y", F.least("x.far", "y.far").alias("low"), F.greatest("x.far", "y.far").alias("high"))
    met = real.select(F.least("start_id", "end_id").alias("low"), F.greatest("start_id", "end_id").alias("high"))
    apart = ends.join(met, ["low", "high"], "left_anti").select("hub", F.col("x.edge_id").alias("a"), F.col("y.edge_id").alias("b"), F.col("x.nth").alias("i"), F.col("y.nth").alias("j"))
    found = written(topk(apart, ["hub"], [F.col("i"), F.col("j")], most, "k").select("hub", "a", "b"), "cases")
    enough = found.groupBy("hub").agg(F.count("*").alias("n")).where(F.col("n") == most)
    rest = written(first.where(F.size("arms") > most + 1).select("hub").join(enough, "hub", "left_anti"), "rest")
    if rest.isEmpty():
        return found
    return found.join(rest, "hub", "left_anti").unionByName(_cases_by_triangles(real, rest, most))


def _cases_by_triangles(real: DataFrame, hubs: DataFrame, most: int) -> DataFrame:
    """The cases of these hubs (hub), whatever edges they have. real: edges without loops.

    A hub's edges are numbered. Which later edges an edge can't be paired with is known from the triangles at the hub and from parallel edges;
    its first `most` partners are among as many more numbers behind its own, so no hub gives all its pairs, and none is left out."""
    arms = _arms(real).join(hubs, "hub", "left_semi")
    close = written(arms.select(F.col("far").alias("node")).unionAll(hubs.select(F.col("hub").alias("node"))).distinct(), "close")
    near = real.join(close.select(F.col("node").alias("start_id")), "start_id", "left_semi").join(close.select(F.col("node").alias("end_id")), "end_id", "left_semi")
    hub = Window.partitionBy("hub")
    arms = arms.withColumn("nth", F.row_number().over(hub.orderBy("edge_id", "far"))).withColumn("n", F.count("*").over(hub))
    links = near.select(F.least("start_id", "end_id").alias("a"), F.greatest("start_id", "end_id").alias("b")).distinct()
    corners = [("x", "y", "z"), ("y", "z", "x"), ("z", "x", "y")]
    closed = triangles(links).select(F.explode(F.array(*(F.struct(F.col(h).alias("hub"), F.col(p).alias("far"), F.col(q).alias("other")) for h, a, b in corners for p, q in ((a, b), (b, a))))).alias("t")).select("t.*").join(hubs, "hub", "left_semi")
    parallel = arms.groupBy("hub", "far").agg(F.count("*").alias("k")).where("k > 1").select("hub", "far", F.col("far").alias("other"))
    later = arms.select("hub", F.col("far").alias("other"), F.col("nth").alias("later"))
    barred = arms.join(closed.unionAll(parallel), ["hub", "far"]).join(later, ["hub", "other"]).where("later > nth").groupBy("hub", "nth").agg(F.collect_set("later").alias("barred"))
    every = arms.join(barred, ["hub", "nth"], "left").withColumn("barred", F.coalesce("barred", F.array().cast("array<int>"))).where("nth < n")
    reach = F.least(F.col("n"), F.col("nth") + F.size("barred") + most).cast("int")
    partners = every.select("hub", F.col("edge_id").alias("a"), "nth", F.explode(F.slice(F.array_except(F.sequence(F.col("nth") + 1, reach), "barred"), 1, most)).alias("later"))
    few = partners.withColumn("k", F.row_number().over(Window.partitionBy("hub").orderBy("nth", "later"))).where(F.col("k") <= most)
    return few.join(arms.select("hub", F.col("nth").alias("later"), F.col("edge_id").alias("b")), ["hub", "later"]).select("hub", "a", "b")


def metrics(ranked: DataFrame, gold: DataFrame, depths: tuple[int, ...] = DEPTHS) -> DataFrame:
    """Each query of gold (query_id, edge_id): recall and hit at each depth, reciprocal rank of the first relevant fact. Queries that
    found nothing count with zeros."""
    hits = gold.join(ranked.select("query_id", "edge_id", "rank"), ["query_id", "edge_id"], "left")
    aggs = [F.count("*").alias("n_gold"), F.coalesce(F.round(1 / F.min("rank"), 6), F.lit(0.0)).alias("rr")]
    for k in depths:
        found = F.sum((F.coalesce(F.col("rank"), F.lit(10**9)) <= k).cast("int"))
        aggs += [F.round(found / F.count("*"), 6).alias(f"recall_{k}"), (found > 0).cast("int").alias(f"hit_{k}")]
    return hits.groupBy("query_id").agg(*aggs)


def means(scored: DataFrame, category: str | None = None) -> DataFrame:
    """Null-skipping means over all and by category ('all' for all), in one pass by rollup."""
    values = [c for c in scored.columns if c not in ("query_id", category)]
    aggs = [F.count("*").alias("n"), *[F.round(F.avg(c), 9).alias(c) for c in values]]
    if category is None:
        return scored.agg(*aggs)
    return scored.rollup(category).agg(F.grouping(category).alias("total"), *aggs).withColumn(category, F.when(F.col("total") == 1, "all").otherwise(F.col(category))).drop("total")


def bootstrap(paired: DataFrame, resamples: int = 5000, seed: int = 7) -> DataFrame:
    """One row: mean difference, its 2.5 and 97.5 percentiles over resamples, and whether 0 lies outside. paired: case_no (0 ..
    n-1), diff. Draw j of resample r is case md5(seed:r:j) mod n, so any engine finds the same numbers. What is drawn is a set of
    cases, so paired is one row a case and small; the draws are made by range and equi-join."""
    spark = paired.sparkSession
    n = paired.count()
    if not n:
        return spark.createDataFrame([], "n bigint, mean_diff double, low double, high double, significant boolean")
    draws = spark.range(resamples * n).select(F.expr(f"id div {n}").alias("r"), (F.col("id") % n).alias("j"))
    pick = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col("r").cast("string"), F.col("j").cast("string")).cast("binary")), 1, 8), 16, 10).cast("bigint") % n
    sample = draws.withColumn("case_no", pick).join(paired, "case_no").groupBy("r").agg(F.avg("diff").alias("m"))
    ci = sample.agg(F.expr("percentile(m, 0.025)").alias("low"), F.expr("percentile(m, 0.975)").alias("high"))
    total = paired.agg(F.count("*").alias("n"), F.avg("diff").alias("mean_diff"))
    return total.join(F.broadcast(ci)).select("n", F.round("mean_diff", 6).alias("mean_diff"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), ((F.col("low") > 0) | (F.col("high") < 0)).alias("significant"))


def kappa(pairs: DataFrame) -> DataFrame:
    """Cohen's kappa of two judges (a, b: 0/1) over what both judged."""
    one = pairs.agg(F.count("*").alias("n"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("observed"), F.avg("a").alias("pa"), F.avg("b").alias("pb"))
    chance = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return one.withColumn("chance", chance).select("n", F.round("observed", 6).alias("observed"), F.round("chance", 6).alias("chance"), F.round(F.when(F.col("chance") < 1, (F.col("observed") - F.col("chance")) / (1 - F.col("chance"))), 6).alias("kappa"))


def auc(scores: DataFrame) -> DataFrame:
    """Mann-Whitney from (label 0/1, score), ties by half. Counts by distinct score first: the window runs over those."""
    by = scores.groupBy("score").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("q"))
    below = F.coalesce(F.sum("q").over(Window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = by.withColumn("won", F.col("p") * (below + F.col("q") / 2))
    return won.agg(F.sum("p").cast("bigint").alias("positives"), F.sum("q").cast("bigint").alias("negatives"), F.round(F.sum("won") / (F.sum("p") * F.sum("q")), 6).alias("auc"))


def operating_points(scores: DataFrame, thresholds: list[float] | None = None) -> DataFrame:
    """threshold, reviews, recall, precision."""
    rows = scores.select("label", F.explode(F.filter(F.array(*[F.lit(t) for t in thresholds or THRESHOLDS]), lambda t: t <= F.col("score"))).alias("threshold"))
    total = scores.agg(F.sum("label").alias("total"))
    got = rows.groupBy("threshold").agg(F.count("*").alias("reviews"), F.sum("label").alias("found")).join(F.broadcast(total))
    return got.select("threshold", "reviews", F.round(F.col("found") / F.col("total"), 6).alias("recall"), F.round(F.col("found") / F.col("reviews"), 6).alias("precision"))


def pool(lists: DataFrame, judged: DataFrame) -> DataFrame:
    """query_id, edge_id that some configuration returned and nobody judged, in an order that tells nothing."""
    todo = lists.select("query_id", "edge_id").distinct().join(judged.select("query_id", "edge_id"), ["query_id", "edge_id"], "left_anti")
    key = F.md5(F.concat_ws(":", F.col("query_id").cast("string"), F.col("edge_id").cast("string")).cast("binary"))
    return todo.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(key)))


def precision_recall(ranked: DataFrame, judgements: DataFrame, k: int = 10) -> DataFrame:
    """By configuration: P@k, R@k and MRR over the questions with a relevant fact. ranked: configuration, query_id, edge_id, rank."""
    good = judgements.where("relevant = 1").select("query_id", "edge_id")
    need = good.groupBy("query_id").agg(F.count("*").alias("need"))
    every = ranked.select("configuration").distinct().join(F.broadcast(need))
    hit = ranked.where(F.col("rank") <= k).join(good, ["query_id", "edge_id"]).groupBy("configuration", "query_id").agg(F.count("*").alias("got"), F.min("rank").alias("first"))
    each = every.join(hit, ["configuration", "query_id"], "left").na.fill(0, ["got"])
    return each.groupBy("configuration").agg(F.count("*").alias("questions"), F.round(F.avg(F.col("got") / k), 6).alias("precision"), F.round(F.avg(F.col("got") / F.col("need")), 6).alias("recall"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def prefix_sizes(n: int, least: int = 24) -> list[int]:
    """n, n/2, n/4 ... down to `least`."""
    out = []
    while n >= least:
        out.append(n)
        n //= 2
    return out


def context_saving(answers: DataFrame, facts: DataFrame) -> DataFrame:
    """One row: mean tokens of an answer against all facts. answers: query_id, chars."""
    whole = facts.agg(F.floor(F.sum(F.length("fact")) / 4).alias("whole"))
    mean = answers.agg(F.avg(F.floor(F.col("chars") / 4)).alias("mean_tokens"))
    return mean.join(F.broadcast(whole)).select(F.round("mean_tokens", 6).alias("mean_tokens"), F.col("whole").cast("bigint").alias("whole"), F.round(1 - F.col("mean_tokens") / F.col("whole"), 6).alias("saving"))


def split_text(text: str, size: int = CHUNK) -> list[str]:
    """Pieces of at most `size` characters. A piece ends behind the last paragraph or sentence end that lies in the second half of what fits, else behind
    the last space there, else where nothing more fits; white space at a cut goes. A text that fits is one piece as it is, an empty
    one too. The ends and spaces of the text are listed once and looked up by position, so the time is linear."""
    if len(text) <= size:
        return [text]
    stops, spaces = ([m.start() for m in re.finditer(p, text)] for p in (r"(?=\n\n|\. )", " "))
    pieces, begin, end = [], 0, len(text)
    while end - begin > size:
        stop = stops[bisect_right(stops, begin + size - 2) - 1] + 2 if stops and stops[0] <= begin + size - 2 else 0
        space = spaces[bisect_left(spaces, begin + size) - 1] + 1 if spaces and spaces[0] < begin + size else 0
        half = begin + size // 2
        cut = stop if stop >= max(half, begin + 1) else space if space - 1 > half else begin + size
        pieces.append(text[begin:cut].strip())
        begin = cut
        while begin < end and text[begin].isspace():
            begin += 1
        while end > begin and text[end - 1].isspace():
            end -= 1
    return [*pieces, text[begin:end]] if begin < end else pieces


def chunks(texts: DataFrame, size: int = CHUNK) -> DataFrame:
    """id, chunk_no, chunk."""
    @F.pandas_udf("array<string>")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda t: split_text(t or "", size))

    return texts.select("id", F.posexplode(cut("text")).alias("chunk_no", "chunk"))


ANSWER_MIN_WORDS = 2
# Words that are no content of an answer.
ANSWER_STOPWORDS = (
    "a an the and or but if of in on at to for from by with about as is are was were be been being do does did have has had will would can could "
    "should it its this that these those he she they them his her their there here what when where who whom which how why"
).split()


def content_words(text: Column) -> Column:
    """Distinct runs of a-z and digits of a text, stop words aside."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), 1)), F.array(*[F.lit(w) for w in ANSWER_STOPWORDS]))


def external_scores(questions: DataFrame, returned: DataFrame, sessions: DataFrame, depths: tuple[int, ...] = DEPTHS, least: int = ANSWER_MIN_WORDS) -> DataFrame:
    """For each question (query_id, answer, gold: array of turns): rr, and at each depth recall, hit, session (share of the gold
    sessions met) and answer_words (share of the answer's content words in the facts), with the share of facts that have a source.
    returned: query_id, rank, fact, turns (array of source turns); sessions: turn, session. Figures that need gold are null where
    there is none; answer_words is null for answers of fewer than `least` content words."""
    asked = questions.select("query_id", F.coalesce("gold", F.array().cast("array<string>")).alias("gold"), content_words(F.col("answer")).alias("wanted"))
    gold = asked.select("query_id", F.explode("gold").alias("turn")).distinct()
    gold_sessions = gold.join(sessions, "turn").select("query_id", "session").distinct()
    need = gold.groupBy("query_id").agg(F.count("*").alias("n_gold"))
    need_sessions = gold_sessions.groupBy("query_id").agg(F.count("*").alias("n_sessions"))
    turns = returned.select("query_id", "rank", F.explode("turns").alias("turn"))
    met = turns.join(gold, ["query_id", "turn"]).groupBy("query_id", "turn").agg(F.min("rank").alias("first"))
    seen = turns.join(sessions, "turn").join(gold_sessions, ["query_id", "session"]).groupBy("query_id", "session").agg(F.min("rank").alias("first"))
    within = lambda k: F.sum((F.col("first") <= k).cast("int"))
    hits = met.groupBy("query_id").agg(F.min("first").alias("first"), *[within(k).alias(f"t{k}") for k in depths])
    places = seen.groupBy("query_id").agg(*[within(k).alias(f"s{k}") for k in depths])
    words = returned.select("query_id", "rank", F.explode(content_words(F.col("fact"))).alias("word")).groupBy("query_id", "word").agg(F.min("rank").alias("first"))
    told = asked.select("query_id", F.explode("wanted").alias("word")).join(words, ["query_id", "word"]).groupBy("query_id").agg(*[within(k).alias(f"w{k}") for k in depths])
    rate = returned.groupBy("query_id").agg(F.count("*").alias("returned"), F.sum(F.length(F.coalesce("fact", F.lit("")))).alias("sum_chars"), F.avg((F.size("turns") > 0).cast("double")).alias("rate"))
    row = asked
    for part in (need, need_sessions, hits, places, told, rate):
        row = row.join(part, "query_id", "left")
    known, n = F.size("gold") > 0, F.size("wanted")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = [F.when(known, F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6)).alias("rr")]
    for k in depths:
        out += [F.when(known, F.round(zero(f"t{k}") / F.col("n_gold"), 6)).alias(f"recall_{k}"), F.when(known, (zero(f"t{k}") > 0).cast("double")).alias(f"hit_{k}")]
        out += [F.when(known, F.coalesce(F.round(zero(f"s{k}") / F.col("n_sessions"), 6), F.lit(0.0))).alias(f"session_{k}"), F.when(n >= least, F.round(zero(f"w{k}") / n, 6)).alias(f"answer_words_{k}")]
    return row.select("query_id", *out, zero("returned").cast("bigint").alias("returned"), F.round("rate", 6).alias("attribution_rate"))


def coverage(facts: DataFrame, questions: DataFrame, judgements: DataFrame, judged_by: str) -> DataFrame:
    """By scope: live facts, opened questions, what this judge judged, and whether that is all. facts: group_id, t_invalid; questions:
    query_id, group_id, opened_at; judgements: query_id, edge_id, judged_by."""
    active = facts.where("t_invalid IS NULL").groupBy("group_id").agg(F.count("*").alias("active_facts"))
    opened = questions.where("opened_at IS NOT NULL").groupBy("group_id").agg(F.count("*").alias("questions"))
    judged = judgements.where(F.col("judged_by") == judged_by).select("query_id", "edge_id").distinct().join(questions.select("query_id", "group_id"), "query_id").groupBy("group_id").agg(F.count("*").alias("judged"))
    row = active.join(opened, "group_id", "full").join(judged, "group_id", "full").na.fill(0, ["active_facts", "questions", "judged"])
    row = row.withColumn("possible", F.col("active_facts") * F.col("questions"))
    return row.withColumn("complete", (F.col("possible") > 0) & (F.col("judged") >= F.col("possible")))


def todo_scopes(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """group_id, action of a run that goes on where it stopped: 'skip' where a scope holds as many facts as expected (group_id, n),
    'ingest' where it holds none, else 'clear' first."""
    j = expected.join(stored.select("group_id", F.col("n").alias("have")), "group_id", "left").na.fill(0, ["have"])
    return j.select("group_id", F.when(F.col("have") == F.col("n"), "skip").when(F.col("have") == 0, "ingest").otherwise("clear").alias("action"))
