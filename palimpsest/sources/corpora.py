"""Readers of conversation corpora and transcripts. JSON is read by Spark; only Python literals need Python."""

import ast

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays

# Names of the numbered question categories.
CATEGORIES = {1: "multi hop", 2: "temporal", 3: "open domain", 4: "single hop", 5: "adversarial"}
NOISE = r"^\s*(<|\[|Caveat:)"
LEAST_TURN, MOST_TURN = 25, 2000


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256 of files: hashed where they are."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def json_array(spark: SparkSession, path: str, schema=None, limit: int | None = None) -> DataFrame:
    """The objects of JSON arrays, one row each. With a schema, files are read in parts; finding one needs them whole."""
    if schema is not None:
        return arrays.json_array(spark, path, schema, limit)
    found = spark.read.option("multiLine", True).json(path)
    return found if limit is None else found.limit(limit)


def dialogues(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Samples with numbered sessions: turns (sample_id, session, dia_id, speaker, text, said_at) and questions with evidence
    (sample_id, question_no, question, answer, category, evidence, gold_sessions)."""
    raw = spark.read.option("multiLine", True).option("primitivesAsString", True).json(path)
    text = raw.select("sample_id", F.from_json(F.to_json("conversation"), "map<string,string>").alias("m"), "qa")
    parts = text.select("sample_id", F.explode("m").alias("key", "value"), "m").where(F.col("key").rlike(r"^session_\d+$"))
    turn = "array<struct<speaker:string,dia_id:string,text:string>>"
    turns = parts.select("sample_id", F.regexp_extract("key", r"(\d+)", 1).cast("int").alias("session"), F.col("m")[F.concat("key", F.lit("_date_time"))].alias("said_at"), F.explode(F.from_json("value", turn)).alias("t"))
    asked = raw.select("sample_id", F.posexplode("qa").alias("question_no", "q")).select("sample_id", "question_no", F.from_json(F.to_json("q"), "question string, answer string, evidence array<string>, category string, adversarial_answer string").alias("q")).where(F.size("q.evidence") > 0)
    names = F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv])
    questions = asked.select("sample_id", "question_no", "q.question", "q.answer", names[F.col("q.category").cast("int")].alias("category"), "q.evidence", F.array_distinct(F.transform("q.evidence", lambda e: F.split(e, ":")[0])).alias("gold_sessions"))
    return turns.select("sample_id", "session", "t.dia_id", "t.speaker", "t.text", "said_at"), questions


def haystacks(spark: SparkSession, path: str, per_type: int | None = None) -> tuple[DataFrame, DataFrame]:
    """One instance a question: turns (question_id, session_id, turn, key, role, content, has_answer) and questions with gold turn keys.
    per_type: the first questions of each type, in file order."""
    schema = "question_id string, question_type string, question string, answer string, question_date string, haystack_dates array<string>, haystack_session_ids array<string>, answer_session_ids array<string>, haystack_sessions array<array<struct<role:string,content:string,has_answer:boolean>>>"
    found = arrays.json_objects(spark, path)
    raw = found.select("file", "block", "nth", F.from_json("json", schema).alias("o")).select("file", "block", F.col("nth").alias("place"), "o.*")
    if per_type is not None:
        from pyspark.sql import Window

        nth = F.row_number().over(Window.partitionBy("question_type").orderBy("file", "block", "place"))
        raw = raw.withColumn("nth", nth).where(F.col("nth") <= per_type).drop("nth")
    s = raw.select("question_id", F.posexplode(F.arrays_zip("haystack_session_ids", "haystack_sessions")).alias("i", "s"))
    turns = s.select("question_id", F.col("s.haystack_session_ids").alias("session_id"), F.posexplode("s.haystack_sessions").alias("turn", "t")).select("question_id", "session_id", "turn", F.concat("session_id", F.lit("#"), F.col("turn").cast("string")).alias("key"), "t.role", "t.content", F.coalesce("t.has_answer", F.lit(False)).alias("has_answer"))
    gold = turns.where("has_answer").groupBy("question_id").agg(F.array_sort(F.collect_list("key")).alias("gold"))
    return turns, raw.select("question_id", "question_type", "question", "answer", "answer_session_ids").join(gold, "question_id", "left")


def _numbers(value) -> list[str]:
    """All whole numbers in a nested value, as text."""
    if isinstance(value, dict):
        return [n for v in value.values() for n in _numbers(v)]
    if isinstance(value, (list, tuple)):
        return [n for v in value for n in _numbers(v)]
    import re

    return re.findall(r"\d+", str(value)) if value is not None else []


def _probes(texts: pd.Series) -> pd.Series:
    """Python literals of questions by ability, as rows; a broken one gives none."""
    def one(t):
        try:
            found = ast.literal_eval(t) if isinstance(t, str) else {}
        except (ValueError, SyntaxError):
            return []
        out = []
        for ability, questions in found.items():
            for q in questions:
                ideal = [v for k, v in q.items() if k.startswith("ideal_")]
                answer = q.get("answer") or (ideal[0] if ideal else None) or q.get("rubric")
                gold = list(dict.fromkeys(_numbers(q.get("source_chat_ids", q.get("conversation_references")))))
                out.append({"ability": ability, "question": q.get("question"), "answer": None if answer is None else str(answer), "gold": gold})
        return out

    return texts.map(one)


def long_chats(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Chats in either shape (plans of batches of turns, or lists of messages): messages and probing questions."""
    raw = json_array(spark, path, "conversation_id string, chat string, probing_questions string")
    batch = "array<map<string,array<struct<batch_number:int,turns:array<array<struct<content:string,id:int,role:string>>>>>>>"
    plans = raw.select("conversation_id", F.explode(F.from_json("chat", batch)).alias("p")).select("conversation_id", F.explode("p").alias("plan", "batches")).where(F.col("batches").isNotNull())
    deep = plans.select("conversation_id", F.regexp_extract("plan", r"(\d+)", 1).cast("int").alias("plan"), F.explode("batches").alias("b")).select("conversation_id", "plan", "b.batch_number", F.explode(F.flatten("b.turns")).alias("m"))
    flat = raw.select("conversation_id", F.posexplode(F.from_json("chat", "array<array<struct<content:string,id:int,role:string>>>")).alias("batch_number", "ms")).select("conversation_id", F.lit(0).alias("plan"), "batch_number", F.explode("ms").alias("m"))
    both = deep.unionByName(flat).where("m.content IS NOT NULL")
    messages = both.select("conversation_id", "plan", "batch_number", "m.id", "m.role", F.trim(F.regexp_replace("m.content", r"->->\s*\d+(,\d+)*\s*$", "")).alias("content"))
    probes_of = F.pandas_udf(_probes, "array<struct<ability:string,question:string,answer:string,gold:array<string>>>")
    probes = raw.select("conversation_id", F.explode(probes_of("probing_questions")).alias("q")).select("conversation_id", "q.*")
    return messages, probes


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Turns that people typed, from JSON lines: (session_id, position, text). Broken lines, tool results and noise are left out."""
    lines = spark.read.text(path).withColumn("session_id", F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.jsonl)?$", 1))
    row = F.from_json("value", "type string, timestamp string, message struct<role:string,content:string>")
    parsed = lines.select("session_id", row.alias("r"), F.monotonically_increasing_id().alias("position")).where("r.type = 'user' OR r.message.role = 'user'")
    content = F.col("r.message.content")
    blocks = F.from_json(content, "array<struct<type:string,text:string>>")
    text = F.when(F.startswith(content, F.lit("[")), F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")).otherwise(content)
    kept = parsed.select("session_id", "position", F.trim(text).alias("text")).where((F.length("text") >= LEAST_TURN) & ~F.col("text").rlike(NOISE))
    return kept.withColumn("text", F.substring("text", 1, MOST_TURN))
