"""Readers. A missing path gives an empty DataFrame where a store may not have been written yet; unreadable rows are kept
apart, never dropped in silence."""

from __future__ import annotations

import json
import os

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.operators import book as B
from tracelode.operators import nested

EVALUATOR = r"evaluator_(\d+)\.json$"
SPEECH = "is_speech boolean, text string, voice_name string, stability double, similarity_boost double, style double, duration double, transitions array<struct<name:string,params:map<string,string>>>"
CASES = "test_cases array<struct<result:string,state_oracle:string,program_info:string,program:string>>"
TENSOR = "`__tensor__` boolean, shape array<int>, dtype string, data_b64 string"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(p)
    return found is not None and len(found) > 0


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line; lines that can't be read are in _corrupt."""
    return spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def parquet(spark: SparkSession, path: str, order: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.orderBy(F.col(order).cast("int")) if order else df


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of each file."""
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.col("value").alias("text"))


def evaluators(spark: SparkSession, folder: str) -> DataFrame:
    """(eval_id, case_no, result, state_oracle, program_info, program) of evaluator_<n>.json files, whatever the nested
    values look like: they stay JSON text."""
    files = spark.read.text(os.path.join(folder, "*.json"), wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), EVALUATOR, 1).alias("n"), "value")
    parsed = files.where("n <> ''").select(F.col("n").cast("int").alias("eval_id"), F.from_json("value", CASES).alias("v"))
    return parsed.select("eval_id", F.posexplode("v.test_cases").alias("case_no", "c")).select("eval_id", "case_no", "c.*")


def indices(spark: SparkSession, folder: str) -> DataFrame:
    """(eval_id) of the evaluator files of a folder, sorted; none if it doesn't exist."""
    if not _exists(spark, os.path.join(folder, "*.json")):
        return spark.createDataFrame([], "eval_id int")
    names = spark.read.format("binaryFile").load(os.path.join(folder, "*.json")).select(F.regexp_extract("path", EVALUATOR, 1).alias("n"))
    return names.where("n <> ''").select(F.col("n").cast("int").alias("eval_id")).orderBy("eval_id")


def summaries(spark: SparkSession, folder: str) -> DataFrame:
    """(id, summary) of JSON files <n>.json: the id inside, else the file's number; blank summaries, unreadable files and
    other names are left out."""
    files = spark.read.text(os.path.join(folder, "*.json"), wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)\.json$", 1).alias("stem"), F.from_json("value", "id string, summary string").alias("v"))
    rows = files.where("stem <> ''").select(F.coalesce(F.col("v.id").try_cast("int"), F.col("stem").cast("int")).alias("id"), F.col("v.summary").alias("summary"))
    return rows.where("trim(summary) <> ''")


def first_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """(file, text) of the first *metadata.json by name; none is an error."""
    path = os.path.join(folder, "*metadata.json")
    if not _exists(spark, path):
        raise FileNotFoundError(f"no metadata file in {folder}")
    return whole_texts(spark, path).orderBy("file").limit(1)


def book(spark: SparkSession, path: str, part: str = "data") -> DataFrame:
    """A part of a stored book, see from_json_book; empty if there is no file."""
    if not _exists(spark, path):
        return spark.createDataFrame([], f"src string, dst string, {B.PARTS[part]} bigint")
    return B.from_json_book(spark.read.text(path, wholetext=True), part=part)


def agent_data(spark: SparkSession, path: str) -> DataFrame:
    """(idx, agent, turn, role, content) of a file that holds conversations by index and agent."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,map<string,array<struct<role:string,content:string>>>>").alias("m"))
    one = text.select(F.explode("m").alias("idx", "agents")).select(F.col("idx").try_cast("int").alias("idx"), F.explode("agents").alias("agent", "messages"))
    return one.select("idx", "agent", F.posexplode("messages").alias("turn", "m")).select("idx", "agent", "turn", "m.role", "m.content")


def prompts(agent: DataFrame, stored: DataFrame) -> DataFrame:
    """(idx, prompt): the last message of an agent's conversation, else the stored prompt."""
    last = agent.groupBy("idx").agg(F.max_by("content", "turn").alias("agent_prompt"))
    met = last.join(stored.select("idx", "prompt"), "idx", "full_outer")
    return met.select("idx", F.coalesce("agent_prompt", "prompt").alias("prompt"))


def resume(spark: SparkSession, path: str) -> DataFrame:
    """(idx, value) of a checkpoint table; keys that are no numbers are left out, a missing table is empty."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "idx int, value string")
    return spark.read.parquet(path).select(F.col("idx").cast("string").try_cast("int").alias("idx"), "value").where("idx is not null")


def tensors(df: DataFrame, column: str) -> DataFrame:
    """Adds shape, dtype and values (array<double>) of tensors in their wire form, little-endian float or int of 4 or 8
    bytes; nested lists are read as well, with the shape of their nesting where it is even."""
    @F.pandas_udf("array<double>")
    def decode(data: pd.Series, dtype: pd.Series) -> pd.Series:
        return pd.Series([None if d is None else np.frombuffer(bytes(d), np.dtype(t)).astype(float).tolist() for d, t in zip(data, dtype)])

    @F.pandas_udf("array<int>")
    def nesting(texts: pd.Series) -> pd.Series:
        def shape(t: str | None) -> list[int] | None:
            try:
                return None if t is None else list(np.array(json.loads(t), float).shape)
            except (ValueError, TypeError):
                return None

        return pd.Series([shape(t) for t in texts], dtype=object)

    t = F.from_json(column, TENSOR)
    parsed = df.withColumn("_t", t).withColumn("_raw", F.try_to_binary(F.col("_t.data_b64"), F.lit("base64")))
    fits = F.length("_raw") % F.substring("_t.dtype", -1, 1).try_cast("int") == 0
    dense = F.when(fits, F.col("_raw"))
    legacy = F.transform(F.regexp_extract_all(F.col(column), F.lit(r"-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"), 0), lambda x: x.cast("double"))
    listed = F.startswith(F.trim(F.col(column)), F.lit("["))
    values = F.when(listed, legacy).otherwise(decode(dense, F.coalesce("_t.dtype", F.lit("<f8"))))
    return parsed.withColumns({"shape": F.coalesce("_t.shape", nesting(F.when(listed, F.col(column)))), "dtype": F.col("_t.dtype"), "values": values}).drop("_t", "_raw")


def speeches(df: DataFrame, column: str) -> DataFrame:
    """Adds a struct speech for objects marked as such, null for others."""
    s = F.from_json(column, SPEECH)
    return df.withColumn("speech", F.when(s["is_speech"], s))


def nested_speeches(df: DataFrame, key: str, column: str) -> DataFrame:
    """(record_id, node_path, speech) of the speeches at any depth of a JSON column, whose key is a number."""
    nodes = nested.json_nodes(df, key, column, "speeches").withColumnRenamed("node", "_speech")
    return speeches(nodes, "_speech").where("speech is not null").select("record_id", "node_path", "speech")


def batch_responses(spark: SparkSession, path: str) -> DataFrame:
    """(custom_id, body) of a batch's output lines."""
    rows = jsonl(spark, path, "custom_id string, response struct<body:string>")
    return rows.where("custom_id is not null").select("custom_id", F.col("response.body").alias("body"))
