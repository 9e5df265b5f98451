"""Writers. Versions are new folders beside the old ones and a pointer file, as Parquet and JSON know no update in place."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode import runtime
from tracelode.operators import book as B


def jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def parquet(df: DataFrame, path: str, partition: list[str] | None = None, order: list[str] | None = None) -> None:
    out = df.sortWithinPartitions(*order) if order else df
    (out.write.partitionBy(*partition) if partition else out.write).mode("overwrite").parquet(path)


def book(df: DataFrame, path: str, pending: DataFrame | None = None, snapshot: DataFrame | None = None) -> None:
    """A book as one small JSON file, with pending discards (src, dst, dec) and the snapshot of a round where there are any, in the
    layout that readers.book reads."""
    B.to_json_book(df, pending, snapshot).coalesce(1).write.mode("overwrite").text(path)


def version(df: DataFrame, folder: str, name: str | None = None) -> str:
    """A new version of a table. The newest version is the one whose marker was written last; markers are never replaced, so a
    reader always finds one, and a version without marker doesn't count."""
    spark = df.sparkSession
    name = name or f"v{time.time_ns()}"
    df.write.mode("overwrite").parquet(f"{folder}/data/{name}")
    spark.createDataFrame([(name,)], "version string").coalesce(1).write.mode("ignore").text(f"{folder}/markers/{time.time_ns():020d}")
    return name


def latest_version(spark: SparkSession, folder: str) -> tuple[DataFrame | None, str | None]:
    """The newest version and its name; None where there is none yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/markers")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None, None
    marks = sorted((f.getPath().toString() for f in fs.listStatus(path)), reverse=True)
    for m in marks:
        if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{m}/_SUCCESS")):
            name = spark.read.text(m).first()[0]
            return spark.read.parquet(f"{folder}/data/{name}"), name
    return None, None


def current(spark: SparkSession, folder: str) -> DataFrame:
    return latest_version(spark, folder)[0]


def append_once(df: DataFrame, path: str, key: str) -> DataFrame:
    """Appends the rows whose key isn't in the table at path yet, so that a repeated run adds nothing; returns those."""
    spark = df.sparkSession
    from tracelode.sources.readers import _exists

    new = df.dropDuplicates([key])
    if _exists(spark, path):
        new = new.join(spark.read.parquet(path).select(key), key, "left_anti")
    # cut: what was new must not be asked again after the table has it
    new = runtime.cut(new)
    new.write.mode("append").parquet(path)
    return new


def batch_requests(df: DataFrame, custom_id: Column, messages: Column, model: str, endpoint: str, max_tokens: int) -> DataFrame:
    """(value): request lines of a batch; the body's fields depend on the endpoint."""
    chat = F.struct(F.lit(model).alias("model"), messages.alias("messages"), F.lit(max_tokens).alias("max_tokens"))
    responses = F.struct(F.lit(model).alias("model"), messages.alias("input"), F.lit(max_tokens).alias("max_output_tokens"))
    body = responses if endpoint.endswith("/responses") else chat
    return df.select(F.to_json(F.struct(custom_id.alias("custom_id"), F.lit("POST").alias("method"), F.lit(endpoint).alias("url"), body.alias("body"))).alias("value"))


def evaluators(cases: DataFrame, folder: str) -> None:
    """One JSON document per evaluator, partitioned by its id; nested values given as JSON text are embedded as text."""
    one = cases.groupBy("eval_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("case_no", "result", "state_oracle", "program_info", "program"))), lambda c: c.dropFields("case_no")).alias("test_cases"))
    one.write.mode("overwrite").partitionBy("eval_id").json(folder)


def tensor_wire(shape: Column, dtype: str, data: Column) -> Column:
    return F.to_json(F.struct(F.lit(True).alias("__tensor__"), shape.alias("shape"), F.lit(dtype).alias("dtype"), F.base64(data).alias("data_b64")))


def summaries(df: DataFrame, path: str) -> None:
    df.where("trim(summary) <> ''").write.mode("overwrite").json(path)


def corpus(evaluators_: DataFrame, prompts: DataFrame, metadata: DataFrame, agent: DataFrame) -> DataFrame:
    """(example_id, evaluator_json, prompt, metadata_json, agent_data_json) sorted by example_id: evaluators with their prompt
    and agent data where there are any; the metadata first by file goes to all. No evaluators are an error."""
    if evaluators_.isEmpty():
        raise ValueError("no evaluators to pack")
    meta = metadata.agg(F.min_by("text", "file").alias("metadata_json"))  # one row
    met = evaluators_.join(prompts, "example_id", "left").join(agent, "example_id", "left").join(F.broadcast(meta))
    return met.select(F.col("example_id").cast("int").alias("example_id"), "evaluator_json", "prompt", "metadata_json", "agent_data_json").orderBy("example_id")


def materialise(corpus_: DataFrame, folder: str) -> None:
    """The inverse of corpus(): a folder of evaluators and one of agent data by example, prompts as one table, the metadata once."""
    for name, column in (("evaluators", "evaluator_json"), ("agent_data", "agent_data_json")):
        corpus_.where(F.col(column).isNotNull()).select("example_id", column).repartition("example_id").write.mode("overwrite").partitionBy("example_id").text(f"{folder}/{name}")
    corpus_.where("prompt is not null").select("example_id", "prompt").write.mode("overwrite").json(f"{folder}/prompts")
    corpus_.agg(F.min_by("metadata_json", "example_id").alias("value")).coalesce(1).write.mode("overwrite").text(f"{folder}/metadata")


def runs(spark: SparkSession, path: str, run_id: str, config: str, book_json: str, diffs: DataFrame) -> None:
    """A run's metadata: its configuration and book, with a row for each index and pair it changed (idx, src, dst, occ)."""
    rows = diffs.select(F.lit(run_id).alias("run_id"), F.lit(config).alias("config"), F.lit(book_json).alias("book"), "idx", "src", "dst", "occ")
    rows.write.mode("append").partitionBy("run_id").parquet(path)


def call_log(calls: DataFrame, folder: str) -> None:
    """Model calls (case_id, round, label, latency, prompt_tokens, completion_tokens, ...) as JSON by case, with a summary of one row
    beside them."""
    calls.write.mode("overwrite").partitionBy("case_id").json(f"{folder}/cases")
    usage_summary(calls).coalesce(1).write.mode("overwrite").json(f"{folder}/summary")


def usage_summary(calls: DataFrame) -> DataFrame:
    """One row: calls, cases, rounds, calls by label, latency and tokens."""
    labels = calls.groupBy("label").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "n")))).alias("labels"))
    total = calls.agg(
        F.count("*").alias("calls"), F.countDistinct("case_id").alias("cases"), F.max("round").alias("rounds"), F.avg("latency").alias("mean_latency"), F.sum("latency").alias("latency"),
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"),
    )
    return total.join(F.broadcast(labels))  # one row each


def speech_wire(speech: Column) -> Column:
    """A speech in the form readers.speeches reads; null for null."""
    return F.when(speech.isNotNull(), F.to_json(F.struct(F.lit(True).alias("is_speech"), speech["text"].alias("text"), speech["voice_name"].alias("voice_name"), *[speech[k].alias(k) for k in ("stability", "similarity_boost", "style", "duration", "transitions")])))
