"""Session set-up, table access, lineage cuts and skew-safe building blocks shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sub-groups into which the rows of one key are spread before they are gathered per key.
SALTS = 32


def session(app: str = "tracelode", cpus: int | str = 8, **conf: str) -> SparkSession:
    """A local session with the settings the operators are tuned for; on a cluster use the cluster's own session."""
    settings = {
        "spark.master": f"local[{cpus}]",
        "spark.app.name": app,
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | conf
    spark = SparkSession.builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; columns and filters reach the parquet scan."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which all executors share: that of the session, else the one spark.checkpoint.dir names. Where
    neither is set in local mode (tests) a temporary folder takes its place; on a cluster that is an error, as a machine's
    own folder can't be shared."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not shared and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tracelode-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder, so that later steps neither repeat its work nor depend on executors that hold it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, *by: str) -> DataFrame:
    """df as a table in the shared folder, a folder per value of by, so that a filter on by reads no other files."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def salt_of(*cols: str, salts: int = SALTS) -> Column:
    return F.pmod(F.hash(*[F.col(c) for c in cols]), F.lit(salts))


def with_shared_key(df: DataFrame, keys: list[str], owner: str, salts: int = SALTS, ends: bool = False) -> DataFrame:
    """The rows of df whose key occurs with at least two different owners; ends adds the key's least and greatest owner
    as _lo and _hi.

    A key may hold a third of all rows: its rows are first reduced per (key, salt), partial results are joined per key,
    and the way back goes through (key, salt) again, so no task gets all rows of one key. Null keys never match.
    """
    salted = df.withColumn("_salt", salt_of(owner, salts=salts))
    part = salted.groupBy(*keys, "_salt").agg(F.min(owner).alias("_lo"), F.max(owner).alias("_hi"))
    whole = part.groupBy(*keys).agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")).where("_lo <> _hi")
    marked = part.select(*keys, "_salt").join(whole, keys)
    return salted.join(marked, [*keys, "_salt"]).drop("_salt", *([] if ends else ["_lo", "_hi"]))


def join_salted(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", salts: int = 8) -> DataFrame:
    """left joined with right, which has one small row per key: a key that holds a third of left is spread over salts
    tasks, each with its own copy of right's row."""
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread = left.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    return spread.join(copies, [*keys, "_salt"], how).drop("_salt")
