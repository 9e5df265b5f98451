"""Random documents, field values, tensors and spoken texts, the same for the same seed; traces of calls are made in simulate."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.operators.docstore import TYPES
from tracelode.operators.speech import VOICES

# Sources of random documents, and their fields in the order that renders them.
SOURCES = ["portal_a", "portal_b", "portal_c", "portal_d", "portal_e"]
FIELDS = ["title", "description", "significantDifferences", "similarities", "members"]


def documents(spark: SparkSession, n: int, fields: int = 3, seed: int = 0) -> DataFrame:
    """n random documents of known sources and types: a title and fields - 1 further fields; the same for the same seed."""
    pick = lambda values, tag: F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.xxhash64("id", F.lit(f"{tag}{seed}")), F.lit(len(values))) + 1).cast("int"))
    others = F.slice(F.array_sort(F.transform(F.array(*[F.lit(f) for f in FIELDS[1:]]), lambda f: F.struct(F.xxhash64("id", f, F.lit(seed)).alias("h"), f.alias("f")))), 1, max(0, fields - 1))
    entries = F.concat(F.array(F.struct(F.lit("title").alias("key"), F.concat(F.lit("title "), F.col("id").cast("string")).alias("value"))), F.transform(others, lambda o: F.struct(o["f"].alias("key"), F.substring(F.md5(F.concat(o["f"], F.col("id").cast("string"))), 1, 8).alias("value"))))
    base = spark.range(n).withColumnsRenamed({"id": "id"})
    return base.select("id", pick(SOURCES, "s").alias("source"), pick(TYPES, "t").alias("type"), F.to_json(F.map_from_entries(entries)).alias("data"))


def tensors(spark: SparkSession, n: int, shape: tuple[int, ...] = (2, 2, 4, 4), seed: int = 0) -> DataFrame:
    """Cells of n tensors of normal values."""
    size = 1
    for s in shape:
        size *= s
    flat = spark.range(n * size).select(F.floor(F.col("id") / size).alias("tensor_id"), (F.col("id") % size).alias("p"), F.randn(seed).alias("val"))
    idx, step = [], size
    for s in shape:
        step //= s
        idx.append((F.floor(F.col("p") / step) % s).cast("int"))
    return flat.select("tensor_id", F.array(*idx).alias("idx"), "val")


def field_value(field: Column, no: Column, exclude: Column, seed: int = 0) -> Column:
    """A random value of a document's field that isn't exclude."""
    value = lambda k: F.concat(field, F.lit(" "), F.substring(F.md5(F.concat_ws("|", field, no.cast("string"), F.lit(seed), F.lit(k))), 1, 8))
    return F.when(value(0).eqNullSafe(exclude), value(1)).otherwise(value(0))


def shaped_tensors(spark: SparkSession, n: int, low: int = 1, high: int = 4, seed: int = 0) -> DataFrame:
    """(tensor_id, shape, values): n dense tensors of four dimensions from low to high, the last two equal and even."""
    size = lambda tag: (F.pmod(F.xxhash64("id", F.lit(f"{tag}{seed}")), F.lit(high - low + 1)) + low).cast("int")
    shape = F.array(size("a"), size("b"), size("c") * 2, size("c") * 2)
    base = spark.range(n).select(F.col("id").alias("tensor_id"), shape.alias("shape"))
    cells = F.aggregate("shape", F.lit(1), lambda a, x: a * x)
    # normal values by Box and Muller from hashes, so that a cell depends on its place alone
    unit = lambda i, tag: (F.pmod(F.xxhash64("tensor_id", i, F.lit(f"{tag}{seed}")), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)
    normal = lambda i: F.sqrt(-2 * F.log(unit(i, "u"))) * F.cos(2 * math.pi * unit(i, "v"))
    return base.withColumn("values", F.transform(F.sequence(F.lit(0), cells - 1), normal))


# Words of random paragraphs.
WORDS = "the a call voice session value record trace tensor field query answer number list user server group study view note step plan copy draft report window signal market river garden engine letter".split()


def paragraphs(spark: SparkSession, n: int, sentences: int = 3, seed: int = 0) -> DataFrame:
    """(id, text): random paragraphs of so many sentences of five to nine words."""
    word = lambda s, w: F.element_at(F.array(*[F.lit(x) for x in WORDS]), (F.pmod(F.xxhash64("id", s, w, F.lit(seed)), F.lit(len(WORDS))) + 1).cast("int"))
    length = lambda s: (F.pmod(F.xxhash64("id", s, F.lit(f"n{seed}")), F.lit(5)) + 5).cast("int")
    sentence = lambda s: F.concat(F.initcap(word(s, F.lit(0))), F.lit(" "), F.array_join(F.transform(F.sequence(F.lit(1), length(s) - 1), lambda w: word(s, w)), " "), F.lit("."))
    return spark.range(n).select("id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(sentences)), sentence), " ").alias("text"))


def voice_terms(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """(id, name, category, gender): search terms of four forms, each as likely: a name, a category, a gender, both of these."""
    form = F.pmod(F.xxhash64("id", F.lit(f"form{seed}")), F.lit(4))
    voice = F.element_at(F.array(*[F.struct(F.lit(v[0]).alias("n"), F.lit(v[2]).alias("c"), F.lit(v[3]).alias("g")) for v in VOICES]), (F.pmod(F.xxhash64("id", F.lit(f"voice{seed}")), F.lit(len(VOICES))) + 1).cast("int"))
    base = spark.range(n).select("id", form.alias("f"), voice.alias("v"))
    return base.select("id", F.when(F.col("f") == 0, F.col("v.n")).alias("name"), F.when(F.col("f").isin(1, 3), F.col("v.c")).alias("category"), F.when(F.col("f").isin(2, 3), F.col("v.g")).alias("gender"))
