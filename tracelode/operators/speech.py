"""Speech objects: a voice library, a chain of operations with lineage, and a call log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The voice library (voice_name, id, category, gender).
VOICES = [
    ("Emma", "v1", "conversational", "feminine"), ("James", "v2", "professional", "masculine"), ("Oliver", "v3", "casual", "masculine"), ("Michael", "v4", "young", "masculine"), ("Sofia", "v5", "casual", "feminine"),
    ("Alexander", "v6", "old", "masculine"), ("Evelyn", "v7", "professional", "feminine"), ("Isabella", "v8", "old", "feminine"), ("Arthur", "v9", "conversational", "masculine"), ("Sophia", "v10", "young", "feminine"),
]
DURATION = 16.0
TOLERANCE = 1e-6
LINEAGE = "array<struct<name:string,params:map<string,string>>>"
FIELDS = ["text", "voice_name", "stability", "similarity_boost", "style", "duration", "transitions"]


def voices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(VOICES, "voice_name string, id string, category string, gender string")


def add_voice(library: DataFrame, name: str, category: str, gender: str) -> DataFrame:
    """A new voice; its id is the bare number of voices after it."""
    n = library.agg(F.count("*").alias("n"))
    return library.unionByName(n.select(F.lit(name).alias("voice_name"), (F.col("n") + 1).cast("string").alias("id"), F.lit(category).alias("category"), F.lit(gender).alias("gender")))


def search(library: DataFrame, name: str | None = None, category: str | None = None, gender: str | None = None) -> DataFrame:
    """(kind, voice_name, category, gender): a name alone decides if given, and a row of kind 'none' says that it is
    unknown; else the voices that fit what is given, by name. Nothing given is an error."""
    if name is None and category is None and gender is None:
        raise ValueError("a name, a category or a gender is needed")
    if name is not None:
        hit = library.where(F.col("voice_name") == name).agg(F.first("voice_name").alias("voice_name"), F.first("category").alias("category"), F.first("gender").alias("gender"))
        return hit.select(F.when(F.col("voice_name").isNull(), "none").otherwise("voice").alias("kind"), "voice_name", "category", "gender")
    fits = [F.col(c) == v for c, v in (("category", category), ("gender", gender)) if v is not None]
    for f in fits:
        library = library.where(f)
    return library.select(F.lit("voice").alias("kind"), "voice_name", "category", "gender").orderBy("voice_name")


def step(name: str, **params: Column) -> Column:
    entries = [x for k, v in params.items() for x in (F.lit(k), v.cast("string"))]
    made = F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")
    return F.struct(F.lit(name).alias("name"), made.cast("map<string,string>").alias("params"))


def text_to_speech(df: DataFrame, text: str, voice: str | None = None, stability: Column | None = None, similarity: Column | None = None, style: Column | None = None) -> DataFrame:
    """Adds the columns of a new speech. The voice isn't checked against the library."""
    v = F.col(voice) if voice else F.lit(None).cast("string")
    number = lambda c: (F.lit(None) if c is None else c).cast("double")
    return df.withColumns(
        {"text": F.col(text), "voice_name": v, "stability": number(stability), "similarity_boost": number(similarity), "style": number(style), "duration": F.lit(DURATION), "transitions": F.array(step("text_to_speech", voice=v)).cast(LINEAGE)}
    )


def speech_to_speech(speeches: DataFrame, voice: str, library: DataFrame) -> DataFrame:
    """Speeches under another voice; those whose new voice isn't in the library are left out."""
    known = speeches.join(library.select(F.col("voice_name").alias("_v")), F.col(voice) == F.col("_v"), "left_semi")
    return known.withColumns({"voice_name": F.col(voice), "transitions": F.array_append("transitions", step("speech_to_speech", voice=F.col(voice)))})


def unknown_voices(speeches: DataFrame, voice: str, library: DataFrame) -> DataFrame:
    return speeches.join(library.select(F.col("voice_name").alias("_v")), F.col(voice) == F.col("_v"), "left_anti")


def isolate_audio(speeches: DataFrame) -> DataFrame:
    return speeches.withColumns({"duration": F.col("duration") / 2, "transitions": F.array_append("transitions", step("isolate_audio"))})


def speech_to_text(speeches: DataFrame, diarize: bool, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(transcriptions, speeches): this operation also lengthens the lineage of its input."""
    said = speeches.select(*keys, "text", F.lit(diarize).alias("diarize"))
    return said, speeches.withColumn("transitions", F.array_append("transitions", step("speech_to_text", diarize=F.lit(diarize))))


def outbound_calls(speeches: DataFrame, voice: str, library: DataFrame, keys: list[str]) -> DataFrame:
    """The call log: a row per call, made before the voice is checked, with the result of that check."""
    names = library.select(F.col("voice_name").alias("_v"), F.lit(True).alias("_known"))
    met = speeches.join(names, F.col(voice) == F.col("_v"), "left")
    return met.select(*keys, "text", F.col(voice).alias("voice_name"), F.coalesce("_known", F.lit(False)).alias("valid"))


def near(a: Column, b: Column) -> Column:
    return F.coalesce(F.abs(a - b) < TOLERANCE, a.isNull() & b.isNull())


def equal(left: str, right: str) -> Column:
    """Speeches in struct columns: equal texts, voices and lineages, numbers within the tolerance, null equal to null."""
    out = F.col(f"{left}.text").eqNullSafe(F.col(f"{right}.text")) & F.col(f"{left}.voice_name").eqNullSafe(F.col(f"{right}.voice_name"))
    for c in ("stability", "similarity_boost", "style", "duration"):
        out = out & near(F.col(f"{left}.{c}"), F.col(f"{right}.{c}"))
    lineage = lambda s: F.to_json(F.transform(F.col(f"{s}.transitions"), lambda t: F.struct(t["name"], F.array_sort(F.map_entries(t["params"])))))
    return out & lineage(left).eqNullSafe(lineage(right))


def sentences(text: Column) -> Column:
    return F.size(F.split(text, r"\.", -1))


def first_sentence(text: Column) -> Column:
    return F.concat(F.element_at(F.split(text, r"\.", -1), 1), F.lit("."))


def resolve(variable: Column, json_value: Column) -> Column:
    """A parameter's value: the variable's, else the text under voice_name, else the only text of a one-key object."""
    fields = F.from_json(json_value, "map<string,string>")
    return F.coalesce(variable, F.try_element_at(fields, F.lit("voice_name")), F.when(F.size(fields) == 1, F.map_values(fields)[0]), F.when(fields.isNull(), json_value))
