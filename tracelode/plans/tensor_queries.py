"""Queries on tensors (the first 64 values of an embedding as 8 x 8) and on speech objects."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelode.operators import speech as S
from tracelode.operators import tensor as T
from tracelode.plans.registry import query

CELLS = "SELECT vec_id, (g - 1)::INT AS p, embedding[g]::DOUBLE AS val FROM embeddings, range(1, 65) r(g)"


def cells(embeddings):
    return T.cells(embeddings, "vec_id", "embedding", [8, 8])


def flat(t, digits=4):
    return t.select(F.col("tensor_id").alias("vec_id"), F.col("idx")[0].alias("i"), F.col("idx")[1].alias("j"), (F.round("val", digits) + 0.0).alias("val"))


@query("embeddings", sql=f"SELECT vec_id, (p % 8)::INT AS i, (p // 8)::INT AS j, round(val, 4) + 0.0 AS val FROM ({CELLS})")
def q_tensor_transpose(embeddings):
    return flat(T.transpose(cells(embeddings), 0, 1, 2))


@query("embeddings", sql=f"SELECT vec_id, ((p // 4) % 4)::INT AS a, (p // 16)::INT AS b, (p % 4)::INT AS c, round(val, 4) + 0.0 AS val FROM ({CELLS})")
def q_tensor_permute(embeddings):
    t = T.permute(T.cells(embeddings, "vec_id", "embedding", [4, 4, 4]), [1, 0, 2])
    return t.select(F.col("tensor_id").alias("vec_id"), *[F.col("idx")[k].alias(n) for k, n in enumerate("abc")], (F.round("val", 4) + 0.0).alias("val"))


@query("embeddings", sql=f"SELECT vec_id, ((p % 8) // 3)::INT AS chunk, (p // 8)::INT AS i, ((p % 8) % 3)::INT AS j, round(val, 4) + 0.0 AS val FROM ({CELLS})")
def q_tensor_split(embeddings):
    t = T.split(cells(embeddings), 3, 1)
    return t.select(F.col("tensor_id").alias("vec_id"), "chunk", F.col("idx")[0].alias("i"), F.col("idx")[1].alias("j"), (F.round("val", 4) + 0.0).alias("val"))


@query("embeddings", sql=f"""
SELECT vec_id, CASE WHEN p // 8 < 1 THEN 0 WHEN p // 8 < 4 THEN 1 ELSE 2 END AS chunk, count(*) AS n, round(sum(val), 5) AS total FROM ({CELLS}) GROUP BY 1, 2""")
def q_tensor_split_sections(embeddings):
    t = T.split(cells(embeddings), [1, 3, 4], 0)
    return t.groupBy(F.col("tensor_id").alias("vec_id"), "chunk").agg(F.count("*").alias("n"), F.round(F.sum("val"), 5).alias("total"))


@query("embeddings", sql=f"""
SELECT vec_id, i, j, round(val, 4) + 0.0 AS val FROM (SELECT vec_id, (p // 8)::INT AS i, (p % 8)::INT AS j, val FROM ({CELLS})
UNION ALL SELECT vec_id, (8 + p % 8)::INT, (p // 8)::INT, val FROM ({CELLS}))""")
def q_tensor_cat(embeddings):
    t = cells(embeddings)
    return flat(T.cat([(t, 8), (T.transpose(t, 0, 1, 2), 8)], 0))


WEIGHT = [[(o * 3 + k * 5) % 7 - 3 for k in range(8)] for o in range(4)]


@query("embeddings", sql=f"SELECT vec_id, (p // 8)::INT AS i, o::INT AS j, round(sum(val * ((o * 3 + (p % 8) * 5) % 7 - 3)), 5) + 0.0 AS val FROM ({CELLS}), range(4) w(o) GROUP BY 1, 2, 3")
def q_tensor_linear(embeddings):
    rows = [(o, k, float(w)) for o, r in enumerate(WEIGHT) for k, w in enumerate(r)]
    w = embeddings.sparkSession.createDataFrame(rows, "o int, k int, w double")
    return flat(T.linear(cells(embeddings), w, 2), 5)


@query("embeddings", sql=f"SELECT vec_id, round(sum(val * ((o * 3 + (p % 8) * 5) % 7 - 3)), 5) AS total FROM ({CELLS}), range(4) w(o) GROUP BY 1")
def q_tensor_linear_dense(embeddings):
    """The same product on whole arrays: no row is exploded and nothing is shuffled."""
    y = T.dense_linear(F.slice("embedding", 1, 64), WEIGHT, 8)
    return embeddings.select("vec_id", F.round(T.dense_sum(y), 5).alias("total"))


def _conv_sql(stride: int, padding: int, dilation: int) -> str:
    size = T.conv_size(8, 3, stride, padding, dilation)
    return f"""
WITH x AS (SELECT vec_id, (p // 8)::INT AS h, (p % 8)::INT AS w, val FROM ({CELLS})), k AS (SELECT a.i AS kh, b.j AS kw, (a.i * 2 + b.j * 3) % 5 - 2 AS c FROM range(3) a(i), range(3) b(j)),
o AS (SELECT a.i AS oh, b.j AS ow FROM range({size}) a(i), range({size}) b(j))
SELECT vec_id, oh::INT AS oh, ow::INT AS ow, round(sum(val * c), 5) + 0.0 AS val FROM x, k, o WHERE x.h = oh * {stride} - {padding} + kh * {dilation} AND x.w = ow * {stride} - {padding} + kw * {dilation} GROUP BY 1, 2, 3"""


def _conv(embeddings, **how):
    t = T.cells(embeddings, "vec_id", "embedding", [1, 1, 8, 8])
    rows = [(0, 0, i, j, float((i * 2 + j * 3) % 5 - 2)) for i in range(3) for j in range(3)]
    w = embeddings.sparkSession.createDataFrame(rows, "o int, c int, kh int, kw int, w double")
    out = T.conv2d(t, w, 8, 8, (3, 3), **how)
    return out.select(F.col("tensor_id").alias("vec_id"), F.col("idx")[2].alias("oh"), F.col("idx")[3].alias("ow"), (F.round("val", 5) + 0.0).alias("val"))


@query("embeddings", sql=_conv_sql(1, 0, 1))
def q_tensor_conv2d(embeddings):
    return _conv(embeddings)


@query("embeddings", sql=_conv_sql(2, 1, 2))
def q_tensor_conv2d_strided(embeddings):
    return _conv(embeddings, stride=2, padding=1, dilation=2)


@query("embeddings", sql=f"""
SELECT vec_id, round(sum(val), 4) AS total, round(avg(val), 8) AS mean, count(*) FILTER (WHERE val > m) AS above_mean FROM (SELECT *, avg(val) OVER (PARTITION BY vec_id) AS m FROM ({CELLS})) GROUP BY 1""")
def q_tensor_reduce(embeddings):
    r = T.reductions(cells(embeddings))
    return r.select(F.col("tensor_id").alias("vec_id"), F.round("total", 4).alias("total"), F.round("mean", 8).alias("mean"), "above_mean")


@query("embeddings", sql="SELECT vec_id, 8 AS rows, len(embedding) // 8 AS cols, len(embedding) AS numel FROM embeddings")
def q_tensor_shape(embeddings):
    s = T.shape_of(cells(embeddings), 2)
    return s.select(F.col("tensor_id").alias("vec_id"), F.col("shape")[0].alias("rows"), F.col("shape")[1].alias("cols"), "numel")


@query("embeddings", sql="""
SELECT a.label AS left_label, b.label AS right_label, count(*) AS pairs FROM (SELECT label, 1 + vec_id % 8 AS n FROM embeddings) a JOIN (SELECT DISTINCT label, 1 + vec_id % 8 AS n FROM embeddings) b USING (n) GROUP BY 1, 2""")
def q_tensor_compat(embeddings):
    """Tensors and weights that fit by one axis; weights of one shape and label count once."""
    head = embeddings.select(F.col("label").alias("tensor_id"), F.array(F.lit(8), (1 + F.col("vec_id") % 8).cast("int")).alias("shape"))
    return T.compatible(head, head.distinct(), 2, 2).groupBy(F.col("left_id").alias("left_label"), F.col("right_id").alias("right_label")).agg(F.count("*").alias("pairs"))


@query("embeddings", sql=f"""
SELECT vec_id, bool_and(abs(val - other) <= 0.01 + 0.01 * abs(other)) AS equal FROM (SELECT vec_id, val, val + CASE WHEN vec_id % 3 = 0 AND p = 5 THEN 0.2 ELSE 0.001 END AS other FROM ({CELLS})) GROUP BY 1""")
def q_tensor_allclose(embeddings):
    t = cells(embeddings)
    moved = t.withColumn("val", F.col("val") + F.when((F.col("tensor_id") % 3 == 0) & (F.col("idx")[0] == 0) & (F.col("idx")[1] == 5), 0.2).otherwise(0.001))
    return T.allclose(t, moved).withColumnRenamed("tensor_id", "vec_id")


@query("embeddings", sql="SELECT label, round(sum(list_sum(embedding::DOUBLE[])), 5) AS total, count(*) AS tensors FROM embeddings GROUP BY 1")
def q_result_sum(embeddings):
    return embeddings.groupBy("label").agg(F.round(F.sum(T.dense_sum(F.col("embedding"))), 5).alias("total"), F.count("*").alias("tensors"))


VOICES = "(VALUES " + ", ".join(str(v) for v in S.VOICES) + ") v(voice_name, id, category, gender)"


@query("documents", sql=f"SELECT voice_name, category, gender FROM {VOICES} WHERE category = 'casual' OR (category = 'old' AND gender = 'feminine') OR voice_name = 'Emma'")
def q_voice_search(documents):
    v = S.voices(documents.sparkSession)
    parts = [S.search(v, category="casual"), S.search(v, category="old", gender="feminine"), S.search(v, name="Emma", gender="masculine"), S.search(v, name="Nobody").where("kind = 'voice'")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).drop("kind")


NAMES = [v[0] for v in S.VOICES] + ["Nobody"]
NAME = "[" + ", ".join(repr(n) for n in NAMES) + "]"


def speeches(documents):
    name = F.element_at(F.array(*[F.lit(n) for n in NAMES]), (F.col("doc_id") % len(NAMES) + 1).cast("int"))
    made = documents.where("text is not null").withColumn("first", name).withColumn("second", F.element_at(F.array(*[F.lit(n) for n in NAMES]), ((F.col("doc_id") * 7) % len(NAMES) + 1).cast("int")))
    return S.text_to_speech(made.drop("text").join(documents.select("doc_id", F.col("text").alias("said")), "doc_id"), "said", "first", stability=F.lit(0.5))


@query("documents", sql=f"""
SELECT doc_id, {NAME}[(doc_id * 7) % 11 + 1] AS voice_name, 4.0 AS duration, 4 AS steps, 'text_to_speech>speech_to_speech>isolate_audio>isolate_audio' AS lineage, length(text) AS n
FROM documents WHERE text IS NOT NULL AND {NAME}[(doc_id * 7) % 11 + 1] <> 'Nobody'""")
def q_speech_chain(documents):
    s = S.isolate_audio(S.isolate_audio(S.speech_to_speech(speeches(documents), "second", S.voices(documents.sparkSession))))
    return s.select("doc_id", "voice_name", "duration", F.size("transitions").alias("steps"), F.array_join(F.col("transitions.name"), ">").alias("lineage"), F.length("text").alias("n"))


@query("documents", sql=f"SELECT doc_id, 8.0 AS duration, false AS same_as_before, true AS same_text FROM documents WHERE text IS NOT NULL")
def q_isolate(documents):
    old = speeches(documents)
    new = S.isolate_audio(old)
    both = old.select("doc_id", F.struct(*S.FIELDS).alias("a")).join(new.select("doc_id", F.struct(*S.FIELDS).alias("b")), "doc_id")
    return both.select("doc_id", F.col("b.duration").alias("duration"), S.equal("a", "b").alias("same_as_before"), (F.col("a.text") == F.col("b.text")).alias("same_text"))


@query("documents", sql=f"SELECT {NAME}[doc_id % 11 + 1] AS voice_name, {NAME}[doc_id % 11 + 1] <> 'Nobody' AS valid, count(*) AS calls FROM documents WHERE text IS NOT NULL GROUP BY 1, 2")
def q_call_log(documents):
    log = S.outbound_calls(speeches(documents), "first", S.voices(documents.sparkSession), ["doc_id"])
    return log.groupBy("voice_name", "valid").agg(F.count("*").alias("calls"))


@query("documents", sql=f"SELECT doc_id, {NAME}[doc_id % 11 + 1] AS voice, split_part(text, '.', 1) || '.' AS first_sentence FROM documents WHERE text IS NOT NULL AND {NAME}[doc_id % 11 + 1] = 'Nobody'")
def q_voice_membership(documents):
    gone = S.unknown_voices(speeches(documents), "first", S.voices(documents.sparkSession))
    return gone.select("doc_id", F.col("first").alias("voice"), S.first_sentence(F.col("text")).alias("first_sentence"))


@query("documents", sql="SELECT doc_id, len(string_split(text, '.'))::INT AS sentences FROM documents WHERE text IS NOT NULL")
def q_sentence_count(documents):
    return documents.where("text is not null").select("doc_id", S.sentences(F.col("text")).alias("sentences"))
