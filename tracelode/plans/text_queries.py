"""Queries on prompts, answers and programs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelode.operators import textops as T
from tracelode.plans.registry import query

FIRST = "regexp_extract_all(code, '(?s)```(?:\\w*\\n)?(.*?)```', 1)"


@query("translations", sql="""
WITH t AS (SELECT DISTINCT program_id, 'Here:' || chr(10) || '```python' || chr(10) || coalesce(program, '') || chr(10) || '```' || chr(10) || 'or' || chr(10) || '```' || chr(10) || task || '```' AS text FROM translations WHERE task IS NOT NULL)
SELECT program_id, list_extract(regexp_extract_all(text, '(?s)```(?:\\w*\\n)?(.*?)```', 1), -1) AS code, text = replace(text, 'exit()', '') AS no_exit FROM t""")
def q_code_extract(translations):
    text = F.concat(F.lit("Here:\n```python\n"), F.coalesce("program", F.lit("")), F.lit("\n```\nor\n```\n"), "task", F.lit("```"))
    t = translations.where("task is not null").select("program_id", text.alias("text")).distinct()
    return t.select("program_id", T.last_code_block(F.col("text")).alias("code"), (F.col("text") == T.without_exit(F.col("text"))).alias("no_exit"))


@query("code_messages", sql="SELECT request_id, item_id, code AS stripped FROM code_messages WHERE code IS NOT NULL AND length(code) > 0 AND NOT contains(code, '`') AND code = trim(code, ' ')")
def q_strip_fence(code_messages):
    """Code as it stands, with its fence taken off if it has one; the SQL has only rows without backticks and outer blanks."""
    return code_messages.where("code is not null and length(code) > 0").select("request_id", "item_id", T.strip_fence(F.col("code")).alias("stripped"))


@query("prompt_messages", sql="""
SELECT request_id, array_to_string(list_sort(list_distinct(regexp_extract_all(prompt, '- ([A-Za-z_]\\w*)\\(', 1))), ',') AS names FROM prompt_messages""")
def q_doc_api_names(prompt_messages):
    return prompt_messages.select("request_id", F.array_join(T.listed_calls(F.col("prompt")), ",").alias("names"))


@query("code_messages", sql="""
SELECT request_id, item_id, array_to_string(list_sort(list_distinct(regexp_extract_all(code, 'def ([A-Za-z_]\\w*)\\(', 1))), ',') AS names FROM code_messages WHERE code IS NOT NULL""")
def q_defined_names(code_messages):
    return code_messages.where("code is not null").select("request_id", "item_id", F.array_join(T.api_names(F.col("code")), ",").alias("names"))


@query("chat_requests", sql="""
WITH m AS (SELECT request_id, list_filter(messages, lambda x: x.role = 'system') AS s, list_filter(messages, lambda x: x.role <> 'system') AS o FROM chat_requests WHERE len(messages) > 0),
f AS (SELECT request_id, o, array_to_string(list_transform(s, lambda x: x.content), chr(10) || chr(10)) AS sys, len(s) AS n FROM m)
SELECT request_id, CASE WHEN n > 0 THEN 'user' ELSE o[1].role END AS first_role, md5(CASE WHEN n = 0 THEN o[1].content WHEN len(o) = 0 THEN sys WHEN o[1].role = 'user' THEN sys || chr(10) || chr(10) || '---' || chr(10) || chr(10) || o[1].content ELSE sys END) AS first_hash,
(CASE WHEN n > 0 AND (len(o) = 0 OR o[1].role <> 'user') THEN 1 ELSE 0 END + len(o)) AS messages FROM f""")
def q_flatten_system(chat_requests):
    flat = T.flatten_system(chat_requests, ["request_id"], "messages")
    return flat.groupBy("request_id").agg(F.min_by("role", "pos").alias("first_role"), F.md5(F.min_by("content", "pos")).alias("first_hash"), F.count("*").alias("messages"))


@query("chat_requests", sql="""
SELECT request_id, list_filter(messages, lambda x: x.role = 'user')[-1].content AS last_user, len(messages) AS turns FROM chat_requests""")
def q_last_message(chat_requests):
    users = F.filter("messages", lambda x: x["role"] == "user")
    return chat_requests.select("request_id", F.try_element_at(users, F.lit(-1))["content"].alias("last_user"), F.size("messages").alias("turns"))


@query("translations", sql="""
SELECT DISTINCT program_id, CASE WHEN length(trim(user_variable_definitions)) > 0 AND length(trim(task_instructions)) > 0 THEN '## Variables' || chr(10) || user_variable_definitions || chr(10) || chr(10) || '## Task' || chr(10) || task_instructions
WHEN length(trim(task_instructions)) > 0 THEN '## Task' || chr(10) || task_instructions WHEN length(trim(user_variable_definitions)) > 0 THEN '## Variables' || chr(10) || user_variable_definitions ELSE '' END AS prompt FROM translations""")
def q_prompt_assemble(translations):
    return translations.select("program_id", T.prompt(F.lit(None).cast("string"), F.col("user_variable_definitions"), F.col("task_instructions")).alias("prompt")).distinct()


@query("translations", sql="""
SELECT DISTINCT program_id, user_variable_definitions AS definitions, task_instructions AS task FROM translations WHERE user_variable_definitions IS NOT NULL AND task_instructions IS NOT NULL""")
def q_normalise_instructions(translations):
    """Instructions given as JSON under other names, or as text with headings, come out as their two parts."""
    t = translations.where("user_variable_definitions is not null and task_instructions is not null").select("program_id", "user_variable_definitions", "task_instructions").distinct()
    as_json = F.to_json(F.struct(F.col("user_variable_definitions").alias("user_variables"), F.col("task_instructions").alias("instructions")))
    as_text = F.concat(F.lit("TASK INSTRUCTIONS: "), "task_instructions", F.lit("\n<User Variable Definitions>: "), "user_variable_definitions")
    d, k = T.instructions(F.col("given"))
    return t.withColumn("given", F.when(F.col("program_id") % 2 == 0, as_json).otherwise(as_text)).select("program_id", d.alias("definitions"), k.alias("task"))


@query("eval_runs", sql="SELECT run_id, lower(regexp_replace(target_llm, '[^A-Za-z0-9._-]+', '_', 'g')) AS tag, 'http://localhost:8080/api/' || task AS url FROM eval_runs")
def q_safe_tag(eval_runs):
    url = F.concat(F.lit("{{ BASE_URL }}/api/"), "task")
    return eval_runs.select("run_id", T.safe_tag(F.col("target_llm")).alias("tag"), T.placeholder(url, "http://localhost:8080").alias("url"))


@query("raw_messages", sql="""
SELECT message_id, contains(lower(body), 'max_tokens') OR contains(lower(body), 'token limit') OR contains(lower(body), 'context length') AS token_limit, contains(body, '"error"') AS has_error FROM raw_messages""")
def q_error_flags(raw_messages):
    return raw_messages.select("message_id", T.token_limit_error(F.col("body")).alias("token_limit"), F.contains("body", F.lit('"error"')).alias("has_error"))


@query("raw_messages", sql="""
SELECT message_id, CASE WHEN json_type(body, '$.choices[0].message.content') = 'VARCHAR' THEN json_extract_string(body, '$.choices[0].message.content')
WHEN json_type(body, '$.choices[0].message.content') = 'ARRAY' THEN array_to_string(json_extract_string(body, '$.choices[0].message.content[*].text'), '')
ELSE coalesce(array_to_string(json_extract_string(body, '$.output[*].content[*].text'), ''), '') END AS answer FROM raw_messages WHERE json_valid(body)""")
def q_response_text(raw_messages):
    return raw_messages.where(F.try_parse_json("body").isNotNull()).select("message_id", T.response_text(F.col("body")).alias("answer"))


@query("raw_messages", sql="SELECT message_id, json_extract_string(body, '$.error.message') AS error FROM raw_messages WHERE json_valid(body) AND json_extract_string(body, '$.error.message') IS NOT NULL")
def q_choice_error(raw_messages):
    r = raw_messages.where(F.try_parse_json("body").isNotNull()).select("message_id", T.choice_error(F.col("body")).alias("error"))
    return r.where("error is not null")


@query("events", sql="""
WITH s AS (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, event_type, json_extract_string(props, '$.k') AS k FROM events)
SELECT user_id, md5(string_agg('    response_' || n || ' = ' || event_type || '(k=' || k || ')', chr(10) ORDER BY ts, event_id)) AS program_hash, count(*) AS lines FROM s GROUP BY 1""")
def q_render_program(events):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    s = events.withColumn("line", T.rendered(F.col("event_type"), F.concat(F.lit("k="), F.get_json_object("props", "$.k")), n))
    return T.program(s, ["user_id"], ["ts", "event_id"], "line", "    ").select("user_id", F.md5("program").alias("program_hash"), "lines")


@query("events", sql="SELECT event_id, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS canonical, event_type || '|' || printf('%.2f', value) AS data_text FROM events")
def q_param_key(events):
    from tracelode.operators.docstore import canonical

    return events.select("event_id", canonical("props").alias("canonical"), F.concat("event_type", F.lit("|"), F.format_string("%.2f", "value")).alias("data_text"))


@query("events", sql="SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'dict' WHEN 1 THEN 'list' WHEN 2 THEN 'str' WHEN 3 THEN 'number' WHEN 4 THEN 'null' ELSE 'none' END AS kind FROM events")
def q_value_type(events):
    k = F.get_json_object("props", "$.k")
    given = F.element_at(F.array(F.col("props"), F.concat(F.lit("["), k, F.lit("]")), F.concat(F.lit('"'), k, F.lit('"')), k, F.lit("null"), F.concat(F.lit("("), k, F.lit(")"))), (F.col("event_id") % 6 + 1).cast("int"))
    return events.select("event_id", T.value_type(given).alias("kind"))


@query("customer", sql="""
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN CAST(c_custkey + 1 AS VARCHAR) WHEN 1 THEN '"' || c_mktsegment || '_diff"' WHEN 2 THEN '["' || c_custkey || '","x","' || c_custkey || '"]' ELSE 'int64' END AS negated FROM customer""")
def q_negate_value(customer):
    key = F.col("c_custkey").cast("string")
    given = F.element_at(F.array(key, F.concat(F.lit('"'), "c_mktsegment", F.lit('"')), F.concat(F.lit('["'), key, F.lit('","x"]')), F.lit("float32")), (F.col("c_custkey") % 4 + 1).cast("int"))
    return customer.select("c_custkey", T.negated(given).alias("negated"))


@query("translations", sql="SELECT program_id, iteration, coalesce(verdict = 'ok', false) OR coalesce(contains(program, 'OK'), false) AS accepted FROM translations")
def q_accepted(translations):
    return translations.select("program_id", "iteration", T.accepted(F.col("verdict"), F.col("program")).alias("accepted"))


@query("events", sql="SELECT event_type, event_type IN ('click', 'purchase') AS allowed, count(*) AS n FROM events GROUP BY 1, 2")
def q_allowlist(events):
    name = F.concat(F.lit("app.page."), F.col("event_type"))
    return events.groupBy("event_type", T.allowed(name, ["click", "purchase", "page.view"]).alias("allowed")).agg(F.count("*").alias("n"))


@query("evaluators", sql="""
WITH i AS (SELECT case_id, json_extract(program_info, '$.init_local_info') AS info FROM evaluators WHERE json_valid(program_info))
SELECT case_id, array_to_string(json_extract_string(info, '$[*][0]'), ',') AS names FROM i WHERE json_type(info) = 'ARRAY'""")
def q_variable_names(evaluators):
    valid = evaluators.where(F.try_parse_json("program_info").isNotNull()).select("case_id", F.get_json_object("program_info", "$.init_local_info").alias("info"))
    return valid.where("info like '[%'").select("case_id", F.array_join(T.variable_names(F.col("info")), ",").alias("names"))


@query("events", sql="SELECT event_id, '{\"k\": ' || json_extract_string(props, '$.k') || ', \"op\": \"' || event_type || '\"}' AS segment FROM events")
def q_json_candidates(events):
    """Of the objects in a text, the largest that has the wanted field."""
    text = F.concat(F.lit("first {\"schema\": \"a longer object without the wanted field\"} then "), F.lit('{"op": "'), "event_type", F.lit('", "k": '), F.get_json_object("props", "$.k"), F.lit("} and {broken"))
    found = T.json_candidates(events.select("event_id", text.alias("text")), ["event_id"], "text")
    return T.best_candidate(found, ["event_id"], ["op"])


@query("code_messages", sql="""
WITH c AS (SELECT request_id, item_id, string_split(code, chr(10)) AS lines FROM code_messages WHERE length(code) > 0)
SELECT request_id, item_id, 'NameError' AS error_type, 'name is not defined' AS message, 2 AS line_no, lines[2] AS line_text FROM c""")
def q_error_summary(code_messages):
    c = code_messages.where("length(code) > 0")
    e = T.error_summary(F.lit("NameError: name is not defined"), F.col("code"), F.lit(2))
    return c.select("request_id", "item_id", e.alias("e")).select("request_id", "item_id", "e.*")


@query("documents", sql="SELECT doc_id, 'Example ' || doc_id || chr(10) || chr(10) || 'lang=' || coalesce(lang, '?') || chr(10) || chr(10) || 'chars=' || n_chars || chr(10) || chr(10) || printf('%.3f', n_chars / 1000.0) AS example FROM documents")
def q_example_text(documents):
    return documents.select("doc_id", F.concat_ws("\n\n", F.concat(F.lit("Example "), F.col("doc_id").cast("string")), F.concat(F.lit("lang="), F.coalesce("lang", F.lit("?"))), F.concat(F.lit("chars="), F.col("n_chars").cast("string")), F.format_string("%.3f", F.col("n_chars") / 1000.0)).alias("example"))


@query("events", sql="""
WITH v AS (SELECT user_id, json_extract_string(props, '$.k') AS k, min((ts, event_id)) AS f FROM events GROUP BY 1, 2)
SELECT user_id, k, 'user_constant_' || (row_number() OVER (PARTITION BY user_id ORDER BY f) - 1) AS name FROM v""")
def q_constant_names(events):
    """Each new constant of a trace gets the next name; one seen before keeps its own."""
    from pyspark.sql import Window

    v = events.groupBy("user_id", F.get_json_object("props", "$.k").alias("k")).agg(F.min(F.struct("ts", "event_id")).alias("f"))
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("f")) - 1
    return v.select("user_id", "k", F.concat(F.lit("user_constant_"), n.cast("string")).alias("name"))
