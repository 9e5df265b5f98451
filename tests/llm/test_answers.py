import json

import numpy as np
import pytest

from tracelode.llm import answers as A
from tracelode.llm import cutoffs as C
from tracelode.llm import defects as D

RAW = "message_id long, request_id long, source string, body string, received_at string, verdict string, items string"
CHAT = "request_id long, max_tokens int, tokens int"
PROMPT = "request_id long, prompt string, defect string"


def chat(text, tokens=10, finish="stop"):
    return json.dumps({"choices": [{"message": {"content": text}, "finish_reason": finish}], "usage": {"completion_tokens": tokens}})


def output(*texts):
    return json.dumps({"output": [{"content": [{"type": "output_text", "text": t} for t in texts]}], "usage": {"output_tokens": 9}, "status": "completed"})


def test_shapes_of_bodies():
    assert A.answer(chat("hi")).text == "hi" and A.answer(output("a", "b")).text == "ab"
    assert A.answer(chat([{"type": "text", "text": "x"}, {"type": "text", "text": "y"}])).text == "xy"
    assert A.answer(chat(None)).kind == "error" and A.answer('{"error": {"code": 503}}').kind == "error"
    assert A.answer('{"choices": [').kind == "unreadable" and A.answer(None).kind == "error" and A.answer("[]").kind == "error" and A.answer("3").kind == "error"


@pytest.mark.parametrize("text,want", [
    ("All steps are done.", "complete"), ("Here:\n```python\nx = f(1)\n```", "complete"), ("Here:\n```python\nx = f(1", "cut"), ("Here:\n```python\nx = f(1)", "cut"), ("x = f(1)\ny = g(", "cut"),
    ("x = f(1)\nif x > 2:", "cut"), ("x = f(1)\ny = 2", "unclear"), ("The steps are done", "unclear"), ("The value is 0.", "unclear"), ("It fits. ...", "complete"), ("It fi…", "unclear"),
])
def test_endings(text, want):
    parts, is_open = A.blocks(text)
    assert C.verdict(text, parts, is_open, C.segments(parts)[-1])[0] == want


def test_censored_fit_recovers_the_distribution():
    rng = np.random.default_rng(1)
    true = np.exp(rng.normal(6, 0.8, 20_000))
    seen, cut = np.minimum(true, 700), true > 700
    mu, sd = C.fit_lognormal(seen, np.ones(len(seen)), cut)
    assert abs(mu - 6) < 0.05 and abs(sd - 0.8) < 0.05
    assert C.fit_lognormal(np.array([5.0]), np.array([1.0]), np.array([False]))[1] > 0


SENTENCES = ["The session of {} keeps its title.", "Please store the value {} as text.", "After the call the result has {} rows.", "Nobody knows why the panel of {} waits."]


def corpus(n=240):
    rng = np.random.default_rng(2)
    name = lambda: "".join(rng.choice(list("bcdfgaeiou"), 7))
    text = lambda k: " ".join(SENTENCES[rng.integers(4)].format(name()) for _ in range(k))
    raw, cut = [], set()
    for i in range(n):
        t = text(3 + i % 5)
        if i % 10 == 3:
            t = t[: len(t) - 12]
            cut.add(i)
        elif i % 10 == 5:
            t = t[:-1]  # only the full stop is missing
        raw.append((i, i, "src" if i % 3 else None, chat(t, 20 + i % 7), "2025-01-01", "v", "w"))
    return raw, cut


def test_cut_answers(spark):
    raw, cut = corpus()
    raw += [(900, 900, "src", None, None, "", ""), (901, 901, "src", chat(""), "2025-01-01", "", ""), (902, 902, "src", chat("ok")[:30], "2025-01-01", "", ""), (903, 903, "src", chat("word " * 100_000 + "end."), "2025-01-01", "", "")]
    raw.append(raw[3])
    got = {r.message_id for r in C.cut_answers(spark.createDataFrame(raw, RAW), spark.createDataFrame([(i, 4096, 1) for i in range(200)], CHAT)).collect()}
    want = cut | {902}
    assert len(got & want) >= 0.9 * len(want) and len(got - want) <= 2


def test_empty_tables(spark):
    raw, req, prompts = spark.createDataFrame([], RAW), spark.createDataFrame([], CHAT), spark.createDataFrame([], PROMPT)
    assert C.cut_answers(raw, req).count() == 0 and C.cut_rates(raw, req).count() == 0 and D.found(prompts, raw, req).count() == 0


P = "Write one program that solves the task.\n\n## Task\nThe session of the group must be stored with its title, and then all of the values are read again."


@pytest.mark.parametrize("text,cut,want", [
    ("```python\nx = store(1)\nRESULT = x\n```", False, []), ("```\n\n```", False, ["empty"]), ("​ \n", False, ["empty"]), (None, False, ["empty"]), ("I must refuse.", False, ["refusal"]),
    ("I'm sorry for the slip; here it is.\n```python\nx = store(1)\n```", False, []), ("I cannot help with that request.\n```python\n# not provided\n```", False, ["refusal"]),
    ("Lo siento, no puedo ayudar con esa petición.", False, ["refusal"]), ("Diese Aufgabe muss ich ablehnen.", False, ["refusal"]), ("Je dois refuser d'écrire ce programme.", False, ["refusal"]),
    (P.upper(), False, ["copied"]), (P.split("## Task\n")[1], False, ["copied"]), ("```python\nx = sto", True, ["truncated"]), ("El código siguiente ejecuta los pasos en orden.\n```python\nx = store(1)\n```", False, ["other_language"]),
    ("代码按照步骤依次执行。", False, ["other_language"]), ("# one call per entry\nx = store(1)", False, []),
])
def test_defect_types(text, cut, want):
    assert D.defect_types("text" if text is not None else "error", text, cut, P)[:1] == want[:1]


def test_last_delivery_counts(spark):
    raw = [(1, 1, "s", chat(""), "2025-01-02"), (2, 1, "s", chat("```\nx = f(1)\n```"), "2025-01-03"), (3, 2, "s", chat("I must refuse."), "2025-01-05"), (4, 2, "s", chat("I must refuse."), "2025-01-05"), (5, 3, "s", chat("fine."), None), (6, 3, "s", '{"error": 1}', "2025-01-01"), (7, None, "s", chat(""), None), (8, 4, None, chat("I must refuse."), "2025-01-01")]
    df = spark.createDataFrame([(*r, "v", "w") for r in raw], RAW).selectExpr("*", "cast(received_at as timestamp) as at").drop("received_at").withColumnRenamed("at", "received_at")
    got = sorted(tuple(r) for r in D.found(spark.createDataFrame([(1, P, "x"), (2, P, "x"), (2, P, "x"), (3, None, "x")], PROMPT), df, spark.createDataFrame([(1, 100, 1)], CHAT)).collect())
    assert got == [(2, "refusal"), (3, "empty"), (4, "refusal")]


def test_a_word_in_five_answers_is_known_however_many_there_are(spark):
    common, five, four = 1000, 2000, 3000
    last = lambda i: five if i < 5 else four if i < 9 else common
    rows = [(i, [common, last(i)], [2], "unclear" if i in (0, 5) else "complete") for i in range(14_000)]
    df = spark.createDataFrame(rows, "message_id long, items array<long>, ends array<int>, verdict string")
    assert {r.message_id: r.named for r in C.endings(df).collect()} == {0: False, 5: True}


def test_defects_of_code_are_seen(spark):
    prompts = spark.createDataFrame([(i, "Write the titles of all sessions into RESULT and keep their order please.") for i in range(6)], "request_id long, prompt string")
    code = [(0, "RESULT = [s.title for s in sessions]"), (1, ""), (2, None), (3, " \n"), (3, " \n"), (4, "```python\n```")]
    df = spark.createDataFrame(code, "request_id long, code string")
    got = sorted(tuple(r) for r in D.code_defects(prompts, df).collect())
    assert got == [(1, "empty", 0), (2, "empty", 0), (3, "empty", 0), (4, "empty", 0), (5, "missing", 0)]


def test_defects_query_reads_the_code(spark, sf_dir):
    from tracelode.llm import queries as Q

    df = Q.p1_defects(spark, sf_dir)
    assert "origin" in df.columns and {r.origin for r in df.select("origin").distinct().collect()} == {"answer", "code"}


# Written without looking at the tables: what declines and what doesn't, in four languages.
DECLINES = [
    "I'm sorry, but I can't help with that.", "I must decline this request.", "We are not able to provide such a script.", "I won't write code that deletes accounts.", "Unfortunately I cannot complete this task.",
    "As an AI I can't place calls with a cloned voice.", "I would prefer not to do this.", "That is against my guidelines.", "I'm not comfortable writing this program.", "Sorry, no. Ask the owner of the data.",
    "Leider kann ich dabei nicht helfen.", "Ich muss diese Anfrage leider ablehnen.", "Das darf ich nicht ausführen.", "Ich werde dieses Programm nicht schreiben.", "Meine Richtlinien erlauben das nicht.", "Ich lehne diese Aufgabe ab.",
    "Je ne peux malheureusement pas vous aider.", "Je refuse d'écrire ce programme.", "Je ne suis pas autorisé à modifier ces données.", "Je dois décliner cette demande.", "Il m'est impossible de répondre à cette demande.",
    "Lo siento, no puedo ayudarte con eso.", "Debo negarme a escribir este programa.", "Me niego a hacerlo.", "No voy a generar ese código.", "Mis normas no me permiten responder.",
]
ANSWERS = [
    "The value cannot be provided as text, so it is stored as a number.", "The server must refuse connections on that port.", "Due to policy reasons the export runs at night.", "The token is not able to create sessions.", "Guidelines prevent duplicate ids.",
    "Retries will not be generating new rows.", "I can't help but notice that two filters are equal; here is the list.", "It could not be created twice, which the check shows.", "If the call is declined, the voice is kept.",
    "Ich werde die Werte nicht runden, sondern speichern.", "Der Wert kann nicht leer sein.", "Die Sitzung war nicht in der Lage, den Filter zu laden.", "Das Feld lehnt leere Texte ab.", "Ich kann hier nicht runden, daher steht der Wert als Text da.",
    "Je ne suis qu'un assistant, voici le résumé complet de la session.", "Le serveur refuse la connexion.", "La valeur ne peut pas être vide.", "Je ne vais pas arrondir la valeur : la voici.", "Il est impossible que la liste soit vide.",
    "El servidor rechaza la conexión.", "El valor no puede crearse dos veces.", "No debo redondear el valor; aquí está.", "Mis pasos son tres: leer, comprobar y guardar.", "No hay filtros en la sesión.",
]


def test_refusals_held_out():
    from tracelode.llm import defects

    found, wrong = [t for t in DECLINES if defects.is_refusal(t)], [t for t in ANSWERS if defects.is_refusal(t)]
    assert len(found) >= 0.9 * len(DECLINES) and not wrong, (set(DECLINES) - set(found), wrong)
