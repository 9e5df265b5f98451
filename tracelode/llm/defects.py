"""Problem 1: prompts whose answer is defective, with the kind of defect.

Ordered rules look at the last delivery of each request: emptiness, refusal phrases in several languages, copied prompts,
unclosed delimiters and abrupt endings (the decision of cutoffs), and a mismatch of script or language. defects() gives
every triggered type; found() the one that explains the answer.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.llm import answers, cutoffs

# Phrases by which an answer declines, by language, each behind parts of which a text must have one. All speak in the first
# person and name the request or what it asks for; what programs or values can't do is no refusal.
DO_EN = "(?:help(?! but)|assist|comply|fulfil|provid|produc|writ|creat|generat|answer|do (?:this|that|so)|support|complete|proceed|carry (?:this|that) out|take (?:this|that) on)"
DO_DE = "(?:helfen|weiterhelfen|schreiben|erstellen|ausführen|beantworten|unterstützen|bearbeiten|erfüllen|liefern|herausgeben|behilflich sein|nachkommen|übernehmen)"
DO_FR = "(?:aider|répondre|traiter|écrire|fournir|produire|générer|rédiger|créer|réaliser|exécuter|donner suite|satisfaire|accéder|faire (?:cela|ceci|ça))"
DO_ES = "(?:ayudar|escribir|responder|atender|crear|proporcionar|generar|hacer (?:eso|esto)|cumplir|realizar|redactar|completar|complacer)"
REFUSALS = {
    "en": [
        (["refuse", "decline"], r"\b(?:i|we)(?: must| have to| need to|'ll have to| will have to|'m going to|'d rather)? (?:politely |respectfully )?(?:refuse|decline)\b"),
        (["can't", "cannot", "can not", "could not", "unable", "not able", "won't", "will not", "not going"], rf"\b(?:i|we)(?:'m| am|'re| are)? (?:sorry,? but )?(?:can(?:no|')t|can not|could not|unable to|not able to|won't|will not|not going to) (?:be able to |be )?{DO_EN}\w*"),
        (["unable", "not able"], rf"(?:^|[.!?:] |# ?)(?:sorry, )?(?:unable|not able) to {DO_EN}\w*"),
        (["will not be"], r"\b(?:i|we|and) will not be (?:generating|writing|providing|producing)\b"),
        (["'d rather", "not something i", "irresponsible of me", "don't write programs", "permissions that i"], r"\bi'd rather not\b|\bnot something i(?: will|'ll| can|'m)\b|\birresponsible of me\b|\bi don't write programs\b|\bpermissions that i don't have\b"),
        (["guidelines", "against my"], r"\b(?:my|our) guidelines (?:keep|prevent|forbid|stop|don't|do not)\b|\bagainst my (?:policy|policies|guidelines|rules|principles)\b"),
        (["sorry"], r"^(?:# ?)?sorry, (?:but )?no\b"),
        (["general topics"], r"\bi can only discuss general topics\b"),
        (["as a"], r"\bas an? (?:ai|assistant|language model)\b[^.]{0,20}\bi\b[^.]{0,20}\b(?:can(?:no|')t|decline|unable|refuse|not able|won't)\b"),
        (["not comfortable"], r"\bi(?:'m| am) not comfortable (?:with|writing|helping|doing)\b"),
        (["not to"], r"\bi (?:prefer|choose|would prefer|'d prefer) not to\b"),
    ],
    "de": [
        (["ablehn", "verweiger"], r"\b(?:(?:muss|möchte|werde) ich|ich (?:muss|möchte|werde)) (?:\w+ ){0,5}(?:ablehnen|verweigern)\b"),
        (["lehne"], r"\b(?:ich lehne|lehne ich)\b[^.!?\n]*\bab\b"),
        (["nicht", "kein"], rf"\b(?:kann|darf|werde|möchte|will) ich (?:\w+,? ){{0,6}}(?:nicht|kein\w*) (?:\w+ ){{0,3}}{DO_DE}\b|\bich (?:kann|darf|werde|möchte|will) (?:\w+ ){{0,6}}(?:nicht|kein\w*) (?:\w+ ){{0,3}}{DO_DE}\b"),
        (["nicht in der lage"], r"\b(?:ich bin|bin ich) (?:\w+ ){0,3}nicht in der lage\b"),
        (["richtlinien"], r"\bmeine richtlinien\b|\bgegen meine richtlinien\b"),
    ],
    "fr": [
        (["refus", "declin", "déclin"], r"\bje (?:me )?(?:dois|préfère|vais devoir|vois dans l'obligation de) (?:\w+ )?(?:refuser|décliner)\b|\bje (?:refuse|décline)\b"),
        (["je ne", "je n'"], rf"\bje (?:ne (?:peux|vais|veux|puis|pourrai)|n'arrive) (?:\w+ )?pas (?:\w+ ){{0,2}}(?:\w')?{DO_FR}|\bje ne (?:saurais|peux|puis) (?:\w+ )?(?:\w')?{DO_FR}|\bje ne suis (?:\w+ )?pas (?:en mesure|autorisée?|habilitée?)\b"),
        (["préfère ne"], rf"\bje préfère ne pas (?:\w+ )?(?:\w')?{DO_FR}"),
        (["impossible"], rf"\b(?:il m'est )?impossible (?:pour moi )?(?:de |d')(?:vous )?{DO_FR}"),
        (["mes "], r"\bmes (?:règles|consignes|directives) (?:\w+ )?(?:m'|ne me |me )"),
        (["interdi"], r"\bm'interdi\w+"),
    ],
    "es": [
        (["negarme", "rechaz", "rehusar", "declinar"], r"\b(?:debo|tengo que|prefiero|voy a) (?:negarme|rechazar|declinar|rehusar)\b|\brechazo (?:esta|esa|la|su|tu) (?:tarea|petición|solicitud)\b"),
        (["no "], rf"\bno (?:me es posible|puedo|podré|voy a|quiero|debo|pienso) (?:\w+ )?{DO_ES}\w*|\bprefiero no {DO_ES}\w*|\bno me está permitido\b|\bno (?:lo )?escribiré\b|\bno estoy (?:autorizad\w+|en condiciones)\b"),
        (["me niego"], r"\bme niego\b"),
        (["mis "], r"\bmis (?:normas|reglas|directrices|políticas) (?:no )?me\b"),
    ],
    "other": [
        (["não "], r"\bnão (?:posso|vou|consigo|me é possível) (?:\w+ )?(?:ajudar|escrever|responder|atender|criar|fornecer|gerar|fazer isso|cumprir)"),
        (["recusar", "rifiutare"], r"\bdevo recusar\b|\bdevo rifiutare\b"),
        (["non posso"], r"\bnon posso (?:\w+ )?(?:aiutar|scriver|risponder|fornir|crear|generar|eseguir|soddisfar)"),
        (["ik kan"], r"\bik kan (?:\w+ ){0,4}niet (?:helpen|schrijven|beantwoorden)\b"),
        (["не могу", "отказ"], r"не могу (?:\w+ )?(?:помочь|выполнить|написать|ответить)|\bя отказываюсь|вынужден\w* отказать"),
        (["无法", "不能", "拒绝", "抱歉"], r"我(?:无法|不能|拒绝)(?:为您|帮您)?(?:帮助|协助|提供|完成|编写|回答|满足|处理|执行)|抱歉[，,]\s*(?:我|无法|不能)"),
        (["できません", "도와드릴"], r"(?:お手伝い|お答え|対応|ご協力)できません|도와드릴 수 없"),
    ],
}
REFUSAL = [(hints, re.compile(pattern, re.M)) for group in REFUSALS.values() for hints, pattern in group]

# Frequent words that tell a language written in Latin letters, function words first, then those of comments.
FUNCTION_WORDS = {
    "en": "the a an of to and is are was were in on for with that this it as by from be has have not or at which into then than its each but so will can what when before after here there does if your you i we our per one all "
    "check field first store reply call calls entry value values result save keep read return program code runs works steps order following",
    "de": "der die das den dem des ein eine einen einem einer und ist sind war in im auf für mit dass dies es als von zu zum zur nicht oder bei wird werden hat haben noch nach aus über wenn ob danach darf alle kein keine zuerst ich sie wir an am hier pro "
    "prüfen feld speichern antwort aufruf aufrufe eintrag wert werte ergebnis lesen programm schritte reihenfolge folgende löst aufgabe",
    "fr": "le la les l un une des du de d et est sont dans sur pour avec que qui ce cette il elle en par au aux ne pas ou se a ont puis plus son sa ses tous toutes entre sans si je nous vous après voici dont à chaque "
    "vérifier champ abord garder réponse appel appels entrée valeur valeurs résultat lire programme étapes ordre suivant exécute résout tâche",
    "es": "el la los las un una unos unas de del y es son en con para por que este esta lo se al no o su sus como más ha han hay todavía si sin ayer pero aunque todos todas cuando primero después le yo aquí está qué cada "
    "comprobar campo guardar respuesta llamada llamadas entrada valor valores resultado leer programa pasos orden siguiente ejecuta resuelve tarea",
    "pt": "o a os as um uma de do da dos das e é são em no na nos nas com para por que este esta se ao à não ou seu sua como mais foi pode depois pelo pela será sem isto aqui está ele ela mas abaixo cada "
    "conferir campo primeiro guardar salvar resposta chamada chamadas entrada valor valores resultado ler programa passos ordem seguir executa resolve tarefa",
    "it": "il lo la i gli le un uno una di del della dei delle e è sono in nel nella con per che questo questa si al alla non o suo sua come più ha hanno anche dopo senza qui ma da dal ogni "
    "controllare campo prima salvare risposta chiamata voce valore valori risultato leggere programma passi ordine seguente esegue risolve compito",
    "nl": "de het een van en is zijn in op voor met dat dit die er niet of bij wordt worden heeft hebben nog na uit over als dan ook te naar wij ik hier geen alle elke "
    "controleren veld eerst opslaan antwoord aanroep invoer waarde waarden resultaat lezen programma stappen volgorde volgende voert lost taak",
    "pl": "i w na z do że się nie to jest są dla od po przez jak oraz ale ten ta tego każdy sprawdź pole najpierw zapisz odpowiedź wywołanie wpis wartość wynik czytaj program kroki kolejność następujący zadanie",
}
TELLING: dict[str, list[str]] = {}
for _lang, _words in FUNCTION_WORDS.items():
    for _w in set(_words.split()):
        TELLING.setdefault(_w, []).append(_lang)
SIGNS = {"ß": "de", "ñ": "es", "¿": "es", "¡": "es", "ã": "pt", "õ": "pt", "œ": "fr", "ł": "pl", "ę": "pl", "ż": "pl"}
SCRIPTS = [("ru", re.compile(r"[\u0400-\u04ff]")), ("zh", re.compile(r"[\u4e00-\u9fff\u3040-\u30ff]")), ("ko", re.compile(r"[\uac00-\ud7a3]")), ("ar", re.compile(r"[\u0600-\u06ff]")), ("el", re.compile(r"[\u0370-\u03ff]")), ("hi", re.compile(r"[\u0900-\u097f]")), ("he", re.compile(r"[\u0590-\u05ff]"))]
LATIN = re.compile(r"[^\W\d_]+")
COMMENT = re.compile(r"(?:^|\s)#\s*(.+)$")
FENCE_LINE = re.compile(r"^[ \t]*```\w*", re.M)
LIST_MARK = re.compile(r"^[^\S\n]*(\d+[.)]|[-*>•]+)[^\S\n]", re.M)
DOCSTRING = re.compile(r'"""(.*?)"""', re.S)


def languages(text: str) -> dict[str, float]:
    """Evidence per language: its script, else the distinct frequent words and signs that tell it."""
    plain = text.isascii()
    letters = 0 if plain else sum(map(str.isalpha, text))
    for name, script in SCRIPTS:
        if letters and len(script.findall(text)) * 4 > letters:
            return {name: 9.0}
    score: dict[str, float] = {}
    low = text.lower()
    for w in set(LATIN.findall(low)):
        told = TELLING.get(w, ())
        for k in told:
            score[k] = score.get(k, 0) + 1 / len(told)
    for sign, k in SIGNS.items() if not plain else ():
        if sign in low:
            score[k] = score.get(k, 0) + 1
    return score


def other_language(text: str, prompt: str) -> bool:
    asked, used = languages(prose_and_comments(prompt)), languages(prose_and_comments(text))
    if not asked or not used:
        return False
    own = max(asked, key=asked.get)
    best = max(used, key=used.get)
    return best != own and asked[own] >= 2 and used[best] >= 1.4 and used[best] > 1.4 * used.get(own, 0) + 0.4


def prose_and_comments(text: str) -> str:
    out = []
    for fenced, part in answers.blocks(text)[0]:
        code = fenced and answers.looks_like_code(part)
        for line in DOCSTRING.sub(" ", part).split("\n"):
            s = line.strip()
            if not s:
                continue
            if s.startswith("#"):
                out.append(s.lstrip("# "))
            elif not code and not answers.CODE_LINE.match(line):
                out.append(s)
            elif "#" in s and (m := COMMENT.search(answers.STRING.sub(" ", s))):
                out.append(m[1])
    return "\n".join(out)


def declines(text: str) -> bool:
    low = text.lower().replace("’", "'")
    return any(pattern.search(low) for hints, pattern in REFUSAL if any(h in low for h in hints))


def has_solution(text: str) -> bool:
    """Some line of code that is no comment, and does more than raise or print a refusal."""
    for _, part in answers.blocks(text)[0]:
        for line in DOCSTRING.sub(" ", part).split("\n"):
            s = line.strip()
            if s and not s.startswith("#") and answers.CODE_LINE.match(s) and s not in ("pass", "RESULT = None") and not s.startswith(("print(\"", "raise ")) and re.search(r"[=(]", s) and not declines(s):
                return True
    return False


def is_refusal(text: str) -> bool:
    """The answer declines and has no code that solves anything."""
    return declines(text) and not has_solution(text)


def plain_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def task_part(prompt: str) -> str:
    """What follows the prompt's last heading."""
    at = [m.end() for m in re.finditer(r"^#+ .*$", prompt, re.M)]
    return prompt[at[-1] :] if at else prompt


def is_copy(text: str, prompt: str) -> bool:
    """Nothing but the prompt or its task: nearly all runs of four words of the answer stand in the prompt, and they
    make up most of the task."""
    own, asked = plain_words(LIST_MARK.sub("", FENCE_LINE.sub("", text))), plain_words(prompt)
    if len(own) < 4 or len(asked) < 4:
        return bool(own) and own == asked
    theirs = f" {' '.join(asked)} "
    spare = (len(own) - 3) * 0.15
    # a list puts its own breaks between the sentences of the task; headings may be left out
    for i in range(len(own) - 3):
        if f" {own[i]} {own[i + 1]} {own[i + 2]} {own[i + 3]} " not in theirs:
            spare -= 1
            if spare < 0:
                return False
    runs = lambda x: set(zip(x, x[1:], x[2:], x[3:]))
    task = runs(plain_words(task_part(prompt)))
    return len(task & runs(own)) >= 0.6 * max(1, len(task))


def defect_types(kind: str, text: str | None, cut: bool, prompt: str | None) -> list[str]:
    """All types that apply, the one that explains the answer first."""
    if kind == "unreadable":
        return ["truncated"] if cut else ["empty"]
    parts = answers.blocks(text)[0] if text else []
    if not any(answers.visible(p) for _, p in parts):
        return ["empty"]
    out = []
    if is_refusal(text):
        out.append("refusal")
    if cut:
        out.append("truncated")
    if prompt and is_copy(text, prompt):
        out.append("copied")
    if prompt and other_language(text, prompt):
        out.append("other_language")
    return out


def _types(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for rid, kind, text, cut, prompt in zip(b["request_id"], b["kind"], b["text"], b["is_cut"], b["prompt"]):
            for i, t in enumerate(defect_types(kind, text, bool(cut), prompt)):
                rows.append((rid, t, i))
        yield pd.DataFrame(rows, columns=["request_id", "defect", "place"])


def defects(prompt_messages: DataFrame, raw_messages: DataFrame, chat_requests: DataFrame) -> DataFrame:
    """(request_id, defect, place): every type that the last delivery of a request triggers; place 0 is the one that
    explains it.

    The last delivery has the greatest received_at, null times come first and ties go to the greatest message_id.
    Requests without deliveries have no rows; without a prompt only empty, truncated and refusal are possible; null bodies
    are empty. Prompts given twice count once; empty tables give an empty result; further columns are not read.
    """
    order = F.struct(F.coalesce(F.col("received_at").cast("timestamp").cast("double"), F.lit(float("-inf"))), "message_id")
    last = raw_messages.where("request_id is not null").groupBy("request_id").agg(F.max_by("message_id", order).alias("message_id"))
    rows = cutoffs.parsed(raw_messages, chat_requests, last)
    texts = rows.where("is_last").select("request_id", "message_id", "kind", "text")
    cuts = cutoffs.judged(rows).where("is_last").select("request_id", "is_cut")
    prompts = prompt_messages.where("request_id is not null").groupBy("request_id").agg(F.max("prompt").alias("prompt"))
    # all by one key: each text moves once
    met = texts.join(cuts, "request_id").join(prompts, "request_id", "left")
    return met.select("request_id", "kind", "text", "is_cut", "prompt").mapInPandas(_types, "request_id bigint, defect string, place int")


def _code_types(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for rid, code, prompt in zip(b["request_id"], b["code"], b["prompt"]):
            text = code if not code or "```" in code else f"```python\n{code}\n```"
            rows += [(rid, t, i) for i, t in enumerate(defect_types("text", text, False, prompt))]
        yield pd.DataFrame(rows, columns=["request_id", "defect", "place"])


def code_defects(prompt_messages: DataFrame, code_messages: DataFrame) -> DataFrame:
    """(request_id, defect, place) of the code taken from answers: the types of defects() but truncated, which is decided on
    deliveries, and `missing` for a prompt without any row of code. Null and blank code is empty; equal rows count once."""
    prompts = prompt_messages.where("request_id is not null").groupBy("request_id").agg(F.max("prompt").alias("prompt"))
    code = code_messages.where("request_id is not null").select("request_id", "code").distinct()
    typed = code.join(prompts, "request_id", "left").select("request_id", "code", "prompt").mapInPandas(_code_types, "request_id bigint, defect string, place int")
    missing = prompts.join(code, "request_id", "left_anti").select("request_id", F.lit("missing").alias("defect"), F.lit(0).alias("place"))
    return typed.distinct().unionByName(missing)


def all_defects(prompt_messages: DataFrame, raw_messages: DataFrame, chat_requests: DataFrame, code_messages: DataFrame) -> DataFrame:
    """(request_id, defect, place, origin): defects() with origin `answer` and code_defects() with origin `code`."""
    answer = defects(prompt_messages, raw_messages, chat_requests).withColumn("origin", F.lit("answer"))
    return answer.unionByName(code_defects(prompt_messages, code_messages).withColumn("origin", F.lit("code")))


def found(prompt_messages: DataFrame, raw_messages: DataFrame, chat_requests: DataFrame) -> DataFrame:
    """(request_id, defect): the one defect of each defective request."""
    return defects(prompt_messages, raw_messages, chat_requests).where("place = 0").select("request_id", "defect").distinct()
