"""Texts of logged model answers: where they stand in a delivery's body, and how they are taken apart."""

from __future__ import annotations

import json
import re
from typing import NamedTuple

FENCE = re.compile(r"^[ \t]*```", re.M)
TOKEN = re.compile(r"[^\W\d_]\w*|\d+(?:\.\d+)?|[^\w\s]|_\w*", re.U)
STRING = re.compile(r"""f?"(?:[^"\\\n]|\\.)*"|f?'(?:[^'\\\n]|\\.)*'""")
BREAK_MARK = re.compile(r"(…|\.{3,}|[\[(<](…|\.{3,}|cut|truncated|snip|clipped|more|continued)[^\])>\n]{0,20}[\])>]?)$", re.I)
INVISIBLE = dict.fromkeys([*range(0x200B, 0x2010), 0x2060, 0xFEFF, 0x00AD, 0x180E, *range(0xFE00, 0xFE10)])


class Answer(NamedTuple):
    """kind: text, error, or unreadable. text: the answer; None where there is none."""

    kind: str
    text: str | None
    finish: str | None = None
    tokens: int | None = None


def _joined(content) -> str | None:
    if isinstance(content, str):
        return content
    if isinstance(content, list):
        parts = [p if isinstance(p, str) else p.get("text") for p in content if isinstance(p, str | dict)]
        return "".join(p for p in parts if isinstance(p, str))
    return None


def answer(body: str | None) -> Answer:
    """The answer in a body: choices[0].message.content or the texts below output[].content[]."""
    if body is None:
        return Answer("error", None)
    try:
        doc = json.loads(body)
    except (ValueError, RecursionError):
        return Answer("unreadable", body)
    if not isinstance(doc, dict):
        return Answer("error", None)
    usage = doc.get("usage") if isinstance(doc.get("usage"), dict) else {}
    tokens = usage.get("completion_tokens", usage.get("output_tokens"))
    tokens = tokens if isinstance(tokens, int) else None
    choices, output = doc.get("choices"), doc.get("output")
    if isinstance(choices, list) and choices and isinstance(choices[0], dict):
        message = choices[0].get("message")
        text = _joined(message.get("content")) if isinstance(message, dict) else None
        return Answer("text" if text is not None else "error", text, choices[0].get("finish_reason"), tokens)
    if isinstance(output, list):
        texts = [_joined(o.get("content")) for o in output if isinstance(o, dict)]
        texts = [t for t in texts if t is not None]
        details = doc.get("incomplete_details")
        finish = details.get("reason") if isinstance(details, dict) else doc.get("status")
        return Answer("text" if texts else "error", "".join(texts) if texts else None, finish if isinstance(finish, str) else None, tokens)
    return Answer("error", None)


def break_mark(text: str) -> str:
    """The mark at the end of a text that tells it was broken off, or ''."""
    m = BREAK_MARK.search(text, max(0, len(text) - 40))
    return m[0] if m else ""


def visible(text: str) -> str:
    return (text if text.isascii() else text.translate(INVISIBLE)).strip()


def blocks(text: str) -> tuple[list[tuple[bool, str]], bool]:
    """Parts of a text as (is inside a fence, text), and whether the last fence is open."""
    out, inside, at = [], False, 0
    for m in FENCE.finditer(text):
        out.append((inside, text[at : m.start()]))
        line = text.find("\n", m.end())
        at = len(text) if line < 0 else line + 1
        inside = not inside
    out.append((inside, text[at:]))
    return [p for p in out if p[1].strip()], inside


CODE_LINE = re.compile(r"^\s*(#|@|def |class |return\b|import |from \w+ import|for .+ in |if .+:|elif |else:|while |try:|except|with |assert |print\(|[\w.\[\]\"', ]+\s*(=|\+=)\s*\S|\w[\w.]*\(.*|[\])}]+,?$)")


def looks_like_code(part: str) -> bool:
    lines = [x for x in part.split("\n") if x.strip()]
    return bool(lines) and sum(bool(CODE_LINE.match(x)) for x in lines) * 2 > len(lines)


SENTENCE_END = re.compile(r"(?<=[.!?。！？])[\"')\]]*(?:\s+|(?<=[。！？])|$)|\n+")


def sentences(part: str) -> list[str]:
    """Sentences of prose, and items of lists; a number's point ends none."""
    return [s for s in (x.strip() for x in SENTENCE_END.split(part)) if s]
