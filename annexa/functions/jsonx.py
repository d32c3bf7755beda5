"""JSON in text cells."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import _c

#: Quotes, braces, and escaped signs.
_SIGNS = re.compile(r'\\.|["{}]', re.S)


def unfenced(c) -> Column:
    inner = F.regexp_extract(_c(c), r"```(?:json)?\s*([\s\S]*?)```", 1)
    return F.when(inner != "", inner).otherwise(_c(c))


def first_object(c) -> Column:
    """From the first brace to the last, with trailing commas dropped; null without one."""
    body = F.regexp_extract(unfenced(c), r"(?s)(\{.*\})", 1)
    return F.nullif(F.regexp_replace(body, r",\s*([}\]])", "$1"), F.lit(""))


def field(c, name: str, default: str = "N/A") -> Column:
    return F.coalesce(F.get_json_object(first_object(c), "$." + name), F.lit(default))


def lenient(c, schema: str) -> Column:
    """The object, single quotes and bare names allowed; a malformed one gives null fields."""
    return F.from_json(first_object(c), schema, {"allowSingleQuotes": "true", "allowUnquotedFieldNames": "true", "mode": "PERMISSIVE"})


def list_of_text(c) -> Column:
    return F.coalesce(F.from_json(_c(c), "array<string>"), F.array().cast("array<string>"))


@F.pandas_udf(T.StringType())
def _balanced(texts: pd.Series) -> pd.Series:
    def one(t: str | None) -> str | None:
        depth = start = 0
        quoted = False
        for m in _SIGNS.finditer(t or ""):
            sign = m.group()
            if sign == '"':
                quoted = not quoted
            elif quoted or len(sign) > 1:
                continue
            elif sign == "{":
                start, depth = (m.start() if depth == 0 else start), depth + 1
            elif depth:
                depth -= 1
                if depth == 0:
                    return t[start : m.end()]
        return None

    return texts.map(one, na_action="ignore")


def balanced_object(c) -> Column:
    """The first object whose braces balance outside of quoted text, behind a fence if there is one; null without one."""
    return _balanced(unfenced(c))


#: Words of other notations, character references, and the names a nested explanation goes by.
WORDS = {"None": "N/A", "True": "yes", "False": "no", "true": "true", "false": "false"}
REFERENCES = {"&quot;": '"', "&#34;": '"', "&#39;": "'"}
EXPLANATIONS = ("justification", "reason", "explanation", "rationale")
PAIRS = {'"': '"', "'": "'", "“": "”", "‘": "’"}

#: What object text is made of: quoted text (an apostrophe within a word does not end it), signs, bare words.
_LEXEME = re.compile(r'''"(?P<double>(?:[^"\\]|\\.)*)"|'(?P<single>(?:[^'\\]|\\.|(?<=\w)'(?=\w))*)'|(?P<sign>[{}\[\]:,])|(?P<bare>[^\s{}\[\]:,"']+)''', re.S)
_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|(.))", re.S)
_CONTROL = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def _plain(quoted: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m.group(1), 16)) if m.group(1) else _CONTROL.get(m.group(2), m.group(2)), quoted)


def members(text: str) -> dict[str, str]:
    """The members of the first object in a text, nested ones as they stand; what cannot be read ends it.

    Either kind of quotes, bare names and words, surplus commas and a missing end are taken as they come.
    """
    found: dict[str, str] = {}
    start = text.find("{")
    if start < 0:
        return found
    name, value, colon, depth, nested, at = None, [], False, 1, 0, start + 1

    def close() -> None:
        if name is not None and colon and value:
            found.setdefault(name, " ".join(value))

    while depth:
        m = _LEXEME.search(text, at)
        if not m:
            break
        if text[at : m.start()].strip():  # a quotation mark without its partner
            break
        at, sign = m.end(), m.group("sign")
        word = m.group("bare")
        word = WORDS.get(word, word) if word is not None else None
        if word is None and not sign:
            word = _plain(m.group("double") if m.group("double") is not None else m.group("single"))
        if sign in ("{", "["):
            nested = m.start() if depth == 1 else nested
            depth += 1
        elif sign in ("}", "]"):
            depth -= 1
            if depth == 1 and colon:
                value.append(text[nested : m.end()])
        elif depth == 1 and sign == ",":
            close()
            name, value, colon = None, [], False
        elif depth == 1 and sign == ":" and not colon:
            colon = True
        elif depth == 1 and word is not None:
            if colon:
                value.append(word)
            else:
                name = word
    close()
    return found


def _freed(text: str) -> str:
    """A text without references and the quotation marks around it."""
    for name, sign in REFERENCES.items():
        text = text.replace(name, sign)
    text = text.strip()
    while len(text) > 1 and PAIRS.get(text[0]) == text[-1]:
        text = text[1:-1].strip()
    return text


def _explained(text: str) -> str:
    """A justification; one that is an object again gives its own."""
    inner = members(text) if text.startswith("{") and text.endswith("}") else {}
    return next((inner[k] for k in EXPLANATIONS if k in inner), text)


@F.pandas_udf(T.StructType([T.StructField("answer", T.StringType()), T.StructField("justification", T.StringType())]))
def _read(replies: pd.Series) -> pd.DataFrame:
    read = [members(t or "") for t in replies]
    return pd.DataFrame({"answer": [m.get("answer", "").strip().lower() for m in read], "justification": [_freed(_explained(m.get("justification", "").strip())) for m in read]})


def reply(c, free_text: bool = False) -> Column:
    """struct<answer, justification> of a model's reply, read by a tolerant scanner of its first object.

    answer is yes, no, na or fail (an answer field holding one of the words,
    in this order, counts). A justification that is an object again gives its
    own justification, reason, explanation or rationale. free_text: where no
    field says it, the first of na, yes and no found anywhere in the reply does.
    """
    raw = F.coalesce(_c(c), F.lit(""))
    read = _read(unfenced(raw))
    said = read["answer"]
    word = F.when(said == "na", "na").when(said.contains("yes"), "yes").when(said.contains("no"), "no").when(said.contains("na"), "na")
    if free_text:
        low = F.lower(raw)
        word = F.coalesce(word, F.when(low.rlike(r"\bna\b"), "na").when(low.rlike(r"\byes\b"), "yes").when(low.rlike(r"\bno\b"), "no"))
    return F.struct(F.coalesce(word, F.lit("fail")).alias("answer"), read["justification"].alias("justification"))
