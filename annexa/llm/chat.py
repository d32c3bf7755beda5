"""Chat formatting with a grammar round trip (operator 5), all in DataFrame functions.

Template, one line of grammar per turn::

    turn  := "<s>[" tag "] " text " [/" tag "]</s>"
    tag   := "SYS" | "INST" | "ANS" | "ROLE:" escaped role ; then "!" if the text is escaped

Escapes are reversible: ``~`` -> ``~0``, ``<`` -> ``~1``, ``[`` -> ``~2``,
``]`` -> ``~3``; no control string is left in an escaped text. A conversation is
rendered with raw texts and parsed again by the deterministic parser below. If
the recovered turns differ from the source, the texts holding ``<``, ``[`` or
``]`` are escaped; if they differ still, every text is. The loss mask covers
the texts of assistant turns: spans (start, length) in code points.

Cases: null text or role is empty; a null conv_id is one conversation; rows of
one turn number are ordered by role and text, a null turn comes first, repeated
rows stay; empty tables give none; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The roles with tags of their own.
TAGS = {"system": "SYS", "user": "INST", "assistant": "ANS"}


def escaped(c: Column) -> Column:
    for raw, code in (("~", "~0"), ("<", "~1"), ("[", "~2"), ("]", "~3")):
        c = F.replace(c, F.lit(raw), F.lit(code))
    return c


def unescaped(c: Column) -> Column:
    for raw, code in (("]", "~3"), ("[", "~2"), ("<", "~1"), ("~", "~0")):
        c = F.replace(c, F.lit(code), F.lit(raw))
    return c


def _tag(role: Column) -> Column:
    out = F.concat(F.lit("ROLE:"), escaped(role))
    for name, tag in TAGS.items():
        out = F.when(role == name, F.lit(tag)).otherwise(out)
    return out


def _role(tag: Column) -> Column:
    out = unescaped(F.substring(tag, 6, 1 << 30))
    for name, own in TAGS.items():
        out = F.when(tag == own, F.lit(name)).otherwise(out)
    return out


def render(turns: Column, level: int) -> Column:
    """The conversation's text; level 0 escapes no text, 1 those with control signs, 2 all."""

    def one(t: Column) -> Column:
        flag = {0: F.lit(False), 1: t["text"].rlike(r"[<\[\]]"), 2: F.lit(True)}[level]
        tag = F.concat(_tag(t["role"]), F.when(flag, F.lit("!")).otherwise(F.lit("")))
        return F.concat(F.lit("<s>["), tag, F.lit("] "), F.when(flag, escaped(t["text"])).otherwise(t["text"]), F.lit(" [/"), tag, F.lit("]</s>"))

    return F.array_join(F.transform(turns, one), "")


def parse(formatted: Column) -> Column:
    """array<struct<role, text, body, width>>: turns read back; body is the text as it stands, width the turn's code points.

    A part that the grammar does not allow gives a null role.
    """
    parts = F.split(formatted, "</s>", -1)
    parts = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))

    def one(p: Column) -> Column:
        mark = F.regexp_extract(p, r"\A<s>\[([^\[\]<]*)\] ", 1)
        head, tail = F.length(mark) + F.lit(7), F.length(mark) + F.lit(4)
        end = F.concat(F.lit(" [/"), mark, F.lit("]"))
        good = (mark != "") & F.endswith(p, end) & (F.length(p) >= head - 1 + tail)
        body = F.substr(p, head, F.length(p) - head - tail + 1)
        flag = F.endswith(mark, F.lit("!"))
        tag = F.when(flag, F.substr(mark, F.lit(1), F.length(mark) - 1)).otherwise(mark)
        return F.struct(
            F.when(good, _role(tag)).alias("role"), F.when(flag, unescaped(body)).otherwise(body).alias("text"),
            body.alias("body"), head.alias("head"), (F.length(p) + F.lit(4)).alias("width"), flag.alias("escaped"),
        )

    return F.transform(parts, one)


def _same(parsed: Column, turns: Column) -> Column:
    plain = F.transform(parsed, lambda p: F.struct(F.coalesce(p["role"], F.lit("\0")).alias("role"), p["text"].alias("text")))
    return plain == turns


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once a row, and not again in each expression that later uses them.

    The optimiser writes a column's expression into its users but not through a generator.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def format_chats(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, level, parsed (turns read back), loss_spans (start, length, escaped) by conversation."""
    text = F.coalesce(F.col("text"), F.lit(""))
    role = F.coalesce(F.col("role"), F.lit(""))
    one = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    convs = one.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    convs = convs.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    # Each level's text is parsed and compared; the first that comes back identical stands.
    for level in (0, 1, 2):
        made = render(F.col("turns"), level)
        open_ = F.lit(True) if level == 0 else ~F.col("ok")
        now = lambda new, old: new if level == 0 else F.when(open_, new).otherwise(F.col(old))  # noqa: B023, E731
        convs = settled(convs, formatted=now(made, "formatted"), level=now(F.lit(level), "level"))
        convs = settled(convs, parsed=now(parse(F.col("formatted")), "parsed"))
        convs = settled(convs, ok=now(_same(F.col("parsed"), F.col("turns")), "ok"))
    convs = convs.withColumn("checked", F.assert_true(F.col("ok"), F.lit("a conversation does not survive its round trip")))

    def span(acc: Column, p: Column) -> Column:
        here = F.struct((acc["at"] + p["head"] - 1).alias("start"), F.length(p["body"]).alias("length"), p["escaped"].alias("escaped"))
        return F.struct((acc["at"] + p["width"]).alias("at"), F.when(p["role"] == "assistant", F.array_append(acc["spans"], here)).otherwise(acc["spans"]).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int,escaped:boolean>>").alias("spans"))
    spans = F.aggregate("parsed", start, span, lambda acc: acc["spans"])
    return convs.select("conv_id", "formatted", "level", "parsed", spans.alias("loss_spans"), "checked")
