"""op5's query reads the loss text from the formatted text under the loss mask."""

from pyspark.sql import functions as F

from annexa.llm import chat, queries
from tests.conftest import SF


def test_loss_text_comes_from_the_spans(spark, monkeypatch):
    right = {r["conv_id"]: r for r in queries.op5_chat_format(spark, SF).collect()}
    made = chat.format_chats

    def late(rows):
        spans = F.transform("loss_spans", lambda s: s.withField("start", s["start"] + 1))
        return made(rows).withColumn("loss_spans", spans)

    monkeypatch.setattr(chat, "format_chats", late)
    wrong = {r["conv_id"]: r for r in queries.op5_chat_format(spark, SF).collect()}
    spoken = [c for c, r in right.items() if r["loss_chars"] > 0]
    assert spoken and all(wrong[c]["loss_sha256"] != right[c]["loss_sha256"] for c in spoken)
    assert all(wrong[c]["turns_sha256"] == r["turns_sha256"] for c, r in right.items())
