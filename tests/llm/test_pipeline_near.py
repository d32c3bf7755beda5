"""The near-copies stage links texts by five-word shingles at a similarity of 0.8."""

import corpus_pipeline
from tests.conftest import SF


def test_two_words_of_a_hundred_changed(spark):
    words = [f"w{i}" for i in range(100)]
    two, four = list(words), list(words)
    for k in (30, 60):  # 86 of 106 five-word shingles remain, 92 of 104 three-word shingles
        two[k] = f"x{k}"
    for k in (20, 40, 60, 80):  # 76 of 116 remain
        four[k] = f"y{k}"
    rows = [(i, " ".join(w), "en", "s", 1) for i, w in enumerate((words, two, four))]
    given = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, given, SF).collect()) == [0, 2]
