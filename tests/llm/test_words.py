"""Words are told apart by their bytes, however long or regular they are."""

import numpy as np
import pyarrow as pa

from annexa.llm import words
from annexa.llm.jaccard_join import ngram_jaccard_join
from annexa.llm.substring_dedup import substring_dedup


def thue_morse(bits):
    a = "a"
    for _ in range(bits):
        a += a.translate({97: "b", 98: "a"})
    return a, a.translate({97: "b", 98: "a"})


def two_documents(spark):
    """Equal but for one word, a long periodic one and its mirror image."""
    one, other = thue_morse(11)
    rest = [f"w{i}" for i in range(19)]
    rows = [(1, " ".join([*rest[:9], one, *rest[9:]])), (2, " ".join([*rest[:9], other, *rest[9:]]))]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_regular_words_differ():
    a, b, n = words.hashed(pa.array([" ".join(thue_morse(11)), None, " x  x ", "X\tx"]))
    assert n.tolist() == [2, 0, 2, 2]
    assert a[0] != a[1] and b[0] != b[1] and a[2] == a[3] == a[5] != a[4]
    assert len(set(words.hashed(pa.array(["X x"]), lower=True)[0].tolist())) == 1


def test_removal_compares_words(spark):
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup(two_documents(spark)).collect()}
    assert got == {1: 0, 2: 0}


def test_links_compare_words(spark):
    got = {r["doc_id"]: r["component_id"] for r in ngram_jaccard_join(two_documents(spark), n=3, percent=90).collect()}
    assert got == {1: 1, 2: 2}


def test_very_long_texts_and_clashing_columns(spark):
    long = " ".join(f"v{i}" for i in range(200_000))
    rows = [(1, long, "s", 1, 1), (2, "x " + long, "s", 1, 1), (2, "x " + long, "s", 1, 1), (3, None, None, 1, 1), (4, "y" * 3_000_000, "s", 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, th int, key int")
    gone = sorted((r["doc_id"], r["n_removed"]) for r in substring_dedup(docs).collect())
    assert gone == [(1, 0), (2, 200_000), (2, 200_000), (3, 0), (4, 0)]
    linked = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_jaccard_join(docs, n=3, percent=90).collect())
    assert linked == [(1, 199_998, 1), (2, 199_999, 1), (2, 199_999, 1), (3, 0, 3), (4, 1, 4)]


def test_hash_halves_keep_all_bits():
    from annexa.llm.postings import by_bucket, pack_rest, unpack_rest

    h = np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for bits in (8, 13, 21):
        for bucket, at in by_bucket(h, bits):
            back = (np.uint64(bucket >> (bits - 8) << 56)) + unpack_rest(pack_rest(h[at], True), True)
            assert (back == h[at]).all()
