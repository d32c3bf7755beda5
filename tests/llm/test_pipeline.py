"""The pipeline, stage by stage, against brute force on the stage's own input; and the queries' SQL."""

import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from annexa.llm import mixing, quality, queries
from tests.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def near_groups(rows, n=5, percent=80):
    """Groups by brute force, at the pipeline's five words and 80 percent."""
    sets = {}
    for r in rows:
        w = [x.translate({k: k + 32 for k in range(65, 91)}) for x in WORD.findall(r["text"] or "")]
        sets[r["doc_id"]] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    before, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, SF).write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        assert name == "packing" or after.columns == corpus_pipeline.COLUMNS
        seen[name] = before.collect(), after.collect()
        before = after
    scores = {r["doc_id"]: r["score"] for r in quality.classify_quality(docs, labels).collect()}
    assert {r["doc_id"] for r in seen["quality"][1]} == {i for i, s in scores.items() if s >= 0.3}
    group = near_groups(seen["near_copies"][0])
    assert {r["doc_id"] for r in seen["near_copies"][1]} == set(group.values())
    windows, expected = set(), {}
    for r in sorted(seen["repeats"][0], key=lambda r: r["doc_id"]):
        w, dead = r["text"].encode().split(), set()
        for k in range(len(w) - 19):
            g = tuple(w[k : k + 20])
            dead |= set(range(k, k + 20)) if g in windows else set()
            windows.add(g)
        expected[r["doc_id"]] = b" ".join(x for j, x in enumerate(w) if j not in dead).decode() if dead else r["text"]
    assert {r["doc_id"]: r["text"] for r in seen["repeats"][1]} == expected
    assert all(r["n_chars"] == len(r["text"]) for r in seen["repeats"][1])
    taken = [r["doc_id"] for r in seen["mixing"][1]]
    assert set(taken) <= set(expected) and max(map(taken.count, taken)) <= 3
    assert len({(r["sequence_id"], r["offset"]) for r in seen["packing"][1]}) == len(seen["packing"][1])
    assert sum(r["piece"] == 0 for r in seen["packing"][1]) == len(taken)


def test_stages_without_id_or_rows(spark, tmp_path):
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None if i % 7 == 0 else i, f"{'one two three ' * (1 + i % 5)}number {i}", "en", f"s{i % 3}", 1) for i in range(60)] + [(None, None, None, None, None), (7, "", "en", None, 0)]
    given = spark.createDataFrame(rows, kinds)
    copies = {}
    for r in mixing.mix_sources(given).collect():
        copies[r["doc_id"], r["th"]] = max(r["copies"], copies.get((r["doc_id"], r["th"]), 0))
    taken = corpus_pipeline.mix(spark, given, SF).select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")).collect()
    assert sorted(taken, key=str) == sorted((k for k, n in copies.items() for _ in range(n)), key=str)
    assert any(r["doc_id"] is None for r in taken)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, given.limit(0), SF).count() == 0
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, given, SF).write.parquet(f"{tmp_path}/{name}")
        given = spark.read.parquet(f"{tmp_path}/{name}")
    assert given.count() > 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = db.sql(queries.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted(map(repr, (tuple(r) for r in got.select(columns).collect())))
    assert rows == sorted(map(repr, want.select(*columns).fetchall()))


def test_registered():
    names = set(__spark_entry__.queries())
    assert {"pipeline", *queries.QUERIES} <= names and len([n for n in names if re.match(r"op\d+_", n)]) == 10


def test_quality_holds_out_by_checksum(spark):
    import zlib

    rows = spark.range(50).withColumnRenamed("id", "doc_id").select("doc_id", quality.held_out().alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
