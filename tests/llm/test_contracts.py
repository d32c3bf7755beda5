"""Contracts of single operators, against brute force where there is no SQL."""

import math
from collections import defaultdict

import numpy as np
import pytest

from annexa.llm import chat, cover_tree, html_template, lsh_forest, mixing, packing, quality, warc
from tests.conftest import SF


def test_archive_without_id(spark):
    kinds = "page_id long, url string, html string, digest int, first string, hot int"
    rows = [(3, "a", "same", 1, "x", 1), (5, "b", "same", 1, "x", 1), (None, "c", "same", 1, "x", 1), (None, "d", "lone", 1, "x", 1), (None, "e", None, 1, "x", 1), (None, "f", None, 1, "x", 1), (9, "g" * 9, "z" * 3_000_000, 1, "x", 1)]
    for hot in (1, 100_000):
        pages = spark.createDataFrame(rows, kinds).select("page_id", "url", "html")
        got = {(r["url"], r["page_id"], r["first"]) for r in warc.marked(pages, hot_rows=hot).collect()}
        assert got == {("a", 3, None), ("b", 5, 3), ("c", None, 3), ("d", None, None), ("e", None, None), ("f", None, None), ("g" * 9, 9, None)}
    back = warc.archive_pages(spark.createDataFrame(rows, kinds)).collect()
    assert sorted((r["url"], r["record_type"], r["refers_to"]) for r in back if r["payload_bytes"] == 4) == [("a", "response", None), ("b", "revisit", 3), ("c", "revisit", 3), ("d", "response", None)]
    assert sum(r["payload_bytes"] == 3_000_000 for r in back) == 1


def plan(rows, weights, ratio, tilt):
    """The mix by brute force: (doc_id, th) -> copies, from rows of (doc_id, th, source, size, u)."""
    per = defaultdict(list)
    for r in rows:
        per[r["source"]].append(r)
    order = sorted(per, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(r["size"] for r in per[s]) for s in order}
    goal, open_, left = dict.fromkeys(order, 0.0), [s for s in order if total[s]], float(sum(total.values()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    while open_:
        share = {s: weight[s] * left / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] >= ratio * total[s]]
        if not over:
            goal |= share
            break
        for s in over:
            goal[s] = ratio * total[s]
            left -= goal[s]
        open_ = [s for s in open_ if s not in over]
    out = {}
    for s in order:
        some = [r for r in per[s] if r["size"]]
        out |= {(r["doc_id"], r["th"]): 0 for r in per[s]}
        if not some or not goal[s]:
            continue
        classes = defaultdict(lambda: [0, 0])  # sizes of a 64th of an octave have one chance
        for r in some:
            k = classes[math.floor(math.log2(r["size"]) * 64)]
            k[0] += 1
            k[1] += r["size"]
        lo, hi = 0.0, ratio / min((w / n) ** tilt for n, w in classes.values()) * 1.01
        for _ in range(200):
            c = (lo + hi) / 2
            lo, hi = (c, hi) if sum(w * min(ratio, c * (w / n) ** tilt) for n, w in classes.values()) < goal[s] else (lo, c)
        ranked, need = [], goal[s]
        for r in some:
            e = min(ratio, hi * r["size"] ** tilt)
            out[r["doc_id"], r["th"]] = math.floor(e)
            need -= math.floor(e) * r["size"]
            if e - math.floor(e) > 1e-9:
                p, u = e - math.floor(e), r["u"]
                ranked.append((u / (1 - u) * (1 - p) / p, r["doc_id"], r))
        for _, _, r in sorted(ranked, key=lambda x: x[:2]):
            if r["size"] / 2 > need:
                break
            out[r["doc_id"], r["th"]] += 1
            need -= r["size"]
    return out, goal


def test_mix_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.word_counts(docs).collect()
    want, goal = plan(rows, mixing.WEIGHTS, 3.0, 0.25)
    got = mixing.mix_sources(docs).collect()
    assert {(r["doc_id"], r["th"]): r["copies"] for r in got} == want
    assert all(r["target"] == pytest.approx(goal[r["source"]]) for r in got)


def test_mix_draws_by_text(spark):
    docs = spark.createDataFrame([(None, f"text number {i} of forty", "s") for i in range(40)], "doc_id long, text string, source string")
    assert mixing.word_counts(docs).select("u").distinct().count() == 40


def test_nearest_is_exact_on_small_tables_and_counts_ids_once(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(8).astype(float).tolist(), "x", 1) for i in range(300)] + [(7, [9.0] * 8, "x", 1), (20, [-9.0] * 8, "x", 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, ids string, shard int")
    held = {}
    for i, v, *_ in rows:
        v = tuple(np.float32(v).tolist())
        held[i] = min(held.get(i, v), v)
    got = defaultdict(list)
    for r in lsh_forest.nearest(table).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    for q in range(0, 300, 20):
        want = sorted((-float(np.dot(np.float64(held[q]), np.float64(v))), i) for i, v in held.items() if i != q)
        assert got[q] == [i for _, i in want[:20]]


def test_nearest_recall_at_production_parameters():
    """One full shard of the hardest kind of vectors, isotropic in 64 dimensions."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((6144, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = x[:100]
    s = q.astype(float) @ x.T.astype(float)
    best = np.argsort(-s, axis=1)[:, :20]
    found = lsh_forest.search_shard(x, q, 20, 64, 0.6, 2048)
    assert np.mean([np.isin(b, at).mean() for b, (at, _) in zip(best, found, strict=True)]) >= 0.9


def test_notice_that_never_varies_is_template(spark):
    page = "<html><body><article><h1>Title {0}</h1><div class='plain'>Read this first.</div><div class='text'><p>Body {0} {0}</p></div><p>More {0}</p></article></body></html>"
    rows = [(i, "http://a.example/x", page.format(i), 1, "t") for i in range(8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host int, template string")
    got = {r["page_id"]: r["text"] for r in html_template.extract_main_text(pages).collect()}
    assert got == {i: f"Title {i}\n\nBody {i} {i}\n\nMore {i}" for i in range(8)}
    same = spark.createDataFrame([(i, "http://a.example/x", page.format(1)) for i in range(8)], "page_id long, url string, html string")
    assert all("Body 1 1" in r["text"] for r in html_template.extract_main_text(same).collect())  # nothing varies: nothing is known


def test_menu_below_deep_nesting(spark):
    deep = "<section>" * 70 + "<nav><div>MENU {0}</div></nav><p>Low {0}</p>" + "</section>" * 70
    rows = [(i, "http://a.example/x", f"<body><article><p>First {i}</p>{deep.format(i)}<p>Last {i}</p></article></body>") for i in range(4)]
    got = {r["page_id"]: r["text"] for r in html_template.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"First {i}\n\nLow {i}\n\nLast {i}" for i in range(4)}


def test_chat_of_any_length_and_repeats(spark):
    long = "word </s> [x] " * 100_000
    rows = [(1, 0, "user", long, 5, True), (1, 1, "assistant", long, 5, True), (1, 1, "assistant", long, 5, True), (2, 0, "user", "", 5, True), (2, 1, "assistant", None, 5, True)]
    made = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, level int, ok boolean")).where("checked IS NULL")
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["parsed"]] for r in made.collect()}
    assert got == {1: [("user", long), ("assistant", long), ("assistant", long)], 2: [("user", ""), ("assistant", "")]}


def test_quality_of_repeats_and_long_texts(spark):
    docs = spark.createDataFrame([(i % 40, ("good words here " if i % 2 else "bad spam stuff ") * (1 + 30_000 * (i == 3)), 1.0) for i in range(80)], "doc_id long, text string, rank double")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    got = quality.classify_quality(docs, labels).collect()
    assert len(got) == 80 and all(0 <= r["score"] <= 1 for r in got)
    by = defaultdict(set)
    for r in got:
        by[r["text"]].add(r["score"])
    assert all(len(v) == 1 for v in by.values())


def test_near_dedup_clashing_columns_and_repeats(spark):
    rows = [(1, [1.0, 0.0], 1, 5, "c"), (1, [1.0, 0.0], 1, 5, "c"), (2, [2.0, 0.01], 1, 5, "c"), (3, [0.0, 1.0], 1, 5, "c"), (4, [1.0, 0.0], 2, 5, "c"), (5, [1.0, 0.0, 0.0], 1, 5, "c")]
    got = cover_tree.near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, cell int, vec string")).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True)]


def test_pack_long_text_repeats_and_clashing_columns(spark):
    import public_tokenizers

    rows = [(1, "hello " * 50_000, 1, "s"), (2, "Hello, wörld!", 1, "s"), (2, "Hello, wörld!", 1, "s"), (None, None, 1, "s"), (3, "É" * 30_000, 1, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, salt int, length string")
    got = packing.pack_best_fit(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert sum(r["length"] for r in got if r["doc_id"] == 1) == 50_001 and sum(r["doc_id"] == 2 for r in got) == 2
    assert [r["length"] for r in got if r["doc_id"] is None] == [1]
    fill = defaultdict(list)
    for r in got:
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096


def test_word_ids_equal_the_tokenizer():
    import public_tokenizers
    import pyarrow as pa

    odd = ["don't STOP!!", "Éa «x» É.", "ﬁne ª º µm ÿÝ", "a b c", "é x́ é", "İstanbul ΑΣ Σ. straße ẞ", "\x1c x\x1fy", "", None, " a ", "...a...!?x", "1234 12a3", "漢字かな 한국", "<|endoftext|> </w>", "ÀÖ×÷ØÞ, x;;"]
    own = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    for _ in range(2):  # new words, then known ones
        ids, n = own.of(pa.array(odd, pa.string()))
        at = 0
        for text, k in zip(odd, n.tolist(), strict=True):
            assert ids[at : at + k].tolist() == own.tokenizer.encode(text or "", add_special_tokens=False).ids
            at += k
