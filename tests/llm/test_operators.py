"""Each operator against a brute-force version, and on odd rows: nulls, empties, ties, repeats, clashing columns."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from annexa.llm import chat, cover_tree, html_template, jaccard_join, lsh_forest, mixing, packing, quality, substring_dedup, warc
from annexa.llm.common import connected_components

WORD = re.compile(r"[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, th string, spots int, size int, u double, score string"


def docs(spark, rows):
    """rows of (doc_id, text, source), with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", 1, 2, 0.5, "s") for i, t, s in rows], DOCS).repartition(3)


def corpus(seed=3, n=60):
    """Copies, near copies and shared passages among random texts; nulls, blanks, ties and odd characters."""
    rng = random.Random(seed)
    text = lambda k: [f"w{rng.randrange(4000)}" for _ in range(k)]
    passage = text(45)
    rows = []
    for i in range(n):
        w = text(rng.choice([0, 1, 2, 3, 12, 40, 150]))
        if i % 5 == 0:
            w = w[:10] + passage[rng.randrange(20) :] + w[10:]
        if i % 7 == 0 and len(rows) > 10:
            w = list(rows[i - 3])
        if i % 11 == 0 and len(rows) > 10:
            w = list(rows[i - 2])
            if w:
                w[rng.randrange(len(w))] = "changed"
        rows.append(w)
    rows += [["a"] * 70, ["A"] * 70, ["é", "中", " x"] * 30]
    sep = [" ", "\n", "\t", "  "]
    out = [(i, "".join(x + sep[rng.randrange(4)] for x in w), f"s{i % 4}" if i % 9 else None) for i, w in enumerate(rows)]
    return [*out, (1000, None, "s1"), (1001, "", "s1"), (1002, " \n\t ", "s2")]


def word_list(t):
    return (t or "").encode().split()


def test_words_agree_with_the_pattern():
    t = "a\x0bb\x0cc d e\r\n f\x1cg"
    assert [x.decode() for x in t.encode().split()] == WORD.findall(t)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7), (200, 201)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {k for k, v in got.items() if v == 0} == set(range(41)) and got[100] == got[95] == got[90] == 90 and got[201] == 200
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_jaccard_join(spark):
    rows = corpus()
    sets = {}
    for i, t, _ in rows:
        w = [x.translate({k: k + 32 for k in range(65, 91)}) for x in WORD.findall(t or "")]
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]) and sets[b]:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    got = jaccard_join.ngram_jaccard_join(docs(spark, [*rows, (None, "no name here", "s"), rows[4]])).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["n_shingles"] == 1
        else:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), find(r["doc_id"]))
    assert len({find(i) for i in sets}) < len(sets)


def dedup_by_force(rows, window=20):
    seen, out = set(), {}
    for i, t, _ in sorted(rows, key=lambda r: r[0]):
        w, dead = word_list(t), set()
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            dead |= set(range(k, k + window)) if g in seen else set()
            seen.add(g)
        kept = b" ".join(x for j, x in enumerate(w) if j not in dead)
        out[i] = (len(w), len(dead), hashlib.sha256(kept).hexdigest(), kept.decode())
    return out


def test_substring_dedup(spark):
    rows = corpus()
    expected = dedup_by_force(rows)
    got = substring_dedup.substring_dedup(docs(spark, [*rows, rows[5], (None, "short", None)])).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_words"], r["n_removed"], r["kept_sha256"], r["kept_text"]) == expected[r["doc_id"]]
    assert sum(x[1] for x in expected.values()) > 100


def test_mixing(spark):
    rows = [(i, "w " * (1 + i * 37 % 90), ["big", "mid", "small", None][0 if i % 2 else i // 2 % 4]) for i in range(800)] + [(900, None, "big"), (901, "", "mid")]
    got = mixing.mix_sources(docs(spark, rows)).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_sources(docs(spark, rows)).collect()), key=str)
    total = sum(len(word_list(t)) for _, t, _ in rows)
    by = {}
    for r in got:
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"] and r["source_size"] >= r["size"]
        by.setdefault(r["source"], []).append(r)
    for x in by.values():
        assert abs(sum(r["taken"] for r in x) - x[0]["target"]) <= 90 and x[0]["target"] <= 3 * x[0]["source_size"] + 1e-6
    assert abs(sum(x[0]["target"] for x in by.values()) - total) < 1e-3 * total


def test_targets_stop_at_the_ratio():
    t = mixing.targets(np.array([10.0, 1000.0, 1000.0, 0.0]), np.array([5.0, 2.0, 1.0, 5.0]), 3.0)
    assert t[0] == 30 and t[3] == 0 and abs(t.sum() - 2010) < 1e-9 and abs(t[1] / t[2] - 2) < 1e-9


def test_plan_bins_is_valid_and_tight():
    rng = random.Random(5)
    for capacity in (12, 100, 4096):
        counts = {}
        for _ in range(3000):
            k = rng.choice([rng.randint(1, capacity), rng.randint(1, capacity // 3), capacity // 2, 1])
            counts[k] = counts.get(k, 0) + 1
        segments, bins = packing.plan_bins(counts, capacity)
        content, placed = {}, {}
        for length, rank, n, first, offset in segments:
            assert rank == placed.get(length, 0)
            placed[length] = rank + n
            for b in range(first, first + n):
                content.setdefault(b, []).append((offset, length))
        assert placed == counts and set(content) == set(range(bins))
        for x in content.values():
            at = 0
            for offset, length in sorted(x):
                assert offset == at
                at += length
            assert at <= capacity
        assert bins <= 1.12 * -(-sum(k * n for k, n in counts.items()) // capacity) + 1


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rows = [*corpus(), (2000, "It's İstanbul Σας x" * 400, "s"), (2001, "<|endoftext|> ok... A1b2", "s")]
    expected = {}
    for i, t, _ in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), 128):
            expected[i, k // 128] = (k, len(ids[k : k + 128]), zlib.crc32(ids[k : k + 128].tobytes()))
    got = packing.pack_best_fit(docs(spark, rows), path, capacity=128, keep_ids=True).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == expected and len(got) == len(expected)
    by = {}
    for r in got:
        assert len(r["ids"]) == r["length"]
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for x in by.values():
        ends = np.cumsum([n for _, n in sorted(x)])
        assert [o for o, _ in sorted(x)] == [0, *ends[:-1]] and ends[-1] <= 128


def test_quality(spark):
    rng = random.Random(1)
    good = lambda: " ".join(rng.choice(["the", "river", "stone", "walks", "under", "bright", "evening"]) + rng.choice(["", "s", "ly"]) for _ in range(60))
    bad = lambda: " ".join("".join(rng.choice("xqzkj$%#") for _ in range(7)) for _ in range(60))
    rows = [(i, good() if i % 3 else bad(), "s") for i in range(400)] + [(1000, None, "s"), (1001, "", "s")]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(400)] + [(5, 0, 0), (1000, 1, 0), (7, None, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in quality.classify_quality(docs(spark, rows), labels).collect()}
    hits = [(got[i] >= 0.3) == (i % 3 > 0) for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean(hits) > 0.95 and all(0 <= x <= 1 for x in got.values()) and got[1000] == got[1001]
    none = quality.classify_quality(docs(spark, rows), labels.limit(0)).select("score").distinct().collect()
    assert [r["score"] for r in none] == [pytest.approx(0.5)]


def test_chat(spark):
    odd = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (-1, 0, "user", odd), (-1, 1, "assistant", odd), (2, 1, "assistant", None), (2, 0, None, "~1 ~0 <s>[ANS!] "), (2, 2, "x] y<", " [/INST]"), (None, None, "system", ""), (3, 0, "user", "a"), (3, 0, "user", "a"), (4, 0, "user", "x [/INST]")]
    got = {r["conv_id"]: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for c in {r[0] for r in rows}:
        source = [(r or "", t or "") for _, _, r, t in sorted((x for x in rows if x[0] == c), key=lambda x: (x[1] or 0))]
        assert [(p["role"], p["text"]) for p in got[c]["parsed"]] == source
        f = got[c]["formatted"]
        spans = [f[s["start"] : s["start"] + s["length"]] for s in got[c]["loss_spans"]]
        back = [s.replace("~3", "]").replace("~2", "[").replace("~1", "<").replace("~0", "~") if m["escaped"] else s for s, m in zip(spans, got[c]["loss_spans"], strict=True)]
        assert back == [t for r, t in source if r == "assistant"]
    assert got[1]["level"] == 0 and got[-1]["level"] == 1 and got[4]["level"] == 0


def test_warc(spark):
    rows = [(5, "http://a", "same"), (3, "http://b", "same"), (9, None, None), (8, "u", ""), (7, "http://c x", "é" * 5000), (3, "http://b", "same"), (None, "n", "same")]
    got = warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    kind = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in got}
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    assert kind[3] == ("response", None, 4, digest("same")) and kind[5] == ("revisit", 3, 4, digest("same"))
    assert kind[8] == ("response", None, 0, digest("")) and kind[9] == ("revisit", 8, 0, digest(""))
    assert kind[7] == ("response", None, 10_000, digest("é" * 5000))
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html(spark):
    page = lambda i, body: f"<html><head><title>t{i}</title><script>var a='<p>x</p>';</script></head><body><nav><a href='/'>Home {i}</a></nav><div class='ad'>Buy {i}</div><article><h1>Head {i}</h1>{body}</article><div class='comments'>Nice {i}</div><footer>&copy; {i}</footer></body></html>"
    rows = [(i, f"http://a.org/{i}", page(i, f"<p>One &amp; <b>two</b>\n {i}<aside>skip</aside><p>End &lt;{i}&gt;")) for i in range(6)]
    rows += [(100, None, None), (101, "bad", ""), (102, "http://b.org/", page(9, "<p>cut &am")[:-60]), (103, "http://c.org", "plain text")]
    got = {r["page_id"]: r for r in html_template.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows)
    for i in range(6):
        assert got[i]["text"] == f"Head {i}\n\nOne & two {i}\n\nEnd <{i}>" and got[i]["n_chars"] == len(got[i]["text"])
    assert got[100]["text"] == got[101]["text"] == "" and got[102]["text"].startswith("Head 9\n\ncut &am")


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def some_vectors(n=300):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((n, 16)).astype(np.float32)
    for i in range(0, n, 4):
        x[i] = x[i // 2] + 0.02 * rng.standard_normal(16)
    x[10:40] = x[9]
    x[50] = 2 * x[9]
    rows = [(i, [float(v) for v in x[i]], i % 3) for i in range(n)]
    return x, [*rows, rows[5], (1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] * 16, 1), (1003, [1.0, None] * 8, 2), (1004, rows[9][1], None), (1020, [], 0)]


def test_forest(spark):
    x, rows = some_vectors()
    usable = {i: np.array(v, np.float64) for i, v, _ in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    got = {}
    for r in lsh_forest.nearest(vectors(spark, rows), shard_rows=90, block_rows=7).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    hits = total = 0
    for q in (i for i in usable if i % 20 == 0):
        best = sorted(((-float(v @ usable[q]), i) for i, v in usable.items() if i != q))[:20]
        assert len(got[q]) == 20 and all(abs(s - float(usable[i] @ usable[q])) < 1e-9 for i, s in got[q])
        hits += len({i for i, _ in got[q]} & {i for _, i in best})
        total += 20
    assert set(got) == {i for i in usable if i % 20 == 0} and hits >= 0.9 * total
    assert lsh_forest.nearest(vectors(spark, [(20, [1.0], 0)])).count() == 0 and lsh_forest.nearest(vectors(spark, [])).count() == 0


@pytest.mark.parametrize("part_rows", [4096, 25])
def test_cover_tree(spark, part_rows):
    x, rows = some_vectors()
    unit = {i: (np.array(v, np.float64) / np.linalg.norm(v), l) for i, v, l in rows if v and l is not None and None not in v and np.isfinite(v).all() and any(v)}
    up, links = {i: i for i, _, _ in rows}, dict.fromkeys([i for i, _, _ in rows], 0)

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in unit:
        for b in unit:
            if a < b and unit[a][1] == unit[b][1] and float(unit[a][0] @ unit[b][0]) >= 0.98:
                links[a] += 1
                links[b] += 1
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    got = cover_tree.near_dedup(vectors(spark, rows), part_rows=part_rows, max_cells=8).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == {i: (links[i], find(i), find(i) == i) for i in links}


def test_empty_tables(spark):
    d = docs(spark, []) if False else spark.createDataFrame([], DOCS)
    import public_tokenizers

    assert jaccard_join.ngram_jaccard_join(d).count() == 0 and substring_dedup.substring_dedup(d).count() == 0 and mixing.mix_sources(d).count() == 0
    assert packing.pack_best_fit(d, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    assert quality.classify_quality(d, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert html_template.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert cover_tree.near_dedup(vectors(spark, [])).count() == 0
