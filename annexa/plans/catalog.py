"""Every query by name over the driver's tables, with the SQL that checks it.

Each runs an operator of the package over its whole table; SQL states the same
result independently. Doubles are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays, clock, jsonx, numeric, service, text, textscore
from ..operators import columns, joins, metrics, records, rewards, rollup, scoring, splits, templates
from ..sources import sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._dir}/{name}.parquet")


def _r(c, n: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


def _rated(t: Tables) -> DataFrame:
    """Quality labels with a length rule's answer."""
    rule = F.when(F.col("n_chars") >= 500, "yes").otherwise("no")
    return t.documents.select("doc_id", "lang", "source", rule.alias("pred"), "n_chars").join(t.labels, "doc_id").withColumn("truth", F.when(F.col("quality") == 1, "yes").otherwise("no"))


_RATED = "WITH r AS (SELECT doc_id, lang, source, n_chars, quality, toxic, CASE WHEN n_chars >= 500 THEN 'yes' ELSE 'no' END AS pred, CASE WHEN quality = 1 THEN 'yes' ELSE 'no' END AS truth FROM documents JOIN labels USING (doc_id))"


@query(_RATED + """, s AS (SELECT lang, count(*) AS n, count(*) FILTER (truth = 'yes' AND pred = 'yes') AS tp, count(*) FILTER (truth = 'no' AND pred = 'yes') AS fp,
  count(*) FILTER (truth = 'yes' AND pred = 'no') AS fn, count(*) FILTER (truth = pred) AS same FROM r GROUP BY lang)
SELECT lang, n, round(same / n, 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM s""")
def clf_binary_metrics(spark, sf_dir):
    out = metrics.binary(_rated(Tables(spark, sf_dir)), ["lang"], "truth", "pred", "yes", ["yes", "no"])
    return out.select("lang", "n", *(_r(c).alias(c) for c in ("accuracy", "precision", "recall", "f1")))


_GUESS = "CASE WHEN source IN ('src0', 'src1', 'src2') THEN 'fr' WHEN source = 'src3' THEN 'xx' ELSE 'en' END"


@query(f"""WITH d AS (SELECT lang AS t, {_GUESS} AS p FROM documents), l AS (SELECT t AS l FROM d UNION SELECT p FROM d),
s AS (SELECT l, count(*) FILTER (t = l AND p = l) AS tp, count(*) FILTER (t = l) AS nt, count(*) FILTER (p = l) AS np FROM l, d GROUP BY l),
m AS (SELECT coalesce(tp / nullif(np, 0), 0) AS p, coalesce(tp / nullif(nt, 0), 0) AS r, coalesce(2 * tp / nullif(np + nt, 0), 0) AS f FROM s)
SELECT count(*) AS labels, round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall, round(avg(f), 6) AS macro_f1 FROM m""")
def clf_macro_metrics(spark, sf_dir):
    d = Tables(spark, sf_dir).documents
    guess = F.when(F.col("source").isin("src0", "src1", "src2"), "fr").when(F.col("source") == "src3", "xx").otherwise("en")
    out = metrics.macro(d.select("lang", guess.alias("p")), [], "lang", "p")
    return out.select("labels", *(_r(f"macro_{c}").alias(f"macro_{c}") for c in ("precision", "recall", "f1")))


@query(_RATED + """, u AS (SELECT 'quality' AS target, quality AS t, (n_chars >= 500)::INT AS p FROM r UNION ALL SELECT 'toxic', toxic, (n_chars < 800)::INT FROM r)
SELECT count(*) AS n, round(count(*) FILTER (t = p) / count(*), 6) AS accuracy, round(count(*) FILTER (t = 1 AND p = 1) / count(*) FILTER (p = 1), 6) AS precision,
 round(count(*) FILTER (t = 1 AND p = 1) / count(*) FILTER (t = 1), 6) AS recall, round(2 * count(*) FILTER (t = 1 AND p = 1) / (count(*) FILTER (p = 1) + count(*) FILTER (t = 1)), 6) AS f1 FROM u""")
def clf_micro_metrics(spark, sf_dir):
    r = _rated(Tables(spark, sf_dir))
    long = r.select(F.explode(F.array(F.struct(F.col("quality").alias("t"), (F.col("n_chars") >= 500).cast("int").alias("p")), F.struct(F.col("toxic").alias("t"), (F.col("n_chars") < 800).cast("int").alias("p")))).alias("x")).select("x.t", "x.p")
    return metrics.binary(long, [], "t", "p", 1).select("n", *(_r(c).alias(c) for c in ("accuracy", "precision", "recall", "f1")))


@query("""SELECT conv_id, CASE WHEN bool_or(role = 'system') THEN 'yes' ELSE 'no' END AS label,
 CASE WHEN bool_and(role = 'system') THEN 'all_yes' WHEN NOT bool_or(role = 'system') THEN 'all_no' ELSE 'mixed' END AS state FROM conversations GROUP BY conv_id""")
def segment_any_yes(spark, sf_dir):
    c = Tables(spark, sf_dir).conversations.select("conv_id", F.when(F.col("role") == "system", "yes").otherwise("no").alias("l"))
    return c.groupBy("conv_id").agg(rollup.any_yes("l").alias("label"), rollup.state("l").alias("state"))


@query("""WITH f AS (SELECT conv_id, role, min(turn) AS t, bool_or(role = 'assistant') OVER (PARTITION BY conv_id) AS a FROM conversations GROUP BY conv_id, role),
g AS (SELECT conv_id, count(DISTINCT role) AS k FROM f GROUP BY conv_id)
SELECT conv_id, string_agg(role, ' || ' ORDER BY t) FILTER (NOT a OR role = 'assistant' ) AS text FROM f GROUP BY conv_id""")
def segment_dedup_join(spark, sf_dir):
    c = Tables(spark, sf_dir).conversations.withColumn("label", F.when(F.col("role") == "assistant", "yes").otherwise("no"))
    return rollup.segments(c, ["conv_id"], "turn", "label", "role").select("conv_id", "text")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def dedupe_first(spark, sf_dir):
    return rollup.keep_one(Tables(spark, sf_dir).events.select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def dedupe_last(spark, sf_dir):
    return rollup.keep_one(Tables(spark, sf_dir).events.select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], last=True).drop("ts")


@query("SELECT source, count(*) AS n FROM documents GROUP BY source HAVING count(*) > 1")
def duplicate_key_report(spark, sf_dir):
    return rollup.duplicate_keys(Tables(spark, sf_dir).documents, ["source"])


@query("""WITH v AS (SELECT DISTINCT o_orderpriority AS p FROM orders UNION SELECT 'none'), e AS (SELECT o_orderpriority AS p, avg(abs(date_diff('day', o_orderdate, l_shipdate))) AS mae, count(*) AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) SELECT v.p AS priority, round(mae, 6) AS mae, coalesce(n, 0) AS n FROM v LEFT JOIN e USING (p)""")
def mae_by_group(spark, sf_dir):
    t = Tables(spark, sf_dir)
    days = lambda c: F.unix_date(F.to_date(c))
    j = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), days("l_shipdate").alias("p")).join(t.orders.select("o_orderkey", days("o_orderdate").alias("t"), F.col("o_orderpriority").alias("priority")), "o_orderkey")
    vocabulary = t.orders.select(F.col("o_orderpriority").alias("priority")).union(spark.range(1).select(F.lit("none")))
    out = metrics.mean_absolute_error(j, vocabulary, "priority", "t", "p")
    return out.select("priority", _r("mae").alias("mae"), "n")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_join(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left_semi")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left_anti")


@query("SELECT doc_id, lang, quality FROM documents LEFT JOIN labels USING (doc_id)")
def left_join_checked(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return joins.checked(t.documents.select("doc_id", "lang"), t.labels.select("doc_id", "quality"), ["doc_id"])


_HOUR = "CAST(floor(epoch(ts) / 3600) AS BIGINT)"


@query(f"""WITH e AS (SELECT user_id, event_id, {_HOUR} AS h FROM events), b AS (SELECT user_id, min(h) AS h0, max(h) - min(h) AS d FROM e GROUP BY user_id),
w AS (SELECT user_id, h0, d, unnest(generate_series(0, greatest(0, CAST(ceil((d - 30) / 25.0) AS BIGINT)))) AS i FROM b WHERE d > 0)
SELECT w.user_id, i, count(*) AS n FROM w JOIN e ON e.user_id = w.user_id AND e.h - h0 BETWEEN i * 25 AND least(i * 25 + 30, d) GROUP BY 1, 2""")
def range_join_windows(spark, sf_dir):
    e = Tables(spark, sf_dir).events.select("user_id", F.floor(F.unix_timestamp("ts") / 3600).alias("h"))
    b = e.groupBy("user_id").agg(F.min("h").alias("h0"), (F.max("h") - F.min("h")).alias("d"))
    w = b.select("user_id", "h0", F.explode(arrays.windows("d", 30, 25)).alias("w")).select("user_id", F.col("w.i").cast("long").alias("i"), (F.col("h0") + F.col("w.s")).alias("s"), (F.col("h0") + F.col("w.e")).alias("e"))
    return joins.overlapping(e.withColumn("h2", F.col("h")), w, ["user_id"], "h", "h2", "s", "e", 31).groupBy("user_id", "i").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS pos, n_name AS l FROM nation), b AS (SELECT row_number() OVER (ORDER BY n_name) - 1 AS pos, n_name AS r FROM nation WHERE n_regionkey <> 3)
SELECT pos, l AS "left", r AS "right", CASE WHEN r IS NULL THEN 'missing' WHEN l IS NULL THEN 'extra' WHEN l = r THEN 'match' ELSE 'mismatch' END AS status FROM a FULL JOIN b USING (pos)""")
def positional_diff(spark, sf_dir):
    n = Tables(spark, sf_dir).nation
    out = joins.positional_diff(n, n.where("n_regionkey <> 3"), ["n_nationkey"], ["n_name"], "n_name")
    return out.select(F.col("pos").cast("long").alias("pos"), "left", "right", "status")


@query("""WITH u AS (SELECT doc_id, 1 AS o, CASE WHEN toxic = 1 THEN 'toxic' END AS v FROM labels UNION ALL SELECT doc_id, 2, CASE WHEN quality = 1 THEN 'good' END FROM labels UNION ALL SELECT doc_id, 3, lang FROM documents)
SELECT doc_id, arg_min(v, o) FILTER (v IS NOT NULL) AS v FROM u GROUP BY doc_id""")
def coalesce_first(spark, sf_dir):
    t = Tables(spark, sf_dir)
    parts = t.labels.select("doc_id", F.lit(1).alias("o"), F.when(F.col("toxic") == 1, "toxic").alias("v")).unionByName(t.labels.select("doc_id", F.lit(2).alias("o"), F.when(F.col("quality") == 1, "good").alias("v"))).unionByName(t.documents.select("doc_id", F.lit(3).alias("o"), F.col("lang").alias("v")))
    return rollup.coalesce_first(parts, ["doc_id"], "o", ["v"])


@query("SELECT doc_id, 'quality' AS name, quality AS value FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels")
def melt(spark, sf_dir):
    return Tables(spark, sf_dir).labels.unpivot(["doc_id"], ["quality", "toxic"], "name", "value")


@query("""SELECT r_name, count(*) FILTER (c_mktsegment = 'AUTOMOBILE') AS automobile, count(*) FILTER (c_mktsegment = 'BUILDING') AS building, count(*) FILTER (c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING')) AS other
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def pivot(spark, sf_dir):
    t = Tables(spark, sf_dir)
    j = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    seg = F.when(F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING"), F.lower("c_mktsegment")).otherwise("other")
    return j.select("r_name", seg.alias("s")).groupBy("r_name").pivot("s", ["automobile", "building", "other"]).count().na.fill(0)


@query("SELECT o_orderstatus AS status, count(*) AS n, count(*) FILTER (o_totalprice > 100000) AS large FROM orders GROUP BY ROLLUP (o_orderstatus)")
def rollup_counts(spark, sf_dir):
    o = Tables(spark, sf_dir).orders
    return o.rollup(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 100000).alias("large"))


@query("SELECT round(avg(m), 4) AS mean_of_means, count(*) AS groups FROM (SELECT c_nationkey, avg(c_acctbal) AS m FROM customer GROUP BY 1)")
def avg_of_groups(spark, sf_dir):
    by = Tables(spark, sf_dir).customer.groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("m"))
    return by.agg(_r(F.avg("m"), 4).alias("mean_of_means"), F.count("*").alias("groups"))


@query("SELECT round(avg(c_acctbal), 4) AS mean, round(stddev_samp(c_acctbal), 4) AS std, min(c_acctbal) AS lo, max(c_acctbal) AS hi, count(*) FILTER (c_acctbal < 0) AS negative FROM customer")
def summary_stats(spark, sf_dir):
    c = F.col("c_acctbal")
    return Tables(spark, sf_dir).customer.agg(_r(F.avg(c), 4).alias("mean"), _r(F.stddev_samp(c), 4).alias("std"), F.min(c).alias("lo"), F.max(c).alias("hi"), F.count_if(c < 0).alias("negative"))


def _parts(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_brand").alias("k"), F.col("p_partkey").alias("i"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))


@query("""WITH p AS (SELECT p_brand AS k, p_size AS x, p_retailprice AS y FROM part), r AS (SELECT k, x, y, rank() OVER (PARTITION BY k ORDER BY x) + (count(*) OVER (PARTITION BY k, x) - 1) / 2 AS rx,
 rank() OVER (PARTITION BY k ORDER BY y) + (count(*) OVER (PARTITION BY k, y) - 1) / 2 AS ry FROM p) SELECT k, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY k""")
def pearson_spearman(spark, sf_dir):
    return metrics.correlations(_parts(Tables(spark, sf_dir)), ["k"], "x", "y").select("k", _r("pearson").alias("pearson"), _r("spearman").alias("spearman"))


@query("""WITH p AS (SELECT s_nationkey AS k, s_suppkey AS i, floor(s_acctbal / 1000) AS x, s_suppkey % 7 AS y FROM supplier), q AS (SELECT a.k, sign(a.x - b.x) AS sx, sign(a.y - b.y) AS sy FROM p a JOIN p b ON a.k = b.k AND a.i < b.i)
SELECT k, round(sum(sx * sy) / nullif(sqrt(sum(abs(sx)) * sum(abs(sy))), 0), 6) AS kendall, round(avg(CASE WHEN sx <> 0 THEN (sx = sy)::INT END), 6) AS pair_accuracy FROM q GROUP BY k""")
def kendall_pairs(spark, sf_dir):
    s = Tables(spark, sf_dir).supplier.select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("i"), F.floor(F.col("s_acctbal") / 1000).cast("double").alias("x"), (F.col("s_suppkey") % 7).cast("double").alias("y"))
    return metrics.pair_orders(s, "k", "i", "x", "y").select("k", _r("kendall").alias("kendall"), _r("pair_accuracy").alias("pair_accuracy"))


def _words(t: Tables) -> DataFrame:
    return t.documents.select(F.explode(text.letters("text")).alias("word"))


@query("SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS word FROM documents) GROUP BY word HAVING count(*) >= 8")
def word_freq(spark, sf_dir):
    return _words(Tables(spark, sf_dir)).groupBy("word").agg(F.count("*").alias("n")).where("n >= 8")


@query("SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS word FROM documents) GROUP BY word ORDER BY n DESC, word LIMIT 60")
def word_topk(spark, sf_dir):
    return _words(Tables(spark, sf_dir)).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(60)


@query("""WITH t AS (SELECT regexp_extract_all(lower(text), '[a-z]{2,}') AS w FROM documents), g AS (SELECT w, unnest(generate_series(1, len(w) - 1)) AS i FROM t WHERE len(w) >= 2)
SELECT w[i] || ' ' || w[i + 1] AS gram, count(*) AS n FROM g WHERE w[i] <> w[i + 1] GROUP BY 1 HAVING count(*) >= 5""")
def bigram_freq(spark, sf_dir):
    d = Tables(spark, sf_dir).documents.select(text.letters("text").alias("w"))
    g = d.select(F.explode(arrays.ngrams("w", 2)).alias("g")).where(F.col("g")[0] != F.col("g")[1])
    return g.groupBy(F.array_join("g", " ").alias("gram")).agg(F.count("*").alias("n")).where("n >= 5")


def _event_lists(t: Tables) -> DataFrame:
    """Each user's event types in order beside the next user's."""
    e = t.events.select("user_id", F.struct("ts", "event_id", "event_type").alias("e"))
    own = e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list("e")), lambda x: x["event_type"]).alias("a"))
    other = own.select((F.col("user_id") - 1).alias("user_id"), F.col("a").alias("b"))
    return own.join(other, "user_id")


_LISTS = """WITH c AS (SELECT event_type, chr(96 + CAST(row_number() OVER (ORDER BY event_type) AS INT)) AS l FROM (SELECT DISTINCT event_type FROM events)),
s AS (SELECT user_id, string_agg(l, '' ORDER BY ts, event_id) AS a FROM events JOIN c USING (event_type) GROUP BY user_id)"""


@query(_LISTS + " SELECT x.user_id, levenshtein(x.a, y.a) AS distance FROM s x JOIN s y ON y.user_id = x.user_id + 1")
def edit_distance(spark, sf_dir):
    return _event_lists(Tables(spark, sf_dir)).select("user_id", arrays.edit_distance("a", "b").cast("long").alias("distance"))


# the table of common lengths row by row, each row from the one above
@query("""WITH RECURSIVE s AS (SELECT user_id, list(event_type ORDER BY ts, event_id) AS a FROM events GROUP BY user_id), p AS (SELECT x.user_id, x.a, y.a AS b FROM s x JOIN s y ON y.user_id = x.user_id + 1),
r AS (SELECT user_id, a, b, 0 AS i, list_transform(range(0, len(b) + 1), lambda j: 0::BIGINT) AS up FROM p
 UNION ALL SELECT user_id, a, b, i + 1, list_reduce(list_transform(range(1, len(b) + 1), lambda j: [j]), lambda row, j: list_append(row, CASE WHEN b[j[1]] = a[i + 1] THEN up[j[1]] + 1 ELSE greatest(up[j[1] + 1], row[j[1]]) END), [0::BIGINT]) FROM r WHERE i < len(a)),
l AS (SELECT user_id, up[-1] AS lcs, len(a) AS pred_len, len(b) AS gt_len FROM r WHERE i = len(a))
SELECT user_id, lcs, pred_len, gt_len, lcs / pred_len AS lcs_precision, lcs / gt_len AS lcs_recall FROM l""")
def sequence_metrics(spark, sf_dir):
    lcs = arrays.common_length("a", "b")
    out = _event_lists(Tables(spark, sf_dir)).select("user_id", lcs.alias("lcs"), F.size("a").alias("pred_len"), F.size("b").alias("gt_len"))
    return out.withColumn("lcs_precision", F.coalesce(F.try_divide("lcs", "pred_len"), F.lit(0.0))).withColumn("lcs_recall", F.coalesce(F.try_divide("lcs", "gt_len"), F.lit(0.0)))


@query("""WITH RECURSIVE d AS (SELECT user_id, ts::DATE AS day, list(event_type ORDER BY ts, event_id) AS s FROM events GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) AS k FROM d),
r AS (SELECT user_id, k, s AS m FROM n WHERE k = 1
 UNION ALL SELECT r.user_id, n.k, r.m || n.s[1 + list_max(list_filter(range(0, 1 + least(len(r.m), len(n.s))), lambda j: j = 0 OR r.m[len(r.m) - j + 1 : len(r.m)] = n.s[1 : j])) : len(n.s)] FROM r JOIN n ON n.user_id = r.user_id AND n.k = r.k + 1)
SELECT user_id, array_to_string(arg_max(m, k), ',') AS merged FROM r GROUP BY user_id""")
def overlap_merge(spark, sf_dir):
    e = Tables(spark, sf_dir).events
    by_day = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]).alias("s"))
    return rollup.merged_sequence(by_day, ["user_id"], "day", "s").select("user_id", F.array_join("s", ",").alias("merged"))


@query("SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total FROM events GROUP BY event_type")
def json_extract(spark, sf_dir):
    e = Tables(spark, sf_dir).events
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(jsonx.lenient("props", "k long")["k"]).alias("total"))


@query(_RATED + """ SELECT doc_id, CASE WHEN truth <> pred THEN 0.0 ELSE round(0.7 * ((lang = 'en') = (source < 'src5'))::INT + 0.3 * (toxic = (n_chars % 2))::INT, 6) END AS score FROM r""")
def gated_score(spark, sf_dir):
    r = _rated(Tables(spark, sf_dir))
    word = lambda c: F.when(c, "a").otherwise("b")
    q = lambda n, t, p: F.struct(F.lit(n).alias("q"), t.alias("t"), p.alias("p"))
    long = r.select("doc_id", F.explode(F.array(q(0, F.col("truth"), F.col("pred")), q(1, word(F.col("lang") == "en"), word(F.col("source") < "src5")), q(2, word(F.col("toxic") == 1), word(F.col("n_chars") % 2 == 1)))).alias("x")).select("doc_id", "x.*")
    return scoring.gated(long, ["doc_id"], "q", "t", "p").select("doc_id", _r("score").alias("score"))


@query()
def group_folds(spark, sf_dir):
    r = _rated(Tables(spark, sf_dir))
    return splits.group_folds(r.select("doc_id", "source", "quality"), "source", "quality").select("doc_id", "source", "quality", "fold")


@query("""SELECT conv_id, to_json(list({'role': role, 'content': text} ORDER BY turn))::VARCHAR AS messages, count(*) AS n, arg_min(text, turn) FILTER (role = 'assistant') AS solution FROM conversations GROUP BY conv_id""")
def records_nested(spark, sf_dir):
    c = records.chats(Tables(spark, sf_dir).conversations, ["conv_id"], "turn")
    return c.select("conv_id", F.to_json("messages").alias("messages"), F.size("messages").cast("long").alias("n"), records.solution("messages").alias("solution"))


@query(_RATED + " SELECT lang, round(100 * sum(quality) / count(*), 6) AS quality, round(100 * sum(toxic) / count(*), 6) AS toxic FROM r GROUP BY lang")
def percent_by_group(spark, sf_dir):
    r = _rated(Tables(spark, sf_dir))
    return r.groupBy("lang").agg(*(_r(100.0 * F.sum(c) / F.count("*")).alias(c) for c in ("quality", "toxic")))


@query("SELECT event_id, minute(ts) * 60 + second(ts) AS secs, printf('%02d:%02d', minute(ts), second(ts)) AS again FROM events")
def time_parse(spark, sf_dir):
    e = Tables(spark, sf_dir).events
    s = clock.mmss(F.concat(F.date_format("ts", "mm:ss"), F.lit(":00")))
    return e.select("event_id", s.cast("long").alias("secs"), clock.to_mmss(s).alias("again"))


@query("SELECT event_type, sum(greatest(a - b, 0))::BIGINT AS surplus, sum(greatest(b - a, 0))::BIGINT AS lacking FROM (SELECT event_type, count(*) FILTER (user_id % 2 = 0) AS a, count(*) FILTER (user_id % 2 = 1) AS b FROM events GROUP BY event_type) GROUP BY event_type")
def multiset_difference(spark, sf_dir):
    e = Tables(spark, sf_dir).events
    n = lambda m, name: e.where(F.col("user_id") % 2 == m).groupBy("event_type").agg(F.count("*").alias(name))
    j = n(0, "a").join(n(1, "b"), "event_type", "full").na.fill(0)
    return j.select("event_type", F.greatest(F.col("a") - F.col("b"), F.lit(0)).alias("surplus"), F.greatest(F.col("b") - F.col("a"), F.lit(0)).alias("lacking"))


@query("SELECT doc_id, regexp_replace(text, '\\s+', ' ', 'g') <> text AS changed, length(text) AS n FROM documents WHERE NOT regexp_matches(text, '(?i)^\\s*(fail(ed)?|error|n/?a|none|null)?\\s*$')")
def failure_filter(spark, sf_dir):
    d = Tables(spark, sf_dir).documents.where(~text.is_failure("text"))
    return d.select("doc_id", (F.regexp_replace("text", r"\s+", " ") != F.col("text")).alias("changed"), F.length("text").cast("long").alias("n"))


@query("SELECT c_custkey, CASE WHEN c_name LIKE '%NES%' THEN 'NES' WHEN upper(c_mktsegment) LIKE '%NES%' THEN 'NES' WHEN upper(c_mktsegment) LIKE '%ES%' THEN 'ES' END AS class FROM customer")
def event_class(spark, sf_dir):
    c = Tables(spark, sf_dir).customer
    return c.select("c_custkey", text.event_class("c_mktsegment").alias("class"))


@query("SELECT (n - 1) // 20 AS batch, count(*) AS rows, min(doc_id) AS first FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) GROUP BY 1")
def fixed_batches(spark, sf_dir):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    b = Tables(spark, sf_dir).documents.select("doc_id", F.floor((n - 1) / 20).cast("long").alias("batch"))
    return b.groupBy("batch").agg(F.count("*").alias("rows"), F.min("doc_id").alias("first"))


@query("SELECT r_name FROM region INTERSECT SELECT r_name FROM region WHERE r_regionkey < 3")
def key_intersection(spark, sf_dir):
    r = Tables(spark, sf_dir).region
    return r.select("r_name").intersect(r.where("r_regionkey < 3").select("r_name"))


@query("SELECT r_name FROM region EXCEPT SELECT r_name FROM region WHERE r_regionkey < 3")
def key_difference(spark, sf_dir):
    r = Tables(spark, sf_dir).region
    return r.select("r_name").subtract(r.where("r_regionkey < 3").select("r_name"))


@query("""WITH a AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, event_type AS l FROM events), b AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, event_type AS r FROM events WHERE event_type <> 'click'),
d AS (SELECT user_id, pos, CASE WHEN r IS NULL THEN 'missing' WHEN l IS NULL THEN 'extra' WHEN l = r THEN 'match' ELSE 'mismatch' END AS s FROM a FULL JOIN b USING (user_id, pos))
SELECT user_id, min(pos) FILTER (s <> 'match') AS first, count(*) FILTER (s = 'mismatch') AS mismatches, count(*) FILTER (s = 'missing') AS missing, count(*) FILTER (s = 'extra') AS extra FROM d GROUP BY user_id""")
def order_diff_by_key(spark, sf_dir):
    e = Tables(spark, sf_dir).events.select("user_id", "ts", "event_id", "event_type")
    diff = joins.positional_diff(e, e.where("event_type <> 'click'"), ["ts", "event_id"], ["event_id"], "event_type", ["user_id"])
    return joins.diff_summary(diff, ["user_id"]).withColumn("first", F.col("first").cast("long"))


def _turn_pairs(t: Tables) -> DataFrame:
    """Each turn beside the turn before."""
    c = t.conversations
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("ref"))
    return c.select("conv_id", "turn", "role", F.col("text").alias("pred")).join(before, ["conv_id", "turn"])


_PAIRS = "c AS (SELECT b.conv_id, b.turn, b.role, coalesce(b.text, '') AS pred, coalesce(a.text, '') AS ref FROM conversations b JOIN conversations a ON a.conv_id = b.conv_id AND a.turn = b.turn - 1)"


@query(f"""WITH {_PAIRS}, w AS (SELECT conv_id, turn, regexp_extract_all(lower(pred), '[a-z0-9]+') AS p, regexp_extract_all(lower(ref), '[a-z0-9]+') AS r FROM c),
u AS (SELECT conv_id, turn, unnest(p) AS g, 1 AS x, 0 AS y FROM w UNION ALL SELECT conv_id, turn, unnest(r), 0, 1 FROM w), h AS (SELECT conv_id, turn, g, least(sum(x), sum(y)) AS m FROM u GROUP BY ALL), s AS (SELECT conv_id, turn, sum(m) AS m FROM h GROUP BY ALL)
SELECT conv_id, turn, round(CASE WHEN coalesce(m, 0) = 0 THEN 0 ELSE 2 * m / (len(p) + len(r)) END, 6) AS rouge1 FROM w LEFT JOIN s USING (conv_id, turn)""")
def rouge_unstemmed(spark, sf_dir):
    return _turn_pairs(Tables(spark, sf_dir)).select("conv_id", "turn", _r(textscore.rouge("pred", "ref", stemmed=False)["rouge1"]).alias("rouge1"))


@query()
def rouge_by_role(spark, sf_dir):
    scored = _turn_pairs(Tables(spark, sf_dir)).select("role", textscore.rouge("pred", "ref").alias("r"))
    return scored.groupBy("role").agg(_r(F.avg("r.rouge1")).alias("rouge1"), _r(F.avg("r.rouge_l")).alias("rouge_l"), F.count("*").alias("n"))


def _tokens_sql(c: str) -> str:
    t = f"rtrim({c})"
    for old, new in (("'<skipped>'", "''"), ("'-' || chr(10)", "''"), ("chr(10)", "' '"), ("'&quot;'", "'\"'"), ("'&amp;'", "'&'"), ("'&lt;'", "'<'"), ("'&gt;'", "'>'")):
        t = f"replace({t}, {old}, {new})"
    t = f"' ' || {t} || ' '"
    for pattern, new in ((r"([\{-~\[-` -&\(-\+:-@/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "), (r"([\.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")):
        t = f"regexp_replace({t}, '{pattern}', '{new}', 'g')"
    return f"list_filter(regexp_split_to_array({t}, '\\s+'), lambda x: x <> '')"


_GRAMS = " UNION ALL ".join(f"SELECT conv_id, turn, role, {n} AS n, {k} AS side, unnest(list_transform(range(1, len({c}) - {n - 2}), lambda i: array_to_string({c}[i : i + {n - 1}], chr(1)))) AS g FROM w" for n in range(1, 5) for k, c in ((0, "p"), (1, "r")))


@query(f"""WITH {_PAIRS}, w AS MATERIALIZED (SELECT conv_id, turn, role, {_tokens_sql("pred")} AS p, {_tokens_sql("ref")} AS r FROM c), g AS ({_GRAMS}),
m AS (SELECT conv_id, turn, role, n, g, least(count(*) FILTER (side = 0), count(*) FILTER (side = 1)) AS m, count(*) FILTER (side = 0) AS t FROM g GROUP BY ALL),
s AS (SELECT role, n, sum(m) AS m, sum(t) AS t FROM m GROUP BY ALL), z AS (SELECT role, n, m, t, sum((m = 0)::INT) OVER (PARTITION BY role ORDER BY n) AS z FROM s),
b AS (SELECT role, exp(avg(ln(CASE WHEN m = 0 THEN 100 / (pow(2, z) * t) ELSE 100 * m / t END))) AS b, count(*) FILTER (t > 0) AS k, max(m) AS best FROM z GROUP BY role), l AS (SELECT role, sum(len(p)) AS p, sum(len(r)) AS r FROM w GROUP BY role)
SELECT role, round(CASE WHEN k < 4 OR best = 0 THEN 0 ELSE b * CASE WHEN p < r THEN exp(1 - r / p) ELSE 1 END END, 6) AS bleu FROM b JOIN l USING (role)""")
def corpus_bleu_by_role(spark, sf_dir):
    counted = _turn_pairs(Tables(spark, sf_dir)).select("role", textscore.bleu_counts("pred", "ref").alias("c"))
    return counted.groupBy("role").agg(_r(textscore.corpus_bleu("c")).alias("bleu"))


@query(f"""WITH {_PAIRS}, w AS MATERIALIZED (SELECT conv_id, turn, role, {_tokens_sql("pred")} AS p, {_tokens_sql("ref")} AS r FROM c), g AS ({_GRAMS}),
m AS (SELECT conv_id, turn, n, g, least(count(*) FILTER (side = 0), count(*) FILTER (side = 1)) AS m, count(*) FILTER (side = 0) AS t FROM g GROUP BY ALL),
s AS (SELECT conv_id, turn, n, sum(m) AS m, sum(t) AS t FROM m GROUP BY ALL HAVING sum(t) > 0), z AS (SELECT *, sum((m = 0)::INT) OVER (PARTITION BY conv_id, turn ORDER BY n) AS z FROM s),
b AS (SELECT conv_id, turn, exp(avg(ln(CASE WHEN m = 0 THEN 100 / (pow(2, z) * t) ELSE 100 * m / t END))) AS b, max(m) AS best FROM z GROUP BY ALL)
SELECT conv_id, turn, round(CASE WHEN coalesce(best, 0) = 0 THEN 0 ELSE b * CASE WHEN len(p) < len(r) THEN exp(1 - len(r) / len(p)) ELSE 1 END END, 6) AS bleu FROM w LEFT JOIN b USING (conv_id, turn)""")
def sentence_bleu(spark, sf_dir):
    return _turn_pairs(Tables(spark, sf_dir)).select("conv_id", "turn", _r(textscore.sentence_bleu("pred", "ref")).alias("bleu"))


@query()
def aligned_f1(spark, sf_dir):
    return _event_lists(Tables(spark, sf_dir)).select("user_id", _r(textscore.aligned_f1("a", "b")).alias("f1"), _r(textscore.aligned_f1("a", "b", compat=True)).alias("f1_compat"))


@query("""SELECT a.vec_id, round(CASE WHEN list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0 THEN list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) ELSE 0 END, 6) AS f1
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def greedy_cosine(spark, sf_dir):
    e = Tables(spark, sf_dir).embeddings
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.array("embedding").alias("b"))
    return e.select("vec_id", F.array("embedding").alias("a")).join(nxt, "vec_id").select("vec_id", _r(textscore.greedy_cosine("a", "b")["f1"]).alias("f1"))


_SECS = "(minute(ts) * 60 + second(ts))"


@query(f"""SELECT event_id, round(0.2 + 1 - least(1.0, abs({_SECS} - (event_id % 3600)) / 60), 6) AS reward FROM events""")
def task_rewards(spark, sf_dir):
    e = Tables(spark, sf_dir).events
    secs = F.minute("ts") * 60 + F.second("ts")
    stamp = lambda s: F.concat(F.lit('{"timestamp": "'), clock.to_mmss(s), F.lit('"}'))
    reply = F.concat(F.lit("<think>seen</think><answer>"), stamp(secs), F.lit("</answer>"))
    return e.select("event_id", _r(rewards.task_reward(reply, stamp(F.col("event_id") % 3600), F.lit("task-4"))).alias("reward"))


@query("""SELECT doc_id, round(greatest(0, CASE WHEN quality = 1 THEN 0.8 ELSE 1 END * CASE WHEN toxic = 1 THEN least(50.0, x) ELSE x END * greatest(0, 1 - 0.1 * (doc_id % 4))), 6) AS score
FROM (SELECT doc_id, quality, toxic, 0.25 * (doc_id % 101 + doc_id % 97 + doc_id % 89 + doc_id % 83) AS x FROM labels)""")
def judged_quality(spark, sf_dir):
    d = F.col("doc_id")
    score = lambda m, name="score": F.struct((d % m).alias(name))
    judge = F.struct(
        score(101, "overall_score").alias("structural_completeness"), score(97).alias("symptom_coverage"), score(89).alias("key_localizing_features"), score(83).alias("temporal_fidelity"),
        F.struct((d % 4).alias("hallucination_count"), (F.col("toxic") == 1).alias("has_safety_issues"), (F.col("quality") == 1).alias("includes_non_seizure")).alias("penalties"),
    )
    reply = F.concat(F.lit("```json\n"), F.to_json(judge), F.lit("\n```"))
    return Tables(spark, sf_dir).labels.select("doc_id", _r(scoring.judged_quality(reply)).alias("score"))


@query("""WITH x AS (SELECT doc_id, CASE WHEN quality = 1 THEN 100.0 ELSE 0 END AS s, CASE WHEN lang = 'en' THEN 100.0 ELSE 0 END AS l, n_chars, toxic = 1 AS t, doc_id % 3 = 0 AS o FROM documents JOIN labels USING (doc_id)),
b AS (SELECT doc_id, (s + 50 + 50 + l) / 4 - 1 AS b, floor(n_chars / 50) AS over, t, o FROM x), y AS (SELECT doc_id, CASE WHEN o THEN 0.8 * b ELSE b END - over AS y, t FROM b)
SELECT doc_id, round(greatest(0, least(100, CASE WHEN t THEN least(50, y) ELSE y END)), 6) AS score FROM y""")
def report_quality(spark, sf_dir):
    t = Tables(spark, sf_dir)
    j = t.documents.select("doc_id", "lang", "n_chars").join(t.labels, "doc_id")
    listed = lambda *x: F.array(*(F.lit(v) if isinstance(v, str) else v for v in x))
    score = scoring.report_quality(
        listed("1"), listed(F.col("quality").cast("string")), listed("a", "b"), listed("a", "c"), listed("en"), listed(F.col("lang")), F.col("n_chars"), F.col("toxic") == 1, F.col("doc_id") % 3 == 0,
    )
    return j.select("doc_id", _r(score).alias("score"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'fail' WHEN quality = 1 THEN 'yes' ELSE 'no' END AS answer, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'doc ' || doc_id END AS justification,
 CASE WHEN doc_id % 3 = 0 THEN NULL ELSE '{"answer": "' || CASE WHEN quality = 1 THEN 'Yes' ELSE 'no' END || '", "justification": "doc ' || doc_id || '"}' END AS object FROM labels""")
def reply_repair(spark, sf_dir):
    said = F.concat(F.lit('So: {"answer": "'), F.when(F.col("quality") == 1, "Yes").otherwise("no"), F.lit('", "justification": "doc '), F.col("doc_id").cast("string"), F.lit('"} Done'))
    d = Tables(spark, sf_dir).labels.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "I do not know").otherwise(said).alias("c"))
    return d.select("doc_id", jsonx.reply("c").alias("r"), jsonx.balanced_object("c").alias("object")).select("doc_id", "r.answer", "r.justification", "object")


@query("""SELECT CAST(n_nationkey AS VARCHAR) AS key, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE r_name END AS name, CASE WHEN n_regionkey <> 3 THEN r_name END AS region FROM nation JOIN region ON n_regionkey = r_regionkey""")
def template_align(spark, sf_dir):
    t = Tables(spark, sf_dir)
    n = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).withColumn("key", F.col("n_nationkey"))
    first = n.select("key", F.when(F.col("key") % 2 == 0, F.col("n_name")).alias("name"))
    second = n.select("key", F.col("r_name").alias("name"), F.when(F.col("n_regionkey") != 3, F.col("r_name")).alias("region"))
    return templates.align(t.nation.select(F.col("n_nationkey").alias("key")), "key", [first, second], ["name", "region"])


@query("SELECT CAST(n_nationkey AS VARCHAR) AS key FROM nation WHERE n_regionkey = 3")
def template_empty_rows(spark, sf_dir):
    n = Tables(spark, sf_dir).nation
    given = n.select(F.col("n_nationkey").alias("key"), F.when(F.col("n_regionkey") != 3, F.col("n_name")).alias("name"))
    return templates.empty_rows(templates.align(given, "key", [given], ["name", "other"]), "key", ["name", "other"])


@query("SELECT 'other' AS name")
def template_empty_columns(spark, sf_dir):
    n = Tables(spark, sf_dir).nation.select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    return templates.empty_columns(templates.align(n, "key", [n], ["name", "other"]), ["name", "other"])


@query("""SELECT p_partkey, list_transform(range(0, 8), lambda i: CAST(floor(i * (p_size - 1) / 7) AS INTEGER)) AS frames FROM part""")
def even_indices(spark, sf_dir):
    return Tables(spark, sf_dir).part.select("p_partkey", numeric.even_indices(F.col("p_size").cast("int"), 8).alias("frames"))


@query("""WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), t AS (SELECT user_id, sum(n) AS n FROM n GROUP BY user_id),
m AS (SELECT x.user_id, sum(least(x.n, y.n)) AS m FROM n x JOIN n y ON y.user_id = x.user_id + 1 AND y.event_type = x.event_type GROUP BY 1)
SELECT x.user_id, round(coalesce(m, 0) / (x.n + y.n - coalesce(m, 0)), 6) AS share FROM t x JOIN t y ON y.user_id = x.user_id + 1 LEFT JOIN m ON m.user_id = x.user_id""")
def bag_overlap(spark, sf_dir):
    return _event_lists(Tables(spark, sf_dir)).select("user_id", _r(arrays.common_share("a", "b")).alias("share"))


@query("SELECT doc_id, list_filter(['the', 'quick_brown', 'tion', 'and'], lambda w: contains(lower(text), w) OR contains(lower(text), replace(w, '_', ' '))) AS found FROM documents WHERE text IS NOT NULL")
def keyword_list(spark, sf_dir):
    d = Tables(spark, sf_dir).documents.where("text IS NOT NULL")
    return d.select("doc_id", text.keywords("text", ["the", "quick_brown", "tion", "and"]).alias("found"))


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'building' ELSE 'unknown' END AS choice, 'Segment of ' || c_name || ': {' || c_mktsegment || '}' AS prompt FROM customer")
def choice_and_prompt(spark, sf_dir):
    c = Tables(spark, sf_dir).customer
    raw = F.concat(F.lit("choice: "), F.col("c_mktsegment"))
    return c.select("c_custkey", text.answer_choice(raw, ["Building"]).alias("choice"), text.filled("Segment of {n}: {{{s}}}", n="c_name", s="c_mktsegment").alias("prompt"))


@query("""
SELECT lang AS model, coalesce(printf('%.2f', nullif(count(*) FILTER (source = 'src1'), 0)::DOUBLE), '') AS src1_docs, coalesce(printf('%.2f', (sum(n_chars) FILTER (source = 'src1') / 4)::DOUBLE), '') AS src1_chars,
 '' AS none_docs, '' AS none_chars FROM documents GROUP BY lang""")
def wide_metrics(spark, sf_dir):
    d = Tables(spark, sf_dir).documents
    by = d.groupBy(F.col("lang").alias("model"), F.col("source").alias("feature")).agg(F.count("*").cast("double").alias("docs"), (F.sum("n_chars") / 4).alias("chars"))
    facts = by.unpivot(["model", "feature"], ["docs", "chars"], "metric", "value")
    return sinks.wide_metrics(facts, "model", "feature", "metric", "value", ["src1", "none"], ["docs", "chars"])


@query("""SELECT coalesce(d.source, a.source) AS source, coalesce(d.n, a.n) AS n, CASE WHEN d.source IS NULL THEN a.m END AS m
 FROM (SELECT source, count(*) AS n, max(n_chars) AS m FROM documents GROUP BY source) a LEFT JOIN (SELECT source, count(*) AS n FROM documents WHERE lang = 'en' GROUP BY source) d ON d.source = a.source""")
def merge_first(spark, sf_dir):
    d = Tables(spark, sf_dir).documents
    done = d.where("lang = 'en'").groupBy("source").agg(F.count("*").alias("n"))
    return sinks.merge_first(done, d.groupBy("source").agg(F.count("*").alias("n"), F.max("n_chars").alias("m")), "source").select("source", "n", "m")


@query("""SELECT doc_id, 'lang' AS feature, lang AS answer, source AS note FROM documents UNION ALL SELECT doc_id, 'size', CAST(n_chars AS VARCHAR), lang FROM documents""")
def unpivot_pairs(spark, sf_dir):
    wide = Tables(spark, sf_dir).documents.select("doc_id", "lang", F.col("source").alias("justification_for_lang"), F.col("n_chars").alias("answer_for_size"), F.col("lang").alias("justification_for_size"), F.lit("").alias("justification_for_nothing"))
    return columns.unpivot_pairs(wide, ["doc_id"])


@query("""SELECT conv_id, coalesce(string_agg(t, ' || ' ORDER BY turn, t) FILTER (t <> ''), '') AS text FROM (SELECT conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM conversations) GROUP BY conv_id""")
def merge_texts(spark, sf_dir):
    rows = Tables(spark, sf_dir).conversations.select("conv_id", "turn", "text")
    return service.merge_texts(rows, "conv_id", "turn", "text", lambda parts: F.concat(F.lit("Merge:\n"), F.array_join(parts, "\n")))
