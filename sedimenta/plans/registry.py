"""Registered queries over the test tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sedimenta.functions import scalars, vectors
from sedimenta.operators import datasets, embed, evaluate, fit, lookup, runs, scan, search, sft, tokenize
from sedimenta.sources import corpus, idx, tables
from sedimenta.sources.scratch import scratch
from sedimenta.streaming import drain, ordered, streams

#: Two to the 64th, for unsigned products in SQL.
_U = "18446744073709551616::UHUGEINT"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide(df: DataFrame) -> DataFrame:
    """A table of fewer files than the cluster has cores is dealt over them, before work on its texts that costs far more than moving them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def six(c: Column) -> Column:
    return F.round(c, 6) + 0.0


# --------------------------------------------------------------------------- vectors
# Every seventh vector begins with NaN, every eleventh is cut to 60 components, on both sides.


def odd_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    v = F.transform("embedding", lambda x, i: F.when((F.col("vec_id") % 7 == 0) & (i == 0), F.lit(float("nan"))).otherwise(x.cast("double")))
    return e.select("vec_id", "label", F.when(F.col("vec_id") % 11 == 0, F.slice(v, 1, 60)).otherwise(v).alias("v"))


ODD = """
WITH e AS (
  SELECT vec_id, label, CASE WHEN vec_id % 11 = 0 THEN v[1:60] ELSE v END AS v FROM (
    SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x, i: CASE WHEN vec_id % 7 = 0 AND i = 1 THEN CAST('nan' AS DOUBLE) ELSE x END) AS v FROM embeddings)
), c AS (SELECT *, list_transform(v, lambda x: CASE WHEN isnan(x) OR isinf(x) THEN 0.0::DOUBLE ELSE x END) AS s FROM e),
n AS (SELECT *, list_transform(s, lambda x: x / sqrt(list_sum(list_transform(s, lambda y: y * y)))) AS u FROM c)
"""


@query(ODD + "SELECT vec_id, round(list_sum(s), 6) + 0.0 AS total, len(s)::INT AS size FROM n")
def f1_sanitize(spark, sf_dir):
    s = vectors.sanitize("v")
    return odd_vectors(spark, sf_dir).select("vec_id", six(F.aggregate(s, F.lit(0.0), lambda a, x: a + x)).alias("total"), F.size(s).alias("size"))


@query(ODD + "SELECT vec_id, round(u[1], 6) + 0.0 AS a, round(u[60], 6) + 0.0 AS b, round(sqrt(list_sum(list_transform(u, lambda x: x * x))), 6) AS norm FROM n")
def f2_normalize(spark, sf_dir):
    e = odd_vectors(spark, sf_dir).select("vec_id", vectors.normalize("v").alias("u"))
    return e.select("vec_id", six(F.get("u", F.lit(0))).alias("a"), six(F.get("u", F.lit(59))).alias("b"), six(vectors.l2_norm("u")).alias("norm"))


PAIRS = ODD + ", p AS (SELECT a.vec_id, a.s AS x, b.s AS y FROM n a JOIN n b ON b.vec_id = a.vec_id + 1)"


def next_pairs(spark, sf_dir):
    e = odd_vectors(spark, sf_dir).select("vec_id", vectors.sanitize("v").alias("x"))
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")


@query(PAIRS + "SELECT vec_id, CASE WHEN len(x) = len(y) THEN round(list_dot_product(x, y), 6) + 0.0 ELSE 0.0::DOUBLE END AS dot FROM p")
def f3_dot(spark, sf_dir):
    return next_pairs(spark, sf_dir).select("vec_id", six(vectors.dot("x", "y")).alias("dot"))


@query(PAIRS + "SELECT vec_id, CASE WHEN len(x) = len(y) THEN round(list_cosine_similarity(x, y), 6) + 0.0 ELSE 0.0::DOUBLE END AS cosine FROM p")
def f4_cosine(spark, sf_dir):
    return next_pairs(spark, sf_dir).select("vec_id", six(vectors.cosine("x", "y")).alias("cosine"))


@query(ODD + "SELECT vec_id, round(sqrt(list_sum(list_transform(s, lambda x: x * x))), 6) AS norm FROM n")
def f5_l2_norm(spark, sf_dir):
    return odd_vectors(spark, sf_dir).select("vec_id", six(vectors.l2_norm(vectors.sanitize("v"))).alias("norm"))


@query(ODD + "SELECT vec_id, vec_id % 7 = 0 AS broken FROM n")
def f6_has_non_finite(spark, sf_dir):
    return odd_vectors(spark, sf_dir).select("vec_id", vectors.has_non_finite("v").alias("broken"))


@query(ODD + "SELECT vec_id, round(list_avg(s), 6) + 0.0 AS mean, round(list_min(s), 6) + 0.0 AS low, round(list_max(s), 6) + 0.0 AS high, round(sqrt(list_sum(list_transform(s, lambda x: x * x))), 6) AS norm FROM n")
def f7_vector_stats(spark, sf_dir):
    e = odd_vectors(spark, sf_dir).select("vec_id", vectors.vector_stats(vectors.sanitize("v")).alias("t"))
    return e.select("vec_id", six(F.col("t.mean")).alias("mean"), six(F.col("t.min")).alias("low"), six(F.col("t.max")).alias("high"), six(F.col("t.norm")).alias("norm"))


@query(ODD + ", m AS (SELECT vec_id, s, list_avg(s) AS mu, list_avg(list_transform(s, lambda x: (x - list_avg(s)) * (x - list_avg(s)))) AS var FROM n) SELECT vec_id, round((s[2] - mu) / sqrt(var + 1e-5), 6) + 0.0 AS a, round((s[60] - mu) / sqrt(var + 1e-5), 6) + 0.0 AS b FROM m")
def f8_layer_norm(spark, sf_dir):
    e = odd_vectors(spark, sf_dir).select("vec_id", vectors.layer_norm(vectors.sanitize("v")).alias("u"))
    return e.select("vec_id", six(F.get("u", F.lit(1))).alias("a"), six(F.get("u", F.lit(59))).alias("b"))


@query(ODD + "SELECT vec_id, (list_position(s, list_max(s)) - 1)::INT AS best FROM n")
def f9_argmax(spark, sf_dir):
    return odd_vectors(spark, sf_dir).select("vec_id", vectors.argmax(vectors.sanitize("v")).alias("best"))


@query(PAIRS + "SELECT vec_id, round(CASE WHEN vec_id % 3 > 1 THEN x[2] + (vec_id % 3) * (y[2] - x[2]) ELSE y[2] END, 6) + 0.0 AS g FROM p WHERE len(x) = len(y)")
def f19_guided_combine(spark, sf_dir):
    p = next_pairs(spark, sf_dir).where(F.size("x") == F.size("y"))
    return p.select("vec_id", six(F.get(vectors.guided_combine("x", "y", (F.col("vec_id") % 3).cast("double")), F.lit(1))).alias("g"))


# --------------------------------------------------------------------------- search


def _search_inputs(spark, sf_dir):
    e = odd_vectors(spark, sf_dir)
    return e.select(F.col("vec_id").alias("path"), F.col("v").alias("embedding")), e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("embedding"))


SEARCH = ODD + """, hits AS (
  SELECT q.vec_id AS query_id, i.vec_id AS path, CASE WHEN i.vec_id % 7 = 0 THEN 0.0::DOUBLE ELSE list_dot_product(i.s, q.u) END AS score
  FROM n i JOIN n q ON q.vec_id % 100 = 0 AND len(i.s) = len(q.u)
) SELECT query_id, path, round(score, 6) + 0.0 AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path)::INT AS rank FROM hits QUALIFY rank <= 5
"""


@query(SEARCH)
def t1_topk_search(spark, sf_dir):
    index, queries = _search_inputs(spark, sf_dir)
    return search.topk_search(index, queries, 5).withColumn("score", six(F.col("score")))


@query(SEARCH)
def j2_scored_pairs(spark, sf_dir):
    index, queries = _search_inputs(spark, sf_dir)
    pairs = search.score_pairs(index, search.prepare_queries(queries), k=5)
    return search.rank_hits(pairs, 5).withColumn("score", six(F.col("score")))


@query(ODD + "SELECT len(v)::INT AS dimension, count(*) AS entries FROM n GROUP BY 1")
def a2_dimension_histogram(spark, sf_dir):
    return search.dimension_histogram(odd_vectors(spark, sf_dir), "v")


@query(ODD + "SELECT count(*) AS documents, arg_min(len(v), vec_id)::INT AS dimension FROM n")
def a2_index_stats(spark, sf_dir):
    return search.index_stats(odd_vectors(spark, sf_dir), "vec_id", "v")


@query(ODD + "SELECT vec_id FROM n WHERE len(v) <> 64")
def p4_mismatched(spark, sf_dir):
    return search.mismatched(odd_vectors(spark, sf_dir), 64, "v").select("vec_id")


@query(ODD + """, bad AS (SELECT CASE WHEN vec_id % 11 = 0 THEN 'dimension' ELSE 'non-finite' END AS kind, printf('%06d', vec_id) AS path FROM n WHERE vec_id % 11 = 0 OR vec_id % 7 = 0)
SELECT kind, count(*) AS problems, array_to_string(list_sort(list(path))[1:5], ', ') || CASE WHEN count(*) > 5 THEN ', ...' ELSE '' END AS preview FROM bad GROUP BY kind""")
def a4_problem_report(spark, sf_dir):
    bad = odd_vectors(spark, sf_dir).where("vec_id % 11 = 0 OR vec_id % 7 = 0")
    kind = F.when(F.col("vec_id") % 11 == 0, "dimension").otherwise("non-finite")
    return search.problem_report(bad.select(kind.alias("kind"), F.format_string("%06d", "vec_id").alias("path")))


# --------------------------------------------------------------------------- documents, embedding, pooling
# Documents as files: source/doc_id.ext by doc_id % 4; every thirteenth begins with a NUL byte, every seventeenth is blank.

FILES = """
WITH f AS (
  SELECT doc_id, '/corpus/' || source || '/' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.TXT' WHEN 2 THEN '.html' ELSE '' END AS path,
    CASE WHEN doc_id % 17 = 0 THEN '   ' ELSE text END AS contents, doc_id % 13 = 0 AS binary_file FROM documents
)
"""


def as_files(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    ext = F.element_at(F.array(F.lit(".md"), F.lit(".TXT"), F.lit(".html"), F.lit("")), (F.col("doc_id") % 4 + 1).cast("int"))
    text = F.when(F.col("doc_id") % 17 == 0, "   ").otherwise(F.col("text"))
    raw = F.concat(F.when(F.col("doc_id") % 13 == 0, F.lit("\0")).otherwise(""), text).cast("binary")
    return d.select("doc_id", F.concat(F.lit("/corpus/"), "source", F.lit("/"), F.col("doc_id").cast("string"), ext).alias("path"), raw.alias("content"))


@query(FILES + "SELECT doc_id, path FROM f WHERE doc_id % 4 IN (0, 1)")
def p1_filter_extensions(spark, sf_dir):
    return corpus.filter_extensions(as_files(spark, sf_dir), [" .MD", "txt"]).select("doc_id", "path")


@query(FILES + "SELECT doc_id, CASE WHEN path LIKE '/corpus/src1/%' THEN substr(path, 14) ELSE path END AS path FROM f")
def p2_relative_path(spark, sf_dir):
    return as_files(spark, sf_dir).select("doc_id", corpus.relative_path("path", "/corpus/src1").alias("path"))


@query(FILES + "SELECT doc_id, CASE WHEN binary_file THEN 'binary' ELSE 'ok' END AS status, CASE WHEN binary_file THEN NULL ELSE length(contents) END AS chars FROM f")
def s2_decode_documents(spark, sf_dir):
    return corpus.decode_documents(as_files(spark, sf_dir)).select("doc_id", "status", F.length("contents").cast("long").alias("chars"))


@query(FILES + "SELECT doc_id FROM f WHERE NOT binary_file ORDER BY path LIMIT 25")
def p3_first_documents(spark, sf_dir):
    good = corpus.decode_documents(as_files(spark, sf_dir)).where("status = 'ok'")
    return good.orderBy("path").limit(25).select("doc_id")


@query(FILES + "SELECT doc_id FROM f WHERE doc_id % 17 = 0 AND NOT binary_file")
def j3_skipped_documents(spark, sf_dir):
    docs = corpus.decode_documents(as_files(spark, sf_dir)).where("status = 'ok'")
    return search.skipped_documents(docs, embed.embed_documents(docs)).select("doc_id")


#: Signed counts of the words' places, as the hashing model makes them.
HASHED = """, w AS (SELECT path, unnest(list_filter(string_split_regex(lower(contents), '\\s+'), lambda x: x <> '')) AS w FROM {rows}),
c{n} AS (SELECT path, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS pos, sum(CASE WHEN substr(md5(w), 9, 1) >= '8' THEN 1 ELSE -1 END)::DOUBLE AS c FROM w GROUP BY ALL)"""


@query(FILES + HASHED.format(rows="(SELECT path, contents FROM f WHERE NOT binary_file)", n="") + """, t AS (
  SELECT path, greatest(sqrt(sum(c * c)), 1e-300) AS norm, sum(c) AS total, coalesce(sum(c) FILTER (WHERE pos = 0), 0) AS first, coalesce(sum(c) FILTER (WHERE pos = 63), 0) AS last FROM c GROUP BY path
) SELECT path, round(total / norm, 6) + 0.0 AS total, round(first / norm, 6) + 0.0 AS first, round(last / norm, 6) + 0.0 AS last FROM t""")
def x1_embed_documents(spark, sf_dir):
    docs = corpus.decode_documents(wide(as_files(spark, sf_dir))).where("status = 'ok'")
    e = embed.embed_documents(docs)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return e.select("path", six(total).alias("total"), six(F.get("embedding", F.lit(0))).alias("first"), six(F.get("embedding", F.lit(63))).alias("last"))


@query(FILES + HASHED.format(rows="(SELECT path, contents FROM f WHERE NOT binary_file)", n="") + """,
qw AS (SELECT item_id, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS w FROM benchmark),
qc AS (SELECT item_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS pos, sum(CASE WHEN substr(md5(w), 9, 1) >= '8' THEN 1 ELSE -1 END)::DOUBLE AS c FROM qw GROUP BY ALL),
hits AS (SELECT item_id AS query_id, path, sum(c.c * qc.c) AS score FROM c JOIN qc USING (pos) GROUP BY ALL)
SELECT query_id, path, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path)::INT AS rank FROM hits QUALIFY rank <= 2""")
def x2_index_and_search(spark, sf_dir):
    docs = corpus.decode_documents(as_files(spark, sf_dir)).where("status = 'ok'")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("contents"))
    index, queries = embed.embed_documents(docs, normalized=False), embed.embed_documents(asked, key="query_id", normalized=False)
    return search.topk_search(index, queries, 2, normalized=False)


def token_vectors(spark, sf_dir):
    """Eight tokens of eight components from each vector; every fifth document masks its last three tokens."""
    t = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, F.lit(8)))
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (F.col("vec_id") % 5 != 0) | (i < 5))
    return table(spark, sf_dir, "embeddings").select("vec_id", t.alias("tokens"), mask.alias("mask"))


def _pool_sql(pick: str) -> str:
    return f"""
WITH t AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, CASE WHEN vec_id % 5 = 0 THEN 5 ELSE 8 END AS n FROM embeddings),
d AS (SELECT vec_id, j, list_transform(range(0, n), lambda i: e[i * 8 + j]) AS c FROM t, unnest(range(1, 9)) AS r(j)),
p AS (SELECT vec_id, list({pick} ORDER BY j) AS v FROM d GROUP BY vec_id)
SELECT vec_id, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) + 0.0 AS a, round(v[8] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) + 0.0 AS b FROM p
"""


def _pool(name, strategy, pick):
    def run(spark, sf_dir):
        p = token_vectors(spark, sf_dir).select("vec_id", embed.pool(strategy, "tokens", "mask").alias("v"))
        return p.select("vec_id", six(F.get("v", F.lit(0))).alias("a"), six(F.get("v", F.lit(7))).alias("b"))

    QUERIES[name], ORACLE_SQL[name] = run, _pool_sql(pick)


for _name, _strategy, _pick in (("mean", "mean", "list_avg(c)"), ("max", "max", "list_max(c)"), ("first", "first", "c[1]"), ("cls", "cls", "c[1]"), ("last", "last", "c[-1]"), ("none", None, "list_avg(c)")):
    _pool(f"a1_pool_{_name}", _strategy, _pick)


#: The same over a row per token; documents of the vectors' labels, so that a few have very many tokens.
LONG = {"mean": "avg(e[j])", "max": "max(e[j])", "first": "arg_min(e[j], p)", "last": "arg_max(e[j], p)"}


@query("WITH t AS (SELECT label, vec_id * 8 + i AS p, CAST(embedding AS DOUBLE[])[i * 8 + 1:i * 8 + 8] AS e FROM embeddings, unnest(range(8)) AS r(i) WHERE vec_id % 5 <> 0 OR i < 5), " + ", ".join(
    f"{n} AS (SELECT label, '{n}' AS strategy, list(x ORDER BY j) AS v FROM (SELECT label, j, {pick} AS x FROM t, unnest(range(1, 9)) AS s(j) GROUP BY label, j) GROUP BY label)" for n, pick in LONG.items()
) + " SELECT label, strategy, round(v[1] / norm, 6) + 0.0 AS a, round(v[8] / norm, 6) + 0.0 AS b FROM (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM (" + " UNION ALL ".join(f"FROM {n}" for n in LONG) + "))")
def a1_pool_rows(spark, sf_dir):
    t = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, F.lit(8)))).alias("i", "vector")
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id", t)
    rows = rows.select("label", (F.col("vec_id") * 8 + F.col("i")).alias("pos"), "vector", ((F.col("vec_id") % 5 != 0) | (F.col("i") < 5)).alias("mask"))
    done = [embed.pool_rows(rows, 8, n, key="label", mask="mask").select("label", F.lit(n).alias("strategy"), six(F.get("embedding", F.lit(0))).alias("a"), six(F.get("embedding", F.lit(7))).alias("b")) for n in LONG]
    return done[0].unionByName(done[1]).unionByName(done[2]).unionByName(done[3])


@query("SELECT DISTINCT 'no pooling strategy given; token vectors are averaged' AS fallback FROM embeddings")
def a3_fallback_messages(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.when(F.col("vec_id") % 2 == 0, F.lit(embed.pooling_fallback(None))).alias("fallback"))
    return search.fallback_messages(e)


IDS = "WITH i AS (SELECT doc_id, range(doc_id % 7, doc_id % 7 + n_chars % 9 + 1) AS ids, doc_id // 8 AS batch FROM documents)"


def id_lists(spark, sf_dir):
    start = F.col("doc_id") % 7
    return table(spark, sf_dir, "documents").select("doc_id", F.sequence(start, start + F.col("n_chars") % 9).alias("ids"), F.floor(F.col("doc_id") / 8).alias("batch"))


@query(IDS + "SELECT doc_id, len(list_filter(ids, lambda x: x <> 3)) AS live, len(ids) AS n FROM i")
def p5_attention_mask(spark, sf_dir):
    mask = vectors.attention_mask("ids", 3)
    return id_lists(spark, sf_dir).select("doc_id", F.size(F.filter(mask, lambda x: x)).cast("long").alias("live"), F.size(mask).cast("long").alias("n"))


@query(IDS + ", m AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch) AS most FROM i) SELECT doc_id, most AS n, list_sum(ids)::BIGINT AS total, (most - len(ids))::BIGINT AS pads FROM m")
def w3_pad_batch(spark, sf_dir):
    p = datasets.pad_batch(id_lists(spark, sf_dir), "batch", "ids", -1)
    real = F.filter("ids", lambda x: x >= 0)
    return p.select("doc_id", F.size("ids").cast("long").alias("n"), F.aggregate(real, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), (F.size("ids") - F.size(real)).cast("long").alias("pads"))


# --------------------------------------------------------------------------- metrics

LOGITS = "WITH l AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[])[1:10] AS z FROM embeddings)"


def logits(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.slice("embedding", 1, 10).alias("logits"))


@query(LOGITS + "SELECT round(avg(CASE WHEN list_position(z, list_max(z)) - 1 = label THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS accuracy FROM l")
def a5_accuracy(spark, sf_dir):
    return evaluate.accuracy(logits(spark, sf_dir)).select(six(F.col("accuracy")).alias("accuracy"))


@query(LOGITS + "SELECT round(avg(ln(list_sum(list_transform(z, lambda x: exp(x)))) - z[label + 1]), 6) AS cross_entropy FROM l")
def a6_cross_entropy(spark, sf_dir):
    return evaluate.cross_entropy(logits(spark, sf_dir)).select(six(F.col("cross_entropy")).alias("cross_entropy"))


@query("SELECT round(avg((l_extendedprice / 1e5 - l_quantity / 50) ** 2), 6) AS mse FROM lineitem")
def a6_mean_squared_error(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 50).alias("predicted"), (F.col("l_extendedprice") / 1e5).alias("actual"))
    return evaluate.mean_squared_error(li).select(six(F.col("mse")).alias("mse"))


STEPS = "WITH s AS (SELECT event_id + 1 AS iter, value / 100 AS loss, 0.25 + (event_id % 4) * 0.25 AS seconds, event_id % 100 + 1 AS tokens FROM events)"


def steps(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select((F.col("event_id") + 1).alias("iter"), (F.col("value") / 100).alias("loss"), (0.25 + (F.col("event_id") % 4) * 0.25).alias("seconds"), (F.col("event_id") % 100 + 1).alias("tokens"))


@query(STEPS + "SELECT round(sum(loss * tokens) / sum(tokens), 6) AS loss, round(exp(sum(loss * tokens) / sum(tokens)), 5) AS perplexity FROM s")
def a7_perplexity(spark, sf_dir):
    return evaluate.perplexity(steps(spark, sf_dir)).select(six(F.col("loss")).alias("loss"), F.round("perplexity", 5).alias("perplexity"))


@query(STEPS + "SELECT (iter - 1) // 10 AS report, max(iter) AS iter, round(avg(loss), 6) AS loss, round((count(*) / sum(seconds))::DOUBLE, 6) AS iterations_per_second, round((sum(tokens) / sum(seconds))::DOUBLE, 6) AS tokens_per_second FROM s GROUP BY 1")
def a8_training_report(spark, sf_dir):
    r = evaluate.training_report(steps(spark, sf_dir))
    return r.select("report", "iter", *(six(F.col(c)).alias(c) for c in ("loss", "iterations_per_second", "tokens_per_second")))


@query(STEPS + "SELECT iter, unnest(['saved', 'validated']) AS mark FROM s WHERE iter % 100 = 0 UNION ALL SELECT iter, 'validated' FROM s WHERE iter = 1")
def a8_checkpoints(spark, sf_dir):
    return evaluate.checkpoints(steps(spark, sf_dir))


@query(STEPS + """, v AS (SELECT (event_id // 10 + 1) AS iter, value AS loss, 0.25 AS seconds FROM events)
SELECT s.iter, round(avg(v.loss), 6) AS validation_loss, round(sum(v.seconds)::DOUBLE, 6) AS validation_seconds
FROM s LEFT JOIN v ON v.iter = s.iter WHERE s.iter = 1 OR s.iter % 100 = 0 GROUP BY s.iter""")
def a8_validation_report(spark, sf_dir):
    scored = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 10 + 1).alias("iter"), F.col("value").alias("loss"), F.lit(0.25).alias("seconds"))
    r = evaluate.validation_report(steps(spark, sf_dir), scored)
    return r.select("iter", six(F.col("validation_loss")).alias("validation_loss"), six(F.col("validation_seconds")).alias("validation_seconds"))


# --------------------------------------------------------------------------- runs
# A run is a user's events by time: a chunk is the event's type (empty for "view"), "error" is a tool call.

RUNS = """
WITH ev AS (
  SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, ts, event_id, value,
    CASE WHEN event_type = 'error' THEN 'tool' ELSE 'chunk' END AS kind, CASE WHEN event_type = 'view' THEN '' ELSE event_type END AS chunk, props, event_type FROM events
), rn AS (SELECT user_id AS run_id, 'model' || (user_id % 5) AS model, min(ts) - INTERVAL 1 SECOND AS start_ts, 40 AS max_tokens FROM events GROUP BY user_id)
"""


def run_events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    seq = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return e.select(
        F.col("user_id").alias("run_id"), seq.alias("seq"), "ts", "event_id", "value",
        F.when(F.col("event_type") == "error", "tool").otherwise("chunk").alias("kind"),
        F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")).alias("chunk"), "props", "event_type",
    )


def run_table(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("run_id")).agg((F.min("ts") - F.expr("INTERVAL 1 SECOND")).alias("start_ts")).select("run_id", F.concat(F.lit("model"), (F.col("run_id") % 5).cast("string")).alias("model"), "start_ts", F.lit(40).alias("max_tokens"))


METRICS = RUNS + """, m AS (
  SELECT run_id, min(ts) AS a, max(ts) AS b, count(*) FILTER (WHERE seq = 1 OR (kind = 'chunk' AND chunk <> '')) AS rate_tokens, count(*) FILTER (WHERE kind = 'chunk' AND chunk <> '') AS total_tokens FROM ev GROUP BY run_id
), g AS (
  SELECT rn.run_id, model, (epoch_us(a) - epoch_us(start_ts)) / 1e3 AS ttft_ms, rate_tokens, total_tokens, (epoch_us(b) - epoch_us(a)) / 1e6 AS seconds,
    rate_tokens / nullif((epoch_us(b) - epoch_us(a)) / 1e6, 0) AS tokens_per_second, total_tokens >= max_tokens AS truncated FROM rn JOIN m USING (run_id))
"""


@query(METRICS + "SELECT run_id, model, round(ttft_ms, 3) AS ttft_ms, rate_tokens, total_tokens, round(seconds, 6) AS seconds, round(tokens_per_second, 9) AS tokens_per_second, truncated FROM g")
def a9_generation_metrics(spark, sf_dir):
    m = runs.generation_metrics(run_events(spark, sf_dir), run_table(spark, sf_dir))
    return m.select("run_id", "model", F.round("ttft_ms", 3).alias("ttft_ms"), "rate_tokens", "total_tokens", F.round("seconds", 6).alias("seconds"), F.round("tokens_per_second", 9).alias("tokens_per_second"), "truncated")


@query(METRICS + "SELECT model, count(*) AS runs, round(avg(ttft_ms), 3) AS mean_ttft_ms, round(max(tokens_per_second), 9) AS best_tokens_per_second, sum(total_tokens)::BIGINT AS tokens, sum(truncated::BIGINT)::BIGINT AS truncated_runs FROM g GROUP BY model")
def a9_model_summary(spark, sf_dir):
    m = runs.model_summary(runs.generation_metrics(run_events(spark, sf_dir), run_table(spark, sf_dir)))
    return m.select("model", "runs", F.round("mean_ttft_ms", 3).alias("mean_ttft_ms"), F.round("best_tokens_per_second", 9).alias("best_tokens_per_second"), "tokens", "truncated_runs")


@query(RUNS + ", t AS (SELECT *, min(CASE WHEN kind = 'tool' THEN seq END) OVER (PARTITION BY run_id) AS tool FROM ev) SELECT run_id, string_agg(chunk, '' ORDER BY seq) AS output FROM t WHERE kind = 'chunk' AND (tool IS NULL OR seq < tool) GROUP BY run_id")
def a11_assemble_output(spark, sf_dir):
    return runs.assemble_output(run_events(spark, sf_dir))


@query(RUNS + "SELECT run_id, seq, round(value - first_value(value) OVER (PARTITION BY run_id ORDER BY seq), 6) + 0.0 AS delta FROM ev")
def w6_delta_from_start(spark, sf_dir):
    return runs.delta_from_start(run_events(spark, sf_dir), "run_id", "seq", "value").select("run_id", "seq", six(F.col("delta")).alias("delta"))


@query(RUNS + ", r AS (SELECT run_id, seq, (epoch_us(ts) - epoch_us(first_value(ts) OVER (PARTITION BY run_id ORDER BY seq))) / 1e6 AS s FROM ev) SELECT run_id, seq, CASE WHEN s > 0 THEN round(seq / s, 9) END AS rate FROM r")
def w7_running_rate(spark, sf_dir):
    return runs.running_rate(run_events(spark, sf_dir)).select("run_id", "seq", F.round("rate", 9).alias("rate"))


@query(RUNS + ", t AS (SELECT run_id, seq, (seq * 10) // count(*) OVER (PARTITION BY run_id) AS tenth FROM ev), l AS (SELECT *, lag(tenth) OVER w AS was, lead(tenth) OVER w AS nxt FROM t WINDOW w AS (PARTITION BY run_id ORDER BY seq)) SELECT run_id, seq, tenth FROM l WHERE tenth > coalesce(was, 0) OR nxt IS NULL")
def w8_progress_milestones(spark, sf_dir):
    e = run_events(spark, sf_dir).withColumn("total", F.count("*").over(W.partitionBy("run_id")))
    return runs.progress_milestones(e, "run_id", "seq", "seq", "total").select("run_id", "seq", "tenth")


@query("""WITH t AS (SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'add_two_numbers' ELSE event_type END AS name, event_id % 10 IN (0, 3, 6) AS bad FROM events)
SELECT event_id, CASE WHEN name <> 'add_two_numbers' THEN 'Unknown tool: ' || name WHEN bad THEN 'Malformed arguments' ELSE '{"result":' || (event_id - 7) || '}' END AS result FROM t""")
def p7_route_tool_calls(spark, sf_dir):
    e, i = table(spark, sf_dir, "events"), F.col("event_id").cast("string")
    tail = F.when(F.col("event_id") % 10 == 3, "}").when(F.col("event_id") % 10 == 6, ', "second": 0.5}').otherwise(', "second": -7}')
    args = F.when(F.col("event_id") % 10 == 0, "oops").otherwise(F.concat(F.lit('{"first": '), i, tail))
    calls = e.select("event_id", F.when(F.col("event_type").isin("click", "view"), "add_two_numbers").otherwise(F.col("event_type")).alias("name"), args.alias("arguments"))
    return runs.route_tool_calls(calls).select("event_id", "result")


@query("SELECT n_name AS model, CASE WHEN n_nationkey % 5 = 0 THEN 'vlm' ELSE 'llm' END AS type, item_id AS prompt_id, CASE WHEN n_nationkey % 5 = 0 THEN '--image' END AS arguments FROM nation, benchmark")
def j4_eval_matrix(spark, sf_dir):
    models = table(spark, sf_dir, "nation").select(F.col("n_name").alias("model"), F.when(F.col("n_nationkey") % 5 == 0, "vlm").otherwise("llm").alias("type"))
    prompts = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("prompt_id"))
    return runs.eval_matrix(models, prompts, {"vlm": "--image"})


@query("""WITH p AS (SELECT doc_id AS prompt_id, CASE WHEN doc_id % 3 = 0 THEN [doc_id, doc_id + 1] WHEN doc_id % 3 = 1 THEN [doc_id, -1] END AS refs, lang FROM documents)
SELECT prompt_id, CASE WHEN refs IS NULL THEN p.lang WHEN a.doc_id IS NULL OR b.doc_id IS NULL THEN 'hello' ELSE a.lang || chr(10) || b.lang END AS prompt
FROM p LEFT JOIN documents a ON a.doc_id = refs[1] LEFT JOIN documents b ON b.doc_id = refs[2]""")
def j5_resolve_prompts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id").cast("string")
    at = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("@"), i, F.lit(",@"), (F.col("doc_id") + 1).cast("string"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("@"), i, F.lit(",@none"))).otherwise(F.col("lang"))
    return runs.resolve_prompts(d.select(F.col("doc_id").alias("prompt_id"), at.alias("prompt")), d.select(i.alias("path"), F.col("lang").alias("contents")), "hello")


CHAT = "WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM (SELECT conv_id, turn, role, CASE WHEN conv_id % 3 = 0 AND role = 'assistant' THEN '' ELSE text END AS text FROM conversations))"


def blanked(spark, sf_dir):
    text = F.when((F.col("conv_id") % 3 == 0) & (F.col("role") == "assistant"), "").otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", text.alias("text"))


@query(CHAT + "SELECT conv_id, turn, role, text FROM c WHERE NOT (back = 1 AND role = 'assistant' AND text = '')")
def p6_open_turn(spark, sf_dir):
    return runs.open_turn(blanked(spark, sf_dir))


@query(CHAT + """SELECT conv_id, string_agg(role || ':' || text || CASE WHEN conv_id % 4 = 0 AND back = last THEN chr(10) || '[Cancelled]' ELSE '' END, '|' ORDER BY place, turn) AS chat
FROM (SELECT *, arg_max(back, place * 100000 + turn) OVER (PARTITION BY conv_id) AS last FROM (SELECT *, CASE role WHEN 'system' THEN 0 WHEN 'tool' THEN 2 ELSE 1 END AS place FROM c)) GROUP BY conv_id""")
def a12_assemble_chat(spark, sf_dir):
    chats = blanked(spark, sf_dir)
    done = runs.assemble_chat(chats, chats.where("conv_id % 4 = 0"))
    return done.select("conv_id", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "|").alias("chat"))


# --------------------------------------------------------------------------- prompts and splits
# Tables are regions with a header of four columns; questions are parts with up to two conditions.


def questions(spark, sf_dir):
    tables = table(spark, sf_dir, "region").select(F.col("r_name").alias("id"), F.array(*[F.lit(c) for c in "abcd"]).alias("header"), F.array(F.lit("text"), F.lit("real"), F.lit("text"), F.lit("real")).alias("types"))
    p = table(spark, sf_dir, "part").join(table(spark, sf_dir, "region"), F.col("p_partkey") % 5 == F.col("r_regionkey"))
    one = F.array(F.lit("0"), (F.col("p_size") % 4).cast("string"), F.col("p_brand"))
    two = F.array(F.lit("1"), F.lit("1"), F.col("p_size").cast("string"))
    conds = F.slice(F.array(one, two), 1, (F.col("p_partkey") % 3).cast("int"))
    sql = F.struct((F.col("p_partkey") % 4).cast("int").alias("sel"), (F.col("p_size") % 6).cast("int").alias("agg"), conds.alias("conds"))
    return p.select("p_partkey", F.col("r_name").alias("table_id"), F.col("p_name").alias("question"), sql.alias("sql")), tables


PROMPTS = """
WITH q AS (
  SELECT p_partkey, r_name, p_name, 'SELECT ' || ['', 'MAX ', 'MIN ', 'COUNT ', 'SUM ', 'AVG '][p_size % 6 + 1] || ['a', 'b', 'c', 'd'][p_partkey % 4 + 1] || ' FROM ' || r_name
    || CASE WHEN p_partkey % 3 > 0 THEN ' WHERE a ' || ['=', '>', '<', 'OP'][p_size % 4 + 1] || ' ''' || p_brand || '''' ELSE '' END
    || CASE WHEN p_partkey % 3 > 1 THEN ' AND b > ' || p_size ELSE '' END AS sql_text
  FROM part JOIN region ON p_partkey % 5 = r_regionkey
), t AS (SELECT p_partkey, sql_text, 'table: ' || r_name || chr(10) || 'columns: a, b, c, d' || chr(10) || 'Q: ' || p_name || chr(10) || 'A: ' || sql_text AS text FROM q)
"""


@query(PROMPTS + "SELECT p_partkey, sql_text, text FROM t")
def f14_wikisql_text(spark, sf_dir):
    asked, tables = questions(spark, sf_dir)
    return sft.wikisql_text(sft.join_wikisql(asked, tables)).select("p_partkey", "sql_text", "text")


@query("SELECT p_partkey, r_name AS table_id, 4 AS columns FROM part JOIN region ON p_partkey % 5 = r_regionkey")
def j1_join_wikisql(spark, sf_dir):
    asked, tables = questions(spark, sf_dir)
    return sft.join_wikisql(asked, tables).select("p_partkey", "table_id", F.size("header").alias("columns"))


SPLIT = "CASE p_partkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'valid' ELSE 'test' END"


@query(f"SELECT split, p_partkey FROM (SELECT p_partkey, {SPLIT} AS split, row_number() OVER (PARTITION BY p_partkey % 3 ORDER BY p_partkey) AS n FROM part) WHERE n <= CASE split WHEN 'train' THEN 1000 ELSE 100 END")
def t2_take_splits(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.expr(SPLIT).alias("split"))
    return sft.take_splits(p, {"train": 1000, "valid": 100, "test": 100}, order="p_partkey").select("split", "p_partkey")


@query(f"SELECT {SPLIT} AS split, p_partkey, p_name FROM part")
def u2_union_splits(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    parts = {name: p.where(F.col("p_partkey") % 3 == i).select("p_partkey", "p_name") for i, name in enumerate(("train", "valid", "test"))}
    return sft.union_splits(**parts)


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1) // 64 AS batch_id, ((row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1) % 64)::INT AS pos FROM orders")
def w1_assign_batches(spark, sf_dir):
    return datasets.assign_batches(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", size=64).select("o_orderkey", "batch_id", "pos")


@query(FILES + "SELECT path, (row_number() OVER (ORDER BY path) - 1) // 8 AS batch_id, ((row_number() OVER (ORDER BY path) - 1) % 8)::INT AS pos FROM f")
def w1_batches_by_path(spark, sf_dir):
    return datasets.assign_batches(as_files(spark, sf_dir).select("path"), "path", size=8).select("path", "batch_id", "pos")


@query(f"""WITH a AS (SELECT o_orderkey, ((1000010 + (o_orderkey + 1)::UHUGEINT * 11400714819323198485::UHUGEINT % {_U}) % {_U})::UBIGINT AS z FROM orders),
b AS (SELECT o_orderkey, (xor(z, z >> 30)::UHUGEINT * 13787848793156543929::UHUGEINT % {_U})::UBIGINT AS z FROM a),
c AS (SELECT o_orderkey, (xor(z, z >> 27)::UHUGEINT * 10723151780598845931::UHUGEINT % {_U})::UBIGINT AS z FROM b)
SELECT o_orderkey, row_number() OVER (ORDER BY xor(xor(z, z >> 31), 9223372036854775808::UBIGINT), o_orderkey) - 1 AS position FROM c""")
def w2_seeded_shuffle(spark, sf_dir):
    return datasets.seeded_shuffle(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 7, 1)


@query("SELECT o_orderkey FROM (SELECT o_orderkey, (row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1) // 64 AS b FROM orders) WHERE b < 10")
def t3_cap_batches(spark, sf_dir):
    b = datasets.assign_batches(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", size=64)
    return datasets.cap_batches(b, 10).select("o_orderkey")


# --------------------------------------------------------------------------- files
# Tables are written to the shared folder in each format and read back.


@query("SELECT vec_id::VARCHAR AS path, len(embedding)::INT AS dimension, round(list_sum(CAST(embedding AS DOUBLE[])), 4) + 0.0 AS total FROM embeddings")
def s4_load_index(spark, sf_dir):
    at = scratch(spark, "index")
    tables.write_index(table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("path"), "embedding"), at, "json")
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return tables.load_index(spark, at, "json").select("path", F.size("embedding").alias("dimension"), (F.round(total, 4) + 0.0).alias("total"))


@query(f"SELECT {SPLIT} AS split, count(*) AS n, sum(length(p_name))::BIGINT AS chars FROM part GROUP BY 1")
def s5_read_sft(spark, sf_dir):
    at = scratch(spark, "sft")
    tables.write_sft(table(spark, sf_dir, "part").select(F.col("p_name").alias("text"), F.expr(SPLIT).alias("split")), at)
    back = [tables.read_sft(spark, at, name, "jsonl", folder=f"{at}/split={name}") for name in ("train", "valid", "test")]
    whole = back[0].unionByName(back[1]).unionByName(back[2])
    return whole.groupBy("split").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("chars"))


@query(PROMPTS + "SELECT p_partkey::VARCHAR || '|' || text AS text FROM t")
def s7_read_wikisql(spark, sf_dir):
    asked, meta = questions(spark, sf_dir)
    at = scratch(spark, "wikisql")
    asked.select("table_id", F.concat_ws("|", F.col("p_partkey").cast("string"), "question").alias("question"), "sql").write.json(f"{at}/dev.jsonl")
    meta.write.json(f"{at}/dev.tables.jsonl")
    back = sft.wikisql_text(sft.join_wikisql(*tables.read_wikisql(spark, at, "dev")))
    number = F.substring_index("question", "|", 1)
    return back.select(F.concat(number, F.lit("|"), F.replace("text", F.concat(F.lit("Q: "), number, F.lit("|")), F.lit("Q: "))).alias("text"))


@query("SELECT source, 'ok' AS status, sum(length(text) + 1)::BIGINT AS chars FROM documents GROUP BY source")
def s1_read_corpus(spark, sf_dir):
    at = scratch(spark, "corpus")
    table(spark, sf_dir, "documents").select("text", "source").repartition("source").write.partitionBy("source").text(at)
    docs = corpus.read_corpus(spark, at, recursive=True, piece_bytes=corpus.PIECE)
    return docs.groupBy(F.regexp_extract("path", "^source=([^/]+)/", 1).alias("source"), "status").agg(F.sum(F.length("contents")).cast("long").alias("chars"))


@query("""WITH f AS (SELECT source, 'source=' || source AS folder, string_split_regex(lower(string_agg(text, ' ')), '\\s+') AS words FROM documents GROUP BY source ORDER BY folder LIMIT 8),
c AS (SELECT source, pos, sum(sign)::DOUBLE AS c FROM (SELECT source, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS pos, CASE WHEN substr(md5(w), 9, 1) >= '8' THEN 1 ELSE -1 END AS sign FROM (SELECT source, unnest(words) AS w FROM f) WHERE w <> '') GROUP BY ALL),
qc AS (SELECT item_id, pos, sum(sign)::DOUBLE AS c FROM (SELECT item_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS pos, CASE WHEN substr(md5(w), 9, 1) >= '8' THEN 1 ELSE -1 END AS sign FROM (SELECT item_id, unnest(string_split_regex(lower(text), '\\s+')) AS w FROM benchmark) WHERE w <> '') GROUP BY ALL),
cn AS (SELECT source, sqrt(sum(c * c)) AS norm FROM c GROUP BY source), qn AS (SELECT item_id, sqrt(sum(c * c)) AS norm FROM qc GROUP BY item_id),
hits AS (SELECT item_id AS query_id, source, sum(c.c * qc.c) AS dot FROM c JOIN qc USING (pos) GROUP BY ALL)
SELECT query_id, hits.source, round(dot / cn.norm / qn.norm, 6) + 0.0 AS score, row_number() OVER (PARTITION BY query_id ORDER BY dot / cn.norm DESC, hits.source)::INT AS rank
FROM hits JOIN cn ON cn.source = hits.source JOIN qn ON qn.item_id = query_id QUALIFY rank <= 2""")
def x2_search_folder(spark, sf_dir):
    at = scratch(spark, "corpus")
    table(spark, sf_dir, "documents").select("text", "source").repartition("source").write.partitionBy("source").text(at)
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    hits = search.search_folder(spark, at, asked)
    return hits.select("query_id", F.regexp_extract("path", "^source=([^/]+)/", 1).alias("source"), six(F.col("score")).alias("score"), "rank")


@query("SELECT vec_id, list_sum(list_transform(embedding, lambda x: floor((x::DOUBLE + 1) * 127.5)))::BIGINT AS total, label FROM embeddings")
def s8_decode_idx(spark, sf_dir):
    import gzip

    @F.pandas_udf("binary")
    def packed(content):
        return content.map(gzip.compress)

    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label", F.floor(F.col("vec_id") / 500).alias("file"))
    byte = lambda x: F.lpad(F.hex(F.floor((x.cast("double") + 1) * 127.5).cast("int")), 2, "0")

    def files(record, header):  # five hundred records each
        rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", record.alias("hex")))), lambda r: r["hex"]), "")
        return e.groupBy("file").agg(F.unhex(F.concat(F.lit("00" * header), rows)).alias("raw")).select("file", packed("raw").alias("content"))

    images = tables.decode_idx(files(F.array_join(F.transform("embedding", byte), ""), 16), "pixels", 64, keys=("file",))
    labels = tables.decode_idx(files(F.lpad(F.hex("label"), 2, "0"), 8), "label", keys=("file",))
    total = F.aggregate("pixels", F.lit(0.0), lambda a, x: a + F.round(x.cast("double") * 255))
    order = e.select("vec_id", "file", (F.row_number().over(W.partitionBy("file").orderBy("vec_id")) - 1).cast("long").alias("idx"))
    return order.join(images.join(labels, ["file", "idx"]), ["file", "idx"]).select("vec_id", total.cast("long").alias("total"), "label")


@query("SELECT list_sum(list_transform(embedding, lambda x: floor((x::DOUBLE + 1) * 127.5)))::BIGINT AS total, label, count(*) AS n FROM embeddings GROUP BY ALL")
def s8_read_idx(spark, sf_dir):
    at = scratch(spark, "idx")
    byte = F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 127.5) / 255)
    idx.write_idx(table(spark, sf_dir, "embeddings").select(byte.alias("pixels"), "label"), at, 64)
    total = F.aggregate("pixels", F.lit(0.0), lambda a, x: a + F.round(x.cast("double") * 255))
    return idx.read_idx_folder(spark, at, 64).select(total.cast("long").alias("total"), "label").groupBy("total", "label").agg(F.count("*").alias("n"))


@query("WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part) SELECT w AS piece, row_number() OVER (ORDER BY w) - 1 AS id, row_number() OVER (ORDER BY w) - 1 AS rank FROM w")
def s9_read_bpe(spark, sf_dir):
    at = scratch(spark, "bpe")
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("w")).distinct()
    listed = words.agg(F.array_sort(F.collect_list("w")).alias("all"))  # a vocabulary: model data
    pairs = F.map_from_entries(F.transform("all", lambda w, i: F.struct(w, i)))
    listed.select(F.to_json(pairs).alias("value")).write.text(f"{at}/vocabulary")
    merges = F.concat(F.lit("#version\n"), F.array_join(F.transform("all", lambda w: F.concat(F.substring(w, 1, 1), F.lit(" "), F.substring(w, 2, 1 << 20))), "\n"))
    listed.select(merges.alias("value")).write.text(f"{at}/merges")
    ids, ranks = tables.read_bpe(spark, f"{at}/vocabulary", f"{at}/merges")
    return spark.createDataFrame([(w, ids[w], ranks[w[:1], w[1:]]) for w in ids], "piece string, id long, rank long")


# --------------------------------------------------------------------------- scalars


@query("SELECT p_partkey, round(p_size / 255, 6) AS unit, round(p_size / 50 * 2 - 1, 6) + 0.0 AS signed, round(least(greatest((p_size - 25) / 20 / 2 + 0.5, 0), 1)::DOUBLE, 6) AS decoded, floor(p_size / 64 * 255)::INT AS byte FROM part")
def f10_scale_pixels(spark, sf_dir):
    p, s = table(spark, sf_dir, "part"), F.col("p_size")
    one = lambda c, mode: F.get(scalars.scale_pixels(F.array(c), mode), F.lit(0))
    return p.select("p_partkey", six(one(s, "unit")).alias("unit"), six(one(s / 50, "signed")).alias("signed"), six(one((s - 25) / 20, "decode")).alias("decoded"), one(s / 64, "byte").alias("byte"))


@query("""WITH d AS (SELECT doc_id, n_chars % 3000 + 64 AS w, doc_id % 2000 + 64 AS h FROM documents), s AS (SELECT *, CASE WHEN w > h THEN 1024 / w ELSE 1024 / h END AS k FROM d)
SELECT doc_id, (floor(floor(w * k + 0.5) / 64) * 64)::INT AS width, (floor(floor(h * k + 0.5) / 64) * 64)::INT AS height FROM s""")
def f11_fit_size(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", scalars.fit_size(F.col("n_chars") % 3000 + 64, F.col("doc_id") % 2000 + 64, 1024).alias("s"))
    return d.select("doc_id", "s.width", "s.height")


BYTES = "WITH b AS (SELECT doc_id, (n_chars * CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 1500 ELSE 2000000 END)::DOUBLE AS n FROM documents)"


@query(BYTES + " SELECT doc_id, CASE WHEN n >= 1073741824 THEN printf('%.2f GB', n / 1073741824) WHEN n >= 1048576 THEN printf('%.0f MB', n / 1048576) WHEN n >= 1024 THEN printf('%.0f KB', n / 1024) ELSE '0 KB' END AS size FROM b")
def f12_format_bytes(spark, sf_dir):
    times = F.element_at(F.array(F.lit(1), F.lit(1500), F.lit(2000000)), (F.col("doc_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", scalars.format_bytes(F.col("n_chars") * times).alias("size"))


@query("SELECT n_nationkey, n_name || ' - ' || CASE WHEN m >= 1000 THEN printf('%.1fB', m / 1000) ELSE m || 'M' END AS label FROM (SELECT n_nationkey, n_name, (n_nationkey * 150000000::BIGINT) // 1048576 AS m FROM nation)")
def f13_model_label(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.select("n_nationkey", scalars.model_label(F.concat(F.lit("org/"), "n_name"), F.col("n_nationkey") * F.lit(150000000).cast("long")).alias("label"))


@query(f"""WITH a AS (SELECT o_orderkey, ((7 + (o_orderkey + 1)::UHUGEINT * 11400714819323198485::UHUGEINT % {_U}) % {_U})::UBIGINT AS z FROM orders),
b AS (SELECT o_orderkey, (xor(z, z >> 30)::UHUGEINT * 13787848793156543929::UHUGEINT % {_U})::UBIGINT AS z FROM a),
c AS (SELECT o_orderkey, (xor(z, z >> 27)::UHUGEINT * 10723151780598845931::UHUGEINT % {_U})::UBIGINT AS z FROM b)
SELECT o_orderkey, CAST(xor(z, z >> 31) AS VARCHAR) AS word FROM c""")
def f16_splitmix64(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", scalars.splitmix64(7, "o_orderkey").alias("w"))
    wide = F.col("w").cast("decimal(20,0)")
    return o.select("o_orderkey", F.when(F.col("w") < 0, wide + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(wide).cast("decimal(20,0)").cast("string").alias("word"))


@query("SELECT l_orderkey, l_linenumber, round(3 + x * (0.5 + x * (3 - x)), 6) + 0.0 AS y FROM (SELECT l_orderkey, l_linenumber, l_quantity / 50 AS x FROM lineitem)")
def f17_predict_poly(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", six(scalars.predict_poly(F.col("l_quantity") / 50, [3.0, 0.5, 3.0, -1.0])).alias("y"))


@query("""WITH p AS (SELECT p_partkey, p_size::DOUBLE AS x, p_size * (2 / 40) AS i FROM part), q AS (SELECT *, floor(i) AS lo FROM p),
lut AS (SELECT unnest([0, 1, 2]) AS k, unnest([0, 255, 10]) AS b, unnest([10, 20, 200]) AS g)
SELECT p_partkey, CASE WHEN x >= 40 THEN 1 ELSE round_even(l.b + (i - lo) * (h.b - l.b), 0) END::INT AS blue, CASE WHEN x >= 40 THEN 2 ELSE round_even(l.g + (i - lo) * (h.g - l.g), 0) END::INT AS green
FROM q LEFT JOIN lut l ON l.k = least(lo, 2) LEFT JOIN lut h ON h.k = least(lo + 1, 2)""")
def f18_apply_ramp(spark, sf_dir):
    c = scalars.apply_ramp("p_size", [(0, 10, 0, 255), (255, 20, 0, 255), (10, 200, 0, 255)], 40.0, (1, 2, 3, 4))
    return table(spark, sf_dir, "part").select("p_partkey", F.get(c, F.lit(0)).alias("blue"), F.get(c, F.lit(1)).alias("green"))


@query("SELECT CASE WHEN event_id % 3 = 0 THEN 'training' ELSE 'validation' END AS kind, event_id AS iteration, round(value, 4) AS loss, CASE WHEN event_id % 3 = 0 THEN 2.5::DOUBLE END AS per_second, CASE WHEN event_id % 3 <> 0 THEN 3.5::DOUBLE END AS seconds FROM events WHERE event_id % 3 < 2")
def f20_parse_training_log(spark, sf_dir):
    i, loss = F.col("event_id").cast("string"), F.round("value", 4).cast("string")
    line = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Iteration "), i, F.lit(": training loss "), loss, F.lit(", iterations/sec 2.5, Tokens/sec 250.25"))).when(
        F.col("event_id") % 3 == 1, F.concat(F.lit("Iteration "), i, F.lit(": validation loss "), loss, F.lit(", validation time 3.5s"))).otherwise("noise")
    return scalars.parse_training_log(table(spark, sf_dir, "events").select(line.alias("line"))).select("kind", "iteration", "loss", "per_second", "seconds")


# --------------------------------------------------------------------------- fits, zones, windows

FIT = """
WITH RECURSIVE m AS (
  SELECT l_returnflag, count(*)::DOUBLE AS n, sum(x) AS x1, sum(x * x) AS x2, sum(y) AS y1, sum(x * y) AS xy, sum(y * y) AS y2
  FROM (SELECT l_returnflag, l_quantity / 50 AS x, l_extendedprice / 1e5 AS y FROM lineitem) GROUP BY 1
), d AS (
  SELECT l_returnflag, 0 AS step, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM m
  UNION ALL SELECT d.l_returnflag, step + 1, a - 0.5 * 2 * (a + b * x1 / n - y1 / n), b - 0.5 * 2 * (a * x1 / n + b * x2 / n - xy / n) FROM d JOIN m USING (l_returnflag) WHERE step < 40
)
"""


def _line_fit(spark, sf_dir, trace=False):
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_quantity") / 50).alias("x"), (F.col("l_extendedprice") / 1e5).alias("y"))
    return fit.fit_poly(li, 1, 0.5, 40, by=["l_returnflag"], trace=trace)


@query(FIT + "SELECT l_returnflag, step, round(a, 6) + 0.0 AS a, round(b, 6) + 0.0 AS b, round(a * a + 2 * a * b * x1 / n + b * b * x2 / n - 2 * (a * y1 / n + b * xy / n) + y2 / n, 6) + 0.0 AS loss FROM d JOIN m USING (l_returnflag)")
def a10_fit_poly(spark, sf_dir):
    f = _line_fit(spark, sf_dir, True)
    return f.select("l_returnflag", "step", six(F.get("theta", F.lit(0))).alias("a"), six(F.get("theta", F.lit(1))).alias("b"), six(F.col("loss")).alias("loss"))


@query("WITH p AS (SELECT p_partkey, p_size / 50 AS x, p_retailprice / 1000 AS y FROM part) SELECT p_partkey AS id, round(x, 6) AS x, round(y, 6) AS y, 'actual' AS series FROM p UNION ALL SELECT p_partkey + 1000000, round(x, 6), round(0.5 + x, 6), 'predicted' FROM p")
def u1_series_long(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), six(F.col("p_size") / 50).alias("x"), six(F.col("p_retailprice") / 1000).alias("actual"), six(scalars.predict_poly(F.col("p_size") / 50, [0.5, 1.0])).alias("predicted"))
    return fit.series_long(p, 1000000)


@query("""WITH p AS (SELECT doc_id, (doc_id % 64)::INT AS x, (n_chars % 64)::INT AS y FROM documents),
z AS (SELECT *, (x >= 10 AND x < 20 AND y >= 5 AND y < 40) AS wall, CASE WHEN (x - 25) ** 2 + (y - 25) ** 2 < 36 THEN 0.0 WHEN (x - 30) ** 2 + (y - 30) ** 2 < 100 THEN 0.75 ELSE 0.0 END::DOUBLE AS value, (x = 0 OR y = 0 OR x = 63 OR y = 63) AS border FROM p)
SELECT doc_id, wall, value, border, (wall OR border OR value > 0) AS "static" FROM z""")
def j6_tag_zones(spark, sf_dir):
    p = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 64).cast("int").alias("x"), (F.col("n_chars") % 64).cast("int").alias("y"))
    return lookup.tag_zones(p, [(10, 5, 10, 35)], [(30, 30, 10, 0.75), (25, 25, 6, 0.0)], 64, 64).drop("x", "y")


ZONES = """
WITH p AS (SELECT event_id, event_id * 7919 % 1024 AS x, (value * 37)::BIGINT % 1024 AS y FROM events),
r AS (SELECT p_partkey * 31 % 1024 AS x, p_partkey * 57 % 1024 AS y, p_size % 9 AS w, p_size % 7 AS h FROM part),
c AS (SELECT o_orderkey AS seq, o_custkey * 13 % 1024 AS x, o_orderkey * 29 % 1024 AS y, CASE WHEN o_orderkey % 500 = 0 THEN 90 ELSE o_orderkey % 6 END AS r, round(o_totalprice / 1e4, 2) - 10 AS value FROM orders)
"""


@query(ZONES + """, w AS (SELECT DISTINCT event_id FROM p JOIN r ON p.x >= r.x AND p.x < r.x + r.w AND p.y >= r.y AND p.y < r.y + r.h),
v AS (SELECT event_id, arg_max(value, seq) AS value FROM p JOIN c ON (p.x - c.x) ** 2 + (p.y - c.y) ** 2 < c.r ** 2 GROUP BY event_id)
SELECT event_id, w.event_id IS NOT NULL AS wall, coalesce(value, 0)::DOUBLE AS value, (x = 0 OR y = 0 OR x = 1023 OR y = 1023) AS border, (w.event_id IS NOT NULL OR x = 0 OR y = 0 OR x = 1023 OR y = 1023 OR coalesce(value, 0) > 0) AS "static"
FROM p LEFT JOIN w USING (event_id) LEFT JOIN v USING (event_id)""")
def j6_zones_as_tables(spark, sf_dir):
    p = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 7919 % 1024).alias("x"), (F.rint(F.col("value") * 37).cast("long") % 1024).alias("y"))
    r = table(spark, sf_dir, "part").select((F.col("p_partkey") * 31 % 1024).alias("x"), (F.col("p_partkey") * 57 % 1024).alias("y"), (F.col("p_size") % 9).alias("w"), (F.col("p_size") % 7).alias("h"))
    k = F.col("o_orderkey")
    c = table(spark, sf_dir, "orders").select(k.alias("seq"), (F.col("o_custkey") * 13 % 1024).alias("x"), (k * 29 % 1024).alias("y"), F.when(k % 500 == 0, 90).otherwise(k % 6).alias("r"), (F.round(F.col("o_totalprice") / 1e4, 2) - 10).alias("value"))
    return lookup.tag_zones_by_tile(p, r, c, 1024, 1024).drop("x", "y")


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey + l_quantity / 64 - 2 AS spot FROM lineitem), t AS (SELECT p_partkey - 1 AS pos, p_retailprice AS v FROM part)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN spot < 0 THEN NULL WHEN spot = floor(spot) THEN l.v ELSE round(l.v + (spot - floor(spot)) * (h.v - l.v), 6) END AS y
FROM a LEFT JOIN t l ON l.pos = floor(spot) LEFT JOIN t h ON h.pos = floor(spot) + 1""")
def j7_interpolate_by_table(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_partkey") + F.col("l_quantity") / 64 - 2).alias("at"))
    prices = table(spark, sf_dir, "part").select((F.col("p_partkey") - 1).alias("pos"), F.col("p_retailprice").alias("value"))
    return lookup.interpolate_by_table(li, "at", prices).withColumn("y", F.round("y", 6)).drop("at")


@query("WITH p AS (SELECT p_partkey, p_size / 12.5 AS pos FROM part), v AS (SELECT [1.0, 4.0, 2.0, 8.0, 5.0]::DOUBLE[] AS t) SELECT p_partkey, round(t[floor(pos)::INT + 1] + (pos - floor(pos)) * (t[least(floor(pos)::INT + 1, 4) + 1] - t[floor(pos)::INT + 1]), 6)::DOUBLE AS y FROM p, v")
def j7_interpolate(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", six(lookup.interpolate([1.0, 4.0, 2.0, 8.0, 5.0], F.col("p_size") / 12.5)).alias("y"))


@query("SELECT event_id, round(avg(value) OVER w, 6) AS mean, CASE WHEN avg(value) OVER w > 0 THEN round(1 / avg(value) OVER w, 6) END AS rate FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)")
def w4_moving_rate(spark, sf_dir):
    return lookup.moving_rate(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value").select("event_id", six(F.col("mean")).alias("mean"), six(F.col("rate")).alias("rate"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, n, event_id, t AS last, true AS shown FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.n, e.event_id, CASE WHEN e.t - r.last >= 3600000000 THEN e.t ELSE r.last END, e.t - r.last >= 3600000000 FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT user_id, event_id FROM r WHERE shown""")
def w5_throttle(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return scan.throttle(e, "user_id", "ts", "event_id", 3600.0).select("user_id", "event_id")


# The same over few keys with very many rows each, which are cut into ranges.


@query("SELECT event_id, round(avg(value) OVER w, 6) AS mean, CASE WHEN avg(value) OVER w > 0 THEN round(1 / avg(value) OVER w, 6) END AS rate FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)")
def w4_moving_rate_spread(spark, sf_dir):
    return lookup.moving_rate(table(spark, sf_dir, "events"), "event_type", ["ts", "event_id"], "value", spread=True).select("event_id", six(F.col("mean")).alias("mean"), six(F.col("rate")).alias("rate"))


@query("""WITH RECURSIVE e AS (SELECT event_type, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT event_type, n, event_id, t AS last, true AS shown FROM e WHERE n = 1
  UNION ALL SELECT e.event_type, e.n, e.event_id, CASE WHEN e.t - r.last >= 600000000 THEN e.t ELSE r.last END, e.t - r.last >= 600000000 FROM r JOIN e ON e.event_type = r.event_type AND e.n = r.n + 1)
SELECT event_type, event_id FROM r WHERE shown""")
def w5_throttle_spread(spark, sf_dir):
    return scan.throttle(table(spark, sf_dir, "events").select("event_type", "event_id", "ts"), "event_type", "ts", "event_id", 600.0).select("event_type", "event_id")


@query("SELECT event_id, round(value - first_value(value) OVER (PARTITION BY event_type ORDER BY ts, event_id), 6) + 0.0 AS delta FROM events")
def w6_delta_spread(spark, sf_dir):
    return runs.delta_from_start(table(spark, sf_dir, "events"), "event_type", ["ts", "event_id"], "value", spread=True).select("event_id", six(F.col("delta")).alias("delta"))


@query("WITH r AS (SELECT event_id, row_number() OVER w AS n, (epoch_us(ts) - epoch_us(first_value(ts) OVER w)) / 1e6 AS s FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)) SELECT event_id, CASE WHEN s > 0 THEN round(n / s, 9) END AS rate FROM r")
def w7_running_rate_spread(spark, sf_dir):
    return runs.running_rate(table(spark, sf_dir, "events"), "event_type", ["ts", "event_id"], spread=True).select("event_id", F.round("rate", 9).alias("rate"))


@query("SELECT event_id, round(product(1 - value / 1e6) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS product FROM events")
def w9_cumulative_product_spread(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("f", 1 - F.col("value") / 1e6)
    return lookup.cumulative_product(e, "event_type", ["ts", "event_id"], "f", spread=True).select("event_id", six(F.col("product")).alias("product"))


LINES = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount"]
OVER = "(PARTITION BY l_orderkey ORDER BY " + ", ".join(LINES) + " ROWS UNBOUNDED PRECEDING)"


@query(f"SELECT l_orderkey, l_linenumber, round(product(1 - l_discount) OVER {OVER}, 6) + 0.0 AS product FROM lineitem")
def w9_cumulative_product(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("f", 1 - F.col("l_discount"))
    return lookup.cumulative_product(li, "l_orderkey", LINES, "f").select("l_orderkey", "l_linenumber", six(F.col("product")).alias("product"))


@query(f"WITH p AS (SELECT l_orderkey, l_linenumber, product(1 - l_discount) OVER {OVER} AS a FROM lineitem) SELECT l_orderkey, l_linenumber, round(sqrt(greatest((1 - a) / a, 0)), 6) + 0.0 AS sigma FROM p")
def w9_noise_schedule(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return lookup.noise_schedule(li, "l_orderkey", LINES, "l_discount").select("l_orderkey", "l_linenumber", six(F.col("sigma")).alias("sigma"))


# --------------------------------------------------------------------------- tokens

#: A small vocabulary for the queries: single letters and digits, their word-end forms, and a few merges.
_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"
_MERGES = [("t", "h"), ("th", "e</w>"), ("o", "n</w>"), ("e", "r"), ("i", "n"), ("in", "g</w>")]
VOCABULARY = {p: i for i, p in enumerate([tokenize.BOS, tokenize.EOS, *_LETTERS, *(c + "</w>" for c in _LETTERS), *("".join(m) for m in _MERGES)])}
RANKS = {m: i for i, m in enumerate(_MERGES)}


@query(r"""WITH t AS (SELECT doc_id, regexp_extract_all(regexp_replace(lower(text), '\s+', ' ', 'g'), '<\|startoftext\|>|<\|endoftext\|>|''s|''t|''re|''ve|''m|''ll|''d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+') AS w FROM documents)
SELECT doc_id, len(w) AS words, sha256(array_to_string(w, ' ')) AS digest FROM t""")
def f15_pre_split(spark, sf_dir):
    d = wide(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", tokenize.pre_split("text").alias("w"))
    return d.select("doc_id", F.size("w").cast("long").alias("words"), F.sha2(F.array_join("w", " ").cast("binary"), 256).alias("digest"))


def _merged(word: str) -> str:
    """SQL for the pieces of a word between chr(1) and chr(2), merged in the order of the ranks."""
    out = f"replace(regexp_replace({word}, '(.)', chr(1) || '\\1' || chr(2), 'gs') || chr(3), chr(2) || chr(3), '</w>' || chr(2))"
    for a, b in _MERGES:
        out = f"replace({out}, chr(1) || '{a}' || chr(2) || chr(1) || '{b}' || chr(2), chr(1) || '{a}{b}' || chr(2))"
    return out


#: Names of pieces and their ids; a name may hold the mark of a word's end.
_IDS = ", ".join(f"('{p}', {i})" for p, i in VOCABULARY.items())


@query(rf"""WITH t AS (SELECT doc_id, regexp_extract_all(regexp_replace(lower(text), '\s+', ' ', 'g'), '<\|startoftext\|>|<\|endoftext\|>|''s|''t|''re|''ve|''m|''ll|''d|[\p{{L}}]+|[\p{{N}}]|[^\s\p{{L}}\p{{N}}]+') AS w FROM documents),
v(piece, id) AS (VALUES {_IDS}),
p AS (SELECT doc_id, generate_subscripts(s, 1) AS i, unnest(s) AS piece FROM (SELECT doc_id, string_split(array_to_string(list_transform(w, lambda x: {_merged("x")}), ''), chr(2)) AS s FROM t)),
k AS (SELECT doc_id, i, id FROM p JOIN v ON v.piece = substr(p.piece, 2)),
g AS (SELECT doc_id, count(*) AS n, string_agg(id::VARCHAR, ',' ORDER BY i) AS ids FROM k GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) + 2 AS n, sha256('0,' || coalesce(ids || ',', '') || '1') AS digest FROM documents LEFT JOIN g USING (doc_id)""".replace("\\\\", "\\"))
def j8_tokenize(spark, sf_dir):
    done = tokenize.tokenize(wide(table(spark, sf_dir, "documents").select("doc_id", "text")), VOCABULARY, RANKS, "doc_id", "text")
    return done.select("doc_id", F.size("ids").cast("long").alias("n"), F.sha2(F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").cast("binary"), 256).alias("digest"))


def word_bpe(spark: SparkSession, path: str | None = None) -> tuple[dict[str, int], dict[tuple[str, str], int]]:
    """A vocabulary of 49,408 word pieces; the path is that of the public file where none is given."""
    if path is None:
        import public_tokenizers

        path = str(public_tokenizers.path("word_bpe_49k.json"))
    return tables.read_bpe_json(spark, f"file://{path}" if path.startswith("/") else path)


@query()
def f15_tokenize_49k(spark, sf_dir):
    done = tokenize.tokenize(wide(table(spark, sf_dir, "documents").select("doc_id", "text")), *word_bpe(spark), "doc_id", "text")
    return done.select("doc_id", F.size("ids").cast("long").alias("n"), F.crc32(F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").cast("binary")).alias("ids_crc32"))


# --------------------------------------------------------------------------- streams
# The events table is read as a stream until it is used up.


def _event_stream(spark, sf_dir):
    e = drain.read_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.select(
        F.col("user_id").alias("run_id"), "event_id", "ts", "value",
        F.when(F.col("event_type") == "error", "tool").otherwise("chunk").alias("kind"),
        F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")).alias("chunk"),
    )


@query(RUNS + """, m AS (SELECT run_id, count(*) FILTER (WHERE kind = 'chunk' AND chunk <> '') AS tokens, (max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 AS s FROM ev GROUP BY run_id)
SELECT run_id, tokens, CASE WHEN s > 0 THEN round(tokens / s, 9) END AS tokens_per_second, tokens >= 40 AS truncated FROM m""")
def st1_stream_generation_metrics(spark, sf_dir):
    live = streams.stream_generation_metrics(_event_stream(spark, sf_dir), "1 day", 40)
    return drain.drain(live, "update", "run_id").select("run_id", "tokens", F.round("tokens_per_second", 9).alias("tokens_per_second"), "truncated")


@query("SELECT epoch_us(ts) // 3600000000 AS hour, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1")
def st2_stream_tumbling(spark, sf_dir):
    live = streams.stream_tumbling(_event_stream(spark, sf_dir), "1 hour")
    hour = F.floor(F.unix_micros("start") / 3600000000)
    return drain.drain(live, "complete").select(hour.alias("hour"), "n", six(F.col("mean_value")).alias("mean_value"))


@query(SEARCH)
def st3_stream_search(spark, sf_dir):
    index, _ = _search_inputs(spark, sf_dir)
    asked = drain.read_stream(spark, sf_dir, "embeddings").where("vec_id % 100 = 0")
    v = F.transform("embedding", lambda x, i: F.when((F.col("vec_id") % 7 == 0) & (i == 0), F.lit(float("nan"))).otherwise(x.cast("double")))
    asked = asked.select(F.col("vec_id").alias("query_id"), F.lit("asked").alias("text"), F.when(F.col("vec_id") % 11 == 0, F.slice(v, 1, 60)).otherwise(v).alias("embedding"))
    found = drain.drain_search(asked, index, 5)
    return found.withColumn("score", six(F.col("score")))


@query("""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, n, t, t AS last, true AS shown FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.n, e.t, CASE WHEN e.t - r.last >= 3600000000 THEN e.t ELSE r.last END, e.t - r.last >= 3600000000 FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT CAST(user_id AS VARCHAR) AS key, t AS micros FROM r WHERE shown""")
def st4_stream_throttle(spark, sf_dir):
    e = _event_stream(spark, sf_dir).select(F.col("run_id").cast("string").alias("key"), "ts", "value")
    return drain.drain(streams.stream_throttle(e, 3600.0)).select("key", F.unix_micros("ts").alias("micros"))


@query("""WITH RECURSIVE e AS (SELECT event_type, epoch_us(ts) AS t, row_number() OVER w AS n, avg(value) OVER (w ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS mean FROM events
  WHERE epoch_us(ts) < (SELECT max(epoch_ms(ts)) - 86400000 FROM events) * 1000 WINDOW w AS (PARTITION BY event_type ORDER BY ts, value)),
r AS (SELECT event_type, n, t, mean, t AS last, true AS shown FROM e WHERE n = 1
  UNION ALL SELECT e.event_type, e.n, e.t, e.mean, CASE WHEN e.t - r.last >= 600000000 THEN e.t ELSE r.last END, e.t - r.last >= 600000000 FROM r JOIN e ON e.event_type = r.event_type AND e.n = r.n + 1)
SELECT event_type AS key, t AS micros, round(mean, 6) AS mean FROM r WHERE shown""")
def st4_throttle_in_order(spark, sf_dir):
    e = drain.read_stream(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "value")
    with ordered.rocksdb(spark):
        done = drain.drain(ordered.throttle_in_order(e, 600.0, late="1 day"))
    return done.select("key", F.unix_micros("ts").alias("micros"), six(F.col("mean")).alias("mean"))


@query("""WITH e AS (SELECT user_id AS run_id, event_id, epoch_us(ts) AS t, CASE WHEN event_type = 'error' THEN 'tool' ELSE 'chunk' END AS kind, CASE WHEN event_type = 'view' THEN '' ELSE event_type END AS chunk FROM events),
f AS (SELECT *, min(CASE WHEN kind = 'tool' THEN event_id END) OVER (PARTITION BY run_id) AS tool FROM e)
SELECT run_id, count(*) FILTER (WHERE kind = 'chunk' AND chunk <> '') AS tokens, max(t) AS last_micros, coalesce(string_agg(chunk, '' ORDER BY event_id) FILTER (WHERE kind = 'chunk' AND (tool IS NULL OR event_id < tool)), '') AS output
FROM f GROUP BY run_id HAVING max(t) // 1000 + 21600000 < (SELECT max(epoch_ms(ts)) FROM events)""")
def st1_run_results(spark, sf_dir):
    e = _event_stream(spark, sf_dir).withColumnRenamed("event_id", "seq")
    with ordered.rocksdb(spark):
        done = drain.drain(ordered.run_results(e, "6 hours"))
    return done.select("run_id", "tokens", F.unix_micros("last_ts").alias("last_micros"), "output")
