"""Queries over recognizer steps, texts and file names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import maths as M
from ..functions import text as T
from ..operators import decode
from . import fixtures as X
from .catalog import query
from .detection_queries import r6


@query(
    f"""WITH {X.STEPS_SQL}, s AS (SELECT crop_id, t, CAST(list_position(probs, list_max(probs)) AS INT) - 1 AS idx, list_max(probs) AS best FROM steps),
  p AS (SELECT *, lag(idx, 1, -1) OVER (PARTITION BY crop_id ORDER BY t) AS prev FROM s),
  d AS (SELECT crop_id, string_agg(chr(48 + idx), '' ORDER BY t) AS text, avg(CAST(best AS DOUBLE)) AS c FROM p WHERE idx <> 0 AND idx <> prev GROUP BY crop_id)
  SELECT k.crop_id, coalesce(text, '') AS text, round(coalesce(c, 0), 6) AS confidence FROM (SELECT DISTINCT crop_id FROM steps) k LEFT JOIN d ON k.crop_id = d.crop_id"""
)
def ctc_decode(spark, sf_dir):
    out = decode.ctc_decode(X.steps(spark, sf_dir), F.chr(F.col("idx") + 48))
    return out.select("crop_id", "text", r6(F.col("confidence"), "confidence"))


@query(
    f"""WITH {X.STEPS_SQL} SELECT crop_id, t, CAST(list_position(probs, list_max(probs)) AS INT) - 1 AS idx, round(CAST(list_max(probs) AS DOUBLE), 6) AS best FROM steps"""
)
def argmax_steps(spark, sf_dir):
    return decode.best_steps(X.steps(spark, sf_dir)).select("crop_id", "t", "idx", r6(F.col("best").cast("double"), "best"))


@query(f"WITH {X.STEPS_SQL} SELECT round(avg(CAST((list_position(probs, list_max(probs)) - 1) % 10 = crop_id AS INT)), 6) AS accuracy FROM steps")
def argmax_accuracy(spark, sf_dir):
    best = decode.best_steps(X.steps(spark, sf_dir))
    return best.agg(r6(F.avg((F.pmod("idx", F.lit(10)) == F.col("crop_id")).cast("int")), "accuracy"))


@query(r"SELECT doc_id, trim(regexp_replace(text, '[\s\x1c-\x1f\x85\p{Z}]+', ' ', 'g')) AS text FROM documents")
def ws_normalize(spark, sf_dir):
    return X.table(spark, sf_dir, "documents").select("doc_id", T.squeeze(F.col("text")).alias("text"))


_OCR = "o AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN '' ELSE source END AS text, CAST(doc_id % 100 AS DOUBLE) / 100 AS conf FROM documents)"


def _ocr(spark, sf_dir):
    text = F.when(F.pmod("doc_id", F.lit(11)) == 0, None).when(F.pmod("doc_id", F.lit(7)) == 0, "").otherwise(F.col("source"))
    return X.table(spark, sf_dir, "documents").select("doc_id", text.alias("text"), (F.pmod("doc_id", F.lit(100)).cast("double") / 100).alias("conf"))


@query(
    f"""WITH {_OCR}, s AS (SELECT doc_id, CASE WHEN text IS NULL THEN 'ocr_error' WHEN text <> '' AND conf >= 0.6 THEN text ELSE 'no_text_detected' END AS shown,
  CASE WHEN text IS NULL THEN 'ocr_error' WHEN text <> '' AND conf > 0.6 THEN text ELSE 'no_text_detected' END AS shown_strict FROM o)
  SELECT *, shown NOT IN ('no_text_detected', 'empty_crop', 'ocr_error') AS sent FROM s"""
)
def ocr_status(spark, sf_dir):
    shown = _ocr(spark, sf_dir).select("doc_id", T.status(F.col("text"), F.col("conf"), 0.6).alias("shown"), T.status(F.col("text"), F.col("conf"), 0.6, strict=True).alias("shown_strict"))
    return shown.withColumn("sent", T.succeeded(F.col("shown")))


@query("SELECT doc_id, CASE WHEN lower(coalesce(nullif(lang, 'fr'), 'en')) IN ('ch', 'chinese_cht', 'japan') THEN 'server' WHEN lower(coalesce(nullif(lang, 'fr'), 'en')) IN ('en', 'korean', 'th', 'el', 'te', 'ta') THEN lower(coalesce(nullif(lang, 'fr'), 'en')) ELSE 'latin' END AS model FROM documents")
def language_model(spark, sf_dir):
    return X.table(spark, sf_dir, "documents").select("doc_id", T.language_model(F.nullif("lang", F.lit("fr"))).alias("model"))


@query(
    """WITH e AS (SELECT user_id, event_id, event_type || CASE WHEN event_id % 3 = 0 THEN '  x ' ELSE '' END AS t, value FROM events)
  SELECT user_id, nullif(trim(regexp_replace(coalesce(string_agg(t, ' ' ORDER BY event_id) FILTER (WHERE value > 50), ''), '\\s+', ' ', 'g')), '') AS text FROM e GROUP BY user_id""".replace("\\\\", "\\")
)
def text_join(spark, sf_dir):
    t = F.concat("event_type", F.when(F.pmod("event_id", F.lit(3)) == 0, "  x ").otherwise(""))
    lines = X.table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", t.alias("t"), "value"))).alias("l"))
    texts, scores = F.transform("l", lambda x: x["t"]), F.transform("l", lambda x: x["value"])
    return lines.select("user_id", T.joined_lines(texts, scores, 50.0).alias("text"))


@query("SELECT page_id, list_last(string_split(url, '/')) AS name FROM pages")
def base_names(spark, sf_dir):
    return X.table(spark, sf_dir, "pages").select("page_id", T.base_name(F.col("url")).alias("name"))


@query("SELECT p_partkey, regexp_replace('module.' || p_name || '.module.w', '^module\\.', '') AS name FROM part".replace("\\\\", "\\"))
def strip_prefix(spark, sf_dir):
    return X.table(spark, sf_dir, "part").select("p_partkey", T.without_wrapper(F.concat(F.lit("module."), F.col("p_name"), F.lit(".module.w"))).alias("name"))


@query(f"WITH {X.STEPS_SQL}, s AS (SELECT crop_id, t, list_transform(probs, lambda v: exp(CAST(v AS DOUBLE))) AS e FROM steps) SELECT crop_id, t, round(list_max(e) / list_sum(e), 6) AS largest, round(list_sum(list_transform(list_zip(e, range(64)), lambda z: z[1] / list_sum(e) * z[2])), 5) AS expected FROM s")
def softmax_integral(spark, sf_dir):
    p = X.steps(spark, sf_dir).select("crop_id", "t", M.softmax(F.col("probs")).alias("p"))
    bins = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: i.cast("double"))
    return p.select("crop_id", "t", r6(F.array_max("p"), "largest"), F.round(M.expectation(F.col("p"), bins), 5).alias("expected"))


@query(f"WITH {X.STEPS_SQL}, s AS (SELECT crop_id, t, list_sort(list_transform(probs, lambda v: CAST(v AS DOUBLE)), 'DESC')[1:4] AS b FROM steps) SELECT crop_id, t, round(b[1], 6) AS first, round(b[4], 6) AS fourth, round(list_sum(b) / 4, 6) AS mean FROM s")
def lqe_stats(spark, sf_dir):
    top = X.steps(spark, sf_dir).select("crop_id", "t", M.top_values(M.doubles(F.col("probs")), 4).alias("b"))
    return top.select("crop_id", "t", r6(F.get("b", F.lit(0)), "first"), r6(F.get("b", F.lit(3)), "fourth"), r6(M.mean_of(F.col("b")), "mean"))


@query(
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS v FROM embeddings)
  SELECT a.vec_id, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM e a JOIN e b ON a.vec_id + 1 = b.vec_id"""
)
def distill_cosine(spark, sf_dir):
    e = X.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("teacher"))
    return e.join(other, "vec_id").select("vec_id", r6(M.cosine(F.col("embedding"), F.col("teacher")), "cosine"))


_QUERIES = "q AS (SELECT label AS image_id, vec_id AS query_id, embedding AS logits FROM embeddings)"


def _queries(spark, sf_dir):
    return X.table(spark, sf_dir, "embeddings").select(F.col("label").alias("image_id"), F.col("vec_id").alias("query_id"), F.col("embedding").alias("logits"))


@query(
    f"""WITH {_QUERIES}, f AS (SELECT image_id, query_id, CAST(i.range AS INT) AS label, logits[i.range + 1] AS logit FROM q, range(64) i),
  s AS (SELECT image_id, query_id, label, 1 / (1 + exp(-CAST(logit AS DOUBLE))) AS score FROM f),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY image_id ORDER BY score DESC, query_id, label) AS INT) AS rank FROM s)
  SELECT image_id, query_id, label, rank, round(score, 6) AS score FROM r WHERE rank <= 30"""
)
def flat_topk(spark, sf_dir):
    from ..operators import detect

    return detect.flat_topk(_queries(spark, sf_dir), 30).select("image_id", "query_id", "label", "rank", r6(F.col("score"), "score"))


@query(
    f"""WITH {_QUERIES}, e AS (SELECT image_id, query_id, list_transform(logits, lambda v: exp(CAST(v AS DOUBLE))) AS e FROM q),
  s AS (SELECT image_id, query_id, CAST(list_position(e[1:63], list_max(e[1:63])) AS INT) - 1 AS label, list_max(e[1:63]) / list_sum(e) AS score FROM e),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY image_id ORDER BY score DESC, query_id) AS INT) AS rank FROM s)
  SELECT image_id, query_id, label, rank FROM r WHERE rank <= 10"""
)
def best_class_topk(spark, sf_dir):
    from ..operators import detect

    return detect.best_class_topk(_queries(spark, sf_dir), 10).select("image_id", "query_id", "label", "rank")


@query(
    f"""WITH {_QUERIES}, r AS (SELECT image_id, query_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY list_max(logits) DESC, query_id) AS INT) AS by_class,
  CAST(row_number() OVER (PARTITION BY image_id ORDER BY logits[1] DESC, query_id) AS INT) AS by_first FROM q)
  SELECT image_id, query_id, 'default' AS method, by_class AS rank FROM r WHERE by_class <= 10
  UNION ALL SELECT image_id, query_id, 'agnostic', by_first FROM r WHERE by_first <= 10
  UNION ALL SELECT image_id, query_id, 'one2many', rank FROM (SELECT image_id, query_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY logits[i.range + 1] DESC, query_id, i.range) AS INT) AS rank FROM q, range(64) i) WHERE rank <= 10"""
)
def query_select(spark, sf_dir):
    from functools import reduce

    from ..operators import detect

    q = _queries(spark, sf_dir)
    parts = [detect.select_queries(q, 10, m).withColumn("method", F.lit(m)) for m in ("default", "agnostic", "one2many")]
    return reduce(lambda a, b: a.unionByName(b), parts)
