"""The thin queries over the operators of this subpackage, and SQL where it can express them.

A query imports its operator when it runs, so that a package that one operator needs is not needed by the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chat

    probe = "\\### Assistant: </turn> ok"
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    formatted = chat.format_conversations(turns.unionByName(extra))
    read = formatted.select("conv_id", "formatted", "n_messages", chat.parse(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.col("n_messages").cast("long").alias("n_messages"),
    )


_OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), n AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS DISTINCT FROM role AS opens,
    length(text) + length(regexp_replace(text, '[^\\<>]', '', 'g')) AS chars,
    length(role) + length(regexp_replace(role, '[^\\<>]', '', 'g')) AS role_chars
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars + CASE WHEN opens THEN role_chars + 15 ELSE 6 END) AS BIGINT) AS formatted_chars,
  CAST(sum(CAST(opens AS INT)) AS BIGINT) AS n_messages
FROM n GROUP BY conv_id
"""

MIN_SITES = 10


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import line_dedup

    out = line_dedup.remove_boilerplate(_read(spark, sf_dir, "documents"), min_sites=MIN_SITES)
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.md5("text").alias("kept_md5"))


_OP2_SQL = f"""
WITH l AS (
  SELECT doc_id, source, text, pos, string_split(text, chr(10))[pos] AS line
  FROM (SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents WHERE text IS NOT NULL)
), bad AS (
  SELECT trim(line, ' ') AS line, min(doc_id) AS keeper FROM l WHERE length(trim(line, ' ')) >= 1
  GROUP BY 1 HAVING count(DISTINCT coalesce(source, chr(0))) >= {MIN_SITES}
), k AS (
  SELECT l.*, bad.line IS NOT NULL AND bad.keeper <> doc_id AS gone FROM l LEFT JOIN bad ON trim(l.line, ' ') = bad.line
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
  CAST(length(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS BIGINT) AS kept_chars,
  md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_md5
FROM k GROUP BY doc_id
UNION ALL SELECT doc_id, 0, 0, NULL, NULL FROM documents WHERE text IS NULL
"""


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    planned = mixing.plan(_read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return planned.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.col("mix_copies")).alias("taken"),
        "source",
    )


_OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [5, 2, 1][CAST((row_number() OVER (ORDER BY CAST(source AS BLOB) NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight
  FROM d GROUP BY source
), rounds AS (
  SELECT 0 AS k, (SELECT CAST(sum(source_size) AS DOUBLE) FROM s) / (SELECT CAST(sum(weight) AS DOUBLE) FROM s) AS level
  UNION ALL
  SELECT k + 1, (SELECT CAST(sum(source_size) - coalesce(sum(source_size * 3) FILTER (WHERE source_size * 3 <= weight * r.level), 0) AS DOUBLE)
      / CAST(sum(weight) FILTER (WHERE source_size * 3 > weight * r.level) AS DOUBLE) FROM s)
  FROM rounds r WHERE k < 40 AND level IS NOT NULL
), level AS (SELECT level FROM rounds WHERE level IS NOT NULL ORDER BY k DESC LIMIT 1),
t AS (SELECT s.*, least(CAST(source_size * 3 AS DOUBLE), weight * level) AS target FROM s, level),
r AS (SELECT *, coalesce(target / nullif(source_size, 0), 0) AS rate FROM t)
SELECT d.doc_id, d.size, r.source_size, r.target, d.source,
  CAST(d.size * (floor(rate) + CASE WHEN CAST(CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""

QUERIES = {"op1_chat_formatting": op1_chat_formatting, "op2_line_dedup": op2_line_dedup, "op8_mixing": op8_mixing}
ORACLES = {"op1_chat_formatting": _OP1_SQL, "op2_line_dedup": _OP2_SQL, "op8_mixing": _OP8_SQL}


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontam

    found = decontam.scan(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"), keep=["doc_id"])
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


QUERIES["op3_decontamination"] = op3_decontamination

#: Plain form: windows of each length as joined words; hit words as distinct places.
_OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(10, len(w)) AS m, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS words FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS words FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)),
hit AS (SELECT doc_id, i, dw.m, item FROM dw JOIN bw ON dw.m = bw.m AND dw.words = bw.words),
n AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS place FROM (SELECT DISTINCT doc_id, i, m FROM hit)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""

ORACLES["op3_decontamination"] = _OP3_SQL


def _fold(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def toxicity_model(docs: DataFrame, labels: DataFrame) -> "toxicity.Model":  # noqa: F821
    """The model that the query and the pipeline share: held-out rows are never read."""
    from . import toxicity

    return toxicity.fit(docs, labels.where(_fold(F.col("doc_id")) != 0))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity_model(docs, _read(spark, sf_dir, "labels")), keep=["doc_id"])
    return scored.select("doc_id", (_fold(F.col("doc_id")) == 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


QUERIES["op6_toxicity"] = op6_toxicity


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc

    path = warc.archive(_read(spark, sf_dir, "pages"), min_bytes=0)
    read = warc.read_archives(spark, path, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES["op7_warc"] = op7_warc

#: Plain form, for the tests: payloads equal byte for byte; base 32 as groups of 20 bits. It is no reference SQL of the
#: entry, since table libraries disagree on how a null among whole numbers reads.
OP7_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, payload, octet_length(payload) AS payload_bytes, sha1(payload) AS hex, max(page_id) OVER (PARTITION BY payload) AS keeper FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, 5 * CAST(i // 4 AS INT) + 1, 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT) + 1, 1)), '') AS payload_digest,
  CASE WHEN keeper IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN keeper IS DISTINCT FROM page_id THEN keeper END AS refers_to
FROM d
"""


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ngram_join

    found = ngram_join.near_duplicates(_read(spark, sf_dir, "documents").select("doc_id", "text"), words=5, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "class_id")


QUERIES["op9_ngram_join"] = op9_ngram_join

#: Plain form: all pairs of classes that share a shingle; components by reachability.
_OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
c AS (SELECT min(doc_id) AS class_id, s, CAST(len(s) AS BIGINT) AS n FROM s WHERE len(s) > 0 GROUP BY s),
g AS (SELECT class_id, n, unnest(s) AS g FROM c),
k AS (SELECT a.class_id AS a, b.class_id AS b, a.n AS n, b.n AS m, count(*) AS common FROM g a JOIN g b ON a.g = b.g AND a.class_id < b.class_id WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
l AS (SELECT a, b FROM k WHERE 100 * common >= 80 * (n + m - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT class_id, class_id AS seen FROM c UNION SELECT r.class_id, e.b FROM r JOIN e ON r.seen = e.a),
t AS (SELECT class_id, min(seen) AS component_id FROM r GROUP BY class_id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(t.component_id, s.doc_id) AS component_id, c.class_id
FROM s LEFT JOIN c ON s.s = c.s LEFT JOIN t ON c.class_id = t.class_id
"""

ORACLES["op9_ngram_join"] = _OP9_SQL


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffix_dedup

    done = suffix_dedup.remove_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"), length=200)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


QUERIES["op10_suffix_dedup"] = op10_suffix_dedup

#: Plain form: every 200-byte string, as hex.
_OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS d_row, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT d_row, p, hash(substr(h, 2 * p + 1, 400)) AS k, md5(substr(h, 2 * p + 1, 400)) AS k2 FROM (SELECT d_row, h, unnest(range(0, length(h) // 2 - 199)) AS p FROM d WHERE length(h) >= 400)),
r AS (SELECT d_row, p FROM (SELECT d_row, p, count(*) OVER (PARTITION BY k, k2) AS n FROM s) WHERE n > 1),
o AS (SELECT d_row, p, max(p + 200) OVER (PARTITION BY d_row ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
g AS (SELECT d_row, p, sum(CASE WHEN reach IS NULL OR p > reach THEN 1 ELSE 0 END) OVER (PARTITION BY d_row ORDER BY p) AS span FROM o),
x AS (SELECT d_row, span, min(p) AS a, max(p) + 200 AS b FROM g GROUP BY ALL),
y AS (SELECT d_row, a, b, coalesce(lag(b) OVER (PARTITION BY d_row ORDER BY a), 0) AS free FROM x),
z AS (SELECT y.d_row, count(*) AS n_spans, CAST(sum(b - a) AS BIGINT) AS n_removed, max(b) AS last, string_agg(substr(h, 2 * free + 1, 2 * (a - free)), '' ORDER BY a) AS kept FROM y JOIN d ON y.d_row = d.d_row GROUP BY y.d_row)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept || substr(h, 2 * last + 1), h))) AS kept_sha256
FROM d LEFT JOIN z ON d.d_row = z.d_row
"""

ORACLES["op10_suffix_dedup"] = _OP10_SQL

#: Not a secret: the query must give equal results everywhere. Real runs pass a key of their own.
DEMO_KEY = b"framequery demonstration key"


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    found = pii.pseudonymize(_read(spark, sf_dir, "documents").select("doc_id", "text"), DEMO_KEY)
    count = lambda kind: F.size(F.filter("pii", lambda p: p["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", F.size("pii").cast("long").alias("n_pii"), *[count(k) for k, _ in pii.PATTERNS], "text")


QUERIES["op4_pii"] = op4_pii


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ann

    found = ann.search(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)
    return found.select("query_id", "rank", "vec_id", "score")


QUERIES["op5_ann"] = op5_ann


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sharding

    placed = sharding.place(_read(spark, sf_dir, "documents").select("doc_id", "text"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


QUERIES["op12_sharding"] = op12_sharding

#: CRC-32 byte by byte, with its table made from the polynomial.
_CRC_SQL = r"""
bits0 AS (SELECT i, CAST(i AS BIGINT) AS v, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits0 WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY i) AS t FROM bits0 WHERE k = 8)"""


def _crc_of(hex_text: str) -> str:
    """SQL of the CRC-32 of bytes given in hex, beside a column t of the table."""
    return f"xor(list_reduce(list_transform(range(0, length({hex_text}) // 2), lambda b: CAST(CAST('0x' || substr({hex_text}, CAST(2 * b + 1 AS INT), 2) AS INT) AS BIGINT)), lambda c, b: xor(c >> 8, t[CAST(xor(c & 255, b) + 1 AS INT)]), 4294967295::BIGINT), 4294967295)"


_OP12_SQL = f"""
WITH RECURSIVE {_CRC_SQL},
d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 16) AS key FROM documents),
j AS (SELECT r, CAST('0x' || key AS UBIGINT)::HUGEINT AS k, -1::BIGINT AS b, 0::BIGINT AS j FROM d
  UNION ALL
  SELECT r, k2, j, CAST(floor((j + 1) * (2147483648.0::DOUBLE / CAST((k2 // 8589934592) + 1 AS DOUBLE))) AS BIGINT)
  FROM (SELECT r, j, (k * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS k2 FROM j WHERE j < 41)),
s AS (SELECT r, CAST(max(j) FILTER (WHERE j < 40) AS INT) AS shard, CAST(max(j) FILTER (WHERE j < 41) AS INT) AS grown_shard FROM j GROUP BY r),
x AS (SELECT doc_id, CAST(length(h) // 2 + 16 AS BIGINT) AS size, CAST({_crc_of("h")} AS BIGINT) AS text_crc32, 'key' AS law, shard, grown_shard, key FROM d JOIN s ON d.r = s.r, crc_table)
SELECT doc_id, size, text_crc32, law, shard, row_number() OVER (PARTITION BY shard ORDER BY key, doc_id, size, text_crc32) - 1 AS slot, grown_shard FROM x
"""

ORACLES["op12_sharding"] = _OP12_SQL


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import resampling

    docs, target = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")
    return resampling.resample(docs, target, percent=10, buckets=10000, runs=(1, 1), least_words=20, seed="2024")


QUERIES["op13_resampling"] = op13_resampling

_OP13_SQL = rf"""
WITH RECURSIVE {_CRC_SQL},
w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
e AS (SELECT r, unnest(w) AS word FROM w),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
v AS (SELECT word, CAST({_crc_of("h")} % 10000 AS INT) AS bucket FROM (SELECT DISTINCT word, hex(encode(word)) AS h FROM (SELECT word FROM e UNION SELECT word FROM b)), crc_table),
s AS (SELECT bucket, count(*) AS n FROM e JOIN v USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM b JOIN v USING (word) GROUP BY bucket),
g AS (SELECT i AS bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM e) + 10000)::DOUBLE / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM b) + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM range(10000) x(i) LEFT JOIN s ON s.bucket = i LEFT JOIN t ON t.bucket = i),
f AS (SELECT r, CAST(count(*) AS BIGINT) AS n, CAST(sum(gain) AS BIGINT) AS total FROM e JOIN v USING (word) JOIN g USING (bucket) GROUP BY r),
m AS (SELECT w.r, doc_id, coalesce(n, 0) AS n_features, CASE WHEN n IS NULL THEN 0 ELSE (total - ((total % n) + n) % n) // n END AS weight,
  CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) AS h FROM w LEFT JOIN f ON w.r = f.r),
c AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM m),
k AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, r) AS place, count(*) OVER () AS eligible FROM c WHERE n_features >= 20)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CASE WHEN place <= 10 * eligible // 100 THEN place END AS rank FROM c LEFT JOIN k ON c.r = k.r
"""

ORACLES["op13_resampling"] = _OP13_SQL


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import collocations

    return collocations.collocations(_read(spark, sf_dir, "documents"), support=30, most=4, top=2000, share=80, scale=2_000_000)


QUERIES["op11_collocations"] = op11_collocations

#: Plain form: every phrase of every piece counted.
_OP11_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) v(m) WHERE len(w) >= m)),
f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1),
k AS (SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS x, array_to_string(ws[k + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
s AS (SELECT k.lang, k.phrase, a, k, fl.f AS l, fr.f AS r, CAST(2000000::HUGEINT * a // (fl.f + fr.f) AS BIGINT) AS score FROM k JOIN f fl ON k.lang = fl.lang AND k.x = fl.phrase JOIN f fr ON k.lang = fr.lang AND k.y = fr.phrase),
b AS (SELECT DISTINCT ON (lang, phrase) * FROM s ORDER BY lang, phrase, score, k),
i AS (SELECT lang, array_to_string(ws[j:j + q - 1], ' ') AS phrase, max(a) AS longer FROM (SELECT *, unnest(range(1, m - q + 2)) AS j FROM (SELECT *, unnest(range(2, m)) AS q FROM c WHERE m > 2)) GROUP BY ALL),
z AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank FROM b LEFT JOIN i ON b.lang = i.lang AND b.phrase = i.phrase WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT z.lang, rank, z.phrase, a, l, r, n, score FROM z JOIN n ON z.lang = n.lang WHERE rank <= 2000
"""

ORACLES["op11_collocations"] = _OP11_SQL
