"""The registered queries of this subpackage and, where SQL can say them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, fingerprint, langid, minhash, mixing, packing, pii, quality, runs, topk, toxicity, warc, whitening
from .common import remainder, table


def held_out(modulus: int, rest: int):
    return F.coalesce(remainder("doc_id", modulus) == rest, F.lit(False))


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, ~held_out(4, 2))
    return langid.predict(docs.withColumn("held_out", held_out(4, 2)), model, keep=("held_out",))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, ~held_out(5, 0))
    return toxicity.score(docs.withColumn("held_out", held_out(5, 0)), model, keep=("held_out",))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), minhash.NearDup(width=3, percent=85)).drop("group")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = quality.apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))[0]


def tokenizer() -> dict[str, str]:
    import public_tokenizers

    return {"path": public_tokenizers.path("byte_bpe_50k.json"), "pattern": public_tokenizers.PATTERN}


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), **tokenizer(), added_tokens=True)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("url")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = chat.read_back(chat.format_chats(rows))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def op11_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint.compared(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint.printed(F.col("sketch")).alias("fingerprint"),
        fingerprint.printed(F.col("edited_sketch")).alias("edited_fingerprint"),
        fingerprint.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        fingerprint.resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return whitening.whiten(vectors, whitening.fit(vectors))


def repeated_tail(text: Column, doc_id: Column) -> Column:
    """The text, its words from a place on periodic in one document of ten."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def tail(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, a + (i - a) % p))), " ")

    edited = fingerprint.bound(words, lambda w: F.when(F.size(w) > 0, tail(w)))
    return F.when(h % 10 == 0, edited).otherwise(text)


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", repeated_tail(F.col("text"), F.col("doc_id")).alias("text"))
    found = runs.find(docs).withColumn("longest", runs.longest(F.col("runs")))
    told = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"longest.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * F.col("longest.length") / F.col("longest.period")).alias("exponent_milli"),
        F.sha2(F.array_join(told, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_langid, op2_topk, op3_toxicity, op4_mixing, op5_minhash, op6_quality, op7_pii, op8_packing, op9_warc, op10_chat, op11_fingerprint, op12_whitening, op13_runs)
    return {f.__name__: f for f in found}


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])), 0)::BIGINT AS score
  FROM (SELECT * FROM v WHERE vec_id % 100 = 0) q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v))
SELECT * FROM (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
WHERE rank <= 10
"""

OP4_SQL = f"""
WITH d AS (
  SELECT doc_id, source, len({_WORDS})::BIGINT AS size FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY source NULLS FIRST, size) AS copy FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM n GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM s),
r AS (SELECT *, 3 * source_size / weight AS ratio FROM w),
l AS (
  SELECT *, ((SELECT sum(source_size) FROM s) - coalesce(sum(3 * source_size) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
f AS (SELECT min(level) AS level FROM (SELECT level FROM l WHERE ratio >= level ORDER BY ratio, source NULLS LAST LIMIT 1)),
t AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, weight * coalesce((SELECT level FROM f), 0.0)) AS target FROM l),
a AS (
  SELECT n.doc_id, n.size, t.source_size, t.target, floor(t.target)::BIGINT AS lim,
    coalesce(sum(n.size) OVER (PARTITION BY n.source ORDER BY md5(concat_ws(':', '7', n.doc_id::VARCHAR, n.copy::VARCHAR)), n.doc_id, n.copy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
  FROM n JOIN t ON n.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (CASE WHEN size = 0 THEN 0 ELSE (lim // source_size) * size + greatest(0, least(pos + size, lim % source_size) - pos) END)::BIGINT AS taken
FROM a
"""

OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
b AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
c(id, root) AS (SELECT DISTINCT a, a FROM b UNION SELECT b.b, c.root FROM c JOIN b ON b.a = c.id),
m AS (SELECT id, min(root) AS root FROM c GROUP BY id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.root, w.doc_id) AS component_id, coalesce(m.root, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.id = w.doc_id
"""

OP6_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w, row_number() OVER () AS k FROM documents),
g AS (SELECT k, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
t AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, a, b, c) AS n FROM g) WHERE n > 1),
r AS (SELECT k, count(DISTINCT i + j) AS n FROM t, (VALUES (0), (1), (2)) o(j) GROUP BY k),
l AS (SELECT k, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(w, lambda x: regexp_full_match(lower(x), '({"|".join(quality.STOP_WORDS)})([.,!?;:](.|\n)*)?'))) AS n_stop
  FROM d JOIN l USING (k) LEFT JOIN r USING (k)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, greatest(n_words, 1) AS n FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_symbols / n <= 0.3 AND word_chars / n >= 2.0 AND word_chars / n <= 15.0
    AND n_dup_lines / greatest(n_lines, 1) <= 0.6 AND n_stop / n >= 0.005 AND n_repeat_words / n <= 0.5 AS kept
FROM f
"""

OP9_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM f
"""


def _escaped(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for c in chat.Template().control:
        out = f"replace({out}, '{c}', '{c[0]}\\.{c[1:]}')"
    return out


OP10_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS told,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
    sum(length({_escaped("role")}) + length({_escaped("text")}) + 13)::BIGINT AS formatted_chars,
    list(role ORDER BY turn, role, text) AS roles
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars,
  regexp_full_match(array_to_string(roles, ','), '(system|system,user|system,user(,assistant,user)*(,assistant)?|user(,assistant,user)*(,assistant)?)') AS valid
FROM g
"""


OP11_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n_chars FROM documents),
o AS (SELECT *, coalesce(lead(text) OVER o, first_value(text) OVER o) AS next FROM d WINDOW o AS (ORDER BY doc_id DESC)),
e AS (SELECT *, left(text, n_chars - n_chars // 2) || left(next, n_chars // 2) AS edited FROM o),
a AS (SELECT doc_id, 0 AS k, text FROM e UNION ALL SELECT doc_id, 1, edited FROM e UNION ALL SELECT doc_id, 2, next FROM e),
w AS (SELECT doc_id, k, {_WORDS} AS w FROM a),
f AS (SELECT doc_id, k, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[]
  ELSE list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: left(md5(array_to_string(w[i:i + 4], ' ')), 16)) END))[1:128] AS f FROM w),
p AS (SELECT doc_id, max(f) FILTER (k = 0) AS a, max(f) FILTER (k = 1) AS b, max(f) FILTER (k = 2) AS c FROM f GROUP BY 1),
u AS (SELECT *, list_sort(list_distinct(a || b))[1:128] AS ab, list_sort(list_distinct(a || c))[1:128] AS ac FROM p)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, array_to_string(a, '') AS fingerprint, array_to_string(b, '') AS edited_fingerprint,
  CASE WHEN len(ab) = 0 THEN 1.0 ELSE len(list_intersect(list_intersect(ab, a), b)) / len(ab) END::DOUBLE AS near_edited,
  CASE WHEN len(ac) = 0 THEN 1.0 ELSE len(list_intersect(list_intersect(ac, a), c)) / len(ac) END::DOUBLE AS near_next
FROM e JOIN u USING (doc_id)
"""


OP13_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w,
    [4294967295] || flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])) AS steps FROM documents),
h AS (SELECT doc_id, w, len(w)::BIGINT AS n, xor(list_reduce(steps, lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) ELSE xor(s >> 1, 3988292384 * (s & 1)) END), 4294967295) AS h FROM d),
a AS (SELECT *, h // 10 AS g, CASE WHEN n > 0 THEN (h // 10) % n END AS a FROM h),
e AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
  THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END) ELSE w END AS w FROM a),
s AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 6], ' ') AS s FROM (SELECT doc_id, w, unnest(range(0, n - 5)) AS i FROM e)),
p AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM s x JOIN s y ON x.doc_id = y.doc_id AND x.s = y.s AND x.i < y.i),
c AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM p),
m AS (SELECT doc_id, q, min(i) AS start, count(*) + 5 AS m FROM c GROUP BY doc_id, q, island),
r AS (SELECT doc_id, start, m + q AS length, min(q) AS period FROM m WHERE m >= greatest(12 - q, q) GROUP BY ALL),
t AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS told,
    arg_max(struct_pack(start, length, period), (length, -start, -period)) AS top FROM r GROUP BY 1),
x AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
o AS (SELECT doc_id, string_agg(v, ' ' ORDER BY i) AS told FROM (SELECT doc_id, unnest(w) AS v, unnest(range(n)) AS i FROM e) u ANTI JOIN x USING (doc_id, i) GROUP BY 1)
SELECT e.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, top.start::BIGINT AS start, top.length::BIGINT AS length, top.period::BIGINT AS period,
  (1000 * top.length // top.period)::BIGINT AS exponent_milli, sha256(coalesce(t.told, '')) AS runs_sha256, sha256(coalesce(o.told, '')) AS collapsed_sha256
FROM e LEFT JOIN t USING (doc_id) LEFT JOIN o ON o.doc_id = e.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_topk": OP2_SQL, "op4_mixing": OP4_SQL, "op5_minhash": OP5_SQL, "op6_quality": OP6_SQL, "op9_warc": OP9_SQL, "op10_chat": OP10_SQL, "op11_fingerprint": OP11_SQL, "op13_runs": OP13_SQL}
