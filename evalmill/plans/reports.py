"""Registered queries of the composed reports, pipelines and suites, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit, curate, fuse, metrics, report, retrieve, split, suite
from . import benchmark
from .registry import ACT, BIN, PRED, RUNS, _split_sql, activities, long_predictions, predictions, query, rounded, runs, table

ROLES = benchmark.Columns()


def _hashed(seed: int) -> str:
    """The order of rows that ``Columns.identity`` gives."""
    return f"md5('{seed}|' || row_id || '|' || left_id || '|' || right_id), row_id, left_id, right_id"


@query(f"""WITH {ACT}, r AS (SELECT kind, rank() OVER (PARTITION BY kind ORDER BY value) + (count(*) OVER (PARTITION BY kind, value) - 1) / 2 AS a,
  rank() OVER (PARTITION BY kind ORDER BY year) + (count(*) OVER (PARTITION BY kind, year) - 1) / 2 AS b FROM act)
  SELECT kind, count(*) AS n, round(corr(a, b), 6) AS spearman FROM r GROUP BY 1""")
def rank_correlation(spark, sf_dir):
    return rounded(metrics.spearman(activities(spark, sf_dir), ["kind"], "value", "year"))


@query(f"""WITH {ACT}, d AS (SELECT DISTINCT priority, left_id::VARCHAR AS v FROM act)
  SELECT priority, count(*) AS n_values, sha1(count(*) || ':' || sum(('0x' || substr(md5(v), 1, 15))::BIGINT)) AS digest FROM d GROUP BY 1""")
def content_digest(spark, sf_dir):
    return report.content_digest(activities(spark, sf_dir), ["priority"], "left_id")


@query(r"SELECT p_partkey, 't' || replace(regexp_replace(printf('%.6f', p_retailprice), '\.?0+$', ''), '.', 'p') || 'nm' AS slug FROM part")
def threshold_slug(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.threshold_slug(F.col("p_retailprice")).alias("slug"))


COHORT = f"""{ACT}, m AS (SELECT context_id, min(year) AS fy, arg_min(kind, (year, kind)) AS fk, count(*) AS candidate_rows FROM act GROUP BY 1),
  st AS (SELECT context_id, candidate_rows, ((fy > 1993)::INT + (fy > 1995)::INT)::VARCHAR || '|' || fk AS stratum FROM m), n AS (SELECT stratum, count(*) AS n FROM st GROUP BY 1),
  s AS (SELECT *, n * 60.0::DOUBLE / sum(n) OVER () AS share FROM n), b AS (SELECT *, least(n, greatest(floor(share)::BIGINT, 1)) AS base FROM s),
  q AS (SELECT *, base + ((row_number() OVER (ORDER BY share - floor(share) DESC, stratum) <= greatest(60 - sum(base) OVER (), 0)) AND base < n)::INT AS quota FROM b),
  c AS (SELECT context_id, stratum FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('3|' || context_id), context_id) AS r FROM st) JOIN q USING (stratum) WHERE r <= quota),
  p AS (SELECT row_id, context_id, stratum, row_number() OVER (PARTITION BY context_id ORDER BY value, row_id) - 1 AS r, count(*) OVER (PARTITION BY context_id) AS n FROM act JOIN c USING (context_id)),
  w AS (SELECT DISTINCT context_id, CASE WHEN least(n, 6) = 1 THEN 0 ELSE round_even(i * (n - 1) / (least(n, 6) - 1)::DOUBLE, 0) END::BIGINT AS r
    FROM (SELECT DISTINCT context_id, n, unnest(range(least(n, 6))) AS i FROM p)),
  kept AS (SELECT row_id, context_id, stratum FROM p JOIN w USING (context_id, r))"""


def _cohort(spark, sf_dir):
    return curate.balanced_cohort(activities(spark, sf_dir), "context_id", "year", "kind", "value", "row_id", 60, 6, (1993, 1995), 3)


@query(f"WITH {COHORT} SELECT row_id, context_id, stratum FROM kept")
def balanced_cohort(spark, sf_dir):
    return benchmark.with_manifest(_cohort(spark, sf_dir), "context_id").select("row_id", "context_id", "stratum")


@query(f"""WITH {COHORT} SELECT st.context_id, stratum, candidate_rows, c.context_id IS NOT NULL AS selected, coalesce(k.n, 0) AS retained_rows
  FROM st LEFT JOIN (SELECT context_id FROM c) c USING (context_id) LEFT JOIN (SELECT context_id, count(*) AS n FROM kept GROUP BY 1) k USING (context_id)""")
def cohort_manifest(spark, sf_dir):
    return _cohort(spark, sf_dir)[1].select("context_id", "stratum", "candidate_rows", "selected", "retained_rows")


CONFLICT = f"""{PRED}, cr AS (SELECT *, abs(p_size - p_hash) AS conflict, round(0.7 * p_hash + 0.3 * p_size, 9) AS fused FROM pred WHERE y IS NOT NULL AND p_hash IS NOT NULL AND p_size IS NOT NULL),
  r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY conflict, doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM cr),
  b AS (SELECT *, CASE WHEN n = 1 THEN 1 ELSE greatest(1, ceil((r - 1) * least(4, n) / (n - 1)::DOUBLE)) END::INT AS conflict_bin FROM r),
  u AS (SELECT lang, conflict_bin, conflict, y, p_size AS cur, m.model, m.p FROM b, (VALUES ('p_size', p_size), ('p_hash', p_hash), ('fused', fused)) m(model, p)),
  per AS (SELECT lang, conflict_bin, model, count(*) AS n, avg(conflict) AS mean_conflict, median(conflict) AS median_conflict, avg((p - y) * (p - y)) AS brier,
    avg((cur - y) * (cur - y)) AS current_brier, avg(((p >= 0.5)::INT = y)::INT) AS accuracy FROM u GROUP BY ALL)"""


def _conflict(spark, sf_dir):
    rows = predictions(spark, sf_dir).withColumn("fused", F.round(0.7 * F.col("p_hash") + 0.3 * F.col("p_size"), 9))
    return audit.conflict_report(rows, ["lang"], "doc_id", "y", "p_size", "p_hash", ["fused"])


@query(f"""WITH {CONFLICT} SELECT lang, conflict_bin, model, n, round(mean_conflict, 12) AS mean_conflict, round(median_conflict, 12) AS median_conflict, round(brier, 12) AS brier,
  round(current_brier, 12) AS current_brier, round(current_brier - brier, 12) AS brier_gain, round(accuracy, 12) AS accuracy,
  CASE model WHEN 'p_size' THEN 'current' WHEN 'p_hash' THEN 'retrieved' ELSE 'fused' END AS family FROM per""")
def conflict_report(spark, sf_dir):
    return rounded(_conflict(spark, sf_dir)[0].select("lang", "conflict_bin", "model", "n", "mean_conflict", "median_conflict", "brier", "current_brier", "brier_gain", "accuracy", "family"), 12)


@query(f"""WITH {CONFLICT} SELECT conflict_bin, model, count(DISTINCT lang) AS runs, sum(n)::BIGINT AS total_n, count(g) AS n_brier_gain, round(avg(g), 12) AS mean_brier_gain,
  round(stddev_pop(g), 12) AS std_brier_gain, round(CASE WHEN count(g) > 1 THEN 1.96 * stddev_pop(g) / sqrt(count(g)) ELSE 0 END, 12) AS ci95_brier_gain
  FROM (SELECT *, current_brier - brier AS g FROM per) GROUP BY ALL""")
def conflict_summary(spark, sf_dir):
    return rounded(audit.pooled(_conflict(spark, sf_dir)[0], ["conflict_bin", "model"], "lang", ["brier_gain"]), 12)


@query(f"""WITH {CONFLICT} SELECT lang, doc_id, y, p_size AS current_p, p_hash AS retrieved_p, round(conflict, 6) AS conflict, conflict_bin FROM b""")
def conflict_samples(spark, sf_dir):
    return rounded(_conflict(spark, sf_dir)[1])


@query(f"""WITH {PRED}, g AS (SELECT * FROM long WHERE y IS NOT NULL AND p IS NOT NULL),
  t AS (SELECT lang, model, p, sum(y) AS pos, count(*) AS k FROM g GROUP BY ALL), c AS (SELECT *, sum(pos) OVER w AS tp, sum(k) OVER w AS up FROM t WINDOW w AS (PARTITION BY lang, model ORDER BY p DESC)),
  a AS (SELECT lang, model, sum(k)::BIGINT AS n, sum(pos) / sum(k) AS prevalence, CASE WHEN sum(pos) > 0 THEN sum(pos * tp / up) / sum(pos) END AS ap FROM c GROUP BY ALL),
  e AS (SELECT lang, model, sum(n * abs(mp - rate)) / sum(n) AS ece FROM (SELECT lang, model, {BIN} AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS rate FROM g GROUP BY ALL) GROUP BY ALL),
  r AS (SELECT lang, model, avg(wrong) AS risk FROM (SELECT lang, model, ((p >= 0.5)::INT <> y)::INT AS wrong, row_number() OVER (PARTITION BY lang, model ORDER BY greatest(p, 1 - p) DESC, doc_id) AS k,
    count(*) OVER (PARTITION BY lang, model) AS n FROM g) WHERE k <= greatest(1, floor(0.8::DOUBLE * n)) GROUP BY ALL)
  SELECT lang, model, n, round(ap, 6) AS ap, round(ap - prevalence, 6) AS ap_lift, round(ece, 6) AS ece, round(risk, 6) AS risk FROM a JOIN e USING (lang, model) JOIN r USING (lang, model)""")
def reliability_report(spark, sf_dir):
    return rounded(audit.reliability(long_predictions(spark, sf_dir), ["lang", "model"], "doc_id")[0].select("lang", "model", "n", "ap", "ap_lift", "ece", "risk"))


@query(f"""WITH {PRED}, g AS (SELECT doc_id, threshold, p_hash AS p, (p_size >= threshold)::INT AS y FROM pred, (VALUES (0.1::DOUBLE), (0.3), (0.6)) v(threshold)),
  t AS (SELECT threshold, p, sum(y) AS pos, count(*) AS k FROM g GROUP BY ALL), c AS (SELECT *, sum(pos) OVER w AS tp, sum(k) OVER w AS up FROM t WINDOW w AS (PARTITION BY threshold ORDER BY p DESC)),
  a AS (SELECT threshold, sum(k)::BIGINT AS n, sum(pos) / sum(k) AS prevalence, CASE WHEN sum(pos) > 0 THEN sum(pos * tp / up) / sum(pos) END AS ap,
    CASE WHEN sum(pos) > 0 AND sum(pos) < sum(k) THEN sum((k - pos) * (tp - pos / 2)) / (sum(pos) * (sum(k) - sum(pos))) END AS auroc FROM c GROUP BY ALL),
  e AS (SELECT threshold, sum(n * abs(mp - rate)) / sum(n) AS ece FROM (SELECT threshold, {BIN} AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS rate FROM g GROUP BY ALL) GROUP BY ALL),
  b AS (SELECT threshold, avg((p - y) * (p - y)) AS brier, avg(((p >= 0.5)::INT = y)::INT) AS accuracy FROM g GROUP BY ALL),
  r AS (SELECT threshold, avg(wrong) AS risk FROM (SELECT threshold, ((p >= 0.5)::INT <> y)::INT AS wrong, row_number() OVER (PARTITION BY threshold ORDER BY greatest(p, 1 - p) DESC, doc_id) AS k,
    count(*) OVER (PARTITION BY threshold) AS n FROM g) WHERE k <= greatest(1, floor(0.8::DOUBLE * n)) GROUP BY ALL)
  SELECT threshold, n, round(auroc, 6) AS auroc, round(ap, 6) AS ap, round(ece, 6) AS ece, round(risk, 6) AS risk, round(brier, 6) AS brier, round(accuracy, 6) AS accuracy, round(prevalence, 6) AS prevalence
  FROM a JOIN e USING (threshold) JOIN r USING (threshold) JOIN b USING (threshold)""")
def threshold_metrics(spark, sf_dir):
    found = metrics.threshold_metrics(predictions(spark, sf_dir), [], "doc_id", "p_size", "p_hash", [0.1, 0.3, 0.6])
    return rounded(found.select("threshold", "n", "auroc", "ap", "ece", "risk", "brier", "accuracy", "prevalence"))


@query(f"""WITH {ACT}, x AS (SELECT priority, year, kind, round(avg(value), 4) AS metric, count(*) AS tie, round(max(value), 4) AS top FROM act GROUP BY ALL),
  d AS (SELECT priority, year, max(metric) FILTER (kind = 'N') AS fixed_metric, max(tie) FILTER (kind = 'N') AS fixed_tie, arg_min(kind, (-metric, -tie, kind)) FILTER (kind IN ('A', 'R')) AS best_simple_model,
    arg_min(metric, (-metric, -tie, kind)) FILTER (kind IN ('A', 'R')) AS best_simple_metric, arg_min(kind, (-metric, -tie, kind)) AS best_model, arg_min(metric, (-metric, -tie, kind)) AS best_metric,
    arg_min(kind, (-top, -metric, kind)) AS val_best_model, arg_min(metric, (-top, -metric, kind)) AS val_best_metric FROM x GROUP BY ALL HAVING count(*) FILTER (kind = 'N') > 0)
  SELECT *, 'N' AS fixed_model, round(fixed_metric - best_simple_metric, 4) AS fixed_minus_best_simple, round(fixed_metric - best_metric, 4) AS fixed_minus_best FROM d""")
def failure_diagnostics(spark, sf_dir):
    rows = activities(spark, sf_dir).groupBy("priority", "year", "kind").agg(F.round(F.avg("value"), 4).alias("metric"), F.count("*").alias("tie"), F.round(F.max("value"), 4).alias("top"))
    return rounded(audit.failure_diagnostics(rows, ["priority", "year"], "kind", "N", ["A", "R"], None, "metric", "tie", "top"), 4)


REPEATED = f"{ACT}, rep AS (SELECT priority, kind, year, status, round(avg(value), 4) AS metric FROM act GROUP BY ALL)"


def _repeated(spark, sf_dir):
    return activities(spark, sf_dir).groupBy("priority", "kind", "year", "status").agg(F.round(F.avg("value"), 4).alias("metric"))


@query(f"""WITH {REPEATED}, l AS (SELECT priority, year, kind, arg_max(metric, status) AS m FROM rep GROUP BY ALL),
  s AS (SELECT priority, kind, count(*) AS n_metric, avg(m) AS mean, coalesce(stddev_samp(m), 0) AS std FROM l GROUP BY ALL), h AS (SELECT *, CASE WHEN n_metric > 1 THEN 1.96 * std / sqrt(n_metric) ELSE 0 END AS ci FROM s)
  SELECT priority, kind, n_metric, round(mean, 4) AS mean_metric, round(std, 4) AS std_metric, round(ci, 4) AS ci95_metric, round(mean - ci, 4) AS low_metric, round(mean + ci, 4) AS high_metric FROM h""")
def component_summary(spark, sf_dir):
    return rounded(audit.component_summary(_repeated(spark, sf_dir), "priority", "year", "kind", "status", ["metric"])[1], 4)


@query(f"""WITH {RUNS}, w AS (SELECT priority, year, max(metric) FILTER (kind = 'A') AS a, max(metric) FILTER (kind = 'N') AS n, max(metric) FILTER (kind = 'R') AS r FROM runs GROUP BY ALL)
  SELECT priority, year, 'mask' AS step, round(a - n, 4) AS delta FROM w UNION ALL SELECT priority, year, 'retrieval', round(r - a, 4) FROM w""")
def component_deltas(spark, sf_dir):
    return rounded(audit.component_deltas(runs(spark, sf_dir), ["priority", "year"], "kind", "metric", {"mask": ("A", "N"), "retrieval": ("R", "A")}), 4)


@query(f"""WITH {RUNS}, s AS (SELECT priority, year, arg_max(kind, (metric, kind)) = 'N' AS match, round(max(metric) - max(metric) FILTER (kind = 'N'), 12) AS gap FROM runs GROUP BY ALL)
  SELECT priority, count(*) AS runs, round(avg(match::INT), 6) AS match_rate, round(avg(gap), 6) AS mean_gap, round(max(gap), 6) AS max_gap FROM s GROUP BY 1""")
def instability_summary(spark, sf_dir):
    found = report.selection_instability(runs(spark, sf_dir).withColumn("chosen", F.lit("N")), ["priority", "year"], "kind", "metric", "chosen")
    return rounded(report.instability_summary(found, ["priority"]))


GRID = f"""{PRED}, x AS (SELECT lang, CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 8 THEN 'val' ELSE 'test' END AS part, p_hash AS p, threshold, (p_size >= threshold)::INT AS y
    FROM pred, (VALUES (0.02::DOUBLE), (0.1), (0.9)) v(threshold)),
  f AS (SELECT lang, threshold, string_agg(part, ',' ORDER BY part) AS one_class_in FROM (SELECT lang, threshold, part FROM x GROUP BY ALL HAVING count(DISTINCT y) < 2) GROUP BY ALL)"""


def _grid(spark, sf_dir):
    part = F.when(F.col("doc_id") % 10 < 7, "train").when(F.col("doc_id") % 10 < 8, "val").otherwise("test")
    return audit.threshold_grid(predictions(spark, sf_dir).drop("y").withColumn("part", part), ["lang"], "part", "doc_id", "p_size", "p_hash", [0.02, 0.1, 0.9])


@query(f"""WITH {GRID} SELECT lang, threshold, count(*) AS n, sum(y)::BIGINT AS n_pos, round(avg((p - y) * (p - y)), 6) AS brier, round(avg(y), 6) AS prevalence
  FROM x WHERE part = 'test' AND NOT EXISTS (SELECT 1 FROM f WHERE f.lang IS NOT DISTINCT FROM x.lang AND f.threshold = x.threshold) GROUP BY ALL""")
def threshold_grid(spark, sf_dir):
    return rounded(_grid(spark, sf_dir)[0].select("lang", "threshold", "n", "n_pos", "brier", "prevalence"))


@query(f"WITH {GRID} SELECT lang, threshold, one_class_in FROM f")
def threshold_failures(spark, sf_dir):
    return _grid(spark, sf_dir)[1]


@query(f"""WITH {RUNS}, r AS (SELECT kind, rank() OVER (PARTITION BY priority, year ORDER BY metric DESC) AS place, count(*) OVER (PARTITION BY priority, year, metric) AS ties FROM runs)
  SELECT kind, count(*) AS n_conditions, round(avg(place + (ties - 1) / 2), 6) AS mean_rank, count_if(place = 1) AS n_first FROM r GROUP BY 1""")
def ranks_across_conditions(spark, sf_dir):
    return rounded(audit.ranks_across(runs(spark, sf_dir), ["priority", "year"], "kind", "metric"))


@query(f"""WITH {ACT}, cov AS (SELECT event_type, sum(v)::DOUBLE AS fetched, max(v) AS announced FROM (SELECT event_type, round(value)::BIGINT AS v FROM events) GROUP BY 1),
  sp AS (SELECT context_id, list(DISTINCT split) AS s FROM {_split_sql('act', "md5('1|' || row_id), row_id")} GROUP BY 1),
  o AS (SELECT (count_if(list_contains(s, 'train') AND list_contains(s, 'val')) > 0)::INT + (count_if(list_contains(s, 'train') AND list_contains(s, 'test')) > 0)::INT AS v FROM sp WHERE context_id IS NOT NULL)
  SELECT (SELECT count(*) FROM cov) AS fetch_groups, (SELECT count_if(NOT coalesce(fetched >= announced, false)) FROM cov) AS incomplete_groups, (SELECT round(min(fetched / nullif(announced, 0)), 6) FROM cov) AS least_coverage,
    v::BIGINT AS violations, (SELECT count(DISTINCT (priority, kind, year)) FROM act) AS runs, (SELECT min(value) > 0 FROM act) AS all_predictions,
    CASE WHEN v > 0 OR (SELECT count_if(NOT coalesce(fetched >= announced, false)) FROM cov) > 0 THEN 'fail' ELSE 'pass' END AS status FROM o""")
def benchmark_verdict(spark, sf_dir):
    log = table(spark, sf_dir, "events").select("event_type", F.round("value").cast("long").alias("page_count"), F.round("value").cast("long").alias("total_count"), F.lit("").alias("error"))
    rows = activities(spark, sf_dir)
    found = split.overlap(split.split_random(rows.select("row_id", "context_id"), ["row_id"], seed=1), {"context": ["context_id"]}).withColumn("mode", F.lit("random"))
    registry = rows.groupBy("priority", "kind", "year").agg((F.min("value") > 0).alias("predictions_present"))
    return rounded(audit.verdict(curate.fetch_coverage(log, ["event_type"]), found, {"random": "context"}, registry))


EXTERNAL = f"""{REPEATED}, s AS (SELECT priority, status, kind, count(*) AS runs, string_agg(DISTINCT year::VARCHAR, ',' ORDER BY year::VARCHAR) AS seeds, count(metric) AS n_metric, round(avg(metric), 4) AS mean_metric,
  round(coalesce(stddev_pop(metric), 0), 4) AS std_metric, round(CASE WHEN count(metric) > 1 THEN 1.96 * coalesce(stddev_pop(metric), 0) / sqrt(count(metric)) ELSE 0 END, 4) AS ci95_metric FROM rep GROUP BY ALL)"""


def _external(spark, sf_dir):
    return audit.external_report(_repeated(spark, sf_dir), ["priority"], "status", ["kind"], "year", ["metric"], ["metric"])


@query(f"WITH {EXTERNAL} SELECT * FROM s")
def external_summary(spark, sf_dir):
    return rounded(_external(spark, sf_dir)[0], 4)


@query(f"WITH {EXTERNAL} SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY priority, status ORDER BY mean_metric DESC, kind) AS r FROM s) WHERE r = 1")
def external_best(spark, sf_dir):
    return rounded(_external(spark, sf_dir)[1], 4)


@query(f"""WITH {REPEATED} SELECT priority, kind, count(*) AS runs, string_agg(DISTINCT year::VARCHAR, ',' ORDER BY year::VARCHAR) AS seeds, string_agg(DISTINCT status, ',' ORDER BY status) AS parts FROM rep GROUP BY ALL""")
def external_coverage(spark, sf_dir):
    return _external(spark, sf_dir)[2]


@query(f"""WITH {ACT}, m AS (SELECT kind, round(avg(value), 4) AS metric, count(*) AS n FROM act GROUP BY 1) SELECT kind, metric, n, row_number() OVER (ORDER BY metric DESC, n DESC, kind) AS place FROM m""")
def model_leaderboard(spark, sf_dir):
    rows = activities(spark, sf_dir).groupBy("kind").agg(F.round(F.avg("value"), 4).alias("metric"), F.count("*").alias("n"))
    return audit.leaderboard(rows, ["metric", "n"], "kind")


@query(f"""WITH {RUNS} SELECT priority, kind, CASE kind WHEN 'A' THEN 'Accepted' ELSE 'None yet' END AS model_label, count(DISTINCT year) AS n_runs, round(avg(metric), 4) AS metric_mean, round(stddev_samp(metric), 4) AS metric_std
  FROM runs WHERE kind IN ('A', 'N') GROUP BY ALL""")
def main_table(spark, sf_dir):
    return rounded(audit.main_table(runs(spark, sf_dir), {"A": "Accepted", "N": "None yet"}, ["priority"], "kind", "year", ["metric"]), 4)


@query(f"""WITH {PRED}, x AS (SELECT lang, threshold, p_hash AS p, (p_size >= threshold)::INT AS y FROM pred, (VALUES (0.1::DOUBLE), (0.3)) v(threshold)),
  t AS (SELECT lang, threshold, p, sum(y) AS pos, count(*) - sum(y) AS neg FROM x GROUP BY ALL), c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM t WINDOW w AS (PARTITION BY lang, threshold ORDER BY p DESC))
  SELECT lang, 'p_hash' AS model, threshold, sum(pos + neg)::BIGINT AS n, sum(pos)::BIGINT AS n_pos, round(CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)) END, 6) AS auroc,
  round(CASE WHEN sum(pos) > 0 THEN sum(pos * tp / (tp + fp)) / sum(pos) END, 6) AS ap FROM c GROUP BY ALL""")
def post_processed(spark, sf_dir):
    """The threshold audit of the models that the main table shows."""
    wide = predictions(spark, sf_dir)
    long = wide.select("doc_id", "lang", F.col("p_size").alias("v"), "p_hash", F.lit(0.5).alias("hidden")).unpivot(["doc_id", "lang", "v"], ["p_hash", "hidden"], "model", "p")
    scores = metrics.ranking(wide.where("y is not null"), ["lang"], "y", "p_hash").withColumns({"model": F.lit("p_hash"), "seed": F.lit(1)})
    main, swept = benchmark.post_process(scores, long, {"p_hash": "by hash"}, ["lang"], "v", [0.1, 0.3])
    return rounded(swept.join(main.select("lang", "model"), ["lang", "model"], "left"))


@query(f"""WITH {ACT}, k AS (SELECT right_id FROM act GROUP BY 1 ORDER BY count(*) DESC, right_id LIMIT 5),
  l AS (SELECT row_id, left_id, right_id, (value <= 20000)::INT AS label FROM act WHERE right_id IN (FROM k) AND value > 0 AND (value <= 20000 OR value >= 40000)),
  d AS (SELECT * FROM l ORDER BY {_hashed(42)} LIMIT 400)
  SELECT row_id, label, coalesce(nullif(trim(s_name), ''), right_id::VARCHAR) AS text FROM d LEFT JOIN supplier ON s_suppkey = right_id AND s_acctbal > 0""")
def public_subset(spark, sf_dir):
    texts = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("right_id"), F.col("s_name").alias("text"))
    return benchmark.public_subset(activities(spark, sf_dir), texts, ROLES, 400, 5, 20000.0, 40000.0, 0.0).select("row_id", "label", "text")


@query(f"""WITH {ACT} SELECT row_id, CASE status WHEN 'F' THEN 'train' ELSE 'test' END AS split, (value <= 20000)::INT AS label, coalesce(nullif(trim(s_name), ''), right_id::VARCHAR) AS text
  FROM act LEFT JOIN supplier ON s_suppkey = right_id AND s_acctbal > 0 WHERE status IN ('F', 'O') AND (value <= 20000 OR value >= 40000)""")
def official_splits(spark, sf_dir):
    rows = activities(spark, sf_dir).withColumnRenamed("value", "Y")
    texts = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("right_id"), F.col("s_name").alias("text"))
    parts = {"train": rows.where("status = 'F'"), "test": rows.where("status = 'O'")}
    return benchmark.official_splits(parts, {"Y": "value"}, texts, ROLES, 20000.0, 40000.0).select("row_id", "split", "label", "text")


@query(f"""WITH {ACT}, d AS (SELECT row_id, right_id, value, c_mktsegment FROM act JOIN customer ON c_custkey = context_id WHERE value > 0 AND c_acctbal > 0 ORDER BY {_hashed(42)} LIMIT 300)
  SELECT row_id, (value <= 30000)::INT AS label, trim(c_mktsegment) || ' [SEP] ' || coalesce(nullif(trim(s_name), ''), '') AS text FROM d LEFT JOIN supplier ON s_suppkey = right_id AND s_acctbal > 0""")
def context_subset(spark, sf_dir):
    contexts = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("context_id"), F.col("c_mktsegment").alias("context_text"))
    texts = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("right_id"), F.col("s_name").alias("group_text"))
    return benchmark.context_subset(activities(spark, sf_dir), contexts, texts, ROLES, 300, 30000.0).select("row_id", "label", "text")


@query(f"""WITH {ACT}, o AS (SELECT left_id, right_id, context_id, median(value) AS value FROM act WHERE value > 0 GROUP BY ALL),
  q AS (SELECT context_id, count(*) AS n, quantile_cont(value, 0.3) AS lo, quantile_cont(value, 0.7) AS hi FROM o GROUP BY 1 HAVING n >= 20),
  l AS (SELECT left_id, right_id, context_id, value, CASE WHEN value >= hi THEN 1 WHEN value <= lo THEN 0 END AS label FROM o JOIN q USING (context_id) WHERE hi - lo > 1000)
  SELECT left_id, right_id, context_id, round(value, 6) AS value, label FROM l WHERE label IS NOT NULL AND context_id IN (SELECT context_id FROM l WHERE label IS NOT NULL GROUP BY 1 HAVING count(DISTINCT label) = 2)""")
def benchmark_build(spark, sf_dir):
    rows, _ = benchmark.build(activities(spark, sf_dir), ROLES, ["priority"], 0.3, 0.7, 20, 1000.0, None)
    return rounded(rows.select("left_id", "right_id", "context_id", "value", "label"))


SPLITS = f"""{ACT}, gr AS (SELECT DISTINCT right_id FROM act), gc AS (SELECT DISTINCT context_id FROM act), gy AS (SELECT DISTINCT year FROM act),
  dealt AS (SELECT 'random' AS mode, split, row_id, left_id, right_id, context_id, value, year FROM {_split_sql('act', _hashed(1))}
    UNION ALL SELECT 'right_cold', split, row_id, left_id, right_id, context_id, value, year FROM act JOIN {_split_sql('gr', "md5('1|' || right_id), right_id")} USING (right_id)
    UNION ALL SELECT 'context_cold', split, row_id, left_id, right_id, context_id, value, year FROM act JOIN {_split_sql('gc', "md5('1|' || context_id), context_id")} USING (context_id)
    UNION ALL SELECT 'temporal', split, row_id, left_id, right_id, context_id, value, year FROM act JOIN {_split_sql('gy', 'year')} USING (year))"""
KEPT = ("row_id", "left_id", "right_id", "context_id", "value", "year")


@query(f"""WITH {SPLITS} SELECT mode, split, count(*) AS n_rows, round(avg((value <= 30000)::INT), 6) AS label_rate, min(year) AS first_year, max(year) AS last_year, round(median(value), 6) AS median_value,
  round(avg(value), 4) AS mean_value, count(DISTINCT left_id) AS n_left_id, count(DISTINCT right_id) AS n_right_id, count(DISTINCT context_id) AS n_context_id FROM dealt GROUP BY ALL""")
def split_descriptives(spark, sf_dir):
    rows = activities(spark, sf_dir).select(*KEPT, (F.col("value") <= 30000).cast("int").alias("label"))
    t = benchmark.descriptives(rows, ROLES, 1)[0].drop("std_value")
    return rounded(t.withColumn("mean_value", F.round("mean_value", 4)))


@query(f"""WITH {SPLITS} SELECT row_id, split, round(9 - log10(value), 6) AS y FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY {_hashed(1)}) AS r FROM dealt WHERE mode = 'right_cold' AND value > 0)
  WHERE split = 'test' OR r <= 200""")
def consumer_splits(spark, sf_dir):
    rows = activities(spark, sf_dir).select(*KEPT, (F.col("value") <= 30000).cast("int").alias("label"))
    return rounded(benchmark.consumer_splits(rows, ROLES, "right_cold", {"train": 200, "val": 200}, 1).select("row_id", "split", "y"))


@query(f"""WITH {SPLITS}, x AS (SELECT mode, split, threshold, (value >= threshold)::INT AS y, round(year / 2000.0::DOUBLE - 0.5, 6) AS p FROM dealt, (VALUES (20000.0::DOUBLE), (50000.0)) v(threshold)),
  bad AS (SELECT mode, threshold FROM x GROUP BY mode, threshold, split HAVING count(DISTINCT y) < 2)
  SELECT mode, 1 AS seed, threshold, count(*) AS n, sum(y)::BIGINT AS n_pos, round(avg((p - y) * (p - y)), 6) AS brier FROM x WHERE split = 'test' AND (mode, threshold) NOT IN (SELECT (mode, threshold) FROM bad) GROUP BY ALL""")
def evaluation_grid(spark, sf_dir):
    rows = activities(spark, sf_dir).select(*KEPT, F.round(F.col("year") / 2000.0 - 0.5, 6).alias("p"))
    return rounded(benchmark.evaluation_grid(rows, ROLES, "p", [20000.0, 50000.0], [1])[0].select("mode", "seed", "threshold", "n", "n_pos", "brier"))


def _grid_sql(seeds: list[int]) -> str:
    """``dealt`` of every seed, as SPLITS has it for one."""
    modes = {"random": ("act", "md5('{s}|' || row_id || '|' || left_id || '|' || right_id), row_id, left_id, right_id", None), "right_cold": ("gr", "md5('{s}|' || right_id), right_id", "right_id"),
             "context_cold": ("gc", "md5('{s}|' || context_id), context_id", "context_id"), "temporal": ("gy", "year", "year")}
    parts = []
    for s in seeds:
        for mode, (source, order, key) in modes.items():
            dealt = _split_sql(source, order.format(s=s))
            parts.append(f"SELECT '{mode}' AS mode, {s} AS seed, split, row_id, value, year FROM {dealt if key is None else f'act JOIN {dealt} USING ({key})'}")
    return f"{ACT}, gr AS (SELECT DISTINCT right_id FROM act), gc AS (SELECT DISTINCT context_id FROM act), gy AS (SELECT DISTINCT year FROM act), dealt AS ({' UNION ALL '.join(parts)})"


@query(f"""WITH {_grid_sql([1, 2, 45])}, x AS (SELECT mode, seed, split, row_id, (value <= 30000)::INT AS y, round(year / 2000.0::DOUBLE - 0.5, 6) AS p FROM dealt),
  b AS (SELECT mode, seed, avg(y) AS prior FROM x WHERE split = 'train' GROUP BY ALL),
  t AS (SELECT mode, seed, missing, y, CASE WHEN ('0x' || substr(md5(seed || '|missing|' || row_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE < missing THEN prior ELSE p END AS p
    FROM x JOIN b USING (mode, seed), (VALUES (0.0::DOUBLE), (0.35)) m(missing) WHERE split = 'test'),
  c AS (SELECT mode, seed, missing, list_sum([(p >= e / 10.0::DOUBLE)::INT for e in range(1, 10)]) AS bin, count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM t GROUP BY ALL),
  e AS (SELECT mode, seed, missing, sum(n * gap) / sum(n) AS ece FROM c GROUP BY ALL),
  r AS (SELECT mode, seed, missing, y, p, rank() OVER (PARTITION BY mode, seed, missing ORDER BY p) + (count(*) OVER (PARTITION BY mode, seed, missing, p) - 1) / 2 AS k FROM t),
  a AS (SELECT mode, seed, missing, (sum(k) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) AS auroc FROM r GROUP BY ALL)
  SELECT mode, seed, missing, count(*) AS n, sum(y)::BIGINT AS n_pos, round(any_value(auroc), 6) AS auroc, round(any_value(ece), 6) AS ece, round(avg((p - y) * (p - y)), 6) AS brier, round(avg(((p >= 0.5)::INT = y)::INT), 6) AS accuracy
  FROM t JOIN e USING (mode, seed, missing) JOIN a USING (mode, seed, missing) GROUP BY ALL""")
def experiment_matrix(spark, sf_dir):
    rows = activities(spark, sf_dir).select(*KEPT, (F.col("value") <= 30000).cast("int").alias("y"), F.round(F.col("year") / 2000.0 - 0.5, 6).alias("p"))
    return rounded(benchmark.experiment_matrix(rows, ROLES, "y", "p", [1, 2, 45], [0.0, 0.35]).select("mode", "seed", "missing", "n", "n_pos", "auroc", "ece", "brier", "accuracy"))


@query(f"""WITH {PRED}, e AS (SELECT lang, 'error' AS kind, least(count(*), 3) AS n FROM long GROUP BY lang, model),
  w AS (SELECT lang, 'decision' AS kind, least(count(*), 3) AS n FROM long WHERE (p >= 0.5)::INT <> y GROUP BY lang, model),
  d AS (SELECT lang, 'disagreement' AS kind, least(count(*), 3) AS n FROM (SELECT lang, doc_id FROM long GROUP BY ALL HAVING count(DISTINCT p >= 0.5) > 1) GROUP BY lang)
  SELECT lang, kind, sum(n)::BIGINT AS n FROM (FROM e UNION ALL FROM w UNION ALL FROM d) GROUP BY ALL""")
def case_counts(spark, sf_dir):
    long = long_predictions(spark, sf_dir)
    scored = metrics.ranking(long, ["lang", "model"])
    return benchmark.case_bundle(long, scored, scored.select("lang", "model"), ["lang"], "doc_id", 3)["counts"]


def _suite_rows(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", "label", (F.col("label") < 5).cast("int").alias("y"), "embedding", F.slice("embedding", 1, 16).alias("head"), (F.col("vec_id") % 7 > 0).cast("int").alias("mask"))
    return split.split_random(v, ["vec_id"], seed=8)


VARIANTS = {
    "no_mask": suite.Features(("embedding",)), "mask": suite.Features(("embedding", "mask")), "head": suite.Features(("head",)),
    "retrieval": suite.Features(("embedding", "mask", "mean_label", "std_label", "mean_sim", "max_sim", "n_ones", "weighted_label")),
    "average": suite.Blend("mask", "retrieval", 0.5), "tuned": suite.Blend("head", "retrieval"), "selected": suite.Select(("mask", "retrieval", "tuned")),
}


@query()
def model_suite(spark, sf_dir):
    parts = _suite_rows(spark, sf_dir)
    near = retrieve.cosine_top_k(parts, parts.where("split = 'train'"), "vec_id", "embedding", 8)
    stats = retrieve.label_summary(parts, near, parts.select("vec_id", "y"), "vec_id", "y").withColumnRenamed("query_id", "vec_id")
    out = suite.run_suite(parts.join(stats, "vec_id"), "vec_id", "y", suite.short_suite(("average", "selected"), VARIANTS), folds=2)
    return rounded(metrics.evaluate(out, ["split", "model"], "vec_id").select("split", "model", "n", "auroc", "ap", "ece", "brier"), 4)


@query()
def composed_suite(spark, sf_dir):
    """A gate, views and set neighbours from the table of standard variants, on the test part and on it with blanked second views."""
    parts = _suite_rows(spark, sf_dir)
    rows = parts.withColumns({"tail": F.slice("embedding", 17, 16), "signs": F.transform(F.filter(F.transform("embedding", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda z: z["x"] > 0.1), lambda z: z["i"].cast("string"))})
    blank = rows.where("split = 'test'").withColumns({"split": F.lit("missing"), "mask": F.lit(0), "tail": F.array().cast("array<float>")})
    table = suite.standard_variants(suite.Roles("embedding", ("mask",), (("head", "head"), ("tail", "tail")), "signs", "head"))
    small = suite.short_suite(("gated_retrieval", "morgan_smiles_retrieval"), table)
    out = suite.run_suite(rows.unionByName(blank), "vec_id", "y", small, folds=2)
    return rounded(metrics.evaluate(out, ["split", "model"], "vec_id").select("split", "model", "n", "auroc", "ap", "ece", "brier"), 4)


@query()
def direct_regression(spark, sf_dir):
    parts = _suite_rows(spark, sf_dir)
    # What is predicted is every row outside train, from neighbours in all of train.
    near = retrieve.cosine_top_k(parts.where("split <> 'train'"), parts.where("split = 'train'"), "vec_id", "embedding", 8)
    means = fuse.neighbour_regression(near, parts, "vec_id", "label")
    out = suite.direct_regression(parts, "vec_id", "label", ("embedding",), means)
    return rounded(metrics.regression(out, ["split", "model"], "label", "p"), 4)
