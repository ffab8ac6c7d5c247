"""Registered queries of the library's operators over the driver's tables, with their SQL.

Roles: order lines are measurements (part, supplier, customer, flag, year,
price); labelled documents are samples; two formulas of a document's id and
length are the models to compare. Doubles are rounded, as sums differ in their
last bits between engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import curate, fuse, metrics, project, report, retrieve, significance, split

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with the SQL of the same rows."""

    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return joined.select(F.col("l_partkey").alias("left_id"), F.col("l_suppkey").alias("right_id"), F.col("o_custkey").alias("context_id"), F.col("l_returnflag").alias("kind"), F.year("o_orderdate").alias("year"), F.col("l_extendedprice").alias("value"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("row_id"), F.col("o_orderpriority").alias("priority"), F.col("l_linestatus").alias("status"))


ACT = """act AS (SELECT l_partkey AS left_id, l_suppkey AS right_id, o_custkey AS context_id, l_returnflag AS kind, year(o_orderdate)::INT AS year,
  l_extendedprice AS value, l_orderkey * 100 + l_linenumber AS row_id, o_orderpriority AS priority, l_linestatus AS status
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, source, y, and two probabilities."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    a = F.round(F.pmod(F.col("doc_id") * 48271, F.lit(65537)) / 65537, 2)
    b = F.least(F.floor(F.col("n_chars") / 4) / 1000, F.lit(1.0))
    return docs.select("doc_id", "lang", "source", a.alias("p_hash"), b.alias("p_size")).join(labels.select("doc_id", F.col("quality").alias("y"), "toxic"), "doc_id")


def long_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = predictions(spark, sf_dir)
    return wide.unpivot(["doc_id", "lang", "y"], ["p_hash", "p_size"], "model", "p")


PRED = """pred AS (SELECT doc_id, lang, source, round(((doc_id * 48271) % 65537) / 65537.0::DOUBLE, 2) AS p_hash, least((n_chars // 4) / 1000.0::DOUBLE, 1.0::DOUBLE) AS p_size,
  quality AS y, toxic FROM documents JOIN labels USING (doc_id)),
long AS (SELECT doc_id, lang, y, 'p_hash' AS model, p_hash AS p FROM pred UNION ALL SELECT doc_id, lang, y, 'p_size', p_size FROM pred)"""


@query(f"""WITH {ACT} SELECT row_id, left_id, kind, value, CASE WHEN value <= 20000 THEN 1 ELSE 0 END AS label FROM act
  WHERE kind IN ('A', 'N') AND value > 0 AND (value <= 20000 OR value >= 40000)""")
def label_with_gap(spark, sf_dir):
    rows = curate.clean_measurements(activities(spark, sf_dir), "value", ["left_id", "right_id", "context_id"], ["A", "N"], "kind")
    return curate.label_with_gap(rows, "value", 20000.0, 40000.0).select("row_id", "left_id", "kind", "value", "label")


@query(f"""WITH {ACT}, p AS (SELECT *, round(9 - log10(value), 6) AS p_value FROM act WHERE value > 0)
  SELECT context_id, count(*) AS n_rows, round(avg(label), 6) AS label_rate, min(p_value) AS low, max(p_value) AS high FROM
  (SELECT *, CASE WHEN p_value >= 9 - log10(30000) THEN 1 ELSE 0 END AS label FROM p) GROUP BY context_id""")
def log_threshold_policy(spark, sf_dir):
    rows = activities(spark, sf_dir).withColumn("p_value", F.round(curate.nm_to_p(F.col("value")), 6))
    t = curate.log_threshold_label(rows, "p_value", 30000.0).groupBy("context_id").agg(F.count("*").alias("n_rows"), F.avg("label").alias("label_rate"), F.min("p_value").alias("low"), F.max("p_value").alias("high"))
    return rounded(t)


@query(f"""WITH {ACT} SELECT right_id, context_id, kind, round(median(value), 6) AS value, round_even(median(year), 0)::INT AS year, count(*) AS n_replicates,
  arg_min(priority, (year, row_id)) AS priority FROM act GROUP BY ALL""")
def collapse_replicates(spark, sf_dir):
    return rounded(curate.collapse_replicates(activities(spark, sf_dir), ["right_id", "context_id", "kind"], "value", "year", "row_id", ["priority"]))


@query(f"WITH {ACT} SELECT row_id, context_id FROM act WHERE context_id IN (SELECT context_id FROM act GROUP BY 1 HAVING count(*) >= 50)")
def with_support(spark, sf_dir):
    return curate.with_support(activities(spark, sf_dir).select("row_id", "context_id"), "context_id", 50)


@query(f"WITH {ACT} SELECT row_id, left_id FROM act WHERE left_id IN (SELECT left_id FROM act GROUP BY 1 ORDER BY count(*) DESC, left_id LIMIT 20)")
def top_groups(spark, sf_dir):
    return curate.top_groups(activities(spark, sf_dir).select("row_id", "left_id"), "left_id", 20)


@query(f"""WITH {ACT}, q AS (SELECT context_id, count(*) AS n, quantile_cont(value, 0.3) AS lo, quantile_cont(value, 0.7) AS hi FROM act GROUP BY 1 HAVING n >= 30),
  l AS (SELECT row_id, context_id, CASE WHEN value >= hi THEN 1 WHEN value <= lo THEN 0 END AS label FROM act JOIN q USING (context_id) WHERE hi - lo > 1000),
  c AS (SELECT *, row_number() OVER (PARTITION BY context_id, label ORDER BY md5('5|' || row_id), row_id) AS r FROM l WHERE label IS NOT NULL)
  SELECT row_id, context_id, label FROM c WHERE r <= 8 AND context_id IN (SELECT context_id FROM c GROUP BY 1 HAVING count(DISTINCT label) = 2)""")
def label_by_quantile(spark, sf_dir):
    rows = activities(spark, sf_dir).select("row_id", "context_id", "value")
    return curate.label_by_quantile(rows, "context_id", "value", ["row_id"], least_rows=30, least_gap=1000.0, cap=8, seed=5)[0].select("row_id", "context_id", "label")


@query(f"""WITH {ACT} SELECT kind, status, count(*) AS n_rows, round(avg((value <= 30000)::INT), 6) AS label_rate, min(year) AS first_year, max(year) AS last_year,
  round(median(value), 6) AS median_value, round(avg(value), 6) AS mean_value, round(stddev_samp(value), 4) AS std_value,
  count(DISTINCT left_id) AS n_left_id, count(DISTINCT context_id) AS n_context_id FROM act GROUP BY ALL""")
def profile(spark, sf_dir):
    t = curate.profile(activities(spark, sf_dir), ["kind", "status"], "value", (F.col("value") <= 30000).cast("int"), "year", ["left_id", "context_id"])
    return rounded(t.withColumn("std_value", F.round("std_value", 4)))


@query(f"""WITH {ACT} SELECT 'row' AS key, count(*) AS n_rows, count(DISTINCT row_id) AS n_distinct, count(*) - count(DISTINCT row_id) AS n_duplicates FROM act
  UNION ALL SELECT 'pair', count(*), count(DISTINCT (left_id, right_id)), count(*) - count(DISTINCT (left_id, right_id)) FROM act""")
def duplicate_counts(spark, sf_dir):
    return curate.duplicate_counts(activities(spark, sf_dir), {"row": ["row_id"], "pair": ["left_id", "right_id"]})


@query(f"WITH {ACT} SELECT year, (value <= 30000)::INT AS label, count(*) AS n FROM act GROUP BY ALL")
def label_by_year(spark, sf_dir):
    return activities(spark, sf_dir).groupBy("year", (F.col("value") <= 30000).cast("int").alias("label")).agg(F.count("*").alias("n"))


@query("""SELECT event_type, sum(value)::DOUBLE AS fetched, max(value) AS announced, count_if(user_id % 97 = 0) AS failed, round(sum(value) / nullif(max(value), 0), 4) AS ratio,
  count_if(user_id % 97 = 0) = 0 AND sum(value) >= max(value) AS complete FROM (SELECT event_type, round(value)::BIGINT AS value, user_id FROM events) GROUP BY 1""")
def fetch_coverage(spark, sf_dir):
    log = table(spark, sf_dir, "events").select("event_type", F.round("value").cast("long").alias("page_count"), F.round("value").cast("long").alias("total_count"), F.when(F.col("user_id") % 97 == 0, "late").alias("error"))
    t = curate.fetch_coverage(log, ["event_type"])
    return t.withColumn("fetched", F.col("fetched").cast("double")).withColumn("ratio", F.round("ratio", 4))


@query(f"""WITH {ACT} SELECT row_id, coalesce(nullif(trim(p_name), ''), 'unknown') AS p_name, coalesce(nullif(trim(s_name), ''), kind) AS s_name
  FROM act LEFT JOIN part ON p_partkey = left_id AND p_size > 10 LEFT JOIN supplier ON s_suppkey = right_id AND s_acctbal > 0""")
def look_up_with_override(spark, sf_dir):
    parts = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("left_id"), "p_name")
    suppliers = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("right_id"), "s_name")
    rows = curate.look_up(activities(spark, sf_dir), parts, "left_id", "p_name", default="unknown")
    return curate.look_up(rows, suppliers, "right_id", "s_name", own="kind").select("row_id", "p_name", "s_name")


@query(f"""WITH {ACT}, n AS (SELECT year, kind, count(*) AS n FROM act GROUP BY ALL), s AS (SELECT *, n * 300.0::DOUBLE / sum(n) OVER () AS share FROM n),
  b AS (SELECT *, least(n, greatest(floor(share)::BIGINT, 1)) AS base FROM s),
  q AS (SELECT *, base + ((row_number() OVER (ORDER BY share - floor(share) DESC, year, kind) <= greatest(300 - sum(base) OVER (), 0)) AND base < n)::INT AS quota FROM b),
  r AS (SELECT row_id, year, kind, row_number() OVER (PARTITION BY year, kind ORDER BY md5('3|' || row_id), row_id) AS r FROM act)
  SELECT row_id, year, kind FROM r JOIN q USING (year, kind) WHERE r <= quota""")
def sample_by_quota(spark, sf_dir):
    rows = activities(spark, sf_dir).select("row_id", "year", "kind")
    return curate.sample_by_quota(rows, ["year", "kind"], 300, ["row_id"], seed=3).select("row_id", "year", "kind")


@query(f"""WITH {ACT}, p AS (SELECT row_id, context_id, row_number() OVER (PARTITION BY context_id ORDER BY value, row_id) - 1 AS r, count(*) OVER (PARTITION BY context_id) AS n FROM act),
  w AS (SELECT DISTINCT context_id, CASE WHEN least(n, 5) = 1 THEN 0 ELSE round_even(i * (n - 1) / (least(n, 5) - 1)::DOUBLE, 0) END::BIGINT AS r
    FROM (SELECT context_id, n, unnest(range(least(n, 5))) AS i FROM (SELECT DISTINCT context_id, n FROM p)))
  SELECT row_id, context_id FROM p JOIN w USING (context_id, r)""")
def evenly_spaced(spark, sf_dir):
    rows = activities(spark, sf_dir).select("row_id", "context_id", "value")
    return curate.evenly_spaced(rows, "context_id", "value", ["row_id"], 5).select("row_id", "context_id")


@query(f"WITH {ACT} SELECT row_id FROM act ORDER BY md5('9|' || row_id), row_id LIMIT 500")
def sample_rows(spark, sf_dir):
    return curate.sample_rows(activities(spark, sf_dir).select("row_id"), 500, ["row_id"], seed=9)


def _split_sql(source: str, order: str) -> str:
    return f"""(SELECT *, CASE WHEN r <= a THEN 'train' WHEN r <= a + b THEN 'val' ELSE 'test' END AS split FROM (
      SELECT *, CASE WHEN n >= 3 THEN least(b0, n - a - 1) ELSE b0 END AS b FROM (
      SELECT *, CASE WHEN n >= 3 THEN least(a0, n - 2) ELSE a0 END AS a FROM (
      SELECT *, greatest(1, floor(n * 0.7::DOUBLE)) AS a0, greatest(1, floor(n * 0.15::DOUBLE)) AS b0 FROM (
      SELECT *, row_number() OVER (ORDER BY {order}) AS r, count(*) OVER () AS n FROM {source})))))"""


@query(f"WITH {ACT} SELECT row_id, split FROM {_split_sql('act', "md5('1|' || row_id), row_id")}")
def split_random(spark, sf_dir):
    return split.split_random(activities(spark, sf_dir).select("row_id"), ["row_id"], seed=1)


@query(f"WITH {ACT}, g AS (SELECT DISTINCT context_id FROM act) SELECT row_id, split FROM act JOIN {_split_sql('g', "md5('2|' || context_id), context_id")} USING (context_id)")
def split_group_cold(spark, sf_dir):
    return split.split_by_group(activities(spark, sf_dir).select("row_id", "context_id"), "context_id", seed=2).select("row_id", "split")


@query(f"""WITH {ACT}, g AS (SELECT DISTINCT left_id FROM act), h AS (SELECT DISTINCT right_id FROM act)
  SELECT 'random' AS name, row_id, split FROM {_split_sql('act', "md5('6|' || row_id), row_id")} UNION ALL
  SELECT 'cold_target', row_id, split FROM act JOIN {_split_sql('h', "md5('6|' || right_id), right_id")} USING (right_id) UNION ALL
  SELECT 'cold_drug_target', row_id, x.split FROM act JOIN {_split_sql('g', "md5('6|' || left_id), left_id")} x USING (left_id) JOIN {_split_sql('h', "md5('7|' || right_id), right_id")} y USING (right_id) WHERE x.split = y.split""")
def official_split_names(spark, sf_dir):
    rows = activities(spark, sf_dir).select("row_id", "left_id", "right_id")
    random, one, both = (split.split_official(rows, n, "left_id", "right_id", ["row_id"], seed=6).select(F.lit(n.strip().lower()).alias("name"), "row_id", "split") for n in ("random", " Cold_Target", "cold_drug_target"))
    return random.unionByName(one).unionByName(both)


@query(f"""WITH {ACT} SELECT row_id, value FROM act WHERE value > 0 AND kind IN ('A', 'N') AND status = 'F' AND year % 3 <> 0 AND trim(CASE WHEN row_id % 5 = 0 THEN 'doubtful' ELSE '  ' END) = '' AND trim(priority) <> ''""")
def trusted_measurements(spark, sf_dir):
    rows = activities(spark, sf_dir).withColumn("repeated", F.col("year") % 3 == 0).withColumn("comment", F.when(F.col("row_id") % 5 == 0, "doubtful").otherwise("  "))
    return curate.keep_trusted(rows, "value", {"kind": ["A", "N"], "status": ["F"]}, ["repeated"], ["comment"], ["priority"]).select("row_id", "value")


@query(f"""WITH {ACT}, g AS (SELECT DISTINCT left_id FROM act), h AS (SELECT DISTINCT right_id FROM act)
  SELECT row_id, x.split FROM act JOIN {_split_sql('g', "md5('4|' || left_id), left_id")} x USING (left_id) JOIN {_split_sql('h', "md5('5|' || right_id), right_id")} y USING (right_id) WHERE x.split = y.split""")
def split_pair_cold(spark, sf_dir):
    return split.split_by_pair(activities(spark, sf_dir).select("row_id", "left_id", "right_id"), "left_id", "right_id", seed=4).select("row_id", "split")


@query(f"WITH {ACT}, g AS (SELECT DISTINCT year FROM act) SELECT row_id, split FROM act JOIN {_split_sql('g', 'year')} USING (year)")
def split_temporal(spark, sf_dir):
    return split.split_by_time(activities(spark, sf_dir).select("row_id", "year"), "year").select("row_id", "split")


def _overlap_sql(entity: str, key: str) -> str:
    return f"""SELECT '{entity}' AS entity, a AS first, b AS second, count_if(list_contains(s, a)) AS n_first, count_if(list_contains(s, b)) AS n_second,
      count_if(list_contains(s, a) AND list_contains(s, b)) AS n_common FROM (SELECT {key} AS k, list(DISTINCT split) AS s FROM sp GROUP BY 1), (VALUES ('train', 'val'), ('train', 'test'), ('val', 'test')) v(a, b) GROUP BY ALL"""


@query(f"""WITH {ACT}, g AS (SELECT DISTINCT context_id FROM act), sp AS (SELECT act.*, split FROM act JOIN {_split_sql('g', "md5('2|' || context_id), context_id")} USING (context_id)),
  o AS ({_overlap_sql('context', 'context_id')} UNION ALL {_overlap_sql('left', 'left_id')} UNION ALL {_overlap_sql('pair', '(left_id, right_id)')})
  SELECT *, round(CASE WHEN n_first + n_second > n_common THEN n_common / (n_first + n_second - n_common) ELSE 0 END, 6) AS jaccard FROM o""")
def split_overlap(spark, sf_dir):
    rows = split.split_by_group(activities(spark, sf_dir).select("context_id", "left_id", "right_id"), "context_id", seed=2)
    return rounded(split.overlap(rows, {"context": ["context_id"], "left": ["left_id"], "pair": ["left_id", "right_id"]}))


RANKING = """t AS (SELECT lang, model, p, sum(y) AS pos, count(*) - sum(y) AS neg FROM long WHERE y IS NOT NULL AND p IS NOT NULL GROUP BY ALL),
  c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM t WINDOW w AS (PARTITION BY lang, model ORDER BY p DESC))"""


@query(f"""WITH {PRED}, {RANKING} SELECT lang, model, sum(pos + neg)::BIGINT AS n, sum(pos)::BIGINT AS n_pos,
  round(CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)) END, 6) AS auroc,
  round(CASE WHEN sum(pos) > 0 THEN sum(pos * tp / (tp + fp)) / sum(pos) END, 6) AS ap FROM c GROUP BY ALL""")
def auroc_ap(spark, sf_dir):
    return rounded(metrics.ranking(long_predictions(spark, sf_dir), ["lang", "model"]))


BIN = "(" + " + ".join(f"(p >= {e!r}::DOUBLE)::INT" for e in metrics.EDGES) + ")"
CAL = f"""cal AS (SELECT lang, model, {BIN} AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS rate FROM long WHERE y IS NOT NULL AND p IS NOT NULL GROUP BY ALL)"""


@query(f"WITH {PRED}, {CAL} SELECT lang, model, bin, n, round(mean_p, 6) AS mean_p, round(rate, 6) AS rate, round(abs(mean_p - rate), 6) AS gap FROM cal")
def calibration_table(spark, sf_dir):
    return rounded(metrics.calibration(long_predictions(spark, sf_dir), ["lang", "model"]))


@query(f"WITH {PRED}, {CAL} SELECT lang, model, round(sum(n * abs(mean_p - rate)) / sum(n), 6) AS ece FROM cal GROUP BY ALL")
def expected_calibration_error(spark, sf_dir):
    return rounded(metrics.ece(long_predictions(spark, sf_dir), ["lang", "model"]))


CONF = """r AS (SELECT *, ((p >= 0.5)::INT <> y)::INT AS wrong, row_number() OVER (PARTITION BY lang, model ORDER BY greatest(p, 1 - p) DESC, doc_id) AS rank,
  count(*) OVER (PARTITION BY lang, model) AS n FROM long WHERE y IS NOT NULL AND p IS NOT NULL)"""


@query(f"WITH {PRED}, {CONF} SELECT lang, model, round(avg(wrong), 6) AS risk FROM r WHERE rank <= greatest(1, floor(0.8::DOUBLE * n)) GROUP BY ALL")
def risk_at_80(spark, sf_dir):
    return rounded(metrics.risk_at(long_predictions(spark, sf_dir), ["lang", "model"], "doc_id"))


@query(f"WITH {PRED}, {CONF} SELECT lang, model, doc_id, rank, round(rank / n, 6) AS coverage, round(sum(wrong) OVER (PARTITION BY lang, model ORDER BY rank) / rank, 6) AS risk FROM r")
def risk_coverage_curve(spark, sf_dir):
    return rounded(metrics.risk_coverage(long_predictions(spark, sf_dir), ["lang", "model"], "doc_id"))


@query(f"""WITH {PRED}, c AS (SELECT lang, model, avg((p - y) * (p - y)) AS brier, avg(y) AS prevalence, count_if(p >= 0.5 AND y = 1)::DOUBLE AS tp, count_if(p >= 0.5 AND y = 0)::DOUBLE AS fp,
  count_if(p < 0.5 AND y = 1)::DOUBLE AS fn, count_if(p < 0.5 AND y = 0)::DOUBLE AS tn FROM long WHERE y IS NOT NULL AND p IS NOT NULL GROUP BY ALL)
  SELECT lang, model, round(brier, 6) AS brier, round(prevalence, 6) AS prevalence, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy,
  round(CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN (tp / (tp + fn) + tn / (tn + fp)) / 2 END, 6) AS balanced_accuracy,
  round(CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0 END, 6) AS mcc FROM c""")
def classification_metrics(spark, sf_dir):
    return rounded(metrics.classification(long_predictions(spark, sf_dir), ["lang", "model"]))


@query(f"""WITH {ACT}, r AS (SELECT kind, value AS y, year * 20.0 AS p FROM act) SELECT kind, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, round(avg(abs(y - p)), 4) AS mae, round(corr(y, p), 6) AS pearson FROM r GROUP BY 1""")
def regression_metrics(spark, sf_dir):
    t = metrics.regression(activities(spark, sf_dir).select("kind", F.col("value").alias("y"), (F.col("year") * 20.0).alias("p")), ["kind"], "y", "p")
    return rounded(t.withColumns({"rmse": F.round("rmse", 4), "mae": F.round("mae", 4)}))


@query(f"""WITH {PRED}, x AS (SELECT p_hash, p_size, threshold, (p_size >= threshold)::INT AS y FROM pred, (VALUES (0.1::DOUBLE), (0.3), (0.6)) v(threshold)),
  t AS (SELECT threshold, p_hash, sum(y) AS pos, count(*) - sum(y) AS neg FROM x GROUP BY ALL), c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM t WINDOW w AS (PARTITION BY threshold ORDER BY p_hash DESC))
  SELECT threshold, sum(pos + neg)::BIGINT AS n, sum(pos)::BIGINT AS n_pos, round(CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)) END, 6) AS auroc,
  round(CASE WHEN sum(pos) > 0 THEN sum(pos * tp / (tp + fp)) / sum(pos) END, 6) AS ap FROM c GROUP BY 1""")
def threshold_sweep(spark, sf_dir):
    return rounded(metrics.threshold_sweep(predictions(spark, sf_dir), [], "p_size", "p_hash", [0.1, 0.3, 0.6]))


@query()
def bootstrap_difference(spark, sf_dir):
    return rounded(metrics.bootstrap_difference(predictions(spark, sf_dir), ["lang"], "doc_id", "y", "p_size", "p_hash", replicates=1000))


RUNS = f"""{ACT}, runs AS (SELECT priority, kind, year, round(avg(value), 4) AS metric FROM act GROUP BY ALL)"""


def runs(spark, sf_dir):
    return activities(spark, sf_dir).groupBy("priority", "kind", "year").agg(F.round(F.avg("value"), 4).alias("metric"))


@query(f"""WITH {RUNS} SELECT priority, kind, count(metric) AS n_metric, round(avg(metric), 4) AS mean_metric, round(coalesce(stddev_pop(metric), 0), 4) AS std_metric,
  round(CASE WHEN count(metric) > 1 THEN 1.96 * coalesce(stddev_pop(metric), 0) / sqrt(count(metric)) ELSE 0 END, 4) AS ci95_metric FROM runs GROUP BY ALL""")
def run_summary(spark, sf_dir):
    return rounded(report.summary(runs(spark, sf_dir), ["priority", "kind"], ["metric"]), 4)


@query(f"WITH {RUNS}, m AS (SELECT priority, kind, avg(metric) AS m FROM runs GROUP BY ALL) SELECT priority, count(*) AS n_groups, round(avg(m), 4) AS mean, round(stddev_samp(m), 4) AS std FROM m GROUP BY 1")
def macro_average(spark, sf_dir):
    return rounded(report.macro_average(runs(spark, sf_dir), ["priority"], ["kind"], "metric"), 4)


@query(f"""WITH {ACT}, c AS (SELECT priority, year, count(*) AS n FROM act GROUP BY ALL)
  SELECT priority, arg_min(year, (-n, year)) AS year, max(n) AS n, (SELECT string_agg(DISTINCT kind, ',' ORDER BY kind) FROM act a WHERE a.priority = c.priority) AS kinds FROM c GROUP BY 1""")
def mode_and_list(spark, sf_dir):
    rows = activities(spark, sf_dir)
    return report.mode_of(rows, ["priority"], "year").join(rows.groupBy("priority").agg(report.distinct_list("kind").alias("kinds")), "priority")


@query(f"WITH {RUNS} SELECT priority, kind, year, metric, rank() OVER (PARTITION BY kind, year ORDER BY metric DESC) + (count(*) OVER (PARTITION BY kind, year, metric) - 1) / 2 AS rank FROM runs")
def average_rank(spark, sf_dir):
    return report.average_rank(runs(spark, sf_dir), ["kind", "year"], "metric")


@query(f"""WITH {PRED}, r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY abs(p_hash - p_size), doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM pred)
  SELECT doc_id, lang, CASE WHEN n = 1 THEN 1 ELSE greatest(1, ceil((r - 1) * least(4, n) / (n - 1)::DOUBLE)) END::INT AS bin FROM r""")
def conflict_bins(spark, sf_dir):
    rows = predictions(spark, sf_dir).withColumn("c", F.abs(F.col("p_hash") - F.col("p_size")))
    return report.equal_bins(rows, ["lang"], "c", ["doc_id"], 4).select("doc_id", "lang", "bin")


@query(f"""WITH {PRED}, e AS (SELECT lang, list_distinct([quantile_cont(p_size, 0.25), quantile_cont(p_size, 0.5), quantile_cont(p_size, 0.75)]) AS e FROM pred GROUP BY 1)
  SELECT doc_id, lang, 1 + len(list_filter(e, lambda x: p_size > x)) AS quartile FROM pred JOIN e USING (lang)""")
def value_quartiles(spark, sf_dir):
    return report.quartiles(predictions(spark, sf_dir).select("doc_id", "lang", "p_size"), ["lang"], "p_size").select("doc_id", "lang", "quartile")


@query(f"WITH {RUNS} SELECT priority, kind, year, metric FROM (SELECT *, row_number() OVER (PARTITION BY priority ORDER BY metric DESC, kind, year) AS r FROM runs) WHERE r <= 3")
def best_runs(spark, sf_dir):
    return report.top_per(runs(spark, sf_dir), ["priority"], 3, F.desc("metric"), F.asc("kind"), F.asc("year"))


@query(f"""WITH {RUNS} SELECT a.priority, a.year, a.metric AS metric_a, b.metric AS metric_b, round(a.metric - b.metric, 4) AS metric_delta
  FROM runs a JOIN runs b ON a.priority = b.priority AND a.year = b.year WHERE a.kind = 'A' AND b.kind = 'N'""")
def paired_comparison(spark, sf_dir):
    return rounded(report.compare(runs(spark, sf_dir), "kind", "A", "N", ["priority", "year"], ["metric"]), 4)


@query(f"""WITH {RUNS} SELECT p.priority, k.kind, y.year FROM (SELECT DISTINCT priority FROM act) p, (SELECT DISTINCT kind FROM act) k, (SELECT DISTINCT year FROM act) y
  WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.priority = p.priority AND r.kind = k.kind AND r.year = y.year)""")
def grid_gaps(spark, sf_dir):
    rows = activities(spark, sf_dir)
    grid = rows.select("priority").distinct().crossJoin(rows.select("kind").distinct()).crossJoin(rows.select("year").distinct())
    return report.gaps(runs(spark, sf_dir), grid, ["priority", "kind", "year"])


@query(f"""WITH {RUNS} SELECT priority, year, arg_max(kind, (metric, kind)) AS best, 'N' AS chosen, arg_max(kind, (metric, kind)) = 'N' AS match,
  round(max(metric) - max(metric) FILTER (kind = 'N'), 6) AS gap FROM runs GROUP BY ALL""")
def selection_instability(spark, sf_dir):
    t = report.selection_instability(runs(spark, sf_dir).withColumn("chosen", F.lit("N")), ["priority", "year"], "kind", "metric", "chosen")
    return rounded(t)


COS = """v AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings WHERE embedding IS NOT NULL),
  n AS (SELECT q.vec_id AS query_id, r.vec_id AS ref_id, list_cosine_similarity(q.v, r.v) AS sim FROM v q JOIN v r ON q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0),
  k AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, ref_id) AS rank, ref_id, sim FROM n)"""

#: The same with every row as a query.
COS_ALL = COS.replace(" WHERE q.vec_id % 20 = 0", "")


def _near(spark, sf_dir, k):
    v = table(spark, sf_dir, "embeddings")
    return v, retrieve.cosine_top_k(v, v, "vec_id", "embedding", k)


@query(f"WITH {COS_ALL} SELECT query_id, rank::INT AS rank, ref_id, round(sim, 6) AS sim FROM k WHERE rank <= 8")
def cosine_neighbours(spark, sf_dir):
    return rounded(_near(spark, sf_dir, 8)[1])


@query(f"""WITH {COS_ALL}, y AS (SELECT query_id, sim, (label < 5)::INT::DOUBLE AS y, least(1, greatest(0, sim)) + 1e-6 AS w FROM k JOIN v ON v.vec_id = ref_id WHERE rank <= 8)
  SELECT query_id, round(avg(y), 6) AS mean_label, round(stddev_pop(y), 6) AS std_label, round(avg(sim), 6) AS mean_sim, round(max(sim), 6) AS max_sim, sum(y) AS n_ones, round(sum(y * w) / sum(w), 6) AS weighted_label FROM y GROUP BY 1""")
def neighbour_labels(spark, sf_dir):
    v, near = _near(spark, sf_dir, 8)
    labels = v.select("vec_id", (F.col("label") < 5).cast("int").alias("y"))
    return rounded(retrieve.label_summary(v.where("embedding is not null"), near, labels, "vec_id", "y"))


def _shortcut_scores(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn("y", (F.col("label") < 5).cast("int"))
    return retrieve.shortcut_scores(rows, rows, "vec_id", "embedding", "y", {"label": "label"}, 5, 0.5)


@query(f"""WITH {COS_ALL}, b AS (SELECT query_id, ref_id, sim, (q.label < 5)::INT AS yq, (r.label < 5)::INT AS yr, q.label = r.label AS s, sim >= 0.5 AS h FROM n JOIN v q ON q.vec_id = query_id JOIN v r ON r.vec_id = ref_id),
  c AS (SELECT 'original' AS condition, * FROM b UNION ALL SELECT 'no_same_label', * FROM b WHERE NOT s UNION ALL SELECT 'no_high_similarity', * FROM b WHERE NOT h UNION ALL SELECT 'no_shortcut', * FROM b WHERE NOT s AND NOT h),
  t AS (SELECT *, row_number() OVER (PARTITION BY condition, query_id ORDER BY sim DESC, ref_id) AS r FROM c),
  p AS (SELECT condition, query_id, count(*) AS n, avg(yr) AS m, avg((yr = yq)::INT) AS a FROM t WHERE r <= 5 GROUP BY ALL)
  SELECT condition, count(*) AS n_queries, round(avg(n), 6) AS mean_neighbours, round(avg(m), 6) AS mean_label, round(avg(a), 6) AS agreement FROM p GROUP BY 1""")
def shortcut_audit(spark, sf_dir):
    t = retrieve.shortcut_audit(_shortcut_scores(spark, sf_dir)).where("condition <> 'label_free'")
    return rounded(t.drop("mean_sim"))


@query(f"""WITH {COS}, b AS (SELECT query_id, ref_id, sim, (q.label < 5)::INT::DOUBLE AS y, (r.label < 5)::INT::DOUBLE AS yr, q.label = r.label AS l, query_id % 7 = ref_id % 7 AS g, sim >= 0.3 AS h
    FROM n JOIN v q ON q.vec_id = query_id JOIN v r ON r.vec_id = ref_id),
  c AS (SELECT unnest(list_filter(['original', CASE WHEN NOT l THEN 'no_same_label' END, CASE WHEN NOT g THEN 'no_same_group' END, CASE WHEN NOT (l AND g) THEN 'no_same_pair' END, CASE WHEN NOT h THEN 'no_high_similarity' END, CASE WHEN NOT (l OR g OR h) THEN 'no_shortcut' END], lambda x: x IS NOT NULL)) AS condition, * FROM b),
  t AS (SELECT *, row_number() OVER (PARTITION BY condition, query_id ORDER BY sim DESC, ref_id) AS rank FROM c),
  p AS (SELECT condition, query_id, y, count(*) AS n, avg(yr) AS score, avg((yr = y)::INT) AS agreement, avg(sim) AS mean_sim FROM t WHERE rank <= 5 GROUP BY ALL)
  SELECT condition, query_id, y, n, round(score, 6) AS score, round(agreement, 6) AS agreement, round(mean_sim, 6) AS mean_sim FROM p
  UNION ALL SELECT 'label_free', query_id, y, n, round(mean_sim, 6), round(agreement, 6), round(mean_sim, 6) FROM p WHERE condition = 'original'""")
def shortcut_scores_by_attribute(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn("y", (F.col("label") < 5).cast("int")).withColumn("group", F.col("vec_id") % 7)
    return rounded(retrieve.shortcut_scores(rows.where("vec_id % 20 = 0"), rows, "vec_id", "embedding", "y", {"label": "label", "group": "group", "pair": ("label", "group")}, 5, 0.3))


@query()
def shortcut_metrics(spark, sf_dir):
    return rounded(retrieve.shortcut_metrics(_shortcut_scores(spark, sf_dir)))


def _set_sql(table: str, key: str, value: str, where: str, k: int) -> str:
    return f"""WITH i AS (SELECT {key} AS id, {value} AS s FROM {table}),
  s AS (SELECT id, unnest(s) AS g FROM i), b AS (SELECT x.id AS query_id, y.id AS ref_id, count(*) AS b FROM s x JOIN s y ON x.g = y.g AND x.id <> y.id GROUP BY ALL),
  k AS (SELECT x.id AS query_id, y.id AS ref_id, coalesce(b.b / (len(x.s) + len(y.s) - b.b), 0.0) AS sim FROM i x JOIN i y ON x.id <> y.id LEFT JOIN b ON b.query_id = x.id AND b.ref_id = y.id WHERE {where})
  SELECT query_id, rank::INT AS rank, ref_id, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, ref_id) AS rank FROM k) WHERE rank <= {k}"""


@query(_set_sql("benchmark", "item_id", "list_distinct(list_transform(range(1, length(text) - 1), lambda i: substr(text, i, 3)))", "true", 5))
def set_neighbours(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").withColumn("s", T.char_ngrams(F.col("text"), 3, 3))
    return rounded(retrieve.set_top_k(items, items, "item_id", "s", 5, fill=True))


@query(_set_sql("benchmark", "item_id", "list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: length(w) >= 8))", "true", 8))
def sparse_set_neighbours(spark, sf_dir):
    """Sets of long words: many rows share none, so that neighbours of similarity 0 fill the lists."""
    items = table(spark, sf_dir, "benchmark").withColumn("s", F.filter(T.words(F.col("text")), lambda w: F.length(w) >= 8))
    return rounded(retrieve.set_top_k(items, items, "item_id", "s", 8, fill=True))


@query(f"""WITH {PRED}, g AS (SELECT lang, y, a / 20.0::DOUBLE AS alpha, round((1 - a / 20.0::DOUBLE) * p_hash + a / 20.0::DOUBLE * p_size, 12) AS p FROM pred, range(21) r(a) WHERE y IS NOT NULL),
  t AS (SELECT lang, alpha, p, sum(y) AS pos, count(*) - sum(y) AS neg FROM g GROUP BY ALL), c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM t WINDOW w AS (PARTITION BY lang, alpha ORDER BY p DESC)),
  s AS (SELECT lang, alpha, round(sum(pos * tp / (tp + fp)) / sum(pos), 9) AS ap FROM c GROUP BY ALL HAVING sum(pos) > 0)
  SELECT lang, arg_max(alpha, (ap, -abs(alpha - 0.5), -alpha)) AS alpha, round(max(ap), 6) AS ap FROM s GROUP BY 1""")
def blend_weight(spark, sf_dir):
    return rounded(fuse.blend_weight(predictions(spark, sf_dir), ["lang"], "y", "p_hash", "p_size"))


@query()
def gated_fusion(spark, sf_dir):
    rows = predictions(spark, sf_dir).where("y is not null").withColumn("label", F.col("y").cast("double")).withColumn("mask", T.presence(F.col("lang")).cast("double"))
    gated = fuse.cross_fitted(fuse.gate_features(rows, "p_hash", "p_size", [], ["mask"]), "label", ["doc_id"], name="gated")
    return rounded(metrics.ranking(gated.withColumn("gated", F.round("gated", 9)).unpivot(["y"], ["p_hash", "p_size", "gated"], "model", "p"), ["model"]))


@query("SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_field(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k")).where("k is not null")


@query(r"""SELECT item_id, CASE WHEN length(t) > 60 THEN substr(t, 1, 57) || '...' ELSE t END AS short, (length(coalesce(text, '')) > 0)::INT AS present,
  list_transform(range(1, 9), lambda i: instr('abcdefghijklmnopqrstuvwxyz', CASE WHEN i <= length(text) THEN substr(text, i::BIGINT, 1) ELSE '#' END)::INT) AS codes
  FROM (SELECT item_id, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM benchmark)""")
def text_functions(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "benchmark").select("item_id", T.shortened(text, 60).alias("short"), T.presence(text).alias("present"), T.encoded(text, "abcdefghijklmnopqrstuvwxyz", 8).alias("codes"))


@query(f"""WITH {PRED}, c AS (SELECT lang, model, sum(CASE WHEN p > p2 THEN 1 WHEN p = p2 THEN 0.5 ELSE 0 END)::DOUBLE / count(*) AS ci
  FROM long JOIN (SELECT lang, model, y AS y2, p AS p2 FROM long) b USING (lang, model) WHERE y > y2 GROUP BY ALL)
  SELECT lang, model, round(ci, 6) AS ci FROM (SELECT DISTINCT lang, model FROM long WHERE y IS NOT NULL AND p IS NOT NULL) g LEFT JOIN c USING (lang, model)""")
def concordance_index(spark, sf_dir):
    return rounded(metrics.concordance(long_predictions(spark, sf_dir), ["lang", "model"]))


@query()
def approximate_concordance(spark, sf_dir):
    return rounded(metrics.approximate_concordance(predictions(spark, sf_dir), "doc_id", "y", "p_size"))


@query()
def paired_significance(spark, sf_dir):
    return rounded(significance.paired_tests(runs(spark, sf_dir), ["priority"], "year", "kind", "metric", "A", "N"))


CASE_TOP = "SELECT lang, doc_id, model, kind, r::INT AS rank, round(size, 6) AS size FROM (SELECT *, row_number() OVER (PARTITION BY lang, model ORDER BY size DESC, doc_id) AS r FROM {0}) WHERE r <= 3"


@query(f"""WITH {PRED}, e AS (SELECT lang, doc_id, model, 'error' AS kind, abs(p - y) AS size FROM long),
  w AS (SELECT lang, doc_id, model, 'decision' AS kind, abs(p - 0.5) AS size FROM long WHERE (p >= 0.5)::INT <> y),
  d AS (SELECT lang, doc_id, NULL::VARCHAR AS model, 'disagreement' AS kind, max(p) - min(p) AS size FROM long GROUP BY ALL HAVING count(DISTINCT p >= 0.5) > 1)
  {CASE_TOP.format('e')} UNION ALL {CASE_TOP.format('w')} UNION ALL {CASE_TOP.format('d')}""")
def case_mining(spark, sf_dir):
    return rounded(significance.cases(long_predictions(spark, sf_dir), ["lang"], "doc_id", "model", "y", "p", 3))


@query(f"""WITH {PRED}, d AS (SELECT lang, doc_id, NULL::VARCHAR AS model, 'disagreement' AS kind, max(p) - min(p) AS size FROM long GROUP BY ALL HAVING count(DISTINCT p >= 0.5) > 1 OR max(p) - min(p) >= 0.4)
  {CASE_TOP.format('d')}""")
def wide_disagreements(spark, sf_dir):
    return rounded(significance.cases(long_predictions(spark, sf_dir), ["lang"], "doc_id", "model", "y", "p", 3, wide=0.4).where("kind = 'disagreement'"))


@query(f"""WITH {COS_ALL} SELECT query_id, round(avg((q.label = r.label)::INT), 6) AS share_label, round(avg((sim >= 0.5)::INT), 6) AS share_high
  FROM k JOIN v q ON q.vec_id = query_id JOIN v r ON r.vec_id = ref_id WHERE rank <= 8 GROUP BY 1""")
def neighbour_exposure(spark, sf_dir):
    v, near = _near(spark, sf_dir, 8)
    return rounded(retrieve.exposure(near, v, "vec_id", {"label": "label"}, 0.5))


@query(f"""WITH {COS_ALL} SELECT query_id, round(sum(sim * label) / sum(sim), 6) AS predicted FROM k JOIN v ON v.vec_id = ref_id WHERE rank <= 8 GROUP BY 1 HAVING sum(sim) > 0""")
def neighbour_regression(spark, sf_dir):
    v, near = _near(spark, sf_dir, 8)
    return rounded(fuse.neighbour_regression(near, v, "vec_id", "label"))


def _view_sql(name: str) -> str:
    columns = ("mean_label", "std_label", "mean_sim", "max_sim", "n_ones", "weighted_label")
    return ", ".join(f"round(coalesce({name[0]}.{c}, 0), 6) AS {name}_{c}" for c in columns)


@query(f"""WITH v AS (SELECT vec_id, (label < 5)::INT::DOUBLE AS y, embedding::DOUBLE[] AS joint, CASE WHEN vec_id % 3 > 0 THEN embedding[1:16]::DOUBLE[] END AS head FROM embeddings),
  n AS (SELECT 'joint' AS view, q.vec_id AS query_id, r.vec_id AS ref_id, r.y, list_cosine_similarity(q.joint, r.joint) AS sim FROM v q JOIN v r ON q.vec_id <> r.vec_id AND q.vec_id % 20 = 0 AND q.joint IS NOT NULL AND r.joint IS NOT NULL
    UNION ALL SELECT 'head', q.vec_id, r.vec_id, r.y, list_cosine_similarity(q.head, r.head) FROM v q JOIN v r ON q.vec_id <> r.vec_id AND q.vec_id % 20 = 0 AND q.head IS NOT NULL AND r.head IS NOT NULL),
  k AS (SELECT *, least(1, greatest(0, sim)) + 1e-6 AS w, row_number() OVER (PARTITION BY view, query_id ORDER BY sim DESC, ref_id) AS rank FROM n),
  s AS (SELECT view, query_id, avg(y) AS mean_label, stddev_pop(y) AS std_label, avg(sim) AS mean_sim, max(sim) AS max_sim, sum(y) AS n_ones, sum(y * w) / sum(w) AS weighted_label FROM k WHERE rank <= 8 GROUP BY ALL)
  SELECT vec_id AS query_id, {_view_sql('joint')}, {_view_sql('head')} FROM v LEFT JOIN s j ON j.view = 'joint' AND j.query_id = vec_id LEFT JOIN s h ON h.view = 'head' AND h.query_id = vec_id WHERE vec_id % 20 = 0""")
def multi_view_neighbours(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") < 5).cast("int").alias("y"), "embedding", F.when(F.col("vec_id") % 3 > 0, F.slice("embedding", 1, 16)).alias("head"))
    return rounded(retrieve.multi_view(v.where("vec_id % 20 = 0"), v, "vec_id", "y", {"joint": "embedding", "head": "head"}))


@query(f"""WITH {PRED}, c AS (SELECT *, abs(p_size - p_hash) AS c, 0.7 * p_hash + 0.3 * p_size AS f FROM pred),
  e AS (SELECT lang, list_distinct([quantile_cont(c, 0.25), quantile_cont(c, 0.5), quantile_cont(c, 0.75)]) AS e FROM c GROUP BY 1)
  SELECT lang, 1 + len(list_filter(e, lambda x: c > x)) AS quartile, count(*) AS n, round(avg(greatest(0, least(1, abs(f - p_hash) / (abs(p_size - p_hash) + 1e-8)))), 4) AS reliance FROM c JOIN e USING (lang) GROUP BY ALL""")
def branch_reliance(spark, sf_dir):
    rows = predictions(spark, sf_dir).withColumn("c", F.abs(F.col("p_size") - F.col("p_hash")))
    moved = retrieve.reliance(0.7 * F.col("p_hash") + 0.3 * F.col("p_size"), F.col("p_hash"), F.col("p_size"))
    return rounded(report.quartiles(rows.withColumn("m", moved), ["lang"], "c").groupBy("lang", "quartile").agg(F.count("*").alias("n"), F.round(F.avg("m"), 4).alias("reliance")))


@query(f"""WITH {ACT}, b AS (SELECT min(value) AS lo, max(value) AS hi FROM act WHERE year < 1999) SELECT row_id, round(2 * (value - lo) / (hi - lo) - 1, 6) AS value FROM act, b""")
def scaled_values(spark, sf_dir):
    return rounded(curate.scaled(activities(spark, sf_dir).select("row_id", "year", "value"), ["value"], F.col("year") < 1999).select("row_id", "value"))


@query(f"WITH {ACT} SELECT left_id, right_id, arg_max(value, (year, row_id, value)) AS value FROM act GROUP BY ALL")
def pair_values(spark, sf_dir):
    rows = activities(spark, sf_dir).withColumn("o", F.struct("year", "row_id", "value"))
    return curate.pair_values(rows, "left_id", "right_id", "value", "o")


@query()
def conflict_aware_arbitration(spark, sf_dir):
    rows = predictions(spark, sf_dir).where("y is not null").withColumns({"y": F.col("y").cast("double"), "current": F.col("p_size"), "retrieved": F.col("p_hash"), "anchor": F.lit(0.5), "mask": T.presence(F.col("lang")).cast("double")})
    ready = fuse.gate_features(rows.select("doc_id", "y", "current", "retrieved", "anchor", "mask"), "current", "retrieved", [], ["mask"])
    parts = split.split_random(ready, ["doc_id"], seed=6, train=0.5, val=0.2)
    fused, _ = fuse.arbitrated(parts.where("split <> 'test'").drop("split"), parts.where("split = 'test'").drop("split"), ["doc_id"], folds=2, stats=[], masks=["mask"])
    return rounded(fused.select("doc_id", "full", "no_gate", "no_probe", "no_anchor"))


@query(f"""WITH {PRED} SELECT doc_id, 'p' AS model, v AS variant, prob FROM (SELECT doc_id, 'clean' AS v, p_hash AS prob FROM pred UNION ALL SELECT doc_id, 'missing', p_size FROM pred)""")
def long_predictions_form(spark, sf_dir):
    wide = predictions(spark, sf_dir).select("doc_id", F.col("p_hash").alias("p_prob_clean"), F.col("p_size").alias("p_prob_missing"))
    return project.long_form(wide, ["doc_id"])


@query(f"""WITH {ACT}, p(kind, active, inactive, up) AS (VALUES ('A', 20000.0::DOUBLE, 40000.0::DOUBLE, false), ('N', 50000.0, 30000.0, true))
  SELECT row_id, kind, CASE WHEN (up AND value >= active) OR (NOT up AND value <= active) THEN 1 ELSE 0 END AS label FROM act JOIN p USING (kind)
  WHERE (up AND (value >= active OR value <= inactive)) OR (NOT up AND (value <= active OR value >= inactive))""")
def label_by_policy(spark, sf_dir):
    policy = spark.createDataFrame([("A", 20000.0, 40000.0, False), ("N", 50000.0, 30000.0, True)], "kind string, active double, inactive double, greater_is_better boolean")
    return project.label_policy(activities(spark, sf_dir), policy, "kind", "value").select("row_id", "kind", "label")


@query(f"""WITH {ACT} SELECT row_id, round(9 - log10(value), 6) AS y, (value <= 30000)::INT AS binary_label, kind AS "group" FROM act WHERE value > 0""")
def regression_frame(spark, sf_dir):
    rows = activities(spark, sf_dir).withColumn("l", (F.col("value") <= 30000).cast("int"))
    return rounded(project.project(project.regression_rows(rows, "value", "l"), {"row_id": "row_id", "y": "y", "binary_label": "binary_label", "group": "kind"}))


def queries() -> dict[str, Query]:
    from . import files, reports  # noqa: F401  register their queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranking metrics of both models by language."""
    return auroc_ap(spark, sf_dir)
