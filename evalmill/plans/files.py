"""Registered queries of sources, sinks and projections, with their SQL.

Queries of file forms write the driver's tables in such a form to the shared
folder and read them back through the library's scans.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from ..functions import text as T
from ..operators import curate, project
from ..operators.common import shared_folder
from ..sources import scans
from .registry import PRED, predictions, query, rounded, table


def fresh(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def one_a_file(df: DataFrame, path: str, form: str) -> None:
    df.write.option("maxRecordsPerFile", 1).format(form).save(path)


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def csv_round_trip(spark, sf_dir):
    rows, path = table(spark, sf_dir, "supplier"), fresh(spark)
    scans.write_csv(rows, path)
    return scans.read_csv(spark, path, rows.schema)


@query("SELECT c_custkey AS sample_id, c_name, c_acctbal FROM customer")
def benchmark_scan(spark, sf_dir):
    rows, path = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample_id"), "c_name", "c_acctbal"), fresh(spark)
    scans.write_csv(rows, path)
    return scans.read_benchmark(spark, path, rows.schema)


@query("SELECT count(*) OVER (PARTITION BY c_nationkey) AS total_count, c_custkey, c_name, c_acctbal FROM customer")
def json_pages(spark, sf_dir):
    record, path = F.struct("c_custkey", "c_name", "c_acctbal"), fresh(spark)
    rows = table(spark, sf_dir, "customer")
    pages = rows.groupBy("c_nationkey").agg(F.collect_list(record).alias("activities"), F.struct(F.count("*").alias("total_count")).alias("page_meta"))
    one_a_file(pages.drop("c_nationkey"), path, "json")
    return scans.read_pages(spark, path, rows.select("c_custkey", "c_name", "c_acctbal").schema).drop("file")


@query("SELECT s_name AS key, 'text of ' || s_suppkey AS value FROM supplier")
def keyed_json(spark, sf_dir):
    """Objects of plain strings and of records, one file per nation."""
    path, quoted = fresh(spark), F.concat(F.lit('"text of '), F.col("s_suppkey"), F.lit('"'))
    value = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit('{"text": '), quoted, F.lit("}"))).otherwise(quoted)
    entry = F.concat(F.lit('"'), F.col("s_name"), F.lit('": '), value)
    objects = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.concat(F.lit("{"), F.array_join(F.collect_list(entry), ", "), F.lit("}")).alias("value"))
    one_a_file(objects.select("value"), path, "text")
    return scans.read_keyed_json(spark, path)


@query("""SELECT 'run=base_s' || year(o_orderdate) AS run_dir, year(o_orderdate)::INT AS seed, 'orders' AS dataset, 'random' AS split_mode, o_orderpriority AS model,
  o_orderpriority AS selected_model, count(*)::DOUBLE AS auprc, max(o_totalprice) AS auroc FROM orders GROUP BY ALL""")
def run_metrics(spark, sf_dir):
    path = fresh(spark)
    per = table(spark, sf_dir, "orders").groupBy(F.concat(F.lit("base_s"), F.year("o_orderdate")).alias("run"), F.col("o_orderpriority").alias("model")).agg(F.count("*").cast("double").alias("auprc"), F.max("o_totalprice").alias("auroc"))
    values = F.struct(F.struct("auprc", "auroc").alias("test_clean"), F.col("model").alias("selected_model"))
    documents = per.groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct("model", values))).alias("models")).withColumns({"dataset": F.lit("orders"), "split_mode": F.lit("random")})
    documents.write.partitionBy("run").json(path)
    return scans.read_metrics(spark, [f"{path}/run=*/*.json"], ["auprc", "auroc"])


@query(f"""WITH {PRED} SELECT doc_id, y, p_hash AS p, 'clean' AS metric_split, 'run=' || lang AS run_dir, n FROM pred JOIN (SELECT lang, count(*) AS n FROM pred GROUP BY 1) USING (lang)
  UNION ALL SELECT doc_id, y, p_size, 'missing', 'run=' || lang, n FROM pred JOIN (SELECT lang, count(*) AS n FROM pred GROUP BY 1) USING (lang)""")
def prediction_scan(spark, sf_dir):
    rows, path = predictions(spark, sf_dir).where("lang is not null"), fresh(spark)
    for name, p in (("clean", "p_hash"), ("missing", "p_size")):
        rows.select("doc_id", "y", F.col(p).alias("p"), F.col("lang").alias("run")).write.partitionBy("run").option("header", True).csv(f"{path}/{name}")
    header = rows.groupBy(F.concat(F.lit("run="), F.col("lang")).alias("run_dir")).agg(F.count("*").alias("n"))
    files = {name: f"{path}/{name}/run=*/*.csv" for name in ("clean", "missing")}
    return scans.read_predictions(spark, files, "doc_id long, y int, p double", header)


@query("""SELECT c_nationkey::INT AS nation, CASE WHEN c_nationkey % 5 = 4 THEN NULL ELSE round(sum(c_acctbal), 2) END AS total, c_nationkey % 5 <> 4 AS usable FROM customer GROUP BY c_nationkey""")
def flat_metrics(spark, sf_dir):
    """Documents with all fields, and others that lack one or are no JSON."""
    path, nation = fresh(spark), F.col("c_nationkey")
    sums = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.round(F.sum("c_acctbal"), 2).alias("total"))
    good = F.to_json(F.struct(nation.alias("nation"), F.col("total")))
    broken = F.when(nation % 10 == 4, F.concat(F.lit('{"nation": '), nation, F.lit("}"))).otherwise(F.concat(F.lit('{"nation": '), nation, F.lit(', "total": ')))
    one_a_file(sums.select(F.when(nation % 5 == 4, broken).otherwise(good).alias("value")), path, "text")
    schema = T_.StructType([T_.StructField("nation", T_.IntegerType()), T_.StructField("total", T_.DoubleType())])
    usable, rest = scans.read_flat_metrics(spark, path, schema, ["nation", "total"])
    told = rest.select(F.regexp_extract("raw", r"(\d+)", 1).cast("int").alias("nation"), F.lit(None).cast("double").alias("total"), F.lit(False).alias("usable"))
    return usable.select("nation", "total", F.lit(True).alias("usable")).unionByName(told)


@query("SELECT n_name AS name, strlen(n_name || chr(10))::BIGINT AS length, sha256(n_name || chr(10)) AS sha256 FROM nation")
def file_listing(spark, sf_dir):
    """Size and digest of every file under a folder."""
    path = fresh(spark)
    table(spark, sf_dir, "nation").select(F.col("n_name").alias("value"), F.col("n_name").alias("run")).write.partitionBy("run").text(path)
    files = scans.list_files(spark, f"{path}/run=*", digest=True)
    return files.select(F.url_decode(F.regexp_extract("path", r"run=([^/]+)/", 1)).alias("name"), "length", "sha256")


@query("""SELECT n.n_regionkey::INT AS region, count(*)::INT AS n_files, sum(strlen(n_name || chr(10)))::BIGINT AS bytes FROM nation n GROUP BY ALL HAVING count(*) > 0""")
def complete_run_folders(spark, sf_dir):
    """Folders with every required file: one per region, a file per nation."""
    path = fresh(spark)
    table(spark, sf_dir, "nation").select(F.col("n_name").alias("value"), F.col("n_regionkey").alias("run"), "n_nationkey").write.partitionBy("run", "n_nationkey").text(path)
    # What a nation's folder is called stands for the name of its file.
    files = scans.list_files(spark, f"{path}/run=*").withColumn("path", F.regexp_extract("path", r"^(.*)/[^/]+$", 1))
    found = scans.complete_runs(files, [])
    return found.select(F.regexp_extract("run_dir", r"run=(\d+)", 1).cast("int").alias("region"), F.size("names").alias("n_files"), "bytes")


@query("""WITH f AS (SELECT CASE WHEN n_nationkey % 3 > 0 THEN 'b' ELSE 'a' END AS name, n_regionkey, count(*) AS rows, sum(strlen(n_name || chr(10))) AS bytes FROM nation GROUP BY ALL)
  SELECT n_regionkey::INT AS region, sum(rows)::BIGINT AS rows, sum(bytes)::BIGINT AS bytes FROM f GROUP BY 1 HAVING count(*) = 2 UNION ALL
  SELECT 100 + n_regionkey::INT, sum(rows)::BIGINT, sum(bytes)::BIGINT FROM f WHERE n_regionkey <> 1 GROUP BY 1 HAVING count(*) = 2""")
def runs_with_required_files(spark, sf_dir):
    """Runs that hold both required files, with their rows; a second set of runs in which one run lacks a file."""
    path = fresh(spark)
    rows = table(spark, sf_dir, "nation").select(F.col("n_name").alias("value"), F.col("n_regionkey").alias("run"), F.when(F.col("n_nationkey") % 3 > 0, "b").otherwise("a").alias("name"))
    second = rows.withColumn("run", F.col("run") + 100).where("not (run = 101 and name = 'b')")
    rows.unionByName(second).repartition("run", "name").write.partitionBy("run", "name").text(path)
    # What a folder is called stands for the name of its file.
    folder = F.regexp_extract("path", r"^(?:file:)?/*(.*)/[^/]+$", 1)
    counts = scans.row_counts(spark, f"{path}/run=*").groupBy(folder.alias("path")).agg(F.sum("rows").alias("rows"))
    files = scans.list_files(spark, f"{path}/run=*").withColumn("path", folder)
    whole = scans.complete_runs(files, ["name=a", "name=b"]).select(F.regexp_extract("run_dir", r"run=(\d+)", 1).cast("int").alias("region"), "bytes")
    told = counts.groupBy(F.regexp_extract("path", r"run=(\d+)", 1).cast("int").alias("region")).agg(F.sum("rows").alias("rows"))
    return whole.join(told, "region").select("region", "rows", "bytes")


@query("SELECT row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) - 1 AS position, o_orderkey, 'o' || (row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) - 1) AS sample_id FROM orders")
def running_numbers(spark, sf_dir):
    """Places and running ids of orders by falling date."""
    order = [F.desc("o_orderdate"), F.asc("o_orderkey")]
    rows = project.sample_ids(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), order, "o")
    return project.numbered(rows, order).select("position", "o_orderkey", "sample_id")


@query("""SELECT a.position, c_custkey, o_orderkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS position FROM customer) a
  JOIN (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS position FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT (SELECT count(*) FROM customer))) b USING (position)""")
def rows_side_by_side(spark, sf_dir):
    """Customers by balance beside as many orders by price, by position."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(customers.count())
    found = project.beside(customers, orders, [F.asc("c_acctbal"), F.asc("c_custkey")], [F.asc("o_totalprice"), F.asc("o_orderkey")])
    return found.select("position", "c_custkey", "o_orderkey")


@query(f"WITH {PRED} SELECT doc_id, lang, CASE WHEN doc_id % 3 > 0 THEN p_hash END AS p FROM pred")
def left_joined_predictions(spark, sf_dir):
    """Rows beside predictions that some of them lack."""
    rows = predictions(spark, sf_dir)
    some = rows.where("doc_id % 3 > 0").select("doc_id", F.col("p_hash").alias("p")).union(spark.createDataFrame([(-5, 0.5)], "doc_id long, p double"))
    return project.with_predictions(rows.select("doc_id", "lang"), some, "doc_id", "keep")


@query("SELECT c_custkey, c_mktsegment AS split_mode, CASE WHEN c_custkey % 10 < 8 THEN 'train' WHEN c_custkey % 10 = 8 THEN 'val' ELSE 'test' END AS split FROM customer")
def split_sink(spark, sf_dir):
    path, place = fresh(spark), F.col("c_custkey") % 10
    part = F.when(place < 8, "train").when(place == 8, "val").otherwise("test")
    scans.write_splits(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("split_mode"), part.alias("split")), path)
    return spark.read.parquet(path).select("c_custkey", "split_mode", "split")


@query("SELECT c_mktsegment AS segment, count(*) AS n, round(avg(c_acctbal), 6) AS mean FROM customer GROUP BY ALL")
def report_sink(spark, sf_dir):
    path = fresh(spark)
    scans.write_report(rounded(table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"), F.avg("c_acctbal").alias("mean"))), path)
    return spark.read.schema("segment string, n long, mean double").json(path)


@query("""SELECT DISTINCT name, region, note FROM (SELECT n_name AS name, n_regionkey AS region, NULL::VARCHAR AS note FROM nation
  UNION ALL SELECT n_name, n_regionkey, NULL FROM nation WHERE n_regionkey < 2 UNION ALL SELECT r_name, r_regionkey, 'region' FROM region)""")
def summary_union(spark, sf_dir):
    """Tables under canonical names, absent columns null, equal rows once."""
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    first = scans.renamed(nations, {"n_name": "name", "n_regionkey": "region"}, ["name", "region"])
    second = scans.renamed(regions.withColumn("note", F.lit("region")), {"r_name": "name", "r_regionkey": "region"}, ["name", "region"])
    return scans.union_tables([first, first.where("region < 2"), second], ["name", "region", "note"])


@query("SELECT s_suppkey, n_nationkey FROM supplier CROSS JOIN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) WHERE n_nationkey <> s_nationkey")
def missing_work(spark, sf_dir):
    """Cells of suppliers and one region's nations that are not done."""
    suppliers, nations = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation").where("n_regionkey = 1")
    grid = suppliers.select("s_suppkey").withColumn("k", F.lit(1)).join(F.broadcast(nations.select("n_nationkey").withColumn("k", F.lit(1))), "k").drop("k")
    return scans.missing_work(grid, suppliers.select("s_suppkey", F.col("s_nationkey").alias("n_nationkey")), ["s_suppkey", "n_nationkey"])


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS source, CASE WHEN doc_id % 2 = 0 THEN '' ELSE lang END AS lang,
  coalesce(regexp_full_match(upper(source), '[A-Z0-9]{5,10}'), false) AS accession, coalesce(doc_id::VARCHAR, 'none') AS id_text FROM documents""")
def replayed_missing(spark, sf_dir):
    """Fields blanked by flags; shape of identifiers; ids as text."""
    flagged = table(spark, sf_dir, "documents").withColumns({"f": F.when(F.col("doc_id") % 3 == 0, "Yes").otherwise("no"), "g": F.col("doc_id") % 2 == 0, "accession": project.looks_like_accession(F.upper("source"))})
    return project.replay_missing(flagged, {"source": "f", "lang": "g"}).select("doc_id", "source", "lang", "accession", project.id_text(F.col("doc_id"), "none").alias("id_text"))


@query("SELECT event_id, trim(coalesce(json_extract_string(props, '$.page'), '')) <> '' AS with_page, trim(coalesce(json_extract_string(props, '$.k'), '')) <> '' AS with_k FROM events")
def complete_payload(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", project.is_complete(F.col("props"), ["page"]).alias("with_page"), project.is_complete(F.col("props"), ["k"]).alias("with_k"))


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n_words FROM documents WHERE coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) <= 100""")
def within_length(spark, sf_dir):
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    rows = table(spark, sf_dir, "documents").withColumn("words", words)
    return project.within_length(rows, {"words": 100}).select("doc_id", F.when(F.col("words").isNotNull(), F.size("words")).cast("long").alias("n_words"))


@query("SELECT c_custkey, c_mktsegment, CASE c_mktsegment WHEN 'MACHINERY' THEN 1 ELSE 2 END AS position FROM customer WHERE c_mktsegment IN ('MACHINERY', 'BUILDING')")
def shortlist(spark, sf_dir):
    return project.shortlist(table(spark, sf_dir, "customer"), "c_mktsegment", ["MACHINERY", "BUILDING"]).select("c_custkey", "c_mktsegment", "position")


@query(f"WITH {PRED} SELECT doc_id, lang, y, p_hash AS p, lang AS lang_pred FROM pred")
def joined_predictions(spark, sf_dir):
    """Rows beside their predictions by row id; clashing names get a suffix."""
    rows = predictions(spark, sf_dir)
    return project.with_predictions(rows.select("doc_id", "lang", "y"), rows.select("doc_id", F.col("p_hash").alias("p"), "lang"), "doc_id")


@query("SELECT s_suppkey, s_nationkey, CASE WHEN s_nationkey < 12 THEN 'train' ELSE 'test' END AS split FROM supplier")
def tagged_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return project.in_split(rows, {"train": rows.where("s_nationkey < 12"), "test": rows.where("s_nationkey >= 12")}, ["s_suppkey", "s_nationkey"])


@query("SELECT l_partkey, arg_min(l_shipdate::DATE::VARCHAR, (l_orderkey, l_linenumber)) AS first_shipped FROM lineitem GROUP BY 1")
def entity_table(spark, sf_dir):
    """Lines of equal numbers go by their place in the table, as SQL's first one does."""
    order = F.struct("l_orderkey", "l_linenumber", "_metadata.file_path", "_metadata.row_index")
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", order.alias("o"), F.to_date("l_shipdate").cast("string").alias("first_shipped"))
    return curate.entity_table(rows, "l_partkey", "first_shipped", "o")


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
  SELECT a.vec_id, round(list_cosine_similarity(a.v, b.v), 5) AS cosine FROM e a JOIN e b ON b.vec_id = a.vec_id + 1""")
def vector_cosine(spark, sf_dir):
    """Cosine of each vector and the one behind it."""
    rows = table(spark, sf_dir, "embeddings")
    later = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("w"))
    return rows.join(later, "vec_id").select("vec_id", F.round(T.cosine(F.col("embedding"), F.col("w")), 5).alias("cosine"))


_WORDS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '')"


@query(f"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents), s AS (SELECT doc_id, list_distinct(w) AS s FROM w)
  SELECT a.doc_id, CASE WHEN len(a.s) + len(b.s) = 0 THEN 0.0 ELSE round(len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)))::DOUBLE, 6) END AS tanimoto
  FROM s a JOIN s b ON b.doc_id = a.doc_id + 1""")
def text_tanimoto(spark, sf_dir):
    """Shared part of the word sets of each document and the one behind it."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(T.words(F.col("text"))).alias("s"))
    later = rows.select((F.col("doc_id") - 1).alias("doc_id"), F.col("s").alias("t"))
    return rows.join(later, "doc_id").select("doc_id", F.round(T.tanimoto(F.col("s"), F.col("t")), 6).alias("tanimoto"))


@query(f"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
  g AS (SELECT doc_id, w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS g FROM w)
  SELECT doc_id, len(g) AS n_grams, len(list_distinct(g)) AS n_distinct FROM g""")
def word_ngrams(spark, sf_dir):
    """Words and pairs of neighbours; counts of their hash vectors are held against them in tests."""
    grams = T.word_ngrams(F.col("text"), 1, 2)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(grams).cast("long").alias("n_grams"), F.size(F.array_distinct(grams)).cast("long").alias("n_distinct"))


@query("""SELECT DISTINCT path, CASE WHEN y % 2 = 0 THEN 'cold_' || lower(p) END AS split, CASE WHEN y % 2 = 0 THEN y END AS seed FROM (SELECT year(o_orderdate)::INT AS y, substr(o_orderpriority, 3) AS p,
  CASE WHEN year(o_orderdate) % 2 = 0 THEN 'runs/cold_' || lower(substr(o_orderpriority, 3)) || '_s' || year(o_orderdate) || '/' ELSE 'runs/' || year(o_orderdate) END AS path FROM orders)""")
def run_names(spark, sf_dir):
    year = F.year("o_orderdate")
    path = F.when(year % 2 == 0, F.concat(F.lit("runs/cold_"), F.lower(F.substring("o_orderpriority", 3, 40)), F.lit("_s"), year, F.lit("/"))).otherwise(F.concat(F.lit("runs/"), year))
    told = table(spark, sf_dir, "orders").select(path.alias("path")).distinct().withColumn("run", T.run_name(F.col("path")))
    return told.select("path", "run.split", "run.seed")


@query("""SELECT o_orderpriority AS priority, unnest(['clerk', 'note']) AS "column", unnest([avg((length(trim(clerk)) = 0)::INT), avg((note IS NULL)::INT)]) AS missing FROM (
  SELECT o_orderpriority, CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE o_orderstatus END AS clerk, CASE WHEN o_orderkey % 4 > 0 THEN o_totalprice END AS note FROM orders) GROUP BY 1""")
def missing_rates(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("priority"), F.when(F.col("o_orderkey") % 3 == 0, " ").otherwise(F.col("o_orderstatus")).alias("clerk"), F.when(F.col("o_orderkey") % 4 > 0, F.col("o_totalprice")).alias("note"))
    return curate.missing_rates(rows, ["priority"], ["clerk", "note"])


#: Where the columns of ``project.CONSUMERS`` come from here.
_FROM = {"left": "l_partkey", "right": "l_suppkey", "left_text": "p_name", "right_text": "s_name", "y": "l_extendedprice", "label": "l_linenumber", "sample": "l_orderkey", "raw": "l_quantity"}


def _consumer_query(consumer: str) -> None:
    kinds = {"string": "VARCHAR", "double": "DOUBLE", "int": "INT"}
    columns = ", ".join(f"{_FROM[role]}::{kinds[project.HELD_AS.get(role, 'string')]} AS {name}" for name, role in project.CONSUMERS[consumer].items())

    def run(spark, sf_dir):
        rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        return project.for_consumer(rows, consumer, _FROM)

    run.__name__ = f"consumer_{consumer}"
    query(f"SELECT {columns} FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey")(run)


for _consumer in project.CONSUMERS:
    _consumer_query(_consumer)


@query("SELECT DISTINCT 'runs/base_s' || year(o_orderdate) || '_x' AS path, year(o_orderdate)::INT AS seed FROM orders")
def seed_of_path(spark, sf_dir):
    path = F.concat(F.lit("runs/base_s"), F.year("o_orderdate"), F.lit("_x"))
    return table(spark, sf_dir, "orders").select(path.alias("path"), T.seed_of(path).alias("seed")).distinct()
