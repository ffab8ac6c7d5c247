"""Projections and predicates over sample tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, few, require_columns
from .curate import nm_to_p


def project(df: DataFrame, mapping: dict[str, str | Column]) -> DataFrame:
    """Columns of another schema: new name -> column name or expression."""
    require_columns(df, *[c for c in mapping.values() if isinstance(c, str)])
    return df.select(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in mapping.items()])


def regression_rows(df: DataFrame, value: str, label: str, raw_scale: bool = False) -> DataFrame:
    """Rows with a usable measurement and its target ``y``: the value itself, or 9 - log10(nM) of positive values; ``binary_label`` beside."""
    number = F.expr(f"try_cast(`{value}` as double)")
    rows = df.withColumn("__v", number).where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    if raw_scale:
        return rows.withColumn("y", F.col("__v")).withColumn("binary_label", F.col(label)).drop("__v")
    return rows.where(F.col("__v") > 0).withColumn("y", nm_to_p(F.col("__v"))).withColumn("binary_label", F.col(label)).drop("__v")


#: The columns that four consumers read, by what they hold.
CONSUMERS = {
    "molecule_scores": {"protein_id": "right", "protein_sequence": "right_text", "molecule_id": "left", "molecule_smiles": "left_text", "affinity_score": "y", "binary_label": "label", "sample_id": "sample", "drug_id": "left", "target_id": "right", "label_raw_nm": "raw"},
    "keyed_affinities": {"drug_key": "left", "compound_iso_smiles": "left_text", "target_key": "right", "target_sequence": "right_text", "affinity": "y", "binary_label": "label", "sample_id": "sample", "drug_id": "left", "target_id": "right", "label_raw_nm": "raw"},
    "affinities": {"drug_id": "left", "target_id": "right", "compound_iso_smiles": "left_text", "target_sequence": "right_text", "affinity": "y", "binary_label": "label", "sample_id": "sample", "label_raw_nm": "raw"},
    "self_targets": {"compound_iso_smiles": "left_text", "target_smiles": "left_text", "target_sequence": "right_text", "affinity": "y", "binary_label": "label", "sample_id": "sample", "drug_id": "left", "target_id": "right", "label_raw_nm": "raw"},
}
#: Types of what they hold; all else is text.
HELD_AS = {"y": "double", "raw": "double", "label": "int"}


def for_consumer(df: DataFrame, consumer: str, roles: dict[str, str]) -> DataFrame:
    """The columns that a consumer reads; ``roles`` names the columns of left, right, left_text, right_text, y, label, sample and raw."""
    if consumer not in CONSUMERS:
        raise ValueError(f"no such consumer: {consumer}")
    return project(df, {name: F.col(roles[role]).cast(HELD_AS.get(role, "string")) for name, role in CONSUMERS[consumer].items()})


def label_policy(df: DataFrame, policies: DataFrame, key: str, value: str) -> DataFrame:
    """Labels by a table of (key, active, inactive, greater_is_better); rows in the gap or without a policy are dropped.

    A short table goes to every task, so that the rows of a frequent key are not sorted in one.
    """
    rows = df.join(few(policies), key)
    up = F.col("greater_is_better")
    yes = F.when(up, F.col(value) >= F.col("active")).otherwise(F.col(value) <= F.col("active"))
    no = F.when(up, F.col(value) <= F.col("inactive")).otherwise(F.col(value) >= F.col("inactive"))
    return rows.withColumn("label", F.when(yes, 1).when(no, 0)).where("label is not null").drop("active", "inactive", "greater_is_better")


def replay_missing(df: DataFrame, flags: dict[str, str]) -> DataFrame:
    """Each column blanked where its flag column says true, 1 or yes."""
    return df.withColumns({c: F.when(F.lower(F.col(f).cast("string")).isin("true", "1", "yes"), F.lit("")).otherwise(F.col(c)) for c, f in flags.items()})


def looks_like_accession(column: Column) -> Column:
    """Five to ten capital letters or digits."""
    return F.coalesce(column.rlike(r"^[A-Z0-9]{5,10}$"), F.lit(False))


def is_complete(payload: Column, fields: list[str]) -> Column:
    """Whether every named field of a JSON payload is present and not blank."""
    out = F.lit(True)
    for f in fields:
        out = out & (F.trim(F.coalesce(F.get_json_object(payload, f"$.{f}"), F.lit(""))) != "")
    return out


def within_length(df: DataFrame, most: dict[str, int]) -> DataFrame:
    """Rows whose arrays have at most so many elements."""
    for c, n in most.items():
        df = df.where(F.size(F.coalesce(F.col(c), F.array().cast(df.schema[c].dataType))) <= n)
    return df


def shortlist(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """Rows of the named values, with their place in the list as ``position``."""
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col(column))
    return df.where(F.col(column).isin(names)).withColumn("position", place.cast("int"))


def id_text(column: Column, default: str = "") -> Column:
    """Ids as text with a default for null."""
    return F.coalesce(column.cast("string"), F.lit(default))


def with_predictions(df: DataFrame, predictions: DataFrame, row_id: str, unmatched: str = "raise") -> DataFrame:
    """Rows joined to their predictions on a row id, clashing names with the suffix ``_pred``.

    Where a side has rows that the other lacks: ``raise`` fails, ``keep`` keeps
    every row of ``df``, with nulls for what it lacks, and drops predictions of no row.
    """
    clash = [c for c in predictions.columns if c in df.columns and c != row_id]
    right = predictions.withColumnsRenamed({c: f"{c}_pred" for c in clash})
    if unmatched == "keep":
        return df.join(right, row_id, "left")
    both = df.withColumn("__left", F.lit(1)).join(right.withColumn("__right", F.lit(1)), row_id, "full")
    odd = F.when(F.col("__left").isNull() | F.col("__right").isNull(), F.raise_error(F.concat(F.lit("row without its counterpart: "), F.col(row_id).cast("string"))).cast("int")).otherwise(1)
    return both.withColumn("__ok", odd).where("__ok = 1").drop("__left", "__right", "__ok")


def numbered(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Adds the place of each row in an order, from 0 on without gaps.

    Ranges of the order first, in as many parts as a shuffle has; a part's rows
    are sorted and counted by themselves, and only the table of parts is ordered
    whole. Rows are kept in the shared folder, so that their parts stay the same.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    # The upper bits name the part, the lower 33 the place in it.
    dealt = dealt.withColumns({"__part": F.shiftright("__at", 33), "__in": F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    return dealt.join(F.broadcast(starts), "__part").withColumn(name, F.col("__in") + F.col("__before")).drop("__at", "__part", "__in", "__before")


def sample_ids(df: DataFrame, order: list[Column], prefix: str, name: str = "sample_id") -> DataFrame:
    """Adds running ids ``{prefix}0``, ``{prefix}1``, ... in an order."""
    return numbered(df, order, "__place").withColumn(name, F.concat(F.lit(prefix), F.col("__place").cast("string"))).drop("__place")


def beside(left: DataFrame, right: DataFrame, left_order: list[Column], right_order: list[Column]) -> DataFrame:
    """Two tables side by side, row by row in their orders, with a column position; raises where one has more rows."""
    a, b = numbered(left, left_order), numbered(right, right_order)
    return with_predictions(a, b, "position")


def in_split(df: DataFrame, parts: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Rows tagged by the part whose keys they match, on all keys at once."""
    tagged = None
    for name, part in parts.items():
        one = part.select(*keys).distinct().withColumn("split", F.lit(name))
        tagged = one if tagged is None else tagged.unionByName(one)
    return df.join(tagged, keys)


def long_form(df: DataFrame, ids: list[str]) -> DataFrame:
    """Wide prediction columns ``{model}_prob`` or ``{model}_prob_{variant}`` as rows (ids, model, variant, prob)."""
    wide = [c for c in df.columns if "_prob" in c]
    rows = df.unpivot(ids, wide, "__c", "prob")
    pattern = r"^(.*)_prob(?:_(clean|missing))?$"
    return rows.select(*ids, F.regexp_extract("__c", pattern, 1).alias("model"), F.nullif(F.regexp_extract("__c", pattern, 2), F.lit("")).alias("variant"), "prob").where("model <> ''")
