"""From raw measurements to clean labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crowded, cut, hash_order, hash_unit, in_unit, joined, quantiles, quantiles_of, ranked, require_columns, value_counts


def clean_measurements(df: DataFrame, value: str, required: list[str], kinds: list[str] | None = None, kind: str | None = None) -> DataFrame:
    """Rows with all required columns, a parsable finite positive value and, if given, a permitted kind."""
    require_columns(df, value, *required)
    number = F.expr(f"try_cast(`{value}` as double)")
    out = df.dropna(subset=required).withColumn(value, number).where(F.col(value).isNotNull() & ~F.isnan(value) & (F.col(value) > 0) & (F.col(value) < float("inf")))
    return out.where(F.col(kind).isin(kinds)) if kinds and kind else out


def keep_trusted(df: DataFrame, value: str, among: dict[str, list] | None = None, flags: list[str] | None = None, blank: list[str] | None = None, filled: list[str] | None = None) -> DataFrame:
    """Measurements that pass all rules: a finite positive value; each column of ``among`` holds one of its values
    (relation, unit, organism, kind); no flag is set; ``blank`` texts (comments on validity) are null or blank;
    ``filled`` ones are neither. A null fails ``among`` and ``filled`` and passes the others."""
    out = clean_measurements(df, value, [])
    text = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit(""))
    rules = [F.col(c).isin(list(v)) for c, v in (among or {}).items()]
    rules += [~F.coalesce(F.col(c).cast("boolean"), F.lit(False)) for c in flags or []]
    rules += [text(c) == "" for c in blank or []] + [text(c) != "" for c in filled or []]
    for rule in rules:
        out = out.where(rule)
    return out


def label_with_gap(df: DataFrame, value: str, active: float, inactive: float | None = None, greater_is_better: bool = False) -> DataFrame:
    """Label 1 beyond the active threshold, 0 beyond the inactive one (ten times the active by default), rows between dropped."""
    inactive = 10 * active if inactive is None else inactive
    yes = F.col(value) >= active if greater_is_better else F.col(value) <= active
    no = F.col(value) <= inactive if greater_is_better else F.col(value) >= inactive
    return df.withColumn("label", F.when(yes, 1).when(no, 0)).where("label is not null")


def log_threshold_label(df: DataFrame, value: str, threshold_nm: float) -> DataFrame:
    """Label 1 if the value, on the scale 9 - log10(nM), reaches the threshold on the same scale."""
    return df.where(F.col(value).isNotNull()).withColumn("label", (F.col(value) >= 9 - F.log10(F.lit(float(threshold_nm)))).cast("int"))


def nm_to_p(value: Column) -> Column:
    """9 - log10(nM); raises on values that are not positive."""
    return F.when(value > 0, 9 - F.log10(value)).when(value.isNotNull(), F.raise_error(F.lit("a measurement must be positive")).cast("double"))


def collapse_replicates(df: DataFrame, keys: list[str], value: str, year: str, order: str, describe: list[str], large: int = 100_000) -> DataFrame:
    """One row per key: median value, median year rounded half to even, first non-null of each descriptive column, row count.

    A row whose key's hash no other row has is its own result. Of the others the
    rows of a key are ordered by value and by year after the same shuffle (sorts
    spill, no buffer holds a key); keys of more than ``large`` rows take their
    medians from ranks in two levels instead. The rows are the same. ``df`` is
    evaluated twice, first for its keys alone.
    """
    rows = df.select(*dict.fromkeys([*keys, value, year, order, *describe]))
    held = crowded(rows.select(*keys), keys, large)
    small, out = rows, None
    if held is not None:
        rows = cut(rows)
        small, many = joined(rows, held, keys, "left_anti"), joined(rows, held, keys, "left_semi")
        out = many.groupBy(*keys).agg(F.count("*").alias("n_replicates"), *_firsts(year, order, describe))
        for column in (value, year):
            out = joined(out, quantiles(many, keys, column, {column: 0.5}), keys, "left")
    by, one = keys, None
    if not any("collate" in t for c, t in rows.dtypes if c in keys):  # texts that a collation calls equal may differ in their hash
        alike = Window.partitionBy("__h")
        told = small.withColumn("__h", F.xxhash64(*keys)).withColumns({"__s": F.count("*").over(alike), "__o": F.max(order).over(alike)})
        # A lone row's order is the largest; asking for it makes both parts need the same columns, so that they share a shuffle.
        lone = told.where((F.col("__s") == 1) & F.col("__o").eqNullSafe(F.col(order)))
        one = lone.select(*keys, *[F.col(c).cast("double").alias(c) for c in (value, year)], F.col("__s").alias("n_replicates"), *describe)
        by, small = ["__h", *keys], told.where(F.col("__s") > 1)
    placed, medians = small, []
    for i, column in enumerate((value, year)):
        own = Window.partitionBy(*by).orderBy(F.asc_nulls_last(column))
        # Non-null values come first: the middle one or two of them.
        placed = placed.withColumn(f"__r{i}", F.row_number().over(own))
    counted = placed.withColumns({f"__n{i}": F.count(c).over(Window.partitionBy(*by)) for i, c in enumerate((value, year))})
    for i, column in enumerate((value, year)):
        middle = F.col(f"__r{i}").between(F.floor((F.col(f"__n{i}") + 1) / 2), F.floor(F.col(f"__n{i}") / 2) + 1)
        medians.append(F.avg(F.when(middle, F.col(column).cast("double"))).alias(column))
    plain = counted.groupBy(*by).agg(*medians, F.count("*").alias("n_replicates"), *_firsts(year, order, describe)).select(*keys, value, year, "n_replicates", *describe)
    for part in (one, out):
        plain = plain if part is None else plain.unionByName(part)
    return plain.select(*keys, value, F.bround(year).cast("int").alias(year), "n_replicates", *describe)


def _firsts(year: str, order: str, describe: list[str]) -> list[Column]:
    return [F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(year, order))).alias(c) for c in describe]


def with_support(df: DataFrame, group: str, least: int) -> DataFrame:
    """Rows of groups that have at least ``least`` rows."""
    held = df.groupBy(group).agg(F.count("*").alias("__n")).where(F.col("__n") >= least).select(group)
    return df.join(held, group, "left_semi")


def top_groups(df: DataFrame, group: str, n: int) -> DataFrame:
    """Rows of the ``n`` most frequent groups, ties to the smaller key."""
    held = df.where(F.col(group).isNotNull()).groupBy(group).count().orderBy(F.desc("count"), group).limit(n).select(group)
    return df.join(held, group, "left_semi")


def label_by_quantile(df: DataFrame, group: str, value: str, order: list[str], low: float = 0.3, high: float = 0.7, least_rows: int = 8, least_gap: float = 0.0, cap: int | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Labels inside groups: 1 from the high quantile on, 0 up to the low one, the middle dropped.

    Groups need ``least_rows`` rows, quantiles further apart than ``least_gap``
    and both classes; ``cap`` bounds the rows per class by hash order. Returns
    the rows and a policy table of the groups kept.
    """
    counts = value_counts(df.where(F.col(group).isNotNull()), [group], value)
    policy = quantiles_of(counts, [group], {"q_low": low, "q_high": high}).withColumnRenamed("__n", "n_rows").where((F.col("n_rows") >= least_rows) & (F.col("q_high") - F.col("q_low") > least_gap))
    policy = cut(policy)  # the classes are counted by it and joined to it
    # A value from the high quantile on is positive, whatever the low one is.
    label = lambda v: F.when(v >= F.col("q_high"), 1).when(v <= F.col("q_low"), 0)
    classes = counts.join(policy, group).groupBy(group).agg(*[F.sum(F.when(label(F.col("__v")) == y, F.col("__c")).otherwise(0)).alias(n) for n, y in (("n_pos", 1), ("n_neg", 0))]).where("n_pos > 0 and n_neg > 0")
    policy = cut(policy.join(classes, group))  # a row per group
    rows = df.join(policy.select(group, "q_low", "q_high"), group).withColumn("label", label(F.col(value))).where("label is not null").drop("q_low", "q_high")
    if cap is not None:
        placed = ranked(rows.withColumn("__u", hash_unit(seed, *order)), [group, "label"], "__u", *order, name="__r", order=F.asc(hash_order(seed, *order)))
        rows = placed.where(F.col("__r") <= cap).drop("__r", "__u")
    return rows, policy


def profile(df: DataFrame, keys: list[str], value: str, label: Column, year: str, entities: list[str]) -> DataFrame:
    """Per group: rows, label rate, first and last year, distinct entities, median, mean and sample deviation of the value.

    Entities are told apart in an aggregate of their own, whose rows hold a group
    and one entity and none of the other sums, so that a task keeps little of each.
    """
    plain = df.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.avg(label).alias("label_rate"), F.min(year).alias("first_year"), F.max(year).alias("last_year"), F.avg(value).alias("mean_value"), F.stddev_samp(value).alias("std_value"))
    names = [f"n_{c}" for c in entities]
    if entities:
        types = dict(df.dtypes)
        same = len({types[c] for c in entities}) == 1
        seen = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), (F.col(c) if same else F.col(c).cast("string")).alias("e")) for i, c in enumerate(entities)]))
        apart = df.select(*keys, seen.alias("__s")).select(*keys, F.col("__s.i").alias("__i"), F.col("__s.e").alias("__e")).where("__e is not null").distinct()
        plain = joined(plain, apart.groupBy(*keys).agg(*[F.count_if(F.col("__i") == i).alias(n) for i, n in enumerate(names)]), keys, "left")
    plain = plain.withColumns({n: F.coalesce(n, F.lit(0).cast("long")) for n in names})
    return joined(plain, quantiles(df, keys, value, {"median_value": 0.5}), keys, "left")


def missing_rates(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, column and the share of rows where it is null or, as text, empty or blank."""
    def gone(c: str) -> Column:
        return F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True)).cast("int")

    rates = df.groupBy(*keys).agg(*[F.avg(gone(c)).alias(f"__r{i}") for i, c in enumerate(columns)])
    told = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"__r{i}").alias("missing")) for i, c in enumerate(columns)]))
    return rates.withColumn("__x", told).select(*keys, "__x.column", "__x.missing")


def duplicate_counts(df: DataFrame, keys: dict[str, list[str]]) -> DataFrame:
    """One row per named key: rows, distinct keys, duplicates (rows beyond the first of each key)."""
    parts = [df.groupBy(*[F.col(c) for c in cols]).agg(F.count("*").alias("n")).agg(F.lit(name).alias("key"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_distinct")) for name, cols in keys.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("n_duplicates", F.col("n_rows") - F.col("n_distinct"))


def fetch_coverage(log: DataFrame, keys: list[str]) -> DataFrame:
    """Per group of a fetch log: fetched rows, rows announced, failed pages, their ratio (null if none announced), completeness."""
    found = log.groupBy(*keys).agg(F.sum("page_count").alias("fetched"), F.max("total_count").alias("announced"), F.count_if(F.coalesce(F.col("error"), F.lit("")) != "").alias("failed"))
    return found.withColumn("ratio", F.col("fetched") / F.nullif("announced", F.lit(0))).withColumn("complete", (F.col("failed") == 0) & (F.col("fetched") >= F.col("announced")))


def look_up(df: DataFrame, dimension: DataFrame, key: str, column: str, default: str | None = None, own: str | None = None) -> DataFrame:
    """Adds ``column`` of the dimension by key; empty or absent values give way to the column ``own``, then to the default."""
    joined = df.join(dimension.select(key, F.col(column).alias("__found")), key, "left")
    value = F.nullif(F.trim("__found"), F.lit(""))
    choice = [value] + ([F.col(own)] if own else []) + ([F.lit(default)] if default is not None else [])
    return joined.withColumn(column, F.coalesce(*choice)).drop("__found")


def quotas(strata: DataFrame, limit: int, order: list[str]) -> DataFrame:
    """(stratum columns, n) with a quota each: shares of the limit by largest remainder, at least 1, at most n.

    Floors rise to 1 first, so that quotas may sum above the limit. One row per
    stratum: the only table that is ordered whole.
    """
    total = strata.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("__total"))
    shared = strata.join(F.broadcast(total)).withColumn("__share", F.col("n") * F.lit(float(limit)) / F.col("__total"))
    floored = shared.withColumn("__base", F.least("n", F.greatest(F.floor("__share"), F.lit(1))))
    by_rest = Window.orderBy(F.desc(F.col("__share") - F.floor("__share")), *order)
    left = F.greatest(F.lit(limit) - F.sum("__base").over(Window.partitionBy()), F.lit(0))
    extra = (F.row_number().over(by_rest) <= left) & (F.col("__base") < F.col("n"))
    return floored.withColumn("quota", F.col("__base") + extra.cast("long")).drop("__share", "__base", "__total")


def sample_by_quota(df: DataFrame, keys: list[str], limit: int, order: list[str], seed: int = 0) -> DataFrame:
    """Rows chosen per stratum by hash order up to its quota; a table within the limit stays whole."""
    held = quotas(df.groupBy(*keys).agg(F.count("*").alias("n")), limit, keys).select(*keys, "quota")
    placed = ranked(df.withColumn("__unit", hash_unit(seed, *order)), keys, "__unit", *order, name="__r", order=F.asc(hash_order(seed, *order)))
    return joined(placed, held, keys).where(F.col("__r") <= F.col("quota")).drop("__r", "__unit", "quota")


def evenly_spaced(df: DataFrame, group: str, value: str, order: list[str], most: int) -> DataFrame:
    """At most ``most`` rows of each group, at even positions of the order by value, both ends kept."""
    placed = ranked(in_unit(df, [group], value, rising=True), [group], "__unit", *order, name="__r", order=F.asc_nulls_last(value))
    sized = joined(placed, df.groupBy(group).agg(F.count("*").alias("__n")), [group]).withColumn("__r", F.col("__r") - 1)
    m = F.least(F.col("__n"), F.lit(most))
    # Position i of m lies at i * step, rounded; only the whole numbers around r / step can fall on r.
    step = (F.col("__n") - 1) / (m - 1)
    near = F.floor(F.col("__r") / step)
    hit = F.lit(False)
    for d in (-1, 0, 1):
        hit = hit | ((near + d).between(F.lit(0), m - 1) & (F.bround((near + d) * step) == F.col("__r")))
    return sized.where(F.when(m == 1, F.col("__r") == 0).otherwise(hit)).drop("__n", "__r", "__unit")


def balanced_cohort(df: DataFrame, group: str, year: str, kind: str, value: str, row_id: str, most_groups: int, most_rows: int, edges: tuple[int, ...] = (2014, 2019), seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """A bounded cohort over groups, and its manifest of one row per group.

    Groups are drawn by quota inside strata of first year (up to each edge, and
    beyond) and first kind; of each chosen group, rows at even ranks of the value
    stay. Rows without group, year or value are dropped. A limit of 0 keeps all.
    """
    rows = df.where(F.col(group).isNotNull() & F.col(year).isNotNull() & F.col(value).isNotNull())
    first = F.min(F.when(F.col(kind).isNotNull(), F.struct(F.col(year).alias("a"), F.col(kind).alias("b"))))["b"]
    meta = rows.groupBy(group).agg(F.count("*").alias("candidate_rows"), F.min(year).alias("first_year"), F.max(year).alias("last_year"), first.alias("first_kind"), F.min(value).alias("min_value"), F.median(value).alias("median_value"), F.max(value).alias("max_value"))
    period = sum([(F.col("first_year") > e).cast("int") for e in edges], F.lit(0))
    meta = meta.withColumn("stratum", F.concat_ws("|", period.cast("string"), F.coalesce("first_kind", F.lit(""))))
    chosen = (sample_by_quota(meta.select(group, "stratum"), ["stratum"], most_groups, [group], seed) if most_groups > 0 else meta).select(group).withColumn("selected", F.lit(True))
    cohort = joined(rows, chosen, [group]).drop("selected")
    cohort = evenly_spaced(cohort, group, value, [row_id], most_rows) if most_rows > 0 else cohort
    kept = cohort.groupBy(group).agg(F.count("*").alias("retained_rows"))
    manifest = joined(joined(meta, chosen, [group], "left"), kept, [group], "left")
    return cohort, manifest.withColumns({"selected": F.coalesce("selected", F.lit(False)), "retained_rows": F.coalesce("retained_rows", F.lit(0).cast("long"))})


def sample_rows(df: DataFrame, n: int, order: list[str], seed: int = 0) -> DataFrame:
    """Exactly ``n`` rows (or all, if fewer) in a seeded hash order of the given columns."""
    return df.orderBy(hash_order(seed, *order), *order).limit(n)


def blank_missing(df: DataFrame, shares: dict[str, float], key: str, seed: int = 0) -> DataFrame:
    """Each named column blanked with its probability by a hash of seed, column and key; draws don't depend on row order."""
    def draw(c: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), F.lit(c), F.col(key)), F.lit(1_000_000)) / 1_000_000

    return df.withColumns({c: F.when(draw(c) < p, F.lit("")).otherwise(F.col(c)) for c, p in shares.items()})


def scaled(df: DataFrame, columns: list[str], train: Column) -> DataFrame:
    """Columns on [-1, 1] by the bounds of the rows where ``train`` holds; constant columns become 0."""
    bounds = df.where(train).agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    wide = df.crossJoin(F.broadcast(bounds))  # one row of bounds
    unit = {c: F.when(F.col(f"__hi_{c}") > F.col(f"__lo_{c}"), 2 * (F.col(c) - F.col(f"__lo_{c}")) / (F.col(f"__hi_{c}") - F.col(f"__lo_{c}")) - 1).otherwise(0.0) for c in columns}
    return wide.withColumns(unit).select(*df.columns)


def entity_table(df: DataFrame, key: str, attribute: str, order: str) -> DataFrame:
    """Distinct keys with their first attribute in the order."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(attribute, order).alias(attribute))


def pair_values(df: DataFrame, row: str, column: str, value: str, order: str) -> DataFrame:
    """(row, column, value) of a pair matrix in coordinates; the last value of a pair wins."""
    return df.groupBy(row, column).agg(F.max_by(value, order).alias(value))
