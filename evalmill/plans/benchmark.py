"""Pipelines over whole tables: from measurements to benchmark tables, splits and their audits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit, curate, metrics, project, report, significance, split
from ..operators.common import cut, hash_order, joined
from ..operators.split import ends


@dataclass(frozen=True)
class Columns:
    """Names of the roles of a measurement table."""

    row_id: str = "row_id"
    left: str = "left_id"
    right: str = "right_id"
    context: str = "context_id"
    value: str = "value"
    year: str = "year"

    @property
    def identity(self) -> list[str]:
        """Columns that order rows; row ids alone may repeat."""
        return [self.row_id, self.left, self.right]


def public_subset(df: DataFrame, texts: DataFrame, c: Columns, size: int, most_groups: int, active: float, inactive: float | None = None, blank: float = 0.05, seed: int = 42) -> DataFrame:
    """Rows of the most frequent groups, labelled, sampled to a size, with a text per group (its id where there is none); a share of the texts is blanked."""
    clean = curate.clean_measurements(df, c.value, [c.left, c.right])
    labelled = curate.label_with_gap(curate.top_groups(clean, c.right, most_groups), c.value, active, inactive)
    drawn = curate.sample_rows(labelled, size, c.identity, seed).withColumn("__own", F.col(c.right).cast("string"))
    told = curate.look_up(drawn, texts, c.right, "text", own="__own").drop("__own")
    return curate.blank_missing(told, {"text": blank}, c.row_id, seed).withColumn("sample_id", T.stable_id("s", F.col(c.row_id).cast("string")))


def official_splits(parts: dict[str, DataFrame], names: dict[str, str], texts: DataFrame, c: Columns, active: float, inactive: float | None = None) -> DataFrame:
    """Given parts under canonical names, labelled and told in words, in one table with a column split."""
    out = None
    for name, part in parts.items():
        rows = curate.label_with_gap(part.withColumnsRenamed(names), c.value, active, inactive).withColumns({"split": F.lit(name), "__own": F.col(c.right).cast("string")})
        told = curate.look_up(rows, texts, c.right, "text", own="__own").drop("__own")
        out = told if out is None else out.unionByName(told)
    return out


def context_subset(df: DataFrame, contexts: DataFrame, texts: DataFrame, c: Columns, size: int, active: float, seed: int = 42) -> DataFrame:
    """Measurements of described contexts, sampled, labelled at one threshold, with the context's and the group's text composed."""
    described = curate.clean_measurements(df, c.value, [c.left, c.right, c.context]).join(contexts.select(c.context, "context_text"), c.context)
    drawn = curate.sample_rows(described, size, c.identity, seed)
    told = curate.look_up(drawn, texts, c.right, "group_text", default="")
    made = told.withColumn("text", T.composed(F.col("context_text"), F.col("group_text"), F.col(c.right).cast("string")))
    return made.withColumn("label", (F.col(c.value) <= active).cast("int"))


def build(df: DataFrame, c: Columns, describe: list[str], low: float, high: float, least_rows: int, least_gap: float, cap: int | None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The benchmark table: replicates collapsed, labels inside each context by quantile; and the policy row of each context."""
    clean = curate.clean_measurements(df, c.value, [c.left, c.right, c.context])
    one = cut(curate.collapse_replicates(clean, [c.left, c.right, c.context], c.value, c.year, c.row_id, describe))  # read for the quantiles and for the rows
    return curate.label_by_quantile(one, c.context, c.value, [c.left, c.right], low, high, least_rows, least_gap, cap, seed)


def modes(c: Columns) -> dict[str, tuple[str, list[str]]]:
    """Split modes by name: the kind of split and its columns."""
    return {"random": ("random", c.identity), "right_cold": ("group", [c.right]), "context_cold": ("group", [c.context]), "temporal": ("time", [c.year])}


def all_splits(df: DataFrame, c: Columns, seed: int = 0) -> DataFrame:
    """``df`` once per split mode, with columns mode and split."""
    out = None
    for name, (kind, columns) in modes(c).items():
        options = {} if kind == "time" else {"seed": seed}
        part = split.split_frame(df, kind, columns, **options).select(*df.columns, "split", F.lit(name).alias("mode"))
        out = part if out is None else out.unionByName(part)
    return out


def overlaps(df: DataFrame, c: Columns) -> DataFrame:
    """Overlap audit of every mode of ``all_splits``; modes come from the table of modes, not from rows."""
    out = None
    for name in modes(c):
        part = split.overlap(df.where(F.col("mode") == name), {"left": [c.left], "right": [c.right], "context": [c.context], "pair": [c.left, c.right]}).withColumn("mode", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def descriptives(df: DataFrame, c: Columns, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """A profile of every part of every split mode, and the overlaps between parts. ``df`` has a label."""
    dealt = all_splits(df, c, seed)
    return curate.profile(dealt, ["mode", "split"], c.value, F.col("label"), c.year, [c.left, c.right, c.context]), overlaps(dealt, c)


def consumer_splits(df: DataFrame, c: Columns, mode: str, most: dict[str, int], seed: int = 0) -> DataFrame:
    """One split mode as regression rows, each part sampled to at most so many rows (0: all)."""
    kind, columns = modes(c)[mode]
    rows = project.regression_rows(split.split_frame(df, kind, columns, **({} if kind == "time" else {"seed": seed})), c.value, "label")
    out = None
    for part in split.PARTS:
        held = rows.where(F.col("split") == part)
        held = curate.sample_rows(held, most[part], c.identity, seed) if most.get(part) else held
        out = held if out is None else out.unionByName(held)
    return out


#: How ``coded`` writes a part; a row that is not in a mode has a dash.
LETTERS = {"train": "t", "val": "v", "test": "x"}


def coded(df: DataFrame, c: Columns, seeds: list[int], train: float = 0.7, val: float = 0.15) -> DataFrame:
    """``df`` with ``__code``: a letter for the row's part in every seed of every mode, seeds of the first mode first.

    Rows stay where they are: of each mode and seed only the hashes at which train
    and val end are sought, among rows (random), or distinct groups or years. Rows
    of one identity that fall in two parts go by a hash of all their columns.
    """
    columns, letters = df.columns, []
    number = F.row_number().over(Window.partitionBy("__id").orderBy(F.xxhash64(*columns)))
    rows = df.withColumns({"__id": F.concat_ws("|", *[F.col(x).cast("string") for x in c.identity]), "__nth": F.lit(1)})
    for kind, group in modes(c).values():
        if kind == "random":
            hashes = {s: hash_order(s, "__id") for s in seeds}
            found = ends(rows, hashes, train, val)
            torn = sum([hashes[s].isin(found[s].torn).cast("int") for s in seeds if found[s].torn], F.lit(0)) > 0
            if any(e.torn for e in found.values()):
                rows = rows.where(torn).withColumn("__nth", number).unionByName(rows.where(~torn))
            letters += [split.dealt_to(hashes[s], found[s], F.col("__nth"), train, val) for s in seeds]
            continue
        key = group[0]
        known = df.where(F.col(key).isNotNull()).select(key).distinct()
        if kind == "group":
            hashes = {s: hash_order(s, key) for s in seeds}
            found = ends(cut(known.select(F.col(key).cast("string").alias(key)).distinct()), hashes, train, val)
            part = [split.dealt_to(hashes[s], found[s], F.lit(1), train, val) for s in seeds]
        else:  # years: few, in their own order, the same for every seed
            years = [r[0] for r in known.orderBy(key).collect()]
            n_train, n_val = split.sizes(len(years), train, val)
            named = F.when(F.col(key).isin(years[:n_train]), "train").when(F.col(key).isin(years[n_train : n_train + n_val]), "val").otherwise("test")
            part = [named for _ in seeds]
        letters += [F.when(F.col(key).isNotNull(), x) for x in part]
    letter = F.create_map(*[F.lit(x) for pair in LETTERS.items() for x in pair])
    return rows.withColumn("__code", F.concat(*[F.coalesce(letter[x], F.lit("-")) for x in letters])).drop("__id", "__nth")


def decoded(df: DataFrame, c: Columns, seeds: list[int], only: str | None = None) -> DataFrame:
    """``coded`` rows as a row per mode and seed, with columns mode, seed and split; of one part where it is named."""
    cells = [(m, s) for m in modes(c) for s in seeds]
    letters = [F.substring("__code", i + 1, 1) for i in range(len(cells))]
    kept = [x == LETTERS[only] if only else x != "-" for x in letters]
    at = F.explode(F.array(*[F.when(k, i) for i, k in enumerate(kept)]))
    name = F.create_map(*[F.lit(x) for part, letter in LETTERS.items() for x in (letter, part)])
    split_name = F.lit(only) if only else name[F.expr("substring(__code, __at + 1, 1)")]
    mode, seed = (F.array(*[F.lit(x) for x in side])[F.col("__at")] for side in zip(*cells, strict=True))
    rows = df.withColumn("__at", at).where("__at is not null")
    return rows.select(*[x for x in df.columns if x != "__code"], mode.alias("mode"), seed.alias("seed"), split_name.alias("split"))


def grid_splits(df: DataFrame, c: Columns, seeds: list[int], train: float = 0.7, val: float = 0.15) -> DataFrame:
    """``df`` once per split mode, with columns mode and parts, an array of (seed, split): every seed of every mode in one plan.

    Rows without a group or year are not in that mode. The same parts as ``all_splits`` gives.
    """
    name = F.create_map(*[F.lit(x) for part, letter in LETTERS.items() for x in (letter, part)])
    told = []
    for i, mode in enumerate(modes(c)):
        parts = [F.struct(F.lit(s).alias("seed"), name[F.substring("__code", i * len(seeds) + j + 1, 1)].alias("split")) for j, s in enumerate(seeds)]
        told.append(F.struct(F.lit(mode).alias("mode"), F.array(*parts).alias("parts")))
    each = coded(df, c, seeds, train, val).withColumn("__x", F.explode(F.array(*told)))
    return each.select(*df.columns, "__x.mode", "__x.parts").where(F.col("parts")[0]["split"].isNotNull())


def exploded(dealt: DataFrame) -> DataFrame:
    """``grid_splits`` as a row per seed, with columns seed and split."""
    columns = [x for x in dealt.columns if x != "parts"]
    return dealt.withColumn("__part", F.explode("parts")).select(*columns, "__part.seed", "__part.split")


def _narrow(df: DataFrame, c: Columns, *columns: str) -> DataFrame:
    return df.select(*dict.fromkeys([*c.identity, c.context, c.year, *columns]))


def evaluation_grid(df: DataFrame, c: Columns, p: str, thresholds: list[float], seeds: list[int]) -> tuple[DataFrame, DataFrame]:
    """Metrics of a score on the test part over split mode, seed and threshold, and the cells that have a one-class part.

    The source is read once; what the metrics read again is in the shared folder.
    """
    dealt = cut(coded(cut(_narrow(df, c, c.value, p)), c, seeds).select(c.row_id, c.value, p, "__code"))
    return audit.threshold_grid(decoded(dealt, c, seeds), ["mode", "seed"], "split", c.row_id, c.value, p, thresholds)


def experiment_matrix(df: DataFrame, c: Columns, y: str, p: str, seeds: list[int], shares: list[float]) -> DataFrame:
    """Metrics on the test part over split mode, seed and share of rows whose score is missing, all cells in one plan.

    A missing score gives way to the share of ones in the cell's train part.
    Which rows miss theirs follows from a hash of seed and row, so that a larger
    share misses those of a smaller one too.
    """
    dealt = cut(coded(cut(_narrow(df, c, y, p).where(F.col(y).isNotNull())), c, seeds).select(c.row_id, y, p, "__code"))
    prior = decoded(dealt, c, seeds, "train").groupBy("mode", "seed").agg(F.avg(F.col(y).cast("double")).alias("__prior"))
    test = joined(decoded(dealt, c, seeds, "test"), F.broadcast(prior), ["mode", "seed"])  # a row per mode and seed
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("seed").cast("string"), F.lit("missing"), F.col(c.row_id).cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    cells = test.withColumn("missing", F.explode(F.array(*[F.lit(float(s)) for s in shares]))).withColumn("__p", F.when(draw < F.col("missing"), F.col("__prior")).otherwise(F.col(p)))
    return metrics.evaluate(cells.select("mode", "seed", "missing", c.row_id, F.col(y).alias("__y"), "__p"), ["mode", "seed", "missing"], c.row_id, "__y", "__p")


def case_bundle(predictions: DataFrame, runs: DataFrame, grid: DataFrame, keys: list[str], id_col: str, n: int) -> dict[str, DataFrame]:
    """Case study tables: run summary, missing runs, cases, and counts of cases by kind. Predictions have model, y and p."""
    cases = significance.cases(predictions, keys, id_col, "model", "y", "p", n)
    summary = report.summary(runs, [*keys, "model"], ["ap", "auroc"])
    return {"summary": summary, "gaps": report.gaps(runs, grid, [*keys, "model"]), "cases": cases, "counts": cases.groupBy(*keys, "kind").agg(F.count("*").alias("n"))}


def post_process(runs: DataFrame, predictions: DataFrame, labels: dict[str, str], keys: list[str], value: str, thresholds: list[float]) -> tuple[DataFrame, DataFrame]:
    """The main table of labelled models and the threshold audit of their predictions (long: model, value, p)."""
    main = audit.main_table(runs, labels, keys, "model", "seed", ["ap", "auroc"])
    shown = predictions.where(F.col("model").isin(list(labels)))
    return main, metrics.threshold_sweep(shown, [*keys, "model"], value, "p", thresholds)


def ready_for_use(coverage: DataFrame, df: DataFrame, c: Columns, registry: DataFrame) -> DataFrame:
    """The verdict on a benchmark of ``all_splits``: cold modes must keep their entity apart."""
    return audit.verdict(coverage, overlaps(df, c), {"right_cold": "right", "context_cold": "context"}, registry)


def with_manifest(cohort: tuple[DataFrame, DataFrame], group: str) -> DataFrame:
    """A cohort's rows beside the stratum of their group."""
    rows, manifest = cohort
    return joined(rows, manifest.select(group, "stratum"), [group])


