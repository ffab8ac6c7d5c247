"""Suites of named model variants over one split table, and grids of runs.

A suite trains on ``train``, tunes on ``val`` and predicts every part but
``train``. Variants form a graph: evidence (what neighbours in the train part
say), classifiers over columns and evidence, and what is made of their
probabilities. The graph is sorted by need, one level after the other; each
level's columns are kept in the shared folder. Loops run over variants and grid
cells, whose number is fixed by the caller; all rows stay in Spark.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType

from . import fuse, metrics, retrieve
from .common import cut, joined


@dataclass(frozen=True)
class Neighbours:
    """Evidence: label statistics of the k train rows nearest by cosine of a vector column."""

    column: str
    k: int = 8


@dataclass(frozen=True)
class SetNeighbours:
    """Evidence: the same by Tanimoto similarity of a set column."""

    column: str
    k: int = 8


@dataclass(frozen=True)
class Views:
    """Evidence: label statistics of the nearest train rows in each of several vector columns, given as (view, column)."""

    columns: tuple[tuple[str, str], ...]
    k: int = 8


@dataclass(frozen=True)
class Features:
    """A calibrated classifier over array or number columns, and over evidence by its name (``name/view`` for one view of several)."""

    columns: tuple[str, ...]


@dataclass(frozen=True)
class Given:
    """The probability of a model from elsewhere, a column of the table."""

    column: str


@dataclass(frozen=True)
class Blend:
    """(1-a) of the first variant and a of the second, a by average precision on val; a given ``weight`` is taken as it is."""

    first: str
    second: str
    weight: float | None = None


@dataclass(frozen=True)
class Select:
    """The variant of highest average precision on val, the first named on ties."""

    names: tuple[str, ...]


@dataclass(frozen=True)
class Gate:
    """A classifier, fitted on val, over two variants' probabilities, their gap, evidence and masks; their tuned blend where val is too small."""

    first: str
    second: str
    evidence: tuple[str, ...] = ()
    masks: tuple[str, ...] = ()


@dataclass(frozen=True)
class Arbitrated:
    """One output (full, no_gate, no_probe, no_anchor) of conflict-aware arbitration between two variants, fitted on val; the anchor is the train part's prevalence."""

    current: str
    retrieved: str
    evidence: tuple[str, ...] = ()
    masks: tuple[str, ...] = ()
    output: str = "full"


Evidence = Neighbours | SetNeighbours | Views
Variant = Features | Given | Blend | Select | Gate | Arbitrated
Node = Evidence | Variant

#: What label summaries say of the neighbours.
STATISTICS = ("mean_label", "std_label", "mean_sim", "max_sim", "n_ones", "weighted_label")


def needs(node: Node, table: dict[str, Node]) -> list[str]:
    """Names of the table that a node is made of."""
    if isinstance(node, Features):
        named = [c.partition("/")[0] for c in node.columns]
        return [n for n in named if isinstance(table.get(n), Evidence)]
    if isinstance(node, Blend):
        return [node.first, node.second]
    if isinstance(node, Select):
        return list(node.names)
    if isinstance(node, Gate):
        return [node.first, node.second, *[e.partition("/")[0] for e in node.evidence]]
    if isinstance(node, Arbitrated):
        return [node.current, node.retrieved, *[e.partition("/")[0] for e in node.evidence]]
    return []


def levels(table: dict[str, Node]) -> list[list[str]]:
    """The names by need: each level is made of earlier ones alone; raises on unknown names and circles."""
    left, done, out = dict(table), set(), []
    for name, node in table.items():
        if missing := [n for n in needs(node, table) if n not in table]:
            raise ValueError(f"{name} needs {', '.join(missing)}")
    while left:
        ready = [n for n, node in left.items() if done.issuperset(needs(node, table))]
        if not ready:
            raise ValueError(f"a circle among {', '.join(left)}")
        out.append(ready)
        done.update(ready)
        left = {n: node for n, node in left.items() if n not in done}
    return out


def as_vector(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Adds ``features`` from number, array and vector columns (sparse ones stay sparse); null numbers count as 0."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    if any(isinstance(kinds[c], VectorUDT) for c in columns):
        parts = {f"__f{i}": F.col(c) if isinstance(kinds[c], VectorUDT) else array_to_vector(_numbers(kinds[c], c)) for i, c in enumerate(columns)}
        return VectorAssembler(inputCols=list(parts), outputCol="features").transform(df.withColumns(parts)).drop(*parts)
    return df.withColumn("features", array_to_vector(F.concat(*[_numbers(kinds[c], c) for c in columns])))


def _numbers(kind: DataType, column: str) -> Column:
    return F.col(column).cast("array<double>") if isinstance(kind, ArrayType) else F.array(F.coalesce(F.col(column).cast("double"), F.lit(0.0)))


def evidence_columns(table: dict[str, Node], name: str) -> list[str]:
    """Columns that ``with_evidence`` adds for a node, or for one of its views."""
    node, view = table[name.partition("/")[0]], name.partition("/")[2]
    if isinstance(node, Views):
        return [f"{name.partition('/')[0]}_{v}_{s}" for v, _ in node.columns if view in ("", v) for s in STATISTICS]
    return [f"{name}_{s}" for s in STATISTICS]


def with_evidence(df: DataFrame, name: str, node: Evidence, id_col: str, label: str, part: str) -> DataFrame:
    """Adds a node's columns; neighbours are looked for in the train part, never the row's own id; zeros where there are none."""
    train = df.where(F.col(part) == "train")
    # A row may stand in several parts (clean and with blanks), each a query of its own; ids are unique within a turn.
    turn = F.row_number().over(Window.partitionBy(id_col).orderBy(part))
    wanted = cut(df.dropDuplicates([id_col, part]).withColumn("__turn", turn).select(id_col, part, "__turn", *[c for _, c in (node.columns if isinstance(node, Views) else (("", node.column),))]))
    turns = wanted.agg(F.max("__turn")).first()[0] or 0
    out = df
    views = node.columns if isinstance(node, Views) else (("", node.column),)
    for view, column in views:
        found = None
        reference = train.select(id_col, label, column)
        if isinstance(node, Views) and reference.where(F.size(column) > 0).limit(2).count() < 2:
            reference = reference.limit(0)
        for t in range(1, turns + 1):
            asked = wanted.where(F.col("__turn") == t).select(id_col, part, column)
            near = retrieve.set_top_k(asked, reference, id_col, column, node.k, fill=True) if isinstance(node, SetNeighbours) else retrieve.cosine_top_k(asked.where(F.size(column) > 0), reference.where(F.size(column) > 0), id_col, column, node.k)
            told = joined(retrieve.label_summary(asked, near, train, id_col, label).withColumnRenamed("query_id", id_col), asked.select(id_col, part), [id_col])
            found = told if found is None else found.unionByName(told)
        if found is None:
            found = df.limit(0).select(id_col, part, *[F.lit(0.0).alias(s) for s in STATISTICS])
        found = cut(found)
        prefix = f"{name}_{view}_" if view else f"{name}_"
        out = joined(out, found.select(id_col, part, *[F.col(s).alias(prefix + s) for s in STATISTICS]), [id_col, part])
    return out


def run_suite(df: DataFrame, id_col: str, label: str, variants: dict[str, Node], part: str = "split", folds: int = 3, seed: int = 0) -> DataFrame:
    """id, part, label, model, p of every variant on the rows outside ``train``.

    The order of the table does not matter. A row may stand in several parts
    (test, and test with blanks), once in each. Classifiers share one dealing of
    the train part into folds.
    """
    order = levels(variants)
    column = {n: f"__v{i}" for i, n in enumerate(variants)}
    wide = df
    for name, node in variants.items():
        if isinstance(node, Evidence):
            wide = with_evidence(wide, name, node, id_col, label, part)

    def expanded(names: tuple[str, ...]) -> list[str]:
        return [c for n in names for c in (evidence_columns(variants, n) if isinstance(variants.get(n.partition("/")[0]), Evidence) else [n])]

    wide = cut(wide)
    train = wide.where(F.col(part) == "train").withColumn("label", F.col(label).cast("double"))
    dealt, folds = fuse.dealt(train, "label", [id_col], folds, seed)
    dealt = cut(dealt)
    rest = wide.where(F.col(part) != "train")
    tuned: dict[tuple[str, str], float] = {}
    arbitrations: dict[Arbitrated, DataFrame] = {}

    def val() -> DataFrame:
        return rest.where(F.col(part) == "val")

    def weight(first: str, second: str) -> float:
        if (first, second) not in tuned:
            found = fuse.blend_weight(val().select(F.lit(1).alias("__all"), label, column[first], column[second]), ["__all"], label, column[first], column[second]).first()
            tuned[first, second] = 0.5 if found is None or found["alpha"] is None else found["alpha"]
        return tuned[first, second]

    def blended(first: str, second: str, a: float):
        return (1 - a) * F.col(column[first]) + a * F.col(column[second])

    def add(name: str, node: Variant) -> DataFrame:
        if isinstance(node, Features):
            names = tuple(expanded(node.columns))
            models = fuse.fit_folds(as_vector(dealt, names).select("label", "features", "fold"), "label", folds)
            return fuse.predict_calibrated(models, as_vector(rest, names), column[name]).drop("features")
        if isinstance(node, Given):
            return rest.withColumn(column[name], F.col(node.column).cast("double"))
        if isinstance(node, Blend):
            return rest.withColumn(column[name], blended(node.first, node.second, weight(node.first, node.second) if node.weight is None else node.weight))
        if isinstance(node, Select):
            places = {column[n]: i for i, n in enumerate(node.names)}
            long = val().withColumn("__all", F.lit(1)).unpivot(["__all", label], list(places), "model", "p").withColumn("place", F.create_map(*[F.lit(x) for kv in places.items() for x in kv])[F.col("model")])
            found = fuse.best_candidate(long, ["__all"], "model", "place", label).first()
            return rest.withColumn(column[name], F.col(column[node.names[0]] if found is None or found["model"] is None else found["model"]))
        if isinstance(node, Gate):
            ready = fuse.gate_features(rest, column[node.first], column[node.second], expanded(node.evidence), list(node.masks)).withColumn("label", F.col(label).cast("double"))
            model = fuse.fit_classifier(ready.where(F.col(part) == "val").where("label is not null").select("label", "features"), "label", 0.5)
            fallback = F.lit(0.0) if model is not None else blended(node.first, node.second, weight(node.first, node.second))
            return fuse.predict(model, ready, column[name], fallback).drop("features", "label")
        key = Arbitrated(node.current, node.retrieved, node.evidence, node.masks)
        if key not in arbitrations:  # its four outputs come from one fit
            prior = dealt.agg(F.avg("label")).first()[0]
            stats, masks = expanded(node.evidence), list(node.masks)
            rows = rest.select(id_col, part, F.col(label).cast("double").alias("__y"), column[node.current], column[node.retrieved], *stats, *masks).withColumn("__anchor", F.lit(0.5 if prior is None else float(prior)))
            ready = fuse.gate_features(rows, column[node.current], column[node.retrieved], stats, masks)
            made, _ = fuse.arbitrated(ready.where((F.col(part) == "val") & F.col("__y").isNotNull()), ready, [id_col], "__anchor", "__y", column[node.current], column[node.retrieved], seed=seed, stats=stats, masks=masks)
            arbitrations[key] = cut(made.select(id_col, part, "full", "no_gate", "no_probe", "no_anchor"))
        return joined(rest, arbitrations[key].select(id_col, part, F.col(node.output).alias(column[name])), [id_col, part])

    for level in order:
        for name in level:
            if not isinstance(variants[name], Evidence):
                rest = add(name, variants[name])
        rest = cut(rest)
    predicted = {n: c for n, c in column.items() if not isinstance(variants[n], Evidence)}
    names = F.create_map(*[F.lit(x) for n, c in predicted.items() for x in (c, n)])
    return rest.unpivot([id_col, part, label], list(predicted.values()), "model", "p").withColumn("model", names[F.col("model")])


def short_suite(names: tuple[str, ...], variants: dict[str, Node]) -> dict[str, Node]:
    """The named variants and those that they are made of, in the order of the full table."""
    wanted, left = set(), list(names)
    while left:
        n = left.pop()
        if n not in wanted:
            wanted.add(n)
            left += needs(variants[n], variants)
    return {n: v for n, v in variants.items() if n in wanted}


@dataclass(frozen=True)
class Roles:
    """Columns of a suite: the joint vector; presence bits; modality vectors (view, column), the first modality first; and, where there are such, a set and a vector of fingerprint bits, encodings of the first two modalities and of the text, the probability of a model from elsewhere."""

    joint: str
    masks: tuple[str, ...]
    views: tuple[tuple[str, str], ...]
    bit_set: str | None = None
    bits: str | None = None
    first: str | None = None
    second: str | None = None
    text: str | None = None
    external: str | None = None


def standard_variants(r: Roles) -> dict[str, Node]:
    """The full table of variants, as far as the columns are there. Names and fixed weights are fixed values."""
    base, first_view = (r.joint, *r.masks), f"views/{r.views[0][0]}"
    t: dict[str, Node] = {
        "near": Neighbours(r.joint),
        "views": Views(r.views),
        "no_mask": Features((r.joint,)),
        "mask": Features(base),
        "retrieval": Features((*base, "near")),
        "multiview_retrieval": Features((*base, "views")),
        "historical_retrieval_evidence": Features(("views",)),
        "smiles_only_retrieval": Features((*base, first_view)),
        "gated_retrieval": Gate("mask", "multiview_retrieval", ("views",), r.masks),
    }
    for name, output in (("full", "full"), ("w_o_gate", "no_gate"), ("w_o_probe", "no_probe"), ("w_o_anchor", "no_anchor")):
        t[name] = Arbitrated("mask", "historical_retrieval_evidence", ("views",), r.masks, output)
    if r.first:
        t |= {"near_first": Neighbours(r.first), "pretrained_smiles_dense": Features((*base, r.first)), "pretrained_smiles_retrieval": Features((*base, r.first, "near_first"))}
    if r.text:
        t |= {"near_text": Neighbours(r.text), "pretrained_text_retrieval": Features((*base, "near_text"))}
    if r.bit_set and r.bits:
        hybrid = (*base, first_view, "near_bits")
        plus = (*hybrid, r.bits)
        t |= {
            "near_bits": SetNeighbours(r.bit_set),
            "morgan_smiles_retrieval": Features((*base, "near_bits")),
            "hybrid_smiles_retrieval": Features(hybrid),
            "hybrid_plus_morgan_bits": Features(plus),
            "hybrid_blend_avg": Blend("hybrid_smiles_retrieval", "hybrid_plus_morgan_bits", 0.5),
        }
        if r.first:
            t["hybrid_plus_pretrained_smiles"] = Features((*plus, r.first))
            t["hybrid_blend_pretrained_tuned"] = Blend("hybrid_blend_avg", "hybrid_plus_pretrained_smiles")
            t["hybrid_pretrained_val_select"] = Select(("hybrid_blend_avg", "hybrid_plus_pretrained_smiles"))
        if r.second:
            t["hybrid_plus_pretrained_sequence"] = Features((*plus, r.second))
        if r.first and r.second:
            t["hybrid_plus_pretrained_smiles_sequence"] = Features((*plus, r.first, r.second))
        if r.text:
            t["hybrid_plus_pretrained_text"] = Features((*plus, r.text))
            t["hybrid_plus_pretrained_text_tuned"] = Blend("hybrid_blend_avg", "hybrid_plus_pretrained_text")
            t["hybrid_plus_pretrained_text_retrieval"] = Features((*plus, "near_text"))
        if r.first and r.text:
            t["hybrid_plus_pretrained_smiles_text"] = Features((*plus, r.first, r.text))
            t["hybrid_plus_pretrained_smiles_text_tuned"] = Blend("hybrid_blend_avg", "hybrid_plus_pretrained_smiles_text")
            t["hybrid_plus_pretrained_smiles_text_retrieval"] = Features((*plus, r.first, "near_text"))
            t["strong_pretrained_gate"] = Gate("hybrid_blend_avg", "hybrid_plus_pretrained_smiles_text", ("near_bits", "near_text"), r.masks)
            t["gated_strong_pretrained_tuned"] = Blend("gated_retrieval", "strong_pretrained_gate")
            t["retrieval_pretrained_smiles_text_tuned"] = Blend("retrieval", "hybrid_plus_pretrained_smiles_text")
            if r.second:
                t["robust_sequence_anchor"] = Blend("gated_strong_pretrained_tuned", "hybrid_plus_pretrained_smiles_sequence", 0.35)
                t["sequence_gate_tuned"] = Gate("gated_strong_pretrained_tuned", "hybrid_plus_pretrained_smiles_sequence", ("near_bits", "near_text"), r.masks)
        if r.first and r.second:
            t["retrieval_sequence_bridge"] = Blend("gated_retrieval", "hybrid_plus_pretrained_smiles_sequence", 0.45)
    if r.external:
        best = tuple(n for n in ("hybrid_blend_avg", "hybrid_plus_pretrained_smiles_text_tuned", "multiview_retrieval") if n in t)
        t |= {"external": Given(r.external), "selected_baseline": Select(best), "interaction_probe_blend": Blend("selected_baseline", "external")}
        if "gated_strong_pretrained_tuned" in t:
            t["robust_probe_anchor"] = Blend("gated_strong_pretrained_tuned", "interaction_probe_blend", 0.45)
            t["interaction_gate_tuned"] = Blend("gated_strong_pretrained_tuned", "interaction_probe_blend")
    t["fullsuite_val_select"] = Select(tuple(n for n, v in t.items() if not isinstance(v, Evidence) and n not in ("full", "w_o_gate", "w_o_probe", "w_o_anchor")))
    return t


def direct_regression(df: DataFrame, id_col: str, value: str, columns: tuple[str, ...], neighbours: DataFrame, alphas: tuple[float, ...] = (0.1, 1.0, 10.0), part: str = "split") -> DataFrame:
    """id, part, value, model, p of a ridge regression, the neighbours' mean, and a linear fusion of both fitted on val.

    The penalty with the smallest RMSE on val is taken, the first on ties;
    ``neighbours`` has query_id and predicted, and the part's column where a row
    stands in several parts (test, and test with blanks: clean and missing side by
    side); rows without neighbours get the train mean.
    """
    rows = as_vector(df.where(F.col(value).isNotNull()).withColumn("label", F.col(value).cast("double")), columns)
    rows = cut(rows.select(*dict.fromkeys([id_col, part, value, "label", "features"])))  # read by every fit
    train, rest = rows.where(F.col(part) == "train"), rows.where(F.col(part) != "train")
    best = None
    for a in alphas:
        model = fuse.ridge(train.select("features", "label"), "label", a)
        rmse = metrics.regression(model.transform(rest.where(F.col(part) == "val")), [], "label", "prediction").first()["rmse"]
        if best is None or (rmse is not None and rmse < best[0]):
            best = (float("inf") if rmse is None else rmse, model)
    mean = train.agg(F.avg("label").alias("__mean"))
    keys = [id_col, part] if part in neighbours.columns else [id_col]
    near = cut(neighbours.withColumnRenamed("query_id", id_col).select(*keys, "predicted"))  # a search, read by the fusion's fit and by its output
    both = joined(joined(best[1].transform(rest).withColumnRenamed("prediction", "ridge"), near, keys, "left"), mean, [])
    both = as_vector(both.withColumn("neighbours", F.coalesce("predicted", "__mean")).drop("features"), ("ridge", "neighbours"))
    fusion = fuse.ridge(both.where(F.col(part) == "val").select("features", "label"), "label", 0.0)
    fused = fusion.transform(both).withColumnRenamed("prediction", "fused")
    return fused.unpivot([id_col, part, value], ["ridge", "neighbours", "fused"], "model", "p")


def run_grid(spark: SparkSession, cells: list[dict], folder: str, run: Callable[[dict], DataFrame], together: int = 4) -> DataFrame:
    """Every cell's table in one long one, with the cell's fields as columns; finished cells (a _SUCCESS file) are not run again.

    A cell is one run of an experiment: split mode, seed, share of blanked
    fields, threshold. Each is a Spark job of its own, written under ``folder``;
    ``together`` of them are submitted at a time and share the cluster.
    """
    def path(cell: dict) -> str:
        return f"{folder}/{'_'.join(f'{k}={v}' for k, v in sorted(cell.items()))}"

    def made(cell: dict) -> None:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path(cell)}/_SUCCESS")
        if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            run(cell).write.mode("overwrite").parquet(path(cell))

    with ThreadPoolExecutor(together) as pool:
        for done in [pool.submit(inheritable_thread_target(spark)(made), cell) for cell in cells]:
            done.result()
    out = None
    for cell in cells:
        part = spark.read.parquet(path(cell)).withColumns({k: F.lit(v) for k, v in cell.items()})
        out = part if out is None else out.unionByName(part)
    return out
