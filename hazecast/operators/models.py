"""Model families, per-horizon training loop and model registry (M1–M6,
M9, M10, M12, S7, S12–S14).

One feature table is built once for all horizons (labels for every K are
columns of the same window pass) and persisted with ``checkpoint()`` in the
shared checkpoint folder; each horizon then fits a Spark ML ``Pipeline`` on
its slice.  The loop over horizons runs on the driver, the fits on the
executors.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazecast.functions.numeric import decode_target, strategy_label
from hazecast.operators import features as FT
from hazecast.operators import trees
from hazecast.operators.clean import complete, drop_incomplete, split_label
from hazecast.operators.selection import MIN_KEEP, Slice, prune_slices
from hazecast.session import SharedFolder

MIN_TRAIN_ROWS = 200
TASK_ROWS = 1 << 17            # training rows of one task of a fit
TREES_A_FILE = 3               # boosted trees between two checkpoints of a fit of one task
GROWN_ROWS = 1 << 21           # training rows that a task which grows trees may hold
ROWS_AT_ONCE = 1 << 22         # training rows of the horizons that are fitted at the same time
MIN_IMPORTANCE = 0.003
SEED = 42


# ---------------------------------------------------------------------------
# Hyper-parameters of the three model families by horizon.  A
# horizon takes the first band (first hour, last hour, values) that holds it.
# ---------------------------------------------------------------------------

ANY = (0, 1 << 30)
BANDS = {
    "gbt": (("maxIter", "maxDepth", "stepSize", "subsamplingRate", "minInstancesPerNode"), [
        (1, 1, (300, 5, 0.03, 0.75, 10)),
        (2, 6, (250, 5, 0.03, 0.75, 8)),
        (7, 22, (200, 5, 0.05, 0.75, 10)),
        (25, 25, (150, 5, 0.05, 0.75, 10)),
        (*ANY, (150, 5, 0.05, 0.75, 8))]),
    "rf": (("numTrees", "maxDepth", "minInstancesPerNode", "subsamplingRate"), [
        (1, 1, (300, 8, 10, 0.8)),
        (2, 6, (250, 7, 8, 0.8)),
        (7, 22, (200, 7, 10, 0.75)),
        (25, 25, (150, 6, 10, 0.75)),
        (*ANY, (150, 6, 8, 0.75))]),
    "linear": (("regParam", "elasticNetParam"), [
        (1, 8, (0.01, 0.0)),
        (9, 24, (0.05, 0.5)),
        (*ANY, (0.1, 0.5))]),
}
COMMON = {"gbt": {"featureSubsetStrategy": "sqrt"}, "rf": {"featureSubsetStrategy": "sqrt"}, "linear": {"maxIter": 200}}


def params_of(family: str, k: int) -> dict:
    """Hyper-parameters of a family for horizon ``k``."""
    names, bands = BANDS[family]
    values = next(v for first, last, v in bands if first <= k <= last)
    return dict(zip(names, values)) | COMMON[family]


# validation cut-offs differ per family in the reference notebooks
DEFAULT_CUTOFFS = {"gbt": ("2025-08-01", "2025-11-01"),
                   "rf": ("2025-07-01", "2025-11-01"),
                   "linear": ("2025-07-01", "2025-11-01")}


def scaled_budget(params: dict, scale: float) -> dict:
    """Scale the number of trees / iterations (smoke runs); 1.0 = as given."""
    out = dict(params)
    for k in ("maxIter", "numTrees"):
        if k in out:
            out[k] = max(2, int(round(out[k] * scale)))
    return out


def pipeline(family: str, features, params: dict, handle_invalid: str = "skip") -> Pipeline:
    """M1 + M2 + M3/M4/M5: assembler (+ scaler for linear) + regressor.  A forest
    keeps the node that every row has reached in each tree: a level goes on from
    there instead of walking down from the root, and the trees are the same."""
    stages = [VectorAssembler(inputCols=list(features), outputCol="features_raw"
                              if family == "linear" else "features", handleInvalid=handle_invalid)]
    if family == "linear":
        stages.append(StandardScaler(inputCol="features_raw", outputCol="features",
                                     withMean=True, withStd=True))
        reg = LinearRegression(featuresCol="features", labelCol="label", **params)
    elif family == "gbt":
        reg = GBTRegressor(featuresCol="features", labelCol="label", seed=SEED, **params)
    elif family == "rf":
        reg = RandomForestRegressor(featuresCol="features", labelCol="label", seed=SEED, cacheNodeIds=True, **params)
    else:
        raise ValueError(family)
    return Pipeline(stages=stages + [reg])


def decode(pred: DataFrame) -> DataFrame:
    """Prediction back to concentration, label back to the raw value."""
    return (pred.withColumn("prediction", decode_target("prediction"))
            .withColumn("label", F.col("label_raw")))


def persist_shared(df: DataFrame) -> DataFrame:
    """Cut lineage into the shared checkpoint folder (survives executor loss)."""
    return df.checkpoint(eager=True)


@dataclass
class HorizonResult:
    k: int
    features: list
    model: PipelineModel
    metrics: dict = field(default_factory=dict)


def horizon_slice(feat: DataFrame, k: int, cutoffs: tuple[str, str]) -> tuple[DataFrame, list[str]]:
    """Complete rows of one horizon (P6) with their split (P9), and its features."""
    hk = FT.horizon_frame(feat, k)
    names = [c for c in FT.horizon_features(k) if c in hk.columns]
    hk = drop_incomplete(hk, names + ["label", "label_raw"])
    return hk.withColumn("split", split_label(*cutoffs)), names


def horizon_columns(feat: DataFrame, k: int) -> dict[str, str]:
    """Catalogue name -> column of the feature table, for the features of
    horizon ``k`` that the table has."""
    at_k = {n: f"{n}__k{k}" for n in ("label", "label_raw", "pm25_lagK", *FT.weather_at_k())}
    own = {n: at_k.get(n, n) for n in FT.horizon_features(k)}
    return {n: c for n, c in own.items() if c in feat.columns or n == "horizon_norm"}


def training_slice(feat: DataFrame, k: int, cutoffs: tuple[str, str]) -> Slice:
    """The complete training rows of one horizon (P6, P9) as a mask over the
    table of all horizons."""
    own = horizon_columns(feat, k)
    needed = [c for n, c in own.items() if n != "horizon_norm"] + [f"label__k{k}", f"label_raw__k{k}"]
    return Slice(complete(needed) & (split_label(*cutoffs) == "train"), own, f"label__k{k}")


def prune_horizons(feat: DataFrame, horizons, cutoffs: tuple[str, str], min_train_rows: int = MIN_TRAIN_ROWS,
                   pruned: dict | None = None) -> list[tuple]:
    """(K, feature, kept, passed_target) of M7/M8 for every feature of every
    horizon, all horizons in one job; those with too few training rows are
    skipped (P15).  ``pruned`` (K -> outcome) keeps what is known already."""
    pruned = {} if pruned is None else pruned
    missing = [k for k in horizons if k not in pruned]
    if missing:
        # horizon_norm is constant within a horizon, so any constant ranks alike
        table = feat.withColumn("horizon_norm", F.lit(1.0))
        pruned.update(prune_slices(table, {k: training_slice(feat, k, cutoffs) for k in missing}, min_train_rows))
    return [(k, n, n in pruned[k][0], n in pruned[k][1]["stage1"])
            for k in horizons if k in pruned for n in horizon_columns(feat, k)]


def select_by_importance(names: list[str], importances, least: float = MIN_IMPORTANCE, fewest: int = MIN_KEEP) -> list[str]:
    """M9: the features of at least that importance; all, if few reach it."""
    strong = [n for n, v in zip(names, importances) if v >= least]
    return strong if len(strong) >= fewest else list(names)


def fit(train: DataFrame, names: list[str], family: str, params: dict) -> PipelineModel:
    """A fitted pipeline."""
    return started(train, names, family, params)[1]()


def started(train: DataFrame, names: list[str], family: str, params: dict) -> tuple[Callable[[], np.ndarray], Callable[[], PipelineModel]]:
    """A fit of which the feature importances can be asked, and the pipeline.  The regressor reads assembled rows from a checkpoint:
    a tree family runs thousands of small jobs, and every one of their tasks
    carries its input's lineage, which is then a file.  Its partitions follow the
    rows, not the files or shuffles before it: every task of a tree fit starts,
    and sends its own statistics of all open nodes.  Boosted trees grow in one task,
    and those of a forest whose rows are several partitions in tasks of some trees
    each (``operators.trees``), unless the rows are too many for a task's memory.
    Where jobs grow boosted trees, their tasks carry the trees since the last
    checkpoint of the errors: with few rows that costs more than writing the errors,
    with many it does not."""
    *before, regressor = pipeline(family, names, params).getStages()
    head = Pipeline(stages=before).fit(train)
    n = train.count()
    tasks = -(-max(n, 1) // TASK_ROWS)
    data = persist_shared(head.transform(train).select("features", "label").coalesce(tasks))
    if family == "gbt" and tasks == 1:
        regressor.setCheckpointInterval(TREES_A_FILE)
    grow = {"gbt": trees.grow_boosted, "rf": trees.grow_forest if tasks > 1 and params.get("numTrees", 0) > 1 else None}.get(family)
    if grow and n <= GROWN_ROWS and trees.grows(regressor):
        spark, p = train.sparkSession, len(names)
        path = grow(regressor, data, p)
        return (lambda: trees.importances(regressor, spark, path, p),
                lambda: PipelineModel(stages=[*head.stages, trees.model_of(regressor, spark, path, p)]))
    model = PipelineModel(stages=[*head.stages, regressor.fit(data)])
    return lambda: model.stages[-1].featureImportances.toArray(), lambda: model


def fit_selected(train: DataFrame, names: list[str], family: str, params: dict, by_importance: bool) -> tuple[PipelineModel, list[str]]:
    """A fitted pipeline and its features: tree families drop what their first
    fit hardly used and are fitted again on the rest (M9)."""
    importances, model = started(train, names, family, params)
    if by_importance and family != "linear":
        strong = select_by_importance(names, importances())
        if strong != names:
            return fit(train, strong, family, params), strong
    return model(), names


def train_horizon(feat: DataFrame, k: int, family: str, cutoffs: tuple[str, str], names: list[str],
                  budget: float = 1.0, prune_importance: bool = True,
                  store: ModelStore | None = None) -> HorizonResult:
    """One horizon with the features that pruning left: its model is read from
    ``store`` if a run before has left it there, else fitted and put there."""
    hk, _ = horizon_slice(feat, k, cutoffs)
    params = scaled_budget(params_of(family, k), budget)
    want = {"family": family, "k": k, "params": params, "names": names, "cutoffs": cutoffs, "importance": prune_importance}
    found = store.get(want) if store else None
    if found is None:
        # read by the fit and the fit after selection
        train = hk.where(F.col("split") == "train").select(*names, "label").persist(StorageLevel.MEMORY_AND_DISK)
        try:
            model, chosen = fit_selected(train, names, family, params, prune_importance)
        finally:
            train.unpersist()
        found = store.put(want, model, chosen) if store else (model, chosen)
    model, chosen = found
    return HorizonResult(k, chosen, model, {"split_frame": hk})


def horizons_at_once(rows: int, horizons: int) -> int:
    """How many fits of so many rows share the executors' memory: a tree family
    holds a row's count in every tree.  Two at least, so that one computes while
    the other waits for the driver."""
    return max(1, min(horizons, max(2, ROWS_AT_ONCE // max(rows, 1))))


def train_horizons(feat: DataFrame, horizons=FT.HORIZONS, family: str = "gbt",
                   cutoffs: tuple[str, str] | None = None, budget: float = 1.0,
                   prune_corr: bool = True, prune_importance: bool = True,
                   min_train_rows: int = MIN_TRAIN_ROWS, parallel: int | None = None,
                   pruned: dict | None = None, store: ModelStore | None = None) -> list[HorizonResult]:
    """All horizons over one shared (checkpointed) feature table.

    Pruning is one job for all horizons; its outcome (``pruned``, K -> result) does
    not depend on the family and is shared.  The fits are independent and wait
    mostly for the driver between small jobs, so all of them run at once from
    driver threads, in a fair pool each, as far as their training rows, which
    they hold in memory, are few (``horizons_at_once``) or ``parallel`` says;
    boosted fits that are a task each (``fit``) wait for a free core.  With
    a ``store`` every fitted horizon is kept as it ends: a run that was stopped
    resumes.  Horizons with too few training rows are skipped (P15)."""
    cut = cutoffs or DEFAULT_CUTOFFS[family]
    horizons = list(horizons)
    if prune_corr:
        pruned = {} if pruned is None else pruned
        prune_horizons(feat, horizons, cut, min_train_rows, pruned)
        names = {k: pruned[k][0] for k in horizons if k in pruned}
    else:
        counts = feat.agg(*[F.count_if(training_slice(feat, k, cut).mask) for k in horizons]).first()
        names = {k: list(horizon_columns(feat, k)) for k, n in zip(horizons, counts) if n >= min_train_rows}

    def one(k):
        feat.sparkSession.sparkContext.setLocalProperty("spark.scheduler.pool", f"{family}-{k}")
        return train_horizon(feat, k, family, cut, names[k], budget, prune_importance, store)
    if not names:
        return []
    # the longest fits (near horizons, most trees) begin first
    rows = feat.where(split_label(*cut) == "train").count()
    workers = parallel or (len(names) if family == "gbt" and rows <= GROWN_ROWS else horizons_at_once(rows, len(names)))
    with ThreadPoolExecutor(max_workers=workers) as ex:
        return list(ex.map(one, sorted(names)))


def evaluate(results: list[HorizonResult], spark: SparkSession) -> DataFrame:
    """Per K rmse on train/val/test, gap = val − train, r2 on test – all
    splits and horizons in one grouped aggregate per model."""
    from hazecast.operators.evaluate import metrics_by_split
    frames = []
    for r in results:
        pred = decode(r.model.transform(r.metrics["split_frame"]))
        frames.append(pred.select(F.lit(r.k).alias("K"), F.lit(len(r.features)).alias("n_features"),
                                  "split", "label", "prediction"))
    if not frames:
        schema = "K int, n_features int, rmse_train double, rmse_val double, gap double, " \
                 "rmse_test double, r2_test double"
        return spark.createDataFrame([], schema)
    u = frames[0]
    for f in frames[1:]:
        u = u.unionByName(f)
    return metrics_by_split(u)


# ---------------------------------------------------------------------------
# kept models
# ---------------------------------------------------------------------------


REGISTRY_SCHEMA = T.StructType([
    T.StructField("K", T.IntegerType()), T.StructField("family", T.StringType()),
    T.StructField("n_features", T.IntegerType()),
    T.StructField("features", T.ArrayType(T.StringType())),
])


def fingerprint(df: DataFrame) -> str:
    """Stands for the rows of a table in any order."""
    row = df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
    return f"{sorted(df.columns)} {row[0]} {row[1]}"


class ModelStore:
    """Fitted horizons by what they were fitted from: a model is written aside
    and renamed into place when whole, so a reader finds it complete or not at
    all, and two writers of the same one do no harm."""

    def __init__(self, spark: SparkSession, base: str, source: str):
        """``source`` stands for the training table: models of another are not
        found."""
        self.folder, self.spark, self.source = SharedFolder(spark, base), spark, source

    def _name(self, want: dict) -> str:
        told = json.dumps(want | {"source": self.source}, sort_keys=True, default=list)
        return f"{want['family']}_k{want['k']}_{hashlib.sha256(told.encode()).hexdigest()[:24]}"

    def get(self, want: dict) -> tuple[PipelineModel, list[str]] | None:
        name = self._name(want)
        if not self.folder.has(name):
            return None
        path = f"{self.folder.path}/{name}"
        names = self.spark.read.text(f"{path}/features").first()[0]
        return PipelineModel.load(f"{path}/model"), json.loads(names)

    def put(self, want: dict, model: PipelineModel, names: list[str]) -> tuple[PipelineModel, list[str]]:
        name, aside = self._name(want), f"_writing-{uuid.uuid4().hex}"
        path = f"{self.folder.path}/{aside}"
        model.write().save(f"{path}/model")
        self.spark.createDataFrame([(json.dumps(names),)], "value string").coalesce(1).write.text(f"{path}/features")
        if not self.folder.has(name):
            self.folder.rename(aside, name)
        return model, names


def registry_rows(results: list[HorizonResult], family: str) -> list[tuple]:
    """{K, strategy, n_features, features} sidecar as rows."""
    return [(r.k, family, len(r.features), list(r.features)) for r in results]


def save_models(spark: SparkSession, results: list[HorizonResult], family: str, base: str) -> DataFrame:
    """S12 + S14: save a new version of a family: every full ``PipelineModel``
    (assembler and scaler included) under ``{base}/{family}/v{version}/k{K}``, then
    the registry table, then the version's name among the published ones, which
    is the one step that readers see.  Earlier versions stay as they are."""
    folder = SharedFolder(spark, f"{base}/{family}")
    version = 1 + max((int(n) for n in folder.names("claimed")), default=0)
    while not folder.claim(f"claimed/{version}"):
        version += 1
    path = f"{folder.path}/v{version}"
    for r in results:
        r.model.write().save(f"{path}/k{r.k}")
    reg = spark.createDataFrame(registry_rows(results, family), REGISTRY_SCHEMA)
    reg = reg.withColumns({"strategy": strategy_label("K"), "version": F.lit(version)})
    reg.write.parquet(f"{path}/registry")
    folder.claim(f"published/{version}")
    return reg


def versions(spark: SparkSession, base: str, family: str) -> list[int]:
    """Published versions of a family, oldest first."""
    return sorted(int(n) for n in SharedFolder(spark, f"{base}/{family}").names("published"))


def load_models(spark: SparkSession, base: str, family: str, version: int | None = None) -> dict[int, tuple[PipelineModel, list]]:
    """S7 + S13: registry scan and model load, of the newest published version
    or a given one; none: no models."""
    known = versions(spark, base, family)
    if version is None and not known:
        return {}
    path = f"{base}/{family}/v{known[-1] if version is None else version}"
    reg = spark.read.parquet(f"{path}/registry").select("K", "features").collect()
    return {int(r["K"]): (PipelineModel.load(f"{path}/k{r['K']}"), list(r["features"])) for r in reg}
