"""Late-delivery classifier with ``pyspark.ml``.

Pipeline per variant: NULL categories become their own level, ``StringIndexer`` ->
``OneHotEncoder`` -> ``VectorAssembler`` with the numeric columns -> a random forest (100 trees, √features
per split, seed 42; :mod:`emporion.operators.grow`).  A level first seen in the test rows gets all zeros.
Everything is fitted on all training rows and evaluated on all test rows; trees grow in the tasks, and only
counts, the few nodes of the forest's top, the 2x2 confusion counts, the AUC and the importance vector reach
the driver.  ``pyspark.ml``'s own forest is not used: it draws its cuts from a sample of the rows and keeps every
node on the driver.

Differences from a single-machine forest, stated rather than hidden: trees are at most ``MAX_DEPTH`` deep,
continuous features are binned (``MAX_BINS``), a node whose drawn features offer no gain is a leaf, and the
80/20 split is a key hash, stratified in expectation (see :func:`emporion.operators.features.in_test`).
``max_depth`` and ``max_bins`` are parameters; ``train_rows`` bounds the forest's rows only if a caller asks for it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emporion.operators import features as H
from emporion.operators import forest as T
from emporion.operators import grow as G
from emporion.session import drop_scratch, materialize
from emporion.sources.adapter import StarSchema

NULL_LEVEL = "__null__"
MAX_DEPTH = 30
MAX_BINS = 128
# Class names of the report.
CLASS_NAMES = {0: "on_time", 1: "late"}


@dataclass(frozen=True)
class Variant:
    name: str
    table: str  # "v1" | "v2"
    categorical: tuple[str, ...]
    numeric: tuple[str, ...]
    balanced: bool


# The three model versions that are compared.
VARIANTS = {
    "v1_naive": Variant("v1: naive", "v1", tuple(H.V1_CATEGORICAL), tuple(H.V1_NUMERIC), False),
    "v1_balanced": Variant("v1: class_weight balanced", "v1", tuple(H.V1_CATEGORICAL), tuple(H.V1_NUMERIC), True),
    "v2_balanced": Variant("v2: + distance & delivery window", "v2", tuple(H.V2_CATEGORICAL), tuple(H.V2_NUMERIC), True),
}


@dataclass
class Evaluation:
    variant: Variant
    weight_median: float | None
    confusion: dict[tuple[int, int], int]
    auc: float
    importances: list[tuple[str, float]] = field(default_factory=list)
    model: PipelineModel | None = None

    # -- derived metrics (H9) -------------------------------------------------------------
    def _pr(self, c: int) -> tuple[float, float, float, int]:
        tp = self.confusion.get((c, c), 0)
        pred = sum(v for (lab, p), v in self.confusion.items() if p == c)
        support = sum(v for (lab, p), v in self.confusion.items() if lab == c)
        precision = tp / pred if pred else 0.0
        recall = tp / support if support else 0.0
        f1 = 2 * precision * recall / (precision + recall) if precision + recall else 0.0
        return precision, recall, f1, support

    def report_rows(self) -> list[tuple]:
        rows = []
        per = {c: self._pr(c) for c in CLASS_NAMES}
        total = sum(self.confusion.values())
        for c, name in CLASS_NAMES.items():
            rows.append((name, *per[c][:3], per[c][3]))
        correct = sum(v for (lab, p), v in self.confusion.items() if lab == p)
        acc = correct / total if total else 0.0
        rows.append(("accuracy", None, None, acc, total))
        macro = [sum(per[c][i] for c in per) / len(per) for i in range(3)]
        rows.append(("macro avg", *macro, total))
        weighted = [sum(per[c][i] * per[c][3] for c in per) / total if total else 0.0 for i in range(3)]
        rows.append(("weighted avg", *weighted, total))
        return rows


def _table(star: StarSchema, which: str) -> DataFrame:
    if which == "v1":
        return H.training_table_v1(star)
    return H.training_table_v2(star)


def _encoder(v: Variant) -> Pipeline:
    idx = [f"{c}__idx" for c in v.categorical]
    ohe = [f"{c}__ohe" for c in v.categorical]
    return Pipeline(stages=[
        StringIndexer(inputCols=list(v.categorical), outputCols=idx, handleInvalid="keep", stringOrderType="alphabetAsc"),
        # The indexer's slot for unseen levels is the one that the encoder drops: all zeros.
        OneHotEncoder(inputCols=idx, outputCols=ohe, handleInvalid="error", dropLast=True),
        VectorAssembler(inputCols=[*ohe, *v.numeric], outputCol="features", handleInvalid="keep"),
    ])


def _feature_names(pred: DataFrame, v: Variant) -> list[str]:
    """Slot names from the assembler's metadata, in the exported format
    ``cat__<column>_<level>`` / ``remainder__<column>``."""
    attrs = pred.schema["features"].metadata["ml_attr"]["attrs"]
    slots = sorted((a for group in attrs.values() for a in group), key=lambda a: a["idx"])
    names = []
    for a in slots:
        n = a["name"]
        for c in v.categorical:
            if n.startswith(f"{c}__ohe_"):
                n = f"cat__{c}_{n[len(c) + 6:]}"
                break
        else:
            n = f"remainder__{n}"
        names.append(n)
    return names


def prepared(star: StarSchema, which: str, seed: int = 42) -> DataFrame:
    """A variant family's table with its split, written once: every pass of training and
    evaluation reads it instead of running the joins again."""
    cols = sorted({c for v in VARIANTS.values() if v.table == which for c in (*v.categorical, *v.numeric)})
    out = _table(star, which).select("order_id", "order_item_id", *cols, F.col(H.LABEL).cast("double").alias("label"))
    return materialize(out.withColumn("test", H.in_test(seed=seed)), f"model-{which}")


def class_weights(train: DataFrame) -> dict[float, float]:
    """H7: n / (classes * rows of the class), over the training rows."""
    counts = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {label: sum(counts.values()) / (len(counts) * n) for label, n in counts.items()}


def fit(table: DataFrame, v: Variant, num_trees: int = 100, max_depth: int = MAX_DEPTH, max_bins: int = MAX_BINS,
        train_rows: int | None = None, seed: int = 42) -> tuple[float | None, DataFrame, PipelineModel]:
    """A variant's encoder and forest, fitted on all training rows of its :func:`prepared` table (the forest on
    ``train_rows`` of them, if given); with the training median of the weight and the table's test rows, filled
    in like the training rows."""
    med, data = H.fill_median(table, "product_weight_g", where=~F.col("test"))
    data = data.na.fill(NULL_LEVEL, subset=list(v.categorical))
    train, test = data.filter(~F.col("test")), data.filter(F.col("test"))
    weights = class_weights(train) if v.balanced else {}
    encoder = _encoder(v).fit(train)  # levels of all training rows, counted where they are
    if train_rows is not None:
        train = train.orderBy(F.xxhash64("order_id", "order_item_id"), "order_id", "order_item_id").limit(train_rows)
    levels = [len(x) for x in encoder.stages[0].labelsArray]
    forest = G.fit(
        encoder.transform(train), [*[f"{c}__idx" for c in v.categorical], *v.numeric], [*levels, *[None] * len(v.numeric)],
        ["order_id", "order_item_id"], "label", (weights.get(0.0, 1.0), weights.get(1.0, 1.0)), num_trees, max_depth, max_bins, seed)
    return med, test, PipelineModel([*encoder.stages, forest])


def evaluate(star: StarSchema, key: str, num_trees: int = 100, max_depth: int = MAX_DEPTH, max_bins: int = MAX_BINS,
             train_rows: int | None = None, seed: int = 42, table: DataFrame | None = None) -> Evaluation:
    """Train one variant on the 80 % split and evaluate it on the 20 % split.  ``table`` is the
    :func:`prepared` table, where several variants share one."""
    v = VARIANTS[key]
    own = table is None
    table = prepared(star, v.table, seed) if own else table
    med, test, model = fit(table, v, num_trees, max_depth, max_bins, train_rows, seed)
    forest, encoded = model.stages[-1], PipelineModel(model.stages[:-1]).transform(test)
    late, read = T.scored(forest, encoded.select("label", "features", *forest.columns))
    pred = materialize(late, "model-predictions")
    confusion, auc = confusion_counts(pred), roc_auc(pred, "p_late")
    names = _feature_names(encoded, v)  # slot names from the schema only
    imp = sorted(zip(names, forest.featureImportances.toArray().tolist()), key=lambda t: (-t[1], t[0]))
    for done in (pred, *read, *([table] if own else [])):  # nothing reads them any more
        drop_scratch(done)
    return Evaluation(v, med, confusion, auc, imp, model)


def confusion_counts(pred: DataFrame) -> dict[tuple[int, int], int]:
    """Rows per (label, prediction)."""
    rows = pred.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n")).collect()
    return {(int(r["label"]), int(r["prediction"])): r["n"] for r in rows}


def roc_auc(pred: DataFrame, score: str) -> float:
    """Exact area under the ROC curve."""
    return BinaryClassificationEvaluator(
        rawPredictionCol=score, labelCol="label", metricName="areaUnderROC", numBins=0
    ).evaluate(pred)


# ---- result tables ------------------------------------------------------------------------
def evaluation(star: StarSchema, key: str, **kw) -> Evaluation:
    """The evaluation of a variant, kept on the star object that it belongs to."""
    return evaluations(star, [key], **kw)[0]


def evaluations(star: StarSchema, keys: list[str], seed: int = 42, **kw) -> list[Evaluation]:
    """The evaluations of several variants; those of one family share its :func:`prepared` table."""
    kept = star.__dict__.setdefault("_evaluations", {})
    at = {key: (key, seed, tuple(sorted(kw.items()))) for key in keys}
    for which in dict.fromkeys(VARIANTS[key].table for key in keys):
        new = [key for key in keys if VARIANTS[key].table == which and at[key] not in kept]
        table = prepared(star, which, seed) if new else None
        for key in new:
            kept[at[key]] = evaluate(star, key, seed=seed, table=table, **kw)
        if new:
            drop_scratch(table)
    return [kept[at[key]] for key in keys]


REPORT = "class string, precision double, recall double, f1_score double, support bigint"


def split_summary(star: StarSchema, seed: int = 42) -> DataFrame:
    """H5: rows per (split, label) and the label's share of the split."""
    tagged = H.training_table_v1(star).select(F.when(H.in_test(seed=seed), "test").otherwise("train").alias("split"), H.LABEL)
    counts = tagged.groupBy("split", H.LABEL).agg(F.count(F.lit(1)).alias("rows"))
    total = F.sum("rows").over(Window.partitionBy("split"))  # over the few counted rows
    return counts.select("split", H.LABEL, "rows", F.round(F.col("rows") / total, 6).alias("share"))


def class_weight_table(star: StarSchema) -> DataFrame:
    """H7: rows and balanced weight of each class of the training split (v1 table)."""
    train = H.split(H.training_table_v1(star))[0]
    counts = train.groupBy(H.LABEL).agg(F.count(F.lit(1)).alias("rows"))
    every = Window.partitionBy()  # over the two counted rows
    weight = F.sum("rows").over(every) / (F.count(F.lit(1)).over(every) * F.col("rows"))
    return counts.select(H.LABEL, "rows", F.round(weight, 6).alias("weight"))


def median_fill(star: StarSchema) -> DataFrame:
    """Per split, the training median of the product weight, the rows it fills and the mean
    afterwards."""
    table = H.training_table_v1(star).select(F.when(H.in_test(), "test").otherwise("train").alias("split"), "product_weight_g")
    missing = table.withColumn("missing", F.col("product_weight_g").isNull())
    med, filled = H.fill_median(missing, "product_weight_g", where=F.col("split") == "train")
    return filled.groupBy("split").agg(
        F.lit(med).cast("double").alias("median"), F.count_if("missing").alias("filled"),
        F.round(F.avg("product_weight_g"), 6).alias("mean_after"),
    )


def rule_predictions(star: StarSchema, from_price: int = 50_000) -> DataFrame:
    """A fixed rule in a model's place, so that the metrics can be checked exactly: items of
    ``from_price`` and more are called late, and the price is the score."""
    test = H.split(H.training_table_v1(star))[1]
    return test.select(
        F.col(H.LABEL).cast("double").alias("label"), F.col("price").alias("score"),
        (F.col("price") >= from_price).cast("double").alias("prediction"),
    )


def rule_report(star: StarSchema) -> DataFrame:
    """H9 on the fixed rule."""
    ev = Evaluation(VARIANTS["v1_naive"], None, confusion_counts(rule_predictions(star)), 0.0)
    rows = [(r[0], *[None if x is None else round(x, 6) for x in r[1:4]], r[4]) for r in ev.report_rows()]
    return star.spark.createDataFrame(rows, REPORT)


def rule_auc(star: StarSchema) -> DataFrame:
    """H10 on the fixed rule."""
    return star.spark.createDataFrame([(round(roc_auc(rule_predictions(star), "score"), 6),)], "roc_auc double")


def _matrix(star: StarSchema, confusion: dict[tuple[int, int], int]) -> DataFrame:
    rows = [(CLASS_NAMES[a], CLASS_NAMES[p], confusion.get((a, p), 0)) for a in CLASS_NAMES for p in CLASS_NAMES]
    return star.spark.createDataFrame(rows, "actual string, predicted string, rows bigint")


def rule_confusion(star: StarSchema) -> DataFrame:
    """H11 on the fixed rule."""
    return _matrix(star, confusion_counts(rule_predictions(star)))


def classification_report(star: StarSchema, key: str = "v2_balanced") -> DataFrame:
    """H9: precision, recall, f1 and support per class, accuracy, macro / weighted mean."""
    return star.spark.createDataFrame(evaluation(star, key).report_rows(), REPORT)


def confusion_matrix(star: StarSchema, key: str = "v2_balanced") -> DataFrame:
    """Test rows per (actual, predicted) class."""
    return _matrix(star, evaluation(star, key).confusion)


def feature_importances(star: StarSchema, key: str = "v2_balanced") -> DataFrame:
    """(feature, importance), most important first."""
    return star.spark.createDataFrame(evaluation(star, key).importances, "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    )


def model_comparison(star: StarSchema) -> DataFrame:
    """H10 + H13: ROC-AUC, recall and precision of the late class, accuracy per variant."""
    rows = []
    for v, ev in zip(VARIANTS.values(), evaluations(star, list(VARIANTS))):
        prec, rec, _, _ = ev._pr(1)
        acc = next(r[3] for r in ev.report_rows() if r[0] == "accuracy")
        rows.append((v.name, round(ev.auc, 3), round(rec, 2), round(prec, 2), round(acc, 2)))
    schema = "model string, roc_auc double, recall_late double, precision_late double, accuracy double"
    return star.spark.createDataFrame(rows, schema)
