"""Detectors on Spark ML: imputation, scaling, trees or logistic regression, and cross-fitted calibration."""

from __future__ import annotations

import json
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, RobustScaler, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import shared_folder
from . import metrics, perturb, sanitize
from .feature_batches import assemble
from .features import FEATURES

SEED, FOLDS = 42, 3


def stored(rows: DataFrame) -> DataFrame:
    """rows, computed once. What trains on them starts from files: boosting runs thousands of short jobs, and each of their tasks
    would be sent the plan of all features, as it is for rows that are only cached."""
    shared_folder(rows.sparkSession)
    return rows.checkpoint()


def _classifier(kind: str, trees: int, depth: int, step: float):
    common = {"featuresCol": "scaled", "labelCol": "label"}
    return {
        "boosted": lambda: GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=step, seed=SEED, **common),
        "forest": lambda: RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED, **common),
        "logistic": lambda: LogisticRegression(maxIter=1000, regParam=0.01, **common),
    }[kind]()


class Detector:
    """fit, predict_proba, predict, save and load over rows with feature columns.

    kinds: `boosted` (gradient-boosted trees), `forest`, `logistic`. With calibrate, each of FOLDS models is trained without a
    fold (dealt by hash of doc_id) and calibrated on it, by a logistic curve (`sigmoid`) or isotonic regression; the
    probability is the folds' mean.
    """

    def __init__(self, kind: str = "boosted", trees: int = 120, depth: int = 5, step: float = 0.05, calibrate: bool = True, method: str = "sigmoid", columns: list[str] | None = None):
        self.kind, self.trees, self.depth, self.step, self.calibrate, self.method = kind, trees, depth, step, calibrate and kind == "boosted", method
        self.columns = columns or FEATURES
        self.models: list[tuple[PipelineModel, PipelineModel | None]] = []

    def _pipeline(self) -> Pipeline:
        filled = [f"_{c}" for c in self.columns]
        scaler = StandardScaler(inputCol="packed", outputCol="scaled", withMean=True) if self.kind == "logistic" else RobustScaler(inputCol="packed", outputCol="scaled", withCentering=True, withScaling=True)
        return Pipeline(stages=[Imputer(strategy="median", inputCols=self.columns, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="packed"), scaler, _classifier(self.kind, self.trees, self.depth, self.step)])

    def _calibrator(self) -> Pipeline:
        from pyspark.ml.regression import IsotonicRegression

        if self.method == "isotonic":
            return Pipeline(stages=[IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="calibrated")])
        pack = VectorAssembler(inputCols=["margin"], outputCol="margin_v")
        return Pipeline(stages=[pack, LogisticRegression(featuresCol="margin_v", labelCol="label", probabilityCol="calibrated_v", rawPredictionCol="calibrated_r", predictionCol="calibrated_p")])

    def fit(self, rows: DataFrame) -> Detector:
        rows = rows.withColumn("label", F.col("label").cast("double"))
        if not self.calibrate:
            self.models = [(self._pipeline().fit(rows), None)]
            return self
        rows = rows.withColumn("_fold", F.pmod(F.xxhash64(F.col("doc_id"), F.lit(SEED)), F.lit(FOLDS)))

        def fold(k: int) -> tuple[PipelineModel, PipelineModel]:
            model = self._pipeline().fit(rows.filter(F.col("_fold") != k))
            out = self._margin(model.transform(rows.filter(F.col("_fold") == k))).select("margin", "label")
            return model, self._calibrator().fit(out)

        with ThreadPool(FOLDS) as pool:  # their jobs are short, so that a fold alone leaves the cores idle
            self.models = pool.map(inheritable_thread_target(rows.sparkSession)(fold), range(FOLDS))
        return self

    @staticmethod
    def _margin(out: DataFrame) -> DataFrame:
        return out.withColumn("margin", vector_to_array("rawPrediction")[1])

    def predict_proba(self, rows: DataFrame) -> DataFrame:
        """rows with ai_probability."""
        kept, names = rows.columns, []
        for k, (model, calibrator) in enumerate(self.models):
            out = model.transform(rows)
            if calibrator is None:
                p = vector_to_array("probability")[1]
            else:
                out = calibrator.transform(self._margin(out))
                p = F.col("calibrated") if self.method == "isotonic" else vector_to_array("calibrated_v")[1]
            rows = out.select(*kept, *names, p.alias(f"_p{k}"))
            names.append(f"_p{k}")
        mean = sum((F.col(n) for n in names[1:]), F.col(names[0])) / len(names)
        return rows.select(*kept, mean.alias("ai_probability"))

    def predict(self, rows: DataFrame) -> DataFrame:
        return self.predict_proba(rows).withColumn("prediction", (F.col("ai_probability") >= 0.5).cast("int"))

    def importances(self) -> list[tuple[str, float]]:
        """(feature, importance): the folds' mean, normalised, greatest first."""
        sums = [0.0] * len(self.columns)
        for model, _ in self.models:
            last = model.stages[-1]
            values = last.featureImportances if self.kind != "logistic" else [abs(x) for x in last.coefficients]
            sums = [a + float(b) for a, b in zip(sums, values, strict=True)]
        whole = sum(sums) or 1.0
        return sorted(((c, x / whole) for c, x in zip(self.columns, sums, strict=True)), key=lambda x: (-x[1], x[0]))

    def save(self, spark: SparkSession, path: str) -> None:
        for k, (model, calibrator) in enumerate(self.models):
            model.write().overwrite().save(f"{path}/model-{k}")
            if calibrator is not None:
                calibrator.write().overwrite().save(f"{path}/calibrator-{k}")
        about = {"kind": self.kind, "trees": self.trees, "depth": self.depth, "step": self.step, "calibrate": self.calibrate, "method": self.method, "columns": self.columns, "n": len(self.models)}
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Detector:
        about = json.loads(spark.read.text(f"{path}/about").first().value)
        n = about.pop("n")
        out = cls(**about)
        out.models = [(PipelineModel.load(f"{path}/model-{k}"), PipelineModel.load(f"{path}/calibrator-{k}") if out.calibrate else None) for k in range(n)]
        return out


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, label, split) of labelled documents (labels: doc_id, label), a train or test part dealt by hash of doc_id."""
    split = F.when(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(10)) < 7, "train").otherwise("test")
    return docs.select("doc_id", "text").join(labels.select("doc_id", "label"), "doc_id").withColumn("split", split)


def featured(known: DataFrame) -> DataFrame:
    """labelled()'s rows with features in place of texts."""
    return assemble(known.select("doc_id", "text")).join(known.select("doc_id", "label", "split"), "doc_id")


def labelled_features(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Features of labelled documents (labels: doc_id, label), with a train or test part dealt by hash of doc_id."""
    return featured(labelled(docs, labels))


def ablation(rows: DataFrame, trees: int = 100, depth: int = 6) -> DataFrame:
    """A forest per feature family and one of all: (subset, num_features, metrics on the test part)."""
    rows = rows.persist()
    subsets = {"stylometry": "sty", "structural": "str", "predictability": "prd", "semantic": "sem", "all": ""}
    out = None
    for name, prefix in subsets.items():
        columns = [c for c in FEATURES if c.startswith(prefix)]
        model = Detector("forest", trees, depth, columns=columns).fit(rows.filter("split = 'train'"))
        scored = model.predict_proba(rows.filter("split = 'test'")).select(F.col("label"), F.col("ai_probability").alias("score"))
        one = metrics.evaluate(scored).select(F.lit(name).alias("subset"), F.lit(len(columns)).alias("num_features"), "roc_auc", "pr_auc", "f1_binary", "accuracy", "ece")
        out = one if out is None else out.unionByName(one)
    return out


def adversarial_benchmark(docs: DataFrame, labels: DataFrame, severity: float = 0.6, kinds: tuple[str, ...] = ("zero_width", "homoglyph", "synonym", "humanizer")) -> DataFrame:
    """(model, attack, metrics): three models on clean test texts and under attacks.

    Only texts with label 1 are attacked, and only the boosted model sees sanitised texts, none of the clean ones. Features are made
    once of each different text of a document, as raw texts of other labels are the same under every attack, and sanitising undoes some
    attacks.
    """
    known = labelled(docs, labels)
    train = stored(featured(known.filter("split = 'train'")))
    tested = known.filter("split = 'test'").drop("split")
    # Other labels' texts are hidden from the attacks, which take most of the time of making variants.
    hidden = tested.withColumnRenamed("text", "whole").withColumn("text", F.when(F.col("label") == 1, F.col("whole")))
    attacked = perturb.apply_attacks(hidden, list(kinds), severity).select("doc_id", "label", "attack_type", F.coalesce("perturbed_text", "whole").alias("text"))
    varied, out = assembled_once(variants(attacked.unionByName(tested.withColumn("attack_type", F.lit("clean"))))), None
    for form, model in (("raw", Detector("logistic")), ("raw", Detector("forest", 100, 6)), ("sanitised", Detector("boosted", 120, 5))):
        kind, model = model.kind, model.fit(train)
        every = varied.filter(F.col("form") == F.when(F.col("attack") == "clean", "raw").otherwise(form)).select("attack", "label", *FEATURES)
        one = model.predict_proba(every).select(F.lit(kind).alias("model"), "attack", "label", F.col("ai_probability").alias("score"))
        out = one if out is None else out.unionByName(one)
    return metrics.evaluate(stored(out), by=["model", "attack"])


def variants(attacked: DataFrame) -> DataFrame:
    """(doc_id, label, text, uses) of apply_attacks()' rows: the different texts of a document, raw and sanitised, and where each is
    used, as an array of (attack, form)."""
    forms = F.array(F.struct(F.lit("raw").alias("form"), "text"), F.struct(F.lit("sanitised").alias("form"), F.col("clean_text").alias("text")))
    rows = sanitize.sanitize(attacked).select("doc_id", "label", "attack_type", F.explode(forms).alias("x"))
    return rows.groupBy("doc_id", "label", F.col("x.text").alias("text")).agg(F.collect_list(F.struct(F.col("attack_type").alias("attack"), F.col("x.form").alias("form"))).alias("uses"))


def assembled_once(texts: DataFrame) -> DataFrame:
    """(label, attack, form, features) of variants()' rows."""
    texts = stored(texts.withColumn("key", F.monotonically_increasing_id()))
    made = assemble(texts.select(F.col("key").alias("doc_id"), "text")).withColumnRenamed("doc_id", "key")
    made = stored(made.join(texts.select("key", "label", "uses"), "key"))
    return made.withColumn("use", F.explode("uses")).select("label", "use.attack", "use.form", *FEATURES)
