"""Payment and login models: Spark ML estimators, calibrated by isotonic regression on a later part of time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .reports import model_quality

#: Features of each model, and the bounds of a calibrated p.
PAYMENT = ("log_amount", "amount_to_median_30d", "txn_count_1h", "txn_sum_24h_paise", "minutes_since_payee_added", "payee_fan_in_24h", "payee_passthrough_24h", "payee_sum_24h_paise", "near_limit_count_24h")
LOGIN = ("device_first_seen", "asn_first_seen", "km_from_home", "hour_deviation", "failed_logins_1h")
BOUNDS = (1e-4, 1 - 1e-4)


@dataclass
class Scorer:
    features: tuple[str, ...]
    model: Model
    calibration: Model

    def raw(self, rows: DataFrame) -> DataFrame:
        return raw(self.model, rows, self.features)

    def scored(self, rows: DataFrame) -> DataFrame:
        """``rows`` with p: the calibrated probability."""
        out = self.calibration.transform(self.raw(rows))
        return out.withColumn("p", F.greatest(F.lit(BOUNDS[0]), F.least(F.lit(BOUNDS[1]), F.col("calibrated")))).drop("raw", "calibrated")


def vectors(rows: DataFrame, features: tuple[str, ...]) -> DataFrame:
    typed = rows.withColumns({f"f_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features})
    return VectorAssembler(inputCols=[f"f_{c}" for c in features], outputCol="vector").transform(typed).drop(*[f"f_{c}" for c in features])


def raw(model: Model, rows: DataFrame, features: tuple[str, ...]) -> DataFrame:
    out = model.transform(vectors(rows, features))
    return out.withColumn("raw", vector_to_array("probability")[1]).drop("vector", "rawPrediction", "probability", "prediction")


def balanced(rows: DataFrame, label: str, domain: str | None = None) -> DataFrame:
    """``rows`` with ``weight``: within a domain both labels weigh the same, and domains do."""
    keys = [label, *([domain] if domain else [])]
    n = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    return rows.join(F.broadcast(n), keys).withColumn("weight", 1 / F.col("n")).drop("n")


def fitted(train: DataFrame, calibrate: DataFrame, features: tuple[str, ...], label: str = "y", trees: bool = False, domain: str | None = None) -> Scorer:
    """A model of ``label`` (0 or 1) from ``train``, calibrated on ``calibrate``; both are read by Spark alone."""
    rows = vectors(balanced(train, label, domain), features)
    scale = rows.count()
    rows = rows.withColumn("weight", F.col("weight") * scale)
    kind = GBTClassifier(maxIter=20, maxDepth=4, seed=7) if trees else LogisticRegression(maxIter=200)
    model = kind.setFeaturesCol("vector").setLabelCol(label).setWeightCol("weight").fit(rows)
    calibration = IsotonicRegression(featuresCol="raw", labelCol=label, predictionCol="calibrated").fit(raw(model, calibrate, features))
    return Scorer(features, model, calibration)


def report(scorer: Scorer, test: DataFrame, label: str = "y", domain: str | None = None) -> DataFrame:
    """n, positives, pr_auc, roc_auc and ece on ``test``, for all of it or by domain."""
    part = F.col(domain) if domain else F.lit("all")
    return model_quality(scorer.scored(test).select(part.alias("part"), "p", F.col(label).alias("y")), "part")
