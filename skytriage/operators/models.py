"""Classifiers on representations, by Spark ML.

Spark ML has no multi-class boosted trees and no missing values: a class each gets its own boosted trees, values that
are missing go to a number below all others, and the statuses beside them tell what is missing. Probabilities are
normalized over the study's classes; a class without training rows has 0."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CLASS_IDS, BaselineConfig
from ..functions.scalars import hash_uniform, normalized
from .population import hash_rank, varying_columns
from .validate import check_boundary, check_classes

MISSING = -1e6


def _filled(c: str) -> Column:
    return F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(MISSING)), F.lit(MISSING)).alias(c)


class BaselineClassifier:
    """fit_epoch() on rows of one epoch of the biased population, then predict()."""

    def __init__(self, config: BaselineConfig = BaselineConfig()):  # noqa: B008
        self.config, self.models = config, {}

    def fit_epoch(self, train: DataFrame, epoch: float, features: list[str], label: str = "y", population: str = "BIASED") -> BaselineClassifier:
        check_classes(check_boundary(train, population), label)
        names = varying_columns(train, features) or features[:1]
        rows = VectorAssembler(inputCols=names, outputCol="features").transform(train.select(label, *map(_filled, names)))
        present = {r[0] for r in rows.select(label).distinct().collect()}
        fitted = {}
        for c in CLASS_IDS:
            if c in present and len(present) > 1:
                gbt = GBTClassifier(labelCol="hit", featuresCol="features", maxIter=self.config.rounds, maxDepth=self.config.depth, stepSize=self.config.step, seed=self.config.seed)
                fitted[c] = gbt.fit(rows.withColumn("hit", (F.col(label) == c).cast("double")))
            elif c in present:
                fitted[c] = None  # the only class
        self.models[float(epoch)] = (names, fitted)
        return self

    def predict(self, rows: DataFrame, epoch: float) -> DataFrame:
        """rows with p_<class>."""
        if float(epoch) not in self.models:
            raise KeyError(f"no model was fitted for epoch {epoch}")
        names, fitted = self.models[float(epoch)]
        out = rows.withColumns({f"_f_{c}": _filled(c) for c in names})
        out = VectorAssembler(inputCols=[f"_f_{c}" for c in names], outputCol="_features").transform(out)
        for c in CLASS_IDS:
            if fitted.get(c) is None:
                out = out.withColumn(f"_r_{c}", F.lit(1.0 if c in fitted else 0.0))
                continue
            model = fitted[c].setFeaturesCol("_features").setProbabilityCol("_p").setRawPredictionCol("_raw").setPredictionCol("_y")
            out = model.transform(out).withColumn(f"_r_{c}", vector_to_array("_p")[1]).drop("_p", "_raw", "_y")
        shares = normalized(*(F.col(f"_r_{c}") for c in CLASS_IDS))
        out = out.withColumns({f"p_{c}": x for c, x in zip(CLASS_IDS, shares, strict=True)})
        return out.drop("_features", *(f"_r_{c}" for c in CLASS_IDS), *(f"_f_{c}" for c in names))


def folds(df: DataFrame, n: int, seed: int, label: str = "y", by: tuple = ()) -> DataFrame:
    """Fold numbers by hash order inside each class (or each group by `by`), so that every fold has each class's share to one object."""
    groups = {f"_by_{k}": c if isinstance(c, Column) else F.col(c) for k, c in enumerate(by or (label,))}
    ranked = hash_rank(df.withColumns(groups), hash_uniform(seed, F.col("object_id")), tuple(groups), "fold")
    return ranked.withColumn("fold", F.pmod(F.col("fold") - 1, F.lit(n)).cast("int")).drop(*groups)
