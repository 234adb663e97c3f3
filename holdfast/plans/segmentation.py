"""Fitted segmentation: power transform, k-means, 2-D projection and segment names."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.feature import PCA, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame

from holdfast import schema as S
from holdfast.operators import kmeans, segments
from holdfast.operators.power import fit_power
from holdfast.session import written

FEATURES = "segment_features"
TEMPORARY = (FEATURES, "_plane", *[f"pt__{c}" for c in S.SEGMENT_INPUTS])


def fit_transform(df: DataFrame, columns: Sequence[str] = S.SEGMENT_INPUTS) -> PipelineModel:
    power = fit_power(df, columns)
    return PipelineModel([power.stage(), VectorAssembler(inputCols=_power_names(columns), outputCol=FEATURES)])


def _power_names(columns: Sequence[str]) -> list[str]:
    return [f"pt__{c}" for c in columns]


@dataclass
class FittedSegments:
    """A saved pipeline: it assigns cluster, plane coordinates and segment name. Centres are those of the fit."""

    model: PipelineModel
    cost: float
    centres: np.ndarray | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df).drop(*TEMPORARY)

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    @staticmethod
    def load(path: str) -> FittedSegments:
        return FittedSegments(PipelineModel.load(path), float("nan"))


def fit_segments(df: DataFrame, k: int = 4, n_init: int = 10, seed: int = 42) -> FittedSegments:
    """Fit on rows with the seven clustering inputs and the four naming columns.

    Inputs have unit variance after the power transform. The clusters are those of the best of ``n_init`` starts.
    """
    rows = df.select(*dict.fromkeys([*S.SEGMENT_INPUTS, "Churn_Numeric"])).persist(StorageLevel.MEMORY_AND_DISK)
    prepare = fit_transform(rows)
    ready = prepare.transform(rows)
    names = _power_names(S.SEGMENT_INPUTS)
    points = written(kmeans.packed(kmeans.weighted_points(ready, names)), "points")
    found = kmeans.fit_all(points, [k], n_init, seed)[k]
    nearest = SQLTransformer(statement=f"select *, {kmeans.nearest_sql(names, found.centres)} as cluster from __THIS__")
    plane = PCA(k=2, inputCol=FEATURES, outputCol="_plane").fit(ready)
    profile = segments.cluster_profile(nearest.transform(ready))
    named = segments.name_clusters(profile).collect()  # k rows
    cases = " ".join(f"when {r.cluster} then '{r.customer_segment}'" for r in named)
    parts = SQLTransformer(statement=f"select *, case cluster {cases} end as customer_segment from __THIS__")
    rows.unpersist()
    model = PipelineModel([*prepare.stages, nearest, plane, parts])
    return FittedSegments(model, found.cost, found.centres)


def with_plane(df: DataFrame) -> DataFrame:
    """The projected vector as columns ``pca1`` and ``pca2``."""
    at = vector_to_array("_plane")
    return df.withColumns({"pca1": at[0], "pca2": at[1]})


def segment_rows(fitted: FittedSegments, df: DataFrame) -> DataFrame:
    """Rows with cluster, segment name and plane coordinates."""
    return with_plane(fitted.model.transform(df)).drop(*TEMPORARY)


def choose_k(
    df: DataFrame, ks: Sequence[int] = range(2, 11), n_init: int = 10, seed: int = 42, silhouette_up_to: int = 8
) -> DataFrame:
    """(k, inertia, silhouette): the best of ``n_init`` starts for each k; all of them share their passes."""
    rows = df.select(*S.SEGMENT_INPUTS).persist(StorageLevel.MEMORY_AND_DISK)
    names = _power_names(S.SEGMENT_INPUTS)
    # files: a kept table has as many partitions as a shuffle, and each pass a task for each
    points = written(kmeans.packed(kmeans.weighted_points(fit_transform(rows).transform(rows), names)), "points")
    fits = kmeans.fit_all(points, list(ks), n_init, seed)
    scores = kmeans.silhouettes(points, {k: f.centres for k, f in fits.items() if k <= silhouette_up_to})
    rows.unpersist()
    found = [(k, float(f.cost), scores.get(k)) for k, f in fits.items()]
    return df.sparkSession.createDataFrame(found, "k int, inertia double, silhouette double")
