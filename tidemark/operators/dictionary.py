"""The dictionary of features: what each column of a matrix means, kept beside the columns and written as a table."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession

from tidemark.operators.validation import require_no_outcomes, schema_differences

TABLE = "name string, timeframe string, family string, unit string, description string, dtype string"


@dataclass(frozen=True)
class Feature:
    name: str
    timeframe: str
    family: str
    unit: str
    description: str
    expression: Column | None = None


class FeatureDictionary:
    """Features in the order of their registration. A name that comes twice, or that looks ahead, is an error."""

    def __init__(self, features: Iterable[Feature] = ()) -> None:
        self._features: dict[str, Feature] = {}
        self.extend(features)

    def register(self, feature: Feature) -> Feature:
        if feature.name in self._features:
            raise ValueError(f"feature {feature.name} is registered twice")
        require_no_outcomes([feature.name], "features")
        self._features[feature.name] = feature
        return feature

    def extend(self, features: Iterable[Feature]) -> None:
        for feature in features:
            self.register(feature)

    @property
    def names(self) -> list[str]:
        return list(self._features)

    def select(self, df: DataFrame, keys: list[str], dtype: str = "float") -> DataFrame:
        """keys and every feature as `dtype`: one projection, whatever their number."""
        column = lambda f: f.expression if f.expression is not None else df[f.name]
        return df.select(*keys, *(column(f).cast(dtype).alias(f.name) for f in self._features.values()))

    def table(self, spark: SparkSession, dtype: str = "float") -> DataFrame:
        rows = [(f.name, f.timeframe, f.family, f.unit, f.description, dtype) for f in self._features.values()]
        return spark.createDataFrame(rows, TABLE)

    def check(self, df: DataFrame, keys: list[str]) -> None:
        """The matrix holds exactly the documented columns beside its keys."""
        found = schema_differences([c for c in df.columns if c not in keys], self.names)
        if any(found.values()):
            raise ValueError(f"matrix and dictionary differ: {found}")
