"""Named queries, each with the statement that checks it where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from terrascope.plans.inputs import Inputs, oracle_text, shaped


@dataclass(frozen=True)
class Query:
    key: str
    shape: str
    build: Callable[[Inputs], DataFrame]
    check: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        return shaped(self.build(Inputs(spark, folder)), self.shape)


REGISTRY: dict[str, Query] = {}


def query(key: str, shape: str, check: str | None = None) -> Callable:
    def wrap(build: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        if key in REGISTRY:
            raise ValueError(f"query registered twice: {key}")
        REGISTRY[key] = Query(key, shape, build, oracle_text(check, shape) if check else None)
        return build

    return wrap
