"""Registered queries against their DuckDB statements on the smallest tables.

A few keys per area by default; TERRASCOPE_ALL=1 runs every key (several minutes).
"""

import os
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as contract  # noqa: E402
from check_queries import compare  # noqa: E402
from terrascope.plans import catalog  # noqa: E402
from terrascope.plans.inputs import BASE_TABLES  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "scalar_metrics", "average_precision", "calibrate_unknown", "nearest_scan", "pose_interpolation", "trajectory_resample",
    "nearest_z_pixel", "label_projection", "depth_edge_mask", "mask_nms", "neighbour_coherence", "relevancy", "latent_cosine",
    "observation_ema", "observation_switch_stream", "stream_scan_match",
]
KEYS = [k for k, q in catalog.REGISTRY.items() if q.check and (os.environ.get("TERRASCOPE_ALL") or k in SAMPLE)]


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in BASE_TABLES:
        connection.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_check(spark, db, key):
    assert compare(contract.queries()[key](spark, FOLDER).toArrow(), db.execute(contract.oracle_sql()[key]).to_arrow_table()) == "ok"


def test_contract(spark):
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
