import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("OMP_NUM_THREADS", "1")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


ENTITY = "id long, source_model_id int, global_id string, step_id int, ifc_class string, canonical_json string, import_timestamp timestamp_ntz"


@pytest.fixture
def entities(spark):
    """Makes an entity table from (id, class, record) with model 1; extra columns with clashing names come along."""
    import json

    def make(rows, model=1):
        data = [(i, model, f"g{i}", i * 10, c, r if isinstance(r, str) or r is None else json.dumps(r, ensure_ascii=False), None) for i, c, r in rows]
        df = spark.createDataFrame(data, ENTITY)
        for extra in ("value", "name", "key", "entity_id", "col", "n", "path", "node_id", "j"):
            df = df.selectExpr("*", f"'clash' as {extra}")
        return df

    return make
