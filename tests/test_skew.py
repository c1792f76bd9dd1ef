"""The same checks with a third of all rows on one key, joins shuffled or broadcast."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as driver
from tests.parity import connect, rows_of_duck, rows_of_spark

SOURCE = "/root/testdata/sf0.001"
HOT = {
    "lineitem": {"l_orderkey": 4, "l_partkey": 55},
    "orders": {"o_custkey": 11},
    "events": {"user_id": 52},
    "documents": {"source": "src1", "text": "one. and\n  the same. text"},
}
QUERIES = [
    "daily_sales", "dashboard_daily", "document_context", "embedding_topk", "etl_rosters",
    "explode_items", "hourly_wages", "member_spend", "role_gate", "role_gate_refused",
    "top_products", "venue_dimension",
]


@pytest.fixture(scope="module")
def hot_dir(tmp_path_factory):
    out = tmp_path_factory.mktemp("hot")
    for name in ("region nation customer supplier part orders lineitem events documents embeddings "
                 "pages benchmark labels conversations").split():  # fmt: skip
        table = pq.read_table(f"{SOURCE}/{name}.parquet")
        hot = np.arange(table.num_rows) % 3 == 0
        changes = dict(HOT.get(name, {}))
        if name == "embeddings":
            changes["embedding"] = table.column("embedding")[9].as_py()
        for column, value in changes.items():
            at = table.schema.get_field_index(column)
            field = table.schema.field(at)
            old = table.column(at).to_pylist()
            new = [value if h else o for o, h in zip(old, hot, strict=True)]
            table = table.set_column(at, field, pa.array(new, field.type))
        pq.write_table(table, out / f"{name}.parquet")
    return str(out)


@pytest.fixture(params=["broadcast", "shuffle"])
def joins(spark, request):
    """Shuffled joins with limits so low that the skew handling sets in."""
    low = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
    }
    if request.param == "shuffle":
        for key, value in low.items():
            spark.conf.set(key, value)
    yield request.param
    for key in low:
        spark.conf.unset(key)


@pytest.mark.parametrize("name", QUERIES)
def test_hot_keys(spark, hot_dir, joins, name):
    frame = driver.queries()[name](spark, hot_dir)
    ours = rows_of_spark(frame)
    assert ours
    assert ours == rows_of_duck(connect(hot_dir), driver.oracle_sql()[name], frame.columns)
