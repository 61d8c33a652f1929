import pytest

from tessera.errors import AnalysisError
from tessera.operators import relation
from tessera.streaming import running_aggregate, running_by_row
from tessera.types import schema_of

from .helpers import rows

AGG = [(1, 2), (1, 4), (1, 6), (3, 2)]
SCHEMA = schema_of([("g", "int"), ("v", "int")])


@pytest.mark.parametrize("op,want", [("sum", [2, 6, 12, 2]), ("min", [2, 2, 2, 2]), ("max", [2, 4, 6, 2]), ("avg", [2, 3, 4, 2]), ("count", [1, 2, 3, 1])])
def test_running_by_row(spark, op, want):
    rows_ = [(k, g, v) for k, (g, v) in enumerate(AGG)]
    df = relation(spark, rows_, schema_of([("i", "int"), ("g", "int"), ("v", "int")]))
    assert [r[-1] for r in sorted(running_by_row(df, op, "v", "g", "i").collect())] == want


def test_running_aggregate_merges_batches(spark, tmp_path):
    path = str(tmp_path / "in")
    relation(spark, AGG[:2], SCHEMA).write.parquet(path)
    q = running_aggregate(spark.readStream.schema(SCHEMA).parquet(path), "sum", "v", "g", "running_sum")
    try:
        q.processAllAvailable()
        assert rows(spark.table("running_sum")) == [(1, 6)]
        relation(spark, AGG[2:], SCHEMA).write.mode("append").parquet(path)
        q.processAllAvailable()
        assert rows(spark.table("running_sum")) == [(1, 12), (3, 2)]
    finally:
        q.stop()
    with pytest.raises(AnalysisError):
        running_aggregate(relation(spark, AGG, SCHEMA), "sum", "v", "g", "x")
