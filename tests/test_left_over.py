"""Writers leave nothing in the shared folder but their tables."""

from test_star import held

from loamgraph.operators.ingest import GraphData, records
from loamgraph.operators.segments import SegmentedIndex
from loamgraph.schema import REGISTRY
from loamgraph.service import Engine


def test_index_leaves_no_words(spark, tmp_path):
    before = held(spark)
    docs = spark.createDataFrame([(i, f"word{i} of {i % 7}") for i in range(500)], "id long, text string")
    SegmentedIndex(spark, str(tmp_path / "index"), "long", buckets=1).upsert(docs)
    assert held(spark) - before < 1000


def test_engine_leaves_no_batches(spark, tmp_path):
    before, spec = held(spark), REGISTRY.entity("project")
    e = Engine(spark, str(tmp_path / "lake"))
    e.sync.process(GraphData().add(spec, records(spark, spec, [{"url": f"u{i}", "name": f"n{i}"} for i in range(500)])))
    assert held(spark) - before < 1000
