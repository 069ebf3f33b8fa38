"""Results and plans that only larger tables than the test data show."""

import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from heliograph.functions.pictures import hash_of, with_perceptual_hash
from heliograph.operators import components, groups as G
from heliograph.operators.components import connected_components
from heliograph.operators.journal import Journal
from heliograph.plans import registry
from heliograph.storage import Scratch


def test_byte_sizes_beyond_a_terabyte_follow_the_sql(spark, tmp_path):
    ids = [1, 600, 5_000, 16_000, 16_379, 51_282, 3_000_000]
    spark.createDataFrame([(i,) for i in ids], "doc_id long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.sql(registry.SQL["x12_format_bytes"]).fetchall())
    assert sorted(map(tuple, registry.QUERIES["x12_format_bytes"](spark, str(tmp_path)).collect())) == want


def _static_plan(df):
    """The physical plan as it is made before anything runs."""
    return df._jdf.queryExecution().sparkPlan().toString()


def test_exploded_hashes_are_not_broadcast(spark, tmp_path):
    spark.range(2000).selectExpr("id", "xxhash64(id) AS phash", "'active' AS status").write.parquet(f"{tmp_path}/photos")
    p = spark.read.parquet(f"{tmp_path}/photos")
    for threshold in (1, 6):
        assert "Broadcast" not in _static_plan(G.hamming_links(p.select("phash"), threshold))
        assert "Broadcast" not in _static_plan(G.band_neighbours(p, p.where("id % 7 = 3"), threshold))


def test_groups_are_not_broadcast(spark, tmp_path):
    spark.range(2000).selectExpr("id", "string(id div 2) AS sha256", "xxhash64(id div 4) AS phash", "id AS size_bytes", "1 AS width", "1 AS height", "'active' AS status").write.parquet(f"{tmp_path}/photos")
    found = G.derive_groups(spark.read.parquet(f"{tmp_path}/photos"))
    assert len(found.collect()) == 4000 and "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def _written_plans(monkeypatch):
    """A list that gets the plan of every table written from now on, as it is made before anything runs."""
    plans, write = [], Scratch.table
    monkeypatch.setattr(Scratch, "table", lambda self, df, name: (plans.append(_static_plan(df)), write(self, df, name))[1])
    return plans


def test_derived_groups_work_out_hashes_once_and_broadcast_nothing(spark, data, monkeypatch):
    plans = _written_plans(monkeypatch)
    plans.append(_static_plan(registry.QUERIES["a19_derived_groups"](spark, data)))
    assert sum("array_distinct" in p for p in plans) == 1 and "array_distinct" not in plans[-1]
    assert not [p for p in plans if "Broadcast" in p]


def test_a_bounded_rebuild_broadcasts_nothing(spark, data, monkeypatch):
    plans = _written_plans(monkeypatch)
    plans.append(_static_plan(registry.QUERIES["a20_bounded_rebuild"](spark, data)))
    assert len(plans) > 8 and not [p for p in plans if "Broadcast" in p]


def _largest_method(df):
    """Bytes of code in the largest method that Spark makes for the joins of ``df``; over 8,000 the JVM interprets it."""
    debug = getattr(getattr(df.sparkSession._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    made = debug.codegenStringSeq(df._jdf.queryExecution().executedPlan())
    return max(x._3().maxMethodCodeSize() for x in map(made.apply, range(made.size())) if "SortMergeJoin" in x._1())


def _joined_rows(df):
    """The most rows that a join of ``df`` has put out, by its metrics."""

    def walk(node):
        own = [node.metrics().get("numOutputRows").get().value()] if node.nodeName().endswith("Join") else []
        return max(own + [walk(node.children().apply(i)) for i in range(node.children().size())], default=0)

    return walk(df._jdf.queryExecution().executedPlan())


@pytest.fixture
def as_planned(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.enabled")


def test_joins_of_hamming_links_are_compiled(spark, tmp_path, as_planned):
    spark.range(100).selectExpr("xxhash64(id) AS phash").write.parquet(f"{tmp_path}/hashes")
    hashes = spark.read.parquet(f"{tmp_path}/hashes")
    assert max(_largest_method(G.hamming_links(hashes, t)) for t in (1, 6)) < 8000


def test_neighbours_of_copies_are_joined_once(spark, tmp_path, as_planned):
    spark.range(100).selectExpr("id", "12345L AS phash", "'active' AS status").write.parquet(f"{tmp_path}/photos")
    p = spark.read.parquet(f"{tmp_path}/photos")
    found = G.band_neighbours(p, p.where("id < 50"))
    assert len(found.collect()) == 50 * 99 and _joined_rows(found) <= 50 * 100


def test_picture_hashes_take_little_memory_for_a_batch():
    class Caught:
        """Stands for a DataFrame and hands out the function that its tasks would run."""

        schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("pixels", T.ArrayType(T.IntegerType()))])
        select = lambda self, *_: self
        mapInArrow = lambda self, run, _: run

    pixels = np.random.default_rng(1).integers(0, 256, (10_000, 1024), np.int32)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(10_001, dtype=np.int32) * 1024), pa.array(pixels.ravel()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000), pa.int64()), lists], ["id", "pixels"])
    run = with_perceptual_hash(Caught())
    tracemalloc.start()
    got = next(run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.column(1).to_pylist() == hash_of(pixels.reshape(-1, 32, 32)).tolist()
    assert peak < 64 << 20


def test_a_run_reads_photos_once_whatever_the_jobs(spark, tmp_path):
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    rows = [(i, f"/a/{i:03}", "active" if i % 10 else "missing") for i in range(100)]
    photos = spark.createDataFrame(rows, "id long, path string, status string").mapInArrow(seen, "id long, path string, status string")
    journal = Journal(spark, f"file://{tmp_path}/journal", size=5)
    journal.plan(spark.createDataFrame([(i, f"/a/{i:03}", f"/b/{i:03}", 1) for i in range(100)], "id long, src string, dest string, size_bytes long"))
    assert journal.run(photos, together=2, stop_after=1) == 1 and journal.done() == [0]
    assert journal.run(photos, together=2) == 9 and journal.run(photos, together=2) == 0
    found = {r.id: r.error for r in journal.outcome().collect()}
    assert len(found) == 100 and {i for i, e in found.items() if e} == set(range(0, 100, 10))
    assert reads.value <= 200


@pytest.mark.parametrize("few", [0, components.FEW_EDGES])
def test_rounds_of_components_have_few_tasks_whatever_the_shuffle_partitions(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW_EDGES", few)
    edges = [(i, i + 1) for i in range(100, 108)] + [(500, 500 + k) for k in range(1, 50)]
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    spark.sparkContext.setJobGroup(f"components {few}", "")
    try:
        got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {**{i: 100 for i in range(100, 109)}, **{500 + k: 500 for k in range(50)}}
    known = spark.sparkContext.statusTracker()
    stages = [known.getStageInfo(s) for j in known.getJobIdsForGroup(f"components {few}") for s in known.getJobInfo(j).stageIds]
    wide = sum(s.numCompletedTasks >= 40 for s in stages if s)
    assert len(stages) > 10 and wide <= 4, (len(stages), wide)  # only where the number of edges isn't known yet, and the result
