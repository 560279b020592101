"""Files, layers and training by hand: formats, wrong files, empty neighbourhoods, numbers that overflow."""

import math

import numpy as np
import pytest

from graphmill.operators import graph as G
from graphmill.operators import layers as L
from graphmill.operators import training as T
from graphmill.sources import files
from graphmill.streaming.cache import run_to_table, stream_trace


def test_npy(spark, tmp_path):
    data = np.arange(14, dtype=np.int32).reshape(7, 2)
    for name, array, across in (("rows.npy", data, False), ("columns.npy", np.ascontiguousarray(data.T), True)):
        np.save(tmp_path / name, array)
        got = files.edges_of(files.read_npy(spark, str(tmp_path / name), across)).collect()
        assert sorted(map(tuple, got)) == [(i, *row) for i, row in enumerate(data.tolist())]
    np.save(tmp_path / "fortran.npy", np.asfortranarray(np.ones((3, 3))))
    np.save(tmp_path / "words.npy", np.array(["a"]))
    for name in ("fortran.npy", "words.npy"):
        with pytest.raises(ValueError):
            files.read_header(str(tmp_path / name))
    with pytest.raises(ValueError):
        files.mounted("hdfs://x/y")
    np.save(tmp_path / "empty.npy", np.zeros((0, 2)))
    assert files.read_npy(spark, str(tmp_path / "empty.npy")).count() == 0


def test_npy_parts(spark, tmp_path):
    rows = spark.range(250).selectExpr("id as row", "array(id * 2, id * 3) as values")
    assert files.write_npy(rows, str(tmp_path / "out"), "int64", bytes_a_part=1600) == 250 and len(files.parts_of(str(tmp_path / "out"))) == 3
    assert sorted(r.values[1] for r in files.read_npy(spark, str(tmp_path / "out")).collect() if r.row != r.values[0] // 2) == []
    assert files.read_npy(spark, str(tmp_path / "out")).count() == 250


def test_npy_filters_leave_slices_out(spark, tmp_path):
    size = 64 << 10
    data = np.random.default_rng(0).standard_normal((300, 1024)).astype(np.float32)  # 16 rows a slice
    np.save(tmp_path / "wide.npy", data)
    whole = files.read_npy(spark, str(tmp_path / "wide.npy"), bytes_a_task=size)
    some = whole.where("row >= 40 and row < 72")
    assert whole.rdd.getNumPartitions() == 19 and some.rdd.getNumPartitions() == 2
    got = {r.row: r["values"] for r in some.collect()}
    assert sorted(got) == list(range(40, 72)) and all(np.array_equal(np.array(v, np.float32), data[k]) for k, v in got.items())
    assert [r.row for r in whole.where("row = 299").collect()] == [299] and whole.where("row > 298 and row < 3").count() == 0 and whole.where("row in (1, 250)").count() == 2
    reader = files.NpyReader(str(tmp_path / "wide.npy"), False, size)
    part = reader.partitions()[0]
    assert (part.last - part.first) * 1024 * 4 <= 64 << 10
    assert files.write_npy(whole, str(tmp_path / "again"), "float32", bytes_a_part=size) == 300
    assert len(files.parts_of(str(tmp_path / "again"))) == 19 and files.read_npy(spark, str(tmp_path / "again")).where("row = 170").first()["values"] == data[170].astype(float).tolist()


def test_csc_readers_open_their_blocks(spark, tmp_path):
    r = np.random.default_rng(1)
    edges = [(k, int(a), int(b)) for k, (a, b) in enumerate(zip(r.integers(0, 400, 3000), np.where(r.random(3000) < 0.5, 17, r.integers(0, 390, 3000)), strict=True))]
    frame = spark.createDataFrame(edges, "edge_id long, src long, dst long")
    files.write_csc(G.adjacency(frame), G.indptr(frame, spark.range(400).withColumnRenamed("id", "node_id")), str(tmp_path / "g"), blocks=20, least=1)
    wanted = spark.createDataFrame([(17,), (5,), (333,), (399,), (17,)], "node_id long")
    got = files.in_edges(spark, str(tmp_path / "g"), wanted)
    seen = {}
    for k, s, d in edges:
        seen.setdefault(d, []).append((k, s))
    assert sorted(map(tuple, got.collect())) == sorted((k, s, d, p) for d in (5, 17, 333) for p, (k, s) in enumerate(seen.get(d, [])))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "block" in plan[plan.index("PartitionFilters") :]
    opened = files.read_csc(spark, str(tmp_path / "g"))[1].where(L.F.col("block").isin(0, 16, 19)).select(L.F.input_file_name()).distinct().count()
    assert opened < files.read_csc(spark, str(tmp_path / "g"))[1].select(L.F.input_file_name()).distinct().count() / 3
    broken = spark.read.parquet(str(tmp_path / "g/indptr")).withColumn("last", L.F.col("first"))
    broken.write.partitionBy("block").parquet(str(tmp_path / "h/indptr"))
    for name in ("indices", "meta"):
        spark.read.parquet(str(tmp_path / "g" / name)).write.parquet(str(tmp_path / "h" / name), partitionBy="block" if name == "indices" else None)
    with pytest.raises(Exception, match="outside"):
        files.in_edges(spark, str(tmp_path / "h"), wanted).collect()


def test_softmax_of_large_numbers(spark):
    row = spark.createDataFrame([([1000.0, 1001.0],)], "h array<double>").select(L.softmax("h").alias("a"), L.log_softmax("h").alias("b"), L.dropout("h", 0.0, L.F.lit(1)).alias("c")).first()
    assert row.a[1] == pytest.approx(1 / (1 + math.exp(-1))) and row.b[1] == pytest.approx(math.log(row.a[1])) and row.c == [1000.0, 1001.0]
    shares = [x for r in spark.range(300).select(L.dropout(L.F.array_repeat(L.F.lit(1.0), 10), 0.2, L.F.col("id")).alias("d")).collect() for x in r.d]
    assert set(shares) == {0.0, 1.25} and 0.15 < shares.count(0.0) / len(shares) < 0.25


def test_attention_without_neighbours_and_large_scores(spark):
    h = spark.createDataFrame([(0, [1.0, 2.0]), (1, [500.0, -900.0]), (2, [3.0, 1.0])], "node_id long, h array<double>")
    edges = spark.createDataFrame([(0, 2), (1, 2)], "src long, dst long")
    w, a = np.eye(2) * 10, np.ones((2, 1)) * 50
    got = {r.node_id: r.h for r in L.gat_layer(edges, h, w, a, a, np.array([0.5, 0.25])).collect()}
    assert got[0] == got[1] == [0.5, 0.25] and got[2] == pytest.approx([5000.5, 20.25])
    mean = {r.node_id: r.h for r in L.sage_layer(edges, h, np.zeros((2, 2)), np.eye(2), np.zeros(2)).collect()}
    assert mean[0] == [0.0, 0.0] and mean[2] == pytest.approx([250.5, -449.0])


def test_training_learns(spark):
    r = np.random.default_rng(1)
    centres = np.eye(3, 4) * 6
    rows = [((centres[k % 3] + r.standard_normal(4)).tolist(), k % 3) for k in range(300)]
    frame = spark.createDataFrame(rows, "x array<double>, label int")
    (w, b), losses = T.train(frame, 4, 3, epochs=12, rate=0.2)
    assert losses[-1] < 0.5 * losses[0]
    guess = (np.array([x for x, _ in rows]) @ w + b).argmax(1)
    assert (guess == [y for _, y in rows]).mean() > 0.9
    gw, _, loss, n = T.gradient(frame, w, b)  # against differences
    step = np.zeros_like(w)
    step[1, 2] = 1e-5
    assert n == 300 and gw[1, 2] == pytest.approx((T.gradient(frame, w + step, b)[2] - T.gradient(frame, w - step, b)[2]) / 2e-5, rel=1e-4)
    assert T.train(frame.limit(0), 4, 3)[1] == []


def test_stream_of_several_micro_batches(spark, tmp_path):
    rows = spark.range(400).selectExpr("id as step", "pmod(id * 37 + id div 9, 50) as node_id", "pmod(pmod(id * 37 + id div 9, 50), 4) as owner")
    want = {r.step: r.hit for r in G.cache_trace(rows, 4, 3).collect()}
    for k in range(4):
        rows.where(f"step div 100 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    assert {r.step: r.hit for r in run_to_table(stream_trace(stream, 4, 3)).collect()} == want


def test_residents_restore_the_cache(spark):
    rows = spark.range(300).selectExpr("id as step", "pmod(id * 17 + id div 7, 40) as node_id", "0L as owner")
    whole = {r.step: r.hit for r in G.cache_trace(rows, 2, 3).collect()}
    first = G.cache_trace(rows.where("step < 150"), 2, 3)
    second = G.cache_trace(rows.where("step >= 150"), 2, 3, state=G.resident_lines(first, 3))
    assert {r.step: r.hit for r in first.unionByName(second).collect()} == whole


def test_npy_parts_are_written_as_rows_come(spark, tmp_path):
    """Several batches a part, rows in any order, both layouts; a gap in the numbers raises."""
    rows = spark.range(100).selectExpr("99 - id as row", "array(id, id * id, 7) as values").repartition(5)
    want = np.array([[99 - r, (99 - r) ** 2, 7] for r in range(100)])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "6")
    try:
        for across in (False, True):
            out = str(tmp_path / f"out-{across}")
            assert files.write_npy(rows, out, "int64", across, bytes_a_part=24 * 40) == 100
            parts = [np.load(name) for name, _ in files.parts_of(out)]
            assert [base for _, base in files.parts_of(out)] == [0, 40, 80]
            assert np.array_equal(np.concatenate([p.T if across else p for p in parts]), want)
        with pytest.raises(Exception, match="without gaps|are missing"):
            files.write_npy(rows.where("row <> 50"), str(tmp_path / "gap"), "int64")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert files.write_npy(rows.limit(0), str(tmp_path / "none"), "int64") == 0
