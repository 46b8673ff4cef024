import numpy as np
from pyspark.sql import functions as F

from lattica import streaming
from lattica.plans import loops, programs
from lattica.sources import generators, sinks


def test_heat_and_poisson(spark):
    m = generators.cartesian(spark, (4, 1), (4.0, 1.0))
    cells = m["cell"].select("uid", F.when(F.col("uid") == 0, 8.0).otherwise(0.0).alias("t"))
    got = [r.t for r in programs.heat(cells, m["cell_node"], None, 1).orderBy("uid").collect()]
    node = [8, 4, 0, 0, 0]
    assert got == [(node[i] + node[i + 1]) / 2 for i in range(4)]
    hot = m["node"].filter("x = 0").select("uid", F.lit(100.0).alias("value"), F.lit(0).alias("turn"))
    out, n = programs.poisson(cells.withColumn("t", F.lit(0.0)), m["cell_node"], hot, tolerance=5.0, most=12)
    v = [r.t for r in out.orderBy("uid").collect()]
    assert n > 1 and v == sorted(v, reverse=True) and 0 < v[-1] < v[0] < 100


def test_sod_conserves(spark):
    hydro, walls = programs.sod_case(spark, 6, 1, 1)
    total = lambda: hydro.cell.agg(F.sum("mass"), F.sum(F.col("mass") * F.col("energy")), F.sum("volume")).first()
    before = total()
    hydro.step(1e-3, walls)
    dt = hydro.time_step(1e-3)
    hydro.step(dt, walls)
    after = total()
    assert 0 < dt <= 1.1e-3 and abs(after[0] - before[0]) < 1e-14 and abs(after[2] - before[2]) < 1e-12
    moved = hydro.node.filter("vx > 0").count()
    assert moved > 0 and abs(after[1] - before[1]) < 1e-2 * before[1]


def test_stencil_keeps_the_sum(spark):
    grid = spark.range(12).select((F.col("id") % 4).alias("i"), F.floor(F.col("id") / 4).alias("j"), F.col("id").cast("double").alias("v"))
    out = programs.stencil(grid, (4, 3), 2)
    assert abs(out.agg(F.sum("v")).first()[0] - 66) < 1e-9 and out.count() == 12


def test_time_loop(spark, tmp_path):
    seen = []
    step = lambda loop, s: {"x": s["x"].select((F.col("id") + 1).alias("id"))}
    loop = loops.TimeLoop({"x": spark.range(3)}, dt=0.5, final_time=3.0, keep_every=2)
    loop.add("compute", "step", step).add("compute", "out", loops.every(2, lambda lo, s: seen.append(lo.iteration)))
    loop.start()
    assert loop.run(4) is None and seen == [2, 4]
    store = sinks.Checkpoints(spark, str(tmp_path / "c"))
    loop.checkpoint(store)
    assert loop.go_back(1) == 2 and loop.state["x"].agg(F.min("id")).first()[0] == 2
    loop.restart(store)
    assert loop.iteration == 4 and loop.run() == "final time" and loop.iteration == 6
    assert sorted(r.id for r in loop.state["x"].collect()) == [6, 7, 8]
    assert set(loop.timings) == {"step", "out"}


def test_balance_rule():
    moved = []
    f = loops.balance(1, 0.5, lambda lo, s: [1.0, 1.2], lambda lo, s: moved.append(1) or s)
    loop = loops.TimeLoop({})
    f(loop, {})
    loops.balance(1, 0.1, lambda lo, s: [1.0, 1.2], lambda lo, s: moved.append(2) or s)(loop, {})
    assert moved == [2]


def _events(spark, path, part, rows):
    spark.createDataFrame(rows, "name string, iteration long, seq long, value double").coalesce(1).write.mode("append").parquet(path)


def test_stream_last_wins_and_restart(spark, tmp_path):
    src, out, chk = (str(tmp_path / d) for d in ("src", "out", "chk"))
    _events(spark, src, 0, [("a", 1, 1, 1.0), ("a", 1, 3, 3.0), ("b", 1, 1, 9.0)])
    run = lambda: streaming.each_batch(streaming.read_events(spark, src, 10, "name string, iteration long, seq long, value double"), streaming.upsert_into(out, ["name", "iteration"], "seq"), chk).awaitTermination(120)
    assert run()
    _events(spark, src, 1, [("a", 1, 2, 2.0), ("b", 1, 5, 5.0)])
    assert run()
    got = {(r.name, r.seq): r.value for r in streaming.current(spark, out, 1).collect()}
    assert got == {("a", 3): 3.0, ("b", 5): 5.0}


def test_stateful_last_wins(spark, tmp_path):
    src = str(tmp_path / "s")
    _events(spark, src, 0, [("a", 1, 1, 1.0), ("a", 1, 3, 3.0), ("b", 2, 1, 9.0)])
    s = streaming.last_wins(streaming.read_events(spark, src, 10, "name string, iteration long, seq long, value double"))
    q = s.writeStream.outputMode("update").format("memory").queryName("lastwins").option("checkpointLocation", str(tmp_path / "k")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted((r.name, r.value) for r in spark.sql("select * from lastwins").collect()) == [("a", 3.0), ("b", 9.0)]


def test_stream_periods_equal_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 {i % 24:02d}:30:00", i % 3, "abc"[i % 3], float(i), None) for i in range(48)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.to_timestamp("ts"))
    df.repartition(3).write.parquet(str(tmp_path / "e"))
    q = streaming.periods(streaming.read_events(spark, str(tmp_path / "e"), 1)).writeStream.outputMode("complete").format("memory").queryName("periods").option("checkpointLocation", str(tmp_path / "k")).trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    got = sorted(map(tuple, spark.sql("select * from periods").collect()))
    want = sorted(map(tuple, df.groupBy(F.window("ts", "6 hours").start.alias("bucket"), F.col("event_type").alias("name")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).collect()))
    assert got == want and len(np.unique([g[1] for g in got])) == 3
