from pyspark.sql import functions as F

from tessella.durable import dealt
from tessella.operators import planar


def test_tasks_follow_rows(spark):
    df = spark.range(40).select(F.col("id").alias("o"))
    assert dealt(df, ["o"], 40, 4).rdd.getNumPartitions() == 10
    assert dealt(df, ["o"], 0).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_steps_of_faces_are_dealt_by_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(planar, "dealt", lambda df, keys, rows: seen.append(rows) or dealt(df, keys, rows, 4), raising=False)
    v = spark.createDataFrame([(g, k, float(k), float(k * k)) for g in range(3) for k in (1, 2, 3, 4)], "o int, v int, x double, y double")
    edges = spark.createDataFrame([(g, a, b) for g in range(3) for a, b in ((1, 2), (2, 3), (3, 4), (1, 3), (1, 4))], "o int, u int, v int")
    found = planar.faces(planar.half_edges(edges, v, ["o"]), ["o"])
    table = planar.face_table(found, v, ["o"])
    assert table.groupBy("outer").agg(F.count("*").alias("n")).orderBy("outer").collect() == [(False, 6), (True, 3)]
    assert seen and set(seen) == {30}


def test_lines_of_maps_are_dealt_by_sites(spark, monkeypatch):
    from tessella.plans import format_queries

    monkeypatch.setattr(format_queries, "dealt", lambda df, keys, rows, each: dealt(df, keys, rows, each // 5000))
    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    lines = spark.range(40).selectExpr("cast(id as string) as map_id", "'x' as line")
    assert format_queries._by_map(lines, spark, sf).rdd.getNumPartitions() == -(-n // 10)
