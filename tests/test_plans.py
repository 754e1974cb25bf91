import pytest
from pyspark.sql import functions as F

from tessella.functions.grids import grid
from tessella.operators import analyze
from tessella.plans import evaluate, pipeline
from tessella.schema import ASSIGNED, INPUT
from tessella.sources import drawings, ipe, tsv, wkt

from .fixtures import MAPS, tile_map


@pytest.fixture(scope="module")
def made(spark):
    plan = pipeline.Plan(grid="HEXAGON", productivity=10, dilation=3.0)
    return pipeline.run(tile_map(spark, "square1", "square9", "dumbbell", "pair", "archipelago"), plan)


def test_every_site_has_a_cell_of_its_own(made):
    m = made.map
    assert m.sites.where("cell is null").count() == 0
    assert m.sites.select("map_id", "cell").distinct().count() == m.sites.count() == m.cells.select("map_id", "x", "y").distinct().count()
    own = m.sites.select("map_id", "outline_id", "partition_id", "cell.x", "cell.y")
    assert own.exceptAll(m.cells.select(*own.columns)).count() == 0
    assert made.cost.where("map_id = 'square1'").first().cost == 0
    assert {s for s, _ in made.timings} == {"partition", "arrange", "assign", "combine"}


def test_components_stay_apart(made):
    g = grid("HEXAGON")
    at = {}
    for r in made.map.cells.where("map_id = 'archipelago'").collect():
        at[(r.x, r.y)] = r.outline_id
    assert all(at.get(n, o) == o for c, o in at.items() for n in g.adjacent(*c))


def test_text_round_trip(spark, made):
    rows = [(r.map_id, i, line) for r in wkt.documents(made.map).collect() for i, line in enumerate(r.value.split("\n"))]
    back = wkt.parse(spark.createDataFrame(rows, "map_id string, ln int, line string"))
    for name, df in made.map.tables().items():
        drop = [c for c in ("custom_weight", "quality") if c in df.columns]
        a, b = df.drop(*drop), back.tables()[name].drop(*drop)
        assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0, name


def test_files_round_trip(spark, made, tmp_path):
    pipeline.write_map(made.map, str(tmp_path / "out"))
    files = sorted((tmp_path / "out").glob("map_id=pair/*.txt"))
    assert files[0].read_text().startswith("STAGE 8\nOUTLINES 2\nOUT 0\tp\t")
    back = pipeline.read_map(spark, str(files[0]))
    assert back.cells.count() == 18 and back.sites.where("cell is not null").count() == 18
    pipeline.export(made.map, str(tmp_path / "x"))
    assert "FeatureCollection" in next((tmp_path / "x.geojson").glob("map_id=pair/*.txt")).read_text()
    with pytest.raises(ValueError):
        pipeline.read_map(spark, str(tmp_path / "x.bmp"))


def test_ipe_round_trip(spark, made, tmp_path):
    value = ipe.documents(made.map).where("map_id = 'pair'").first().value
    (tmp_path / "pair.ipe").write_text(value)
    back = ipe.read(spark, str(tmp_path / "pair.ipe"), 15)
    m = made.map
    assert back.maps.first().stage == ASSIGNED and back.maps.first().grid == "HEXAGON"
    for name, cols in (("cells", ["outline_id", "partition_id", "x", "y"]), ("sites", ["outline_id", "label", "partition_id", "cell"]), ("partitions", ["outline_id", "partition_id", "label"]), ("outlines", ["outline_id", "label", "color"])):
        a, b = m.tables()[name].where("map_id = 'pair'").select(*cols), back.tables()[name].select(*cols)
        assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0, name
    assert ipe.read(spark, str(tmp_path / "pair.ipe"), INPUT).maps.first().stage == INPUT


def test_drawings_escape_labels(spark, made):
    m = made.map.with_(sites=made.map.sites.where("map_id = 'square1'").withColumn("label", F.lit('a"<&>')))
    g = grid("HEXAGON")
    import json

    got = json.loads(drawings.geojson(m, g).first().value)
    ring = got["features"][0]["geometry"]["coordinates"][0]
    assert got["features"][0]["properties"]["label"] == 'a"<&>' and ring[0] == ring[-1] and len(ring) == 7
    assert 'label="a&quot;&lt;&amp;&gt;"' in drawings.svg(m, g).first().value
    assert tsv.result_lines(m).first().value.endswith('a"<&>')


def test_tolerant_reader(spark):
    lines = ["STAGE 2", "OUTLINES 1", "OUT 0\t<NULL>\t<NULL>\t<NULL>", "0 0\t1 0\t1 1", "SITECOUNT 0", "PARTITIONS 1", "PART 0 0\t<NULL>\t0.5 0.5\t<NULL>", "0 0\t1 0\t1 1", ""]
    m = wkt.parse(spark.createDataFrame([("m", i, x) for i, x in enumerate(lines)], "map_id string, ln int, line string"))
    o, p = m.outlines.first(), m.partitions.first()
    assert (o.label, o.color, o.label_pt, len(o.ring), p.label_pt.x) == (None, None, None, 3, 0.5)
    assert m.sites.count() == m.cells.count() == 0


def test_stages(spark, made):
    back = made.map.at(INPUT)
    assert back.cells.count() == 0 and back.sites.where("cell is not null or partition_id is not null").count() == 0
    with pytest.raises(ValueError, match="stage"):
        analyze.analyze(back, grid("HEXAGON"))


def test_perfect_map_scores_best(spark):
    r = pipeline.run(tile_map(spark, "square9"), pipeline.Plan(measures=[]))
    s = {x.analyzer: x for x in analyze.summarize(r.measures).collect()}
    assert r.cost.first().cost < 1e-18
    for name in ("OrthogonalOrder-5", "OrthogonalOrder-ALL", "Deformation-ALL", "Displacement-Uni", "SiteGuideFit-miss"):
        assert abs(s[name].max) < 1e-9, name
    assert s["GuidingShapeFit-countpct"].min == s["GuidingShapeFit-countpct"].max == 1.0


def test_refine_and_methods(spark):
    m = tile_map(spark, "archipelago")
    costs = {}
    for refine, method in ((None, "Agnostic"), ("Uniform-Aware", "AgglomerativeAssigned"), ("Nonuniform-Aware", "AgglomerativePartition")):
        r = pipeline.run(m, pipeline.Plan(refine=refine, combination=method))
        costs[refine] = r.cost.first().cost
        assert r.map.cells.select("x", "y").distinct().count() == 23
    assert costs["Nonuniform-Aware"] <= costs[None] + 1e-9


def test_cartogram_and_weights(spark):
    m = tile_map(spark, "pair", "archipelago")
    area = {(r.map_id, r.outline_id): r.custom_weight for r in pipeline.area_weights(m.outlines, 5, 20).collect()}
    assert (area[("archipelago", 0)], area[("archipelago", 1)]) == (20, 5)
    rand = pipeline.random_weights(m.outlines, 2, 4)
    assert {r.custom_weight for r in rand.collect()} <= {2, 3, 4} and rand.exceptAll(pipeline.random_weights(m.outlines, 2, 4)).count() == 0
    w = spark.createDataFrame([("p", 11.4), ("q", 0.1)], "key string, value double")
    pair = m.with_(**{n: df.where("map_id = 'pair'") for n, df in m.tables().items()})
    weighted = pair.with_(outlines=pipeline.table_weights(pair.outlines, w))
    done = pipeline.cartogram(weighted, "SQUARE", exact=True)
    assert {r.outline_id: r["count"] for r in done.cells.groupBy("outline_id").count().collect()} == {0: 11, 1: 1}
    with pytest.raises(Exception, match="no weight"):
        pipeline.table_weights(m.outlines, w).collect()


def test_tables_of_text(spark, tmp_path):
    (tmp_path / "w.tsv").write_text("# note\na\t1\nb\t2\na\t3\nbad\nx\ty\tz\n")
    assert {r.key: r.value for r in tsv.read_weights(spark, str(tmp_path / "w.tsv")).collect()} == {"a": 3.0, "b": 2.0}
    (tmp_path / "s.tsv").write_text("u\t1\t1\nv\t2\t2\t1\t2\t3\nw\t99\t99\n")
    inside, outside = tsv.read_sites(spark, str(tmp_path / "s.tsv"), tile_map(spark, "square9").outlines)
    assert [(r.label, r.site_id, tuple(r.color)) for r in inside.orderBy("site_id").collect()] == [("u", 0, (0, 0, 0)), ("v", 1, (1, 2, 3))]
    assert [r.label for r in outside.collect()] == ["w"]
    (tmp_path / "e.tsv").write_text("b\ta\na\tb\na\tc\n")
    assert tsv.read_adjacency(spark, str(tmp_path / "e.tsv")).count() == 2


def test_evaluation(spark, made):
    s = {r.map_id: r for r in evaluate.map_statistics(made.map).collect()}
    assert (s["archipelago"].outlines, s["archipelago"].sites, s["dumbbell"].partitions) == (4, 23, 2)
    shapes = evaluate.shape_measures(made.map).withColumn("cut_type", F.lit("COMBINED"))
    d = evaluate.compare_cut_types(shapes).where("map_id = 'dumbbell'").first()
    assert abs(d.length - 1.0) < 1e-9 and d.cuts == 1 and d.best_fatness == 1
    assert {r.outline_id: r.left for r in evaluate.row_layout(made.map).where("map_id = 'archipelago'").collect()} == {0: 0.0, 1: 6.0, 2: 8.0, 3: 10.0}
    lines = spark.createDataFrame([("total 123 ms x",), ("none",)], "l string")
    assert [r.t for r in lines.select(evaluate.parse_timing(F.col("l")).alias("t")).collect()] == [123, None]
    assert made.timing_table(spark).count() == 4
    assert set(MAPS) >= {"collinear"} or evaluate.SUITES["partition"]


def test_queries_match_sql(spark):
    """Every registered tile-map query against its SQL at the smallest size."""
    import duckdb

    from tessella.plans import format_queries, planar_queries, queries, step_queries, table_queries  # noqa: F401  the others register more

    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name, f in queries.QUERIES.items():
        a = f(spark, sf).toPandas()
        assert len(a) or name in ("alleys", "set_holes", "hole_borders"), name
        if name in queries.ORACLE_SQL:
            b = c.execute(queries.ORACLE_SQL[name]).df()
            cols = sorted(a.columns)
            assert cols == sorted(b.columns), name
            a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (a, b))
            assert len(a) == len(b) and all((a[k].fillna(-9) == b[k].fillna(-9)).all() for k in cols), name
