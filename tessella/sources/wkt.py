"""The staged text format of maps, read and written with DataFrame functions.

``STAGE n``; ``OUTLINES k`` with ``OUT``, ring, ``SITECOUNT`` and ``SITE`` lines; then, by
stage, ``PARTITIONS``, ``CARTOGRAM`` and ``ASSIGNMENT``. Fields are separated by tabs,
``<NULL>`` is null, positions in the file are the keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import ASSIGNED, CELL, COLOR, DEFORMED, PARTITIONED, POINT, RING, SCHEMAS, TileMap

NULL = "<NULL>"


def text(s: Column) -> Column:
    return F.when(s != NULL, s)


def _number(s: Column, i: int, kind: str) -> Column:
    return F.get(F.split(F.trim(s), " +"), F.lit(i)).try_cast(kind)


def to_point(s: Column) -> Column:
    x, y = _number(s, 0, "double"), _number(s, 1, "double")
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y"))).cast(POINT)


def to_cell(s: Column) -> Column:
    x, y = _number(s, 0, "int"), _number(s, 1, "int")
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y"))).cast(CELL)


def to_color(s: Column) -> Column:
    c = [_number(s, i, "int") for i in range(3)]
    return F.when(c[0].isNotNull() & c[1].isNotNull() & c[2].isNotNull(), F.struct(*(v.alias(n) for v, n in zip(c, "rgb", strict=True)))).cast(COLOR)


def to_ring(s: Column) -> Column:
    return F.filter(F.transform(F.split(s, "\t"), to_point), lambda p: p.isNotNull()).cast(RING)


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """map_id (the file's name without its extension), ln and line of text files; a file is one map and so one row of text."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(\.[^./]*)?$", 1).alias("map_id"), "value")
    return files.select("map_id", F.posexplode(F.split("value", "\r?\n")).alias("ln", "line"))


def parse(lines: DataFrame) -> TileMap:
    """Maps from lines (map_id, ln, line)."""
    w = Window.partitionBy("map_id").orderBy("ln")
    c = F.col("line")
    word = F.regexp_extract(c, r"^[A-Z]+", 0)
    s = lines.withColumn("word", word).withColumn("f", F.split(c, "\t"))
    s = s.withColumn("section", F.last(F.when(F.col("word").isin("OUTLINES", "PARTITIONS", "CARTOGRAM", "ASSIGNMENT"), F.col("word")), True).over(w))
    for k in (1, 2, 3):
        s = s.withColumn(f"next{k}", F.lead("line", k).over(w))
    s = s.withColumn("out", F.sum(((F.col("word") == "OUT") & (F.col("section") == "OUTLINES")).cast("int")).over(w) - 1)

    def field(i: int) -> Column:
        return F.get("f", F.lit(i))

    def index(i: int) -> Column:
        return F.get(F.split(field(0), " "), F.lit(i)).try_cast("int")

    maps = s.groupBy("map_id").agg(F.max(F.when(F.col("word") == "STAGE", F.regexp_extract("line", r"\d+", 0).try_cast("int"))).alias("stage"), F.max(F.when(F.col("word") == "CARTOGRAM", F.substring("line", 11, 1000))).alias("grid"))
    outs = s.where("section = 'OUTLINES' and word = 'OUT'")
    outlines = outs.select("map_id", F.col("out").cast("int").alias("outline_id"), text(field(1)).alias("label"), to_point(field(2)).alias("label_pt"), to_color(field(3)).alias("color"), to_ring(F.col("next1")).alias("ring"), F.lit(-1).alias("custom_weight"))
    in_out = Window.partitionBy("map_id", "out").orderBy("ln")
    found = s.where("section = 'OUTLINES' and word = 'SITE'").withColumn("site_id", F.row_number().over(in_out) - 1)
    sites = found.select("map_id", F.col("out").cast("int").alias("outline_id"), F.col("site_id").cast("int").alias("site_id"), text(field(1)).alias("label"), to_point(field(2)).alias("p"), to_color(field(3)).alias("color"), text(field(4)).alias("layer")).select("map_id", "outline_id", "site_id", "label", F.col("p.x").alias("x"), F.col("p.y").alias("y"), "color", "layer")

    parts = s.where("section = 'PARTITIONS' and word = 'PART'").withColumn("outline_id", index(1)).withColumn("partition_id", index(2))
    partitions = parts.select("map_id", "outline_id", "partition_id", text(field(1)).alias("label"), to_point(field(2)).alias("label_pt"), to_color(field(3)).alias("color"), to_ring(F.col("next1")).alias("ring"), F.lit(-1).alias("custom_weight"))
    member = parts.select("map_id", "outline_id", "partition_id", F.explode(F.split("next2", "\t")).alias("s")).select("map_id", "outline_id", "partition_id", F.col("s").try_cast("int").alias("site_id")).where("site_id is not null")

    made = s.where("section = 'CARTOGRAM' and word = 'PART'").withColumn("outline_id", index(1)).withColumn("partition_id", index(2))
    key = ["map_id", "outline_id", "partition_id"]

    def cells_of(df: DataFrame, column: str) -> DataFrame:
        return df.select(*key, F.posexplode(F.split(column, "\t")).alias("ord", "c")).withColumn("c", to_cell(F.col("c"))).where("c is not null").select(*key, F.col("c.x").alias("x"), F.col("c.y").alias("y"), "ord")

    guided = made.where(F.size("f") > 1)
    quality = guided.select(*key, F.explode(F.split("next3", "\t")).alias("q")).select(*key, to_cell(F.substring_index("q", ";", 1)).alias("c"), F.substring_index("q", ";", -1).try_cast("double").alias("area")).where("c is not null").select(*key, F.col("c.x").alias("x"), F.col("c.y").alias("y"), "area")
    guide_cells = cells_of(guided, "next2")
    total = guide_cells.join(quality, [*key, "x", "y"]).groupBy(*key).agg(F.sum("area").alias("quality"))
    guides = guided.select(*key, field(1).try_cast("double").alias("factor"), to_point(field(2)).alias("t")).join(total, key, "left").select(*key, "factor", F.col("t.x").alias("tx"), F.col("t.y").alias("ty"), F.coalesce("quality", F.lit(0.0)).alias("quality"))

    given = s.where("section = 'ASSIGNMENT' and word = 'SITE'").select("map_id", index(1).alias("outline_id"), index(2).alias("site_id"), to_cell(field(1)).alias("cell"))
    sites = sites.join(member, ["map_id", "outline_id", "site_id"], "left").join(given, ["map_id", "outline_id", "site_id"], "left")
    order = {name: [c.split()[0] for c in _split(schema)] for name, schema in SCHEMAS.items()}
    frames = {"maps": maps, "outlines": outlines, "sites": sites, "partitions": partitions, "cells": cells_of(made, "next1"), "guides": guides, "guide_cells": guide_cells, "cell_quality": quality}
    return TileMap(**{n: df.select(*order[n]) for n, df in frames.items()})


def _split(schema: str) -> list[str]:
    """The columns of a schema string."""
    out, depth, at = [], 0, 0
    for i, ch in enumerate(schema + ","):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(schema[at:i].strip())
            at = i + 1
    return out


def read(spark: SparkSession, path: str) -> TileMap:
    return parse(file_lines(spark, path))


# writing


def _s(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(NULL))


def from_point(p: Column) -> Column:
    return F.when(p.isNull(), NULL).otherwise(F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string")))


def from_color(c: Column) -> Column:
    return F.when(c.isNull(), NULL).otherwise(F.concat_ws(" ", c["r"], c["g"], c["b"]))


def from_ring(ring: Column) -> Column:
    return F.array_join(F.transform(ring, from_point), "\t")


def lines(m: TileMap) -> DataFrame:
    """The lines of each map: map_id, key (orders them) and line."""
    out: list[DataFrame] = []

    def add(df: DataFrame, section: int, o: Column, p: Column, kind: int, line: Column) -> None:
        key = F.struct(F.lit(section).alias("s"), o.cast("int").alias("o"), F.lit(kind).alias("k"), p.cast("int").alias("p"))
        out.append(df.select("map_id", key.alias("key"), line.alias("line")))

    zero, oid, pid, sid = F.lit(-1), F.col("outline_id"), F.col("partition_id"), F.col("site_id")
    stage = m.maps.select("map_id", "stage", "grid")
    add(stage, 0, zero, zero, 0, F.concat(F.lit("STAGE "), F.col("stage")))
    n_out = m.outlines.groupBy("map_id").count()
    add(stage.join(n_out, "map_id", "left"), 1, zero, zero, 0, F.concat(F.lit("OUTLINES "), F.coalesce("count", F.lit(0)).cast("string")))
    add(m.outlines, 1, oid, zero, 0, F.concat_ws("\t", F.concat_ws(" ", F.lit("OUT"), oid), _s(F.col("label")), from_point(F.col("label_pt")), from_color(F.col("color"))))
    add(m.outlines, 1, oid, zero, 1, from_ring(F.col("ring")))
    n_sites = m.sites.groupBy("map_id", "outline_id").count()
    add(m.outlines.join(n_sites, ["map_id", "outline_id"], "left"), 1, oid, zero, 2, F.concat(F.lit("SITECOUNT "), F.coalesce("count", F.lit(0)).cast("string")))
    place = F.concat_ws(" ", F.col("x").cast("string"), F.col("y").cast("string"))
    add(m.sites, 1, oid, sid, 3, F.concat_ws("\t", F.concat_ws(" ", F.lit("SITE"), oid, sid), _s(F.col("label")), place, from_color(F.col("color")), _s(F.col("layer"))))

    at_part = m.maps.where(F.col("stage") >= PARTITIONED).select("map_id")
    parts = m.partitions.join(at_part, "map_id")
    n_parts = parts.groupBy("map_id").count()
    add(at_part.join(n_parts, "map_id", "left"), 2, zero, zero, 0, F.concat(F.lit("PARTITIONS "), F.coalesce("count", F.lit(0)).cast("string")))
    members = m.sites.where("partition_id is not null").groupBy("map_id", "outline_id", "partition_id").agg(F.array_join(F.sort_array(F.collect_list("site_id")).cast("array<string>"), "\t").alias("ids"))
    listed = parts.join(members, ["map_id", "outline_id", "partition_id"], "left")

    def block(df: DataFrame, section: int, base: int, line: Column) -> None:
        key = F.struct(F.lit(section).alias("s"), oid.cast("int").alias("o"), pid.cast("int").alias("k"), F.lit(base).alias("p"))
        out.append(df.select("map_id", key.alias("key"), line.alias("line")))

    head = F.concat_ws(" ", F.lit("PART"), oid, pid)
    block(parts, 2, 0, F.concat_ws("\t", head, _s(F.col("label")), from_point(F.col("label_pt")), from_color(F.col("color"))))
    block(parts, 2, 1, from_ring(F.col("ring")))
    block(listed, 2, 2, F.coalesce("ids", F.lit("")))

    at_cells = m.maps.where(F.col("stage") >= DEFORMED).select("map_id", "grid")
    add(at_cells, 3, zero, zero, 0, F.concat(F.lit("CARTOGRAM "), F.col("grid")))
    pk = ["map_id", "outline_id", "partition_id"]
    own = m.partitions.join(at_cells.select("map_id"), "map_id").select(*pk)

    def joined(df: DataFrame, order: list[str], value: Column) -> DataFrame:
        items = F.array_sort(F.collect_list(F.struct(*order, value.alias("v"))))
        return df.groupBy(*pk).agg(F.array_join(F.transform(items, lambda e: e["v"]), "\t").alias("items"))

    cell = F.concat_ws(" ", "x", "y")
    has = own.join(m.guides, pk)
    block(own.join(m.guides.withColumn("g", F.lit(1)), pk, "left"), 3, 0, F.when(F.col("g").isNull(), head).otherwise(F.concat_ws("\t", head, F.col("factor").cast("string"), F.concat_ws(" ", F.col("tx").cast("string"), F.col("ty").cast("string")))))
    block(own.join(joined(m.cells, ["ord", "x", "y"], cell), pk, "left"), 3, 1, F.coalesce("items", F.lit("")))
    block(has.join(joined(m.guide_cells, ["ord", "x", "y"], cell), pk, "left"), 3, 2, F.coalesce("items", F.lit("")))
    block(has.join(joined(m.cell_quality, ["x", "y"], F.concat_ws(";", cell, F.col("area").cast("string"))), pk, "left"), 3, 3, F.coalesce("items", F.lit("")))

    done = m.maps.where(F.col("stage") >= ASSIGNED).select("map_id")
    add(done, 4, zero, zero, 0, F.lit("ASSIGNMENT"))
    add(m.sites.join(done, "map_id"), 4, oid, sid, 0, F.concat_ws("\t", F.concat_ws(" ", F.lit("SITE"), oid, sid), F.when(F.col("cell").isNull(), NULL).otherwise(F.concat_ws(" ", "cell.x", "cell.y"))))
    both = out[0]
    for df in out[1:]:
        both = both.unionByName(df)
    return both


def documents(m: TileMap) -> DataFrame:
    """map_id and the text of its file."""
    item = F.struct("key", "line")
    return lines(m).groupBy("map_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda e: e["line"]), "\n").alias("value"))


def write(m: TileMap, path: str) -> None:
    """One text file per map in ``path``/map_id=…"""
    documents(m).write.partitionBy("map_id").mode("overwrite").text(path)
