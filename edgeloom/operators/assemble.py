"""Edges from raw relations: imports and implicit inheritance resolved, in the order of emission."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import extension
from ..model import EDGE_COLUMNS
from ..plans.settle import settled
from .resolve import covered_interfaces, resolve_calls, resolve_imports


def raw_edges(raw: DataFrame, files: DataFrame, packages: DataFrame) -> DataFrame:
    """Edges with `child`, before calls are resolved. raw: rows of the registry; files: (path); packages: (dir, name, ord).

    `ord` follows (family, file, section, place in the section): scripts first, then the other languages.
    """
    imports = raw.where("kind = 'import'").withColumn("key", F.struct("file", "section", "seq"))
    asked = imports.select("key", F.col("file").alias("source"), F.col("name").alias("specifier"), (F.col("family") == 0).alias("script"), extension(F.col("file")).alias("extension"))
    found = resolve_imports(asked, files.select(F.col("path").alias("file")), packages, "key")
    imports = imports.join(found, "key").drop("key", "name").withColumnRenamed("resolved", "name")

    interfaces = raw.where("kind = 'interface-method'").select("file", F.col("child").alias("iface"), F.col("name").alias("method"))
    methods = raw.where("kind = 'type-method'")
    types = methods.select("file", F.col("child").alias("type"), F.col("name").alias("method"))
    place = methods.groupBy("file", F.col("child").alias("type")).agg(F.min(F.struct("seq", "family", "line", "col")).alias("at"))
    implied = covered_interfaces(interfaces, types).join(place, ["file", "type"])
    implied = implied.select(
        "file", F.col("at.family").alias("family"), F.lit(4).alias("section"), F.col("at.seq").alias("seq"), F.lit("inherit").alias("kind"),
        F.col("iface").alias("name"), F.col("type").alias("child"), F.lit("inferred").alias("confidence"), F.col("at.line").alias("line"), F.col("at.col").alias("col"),
    )
    plain = raw.where("kind in ('definition', 'call', 'inherit', 'type-ref')")
    rows = plain.unionByName(imports.select(*plain.columns)).unionByName(implied)
    return rows.select("kind", F.col("file").alias("source"), F.col("name").alias("target"), "confidence", "file", "line", "col", "child", "family", "section", "seq")


def edges_of(rows: DataFrame) -> DataFrame:
    """Edges with calls resolved, numbered in their order. The number is a file's rank and the place in it.

    Rows and numbered rows are settled: they are read many times below, and their plans are long.
    """
    rows = settled(rows)
    order = Window.partitionBy("file").orderBy("section", "seq", "target")
    inside = rows.withColumn("n", F.row_number().over(order))
    sizes = rows.groupBy("family", "file").agg(F.count("*").alias("n_file"))
    # One row for each file, of which a scan has a bounded number (its file budget).
    before = sizes.withColumn("base", F.coalesce(F.sum("n_file").over(Window.orderBy("family", "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = inside.join(before.select("file", "base"), "file").withColumn("ord", F.col("base") + F.col("n"))
    return resolve_calls(settled(numbered.select(*EDGE_COLUMNS, "child"))).select(*EDGE_COLUMNS, "child")
