"""Command line: python -m cellgrove list | query | crop | merge | zones | label | evaluate | prepare | restore | quality | gate."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import queries, queries_files, queries_tables
from .config import GRID_RESOLUTION
from .functions.scalar import suffix_code
from .operators import matching, points
from .operators.grid import Grid
from .plans import annotation, candidates, guard, results, stages
from .sources import las, sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cellgrove")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of the queries")
    c = sub.add_parser("query", help="run a query over a folder of tables")
    c.add_argument("name")
    c.add_argument("tables")
    c.add_argument("--out", help="a new folder for the result as Parquet; else its first rows are shown")
    c = sub.add_parser("crop", help="cut a rectangle out of LAS files, under their own scale")
    c.add_argument("las")
    c.add_argument("out")
    c.add_argument("bounds", nargs=4, type=float, metavar=("X0", "Y0", "X1", "Y1"))
    c = sub.add_parser("merge", help="put the classes of edited parts (name_class.las) back into their tile")
    c.add_argument("tile")
    c.add_argument("parts", nargs="+")
    c.add_argument("--out", required=True)
    c = sub.add_parser("zones", help="write the zone map of LAS files")
    c.add_argument("las")
    c.add_argument("out")
    c.add_argument("--run", type=int, default=65_536, help="records of a run")
    c = sub.add_parser("label", help="the stages from points to labels: terrain, statistics, fusion, transfer")
    c.add_argument("las")
    c.add_argument("out", help="a new folder for the labelled points as Parquet")
    c.add_argument("--resolution", type=float, default=GRID_RESOLUTION)
    c.add_argument("--no-ground-filter", action="store_true")
    c = sub.add_parser("evaluate", help="IoU of predicted against reviewed LAS files")
    c.add_argument("--gt", required=True)
    c.add_argument("--pred", required=True)
    c = sub.add_parser("prepare", help="a copy of a tile for annotation, and its manifest")
    c.add_argument("tile")
    c.add_argument("out")
    c.add_argument("manifest")
    c = sub.add_parser("restore", help="labels of an edited copy back on the tile's own points")
    c.add_argument("tile")
    c.add_argument("edited")
    c.add_argument("manifest")
    c.add_argument("out")
    c = sub.add_parser("quality", help="the data-quality tables of a rectangle, as CSV")
    c.add_argument("las")
    c.add_argument("out")
    c.add_argument("bounds", nargs=4, type=float, metavar=("X0", "Y0", "X1", "Y1"))
    c = sub.add_parser("gate", help="open the final gate once and take stock of the candidates")
    c.add_argument("root")
    c.add_argument("protocol", help='JSON: {"regions": [{"id", "source_candidate", "scoring_bounds"}, ...]}')
    c.add_argument("folder")
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    every = queries.queries() | queries_tables.queries() | queries_files.queries()
    if a.command == "list":
        print("\n".join(sorted(every)))
        return
    spark = SparkSession.builder.appName(f"cellgrove {a.command}").getOrCreate()
    las.register(spark)
    if a.command == "query":
        out = every[a.name](spark, a.tables)
        out.write.mode("errorifexists").parquet(a.out) if a.out else out.show(truncate=False)
    elif a.command == "crop":
        las.write_subset(points.crop(spark.read.format("las").load(a.las), tuple(a.bounds), require=True), a.las, a.out)
    elif a.command == "merge":
        codes = {r.name: r.code for r in spark.createDataFrame([(n,) for n in a.parts], "name string").select("name", suffix_code(F.col("name")).alias("code")).collect()}
        if missing := [n for n, code in codes.items() if code is None]:
            raise SystemExit(f"no class in the names {missing}")
        read = lambda n: spark.read.format("las").load(n)
        by_code: dict = {}
        for n, code in codes.items():
            by_code[code] = by_code[code].unionByName(read(n)) if code in by_code else read(n)
        merged = matching.merge_parts(read(a.tile), {code: d.withColumnRenamed("tile_index", "orig_index") if "tile_index" in d.columns else d for code, d in by_code.items()})
        las.write_subset(merged, a.tile, a.out)
    elif a.command == "zones":
        las.write_zones(spark, a.las, a.out, a.run)
    elif a.command == "label":
        d = spark.read.format("las").load(a.las)
        stages.label(d, Grid.of_points(d, a.resolution), filter_ground=not a.no_ground_filter).write.mode("errorifexists").parquet(a.out)
    elif a.command == "evaluate":
        stages.evaluate(*(spark.read.format("las").load(n).withColumn("ordinal", F.col("orig_index")) for n in (a.gt, a.pred))).orderBy("code").show()
    elif a.command == "prepare":
        prepared, record = annotation.prepare(spark.read.format("las").load(a.tile))
        las.write_subset(prepared.withColumn("tile_index", F.col("tile_index").cast("int")).drop("orig_index"), a.tile, a.out)
        sinks.create_json(a.manifest, record | {"tile": {p: sinks.sha256_file(p) for p in las.paths_of(a.tile)}})
    elif a.command == "restore":
        with open(a.manifest) as f:
            record = json.load(f)
        for p, digest in record["tile"].items():
            guard.locked(p, digest, p)
        prepared, _ = annotation.prepare(spark.read.format("las").load(a.tile))
        restored = annotation.restore(prepared, spark.read.format("las").load(a.edited).drop("orig_index"), record)
        las.write_subset(restored.drop("tile_index").withColumnRenamed("orig_index", "source_index"), a.tile, a.out)
    elif a.command == "quality":
        d = spark.read.format("las").load(a.las)
        d = d if "hag" in d.columns else d.withColumn("hag", F.lit(None).cast("float"))
        results.write(annotation.quality_report(d, tuple(a.bounds)), a.out)
    else:
        with open(a.protocol) as f:
            regions = json.load(f)["regions"]
        chosen = [candidates.Candidate.of(r["id"], r["source_candidate"], r["scoring_bounds"]) for r in regions]
        print(json.dumps(candidates.final_gate(spark, guard.Gate(a.folder), a.root, chosen, {"protocol": sinks.sha256_file(a.protocol)}), indent=2))


if __name__ == "__main__":
    main()
