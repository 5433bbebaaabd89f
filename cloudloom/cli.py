"""Command line: info, thin, reconstruct, register, compare. Run as ``spark-submit`` or ``python -m cloudloom.cli``."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from cloudloom.operators import planes, points, registration
from cloudloom.operators.points import XYZ
from cloudloom.plans import reconstruct
from cloudloom.sources import clouds, models


def info(spark: SparkSession, path: str) -> dict:
    """Count, box and centre of a cloud, and what its header tells."""
    cloud = clouds.read_cloud(spark, path)
    known = clouds.header_facts(path)
    return points.extent(cloud).first().asDict() | {"columns": cloud.columns, "header_points": known[0], "header_colour": known[1]}


def rebuild(spark: SparkSession, path: str, out: str, scene: str, sensor: str) -> dict:
    """Surfaces of a cloud as STEP, IFC, a mesh and tables below ``out``; the report's rows."""
    found, owners, spacing = reconstruct.surfaces(clouds.read_cloud(spark, path), reconstruct.settings(scene, sensor))
    Path(out).mkdir(parents=True, exist_ok=True)
    found.write.mode("overwrite").parquet(f"{out}/surfaces")
    owners.write.mode("overwrite").parquet(f"{out}/owners")
    Path(out, "model.stp").write_text(models.step(found))
    Path(out, "model.ifc").write_text(models.ifc(found))
    table = planes.takeoff(found)
    Path(out, "report.html").write_text(models.page("Reconstruction", {"Surfaces by class": table}))
    return {"spacing": spacing, "classes": [r.asDict() for r in table.collect()]}


def compare(spark: SparkSession, old: str, new: str, aligned: bool) -> dict:
    """Changes of a newer cloud against an older one."""
    a, b = (clouds.read_cloud(spark, p).select("pid", *XYZ) for p in (old, new))
    cell = 3 * reconstruct._first_cell(a)
    changed, found = registration.compare_epochs(a, b, cell, aligned)
    facts = registration.change_statistics(changed).first().asDict()
    return facts | ({"matrix": found.matrix, "rmse": found.rmse} if found else {})


def register(spark: SparkSession, source: str, target: str, out: str) -> dict:
    """Moves a cloud onto another and writes it as text in parts."""
    a, b = (clouds.read_cloud(spark, p) for p in (source, target))
    found = registration.register(a, b.select("pid", *XYZ), 3 * reconstruct._first_cell(b))
    _write(points.transform(a, list(found.matrix)), out)
    return {"matrix": found.matrix, "rmse": found.rmse, "iterations": found.iterations, "converged": found.converged}


def thin(spark: SparkSession, path: str, size: float, out: str) -> dict:
    """One point a cell, written as text in parts."""
    kept = points.voxel_downsample(clouds.read_cloud(spark, path), size)
    _write(kept, out)
    return {"points": kept.count()}


def _write(cloud: DataFrame, out: str) -> None:
    from cloudloom.sources.writers import write_xyz

    write_xyz(cloud, out)


def main(argv: list[str] | None = None) -> dict:
    top = argparse.ArgumentParser(prog="cloudloom", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    one = sub.add_parser("info")
    one.add_argument("cloud")
    one = sub.add_parser("thin")
    one.add_argument("cloud")
    one.add_argument("out")
    one.add_argument("--size", type=float, required=True)
    one = sub.add_parser("reconstruct")
    one.add_argument("cloud")
    one.add_argument("out")
    one.add_argument("--scene", default="building", choices=sorted(reconstruct.SCENES))
    one.add_argument("--sensor", default="standard", choices=sorted(reconstruct.SENSORS))
    one = sub.add_parser("register")
    for x in ("source", "target", "out"):
        one.add_argument(x)
    one = sub.add_parser("compare")
    one.add_argument("old")
    one.add_argument("new")
    one.add_argument("--as-is", action="store_true", help="without aligning the newer cloud first")
    a = top.parse_args(argv)
    spark = SparkSession.builder.appName("cloudloom").getOrCreate()
    told = {
        "info": lambda: info(spark, a.cloud),
        "thin": lambda: thin(spark, a.cloud, a.size, a.out),
        "reconstruct": lambda: rebuild(spark, a.cloud, a.out, a.scene, a.sensor),
        "register": lambda: register(spark, a.source, a.target, a.out),
        "compare": lambda: compare(spark, a.old, a.new, not a.as_is),
    }[a.command]()
    print(json.dumps(models.plain(told)))
    return told


if __name__ == "__main__":
    main()
