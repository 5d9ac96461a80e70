"""Command line: ``python -m verdatrace.cli demo|run|epochs|survey|catalogues|config-template``."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

VERSION = "0.1.0"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="verdatrace", description="Raster time-series analytics on Spark")
    p.add_argument("--version", action="version", version=VERSION)
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, help: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=help)
        c.add_argument("--master", default=None, help="Spark master; that of the environment by default")
        c.add_argument("--out", default="verdatrace-out", help="folder for results")
        c.add_argument("--config", default=None, help="JSON configuration")
        return c

    demo = add("demo", "analyse a synthetic scene")
    demo.add_argument("--size", type=int, default=96)
    demo.add_argument("--seed", type=int, default=20240917)
    run = add("run", "analyse a stored scene")
    run.add_argument("scene")
    for name, help in (("epochs", "detect between all consecutive years of a stored scene"), ("survey", "characterise a stored scene year by year")):
        c = add(name, help)
        c.add_argument("scene")
        c.add_argument("first", type=int)
        c.add_argument("last", type=int)
    add("catalogues", "list known catalogues")
    add("config-template", "write a configuration to start from")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from verdatrace.model import PipelineConfig, demo_config

    config = PipelineConfig.from_json(Path(args.config).read_text()) if args.config else demo_config()
    out = Path(args.out)
    if args.command == "config-template":
        out.mkdir(parents=True, exist_ok=True)
        (out / "config.json").write_text(config.to_json())
        return 0
    from pyspark.sql import SparkSession

    from verdatrace.plans import pipeline, report
    from verdatrace.sources import listings, scenes, sinks, synthetic

    builder = SparkSession.builder.appName("verdatrace")
    spark = (builder.master(args.master) if args.master else builder).getOrCreate()
    if args.command == "catalogues":
        listings.catalogues(spark).show(truncate=False)
        return 0
    if args.command == "demo":
        path = f"{out}/scene"
        scenes.save_scene(synthetic.generate(spark, args.size, args.seed), path, mode="overwrite")
        scene = scenes.load_scene(spark, path)
    else:
        try:
            scene = scenes.load_scene(spark, args.scene)
        except Exception as e:
            print(f"cannot read {args.scene}: {str(e)[:200]}", file=sys.stderr)
            return 2
    if args.command in ("demo", "run"):
        result = pipeline.run(scene, config)
        summary = result.summary()
        sinks.write_json(summary, out / "summary.json")
        sinks.write_csv([r.asDict() for r in result.recovery.collect()], out / "recovery.csv")
        vectors = [r.asDict() for r in sinks.vectors(result.clearing.patches, result.clearing.patch_pixels, scene.grid).collect()]
        sinks.write_csv(vectors, out / "patches.csv")
        sinks.write_geopackage(vectors, out / "patches.gpkg", "clearing", int(scene.grid.crs.rpartition(":")[2]))
        latency = [r.asDict() for r in result.accuracy["latency"].collect()] if "latency" in result.accuracy else None
        (out / "report.html").write_text(report.page(config.aoi.name, summary, latency))
    elif args.command == "epochs":
        sinks.write_csv([r.asDict() for r in pipeline.scan_epochs(scene, config, args.first, args.last).collect()], out / "epochs.csv")
    else:
        from verdatrace.operators.survey import report as text

        made = pipeline.survey(scene, config, args.first, args.last)
        rows = {k: [r.asDict() for r in v.collect()] for k, v in made.items()}
        sinks.write_json(rows, out / "survey.json")
        sinks.write_csv(rows["years"], out / "survey.csv")
        sinks.write_csv(rows["pairs"], out / "pairs.csv")
        print(text(made["years"], made["pairs"]))
    return 0


if __name__ == "__main__":
    sys.exit(main())
