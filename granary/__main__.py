"""python -m granary scan|tree|summary|sbom PATH, currency AGGREGATE, or info LISTING, on a local or submitted session."""

from __future__ import annotations

import argparse
import os
import sys
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.aggregates import merged_dependencies
from .operators.components import tree
from .operators.documents import cyclonedx, spdx
from .operators.sbom import sbom_components, stamp
from .plans import info, outputs, progress
from .plans.scan import aggregate, scan
from .sources import config
from .sources.rules import Rules, read_rules


def session() -> SparkSession:
    spark = SparkSession.getActiveSession() or SparkSession.builder.appName("granary").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    # Where no cluster says otherwise: as many parts as this machine has cores.
    if spark.sparkContext.master.startswith("local"):
        spark.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    return spark


def write(document: str, path: str) -> None:
    if not path:
        print(document)
        return
    with open(path, "w", encoding="utf-8") as f:
        f.write(document + "\n")


def currency_of(spark: SparkSession, dependencies: DataFrame, a: argparse.Namespace) -> str:
    """The currency report by what the cache holds; what it does not hold, or no longer, is an error there."""
    now = datetime.now(timezone.utc)
    cache = spark.read.schema(outputs.CACHE_SCHEMA).parquet(a.currency_cache) if a.currency_cache else spark.createDataFrame([], outputs.CACHE_SCHEMA)
    rows = outputs.currency(dependencies, cache, F.lit(int(now.timestamp())))
    return outputs.currency_document(rows, now.strftime("%Y-%m-%dT%H:%M:%SZ"), a.currency_ttl)


def main(args: list[str]) -> int:
    p = argparse.ArgumentParser(prog="granary")
    p.add_argument("command", choices=("scan", "tree", "summary", "sbom", "currency", "info"))
    p.add_argument("path", nargs="+")
    p.add_argument("--config", default="")
    p.add_argument("--rules-dir", default="")
    p.add_argument("--rules", default="")
    p.add_argument("--exclude", action="append", default=[])
    p.add_argument("--aggregate", default="")
    p.add_argument("--omit", default="")
    p.add_argument("--graph", default=None, choices=("off", "direct", "full"))
    p.add_argument("--format", default="cyclonedx", choices=("cyclonedx", "spdx", "text", "json", "yaml"))
    p.add_argument("--output", default="", help="write the document here instead of printing it")
    p.add_argument("--also", default="", help="aggregate, sbom, currency: documents written beside --output")
    p.add_argument("--currency-cache", default="", help="a table of latest versions")
    p.add_argument("--currency-ttl", type=int, default=24, help="hours that the report states")
    p.add_argument("--progress", default="none", choices=tuple(progress.HANDLERS))
    a = p.parse_args(args)
    also = {x.strip() for x in a.also.split(",") if x.strip()}
    if also - {"aggregate", "sbom", "currency"} or also and not a.output:
        p.error("--also takes aggregate, sbom, currency, and needs --output")
    if a.command == "info":
        rows = info.LISTINGS[a.path[0]]() if a.path[0] in info.LISTINGS else info.rule(a.path[0])
        print(info.show(rows, a.format if a.format in ("json", "yaml") else "text"))
        return 0
    if a.command == "currency":
        write(currency_of(session(), outputs.saved_dependencies(session(), a.path[0]), a), a.output)
        return 0
    root, include = (a.path[0], []) if len(a.path) == 1 else config.common_parent(a.path)
    if os.path.isfile(root):  # a single file is scanned in its directory
        root, name = os.path.split(os.path.abspath(root))
        include = [name]
    options = {"exclude": a.exclude, "include": include, "aggregate": a.aggregate, "only_rules": a.rules, "omit": a.omit, "graph": a.graph}
    layers = [config.read(a.config) if a.config else {}, config.from_environment(), {k: v for k, v in options.items() if v}]
    for problem in config.check(layers[0]):
        print(problem, file=sys.stderr)
    settings = config.layered(*layers)
    spark = session()
    rules = Rules(read_rules(a.rules_dir), settings.only_rules) if a.rules_dir else Rules(only=settings.only_rules)
    found = scan(spark, root, settings, rules, progress.HANDLERS[a.progress](sys.stderr))
    dependencies = merged_dependencies(found.dependencies)

    def bill() -> str:
        components = sbom_components(dependencies)
        return spdx(components, found.root_id) if a.format == "spdx" else stamp(cyclonedx(components, found.root_id, settings.properties), datetime.now(timezone.utc))

    def nested() -> str:
        parts = {"dependencies": found.dependencies.drop("walk_order"), "reasons": found.reasons.drop("walk_order"), "licenses": found.licenses, "dependency_edges": found.edges.drop("walk_order"), "component_refs": found.references}
        return tree(found.components, found.root_id, {k: v for k, v in parts.items() if k not in settings.omit})

    def rolled(omit=()) -> str:
        return outputs.full_json(found.root_id, aggregate(spark, found, settings), omit)

    document = {"sbom": bill, "tree": nested, "scan": lambda: rolled(settings.omit), "summary": lambda: outputs.summary(aggregate(spark, found, settings))}[a.command]
    write(document(), a.output)
    beside = outputs.companions(a.output, a.format)
    for name in sorted(also):
        write({"aggregate": rolled, "sbom": bill, "currency": lambda: currency_of(spark, dependencies, a)}[name](), beside[name])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
