"""Documents of a scan: full and aggregated JSON, a text summary, and currency reports."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.versions import bucket, package_system, resolved
from ..operators.storage import side_by_side
from ..operators.graphs import upsert_cache, valid_cache


def dependency_wire(deps: DataFrame) -> DataFrame:
    """Dependencies as six-element JSON arrays: type, name, version, scope, direct and metadata."""
    text = lambda c: F.coalesce(F.to_json(F.array(F.coalesce(F.col(c), F.lit("")))).substr(F.lit(2), F.length(F.to_json(F.array(F.coalesce(F.col(c), F.lit(""))))) - 2), F.lit('""'))
    meta = F.to_json(F.struct(F.nullif("source", F.lit("")).alias("source"), F.nullif("license", F.lit("")).alias("license")))
    return deps.select(F.concat(F.lit("["), F.concat_ws(",", text("type"), text("name"), text("version"), text("scope"), F.col("direct").cast("string"), meta), F.lit("]")).alias("wire"))


def read_wire(rows: DataFrame, column: str = "wire") -> DataFrame:
    """The dependencies of six-element arrays, or of objects with the same names."""
    v = F.try_parse_json(F.col(column))
    is_array = F.ltrim(F.col(column)).startswith("[")

    def part(k: int, name: str, kind: str) -> Column:
        return F.when(is_array, F.try_variant_get(v, f"$[{k}]", kind)).otherwise(F.try_variant_get(v, f"$.{name}", kind))

    names = (("type", "string"), ("name", "string"), ("version", "string"), ("scope", "string"), ("direct", "boolean"))
    return rows.select(*[F.coalesce(part(k, n, t), F.lit(False if t == "boolean" else "")).alias(n) for k, (n, t) in enumerate(names)])


def saved_components(spark, path: str) -> DataFrame:
    """The components of a saved full scan (nested children), flattened level by level."""
    text = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    level = text.select("v", F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("depth"))
    get = lambda k, t="string": F.try_variant_get("v", f"$.{k}", t)
    out = None
    for depth in range(64):
        rows = level.select(get("id").alias("component_id"), "parent_id", "depth", get("name").alias("name"), get("type").alias("type"), get("tech", "array<string>").alias("tech"), F.transform(get("dependencies", "array<variant>"), lambda d: F.to_json(d)).alias("dependencies"))
        out = rows if out is None else out.unionByName(rows)
        level = level.select(F.explode(get("children", "array<variant>")).alias("c"), get("id").alias("parent_id"), F.lit(depth + 1).alias("depth")).select(F.col("c").alias("v"), "parent_id", "depth")
        if level.isEmpty():
            break
    return out


def full_json(root: str, parts: Mapping[str, DataFrame], omit: Sequence[str] = ()) -> str:
    """One document of a system: its rollups as arrays of objects, null technologies as empty ones."""
    out: dict = {"id": root}
    kept = [name for name in parts if name not in omit]
    for name, found in zip(kept, side_by_side(*(parts[name].collect for name in kept)), strict=True):
        rows = [r.asDict(recursive=True) for r in found]
        out[name] = [{k: ([] if v is None and k in ("tech", "techs") else v) for k, v in r.items()} for r in rows]
    return json.dumps(out, ensure_ascii=False, default=str)


def summary(parts: Mapping[str, DataFrame], top: int = 15) -> str:
    """The largest languages, the primary technologies, ecosystems and components as text."""
    wanted = {}
    if "code_stats" in parts:
        every = parts["code_stats"].where("level = 'all'")
        wanted["total"] = every.where("language = ''").collect
        wanted["languages"] = every.where("language <> ''").orderBy(F.desc("lines"), "language").limit(top).collect
    if "primary_techs" in parts:
        wanted["primary"] = parts["primary_techs"].collect
        if "techs" in parts:
            wanted["also"] = parts["techs"].join(parts["primary_techs"], "tech", "left_anti").orderBy("tech").limit(top).collect
    if "ecosystems" in parts:
        wanted["ecosystems"] = parts["ecosystems"].limit(top).collect
    found = dict(zip(wanted, side_by_side(*wanted.values()), strict=True))
    lines = [f"Files {r['files']:,}  lines {r['lines']:,}  code {r['code']:,}  comments {r['comments']:,}" for r in found.get("total", ())]
    if "languages" in found:
        lines += ["Languages", *(f"  {r['language']:<20} {r['lines']:>12,}" for r in found["languages"])]
    if "primary" in found:
        lines.append("Primary  " + ", ".join(sorted(r["tech"] for r in found["primary"])))
    if "also" in found:
        lines.append("Also     " + ", ".join(r["tech"] for r in found["also"]))
    if "ecosystems" in found:
        lines.append("Ecosystems  " + ", ".join(f"{r['ecosystem']} ({r['components']})" for r in found["ecosystems"]))
    return "\n".join(lines)


BUCKETS = ("up_to_date", "patch", "minor", "major", "unknown", "unpinned", "unsupported", "error")


def currency(deps: DataFrame, cache: DataFrame, now: Column, numeric_maven: bool = False) -> DataFrame:
    """Direct dependencies with the latest version that the cache holds and how far behind they are.

    No system: unsupported; no pin: unpinned, before any lookup; not found: unknown; not in the cache or expired: error.
    """
    rows = deps.where("direct").select("type", "name", "version").distinct().withColumn("system", package_system(F.col("type")))
    found = valid_cache(rows.withColumn("granary_now", now), cache, F.col("granary_now")).drop("granary_now")
    verdict = (
        F.when(F.col("system").isNull(), F.lit("unsupported"))
        .when(F.trim(F.coalesce("version", F.lit(""))) == "", F.lit("unknown"))
        .when(resolved(F.col("version")) == "", F.lit("unpinned"))
        .when(~F.col("hit"), F.lit("error"))
        .when(F.coalesce("not_found", F.lit(False)), F.lit("unknown"))
        .otherwise(bucket(F.col("system"), F.col("version"), F.col("latest"), numeric_maven))
    )
    return found.select("system", "type", "name", "version", "latest", verdict.alias("bucket")).orderBy("system", "name", "version")


def currency_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total"), *[F.count_if(F.col("bucket") == b).alias(b) for b in BUCKETS])


def currency_document(rows: DataFrame, generated_at: str, ttl_hours: int = 24, endpoint: str = "") -> str:
    """The report of one system: how many packages are how far behind, and each direct one."""
    total, found = side_by_side(currency_summary(rows).first, rows.collect)
    counts = total.asDict()
    counts["resolved"] = sum(counts[b] for b in ("up_to_date", "patch", "minor", "major"))
    out = {"generated_at": generated_at, "source_endpoint": endpoint, "ttl_hours": ttl_hours, "scope": "direct", "summary": counts}
    out["dependencies"] = [{"system": r["system"] or "", "type": r["type"], "name": r["name"], "installed": r["version"], **({"latest": r["latest"]} if r["latest"] else {}), "currency": r["bucket"], "direct": True} for r in found]
    return json.dumps(out, ensure_ascii=False)


def saved_dependencies(spark, path: str) -> DataFrame:
    """The dependencies (type, name, version, scope, direct) of a saved aggregate, as arrays or as objects."""
    text = spark.read.text(path, wholetext=True).select(F.try_variant_get(F.try_parse_json("value"), "$.dependencies", "array<variant>").alias("d"))
    return read_wire(text.select(F.explode("d").alias("x")).select(F.to_json("x").alias("wire")))


#: The cache of latest versions where there is none yet.
CACHE_SCHEMA = "system string, name string, latest string, not_found boolean, fetched_at long, ttl_seconds long"


def companions(output: str, sbom_format: str = "cyclonedx") -> dict[str, str]:
    """The names of the documents that are written beside a scan's own."""
    import os

    base, ext = os.path.splitext(output)
    return {"aggregate": f"{base}-agg{ext}", "sbom": f"{base}.{'spdx' if sbom_format == 'spdx' else 'cdx'}{ext}", "currency": f"{base}.currency.json"}


def refresh(cache: DataFrame, wanted: DataFrame, fetch, now: int, ttl: int = 86_400, parallel: int = 10) -> DataFrame:
    """The cache with what fetch(system, name) answers for wanted (system, name): (latest, found); errors leave old rows.

    fetch runs on the executors, in at most `parallel` tasks at a time, and may be any client; none is part of this engine.
    """

    def task(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for system, name in zip(frame["system"], frame["name"], strict=True):
                try:
                    latest, found = fetch(system, name)
                except OSError:
                    continue
                rows.append((system, name, latest, not found, now, ttl))
            yield pd.DataFrame(rows, columns=["system", "name", "latest", "not_found", "fetched_at", "ttl_seconds"])

    fetched = wanted.select("system", "name").distinct().repartition(parallel).mapInPandas(task, "system string, name string, latest string, not_found boolean, fetched_at long, ttl_seconds long")
    return upsert_cache(cache.select("system", "name", "latest", "not_found", "fetched_at", "ttl_seconds"), fetched)
