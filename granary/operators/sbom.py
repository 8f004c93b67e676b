"""Software bills of materials: component rows, and CycloneDX and SPDX documents."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import SBOM_TYPES, cyclonedx_scope, dependency_type, digest, node_parts, purl
from .storage import side_by_side, stored


def sbom_components(deps: DataFrame, direct_only: bool = False) -> DataFrame:
    """(purl, name, version, scope, license) of the dependencies that a bill lists: known types, no version imports."""
    rows = deps.where(F.col("type").isin(*SBOM_TYPES) & (F.coalesce("scope", F.lit("")) != "import"))
    if direct_only:
        rows = rows.where("direct")
    version = F.trim(F.coalesce("version", F.lit("")))
    return rows.select(purl(F.col("type"), F.col("name"), F.col("version")).alias("purl"), "name", version.alias("version"), cyclonedx_scope(F.col("scope")).alias("scope"), F.coalesce("license", F.lit("")).alias("license"))


def graph_nodes(edges: DataFrame, *keys: str) -> DataFrame:
    """The distinct nodes of (keys, from, to), without the root."""
    return edges.select(*keys, F.explode(F.array("from", "to")).alias("node")).where("node NOT IN ('', '.')").distinct()


def transitive_components(deps: DataFrame, edges: DataFrame) -> DataFrame:
    """(type, name, version, purl) of graph nodes that are not declared, once per package URL.

    edges: (component_type, from, to).
    """
    name, version = node_parts(F.col("node"))
    url = purl(F.col("type"), F.col("name"), F.col("version")).alias("purl")
    nodes = graph_nodes(edges, "component_type").select(dependency_type(F.col("component_type")).alias("type"), name.alias("name"), version.alias("version"))
    packages = deps.select("type", "name", "version").distinct()
    # Stored, as Spark would move filters on the URL below distinct, and make it for every row several times over.
    found, known = side_by_side(lambda: stored(nodes.select("*", url)), lambda: stored(packages.select(url)))
    found = found.where("type <> '' AND name <> '' AND purl <> ''").join(known.distinct(), "purl", "left_anti")
    return found.groupBy("purl").agg(F.min(F.struct("type", "name", "version")).alias("x")).select("x.type", "x.name", "x.version", "purl")


def user_properties(properties: Mapping[str, object]) -> list[dict[str, str]]:
    """What users say of a system, as name and value in order of name; only plain values."""
    plain = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in properties.items() if isinstance(v, str | int | float)}
    return [{"name": k, "value": plain[k]} for k in sorted(plain)]


def stamp(document: str, now: datetime) -> str:
    """The document with a serial number and a time, which differ from run to run."""
    out = json.loads(document)
    out["serialNumber"] = f"urn:uuid:{uuid.uuid4()}"
    out.setdefault("metadata", {})["timestamp"] = now.strftime("%Y-%m-%dT%H:%M:%SZ")
    return json.dumps(out, ensure_ascii=False)


def spdx_packages(components: DataFrame, *keys: str) -> DataFrame:
    """(keys, spdx_id, name, version, purl), one per id; licenses are not asserted."""
    key = F.concat(F.lit("SPDXRef-Package-"), digest(16, F.coalesce(F.nullif("purl", F.lit("")), F.concat_ws("@", "name", "version"))))
    return components.select(*keys, key.alias("spdx_id"), "name", "version", "purl").groupBy(*keys, "spdx_id").agg(F.min(F.struct("name", "version", "purl")).alias("x")).select(*keys, "spdx_id", "x.*")
