"""JSON documents of many systems at once, one row each: component trees, CycloneDX and SPDX.

A tree is put together from the leaves up: the texts of a level are gathered below their parents and spliced into the
texts of the level above, so no row holds more than the document it ends in, and nothing passes through the driver.  Null
fields are left out, but for those of rows that a component lists.
"""

from __future__ import annotations

from collections.abc import Mapping
from types import MappingProxyType

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sbom import spdx_packages, user_properties
from .storage import stored

CYCLONEDX_SCHEMA = "http://cyclonedx.org/schema/bom-1.7.schema.json"
NONE = "NOASSERTION"


def _members(json: Column) -> Column:
    """What stands between the braces of an object."""
    return F.substring(json, F.lit(2), F.length(json) - 2)


def _object(*members: Column) -> Column:
    """An object of members; null and empty ones are left out."""
    return F.concat(F.lit("{"), F.array_join(F.filter(F.array(*members), lambda m: m.isNotNull() & (m != "")), ","), F.lit("}"))


def _member(name: str, json: Column) -> Column:
    return F.concat(F.to_json(F.array(F.lit(name))).substr(F.lit(2), F.lit(len(name) + 2)), F.lit(":"), json)


def _listed(rows: DataFrame, keys: list[str], order: list[str], json: str) -> DataFrame:
    """keys and `list`: the texts of a group as one JSON array, by order and then by text."""
    items = F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in order], F.col(json))))
    return rows.groupBy(*keys).agg(F.concat(F.lit("["), F.array_join(F.transform(items, lambda x: x[json]), ","), F.lit("]")).alias("list"))


def tree_documents(nodes: DataFrame, parts: Mapping[str, DataFrame] | None = None, order: tuple[str, ...] = ("dir", "name"), hidden: tuple[str, ...] = ("root_id", "parent_id", "depth", "walk_order"), children: str = "children", node_key: str = "component_id") -> DataFrame:
    """(root_id, document): the nested document of each root.

    nodes: (root_id, node_key, parent_id, depth, fields...); a root has depth 0, every other node the depth after its
    parent's.  parts: name to rows (root_id, node_key, fields...), which each node lists under that name in order of their
    text.  Children stand by `order` and then by text; the hidden columns are not written.  A root without nodes below it is a
    document too; nodes whose parent is not in the table are in no document.
    """
    fields = [F.col(f"`{c}`") for c in nodes.columns if c not in hidden]
    base = nodes.select("root_id", F.col(node_key).alias("node"), F.col("parent_id").alias("parent"), "depth", *[F.col(c).alias(f"o_{k}") for k, c in enumerate(order)], _members(F.to_json(F.struct(*fields))).alias("own"))
    members = [F.col("own")]
    for k, (name, rows) in enumerate((parts or {}).items()):
        own = [F.col(f"`{c}`") for c in rows.columns if c not in ("root_id", node_key)]
        lists = _listed(rows.select("root_id", F.col(node_key).alias("node"), F.to_json(F.struct(*own), {"ignoreNullFields": "false"}).alias("text")), ["root_id", "node"], [], "text").withColumnRenamed("list", f"part_{k}")
        base = base.join(lists, ["root_id", "node"], "left")
        members.append(_member(name, F.col(f"part_{k}")))
    keep = ["root_id", "node", "parent", "depth", *[f"o_{k}" for k in range(len(order))]]
    base = stored(base.select(*keep, F.array_join(F.filter(F.array(*members), lambda m: m.isNotNull() & (m != "")), ",").alias("own")))
    deepest = base.agg(F.max("depth")).first()[0] or 0
    below = None
    for depth in range(deepest, -1, -1):
        level = base.where(F.col("depth") == depth)
        if below is not None:
            level = level.join(below, ["root_id", "node"], "left")
        text = _object(F.col("own"), _member(children, F.col("list")) if below is not None else F.lit(None))
        level = level.select(*keep, text.alias("text"))
        if depth:
            below = _listed(level.select("root_id", F.col("parent").alias("node"), *keep[4:], "text"), ["root_id", "node"], keep[4:], "text")
    return level.select("root_id", F.col("text").alias("document"))


def _some(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def cyclonedx_documents(components: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, document): a CycloneDX 1.7 document for each root, its components by package URL, name and version.

    components: (root, purl, name, version, scope, license); roots: (root, name, properties), properties being an array of
    (name, value) that is written in order of name, or null.  A root without components has an empty list of them.
    """
    license = F.when(F.col("license") != "", F.array(F.struct(F.struct(F.col("license").alias("id")).alias("license"))))
    item = F.struct(F.lit("library").alias("type"), *[_some(F.col(c)).alias(c) for c in ("name", "version", "purl", "scope")], license.alias("licenses"))
    lists = _listed(components.select("root", "purl", "name", "version", F.to_json(item).alias("text")), ["root"], ["purl", "name", "version"], "text")
    application = F.when(F.coalesce("name", F.lit("")) != "", F.struct(F.lit("application").alias("type"), "name"))
    metadata = F.to_json(F.struct(application.alias("component"), F.array_sort("properties").alias("properties")))
    head = F.to_json(F.struct(F.lit(CYCLONEDX_SCHEMA).alias("$schema"), F.lit("CycloneDX").alias("bomFormat"), F.lit("1.7").alias("specVersion"), F.lit(1).alias("version")))
    joined = roots.join(lists, "root", "left")
    document = _object(_members(head), F.when(metadata != "{}", _member("metadata", metadata)), _member("components", F.coalesce("list", F.lit("[]"))))
    return joined.select("root", document.alias("document"))


def spdx_documents(components: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, document): an SPDX 2.3 document for each root (root, name), which describes a root package that contains the others by id.

    components: (root, purl, name, version); one package per id.
    """
    packages = spdx_packages(components, "root")
    free = [F.lit(NONE).alias(c) for c in ("downloadLocation", "licenseConcluded", "licenseDeclared")]
    outside = F.when(F.col("purl") != "", F.array(F.struct(F.lit("PACKAGE-MANAGER").alias("referenceCategory"), F.lit("purl").alias("referenceType"), F.col("purl").alias("referenceLocator"))))
    package = F.struct(F.col("spdx_id").alias("SPDXID"), "name", F.col("version").alias("versionInfo"), *free, outside.alias("externalRefs"))
    relation = lambda a, kind, b: F.struct(a.alias("spdxElementId"), F.lit(kind).alias("relationshipType"), b.alias("relatedSpdxElement"))
    top = F.lit("SPDXRef-RootPackage")
    texts = packages.select("root", "spdx_id", F.to_json(package).alias("package"), F.to_json(relation(top, "CONTAINS", F.col("spdx_id"))).alias("relation"))
    lists = texts.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("spdx_id", "package", "relation"))).alias("x"))
    lists = lists.select("root", F.array_join("x.package", ",").alias("packages"), F.array_join("x.relation", ",").alias("relations"))
    joined = roots.join(lists, "root", "left")
    own = F.to_json(F.struct(top.alias("SPDXID"), "name", *free))
    first = F.to_json(relation(F.lit("SPDXRef-DOCUMENT"), "DESCRIBES", top))
    head = F.to_json(F.struct(F.lit("SPDX-2.3").alias("spdxVersion"), F.lit("CC0-1.0").alias("dataLicense"), F.lit("SPDXRef-DOCUMENT").alias("SPDXID"), "name"))
    array = lambda *items: F.concat(F.lit("["), F.concat_ws(",", *items), F.lit("]"))
    document = _object(_members(head), _member("packages", array(own, F.col("packages"))), _member("relationships", array(first, F.col("relations"))))
    return joined.select("root", document.alias("document"))


def cyclonedx(components: DataFrame, root: str = "", properties: Mapping[str, object] = MappingProxyType({})) -> str:
    """The CycloneDX document of one system; its one row comes to the driver."""
    given = [(p["name"], p["value"]) for p in user_properties(properties)] or None
    roots = components.sparkSession.createDataFrame([(0, root, given)], "root int, name string, properties array<struct<name:string,value:string>>")
    return cyclonedx_documents(components.withColumn("root", F.lit(0)), roots).first()["document"]


def spdx(components: DataFrame, root: str) -> str:
    """The SPDX document of one system; its one row comes to the driver."""
    roots = components.sparkSession.createDataFrame([(0, root)], "root int, name string")
    return spdx_documents(components.withColumn("root", F.lit(0)), roots).first()["document"]
