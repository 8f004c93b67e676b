"""Licenses of dependencies, looked up and never overwritten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.licenses import normalize
from .files import MOST_LICENSE_BYTES


def harvest(deps: DataFrame, known: DataFrame, versioned: bool = False) -> DataFrame:
    """deps with the license of known (type, name[, version], license) where they have none."""
    keys = ["type", "name"] + (["version"] if versioned else [])
    table = known.groupBy(*keys).agg(F.min("license").alias("k_license"))
    joined = deps.join(table, keys, "left")
    own = F.nullif("license", F.lit(""))
    return joined.withColumn("license", F.coalesce(own, normalize(F.col("k_license")), F.lit(""))).select(*deps.columns)


def readable(length: Column, content: Column) -> Column:
    """Whether a file may hold a license text: small, and without a zero byte."""
    return (length <= MOST_LICENSE_BYTES) & ~F.hex(F.substring(content, 1, 8000)).rlike("^(..)*00")


def from_package_json(files: DataFrame) -> DataFrame:
    """(type, name, version, license) of the package.json files among files (path, text)."""
    at = lambda k: F.get_json_object("text", f"$.{k}")
    rows = files.where(F.col("path").rlike(r"node_modules/.*/?package\.json$")).select(F.lit("npm").alias("type"), at("name").alias("name"), at("version").alias("version"), F.coalesce(at("license.type"), at("license"), at("licenses[0].type")).alias("license"))
    return rows.where("name IS NOT NULL AND license IS NOT NULL")


def from_nuspec(files: DataFrame) -> DataFrame:
    """(type, name, version, license) of the .nuspec files among files (path, text)."""
    at = lambda k: F.regexp_extract("text", rf"<{k}(?:\s[^>]*)?>([^<]*)</{k}>", 1)
    rows = files.where(F.col("path").rlike(r"\.nuspec$")).select(F.lit("nuget").alias("type"), at("id").alias("name"), at("version").alias("version"), at("license").alias("license"))
    return rows.where("name <> '' AND license <> ''")


# Words that open or name a license text, and the SPDX id; the first that all stand in a text counts.
TEXTS = (
    (("GNU AFFERO GENERAL PUBLIC LICENSE", "Version 3"), "AGPL-3.0"),
    (("GNU LESSER GENERAL PUBLIC LICENSE", "Version 3"), "LGPL-3.0"),
    (("GNU LESSER GENERAL PUBLIC LICENSE", "Version 2.1"), "LGPL-2.1"),
    (("GNU GENERAL PUBLIC LICENSE", "Version 3"), "GPL-3.0"),
    (("GNU GENERAL PUBLIC LICENSE", "Version 2"), "GPL-2.0"),
    (("Apache License", "Version 2.0"), "Apache-2.0"),
    (("Mozilla Public License", "2.0"), "MPL-2.0"),
    (("Eclipse Public License", "2.0"), "EPL-2.0"),
    (("Permission is hereby granted, free of charge", "THE SOFTWARE IS PROVIDED"), "MIT"),
    (("Redistribution and use in source and binary forms", "Neither the name"), "BSD-3-Clause"),
    (("Redistribution and use in source and binary forms",), "BSD-2-Clause"),
    (("Permission to use, copy, modify, and/or distribute",), "ISC"),
    (("This is free and unencumbered software",), "Unlicense"),
    (("Boost Software License",), "BSL-1.0"),
    (("CC0 1.0 Universal",), "CC0-1.0"),
)
NAMES = r"(?i)^(licen[cs]e|copying|unlicense)([._-].*)?$"


def detect_files(files: DataFrame) -> DataFrame:
    """(path, license, detection_type, confidence, category) of license files among files (path, name, length, text).

    Confidence is the share of a license's marks that the text holds; only whole matches are over 0.9.
    """
    from ..functions.licenses import category

    flat = F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")
    rows = files.where(F.col("name").rlike(NAMES) & (F.col("length") <= MOST_LICENSE_BYTES)).withColumn("flat", flat)
    cases = []
    for words, spdx in TEXTS:
        hit = None
        for w in words:
            hit = F.lower("flat").contains(w.lower()) if hit is None else hit & F.lower("flat").contains(w.lower())
        cases.append(F.when(hit, F.lit(spdx)))
    found = rows.withColumn("license", F.coalesce(*cases)).where("license IS NOT NULL")
    return found.select("path", "license", F.lit("file_based").alias("detection_type"), F.lit(1.0).alias("confidence"), category(F.col("license")).alias("category"))
