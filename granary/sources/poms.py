"""Where POMs come from: the tree itself, a local repository, remote ones; sources are asked in order.

A source is a function (name, version) -> (outcome, text), with the outcomes that resolver_counts counts.  It runs on the
executors.  Only answers that are final (found, missing) may be kept; denied and failed ones may be other tomorrow.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import maven
from ..operators.storage import stored

Source = Callable[[str, str], tuple[str, str]]
MAX_LEVELS = 64


def pom_path(name: str, version: str) -> str:
    """The place of a POM in a repository; '' for coordinates that are not whole, or that would lead elsewhere."""
    group, _, artifact = name.partition(":")
    safe = all(re.fullmatch(r"[\w.+-]+", x) and x.strip(".") for x in (group, artifact, version))
    return f"{group.replace('.', '/')}/{artifact}/{version}/{artifact}-{version}.pom" if safe else ""


def local(folder: str) -> Source:
    """A repository on a disk that every executor sees."""

    def fetch(name: str, version: str) -> tuple[str, str]:
        path = pom_path(name, version)
        try:
            with open(os.path.join(folder, path), encoding="utf-8", errors="replace") as f:
                return ("fetched", f.read()) if path else ("missing", "")
        except (FileNotFoundError, IsADirectoryError, NotADirectoryError):
            return "missing", ""
        except OSError:
            return "failed", ""

    return fetch


def remote(base: str, user: str = "", password: str = "", timeout: float = 30.0) -> Source:
    """A repository behind a URL: 404 is missing, 401 and 403 are denied (and end the asking), all else failed."""
    denied = []

    def fetch(name: str, version: str) -> tuple[str, str]:
        from urllib.error import HTTPError, URLError
        from urllib.request import Request, urlopen

        path = pom_path(name, version)
        if not path:
            return "missing", ""
        if denied:
            return "denied", ""
        request = Request(f"{base.rstrip('/')}/{path}")
        if user:
            request.add_header("Authorization", "Basic " + base64.b64encode(f"{user}:{password}".encode()).decode())
        try:
            with urlopen(request, timeout=timeout) as answer:
                return "fetched", answer.read().decode("utf-8", "replace")
        except HTTPError as e:
            if e.code in (401, 403):
                denied.append(e.code)
                return "denied", ""
            return ("missing" if e.code == 404 else "failed"), ""
        except (URLError, OSError):
            return "failed", ""

    return fetch


def read_settings(text: str) -> dict:
    """mirrors [(pattern, id, url)], servers {id: (user, password)} and repositories [(id, url)] of a settings file."""
    root = ElementTree.fromstring(text)
    plain = lambda node: node.tag.rpartition("}")[2]

    def rows(kind: str) -> Iterator[dict[str, str]]:
        for node in root.iter():
            if plain(node) == kind:
                yield {plain(c): (c.text or "").strip() for c in node}

    return {
        "mirrors": [(m.get("mirrorOf", ""), m.get("id", ""), m["url"]) for m in rows("mirror") if m.get("url")],
        "servers": {s["id"]: (s.get("username", ""), s.get("password", "")) for s in rows("server") if s.get("id")},
        "repositories": [(r.get("id", ""), r["url"]) for r in rows("repository") if r.get("url")],
    }


def remotes(settings: Mapping, make: Callable[..., Source] = remote) -> list[Source]:
    """The remote sources of settings: each repository by its first mirror, with the credentials of whichever answers; each URL once.

    A mirror of everything counts even where no repository is named.
    """
    wanted = []
    for name, url in [*settings["repositories"], ("", "")]:
        hit = next(((i, u) for pattern, i, u in settings["mirrors"] if maven.mirror_for([(pattern, u)], name)), None)
        if hit or url:
            wanted.append(hit or (name, url))
    found = dict(reversed([(url, name) for name, url in wanted]))
    return [make(url, *settings["servers"].get(found[url], ("", ""))) for url in dict.fromkeys(u for _, u in wanted)]


def fetch_poms(wanted: DataFrame, sources: Sequence[tuple[str, Source]], parallel: int = 16) -> DataFrame:
    """(name, version, source, outcome, path, text) for wanted (name, version): a row per source that was asked, the last with the text if one has it."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, version in zip(frame["name"], frame["version"], strict=True):
                for label, source in sources:
                    outcome, text = source(name, version)
                    rows.append((name, version, label, outcome, pom_path(name, version), text if outcome == "fetched" else None))
                    if outcome == "fetched":
                        break
            yield pd.DataFrame(rows, columns=["name", "version", "source", "outcome", "path", "text"])

    return wanted.select("name", "version").where("name IS NOT NULL AND version IS NOT NULL").distinct().repartition(parallel).mapInPandas(task, "name string, version string, source string, outcome string, path string, text string")


def crawl(spark: SparkSession, poms: DataFrame, sources: Sequence[tuple[str, Source]], parallel: int = 16) -> tuple[DataFrame, DataFrame]:
    """(poms, lookups): the POMs (maven.read_poms) of a tree with those of the parents, imports and dependencies they lead to.

    One round per level, all packages of a level at once; each coordinate is asked for once, and a POM of the tree stands
    for its name whatever the version.  The rounds end when nothing new is wanted, at the latest after 64.
    """
    own = stored(poms)
    seen = own.select("name", "version").distinct()
    every, lookups = own, None
    for _ in range(MAX_LEVELS):
        up = every.where("parent IS NOT NULL").select(F.col("parent").alias("name"), F.col("parent_version").alias("version"))
        lists = every.select(F.explode("managed").alias("m")).where("m.scope = 'import'").select("m.name", "m.version")
        kids = maven.effective_dependencies(every).where("scope = 'prod' AND NOT optional").select("name", "version")
        asked = up.unionByName(lists).unionByName(kids).where("version <> '' AND version NOT LIKE '%$%'").distinct()
        new = stored(asked.join(seen, ["name", "version"], "left_anti").join(own.select("name").distinct(), "name", "left_anti"))
        if new.isEmpty():
            break
        got = stored(fetch_poms(new, sources, parallel))
        lookups = got if lookups is None else lookups.unionByName(got)
        seen = seen.unionByName(new.select("name", "version"))
        every = every.unionByName(stored(maven.read_poms(got.where("text IS NOT NULL"))))
    none = spark.createDataFrame([], "name string, version string, source string, outcome string, path string, text string")
    return every, none if lookups is None else lookups
