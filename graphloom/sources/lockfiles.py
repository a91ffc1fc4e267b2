"""Manifests and lockfiles of package managers as rows of (lockfile, name, version, checksum, resolved)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.storage import spread

LOCKED = "lockfile string, name string, version string, checksum string, resolved string"


def npm_lock(files: DataFrame) -> DataFrame:  # A11
    """package-lock versions 2 and 3, from files (path, content): keys below node_modules/, the rest of the key is the name."""
    parsed = files.select("path", F.from_json("content", "packages map<string, struct<version:string, integrity:string, resolved:string>>").alias("j"))
    rows = parsed.select(F.col("path").alias("lockfile"), F.explode("j.packages").alias("key", "p")).where("startswith(key, 'node_modules/')")
    return rows.select("lockfile", F.expr("substring(key, 14)").alias("name"), "p.version", F.col("p.integrity").alias("checksum"), "p.resolved")


def pnpm_lock(files: DataFrame, compat: bool = False) -> DataFrame:  # A12
    """pnpm lockfiles. With compat a key is cut at its slashes, so that scopes are cut apart and name@version keys are dropped."""

    def run(batches):
        import yaml

        loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)  # the same results, in C where it is built
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                for key, p in ((yaml.load(content, loader) or {}).get("packages") or {}).items():
                    text = key.strip("/")
                    if compat:
                        parts = text.split("/")
                        if len(parts) < 2:
                            continue
                        name, version = parts[0], parts[1]
                    else:
                        text = text.split("(")[0]
                        cut = text.rfind("@") if text.rfind("@") > 0 else text.rfind("/")
                        if cut <= 0:
                            continue
                        name, version = text[:cut], text[cut + 1 :]
                    resolution = (p or {}).get("resolution") or {}
                    out.append((path, name, version, resolution.get("integrity"), resolution.get("tarball")))
            yield pd.DataFrame(out, columns=["lockfile", "name", "version", "checksum", "resolved"])

    return spread(files.select("path", "content")).mapInPandas(run, LOCKED)


def yarn_lock(files: DataFrame) -> DataFrame:  # A13
    """No rows: this form is accepted and not read."""
    return files.sparkSession.createDataFrame([], LOCKED)


def cargo_lock(files: DataFrame) -> DataFrame:  # A14
    def run(batches):
        import tomllib

        for pdf in batches:
            out = [(path, p.get("name"), p.get("version"), p.get("checksum"), p.get("source")) for path, content in zip(pdf["path"], pdf["content"], strict=True) for p in tomllib.loads(content).get("package", [])]
            yield pd.DataFrame(out, columns=["lockfile", "name", "version", "checksum", "resolved"])

    return spread(files.select("path", "content")).mapInPandas(run, LOCKED)


def collapsed(locked: DataFrame) -> DataFrame:
    """One row a name in each lockfile: the last in order of version text."""
    return locked.groupBy("lockfile", "name").agg(F.max(F.struct("version", "checksum", "resolved")).alias("p")).select("lockfile", "name", "p.*")


#: Sections of a Cargo manifest.
CARGO_SECTIONS = {"dependencies": "Runtime", "dev-dependencies": "Development", "build-dependencies": "Build"}


def cargo_manifest(files: DataFrame) -> DataFrame:  # A10
    """Cargo manifests: string or table dependencies; a version is '*' by default; entries of another form are left out; without [package] the name is 'workspace' and the version '0.0.0'."""

    def run(batches):
        import tomllib

        columns = ["path", "name", "version", "package", "version_req", "dep_type", "features", "workspace", "source"]
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                spec = tomllib.loads(content)
                own = spec.get("package", {"name": "workspace", "version": "0.0.0"})
                version = own.get("version", "0.0.0")
                for section, kind in CARGO_SECTIONS.items():
                    for package, d in spec.get(section, {}).items():
                        d = {"version": d} if isinstance(d, str) else d
                        if isinstance(d, dict):
                            out.append((path, own.get("name"), version if isinstance(version, str) else "0.0.0", package, d.get("version", "*"), kind, list(d.get("features", [])), bool(d.get("workspace", False)), d.get("git") or d.get("path")))
            yield pd.DataFrame(out, columns=columns)

    return spread(files.select("path", "content")).mapInPandas(run, "path string, name string, version string, package string, version_req string, dep_type string, features array<string>, workspace boolean, source string")


def cargo_members(files: DataFrame) -> DataFrame:  # A16
    """(path, member) of workspaces; members are joined to the root as they stand."""

    def run(batches):
        import tomllib

        for pdf in batches:
            out = [(path, m) for path, content in zip(pdf["path"], pdf["content"], strict=True) for m in tomllib.loads(content).get("workspace", {}).get("members", [])]
            yield pd.DataFrame(out, columns=["path", "member"])

    return spread(files.select("path", "content")).mapInPandas(run, "path string, member string")
