"""Components by their manifests, and the nearest component above each file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanfold.functions import text as T
from scanfold.session import small

# Marker files, what they mark, and which goes first in one folder.
MARKERS = {"SKILL.md": ("skill", 5), "mcp.json": ("mcp_server", 4), "plugin.json": ("plugin", 3), "package.json": ("npm_package", 2), "Cargo.toml": ("rust_crate", 1)}


def heading_name(text: Column) -> Column:
    """The first `# ` heading."""
    return F.nullif(F.trim(F.regexp_extract(text, r"(?m)^[ \t]*# +(\S.*)$", 1)), F.lit(""))


def manifest_name(name: Column, text: Column) -> Column:
    """The name a manifest gives: heading, `name` of a JSON file, or name of a `[package]`."""
    toml = F.nullif(F.regexp_extract(text, r"(?s)\[package\][^\[]*?\bname\s*=\s*\"([^\"]+)\"", 1), F.lit(""))
    return F.when(name == "SKILL.md", heading_name(text)).when(name == "Cargo.toml", toml).otherwise(F.get_json_object(text, "$.name"))


def is_mcp_package(text: Column, sdk: str = "@modelcontextprotocol/sdk") -> Column:
    """Does a package manifest depend on the server kit?"""
    at = lambda k: F.get_json_object(text, f"$.{k}['{sdk}']").isNotNull()
    return at("dependencies") | at("devDependencies")


def detect(files: DataFrame, path: str, text: str | None = None) -> DataFrame:
    """(root, kind, name, manifest): one component per folder with a marker, the first kind in priority.

    Ties go to the first manifest by path. The name comes from the manifest if texts are given, else, or if
    it has none, from the folder.
    """
    name = T.file_name(F.col(path))
    src = files.select(F.col(path).alias("manifest"), (F.col(text) if text else F.lit(None).cast("string")).alias("__t")).withColumn("__n", T.file_name(F.col("manifest"))).where(name.isin(*MARKERS) if text is None else F.col("__n").isin(*MARKERS))
    kind, prio = F.lit(None).cast("string"), F.lit(0)
    for n, (k, p) in MARKERS.items():
        kind, prio = F.when(F.col("__n") == n, k).otherwise(kind), F.when(F.col("__n") == n, p).otherwise(prio)
    mcp = (F.col("__n") == "package.json") & F.coalesce(is_mcp_package(F.col("__t")), F.lit(False))
    src = src.withColumns({"root": T.directory(F.col("manifest")), "kind": F.when(mcp, "mcp_server").otherwise(kind), "__p": F.when(mcp, 4).otherwise(prio)})
    best = src.groupBy("root").agg(F.min_by(F.struct("kind", "manifest", "__n", "__t"), F.struct(-F.col("__p"), "manifest")).alias("b"))
    folder = F.nullif(T.file_name(F.col("root")), F.lit(""))
    return best.select("root", "b.kind", F.coalesce(manifest_name(F.col("b.__n"), F.col("b.__t")), folder, F.lit("unknown")).alias("name"), "b.manifest")


def by_depth(components: DataFrame) -> DataFrame:
    """Components with their depth, the deepest first, then by path: the order in which the nearest one is looked for."""
    return components.withColumn("depth", F.size(F.split("root", "/"))).orderBy(F.desc("depth"), "root")


def assign(files: DataFrame, path: str, components: DataFrame) -> DataFrame:
    """``files`` with ``component_root``: the nearest folder above that is a component, else null.

    Every distinct folder, not every file, is taken apart into the folders above it; those meet the components
    in an equi-join, and the longest wins. Files join their folder's answer.
    """
    folder = T.directory(F.col(path))
    folders = files.where(F.col(path).isNotNull()).select(folder.alias("__dir")).distinct()
    parts = F.split("__dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    up = folders.select("__dir", F.explode(above).alias("root"))
    near = up.join(small(components.select("root").distinct()), "root").groupBy("__dir").agg(F.max_by("root", F.length("root")).alias("component_root"))
    return files.withColumn("__dir", folder).join(near, "__dir", "left").drop("__dir")
