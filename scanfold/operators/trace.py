"""Which files an agent can be led to: references between files, followed from instruction files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanfold.functions import text as T
from scanfold.operators.paths import INSTRUCTIONS
from scanfold.session import spread, written

# How a text refers to a file; the first group that matched is the path.
VERB = r"(?i)\b(?:read|execute|run|follow\s+(?:the\s+)?instructions?\s+in|source|include)\s+(?:`([^`]+)`|\"([^\"]+)\"|'([^']+)'|(\S+\.\w{1,5}))"
LINK = r"\[(?:[^\]]*)\]\(([^)]+\.\w{1,5})\)"
TICK = r"`((?:\./|\.\./)?\w[\w\-./]*\.\w{1,5})`"
TRACEABLE = "md txt sh py js ts yaml yml json".split()
FOLLOWED = "md txt".split()
MAX_DEPTH = 3


def _first_group(pattern: str, groups: int) -> Callable[[Column], Column]:
    """The first group of a match that isn't empty."""
    return lambda m: F.coalesce(*[F.nullif(F.regexp_extract(m, pattern, k), F.lit("")) for k in range(1, groups + 1)], F.lit(""))


def references(files: DataFrame, path: str, text: str, root: str) -> DataFrame:
    """(src, dst): distinct references between files that exist under the same root.

    `./` and `../` start at the referring file's folder; other paths are tried there first, then at the root.
    Addresses and anchors are none. Null texts refer to nothing.
    """
    t = F.col("__t")
    src = spread(files.select(F.col(path).alias("src"), F.col(text).alias("__t"), F.regexp_replace(root, r"/+$", "").alias("__root")))
    # one pass for whole references of each form; the path is then taken out of the few that there are
    whole = F.concat(*[F.transform(F.regexp_extract_all(t, F.lit(p), F.lit(0)), _first_group(p, g)) for p, g in ((VERB, 4), (LINK, 1), (TICK, 1))])
    r = src.select("src", "__root", F.explode_outer(F.array_distinct(F.filter(whole, lambda x: x != ""))).alias("ref")).where(F.col("ref").isNotNull() & ~F.col("ref").rlike(r"^(?:https?://|#)"))
    near = T.normal_path(F.concat_ws("/", T.directory(F.col("src")), "ref"))
    far = F.when(~F.col("ref").rlike(r"^\.\.?/"), T.normal_path(F.concat_ws("/", "__root", "ref")))
    r = r.select("src", "__root", near.alias("near"), far.alias("far"))
    known = files.select(T.normal_path(F.col(path)).alias("__n"), F.col(path).alias("dst")).where(T.extension(F.col(path)).isin(*TRACEABLE)).dropDuplicates(["__n"])
    tries = r.select("src", "__root", F.posexplode_outer(F.array_compact(F.array("near", "far"))).alias("k", "__n"), F.concat_ws("|", "near", "far").alias("__ref"))
    hits = tries.join(known, "__n").where(F.startswith("__n", F.concat("__root", F.lit("/"))))
    return hits.groupBy("src", "__ref").agg(F.min_by("dst", "k").alias("dst")).select("src", "dst").distinct()


def is_instruction(path: F.Column) -> F.Column:
    return T.file_name(path).isin(*INSTRUCTIONS)


def reachable(edges: DataFrame, starts: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """(instruction, path, depth): files reached from each start, by the fewest steps; only prose files are followed.

    ``starts`` has the column ``instruction``. The few steps are unrolled; each is a join with the edges, which are written
    once, so that no step looks for references again.
    """
    edges = written(edges, "edges")
    now = starts.select("instruction", F.col("instruction").alias("path")).distinct()
    out = None
    for k in range(1, depth + 1):
        go = now if k == 1 else now.where(T.extension(F.col("path")).isin(*FOLLOWED))
        now = go.join(edges, go["path"] == edges["src"]).select("instruction", F.col("dst").alias("path")).distinct()
        part = now.withColumn("depth", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out.where(F.col("path") != F.col("instruction")).groupBy("instruction", "path").agg(F.min("depth").alias("depth"))


def referenced_by(reached: DataFrame) -> DataFrame:
    """(path, referenced_by): names of the instruction files that lead to a path, in order, joined."""
    names = F.array_sort(F.collect_set(T.file_name(F.col("instruction"))))  # distinct names, of which there are few
    return reached.groupBy("path").agg(F.array_join(names, ", ").alias("referenced_by"))
