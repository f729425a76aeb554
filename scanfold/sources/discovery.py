"""What a platform keeps where: walks of a folder and the places an agent platform reads from its home folder."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanfold.functions import text as T
from scanfold.operators import paths

# Extensions that a walk of an agent's folder, its plugins and its skills take.
AGENT_FILES = "js ts mjs cjs py json yaml yml toml md sh bash zsh ps1 psm1 psd1 bat cmd".split()
PLUGIN_FILES = "js ts mjs cjs json md".split()
SKILL_FILES = "md js ts mjs cjs py sh bash zsh json yaml yml".split()
HOOK_DEPTH, SKILL_DEPTH = 2, 4
FIRST = ("mcp_server", "plugin", "hook")  # kinds that win where a path is found as several


def agent_walk(files: DataFrame, path: str = "path") -> DataFrame:
    """(path, kind, name) of the files of an agent's folder that are scanned; no folder is pruned."""
    p = F.col(path)
    kept = files.where(paths.is_scanned(p, prune=False, extensions=AGENT_FILES) & ~T.extension(p).isin(*paths.BINARY))
    return kept.select(p.alias("path"), paths.component_type(p).alias("kind"), T.file_name(p).alias("name"))


def agent_home(files: DataFrame, home: Column, path: str = "path", folder: str = "") -> DataFrame:
    """(path, kind, name) of what an agent reads from ``home``: plugins, hooks, settings with their servers, instructions, skills and commands.

    ``folder`` is the platform's folder inside the home folder, '' if they are one. A path found as several kinds is the
    one of ``FIRST``, then the one found first. One pass over the paths; each distinct path gives one row.
    """
    p = F.col("path")
    base = F.concat(home, F.lit(f"/{folder}" if folder else ""))
    inside = lambda root: F.when(F.startswith(p, F.concat(root, F.lit("/"))), F.substr(p, F.length(root) + 2))
    rel, ext, name = inside(base), T.extension(p), T.file_name(p)
    below = lambda d: F.when(F.startswith(rel, F.lit(f"{d}/")), F.size(F.split(rel, "/")) - 1)
    text = ~ext.isin(*paths.BINARY)
    kind = paths.component_type(p)
    found = [
        (below("plugins").isNotNull() & ext.isin(*PLUGIN_FILES), kind, name),
        (rel == "settings.json", F.lit("config"), F.lit("settings.json")),
        (below("hooks") <= HOOK_DEPTH, F.lit("hook"), name),
        (rel == "settings.json", F.lit("mcp_server"), F.lit("settings.json (servers)")),
        (inside(home) == ".claude.json", F.lit("mcp_server"), F.lit(".claude.json")),
        (rel == "CLAUDE.md", F.lit("prompt"), F.lit("CLAUDE.md (global)")),
        (inside(home) == "CLAUDE.md", F.lit("prompt"), F.lit("CLAUDE.md (home)")),
        ((below("commands") <= SKILL_DEPTH) & ext.isin(*SKILL_FILES), kind, F.concat(F.lit("command: "), paths.skill_name(p))),
        ((below("skills") <= SKILL_DEPTH) & ext.isin(*SKILL_FILES), kind, F.concat(F.lit("skill: "), paths.skill_name(p))),
    ]
    each = [F.when(cond & text, F.struct((~k.isin(*FIRST)).cast("int").alias("late"), F.lit(n).alias("no"), k.alias("kind"), label.alias("name"))) for n, (cond, k, label) in enumerate(found)]
    best = files.select(F.col(path).alias("path")).where(p.isNotNull()).select("path", F.array_min(F.array_compact(F.array(*each))).alias("b")).where(F.col("b").isNotNull())
    return best.groupBy("path").agg(F.min("b").alias("b")).select("path", "b.kind", "b.name")


class PlatformAdapter(Protocol):
    """What a platform must tell. Frames of files have the column path."""

    name: str

    def is_present(self, files: DataFrame) -> bool:
        """Does anything of the platform exist among the files?"""

    def discover(self, files: DataFrame) -> DataFrame:
        """(path, kind, name) of all its components."""

    def discover_at(self, files: DataFrame, root: str) -> DataFrame:
        """The same of the files below a folder."""


def _below(files: DataFrame, root: str) -> DataFrame:
    return files.where((F.col("path") == root) | F.col("path").startswith(root.rstrip("/") + "/"))


class AgentAdapter:
    """An agent platform with a folder of its own in a home folder."""

    name = "agent"

    def __init__(self, home: str = "", folder: str = ".claude") -> None:
        self.home, self.folder = home.rstrip("/"), folder

    def is_present(self, files: DataFrame) -> bool:
        return not _below(files, f"{self.home}/{self.folder}").isEmpty()

    def discover(self, files: DataFrame) -> DataFrame:
        return agent_home(files, F.lit(self.home), folder=self.folder)

    def discover_at(self, files: DataFrame, root: str) -> DataFrame:
        """A file that is named itself is taken whatever its extension, unless it is binary."""
        p = F.col("path")
        lone = files.where((p == root) & ~T.extension(p).isin(*paths.BINARY)).select("path", paths.component_type(p).alias("kind"), T.file_name(p).alias("name"))
        return agent_walk(_below(files, root).where(p != root)).unionByName(lone)


class GenericAdapter:
    """Any folder."""

    name = "generic"

    def is_present(self, files: DataFrame) -> bool:
        return not files.isEmpty()

    def discover(self, files: DataFrame) -> DataFrame:
        p = F.col("path")
        return files.where(paths.is_scanned(p)).select("path", paths.component_type(p).alias("kind"), T.file_name(p).alias("name"))

    def discover_at(self, files: DataFrame, root: str) -> DataFrame:
        return self.discover(_below(files, root))


def create_adapter(platform: str, home: str = "") -> PlatformAdapter:
    """The adapter of a platform by name; one without an adapter of its own is generic."""
    return AgentAdapter(home) if platform == AgentAdapter.name else GenericAdapter()


def detect_platform(files: DataFrame, home: str = "") -> str | None:
    """The platform that is there: the agent platform is recognised, no other is."""
    return AgentAdapter.name if AgentAdapter(home).is_present(files) else None
