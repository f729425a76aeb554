"""Queries on paths: skipping, scope, kinds and components; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanfold.functions import globs
from scanfold.functions import text as T
from scanfold.operators import components, paths
from scanfold.sources.tables import table

ROOT = r"^(/srv/scan/[^/]+)"
CONFIG = paths.SkipConfig(trusted_paths=("/vendor/",), skip_globs=("**/CHANGELOG*", "**/*.lock", "**/*-lock.json"), trusted_packages=("lodash",))


def _paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "scan_results").where(F.col("path").isNotNull()).select("path").distinct()


def _relative() -> F.Column:
    return T.relative_path(F.col("path"), F.regexp_extract("path", ROOT, 1))


def path_skip(spark: SparkSession, d: str) -> DataFrame:
    """Which paths aren't scanned, and which are of trusted origin."""
    return _paths(spark, d).select("path", paths.should_skip(F.col("path"), CONFIG).alias("skip"), paths.is_trusted_source(F.col("path"), CONFIG).alias("trusted"))


def path_walk(spark: SparkSession, d: str) -> DataFrame:
    """What a walk keeps, and what it calls it."""
    p = _paths(spark, d).where(paths.is_scanned(F.col("path")))
    return p.select("path", T.extension(F.col("path")).alias("ext"), paths.component_type(F.col("path")).alias("kind"), paths.skill_name(F.col("path")).alias("name"))


def path_hooks_and_skills(spark: SparkSession, d: str) -> DataFrame:
    """Files at most two folders below plugins, or at most four below skills."""
    depth = lambda f: paths.depth_below(F.col("path"), f)
    return _paths(spark, d).where((depth("plugins") <= 2) | (depth("skills") <= 4)).select("path", F.coalesce(depth("plugins"), depth("skills")).alias("depth"))


def scope_classify(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d).select("path", paths.install_scope(_relative()).alias("scope"))


def scope_whitelist(spark: SparkSession, d: str) -> DataFrame:
    """The same under a manifest that lists what it ships."""
    ships = paths.npm_whitelist({"files": ["skills", "plugins/"], "main": "index.js"})
    return _paths(spark, d).select("path", paths.install_scope(_relative(), ships).alias("scope"))


def _components(spark: SparkSession, d: str) -> DataFrame:
    return components.detect(_paths(spark, d), "path")


def component_detect(spark: SparkSession, d: str) -> DataFrame:
    return _components(spark, d)


def component_assign(spark: SparkSession, d: str) -> DataFrame:
    """The nearest component above every file."""
    return components.assign(_paths(spark, d), "path", _components(spark, d))


def component_kinds(spark: SparkSession, d: str) -> DataFrame:
    return _components(spark, d).groupBy("kind").agg(F.count("*").alias("n"))


def normal_paths(spark: SparkSession, d: str) -> DataFrame:
    """Findings' files, written with either separator, as one form."""
    f = table(spark, d, "findings").where(F.col("location.file").isNotNull()).select(F.col("location.file").alias("file")).distinct()
    return f.select("file", T.normal_path(F.col("file")).alias("normal"))


QUERIES = {f.__name__: f for f in (path_skip, path_walk, path_hooks_and_skills, scope_classify, scope_whitelist, component_detect, component_assign, component_kinds, normal_paths)}


def _in(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _any(globs_: list[str]) -> str:
    return globs.any_glob(globs_)


_NAME = "regexp_extract({p}, '([^/]*)$', 1)"
_P = rf"""with p as (select distinct path, regexp_extract(path, '([^/]*)$', 1) name, lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^.+\.([^.]*)$', 1)) ext,
  case when regexp_matches(path, '^/srv/scan/[^/]+/') then regexp_replace(path, '^/srv/scan/[^/]+/', '') else path end rel from scan_results where path is not null)
"""
_TRUST = " or ".join(f"contains(path, '{x}')" for x in [*paths.SYSTEM_CACHES, *CONFIG.trusted_paths])
_DEV = [*(f"{x}/**" for x in paths.DEV_DIRS), *paths.DEV_FILES]
_SHIPS = paths.npm_whitelist({"files": ["skills", "plugins/"], "main": "index.js"})
_KIND = "case name when 'SKILL.md' then 'skill' when 'mcp.json' then 'mcp_server' when 'plugin.json' then 'plugin' when 'package.json' then 'npm_package' when 'Cargo.toml' then 'rust_crate' end"
_COMP = f""", m as (select path manifest, regexp_replace(path, '/[^/]*$', '') root, {_KIND} kind, list_position(['Cargo.toml','package.json','plugin.json','mcp.json','SKILL.md'], name) prio from p where name in {_in(list(components.MARKERS))}),
c as (select root, kind, regexp_extract(root, '([^/]*)$', 1) name, manifest from m qualify row_number() over (partition by root order by prio desc, manifest) = 1)
"""
_SCOPE = f"case when regexp_matches(rel, '{_any(paths.ALWAYS_IN_SCOPE)}') then 'installed' when regexp_matches(name, '{_any(paths.ALWAYS_IN_SCOPE)}') and not regexp_matches(rel, '{_any(_DEV)}') then 'installed'"
ORACLE = {
    "path_skip": _P
    + f"""select path, case when {_TRUST} then true when contains(path, '__pycache__') or contains(path, '.venv') then true when contains(path, 'node_modules/lodash/') then true
      when ext in {_in(paths.EXECUTABLE)} then false else regexp_matches(path, '{_any(list(CONFIG.skip_globs))}') end skip,
      ({_TRUST} or contains(path, '/VSCode/') or contains(path, 'node_modules/lodash/')) trusted from p""",
    "path_walk": _P
    + f"""select path, ext, case when ext in ('js','ts','mjs','cjs','py') then 'plugin' when ext in ('json','yaml','yml','toml') then 'config' when ext in ('md','txt') then 'prompt' else 'hook' end kind,
      case when name = 'SKILL.md' then string_split(path, '/')[-2] else regexp_replace(name, '^(.+)\\.[^.]*$', '\\1') end name
      from p where ext in {_in(paths.SCANNED)} and not regexp_matches(path, '(?:^|/)(?:node_modules|\\.git|\\.svn|target|dist|build|__pycache__|\\.venv|venv)/')""",
    "path_hooks_and_skills": _P
    + """, x as (select path, nullif(regexp_extract(path, '(?:^|/)plugins/(.*)$', 1), '') a, nullif(regexp_extract(path, '(?:^|/)skills/(.*)$', 1), '') b from p),
      y as (select path, len(string_split(a, '/')) a, len(string_split(b, '/')) b from x) select path, coalesce(a, b)::int depth from y where a <= 2 or b <= 4""",
    "scope_classify": _P + f"select path, {_SCOPE} when regexp_matches(rel, '{_any(_DEV)}') or regexp_matches(name, '{_any(_DEV)}') then 'dev_only' else 'installed' end scope from p",
    "scope_whitelist": _P + f"select path, {_SCOPE} when regexp_matches(rel, '{_any(_SHIPS)}') then 'installed' else 'dev_only' end scope from p",
    "component_detect": _P + _COMP + "select root, kind, name, manifest from c",
    "component_assign": _P + _COMP + "select path, max_by(root, length(root)) component_root from p left join c on starts_with(path, root || '/') group by path",
    "component_kinds": _P + _COMP + "select kind, count(*) n from c group by kind",
    # parts are folded one by one: `..` takes away the part before it
    "normal_paths": r"""with recursive f as (select distinct location.file file from findings where location.file is not null),
      p as (select file, list_filter(string_split(replace(file, '\', '/'), '/'), lambda x: x not in ('', '.')) parts from f),
      s as (select file, parts, 1 k, []::varchar[] acc from p
            union all select file, parts, k + 1, case when parts[k] = '..' then acc[1:greatest(len(acc) - 1, 0)] else list_append(acc, parts[k]) end from s where k <= len(parts))
      select file, case when starts_with(replace(file, '\', '/'), '/') then '/' else '' end || array_to_string(acc, '/') normal from s where k = len(parts) + 1""",
}
