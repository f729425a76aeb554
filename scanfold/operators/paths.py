"""Predicates on paths: what is scanned, what is skipped, what is installed."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanfold.functions import globs
from scanfold.functions import text as T

# Names and extensions by which files are chosen.
EXECUTABLE = "js mjs cjs ts tsx jsx py pyw pyc pyo sh bash zsh fish rb erb pl pm php phtml lua ps1 psm1 psd1 bat cmd jar class exe dll so dylib wasm".split()
SCANNED = "js ts mjs cjs py json yaml yml toml md txt sh bash zsh ps1 psm1 psd1 bat cmd".split()
BINARY = (
    "png jpg jpeg gif bmp ico svg webp tiff tif psd raw heic heif avif woff woff2 ttf otf eot mp3 mp4 avi mov wmv flv wav ogg webm m4a aac flac mkv mpeg mpg zip tar gz bz2 7z rar jar war "
    "ear xz lz lzma tgz tbz2 pdf doc docx xls xlsx ppt pptx odt ods odp exe dll so dylib o obj a lib class pyc pyo wasm bin dat dex db sqlite sqlite3 mdb lock cache"
).split()
PRUNED = "node_modules .git .svn target dist build __pycache__ .venv venv".split()
INSTRUCTIONS = "SKILL.md CLAUDE.md .cursorrules .clinerules copilot-instructions.md AGENTS.md".split()
ALWAYS_IN_SCOPE = (
    "SKILL.md CLAUDE.md .cursorrules .clinerules copilot-instructions.md .github/copilot-instructions.md package.json Cargo.toml pyproject.toml setup.py setup.cfg "
    "README* readme* LICENSE* license* LICENCE* CHANGELOG* changelog*"
).split()
SHIPPED_ALWAYS = "package.json README* readme* LICENSE* license* LICENCE* licence* CHANGELOG* changelog*".split()
DEV_DIRS = (
    "test tests __tests__ spec examples example docs doc benchmarks benches fixtures __fixtures__ __mocks__ .github .circleci .husky e2e cypress playwright coverage .nyc_output dist build out"
).split()
DEV_FILES = (
    "*.test.js *.test.ts *.test.jsx *.test.tsx *.test.mjs *.test.cjs *.spec.js *.spec.ts *.spec.jsx *.spec.tsx *.spec.mjs *.spec.cjs *_test.py test_*.py *_test.rs *_test.go "
    "jest.config.* vitest.config.* Dockerfile Dockerfile.* docker-compose* .editorconfig .gitattributes .eslintrc* .prettierrc* tsconfig.test.json .travis.yml Makefile Gruntfile* Gulpfile* "
    "rollup.config.* webpack.config.* *.min.js *.min.css *.min.mjs vendor-*.js"
).split()
SYSTEM_CACHES = ["/Homebrew/", "/homebrew/", "/Cellar/", "/JetBrains/", "/.vscode/"]


@dataclass(frozen=True)
class SkipConfig:
    """What isn't scanned. ``trusted_paths`` are parts of paths whose files are trusted, code included."""

    skip_globs: tuple[str, ...] = ("**/CHANGELOG*", "**/LICENSE*", "**/*.lock", "**/*.map")
    skip_node_modules: bool = False
    skip_python_cache: bool = True
    trusted_packages: tuple[str, ...] = ()
    trusted_paths: tuple[str, ...] = ()
    disabled_rules: tuple[str, ...] = field(default=())


def _has(path: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | path.contains(p)
    return out


def _in_package(path: Column, packages: tuple[str, ...]) -> Column:
    return path.contains("node_modules") & _has(path, [f"node_modules/{p}{s}" for p in packages for s in ("/", "\\")])


def should_skip(path: Column, cfg: SkipConfig = SkipConfig()) -> Column:
    """Trusted places first, which may hold code; executable files are never skipped by a glob."""
    out = F.when(_has(path, [*SYSTEM_CACHES, *cfg.trusted_paths]), True)
    if cfg.skip_node_modules:
        out = out.when(path.contains("node_modules"), True)
    if cfg.skip_python_cache:
        out = out.when(_has(path, ["__pycache__", ".venv"]), True)
    return out.when(_in_package(path, cfg.trusted_packages), True).when(T.extension(path).isin(*EXECUTABLE), False).otherwise(globs.matches(path, list(cfg.skip_globs)))


def is_trusted_source(path: Column, cfg: SkipConfig = SkipConfig()) -> Column:
    return _has(path, [*SYSTEM_CACHES, "/VSCode/", *cfg.trusted_paths]) | _in_package(path, cfg.trusted_packages)


def is_scanned(path: Column, prune: bool = True, extensions: list[str] = SCANNED) -> Column:
    """Is the file of a kind that is scanned, and outside the folders that a walk prunes?"""
    kept = T.extension(path).isin(*extensions) & ~T.extension(path).isin(*BINARY)
    return kept & ~path.rlike("(?:^|/)(?:" + "|".join(p.replace(".", r"\.") for p in PRUNED) + ")/") if prune else kept


def component_type(path: Column) -> Column:
    """What a generic walk calls a file, by its extension."""
    ext = T.extension(path)
    return (
        F.when(ext.isin("js", "ts", "mjs", "cjs", "py"), "plugin")
        .when(ext.isin("json", "yaml", "yml", "toml"), "config")
        .when(ext.isin("md", "txt"), "prompt")
        .when(ext.isin("sh", "bash", "zsh", "ps1", "psm1", "psd1", "bat", "cmd"), "hook")
        .otherwise("other")
    )


def depth_below(path: Column, folder: str) -> Column:
    """How many parts a path has below a folder of this name; null outside it."""
    rest = F.regexp_extract(path, rf"(?:^|/){folder}/(.*)$", 1)
    return F.when(rest != "", F.size(F.split(rest, "/")))


def skill_name(path: Column) -> Column:
    """The folder that holds a SKILL.md, else the file's own name without its extension."""
    parts = F.split(path, "/")
    return F.when(T.file_name(path) == "SKILL.md", F.get(parts, F.size(parts) - 2)).otherwise(F.regexp_replace(T.file_name(path), r"^(.+)\.[^.]*$", "$1"))


def install_scope(relative: Column, whitelist: list[str] | None = None) -> Column:
    """installed or dev_only, for a path relative to the scanned root.

    Instruction files and manifests are installed, unless a development folder holds them; then the
    manifest's own list decides if there is one, else the customary names of folders and files.
    """
    name = T.file_name(relative)
    dev = [*(f"{d}/**" for d in DEV_DIRS), *DEV_FILES]
    in_dev = globs.matches(relative, dev)
    out = F.when(globs.matches(relative, ALWAYS_IN_SCOPE), "installed").when(globs.matches(name, ALWAYS_IN_SCOPE) & ~in_dev, "installed")
    if whitelist is not None:
        return out.when(globs.matches(relative, whitelist), "installed").otherwise("dev_only")
    return out.when(in_dev | globs.matches(name, dev), "dev_only").otherwise("installed")


def installed_only(files: DataFrame, scope: str = "scope", reachable: str = "reachable") -> DataFrame:
    """Without development files, unless an instruction leads to them."""
    return files.where((F.col(scope) == "installed") | F.coalesce(F.col(reachable), F.lit(False)))


def scope_counts(files: DataFrame, by: list[str], scope: str = "scope", reachable: str = "reachable") -> DataFrame:
    """Per group: files, installed ones, development ones and reachable ones. A file that an instruction leads to counts as installed."""
    led = F.coalesce(F.col(reachable), F.lit(False))
    installed = (F.col(scope) == "installed") | led
    return files.groupBy(*by).agg(F.count("*").alias("n_files"), F.count_if(installed).alias("n_installed"), F.count_if(~installed).alias("n_dev_only"), F.count_if(led).alias("n_reachable"))


def npm_whitelist(package_json: dict) -> list[str] | None:
    """The globs of what a package ships, from its manifest; None without a ``files`` list."""
    files = package_json.get("files")
    if not isinstance(files, list) or not files:
        return None
    out = []
    for f in (x for x in files if isinstance(x, str)):
        out += [f] if "*" in f or "{" in f else [f, f.rstrip("/") + "/**"]
    binary = package_json.get("bin")
    entries = [package_json.get(k) for k in ("main", "module", "types", "typings", "browser")]
    entries += list(binary.values()) if isinstance(binary, dict) else [binary]
    return [*out, *(e for e in entries if isinstance(e, str)), *SHIPPED_ALWAYS]


def project_type(files: DataFrame, path: str, root: str) -> DataFrame:
    """(root, project_type) from the manifests that lie in each root: npm before cargo before python."""
    rel = T.relative_path(F.col(path), F.col(root))
    has = lambda *n: F.max(rel.isin(*n))
    g = files.groupBy(root).agg(has("package.json").alias("n"), has("Cargo.toml").alias("c"), has("pyproject.toml", "setup.py").alias("p"))
    return g.select(root, F.when(F.col("n"), "npm").when(F.col("c"), "cargo").when(F.col("p"), "python").otherwise("unknown").alias("project_type"))
