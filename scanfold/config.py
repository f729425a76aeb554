"""Settings of a scan, from a TOML file; decided before a plan is built."""

from __future__ import annotations

import hashlib
import os
import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path

from scanfold.operators.paths import SkipConfig

FILE_NAME = "scanfold.toml"
TEMPLATE = """# Settings of a scan. Every line may be left out.
skip_globs = ["**/CHANGELOG*", "**/LICENSE*"]   # never skips executable files
trusted_packages = []                           # packages in node_modules that aren't scanned
trusted_paths = []                              # parts of paths that are trusted, code included
skip_node_modules = false
skip_python_cache = true
entropy_threshold = 5.5
disabled_rules = []
third_party_only = false
rule_folders = []                               # JSON rule files of your own
min_severity = "low"
include_dev = false
"""


@dataclass(frozen=True)
class Config:
    skip_globs: tuple[str, ...] = ()
    trusted_packages: tuple[str, ...] = ()
    trusted_paths: tuple[str, ...] = ()
    skip_node_modules: bool = False
    skip_python_cache: bool = False
    entropy_threshold: float = 5.5
    disabled_rules: tuple[str, ...] = ()
    third_party_only: bool = False
    rule_folders: tuple[str, ...] = field(default=())
    min_severity: str = "info"
    include_dev: bool = False

    @classmethod
    def load(cls, path: str | Path) -> Config:
        """The settings of a file. Unknown names are refused, as they are likely misspelt."""
        data = tomllib.loads(Path(path).read_text())
        known = {f.name for f in fields(cls)}
        if odd := sorted(set(data) - known):
            raise ValueError(f"{path}: unknown settings {', '.join(odd)}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in data.items()})

    @classmethod
    def find(cls, explicit: str | None = None, folder: str = ".", home: str | None = None) -> Config:
        """The explicit file, else the folder's, else the home folder's, else the defaults."""
        if explicit:
            return cls.load(explicit)
        for place in (folder, home or os.path.expanduser("~")):
            path = Path(place) / FILE_NAME
            if path.exists():
                return cls.load(path)
        return cls()

    def skip(self) -> SkipConfig:
        return SkipConfig(self.skip_globs, self.skip_node_modules, self.skip_python_cache, self.trusted_packages, self.trusted_paths, self.disabled_rules)

    def folders(self) -> list[str]:
        return [os.path.expanduser(f) for f in self.rule_folders]

    def profile(self, patterns: list) -> str:
        """What results depend on beside the text: the settings and the rules' content. Part of a cache's key."""
        parts = [repr(self.entropy_threshold), *sorted(repr(p) for p in patterns)]
        return hashlib.sha256("\n".join(parts).encode()).hexdigest()


def write_template(path: str | Path) -> bool:
    """Write the default settings; an existing file is left alone."""
    path = Path(path)
    if path.exists():
        return False
    path.write_text(TEMPLATE)
    return True
