"""Scans large collections of text for security-relevant content, on Spark."""

from __future__ import annotations

from importlib import import_module

# what the package offers, and where it stands; loaded when it is asked for
_OFFERS = {
    "scanfold.engine": ("Engine", "text_source"),
    "scanfold.config": ("Config",),
    "scanfold.session": ("get_session",),
    "scanfold.rules": ("load_rules", "compile_rules", "select_rules", "self_tests"),
    "scanfold.sources.discovery": ("PlatformAdapter", "create_adapter", "detect_platform"),
    "scanfold.operators.js": ("Detector",),
    "scanfold.sinks.report": ("render",),
}
__all__ = [n for names in _OFFERS.values() for n in names]


def __getattr__(name: str):
    for module, names in _OFFERS.items():
        if name in names:
            return getattr(import_module(module), name)
    raise AttributeError(name)
