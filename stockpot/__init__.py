"""stockpot: a Spark-native engine for building and querying recipe search indexes."""

from __future__ import annotations

from importlib import import_module

__version__ = "0.1.0"
#: What the package exports, by module; a module is imported when one of its names is first used.
EXPORTS = {
    "functions.recipes": ("normalise",),
    "functions.html": ("crawl_docs",),
    "operators.index": ("Index", "build"),
    "operators.enrich": ("enrich",),
    "plans.crawl": ("Crawl",),
    "plans.hybrid": ("batch", "did_you_mean", "parse", "run", "run_corrected"),
    "plans.pages": ("canonical", "gram_index", "recipe_index"),
    "sources.store": ("Memory", "Store"),
}
_WHERE = {name: module for module, names in EXPORTS.items() for name in names}
EXPORTS_NAMES = sorted(_WHERE)


def __getattr__(name: str):
    if name not in _WHERE:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f"{__name__}.{_WHERE[name]}"), name)
