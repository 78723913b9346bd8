"""Queries by topic; ``load()`` imports them all and returns the registry."""

import importlib

MODULES = ("bars", "rolling", "features", "edge", "metrics", "calib", "decide", "train", "streams")


def load():
    from . import registry

    for m in MODULES:
        importlib.import_module(f"{__name__}.{m}")
    return registry
