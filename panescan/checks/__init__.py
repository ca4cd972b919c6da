"""Registered queries over the given tables, each with an independent SQL twin where SQL can say it."""

from __future__ import annotations

import importlib
from functools import wraps

from panescan.session import ship_package

MODULES = ["mask_metrics", "gray_layers", "mask_layers", "tile_forms", "regrid_forms", "boxes_patches", "mask_regions", "scores_votes", "training_history", "files_plans", "scoring_streams", "file_round_trips"]


def _shipped(fn):
    """Workers may start in any folder, so the package travels with the first query."""

    @wraps(fn)
    def run(spark, sf_dir):
        ship_package(spark)
        return fn(spark, sf_dir)

    return run


def load() -> tuple[dict, dict]:
    queries, sql = {}, {}
    for name in MODULES:
        module = importlib.import_module(f"{__name__}.{name}")
        clash = queries.keys() & module.QUERIES.keys()
        if clash:
            raise ValueError(f"query registered twice: {sorted(clash)}")
        queries.update({k: _shipped(fn) for k, fn in module.QUERIES.items()})
        sql.update(module.SQL)
    return queries, sql
