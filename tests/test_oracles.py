"""Queries against their SQL, on the smallest tables. The slowest are left to the driver."""

import datetime

import duckdb
import numpy as np
import pytest

from palimpsest.plans import catalog, catalog_stats  # noqa: F401

SLOW = {"near_dup_sensitivity", "borderline_pairs", "near_dup_screen", "cluster_stats", "component_exclusions", "kappa_bootstrap", "content_hashes", "label_conflicts", "exact_prefix_flags", "prefix_overlap", "flag_reasons", "draw_balanced", "length_quota", "universe_sample", "binary_metrics", "norm_light", "seed_pair_mean", "format_summary", "model_difference", "random_drop_paired", "label_mapping", "filter_short"}


@pytest.fixture(scope="module")
def duck(sf):
    import glob
    import os

    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and np.isnan(v)):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return float(v)
    if isinstance(v, (float, np.floating)):
        return round(float(v), 7) + 0.0
    if isinstance(v, (list, tuple, np.ndarray)):
        return str([plain(x) for x in v])
    return v.isoformat() if isinstance(v, datetime.datetime) else str(v)


@pytest.mark.parametrize("name", [n for n in catalog.SQL if n not in SLOW])
def test_query_equals_sql(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    got = duck.execute(catalog.SQL[name])
    names = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(names)
    cols = sorted(names)
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in got.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str) == want
