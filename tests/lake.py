"""Helpers of the engine's tests."""

import uuid

from moraine import Engine


def engine(spark, tmp_path, **options):
    return Engine(spark, str(tmp_path / uuid.uuid4().hex), **{"allow_full_scan": True} | options)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def values(text, names):
    return f"SELECT * FROM VALUES {text} AS x({names})"
