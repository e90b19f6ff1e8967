"""A query is a text or function over lake tables that are made from a data folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..engine import Engine
from ..sources.shared import shared_folder

#: Partitioning and sort order of the tables made.
LAYOUT = {
    "lineitem": (["year(l_shipdate)"], ["l_orderkey"]),
    "orders": (["year(o_orderdate)"], ["o_orderkey"]),
    "events": (["day(ts)"], []),
}


def engine_for(spark: SparkSession, **options) -> Engine:
    """An engine on a new warehouse in the folder that all executors share."""
    return Engine(spark, f"{shared_folder(spark)}/warehouse-{uuid.uuid4().hex}", **{"allow_full_scan": True} | options)


def sources(engine: Engine, sf_dir: str, *names: str) -> None:
    """Plain views of the data folder's tables."""
    for n in names:
        engine.register(n, engine.spark.read.parquet(f"{sf_dir}/{n}.parquet"))


def lake_table(engine: Engine, sf_dir: str, name: str, partitioning: list | None = None, sort_order: list | None = None) -> None:
    """``db.<name>`` with all rows of the data folder's table."""
    sources(engine, sf_dir, name)
    layout = LAYOUT.get(name, ([], []))
    df = engine.spark.table(name)
    engine.create_table(f"db.{name}", df.schema, layout[0] if partitioning is None else partitioning, layout[1] if sort_order is None else sort_order)
    engine.insert_into(f"db.{name}").data(df).execute()


@dataclass
class Query:
    """``text``: Spark SQL over ``db.<table>`` for each of ``tables``; or ``make(engine, sf_dir)``."""

    name: str
    oracle: str | None
    tables: tuple[str, ...] = ()
    text: str = ""
    args: list | None = None
    make: Callable[[Engine, str], DataFrame] | None = None
    layout: tuple[list, list] | None = None

    def setup(self, engine: Engine, sf_dir: str) -> None:
        for t in self.tables:
            lake_table(engine, sf_dir, t, *(self.layout or (None, None)))

    def result(self, engine: Engine, sf_dir: str) -> DataFrame:
        return self.make(engine, sf_dir) if self.make else engine.sql(self.text, self.args)

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = engine_for(spark)
        self.setup(engine, sf_dir)
        return self.result(engine, sf_dir)
