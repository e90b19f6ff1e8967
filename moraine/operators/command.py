"""What all commands share: options, their source, and how they end."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ValidationError, check
from ..plans.parser import parse
from ..plans.predicates import Predicate, and_, between, equal, is_null, not_null, or_
from ..sources.commit import Batch, Change, CommitMetrics, Transaction, isolation_for
from ..sources.metadata import MAIN, Table
from ..sources.writer import Writer, wrapped

#: Combinations of values that a filter may list; more are joined as a table.
MOST_VALUES = 10_000


class Command:
    """Options are methods that return the command, so they chain; ``execute`` runs it."""

    kind = ""  # whose isolation property holds

    def __init__(self, engine, target: str | Table | Batch):
        self.engine = engine
        self.batch = target if isinstance(target, Batch) else None
        if self.batch:
            self.table = self.batch.table
            self._branch = self.batch.branch
        else:
            self.table = engine.table(target if isinstance(target, str) else target.name, refresh=True)
            self._branch = MAIN
        self._metadata: dict[str, str] = {}
        self._isolation: str | None = None
        self._skip_sort = False
        self._process = engine.process_source_tables
        self._once = False
        self._columns: list[str] | None = None
        self._source = None

    def _alone(self, what: str) -> None:
        check(not self.batch, "Set %s on the batch transaction.", what)

    def branch(self, name: str):
        self._alone("branch")
        self._branch = name
        return self

    def snapshot_metadata(self, values: dict[str, str]):
        self._alone("snapshot metadata")
        self._metadata = dict(values)
        return self

    def isolation_level(self, level: str):
        self._alone("isolation level")
        self._isolation = level
        return self

    def skip_data_sorting(self, skip: bool = True):
        self._skip_sort = skip
        return self

    def process_source_tables(self, process: bool = True):
        self._process = process
        return self

    def execute_sql_once_only(self, once: bool = True):
        """Write the source's rows once before anything else reads them."""
        self._once = once
        return self

    def sql(self, text: str, args=None):
        return self._from(lambda: self.engine.source(text, args, self._process))

    def data(self, df: DataFrame):
        return self._from(lambda: df)

    def statement(self, name: str, parameters: dict | None = None):
        """A named SQL template of the engine."""
        return self._from(lambda: self.engine.source(self.engine.templates.text(name, parameters), self.engine.templates.args(name, parameters), self._process))

    def _from(self, make):
        check(self._source is None, "The source is already set")
        self._source = make
        return self

    def columns(self, names: list[str]):
        self._columns = list(names)
        return self

    # --- helpers ---

    def _predicate(self, condition: Predicate | str) -> Predicate:
        return parse(condition, self.table.schema) if isinstance(condition, str) else condition

    def _base(self):
        """The snapshot that the command reads, on its branch (main's if the branch is new)."""
        meta = self.table.meta
        ref = meta.refs.get(self._branch) or meta.refs[MAIN]
        return None if ref.snapshot is None else meta.snapshots[ref.snapshot]

    def _write(self, df: DataFrame):
        try:
            return Writer(self.table, self._skip_sort).write(df)
        except ValidationError:
            raise
        except Exception as e:
            if wrapped(e) is not e:
                raise wrapped(e) from e
            raise

    def _finish(self, change: Change | None) -> CommitMetrics | None:
        """Commit, or join the batch; then there are no metrics yet."""
        if self.batch:
            if change:
                self.batch.add(change)
            return None
        if not change:
            return CommitMetrics(self.table.name)
        t = Transaction(self.table, self._branch, self._metadata, self.engine.application, self.engine.collect)
        return t.commit([change])

    def _level(self) -> str:
        return isolation_for(self.table, self.kind, self._isolation)

    @contextmanager
    def _staging(self):
        """A function that writes a frame once and reads it back; the files go at the end."""
        made = []

        def stage(df: DataFrame) -> DataFrame:
            path = f"{self.table.meta.location}/staging/{uuid.uuid4().hex}"
            made.append(path)
            df.write.option("compression", "zstd").parquet(path)
            return self.engine.spark.read.schema(df.schema).parquet(path)

        try:
            yield stage
        finally:
            for path in made:
                if not self.engine.keep_staging:
                    self.table.catalog.files.remove(path)


def values_filter(df: DataFrame, names: list[str]) -> tuple[Predicate, DataFrame | None]:
    """Rows with one of the combinations of values that ``df`` has in some columns. Null matches null.

    Of up to MOST_VALUES combinations the filter is exact. Of more it has the
    columns' bounds only, for pruning, and the combinations come as a table
    with which rows are to be joined (``among``).
    """
    values = df.select(*[F.col(f"`{n}`") for n in names]).distinct()
    rows = values.limit(MOST_VALUES + 1).collect()
    if len(rows) > MOST_VALUES:
        return and_(*[_bounds(values, n) for n in names]), values
    out = or_()
    for r in rows:
        out = or_(out, and_(*[is_null(n) if v is None else equal(n, v) for n, v in zip(names, r)]))
    return out, None


def _bounds(values: DataFrame, name: str) -> Predicate:
    c = F.col(f"`{name}`")
    odd = F.isnan(c) if isinstance(values.schema[name].dataType, (T.FloatType, T.DoubleType)) else F.lit(False)
    low, high, nulls, nans = values.agg(F.min(c), F.max(c), F.max(c.isNull()), F.max(odd)).first()
    some = or_() if low is None else not_null(name) if nans else between(name, low, high)
    return or_(some, is_null(name)) if nulls else some


def spread(df: DataFrame, rows: int) -> DataFrame:
    """One side of a join, of so many rows at most; many are never broadcast.

    Spark goes by compressed bytes, of which a path that repeats needs next to
    none, while the driver and every executor would hold it once a row.
    """
    return df.hint("merge") if rows > MOST_VALUES else df


def among(rows: DataFrame, values: DataFrame, how: str) -> DataFrame:
    """Rows with one of the combinations (``left_semi``) or none (``left_anti``). Null matches null."""
    v = spread(values, MOST_VALUES + 1).toDF(*[f"_v{i}" for i in range(len(values.columns))])
    same = [F.col(f"`{n}`").eqNullSafe(F.col(f"_v{i}")) for i, n in enumerate(values.columns)]
    return rows.join(v, reduce(lambda a, b: a & b, same), how)
