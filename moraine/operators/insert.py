"""INSERT, and INSERT OVERWRITE by a filter, a condition in SQL, or the source's own values."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..errors import check
from ..plans.predicates import Predicate
from ..sources.commit import Change, CommitMetrics
from ..sources.metadata import DataFile
from ..sources.scan import FILE, TimeTravel, plan, read_table
from ..sources.writer import project
from .command import Command, among, values_filter


class Insert(Command):
    def __init__(self, engine, target):
        super().__init__(engine, target)
        self._filter: Predicate | None = None
        self._filter_columns: list[str] | None = None

    def overwrite_by_filter(self, condition: Predicate):
        self._filter = condition
        return self

    def overwrite_by_filter_sql(self, text: str):
        self._filter = self._predicate(text)
        return self

    def overwrite_by_filter_columns(self, names: list[str]):
        known = set(self.table.schema.names)
        check(names and all(n in known for n in names), "Filter columns must be columns of the table: %s", names)
        self._filter_columns = list(names)
        return self

    def execute(self) -> CommitMetrics | None:
        """An empty source changes nothing, not even with a filter.

        Where filter columns have too many combinations of values for a filter,
        files that hold other rows as well are written anew without the matches.
        """
        check(self._source is not None, "The source is mandatory")
        check(self._filter is None or self._filter_columns is None, "Only one kind of overwrite filter may be set")
        base = self._base()
        with self._staging() as stage:
            rows = project(self._source(), self.table.schema, self._columns)
            files = self._write(stage(rows) if self._once else rows)
            if not files:
                return self._finish(None)
            where = self._filter
            if self._filter_columns:
                # from what was written, so that the source runs once
                where, values = values_filter(read_table(self.table, [f.path for f in files]), self._filter_columns)
                if values is not None:
                    return self._replace(files, where, stage(values), base)
        if where is None:
            return self._finish(Change(files, base=base.id if base else None))
        return self._finish(Change(files, [], base.id if base else None, where, self._level(), where))

    def _replace(self, files: list[DataFile], where: Predicate, values: DataFrame, base) -> CommitMetrics | None:
        old = plan(self.table, where, TimeTravel(snapshot=base.id) if base else None).files
        touched = []
        if old:
            rows = read_table(self.table, [f.path for f in old], file_columns=True)
            hit = {r[0] for r in among(rows, values, "left_semi").select(FILE).distinct().collect()}  # a path a file
            touched = [f for f in old if f.path in hit]
        if touched:
            files = files + self._write(among(read_table(self.table, [f.path for f in touched]), values, "left_anti"))
        return self._finish(Change(files, touched, base.id if base else None, where, self._level()))
