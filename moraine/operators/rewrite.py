"""UPDATE and DELETE by copy on write: only files with a matching row are written anew."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import check
from ..functions.types import coerce, literal
from ..plans.predicates import Predicate, resolve, to_column
from ..plans.pruning import Pruner
from ..sources.commit import Change, CommitMetrics
from ..sources.metadata import DataFile
from ..sources.scan import FILE, TimeTravel, plan, read_table
from .command import Command


class _Rewrite(Command):
    def __init__(self, engine, target):
        super().__init__(engine, target)
        self._condition: Predicate | None = None

    def condition(self, where: Predicate):
        self._condition = where
        return self

    def condition_sql(self, text: str):
        self._condition = self._predicate(text)
        return self

    def _touched(self) -> tuple[list[DataFile], list[DataFile], Predicate]:
        """(files all of whose rows match, files some of whose rows do, the predicate)."""
        check(self._condition is not None, "The condition is mandatory")
        base = self._base()
        p = resolve(self._condition, self.table.schema)
        got = plan(self.table, self._condition, TimeTravel(snapshot=base.id) if base else None)
        pruner = Pruner(self.table.schema, self.table.meta.specs)
        whole = [f for f in got.files if pruner.must_match(p, f)]
        sure = {f.path for f in whole}
        rest = [f for f in got.files if f.path not in sure]
        if rest:
            rows = read_table(self.table, [f.path for f in rest], file_columns=True)
            hit = {r[0] for r in rows.where(to_column(p, self.table.schema)).select(FILE).distinct().collect()}
            rest = [f for f in rest if f.path in hit]
        return whole, rest, p


class Delete(_Rewrite):
    """Rows for which the condition is null stay."""

    kind = "delete"

    def execute(self) -> CommitMetrics | None:
        whole, some, p = self._touched()
        if not whole and not some:
            return self._finish(None)
        added = []
        if some:
            rows = read_table(self.table, [f.path for f in some])
            added = self._write(rows.where(~F.coalesce(to_column(p, self.table.schema), F.lit(False))))
        base = self._base()
        return self._finish(Change(added, whole + some, base.id if base else None, self._condition, self._level()))


class Update(_Rewrite):
    """Sets columns of matching rows to constants."""

    kind = "update"

    def __init__(self, engine, target):
        super().__init__(engine, target)
        self._sets: dict[str, object] = {}

    def update_sets(self, values: dict[str, object]):
        for name, value in values.items():
            f = next((f for f in self.table.schema if f.name == name), None) or next((f for f in self.table.schema if f.name.lower() == name.lower()), None)
            check(f is not None, "Could not find column %s", name)
            check(not isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)), "Only columns of primitive types can be updated: %s", name)
            self._sets[f.name] = coerce(value, f.dataType, f"value for column {f.name}")
        return self

    def execute(self) -> CommitMetrics | None:
        check(self._sets, "Update sets are mandatory")
        whole, some, p = self._touched()
        files = whole + some
        if not files:
            return self._finish(None)
        rows = read_table(self.table, [f.path for f in files])
        hit = to_column(p, self.table.schema)
        kinds = {f.name: f.dataType for f in self.table.schema}
        new = rows.select(*[F.when(hit, literal(self._sets[n], kinds[n])).otherwise(F.col(f"`{n}`")).alias(n) if n in self._sets else F.col(f"`{n}`") for n in rows.columns])
        added = self._write(new)
        base = self._base()
        return self._finish(Change(added, files, base.id if base else None, self._condition, self._level()))
