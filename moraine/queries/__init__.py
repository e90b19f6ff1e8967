"""Queries of the table engine over the tables of a data folder, each with its SQL for DuckDB."""

from .changes import CHANGES
from .guards import GUARDS
from .reads import READS

QUERIES = {q.name: q.run for q in (*READS, *CHANGES, *GUARDS)}
ORACLE_SQL = {q.name: q.oracle for q in (*READS, *CHANGES, *GUARDS) if q.oracle}
