"""The SQL of the mix, on tables with tiny sources beside large ones."""

import random

import duckdb
import pytest

from moraine.llm import mixing
from moraine.llm.oracles import MIX


@pytest.mark.parametrize("few", [mixing.FEW_SOURCES, 0])
def test_sql_agrees(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "FEW_SOURCES", few)  # with 0 nothing is broadcast
    r = random.Random(few)
    rows = [(1000 * s + k, "w " * r.randrange(900, 1400), f"s{s:02}") for s in range(8) for k in range(20)]
    rows += [(9000 + k, "tiny " * 20, "s03tiny") for k in range(3)] + [(9100, "few " * 300, "s05few"), (9200, "last " * 30, "zlast"), (9300, "null " * 9, None), (9400, None, "s01"), (9500, "", "only empty")]
    got = mixing.taken(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    duck = duckdb.connect()
    duck.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    duck.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    want = duck.execute(MIX).fetchall()
    plain = lambda xs: sorted((x[0], x[1], x[2], round(x[3], 6), x[4], str(x[5])) for x in xs)
    assert plain(got) == plain(want)
