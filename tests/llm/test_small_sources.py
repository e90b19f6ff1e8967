"""Mixing where one source is tiny beside the others."""

from moraine.llm import mixing

DOCS = "doc_id long, text string, source string"


def test_tiny_sources_get_their_target(spark):
    rows = [(1000 * s + k, "w " * 20_000, f"s{s:02}") for s in range(20) for k in range(5)]
    # 60 words far below a block, and some hundreds that make one or a few
    rows += [(90_000 + k, "tiny " * 20, "s05tiny") for k in range(3)] + [(91_000, "few " * 700, "s11few"), (92_000, "last " * 30, "zlast"), (93_000, "null " * 9, None)]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.taken(df).collect()
    for s in {r.source for r in got}:
        mine = [r for r in got if r.source == s]
        goal = round(mine[0].target)
        assert goal * (1 - 1 / mixing.LACK) <= sum(r.taken for r in mine) <= goal
        assert all(0 <= r.taken <= 3 * r.size for r in mine)
    kept = {r.doc_id for r in mixing.mixed_documents(df).select("doc_id").collect()}
    assert {90_000, 90_001, 90_002, 91_000, 92_000, 93_000} <= kept
    _, pieces = mixing.mix(df)
    slots = pieces.groupBy("slot").agg({"sid": "min", "*": "count"}).collect()
    assert pieces.select("slot", "sid").distinct().count() == len(slots)
