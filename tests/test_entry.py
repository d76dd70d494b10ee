from __future__ import annotations

import __spark_entry__ as entry


def test_contract(spark):
    q, o = entry.queries(), entry.oracle_sql()
    assert o.keys() <= q.keys() and all(map(callable, q.values()))
    assert entry.entry(spark).columns == ["set_type", "src", "tgt", "score"]
