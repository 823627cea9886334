"""The driver contract in __spark_entry__.py."""

import __spark_entry__ as E
from phenospark.queries import all_oracles, all_queries


def test_entry_and_registry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert rows and df.columns == ["flag", "value", "patients"]
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert all(callable(f) for f in q.values())
    # the library's own queries are always there; whatever else is registered comes from the optional subpackage
    assert set(all_queries()) <= set(q) and set(all_oracles()) <= set(o)
    assert (set(q) == set(all_queries())) == (E.corpus_pipeline is None)
