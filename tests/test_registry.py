import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    from millrace.plans import registry

    assert set(registry.queries()) == set(registry.oracle_sql())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_entry_and_queries_run(spark):
    import __spark_entry__ as e
    from millrace.plans import registry

    assert e.entry(spark).count() > 0
    for name, q in registry.queries().items():
        assert q(spark, DATA).schema, name
