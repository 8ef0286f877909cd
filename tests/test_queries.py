"""Every registered query of the library against its SQL."""

import pytest
from oracle import assert_same

from textveil.plans import registry


def test_every_query_has_sql():
    # the listing of files hangs on how the tables were written
    assert set(registry.QUERIES) - set(registry.ORACLES) == {"file_listing"}


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, sf_dir, name):
    assert_same(registry.QUERIES[name](spark, sf_dir), registry.ORACLES[name], sf_dir)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
