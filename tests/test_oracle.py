"""Every registered query outside the training-data operators against its SQL."""

import pytest

from tests.compare import differences, views
from vellumspark.plans import registry

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return views(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.load()))
def test_query(spark, con, name):
    q = registry.load()[name]
    if q.sql:
        assert differences(spark, con, name, q.run, q.sql, FOLDER) is None
    else:
        assert q.run(spark, FOLDER).count() > 0
