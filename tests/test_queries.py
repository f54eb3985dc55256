from __future__ import annotations

import pytest

from scorewright import plans
from tests.compare import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    same(plans.QUERIES[name](spark, SF), SF, plans.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_query_runs(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0
