"""Each registered query against its SQL on the smallest tables; those without SQL must give rows."""

import pytest
from compare import differences

from tablewright.plans.oracles import ORACLES
from tablewright.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    assert not differences(df, ORACLES[name], SF) if name in ORACLES else df.count() > 0
