"""No task ranks the whole dictionary of a field: values are ranked within salts first."""

import re

import pytest

from tessera.plans.registry import QUERIES


@pytest.mark.parametrize("name", ["facet_author", "facet_series"])
def test_ranked_within_salts(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    windows = re.findall(r"Window \[row_number\(\) windowspecdefinition\(([^)]*?) ASC", plan)
    assert any("salt#" in w for w in windows)
