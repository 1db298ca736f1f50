"""The operators that SQL can express give DuckDB's rows on whole tables."""

import pandas as pd
import pytest

from scriptorium.llm import queries
from tests.test_queries import duck, normal  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, sf, duck, name):  # noqa: F811
    ours, theirs = normal(queries.queries()[name](spark, sf).toPandas()), normal(duck.execute(queries.oracle_sql()[name]).df())
    assert list(ours.columns) == list(theirs.columns)
    pd.testing.assert_frame_equal(ours, theirs)
