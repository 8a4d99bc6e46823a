"""Every event-listing query against its DuckDB SQL."""

import pytest
from comparing import differences

from marquee.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, sf_dir, name):
    assert not differences(catalog.QUERIES[name](spark, sf_dir), catalog.ORACLES[name], sf_dir)


def test_every_query_has_sql_or_a_test_of_its_own():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) <= {"html_extract", "canonical_artist", "canonical_promoter", "normalize_genre", "split_acts"}
