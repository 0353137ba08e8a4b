import pytest

from tests.by_hand import BY_HAND


@pytest.mark.parametrize("name", sorted(BY_HAND))
def test_cases(spark, name):
    function, columns, results = BY_HAND[name]
    rows = function(spark).collect()
    assert {r.id: tuple(r[c] for c in columns) for r in rows} == dict(enumerate(map(tuple, results)))
