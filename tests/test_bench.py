"""The headline of the bench."""

import bench


def test_no_total_of_a_part():
    assert bench.headline({"a": 1.5, "b": 2.25}, []) == 3.75
    assert bench.headline({"a": 1.5}, ["b"]) is None
