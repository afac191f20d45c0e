import pytest

from citeloom.schema import checked_space, dotted_space, entity, space, union_keys


def test_union_is_sorted():
    assert union_keys("q.w.e", "e.r.t") == "e.q.r.t.w"


def test_spaces():
    assert dotted_space(["fy", "c"]) == "c.fy"
    assert space("citing_year.cited_work") == ("c", "fy")
    assert checked_space("c.fy") == ("c", "fy")
    with pytest.raises(ValueError):
        checked_space("fy.c")
    with pytest.raises(KeyError):
        entity("colour")
