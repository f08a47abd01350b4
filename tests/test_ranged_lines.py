"""Networks drawn edge by edge whose line of nodes is cut into several ranges."""

from tests.conftest import SF
from weftnet.functions import order
from weftnet.plans import extra
from weftnet.synthetic import sparse


def test_links_of_many_ranges(spark, monkeypatch):
    members = extra._many(spark, SF)
    find = lambda: sorted(tuple(r) for r in sparse.mmsbm(members, extra._w(), 400.0, 2, seed=1).collect())
    want = find()
    monkeypatch.setattr(order, "LEAST", 20)
    assert order.cuts(members, ["i"])
    assert find() == want
