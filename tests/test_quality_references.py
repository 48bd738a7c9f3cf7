"""What the reference rule shuffles."""

from __future__ import annotations

from ridegrid.operators import quality as Q


def test_references_are_shuffled_as_numbers(spark, td):
    plan = Q.dq_fk(td)._jdf.queryExecution().optimizedPlan()
    joins = [line for line in plan.toString().splitlines() if "LeftSemi" in line]
    assert joins
    left = plan.children().head()
    while not left.nodeName().startswith("Join"):
        left = left.children().head()
    types = {left.left().output().apply(i).dataType().simpleString() for i in range(left.left().output().size())}
    assert types <= {"int", "bigint"}
