"""What the nodes of a finished plan made, by Spark's own counters."""

from __future__ import annotations


def nodes(df):
    """The nodes that ran; call after df itself was collected."""
    left = [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            left.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            left.append(node.plan())
        else:
            yield node
            children = node.children()
            left += [children.apply(i) for i in range(children.size())]


def most_rows(df) -> int:
    """The most rows that a node made."""
    counts = [node.metrics().get("numOutputRows") for node in nodes(df)]
    return max([c.get().value() for c in counts if c.isDefined()], default=0)
