import re

import pytest


@pytest.fixture
def moved(spark):
    """moved(f): the columns of every exchange of all that f() runs, but for those that broadcast."""

    def columns(f):
        store = spark._jsparkSession.sharedState().statusStore()
        seen = store.executionsList().size()
        f()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        runs = store.executionsList()
        assert runs.size() > seen
        out = set()
        for i in range(seen, runs.size()):
            plan = runs.apply(i).physicalPlanDescription()
            for inputs in re.findall(r"\(\d+\) Exchange[^\n]*\nInput \[\d+\]: \[([^\]]*)\]", plan):
                out |= {c.split("#")[0].strip() for c in inputs.split(",")}
        return out

    return columns
