"""Connected components, by the driver and by rounds of joins."""

import numpy as np

from stackroom.llm.common import Scratch, components
from tests.llm.test_near import roots


def test_few_edges_take_few_jobs(spark):
    rng = np.random.default_rng(5)
    edges = [(i, i + 1) for i in range(300)] + [(1000 + i, -7) for i in range(300)] + [(int(a), int(b)) for a, b in rng.integers(2000, 2400, (250, 2))]
    edges += [(2**62, 2**62 + 1), (2**62 + 1, 2**62), (9_999, 9_999), (None, 3)]
    links = [(a, b) for a, b in edges if a is not None and a != b]
    right = roots({x for e in links for x in e}, links)
    table, scratch, sc = spark.createDataFrame(edges, "a long, b long"), Scratch(spark), spark.sparkContext

    def found(**options):
        rows = components(scratch, table, **options).collect()
        assert len(rows) == len(right)
        return {r.id: r.component for r in rows}

    try:
        sc.setJobGroup("few-edges", "")
        assert found() == right
        assert len(sc.statusTracker().getJobIdsForGroup("few-edges")) <= 12
        assert len({tuple(sorted(e)) for e in links}) > 400
        sc.setJobGroup("many-edges", "")
        assert found(few=400) == right
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert components(scratch, table.limit(0)).count() == 0
    scratch.close()
