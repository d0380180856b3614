"""The driver lets go of what it needs no longer after every scratch table."""

from __future__ import annotations

from tidemark.llm import common


def test_each_scratch_table_tidies_the_driver(spark):
    def full_collections() -> int:
        return sum(b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if any(x in b.getName() for x in ("Old", "MarkSweep", "Major")))

    for _ in range(2):
        before = full_collections()
        assert common.scratch(spark.range(3), "tidied").count() == 3
        assert full_collections() > before
