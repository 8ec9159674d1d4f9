import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "3g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def sf():
    return SF


@pytest.fixture
def shuffled():
    """Of a frame that was collected: how many rows its shuffles wrote, and how many bytes."""

    def nodes(plan):
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return nodes(plan.executedPlan())
        if name.endswith("QueryStageExec"):
            return nodes(plan.plan())
        children = plan.children()
        return [plan] + [x for i in range(children.size()) for x in nodes(children.apply(i))]

    def run(df):
        found = [x.metrics() for x in nodes(df._jdf.queryExecution().executedPlan()) if x.getClass().getSimpleName() == "ShuffleExchangeExec"]
        return tuple(sum(m.apply(k).value() for m in found) for k in ("shuffleRecordsWritten", "shuffleBytesWritten"))

    return run
