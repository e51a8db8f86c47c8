import uuid

import pytest

from spanloom.llm.graph import components

PARTITIONS = 64


@pytest.fixture
def many_partitions(spark):
    """Shuffles whose partitions Spark does not put together itself."""
    held = {"spark.sql.shuffle.partitions": str(PARTITIONS), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_tasks_follow_the_links(spark, many_partitions):
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(7, i) for i in range(200, 260)]
    links = spark.createDataFrame([*chain, *star, (1, 2), (2, 1), (3, 3)], "u long, v long").repartition(3)
    group, sc = uuid.uuid4().hex, spark.sparkContext
    sc.setJobGroup(group, "components")
    found = {r.node: r.root for r in components(links).collect()}
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert found == {**{i: 100 for i in range(101, 141)}, **{i: 7 for i in range(200, 260)}, 2: 1}
    tracker = sc.statusTracker()
    tasks = [s.numTasks for j in tracker.getJobIdsForGroup(group) for i in tracker.getJobInfo(j).stageIds if (s := tracker.getStageInfo(i))]
    # the first reading of the links takes a task for each partition, the rounds after it do not
    assert sum(n >= PARTITIONS for n in tasks) <= 2


def test_no_links(spark):
    assert components(spark.createDataFrame([(4, 4)], "u long, v long")).collect() == []
