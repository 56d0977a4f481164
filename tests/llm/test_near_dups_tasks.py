"""Small tables over many partitions: few tasks, and the results of the ways that large ones take."""

import numpy as np
import pytest

from panelwright.llm import components as parts
from panelwright.llm import near_dups, store


@pytest.fixture
def many_partitions(spark):
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield 64
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.fixture
def tasks_of(spark):
    """Number of tasks of what is run."""

    def count(name, run):
        spark.sparkContext.setJobGroup(name, name)
        made = run()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        status = spark.sparkContext.statusTracker()
        stages = {s for j in status.getJobIdsForGroup(name) for s in status.getJobInfo(j).stageIds}
        return made, sum(i.numCompletedTasks for s in stages if (i := status.getStageInfo(s)))

    return count


def edges_of(spark, rng, n):
    return spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(-400, 400, (n, 2))], "a long, b long").coalesce(2)


def test_components_of_few_edges(spark, monkeypatch, many_partitions, tasks_of):
    rng = np.random.default_rng(3)
    edges = store.materialise(edges_of(spark, rng, 300), "test-edges")
    small, tasks = tasks_of("few-edges", lambda: sorted(map(tuple, parts.components(edges).collect())))
    monkeypatch.setattr(parts, "SMALL", 299)
    assert small == sorted(map(tuple, parts.components(edges).collect()))
    assert len({c for _, c in small}) > 10
    assert tasks < many_partitions


def test_components_of_few_edges_with_nulls(spark):
    edges = spark.createDataFrame([(1, None), (None, 2), (3, 3), (5, 4), (5, 4), (9, 5), (2**62, -(2**62))], "a long, b long")
    assert {r.node: r.component for r in parts.components(edges).collect()} == {3: 3, 4: 4, 5: 4, 9: 4, 2**62: -(2**62), -(2**62): -(2**62)}
    assert parts.components(edges.where("a is null")).collect() == []


def test_tables_are_written_by_as_many_tasks_as_their_source_asks_for(spark, monkeypatch, many_partitions):
    source = store.materialise(spark.range(4000), "test-source")
    dealt = source.repartition(many_partitions, "id")
    cores = spark.sparkContext.defaultParallelism
    assert len(store.materialise(dealt, "test-few", of=source).inputFiles()) <= cores
    assert len(store.materialise(dealt, "test-all").inputFiles()) > cores
    monkeypatch.setattr(store, "GATHER_BYTES", store.plan_bytes(source) // 20)
    some = store.materialise(dealt, "test-some", of=source)
    assert cores < len(some.inputFiles()) < 30
    assert some.count() == 4000


def test_tasks_of_crowded_sets(docs_of, monkeypatch, many_partitions, tasks_of):
    """A family of near copies under crowded keys, whatever the number of partitions."""
    monkeypatch.setattr(near_dups, "FREQUENT_LEAST", 2)
    monkeypatch.setattr(near_dups, "MEET", 4)
    rng = np.random.default_rng(8)
    texts = []
    for family in range(2):
        for _ in range(40):
            w = [f"f{family}w{i}" for i in range(200)]
            w[rng.integers(200)] = f"v{rng.integers(1000)}"
            texts.append(" ".join(w))
    docs = docs_of(texts)
    got, tasks = tasks_of("crowded", lambda: {r.doc_id: r.component_id for r in near_dups.near_duplicates(docs, shingle=2).collect()})
    assert got == {i: i // 40 * 40 for i in range(80)}
    assert tasks < 24 * many_partitions, tasks
