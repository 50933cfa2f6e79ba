"""Shared parts: Bloom filters, components; the core stands without the subpackage of text operators."""

import random
import re
import subprocess
import sys
from pathlib import Path

import numpy as np

import siltstone
from siltstone.functions import bloom, graphs


def test_bloom_has_no_misses(spark):
    rnd = np.random.default_rng(1)
    once, twice = rnd.integers(0, 1 << 62, 20_000), rnd.integers(0, 1 << 62, 500)
    df = spark.createDataFrame([(int(x),) for x in np.concatenate([once, twice, twice])], "h long").repartition(5)
    path, size, k = bloom.build(df, lambda b: b.column("h").to_numpy().view(np.uint64), 21_000, bits_per_key=16, k=4, most_bytes=1 << 20)
    a, b = bloom.load(path, size)
    assert bloom.has(a, once.view(np.uint64), k).all() and bloom.has(b, twice.view(np.uint64), k).all()
    assert bloom.has(b, once.view(np.uint64), k).mean() < 0.01
    assert bloom.has(a, rnd.integers(0, 1 << 62, 20_000).view(np.uint64), k).mean() < 0.02
    for n in (0, 1, 50, bloom.SEGMENT_BYTES):
        places = np.sort(rnd.choice(bloom.SEGMENT_BYTES * 8, n, replace=False)).astype(np.uint32)
        assert (bloom.unpacked(bloom.packed(places)) == bloom.bitmap(places)).all()


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)]
    par = {}

    def find(x):
        while par.setdefault(x, x) != x:
            x = par[x]
        return x

    for a, b in edges:
        par[max(find(a), find(b))] = min(find(a), find(b))
    got = graphs.components(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()
    assert {r.node: r.component for r in got} == {x: find(x) for x in par}
    assert graphs.components(spark.createDataFrame([], "a int, b int"), "a", "b").count() == 0


def test_no_ref_to_llm():
    """The core imports nothing of the text operators."""
    root = Path(siltstone.__file__).parent
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert not re.search(r"^\s*(from|import) .*\bllm\b", f.read_text(), re.M), f


def test_queries_without_a_session():
    """All queries and their SQL can be listed before a session is started."""
    code = "import __spark_entry__ as e; from pyspark import SparkContext; print(len(e.queries()), len(e.oracle_sql()), SparkContext._active_spark_context)"
    got = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(siltstone.__file__).parent.parent)
    assert got.returncode == 0, got.stderr
    queries, sql, session = got.stdout.split()
    assert int(queries) > 0 and int(sql) > 0 and session == "None"
