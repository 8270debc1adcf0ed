import os
import subprocess
import sys

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabgauge.functions.checkpoints import settled
from tabgauge.llm import neardup, quality, workers

ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

LEFT = """
import os
from tabgauge.llm.workers import thrifty

def rss():
    return int(open("/proc/self/statm").read().split()[1]) * os.sysconf("SC_PAGE_SIZE") >> 20

last = []

def function(batches):
    for batch in batches:
        parts = [b"x" * 5000 + bytes([i % 256]) for i in range(30_000)]
        last.append(parts.pop())
        yield batch

before = rss()
list(function([1, 2]))
kept = rss() - before
list(thrifty(function)([1, 2]))
print(kept, rss() - before)
"""


def test_batches_are_small_only_inside(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    before = spark.conf.get(ROWS)
    rows = spark.range(0, 5000, 1, 1).mapInArrow(sizes, "n long")
    with workers.few_rows(spark):
        inside = settled(rows)
    assert spark.conf.get(ROWS) == before
    found = inside.agg(F.sum("n"), F.max("n")).first()
    assert (found[0], found[1]) == (5000, workers.BATCH_ROWS)
    with pytest.raises(KeyError), workers.few_rows(spark):
        raise KeyError
    assert spark.conf.get(ROWS) == before
    with workers.few_rows(spark, 7), workers.few_rows(spark):  # a smaller setting stays
        assert spark.conf.get(ROWS) == "7"


@pytest.mark.parametrize("operator", [neardup, quality])
def test_texts_reach_python_in_small_batches(spark, monkeypatch, operator):
    seen = []

    def noted(table):
        if "MapInArrow" in table._jdf.queryExecution().toString():
            seen.append(int(spark.conf.get(ROWS)))
        return settled(table)

    monkeypatch.setattr(operator, "settled", noted)
    docs = spark.createDataFrame(
        [(i, "en", f"some words that are much alike, of {i % 3}") for i in range(9)],
        "doc_id long, lang string, text string",
    )
    assert operator.judged(docs).count() == 9
    assert len(seen) == 2 and max(seen) <= workers.BATCH_ROWS


@pytest.mark.skipif(sys.platform != "linux", reason="reads /proc")
def test_a_worker_gives_freed_memory_back():
    run = subprocess.run([sys.executable, "-c", LEFT], capture_output=True, text=True, cwd=os.getcwd(), check=True)
    kept, left = map(int, run.stdout.split())
    assert kept > 100 and left < 40
