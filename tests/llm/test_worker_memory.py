"""What an executor and its Python workers hold at a time: rows of a batch."""

import pyarrow as pa

from papyra.llm.common import BATCH_ROWS, Scratch

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def batch_sizes(spark, rows):
    """How many rows each batch had with which a table of so many rows was made."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64())], ["n"])

    made = spark.range(rows, numPartitions=1).mapInArrow(sizes, "n long")
    return [r.n for r in Scratch(spark, "t").write(made, "t").collect()]


def test_scratch_tables_are_made_by_small_batches(spark):
    before = spark.conf.get(KEY)
    found = batch_sizes(spark, 3 * BATCH_ROWS + 1)
    assert sum(found) == 3 * BATCH_ROWS + 1 and max(found) <= BATCH_ROWS
    assert spark.conf.get(KEY) == before


def test_a_smaller_limit_stays(spark):
    before = spark.conf.get(KEY)
    spark.conf.set(KEY, 7)
    try:
        assert sorted(batch_sizes(spark, 20)) == [6, 7, 7]
        assert spark.conf.get(KEY) == "7"
    finally:
        spark.conf.set(KEY, before)
