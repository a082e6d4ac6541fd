import pyarrow as pa

from beamframe.llm.shared import BATCH_BYTES, materialize, tidy


def test_rows_reach_python_in_bounded_batches(spark):
    """100 texts of 400,000 bytes went to Python as one batch."""
    docs = materialize(spark.range(100, numPartitions=1).selectExpr("id", "repeat(cast(id % 10 as string), 400000) AS text").coalesce(1), "wide")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([sum(len(x.as_buffer()) for x in b.column("text"))])], ["rows", "bytes"])

    got = docs.select("text").mapInArrow(tidy(sizes), "rows long, bytes long").collect()
    assert sum(r.rows for r in got) == 100 and max(r.bytes for r in got) <= BATCH_BYTES + 400_000


def test_tidy_hands_on_every_batch():
    batches = [pa.RecordBatch.from_pydict({"x": [k]}) for k in range(3)]
    assert [b.column(0)[0].as_py() for b in tidy(lambda own: own)(iter(batches))] == [0, 1, 2]
