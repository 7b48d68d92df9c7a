import pytest

from weftline.llm.common import Scratch


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "test")


@pytest.fixture
def docs(spark):
    """(doc_id, text) rows plus columns whose names clash with those the operators use within."""

    def make(rows, **more):
        import pyarrow as pa

        n = len(rows)
        cols = {"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())}
        cols |= {c: pa.array(v, pa.string()) for c, v in more.items()}
        for c in ("fp", "sha", "tid", "body", "h", "n", "block", "token", "bucket", "before", "slot", "shard", "segment", "root", "node", "score", "__kept", "__sha", "spans"):
            cols[c] = pa.array([f"own-{c}"] * n, pa.string())
        return spark.createDataFrame(pa.table(cols)).repartition(3)

    return make
