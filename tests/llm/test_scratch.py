"""Tables of a run, and that they go."""

from pathlib import Path

from weftline.llm.common import Scratch


def test_sweep_removes_later_runs_only(spark):
    first = Scratch(spark, "first")
    kept = first.keep(spark.range(3), "rows")
    mark = Scratch.mark()
    second = Scratch(spark, "second")
    second.keep(spark.range(5), "rows")
    Scratch.sweep(mark)
    assert kept.count() == 3
    assert not Path(second.root.removeprefix("file://")).exists()
    first.drop("rows")
    assert not Path(first.path("rows").removeprefix("file://")).exists()
