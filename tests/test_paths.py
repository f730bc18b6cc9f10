"""The planner's paths and the stream agree with brute force."""

from boxwright.operators.index import Index
from boxwright.plans.planner import choose, region_counts
from boxwright.streaming.counts import RegionCounts
from test_boxes import frame, meets, random_boxes


def test_planner_paths_agree(spark):
    a, q = random_boxes(11, 200), random_boxes(12, 30)
    data, queries = frame(spark, a), frame(spark, q, "qid")
    want = {j: sum(meets(x, y) for x in a) for j, y in enumerate(q, 1)}
    index = Index.build(data, leaf_cap=10)
    for path in (None, "scan", "grid", "index"):
        assert {r.qid: r.n for r in region_counts(data, queries, index=index if path != "grid" else None, path=path).collect()} == want
    assert choose(3, None, (0, 1)) == "scan" and choose(3000, None, (0, 1)) == "grid" and choose(3, index, (0, 1)) == "index" and choose(3, index, (0,)) == "scan"
    assert region_counts(data, queries.limit(0)).count() == 0


def test_stream_counts(spark, tmp_path):
    a, q = random_boxes(13, 120), random_boxes(14, 20)
    sink = RegionCounts(frame(spark, q, "qid"), str(tmp_path / "out"))
    for part in (a[:70], a[70:]):
        frame(spark, part).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(frame(spark, a).schema).option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))
        sink.start(stream, str(tmp_path / "check")).awaitTermination(120)
    want = {j: sum(meets(x, y) for x in a) for j, y in enumerate(q, 1)}
    assert {r.qid: r.n for r in sink.totals().collect()} == want
    sink(frame(spark, a[:5]), 0)  # a batch that is run again replaces its first try
    assert spark.read.parquet(str(tmp_path / "out")).where("batch = 0").count() <= 20
