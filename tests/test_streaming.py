"""The streaming ingest gives the same cleaned rows as the batch operators."""

import tempfile

from attemptlab.operators import attempts as A
from attemptlab.sources.fixtures import Fixtures
from attemptlab.streaming import submissions as SS
from tests.conftest import SF_SMALL


def test_stream_matches_batch(spark):
    fx = Fixtures(spark, SF_SMALL)
    subs = fx.submissions.withColumnRenamed("ts", "timestamp").select(
        "submission_id", "student_id", "question_unittest_id", "response", "response_type", "pass", "timestamp")
    src = tempfile.mkdtemp(prefix="attemptlab-src-")
    sink = tempfile.mkdtemp(prefix="attemptlab-sink-") + "/t"
    subs.write.mode("overwrite").parquet(src)
    q = SS.start_ingest(spark, src, fx.questions, sink, fmt="parquet", trigger_once=True)
    q.awaitTermination(300)
    got = sorted(r.submission_id for r in spark.read.parquet(sink).select("submission_id").collect())
    want = sorted(r.submission_id for r in A.join_questions(A.clean_submissions(A.normalise_na(fx.submissions)), fx.questions)
                  .select("submission_id").collect())
    assert got == want
    sc = SS.scenarios_from_sink(spark, sink, fx.questions)
    assert sc["Scenario2"].count() == A.latest_per_pair(A.join_questions(
        A.clean_submissions(A.normalise_na(fx.submissions)), fx.questions)).count()
