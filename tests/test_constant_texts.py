from pyspark.sql import functions as F

from veilsift import sql
from veilsift.patterns import instructs


def test_a_detector_holds_a_constant_text_once(spark):
    n = 1000
    df = spark.range(1).select(F.repeat(F.lit("Important "), F.lit(n)).alias("t"))
    for d in sql.DETECTORS:
        found = df.select(instructs(F.col("t"), d).alias("f"))
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.lower().count("important important") < 0.75 * n, d
        assert found.first().f is False
