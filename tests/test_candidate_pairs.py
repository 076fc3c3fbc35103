"""Candidate pairs meet by party, or by amount and days: never by amount alone."""

from pyspark.sql import functions as F

from provena.operators import matching as M
from provena.plans import matching_queries as Q
from provena.plans.bind import doc, payment


def test_candidates_equal_those_by_amount_alone(spark, sf):
    d = doc(spark, sf).select("id", F.col("party").alias("doc_party"), "gross", "issue_date")
    want = M.band_join(payment(spark, sf), d, "amount", "gross").where((F.col("party") == F.col("doc_party")) | (F.abs(F.datediff("booked_on", "issue_date")) <= 60))
    key = lambda df: sorted((r.pay_id, r.id) for r in df.select("pay_id", "id").collect())
    got = Q._scored(spark, sf)
    assert key(got) == key(want)
    assert key(Q._score(Q._party_pairs(spark, sf)).where("viable")) == key(Q._score(want).where("viable"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert all("party" in line or "block" in line for line in plan.split("\n") if "Join" in line)
