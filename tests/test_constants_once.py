"""Catalog keys against constants: the code view is made and tokenised once, in the job that stages its constants."""

from locflow.plans.checks import q_compare_keys
from locflow.plans.jobs import all_plans
from conftest import SF001


def test_code_view_is_tokenised_once(spark):
    df, plans = all_plans(lambda: q_compare_keys(spark, SF001))
    assert len(plans) == 2
    assert "public const string K" in plans[0] and "public const string K" not in df._jdf.queryExecution().optimizedPlan().toString()
