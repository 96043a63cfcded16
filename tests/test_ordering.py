"""Result ordering (the oracle compare is order-insensitive, so order is checked here)."""

import __spark_entry__ as E
from fixture_tables import SMALL

Q = E.queries()


def test_result_orders(spark):
    def col(name, c):
        return [r[c] for r in Q[name](spark, SMALL).collect()]

    dates = col("a14_daily_timeseries_rollup", "date")
    assert dates == sorted(dates) and len(dates) > 1
    assert col("a15_day_of_week_raw", "day_of_week") == list(range(7))
    hours = col("a16_hourly_profile", "hour")
    assert hours == sorted(hours)
    avg = col("a20_resolution_by_category", "avg_hours")
    assert avg == sorted(avg, reverse=True)
    counts = col("a19_district_breakdown_long", "count")
    assert counts == sorted(counts, reverse=True)
    months = col("a17_monthly_trend_rollup", "year_month")
    assert months == sorted(months)
    cat_counts = col("a11_category_counts", "count")
    assert cat_counts == sorted(cat_counts, reverse=True)
