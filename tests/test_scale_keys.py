"""Keys of series stay apart beyond a thousand products."""

import datetime

from tallyloom import queries_models


def test_stockout_series_are_pairs(spark, tmp_path):
    """Store 0's product 1000 and store 1's product 0 are two series."""
    day = datetime.datetime(2020, 1, 6)
    lines = [(1, part, supplier, 1, 900.0, 1.0, 0.0, 0.0, "N", "O", day) for part, supplier in ((100_001, 5), (1, 6))]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    spark.createDataFrame(lines, schema).write.parquet(f"file://{tmp_path}/lineitem.parquet")
    assert queries_models.h14_portfolio(spark, f"file://{tmp_path}").first().stockout_series == 2
