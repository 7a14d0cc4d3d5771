"""Plan-shape guards for the flagship customer table."""

import re

from custspark.plans import customer360 as c360
from custspark.sources.tables import Tables

from .conftest import SF_SMALL


def test_customer_360_reads_each_table_once(spark):
    df = c360.customer_360(Tables(spark, SF_SMALL))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    for table in ("lineitem",):  # part is read twice by design: part -> department, distinct brands
        scans = re.findall(r"FileScan parquet \[[^\]]*\][^\n]*%s\.parquet" % table, plan)
        assert len(scans) <= 1, (table, len(scans))
    # column pruning reaches the line-table scan
    m = re.search(r"FileScan parquet \[([^\]]*)\][^\n]*lineitem\.parquet", plan)
    assert m and "l_comment" not in m.group(1) and "l_shipdate" not in m.group(1)
