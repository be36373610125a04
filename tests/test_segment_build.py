"""How the stored views are built: rows are dealt once, and segments meet where their first keys say."""

import duckdb

from blockloom.plans import views
from blockloom.plans.registry import ORACLES, QUERIES
from blockloom.sources.manifest import Segments

from .compare import rows, sql_rows
from .conftest import SF


def test_lines_are_dealt_once(spark, tmp_path, monkeypatch):
    """Many short segments over orders without lines, lines without orders and keys with gaps give the rows of the SQL."""
    con = duckdb.connect()
    con.execute(f"CREATE TABLE orders AS SELECT * REPLACE (o_orderkey * 3 AS o_orderkey) FROM '{SF}/orders.parquet' WHERE o_orderkey % 7 <> 0")
    con.execute(f"CREATE TABLE lineitem AS SELECT * REPLACE (l_orderkey * 3 AS l_orderkey) FROM '{SF}/lineitem.parquet' WHERE l_orderkey % 5 <> 0")
    for t in ("orders", "lineitem"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    plans, build = [], Segments.build

    def noted(self, df, size, key):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        build(self, df, size, key)

    monkeypatch.setattr(views, "SEGMENT", 64)
    monkeypatch.setattr(Segments, "build", noted)
    for name in ("body_indices", "block_receipts"):
        assert rows(QUERIES[name](spark, str(tmp_path))) == sql_rows(con, ORACLES[name])[1]
    assert len(plans) == 2 and plans[1].count("Exchange ") == 1 and "Join" not in plans[1]
