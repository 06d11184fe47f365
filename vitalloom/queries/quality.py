"""Data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as q
from ..registry import Tables, query

REQUIRED = {"orders": ["o_orderkey", "o_orderstatus", "o_closed_at"], "events": ["event_id", "ts", "props"],
            "documents": ["doc_id", "text", "reviewed", "owner"], "conversations": ["conv_id", "turn", "role"]}


@query("q1_required_columns", """
SELECT 'orders' AS "table", count(*) AS rows, 'o_closed_at' AS missing FROM orders UNION ALL SELECT 'events', count(*), '' FROM events
UNION ALL SELECT 'documents', count(*), 'reviewed,owner' FROM documents UNION ALL SELECT 'conversations', count(*), '' FROM conversations""")
def q1(t: Tables):
    return q.table_report({n: getattr(t, n) for n in REQUIRED}, REQUIRED)


@query("q2_status_domain", "SELECT o_orderstatus AS bad_value, count(*) AS n FROM orders WHERE o_orderstatus NOT IN ('O', 'F') GROUP BY 1")
def q2(t: Tables):
    return q.outside_domain(t.orders, "o_orderstatus", ["O", "F"])


@query("q3_pair_uniqueness", """
SELECT least(l_partkey::VARCHAR, l_suppkey::VARCHAR) AS low, greatest(l_partkey::VARCHAR, l_suppkey::VARCHAR) AS high, count(*) AS n
FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2 HAVING count(*) > 1""")
def q3(t: Tables):
    return q.repeated_pairs(t.lineitem, "l_partkey", "l_suppkey", F.col("l_linestatus") == "O")
