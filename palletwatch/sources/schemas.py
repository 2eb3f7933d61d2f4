"""Column types of the delivery tables, for readers that cannot infer them."""

from __future__ import annotations

REGION = "r_regionkey int, r_name string"
NATION = "n_nationkey int, n_name string, n_regionkey int"
SUPPLIER = "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double"
PART = "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
ORDERS = (
    "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string"
)
LINEITEM = (
    "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
    "l_linestatus string, l_shipdate timestamp_ntz"
)
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"

SCHEMAS = {
    "region": REGION,
    "nation": NATION,
    "supplier": SUPPLIER,
    "part": PART,
    "orders": ORDERS,
    "lineitem": LINEITEM,
    "events": EVENTS,
}
