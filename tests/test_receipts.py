from __future__ import annotations

import datetime as dt
from decimal import Decimal

from palletwatch.operators import geography, orders, parts, quality, receipts, series, suppliers, leadtime
from tests.fixtures import line, lines, order, orders as order_table, parts as part_table, rows, suppliers as vendor_table


def d(text):
    return dt.date.fromisoformat(text)


def test_amounts_are_exact_beyond_double_precision(spark):
    """A value that a sum of doubles would round away."""
    table = lines(spark, line(price=9_999_999_999.99), *(line(price=0.01) for _ in range(7)))
    got = receipts.daily_receipts(table).first()
    assert got.net_value == Decimal("10000000000.0600")
    assert got.quantity == Decimal("8.00")


def test_negative_units_survive_the_split_sum(spark):
    table = lines(spark, line(price=-123456.78, discount=0.07), line(price=0.01, discount=0.1))
    assert receipts.daily_receipts(table).first().net_value == Decimal("-123456.78") * Decimal("0.93") + Decimal("0.009")


def test_repeated_keys_counts_copies(spark):
    table = lines(spark, line(), line(), line(number=2), line(received="2000-02-01"))
    assert rows(receipts.repeated_keys(table), "l_orderkey", "l_linenumber", "times") == [(1, 1, 3)]


def test_latest_per_part_breaks_ties_by_line_key(spark):
    table = lines(
        spark,
        line(order=5, received="2000-03-01"), line(order=7, received="2000-03-01", quantity=4.0),
        line(order=9, received="2000-02-01"), line(order=2, part=2),
    )
    assert rows(receipts.latest_per_part(table), "l_partkey", "l_orderkey", "quantity") == [
        (1, 7, Decimal("4.00")), (2, 2, Decimal("1.00")),
    ]


def test_odd_rates_and_fine_quantities_are_not_rounded(spark):
    table = lines(
        spark, line(price=100.0, discount=0.125, quantity=1.005), line(price=100.0, discount=0.0, quantity=0.004)
    )
    got = receipts.daily_receipts(table).first()
    assert (got.net_value, got.quantity) == (Decimal("187.50"), Decimal("1.009"))
    one = order_table(spark, order(1, total=287.64375))
    taxed = lines(spark, line(price=100.0, discount=0.125, tax=0.0825), line(price=200.0, discount=0.05, tax=0.0125))
    assert orders.value_reconciliation(one, taxed).first().received_value == Decimal("287.09375")


def test_more_places_can_be_asked_for(spark):
    fine = {"l_quantity": 5, "l_extendedprice": 3, "l_discount": 5, "l_tax": 5, "o_totalprice": 3}
    table = lines(spark, line(price=10.125, discount=0.00001, quantity=0.00001))
    got = receipts.daily_receipts(table, fine).first()
    assert (got.net_value, got.quantity) == (Decimal("10.125") * Decimal("0.99999"), Decimal("0.00001"))


def test_large_values_do_not_run_over(spark):
    table = lines(spark, *(line(price=999_999_999.99, discount=0.0001, tax=0.9999) for _ in range(5)))
    got = orders.value_reconciliation(order_table(spark, order(1, total=1.0)), table).first()
    assert got.received_value == 5 * Decimal("999999999.99") * Decimal("0.9999") * Decimal("1.9999")


def test_open_orders_as_of_a_day(spark):
    """A receipt after the day does not close an order, and an order placed after it is not yet open."""
    table = lines(spark, line(order=1, received="2000-02-10"), line(order=4, received="2000-01-15"))
    placed = order_table(
        spark, order(1), order(2, ordered="2000-03-01"), order(3, ordered="2000-01-15"), order(4), order(5, ordered="2000-01-16")
    )
    assert rows(orders.open_orders(placed, table, dt.date(2000, 1, 15)), "o_orderkey", "days_open") == [(1, 14), (3, 0)]


def test_open_orders_with_many_lines_of_one_order(spark):
    table = lines(spark, *(line(order=1, number=n) for n in range(50)))
    late = order_table(spark, order(1), order(2, ordered="2000-01-05"))
    assert rows(orders.open_orders(late, table, dt.date(2000, 1, 15)), "o_orderkey", "days_open") == [(2, 10)]


def test_value_reconciliation_statuses(spark):
    table = lines(
        spark,
        line(order=1, price=100.0, discount=0.1, tax=0.05), line(order=1, price=5.5),
        line(order=2, price=3.0), line(order=4, price=3.0),
    )
    expected = order_table(
        spark, order(1, total=100.0), order(2, total=3.02), order(3, total=9.0), order(4, total=3.01)
    )
    assert rows(orders.value_reconciliation(expected, table), "o_orderkey", "status", "difference") == [
        (1, "matched", Decimal("0.000000")), (2, "differs", Decimal("0.020000")),
        (3, "no receipt", None), (4, "matched", Decimal("0.010000")),
    ]


def test_lead_time_quantiles_and_quarantine(spark):
    table = lines(
        spark,
        line(received="2000-01-01"), line(received="2000-01-02"), line(received="2000-01-05"),
        line(received="1999-12-30"),
    )
    one = order_table(spark, order(1))
    assert rows(leadtime.lead_time_stats(table, one)) == [(1, 3, 0, 1.0, 3.4, 4)]
    assert rows(leadtime.lead_time_quarantine(table, one), "lead") == [(-2,)]


def test_limits_from_counts_equal_those_from_lines(spark):
    table = lines(spark, *(line(received=f"2000-01-{1 + n * n % 28:02d}", number=n) for n in range(60)), line(received="1999-01-01"))
    one = order_table(spark, order(1))
    counted = rows(leadtime.suggest_limits(table, one))
    assert counted == rows(leadtime._spread(leadtime.with_lead(table, one), "o_orderpriority"))
    assert counted[0][1] == 60


def test_late_receipts_at_the_limit_and_without_limit(spark):
    table = lines(
        spark, line(order=1, received="2000-01-31"), line(order=1, received="2000-02-01"),
        line(order=2, received="2009-01-01"),
    )
    both = order_table(spark, order(1), order(2, priority="unknown"))
    assert rows(leadtime.late_receipts(table, both)) == [("1-URGENT", 2, 1, 0.5), ("unknown", 1, 0, 0.0)]


def test_scorecard_ranks_with_ties_and_undefined_shares(spark):
    table = lines(
        spark,
        line(supplier=1, returned="R"), line(supplier=1),
        line(supplier=2, returned="R", received="2001-01-01"), line(supplier=2),
        line(supplier=3, received="1999-01-01"),
        line(supplier=4, received="2001-01-01"),
    )
    got = suppliers.supplier_scorecard(table, order_table(spark, order(1)))
    assert rows(got, "l_suppkey", "returned_share", "returned_rank", "late_share", "late_rank") == [
        (1, 0.5, 1, 0.0, 3), (2, 0.5, 1, 0.5, 2), (3, 0.0, 2, None, None), (4, 0.0, 2, 1.0, 1),
    ]


def test_scorecard_keeps_lines_of_unknown_orders(spark):
    table = lines(spark, line(order=77, returned="R"), line(order=1))
    got = suppliers.supplier_scorecard(table, order_table(spark, order(1)))
    assert rows(got, "lines", "returned_share", "eligible_lines") == [(2, 0.5, 1)]


def test_value_classes_at_the_exact_boundary(spark):
    """The part before which exactly 80 % has passed is the first of class B."""
    table = lines(
        spark, line(part=1, price=80.0), line(part=2, price=10.0), line(part=3, price=5.0), line(part=4, price=5.0)
    )
    assert rows(parts.value_classes(table), "l_partkey", "value_before", "value_class") == [
        (1, Decimal("0.00"), "A"), (2, Decimal("80.00"), "B"), (3, Decimal("90.00"), "B"), (4, Decimal("95.00"), "C"),
    ]


def test_rolling_quantity_uses_calendar_days(spark):
    table = lines(
        spark, line(received="2000-01-01", quantity=1.0), line(received="2000-01-07", quantity=2.0),
        line(received="2000-01-08", quantity=4.0), line(supplier=2, received="2000-01-08", quantity=8.0),
    )
    got = rows(series.rolling_quantity(table), "l_suppkey", "receipt_day", "rolling_quantity")
    assert [int(q) for *_, q in got] == [1, 3, 6, 8]


def test_receipt_gaps_ignores_repeats_of_a_day(spark):
    table = lines(
        spark, line(received="2000-01-01"), line(received="2000-01-01", number=2),
        line(received="2000-01-31"), line(received="2000-03-02"),
    )
    assert rows(series.receipt_gaps(table)) == [(1, d("2000-01-31"), d("2000-03-02"), 31)]


def test_empty_days_cover_edges_and_unseen_suppliers(spark):
    """Supplier 3 has no receipts; 9 and NULL have some, but are no suppliers."""
    table = lines(
        spark, line(received="2000-01-02"), line(supplier=2, received="2000-01-01"),
        line(supplier=2, received="2000-01-03"), line(supplier=9, received="2000-01-01"),
        line(supplier=9, received="2000-01-03"), line(supplier=None, received="2000-01-01"),
        line(supplier=None, received="2000-01-03"),
    )
    got = series.empty_days_by_supplier(table, vendor_table(spark, 1, 2, 3))
    assert rows(got) == [
        (1, d("2000-01-01"), d("2000-01-01"), 1), (1, d("2000-01-03"), d("2000-01-03"), 1),
        (2, d("2000-01-02"), d("2000-01-02"), 1), (3, d("2000-01-01"), d("2000-01-03"), 3),
    ]


def _month(spark, quantities):
    start = dt.date(2000, 1, 1)
    return lines(spark, *(
        line(received=str(start + dt.timedelta(days=n)), quantity=float(q)) for n, q in enumerate(quantities)
    ))


def test_flat_days_have_no_anomaly(spark):
    assert rows(series.volume_anomalies(_month(spark, [5] * 30))) == []


def test_anomaly_needs_a_full_history(spark):
    quantities = [5, 6] * 14 + [50]
    assert [r[0] for r in rows(series.volume_anomalies(_month(spark, quantities)))] == [d("2000-01-29")]
    assert rows(series.volume_anomalies(_month(spark, quantities[1:]))) == []


def test_anomalies_per_supplier(spark):
    table = _month(spark, [5, 6] * 14 + [50])
    assert rows(series.volume_anomalies(table, "l_suppkey"), "l_suppkey", "quantity") == [(1, Decimal("50.00"))]


def test_geography_totals_reports_every_level(spark):
    nation = spark.createDataFrame([(1, "N1", 1), (2, "N2", 1)], "n_nationkey int, n_name string, n_regionkey int")
    region = spark.createDataFrame([(1, "R1")], "r_regionkey int, r_name string")
    vendor = spark.createDataFrame(
        [(1, "a", 1, 0.0), (2, "b", 2, 0.0)], "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double"
    )
    got = geography.geography_totals(lines(spark, line(), line(), line(supplier=2)), vendor, nation, region)
    levels = {(r.all_regions, r.all_nations, r.all_suppliers, r.n_name, r.l_suppkey): r.lines for r in got.collect()}
    assert levels == {
        (1, 1, 1, None, None): 3, (0, 1, 1, None, None): 3,
        (0, 0, 1, "N1", None): 2, (0, 0, 1, "N2", None): 1,
        (0, 0, 0, "N1", 1): 2, (0, 0, 0, "N2", 2): 1,
    }


def test_rules_see_null_and_orphan_keys(spark):
    table = lines(
        spark, line(), line(order=None), line(part=9), line(supplier=None, quantity=0.0), line(supplier=8),
        line(supplier=8, discount=1.5), line(number=None, discount=-0.1, quantity=None),
        line(quantity=0.0005, price=0.005, discount=0.00001, tax=0.12345), line(price=None),
    )
    got = quality.rule_violations(
        table, order_table(spark, order(1, total=1.001)), part_table(spark, 1), vendor_table(spark, 1)
    )
    assert dict(rows(got)) == {
        "null l_orderkey": 1, "null l_partkey": 0, "null l_suppkey": 1, "null l_linenumber": 1,
        "quantity not positive": 1, "discount outside 0 to 1": 2,
        "l_quantity finer than 3 places": 1, "l_extendedprice finer than 2 places": 1,
        "l_discount finer than 4 places": 1, "l_tax finer than 4 places": 1, "o_totalprice finer than 2 places": 1,
        "orphan l_orderkey": 0, "orphan l_partkey": 1, "orphan l_suppkey": 2,
    }
