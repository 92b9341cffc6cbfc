from __future__ import annotations

import json
from decimal import Decimal

from conftest import at, day, one, rows

from taquilla.operators import dashboard, reports

TODAY = day("2024-01-15")
TEAMS = [{"id": "A", "name": "Alfa"}, {"id": "B", "name": "Beta"}]


def match(key, date="2024-01-20", **more):
    fields = {"match_date": day(date) if date else None, "match_hour": "19:00:00"}
    return {
        "id": key,
        "id_team_local": "A",
        "id_team_visitor": "B",
        "state": "en_venta",
        **fields,
        **more,
    }


def stand(key, name, capacity):
    return {"id": key, "name": name, "total_capacity": capacity}


def price(match_key, stand_key, value="50000.00", key=None):
    return {
        "id": key or f"{match_key}-{stand_key}",
        "id_match": match_key,
        "id_stand": stand_key,
        "price": value,
    }


def ticket(key, match_key, stand_key=None, **more):
    return {
        "id": key,
        "id_users": "u",
        "id_matches": match_key,
        "id_match_stand_price": f"{match_key}-{stand_key}" if stand_key else None,
        "id_transaction": "x",
        **more,
    }


def test_daily_and_monthly_have_no_upper_bound_on_the_month(make_tables):
    t = make_tables(
        tickets=[
            ticket("1", "m", purchased_at=at("2024-01-15T23:59:59"), price="10.00"),
            ticket("2", "m", purchased_at=at("2024-01-01T00:00:00"), price="20.00"),
            ticket("3", "m", purchased_at=at("2023-12-31T23:59:59"), price="40.00"),
            ticket("4", "m", purchased_at=at("2024-02-20T10:00:00"), price="80.00"),
            ticket("5", "m", purchased_at=at("2024-01-15T10:00:00"), state="anulado"),
        ]
    )
    assert one(dashboard.daily_monthly_stats(t, TODAY)) == {
        "daily_tickets_sold": 1,
        "daily_revenue": Decimal("10.00"),
        "monthly_revenue": Decimal("110.00"),
    }


def test_stats_without_tickets_are_zero(make_tables):
    got = one(dashboard.daily_monthly_stats(make_tables(), TODAY))
    assert got == {
        "daily_tickets_sold": 0,
        "daily_revenue": Decimal("0.00"),
        "monthly_revenue": Decimal("0.00"),
    }


def test_upcoming_edges(make_tables):
    t = make_tables(
        teams=TEAMS,
        soccer_stands=[stand("s", "Norte", 10), stand("z", "Cero", 0)],
        matches=[
            match("m1", "2024-01-20"),
            match("m2", "2024-01-15", match_hour=None),
            match("m3", "2024-01-15", id_team_visitor="missing"),
            match("m4", "2024-01-16", state=None),
            match("m5", "2024-01-14"),
            match("m6", "2024-01-16", state="finalizado"),
            match("m7", "2024-01-18"),
        ],
        match_stand_prices=[price("m1", "s"), price("m7", "z")],
        tickets=[ticket(str(i), "m1", "s") for i in range(7)] + [ticket("v", "m1", state="usado")],
    )
    got = rows(dashboard.upcoming_matches(t, TODAY))
    # a NULL hour comes after the others of its day; NULL state and closed states are out
    assert [r["match_id"] for r in got] == ["m3", "m2", "m7", "m1"]
    assert got[0]["match_name"] == "Alfa vs "
    assert got[0]["occupancy_level"] == "Sin capacidad"
    assert got[2]["occupancy_level"] == "Sin capacidad"
    assert got[3]["formatted_date"] == "20 de enero de 2024"
    assert (got[3]["tickets_sold"], got[3]["occupancy_percentage"]) == (7, Decimal("70.00"))
    assert got[3]["occupancy_level"] == "Alto"
    assert one(dashboard.upcoming_count(t, TODAY))["upcoming_matches_count"] == 4
    assert len(rows(dashboard.upcoming_matches(t, TODAY, k=2))) == 2


def test_stand_comparison_levels_before_rounding(make_tables):
    t = make_tables(
        soccer_stands=[
            stand("s", "Norte", 30000),
            stand("e", "Este", 4),
            stand("z", "Cero", 0),
        ],
        matches=[match("m1"), match("m2", state="finalizado"), match("m3", state=None)],
        match_stand_prices=[
            price("m1", "s"),
            price("m1", "e"),
            price("m2", "e"),
            price("m3", "e"),
            price("m1", "z"),
        ],
        tickets=[ticket(f"e{i}", "m1", "e") for i in range(3)]
        + [ticket(f"c{i}", "m2", "e") for i in range(3)]
        + [ticket(f"n{i}", "m3", "e") for i in range(3)]
        + [ticket("none", "m1")],
    )
    got = {r["stand_name"]: r for r in rows(dashboard.stand_comparison(t))}
    assert got["Este"]["tickets_sold"] == 3
    assert got["Este"]["occupancy_percentage"] == Decimal("75.00")
    assert got["Este"]["occupancy_level"] == "Medio"
    assert got["Norte"]["occupancy_level"] == "Bajo"
    assert got["Cero"]["occupancy_level"] == "Sin capacidad"
    assert got["Cero"]["occupancy_percentage"] == Decimal("0.00")


def test_trend_days_without_sales_are_absent(make_tables):
    t = make_tables(
        tickets=[
            ticket("1", "m", purchased_at=at("2024-01-08T00:00:00")),
            ticket("2", "m", purchased_at=at("2024-01-07T23:59:59")),
            ticket("3", "m", purchased_at=at("2024-01-30T08:00:00")),
        ]
    )
    got = rows(dashboard.sales_trend(t, TODAY))
    assert [(str(r["sale_date"]), r["day_name"], r["tickets_sold"]) for r in got] == [
        ("2024-01-08", "Lun", 1),
        ("2024-01-30", "Mar", 1),
    ]


def test_summary_average_is_over_days_with_sales(make_tables):
    moments = ["2024-01-10T01:00:00"] * 3 + ["2024-01-12T01:00:00", "2020-01-01T00:00:00"]
    t = make_tables(
        matches=[match("m1"), match("m2", state=None), match("m3", state="cancelado")],
        soccer_stands=[stand("s", "Norte", 1)],
        tickets=[
            ticket(str(i), "m1", purchased_at=at(moment)) for i, moment in enumerate(moments)
        ],
    )
    assert one(dashboard.general_summary(t, TODAY)) == {
        "active_matches": 1,
        "total_stands": 1,
        "total_tickets_sold": 5,
        "total_revenue": Decimal("500.00"),
        "avg_daily_sales": 2.0,
    }


def test_document_of_empty_tables(make_tables):
    got = one(dashboard.dashboard_json(make_tables(), TODAY))
    assert json.loads(got["upcomingMatches"]) == {"count": 0, "matches": None}
    assert got["standComparison"] == got["salesTrend"] == got["dailyRevenue"] == "[]"
    assert json.loads(got["summary"])["avg_daily_sales"] == 0.0


def test_document_keeps_order_and_null_fields(make_tables):
    t = make_tables(
        teams=TEAMS,
        matches=[match("m1", "2024-01-21"), match("m2", "2024-01-20", match_hour=None)],
        tickets=[
            ticket("1", "m1", purchased_at=at("2024-01-14T10:00:00")),
            ticket("2", "m1", purchased_at=at("2024-01-13T10:00:00")),
        ],
    )
    got = one(dashboard.dashboard_json(t, TODAY))
    shown = json.loads(got["upcomingMatches"])["matches"]
    assert [m["match_id"] for m in shown] == ["m2", "m1"]
    assert shown[0]["match_hour"] is None and "match_date" not in shown[0]
    assert [d["sale_date"] for d in json.loads(got["salesTrend"])] == ["2024-01-13", "2024-01-14"]
    assert [d["sale_date"] for d in json.loads(got["dailyRevenue"])] == [
        "2024-01-14",
        "2024-01-13",
    ]


def test_report_capacity_counts_equal_sizes_once(make_tables):
    t = make_tables(
        soccer_stands=[stand("n", "Norte", 55), stand("s", "Sur", 55), stand("o", "Oriental", 90)],
        match_stand_prices=[price("m1", "n"), price("m1", "s"), price("m2", "n"), price("m2", "o")],
    )
    assert one(reports.capacity(t)) == {"total_capacity": 200, "total_capacity_all": 255}


def test_stands_of_one_name_merge_and_ties_take_the_lowest_name(make_tables):
    t = make_tables(
        soccer_stands=[stand("n1", "Norte", 5), stand("n2", "Norte", 5), stand("s", "Este", 5)],
        match_stand_prices=[price("m", "n1"), price("m", "n2"), price("m", "s")],
        tickets=[
            ticket("1", "m", "n1", price="1.00"),
            ticket("2", "m", "n2", price="2.00"),
            ticket("3", "m", "s"),
            ticket("4", "m", "s"),
            ticket("5", "m"),
        ],
    )
    got = rows(reports.revenue_by_stand(t))
    assert [(r["stand_name"], r["tickets_sold"], r["stand_revenue"]) for r in got] == [
        ("Este", 2, Decimal("200.00")),
        ("Norte", 2, Decimal("3.00")),
    ]
    assert one(reports.most_popular_stand(t)) == {"stand_name": "Este"}
    shares = {r["stand_name"]: r["percentage"] for r in rows(reports.tickets_by_stand(t))}
    assert shares == {"Este": "40.00", "Norte": "40.00"}
    # by stand plus without a stand gives all sold tickets
    assert sum(r["tickets_sold"] for r in got) + 1 == one(reports.total_stats(t))["total_tickets_sold"]


def test_report_of_nothing(make_tables):
    t = make_tables(soccer_stands=[stand("n", "Norte", 5)])
    assert one(reports.most_popular_stand(make_tables())) == {"stand_name": "No disponible"}
    assert rows(reports.tickets_by_stand(t))[0]["percentage"] == "0.00"
    assert one(reports.report_totals(t))["total_occupancy_percentage"] == Decimal("0.00")


def test_top_matches_break_ties_by_date(make_tables):
    t = make_tables(
        teams=TEAMS,
        matches=[
            match("a", "2024-01-01"),
            match("b", "2024-01-03"),
            match("c", "2024-01-02"),
            match("d", None),
        ],
        tickets=[ticket(f"{m}{i}", m) for m in "abc" for i in range(2)],
    )
    assert [r["match_id"] for r in rows(reports.top_matches(t))] == ["b", "c", "a"]
    # without sales a match without a date is first, as its date sorts first descending
    assert rows(reports.match_details(t))[0]["match_id"] == "d"


def test_revenue_by_day_leaves_out_free_transactions(make_tables):
    t = make_tables(
        transactions=[
            {"id": "1", "id_users": "u", "total_amount": "10.00", "created_at": at("2024-01-02T09:00:00")},
            {"id": "2", "id_users": "u", "total_amount": "5.00", "created_at": at("2024-01-02T10:00:00")},
            {"id": "3", "id_users": "u", "total_amount": "0.00", "created_at": at("2024-01-03T10:00:00")},
        ]
    )
    assert one(reports.revenue_by_day(t)) == {
        "sale_date": day("2024-01-02"),
        "daily_revenue": Decimal("15.00"),
        "transactions_count": 2,
    }


def test_report_sections_from_one_rollup_equal_the_single_ones(make_tables):
    t = make_tables(
        teams=TEAMS,
        soccer_stands=[stand("n", "Norte", 5), stand("s", "Sur", 9)],
        matches=[match("m"), match("k", "2024-01-02"), match("q", None)],
        match_stand_prices=[price("m", "n"), price("k", "s"), price("k", "n")],
        tickets=[ticket(f"m{i}", "m", "n") for i in range(3)]
        + [ticket("k1", "k", "s"), ticket("k2", "k"), ticket("k3", "k", "n", state="usado")],
        transactions=[{"id": "x", "id_users": "u", "total_amount": "10.00"}],
    )
    sections = reports.sales_report(t)
    single = {
        "totalStats": reports.report_totals(t),
        "revenueByDay": reports.revenue_by_day(t),
        "revenueByStand": reports.revenue_by_stand(t),
        "ticketsByStand": reports.tickets_by_stand(t),
        "topMatches": reports.top_matches(t),
        "matchesDetails": reports.match_details(t),
    }
    assert {n: rows(s) for n, s in sections.items()} == {n: rows(s) for n, s in single.items()}
    assert one(sections["totalStats"])["total_tickets_sold"] == 5
