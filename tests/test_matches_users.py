from __future__ import annotations

from decimal import Decimal

from conftest import at, day, one, rows
from pyspark.sql import functions as F
from test_dashboard_reports import TEAMS, match, price, stand, ticket

from taquilla.operators import listings, matches, occupancy, simulations, users

STANDS = [stand("n", "Norte", 10), stand("s", "Sur", 5), stand("z", "Cero", 0)]


def test_catalog_of_a_match_without_prices_is_an_empty_array(make_tables):
    t = make_tables(
        teams=TEAMS,
        soccer_stands=STANDS,
        matches=[match("m1"), match("m2")],
        match_stand_prices=[price("m1", "s"), price("m1", "n")],
    )
    got = rows(matches.match_catalog(t))
    assert [r["stand_price"] for r in got if r["id"] == "m2"] == [None]
    priced = [r for r in got if r["id"] == "m1"]
    assert sorted(r["stand_price"]["stand"]["name"] for r in priced) == ["Norte", "Sur"]
    assert {r["local"]["name"] for r in priced} == {"Alfa"}
    assert [r["id"] for r in rows(matches.match_catalog(t, "m2"))] == ["m2"]


def test_history_counts_all_states_and_takes_the_last_result(make_tables):
    t = make_tables(
        teams=TEAMS,
        matches=[match("m1", state="finalizado"), match("m2", state="cancelado"), match("m3")],
        tickets=[ticket("1", "m1"), ticket("2", "m1", state="anulado"), ticket("3", "m3")],
        match_simulations=[
            {"id": "a", "id_matches": "m1", "local_goals": 1},
            {"id": "b", "id_matches": "m1", "local_goals": 4},
        ],
    )
    got = {r["id"]: r for r in rows(matches.match_history(t))}
    assert set(got) == {"m1", "m2"}
    assert got["m1"]["total_tickets_sold"] == 2
    assert got["m1"]["result"]["local_goals"] == 4
    assert got["m2"]["result"] is None
    assert one(matches.match_history_summary(t)) == {
        "total_matches": 2,
        "total_tickets_sold": 2,
        "total_revenue": Decimal("200.00"),
        "average_tickets_per_match": 1,
        "average_revenue_per_match": 100,
    }
    assert one(matches.match_history_summary(make_tables()))["average_tickets_per_match"] == 0


def test_occupancy_states(make_tables):
    t = make_tables(
        soccer_stands=STANDS,
        matches=[match(m) for m in ("full", "over", "few", "free", "zero", "none")],
        match_stand_prices=[
            price("full", "s", "9.00"),
            price("over", "s"),
            price("few", "n"),
            price("few", "s", "7.00"),
            price("free", "n"),
            price("zero", "z"),
        ],
        tickets=[ticket(f"f{i}", "full", state="usado") for i in range(5)]
        + [ticket(f"o{i}", "over") for i in range(6)]
        + [ticket(f"w{i}", "few") for i in range(13)]
        + [ticket("z", "zero")],
    )
    got = {r["match_id"]: r for r in rows(occupancy.match_occupancy(t))}
    assert "none" not in got
    assert {m: r["status"] for m, r in got.items()} == {
        "full": "Agotadas",
        "over": "Pocos cupos",
        "few": "Pocos cupos",
        "free": "Disponibles",
        "zero": "Pocos cupos",
    }
    assert got["over"]["available_percentage"] == Decimal("-20.00")
    assert got["few"]["lowest_price"] == Decimal("7.00")
    assert got["zero"]["occupancy_percentage"] is None


def test_stand_summary_uses_list_price_and_merges_equal_rows(make_tables):
    t = make_tables(
        soccer_stands=STANDS,
        matches=[match("m"), match("other")],
        match_stand_prices=[
            price("m", "n", "100.00"),
            price("m", "n", "100.00", key="m-n2"),
            price("m", "z", "1.00"),
        ],
        tickets=[ticket(f"t{i}", "m", "n", price="1.00") for i in range(7)]
        + [ticket("u", "m", "n", state="usado")]
        + [dict(ticket("second", "m"), id_match_stand_price="m-n2")]
        # a ticket of another match pointing at this price row does not count
        + [dict(ticket("wrong", "other"), id_match_stand_price="m-n")],
    )
    got = {r["stand_name"]: r for r in rows(occupancy.match_stand_summary(t, "m"))}
    assert got["Norte"]["tickets_sold"] == 8
    assert got["Norte"]["revenue"] == Decimal("800.00")
    assert got["Norte"]["availability"] == "Pocas disponibles"
    assert got["Cero"]["availability"] == "Sin disponibilidad"
    assert got["Cero"]["occupancy_percentage"] is None
    totals = {r["match_id"]: r for r in rows(occupancy.match_stand_totals(t))}
    assert totals["m"]["tickets_sold"] == sum(r["tickets_sold"] for r in got.values())
    assert totals["m"]["total_capacity"] == 10
    assert totals["other"]["total_capacity"] == 0
    assert totals["other"]["occupancy_percentage"] is None


def user_tables(make_tables):
    return make_tables(
        users=[
            {"id": "u", "name": "Ana", "email": "a@x.co"},
            {"id": "v", "name": "Beto", "email": "b@x.co"},
        ],
        teams=TEAMS,
        soccer_stands=STANDS,
        matches=[match("m1", "2024-01-20", match_hour="00:05:00"), match("m2", "2024-02-01")],
        match_stand_prices=[price("m1", "n"), price("m1", "s"), price("m2", "s")],
        transactions=[
            {"id": "x", "id_users": "u", "total_amount": "300.00"},
            {"id": "y", "id_users": "u", "total_amount": "50.00"},
        ],
        tickets=[
            ticket("1", "m1", "n", purchased_at=at("2024-01-01T10:00:00"), row=3, seat=0),
            ticket("2", "m1", "n", purchased_at=at("2024-01-02T10:00:00"), row=3, seat=4),
            ticket("3", "m1", "s", purchased_at=at("2024-01-03T10:00:00")),
            ticket("4", "m2", "s", purchased_at=at("2024-03-02T09:00:00"), id_transaction="y"),
            ticket("5", "m2", purchased_at=at("2024-01-04T10:00:00"), id_transaction="gone"),
            ticket("6", "m2", state="anulado"),
        ],
    )


def test_user_summary_quirks_and_ties(make_tables):
    got = {r["user_id"]: r for r in rows(users.user_purchase_summary(user_tables(make_tables)))}
    ana = got["u"]
    assert (ana["total_tickets"], ana["total_matches"]) == (5, 2)
    # a transaction enters once per ticket: three times 300 and once 50
    assert ana["total_spent"] == Decimal("950.00")
    assert ana["total_spent_tickets"] == Decimal("500.00")
    assert ana["average_per_match"] == Decimal("475.00")
    assert ana["total_spent_text"] == "$\u00a0950"
    # two each in Norte and Sur: the stand bought last wins
    assert (ana["favorite_stand"], ana["favorite_stand_count"]) == ("Sur", 2)
    assert ana["favorite_stand_percentage"] == "40.0%"
    # 60 days and 23 hours are three begun months
    assert ana["months_active"] == 3
    assert ana["last_purchase_text"] == "2 de marzo de 2024"
    beto = got["v"]
    assert (beto["total_tickets"], beto["total_matches"]) == (0, 0)
    assert beto["total_spent"] == Decimal("0.00")
    assert beto["favorite_stand"] is beto["first_purchase"] is beto["months_active"] is None


def test_user_history_distribution_and_recent(make_tables):
    t = user_tables(make_tables)
    history = rows(users.user_match_history(t, "u"))
    assert [r["match_id"] for r in history] == ["m2", "m2", "m1", "m1", "m1"]
    first = history[2]
    assert first["time_formatted"] == "12:05 am"
    assert first["date_formatted"] == "20 de enero del 2024"
    assert first["tickets_count"] == 3
    assert [r["ticket_id"] for r in history[2:]] == ["3", "2", "1"]
    assert [r["seat_info"] for r in history[2:]] == [None, "Fila 3 - Asiento 4", None]
    assert history[1]["stand"] == "Sin especificar"
    shares = rows(users.user_stand_distribution(t, "u"))
    assert [(r["stand"], r["count"], r["percentage"]) for r in shares] == [
        ("Norte", 2, "40.0%"),
        ("Sur", 2, "40.0%"),
    ]
    recent = rows(users.user_recent_purchases(t, "u", k=2))
    assert [(r["position"], r["date_time"]) for r in recent] == [
        (1, "1 de febrero del 2024 a las 7:00 pm"),
        (2, "1 de febrero del 2024 a las 7:00 pm"),
    ]


def test_one_row_per_child_whatever_their_number(make_tables):
    def bought(n):
        return make_tables(
            teams=TEAMS,
            matches=[match("m")],
            transactions=[{"id": "x", "id_users": "u", "id_matches": "m"}],
            tickets=[
                ticket(f"{i:05d}", "m", id_users="u", id_transaction="x") for i in range(n)
            ],
        )

    for n in (3, 5000):
        t = bought(n)
        details = rows(listings.transaction_details(t, "x"))
        assert [r["ticket"]["id"] for r in details] == [f"{i:05d}" for i in range(n)]
        history = rows(users.user_match_history(t, "u"))
        assert [r["ticket_id"] for r in history] == [f"{n - 1 - i:05d}" for i in range(n)]
        assert {(r["tickets_count"], r["local_name"]) for r in history} == {(n, "Alfa")}
    nothing = rows(listings.transaction_details(bought(0), "x"))
    assert [(r["id"], r["ticket"]) for r in nothing] == [("x", None)]


def test_listings_scope_and_hidden_password(make_tables):
    t = user_tables(make_tables)
    assert [r["id"] for r in rows(listings.ticket_listing(t, user_id="u"))][0] == "4"
    assert rows(listings.ticket_listing(t, user_id="v")) == []
    admin = one(listings.ticket_listing(t, ticket_id="1", is_admin=True))
    assert (admin["user_name"], admin["stand_name"], admin["seat_info"]) == ("Ana", "Norte", None)
    assert len(rows(listings.transaction_listing(t, user_id="u"))) == 2
    assert "password" not in listings.entity_listing(t, "users").columns
    assert one(listings.entity_listing(t, "users", "v"))["name"] == "Beto"
    details = rows(listings.transaction_details(t, "x"))
    # tickets of any state
    assert [r["ticket"]["id"] for r in details] == ["1", "2", "3", "6"]


def simulated(make_tables):
    return make_tables(
        teams=TEAMS,
        matches=[match("m1", state="finalizado")],
        match_simulations=[
            {
                "id": f"s{i}",
                "id_matches": f"m{i}",
                "local_goals": i,
                "local_goals_first_half": 1,
                "local_possession": "55.50" if i == 1 else None,
            }
            for i in range(1, 6)
        ],
        simulations_events=[
            {"id": "e1", "id_teams": "A", "id_match_simulations": "s1", "minute": 46},
            {"id": "e2", "id_teams": "B", "id_match_simulations": "s1", "minute": 45,
             "type_event": "Tarjeta roja"},
            {"id": "e3", "id_teams": "A", "id_match_simulations": "s4", "minute": 9},
        ],
    )


def test_scoreboard_timeline_and_counts(make_tables):
    t = simulated(make_tables)
    board = one(simulations.match_scoreboard(t, "m1"))
    assert board["score"] == "1 - 0"
    assert board["first_half"] == {"local": 1, "visitor": 0, "score": "1 - 0"}
    assert board["local"]["possession"] == "55.50%"
    assert board["visitor"]["possession"] == "null%"
    assert board["local"]["team"]["name"] == "Alfa"
    line = rows(simulations.match_timeline(t, "m1"))
    assert [(e["id"], e["half"], e["team_name"]) for e in line] == [
        ("e2", "first_half", "Beta"),
        ("e1", "second_half", "Alfa"),
    ]
    counts = {r["match_id"]: r for r in rows(simulations.match_event_summary(t))}
    assert (counts["m1"]["total_events"], counts["m1"]["goals"], counts["m1"]["red_cards"]) == (2, 1, 1)
    assert counts["m2"]["total_events"] == 0
    literal = one(simulations.match_event_summary(t, "m1", literal=True))
    assert (literal["total_events"], literal["goals"]) == (2, 0)


def test_pages(make_tables):
    t = simulated(make_tables)
    page = rows(listings.paged_listing(t, "match_simulations", page=1, limit=2))
    assert [(r["id"], r["total"]) for r in page] == [("s5", 5), ("s4", 5)]
    assert [r["id"] for r in rows(listings.paged_listing(t, "match_simulations", 3, 2))] == ["s1"]
    assert [r["id"] for r in rows(listings.page_events(t, page=1, limit=2))] == ["e3"]
    with_events = rows(simulations.simulation_with_events(t, "s1"))
    assert sorted(r["event_id"] for r in with_events) == ["e1", "e2"]
    assert one(simulations.simulation_with_events(t, "s2"))["event_id"] is None
    assert len(rows(simulations.simulation_events(t, "s1"))) == 2
