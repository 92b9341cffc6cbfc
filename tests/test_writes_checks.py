from __future__ import annotations

from collections import Counter
from decimal import Decimal

import pytest
from conftest import MOMENT, at, day, frame, one, rows
from pyspark.sql import functions as F
from test_dashboard_reports import TEAMS, match, price, stand, ticket
from test_matches_users import simulated, user_tables

from taquilla.operators import checks, writes
from taquilla.plans import sizing
from taquilla.sources.schemas import TABLE_ORDER
from taquilla.sources.tables import bought_since, read_tables, write_table, write_tables

NOW = at("2024-05-05T12:00:00")


def keyed(df, key="id"):
    return {r[key]: r for r in rows(df)}


def test_defaults_for_transactions(spark):
    sent = spark.createDataFrame(
        [
            ("1", "u", "", Decimal("5.00"), 0, "", None, "", None),
            ("2", "u", "m", Decimal("0.00"), 3, "card", "r", "USD", MOMENT),
        ],
        "id string, id_users string, id_matches string, total_amount decimal(12,2),"
        " number_tickets int, payment_method string, reference string, currency string,"
        " created_at timestamp_ntz",
    )
    got = keyed(writes.apply_defaults("transactions", sent, NOW))
    assert got["1"]["id_matches"] is got["1"]["payment_method"] is got["1"]["reference"] is None
    assert (got["1"]["number_tickets"], got["1"]["currency"]) == (1, "COP")
    assert got["1"]["created_at"] == NOW
    # an amount of zero is a value, not a missing one
    assert got["2"]["total_amount"] == Decimal("0.00")
    assert (got["2"]["number_tickets"], got["2"]["created_at"]) == (3, MOMENT)


def test_defaults_for_other_tables(spark):
    sent = spark.createDataFrame(
        [("1", "7/1/2024", ""), ("2", "2024-01-07", "en_venta"), ("3", "2024/01/17", None)],
        "id string, match_date string, state string",
    )
    got = keyed(writes.apply_defaults("matches", sent, NOW))
    assert [got[k]["match_date"] for k in "123"] == [day("2024-01-07"), day("2024-01-07"), None]
    assert [got[k]["state"] for k in "123"] == [None, "en_venta", None]
    tickets = spark.createDataFrame([("1", None, None)], "id string, state string, purchased_at timestamp_ntz")
    assert one(writes.apply_defaults("tickets", tickets, NOW)) == {
        "id": "1",
        "state": "vendido",
        "purchased_at": NOW,
    }
    users = spark.createDataFrame([("1", ""), ("2", "administrador")], "id string, rol string")
    assert [r["rol"] for r in rows(writes.apply_defaults("users", users, NOW))] == [
        "usuario",
        "administrador",
    ]
    sims = spark.createDataFrame([("1", None, 0)], "id string, local_red_cards int, local_possession int")
    assert one(writes.apply_defaults("match_simulations", sims, NOW)) == {
        "id": "1",
        "local_red_cards": 0,
        "local_possession": None,
    }


PATCH = "id string, seq int, set_fields array<string>, name string, city string, foundation string"


def test_patch_sets_only_named_and_allowed_fields(spark):
    teams = frame(
        spark,
        "teams",
        [
            {"id": "A", "name": "Alfa", "city": "Cali"},
            {"id": "B", "name": "Beta", "city": "Bogota"},
            {"id": "C", "name": "Gama", "city": "Pasto"},
        ],
    )
    patches = spark.createDataFrame(
        [
            ("A", 1, ["name"], "Uno", "ignored", None),
            ("A", 2, ["name"], "Dos", None, None),
            ("A", 1, ["city"], None, None, None),
            ("B", 1, ["foundation"], None, None, "2000"),
            ("X", 1, ["name"], "Nobody", None, None),
        ],
        PATCH,
    )
    got = keyed(writes.patch_rows("teams", teams, patches))
    # of two patches to one field the later one; an explicit NULL overwrites
    assert (got["A"]["name"], got["A"]["city"]) == ("Dos", None)
    # foundation is not on the list of the table
    assert (got["B"]["foundation"], got["B"]["name"]) == ("1900", "Beta")
    assert (got["C"]["name"], got["C"]["city"]) == ("Gama", "Pasto")
    assert one(writes.patches_without_row(teams, patches))["id"] == "X"


def test_patchable_fields_by_role():
    columns = ["id", "name", "rol", "created_at"]
    assert writes.patchable_fields("users", columns, False) == ["name"]
    assert writes.patchable_fields("users", columns, True) == ["name", "rol"]
    sims = ["id", "id_matches", "local_goals_first_half"]
    assert writes.patchable_fields("match_simulations", sims, False) == ["id_matches"]
    assert writes.patchable_fields("match_simulations", sims, True) == sims[1:]


def ids(t):
    return {name: sorted(r["id"] for r in t[name].collect()) for name in TABLE_ORDER}


def cascade_tables(make_tables):
    return make_tables(
        users=[{"id": "u", "name": "Ana", "email": "a"}, {"id": "v", "name": "Beto", "email": "b"}],
        teams=[*TEAMS, {"id": "C", "name": "Gama"}],
        soccer_stands=[stand("n", "Norte", 10), stand("s", "Sur", 5)],
        matches=[match("m1"), match("m2", id_team_local="B", id_team_visitor="C")],
        match_stand_prices=[price("m1", "n"), price("m2", "s"), price("m2", "n")],
        transactions=[
            {"id": "x", "id_users": "u", "id_matches": "m1", "total_amount": "1.00"},
            {"id": "y", "id_users": "v", "id_matches": None, "total_amount": "1.00"},
        ],
        tickets=[
            ticket("1", "m1", "n"),
            ticket("2", "m2", "s", id_transaction="y", id_users="v"),
            ticket("3", "m2", id_transaction="y", id_users="v"),
            ticket("4", "m2", "s", id_transaction="x", id_users="v"),
        ],
        match_simulations=[{"id": "s1", "id_matches": "m1"}, {"id": "s2", "id_matches": "m2"}],
        simulations_events=[
            {"id": "e1", "id_teams": "B", "id_match_simulations": "s1"},
            {"id": "e2", "id_teams": "C", "id_match_simulations": "s2"},
            {"id": "e3", "id_teams": "A", "id_match_simulations": "s2"},
        ],
    )


def test_cascade_from_a_team(make_tables):
    t = cascade_tables(make_tables)
    after = writes.delete_cascade(t, "teams", t.teams.filter("id = 'A'").select("id"))
    assert ids(after) == {
        "users": ["u", "v"],
        "teams": ["B", "C"],
        "soccer_stands": ["n", "s"],
        "matches": ["m2"],
        "match_stand_prices": ["m2-n", "m2-s"],
        "transactions": ["y"],
        "match_simulations": ["s2"],
        # 4 goes with its transaction, which goes with its match
        "tickets": ["2", "3"],
        "simulations_events": ["e2"],
    }
    for name in TABLE_ORDER:
        assert checks.check_references(after, name, after[name]).isEmpty()


def test_cascade_from_a_stand_and_a_user(make_tables):
    t = cascade_tables(make_tables)
    after = ids(writes.delete_cascade(t, "soccer_stands", t.soccer_stands.filter("id = 's'")))
    assert after["match_stand_prices"] == ["m1-n", "m2-n"]
    assert after["tickets"] == ["1", "3"]
    assert after["matches"] == ["m1", "m2"]
    after = ids(writes.delete_cascade(t, "users", t.users.filter("id = 'u'")))
    assert (after["transactions"], after["tickets"]) == (["y"], ["2", "3"])
    after = ids(writes.delete_cascade(t, "tickets", t.tickets.filter("id = '2'")))
    assert after["tickets"] == ["1", "3", "4"]


def test_settlement(make_tables, spark):
    t = make_tables(
        matches=[match("m1"), match("m2", state="finalizado"), match("m3", state=None), match("m4")],
        tickets=[
            ticket("1", "m1"),
            ticket("2", "m1", state="anulado"),
            ticket("3", "m2"),
            ticket("4", "m4"),
        ],
        match_simulations=[{"id": "s", "id_matches": "m1"}],
    )
    asked = spark.createDataFrame([("m1",), ("m1",), ("m2",), ("m3",), ("none",)], "id string")
    after, counts = writes.settle_matches(t, asked)
    assert {r["match_id"]: r["tickets_updated"] for r in rows(counts)} == {"m1": 1, "m3": 0}
    assert {r["id"]: r["state"] for r in rows(after.matches)} == {
        "m1": "finalizado",
        "m2": "finalizado",
        "m3": "finalizado",
        "m4": "en_venta",
    }
    assert {r["id"]: r["state"] for r in rows(after.tickets)} == {
        "1": "usado",
        "2": "anulado",
        "3": "vendido",
        "4": "vendido",
    }
    again, counts = writes.settle_matches(after, asked)
    assert counts.isEmpty()
    assert sorted(map(str, rows(again.tickets))) == sorted(map(str, rows(after.tickets)))
    refused = {(r["id"], r["rule"]) for r in rows(checks.check_settlement(t, asked))}
    assert refused == {
        ("m1", "already simulated"),
        ("m2", "already finished"),
        ("none", "no such row in matches"),
    }


def test_prices_for_every_stand_of_every_match(make_tables):
    t = make_tables(
        matches=[match(f"m{i}") for i in range(20)],
        soccer_stands=[
            stand("1", "Occidental", 1),
            stand("2", "Oriental", 1),
            stand("3", "Norte", 1),
            stand("4", "Sur", 1),
            stand("5", "Palco", 1),
        ],
    )
    got = rows(writes.provision_prices(t.matches, t.soccer_stands, NOW))
    assert len(got) == 100 and len({r["id"] for r in got}) == 100
    assert {(r["id_stand"], r["price"]) for r in got} == {
        ("1", Decimal("80000.00")),
        ("2", Decimal("70000.00")),
        ("3", Decimal("40000.00")),
        ("4", Decimal("45000.00")),
        ("5", Decimal("50000.00")),
    }
    with pytest.raises(ValueError):
        writes.provision_prices(t.matches, make_tables().soccer_stands, NOW)


def broken(df):
    return {(r["id"], r["field"], r["rule"]) for r in rows(df)}


def test_required_fields(spark):
    events = spark.createDataFrame(
        [("1", "A", "s", 0, "Gol", "P"), ("2", "", "s", None, "", None)],
        "id string, id_teams string, id_match_simulations string, minute int, type_event string,"
        " player string",
    )
    assert broken(checks.check_required("simulations_events", events)) == {
        ("2", "id_teams", "required"),
        ("2", "minute", "required"),
        ("2", "type_event", "required"),
        ("2", "player", "required"),
    }
    requests = spark.createDataFrame(
        [("1", 0, 0, Decimal("0.00"), 1), ("2", None, 5, None, 0)],
        "id string, id_users bigint, id_matches bigint, price decimal(10,2), quantity int",
    )
    assert broken(checks.check_required("purchase_requests", requests)) == {
        ("2", "id_users", "required"),
        ("2", "price", "required"),
        ("2", "quantity", "required"),
    }


def test_domain_allows_null(make_tables):
    t = make_tables(matches=[match("a", state=None), match("b", state="aplazado"), match("c")])
    assert broken(checks.check_domain("matches", t.matches)) == {("b", "state", "not in list")}
    assert checks.check_domain("teams", t.teams).isEmpty()


def test_references_ignore_null(make_tables):
    t = make_tables(
        users=[{"id": "u", "name": "Ana", "email": "a"}],
        matches=[match("m")],
        transactions=[{"id": "x", "id_users": "u", "total_amount": "1.00"}],
        tickets=[ticket("1", "m"), ticket("2", "gone", "n", id_users="w")],
    )
    assert broken(checks.check_references(t, "tickets", t.tickets)) == {
        ("2", "id_users", "no such row in users"),
        ("2", "id_matches", "no such row in matches"),
        ("2", "id_match_stand_price", "no such row in match_stand_prices"),
    }


def test_unique_in_batch_and_table(spark):
    stored = frame(spark, "users", [{"id": "1", "name": "A", "email": "a", "identification": "9"}])
    batch = frame(
        spark,
        "users",
        [
            {"id": "1", "name": "A", "email": "a", "identification": "9"},
            {"id": "2", "name": "B", "email": "a", "identification": None},
            {"id": "3", "name": "C", "email": "c", "identification": None},
        ],
    )
    assert broken(checks.check_unique("users", batch, stored)) == {
        ("1", "email", "repeated in batch"),
        ("2", "email", "repeated in batch"),
        # row 1 is the stored row itself
        ("2", "email", "already in table"),
    }


def test_unique_with_one_value_on_most_rows(spark):
    batch = spark.range(3000).select(
        F.col("id").cast("string").alias("id"),
        F.when(F.col("id") < 2000, "same").otherwise(F.col("id").cast("string")).alias("ticket_code"),
    )
    found = checks.check_unique("tickets", batch, batch)
    assert Counter(r["rule"] for r in rows(found)) == {
        "repeated in batch": 2000,
        "already in table": 2000,
    }


def test_shape(spark, make_tables):
    users = frame(
        spark,
        "users",
        [
            {"id": "1", "name": "Ana", "email": "ana@club.com.co", "password": "123456"},
            {"id": "2", "name": "A", "email": "ana@club", "password": "12345", "last_name": "x" * 101},
            {"id": "3", "name": "Bo", "email": "no spaces@club.co", "identification": "123"},
        ],
    )
    assert broken(checks.check_shape("users", users)) == {
        ("2", "name", "too short"),
        ("2", "email", "not an e-mail"),
        ("2", "password", "too short"),
        ("2", "last_name", "too long"),
        ("3", "email", "not an e-mail"),
        ("3", "identification", "too short"),
    }
    sent = spark.createDataFrame(
        [("1", "N", "55"), ("2", "S", "-1"), ("3", "E", "1.5"), ("4", "O", None)],
        "id string, name string, total_capacity string",
    )
    assert {r[0] for r in broken(checks.check_shape("soccer_stands", sent))} == {"2", "3"}


def test_rules(spark, make_tables):
    t = make_tables(matches=[match("a"), match("b", id_team_visitor="A")])
    assert broken(checks.check_rules("matches", t.matches)) == {
        ("b", "id_team_visitor", "same team twice")
    }
    requests = spark.createDataFrame([("1", 0), ("2", 1), ("3", 10), ("4", 11)], "id string, quantity int")
    assert {r[0] for r in broken(checks.check_rules("purchase_requests", requests))} == {"1", "4"}


def test_tables_survive_a_round_trip(make_tables, spark, tmp_path):
    t = user_tables(make_tables)
    write_tables(t, str(tmp_path))
    stored = read_tables(spark, str(tmp_path))
    for name in TABLE_ORDER:
        columns = t[name].columns
        assert sorted(map(str, rows(stored[name].select(columns)))) == sorted(map(str, rows(t[name])))
    # a query on days opens only the folders of those days
    recent = bought_since(stored.tickets, day("2024-01-04"))
    assert sorted(r["id"] for r in rows(recent)) == ["4", "5"]
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(purchase_day" in plan
    write_table("tickets", t.tickets.limit(0), str(tmp_path))
    write_table("teams", frame(spark, "teams", [{"id": "Z", "name": "Zeta"}]), str(tmp_path))
    assert read_tables(spark, str(tmp_path)).teams.count() == 3


def test_simulated_fixture_has_clean_references(make_tables):
    t = simulated(make_tables)
    assert checks.check_references(t, "simulations_events", t.simulations_events).isEmpty()


def test_an_unknown_table_is_an_error(make_tables):
    t = make_tables()
    for check in (
        checks.check_required,
        checks.check_domain,
        checks.check_unique,
        checks.check_shape,
        checks.check_rules,
    ):
        with pytest.raises(ValueError, match="matchs"):
            check("matchs", t.matches)
    with pytest.raises(ValueError, match="matchs"):
        checks.check_references(t, "matchs", t.matches)


def test_wide_patches_are_not_broadcast(spark, make_tables, monkeypatch):
    t = make_tables(transactions=[{"id": "x", "id_users": "u", "total_amount": "1.00"}])
    wide = spark.range(40).select(
        F.concat(F.lit("x"), F.col("id").cast("string")).alias("id"),
        F.lit(1).alias("seq"),
        F.array(F.lit("reference")).alias("set_fields"),
        F.repeat(F.lit("r"), 1_000).alias("reference"),
    )

    def plan(patches):
        patched = writes.patch_rows("transactions", t.transactions, patches, is_admin=True)
        return patched._jdf.queryExecution().optimizedPlan().toString()

    assert "strategy=broadcast" in plan(wide)
    monkeypatch.setattr(sizing, "PART_OF_HEAP", 1 << 15)  # 32 kB of 1 GB
    assert "strategy=broadcast" not in plan(wide)
    assert "strategy=broadcast" in plan(wide.limit(5))


def test_prices_come_in_blocks_of_stands(make_tables):
    t = make_tables(
        matches=[match(f"m{i}") for i in range(7)],
        soccer_stands=[stand(f"s{i}", "Norte", 1) for i in range(9)],
    )
    whole = rows(writes.provision_prices(t.matches, t.soccer_stands, NOW))
    blocks = writes.provision_prices(t.matches, t.soccer_stands, NOW, block_bytes=100)
    assert blocks._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") > 2
    assert len(whole) == 63
    assert sorted(r["id"] for r in rows(blocks)) == sorted(r["id"] for r in whole)


def test_references_are_looked_up_in_two_passes(make_tables):
    t = cascade_tables(make_tables)
    found = checks.check_references(t, "tickets", t.tickets)
    assert found.isEmpty()
    with pytest.raises(ValueError):
        checks.check_references(t, "tickets", t.tickets.drop("id_users"))
    with pytest.raises(ValueError):
        checks.check_rules("purchase_requests", t.tickets)
