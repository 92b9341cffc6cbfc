from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict

import pytest
from conftest import rows
from test_dashboard_reports import TEAMS, match, price, stand, ticket

from taquilla.operators import admission

REQUEST = (
    "id string, id_users string, id_matches string, id_match_stand_price string,"
    " id_transaction string, price decimal(10,2), quantity int, requested_at timestamp_ntz"
)
START = dt.datetime(2024, 1, 1)


def tables(make_tables, capacity, sold=0, stored=()):
    return make_tables(
        users=[{"id": "u", "name": "Ana", "email": "a"}],
        teams=TEAMS,
        soccer_stands=[stand("n", "Norte", capacity), stand("s", "Sur", 7)],
        matches=[match("m"), match("m2")],
        match_stand_prices=[price("m", "n"), price("m", "s"), price("m2", "n")],
        tickets=[
            ticket(f"t{i}", "m", "n", state=["vendido", "anulado", "usado"][i % 3])
            for i in range(sold)
        ]
        + [ticket(f"c{i}", "m2", ticket_code=code) for i, code in enumerate(stored)],
    )


def requests(spark, listed):
    """(quantity, stand key or None, ...) in order of arrival."""
    made = []
    for i, (quantity, stand_key, *more) in enumerate(listed):
        fields = {
            "id": f"r{i:05d}",
            "id_users": "u",
            "id_matches": "m",
            "id_match_stand_price": f"m-{stand_key}" if stand_key else None,
            "id_transaction": "x",
            "price": 1,
            "quantity": quantity,
            "requested_at": START + dt.timedelta(seconds=i),
            **(more[0] if more else {}),
        }
        made.append(tuple(fields.values()))
    loose = REQUEST.replace("decimal(10,2)", "int")
    df = spark.createDataFrame(made, loose)
    return df.withColumn("price", df.price.cast("decimal(10,2)"))


def decided(result):
    return {
        r["id"]: (r["accepted"], r["reason"], r["places_left"]) for r in rows(result.decisions)
    }


def brute(listed, free):
    """Requests in order, one by one."""
    left, expected = dict(free), {}
    for i, (quantity, stand_key, *_) in enumerate(listed):
        key = f"r{i:05d}"
        if stand_key is None:
            expected[key] = (True, None, None)
        elif quantity <= left[stand_key]:
            left[stand_key] -= quantity
            expected[key] = (True, None, None)
        else:
            expected[key] = (False, "not enough places", left[stand_key])
    return expected


def test_a_smaller_request_passes_after_a_refused_one(spark, make_tables):
    t = tables(make_tables, capacity=10, sold=4)
    result = admission.admit_purchases(t, requests(spark, [(3, "n"), (9, "n"), (2, "n"), (2, "n")]))
    assert decided(result) == {
        "r00000": (True, None, None),
        "r00001": (False, "not enough places", 3),
        "r00002": (True, None, None),
        "r00003": (False, "not enough places", 1),
    }
    issued = rows(result.tickets)
    assert len(issued) == 5
    assert {r["state"] for r in issued} == {"vendido"}
    assert all(1 <= r["row"] <= 30 and 1 <= r["seat"] <= 50 for r in issued)
    assert all(len(r["ticket_code"]) == 8 for r in issued)
    assert len({r["ticket_code"] for r in issued}) == 5


def test_reasons(spark, make_tables):
    t = tables(make_tables, capacity=10)
    listed = [
        (0, "n"),
        (11, "n"),
        (1, "n", {"id_matches": "nowhere"}),
        (1, "n", {"id_users": "nobody"}),
        (1, "n", {"id_match_stand_price": "nothing"}),
        (1, "n", {"price": None}),
        (10, None),
        (1, "n", {"id_match_stand_price": ""}),
    ]
    got = decided(admission.admit_purchases(t, requests(spark, listed)))
    assert [got[f"r{i:05d}"][1] for i in range(8)] == [
        "missing field",
        "quantity not from 1 to 10",
        "match not found",
        "user not found",
        "stand price not found",
        "missing field",
        None,
        None,
    ]


def test_an_oversold_stand_takes_nothing(spark, make_tables):
    t = tables(make_tables, capacity=3, sold=5)
    got = decided(admission.admit_purchases(t, requests(spark, [(1, "n")])))
    assert got == {"r00000": (False, "not enough places", -2)}


@pytest.mark.parametrize("seed,capacity", [(1, 0), (2, 5), (3, 9), (4, 23), (5, 400), (6, 100000)])
def test_against_one_by_one(spark, make_tables, seed, capacity):
    """Most requests go to one stand, as on the day a final goes on sale."""
    draw = random.Random(seed)
    listed = [
        (draw.choice([1, 1, 2, 3, 5, 7, 8, 9, 10]), draw.choice(["n"] * 6 + ["s", None]))
        for _ in range(1500)
    ]
    t = tables(make_tables, capacity=capacity, sold=2)
    result = admission.admit_purchases(t, requests(spark, listed))
    expected = brute(listed, {"n": capacity - 2, "s": 7})
    got = decided(result)
    assert got == expected
    issued = defaultdict(int)
    for r in rows(result.tickets):
        issued[r["id_match_stand_price"]] += 1
    assert issued["m-n"] <= max(capacity - 2, 0) and issued["m-s"] <= 7
    total = sum(q for i, (q, *_) in enumerate(listed) if expected[f"r{i:05d}"][0])
    assert sum(issued.values()) == total


def code(request, n, attempt, length):
    import hashlib

    length += max(0, attempt - admission.SHORT_DRAWS)
    return hashlib.md5(f"{request}:{n}:code{attempt}".encode()).hexdigest()[:length].upper()


@pytest.mark.parametrize("length,count", [(1, 12), (2, 60), (3, 100)])
def test_codes_clash(spark, make_tables, monkeypatch, length, count):
    """With short codes many clash: they are drawn again until none does, and nobody is refused."""
    monkeypatch.setattr(admission, "CODE_LENGTH", length)
    draw = random.Random(length)
    listed = [(draw.randint(1, 3), draw.choice(["n", None])) for _ in range(count)]
    stored = [code("r00000", 1, 0, length), code("r00001", 1, 1, length), "FFFFFFFFFF"]
    result = admission.admit_purchases(
        tables(make_tables, count, stored=stored), requests(spark, listed)
    )
    assert decided(result) == brute(listed, {"n": count})
    granted = {k for k, v in brute(listed, {"n": count}).items() if v[0]}
    final = {}
    pending = [
        (f"r{i:05d}", n)
        for i, (q, _) in enumerate(listed)
        for n in range(1, q + 1)
        if f"r{i:05d}" in granted
    ]
    attempt = 0
    while pending:
        drawn = {k: code(*k, attempt, length) for k in pending}
        times = defaultdict(int)
        for c in drawn.values():
            times[c] += 1
        used = {*stored, *final.values()}
        pending = [k for k, c in drawn.items() if times[c] > 1 or c in used]
        final |= {k: c for k, c in drawn.items() if k not in set(pending)}
        attempt += 1
    assert attempt > 1 and len(set(final.values())) == len(final)
    issued = sorted((r["id_request"], r["ticket_code"]) for r in rows(result.tickets))
    assert issued == sorted((k[0], c) for k, c in final.items())


def test_running_again_gives_the_same_tickets(spark, make_tables):
    t = tables(make_tables, capacity=50)
    asked = requests(spark, [(3, "n"), (2, "s"), (4, None)])
    first = sorted(map(str, rows(admission.admit_purchases(t, asked).tickets)))
    assert first == sorted(map(str, rows(admission.admit_purchases(t, asked).tickets)))
