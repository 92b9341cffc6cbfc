"""Which stored codes are compared with drawn ones."""

from __future__ import annotations

from taquilla.operators import admission


def test_only_codes_that_can_be_drawn_are_looked_up(make_tables):
    codes = ["ABCDEF12", "0123456789AB", "ABC", "abcdef12", "1-1-2-3-2001-05-05", None]
    t = make_tables(tickets=[{"id": str(i), "ticket_code": c} for i, c in enumerate(codes)])
    assert {r["code"] for r in admission._drawable(t.tickets).collect()} == {"ABCDEF12", "0123456789AB"}
