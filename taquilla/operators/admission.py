"""Admission of purchase requests against the free places of a stand.

Requests for one (match, price row) are served in order of ``requested_at`` and id. A
request is accepted if its quantity does not exceed the places left at its turn; a later,
smaller one may still fit after a larger one was refused.

The order matters within a group, and a group may hold a large share of all requests, so it
is never brought together. Three facts about quantities from 1 to 10 make that possible:

1. Places only shrink. Of the requests for ``q`` places only the first ``free // q`` can
   ever be accepted. The others are refused, however many they are. The first of each kind
   are found by a rank within salted parts of the group and then a rank over what is left.
2. As long as nobody was refused, places left are ``free`` minus a running sum. The first
   refusal happens with at most 9 places left.
3. From there on at most 9 more requests are accepted. By fact 1 they are among the first
   ``left // q`` of each kind, 23 requests at most, which a short fold goes through.

A group is then described by at most ten steps (who brought the places left to 9 or less,
and to what), and each request is decided on its own against those steps.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taquilla.operators.checks import MOST_TICKETS_PER_REQUEST
from taquilla.plans.dimensions import priced_stands
from taquilla.plans.sizing import (
    lookup_side,
    marked,
    measured_side,
    written_and_measured,
)
from taquilla.session import cut_lineage
from taquilla.sources.schemas import SOLD
from taquilla.sources.tables import Tables

SALTS = 32
GROUP = ["id_matches", "id_match_stand_price"]
ROWS_IN_STAND = 30
SEATS_IN_ROW = 50
CODE_LENGTH = 8
SHORT_DRAWS = 4  # draws after the first that keep this length


@dataclass(frozen=True)
class Admission:
    """``decisions``: one row per request. ``tickets``: the rows to append to tickets."""

    decisions: DataFrame
    tickets: DataFrame


def _missing(column: Column) -> Column:
    return column.isNull() | (column.cast("string") == "")


def check_requests(t: Tables, requests: DataFrame) -> DataFrame:
    """Requests with the reason they are refused for, if any, and the places still free.

    ``free`` is NULL where no stand is asked for; such a request is not checked against
    places.
    """
    matches = t.matches.select(F.col("id").alias("known_match"))
    users = t.users.select(F.col("id").alias("known_user"))
    prices = priced_stands(t).select(F.col("id_price").alias("known_price"), "capacity")
    taken = (
        t.tickets.filter(F.col("id_match_stand_price").isNotNull())
        .groupBy(
            F.col("id_matches").alias("taken_match"),
            F.col("id_match_stand_price").alias("taken_price"),
        )
        .agg(F.count("*").alias("taken"))
    )
    has_stand = ~_missing(F.col("id_match_stand_price"))
    # requests without a stand, or without a user, share one NULL key; they are spread over
    # buckets instead, and all others are in bucket 0
    spread = F.pmod(F.xxhash64("id"), F.lit(1024))
    bucket = F.when(has_stand, 0).otherwise(spread)
    user_bucket = F.when(F.col("id_users").isNotNull(), 0).otherwise(spread)

    def zero(column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(1))

    users = users.withColumn("known_user_bucket", zero("known_user"))
    prices = prices.withColumn("known_bucket", zero("known_price"))
    spread_taken = taken.withColumn("taken_bucket", zero("taken_price"))
    known = (
        requests.withColumns({"bucket": bucket, "user_bucket": user_bucket})
        .join(lookup_side(matches), F.col("id_matches") == F.col("known_match"), "left")
        .join(
            users,
            (F.col("id_users") == F.col("known_user"))
            & (F.col("user_bucket") == F.col("known_user_bucket")),
            "left",
        )
        .join(
            lookup_side(prices),
            (F.col("id_match_stand_price") == F.col("known_price"))
            & (F.col("bucket") == F.col("known_bucket")),
            "left",
        )
        .join(
            spread_taken,
            (F.col("id_matches") == F.col("taken_match"))
            & (F.col("id_match_stand_price") == F.col("taken_price"))
            & (F.col("bucket") == F.col("taken_bucket")),
            "left",
        )
    )
    quantity = F.col("quantity")
    incomplete = (
        _missing(F.col("id_users"))
        | _missing(F.col("id_matches"))
        | F.col("price").isNull()
        | quantity.isNull()
        | (quantity == 0)
    )
    reason = (
        F.when(incomplete, "missing field")
        .when(~quantity.between(1, MOST_TICKETS_PER_REQUEST), "quantity not from 1 to 10")
        .when(F.col("known_match").isNull(), "match not found")
        .when(F.col("known_user").isNull(), "user not found")
        .when(has_stand & F.col("known_price").isNull(), "stand price not found")
    )
    free = F.when(has_stand, F.col("capacity") - F.coalesce("taken", F.lit(0)))
    return known.select(*requests.columns, reason.alias("reason"), free.alias("free"))


def _in_turn() -> list[str]:
    return ["requested_at", "id"]


def _most(places: str) -> Column:
    """How many requests of this quantity the places can take."""
    return F.floor(F.col(places) / F.col("quantity"))


def _candidates(contested: DataFrame) -> DataFrame:
    """Per group and quantity the first ``free // quantity`` requests."""
    salted = contested.filter(F.col("quantity") <= F.col("free")).withColumn(
        "salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))
    )
    in_part = Window.partitionBy(*GROUP, "quantity", "salt").orderBy(*_in_turn())
    in_group = Window.partitionBy(*GROUP, "quantity").orderBy(*_in_turn())
    return (
        salted.withColumn("rank", F.row_number().over(in_part))
        .filter(F.col("rank") <= _most("free"))
        .withColumn("rank", F.row_number().over(in_group))
        .filter(F.col("rank") <= _most("free"))
        .drop("rank", "salt")
    )


def _steps(contested: DataFrame) -> DataFrame:
    """(group, steps): who brought the places left to 9 or less, and to what."""
    candidates = _candidates(
        contested.select(*GROUP, "id", "requested_at", "quantity", "free")
    )
    # the candidates of a group are limited by its places; all below is one pass over them
    turn = Window.partitionBy(*GROUP).orderBy(*_in_turn())
    whole = Window.partitionBy(*GROUP)
    of_kind = Window.partitionBy(*GROUP, "quantity", "early").orderBy(*_in_turn())
    placed = (
        candidates.withColumn(
            "total", F.sum("quantity").over(turn.rowsBetween(Window.unboundedPreceding, 0))
        )
        .withColumn("early", F.col("total") <= F.col("free"))
        .withColumn("used", F.max(F.when(F.col("early"), F.col("total"))).over(whole))
        .withColumn("left", F.col("free") - F.coalesce("used", F.lit(0)))
        .withColumn("rank", F.row_number().over(of_kind))
    )
    # until the first refusal the running sum tells the places left; later few can still fit
    last_early = F.col("early") & (F.col("free") - F.col("total") < 10)
    may_fit = (
        ~F.col("early")
        & (F.col("quantity") <= F.col("left"))
        & (F.col("rank") <= _most("left"))
    )
    step = F.struct("requested_at", "id", (F.col("free") - F.col("total")).alias("left"))
    grouped = (
        placed.filter(last_early | may_fit)
        .groupBy(*GROUP)
        .agg(
            F.collect_list(F.when(F.col("early"), step)).alias("steps"),
            F.sort_array(
                F.collect_list(
                    F.when(~F.col("early"), F.struct("requested_at", "id", "quantity"))
                )
            ).alias("waiting"),
            F.max("left").alias("left"),
        )
    )
    steps_type = grouped.schema["steps"].dataType.simpleString()
    start = F.struct(F.col("left"), F.array().cast(steps_type).alias("steps"))

    def serve(state: Column, request: Column) -> Column:
        after = state["left"] - request["quantity"]
        taken = F.struct(
            request["requested_at"].alias("requested_at"),
            request["id"].alias("id"),
            after.alias("left"),
        )
        served = F.struct(
            after.alias("left"), F.concat(state["steps"], F.array(taken)).alias("steps")
        )
        return F.when(request["quantity"] <= state["left"], served).otherwise(state)

    later = F.aggregate("waiting", start, serve, lambda state: state["steps"])
    return grouped.select(*GROUP, F.concat("steps", later).alias("steps"))


def decide(checked: DataFrame) -> DataFrame:
    """Checked requests with ``accepted``, ``reason`` and ``places_left``."""
    in_order = F.col("reason").isNull()
    has_stand = F.col("free").isNotNull()
    contested = checked.filter(in_order & has_stand)
    others = checked.filter(~(in_order & has_stand)).select(
        *checked.columns,
        in_order.alias("accepted"),
        F.lit(None).cast("bigint").alias("places_left"),
    )
    # written, so that beyond a broadcast the requests of a hot stand can be split over tasks
    with_steps = contested.join(measured_side(_steps(contested)), GROUP, "left")
    before = F.filter(
        "steps",
        lambda s: F.struct(s["requested_at"], s["id"]) < F.struct("requested_at", "id"),
    )
    left = F.coalesce(
        F.array_min(F.transform(before, lambda s: s["left"])), F.col("free")
    ).cast("bigint")
    fits = F.col("quantity") <= left
    decided = with_steps.select(
        *[c for c in checked.columns if c != "reason"],
        F.when(~fits, "not enough places").alias("reason"),
        fits.alias("accepted"),
        F.when(~fits, left).alias("places_left"),
    )
    return others.unionByName(decided)


def _digest(purpose: str) -> Column:
    """32 hex digits that depend only on the request and the ticket's number in it."""
    return F.md5(F.concat_ws(":", F.col("id").cast("string"), F.col("n").cast("string"), F.lit(purpose)))


def _number(digest: Column, start: int, most: int) -> Column:
    """A number from 1 to ``most`` out of four hex digits of a digest."""
    return (1 + F.conv(F.substring(digest, start, 4), 16, 10).cast("int") % most).cast("int")


def _code(attempt: int) -> Column:
    """The code of a draw; late draws are longer, so that there are always free codes."""
    length = min(CODE_LENGTH + max(0, attempt - SHORT_DRAWS), 32)
    return F.upper(F.substring(_digest(f"code{attempt}"), 1, length))


def _drawable(tickets: DataFrame) -> DataFrame:
    """The codes in use that could be drawn: shorter ones or those of other characters cannot."""
    return tickets.select(F.col("ticket_code").alias("code")).filter(
        F.col("code").rlike(f"^[0-9A-F]{{{CODE_LENGTH},}}$")
    )


def _tickets(drawn: DataFrame, redrawn: Column) -> DataFrame:
    seat = _digest("seat")
    return drawn.select(
        F.col("id").alias("id_request"),
        _digest("ticket").alias("id"),
        "id_users",
        "id_matches",
        F.when(
            ~_missing(F.col("id_match_stand_price")), F.col("id_match_stand_price")
        ).alias("id_match_stand_price"),
        F.coalesce(redrawn, _code(0)).alias("ticket_code"),
        "price",
        _number(seat, 1, ROWS_IN_STAND).alias("row"),
        _number(seat, 5, SEATS_IN_ROW).alias("seat"),
        "id_transaction",
        F.lit(SOLD).alias("state"),
        F.col("requested_at").alias("purchased_at"),
    )


def _issue(t: Tables, accepted: DataFrame) -> DataFrame:
    """Tickets of accepted requests.

    Codes are digests, so a task that runs again issues the same ones. A code that is in use
    already, or drawn twice, is drawn again until none clashes: every accepted request gets
    its tickets. Clashes are few, so all draws after the first work on small tables.
    """
    drawn = accepted.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("quantity"))))
    stored = _drawable(t.tickets)

    def shared(codes: DataFrame, known: DataFrame) -> DataFrame:
        return known.join(codes.select("code"), "code", "left_semi").select("code")

    draws = [measured_side(drawn.select("id", "n", _code(0).alias("code")))]
    while True:
        last = draws[-1]
        counts = last.groupBy("code").agg(F.count("*").alias("times"))
        clashing = counts.filter(F.col("times") > 1).select("code").unionByName(shared(last, stored))
        for earlier, later in zip(draws, draws[1:], strict=False):
            kept = earlier.join(last.select("code"), "code", "left_semi").join(
                later.select("id", "n"), ["id", "n"], "left_anti"
            )
            clashing = clashing.unionByName(kept.select("code"))
        again, clashes, size = written_and_measured(
            last.join(clashing.distinct(), "code", "left_semi").select(
                "id", "n", _code(len(draws)).alias("code")
            )
        )
        if not clashes:
            break
        draws.append(marked(again, size))
    if len(draws) == 1:
        return _tickets(drawn, F.lit(None).cast("string"))
    numbered = [d.withColumn("draw", F.lit(i)) for i, d in enumerate(draws[1:])]
    final = (
        reduce(DataFrame.unionByName, numbered)
        .groupBy("id", "n")
        .agg(F.max_by("code", "draw").alias("redrawn"))
    )
    return _tickets(drawn.join(final, ["id", "n"], "left"), F.col("redrawn"))


def admit_purchases(t: Tables, requests: DataFrame) -> Admission:
    """Decide requests (id, id_users, id_matches, id_match_stand_price, id_transaction,
    price, quantity, requested_at) and issue the tickets of the accepted ones.

    Checked and decided requests are written out once each, as several branches go on from
    them.
    """
    checked = cut_lineage(check_requests(t, requests))
    decided = cut_lineage(decide(checked))
    decisions = decided.select(
        "id",
        "id_users",
        "id_matches",
        "id_match_stand_price",
        "quantity",
        "accepted",
        "reason",
        "places_left",
    )
    return Admission(decisions, _issue(t, decided.filter("accepted")))
