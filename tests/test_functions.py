from __future__ import annotations

import datetime as dt
from decimal import Decimal

from conftest import at, day
from pyspark.sql import functions as F

from taquilla.functions import numeric, text


def evaluate(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_padded_date(spark):
    assert evaluate(spark, text.padded_date(F.lit(day("2024-01-07")))) == "07 de enero de 2024"
    assert evaluate(spark, text.padded_date(F.lit(day("2001-12-31")))) == "31 de diciembre de 2001"


def test_long_date(spark):
    assert evaluate(spark, text.long_date(F.lit(day("2024-01-07")))) == "7 de enero del 2024"
    assert evaluate(spark, text.long_date(F.lit("2024-09-30"))) == "30 de septiembre del 2024"
    assert evaluate(spark, text.long_date(F.lit(None).cast("date"))) == "Fecha no disponible"
    assert evaluate(spark, text.long_date(F.lit("2024-13-01"))) == "Fecha inválida"


def test_half_day_hour(spark):
    cases = {
        "19:05:00": "7:05 pm",
        "00:05:00": "12:05 am",
        "12:00:00": "12:00 pm",
        "09:5": "9:05 am",
        "xx": "Hora inválida",
        "": "Hora no disponible",
        None: "Hora no disponible",
    }
    for hour, expected in cases.items():
        assert evaluate(spark, text.half_day_hour(F.lit(hour).cast("string"))) == expected


def test_weekday_from_sunday(spark):
    got = [evaluate(spark, text.weekday_name(F.lit(dt.date(2024, 1, 7 + i)))) for i in range(7)]
    assert got == ["Dom", "Lun", "Mar", "Mié", "Jue", "Vie", "Sáb"]


def test_purchase_texts(spark):
    moment = F.lit(at("2024-03-09T07:05:00")).cast("timestamp_ntz")
    assert evaluate(spark, text.purchase_date_text(moment)) == "9 de marzo de 2024"
    assert evaluate(spark, text.purchase_moment_text(moment)) == "9 de marzo de 2024, 07:05"
    nothing = F.lit(None).cast("timestamp_ntz")
    assert evaluate(spark, text.purchase_moment_text(nothing)) is None


def test_seat_text_needs_both_numbers(spark):
    def seat(row, number):
        return evaluate(spark, text.seat_text(F.lit(row).cast("int"), F.lit(number).cast("int")))

    assert seat(3, 14) == "Fila 3 - Asiento 14"
    assert seat(0, 14) is None
    assert seat(3, 0) is None
    assert seat(None, 14) is None


def test_versus_counts_null_as_empty(spark):
    assert evaluate(spark, text.versus(F.lit("A"), F.lit(None).cast("string"))) == "A vs "


def test_day_month_year(spark):
    cases = {
        "7/1/2024": day("2024-01-07"),
        "07/01/2024": day("2024-01-07"),
        "2024-01-07": day("2024-01-07"),
        "2024/01/17": None,
        "nonsense": None,
        None: None,
    }
    for written, expected in cases.items():
        assert evaluate(spark, text.day_month_year(F.lit(written).cast("string"))) == expected


def test_percentage_rounds_half_away_and_guards_zero(spark):
    def share(part, whole, digits=2):
        return evaluate(spark, numeric.percentage(F.lit(part), F.lit(whole), digits))

    assert share(1, 16, 1) == Decimal("6.3")  # 6.25
    assert share(-1, 16, 1) == Decimal("-6.3")
    assert share(1, 3) == Decimal("33.33")
    assert share(5, 0) is None
    assert evaluate(spark, numeric.percentage_or_zero(F.lit(5), F.lit(0))) == Decimal("0.00")


def test_round_half_up(spark):
    def nearest(value):
        return evaluate(spark, numeric.round_half_up(F.lit(Decimal(value))))

    assert [nearest(v) for v in ("2.5", "2.4", "-2.5", "-2.6")] == [3, 2, -2, -3]


def test_money_text(spark):
    def money(value):
        return evaluate(spark, numeric.money_text(F.lit(Decimal(value))))

    assert money("80000") == "$\u00a080.000"
    assert money("112946.5") == "$\u00a0112.946,5"
    assert money("1234567.89") == "$\u00a01.234.567,89"
    assert money("-5.00") == "-$\u00a05"


def test_number_or_zero(spark):
    assert evaluate(spark, numeric.number_or_zero(F.lit("12.5"))) == 12.5
    assert evaluate(spark, numeric.number_or_zero(F.lit("abc"))) == 0.0
    assert evaluate(spark, numeric.number_or_zero(F.lit(None).cast("string"), "int")) == 0
