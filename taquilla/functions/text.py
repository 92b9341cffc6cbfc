"""Spanish text columns: dates, hours, weekdays, seats, scores, match names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------------
MONTHS = (
    "enero",
    "febrero",
    "marzo",
    "abril",
    "mayo",
    "junio",
    "julio",
    "agosto",
    "septiembre",
    "octubre",
    "noviembre",
    "diciembre",
)
WEEKDAYS_FROM_SUNDAY = ("Dom", "Lun", "Mar", "Mié", "Jue", "Vie", "Sáb")
NO_DATE = "Fecha no disponible"
BAD_DATE = "Fecha inválida"
NO_HOUR = "Hora no disponible"
BAD_HOUR = "Hora inválida"
NO_STAND = "Sin especificar"
# ----------------------------------------------------------------------------------------


def _pick(words: tuple[str, ...], position: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), position)


def month_name(day: Column) -> Column:
    return _pick(MONTHS, F.month(day))


def weekday_name(day: Column) -> Column:
    return _pick(WEEKDAYS_FROM_SUNDAY, F.dayofweek(day))


def padded_date(day: Column) -> Column:
    """``07 de enero de 2024``; the parts of a NULL date are empty."""
    empty = F.lit("")
    return F.concat(
        F.coalesce(F.date_format(day, "dd"), empty),
        F.lit(" de "),
        F.coalesce(month_name(day), empty),
        F.lit(" de "),
        F.coalesce(F.date_format(day, "yyyy"), empty),
    )


def long_date(day: Column) -> Column:
    """``7 de enero del 2024`` from a date or ISO text, with texts for missing and bad input."""
    written = day.cast("string")
    parsed = F.to_date(F.try_to_timestamp(written, F.lit("yyyy-MM-dd")))
    return (
        F.when(written.isNull() | (written == ""), NO_DATE)
        .when(parsed.isNull(), BAD_DATE)
        .otherwise(
            F.concat(
                F.dayofmonth(parsed).cast("string"),
                F.lit(" de "),
                month_name(parsed),
                F.lit(" del "),
                F.year(parsed).cast("string"),
            )
        )
    )


def half_day_hour(hour: Column) -> Column:
    """``19:05:00`` as ``7:05 pm``, with texts for missing and bad input."""
    parts = F.split(hour, ":")
    hours = F.regexp_extract(F.get(parts, F.lit(0)), r"^\s*(\d+)", 1).try_cast("int")
    on_dial = F.when(hours % 12 == 0, 12).otherwise(hours % 12)
    # a longer minute part stays whole; lpad alone would cut it
    minute_part = F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
    minutes = F.when(F.length(minute_part) < 2, F.lpad(minute_part, 2, "0")).otherwise(minute_part)
    return (
        F.when(hour.isNull() | (hour == ""), NO_HOUR)
        .when(hours.isNull(), BAD_HOUR)
        .otherwise(
            F.concat(
                on_dial.cast("string"),
                F.lit(":"),
                minutes,
                F.when(hours >= 12, " pm").otherwise(" am"),
            )
        )
    )


def purchase_date_text(moment: Column) -> Column:
    """``7 de enero de 2024``; NULL stays NULL."""
    return F.concat(
        F.dayofmonth(moment).cast("string"),
        F.lit(" de "),
        month_name(moment),
        F.lit(" de "),
        F.year(moment).cast("string"),
    )


def purchase_moment_text(moment: Column) -> Column:
    """``7 de enero de 2024, 19:05``; NULL stays NULL."""
    return F.concat(purchase_date_text(moment), F.lit(", "), F.date_format(moment, "HH:mm"))


def seat_text(row: Column, seat: Column) -> Column:
    """``Fila 3 - Asiento 14``; NULL where either number is missing or 0."""
    return F.when(
        (row != 0) & (seat != 0),
        F.concat(F.lit("Fila "), row.cast("string"), F.lit(" - Asiento "), seat.cast("string")),
    )


def score_text(local: Column, visitor: Column) -> Column:
    return F.concat(local.cast("string"), F.lit(" - "), visitor.cast("string"))


def versus(local: Column, visitor: Column) -> Column:
    """``Local vs Visitor``; a missing name counts as empty."""
    return F.concat(F.coalesce(local, F.lit("")), F.lit(" vs "), F.coalesce(visitor, F.lit("")))


def match_half(minute: Column) -> Column:
    return F.when(minute <= 45, "first_half").otherwise("second_half")


def day_month_year(value: Column) -> Column:
    """A date column from text: day/month/year or ISO; anything else gives NULL."""
    written = value.cast("string")
    return F.when(
        written.contains("/"), F.to_date(F.try_to_timestamp(written, F.lit("d/M/yyyy")))
    ).otherwise(written.try_cast("date"))
