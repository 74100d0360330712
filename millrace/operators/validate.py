"""Parsing and checking of payloads. Types are told apart as JSON has them, so a number in quotes is no number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAME = r"^[A-Za-z0-9._-]{1,64}$"


def _part(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _kind(v: Column, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(_part(v, path)), F.lit("ABSENT"))


def _is_text(v: Column, path: str) -> Column:
    return _kind(v, path) == "STRING"


def _is_number(v: Column, path: str) -> Column:
    return _kind(v, path).rlike(r"^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$")


def parse_event(raw: Column) -> Column:
    """``ok`` or ``poison``: an event has text in eventId, type and orderId, none of it empty, and an object in data."""
    v = F.try_parse_json(raw)
    good = F.lit(True)
    for path in ("$.eventId", "$.type", "$.orderId"):
        good = good & _is_text(v, path) & (F.coalesce(F.try_variant_get(v, path, "string"), F.lit("")) != "")
    good = good & F.startswith(_kind(v, "$.data"), F.lit("OBJECT"))
    return F.when(F.coalesce(good, F.lit(False)), "ok").otherwise("poison")


def placed_quantity(data: Column) -> Column:
    """The whole quantity, 1 to 2147483647, of an order's data; null if the quantity or the amount is not as it must be."""
    v = F.try_parse_json(data)
    q = F.try_variant_get(v, "$.quantity", "double")
    good = _is_number(v, "$.quantity") & _is_number(v, "$.amount") & (q == F.floor(q)) & (q >= 1) & (q <= 2147483647)
    return F.when(F.coalesce(good, F.lit(False)), q.cast("int"))


def order_request_error(i: Column, amount: Column, sku: Column, quantity: Column) -> Column:
    """What is wrong with a request, null if nothing is: amount over 0, sku of 1 to 64 code points, quantity 1 to 1e6, a plain id."""
    return (
        F.when(i.isNotNull() & ~i.rlike(NAME), "id")
        .when(amount.isNull() | ~(amount > 0), "amount")
        .when(sku.isNull() | ~F.char_length(sku).between(1, 64), "sku")
        .when(~F.coalesce(quantity, F.lit(1)).between(1, 1_000_000), "quantity")
    )


def chat_code(payload: Column, limit: int = 4096) -> Column:
    """The close code of a chat payload: 1009 too long, 1003 not a JSON object with a text, null if good."""
    v = F.try_parse_json(payload)
    text = F.try_variant_get(v, "$.text", "string")
    good = _is_text(v, "$.text") & (text != "")
    return F.when(F.octet_length(payload) > limit, F.lit(1009)).when(~F.coalesce(good, F.lit(False)), F.lit(1003))
