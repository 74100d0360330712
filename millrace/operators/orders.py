"""Order processing: outbox, reservations, payments, states, and step-by-step sagas with compensation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .folds import ordered_fold, reservations


def payment_status(amount: Column, limit: float) -> Column:
    return F.when(amount > limit, "failed").otherwise("charged")


def settle(orders: DataFrame, stock: DataFrame, limit: float) -> DataFrame:
    """``order_id, sku, quantity, amount`` with ``payment, reservation, stock_left``, orders of a sku in order of their ids.

    A sku that is not in ``stock`` has none. The release of a failed payment comes before the sku's next order.
    """
    rows = orders.join(stock, "sku", "left").withColumn("payment", payment_status(F.col("amount"), limit))
    rows = rows.withColumn("_fails", F.col("payment") == "failed").withColumn("_stock", F.coalesce(F.col("stock").cast("bigint"), F.lit(0).cast("bigint"))).drop("stock")
    out = ordered_fold(rows, ["sku"], ["order_id"], ["_stock", "quantity", "_fails"], reservations(), "reservation string, stock_left bigint")
    return out.drop("_fails", "_stock")


def final_status(reservation: Column, payment: Column) -> Column:
    return F.when((reservation == "reserved") & (payment == "charged"), "paid").otherwise("cancelled")


def status_trail(reservation: Column, payment: Column, payment_first: bool = True) -> Column:
    """The states that an order goes through, as an array. Which service comes first decides what a short order shows."""
    paid = payment == "charged"
    rejected = reservation == "rejected"
    middle = F.when(paid, F.lit("paid")).otherwise(F.lit("payment_failed"))
    full = F.when(~rejected & paid, F.array(F.lit("placed"), F.lit("paid"))).otherwise(F.array(F.lit("placed"), middle, F.lit("cancelled")))
    if payment_first:
        return full
    return F.when(rejected, F.array(F.lit("placed"), F.lit("cancelled"))).otherwise(full)


def order_events(reservation: Column, payment: Column) -> Column:
    """The events of an order, as an array."""
    stock = F.when(reservation == "rejected", F.array(F.lit("StockRejected"))).otherwise(F.array(F.lit("StockReserved")))
    money = F.when(payment == "charged", F.array(F.lit("PaymentCompleted"))).otherwise(F.array(F.lit("PaymentFailed")))
    back = F.when(reservation == "released", F.array(F.lit("StockReleased"))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(F.lit("OrderPlaced")), stock, money, back)


def saga(steps: Column) -> Column:
    """Runs ``array<struct<name, run_fails, compensate_fails>>``: steps in order up to the first that fails, then back.

    A struct of ``status`` (completed, compensated, compensation_failed), ``ran``, ``compensated`` in the order of compensation and
    ``failed_compensations``. A failing compensation doesn't stop the others.
    """
    at = F.array_position(F.transform(steps, lambda s: s["run_fails"]), True)
    failed = at > 0
    done = F.when(failed, F.slice(steps, 1, F.greatest(at.cast("int") - 1, F.lit(0)))).otherwise(steps)
    back = F.when(failed, F.reverse(done)).otherwise(F.slice(steps, 1, 0))
    bad = F.filter(back, lambda s: s["compensate_fails"])
    status = F.when(~failed, "completed").when(F.size(bad) > 0, "compensation_failed").otherwise("compensated")
    return F.struct(
        status.alias("status"),
        F.transform(done, lambda s: s["name"]).alias("ran"),
        F.transform(F.filter(back, lambda s: ~s["compensate_fails"]), lambda s: s["name"]).alias("compensated"),
        F.transform(bad, lambda s: s["name"]).alias("failed_compensations"),
    )


def batches(pending: DataFrame, order: str, size: int, shift: int = 0) -> DataFrame:
    """Numbers an outbox's rows in batches of ``size``, from a gapless rank column ``order`` that begins at 1."""
    return pending.withColumn("batch_no", F.floor((F.col(order) - 1 + shift) / size).cast("bigint"))


def relay_interleaving(rank: Column, blocked: int) -> Column:
    """When each row is published if one relay holds the first ``blocked`` rows locked and another goes on with the rest meanwhile."""
    return F.when(rank <= blocked, F.lit(1)).otherwise(F.lit(0))
