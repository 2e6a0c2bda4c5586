"""What every detector does to its transactions first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlattice.functions.columns import micros, number, require, without_labels

ENTITIES = ("sender_entity_id", "receiver_entity_id", "entity_id")


def prepare(tx: DataFrame, what: str, row_references: bool = False) -> DataFrame:
    """ord, timestamp, t (microseconds), sender, receiver, paid, received, ref and the entity columns (null if absent).

    Label columns never pass.  Rows without time, sender or receiver go.  A row without a reference of its own gets
    row-<ord> or time|sender|receiver.
    """
    tx = without_labels(tx)
    require(tx, {"timestamp", "sender_account", "receiver_account"}, what)
    ts = F.col("timestamp").try_cast("timestamp_ntz")
    sender, receiver = F.trim(F.col("sender_account").cast("string")), F.trim(F.col("receiver_account").cast("string"))
    order = F.col("ord") if "ord" in tx.columns else F.monotonically_increasing_id()
    if "transaction_reference" in tx.columns:
        ref = F.col("transaction_reference").cast("string")
    elif row_references:
        ref = F.concat(F.lit("row-"), order.cast("string"))
    else:
        ref = F.concat_ws("|", F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), sender, receiver)
    entities = [(F.col(c).cast("string") if c in tx.columns else F.lit(None).cast("string")).alias(c) for c in ENTITIES]
    out = tx.select(order.alias("ord"), ts.alias("timestamp"), micros(ts).alias("t"), sender.alias("sender"), receiver.alias("receiver"), number(tx, "amount_paid").alias("paid"), number(tx, "amount_received").alias("received"), ref.alias("ref"), *entities)
    return out.where(F.col("t").isNotNull() & F.col("sender").isNotNull() & F.col("receiver").isNotNull())
