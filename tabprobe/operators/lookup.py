"""Values of many columns looked up in one table of ``(col, value)`` entries.

Ordinal codes and target statistics replace the values of every categorical
column.  All columns' entries form one table with one text key per entry (the
column's name and the value, NULL marked), kept within a byte budget:

* entries within ``budget_bytes`` (counted), the most frequent first, are
  broadcast once; every column's join reads that same broadcast.  Hot values are
  frequent, so they are always among them: a value, or NULL, in a third of all
  rows is never shuffled;
* the rest is needed only by rows with a rare or unknown value.  These values
  are taken out as ``(row, key)`` and meet the remaining entries in one shuffle
  by key, for all columns together; a second one brings them back to their rows.

So a frame of any number of columns takes no shuffle where the entries fit the
budget, else two, and no entry passes through the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: bytes of keys and payload that are broadcast
BUDGET_BYTES = 32 << 20
#: values looked for that are met one by one, if the broadcast entries lack them
OFTEN = 100
#: bytes counted for an entry beside its key
ENTRY_BYTES = 48
_MARK = "\x1f"


#: longer values are keyed by their hash, so that an entry has a bounded size
LONG_VALUE = 64


def entry_key(col: str | Column, value: Column, *more: Column) -> Column:
    """Text key of a value of a column; ``more`` are further key parts (a fold)."""
    parts = [p.cast("string") for p in more]
    v = value.cast("string")
    text = F.when(v.isNull(), F.lit("n")).when(F.length(v) <= LONG_VALUE, F.concat(F.lit("v"), v)) \
        .otherwise(F.concat(F.lit("h"), F.sha2(v, 256)))
    return F.concat_ws(_MARK, col if isinstance(col, Column) else F.lit(col), *parts, text)


@dataclass
class Lookup:
    """Entries ``key, cnt, payload`` split by frequency: ``hot`` is broadcast,
    ``cold`` (None: no entry) is joined by shuffle."""
    hot: DataFrame
    cold: DataFrame | None
    payload: list[str]

    def apply(self, df: DataFrame, keys: dict[str, Column], use) -> DataFrame:
        """``df`` without the columns that ``keys`` names, and with the columns
        ``use(name, entry)`` for each of them; ``entry`` is the struct of the key's
        payload, or NULL if there is no such entry."""
        found = df
        if self.cold is not None:
            row = "__lookup_row"
            found = df.withColumn(row, F.monotonically_increasing_id()).checkpoint()
        before = found.columns
        for i, (name, key) in enumerate(keys.items()):
            entry = self.hot.select(F.col("key").alias(f"__key{i}"),
                                    F.struct(*self.payload).alias(f"__entry{i}"))
            found = found.join(F.broadcast(entry), key == F.col(f"__key{i}"), "left")
        entries = {name: F.col(f"__entry{i}") for i, name in enumerate(keys)}
        if self.cold is not None:
            found, entries = self._rare(found, before, keys, row)
        return found.select(*[c for c in df.columns if c not in keys],
                            *[out for name, e in entries.items() for out in use(name, e)])

    def _rare(self, found: DataFrame, before: list[str], keys: dict[str, Column], row: str):
        """Entries of the values that the broadcast ones don't hold."""
        spark = found.sparkSession
        missing = F.filter(F.array(*[
            F.when(F.col(f"__key{i}").isNull() & key.isNotNull(), F.struct(F.lit(i).alias("i"), key.alias("key")))
            for i, key in enumerate(keys.values())]), lambda m: m.isNotNull())
        asked = found.select(row, F.explode(missing).alias("m")).select(row, "m.i", "m.key")
        entry = F.struct(*self.payload)
        kind = self.cold.select(entry.alias("e")).schema["e"].dataType
        # a value that was rare or unknown when fitted may be frequent here
        often = [r["item"] for r in asked.agg(F.expr(f"approx_top_k(key, {OFTEN}, {100 * OFTEN})").alias("t"))
                 .select(F.explode("t").alias("t")).select("t.*").collect()]
        often = F.broadcast(spark.createDataFrame([(k,) for k in often], "key string"))
        known = F.broadcast(often.join(self.cold, "key", "left").select("key", entry.alias("e"), F.lit(True).alias("o")))
        asked = asked.join(known, "key", "left")
        seldom = asked.where("o IS NULL").select(row, "i", "key", F.lit(None).cast(kind).alias("e"))
        both = seldom.unionByName(self.cold.select(
            F.lit(None).cast("long").alias(row), F.lit(None).cast("int").alias("i"), "key", entry.alias("e")))
        # one entry a key, and no key here is frequent: the windows are small
        met = both.withColumn("e", F.max("e").over(Window.partitionBy("key"))).select(row, "i", "e") \
            .unionByName(asked.where("o").select(row, "i", "e")) \
            .where(F.col(row).isNotNull() & F.col("e").isNotNull())
        hits = [f"__entry{i}" for i in range(len(keys))]
        rows = found.select(row, F.struct(*before, *hits).alias("r"), F.lit(None).cast("int").alias("i"),
                            F.lit(None).cast(kind).alias("e"))
        back = rows.unionByName(met.select(row, F.lit(None).cast(rows.schema["r"].dataType).alias("r"), "i", "e")) \
            .groupBy(row).agg(F.first("r", ignorenulls=True).alias("r"),
                              F.collect_list(F.when(F.col("e").isNotNull(), F.struct("i", "e"))).alias("es"))
        late = F.map_from_entries("es")
        return back.select("r.*", late.alias("__late")), {
            n: F.coalesce(F.col(h), F.col("__late")[F.lit(i)]) for i, (n, h) in enumerate(zip(keys, hits))}


def build(entries: DataFrame, payload: list[str], budget_bytes: int = BUDGET_BYTES) -> Lookup:
    """``entries`` (checkpointed or otherwise cheap to read): one row per ``key`` with
    ``cnt``, its frequency, and the payload."""
    size = F.length("key") + ENTRY_BYTES + 8 * len(payload)
    # bytes by order of magnitude of the frequency: at most 64 rows
    level = F.floor(F.log2(F.greatest(F.col("cnt"), F.lit(1)).cast("double"))).cast("int")
    bytes_of = {r[0]: r[1] for r in entries.groupBy(level.alias("level")).agg(F.sum(size)).collect()}
    spent, least = 0, None
    for lv in sorted(bytes_of, reverse=True):
        spent += bytes_of[lv]
        if spent > budget_bytes:
            break
        least = lv
    table = entries.select("key", *payload)
    if spent <= budget_bytes:
        return Lookup(table, None, payload)
    if least is None:
        return Lookup(table.limit(0), table, payload)
    return Lookup(table.where(level >= least), table.where(level < least), payload)
