"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``CELLS`` cells. Virtual nodes sit on cells; a row belongs to the first node at or after its
cell. Rows enter in ring order; a row whose shard is full goes on clockwise to the next node whose shard has room. As
rows enter in ring order, each node takes a run of consecutive ring ranks, so the whole placement is a list
of cuts in the ring order. The cuts are folded from the counts per cell, a table of fixed size; rows are then
placed by their cell and rank. Only DataFrame expressions are used.

Capacities are the row counts that differ by at most one, so the law ``rows`` holds for any data; a shard more or less
moves the rows near the cuts and those of the shard's own arcs.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from driftgauge.functions.hashing import hash60
from driftgauge.llm.storage import stored
from driftgauge.llm.text import whole

CELLS = 1 << 13
VIRTUAL_NODES = 64
EXTRA = 16  # fixed value: bytes counted for a row besides its text


def ring_cell(position: Column) -> Column:
    """The cell of a 60-bit position."""
    return F.shiftright(position, 60 - (CELLS.bit_length() - 1)).cast("int")


def cell_owners(spark, shards: int) -> DataFrame:
    """(cell, node cell, shard) for every cell: the first virtual node clockwise. Two nodes on a cell: the lower shard."""
    nodes = spark.range(shards * VIRTUAL_NODES).select(
        F.expr(f"cast(id div {VIRTUAL_NODES} as int)").alias("shard"), ring_cell(hash60(F.lit("node"), F.col("id"))).alias("cell")
    )
    nodes = nodes.groupBy("cell").agg(F.min("shard").alias("shard"))
    cells = spark.range(CELLS).select(F.col("id").cast("int").alias("cell")).join(nodes, "cell", "left")
    # fixed number of rows, whatever the data
    onward = W.Window.orderBy("cell").rowsBetween(0, W.Window.unboundedFollowing)
    everywhere = W.Window.orderBy("cell").rowsBetween(W.Window.unboundedPreceding, W.Window.unboundedFollowing)
    return cells.select(
        "cell", F.coalesce(F.first("shard", ignorenulls=True).over(onward), F.first("shard", ignorenulls=True).over(everywhere)).alias("shard")
    )


def ring_cuts(cells: Column, total: Column, shards: int) -> Column:
    """Cuts (first, last, shard, slot of the first) of the ring order from the ordered array ``cells(shard, n)``.

    Two laps: what the first lap carries past the last cell goes on from the start. Runs of rows that arrive earlier are
    placed first, so cuts come in ring order.
    """
    room = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.expr(f"total div {shards}") + F.when(s < total % shards, 1).otherwise(0))
    start = F.struct(
        room.alias("room"), F.lit(0).cast("bigint").alias("waiting"), F.lit(0).cast("bigint").alias("done"),
        F.array().cast("array<struct<first:bigint,last:bigint,shard:int,slot:bigint>>").alias("cuts"),
    )

    def step(acc: Column, cell: Column) -> Column:
        left = F.get(acc["room"], cell["shard"])
        ready = acc["waiting"] + cell["n"]
        taken = F.least(left, ready)
        size = F.expr(f"total div {shards}") + F.when(cell["shard"] < total % shards, 1).otherwise(0)
        cut = F.struct(acc["done"].alias("first"), (acc["done"] + taken).alias("last"), cell["shard"].alias("shard"), (size - left).alias("slot"))
        return F.struct(
            F.when(taken > 0, F.transform(acc["room"], lambda r, s: F.when(s == cell["shard"], r - taken).otherwise(r))).otherwise(acc["room"]).alias("room"),
            (ready - taken).alias("waiting"),
            (acc["done"] + taken).alias("done"),
            F.when(taken > 0, F.concat(acc["cuts"], F.array(cut))).otherwise(acc["cuts"]).alias("cuts"),
        )

    again = F.transform(cells, lambda c: F.struct(c["shard"].alias("shard"), F.lit(0).cast("bigint").alias("n")))
    return F.aggregate(F.concat(cells, again), start, step)["cuts"]


def assign_shards(documents: DataFrame, shards: int = 40) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``documents(doc_id, text)``.

    Size is the UTF-8 bytes of the text plus 16; null text has no bytes. The position on the ring comes from the doc_id, of a
    null doc_id from the checksum of its text. Equal positions (repeated rows, equal ids) are ordered by id,
    checksum and size; repeated rows are interchangeable, each gets a slot of its own. Slots of a shard run
    from 0 without gaps. An empty table gives no rows. Other columns are not read.
    """
    text = whole(F.col("text"))
    rows = documents.select(
        F.col("doc_id"), (F.octet_length(text) + EXTRA).cast("bigint").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32")
    )
    rows = rows.withColumn("position", hash60(F.lit("row"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("crc"), "text_crc32"))))
    rows = stored(rows.withColumn("cell", ring_cell(F.col("position"))), "ring-rows")
    counts = rows.groupBy("cell").agg(F.count("*").alias("n"))
    ring = cell_owners(documents.sparkSession, shards).join(counts, "cell", "left").select("cell", "shard", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    upto = W.Window.orderBy("cell").rowsBetween(W.Window.unboundedPreceding, -1)
    ring = stored(ring.withColumn("start", F.coalesce(F.sum("n").over(upto), F.lit(0)).cast("bigint")), "ring-cells")
    # runs of one owner are one step of the fold
    change = F.when(F.lag("shard").over(W.Window.orderBy("cell")).eqNullSafe(F.col("shard")), 0).otherwise(1)
    arcs = ring.withColumn("change", change).withColumn("arc", F.sum("change").over(W.Window.orderBy("cell")))
    arcs = arcs.groupBy("arc", "shard").agg(F.sum("n").alias("n"))
    folded = arcs.agg(
        F.sum("n").alias("total"), F.transform(F.array_sort(F.collect_list(F.struct("arc", "shard", "n"))), lambda a: F.struct(a["shard"].alias("shard"), a["n"].alias("n"))).alias("arcs")
    ).select("total", "arcs")
    cuts = stored(folded.select(F.explode(ring_cuts(F.col("arcs"), F.col("total"), shards)).alias("c")).select("c.*"), "ring-cuts")
    # pieces of each cell: the cuts that meet its ranks; both tables have a fixed bound
    overlap = F.broadcast(cuts).alias("x")
    pieces = ring.where("n > 0").join(overlap, (F.col("first") < F.col("start") + F.col("n")) & (F.col("last") > F.col("start")))
    pieces = pieces.groupBy("cell", "start").agg(F.array_sort(F.collect_list(F.struct("last", "first", F.col("x.shard").alias("shard"), "slot"))).alias("pieces"))
    rank = F.row_number().over(W.Window.partitionBy("cell").orderBy("position", "doc_id", "text_crc32", "size"))
    ranked = rows.withColumn("in_cell", rank - 1).join(F.broadcast(pieces), "cell").withColumn("rank", F.col("start") + F.col("in_cell"))
    placed = ranked.withColumn("piece", F.get(F.filter("pieces", lambda p: p["last"] > F.col("rank")), F.lit(0)))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("piece.shard").alias("shard"),
        (F.col("piece.slot") + F.col("rank") - F.col("piece.first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
