"""Operator 13: shards of near-equal bytes, by a k-d tree over metadata."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import scan
from .common import partitions, release, stored

#: Metadata that span the space, in order of preference among equally wide ones.
DIMENSIONS = ("source", "lang", "n_chars")
#: Shards of the contract.
SHARDS = 16
#: Bits of a coordinate, of the hash of a document, of the hash of a row; a histogram looks at LEVEL of them.
COORD, NAME, ROW, LEVEL = 24, 24, 12, 12
KEY = COORD + NAME + ROW
#: Rows whose slots are numbered in one task.
BLOCK = 2048


def number(column: Column, kind: str) -> Column:
    """A value as a double that keeps the order of values; null where it is null or not finite.

    Strings go by their first six bytes; beyond these the hash of the document decides.
    """
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean") or kind.startswith("decimal"):
        x = column.cast("double")
    elif kind in ("date", "timestamp"):
        x = column.cast("timestamp").cast("double")
    elif kind == "timestamp_ntz":
        x = F.to_timestamp(column).cast("double")
    else:
        x = F.conv(F.rpad(F.hex(F.substring(F.encode(column.cast("string"), "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("double")
    return F.when(F.abs(x) < math.inf, x)


def _base(docs: DataFrame, dimensions: tuple[str, ...]) -> DataFrame:
    """A row per document: what a tree needs of it."""
    kinds = dict(docs.dtypes)
    raw = docs.select([number(docs[d], kinds[d]).alias(f"x{j}") for j, d in enumerate(dimensions)])
    ends = raw.agg(*[f(f"x{j}").alias(f"{f.__name__}{j}") for j in range(len(dimensions)) for f in (F.min, F.max)]).first()

    def coordinate(j: int) -> Column:
        low, high = ends[f"min{j}"], ends[f"max{j}"]
        if low is None:
            return F.lit(0).cast("long")
        x = F.floor((F.col(f"x{j}") - F.lit(low)) / F.lit(high - low) * F.lit(float((1 << COORD) - 2))) + 1 if high > low else F.when(F.col(f"x{j}").isNotNull(), 1)
        return F.coalesce(x.cast("long"), F.lit(0).cast("long"))

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), *[number(docs[d], kinds[d]).alias(f"x{j}") for j, d in enumerate(dimensions)],
    )
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("text_crc32").cast("string"))
    tie = F.shiftleft(F.conv(F.substring(F.md5(name), 1, NAME // 4), 16, 10).cast("long"), ROW) + F.pmod(F.xxhash64("uid"), F.lit(1 << ROW))
    return stored(rows.select("uid", "doc_id", "size", "text_crc32", tie.alias("tie"), *[coordinate(j).alias(f"c{j}") for j in range(len(dimensions))]), "shard-rows")


def _cuts(rows: DataFrame, n_dims: int) -> DataFrame:
    """(at, at_leaves, dim, left, cut) of each node that is split.

    The dimension is the widest of the node.  Its rows are ordered by coordinate, then by
    hashes of document and row; the cut is their median by bytes, or what share of
    them the leaves on the left have, found by histograms of ever fewer rows.
    """
    fields = [x for j in range(n_dims) for x in (F.min(f"c{j}").alias(f"min{j}"), F.max(f"c{j}").alias(f"max{j}"))]
    nodes = rows.where("leaves > 1").groupBy("shard", "leaves").agg(F.sum("size").alias("total"), *fields)
    width = [F.col(f"max{j}") - F.col(f"min{j}") for j in range(n_dims)]
    widest = F.greatest(*width, F.lit(0))
    dim = F.coalesce(*[F.when(w == widest, j) for j, w in enumerate(width)])
    left = F.floor(F.col("leaves") / 2).cast("int")
    state = stored(
        nodes.select(F.col("shard").alias("at"), F.col("leaves").alias("at_leaves"), dim.alias("dim"), left.alias("left"), (F.col("total") * left / F.col("leaves")).alias("want"), F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below")),
        "shard-cuts",
    )
    keyed = rows.where("leaves > 1").select("shard", "size", "tie", *[f"c{j}" for j in range(n_dims)])
    for shift in range(KEY - LEVEL, -1, -LEVEL):
        joined = keyed.join(state, keyed["shard"] == state["at"]).withColumn("key", _key(n_dims))
        joined = joined.where(F.shiftright("key", shift + LEVEL) == F.col("prefix"))
        hist = joined.groupBy("at", "at_leaves", "dim", "left", "want", "below", F.shiftright("key", shift).alias("bucket")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
        order = W.partitionBy("at").orderBy("bucket")
        hist = hist.withColumn("after", F.col("below") + F.sum("bytes").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))).where("after > want")
        hist = hist.withColumn("nth", F.row_number().over(order)).where("nth = 1")
        old, state = state, stored(hist.select("at", "at_leaves", "dim", "left", "want", F.col("bucket").alias("prefix"), (F.col("after") - F.col("bytes")).alias("below"), "bytes", "n"), "shard-cuts")
        release(old)
        if (state.agg(F.max("n")).first()[0] or 1) == 1:  # each cut is next to one row
            break
    fits = F.col("below") + F.col("bytes") / 2 <= F.col("want")
    cut = F.shiftleft(F.col("prefix") + F.when(fits, 1).otherwise(0), shift) - 1  # the last key of the bucket, or the last before it
    return stored(state.select("at", "dim", "left", cut.alias("cut")), "shard-cuts")


def _key(n_dims: int) -> Column:
    coordinate = F.element_at(F.array(*[f"c{j}" for j in range(n_dims)]), F.col("dim") + 1)
    return F.shiftleft(coordinate, NAME + ROW) + F.col("tie")


def _slots(rows: DataFrame, leaves: int) -> DataFrame:
    """Adds ``slot``: the place in the shard by the document's hash, gapless from 0.

    Blocks of a shard, by leading bits of the hash, are numbered each; where repeated rows
    make a block large, bits of the rows' own hashes split it too.
    """
    n = rows.count()
    bits = min(NAME, max(0, math.ceil(math.log2(max(1, n / leaves / BLOCK)))))
    bucket = F.shiftright("tie", NAME + ROW - bits)
    most = rows.groupBy("shard", bucket.alias("b")).count().agg(F.max("count")).first()[0] or 0
    more = min(ROW, max(0, math.ceil(math.log2(max(1, most / BLOCK / 4)))))
    row = F.shiftright(F.col("tie").bitwiseAND(F.lit((1 << ROW) - 1)), ROW - more)
    blocks = rows.withColumn("block", F.shiftleft(bucket, more) + row)
    sizes = scan.before(blocks.groupBy("shard", "block").agg(F.count("*").alias("n")), ["shard"], "block", ["n"], 1 << bits + more)
    sizes = sizes.select(F.col("shard").alias("of_shard"), F.col("block").alias("of_block"), F.col("before_n").alias("moved"))
    order = W.partitionBy("shard", "block").orderBy("tie", "text_crc32", "doc_id", "uid")
    blocks = blocks.withColumn("nth", F.row_number().over(order) - 1)
    out = blocks.join(sizes, (blocks["shard"] == sizes["of_shard"]) & (blocks["block"] == sizes["of_block"]))
    return out.withColumn("slot", (F.col("nth") + F.col("moved")).cast("long"))


def shards(docs: DataFrame, leaves: int | None = None, target_bytes: int | None = None, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """Deal documents to shards of near-equal bytes.

    ``docs`` has doc_id, text and the dimensions; either the number of shards is given or the
    bytes that one may hold.  A node of the tree is split across its widest dimension at the
    median of its bytes until each leaf has its share.  The tree's state is tables; rows
    are moved only to number them.

    Returns doc_id, size (UTF-8 bytes and 1), text_crc32, shard and slot (gapless from 0 in
    each shard), a row for each row.  Null texts are empty; nulls and values that are not
    finite come before all others of a dimension; equal rows may be split; a document is never
    split, so a shard may miss its share by a document for each level of the tree; an
    empty table gives an empty one.  Equal texts are not kept together: a third of
    all rows may have one text.
    """
    rows = _base(docs, dimensions)
    if leaves is None:
        total = rows.agg(F.sum("size")).first()[0] or 0
        leaves = max(1, -(-total // (target_bytes or 1 << 29)))
    k = len(dimensions)
    rows = rows.withColumns({"shard": F.lit(0), "leaves": F.lit(leaves)})
    for level in range((leaves - 1).bit_length()):
        cuts = _cuts(rows, k)
        joined = rows.join(cuts, rows["shard"] == cuts["at"], "left")
        right = F.col("cut").isNotNull() & (_key(k) > F.col("cut"))
        inside = F.when(F.col("cut").isNull(), F.col("leaves")).when(right, F.col("leaves") - F.col("left")).otherwise(F.col("left"))
        old, rows = rows, stored(joined.select("uid", "doc_id", "size", "text_crc32", "tie", *[f"c{j}" for j in range(k)], F.when(right, F.col("shard") + F.col("left")).otherwise(F.col("shard")).cast("int").alias("shard"), inside.cast("int").alias("leaves")), "shard-rows")
        release(*([old] if level else []), cuts)
    return _slots(rows, leaves).select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), "slot")


def contract(docs: DataFrame) -> DataFrame:
    """:func:`shards` with the columns of the contract: the law is near-equal bytes."""
    out = shards(docs, SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write(docs: DataFrame, path: str, target_bytes: int, dimensions: tuple[str, ...] = DIMENSIONS) -> None:
    """Write whole documents as Parquet, a folder ``shard=N`` for each shard, in order of slots.

    Documents are staged under a number each, which the tree carries as their id.
    """
    names = docs.columns
    staged = stored(docs.toDF(*[f"d{i}" for i in range(len(names))]).withColumn("doc_id", F.monotonically_increasing_id()), "shard-docs")
    of = {n: F.col(f"d{i}") for i, n in enumerate(names)}
    found = shards(staged.select("doc_id", of["text"].alias("text"), *[of[d].alias(d) for d in dimensions if d != "text"]), None, target_bytes, dimensions)
    out = staged.join(found.select("doc_id", F.col("shard").alias("out_shard"), F.col("slot").alias("out_slot")), "doc_id")
    out = out.repartitionByRange(partitions(docs.sparkSession), "out_shard", "out_slot").sortWithinPartitions("out_shard", "out_slot")
    clash = {"shard", "slot"} & {n.lower() for n in names}
    out.select(*[of[n].alias(f"doc_{n}" if n.lower() in clash else n) for n in names], F.col("out_slot").alias("slot"), F.col("out_shard").alias("shard")).write.partitionBy("shard").parquet(path)
    release(staged)
