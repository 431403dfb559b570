"""Sharding by histogram sort: shards of near-equal bytes, equal texts together.

The sort key of a document is a 64-bit hash of its text, so equal texts are neighbours and the keys of
different texts spread evenly. Splitters are found without sorting: each round counts the exact bytes
below every candidate boundary over the whole table and keeps, for each splitter, only the interval
between two candidates that holds its target, until that interval weighs less than the tolerance or
is a single key. The rows (a few numbers each) are then exchanged once, to ranges of the key within their
shard, and sorted there: the slots of a shard follow its keys.

Groups of equal texts that weigh more than 1/``HEAVY`` of a shard, at most ``HEAVY`` times the number
of shards, are placed first, largest to the emptiest shard, and stand after the other rows there; the splitters
share out the rest over the room that is left. Heavy groups are found by counting, too: only the cells of the key
that weigh as much are looked into. A group stays whole unless it alone is above a shard's share by more than
``tolerance``; then it is dealt over several shards in pieces of what each has room for. Rows of a heavy group are
ranked in hashed cells, with a salt for rows that share a doc_id, so that no task holds a group.

Defined results: a null text has size 8 and is the empty text otherwise, in whose shard it stands; a very long text
is hashed whole; ties (rows of equal text and doc_id) take slots in the order of the files that were read; repeated
rows are separate rows with slots of their own; a null doc_id is allowed; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.llm.store import written

SHARDS = 24
HEAVY = 64
#: How much one group may lift its shard above the fair share before the group is split.
TOLERANCE = 0.05
#: A splitter is settled when the interval that holds its target weighs less than this part of a shard.
SPLITTER_TOLERANCE = 0.0005
PROBE_BITS = 8
#: Upper bits of the key that name the cells in which heavy groups are looked for.
CELL_BITS = 16
#: Rows that one range within a shard, numbered by one task, holds on average.
RANGE_ROWS = 20_000


def find_splitters(keyed: DataFrame, targets: list[float], tolerance: float) -> list[int]:
    """For each target, a key with about that many bytes below it. ``keyed`` has (key, size).

    A round takes the next ``PROBE_BITS`` bits of the key: its candidates cut every open interval into
    2**PROBE_BITS. Only the candidates' counts reach the driver, that many for each splitter.
    """
    shift = 64 - PROBE_BITS
    # Of each splitter still open: its interval as a prefix of the key (None: all keys), bytes below it.
    open_: dict[int, tuple[int | None, float]] = {i: (None, 0.0) for i in range(len(targets))}
    done: dict[int, int] = {}
    while open_:
        prefixes = sorted({p for p, _ in open_.values() if p is not None})
        cells = keyed.select(F.shiftright("key", shift).alias("cell"), "size")
        if prefixes:
            cells = keyed.where(F.shiftright("key", shift + PROBE_BITS).isin(prefixes)).select(F.shiftright("key", shift).alias("cell"), "size")
        found = dict(cells.groupBy("cell").agg(F.sum("size")).collect())
        for i, (prefix, below) in list(open_.items()):
            low = -(1 << (PROBE_BITS - 1)) if prefix is None else prefix << PROBE_BITS
            for cell in range(low, low + (1 << PROBE_BITS)):
                here = float(found.get(cell, 0))
                if below + here >= targets[i]:
                    break
                below += here
            if here <= tolerance or shift == 0:
                nearer_low = targets[i] - below <= below + here - targets[i]
                done[i] = min(cell if nearer_low else cell + 1, (1 << (63 - shift)) - 1) << shift
                del open_[i]
            else:
                open_[i] = (cell, below)
        shift = max(0, shift - PROBE_BITS)
    return [done[i] for i in range(len(targets))]


def heavy_groups(rows: DataFrame, least: float) -> list[tuple[int, int, int]]:
    """(key, bytes, rows) of all keys above ``least`` bytes. As many cells as fit into the table at that weight, and
    no more keys, reach the driver."""
    cell = F.shiftright("key", 64 - CELL_BITS).cast("int")
    cells = [r["cell"] for r in rows.groupBy(cell.alias("cell")).agg(F.sum("size").alias("bytes")).where(F.col("bytes") > least).collect()]
    if not cells:
        return []
    found = rows.where(cell.isin(cells)).groupBy("key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    return [(r["key"], r["bytes"], r["rows"]) for r in found.where(F.col("bytes") > least).collect()]


def range_of(splitters: list[int], ranges: int) -> Column:
    """Which of ``ranges`` equal parts of its shard's interval a key falls in; it never falls as the key rises."""
    edge = [-(2.0**63), *map(float, splitters), 2.0**63]
    shard, key = F.col("shard"), F.col("key").cast("double")
    low, high = (F.element_at(F.array(*map(F.lit, e)), shard + 1) for e in (edge[:-1], edge[1:]))
    return F.least(F.lit(ranges - 1), F.greatest(F.lit(0), F.floor((key - low) / F.greatest(high - low, F.lit(1.0)) * ranges))).cast("int")


def shard_of(splitters: list[int]) -> Column:
    """The number of splitters that are <= key, by binary search written out as nested conditions."""

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("key") < F.lit(splitters[mid]), search(lo, mid)).otherwise(search(mid + 1, hi))

    return search(0, len(splitters))


def deal_heavy(groups: list[tuple[int, int, int]], shards: int, mean: float, tolerance: float):
    """Shards of heavy groups (key, bytes, rows): [(key, shard, from row, to row)], and the room left in each shard."""
    room, pieces = [mean] * shards, []
    for key, size, rows in sorted(groups, key=lambda g: (-g[1], g[0])):
        begin, each = 0, size / rows
        while begin < rows:
            to = max(range(shards), key=lambda s: (room[s], -s))
            n = rows - begin
            if n * each > mean * (1 + tolerance):
                n = min(n, max(1, int(room[to] / each)))
            pieces.append((key, to, begin, begin + n))
            room[to] -= n * each
            begin += n
    return pieces, [max(0.0, r) for r in room]


def assign_shards(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row."""
    spark = docs.sparkSession
    text = F.col("text")
    rows = written(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(8)).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            F.xxhash64(F.coalesce(text, F.lit("")), F.lit(7)).alias("key"),
            F.monotonically_increasing_id().alias("salt"),  # written, so it stays as it is
        ),
        "shard-keys",
    )
    total, n_rows = rows.agg(F.sum("size"), F.count(F.lit(1))).first()
    mean = (total or 0) / shards
    heavy = heavy_groups(rows, mean / HEAVY)
    pieces, room = deal_heavy(heavy, shards, mean, tolerance)
    schema = "h_key long, h_shard int, h_from long, h_to long"
    dealt = spark.createDataFrame(pieces, schema)
    whole = dealt.groupBy("h_key").agg(F.count(F.lit(1)).alias("h_n"), F.min("h_shard").alias("h_shard"))
    marked = rows.join(F.broadcast(whole), F.col("key") == F.col("h_key"), "left")
    light = marked.where("h_key is null").select("key", "size")
    left, targets = sum(room), []
    light_total = (total or 0) - sum(b for _, b, _ in heavy)
    for r in room[:-1]:
        targets.append((targets[-1] if targets else 0.0) + (light_total * r / left if left else 0.0))
    splitters = sorted(find_splitters(light, targets, mean * SPLITTER_TOLERANCE)) if light_total else [0] * (shards - 1)
    ranges = max(1, -(-(n_rows or 0) // (shards * RANGE_ROWS)))
    # Heavy rows stand in hashed ranges after those of the key.
    hashed = (F.lit(ranges) + F.pmod(F.xxhash64("doc_id", F.pmod("salt", F.lit(64))), F.lit(ranges * 64))).cast("int")
    columns = ["doc_id", "size", "text_crc32", "key", "salt", "shard"]
    placed = marked.where("h_key is null").withColumn("shard", shard_of(splitters)).select(*columns, range_of(splitters, ranges).alias("part"))
    placed = placed.unionByName(marked.where("h_n = 1").withColumn("shard", F.col("h_shard")).select(*columns, hashed.alias("part")))
    if any(n > 1 for n in _counts(pieces).values()):
        placed = placed.unionByName(_split_groups(marked.where("h_n > 1"), dealt, ranges).select(*columns, hashed.alias("part")))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n")).select(
        "shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead")
    )
    inside = Window.partitionBy("shard", "part").orderBy("key", "doc_id", "salt")
    return placed.join(starts, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.row_number().over(inside) - 1 + F.col("ahead")).alias("slot")
    )


def _counts(pieces: list[tuple]) -> dict[int, int]:
    out: dict[int, int] = {}
    for key, *_ in pieces:
        out[key] = out.get(key, 0) + 1
    return out


def _split_groups(rows: DataFrame, dealt: DataFrame, ranges: int) -> DataFrame:
    """Rows of groups too large for one shard, by their rank within the group: counts per hashed cell plus
    a rank inside each."""
    cell = F.pmod(F.xxhash64("doc_id", F.pmod("salt", F.lit(64)), F.lit(3)), F.lit(ranges * 64)).cast("int")
    celled = rows.withColumn("cell", cell)
    before = Window.partitionBy("key").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    ahead = celled.groupBy("key", "cell").agg(F.count(F.lit(1)).alias("n")).select(
        "key", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead")
    )
    inside = Window.partitionBy("key", "cell").orderBy("doc_id", "salt")
    ranked = celled.join(ahead, ["key", "cell"]).withColumn(
        "at", F.row_number().over(inside) - 1 + F.col("ahead")
    )
    piece = dealt.select(F.col("h_key").alias("p_key"), F.col("h_shard").alias("p_shard"), "h_from", "h_to")
    return ranked.drop("h_key", "h_shard", "h_n").join(
        F.broadcast(piece), (F.col("key") == F.col("p_key")) & (F.col("at") >= F.col("h_from")) & (F.col("at") < F.col("h_to"))
    ).select("doc_id", "size", "text_crc32", "key", "salt", F.col("p_shard").alias("shard"))


def sharding_digest(docs: DataFrame) -> DataFrame:
    return assign_shards(docs.select("doc_id", "text")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
