"""The trie of conversation prefixes, built by halving depths.

A conversation is a sequence of turns, each named by 128 bits of its role and text. A window of 2**k turns is cut at half
its depth: the name of what lies above the cut, with the name of the prefix that leads to the window, names the cut prefix, the
forest key of the window below; both halves are cut again, all windows of a level at once. Above `LEAF` turns a level is a
join of narrow tables (conversation, window); windows of `LEAF` turns lie in one row and are cut there by the same step on
arrays, so that neither a long conversation nor a prefix that many share is ever gathered into one task.

Totals go the other way. Each node is carried by its smallest member, at its depth; a window's totals are those of its
halves, and the lower half's are grafted onto the turns above the cut. What a node's members carry from its depth on is then
the sum over its subtree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm import words as W
from codeloom.llm.arrow import mapped
from codeloom.llm.steps import forget, settled

LEAF_BITS = 6
HOT = 64
ROOT = (0, 0)
_OTHER = np.uint64(0xD6E8FEB86659FD93)
PIECE_ROWS = 1 << 13
MEASURES = ("leaves", "saved")


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, size (UTF-8 bytes of the text) and x, y (the turn's name) of every row with a conv_id."""
    role, text = (F.coalesce(F.col(n).cast("string"), F.lit("")) for n in ("role", "text"))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    half = lambda at: F.conv(F.substring(F.col("digest"), at, 16), 16, -10).cast("long")
    named = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.octet_length(text).cast("long").alias("size"), digest.alias("digest")
    )
    return named.select("conv_id", "turn", "size", half(1).alias("x"), half(17).alias("y"))


def _placed(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns with part and place in part, and (conv_id, part, before): the turns of conv_id in earlier parts.

    Parts are ranges of (conv_id, turn, name), so that a conversation of any length is numbered in several tasks.
    """
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("x"), F.col("y")]
    ranges = settled(turns.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    place = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order[1:]))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranges.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("held"))
    counts = counts.withColumn("before", F.coalesce(F.sum("held").over(earlier), F.lit(0)))
    return ranges.withColumn("place", place), counts


def heads(conv_id: Column) -> Column:
    """How many turns the conversation takes from the first of its five: 0 to 8, by the CRC of its id."""
    return F.crc32(conv_id.cast("string").cast("binary")) % 9


def rebuilt(conversations: DataFrame, grouped: int = 5) -> tuple[DataFrame, DataFrame]:
    """conv_id, at (from 0), x, y, size of every rebuilt turn, and conv_id, n (its turns) of every conversation.

    A conversation starts with the first `heads` original turns of the first conversation of its `grouped`, and goes on with
    its own turns after as many.
    """
    turns, counts = _placed(_turns(conversations))
    sizes = settled(counts.groupBy("conv_id").agg(F.sum("held").alias("own")))
    given = sizes.select(
        "conv_id", "own", heads(F.col("conv_id")).alias("head"), (F.col("conv_id") - F.col("conv_id") % grouped).alias("base")
    )
    first = sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    taken = F.least(F.col("head"), F.coalesce(F.col("base_own"), F.lit(0)))
    given = settled(given.join(first, "base", "left").select("conv_id", "base", "own", "head", taken.alias("taken")))
    starts = counts.join(given, "conv_id").select("conv_id", "part", "before", "head", "taken")
    numbered = settled(
        turns.join(starts, ["conv_id", "part"]).select(
            "conv_id", (F.col("before") + F.col("place") - 1).alias("at"), "x", "y", "size", "head", "taken"
        )
    )
    own = numbered.filter("at >= head").withColumn("at", F.col("at") - F.col("head") + F.col("taken"))
    most = numbered.filter("at < 8").select(F.col("conv_id").alias("base"), "at", "x", "y", "size")
    lent = given.filter("taken > 0").select("conv_id", "base", "taken").join(most, "base").filter("at < taken")
    sequence = own.select("conv_id", "at", "x", "y", "size").unionByName(lent.select("conv_id", "at", "x", "y", "size"))
    n = F.col("taken") + F.greatest(F.col("own") - F.col("head"), F.lit(0))
    return sequence, given.select("conv_id", n.alias("n"))


def _pair(left: tuple[Column, Column], right: tuple[Column, Column]) -> list[Column]:
    """The name of two names, one after the other."""
    return [F.xxhash64(F.lit(k), *left, *right) for k in (1, 2)]


def _starts(blocks: DataFrame, most: int) -> DataFrame:
    """conv_id, block, sx, sy: the name of the prefix in front of every block but the first of each conversation.

    blocks: conv_id, block, x, y (its name) of all full blocks; most: the greatest number of blocks in front of a turn or an
    end, plus one. A block that would start where its conversation ends has a row too.
    """
    levels = [blocks]
    while 1 << len(levels) < most:  # windows of twice the size: the names of both halves
        odd = F.col("block") % 2 == 1
        sides = [[F.max(F.when(side, F.col(n))).alias(f"{n}{k}") for n in ("x", "y")] for k, side in enumerate((~odd, odd))]
        both = levels[-1].groupBy("conv_id", F.shiftright("block", 1).alias("block")).agg(*sides[0], *sides[1])
        x, y = _pair((F.col("x0"), F.col("y0")), (F.col("x1"), F.col("y1")))
        both = both.filter("x0 IS NOT NULL AND x1 IS NOT NULL")
        levels.append(settled(both.select("conv_id", "block", x.alias("x"), y.alias("y"))))
    root = [F.lit(v).cast("long").alias(n) for n, v in zip(("block", "sx", "sy"), (0, *ROOT), strict=True)]
    found = blocks.select("conv_id").distinct().select("conv_id", *root)
    for level in reversed(levels):  # cut every window at half its depth: the prefix named at the cut leads to the lower half
        upper = found.withColumn("block", F.col("block") * 2)
        x, y = _pair((F.col("sx"), F.col("sy")), (F.col("x"), F.col("y")))
        lower = upper.join(level, ["conv_id", "block"])
        lower = lower.select("conv_id", (F.col("block") + 1).alias("block"), x.alias("sx"), y.alias("sy"))
        found = settled(upper.unionByName(lower))
    forget(*levels[1:])
    return found.filter("block > 0")


def _after(totals: DataFrame, most: int) -> DataFrame:
    """conv_id, block, after_leaves, after_saved: what a conversation carries behind each of its blocks.

    totals: conv_id, block, leaves, saved of every block of the conversations that have several, at most `most`.
    """
    levels = [totals]
    while 1 << len(levels) < most:
        up = levels[-1].groupBy("conv_id", F.shiftright("block", 1).alias("block"))
        levels.append(settled(up.agg(*[F.sum(n).alias(n) for n in MEASURES])))
    none = [F.lit(0).cast("long").alias(n) for n in ("window", *(f"after_{n}" for n in MEASURES))]
    rest = totals.select("conv_id").distinct().select("conv_id", *none)
    for level in reversed(levels):  # the lower half's totals are grafted onto the half above the cut
        lower = level.filter("block % 2 = 1")
        lower = lower.select("conv_id", (F.col("block") - 1).alias("block"), *[F.col(n).alias(f"low_{n}") for n in MEASURES])
        halves = level.select("conv_id", "block", F.shiftright("block", 1).alias("window"))
        halves = halves.join(rest, ["conv_id", "window"]).join(lower, ["conv_id", "block"], "left")
        grown = [(F.col(f"after_{n}") + F.coalesce(F.col(f"low_{n}"), F.lit(0))).alias(f"after_{n}") for n in MEASURES]
        rest = settled(halves.select("conv_id", F.col("block").alias("window"), *grown))
    forget(*levels[1:])
    return rest.withColumnRenamed("window", "block")


def _pairs(left: tuple, right: tuple) -> tuple[np.ndarray, np.ndarray]:
    return W.pair(left[0], right[0]), W.pair(left[1] ^ _OTHER, right[1])


def windows(x: np.ndarray, y: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The names of the windows of 1, 2, 4 ... turns in rows of 2**k turns, up to whole rows."""
    levels = [(x, y)]
    while levels[-1][0].shape[1] > 1:
        x, y = levels[-1]
        levels.append(_pairs((x[:, ::2], y[:, ::2]), (x[:, 1::2], y[:, 1::2])))
    return levels


def cut(x: np.ndarray, y: np.ndarray, start: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The names of the prefixes in front of each turn in rows of 2**k turns (x, y); start: those in front of the rows.

    All windows of a level are cut at once; the name at a cut leads to the window's lower half.
    """
    found = tuple(side[:, None] for side in start)
    for level in reversed(windows(x, y)[:-1]):
        lower = _pairs(found, tuple(side[:, ::2] for side in level))
        found = tuple(np.stack(sides, axis=2).reshape(len(x), -1) for sides in zip(found, lower, strict=True))
    return found


def graft(x: np.ndarray) -> np.ndarray:
    """The sums from each place of rows of 2**k places to their ends: a lower half's total goes onto the upper half."""
    out = x.copy()
    size = 1
    while size < x.shape[1]:
        halves = out.reshape(len(x), -1, 2, size)
        halves[:, :, 0] += halves[:, :, 1, :1]
        size *= 2
    return out


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The flat values of a list column without nulls, and each row's number of them."""
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def _matrix(flat: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    """A row for each list, filled up with zeros."""
    out = np.zeros((len(lengths), width), flat.dtype)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _column_of_lists(matrix: np.ndarray, lengths: np.ndarray) -> pa.Array:
    flat = matrix[np.arange(matrix.shape[1]) < lengths[:, None]]
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), flat.view(np.int64))


def _names_of(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x, lengths = _lists(batch.column("x"))
    y, _ = _lists(batch.column("y"))
    return _matrix(x.view(np.uint64), lengths, width), _matrix(y.view(np.uint64), lengths, width), lengths


def _block_names(leaf: int):
    def work(batch: pa.RecordBatch) -> dict:
        x, y, _ = _names_of(batch, leaf)
        top = windows(x, y)[-1]
        return {"conv_id": batch.column("conv_id"), "block": batch.column("block"), "x": top[0][:, 0].view(np.int64), "y": top[1][:, 0].view(np.int64)}

    return work


def _prefix_names(leaf: int):
    """Of every turn in a block: the name of the prefix that ends with it (x, y) and of the one in front of it (px, py)."""

    def work(batch: pa.RecordBatch) -> dict:
        lengths = _lists(batch.column("x"))[1]
        width = min(leaf, 1 << int(lengths.max(initial=1)).bit_length())
        x, y, _ = _names_of(batch, width)
        known = [batch.column(n).to_numpy(zero_copy_only=False).view(np.uint64) for n in ("sx", "sy", "ex", "ey")]
        before = cut(x, y, (known[0], known[1]))
        ends = [np.concatenate([b[:, 1:], e[:, None]], axis=1) for b, e in zip(before, known[2:], strict=True)]
        out = {n: _column_of_lists(m, lengths) for n, m in zip(("x", "y", "px", "py"), (*ends, *before), strict=True)}
        return {n: batch.column(n) for n in ("conv_id", "block", "size")} | out

    return work


def _grafted(leaf: int):
    """Of every turn in a block: what its conversation carries from it on."""

    def work(batch: pa.RecordBatch) -> dict:
        lengths = _lists(batch.column("x"))[1]
        width = 1 << max(0, int(lengths.max(initial=1)) - 1).bit_length()
        places, held = _lists(batch.column("places"))
        row = np.repeat(np.arange(len(held)), held)
        out = {}
        for n in MEASURES:
            own = np.zeros((len(lengths), width), np.int64)
            own[row, places] = _lists(batch.column(n))[0]
            after = batch.column(f"after_{n}").to_numpy(zero_copy_only=False)
            out[n] = _column_of_lists(graft(own) + after[:, None], lengths)
        return {"x": batch.column("x"), "y": batch.column("y")} | out

    return work


def _named(sequence: DataFrame, longest: int, leaf_bits: int) -> DataFrame:
    """conv_id, block, and lists over its turns: size, x, y (the prefix up to the turn), px, py (the prefix in front of it)."""
    leaf = 1 << leaf_bits
    held = F.sort_array(F.collect_list(F.struct("at", "x", "y", "size")))
    blocks = sequence.groupBy("conv_id", F.shiftright("at", leaf_bits).alias("block")).agg(held.alias("held"))
    blocks = blocks.select("conv_id", "block", *[F.col(f"held.{n}").alias(n) for n in ("x", "y", "size")])
    zero = F.lit(0).cast("long")
    if longest < leaf:  # no conversation fills a block: every prefix in front of a block is the root
        led = blocks.select("*", *[zero.alias(n) for n in ("sx", "sy", "ex", "ey")])
    else:
        blocks = settled(blocks)
        full = blocks.filter(F.size("x") == leaf).select("conv_id", "block", "x", "y")
        full = settled(mapped(full, _block_names(leaf), "conv_id long, block long, x long, y long"))
        starts = _starts(full, longest // leaf + 1)
        ends = starts.select("conv_id", (F.col("block") - 1).alias("block"), F.col("sx").alias("ex"), F.col("sy").alias("ey"))
        led = blocks.join(starts, ["conv_id", "block"], "left").join(ends, ["conv_id", "block"], "left")
        led = led.select("conv_id", "block", "x", "y", "size", *[F.coalesce(n, zero).alias(n) for n in ("sx", "sy", "ex", "ey")])
    longs = ", ".join(f"{n} array<long>" for n in ("size", "x", "y", "px", "py"))
    return settled(mapped(led, _prefix_names(leaf), f"conv_id long, block long, {longs}"))


def _with_parents(nodes: DataFrame) -> DataFrame:
    """nodes with parent_conv_id. A parent of more than a HOT-th of all nodes is one of at most HOT, which are broadcast."""
    total = nodes.count()
    of = nodes.filter("n_children > 0").select(
        F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("parent_conv_id"), "n_children"
    )
    hot = F.col("n_children") * HOT > total
    crowded, others = F.broadcast(of.filter(hot).drop("n_children")), of.filter(~hot).drop("n_children")
    first = nodes.join(crowded, ["px", "py"])
    rest = nodes.join(crowded, ["px", "py"], "left_anti").join(others, ["px", "py"], "left")
    return first.unionByName(rest)


def _totals(named: DataFrame, nodes: DataFrame, longest: int, leaf_bits: int) -> DataFrame:
    """x, y, n_leaves and saved_tokens of every node but the root, over its subtree."""
    leaf = 1 << leaf_bits
    place = F.col("depth") - 1
    carried = nodes.filter("depth > 0").select(
        "conv_id",
        F.shiftright(place, leaf_bits).alias("block"),
        place.bitwiseAND(F.lit(leaf - 1)).alias("at"),
        (F.col("n_children") == 0).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("size")).alias("saved"),
    )
    held = F.sort_array(F.collect_list(F.struct("at", *MEASURES)))
    sums = [F.sum(n).alias(f"all_{n}") for n in MEASURES]
    carried = carried.groupBy("conv_id", "block").agg(held.alias("held"), *sums)
    none = F.array().cast("array<long>")
    rows = named.select("conv_id", "block", "x", "y").join(carried, ["conv_id", "block"], "left")
    zero = F.lit(0).cast("long")
    if longest <= leaf:
        rows = rows.select("*", *[zero.alias(f"after_{n}") for n in MEASURES])
    else:
        rows = settled(rows)
        several = rows.filter("block > 0").select("conv_id").distinct()
        totals = rows.select("conv_id", "block", *[F.coalesce(f"all_{n}", zero).alias(n) for n in MEASURES])
        after = _after(settled(totals.join(several, "conv_id", "left_semi")), -(-longest // leaf))
        rows = rows.join(after, ["conv_id", "block"], "left")
        rows = rows.select("x", "y", "held", *[F.coalesce(f"after_{n}", zero).alias(f"after_{n}") for n in MEASURES])
    lists = [F.coalesce(F.col(f"held.{n}"), none).alias(m) for n, m in zip(("at", *MEASURES), ("places", *MEASURES), strict=True)]
    rows = rows.filter("held IS NOT NULL OR after_leaves > 0 OR after_saved > 0")
    rows = rows.select("x", "y", *lists, *[f"after_{n}" for n in MEASURES])
    longs = ", ".join(f"{n} array<long>" for n in ("x", "y", *MEASURES))
    parts = mapped(rows, _grafted(leaf), longs).select(F.inline(F.arrays_zip("x", "y", *MEASURES)))
    return parts.groupBy("x", "y").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (x, y, conv_id), sorted, as pieces (x, y, first, ids) of the ids of one node in this partition."""
    kind = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
    for batch in batches:
        for at in range(0, batch.num_rows, PIECE_ROWS):
            part = batch.slice(at, PIECE_ROWS)
            x, y, ids = (part.column(n).to_numpy() for n in ("x", "y", "conv_id"))
            opens = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
            texts = [",".join(map(str, own.tolist())) for own in np.split(ids, opens[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (x[opens], y[opens], ids[opens], texts)], schema=kind)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's ids from its pieces in order: a running hash, whatever their number."""
    kind = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("ends_sha256", pa.string())])
    key, running = None, None
    for batch in batches:
        done = []
        for x, y, ids in zip(*(batch.column(n).to_pylist() for n in ("x", "y", "ids")), strict=True):
            if (x, y) == key:
                running.update(b"," + ids.encode())
                continue
            if key is not None:
                done.append((*key, running.hexdigest()))
            key, running = (x, y), hashlib.sha256(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate(kind.types)], schema=kind)
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*key, running.hexdigest()), kind.types, strict=True)], schema=kind)


def _ends(named: DataFrame, sizes: DataFrame, leaf_bits: int) -> DataFrame:
    """x, y, ends_sha256 of the nodes where conversations end.

    Ids are sorted in ranges, so that the ids of one node are joined in many tasks; what one task hashes of a node is
    its pieces, one after the other.
    """
    last = named.select("conv_id", "block", F.element_at("x", -1).alias("x"), F.element_at("y", -1).alias("y"))
    tail = F.shiftright(F.col("n") - 1, leaf_bits)
    last = last.join(sizes.filter("n > 0").select("conv_id", tail.alias("block")), ["conv_id", "block"], "left_semi")
    bare = sizes.filter("n = 0").select("conv_id", *[F.lit(v).cast("long").alias(n) for n, v in zip("xy", ROOT, strict=True)])
    ends = last.select("conv_id", "x", "y").unionByName(bare)
    ends = ends.repartitionByRange("x", "y", "conv_id").sortWithinPartitions("x", "y", "conv_id").select("x", "y", "conv_id")
    pieces = ends.mapInArrow(_pieces, "x long, y long, first long, ids string")
    pieces = pieces.repartition("x", "y").sortWithinPartitions("x", "y", "first").select("x", "y", "ids")
    return pieces.mapInArrow(_hashed, "x long, y long, ends_sha256 string")


def trie(sequence: DataFrame, sizes: DataFrame, leaf_bits: int = LEAF_BITS) -> DataFrame:
    """The nodes of the trie of sequence (conv_id, at, x, y, size) and sizes (conv_id, n): one row each.

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256; see `prefix_trie`.
    """
    sizes = settled(sizes)
    longest = sizes.agg(F.max("n")).first()[0]
    named = _named(sequence, longest or 0, leaf_bits)
    each = named.select("conv_id", (F.col("block") * (1 << leaf_bits)).alias("from"), F.arrays_zip("x", "y", "px", "py", "size").alias("all"))
    each = each.select("conv_id", "from", F.posexplode("all").alias("place", "turn"))
    depth = (F.col("from") + F.col("place") + 1).alias("depth")
    each = each.select("conv_id", depth, *[F.col(f"turn.{n}").alias(n) for n in ("x", "y", "px", "py", "size")])
    least = [F.min(n).alias(n) for n in ("conv_id", "depth", "px", "py", "size")]
    nodes = each.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n_convs"), *least)
    root = sizes.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).filter("n_convs > 0")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    top = [F.lit(v).cast("long").alias(n) for n, v in zip("xy", ROOT, strict=True)]
    root = root.select(*top, "n_convs", "conv_id", zero.alias("depth"), none.alias("px"), none.alias("py"), zero.alias("size"))
    nodes = settled(nodes.unionByName(root))
    children = nodes.filter("depth > 0").groupBy(F.col("px").alias("x"), F.col("py").alias("y")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = settled(nodes.join(children, ["x", "y"], "left").withColumn("n_children", F.coalesce("n_children", zero)))
    below = _totals(named, nodes, longest or 0, leaf_bits)
    leaves = F.sum((F.col("n_children") == 0).cast("long")).alias("n_leaves")
    all_of = nodes.agg(leaves, F.sum((F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens")).filter("n_leaves > 0")
    below = below.unionByName(all_of.select(*top, "n_leaves", "saved_tokens"))
    out = _with_parents(nodes).join(below, ["x", "y"]).join(_ends(named, sizes, leaf_bits), ["x", "y"], "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame, leaf_bits: int = LEAF_BITS) -> DataFrame:
    """The prefix trie of the rebuilt conversations of a table (conv_id, turn, role, text), one row for each node.

    conv_id is the smallest member, parent_conv_id that of the parent (null for the root), n_convs counts members; n_leaves
    and saved_tokens (members but one, times the bytes of the last text) are sums over the subtree; ends_sha256 is the
    digest of the ids of the conversations that end at the node.

    Turns are ordered by turn, null first, and rows of the same turn by the digest of role and text; repeated rows
    are turns of their own. A null role or text is an empty one; rows without a conv_id are left out, as are other
    columns. Without conversations there is no root and no row.
    """
    return trie(*rebuilt(conversations), leaf_bits=leaf_bits)


def prefix_trie_sql() -> str:
    """The same in DuckDB, by whole prefixes and all pairs of a node and one below it."""
    return r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
        md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS name
    FROM conversations WHERE conv_id IS NOT NULL
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, name[1] >= '8' DESC, name[1:16],
        name[17] >= '8' DESC, name) AS i FROM turns
), counted AS (
    SELECT conv_id, count(*) AS own, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::BIGINT) AS digits
    FROM turns GROUP BY conv_id
), convs AS (
    SELECT conv_id, own, conv_id - conv_id % 5 AS base,
        xor(list_reduce(list_prepend(4294967295::BIGINT, digits), lambda crc, byte:
            list_reduce(list_prepend(xor(crc, byte), range(8)), lambda c, i:
                CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)), 4294967295::BIGINT) % 9 AS h
    FROM counted
), rebuilt AS (
    SELECT c.conv_id, i, name, text FROM convs c JOIN placed p ON p.conv_id = c.base AND p.i <= c.h
    UNION ALL
    SELECT c.conv_id, least(c.h, coalesce(b.own, 0)) + p.i - c.h, name, text
    FROM convs c JOIN placed p ON p.conv_id = c.conv_id AND p.i > c.h LEFT JOIN convs b ON b.conv_id = c.base
), named AS (
    SELECT conv_id, i AS depth, strlen(text) AS size, md5(array_to_string(list(name) OVER (PARTITION BY conv_id ORDER BY i), ',')) AS node
    FROM rebuilt
), every AS (
    SELECT conv_id, depth, size, node, coalesce(lag(node) OVER (PARTITION BY conv_id ORDER BY depth), 'root') AS parent FROM named
    UNION ALL SELECT conv_id, 0, 0, 'root', NULL FROM convs
), nodes AS (
    SELECT node, any_value(parent) AS parent, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs,
        any_value(size) AS size FROM every GROUP BY node
), kids AS (
    SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent
), under AS (
    SELECT DISTINCT a.node, b.node AS low FROM every a JOIN every b ON a.conv_id = b.conv_id AND b.depth >= a.depth
), totals AS (
    SELECT under.node, count(*) FILTER (kids.node IS NULL) AS n_leaves, sum((n_convs - 1) * size)::BIGINT AS saved_tokens
    FROM under JOIN nodes ON nodes.node = low LEFT JOIN kids ON kids.node = low GROUP BY under.node
), ends AS (
    SELECT node, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
    FROM (SELECT *, max(depth) OVER (PARTITION BY conv_id) AS last FROM every) WHERE depth = last GROUP BY node
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens,
    sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.node = n.parent LEFT JOIN kids ON kids.node = n.node JOIN totals ON totals.node = n.node
    LEFT JOIN ends ON ends.node = n.node
"""
