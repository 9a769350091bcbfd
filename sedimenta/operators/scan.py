"""Running values over keys of any length: segmented scans of a range-partitioned table.

A window sends all rows of a key to one task. Here rows are range-partitioned by key and order, so that a frequent key is cut, and written once. A
stretch is what one task reads of a written file. Only the first and the last key of a stretch can go on in another one, so a first pass
over the columns that matter gives two small rows per stretch: totals of any associative operation, the last rows for a moving frame, or the map
of a throttle. Their prefixes are what a stretch's first key starts from, and a second pass streams the rows. All lists that reach the driver have a row
per stretch, so the table's files bound them and its keys don't.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from sedimenta.sources.scratch import scratch

#: Maps of neighbouring stretches that a task composes.
FAN = 16
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


@dataclass
class Ranged:
    """A table sorted by key and order within ranges: columns c0, c1, ... (those of the source, by place), k, part, and extra ones.
    ``names`` are the source's columns."""

    rows: DataFrame
    names: list[str]

    def stretches(self) -> DataFrame:
        """The rows with the place (part, block) of the stretch that they are read in."""
        return self.rows.select("*", F.col("_metadata.file_block_start").alias("block"))


def ranged(df: DataFrame, key: str | None, order: list[str | Column], extra: dict[str, Column] | None = None, parts: int | None = None) -> Ranged:
    """Rows ranged and sorted by key (null a key of its own; no key: all rows are one) and order, written with ``extra`` columns. Rows
    that tie in all of these are told apart by a hash of the row, so that equal keys and orders are cut too."""
    spark, names = df.sparkSession, df.columns
    k = F.lit(0) if key is None else F.col(key)
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    plain = df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)), k.alias("k"), *(o.alias(f"o{i}") for i, o in enumerate(keys)), *(c.alias(n) for n, c in (extra or {}).items()))
    hashed = [f"c{i}" for i, f in enumerate(df.schema) if not isinstance(f.dataType, T.MapType | T.VariantType)]
    plain = plain.withColumn("tie", F.xxhash64(*hashed))
    by = ["k", *(f"o{i}" for i in range(len(keys))), "tie"]
    dealt = plain.repartitionByRange(parts, *by) if parts else plain.repartitionByRange(*by)
    path = scratch(spark, "ranged")
    out = dealt.sortWithinPartitions(*by).drop(*by[1:]).withColumn("part", F.spark_partition_id())
    out.write.option("maxRecordsPerFile", 0).parquet(path)
    return Ranged(spark.read.schema(out.schema).parquet(path), names)


@dataclass
class Piece:
    """Rows of one stretch, as they come. ``starts`` are the rows at which a key begins (row 0 first), ``opens`` says whether the stretch
    begins here, ``goes_on`` whether row 0's key is that of the piece before."""

    place: tuple[int, int]
    rows: pa.RecordBatch
    starts: np.ndarray
    opens: bool
    goes_on: bool

    def start_of_rows(self) -> np.ndarray:
        """For each row, the row at which its key begins."""
        n = self.rows.num_rows
        return np.repeat(self.starts, np.diff(np.append(self.starts, n)))


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[Piece]:
    place, last = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        part, block = batch["part"].to_numpy(), batch["block"].to_numpy()
        cuts = np.flatnonzero((part[1:] != part[:-1]) | (block[1:] != block[:-1])) + 1
        for i, j in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            rows, now = batch.slice(i, j - i), (int(part[i]), int(block[i]))
            k = rows["k"]
            a, b = k.slice(0, len(k) - 1), k.slice(1)
            differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
            starts = np.concatenate([[0], np.flatnonzero(differ.to_numpy(zero_copy_only=False)) + 1])
            yield Piece(now, rows, starts, now != place, now == place and k[0].equals(last))
            place, last = now, k[-1]


def _ends(rows: DataFrame, fold: Callable[[object, pa.RecordBatch], object], told: Callable[[object], dict], kinds: str) -> DataFrame:
    """What ``fold`` makes of the rows of the first and the last key of each stretch, piece by piece: part, block, head (whether it is
    the first key), k, and the columns that ``told`` gives."""
    out = f"part int, block long, head boolean, k {rows.schema['k'].dataType.simpleString()}, {kinds}"
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in T._parse_datatype_string(out).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, head, k, state = None, True, None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"part": place[0], "block": place[1], "head": head, "k": k.as_py(), **told(state)}], arrow)

        for piece in pieces(batches):
            edges = np.append(piece.starts, piece.rows.num_rows)
            wanted = {0, len(piece.starts) - 1}  # a key between them begins and ends in this piece
            for i in sorted(wanted):
                if i or not piece.goes_on:
                    if place is not None and (head or (piece.opens and i == 0)):
                        yield done()
                    place, head, k, state = piece.place, piece.opens and i == 0, piece.rows["k"][int(edges[i])], None
                state = fold(state, piece.rows.slice(edges[i], edges[i + 1] - edges[i]))
        if place is not None:
            yield done()

    return rows.mapInArrow(run, out)


def _per_stretch(carried: DataFrame):
    """What the first key of each stretch starts from, by place (null if it begins there): a row per stretch, sent to all tasks."""
    found = carried.where("head").toArrow().to_pylist()
    return carried.sparkSession.sparkContext.broadcast({(r["part"], r["block"]): r if r["ahead"] else None for r in found})


def _opened(known: dict[tuple[int, int], dict | None], piece: Piece) -> dict | None:
    """What the key of a piece that doesn't go on starts from. Files may be split otherwise than in the first pass if the cluster has changed since:
    a place that it hasn't seen is an error rather than a wrong result."""
    if not piece.opens:
        return None
    if piece.place not in known:
        raise RuntimeError("the ranges' files were split otherwise than in the first pass; run the query again")
    return known[piece.place]


def _columns(table: Ranged) -> tuple[list[str], str]:
    held = [f"c{i}" for i in range(len(table.names))]
    return held, ", ".join(f"{c} {table.rows.schema[c].dataType.simpleString()}" for c in held)


# --------------------------------------------------------------------------- running values

#: Operations with numpy's function and the neutral elements of whole and other numbers.
_FOLDS = {
    "sum": (np.add, 0, 0.0),
    "product": (np.multiply, 1, 1.0),
    "count": (np.add, 0, 0.0),
    "min": (np.minimum, np.iinfo(np.int64).max, np.inf),
    "max": (np.maximum, np.iinfo(np.int64).min, -np.inf),
}


def _values(op: str, column: pa.Array, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """Values with nulls as neutral elements, and which are there."""
    there = pc.is_valid(column).to_numpy(zero_copy_only=False)
    if op == "count":
        return there.astype(np.int64), there
    x = pc.fill_null(column, 0).to_numpy(zero_copy_only=False).astype(np.int64 if whole else np.float64)
    return np.where(there, x, _FOLDS[op][1 if whole else 2]), there


def segmented(fold: np.ufunc, x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Running values within segments, by doubling steps: as many passes as the longest segment has binary digits."""
    y, at, step = x.copy(), np.arange(len(x)) - start, 1
    longest = int(at.max(initial=0))
    while step <= longest:
        reach = np.flatnonzero(at >= step)
        y[reach] = fold(y[reach - step], y[reach])
        step *= 2
    return y


def running(df: DataFrame, key: str | None, order: str | Column | list[str | Column], **outs: tuple[str, str | Column]) -> DataFrame:
    """Add running values of each key up to and including a row: ``name=(operation, column)`` with sum, product, count, min, max (which pass
    over nulls, and are null before the first value; a count is 0), or first (the value of the key's first row, null or not). Whole
    numbers stay long, others become double. Rows that tie in the order come in an order of their own that is kept."""
    given = {n: F.col(c) if isinstance(c, str) else c for n, (_, c) in outs.items()}
    kinds = {n: isinstance(f.dataType, _WHOLE) for n, f in zip(given, df.select(*given.values()).schema, strict=True)}
    ops = {f"v{i}": (op, n, op == "count" or kinds[n]) for i, (n, (op, _)) in enumerate(outs.items())}
    extra = {v: (given[n].isNotNull().cast("int") if op == "count" else given[n]).cast("long" if whole else "double") for v, (op, n, whole) in ops.items()}
    extra |= {v: F.nullif(extra[v], F.lit(0)) for v, (op, *_) in ops.items() if op == "count"}
    table = ranged(df, key, order if isinstance(order, list) else [order], extra)
    rows, (held, kinds_held) = table.stretches(), _columns(table)
    kind = {v: "long" if whole else "double" for v, (_, _, whole) in ops.items()}

    def fold(state: dict | None, part: pa.RecordBatch) -> dict:
        state = state or {}
        for v, (op, _, whole) in ops.items():
            if op == "first":
                state.setdefault(v, part[v][0].as_py())
                continue
            x, there = _values(op, part[v], whole)
            if op == "count" or there.any():
                now = _FOLDS[op][0].reduce(x).item()
                state[v] = now if state.get(v) is None else _FOLDS[op][0](state[v], now).item()
        return state

    ends = _ends(rows.select("k", "part", "block", *ops), fold, lambda state: {v: state.get(v) for v in ops}, ", ".join(f"{v} {k}" for v, k in kind.items()))
    before = W.partitionBy("k").orderBy("part", "block").rowsBetween(W.unboundedPreceding, -1)
    how = {"sum": F.sum, "product": F.product, "count": F.sum, "min": F.min, "max": F.max, "first": F.first}
    starts = _per_stretch(ends.select("part", "block", "head", F.count("*").over(before).alias("ahead"), *(how[op](v).over(before).cast(kind[v]).alias(v) for v, (op, *_) in ops.items())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, state = starts.value, None
        for piece in pieces(batches):
            if not piece.goes_on:
                state = _opened(known, piece)
            start, now, made = piece.start_of_rows(), {}, []
            mine = start == 0  # rows of the key that the state is of
            for v, (op, _, whole) in ops.items():
                was = state[v] if state else None
                if op == "first":
                    y = piece.rows[v].take(pa.array(start))
                    if state:
                        y = pc.if_else(pa.array(mine), pa.scalar(was, y.type), y)
                    made.append(y)
                    now[v] = y[-1].as_py()
                    continue
                x, there = _values(op, piece.rows[v], whole)
                y, seen = segmented(_FOLDS[op][0], x, start), segmented(np.logical_or, there, start)
                if was is not None:
                    y[mine] = _FOLDS[op][0](np.asarray(was, dtype=y.dtype), y[mine])
                    seen[mine] = True
                if op == "count":
                    seen[:] = True
                made.append(pa.array(y, mask=~seen))
                now[v] = y[-1].item() if seen[-1] else None
            state = now
            yield pa.RecordBatch.from_arrays([*(piece.rows[c] for c in held), *made], names=[*held, *(f"r{v}" for v in ops)])

    done = rows.select(*held, "k", "part", "block", *ops).mapInArrow(run, kinds_held + "".join(f", r{v} {k}" for v, k in kind.items()))
    return done.select(*(F.col(c).alias(n) for c, n in zip(held, table.names, strict=True) if n not in outs), *(F.col(f"r{v}").alias(n) for v, (_, n, _) in ops.items()))


# --------------------------------------------------------------------------- moving means


def moving_mean(df: DataFrame, key: str | None, order: str | Column | list[str | Column], value: str, n: int = 30, out: str = "mean") -> DataFrame:
    """Add the mean of the values (nulls aside; null without any) of a row and the ``n`` - 1 rows of its key before it. A stretch is
    handed the last ``n`` - 1 values before it."""
    table = ranged(df, key, order if isinstance(order, list) else [order], {"v": F.col(value).cast("double")})
    rows, (held, kinds_held), halo = table.stretches(), _columns(table), n - 1

    def fold(state: list | None, part: pa.RecordBatch) -> list:
        last = part["v"].slice(max(0, part.num_rows - halo)).to_pylist() if halo else []
        return [*(state or []), *last][-halo:] if halo else []

    ends = _ends(rows.select("k", "part", "block", "v"), fold, lambda state: {"v": state}, "v array<double>")
    by = W.partitionBy("k").orderBy("part", "block")
    near = F.flatten(F.collect_list("v").over(by.rowsBetween(-max(halo, 1), -1)))  # a stretch has a row of the key at least
    starts = _per_stretch(ends.select("part", "block", "head", F.count("*").over(by.rowsBetween(W.unboundedPreceding, -1)).alias("ahead"), F.when(F.size(near) > 0, F.slice(near, -F.least(F.lit(max(halo, 1)), F.size(near)), F.lit(halo))).otherwise(near).alias("v")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, state = starts.value, []
        for piece in pieces(batches):
            if not piece.goes_on:
                state = (_opened(known, piece) or {"v": []})["v"]
            column = pa.concat_arrays([pa.array(state, pa.float64()), piece.rows["v"]])
            there = pc.is_valid(column).to_numpy(zero_copy_only=False)
            x = np.where(there, pc.fill_null(column, 0.0).to_numpy(zero_copy_only=False), 0.0)
            h = len(state)
            start = np.concatenate([np.zeros(h, dtype=np.int64), np.where(piece.start_of_rows() == 0, 0, piece.start_of_rows() + h)])
            at = np.arange(len(x)) - start
            total, count = np.zeros(len(x)), np.zeros(len(x), dtype=np.int64)
            for back in range(min(n, int(at.max(initial=0)) + 1)):
                reach = np.flatnonzero(at >= back)
                total[reach] += x[reach - back]
                count[reach] += there[reach - back]
            with np.errstate(invalid="ignore"):
                mean = pa.array((total / count)[h:], mask=(count == 0)[h:])
            tail = start[-1]
            state = column.slice(max(int(tail), len(column) - halo)).to_pylist() if halo else []
            yield pa.RecordBatch.from_arrays([*(piece.rows[c] for c in held), mean], names=[*held, "r"])

    done = rows.select(*held, "k", "part", "block", "v").mapInArrow(run, f"{kinds_held}, r double")
    return done.select(*(F.col(c).alias(m) for c, m in zip(held, table.names, strict=True) if m != out), F.col("r").alias(out))


# --------------------------------------------------------------------------- throttles


@dataclass
class Gate:
    """What a run of rows does to a throttle: a row is let in at the first of ``entries`` that is at least ``gap`` after the last one
    published; the last one published on leaving is then the exit of that entry. No such entry: it stays. ``reach`` is the run's
    first time and ``gap``; later entries can't be the first."""

    entries: np.ndarray
    exits: np.ndarray
    reach: int

    def leave(self, last: int | None, gap: int) -> int | None:
        i = 0 if last is None else int(np.searchsorted(self.entries, last + gap))
        return last if i == len(self.entries) else int(self.exits[i])

    def then(self, other: Gate, gap: int) -> Gate:
        """Both runs, one after the other."""
        to = np.searchsorted(other.entries, self.exits + gap)
        exits = np.where(to < len(other.entries), np.append(other.exits, 0)[to], self.exits)
        entries = self.entries
        if entries[-1] < self.reach:  # later rows may be the first to be let in
            more = slice(int(np.searchsorted(other.entries, entries[-1], side="right")), int(np.searchsorted(other.entries, self.reach)) + 1)
            entries, exits = np.concatenate([entries, other.entries[more]]), np.concatenate([exits, other.exits[more]])
        return _short(entries, exits, self.reach)


def _short(entries: np.ndarray, exits: np.ndarray, reach: int) -> Gate:
    """Of neighbouring entries with one exit the last is enough."""
    keep = np.append(exits[1:] != exits[:-1], True)
    return Gate(entries[keep], exits[keep], reach)


def gate(times: np.ndarray, gap: int) -> Gate:
    """The gate of a run of ascending times, by pointer jumping: each row points to the first one ``gap`` later, and pointers are
    doubled until they rest."""
    times = np.unique(times)
    after = np.searchsorted(times, times + gap)
    rest = np.where(after == len(times), np.arange(len(times)), after)
    while (new := rest[rest]).tobytes() != rest.tobytes():
        rest = new
    first = int(np.searchsorted(times, times[0] + gap)) + 1
    return _short(times[:first], times[rest[:first]], int(times[0]) + gap)


def let_through(times: np.ndarray, starts: np.ndarray, last: int | None, gap: int) -> np.ndarray:
    """Which rows a throttle publishes: ``times`` ascend within the segments that begin at ``starts``, and ``last`` was published before
    the first segment. Every row points to the first one of its segment ``gap`` later; the orbits of the segments' first rows are
    marked by jumps of doubled length."""
    n, ends = len(times), np.append(starts[1:], len(times))
    segment = np.repeat(np.arange(len(starts)), ends - starts)
    order = np.lexsort((np.repeat([1, 0], n), np.concatenate([times, times + gap]), np.tile(segment, 2)))  # a place asked for comes before rows at that time
    asked = order >= n
    jump = np.full(n + 1, n)
    jump[order[asked] - n] = np.cumsum(~asked)[asked]
    jump[:n] = np.where(jump[:n] < ends[segment], jump[:n], n)
    first = starts.copy()
    if last is not None:
        first[0] = np.searchsorted(times[: ends[0]], last + gap)
        first = first[1:] if first[0] == ends[0] else first
    out = np.zeros(n + 1, dtype=bool)
    out[first] = True
    while (jump[:n] < n).any():
        out[jump[np.flatnonzero(out)]] = True
        jump = jump[jump]
    return out[:n]


def throttle(df: DataFrame, key: str | None, ts: str, tie: str | list[str], seconds: float = 0.5) -> DataFrame:
    """Rows that a throttle lets through: the first of each key, and each that is at least ``seconds`` (to the microsecond) after the last one let
    through. Rows without a time aren't. Of rows of one time the first by ``tie`` counts; with no or negative ``seconds`` all are let through.

    The decision depends on the last row let through, but what a run of rows makes of it is a map of bounded size (``Gate``). Runs are the
    stretches of a key; their gates are composed in groups of ``FAN`` until one is left, and the last published times are handed down again.
    """
    timed, spark, gap = df.where(F.col(ts).isNotNull()), df.sparkSession, int(np.ceil(round(seconds * 1e6, 3)))
    if gap <= 0:
        return timed
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    table = ranged(timed, key, [us, *([tie] if isinstance(tie, str) else tie)], {"us": us})
    rows, (held, kinds_held) = table.stretches(), _columns(table)

    def fold(state: list | None, part: pa.RecordBatch) -> list:
        state = state or []
        state.append(part["us"].to_numpy())
        return state

    def told(state: list) -> dict:
        g = gate(np.concatenate(state), gap)
        return {"entries": g.entries, "exits": g.exits, "reach": g.reach}

    level = _written(_ends(rows.select("k", "part", "block", "us"), fold, told, GATES).withColumnRenamed("part", "node"), "gates")
    files, levels = (level.agg(F.max("node")).first()[0] or 0) + 1, [level]
    kind = level.schema["k"].dataType.simpleString()
    while files > FAN:  # nodes are numbered by the table's files, whose number is known
        above = levels[-1].withColumn("up", F.floor(F.col("node") / FAN)).groupBy("k", "up").applyInArrow(_composer(gap), f"k {kind}, node int, block long, head boolean, {GATES}")
        levels.append(_written(above, "gates"))
        files = -(-files // FAN)
    handed = None
    for level in reversed(levels):
        grouped = level.withColumn("up", F.floor(F.col("node") / FAN).cast("int"))
        if handed is None:
            asked = grouped.withColumn("was", F.lit(None).cast("long"))
        else:
            upper = handed.select(F.col("k").alias("uk"), F.col("node").alias("un"), F.col("last").alias("was"))
            asked = grouped.join(upper, F.col("k").eqNullSafe(F.col("uk")) & (F.col("up") == F.col("un"))).drop("uk", "un")
        handed = _written(asked.groupBy("k", "up").applyInArrow(_hander(gap), f"k {kind}, node int, block long, head boolean, last long"), "handed")
    starts = _per_stretch(handed.select(F.col("node").alias("part"), "block", "head", "last", F.col("last").isNotNull().alias("ahead")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last = starts.value, None
        for piece in pieces(batches):
            if not piece.goes_on:
                last = (_opened(known, piece) or {"last": None})["last"]
            times, tail = piece.rows["us"].to_numpy(), int(piece.starts[-1])
            out = let_through(times, piece.starts, last, gap)
            seen = np.flatnonzero(out[tail:])
            last = int(times[tail + seen[-1]]) if len(seen) else last
            yield pa.RecordBatch.from_arrays([piece.rows[c] for c in held], names=held).filter(pa.array(out))

    done = rows.select(*held, "k", "part", "block", "us").mapInArrow(run, kinds_held)
    return done.toDF(*table.names)


GATES = "entries array<long>, exits array<long>, reach long"


def _written(df: DataFrame, label: str) -> DataFrame:
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _gates(rows: pa.Table) -> list[Gate]:
    lists = (rows[c].to_pylist() for c in ("entries", "exits", "reach"))
    return [Gate(np.array(e, dtype=np.int64), np.array(x, dtype=np.int64), r) for e, x, r in zip(*lists, strict=True)]


def _composer(gap: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def compose(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        first, *others = _gates(rows.sort_by([("node", "ascending"), ("block", "ascending")]))
        for g in others:
            first = first.then(g, gap)
        cols = [pa.array([key[0].as_py()], key[0].type), pa.array([key[1].as_py()], pa.int32()), pa.array([0], pa.int64()), pa.array([True]), pa.array([first.entries]), pa.array([first.exits]), pa.array([first.reach], pa.int64())]
        return pa.table(cols, names=["k", "node", "block", "head", "entries", "exits", "reach"])

    return compose


def _hander(gap: int) -> Callable[[pa.Table], pa.Table]:
    def hand_down(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("node", "ascending"), ("block", "ascending")])
        last, out = rows["was"][0].as_py(), []
        for g in _gates(rows):
            out.append(last)
            last = g.leave(last, gap)
        return rows.select(["k", "node", "block", "head"]).append_column("last", pa.array(out, pa.int64()))

    return hand_down
