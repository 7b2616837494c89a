"""JSON arrays of any size, read in byte ranges by many tasks.

What a byte means depends on all before it: it may lie in a string, an escape or a comment. So the first pass runs over each
range once for every state it may begin in, and gives for each the state at the range's end, the change of depth, and how
many objects open at each depth. Composed from left to right, a row a range, these tell where each range really begins: its
state, its depth, and the number of its first object. The second pass reads the objects that open in its range at depth 1, the last
of them beyond its end. Strings, escapes, comments and brackets are bytes below 128, so a cut inside a character does no harm.
"""

from __future__ import annotations

import json
import re
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.store import kept
from .files import filesystem

PLAIN, STRING, ESCAPE, LINE, BLOCK, STAR, SLASH = range(7)
TOKEN = re.compile(
    rb'(?P<s>"(?:[^"\\]++|\\.)*+")|(?P<S>"(?:[^"\\]++|\\.)*+(?P<e>\\?)\Z)|(?P<l>//[^\n]*+\n)|(?P<L>//[^\n]*+\Z)|(?P<b>/\*.*?\*/)|(?P<B>/\*.*\Z)|(?P<x>/\Z)|(?P<o>[{\[])|(?P<c>[}\]])',
    re.S,
)
REST = re.compile(rb'(?:[^"\\]++|\\.)*+"', re.S)


def resumed(data: bytes, state: int) -> tuple[int, int]:
    """(state, position): where plain text begins again in data that starts in ``state``, or the end and the state there."""
    at = 0
    if state == SLASH:
        state, at = {b"/": (LINE, 1), b"*": (BLOCK, 1)}.get(data[:1], (PLAIN, 0))
    if state == ESCAPE:
        state, at = STRING, 1
    if state == STAR:
        state, at = (PLAIN, 1) if data[:1] == b"/" else (BLOCK, 0)
    if state == STRING:
        m = REST.match(data, at)
        if m:
            return PLAIN, m.end()
        tail = len(data) - len(data[at:].rstrip(b"\\")) - at if at < len(data) else 0
        return (ESCAPE if tail % 2 else STRING), len(data)
    if state in (LINE, BLOCK):
        mark = b"\n" if state == LINE else b"*/"
        end = data.find(mark, at)
        if end >= 0:
            return PLAIN, end + len(mark)
        return (STAR if state == BLOCK and len(data) > at and data.endswith(b"*") else state), len(data)
    return PLAIN, at


def closing_state(m: re.Match) -> int:
    """The state in which an open token leaves the end of the data."""
    kind = m.lastgroup
    if m["S"] is not None:
        return ESCAPE if m["e"] else STRING
    if m["B"] is not None:
        return STAR if len(m["B"]) > 2 and m["B"].endswith(b"*") else BLOCK
    return {"L": LINE, "x": SLASH}.get(kind, PLAIN)


def scanned(data: bytes, at: int) -> tuple[int, int, dict[int, int]]:
    """(state at the end, change of depth, objects opened by depth) of data that is plain from ``at`` on."""
    depth, state, opened = 0, PLAIN, Counter()
    for m in TOKEN.finditer(data, at):
        kind = m.lastgroup
        if kind == "o":
            opened[depth] += m[0] == b"{"
            depth += 1
        elif kind == "c":
            depth -= 1
        elif m.end() == len(data):
            state = closing_state(m)
    return state, depth, {d: n for d, n in opened.items() if n}


def summary(data: bytes) -> list[tuple[int, int, dict[int, int]]]:
    """``scanned`` for each state the data may begin in; states that meet are scanned once."""
    seen: dict[int, tuple] = {}
    out = []
    for state in range(7):
        end, at = resumed(data, state)
        if at >= len(data) and end != PLAIN:
            out.append((end, 0, {}))
            continue
        if at not in seen:
            seen[at] = scanned(data, at)
        out.append(seen[at])
    return out


def objects(read, start: int, stop: int, state: int, depth: int):
    """The bytes of the objects that open at depth 1 in [start, stop). ``read(a, b)`` gives the file's bytes, fewer at its end."""
    data = read(start, stop)
    end, at = resumed(data, state)
    opens = None
    if end == PLAIN:
        for m in TOKEN.finditer(data, at):
            kind = m.lastgroup
            if kind == "o":
                if depth == 1 and m[0] == b"{":
                    opens = m.start()
                depth += 1
            elif kind == "c":
                depth -= 1
                if depth == 1 and opens is not None:
                    yield data[opens : m.end()]
                    opens = None
    # The last one goes on behind the range: twice as much is read until it closes.
    more, begin = 1 << 20, start + (opens or 0)
    while opens is not None:
        own, level = read(begin, stop + more), 0
        for m in TOKEN.finditer(own):
            level += {"o": 1, "c": -1}.get(m.lastgroup, 0)
            if level == 0 and m.lastgroup == "c":
                yield own[: m.end()]
                return
        if begin + len(own) < stop + more:
            raise ValueError(f"an object at byte {begin} has no end")
        more *= 2


def ranges(spark: SparkSession, path: str, range_bytes: int) -> DataFrame:
    """file (by name, from 0), path, k, start, stop, and where each range begins: state, depth, first (the number of its first object
    over all files)."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    cuts = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))
    each = files.select("path", "length", F.posexplode(cuts).alias("k", "start")).select("path", "k", "start", F.least(F.col("start") + range_bytes, "length").alias("stop"))

    def first(batches):
        for batch in batches:
            for row in batch.to_pylist():
                fs, at = filesystem(row["path"])
                with fs.open_input_file(at) as f:
                    f.seek(row["start"])
                    told = [(s, d, list(o.items())) for s, d, o in summary(f.read(row["stop"] - row["start"]))]
                yield pa.RecordBatch.from_pylist([row | {"told": json.dumps(told)}], pa.schema([("path", pa.string()), ("k", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("told", pa.string())]))

    # A range a task, or several where there are very many.
    n = each.count()
    spread = lambda df: df.repartition(max(1, min(n, 4096)))
    told = kept(spread(each).mapInArrow(first, "path string, k int, start long, stop long, told string"))

    def composed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("k")
        state, depth, count, out = PLAIN, 0, 0, []
        for x in map(json.loads, rows.told):
            end, change, opened = x[state]
            mine = sum(n for d, n in opened if d + depth == 1)
            out.append((state, depth, count, mine))
            state, depth, count = end, depth + change, count + mine
        own = pd.DataFrame(out, columns=["state", "depth", "before", "objects"], index=rows.index)
        return pd.concat([rows[["path", "k", "start", "stop"]], own], axis=1)

    placed = kept(told.groupBy("path").applyInPandas(composed, "path string, k int, start long, stop long, state int, depth int, before long, objects long"))
    sizes = placed.groupBy("path").agg(F.sum("objects").alias("n"))
    offset = sizes.select("path", F.coalesce(F.sum("n").over(W.orderBy("path").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    found = placed.join(F.broadcast(offset), "path").select("path", "k", "start", "stop", "state", "depth", (F.col("offset") + F.col("before")).alias("first"))
    return spread(found.where("objects > 0"))


def array_objects(spark: SparkSession, path: str, parse, names: list[str], kinds: list[pa.DataType], schema: str, range_bytes: int = 32 << 20, rows: int = 1000) -> DataFrame:
    """A row for each object of the arrays in ``path`` (a file, a folder or a pattern): row_idx, its number over all files in the order of
    their names, and what ``parse`` makes of up to ``rows`` objects' texts (a list of values for each of ``names``)."""

    def second(batches):
        for batch in batches:
            for row in batch.to_pylist():
                fs, at = filesystem(row["path"])
                with fs.open_input_file(at) as f:

                    def read(a: int, b: int) -> bytes:
                        f.seek(a)  # noqa: B023  used within this turn
                        data = f.read(b - a)  # noqa: B023
                        return data

                    number, some = row["first"], []
                    for raw in objects(read, row["start"], row["stop"], row["state"], row["depth"]):
                        some.append(raw.decode())
                        if len(some) == rows:
                            yield batch_of(number, some)
                            number, some = number + len(some), []
                    if some:
                        yield batch_of(number, some)

    def batch_of(number: int, texts: list[str]) -> pa.RecordBatch:
        columns = [pa.array(range(number, number + len(texts)), pa.int64()), *(pa.array(v, k) for v, k in zip(parse(texts), kinds))]
        return pa.RecordBatch.from_arrays(columns, names=["row_idx", *names])

    return ranges(spark, path, range_bytes).mapInArrow(second, schema)
