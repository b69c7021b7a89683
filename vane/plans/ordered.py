"""Order-dependent recursions: one pass over each key's rows in order, with a small state a key."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vane.plans.shared import stored

ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "timestamp": pa.timestamp("us", tz="UTC")}


def ordered_scan(rows: DataFrame, keys: list[str], order: list[str], start: Callable[[], Any], step: Callable[[Any, tuple], list[tuple] | None], schema: str, finish: Callable[[Any, tuple], list[tuple]] | None = None) -> DataFrame:
    """step(state, row) for each row of a key in order, and finish(state, key) after its last row; both give rows of schema.

    Rows are dealt by key and sorted by Spark, which spills; a task streams them and holds the state of one key and one batch
    of rows, so a hot key costs time and no memory. Columns come to step in the order keys, order, others.
    """
    names = [*keys, *order, *(c for c in rows.columns if c not in (*keys, *order))]
    columns = [c.strip().rsplit(" ", 1) for c in schema.split(",")]

    def pack(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], ARROW[kind]) for i, (_, kind) in enumerate(columns)], [n for n, _ in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if key is None or row[: len(keys)] != key:
                    if key is not None and finish is not None:
                        out += finish(state, key)
                    key, state = row[: len(keys)], start()
                out += step(state, row) or ()
                if len(out) >= 10_000:
                    yield pack(out)
                    out = []
        if key is not None and finish is not None:
            out += finish(state, key)
        if out:
            yield pack(out)

    return rows.select(*names).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def chunked_scan(rows: DataFrame, keys: list[str], chunk: str, order: list[str], start: Callable[[], Any], step: Callable[[Any, tuple], list[tuple] | None], schema: str) -> DataFrame:
    """ordered_scan for steps whose state forgets: a key's rows are dealt by chunk too (a column that follows the order, such as the day).

    Every chunk is first run from a fresh state; then from the state in which the chunk before it ended; and again, as long as that
    state changes. What comes out is exact, because the first chunk's state is, and so each next one's once the one before it stays as it is. A state that
    is forgotten within a chunk (sums that return to 0) settles in the second run, whatever the number of chunks. The state must be a list of plain values.
    """
    rows = stored(rows.select(*keys, chunk, *order, *(c for c in rows.columns if c not in (*keys, chunk, *order))), "chunk-rows")
    by = [*keys, chunk]
    outs = [c.strip().rsplit(" ", 1) for c in schema.split(",")]
    blank = (None,) * len(outs)
    own = [f"{'' if n not in by else '_'}{n} {k}" for n, k in outs]
    held = f"{', '.join(f'{c} {rows.schema[c].dataType.simpleString()}' for c in by)}, {', '.join(own)}, state_after string"

    def run(some: DataFrame) -> DataFrame:
        """Rows of the step, and for each chunk a row with its last state."""
        def one(box: list, row: tuple) -> list[tuple]:
            key, begun, rest = row[: len(by)], row[len(by)], row[len(by) + 1 :]
            if begun == 0:  # the state before the chunk comes as its first row
                box[0][:] = json.loads(rest[-1])
                return []
            return [(*key, *r, None) for r in step(box[0], (*key[:-1], *rest[:-1])) or ()]

        last = lambda box, key: [(*key, *blank, json.dumps(dumped(box[0])))]
        return ordered_scan(some, by, ["begun", *order], lambda: [start()], one, held, last)

    marked = rows.withColumns({"begun": F.lit(1), "state_before": F.lit(None).cast("string")})
    named = lambda df, *more: df.select(*[F.col(c).alias(f"at_{c}") for c in by], *more)
    here = [F.col(c).eqNullSafe(F.col(f"at_{c}")) for c in by]
    ends = stored(run(marked).where("state_after IS NOT NULL").select(*by, "state_after"), "chunk-ends")
    fresh = json.dumps(dumped(start()))
    used = done = None  # used: the state that each chunk was last run from
    while True:
        before = ends.withColumn("state_before", F.lag("state_after", 1, fresh).over(Window.partitionBy(*keys).orderBy(chunk)))
        wanted = before if done is None else before.join(named(used, "state_used"), here).where("state_before <> state_used")
        wanted = stored(wanted.select(*by, "state_before"), "chunk-states")
        if done is not None and not wanted.limit(1).count():
            break
        again = marked if done is None else marked.join(named(wanted), here, "left_semi")
        first = wanted.select(*by, F.lit(0).alias("begun"), "state_before")
        found = stored(run(again.unionByName(first, allowMissingColumns=True)), "chunk-run")
        new = found.where("state_after IS NOT NULL").select(*by, "state_after")
        now = wanted.withColumnRenamed("state_before", "state_used")
        changed = lambda old, fresh_rows, name: fresh_rows if done is None else stored(old.join(named(fresh_rows).distinct(), here, "left_anti").unionByName(fresh_rows), name)
        ends, used, done = changed(ends, new, "chunk-ends"), changed(used, now, "chunk-used"), changed(done, found, "chunk-run")
    return done.where("state_after IS NULL").select(*[F.col(f"_{n}" if n in by else n).alias(n) for n, _ in outs])


def framed(rows: list[tuple], columns: list[tuple[str, str]]) -> pd.DataFrame:
    """Rows as a pandas frame of the named kinds."""
    kinds = {"bigint": "Int64", "int": "Int32", "boolean": "boolean", "double": "float64"}

    def kind_of(i: int, kind: str) -> str:
        if kind != "timestamp":
            return kinds.get(kind, "object")
        return "datetime64[us, UTC]" if any(getattr(r[i], "tzinfo", None) is not None for r in rows) else "datetime64[us]"

    return pd.DataFrame({n: pd.Series([r[i] for r in rows], dtype=kind_of(i, kind)) for i, (n, kind) in enumerate(columns)})


def dumped(state: Any) -> Any:
    """The attributes of a state, all the way down, as plain values."""
    if isinstance(state, deque):
        return list(state)
    if hasattr(state, "__dict__"):
        return {k: dumped(v) for k, v in vars(state).items()}
    return [dumped(v) for v in state] if isinstance(state, (list, tuple)) else state


def restored(fresh: Any, plain: Any) -> Any:
    """A fresh state with the attributes that dumped() gave."""
    if isinstance(fresh, deque):
        return deque(plain)
    if not hasattr(fresh, "__dict__"):
        return plain
    for k, v in plain.items():
        setattr(fresh, k, restored(getattr(fresh, k), v))
    return fresh


def stream_scan(rows: DataFrame, keys: list[str], order: list[str], start: Callable[[], Any], step: Callable[[Any, tuple], list[tuple] | None], schema: str, finish: Callable[[Any, tuple], list[tuple]] | None = None) -> DataFrame:
    """ordered_scan over a stream: the state of each key is kept between micro-batches, whose rows are taken in order.

    finish gives a key's rows after each micro-batch that brought it rows. Rows that come late are taken when they come.
    """
    names = [*keys, *order, *(c for c in rows.columns if c not in (*keys, *order))]
    columns = [tuple(c.strip().rsplit(" ", 1)) for c in schema.split(",")]

    def run(key: tuple, batches: Iterator[pd.DataFrame], kept) -> Iterator[pd.DataFrame]:
        state = restored(start(), json.loads(kept.get[0])) if kept.exists else start()
        pdf = pd.concat(list(batches)).sort_values(order, kind="stable")
        out: list[tuple] = []
        for row in pdf[names].itertuples(index=False, name=None):
            out += step(state, tuple(None if v is pd.NA or v is pd.NaT or v != v else v for v in row)) or ()
        if finish is not None:
            out += finish(state, key)
        kept.update((json.dumps(dumped(state)),))
        yield framed(out, columns)

    return rows.select(*names).groupBy(*keys).applyInPandasWithState(run, schema, "state string", "append", "NoTimeout")
