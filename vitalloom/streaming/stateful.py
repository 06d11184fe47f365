"""Keyed streams with state and event-time timers, exact for rows in any order within a declared lateness.

Each micro-batch is first split by a watermark of its own: the newest time of all batches before it less the lateness.
Rows at or behind it go to a table of late rows and are counted, all others to a table that the stateful query reads,
one micro-batch for each split. So both see one watermark, Spark drops nothing by itself, and rows in = rows kept +
rows late. Split tables are written once per batch number, so a replayed batch changes nothing.

Columns have plain names: those that start with an underscore lose them on the way to the state API.

A stateful step holds a key's rows until the watermark passes them and then takes them in the order of their times.
Its answer is therefore that of the batch form, however the rows were dealt to files and batches. Keys are dealt over
buckets by their hash; a bucket's state is bounded by the rows of its keys within the lateness, and a key's part of it
ends by timer when it can no longer matter.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Number of the split that holds the closing row.
CLOSING = 2_000_000_000
#: Buckets over which keys are dealt. A bucket's rows within the lateness are held in one call's memory.
BUCKETS = 2_048


@dataclass
class Ran:
    """What a keyed stream has written: answers, late rows, and counts by batch (batch, rows, late, newest)."""

    out: DataFrame
    late: DataFrame
    counts: DataFrame


class Kept:
    """What a step keeps of one key, while its rows are folded."""

    def __init__(self, row: tuple | None):
        self.row = row

    def exists(self) -> bool:
        return self.row is not None

    def get(self) -> tuple | None:
        return self.row

    def update(self, row: tuple) -> None:
        self.row = row

    def clear(self) -> None:
        self.row = None


class KeyedStep(StatefulProcessor):
    """State of one bucket of keys: their rows that wait for the watermark, and what the step keeps of each key.

    A call costs milliseconds however few rows it brings, so keys are dealt over buckets by their hash, and one call
    serves all of a bucket; each key is folded for itself. A bucket has one timer, for the earliest of its keys.
    """

    #: Columns of a waiting row besides its time, as a schema string.
    waits: str
    #: Columns of what is kept, as a schema string.
    keeps: str
    #: Seconds after its rows that a step may still wait for.
    horizon: float = 0.0

    def __init__(self, keys: Sequence[str], columns: dict[str, Column], out: str):
        self.keys, self.columns, self.out = list(keys), columns, out

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "columns"}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # packed: a row of state of its own for each would cost more than folding it
        self.rows = handle.getListState("rows", "packed binary")
        self.all_kept = handle.getValueState("kept", "packed binary")
        self.wake = handle.getValueState("wake", "at long")

    def _wake_at(self, at: int, now: int) -> None:
        """Let the bucket's timer end at ``at`` (µs) or earlier."""
        at, set_for = max(-(-at // 1000), now + 1), self.wake.get()[0] if self.wake.exists() else None
        if set_for is None or at < set_for:
            if set_for is not None:
                self.handle.deleteTimer(set_for)
            self.handle.registerTimer(at)
            self.wake.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, names = None, [x.split()[0] for x in self.waits.split(", ")]
        for part in rows:
            part = part[~part["closing_row"]]
            if len(part):
                times = part["at_us"].tolist()
                held = list(zip(*[part[k].tolist() for k in self.keys], times, *[[None if pd.isna(v) else v for v in part[n].tolist()] for n in names]))
                self.rows.appendValue((pickle.dumps(held),))
                first = min(times) if first is None else min(first, *times)
        if first is not None:
            self._wake_at(first, timerValues.getCurrentWatermarkInMs())
        yield self._table([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, now = len(self.keys), timerValues.getCurrentWatermarkInMs()
        passed, ready, rest = now * 1000, {}, []
        for chunk in self.rows.get() if self.rows.exists() else ():
            for r in pickle.loads(chunk[0]):
                if r[n] <= passed:
                    ready.setdefault(r[:n], []).append(r[n:])
                else:
                    rest.append(r)
        kept = pickle.loads(self.all_kept.get()[0]) if self.all_kept.exists() else {}
        answers, left, wakes = [], {}, [r[n] for r in rest]
        for k in ready.keys() | kept.keys():
            own = ready.get(k, [])
            if len(own) > 1:
                own.sort(key=lambda r: (r[0], [(x is None, x) for x in r[1:]]))
            self.kept = Kept(kept.get(k))
            told, wake = self.fold(own, passed)
            answers += [k + a for a in told]
            if self.kept.exists():
                left[k] = self.kept.get()
            if wake is not None:
                wakes.append(wake)
        if ready and rest:
            self.rows.put([(pickle.dumps(rest),)])
        elif ready:
            self.rows.clear()
        if left:
            self.all_kept.update((pickle.dumps(left),))
        else:
            self.all_kept.clear()
        self.wake.clear()
        if wakes:
            self._wake_at(min(wakes), now)
        yield self._table(answers)

    def fold(self, rows: list[tuple], passed: int) -> tuple[list[tuple], int | None]:
        """Answers to rows that are final, in order of time, and the time (µs) at which to be woken again."""
        raise NotImplementedError

    def _table(self, answers: list[tuple]) -> pd.DataFrame:
        names = [*self.keys, *[x.split()[0] for x in self.out.split(", ")]]
        return pd.DataFrame({n: pd.Series([a[i] for a in answers], dtype=object) for i, n in enumerate(names)})

    def close(self) -> None:
        pass


class Cooldown(KeyedStep):
    """Lets a row through when at least ``gap_seconds`` have passed since the last one let through, or when forced.

    With ``since_seen`` the gap counts from the last row of the key, let through or not: repeated decisions.
    Answers: id, time let through. The kept time ends when event time passes it by the gap.
    """

    keeps = "last long"

    def __init__(self, keys: Sequence[str], ident: str, ident_type: str, gap_seconds: float, *, force: Column | None = None, since_seen: bool = False):
        super().__init__(keys, {ident: F.col(ident), "forced": F.lit(False) if force is None else force}, f"{ident} {ident_type}, emitted_at long")
        self.waits = f"{ident} {ident_type}, forced boolean"
        self.gap, self.since_seen = int(gap_seconds * 1_000_000), since_seen

    def fold(self, rows, passed):
        last = self.kept.get()[0] if self.kept.exists() else None
        answers = []
        for t, ident, forced in rows:
            through = forced or last is None or t - last >= self.gap
            if through:
                answers.append((ident, t))
            if through or self.since_seen:
                last = t
        if last is None or last + self.gap <= passed:
            self.kept.clear()
            return answers, None
        self.kept.update((last,))
        return answers, last + self.gap


class TimedOutcome(KeyedStep):
    """A key's first ``opens`` row starts a span; a ``closes`` row before its end answers ``on_close``, its end ``on_expiry``.

    Serves stale tasks and veto windows. A closing row that comes before the opening one waits. Each key is answered
    once; what is kept of it ends ``forget_seconds`` later, or never if that is None.
    """

    waits = "kind string"
    keeps = "opened long, closed long, told boolean"

    def __init__(self, keys: Sequence[str], kind: Column, opens: str, closes: str, after_seconds: float, on_close: str, on_expiry: str, *, forget_seconds: float | None = None):
        super().__init__(keys, {"kind": kind}, "outcome string, at long")
        self.opens, self.closes, self.on_close, self.on_expiry = opens, closes, on_close, on_expiry
        self.span, self.horizon = int(after_seconds * 1_000_000), after_seconds
        self.forget = None if forget_seconds is None else int(forget_seconds * 1_000_000)

    def fold(self, rows, passed):
        opened, closed, told = self.kept.get() if self.kept.exists() else (None, None, False)
        for t, kind in rows:
            if kind == self.opens and opened is None:
                opened = t
            elif kind == self.closes and closed is None:
                closed = t
        answers = []
        if opened is not None and not told:
            if closed is not None and closed <= opened + self.span:
                answers, told = [(self.on_close, max(opened, closed))], True
            elif opened + self.span <= passed:
                answers, told = [(self.on_expiry, opened + self.span)], True
        if opened is not None and not told:
            self.kept.update((opened, closed, told))
            return answers, opened + self.span
        end = None if self.forget is None else (opened if opened is not None else closed or passed) + self.span + self.forget
        if end is not None and end <= passed:
            self.kept.clear()
            return answers, None
        if opened is not None or closed is not None:
            self.kept.update((opened, closed, told))
        return answers, end


class OpenContext(KeyedStep):
    """Each contact's open context: its latest row, until that row's own end.

    Answers ``opened`` when a context takes over, ``replaced`` for the one before if it still held, ``expired`` when
    event time passes the end of the one that holds. State is one row and ends with the context.
    """

    keeps = "ident long, ends long, since long"

    def __init__(self, keys: Sequence[str], ident: str, ends: Column, *, longest_seconds: float):
        super().__init__(keys, {"ident": F.col(ident).cast("long"), "ends": (F.unix_micros(ends.cast("timestamp")))}, "ident long, event string, at long")
        self.waits = "ident long, ends long"
        self.horizon = longest_seconds

    def fold(self, rows, passed):
        ident, ends, since = self.kept.get() if self.kept.exists() else (None, None, None)
        answers = []

        def ended(before: int) -> bool:
            return ident is not None and ends < before

        for t, new, until in rows:
            if ended(t):
                answers.append((ident, "expired", ends))
            elif ident is not None:
                answers.append((ident, "replaced", t))
            ident, ends, since = new, until, t
            answers.append((ident, "opened", t))
        if ended(passed):
            answers.append((ident, "expired", ends))
            ident = None
        if ident is None:
            self.kept.clear()
            return answers, None
        self.kept.update((ident, ends, since))
        return answers, ends + 1


def run_keyed(stream: DataFrame, step: KeyedStep, time: str, folder: str, *, lateness_seconds: float, close: bool = False, buckets: int = BUCKETS) -> Ran:
    """Run a keyed step over what a stream holds now, into tables under ``folder``.

    Rows with a null time or key are left out. ``lateness_seconds`` says how far behind the newest time of earlier
    batches a row may come; later ones go to the late table. With ``close`` the stream ends here: a last row far ahead
    lets every waiting answer out. Running again on the same folder goes on where the last run ended, and needs the
    same number of ``buckets``.
    """
    spark = stream.sparkSession
    lateness = int(lateness_seconds * 1_000) * 1_000
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    rows = stream.select(*step.keys, *[c.alias(n) for n, c in step.columns.items()], micros.alias("at_us"), F.lit(False).alias("closing_row"))
    rows = rows.where(" AND ".join(f"`{k}` IS NOT NULL" for k in [*step.keys, "at_us"]))
    schema = T.StructType([*rows.schema.fields, T.StructField("batch", T.IntegerType()), T.StructField("late", T.BooleanType())])
    marks = "batch int, rows long, late long, newest long"

    def marked(number: int):
        try:
            return spark.read.schema(marks).parquet(f"{folder}/marks/{number}").first()
        except AnalysisException:
            return None

    def split(batch: DataFrame, number: int) -> None:
        if marked(number) is None:
            before = marked(number - 1)
            newest = None if before is None else before.newest
            late = F.lit(False) if newest is None else F.col("at_us") <= newest // 1000 * 1000 - lateness
            seen = Observation()
            flagged = batch.withColumn("late", late).observe(seen, F.count("*").alias("n"), F.sum(F.col("late").cast("long")).alias("late"), F.max("at_us").alias("newest"))
            flagged.write.mode("overwrite").partitionBy("late").parquet(f"{folder}/split/batch={number}")
            got = seen.get
            newest = max((x for x in (newest, got["newest"]) if x is not None), default=None)
            spark.createDataFrame([(number, got["n"], got["late"] or 0, newest)], marks).coalesce(1).write.mode("overwrite").parquet(f"{folder}/marks/{number}")
        _advance(spark, step, schema, folder, lateness, buckets)

    splitting = rows.writeStream.foreachBatch(split).option("checkpointLocation", f"{folder}/splitting").trigger(availableNow=True).start()
    splitting.awaitTermination()
    counts = spark.read.schema(marks).parquet(f"{folder}/marks/*")
    if close:
        newest = counts.agg(F.max("newest")).first()[0] or 0
        end = newest + lateness + int(step.horizon * 1_000_000) + 1_000_000
        types = T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields if f.name not in ("batch", "late")])
        last = tuple({"at_us": end, "closing_row": True}.get(f.name, _any_value(f.dataType) if f.name in step.keys else None) for f in types.fields)
        spark.createDataFrame([last], types).coalesce(1).write.mode("overwrite").parquet(f"{folder}/split/batch={CLOSING}/late=false")
        _advance(spark, step, schema, folder, lateness, buckets)
    out = spark.read.schema(_out_schema(step, schema)).parquet(f"{folder}/out")
    return Ran(out, spark.read.schema(schema).parquet(f"{folder}/split").where("late"), counts)


def _any_value(kind: T.DataType):
    """Some value of a key's type, for the closing row."""
    return "" if isinstance(kind, T.StringType) else 0


def _out_schema(step: KeyedStep, schema: T.StructType) -> T.StructType:
    return T.StructType([*[schema[k] for k in step.keys], *T._parse_datatype_string(step.out).fields])


def _advance(spark, step: KeyedStep, schema: T.StructType, folder: str, lateness: int, buckets: int) -> None:
    """Bring the stateful query up to the last split."""
    kept = spark.readStream.schema(schema).parquet(f"{folder}/split").where("NOT late").drop("batch", "late")
    timed = kept.withColumn("event_time", F.timestamp_micros("at_us")).withWatermark("event_time", f"{lateness // 1000} milliseconds")
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        dealt = timed.withColumn("key_bucket", F.pmod(F.xxhash64(*step.keys), F.lit(buckets)).cast("int"))
        answers = dealt.groupBy("key_bucket").transformWithStateInPandas(step, _out_schema(step, schema), "append", "EventTime")
        q = (answers.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
             .trigger(availableNow=True).start())
    finally:
        spark.conf.set(PROVIDER, before)
    q.awaitTermination()
