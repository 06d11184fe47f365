"""Sinks and snapshot algebra: append, upsert, guarded transition, cascade, supersede.

Spark tables are immutable files, so every change yields a new snapshot
DataFrame; write it beside the old one and swap. Never read and overwrite one
path in a single plan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import c, nonblank, ts
from ..functions.neighbours import neighbour


def append_facts(df: DataFrame, path: str, *, as_of=None, time_col: str = "recorded_at",
                 date_col: str = "recorded_date") -> None:
    """Append facts with a time stamp, partitioned by its day; a heavy day is split by size, light ones are not."""
    stamped = df if time_col in df.columns else df.withColumn(time_col, ts(as_of))
    (stamped.withColumn(date_col, F.to_date(time_col))
     .hint("rebalance", date_col)
     .write.mode("append").partitionBy(date_col).parquet(path))


def stream_append(stream: DataFrame, path: str, checkpoint: str, *, time_col: str,
                  date_col: str = "recorded_date", available_now: bool = True):
    """Streaming twin of :func:`append_facts`."""
    writer = (stream.withColumn(date_col, F.to_date(time_col))
              .writeStream.format("parquet").option("path", path)
              .option("checkpointLocation", checkpoint).partitionBy(date_col))
    return writer.trigger(availableNow=True).start() if available_now else writer.start()


# --- upsert -----------------------------------------------------------------

POLICIES = ("overwrite", "keep", "coalesce", "keep_if_status", "append", "or", "increment")


def upsert(base: DataFrame, updates: DataFrame, keys: Sequence[str], order: str,
           policies: Mapping[str, str | tuple], *, do_nothing: bool = False) -> DataFrame:
    """New snapshot of ``base`` after all ``updates``, one policy per column.

    ``overwrite`` takes the latest update; ``keep`` is set once (stored value wins,
    else the earliest update); ``coalesce`` takes the latest non-null update;
    ``("keep_if_status", col, statuses)`` keeps the stored value while the stored
    status is listed; ``append`` adds absent array items; ``or`` and ``increment``
    fold booleans and counters. ``do_nothing`` leaves existing rows alone.
    Several updates of a key are folded map-side first, so replaying a batch of
    set-like policies changes nothing and a hot key costs one row.
    """
    folds = {}
    for col, policy in policies.items():
        kind = policy if isinstance(policy, str) else policy[0]
        if kind not in POLICIES:
            raise ValueError(f"unknown policy {kind!r} for {col}")
        value = F.col(col)
        folds[col] = {
            "overwrite": F.max_by(value, order),
            "keep_if_status": F.max_by(value, order),
            "coalesce": F.max_by(value, F.when(value.isNotNull(), F.col(order))),
            "keep": F.min_by(value, F.when(value.isNotNull(), F.col(order))),
            "append": F.array_sort(F.array_distinct(F.flatten(F.collect_set(value))))
            if kind == "append" else None,
            "or": F.bool_or(value) if kind == "or" else None,
            "increment": F.sum(value) if kind == "increment" else None,
        }[kind].alias(f"__u_{col}")
    fresh = updates.groupBy(*keys).agg(*folds.values(), F.lit(True).alias("__u"))
    both = base.withColumn("__b", F.lit(True)).join(fresh, list(keys), "full_outer")
    stored = F.col("__b").isNotNull()
    touched = F.col("__u").isNotNull()
    out = {}
    for col in base.columns:
        if col in keys:
            out[col] = F.col(col)
            continue
        old = F.col(col)
        if col not in policies:
            out[col] = old
            continue
        policy = policies[col]
        kind = policy if isinstance(policy, str) else policy[0]
        new = F.col(f"__u_{col}")
        if kind == "overwrite":
            merged = new
        elif kind == "coalesce":
            merged = F.coalesce(new, old)
        elif kind == "keep":
            merged = F.coalesce(old, new)
        elif kind == "keep_if_status":
            merged = F.when(F.col(policy[1]).isin(*policy[2]), old).otherwise(new)
        elif kind == "append":
            empty = F.array().cast(base.schema[col].dataType)
            merged = F.array_union(F.coalesce(old, empty), F.coalesce(new, empty))
        elif kind == "or":
            merged = F.coalesce(old, F.lit(False)) | F.coalesce(new, F.lit(False))
        else:
            merged = F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0))
        changed = F.when(stored, old if do_nothing else merged).otherwise(new)
        out[col] = F.when(touched, changed).otherwise(old)
    return both.select(*[e.alias(n) for n, e in out.items()])


def upsert_pairs(base: DataFrame, updates: DataFrame, a: str, b: str, order: str,
                 policies: Mapping[str, str | tuple]) -> DataFrame:
    """:func:`upsert` keyed by the pair in either order."""
    def keyed(df):
        low, high = F.least(F.lower(a), F.lower(b)), F.greatest(F.lower(a), F.lower(b))
        return df.withColumns({"__low": low, "__high": high})
    keep = {a: "keep", b: "keep", **policies}
    merged = upsert(keyed(base), keyed(updates), ["__low", "__high"], order, keep)
    return merged.drop("__low", "__high")


# --- guarded transition -----------------------------------------------------

def transition(snapshot: DataFrame, requests: DataFrame, key: str, status: str, target: str,
               order: str, allowed: Mapping[str, Sequence[str]], *, as_of,
               stamps: Mapping[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Apply status requests where the current status permits them.

    ``allowed`` maps a target to the statuses it may follow; ``stamps`` maps a
    target to the time column it sets. The first request of a key counts.
    Returns the new snapshot and the request log with ``applied``.
    """
    first = requests.groupBy(key).agg(F.min_by(target, order).alias("__to"))
    both = snapshot.join(first, key, "left")
    ok = F.lit(False)
    for to, sources in allowed.items():
        ok = ok | ((F.col("__to") == to) & F.col(status).isin(*sources))
    both = both.withColumn("__ok", F.coalesce(ok, F.lit(False)))
    stamp_cols: dict[str, list[str]] = {}
    for to, col in (stamps or {}).items():
        stamp_cols.setdefault(col, []).append(to)
    changes = {status: F.when(F.col("__ok"), F.col("__to")).otherwise(F.col(status))}
    for col, targets in stamp_cols.items():
        old = F.col(col) if col in snapshot.columns else F.lit(None).cast("timestamp_ntz")
        changes[col] = F.when(F.col("__ok") & F.col("__to").isin(*targets), ts(as_of)).otherwise(old)
    log = (both.where(F.col("__to").isNotNull())
           .select(key, F.col(status).alias("from_status"), F.col("__to").alias("to_status"),
                   F.col("__ok").alias("applied")))
    unknown = (first.join(snapshot.select(key), key, "left_anti")
               .select(key, F.lit(None).cast("string").alias("from_status"),
                       F.col("__to").alias("to_status"), F.lit(False).alias("applied")))
    return both.withColumns(changes).drop("__to", "__ok"), log.unionByName(unknown)


def delete_with_cancel(owners: DataFrame, dependents: DataFrame, doomed: DataFrame, key: str,
                       reference: Column, status: str, open_statuses: Sequence[str],
                       cancelled: str = "cancelled") -> tuple[DataFrame, DataFrame]:
    """Drop ``doomed`` owners; open dependents that name one become cancelled."""
    keys = doomed.select(F.col(key).alias("__gone")).distinct()
    kept = owners.join(keys, owners[key] == keys["__gone"], "left_anti")
    hit = dependents.join(keys, reference.cast("string") == F.col("__gone").cast("string"), "left")
    new = F.when(F.col("__gone").isNotNull() & F.col(status).isin(*open_statuses), cancelled)
    return kept, hit.withColumn(status, F.coalesce(new, F.col(status))).drop("__gone")


def supersede(rows: DataFrame, keys: Sequence[str], order: Sequence[str], ident: str, *,
              slice_by: Column | None = None) -> DataFrame:
    """Close every row but a key's latest, pointing at its successor."""
    nxt = neighbour(rows, keys, order, [ident, order[0]], "__next", forward=True, slice_by=slice_by)
    return nxt.withColumns({
        "superseded_by": F.col("__next")[ident],
        "closed_at": F.col("__next")[order[0]],
        "is_current": F.col("__next").isNull(),
    }).drop("__next")


def seed_if_empty(base: DataFrame, active: Column, seed: DataFrame) -> DataFrame:
    """The table, with the seed rows added only when no active row exists.

    The check reads at most one row.
    """
    return base.unionByName(seed, allowMissingColumns=True) if base.where(active).isEmpty() else base


def append_note(old: str | Column, new: str | Column) -> Column:
    """Blank new keeps old; blank old takes new; else old, line break, new."""
    o, n = nonblank(old), nonblank(new)
    return F.when(n.isNull(), c(old)).when(o.isNull(), c(new)).otherwise(F.concat_ws("\n", c(old), c(new)))
