"""Latest rows, expiry, jumps, first occurrences, look-ahead, ranks and set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.core import c, pair_high, pair_low, seconds, ts
from ..functions.neighbours import neighbour
from .filters import physical_limit_ok


def latest_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, out: str = "rank") -> DataFrame:
    """First ``n`` rows per key. A row-number limit is cut before the shuffle, so a
    hot key sends ``n`` rows per task only."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= n)


def latest_per(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The latest row per key, as one aggregate; null times lose."""
    rank = F.struct(*[F.col(o) for o in order])
    return df.groupBy(*keys).agg(F.max_by(F.struct(*values), rank).alias("__r")).select(*keys, "__r.*")


# Seconds after which an open context ends, by type; others end after two hours.
APPROVAL_TYPES = ("veto_window", "approval_window", "pending_approval", "interaction_alert", "new_med")
CONTEXT_SECONDS = {**{t: 180 for t in APPROVAL_TYPES}, "appointment_confirm": 72 * 3600, "appointment_draft": 2 * 3600}
DEFAULT_CONTEXT_SECONDS = 120 * 60


def context_expiry(kind: str | Column, created: str | Column, explicit: str | Column) -> Column:
    """When an open context ends; an explicit time wins."""
    span = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in CONTEXT_SECONDS.items() for x in kv]), c(kind)),
                      F.lit(DEFAULT_CONTEXT_SECONDS))
    return F.coalesce(c(explicit), c(created) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), span.cast("decimal(18,6)")))


def open_context(tasks: DataFrame, contact: str, kind: str, created: str, explicit: str, ident: str, as_of) -> DataFrame:
    """Latest open context of each contact and whether it still holds."""
    last = latest_per(tasks, [contact], [created, ident], [ident, kind, created, explicit])
    end = context_expiry(kind, created, explicit)
    return last.withColumns({"expires_at": end, "active": end >= ts(as_of)})


JUMP_FACTOR = 5.0  # fixed value


def value_jumps(rows: DataFrame, keys: Sequence[str], order: Sequence[str], test: str, value: str, *,
                factor: float = JUMP_FACTOR) -> DataFrame:
    """``limit`` outside physical limits, ``jump`` beyond the factor of the value before, else ``ok``."""
    prev = neighbour(rows, keys, order, [value], "__prev").withColumn("previous", F.col("__prev")[value])
    v, p = F.col(value), F.col("previous")
    jump = (p > 0) & (v > 0) & (F.greatest(v / p, p / v) > factor)
    state = F.when(~physical_limit_ok(test, value), "limit").when(F.coalesce(jump, F.lit(False)), "jump").otherwise("ok")
    return prev.drop("__prev").withColumn("state", state)


def lines_of(text: str | Column) -> Column:
    return F.split(c(text), "\r\n|\r|\n")


def dedupe_key(line: Column) -> Column:
    """Line without case, punctuation and extra space, for comparing lines."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " "), " +", " "))


def first_occurrences(docs: DataFrame, doc: str, lines: Column, key=dedupe_key) -> DataFrame:
    """Each document's lines without later repeats, in order.

    Repeats fold by ``min`` per (document, key) before the shuffle; empty keys go.
    """
    each = docs.select(doc, F.posexplode(lines).alias("pos", "line")).withColumn("__key", key(F.col("line"))).where("__key <> ''")
    kept = each.groupBy(doc, "__key").agg(F.min(F.struct("pos", "line")).alias("__f"))
    return kept.select(doc, "__f.pos", "__f.line")


def line_lookahead(docs: DataFrame, doc: str, lines: Column, name_of, *, span: int = 4,
                   unit_pattern: str = r"(?i)(mg/dl|g/dl|/cumm|cumm|lakhs/cumm|mill/cumm|ml/min|u/l|iu/l|fl|pg|%|ratio|ng/dl|uiu/ml)") -> DataFrame:
    """Vertical tables: a name line, its value in the next lines, then flag, unit and range.

    ``name_of(line)`` gives the canonical name or null. Everything happens inside
    the document's own line array, so nothing is shuffled.
    """
    arr = docs.select(doc, lines.alias("__l")).withColumn("__n", F.transform("__l", name_of))
    each = (arr.select(doc, "__l", "__n", F.posexplode("__n").alias("pos", "test_name")).where("test_name IS NOT NULL"))
    nxt = F.slice("__l", F.col("pos") + 2, span)
    names = F.slice("__n", F.col("pos") + 2, span)
    each = each.withColumns({"__after": nxt, "__names": names})
    stop = _first_index("__names", lambda x: x.isNotNull(), span)
    number = r"^[<>]?\s*(\d+(?:\.\d+)?)$"
    at = _first_index("__after", lambda x: F.trim(x).rlike(number), span)
    each = each.withColumns({"__stop": stop, "__at": at}).where("__at < __stop AND __at < size(__after)")
    each = each.withColumn("value", F.regexp_extract(F.trim(F.get("__after", F.col("__at"))), number, 1).cast("double"))
    start = F.col("pos") + F.col("__at") + 3
    tail, tail_names = F.slice("__l", start, span), F.slice("__n", start, span)
    each = each.withColumns({"__tail": tail, "__tn": tail_names})
    each = each.withColumn("__tail", F.slice("__tail", 1, _first_index("__tn", lambda x: x.isNotNull(), span)))
    flags = F.filter("__tail", lambda x: F.trim(x).rlike("^[HLhl]$"))
    units = F.filter("__tail", lambda x: x.rlike(unit_pattern) & ~F.trim(x).rlike("^[HLhl]$"))
    rest = F.filter("__tail", lambda x: ~F.trim(x).rlike("^[HLhl]$") & (~x.rlike(unit_pattern) | (x != F.get(units, 0))))
    ranges = F.filter(rest, lambda x: x.rlike(r"\d+(?:\.\d+)?\s*[-–]\s*\d+(?:\.\d+)?"))
    last = F.get(ranges, F.size(ranges) - 1)
    pat = r"(\d+(?:\.\d+)?)\s*[-–]\s*(\d+(?:\.\d+)?)"
    return each.select(doc, "pos", "test_name", "value", F.trim(F.get(units, 0)).alias("unit"),
                       F.upper(F.trim(F.get(flags, F.size(flags) - 1))).alias("flag"),
                       F.nullif(F.regexp_extract(last, pat, 1), F.lit("")).cast("double").alias("low"),
                       F.nullif(F.regexp_extract(last, pat, 2), F.lit("")).cast("double").alias("high"))


def _first_index(array: str, test, span: int) -> Column:
    """Zero-based index of the first element that passes, ``span`` when none does."""
    marks = F.transform(F.col(array), lambda x, i: F.when(test(x), i).otherwise(span))
    return F.coalesce(F.array_min(marks), F.lit(span))


def negation_near(text: str | Column, keywords: Sequence[str], negations: Sequence[str], window: int = 4) -> Column:
    """A keyword with a negation word within ``window`` tokens on either side: one
    pass of one pattern over the text with its tokens spaced singly."""
    spaced = F.concat(F.lit(" "), F.regexp_replace(F.lower(c(text)), "[^a-z0-9]+", " "), F.lit(" "))
    return spaced.rlike(negation_pattern(keywords, negations, window))


def negation_pattern(keywords: Sequence[str], negations: Sequence[str], window: int = 4) -> str:
    words = [" ".join("".join(ch if ch.isalnum() else " " for ch in k.lower()).split()) for k in keywords]
    kw, neg = "|".join(words), "|".join(negations)
    gap = f"(?: [a-z0-9]+){{0,{window - 1}}}"
    return f" (?:{neg}){gap} (?:{kw}) | (?:{kw}){gap} (?:{neg}) "


def new_pairs(items: DataFrame, known: DataFrame, entity: str, item: str, time: str, *, cap: int = 10) -> DataFrame:
    """Up to ``cap`` pairs per item with the entity's earlier items, newest first,
    that are not in ``known`` (columns low, high).

    Items are ranked per entity after folding repeats. An item then asks only for
    the next ``cap`` ranks plus as many as its known partners could take away, so
    the answer is exact without forming all pairs.
    """
    held = items.select(F.col(entity), F.lower(F.trim(F.col(item))).alias("item"), F.col(time).alias("__t")) \
        .groupBy(entity, "item").agg(F.max("__t").alias("__t"))
    w = W.partitionBy(entity).orderBy(F.col("__t").desc(), "item")
    ranked = held.withColumn("__rk", F.row_number().over(w))
    sizes = ranked.groupBy(entity).agg(F.max("__rk").alias("__size"))
    pairs = known.select("low", "high").distinct()
    degree = (pairs.select(F.explode(F.array("low", "high")).alias("item")).groupBy("item")
              .agg(F.count("*").alias("__deg")))
    asks = (ranked.join(sizes, entity).join(degree, "item", "left")
            .withColumn("__upto", F.least(F.col("__size"), F.col("__rk") + cap + F.coalesce("__deg", F.lit(0))))
            .where("__upto > __rk")
            .select(entity, "item", "__rk", F.explode(F.sequence(F.col("__rk") + 1, F.col("__upto").cast("int"))).alias("__prk")))
    partner = ranked.select(entity, F.col("__rk").alias("__prk"), F.col("item").alias("partner"))
    cand = (asks.join(partner, [entity, "__prk"])
            .withColumns({"low": pair_low("item", "partner"), "high": pair_high("item", "partner")})
            .join(pairs, ["low", "high"], "left_anti"))
    out = W.partitionBy(entity, "item").orderBy("__prk")
    return (cand.withColumn("rank", F.row_number().over(out)).where(F.col("rank") <= cap)
            .select(entity, "item", "partner", "rank"))


def named_or_newest(requests: DataFrame, rows: DataFrame, request_key: str, row_key: str, text: str, name: str,
                    order: Sequence[Column], values: Sequence[str], *, newest: int = 5, keep: int = 3) -> DataFrame:
    """Of an entity's newest rows keep those the request text names, else the newest few.

    The rows fold to at most ``newest`` per entity first, so a request meets one
    short list and the choice is made in place.
    """
    cut = latest_n(rows, [row_key], order, newest, "__rn")
    packed = cut.groupBy(row_key).agg(F.array_sort(F.collect_list(F.struct("__rn", name, *values))).alias("__rows"))
    j = requests.join(packed, requests[request_key] == packed[row_key])
    low = F.lower(F.col(text))
    named = F.filter("__rows", lambda r: low.contains(F.lower(r[name])))
    chosen = F.slice(F.when(F.size(named) > 0, named).otherwise(F.col("__rows")), 1, keep)
    return j.withColumn("__pick", F.explode(chosen)).select(
        *[requests[x] for x in requests.columns], F.col(f"__pick.{name}").alias(name),
        *[F.col(f"__pick.{v}").alias(v) for v in values])


# --- orders, limits, sets -----------------------------------------------------------------

def top_by(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """Top-k report: Spark keeps the best ``n`` per task, then merges."""
    return df.orderBy(*order).limit(n)


def due_batch(df: DataFrame, due: Column, order: Sequence[Column], n: int) -> DataFrame:
    return top_by(df.where(due), order, n)


def sort_findings(findings: str | Column, severity: str = "severity") -> Column:
    """Findings array by severity, strongest first, equal ones in given order."""
    from .aggregates import severity_rank
    ranked = F.transform(c(findings), lambda x, i: F.struct((-severity_rank(x[severity])).alias("r"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(ranked), lambda x: x["x"])


def preferred(df: DataFrame, keys: Sequence[str], rank: Column, tie: str, values: Sequence[str]) -> DataFrame:
    """First preferred row per key by role rank."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*values), F.struct(rank.alias("r"), F.col(tie).alias("t"))).alias("__p")) \
        .select(*keys, "__p.*")


def union_distinct(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def union_findings(shape: Mapping[str, str], *parts: DataFrame) -> DataFrame:
    """Stack finding lists of different shapes into one."""
    out = None
    for p in parts:
        cols = [(F.col(n) if n in p.columns else F.lit(None)).cast(t).alias(n) for n, t in shape.items()]
        out = p.select(*cols) if out is None else out.unionByName(p.select(*cols))
    return out


def missing_from(required: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    return required.select(*keys).distinct().join(present.select(*keys).distinct(), list(keys), "left_anti")
