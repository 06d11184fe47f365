"""Candidate and document intake as table jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import VETO_SEVERITIES
from ..operators.documents import clean_extracted, document_type, is_cut, keep_words
from ..operators.extraction import item_array, item_key, lab_array, lab_rows, prescription_items
from ..operators.filters import physical_limit_ok
from ..sources.tables import new_content


def candidate_status(candidates: DataFrame, findings: DataFrame, key: str) -> DataFrame:
    """Final state of validated candidates.

    Suspicious records stop first. Any interaction holds; other findings hold only
    when high or critical and not about missing context.
    """
    holds = (F.col("type") == "drug_interaction") | (F.col("severity").isin(*VETO_SEVERITIES) & ~F.col("type").endswith("_missing"))
    per = findings.groupBy(key).agg(F.bool_or(holds).alias("__hold"))
    return candidates.join(per, key, "left").withColumn(
        "final_status", F.when(F.col("status") == "suspicious", "suspicious")
        .when(F.coalesce("__hold", F.lit(False)), "veto_required").otherwise("active")).drop("__hold")


CONFIDENCE_FLOOR = 0.70  # fixed value


def intake(arriving: DataFrame, history: DataFrame, *, owner: str, ident: str, text: str, budget: int = 1000) -> dict[str, DataFrame]:
    """New documents, typed, shortened, extracted and checked: one table per sink.

    Each text is read, typed and extracted once, inside its own row. ``documents`` has a
    row per new document with its review reason; ``labs`` and ``items`` are the
    extracted rows of the matching types. Write ``documents`` first when all three are wanted.
    """
    fresh = new_content(arriving, history, [owner], text, ident)
    typed = document_type(fresh.withColumn(text, clean_extracted(text)), text).withColumn(
        "document_type", F.when(F.col("document_type") == "unknown", "general_note").otherwise(F.col("document_type")))
    kind = F.col("document_type")
    cut = F.coalesce(*[F.when(kind == k, is_cut(text, budget, keep_words(k)))
                       for k in ("prescription", "lab_report", "discharge_summary")],
                     is_cut(text, budget, keep_words()))
    # a null text has no rows, so only those of the kind are searched
    of = lambda k: F.when(kind == k, F.col(text))
    full = typed.withColumns({"truncated": cut, "lab_values": lab_array(of("lab_report")), "medications": item_array(of("prescription"))})
    labs = F.array_distinct(F.transform("lab_values", lambda r: F.concat_ws(
        "|", F.when(physical_limit_ok(r["test_name"], r["value"]), "ok").otherwise("bad"), r["test_name"], r["value"].cast("string"), r["unit"])))
    items = F.array_distinct(F.transform(F.filter("medications", lambda r: r["item"].isNotNull()), lambda r: F.concat_ws(
        "|", item_key(r["item"]), F.coalesce(r["dose"]["value"].cast("string"), F.lit("")), F.coalesce(r["dose"]["unit"], F.lit("")),
        F.coalesce(r["frequency"], F.lit("")))))
    counted = full.withColumns({"__bad": F.size(F.filter(labs, lambda x: x.startswith("bad|"))), "extracted": F.coalesce(
        F.when(kind == "lab_report", F.size(labs)), F.when(kind == "prescription", F.size(items)), F.lit(0))})
    docs = counted.select(
        ident, owner, "document_type", "type_confidence", "truncated", "extracted", "lab_values", "medications",
        F.when(F.coalesce("__bad", F.lit(0)) > 0, "validation_errors").when(F.col("type_confidence") < CONFIDENCE_FLOOR, "low_confidence")
        .when(F.col("truncated"), "context_truncated").otherwise("").alias("review_reason"))
    return {"documents": docs, "labs": lab_rows(typed.where(kind == "lab_report"), [ident], text).withColumn(
        "accepted", physical_limit_ok("test_name", "value")), "items": prescription_items(typed.where(kind == "prescription"), [ident], text)}
