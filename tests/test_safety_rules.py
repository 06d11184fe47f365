"""Rule joins, renal bands, conditions, votes, evidence and gates on invented rows."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vitalloom.operators import aggregates as a
from vitalloom.operators import documents as d
from vitalloom.operators import joins as j
from vitalloom.operators import windows as w
from vitalloom.plans import safety


def test_aspirin_and_warfarin_are_critical_either_way_round(rows):
    rules = j.canonical_rules(rows([("Warfarin", "aspirin", "critical"), ("aspirin", "warfarin", "low")], "drug_a string, drug_b string, severity string"))
    items = rows([(1, "aspirin"), (1, "WARFARIN"), (2, "aspirin"), (2, "metformin")], "e int, item string")
    got = j.flagged_pairs(items, rules, "e", "item").collect()
    assert [tuple(r) for r in got] == [(1, "aspirin", "warfarin", "critical")]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 3), st.sampled_from("abcdef")), min_size=1, max_size=20),
       st.lists(st.tuples(st.sampled_from("abcdef"), st.sampled_from("abcdef")), min_size=1, max_size=6))
def test_flagged_pairs_equal_brute_force_and_are_symmetric(rows, held, pairs):
    items = rows(held, "e int, item string")
    def run(ps):
        rules = j.canonical_rules(rows([(x, y, "high") for x, y in ps], "drug_a string, drug_b string, severity string"))
        return {tuple(r)[:3] for r in j.flagged_pairs(items, rules, "e", "item").collect()}
    want = {(e, min(x, y), max(x, y)) for e, i in held for x, y in pairs for e2, k in held if x != y and e == e2 and i == x and k == y}
    assert run(pairs) == want == run([(y, x) for x, y in pairs])


def test_pairs_of_large_and_small_sets(rows):
    rules = j.canonical_rules(rows([("a", "b", "high"), ("c", "d", "low"), ("a", "z", "low")], "drug_a string, drug_b string, severity string"))
    items = rows([(1, q) for q in "abcd"] + [(2, q) for q in "ab"] + [(3, "a")], "e int, item string")
    got = {tuple(r)[:3] for r in j.flagged_pairs(items, rules, "e", "item").collect()}
    assert got == {(1, "a", "b"), (1, "c", "d"), (2, "a", "b")}


def test_pairs_do_not_pass_through_all_rules_of_a_component(spark, rows):
    """Each of 400 entities holds 3 of 60 components that all have rules with each other: few pairs, many rules."""
    names = [f"n{i:02d}" for i in range(60)]
    rules = j.canonical_rules(rows([(x, y, "low") for x in names for y in names if x < y], "drug_a string, drug_b string, severity string"))
    items = rows([(e, names[(e * 7 + k * 11) % 60]) for e in range(400) for k in range(3)], "e int, item string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the final plan then holds its counts
    try:
        got = j.flagged_pairs(items, rules, "e", "item")
        assert got.count() == 1200
        executed = got._jdf.queryExecution().executedPlan()
        got._jdf.queryExecution().toRdd().count()
        seen, most = [executed], 0
        while seen:
            plan = seen.pop()
            if "Join" in plan.nodeName() and plan.metrics().contains("numOutputRows"):
                most = max(most, plan.metrics().apply("numOutputRows").value())
            seen += [plan.children().apply(i) for i in range(plan.children().size())]
        assert 1200 <= most <= 400 * 9
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_item_names_split_before_normalising(rows):
    df = rows([("Tab. Ecosprin AV 75 mg",), ("Telma-AM",), ("aspirin+atorvastatin",), ("Zyx 10mg",)], "n string")
    got = [r[0] for r in df.select(d.components("n")).collect()]
    assert got[0] == ["aspirin", "atorvastatin"] or got[0] == ["aspirin"]
    assert got[1] == ["telmisartan", "amlodipine"]
    assert got[3] == ["zyx"]


def test_own_row_is_not_its_duplicate(rows):
    items = rows([(1, "a", "aspirin", "dr x"), (2, "b", "aspirin", ""), (2, "c", "aspirin", "dr y"), (3, "d", "a+b", ""), (3, "e", "b+c", "")],
                 "e int, id string, item string, rx string")
    got = {r["id"]: (r["finding"], r["severity"]) for r in j.duplicate_or_overlap(items, "e", "id", "item", "rx", F.split("item", r"\+")).collect()}
    assert got == {"b": ("duplicate", "high"), "c": ("duplicate", "medium"), "d": ("overlap", "medium"), "e": ("overlap", "medium")}


def test_renal_bands_missing_marker_and_fallback(rows):
    items = rows([(1, "metformin"), (2, "metformin"), (3, "digoxin"), (4, "x"), (5, "x")], "e int, item string")
    rules = rows([("metformin", 60.0, 45.0, 30.0, "medium")], "item string, advisory_egfr double, warning_egfr double, critical_egfr double, default_severity string")
    markers = rows([(1, 25.0), (3, 50.0), (5, 55.0)], "e int, egfr double")
    flags = rows([(4, True), (5, True)], "e int, has_renal boolean")
    got = {r["e"]: (r["finding"], r["severity"]) for r in j.renal_findings(items, rules, markers, flags, entity="e", item="item").collect()}
    assert got == {1: ("renal_clearance_warning", "critical"), 2: ("renal_context_missing", "high"), 3: ("renal_clearance_warning", "high"),
                   4: ("renal_context_missing", "high"), 5: ("renal_condition_context", "medium")}


def test_condition_rules_and_allergy(rows):
    df = rows([("warfarin", "bleeding ulcer"), ("warfarin", "pregnancy"), ("penicillin", "allergy: penicillin"), ("zinc", "allergy: penicillin")], "i string, c string")
    got = {(r["i"], r["rule"], r["severity"]) for r in j.condition_findings(df, "i", "c", ["i"]).collect()}
    assert got == {("warfarin", "bleeding_condition_rule", "high"), ("warfarin", "pregnancy_condition_rule", "critical"),
                   ("penicillin", "allergy_condition_rule", "critical")}


def test_votes_raise_but_never_lower(rows):
    pairs = rows([("a", "b", "low"), ("a", "c", "critical"), ("a", "d", None)], "x string, y string, s string")
    votes = rows([("b", "a", "vetoed")] * 4 + [("a", "b", "approved")] + [("a", "c", "approved")] * 5 + [("d", "a", "vetoed")] * 2, "x string, y string, o string")
    got = {r["y"]: r["learned_severity"] for r in a.escalate_by_votes(pairs, votes, "x", "y", "s", "o").collect()}
    assert got == {"b": "critical", "c": "critical", "d": "none"}


def test_verification_levels(rows):
    rules = rows([(1, 0.6), (2, 0.5), (3, 0.9), (4, None)], "k int, c double")
    ev = rows([(1, "rxnav", "ok", 1), (2, "pubmed", "ok", 2), (3, "rxnav", "no_data", 0)], "k int, s string, st string, n int")
    got = {r["k"]: (r["confidence_score"], r["verification_status"]) for r in a.verify_rules(rules, ev, ["k"], "s", "st", "n", "c", ["rxnav"], ["pubmed"]).collect()}
    assert got == {1: (0.88, "live_verified"), 2: (0.7, "review_required"), 3: (0.55, "review_required"), 4: (0.55, "review_required")}


def test_gates_need_every_source_and_summary(rows):
    df = rows([(1, ["local_drug_interactions", "rxnav", "openfda"], "why"), (2, ["rxnav"], "why"), (3, ["local_drug_interactions", "rxnav", "openfda"], "")],
              "k int, tried array<string>, why string")
    out = a.safety_gates(df, evidence=F.lit(True), context=F.lit(True), attempted=F.col("tried"), summary=[F.lit("r"), F.col("why"), F.lit("d")],
                         conditions=F.lit(True), severity=F.lit("high"), confidence=F.lit(0.9))
    got = {r["k"]: (r["tool_ledger"], r["three_part_summary"], r["all_passed"]) for r in out.collect()}
    assert got == {1: (True, True, True), 2: (False, True, False), 3: (True, False, False)}


@pytest.mark.parametrize("passed,conf,sev,want", [(False, .9, "high", "gates_failed"), (True, .7, "high", "low_confidence"), (True, .8, "none", "no_interaction"),
                                                  (True, .8, "critical", "pending_human_approval"), (True, .8, "high", "pending_veto"), (True, .8, "low", "severity_not_promotable")])
def test_promotion(spark, passed, conf, sev, want):
    got = spark.range(1).select(a.promotion_state(F.lit(passed), F.lit(conf), F.lit(sev))).first()[0]
    assert got == want


def test_new_pairs_equal_brute_force(rows):
    import random
    rng = random.Random(3)
    held = [(e, rng.choice("abcdefghij"), rng.randint(1, 50)) for e in (1, 2, 3) for _ in range(12)]
    known = {tuple(sorted(rng.sample("abcdefghij", 2))) for _ in range(12)}
    got = {(r["e"], r["item"], r["partner"], r["rank"]) for r in w.new_pairs(
        rows(held, "e int, i string, t int"), rows(sorted(known), "low string, high string"), "e", "i", "t", cap=2).collect()}
    want = set()
    for e in (1, 2, 3):
        latest = {}
        for e2, i, t in held:
            if e2 == e:
                latest[i] = max(latest.get(i, 0), t)
        order = sorted(latest, key=lambda i: (-latest[i], i))
        for n, i in enumerate(order):
            new = [p for p in order[n + 1:] if tuple(sorted((i, p))) not in known][:2]
            want |= {(e, i, p, r + 1) for r, p in enumerate(new)}
    assert got == want


def test_totals_and_completeness(rows):
    log = rows([("p", "sent"), ("p", "suppressed")], "p string, s string")
    assert tuple(a.filtered_counts(log, ["p"], {"count": F.lit(True), "sent": F.col("s") == "sent"}).first()) == ("p", 2, 1)
    full = {i: F.lit(False) for i, _ in a.CARD_PENALTIES}
    cols = a.completeness({**full, "missing_doctor_phone": F.lit(True), "missing_hospital_phone": F.lit(None).cast("boolean")})
    got = log.limit(1).select(cols["score"], cols["band"], cols["issues"]).first()
    assert tuple(got) == (75, "usable_needs_review", ["missing_doctor_phone", "missing_hospital_phone"])


def test_herb_join_needs_both_sides_unless_loose(rows):
    herbs = rows([("Ginkgo", "warfarin", "high")], "herb_name string, drug_name string, severity string")
    pairs = rows([("warfarin", "ginkgo"), ("warfarin", "zinc")], "a string, b string")
    strict = {(r["b"], r["severity"]) for r in j.herb_matches(pairs, herbs, "a", "b").collect()}
    loose = {(r["b"], r["severity"]) for r in j.herb_matches(pairs, herbs, "a", "b", loose=True).collect()}
    assert strict == {("ginkgo", "high"), ("zinc", None)}
    assert loose == {("ginkgo", "high"), ("zinc", "high")}


def shuffled_rows(spark):
    """Rows that the session's stages have written for shuffles so far."""
    context = spark.sparkContext
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_safety_findings_deal_the_items_once(spark, rows):
    """3,000 entities with 3 items each: what is shuffled stays near the items and the tables by entity."""
    names = [f"n{i:02d} m{i % 5}" for i in range(40)]
    items = rows([(e, k, names[(e * 7 + k * 11) % 40], "dr" if e % 2 else " ") for e in range(3000) for k in range(3)], "e long, i int, item string, rx string")
    rules = rows([(x, y, "low") for x in names for y in names if x < y], "drug_a string, drug_b string, severity string")
    by_entity = {"markers": rows([(e, 40.0) for e in range(3000)], "e long, egfr double"), "renal_flags": rows([(e, False) for e in range(3000)], "e long, has_renal boolean"),
                 "conditions": rows([(e, "ulcer") for e in range(3000)], "e long, cond string")}
    votes = rows([(names[0], names[11], "vetoed")] * 3, "drug_a string, drug_b string, outcome string")
    renal = rows([(names[0], 60.0, 45.0, 30.0, "medium")], "item string, advisory_egfr double, warning_egfr double, critical_egfr double, default_severity string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
    try:
        before = shuffled_rows(spark)
        got = safety.safety_findings(items, rules, votes, renal, **by_entity, entity="e", ident="i", item="item", prescriber="rx",
                                     components=F.split("item", " "), condition="cond", condition_rules=[("r", (names[1],), ("ulcer",), "high")])
        kinds = {(r.type, r.severity): r["count"] for r in got.groupBy("type", "severity").count().collect()}
        assert kinds[("drug_interaction", "critical")] + kinds[("drug_interaction", "low")] == 9000
        assert kinds[("r", "high")] == sum(n == names[1] for e in range(3000) for n in {names[(e * 7 + k * 11) % 40] for k in range(3)})
        assert shuffled_rows(spark) - before < 9000 + 3 * 3000 + 4000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


@pytest.mark.parametrize("few", [2, 32])
def test_distinct_items_of_an_entity_give_the_findings_of_their_rows(rows, monkeypatch, few):
    """Against the operators over rows, with entities above and below the bound, null items and blank prescribers."""
    monkeypatch.setattr(j, "FEW", few)
    names = ["a b", "B c", "d", None, "e f", "f g", "a b ", "", "h"]
    items = rows([(None if e == 5 else e, e * 100 + k, names[(e * k + k // 3) % 9], ["x", None, " "][(e + k) % 3]) for e in range(9) for k in range(e + 1)], "e long, i int, item string, rx string")
    rules = j.canonical_rules(rows([(x, y, "high") for x in names for y in names if x and y and x < y], "drug_a string, drug_b string, severity string"))
    held = j.held_once(items, "e", "item", "rx")
    assert sorted(map(tuple, j.flagged_pairs_held(held, rules, "e", "item").collect())) == sorted(map(tuple, j.flagged_pairs(items, rules, "e", "item").collect()))
    want = j.duplicate_or_overlap(items, "e", "i", "item", "rx", F.split("item", " ")).select("e", "item", "finding", "severity").distinct()
    got = j.duplicates_held(held, "e", "item", F.split("item", " "))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 10
