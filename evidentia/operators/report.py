"""The report on a judged query: sentences whose every value is a computed one, a document, and its text.

A value in a sentence is a *fact*: it carries the JSON pointer of the report's field that it was taken from
and the form in which it is said, so that a reader of the report alone can find it again (``resolved``).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.operators import judgement as J

TEMPLATES = {
    "headline_green": "{headline}: the first source is of tier {tier} and the answer is accepted.",
    "headline_orange_review": "{headline}: the action is {action}, so an analyst looks at the answer first.",
    "headline_orange_tier": "{headline}: the first source is of tier {tier}, which is never accepted unseen.",
    "headline_red_attack": "{headline}, attack detected: case {case_id} on a source of tier {tier}; the document is in question.",
    "headline_red_compromise": "{headline}, trusted source in doubt: case {case_id} on a source of tier {tier}; the source is in question.",
    "signal_over_malicious": "{signal} is {value} on document {doc_id}, {margin} from the malicious threshold {threshold}.",
    "signal_over_suspicious": "{signal} is {value} on document {doc_id}, {margin} from the suspicious threshold {threshold}.",
    "signal_below": "{signal} is at most {value}, below its suspicious threshold {threshold}.",
    "signal_unusable": "{signal} decides nothing, as it has no threshold ({reason}).",
    "signal_missing": "{signal} was not measured, which is not the same as nothing found.",
    "no_signal_fired": "No signal of the {n_docs} retrieved documents reaches its suspicious threshold.",
    "composite_score": "Trust is {trust}, between {trust_low} and {trust_high}.",
    "composite_absent": "There is no risk for this answer, so there is no trust score.",
    "model_unfitted": "No model was fitted, so the cases alone decide.",
    "backend_fallback": "{n_fallback} signals ran without a model of their own: {fallbacks}.",
    "confidence_singleton": "One document carries the answer, so confidence is at most {cap}.",
    "confidence_low": "Confidence is {confidence}, below {floor}, so an analyst looks at it in any case.",
    "confidence_high": "Confidence is {confidence}, from {n_eff} effective documents of {n_sources} sources.",
    "reconciliation_agree": "Cases and score both ask for {action}.",
    "reconciliation_differ": "Cases ask for {case_action} and the score for {score_action}; {action} is the outcome.",
    "entities_found": "{n_entities} indicators were found in the retrieved documents.",
    "entities_none": "No indicators were found in the retrieved documents.",
}
_SLOT = re.compile(r"\{(\w+)\}")
# What a priority is worth, and what an action asks for at least.
RISK_TIERS = ["INFORMATIONAL", "LOW", "MEDIUM", "HIGH", "CRITICAL"]
PRIORITY_RISK = {"P0": 4, "P1": 3, "P2": 3, "P3": 2, "P4": 1, "P5": 0}
ACTION_RISK = {"ACCEPT": 0, "REVIEW": 2, "REJECT": 3, "ESCALATE": 4}


def numbers_in_templates() -> list[str]:
    """The templates that state a number of their own."""
    return sorted(name for name, text in TEMPLATES.items() if re.search(r"\d", _SLOT.sub("", text)))


def score(c: Column) -> Column:
    return F.format_string("%.3f", F.round(c, 3))


def percent(c: Column) -> Column:
    return F.format_string("%.1f%%", F.round(c, 1))


def delta(c: Column) -> Column:
    return F.format_string("%+.3f", F.round(c, 3))


FORMS: dict[str, Callable[[Column], Column]] = {"score": score, "percent": percent, "delta": delta, "plain": lambda c: c.cast("string")}
FACT = "array<struct<slot: string, pointer: string, form: string, said: string>>"


class Fact(NamedTuple):
    """A value of the report, where it stands there, and how it is said."""

    value: Column
    pointer: Column
    form: str = "plain"

    def said(self) -> Column:
        return F.coalesce(FORMS[self.form](self.value), F.lit("n/a"))


def field(name: str, form: str = "plain") -> Fact:
    """A field at the top of the report, which is the column of that name."""
    return Fact(F.col(name), F.lit(f"/{name}"), form)


def filled(name: str, **facts: Fact) -> Column:
    """Struct (template_id, text, facts); a slot without a fact is an error."""
    parts = _SLOT.split(TEMPLATES[name])
    if missing := sorted(set(parts[1::2]) - set(facts)):
        raise ValueError(f"{name} needs {missing}")
    used = [F.struct(F.lit(slot).alias("slot"), facts[slot].pointer.alias("pointer"), F.lit(facts[slot].form).alias("form"), facts[slot].said().alias("said")) for slot in dict.fromkeys(parts[1::2])]
    text = F.concat(*[F.lit(p) if k % 2 == 0 else facts[p].said() for k, p in enumerate(parts)])
    return F.struct(F.lit(name).alias("template_id"), text.alias("text"), (F.array(*used) if used else F.array()).cast(FACT).alias("facts"))


def report_id(query: Column, generated_at: Column) -> Column:
    return F.concat(F.lit("rpt-"), F.substr(F.sha2(F.concat(query, F.lit("|"), generated_at), 256), F.lit(1), F.lit(16)))


def risk_tier(priority: Column, action: Column) -> Column:
    """The priority's tier, raised to what the action asks for."""
    worth = lambda of, c, other: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in of.items() for x in kv]), c), F.lit(other))
    return F.get(F.array(*map(F.lit, RISK_TIERS)), F.greatest(worth(PRIORITY_RISK, priority, 3), worth(ACTION_RISK, action, 4)))


#: The order in which a document's readings are told.
TOLD = ("injection", "anomaly", "unsupport", "conflict")
#: What reads each signal, and whether that stands in for a model.
BACKENDS = {"unsupport": ("coverage of the claim's terms", True), "anomaly": ("hashed features", True), "injection": ("patterns", False), "conflict": ("difference of support", True)}


def _six(c: Column) -> Column:
    return F.round(c, 6)


def readings() -> Column:
    """Every document's reading of every signal: doc_id, signal, value, status, and the threshold that it reaches or, if
    none, the suspicious one, with the margin to it."""
    cuts = F.col("cuts")

    def one(d: Column, s: str) -> Column:
        low, high = cuts["suspicious"][s], cuts["malicious"][s]
        status = F.when(d[s].isNull(), "missing").when(low.isNull(), "unusable").when(d[s] >= high, "malicious").when(d[s] >= low, "suspicious").otherwise("below")
        to = F.when(d[s] >= high, high).otherwise(low)
        return F.struct(d["doc_id"].alias("doc_id"), F.lit(s).alias("signal"), _six(d[s]).alias("value"), status.alias("status"), _six(to).alias("threshold"), _six(d[s] - to).alias("margin"))

    return F.flatten(F.transform("docs", lambda d: F.array(*[one(d, s) for s in TOLD])))


def signals() -> Column:
    """Each signal: its largest reading, its cut points, where those come from and what read it."""
    cuts = F.col("cuts")
    return F.array(*[F.struct(
        F.lit(s).alias("signal"), _six(F.col(f"max_{s}")).alias("max"), _six(cuts["suspicious"][s]).alias("suspicious"), _six(cuts["malicious"][s]).alias("malicious"), cuts["origin"][s].alias("origin"), cuts["unusable"][s].alias("unusable"),
        F.lit(BACKENDS[s][0]).alias("backend"), F.lit(BACKENDS[s][1]).alias("fallback"),
    ) for s in J.SIGNALS])


def _fired() -> Column:
    """A sentence for each reading that reaches a threshold, in rank order."""

    def of(r: Column, i: Column) -> Column:
        at = lambda name: F.concat(F.lit("/readings/"), i.cast("string"), F.lit(f"/{name}"))
        facts = {"signal": Fact(r["signal"], at("signal")), "value": Fact(r["value"], at("value"), "score"), "doc_id": Fact(r["doc_id"], at("doc_id")), "margin": Fact(r["margin"], at("margin"), "delta"), "threshold": Fact(r["threshold"], at("threshold"), "score")}
        return F.when(r["status"] == "malicious", filled("signal_over_malicious", **facts)).when(r["status"] == "suspicious", filled("signal_over_suspicious", **facts))

    return F.array_compact(F.transform("readings", of))


def _quiet(i: int) -> Column:
    """What is said of a signal that no document brings over a threshold."""
    s = F.get("signals", F.lit(i))
    fact = lambda name, form="plain": Fact(s[name], F.lit(f"/signals/{i}/{name}"), form)
    missing, unusable = filled("signal_missing", signal=fact("signal")), filled("signal_unusable", signal=fact("signal"), reason=fact("unusable"))
    below = filled("signal_below", signal=fact("signal"), value=fact("max", "score"), threshold=fact("suspicious", "score"))
    return F.when(s["max"].isNull(), missing).when(s["suspicious"].isNull(), unusable).when(F.col(f"max_{J.SIGNALS[i]}") < F.col("cuts")["suspicious"][J.SIGNALS[i]], below)


def sentences() -> Column:
    """The report's sentences, from the columns of ``reported``."""
    c = F.col
    red = F.when(c("subtype") == "TRUSTED_SOURCE_COMPROMISE", filled("headline_red_compromise", headline=field("headline"), case_id=field("case_id"), tier=field("tier"))).otherwise(filled("headline_red_attack", headline=field("headline"), case_id=field("case_id"), tier=field("tier")))
    orange = F.when(c("action") == "REVIEW", filled("headline_orange_review", headline=field("headline"), action=field("action"))).otherwise(filled("headline_orange_tier", headline=field("headline"), tier=field("tier")))
    first = F.when(c("headline") == "RED", red).when(c("headline") == "GREEN", filled("headline_green", headline=field("headline"), tier=field("tier"))).otherwise(orange)
    limit = lambda name: Fact(c("limits")[name], F.lit(f"/limits/{name}"), "score")
    trusted = filled("composite_score", trust=field("trust", "percent"), trust_low=field("trust_low", "percent"), trust_high=field("trust_high", "percent"))
    after = [
        F.when(~c("model_fitted"), filled("model_unfitted")),
        F.when(c("trust").isNull(), filled("composite_absent")).otherwise(trusted),
        F.when(c("n_docs") == 1, filled("confidence_singleton", cap=limit("singleton"))),
        F.when(c("forced_review"), filled("confidence_low", confidence=field("confidence", "score"), floor=limit("floor"))).otherwise(filled("confidence_high", confidence=field("confidence", "score"), n_eff=field("n_eff", "score"), n_sources=field("n_sources"))),
        F.when(c("case_action") == c("score_action"), filled("reconciliation_agree", action=field("case_action"))).otherwise(filled("reconciliation_differ", case_action=field("case_action"), score_action=field("score_action"), action=field("action"))),
        F.when(c("n_fallback") > 0, filled("backend_fallback", n_fallback=field("n_fallback"), fallbacks=field("fallbacks"))),
        F.when(c("n_entities") > 0, filled("entities_found", n_entities=field("n_entities"))).otherwise(filled("entities_none")),
    ]
    none = F.when(F.size("fired") == 0, filled("no_signal_fired", n_docs=field("n_docs")))
    return F.concat(F.array(first), c("fired"), F.array_compact(F.array(none, *[_quiet(i) for i in range(len(J.SIGNALS))], *after)))


def caveats() -> Column:
    """What a reader must know of how the report came about."""
    stand_in = F.array_join(F.transform(F.filter("signals", lambda s: s["origin"] == "fallback"), lambda s: s["signal"]), ", ")
    return F.array_compact(F.array(
        F.when(F.col("n_fallback") > 0, F.concat(F.lit("Signals that stand in for a model show structure and are no measurement: "), "fallbacks", F.lit("."))),
        F.when(stand_in != "", F.concat(F.lit("Too few clean documents were read to fit the thresholds of "), stand_in, F.lit("; stand-ins were used."))),
        F.when(~F.col("answer_given"), F.lit("Support is that for the question, as no answer was given.")),
        F.when(~F.col("model_fitted"), F.lit("No fitted model: cases alone decide, and there is no trust score.")),
    ))


def reported(rows: DataFrame, generated_at: str, model_fitted: bool = True, answer_given: bool = False) -> DataFrame:
    """Adds report_id, risk_tier, sentences, caveats and report (JSON) to scored rows with cuts, query (text) and n_entities.

    All numbers are rounded to six places first, so that sentences say what the report holds.  Without a fitted model there is no risk.
    """
    risk = lambda name: _six(F.col(name)) if model_fitted else F.lit(None).cast("double")
    rows = rows.withColumns({
        "report_id": report_id(F.col("query"), F.lit(generated_at)), "generated_at": F.lit(generated_at), "risk_tier": risk_tier(F.col("priority"), F.col("action")), "readings": readings(), "signals": signals(),
        **{n: risk(n) for n in ("risk", "risk_lo", "risk_hi")}, **{n: _six(F.col(n)) for n in ("n_eff", "volume", "agreement", "independence", "coherence", "stability")},
        "limits": F.struct(F.lit(J.SINGLETON).alias("singleton"), F.lit(J.FLOOR).alias("floor")), "model_fitted": F.lit(model_fitted), "answer_given": F.lit(answer_given),
        "n_fallback": F.lit(sum(b for _, b in BACKENDS.values())), "fallbacks": F.lit(", ".join(s for s in J.SIGNALS if BACKENDS[s][1])),
    })
    rows = rows.withColumns({"trust": _six(100 * (1 - F.col("risk"))), "trust_low": _six(100 * (1 - F.col("risk_hi"))), "trust_high": _six(100 * (1 - F.col("risk_lo"))), "fired": _fired()})
    rows = rows.withColumns({"sentences": sentences(), "caveats": caveats()})
    fields = [
        "report_id", "generated_at", "query_id", "query", "headline", "subtype", "band", "rule", "case_id", "matched", "priority", "risk_tier", "action", "case_action", "score_action", "tier", "risk", "risk_lo", "risk_hi", "trust", "trust_low", "trust_high", "confidence", "forced_review", "limits",
        F.struct("volume", "agreement", "independence", "coherence", "stability").alias("confidence_components"), "n_docs", "n_eff", "n_sources", "n_tiers", "n_entities", "docs", "readings", "signals", "n_fallback", "fallbacks", "model_fitted", "answer_given", "caveats", "sentences",
        F.struct(F.lit("PENDING").alias("decision"), F.col("action").alias("recommended"), F.col("case_id").alias("case_id"), F.col("risk").alias("risk"), F.col("confidence").alias("confidence"), F.col("headline").alias("headline"), F.transform("docs", lambda d: F.struct(d["doc_id"].alias("doc_id"), F.lit(None).cast("string").alias("verdict"))).alias("documents")).alias("analyst"),
    ]
    return rows.withColumn("report", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))


#: Levels of a report below its top that facts point into.
DEPTH = 3


def walked(reports: DataFrame) -> DataFrame:
    """(query_id, pointer, value): every single value of the JSON in ``report``, by JSON pointer; its sentences are left out.

    The JSON is walked as a VARIANT, level by level.
    """
    spark = reports.sparkSession
    nodes = reports.select("query_id", F.lit("").alias("pointer"), F.parse_json("report").alias("v"))
    out = None
    for _ in range(DEPTH):
        inner = nodes.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        nodes = inner.select("query_id", F.concat("pointer", F.lit("/"), F.coalesce("key", F.col("pos").cast("string"))).alias("pointer"), F.col("value").alias("v")).where("pointer <> '/sentences'")
        single = ~F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)")
        found = nodes.where(single).select("query_id", "pointer", F.variant_get("v", "$", "string").alias("value"))
        out = found if out is None else out.unionByName(found)
        nodes = nodes.where(~single)
    return out


def resolved(reports: DataFrame) -> DataFrame:
    """One row for each fact of each sentence: query_id, place, template_id, slot, pointer, said, resolved.

    A fact is resolved if the report itself (column ``report``, JSON) has a value at its pointer which, put in the fact's form,
    is what the sentence says.
    """
    schema = f"struct<sentences: array<struct<template_id: string, text: string, facts: {FACT}>>>"
    told = reports.select("query_id", F.posexplode(F.from_json("report", schema)["sentences"]).alias("place", "s"))
    facts = told.select("query_id", "place", "s.template_id", F.explode("s.facts").alias("f")).select("query_id", "place", "template_id", "f.*")
    number = F.col("value").try_cast("double")
    again = F.col("value")
    for name in ("score", "percent", "delta"):
        again = F.when(F.col("form") == name, FORMS[name](number)).otherwise(again)
    met = facts.join(walked(reports), ["query_id", "pointer"], "left")
    return met.select("query_id", "place", "template_id", "slot", "pointer", "said", F.coalesce(F.coalesce(again, F.lit("n/a")) == F.col("said"), F.lit(False)).alias("resolved"))


def ungrounded() -> Column:
    """The numbers in a report's sentences that none of their facts says, from the column sentences."""
    numbers = lambda c: F.regexp_extract_all(c, F.lit(r"[-+]?\d+(?:\.\d+)?"), F.lit(0))
    one = lambda s: F.array_except(numbers(s["text"]), F.flatten(F.transform(s["facts"], lambda f: numbers(f["said"]))))
    return F.flatten(F.transform("sentences", one))


def markdown() -> Column:
    """The report as text, from a ``reported`` row."""
    lines = F.array_join(F.transform("sentences", lambda s: F.concat(F.lit("- "), s["text"])), "\n")
    table = lambda d: F.concat(F.lit("| "), reduce(lambda a, b: F.concat(a, F.lit(" | "), b), [d["rnk"].cast("string"), d["doc_id"].cast("string"), d["tier"].cast("string"), *[F.coalesce(score(d[s]), F.lit("n/a")) for s in J.SIGNALS]]), F.lit(" |"))
    head = "| rank | document | tier | " + " | ".join(J.SIGNALS) + " |\n|" + "---|" * (3 + len(J.SIGNALS))
    return F.concat(F.lit("# "), "headline", F.lit(": "), "action", F.lit("\n\n> "), "query", F.lit("\n\n"), "report_id", F.lit(", risk "), "risk_tier", F.lit(", case "), "case_id", F.lit("\n\n## Reasoning\n\n"), lines, F.lit(f"\n\n## Documents\n\n{head}\n"), F.array_join(F.transform("docs", table), "\n"), F.lit("\n\n## Caveats\n\n"), F.array_join(F.transform("caveats", lambda t: F.concat(F.lit("- "), t)), "\n"), F.lit("\n"))
