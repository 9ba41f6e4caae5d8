"""Bands, cases, risk, confidence and the reconciled action of a query, as expressions over its row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.operators import thresholds as T

SIGNALS = T.SIGNALS
# The cases in the order in which the first match wins, with tier, band, priority and action.
CASES = [
    ("C5", "1", "MALICIOUS", "P0", "ESCALATE"), ("C4", "1", "SUSPICIOUS", "P1", "ESCALATE"), ("C11", "any", "-", "P1", "ESCALATE"), ("C10", "1 vs 1", "-", "P2", "REVIEW"),
    ("C7", "2", "MALICIOUS", "P2", "REJECT"), ("C9", "3", "MALICIOUS", "P2", "REJECT"), ("C6", "2", "SUSPICIOUS", "P3", "REVIEW"), ("C8", "3", "SUSPICIOUS", "P3", "REJECT"),
    ("C3", "3", "CLEAN", "P3", "REVIEW"), ("C2", "2", "CLEAN", "P4", "ACCEPT"), ("C1", "1", "CLEAN", "P5", "ACCEPT"),
]
ACTIONS = ["ACCEPT", "REVIEW", "REJECT", "ESCALATE"]
# The fitted model's coefficients on standardised inputs, and its operating thresholds.
INTERCEPT, COEFFICIENTS = 0.347898, {"x_conflict": 0.350899, "is_tier1": -0.527212, "is_tier3": 0.35813}
TAU_REVIEW, TAU_REJECT = 0.129559, 0.600176
EPS, MEMBERS = 1e-3, 200
# The confidence's saturation, the exponent of agreement, its caps and its floor.
KAPPA, AGREEMENT, N_EFF_ONE, SINGLETON, FLOOR = 2.0, 1.5, 0.40, 0.30, 0.35


def _over(values: dict[str, Column], cuts: Column, names: list[str]) -> Column:
    """How many signals reach their cut; one that was not measured, or has no cut, does not."""
    return reduce(lambda a, b: a + b, [F.coalesce((values[s] >= cuts[s]).cast("int"), F.lit(0)) for s in names])


def rule(values: dict[str, Column], cuts: Column | None = None) -> Column:
    """The rule that decides a band: injection alone, two signals over their upper cut, one of them and two others
    over the lower one, any over its lower cut, or none."""
    cuts = T.provisional() if cuts is None else cuts
    upper, lower = _over(values, cuts["malicious"], SIGNALS), _over(values, cuts["suspicious"], SIGNALS)
    injected = F.coalesce(values["injection"] >= cuts["malicious"]["injection"], F.lit(False))
    return F.when(injected, "injection_alone").when(upper >= 2, "two_signals_malicious").when((upper == 1) & (lower - 1 >= 2), "one_malicious_two_suspicious").when(lower >= 1, "one_suspicious").otherwise("none_over_threshold")


def band(values: dict[str, Column], cuts: Column | None = None) -> Column:
    """MALICIOUS, SUSPICIOUS or CLEAN, as ``rule`` says; ``cuts`` are provisional if not given."""
    by = rule(values, cuts)
    return F.when(by == "none_over_threshold", "CLEAN").when(by == "one_suspicious", "SUSPICIOUS").otherwise("MALICIOUS")


def grid_case(tier: Column, of: Column) -> Column:
    """The case of a tier and a band; null for a tier that is none of 1, 2 and 3."""
    out = F.lit(None).cast("string")
    for case_id, of_tier, of_band, _, _ in CASES:
        if of_band != "-":
            out = F.when((tier == int(of_tier)) & (of == of_band), case_id).otherwise(out)
    return out


def case_field(case_id: Column, field: str) -> Column:
    place = {"priority": 3, "action": 4}[field]
    return F.element_at(F.create_map(*[F.lit(x) for c in CASES for x in (c[0], c[place])]), case_id)


def severity(action: Column) -> Column:
    """From 0 for ACCEPT to 3 for ESCALATE; null for what is no action."""
    at = F.array_position(F.array(*map(F.lit, ACTIONS)), action)
    return F.when(at > 0, at - 1)


def dominant(*actions: Column) -> Column:
    """The severest action; what is none is ignored."""
    return F.get(F.array(*map(F.lit, ACTIONS)), F.greatest(*map(severity, actions)).cast("int")) if len(actions) > 1 else F.get(F.array(*map(F.lit, ACTIONS)), severity(actions[0]).cast("int"))


def headline(action: Column, tier: Column) -> Column:
    """GREEN only for an accepted answer of tier 1; whatever is not known is ORANGE."""
    return F.when(action.isin("REJECT", "ESCALATE"), "RED").when((action == "ACCEPT") & (tier == 1), "GREEN").otherwise("ORANGE")


def subtype(action: Column, tier: Column) -> Column:
    return F.when(action.isin("REJECT", "ESCALATE"), F.when(tier == 1, "TRUSTED_SOURCE_COMPROMISE").otherwise("ATTACK_DETECTED"))


def _set_max(name: str) -> Column:
    return F.array_max(F.transform("docs", lambda d: d[name]))


def classified(rows: DataFrame) -> DataFrame:
    """Adds what the set of a query's documents (``docs``, see ``signals.measured``) says.

    tier (of the first hit), the signals' maxima (max_*), band, n_sources, n_tiers, n_eff, support
    (documents that cover half of the claim), d_conflict_max, tier1_conflict, matched (all cases in
    order of precedence) and case_id.  Cut points come from the column ``cuts`` (see ``thresholds``), and
    are provisional without it; one that is missing is never reached.
    """
    cuts = F.col("cuts") if "cuts" in rows.columns else T.provisional()
    reached = lambda kind, s, other=1.0: F.coalesce(cuts[kind][s], F.lit(other))
    weights = F.transform("docs", lambda d: F.greatest(d["score"], F.lit(0.0)))
    total = F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)
    squares = F.aggregate(weights, F.lit(0.0), lambda a, w: a + w * w)
    first_tier = F.filter("docs", lambda d: d["tier"] == 1)
    apart = F.transform(first_tier, lambda a: F.array_max(F.transform(first_tier, lambda b: F.abs(a["entailment"] - b["entailment"]))))
    rows = rows.withColumns({f"max_{s}": _set_max(s) for s in SIGNALS})
    rows = rows.withColumns({
        "tier": F.get("docs", F.lit(0))["tier"],
        "n_docs": F.size("docs"),
        "n_sources": F.size(F.array_distinct("docs.source")),
        "n_tiers": F.size(F.array_distinct("docs.tier")),
        "support": F.size(F.filter("docs", lambda d: d["entailment"] >= 0.5)),
        "d_conflict_max": F.coalesce("max_conflict", F.lit(0.0)),
        "tier1_conflict": F.coalesce(F.array_max(apart), F.lit(0.0)),
        "n_tier1": F.size(first_tier),
        "outliers": F.size(F.filter("docs", lambda d: F.coalesce(d["anomaly"], F.lit(0.0)) >= reached("malicious", "anomaly"))),
        "rule": rule({s: F.col(f"max_{s}") for s in SIGNALS}, cuts), "band": band({s: F.col(f"max_{s}") for s in SIGNALS}, cuts),
    })
    rows = rows.withColumn("n_eff", F.when(total <= 0, F.col("n_docs").cast("double")).otherwise(F.least(F.try_divide(total * total, squares), F.col("n_sources").cast("double"))))
    quiet = lambda s: F.coalesce(F.col(f"max_{s}"), F.lit(0.0)) < reached("suspicious", s)
    grid = grid_case(F.col("tier"), F.col("band"))
    holds = {
        "C11": (F.col("outliers") == 1) & (F.coalesce("n_eff", F.lit(0.0)) <= 2) & (F.col("support") < 2),
        "C10": (F.col("n_tier1") >= 2) & (F.col("tier1_conflict") >= reached("malicious", "unsupport", 0.85)) & quiet("injection") & quiet("anomaly"),
    }
    matched = F.array_compact(F.array(*[F.when(holds.get(c[0], F.lit(False)) | (grid == c[0]), c[0]) for c in CASES]))
    return rows.withColumn("matched", matched).withColumn("case_id", F.get("matched", F.lit(0)))


def clipped_logit(p: Column) -> Column:
    """The logit of a probability that is kept off 0 and 1; 0.0 stands for what was not measured."""
    kept = F.greatest(F.least(F.coalesce(p, F.lit(0.0)), F.lit(1 - EPS)), F.lit(EPS))
    return F.log(kept / (1 - kept))


def encoded(rows: DataFrame) -> DataFrame:
    """(query_id, rnk, doc_id, tier, x_conflict, is_tier1, is_tier3) of every retrieved document; tier 2 is the reference."""
    each = rows.select("query_id", F.explode("docs").alias("d")).select("query_id", "d.rnk", "d.doc_id", "d.tier", clipped_logit(F.col("d.conflict")).alias("x_conflict"))
    return each.withColumns({"is_tier1": (F.col("tier") == 1).cast("double"), "is_tier3": (F.col("tier") == 3).cast("double")})


def standardised(rows: DataFrame, names: list[str]) -> DataFrame:
    """Each column less its mean, in its population deviations; a deviation of 0 counts as 1."""
    stats = rows.agg(*[F.avg(n).alias(f"mean_{n}") for n in names], *[F.stddev_pop(n).alias(f"sd_{n}") for n in names])
    out = rows.crossJoin(F.broadcast(stats))  # one row
    return out.withColumns({n: (F.col(n) - F.col(f"mean_{n}")) / F.when(F.col(f"sd_{n}") == 0, 1.0).otherwise(F.col(f"sd_{n}")) for n in names}).drop(*stats.columns)


def _linear(intercept: Column, shift: Column) -> Column:
    return reduce(lambda a, b: a + b, [(F.lit(c) + shift) * F.col(n) for n, c in COEFFICIENTS.items()], intercept)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _quantile(ordered: Column, q: float) -> Column:
    """Linear between the neighbours, of MEMBERS ordered values."""
    at = q * (MEMBERS - 1)
    low = F.get(ordered, F.lit(int(at)))
    return low + (at - int(at)) * (F.get(ordered, F.lit(int(at) + 1)) - low)


def risks(rows: DataFrame) -> DataFrame:
    """Adds risk, risk_lo and risk_hi to standardised rows.

    The ensemble stands for resampled fits: member k moves the intercept by (k % 13 - 6) * 0.02 and
    each coefficient by (k % 21 - 10) * 0.01.  Its spread around its median is put on the point.
    """
    member = lambda k: _linear(INTERCEPT + (k % 13 - 6) * 0.02, (k % 21 - 10) * 0.01)
    rows = rows.withColumns({"point": _linear(F.lit(INTERCEPT), F.lit(0.0)), "spread": F.array_sort(F.transform(F.sequence(F.lit(1), F.lit(MEMBERS)), member))})
    lo, mid, hi = (_quantile(F.col("spread"), q) for q in (0.025, 0.5, 0.975))
    zero = F.lit(0.0)
    rows = rows.withColumns({"risk": sigmoid(F.col("point")), "risk_lo": sigmoid(F.col("point") + F.least(lo - mid, zero)), "risk_hi": sigmoid(F.col("point") + F.greatest(hi - mid, zero))})
    return rows.drop("point", "spread")


def worst_risk(rows: DataFrame) -> DataFrame:
    """(query_id, risk, risk_lo, risk_hi) of each query's riskiest document, the first of equals."""
    order = Window.partitionBy("query_id").orderBy(F.desc("risk"), "rnk")
    return rows.withColumn("place", F.row_number().over(order)).where("place = 1").select("query_id", "risk", "risk_lo", "risk_hi")


def confident(rows: DataFrame) -> DataFrame:
    """Adds the five components, confidence and forced_review; ``width`` is that of the risk interval."""
    votes = F.array(*[F.coalesce(f"max_{s}", F.lit(0.0)) for s in SIGNALS[:3]])
    mean = F.aggregate(votes, F.lit(0.0), lambda a, v: a + v) / 3
    deviation = F.sqrt(F.aggregate(votes, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / 3)
    unit = lambda x: F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0))
    rows = rows.withColumns({
        "volume": 1 - F.exp(-F.greatest("n_eff", F.lit(0.0)) / KAPPA),
        "agreement": unit(1 - F.col("d_conflict_max")),
        "independence": 0.7 * F.least(F.col("n_sources") / 3, F.lit(1.0)) + 0.3 * F.least(F.col("n_tiers") / 2, F.lit(1.0)),
        "coherence": unit(1 - deviation / 0.5),
        "stability": unit(1 - F.col("width")),
    })
    weights = {"volume": 1.0, "agreement": AGREEMENT, "independence": 1.0, "coherence": 1.0, "stability": 1.0}
    logs = reduce(lambda a, b: a + b, [w * F.log(F.greatest(c, F.lit(1e-300))) for c, w in weights.items()])
    raw = F.when(F.least(*weights) <= 0, 0.0).otherwise(F.exp(logs / sum(weights.values())))
    one = F.when(F.col("n_eff") <= 1, F.least(raw, F.lit(N_EFF_ONE))).otherwise(raw)
    rows = rows.withColumn("confidence", F.round(F.when(F.col("n_docs") == 1, F.least(one, F.lit(SINGLETON))).otherwise(one), 6))
    return rows.withColumn("forced_review", F.col("confidence") < FLOOR)


def score_action(upper: Column, consistent: Column) -> Column:
    """What the risk's upper bound asks for; without consistent bands never more than REVIEW, without a risk nothing."""
    asked = F.when(consistent & (upper >= TAU_REJECT), "REJECT").when(upper >= TAU_REVIEW, "REVIEW").otherwise("ACCEPT")
    return F.when(upper.isNull(), "ACCEPT").otherwise(asked)


def scored(rows: DataFrame) -> DataFrame:
    """Every query judged as a whole: ``measured`` rows with case, risk, confidence, the action that is
    the severest of case, score and confidence floor, and the headline of that action."""
    names = list(COEFFICIENTS)
    out = classified(rows).join(worst_risk(risks(standardised(encoded(rows), names))), "query_id", "left")
    out = confident(out.withColumn("width", F.coalesce(F.col("risk_hi") - F.col("risk_lo"), F.lit(0.5))))
    out = out.withColumns({"case_action": case_field(F.col("case_id"), "action"), "score_action": score_action(F.col("risk_hi"), F.lit(True))})
    out = out.withColumn("action", dominant(F.col("case_action"), F.col("score_action"), F.when(F.col("forced_review"), "REVIEW").otherwise("ACCEPT")))
    return out.withColumns({"headline": headline(F.col("action"), F.col("tier")), "subtype": subtype(F.col("action"), F.col("tier")), "priority": case_field(F.col("case_id"), "priority")})
