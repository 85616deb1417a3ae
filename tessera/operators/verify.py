"""Verification signals of claim and evidence pairs, verdicts, mitigation and roll-ups.

Thresholds are parameters. Signals that a model would give (entailment) are columns that may be null; the
offline support is the mean of the coverage signals that are not null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import numbers, tokens
from tessera.functions.vectors import entropy

DECIMALS = 6


@dataclass(frozen=True)
class Thresholds:
    contradict: float = 0.5
    supported_high: float = 0.7
    supported_low: float = 0.4


def _share(wanted: Column, there: Column) -> Column:
    """Part of the distinct wanted that is there; null if nothing is wanted."""
    own = F.array_distinct(wanted)
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, there)) / F.size(own))


def entities(c: str) -> Column:
    """Capitalised ASCII words that do not begin the text: an approximation without a model."""
    return F.regexp_extract_all(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"^[^ ]* ?", ""), F.lit("[A-Z][a-z]+"), F.lit(0))


def token_coverage(claim: str, evidence: str) -> Column:
    return F.round(_share(tokens(claim), tokens(evidence)), DECIMALS)


def number_coverage(claim: str, evidence: str) -> Column:
    return F.round(_share(numbers(claim), numbers(evidence)), DECIMALS)


def entity_coverage(claim: str, evidence: str) -> Column:
    return F.round(_share(entities(claim), entities(evidence)), DECIMALS)


def numeric_check(claim: str, evidence: str) -> Column:
    return F.size(F.array_except(numbers(claim), numbers(evidence))) == 0


def citation_match(claim: str, top_evidence: str) -> Column:
    """Token overlap (Jaccard) with the top evidence, in [0, 1]; 0 for two texts without tokens."""
    a, b = tokens(claim), tokens(top_evidence)
    return F.round(F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0)), DECIMALS)


def mean_entropy(steps: str) -> Column:
    """Mean entropy over the probability vectors of an answer's tokens."""
    each = F.transform(F.col(steps), entropy)
    return F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / F.size(each)


def perplexity(scores: str) -> Column:
    """exp of the mean negative log probability of the emitted tokens."""
    total = F.aggregate(F.col(scores), F.lit(0.0), lambda s, p: s + F.ln(p))
    return F.exp(-total / F.size(scores))


def aligned_scores(steps: str, token_ids: str, legacy_alignment: bool = False) -> Column:
    """Probability of each emitted token. The first id is the decoder's start token, which no step emits; the
    legacy alignment reads step i against id i."""
    shift = 0 if legacy_alignment else 1
    return F.transform(F.col(steps), lambda p, i: F.element_at(p, F.element_at(F.col(token_ids), i + 1 + shift) + 1))


def self_agreement(samples: str) -> Column:
    """Population variance of the token Jaccard over all pairs of an answer's samples (k of them); null for fewer than two."""
    lists = F.transform(F.col(samples), tokens)
    near = lambda a, b: F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0)).cast("double")
    rows = F.transform(lists, lambda a, i: F.transform(F.slice(lists, i + 2, F.size(lists)), lambda b: near(a, b)))
    flat = F.flatten(rows)
    mean = F.aggregate(flat, F.lit(0.0), lambda s, x: s + x) / F.size(flat)
    return F.when(F.size(samples) > 1, F.aggregate(flat, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / F.size(flat))


def decide(df: DataFrame, support: Column, contradict: Column, numeric: Column, t: Thresholds = Thresholds()) -> DataFrame:
    """df with support_prob, contradict_prob, overall_confidence, status and band. The first rule that fits wins."""
    s, c = F.coalesce(support, F.lit(0.0)), F.coalesce(contradict, F.lit(0.0))
    against = F.coalesce(contradict >= t.contradict, F.lit(False)) | (contradict.isNull() & ~F.coalesce(numeric, F.lit(True)))
    status = F.when(against, "Contradictory").when(s >= t.supported_low, "Supported").otherwise("Low Confidence")
    band = F.when(against, F.lit(None)).when(s >= t.supported_high, "High").when(s >= t.supported_low, "Low")
    return df.withColumns(
        {"support_prob": F.round(s, DECIMALS), "contradict_prob": F.round(c, DECIMALS), "overall_confidence": F.round(s * (1 - c), DECIMALS), "status": status, "band": F.coalesce(band, F.lit("none"))}
    )


def entailment_rollup(pairs: DataFrame, by: str = "claim_id", entail: str = "nli_entail", contradict: str = "nli_contradict", least: float = 0.5) -> DataFrame:
    """Of each claim over its evidence: pairs, the greatest probabilities and the part of the pairs that entail it; null without a judged pair."""
    judged = F.count(entail)
    yes = F.count_if(F.col(entail) >= least)
    return pairs.groupBy(by).agg(
        F.count("*").alias("pairs"),
        F.round(F.max(entail), DECIMALS).alias("max_entailment_prob"),
        F.round(F.max(contradict), DECIMALS).alias("max_contradiction_prob"),
        F.round(F.try_divide(yes, judged), DECIMALS).alias("entailment_ratio"),
    )


def mitigated(status: str, text: str) -> Column:
    """What an answer says of a claim after mitigation: contradicted ones go, weak ones are flagged."""
    return F.when(F.col(status) == "Contradictory", "[removed]").when(F.col(status) == "Low Confidence", F.concat(F.lit("[unverified] "), F.col(text))).otherwise(F.col(text))


def summary(decided: DataFrame, by: str = "answer_id") -> DataFrame:
    """Six measures of each answer; each claim is in exactly one counter."""
    status, band = F.col("status"), F.col("band")
    return decided.groupBy(by).agg(
        F.count("*").alias("claims_total"),
        F.count_if((status == "Supported") & (band == "High")).alias("supported_high"),
        F.count_if((status == "Supported") & (band == "Low")).alias("supported_low"),
        F.count_if(status == "Contradictory").alias("contradicted"),
        F.count_if(status == "Low Confidence").alias("insufficient"),
        F.round(F.avg("overall_confidence"), DECIMALS).alias("mean_overall_confidence"),
    )


def detector_metrics(df: DataFrame, gold: Column, flagged: Column, by: list[str] | None = None) -> DataFrame:
    """Confusion counts, accuracy, precision, recall and F1; a measure without a denominator is null."""
    out = df.groupBy(*(by or [])).agg(
        F.count_if(gold & flagged).alias("tp"), F.count_if(~gold & flagged).alias("fp"), F.count_if(gold & ~flagged).alias("fn"), F.count_if(~gold & ~flagged).alias("tn")
    )
    ratio = lambda a, b: F.round(F.try_divide(a.cast("double"), b.cast("double")), DECIMALS)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return out.withColumns({"accuracy": ratio(tp + tn, tp + tn + fp + fn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def ablations(df: DataFrame, signals: list[str], gold: Column, threshold: float) -> DataFrame:
    """Metrics of the mean of all signals, and with each one disabled."""
    masks = F.array(F.lit("none"), *(F.lit(s) for s in signals))
    each = df.withColumn("disabled", F.explode(masks))
    score = sum((F.when(F.col("disabled") != s, F.col(s)).otherwise(0.0) for s in signals), F.lit(0.0))
    n = sum((F.when(F.col("disabled") != s, 1).otherwise(0) for s in signals), F.lit(0))
    return detector_metrics(each, gold, score / n >= threshold, ["disabled"])
