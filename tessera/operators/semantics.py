"""Registered metrics of claim extraction and verification against adjudicated fixtures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Roles of a candidate that no match counts for.
INELIGIBLE = ("compound", "fragment", "qualifier_loss", "invention")
NEGATIVE = ("weak", "unverified")


def ratio(part: Column, whole: Column) -> Column:
    """Null where nothing is to be counted."""
    return F.round(part / F.nullif(whole, F.lit(0)), 8)


def unresolved_gold(golds: DataFrame, matches: DataFrame, candidates: DataFrame, bindings: DataFrame) -> DataFrame:
    """Material golds (fixture, gold_id, material, gold_status) with their matched candidate and whether they stay unresolved.

    Unresolved is a gold without an eligible match, one whose truth is weak or
    unverified, one whose binding is missing, invalid, for another candidate or not
    fully entailed, and one whose candidate was not verified.
    """
    c = candidates.select("fixture", "candidate_id", "role", "predicted_status")
    b = bindings.select("fixture", "gold_id", F.col("candidate_id").alias("_bound"), "valid", "fully_entailed")
    out = golds.where("material").join(matches.select("fixture", "gold_id", "candidate_id"), ["fixture", "gold_id"], "left").join(c, ["fixture", "candidate_id"], "left").join(b, ["fixture", "gold_id"], "left")
    eligible = F.col("candidate_id").isNotNull() & ~F.coalesce(F.col("role").isin(*INELIGIBLE), F.lit(False))
    bound = F.coalesce((F.col("_bound") == F.col("candidate_id")) & F.col("valid") & F.col("fully_entailed"), F.lit(False))
    resolved = eligible & bound & (F.col("gold_status") == "verified") & F.coalesce(F.col("predicted_status") == "verified", F.lit(False))
    return out.select("fixture", "gold_id", "gold_status", "candidate_id", "predicted_status", eligible.alias("recalled"), (~resolved).alias("unresolved"))


def gold_metrics(unresolved: DataFrame, keys: list[str]) -> DataFrame:
    """Material recall, unresolved rate and false verification rate."""
    negative = F.col("gold_status").isin(*NEGATIVE)
    false = negative & F.coalesce(F.col("predicted_status") == "verified", F.lit(False))
    return unresolved.groupBy(*keys).agg(
        F.count("*").alias("material_golds"), ratio(F.count_if("recalled"), F.count("*")).alias("material_claim_recall"), ratio(F.count_if("unresolved"), F.count("*")).alias("material_unresolved_rate"),
        ratio(F.count_if(false), F.count_if(negative)).alias("material_false_verification_rate"), (F.count_if("unresolved") == 0).alias("semantic_pass"),
    )


def final_unresolved(atoms: DataFrame) -> DataFrame:
    """Final claims (.., atom_id, material, label, prediction_id, predicted_status, bound_to, valid, fully_entailed, evidence_id) with ``unresolved``; claims that are not material never are."""
    sure = lambda c: F.coalesce(c, F.lit(False))
    good = sure(F.col("label") == "verified") & sure(F.col("prediction_id") != "") & sure(F.col("predicted_status") == "verified") & sure(F.col("bound_to") == F.col("atom_id"))
    good = good & sure(F.col("valid")) & sure(F.col("fully_entailed")) & sure(F.col("evidence_id") != "")
    return atoms.withColumn("unresolved", F.col("material") & ~good)


def final_metrics(atoms: DataFrame, cases: DataFrame, keys: list[str]) -> DataFrame:
    """Unresolved rate of the final material claims, and false verification rate over fixed classification cases."""
    a = final_unresolved(atoms).groupBy(*keys).agg(ratio(F.count_if("unresolved"), F.count_if("material")).alias("final_unresolved_rate"))
    negative = F.col("material") & F.col("label").isin(*NEGATIVE)
    c = cases.groupBy(*keys).agg(ratio(F.count_if(negative & (F.col("predicted_status") == "verified")), F.count_if(negative)).alias("false_verification_rate"))
    return a.join(c, keys, "full_outer")


def unverified_rate(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Unverified verifier rows, all rows, and their ratio, unrounded."""
    n = F.count_if(F.col("status") == "unverified")
    return rows.groupBy(*keys).agg(n.alias("numerator"), F.count("*").alias("denominator"), (n / F.nullif(F.count("*"), F.lit(0))).alias("value"))


def extraction_metrics(candidates: DataFrame, golds: DataFrame, matches: DataFrame, keys: list[str]) -> DataFrame:
    """Factual and material recall, precision, F1, duplicate rate, atomicity and fragments.

    ``candidates`` has (keys, candidate_id, canonical, role), ``golds`` (keys, gold_id, material, factual), ``matches`` (keys, candidate_id, gold_id).
    """
    g = golds.join(matches.select(*keys, "gold_id", F.lit(True).alias("_m")), [*keys, "gold_id"], "left").withColumn("_m", F.coalesce("_m", F.lit(False)))
    per = g.groupBy(*keys).agg(
        ratio(F.count_if(F.col("material") & F.col("_m")), F.count_if("material")).alias("material_recall"), ratio(F.count_if(F.col("factual") & F.col("_m")), F.count_if("factual")).alias("factual_recall"), F.count("*").alias("n_gold"), F.count_if("_m").alias("tp")
    )
    c = candidates.groupBy(*keys).agg(
        F.count("*").alias("n_found"), ratio(F.count("*") - F.count_distinct("canonical"), F.count("*")).alias("duplicate_rate"), ratio(F.count_if(F.col("role") != "compound"), F.count("*")).alias("atomicity"), F.count_if(F.col("role") == "fragment").alias("fragments")
    )
    out = per.join(c, keys, "full_outer").fillna(0, ["n_gold", "tp", "n_found", "fragments"])
    return out.withColumn("precision", ratio(F.col("tp"), F.col("n_found"))).withColumn("f1", ratio(2 * F.col("tp"), F.col("n_found") + F.col("n_gold"))).drop("n_gold", "n_found")


def extraction_case(found: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Material cases found (tp), missed (fn) and found beyond them (fp, at least 0), with recall; ``found`` and ``wanted`` are (keys, canonical, material)."""
    f = found.where("material").select(*keys, "canonical").distinct().withColumn("_f", F.lit(1))
    w = wanted.where("material").select(*keys, "canonical").distinct().withColumn("_w", F.lit(1))
    both = w.join(f, [*keys, "canonical"], "full_outer")
    hit = F.col("_w").isNotNull() & F.col("_f").isNotNull()
    out = both.groupBy(*keys).agg(F.count_if(hit).alias("tp"), F.count_if(F.col("_f").isNull()).alias("fn"), F.greatest(F.count_if(F.col("_w").isNull()), F.lit(0)).alias("fp"))
    return out.withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
