"""Roll-ups of verification reports, run records and benchmark runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UVR_LIMIT = 0.15
GROUNDING_FLOOR = 0.85
MAX_SMOKE_TOPICS = 20
SOURCE_KINDS = ("web", "kb", "none", "unresolved")


def _share(part: Column, whole: Column, digits: int) -> Column:
    """Null where there is nothing to divide by."""
    return F.round(part / F.nullif(whole, F.lit(0)), digits)


def grounding_breakdown(report: DataFrame, keys: list[str]) -> DataFrame:
    """Why grounding failed: unverified rows without and with a source, weak rows, mean confidences (0 without rows)."""
    s, bare = F.col("status"), F.coalesce(F.col("source_url"), F.lit("")) == ""
    mean = lambda kind: F.round(F.coalesce(F.avg(F.when(s == kind, F.coalesce("confidence", F.lit(0.0)))), F.lit(0.0)), 3)
    return report.groupBy(*keys).agg(
        F.count_if((s == "unverified") & bare).alias("unverified_no_source"), F.count_if((s == "unverified") & ~bare).alias("unverified_has_source"), F.count_if(s == "weak").alias("weak_count"),
        mean("verified").alias("mean_confidence_verified"), mean("unverified").alias("mean_confidence_unverified"),
    )


def grounded_depth(report: DataFrame, keys: list[str]) -> DataFrame:
    """Substantive and verified rows, and the shares of verified and unverified ones."""
    s, deep, n = F.col("status"), F.col("specificity") == "substantive", F.count("*")
    return report.groupBy(*keys).agg(
        F.count_if(deep & (s == "verified")).alias("sv"), F.count_if(deep).alias("s"), F.count_if(s == "verified").alias("v"), n.alias("n"),
        _share(F.count_if(s == "verified"), n, 3).alias("verified_fraction"), _share(F.count_if(s == "unverified"), n, 3).alias("unverified_fraction"),
    )


def attribution_counts(report: DataFrame, keys: list[str]) -> DataFrame:
    return report.groupBy(*keys).agg(*[F.count_if(F.col("source_kind") == k).alias(f"n_{k}") for k in SOURCE_KINDS])


def grounding_summary(report: DataFrame, keys: list[str]) -> DataFrame:
    n = {k: F.count_if(F.col("status") == k).cast("string") for k in ("verified", "weak", "unverified")}
    text = F.concat(n["verified"], F.lit(" verified, "), n["weak"], F.lit(" weak, "), n["unverified"], F.lit(" unverified out of "), F.count("*").cast("string"), F.lit(" total claims."))
    return report.groupBy(*keys).agg(text.alias("summary"))


def iteration_metrics(report: DataFrame, run: str, iteration: str) -> DataFrame:
    """Counts of each iteration of a run with the change of its unverified rate from the iteration before."""
    deep, s = F.col("specificity") == "substantive", F.col("status")
    out = report.groupBy(run, iteration).agg(
        F.count_if(deep & (s == "verified")).alias("sv"), F.count_if(s == "unverified").alias("u"), F.count("*").alias("n"), _share(F.count_if(s == "unverified"), F.count("*"), 3).alias("uvr")
    )
    before = F.lag("uvr").over(Window.partitionBy(run).orderBy(iteration))
    return out.withColumn("delta_uvr", F.round(F.col("uvr") - before, 3))


def experiment_cells(iterations: DataFrame, keys: list[str], run: str, iteration: str) -> DataFrame:
    """Means over runs of the first and the last iteration; iterations without rows are left out."""
    per = iterations.where("n > 0").groupBy(*keys, run).agg(F.min_by("uvr", iteration).alias("first"), F.max_by("uvr", iteration).alias("last"), F.max_by("sv", iteration).alias("sv"))
    return per.groupBy(*keys).agg(F.count("*").alias("runs"), F.round(F.avg("first"), 4).alias("first_uvr"), F.round(F.avg("last"), 4).alias("last_uvr"), F.round(F.avg("sv"), 4).alias("mean_sv"))


def verification_outcome(status: Column, total: Column, unverified: Column, allow_zero: Column) -> Column:
    """(evaluation_status, uvr, validation_error): whether a run's unverified rate means anything."""
    done = status == "completed"
    kind = F.when(~done, "verification_incomplete").when(total > 0, "scorable").when(allow_zero, "allowed_zero_claims").otherwise("unscorable_incomplete")
    error = F.when(~done, F.concat(F.lit("verification_status="), status)).when((total == 0) & ~allow_zero, "zero verdicts without allow_zero_claims")
    return F.struct(kind.alias("evaluation_status"), F.when(done, unverified / F.nullif(total, F.lit(0))).alias("uvr"), error.alias("validation_error"))


def benchmark_metrics(runs: DataFrame, floor: float = GROUNDING_FLOOR) -> DataFrame:
    """Means over successful runs without validation error; wall time over all runs, the unverified rate over those that have one."""
    ok = (F.col("status") == "success") & (F.coalesce(F.col("validation_error"), F.lit("")) == "") & F.col("has_telemetry")
    mean = lambda c, digits: F.round(F.avg(F.when(ok, F.col(c))), digits).alias(f"mean_{c}")
    return runs.agg(
        F.count("*").alias("total_runs"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"), F.count_if(ok & F.col("uvr").isNull()).alias("unscorable"),
        mean("cost_usd", 5), mean("grounding", 3), mean("reflection", 1), F.round(F.avg("wall_time_s"), 1).alias("mean_wall_time_s"), mean("html_errors", 1),
        F.round(F.avg(F.when(ok, F.col("uvr"))), 3).alias("mean_unverified_rate"), F.count_if(ok & (F.coalesce(F.col("grounding"), F.lit(1.0)) < floor)).alias("runs_below_grounding_floor"),
    )


def smoke_failures(runs: DataFrame, limit: float = UVR_LIMIT) -> DataFrame:
    """(id, failure): failed runs, and runs whose unverified rate is above the limit."""
    label = F.format_string("topic %02d", "id")
    failed = (F.col("status") != "success") | (F.coalesce(F.col("validation_error"), F.lit("")) != "")
    why = F.when(failed, F.concat(label, F.lit(": "), F.coalesce(F.nullif("validation_error", F.lit("")), F.lit("CLI failed"))))
    above = F.when(F.col("uvr") > limit, F.concat(label, F.format_string(f" UVR %.2f > {limit:.2f}", "uvr")))
    return runs.select("id", F.explode(F.array_compact(F.array(why, above))).alias("failure"))


def release_failures(runs: DataFrame, limit: float = UVR_LIMIT) -> DataFrame:
    """(id, failure) of release runs: the first thing wrong with each run, and run ids that are missing or repeated."""
    total = F.col("verified") + F.col("weak") + F.col("unverified")
    rate = F.col("unverified") / F.nullif(total, F.lit(0))
    label = F.format_string("topic %02d: ", "id")
    first = (
        F.when(F.col("exit_code") != 0, F.concat(F.lit("subprocess exit code "), F.col("exit_code").cast("string")))
        .when((F.col("status") != "success") | (F.coalesce(F.col("validation_error"), F.lit("")) != ""), F.coalesce(F.nullif("validation_error", F.lit("")), F.lit("CLI failed")))
        .when(~F.col("has_telemetry"), "telemetry unavailable")
        .when(total <= 0, "unscorable zero-verdict telemetry claim total")
        .when(F.col("verification_status") != "completed", F.concat(F.lit("verification_status="), F.col("verification_status")))
        .when(F.col("uvr").isNull() | (F.col("uvr") < 0) | (F.col("uvr") > 1), "UVR out of range")
        .when(F.col("uvr") > limit, F.format_string(f"UVR %.2f > {limit:.2f}", "uvr"))
        .when(F.col("uvr") != rate, "UVR contradicts claim counts")
    )
    own = runs.select("id", F.concat(label, first).alias("failure")).where("failure is not null")
    named = runs.withColumn("twice", F.count("*").over(Window.partitionBy("run_id")))
    ids = named.where("run_id is null or run_id = '' or twice > 1").select("id", F.when(F.coalesce("run_id", F.lit("")) == "", "run ID missing").otherwise("run ID repeated").alias("failure"))
    return own.unionByName(ids)


def telemetry_error(required_missing: Column, web_sources: Column, attribution_sum: Column, n_report: Column, without_kind: Column, without_chunk: Column) -> Column:
    """The first thing wrong with a run record, else null."""
    return (
        F.when(F.size(required_missing) > 0, "missing_fields")
        .when(web_sources.isNull() | (web_sources < 0), "web_sources_count_invalid")
        .when((n_report > 0) & (attribution_sum != n_report), "attribution_does_not_sum")
        .when((n_report > 0) & (without_kind > 0), "source_kind_missing")
        .when(without_chunk > 0, "chunk_index_missing")
    )


def exact_record(requests: DataFrame, records: DataFrame) -> DataFrame:
    """Each request (run_id, topic) against the record that its file holds (file_id, run_id, topic): 'ok' or why not."""
    held = records.select(F.col("file_id").alias("run_id"), F.col("run_id").alias("_run"), F.col("topic").alias("_topic"), F.lit(True).alias("_there"))
    why = F.when(F.col("_there").isNull(), "telemetry_missing").when(~F.col("_run").eqNullSafe(F.col("run_id")), "run_id_mismatch").when(~F.col("_topic").eqNullSafe(F.col("topic")), "topic_mismatch").otherwise("ok")
    return requests.join(held, "run_id", "left").select("run_id", "topic", why.alias("result"))


def manifest_errors(topics: DataFrame) -> DataFrame:
    """(place, failure) of manifest rows (place, id, topic, slug): bad or repeated ids, empty or repeated names."""
    text = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) != ""
    nth = lambda c, valid: F.sum(F.when(valid, 1).otherwise(0)).over(Window.partitionBy(c).orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    seen = topics.withColumn("_id", nth("id", F.col("id") > 0)).withColumn("_topic", nth("topic", text("topic"))).withColumn("_slug", nth("slug", text("slug")))
    found = [
        F.when(F.coalesce(F.col("id"), F.lit(0)) <= 0, "id must be a positive integer").when(F.col("_id") > 1, "duplicate id"),
        F.when(~text("topic"), "topic must be nonempty").when(F.col("_topic") > 1, "duplicate topic"),
        F.when(~text("slug"), "slug must be nonempty").when(F.col("_slug") > 1, "duplicate slug"),
    ]
    return seen.select("place", F.explode(F.array_compact(F.array(*found))).alias("failure"))


def manifest_order(topics: DataFrame, contract: DataFrame) -> DataFrame:
    """Places at which the ids of manifest (place, id) and contract (place, id) differ, a missing row being null."""
    want = contract.select("place", F.col("id").alias("want"))
    return topics.select("place", F.col("id").alias("got")).join(want, "place", "full_outer").where(~F.col("got").eqNullSafe(F.col("want")))


def smoke_topics(topics: DataFrame, topic_id: int | None = None, limit: int | None = None) -> DataFrame:
    """One topic by id or the first of the manifest; exactly one way, at most ``MAX_SMOKE_TOPICS``."""
    if (topic_id is None) == (limit is None):
        raise ValueError("exactly one of topic_id and limit is needed")
    if topic_id is not None:
        if topic_id <= 0:
            raise ValueError("topic_id must be positive")
        return topics.where(F.col("id") == topic_id)
    if not 0 < limit <= MAX_SMOKE_TOPICS:
        raise ValueError(f"limit must be between 1 and {MAX_SMOKE_TOPICS}")
    return topics.orderBy("place").limit(limit)


def cost_gate(steps: DataFrame, run: str, order: list[str], cost: str, limit: float) -> DataFrame:
    """Steps with the running cost of their run and whether the run stops there: the first step at or above the limit."""
    at = Window.partitionBy(run).orderBy(*order)
    spent = F.sum(cost).over(at.rowsBetween(Window.unboundedPreceding, 0))
    out = steps.withColumn("spent", spent)
    return out.withColumn("stops", (F.col("spent") >= limit) & (F.coalesce(F.lag("spent").over(at), F.lit(0.0)) < limit)).withColumn("runs", F.coalesce(F.lag("spent").over(at), F.lit(0.0)) < limit)


def headline(runs: DataFrame) -> DataFrame:
    """What a list of runs shows: identity, state, message, tokens and cost."""
    return runs.select("run_id", F.coalesce("terminal_status", F.lit("running")).alias("state"), F.coalesce(F.nullif(F.trim("message"), F.lit("")), F.lit("")).alias("message"), F.coalesce("total_tokens", F.lit(0)).alias("total_tokens"), F.round(F.coalesce("cost_usd", F.lit(0.0)), 5).alias("cost_usd"))


def terminal_outcome(state: DataFrame) -> DataFrame:
    """(run_id, outcome, repairable) of a verification that did not pass, the first rule that holds.

    ``state`` has identity_matches, ambiguous_anchor, verification_status,
    inventory_current, anchors_ok, material_state, citations_ok, semantic_ok.
    """
    c = F.col
    material_ok = c("material_state").isin("pass", "no_inventory")
    blocked = ~material_ok & ~c("material_state").isin("repairable", "exhausted")
    outcome = F.coalesce(
        F.when(~c("identity_matches"), F.lit("execution_failed:stop")),
        F.when((c("verification_status") == "inventory_failed") & c("inventory_current") & c("ambiguous_anchor"), F.lit("execution_failed:stop")),
        F.when((c("verification_status") != "completed") & c("verification_status").isin("parse_failed", "inventory_failed"), F.lit("execution_failed:repair")),
        F.when(c("verification_status") != "completed", F.lit("execution_failed:stop")),
        F.when(~c("inventory_current") | ~c("anchors_ok"), F.lit("execution_failed:stop")),
        F.when(blocked, F.lit("policy_blocked:stop")),
        F.when(~c("citations_ok"), F.lit("policy_blocked:stop")),
        F.when(~c("semantic_ok"), F.lit("terminal_quality_exhausted:repair")),
        F.when(~material_ok, F.lit("policy_blocked:repair")),
        F.lit("execution_failed:stop"),
    )
    return state.select("run_id", F.substring_index(outcome, ":", 1).alias("outcome"), outcome.endswith(":repair").alias("repairable"))


def attempts_left(runs: DataFrame, limits: dict[str, int]) -> DataFrame:
    """(run_id, kind, used, limit, allowed): whether one more draft, content feedback or layout revision is allowed."""
    table = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("long").alias("used"), F.lit(n).cast("long").alias("limit")) for k, n in limits.items()])
    return runs.select("run_id", F.explode(table).alias("x")).select("run_id", "x.*", (F.col("x.used") < F.col("x.limit")).alias("allowed"))


def trace_errors(trace: DataFrame) -> DataFrame:
    """(run_id, iteration, error) of an append-only trace (run_id, iteration, payload, digest, previous): gaps, repeated iterations, broken digests and links."""
    at = Window.partitionBy("run_id").orderBy("iteration", "digest")
    before = F.lag("digest").over(at)
    gap = F.col("iteration") - F.coalesce(F.lag("iteration").over(at), F.lit(-1))
    found = F.array_compact(
        F.array(
            F.when(gap > 1, F.lit("iteration_gap")), F.when(gap == 0, F.lit("iteration_repeated")),
            F.when(F.sha2("payload", 256) != F.col("digest"), F.lit("digest_mismatch")), F.when(~F.col("previous").eqNullSafe(before), F.lit("link_mismatch")),
        )
    )
    return trace.withColumn("_found", found).select("run_id", "iteration", F.explode("_found").alias("error"))
