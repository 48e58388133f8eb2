"""Intake, capture routing, redirects and batch reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegauge.constants import (
    ALLOWED_PORTS,
    BATCH_URLS,
    MAX_HTML_BYTES,
    MAX_REDIRECTS,
    MAX_URL_LENGTH,
    MIN_HTML_CHARS,
    REDIRECT_STATUSES,
)
from sitegauge.functions.html import let, strip
from sitegauge.functions.urls import IPV4_PATTERN, admission, public_address, resolve_url
from sitegauge.operators.scores import audited, legacy_score_column
from sitegauge.operators.url_ops import judged
from sitegauge.plans.page_report import fact_columns
from sitegauge.sources.files import work_folder

TOO_MANY = "Refused: Too many redirects"


def page_intake(submissions: DataFrame, most_bytes: int = MAX_HTML_BYTES, longest_url: int = MAX_URL_LENGTH, least_chars: int = MIN_HTML_CHARS) -> DataFrame:
    """``(page_id, url, status, reason)``: rejected rows carry the first reason."""
    reason = (
        F.when(F.octet_length("html") > most_bytes, "HTML content exceeds maximum size of 5 MB")
        .when(F.length("url") > longest_url, "URL exceeds maximum length of 2048 characters")
        .when(F.coalesce(F.length(strip(F.col("html"))), F.lit(0)) < least_chars, "HTML content too short or empty")
    )
    return submissions.select(
        "page_id", "url", F.when(reason.isNull(), "accepted").otherwise("rejected").alias("status"), reason.alias("reason")
    )


def routing_error() -> Column:
    """Error of one fetch outcome, null if the page can be read."""
    kind = F.coalesce(F.col("content_type"), F.lit(""))
    return (
        F.when(F.col("refusal").isNotNull(), F.concat(F.lit("Refused: "), F.col("refusal")))
        .when(F.col("status") >= 400, F.concat(F.lit("HTTP "), F.col("status").cast("string")))
        .when(~kind.contains("html") & ~kind.contains("xml"), F.concat(F.lit("Not an HTML document ("), kind, F.lit(")")))
    )


def capture_routing(captures: DataFrame) -> DataFrame:
    routed = captures.withColumn("error", routing_error())
    return routed.select("url", F.when(F.col("error").isNull(), "ok").otherwise("error").alias("status"), "error")


def batch_report(captures: DataFrame) -> DataFrame:
    routed = capture_routing(captures)
    return routed.agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "ok").alias("ok"),
        F.count_if(F.col("status") == "error").alias("errors"),
    )


def batch_numbers(rows: DataFrame, order: tuple[str, ...], size: int = BATCH_URLS) -> DataFrame:
    """The columns of ``order`` with ``batch``: rows in order, ``size`` a batch, from 0 and without gaps.

    No global sort: rows are range-partitioned, numbered inside their range, and the counts of the
    ranges before are added. The numbered keys are written first, so that both uses see the same ranges.
    """
    path = work_folder(rows.sparkSession, "ranges")
    ranged = rows.select(*order).repartitionByRange(*order).withColumn("range", F.spark_partition_id())
    inside = F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1
    ranged.withColumn("place", inside).write.parquet(path)
    placed = rows.sparkSession.read.parquet(path)
    counts = placed.groupBy("range").agg(F.count("*").alias("n"))  # one row a range
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("range", before.alias("start"))
    return placed.join(starts, "range").select(*order, F.floor((F.col("start") + F.col("place")) / size).alias("batch"))


def batch_documents(captures: DataFrame, size: int = BATCH_URLS) -> DataFrame:
    """Reports of captures in batches of at most ``size``: batch, total, results (JSON).

    ``captures`` has page_id (unique), url and a fetch outcome. Batches go by page_id. A result is
    ``{url, status, error}`` of a failed capture, else ``{url, score, audit, status}``: the additive
    score, and score, grade, counts and summary of the audit.
    """
    routed = captures.withColumn("error", routing_error())
    readable = routed.withColumn("html", F.when(F.col("error").isNull(), F.col("html")).otherwise("")).drop("status")
    scored = audited(readable).select("page_id", "url", "error", "audit", *[c for c in fact_columns()]).withColumn("score", legacy_score_column())
    audit = F.struct(*[F.col(f"audit.{k}").alias(k) for k in ("score", "grade", "counts", "summary")])
    result = F.when(F.col("error").isNotNull(), F.to_json(F.struct("url", F.lit("error").alias("status"), "error"))).otherwise(
        F.to_json(F.struct("url", "score", audit.alias("audit"), F.lit("ok").alias("status")), {"ignoreNullFields": "false"}))
    results = scored.select("page_id", result.alias("result")).join(batch_numbers(captures, ("page_id",), size), "page_id")
    in_order = F.sort_array(F.collect_list(F.struct("page_id", "result")))
    return results.groupBy("batch").agg(F.count("*").alias("total"), in_order.alias("rows")).select(
        "batch", "total", F.concat(F.lit("["), F.array_join(F.transform("rows", lambda r: r["result"]), ","), F.lit("]")).alias("results"))


def report_csv(captures: DataFrame) -> DataFrame:
    """The 20 report columns of every capture; failed ones keep url and status only."""
    routed = captures.withColumn("error", routing_error())
    # Failed captures are audited as empty pages: no second branch, no join back.
    readable = routed.withColumn("html", F.when(F.col("error").isNull(), F.col("html")).otherwise("")).drop("status")
    scored = audited(readable)
    ok = F.col("error").isNull()
    flat = scored.select("error", "audit", *fact_columns()).withColumn("score", legacy_score_column())
    columns = {
        "score": F.col("score"), "critical_issues": F.col("audit.counts.critical"), "warnings": F.col("audit.counts.warning"),
        "title": F.col("title"), "title_length": F.col("title_length"), "description_length": F.col("description_length"),
        "h1_count": F.col("headings_h1_count"), "word_count": F.col("word_count"), "images_total": F.col("images_total"),
        "images_without_alt": F.col("images_without_alt"), "has_viewport": F.col("has_viewport"),
        "has_schema": F.col("schema_has_structured_data"), "flesch_kincaid_grade": F.col("grade"),
        "internal_links": F.col("links_internal"), "external_links": F.col("links_external"),
        "lcp": F.col("lcp"), "fcp": F.col("fcp"), "cls": F.col("cls"),
    }
    return flat.select(
        "url", F.when(ok, "ok").otherwise("error").alias("status"), *[F.when(ok, v).alias(k) for k, v in columns.items()]
    )


def _refusal(url: Column, ports: tuple[int, ...]) -> Column:
    """Reason to refuse a URL without a DNS answer; literal addresses are judged themselves."""

    def judge(verdict: Column) -> Column:
        host = verdict["host"]
        literal = host.rlike(IPV4_PATTERN) | host.contains(":")
        return F.when(~verdict["ok"], verdict["reason"]).when(
            literal & ~public_address(host), F.concat(F.lit("Hostname resolves to a non-public address ("), host, F.lit(")"))
        )

    return F.concat(F.lit("Refused: "), let(admission(url, ports), judge))


def _with_refusal(rows: DataFrame, column: str, name: str, dns: DataFrame | None, ports: tuple[int, ...]) -> DataFrame:
    """The rows with the reason to refuse a URL, by its host's addresses where answers are recorded."""
    if dns is None:
        return rows.withColumn(name, _refusal(F.col(column), ports))
    return judged(rows, column, dns, ports).withColumn(name, F.concat(F.lit("Refused: "), "reason")).select(*rows.columns, name)


def _stored(jumps: DataFrame) -> DataFrame:
    path = work_folder(jumps.sparkSession, "jumps")
    jumps.write.parquet(path)
    return jumps.sparkSession.read.schema(jumps.schema).parquet(path)


def _followed(state: DataFrame, jumps: DataFrame) -> DataFrame:
    """Rows (key, to, hops, error) moved on by a jump; finished ones find none, failed ones do not look."""
    onward = jumps.select(F.col("key").alias("_at"), F.col("to").alias("_to"), F.col("hops").alias("_hops"), F.col("error").alias("_error"))
    joined = state.join(onward, F.when(F.col("error").isNull(), F.col("to")) == F.col("_at"), "left")
    return joined.select(
        "key", F.coalesce("_to", "to").alias("to"), (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops"), F.coalesce("error", "_error").alias("error"))


def redirect_resolve(
    hops: DataFrame, starts: DataFrame, dns: DataFrame | None = None, allowed_ports: tuple[int, ...] = ALLOWED_PORTS, max_redirects: int = MAX_REDIRECTS
) -> DataFrame:
    """Follow the recorded hops of every start URL: ``(url, final_url, n_hops, error)``.

    ``hops`` has one row per fetched URL, ``dns`` the recorded ``(host, address)`` answers: the start
    and every hop are refused if their host has none or a non-public one. Without ``dns`` only
    literal addresses are judged. Targets are resolved and judged once per hop. Jumps of one hop
    are composed with themselves to jumps of two, four and so on, each with its end, length and
    first error; a start takes those that make up ``max_redirects`` and one, which is too many. So
    the joins grow with the logarithm of the limit. Many URLs may lead to one, which adaptive skew
    handling splits on their side, as a URL has one jump.
    """
    missing = F.coalesce(F.col("location") == "", F.lit(True))
    edges = (
        hops.where(F.col("status").isin(*REDIRECT_STATUSES))
        .select("from_url", F.when(~missing, resolve_url(F.col("from_url"), F.col("location"))).alias("target"))
    )
    jumps = _stored(_with_refusal(edges, "target", "refusal", dns, allowed_ports).select(
        F.col("from_url").alias("key"), F.coalesce("target", "from_url").alias("to"), F.col("target").isNotNull().cast("int").alias("hops"),
        F.when(F.col("target").isNull(), TOO_MANY).otherwise(F.col("refusal")).alias("error")))
    state = _with_refusal(starts.select("url").distinct(), "url", "error", dns, allowed_ports).select(
        F.col("url").alias("key"), F.col("url").alias("to"), F.lit(0).alias("hops"), "error")
    left = max_redirects + 1
    while left:
        if left % 2:
            state = _followed(state, jumps)
        left //= 2
        if left:
            jumps = _stored(_followed(jumps, jumps))
    error = F.coalesce("error", F.when(F.col("hops") > max_redirects, TOO_MANY))
    return state.select(F.col("key").alias("url"), "to", F.col("hops").alias("n_hops"), error.alias("error")).select(
        "url", F.when(F.col("error").isNull(), F.col("to")).alias("final_url"), "n_hops", "error")
