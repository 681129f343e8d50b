"""One query per operator, each over whole benchmark tables.

Results are flat columns so that they compare easily; nested values are shown as
joined text.
"""

from __future__ import annotations

import atexit
import datetime as dt
import shutil
import tempfile
from collections.abc import Callable
from dataclasses import replace

import docmill
import workload
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions import pii
from docmill.functions.columns import settle
from docmill.operators import (
    classify,
    evaluate,
    extract,
    gate,
    ledger,
    payload,
    quota,
    route,
    scan,
    validate,
)
from docmill.operators.infer import infer, model_chain
from docmill.operators.source_text import from_content, from_text
from docmill.plans.documents import analyse, process_documents
from docmill.plans.intake import intake, queued_jobs
from docmill.plans.model import process_with_model
from docmill.plans.versions import process_versioned
from docmill.schemas import FIELDS, build_fields
from docmill.settings import DEFAULT_RULES, SPARK_CONF, Settings
from docmill.sources import documents as files
from docmill.sources import golden, results
from docmill.sources.commits import Commits, read_committed
from docmill.streaming import jobs
from docmill.streaming.ingest import start_ingest
from docmill.streaming.quota import start_quota
from docmill.streaming.storage import fresh_folder
from workload import corpus
from workload.corpus import SUFFIXES, mixed, render, spread, table
from workload.models import Fragile, Stub

AS_OF = dt.date(2026, 6, 1)
PROCESSED = dt.datetime(2026, 6, 1, 12, 0, 0)
SETTINGS = Settings()
GATE = Settings(max_file_size_mb=0.005)
QUOTA = Settings(quota_per_minute=1, quota_per_day=200)

# Python workers get the code with the task; nothing need be installed there.
for package in (docmill, workload):
    cloudpickle.register_pickle_by_value(package)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        for key, value in SPARK_CONF.items():
            spark.conf.set(key, value)
        return f(spark, sf)

    QUERIES[f.__name__] = run
    return f


# --- Shared inputs ---------------------------------------------------------


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return from_text(mixed(spark, sf))


def kind_docs(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    return from_text(render(spark, sf, kind))


def fields_of(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    df = extract.extract(kind_docs(spark, sf, kind), only=kind)
    return df.withColumn("document_type", F.lit(kind))


def analysed(spark: SparkSession, sf: str) -> DataFrame:
    return analyse(docs(spark, sf), DEFAULT_RULES, SETTINGS, AS_OF)


def processed(spark: SparkSession, sf: str, kind: str | None = None) -> DataFrame:
    source = kind_docs(spark, sf, kind) if kind else docs(spark, sf)
    return process_documents(source, DEFAULT_RULES, SETTINGS, AS_OF, PROCESSED)


def big(column: Column | str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return column.cast("bigint")


def joined(items: str | Column, *names: str) -> Column:
    items = F.col(items) if isinstance(items, str) else items
    return F.array_join(
        F.transform(items, lambda x: F.concat_ws("|", *[x[n] for n in names])), ";"
    )


def shown_findings(items: str) -> Column:
    return joined(items, "category", "severity", "message", "detail")


def shown_issues(items: str) -> Column:
    return joined(items, "field", "severity", "message")


def uploads(spark: SparkSession, sf: str) -> DataFrame:
    """Upload metadata from the web pages: name, size and declared type."""
    pages = table(spark, sf, "pages")
    suffix = (
        F.when(F.col("page_id") % 7 == 0, F.lit(".EXE"))
        .when(F.col("page_id") % 7 == 1, F.lit(""))
        .when(F.col("page_id") % 7 == 2, F.lit(".PDF"))
        .when(F.col("page_id") % 7 == 3, F.lit(".jpeg"))
        .otherwise(F.lit(".txt"))
    )
    return pages.select(
        "page_id",
        F.concat(F.lit("/in/page"), F.col("page_id").cast("string"), suffix).alias("path"),
        F.when(F.col("page_id") % 9 == 0, F.lit(0))
        .otherwise(F.octet_length("html"))
        .cast("bigint")
        .alias("length"),
        F.when(F.col("page_id") % 4 == 0, F.lit("application/zip"))
        .when(F.col("page_id") % 4 == 1, F.lit(None))
        .otherwise(F.lit("text/html"))
        .alias("mime_type"),
    )


# --- Sources and gate ------------------------------------------------------

@query
def scan_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The table's own files as documents: name, size, type and a digest of their bytes."""
    found = files.with_digest(files.scan_files(spark, sf, "*.parquet"), spark, sf, "*.parquet")
    return found.select(
        F.element_at(F.split("path", "/"), -1).alias("file"),
        "length",
        "mime_type",
        "is_text_type",
        "bytes",
        "md5",
    )


@query
def text_source(spark: SparkSession, sf: str) -> DataFrame:
    raw = mixed(spark, sf).select("job_id", F.encode("text", "utf-8").alias("content"))
    df = from_content(raw)
    return df.select(
        "job_id",
        F.md5("scan_text").alias("scan_md5"),
        F.md5("body").alias("body_md5"),
        big(F.length("body")).alias("body_length"),
    )


@query
def mime_guess(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    path = F.regexp_extract("url", r"^[a-z]+://[^/]+([^?#]*)", 1)
    # Besides the pages' own suffixes, each of the list in turn.
    suffix = F.get(F.array(*[F.lit(x) for x in SUFFIXES]), F.pmod("page_id", F.lit(len(SUFFIXES))).cast("int"))
    path = F.when(suffix == "", path).otherwise(F.concat(path, F.lit("file"), suffix))
    return pages.select(
        "page_id",
        gate.guess_mime(path).alias("batch_mime"),
        gate.guess_mime(path, "application/octet-stream").alias("upload_mime"),
    )


@query
def input_gate(spark: SparkSession, sf: str) -> DataFrame:
    return gate.with_gate(uploads(spark, sf), GATE).select(
        "page_id",
        F.col("reject_reason").isNull().cast("int").alias("accepted"),
        F.col("mime_suspicious").cast("int").alias("mime_suspicious"),
    )


@query
def input_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    return gate.quarantined(gate.with_gate(uploads(spark, sf), GATE)).select(
        "page_id", "reject_reason"
    )


@query
def golden_scan(spark: SparkSession, sf: str) -> DataFrame:
    examples = golden.parse_golden(render(spark, sf, "golden"))
    return examples.select(
        "name",
        "file",
        "mime_type",
        "expected_type",
        "expected_route",
        F.try_variant_get("expected_fields", "$.total_amount", "double").alias("expected_total"),
    )


@query
def golden_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return golden.golden_rejects(render(spark, sf, "golden"))


@query
def eval_set_split(spark: SparkSession, sf: str) -> DataFrame:
    inputs, outputs = golden.split_golden(golden.parse_golden(render(spark, sf, "golden")))
    left = inputs.select(
        "name", F.lit("input").alias("part"), F.concat_ws("|", "file", "mime_type").alias("value")
    )
    right = outputs.select(
        "name",
        F.lit("output").alias("part"),
        F.concat_ws("|", "expected_type", F.coalesce("expected_route", F.lit("none"))).alias(
            "value"
        ),
    )
    return left.unionByName(right)


# --- Scans -----------------------------------------------------------------


@query
def injection_scan(spark: SparkSession, sf: str) -> DataFrame:
    df = scan.injection_findings(docs(spark, sf), "scan_text", "findings")
    return df.where(F.size("findings") > 0).select(
        "job_id", shown_findings("findings").alias("findings")
    )


@query
def pii_scan(spark: SparkSession, sf: str) -> DataFrame:
    talk = table(spark, sf, "conversations").select(
        F.concat_ws("-", F.lit("conv"), "conv_id", "turn").alias("job_id"), "text"
    )
    df = scan.pii_counts(from_text(mixed(spark, sf).unionByName(talk)), "scan_text")
    counts = ["n_email", "n_ssn", "n_credit_card", "n_phone"]
    return df.select("job_id", *[big(c).alias(c) for c in counts]).where(
        " + ".join(counts) + " > 0"
    )


@query
def pii_by_source(spark: SparkSession, sf: str) -> DataFrame:
    counts = scan.pii_counts(table(spark, sf, "documents").select("source", "text"), "text")
    return counts.groupBy("source").agg(
        F.count("*").alias("documents"),
        *[
            F.sum(big(c)).alias(c)
            for c in ["n_email", "n_ssn", "n_credit_card", "n_phone"]
        ],
    )


@query
def redact_text(spark: SparkSession, sf: str) -> DataFrame:
    clean = pii.redact_pii(F.col("text"))
    df = mixed(spark, sf).select("job_id", "text", clean.alias("clean"))
    return df.select(
        "job_id",
        F.md5("clean").alias("clean_md5"),
        (F.col("clean") != F.col("text")).cast("int").alias("changed"),
    )


@query
def mask_value(spark: SparkSession, sf: str) -> DataFrame:
    """Whole values of differing length: the key, the segment, the name, none at all."""
    key = F.col("c_custkey")
    value = (
        F.when(key % 4 == 0, key.cast("string"))
        .when(key % 4 == 1, F.col("c_mktsegment"))
        .when(key % 4 == 2, F.col("c_name"))
    )
    return table(spark, sf, "customer").select("c_custkey", pii.mask_value(value).alias("masked"))


@query
def entry_findings(spark: SparkSession, sf: str) -> DataFrame:
    df = scan.entry_findings(docs(spark, sf))
    return df.where(F.size("entry_findings") > 0).select(
        "job_id", shown_findings("entry_findings").alias("findings")
    )


@query
def sensitive_fields(spark: SparkSession, sf: str) -> DataFrame:
    df = fields_of(spark, sf, "id_document")
    items = F.array_compact(F.array(*scan.sensitive_findings(F.col("fields"))))
    return df.select("job_id", joined(items, "category", "severity", "detail").alias("findings"))


@query
def redact_fields(spark: SparkSession, sf: str) -> DataFrame:
    ids = fields_of(spark, sf, "id_document").unionByName(fields_of(spark, sf, "resume"))
    df = ids.select("job_id", pii.redact_value(F.col("fields"), FIELDS).alias("f"))
    return df.select(
        "job_id",
        *[
            F.col(f"f.{n}").alias(n)
            for n in ("full_name", "id_number", "date_of_birth", "expiry_date", "email", "phone")
        ],
        F.array_join("f.links", " ").alias("links"),
        F.array_join("f.skills", ",").alias("skills"),
    )


@query
def redact_record(spark: SparkSession, sf: str) -> DataFrame:
    record = F.to_json(F.struct("job_id", "body"))
    return kind_docs(spark, sf, "resume").select(
        "job_id", pii.redact_pii(record).alias("record")
    )


@query
def grounding(spark: SparkSession, sf: str) -> DataFrame:
    df = scan.field_findings(fields_of(spark, sf, "invoice"))
    found = F.filter("field_findings", lambda x: x["category"] == "grounding")
    df = df.select("job_id", found.alias("found")).where(F.size("found") > 0)
    return df.select("job_id", joined("found", "message", "detail").alias("findings"))


@query
def all_findings(spark: SparkSession, sf: str) -> DataFrame:
    return analysed(spark, sf).select(
        "job_id", shown_findings("security_findings").alias("findings")
    )


# --- Classification and extraction -----------------------------------------


@query
def classify_scores(spark: SparkSession, sf: str) -> DataFrame:
    names = [f"score_{t}" for t in ("invoice", "contract", "resume", "id_document")]
    return classify.keyword_scores(docs(spark, sf)).select(
        "job_id", *[big(n).alias(n) for n in names]
    )


@query
def classify_documents(spark: SparkSession, sf: str) -> DataFrame:
    return classify.classify(docs(spark, sf)).select(
        "job_id", "document_type", "classification_confidence", "reasoning"
    )


def _flat(df: DataFrame, *names: str) -> DataFrame:
    return df.select(
        "job_id", *[F.col(f"fields.{n}").alias(n) for n in names], "extraction_confidence"
    )


INVOICE_COLUMNS = (
    "vendor_name invoice_number invoice_date due_date po_number total_amount grand_total subtotal"
    " tax_amount vendor_tax_id payment_terms currency"
).split()


@query
def extract_invoice(spark: SparkSession, sf: str) -> DataFrame:
    df = fields_of(spark, sf, "invoice")
    return _flat(df, *INVOICE_COLUMNS)


@query
def extract_contract(spark: SparkSession, sf: str) -> DataFrame:
    df = fields_of(spark, sf, "contract")
    return df.select(
        "job_id",
        F.array_join("fields.party_names", "|").alias("parties"),
        "fields.effective_date",
        "fields.expiration_date",
        "fields.governing_law",
        F.col("fields.signatures_present").cast("int").alias("signed"),
        "extraction_confidence",
    )


@query
def extract_resume(spark: SparkSession, sf: str) -> DataFrame:
    df = fields_of(spark, sf, "resume")
    return df.select(
        "job_id",
        "fields.candidate_name",
        "fields.full_name",
        "fields.email",
        "fields.phone",
        "fields.location",
        F.array_join("fields.links", "|").alias("links"),
        F.array_join("fields.skills", "|").alias("skills"),
        "extraction_confidence",
    )


@query
def extract_id(spark: SparkSession, sf: str) -> DataFrame:
    names = ("full_name", "id_number", "id_type", "date_of_birth", "expiry_date")
    return _flat(fields_of(spark, sf, "id_document"), *names)


@query
def extract_unknown(spark: SparkSession, sf: str) -> DataFrame:
    df = extract.extract(classify.classify(kind_docs(spark, sf, "unknown")))
    return df.select(
        "job_id",
        "document_type",
        "extraction_confidence",
        F.col("fields.vendor_name").isNull().cast("int").alias("no_vendor"),
        big(F.size("fields.line_items")).alias("n_lines"),
    )


@query
def line_items(spark: SparkSession, sf: str) -> DataFrame:
    df = fields_of(spark, sf, "invoice")
    rows = df.select("job_id", F.posexplode("fields.line_items").alias("pos", "item"))
    return rows.select(
        "job_id",
        big("pos").alias("pos"),
        *[f"item.{n}" for n in ("description", "quantity", "unit_price", "amount", "line_total")],
    )


@query
def typed_invoices(spark: SparkSession, sf: str) -> DataFrame:
    df = results.typed_table(processed(spark, sf), "invoice")
    return df.select(
        "job_id", "vendor_name", "invoice_number", "invoice_date", "grand_total", "currency",
        big(F.size("line_items")).alias("n_lines"),
    )


@query
def typed_contracts(spark: SparkSession, sf: str) -> DataFrame:
    df = results.typed_table(processed(spark, sf), "contract")
    return df.select(
        "job_id", F.array_join("party_names", "|").alias("party_names"), "effective_date",
        "expiration_date", "governing_law",
    )


# --- Payloads --------------------------------------------------------------


@query
def payload_parse(spark: SparkSession, sf: str) -> DataFrame:
    df = payload.parse_payload(render(spark, sf, "payload"))
    keys = F.map_keys(F.try_variant_get("_payload", "$", "map<string,variant>"))
    return df.select("k", F.array_join(F.array_sort(keys), ",").alias("keys"))


@query
def payload_classification(spark: SparkSession, sf: str) -> DataFrame:
    return payload.classification(render(spark, sf, "payload")).drop("payload")


@query
def payload_fields(spark: SparkSession, sf: str) -> DataFrame:
    df = payload.extraction(render(spark, sf, "payload"))
    lines = F.col("fields.line_items")
    return df.select(
        "k",
        "fields.vendor_name",
        "fields.total_amount",
        F.col("fields.signatures_present").cast("int").alias("signed"),
        F.array_join("fields.party_names", "|").alias("party_names"),
        F.try_element_at("fields.party_roles", F.lit("A")).alias("role_a"),
        big(F.size(lines)).alias("n_lines"),
        validate.sum_lines(lines).alias("line_sum"),
        F.aggregate(lines, F.lit(0.0), lambda a, x: a + x["quantity"]).alias("quantity"),
        big(F.size("fields.education")).alias("n_education"),
        "extraction_confidence",
    )


@query
def payload_dropped_keys(spark: SparkSession, sf: str) -> DataFrame:
    df = payload.extraction(render(spark, sf, "payload"))
    return df.select("k", F.array_join("dropped_keys", ",").alias("dropped"))


@query
def alias_sync(spark: SparkSession, sf: str) -> DataFrame:
    k, name = F.col("c_custkey"), F.col("c_name")
    values = {
        "grand_total": F.when(k % 3 == 0, F.col("c_acctbal")),
        "total_amount": F.when(k % 2 == 0, k.cast("double")),
        "parties": F.when(k % 4 == 0, F.array(name)).otherwise(F.array().cast("array<string>")),
        "party_names": F.when(k % 6 == 0, F.array(name, F.lit("B"))).otherwise(
            F.array().cast("array<string>")
        ),
        "years_experience": F.when(k % 5 == 0, F.lit(3.0)),
    }
    df = table(spark, sf, "customer").withColumn("f", build_fields(values))
    df = df.select("c_custkey", extract.sync_aliases(F.col("f")).alias("f"))
    return df.select(
        "c_custkey",
        "f.grand_total",
        "f.total_amount",
        F.array_join("f.parties", "|").alias("parties"),
        F.array_join("f.party_names", "|").alias("party_names"),
        "f.years_experience",
        "f.total_years_experience",
    )


# --- Validation ------------------------------------------------------------


def _checked(df: DataFrame, items: list[Column]) -> DataFrame:
    df = df.withColumns(
        {
            "_candidates": validate.total_candidates(F.col("fields")),
            **validate.parsed_dates(F.col("fields")),
        }
    )
    df = settle(df, ["job_id"], {"issues": F.array_compact(F.array(*items))})
    return df.where(F.size("issues") > 0).select("job_id", shown_issues("issues").alias("issues"))


@query
def required_fields(spark: SparkSession, sf: str) -> DataFrame:
    parts = []
    for kind in ("invoice", "contract", "resume", "id_document"):
        names = DEFAULT_RULES.required_fields(kind)
        items = validate.required_field_issues(F.col("fields"), names)
        parts.append(_checked(fields_of(spark, sf, kind), items))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query
def date_checks(spark: SparkSession, sf: str) -> DataFrame:
    items = validate.date_issues(F.col("fields"))
    parts = [
        _checked(fields_of(spark, sf, k), items) for k in ("invoice", "contract", "id_document")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def date_order(spark: SparkSession, sf: str) -> DataFrame:
    return _checked(
        fields_of(spark, sf, "invoice"), [validate.date_order_issue(F.col("fields"))]
    )


@query
def reconcile(spark: SparkSession, sf: str) -> DataFrame:
    items = [
        validate.total_issue(
            F.col("fields"), F.col("_candidates"), DEFAULT_RULES.total_tolerance
        )
    ]
    return _checked(fields_of(spark, sf, "invoice"), items)


@query
def reconcile_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Stated order totals against their line sums, as a join of aggregates."""
    lines = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(
            F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("line_cents"),
            F.count("*").alias("n_lines"),
        )
    )
    orders = table(spark, sf, "orders").select(
        "o_orderkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents")
    )
    both = orders.join(lines, "o_orderkey", "left")
    off = F.abs(F.col("cents") - F.col("line_cents"))
    status = (
        F.when(F.col("n_lines").isNull(), F.lit("no lines"))
        .when(off <= 5, F.lit("reconciled"))
        .otherwise(F.lit("off"))
    )
    return both.select(
        "o_orderkey", "cents", "line_cents", F.coalesce("n_lines", F.lit(0)).alias("n_lines"),
        status.alias("status"),
    )


@query
def tax_id_format(spark: SparkSession, sf: str) -> DataFrame:
    items = [validate.tax_id_issue(F.col("fields"), DEFAULT_RULES)]
    return _checked(fields_of(spark, sf, "invoice"), items)


@query
def vendor_whitelist(spark: SparkSession, sf: str) -> DataFrame:
    items = [validate.whitelist_issue(F.col("fields"), DEFAULT_RULES)]
    return _checked(fields_of(spark, sf, "invoice"), items)


@query
def vendor_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers whose name contains no listed suffix; the list is a table."""
    listed = table(spark, sf, "nation").select(
        F.concat(F.lit("#0000000"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias(
            "entry"
        )
    )
    suppliers = table(spark, sf, "supplier").select("s_suppkey", "s_name")
    return validate.vendors_off_list(suppliers, listed, "s_name", "entry")


@query
def whitelist_results(spark: SparkSession, sf: str) -> DataFrame:
    """Results of invoices under the rules' vendors and a table of further ones."""
    listed = table(spark, sf, "supplier").where(F.col("s_suppkey") % 3 == 0).select(F.col("s_name").alias("entry"))
    invoices = kind_docs(spark, sf, "invoice")
    df = process_documents(invoices, DEFAULT_RULES, SETTINGS, AS_OF, PROCESSED, whitelist=listed)
    off = F.exists("validation_issues", lambda i: F.contains(i["message"], F.lit("is not in the whitelist.")))
    return df.select(
        "job_id", "status", "route", "route_reason", off.cast("int").alias("off_list"),
        big(F.size("validation_issues")).alias("n_issues"), big(F.size("security_findings")).alias("n_findings"),
    )


@query
def contract_checks(spark: SparkSession, sf: str) -> DataFrame:
    items = validate.contract_issues(F.col("fields"))
    return _checked(fields_of(spark, sf, "contract"), items)


@query
def id_checks(spark: SparkSession, sf: str) -> DataFrame:
    items = validate.id_issues(F.col("fields"), DEFAULT_RULES, F.lit(AS_OF))
    return _checked(fields_of(spark, sf, "id_document"), items)


@query
def validate_documents(spark: SparkSession, sf: str) -> DataFrame:
    df = analysed(spark, sf).select("job_id", F.posexplode("validation_issues").alias("pos", "i"))
    return df.select("job_id", big("pos").alias("pos"), "i.field", "i.severity", "i.message")


@query
def issue_counts(spark: SparkSession, sf: str) -> DataFrame:
    issues = F.col("validation_issues")
    return analysed(spark, sf).select(
        "job_id",
        big(F.size(F.filter(issues, lambda i: i["severity"] == "error"))).alias("errors"),
        big(F.size(F.filter(issues, lambda i: i["severity"] == "warning"))).alias("warnings"),
    )


@query
def populated_fields(spark: SparkSession, sf: str) -> DataFrame:
    df = results.populated_fields(fields_of(spark, sf, "resume"))
    keys = F.array_sort(F.map_keys("populated"))
    return df.select("job_id", F.array_join(keys, ",").alias("populated"))


# --- Retry, routing, results -----------------------------------------------


@query
def retry_passes(spark: SparkSession, sf: str) -> DataFrame:
    df = extract.extract(classify.classify(docs(spark, sf)))
    return df.select(
        "job_id",
        "extraction_confidence",
        big(route.passes(F.col("extraction_confidence"), SETTINGS)).alias("passes"),
    )


@query
def route_documents(spark: SparkSession, sf: str) -> DataFrame:
    return analysed(spark, sf).select("job_id", "document_type", "route", "route_reason")


@query
def rules_over_time(spark: SparkSession, sf: str) -> DataFrame:
    """Invoices of two times, the later one under rules that know one vendor less."""
    k = F.element_at(F.split("job_id", "-"), 2).cast("bigint")
    invoices = kind_docs(spark, sf, "invoice").withColumn("received_at", F.timestamp_seconds(k % 1000))
    begin = dt.datetime(1970, 1, 1)
    known = tuple(v for v in DEFAULT_RULES.vendor_whitelist if v != "Globex")
    versions = [(begin, DEFAULT_RULES), (begin + dt.timedelta(seconds=500), replace(DEFAULT_RULES, vendor_whitelist=known))]
    df = process_versioned(invoices, versions, SETTINGS, AS_OF, PROCESSED)
    return df.select(
        "job_id", "status", "route", "route_reason", big(F.size("validation_issues")).alias("n_issues"),
        big(F.unix_seconds("rules_from")).alias("rules_from"),
    )


@query
def document_results(spark: SparkSession, sf: str) -> DataFrame:
    return processed(spark, sf).select(
        "job_id", "status", "document_type", "classification_confidence",
        "extraction_confidence", "route", "route_reason", big("retries").alias("retries"),
        F.coalesce("error", F.lit("")).alias("error"),
        big(F.size("validation_issues")).alias("n_issues"),
        big(F.size("security_findings")).alias("n_findings"),
    )


@query
def result_json(spark: SparkSession, sf: str) -> DataFrame:
    """Records as masked JSON text, and what a JSON reader finds in them."""
    records = results.to_record(processed(spark, sf), redact=True)

    def member(name: str) -> Column:
        return F.get_json_object("result", f"$.{name}")

    return records.select(
        "job_id",
        "status",
        member("document_type").alias("document_type"),
        member("route").alias("route"),
        big(F.json_array_length(member("validation_issues"))).alias("n_issues"),
        big(F.json_array_length(member("security_findings"))).alias("n_findings"),
        big(member("retries")).alias("retries"),
    )


@query
def result_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    stored = results.to_record(processed(spark, sf, "invoice"))
    back = results.from_record(stored)
    return back.select(
        "job_id",
        "result.status",
        "result.route",
        "result.fields.total_amount",
        big(F.size("result.fields.line_items")).alias("n_lines"),
        big(F.size("result.validation_issues")).alias("n_issues"),
    )


# --- Evaluation ------------------------------------------------------------


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    examples = golden.parse_golden(render(spark, sf, "golden"))
    return evaluate.pair(examples, processed(spark, sf, "invoice"))


@query
def eval_per_example(spark: SparkSession, sf: str) -> DataFrame:
    df = evaluate.per_example(pairs(spark, sf))
    return df.select(
        "name",
        F.col("classification_ok").cast("int").alias("classification_ok"),
        F.col("routing_ok").cast("int").alias("routing_ok"),
        "true_positive",
        "false_negative",
        "field_f1",
        "predicted_type",
        "predicted_route",
    )


@query
def field_match(spark: SparkSession, sf: str) -> DataFrame:
    df = evaluate.field_outcomes(pairs(spark, sf))
    return df.withColumn("matched", F.col("matched").cast("int"))


@query
def field_accuracy_by_name(spark: SparkSession, sf: str) -> DataFrame:
    df = evaluate.accuracy_by_field(evaluate.field_outcomes(pairs(spark, sf)))
    return df.withColumn("accuracy", F.round("accuracy", 6))


@query
def eval_report(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.rounded(evaluate.report(evaluate.per_example(pairs(spark, sf))))


@query
def eval_gate(spark: SparkSession, sf: str) -> DataFrame:
    df = evaluate.gate(evaluate.report(evaluate.per_example(pairs(spark, sf))), 0.95, 0.9, 0.7)
    return df.select(
        F.col("passed").cast("int").alias("passed"), F.array_join("failures", "; ").alias("failures")
    )


@query
def experiment_scores(spark: SparkSession, sf: str) -> DataFrame:
    df = evaluate.experiment_scores(evaluate.per_example(pairs(spark, sf)))
    return df.withColumn("score", F.round("score", 6))


# --- Quota and ledger ------------------------------------------------------


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """Events as requests of five clients, which makes minutes and days overflow."""
    return table(spark, sf, "events").select(
        "event_id", "ts", (F.col("user_id") % 5).alias("client_id")
    )


@query
def quota_decisions(spark: SparkSession, sf: str) -> DataFrame:
    df = quota.decide(requests(spark, sf), QUOTA)
    return df.select(
        "event_id", "client_id", "decision", "reason", big("retry_after").alias("retry_after")
    )


@query
def quota_summary(spark: SparkSession, sf: str) -> DataFrame:
    df = quota.decide(requests(spark, sf), QUOTA)
    return df.groupBy("client_id", "decision", F.coalesce("reason", F.lit("-")).alias("reason")).agg(
        F.count("*").alias("requests")
    )


def job_transitions(spark: SparkSession, sf: str) -> DataFrame:
    """Events as state changes of one job per user."""
    kind = F.col("event_type")
    status = (
        F.when(kind == "signup", F.lit("queued"))
        .when(kind.isin("view", "click"), F.lit("running"))
        .when(kind == "purchase", F.lit("completed"))
        .otherwise(F.lit("failed"))
    )
    return table(spark, sf, "events").select(
        F.concat(F.lit("job-"), F.col("user_id").cast("string")).alias("job_id"),
        F.concat(F.col("event_id").cast("string"), F.lit(".txt")).alias("filename"),
        status.alias("status"),
        F.when(status.isin(*ledger.FINISHED), F.col("props")).alias("result"),
        F.col("event_id").alias("seq"),
        F.col("ts").alias("updated_at"),
    )


@query
def job_latest(spark: SparkSession, sf: str) -> DataFrame:
    df = ledger.latest(job_transitions(spark, sf))
    return df.select(
        "job_id", "filename", "status", "result",
        *[F.unix_micros(F.col(c).cast("timestamp")).alias(c) for c in ("created_at", "updated_at")],
    )


@query
def job_status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.status_counts(ledger.latest(job_transitions(spark, sf)))


@query
def job_lookup(spark: SparkSession, sf: str) -> DataFrame:
    asked = table(spark, sf, "customer").select(
        F.concat(F.lit("job-"), F.col("c_custkey").cast("string")).alias("job_id")
    )
    jobs = ledger.latest(job_transitions(spark, sf))
    return ledger.lookup(asked, jobs).select("job_id", "status", "answer")


def status_requests(spark: SparkSession, sf: str) -> DataFrame:
    """For every third event a question after some minutes, about the job of a user close by."""
    n, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    return table(spark, sf, "events").where(n % 3 == 0).select(
        n.alias("request_id"),
        F.concat(F.lit("job-"), (F.col("user_id") + n % 2).cast("string")).alias("job_id"),
        F.timestamp_seconds(F.unix_seconds(ts) + (n % 11) * 60).alias("asked_at"),
    )


@query
def status_as_of(spark: SparkSession, sf: str) -> DataFrame:
    """Answers as of the time of asking, jobs midway through their transitions included."""
    found = ledger.as_of(status_requests(spark, sf), job_transitions(spark, sf))
    return found.select(
        "request_id", "job_id", "filename", "status", "result", "answer",
        *[F.unix_micros(c).alias(c) for c in ("asked_at", "created_at", "updated_at")],
    )


# --- Models ----------------------------------------------------------------


CHAIN = model_chain("primary", " backup, primary")


def model_docs(spark: SparkSession, sf: str) -> DataFrame:
    return kind_docs(spark, sf, "unknown").select("job_id", "scan_text", "body")


@query
def infer_stub(spark: SparkSession, sf: str) -> DataFrame:
    df = infer(model_docs(spark, sf), Stub, ["spare"], SETTINGS)
    df = payload.classification(df, "classify_payload")
    df = payload.extraction(df.withColumn("last", F.element_at("attempts", -1)["payload"]), "last")
    return df.select(
        "job_id", "document_type", "fields.invoice_number", "fields.total_amount",
        "extraction_confidence", big(F.size("attempts")).alias("attempts"),
    )


@query
def infer_failover(spark: SparkSession, sf: str) -> DataFrame:
    df = infer(model_docs(spark, sf), Stub, CHAIN, SETTINGS)
    return df.select(
        "job_id",
        "classify_served_by",
        "classify_error",
        F.array_join(
            F.transform("attempts", lambda a: F.coalesce(a["served_by"], a["error"])), ";"
        ).alias("attempts"),
    )


@query
def model_faults(spark: SparkSession, sf: str) -> DataFrame:
    """A model whose answers nest too deep, are no text, or end the program for some documents."""
    df = infer(model_docs(spark, sf), Fragile, ["spare"], SETTINGS, lanes=4)
    df = payload.classification(df, "classify_payload")
    df = payload.extraction(df.withColumn("last", F.element_at("attempts", -1)["payload"]), "last")
    return df.select(
        "job_id",
        "document_type",
        "classify_error",
        F.array_join(F.transform("attempts", lambda a: F.coalesce(a["served_by"], a["error"])), ";").alias("attempts"),
        F.coalesce("fields.vendor_name", F.lit("")).alias("vendor_name"),
    )


def shown_results(df: DataFrame) -> DataFrame:
    return df.select(
        "job_id", "status", "document_type", "route", "route_reason",
        big("retries").alias("retries"),
    )


@query
def model_results(spark: SparkSession, sf: str) -> DataFrame:
    return shown_results(
        process_with_model(
            model_docs(spark, sf), Stub, CHAIN, DEFAULT_RULES, SETTINGS, AS_OF, PROCESSED
        )
    )


@query
def model_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files, every second one not text: the model gets their bytes and type."""
    text = F.regexp_replace("text", "\r\n?", "\n")
    odd = F.col("doc_id") % 2 == 1
    files = spread(table(spark, sf, "documents")).select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("job_id"),
        F.when(odd, F.lit("application/octet-stream")).otherwise(F.lit("text/plain")).alias("mime_type"),
        F.when(odd, F.encode(text, "UTF-16LE")).otherwise(F.encode(text, "UTF-8")).alias("content"),
    )
    df = process_with_model(
        from_content(files, keep_content=True), Stub, CHAIN, DEFAULT_RULES, SETTINGS, AS_OF,
        PROCESSED, ("job_id", "body", "mime_type", "content"),
    )
    return shown_results(df)


# --- Intake and streams ----------------------------------------------------


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for a stream: in the shared one, or in a local session without one in a
    folder that goes with the driver."""
    if spark.conf.get("spark.checkpoint.dir", None):
        return fresh_folder(spark, name)
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix=f"docmill-{name}-")
    atexit.register(shutil.rmtree, folder, True)
    return folder


def arrivals(
    df: DataFrame, folder: str, parts: list[Column], take: Callable[[DataFrame], object]
) -> None:
    """The rows of each part land one after another; ``take`` runs on the stream after each, as
    a batch that starts from what the one before left."""
    spark = df.sparkSession
    for part in parts:
        df.where(part).write.mode("append").parquet(f"{folder}/landing")
        take(spark.readStream.schema(df.schema).parquet(f"{folder}/landing"))


def ingested(spark: SparkSession, sf: str) -> str:
    """Invoices arriving in three batches; the folder with what came of them."""
    source, steps = corpus.CORPORA["invoice"]
    folder = work_folder(spark, "ingest")

    def take(stream: DataFrame) -> None:
        rendered = corpus.apply_steps(stream, steps)
        suffix = F.when(F.col("k") % 50 == 0, F.lit(".exe")).otherwise(F.lit(".txt"))
        arriving = rendered.select(
            "job_id",
            F.concat("job_id", suffix).alias("path"),
            F.octet_length("text").cast("bigint").alias("length"),
            F.lit("text/plain").alias("mime_type"),
            F.encode("text", "utf-8").alias("content"),
        )
        start_ingest(arriving, folder, DEFAULT_RULES, SETTINGS, AS_OF, PROCESSED).awaitTermination()

    orders = table(spark, sf, source)
    arrivals(orders, folder, [F.col("o_orderkey") % 3 == i for i in range(3)], take)
    return folder


@query
def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Invoices arriving as a stream of files, read back from the result table."""
    folder = ingested(spark, sf)
    names = jobs.jobs(spark, folder).select("job_id", "filename")
    done = read_committed(spark, folder, "results").join(names, "job_id")
    turned_away = read_committed(spark, folder, "quarantine")
    return done.select("job_id", "filename", "status", "route").unionByName(
        turned_away.select(
            "job_id", F.col("path").alias("filename"), F.lit("quarantined").alias("status"),
            F.lit(None).cast("string").alias("route"),
        )
    )


@query
def stream_status(spark: SparkSession, sf: str) -> DataFrame:
    """Status answers for all orders, from the ledger that the stream wrote."""
    folder = ingested(spark, sf)
    asked = table(spark, sf, "orders").select(
        F.concat(F.lit("inv-"), F.col("o_orderkey").cast("string")).alias("job_id")
    )
    return ledger.lookup(asked, jobs.jobs(spark, folder)).select(
        "job_id", "status", "answer", "document_type", "route", "error"
    )


@query
def ledger_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """The last state of each job, from a snapshot that four batches of transitions moved on."""
    folder, moves = work_folder(spark, "jobs"), job_transitions(spark, sf)
    for version in range(4):
        batch = moves.where(F.floor(F.col("seq") / 97) % 4 == version)
        Commits(spark, folder).write(version, jobs.advance(spark, folder, batch, version, buckets=16))
        jobs.expire(spark, folder, keep=1)
    return jobs.jobs(spark, folder).select(
        "job_id", "filename", "status", "result",
        *[F.unix_micros(c).alias(c) for c in ("created_at", "updated_at")],
    )


@query
def intake_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Events as uploads: quota, gate and first transition in one plan."""
    n = F.col("event_id")
    suffix = F.when(n % 7 == 0, F.lit(".exe")).otherwise(F.lit(".pdf"))
    uploads = table(spark, sf, "events").select(
        "event_id",
        "ts",
        (F.col("user_id") % 5).alias("client_id"),
        F.concat(n.cast("string"), suffix).alias("path"),
        F.when(n % 11 == 0, F.lit(0)).otherwise(n).cast("bigint").alias("length"),
        F.when(n % 3 == 0, F.lit("application/zip")).otherwise(F.lit("application/pdf")).alias("mime_type"),
    )
    answered = intake(uploads, QUOTA)
    queued = queued_jobs(answered, "path").select("filename", F.col("status").alias("job_status"))
    return answered.join(queued, answered["path"] == queued["filename"], "left").select(
        "event_id",
        "answer",
        "message",
        big("retry_after").alias("retry_after"),
        F.col("mime_suspicious").cast("int").alias("mime_suspicious"),
        "job_status",
    )


@query
def stream_quota(spark: SparkSession, sf: str) -> DataFrame:
    """Requests arriving in four batches, split by time."""
    events = table(spark, sf, "events").select(
        "event_id", "ts", (F.col("user_id") % 5).alias("client_id")
    )
    stamp = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = events.agg(F.min(stamp), F.max(stamp)).first()
    cuts = [low + (high + 1 - low) * i // 4 for i in range(5)]
    folder = work_folder(spark, "quota")

    def take(stream: DataFrame) -> None:
        start_quota(stream, folder, QUOTA).awaitTermination()

    parts = [(stamp >= a) & (stamp < b) for a, b in zip(cuts, cuts[1:])]
    arrivals(events, folder, parts, take)
    return spark.read.parquet(f"{folder}/decisions").select(
        "event_id", "client_id", "decision", "reason", big("retry_after").alias("retry_after")
    )


@query
def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Documents per type, status and route."""
    df = processed(spark, sf)
    return df.groupBy("document_type", "status", "route").agg(F.count("*").alias("documents"))
