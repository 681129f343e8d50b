"""Record types shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENT_TYPES = ("invoice", "contract", "resume", "id_document", "unknown")
SENSITIVE_FIELDS = ("date_of_birth", "id_number", "vendor_bank_details")

_STRINGS = T.ArrayType(T.StringType())
_MAP = T.MapType(T.StringType(), T.StringType())


def _typed(dtype: T.DataType, names: list[str]) -> list[T.StructField]:
    return [T.StructField(name, dtype) for name in names]


# The names of all fields of a record, and which belong to each type.
LINE_ITEM = T.StructType(
    _typed(T.StringType(), ["description"])
    + _typed(T.DoubleType(), ["quantity", "unit_price", "amount", "line_total"])
    + _typed(T.StringType(), ["hsn_sac_code"])
    + _typed(T.DoubleType(), ["tax_rate"])
)
WORK = T.StructType(
    _typed(T.StringType(), ["company", "title", "start_date", "end_date"])
    + _typed(_STRINGS, ["responsibilities"])
)
EDUCATION = T.StructType(_typed(T.StringType(), ["institution", "degree", "field", "graduation_year"]))
ISSUE = T.StructType(_typed(T.StringType(), ["field", "message", "severity"]))
FINDING = T.StructType(_typed(T.StringType(), ["category", "message", "severity", "detail"]))

# Values that stand in for an explicit or implicit null. Every other field is
# nullable; arrays and maps are never null.
RECORD_DEFAULTS: dict[str, object] = {
    "description": "",
    "quantity": 1.0,
    "unit_price": 0.0,
    "amount": 0.0,
    "company": "",
    "title": "",
    "institution": "",
}

# One superset record over all document types; fields of other types stay null
# or empty.
FIELDS = T.StructType(
    _typed(T.StringType(), [
            "vendor_name", "invoice_number", "invoice_date", "due_date", "po_number",
            "currency", "vendor_address", "vendor_tax_id", "vendor_bank_details", "bill_to",
            "ship_to",
        ])
    + [T.StructField("line_items", T.ArrayType(LINE_ITEM))]
    + _typed(T.DoubleType(), [
            "subtotal", "tax_amount", "cgst", "sgst", "igst", "discount", "shipping",
            "grand_total", "total_amount",
        ])
    + _typed(T.StringType(), ["payment_terms", "payment_method"])
    + _typed(_STRINGS, ["parties", "party_names"])
    + _typed(_MAP, ["party_roles"])
    + _typed(T.StringType(), ["effective_date", "expiration_date", "term_length", "renewal_type", "notice_period"])
    + _typed(T.DoubleType(), ["contract_value"])
    + _typed(T.StringType(), [
            "payment_schedule", "termination_clause", "liability_cap", "confidentiality",
            "governing_law", "jurisdiction",
        ])
    + _typed(T.BooleanType(), ["signatures_present"])
    + _typed(_STRINGS, ["signatory_names"])
    + _typed(T.StringType(), ["candidate_name", "full_name", "email", "phone", "location"])
    + _typed(_STRINGS, ["links"])
    + _typed(T.DoubleType(), ["years_experience", "total_years_experience"])
    + [
        T.StructField("work_history", T.ArrayType(WORK)),
        T.StructField("education", T.ArrayType(EDUCATION)),
    ]
    + _typed(_STRINGS, ["skills", "certifications", "languages"])
    + _typed(T.StringType(), [
            "id_type", "id_number", "date_of_birth", "expiry_date", "issuing_authority",
            "nationality",
        ])
    + _typed(_MAP, ["extra"])
)

FIELD_TYPES: dict[str, T.DataType] = {f.name: f.dataType for f in FIELDS.fields}

# The part of the record that belongs to each document type.
FIELDS_BY_TYPE: dict[str, list[str]] = {
    "invoice": [
        "vendor_name", "invoice_number", "invoice_date", "due_date", "po_number", "currency",
        "vendor_address", "vendor_tax_id", "vendor_bank_details", "bill_to", "ship_to",
        "line_items", "subtotal", "tax_amount", "cgst", "sgst", "igst", "discount", "shipping",
        "grand_total", "payment_terms", "payment_method",
    ],
    "contract": [
        "party_names", "party_roles", "effective_date", "expiration_date", "term_length",
        "renewal_type", "notice_period", "contract_value", "currency", "payment_schedule",
        "termination_clause", "liability_cap", "confidentiality", "governing_law",
        "jurisdiction", "signatures_present", "signatory_names",
    ],
    "resume": [
        "full_name", "candidate_name", "email", "phone", "location", "links",
        "total_years_experience", "work_history", "education", "skills", "certifications",
        "languages",
    ],
    "id_document": [
        "id_type", "full_name", "id_number", "date_of_birth", "expiry_date",
        "issuing_authority", "nationality",
    ],
}

RESULT = T.StructType(
    [
        T.StructField("job_id", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("document_type", T.StringType()),
        T.StructField("classification_confidence", T.DoubleType()),
        T.StructField("extraction_confidence", T.DoubleType()),
        T.StructField("fields", FIELDS),
        T.StructField("validation_issues", T.ArrayType(ISSUE)),
        T.StructField("security_findings", T.ArrayType(FINDING)),
        T.StructField("route", T.StringType()),
        T.StructField("route_reason", T.StringType()),
        T.StructField("retries", T.IntegerType()),
        T.StructField("error", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)


def default_value(dtype: T.DataType, name: str = "") -> Column:
    """What a field holds when nothing was extracted for it."""
    if isinstance(dtype, T.ArrayType):
        return F.array().cast(dtype)
    if isinstance(dtype, T.MapType):
        return F.create_map().cast(dtype)
    return F.lit(RECORD_DEFAULTS.get(name)).cast(dtype)


def build_fields(values: dict[str, Column]) -> Column:
    """A ``fields`` struct from the given columns, defaults elsewhere."""
    return F.struct(
        *[
            (values[f.name].cast(f.dataType) if f.name in values else default_value(f.dataType))
            .alias(f.name)
            for f in FIELDS.fields
        ]
    )


def empty_findings() -> Column:
    return F.array().cast(T.ArrayType(FINDING))


def empty_issues() -> Column:
    return F.array().cast(T.ArrayType(ISSUE))


def issue(field: str, message: Column | str, severity: str = "error") -> Column:
    message = F.lit(message) if isinstance(message, str) else message
    return F.struct(
        F.lit(field).alias("field"),
        message.alias("message"),
        F.lit(severity).alias("severity"),
    )


def finding(category: str, message: Column | str, severity: str, detail: Column | str) -> Column:
    message = F.lit(message) if isinstance(message, str) else message
    detail = F.lit(detail) if isinstance(detail, str) else detail
    return F.struct(
        F.lit(category).alias("category"),
        message.alias("message"),
        F.lit(severity).alias("severity"),
        detail.alias("detail"),
    )


def present(items: list[Column], dtype: T.StructType) -> Column:
    """Array of the items that are not null, in order."""
    if not items:
        return F.array().cast(T.ArrayType(dtype))
    return F.array_compact(F.array(*items))
