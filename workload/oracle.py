"""The same results in DuckDB SQL, written independently of the operators.

Queries are assembled from common table expressions: documents, classification,
extraction, issues, findings, route.
"""

from __future__ import annotations

from docmill.functions import patterns as P
from workload.corpus import SUFFIXES, mixed_sql, render_sql

ORACLE: dict[str, str] = {}

SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
AS_OF = "DATE '2026-06-01'"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {SPACES})"


def rx(body: str, pattern: str, group: int = 1, flags: str = "(?i)") -> str:
    return f"nullif(regexp_extract({body}, {q(flags + pattern)}, {group}), '')"


def first(body: str, pattern: str, group: int = 1) -> str:
    return strip(rx(body, pattern, group))


def num(x: str) -> str:
    return f"try_cast(replace({x}, ',', '') AS DOUBLE)"


def r2(x: str) -> str:
    return f"cast(printf('%.2f', {x}) AS DOUBLE)"


def pack(items: list[str]) -> str:
    """List of the strings that are not null."""
    return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"


def opt(cond: str, *parts: str) -> str:
    return f"CASE WHEN {cond} THEN {' || '.join(parts)} END"


def with_(*ctes: tuple[str, str], final: str) -> str:
    body = ", ".join(f"{name} AS ({sql})" for name, sql in ctes)
    return f"WITH {body} {final}"


# --- Text ------------------------------------------------------------------

TEXT = (
    "SELECT job_id, CASE WHEN contains(text, chr(0)) THEN '' ELSE text END AS scan,"
    " replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS body"
    " FROM docs"
)


def text_ctes(source: str) -> list[tuple[str, str]]:
    return [("docs", source), ("t", TEXT)]


# --- Scans -----------------------------------------------------------------

# Word characters over Unicode, spelled out because \w and \b are ASCII here.
# Digits next to letters outside ASCII are told apart by mapping those to 'a'.
EMAIL = r"[\p{L}\p{N}_.\-]+@[\p{L}\p{N}_.\-]+\.[\p{L}\p{N}_]+"
PII_SQL = {label: (EMAIL if label == "email" else pattern) for label, pattern, _ in P.PII}


def pii_n(text: str, label: str) -> str:
    if label != "email":
        text = f"regexp_replace({text}, '[^\\x00-\\x7F]', 'a', 'g')"
    return f"len(regexp_extract_all({text}, {q(PII_SQL[label])}))"


def pii_items(text: str) -> list[str]:
    return [
        opt(
            f"{pii_n(text, label)} > 0",
            q("pii|warning|Detected "),
            f"{pii_n(text, label)}",
            q(f" {label} value(s).|category={label}"),
        )
        for label, _, _ in P.PII
    ]


def injection_items(text: str) -> list[str]:
    by_label: dict[str, list[str]] = {}
    for pattern, label, _ in P.INJECTION:
        by_label.setdefault(label, []).append(rx(text, pattern, 0))
    return [
        opt(
            f"coalesce({', '.join([*found, 'NULL'])}) IS NOT NULL",
            q(f"injection|error|Possible prompt injection ({label}).|Matched: '"),
            f"left(coalesce({', '.join([*found, 'NULL'])}), 80)",
            q("'"),
        )
        for label, found in by_label.items()
    ]


def entry(text: str = "scan") -> str:
    return f"list_concat({pack(injection_items(text))}, {pack(pii_items(text))})"


def redact(text: str) -> str:
    # Letters beyond ASCII are flanked by ASCII letters while the patterns run,
    # so that \b sees them as parts of words.
    text = f"regexp_replace({text}, '([^\\x00-\\x7F])', 'qZ\\1Zq', 'g')"
    for label, _, placeholder in P.PII:
        text = f"regexp_replace({text}, {q(PII_SQL[label])}, {q(placeholder)}, 'g')"
    return f"replace(replace({text}, 'qZ', ''), 'Zq', '')"


# --- Classification --------------------------------------------------------


def score(kind: str, body: str = "body") -> str:
    return "(" + " + ".join(
        f"cast(contains(lower({body}), {q(word)}) AS BIGINT)" for word in P.KEYWORDS[kind]
    ) + ")"


SCORES = ", ".join(f"{score(k)} AS score_{k}" for k in P.KEYWORDS)
HITS = "greatest(" + ", ".join(f"score_{k}" for k in P.KEYWORDS) + ")"
KIND = (
    f"CASE WHEN {HITS} = 0 THEN 'unknown' "
    + " ".join(f"WHEN score_{k} = {HITS} THEN '{k}'" for k in P.KEYWORDS)
    + " END"
)
CLASSIFIED = (
    f"SELECT *, {KIND} AS document_type,"
    f" CASE WHEN {HITS} = 0 THEN 0.3 ELSE"
    f" cast(printf('%.2f', least(0.5 + 0.15 * {HITS}, 0.99)) AS DOUBLE) END::DOUBLE"
    f" AS classification_confidence, {HITS} AS hits FROM (SELECT *, {SCORES} FROM t)"
)

# --- Extraction ------------------------------------------------------------


def typed(kind: str, value: str) -> str:
    return f"CASE WHEN document_type = '{kind}' THEN {value} END"


def either(*values: str) -> str:
    return f"coalesce({', '.join(values)})"


def _extract_columns() -> dict[str, str]:
    cols: dict[str, str] = {}
    for name, pattern in P.INVOICE.items():
        value = first("body", pattern)
        number = name in ("total_amount", "subtotal", "tax_amount")
        cols[name] = typed("invoice", num(value) if number else value)
    for i, name in enumerate(["qty", "dsc", "unit", "amt"], start=1):
        cols[name] = typed(
            "invoice", f"regexp_extract_all(body, {q('(?i)' + P.LINE_ITEM)}, {i})"
        )
    cols["party1"] = typed("contract", first("body", P.PARTIES, 1))
    cols["party2"] = typed("contract", first("body", P.PARTIES, 2))
    for name, pattern in P.CONTRACT.items():
        cols[name] = typed("contract", first("body", pattern))
    cols["signed"] = typed("contract", f"regexp_matches(body, {q('(?i)' + P.SIGNED)})")
    cols["candidate_name"] = typed("resume", first("body", P.RESUME["candidate_name"]))
    cols["email"] = typed("resume", first("body", P.RESUME["email"], 0))
    cols["phone"] = typed("resume", first("body", P.RESUME["phone"], 0))
    cols["location"] = typed("resume", first("body", P.RESUME["location"]))
    cols["links"] = typed("resume", f"regexp_extract_all(body, {q(P.LINKS)})")
    skills = first("body", P.RESUME["skills"])
    cols["skills"] = typed(
        "resume",
        f"list_filter(list_transform(regexp_split_to_array({skills}, '[,;]'),"
        f" lambda s: {strip('s')}), lambda s: s <> '')",
    )
    cols["full_name"] = either(
        typed("resume", first("body", P.RESUME["candidate_name"])),
        typed("id_document", first("body", P.ID_DOCUMENT["full_name"])),
    )
    for name in ("id_number", "id_type", "date_of_birth", "expiry_date"):
        cols[name] = typed("id_document", first("body", P.ID_DOCUMENT[name]))
    return cols


EXTRACT_RAW = "SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in _extract_columns().items()) + " FROM c"
EXTRACTED = (
    "SELECT *, CASE document_type"
    " WHEN 'invoice' THEN CASE WHEN total_amount IS NOT NULL THEN 0.85 ELSE 0.5 END"
    " WHEN 'contract' THEN CASE WHEN party1 IS NOT NULL THEN 0.8 ELSE 0.5 END"
    " WHEN 'resume' THEN CASE WHEN coalesce(email, '') <> '' THEN 0.8 ELSE 0.5 END"
    " WHEN 'id_document' THEN CASE WHEN coalesce(id_number, '') <> '' THEN 0.8 ELSE 0.5 END"
    " ELSE 0.6 END::DOUBLE AS extraction_confidence,"
    " list_transform(amt, lambda x: try_cast(x AS DOUBLE)) AS amounts,"
    " list_filter(flatten(list_transform(range(1, len(unit) + 1),"
    " lambda i: [unit[i], amt[i]])), lambda x: try_cast(x AS DOUBLE) IS NULL)[1] AS bad_number"
    " FROM x0"
)
EXTRACT_CTES = [("c", CLASSIFIED), ("x0", EXTRACT_RAW), ("x", EXTRACTED)]


def forced(kind: str) -> list[tuple[str, str]]:
    """Extraction of one corpus with its type given."""
    return [
        *text_ctes(render_sql(kind)),
        ("c", f"SELECT *, '{kind}' AS document_type FROM t"),
        ("x0", EXTRACT_RAW),
        ("x", EXTRACTED),
    ]


# --- Validation ------------------------------------------------------------


def iso(x: str) -> str:
    return (
        f"CASE WHEN regexp_full_match({x}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')"
        f" THEN try_cast({x} AS DATE) END"
    )


def err(field: str, *message: str) -> list[str]:
    return [q(f"{field}|error|"), *message]


def warn(field: str, *message: str) -> list[str]:
    return [q(f"{field}|warning|"), *message]


def missing(field: str, cond: str) -> str:
    return opt(cond, *err(field, q(f"Required field '{field}' is missing.")))


def blank(x: str) -> str:
    return f"({x} IS NULL OR {strip(x)} = '')"


REQUIRED = {
    "invoice": [
        missing("vendor_name", blank("vendor_name")),
        missing("invoice_number", blank("invoice_number")),
        missing("total_amount", "total_amount IS NULL"),
        missing("invoice_date", blank("invoice_date")),
    ],
    "contract": [
        missing("parties", "party1 IS NULL"),
        missing("effective_date", blank("effective_date")),
    ],
    "resume": [
        missing("candidate_name", blank("candidate_name")),
        missing("email", blank("email")),
    ],
    "id_document": [
        missing("full_name", blank("full_name")),
        missing("id_number", blank("id_number")),
    ],
}
DATES = [
    opt(
        f"{d} <> '' AND ({iso(d)}) IS NULL",
        *err(d, q(f"Field '{d}' value '"), d, q("' is not a valid ISO date.")),
    )
    for d in (
        "invoice_date",
        "due_date",
        "effective_date",
        "expiration_date",
        "date_of_birth",
        "expiry_date",
    )
]
TAX = "coalesce(tax_amount, 0.0)"
LINES = r2("list_sum(amounts)")
CANDIDATES = (
    "list_filter(["
    f"CASE WHEN subtotal IS NOT NULL THEN {r2(f'subtotal + {TAX}')} END,"
    f"CASE WHEN len(amounts) > 0 THEN {r2(f'{LINES} + {TAX}')} END,"
    f"CASE WHEN len(amounts) > 0 THEN {LINES} END"
    "], lambda x: x IS NOT NULL)"
)
RECONCILE = opt(
    f"total_amount IS NOT NULL AND len({CANDIDATES}) > 0 AND"
    f" len(list_filter({CANDIDATES}, lambda x: abs(x - total_amount) <= 0.05::DOUBLE)) = 0",
    *err(
        "grand_total",
        q("Grand total "),
        "cast(total_amount AS VARCHAR)",
        q(" does not reconcile with components (candidates ["),
        f"array_to_string(list_transform(list_sort(list_distinct({CANDIDATES})),"
        " lambda x: cast(x AS VARCHAR)), ', ')",
        q("], tolerance 0.05)."),
    ),
)
DUE = opt(
    f"{iso('due_date')} < {iso('invoice_date')}",
    *err("due_date", q("due_date "), "due_date", q(" precedes invoice_date "), "invoice_date", q(".")),
)
TAX_PATTERNS = [
    "^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z]{1}[1-9A-Z]{1}Z[0-9A-Z]{1}$",
    "^[A-Z]{5}[0-9]{4}[A-Z]$",
    "^[0-9]{2}-?[0-9]{7}$",
    "^[A-Z]{2}[0-9A-Z]{2,12}$",
]
TAX_ID = opt(
    "vendor_tax_id <> '' AND NOT ("
    + " OR ".join(
        f"regexp_matches(upper(replace(vendor_tax_id, ' ', '')), '{p}')" for p in TAX_PATTERNS
    )
    + ")",
    *warn(
        "vendor_tax_id",
        q("Tax id '"),
        "vendor_tax_id",
        q("' does not match a known GSTIN/PAN/VAT/EIN format."),
    ),
)
VENDORS = ["acme corp", "globex", "initech", "umbrella industries", "stark industries"]
WHITELIST = opt(
    "vendor_name <> '' AND NOT ("
    + " OR ".join(f"contains(lower(vendor_name), '{v}')" for v in VENDORS)
    + ")",
    *warn("vendor_name", q("Vendor '"), "vendor_name", q("' is not in the whitelist.")),
)
CONTRACT_CHECKS = [
    opt(
        f"{iso('expiration_date')} <= {iso('effective_date')}",
        *err(
            "expiration_date",
            q("expiration_date "),
            "expiration_date",
            q(" is not after effective_date "),
            "effective_date",
            q("."),
        ),
    ),
    opt("party1 IS NULL", *err("party_names", q("A contract must name at least two parties."))),
    opt("NOT signed", *warn("signatures_present", q("No signatures detected on the contract."))),
]
ID_FORMATS = {
    "aadhaar": r"^[2-9][0-9]{3}\s?[0-9]{4}\s?[0-9]{4}$",
    "pan": "^[A-Z]{5}[0-9]{4}[A-Z]$",
    "passport": "^[A-Z][0-9]{7}$",
    "drivers_license": "^[A-Z0-9-]{6,20}$",
}
ID_CHECKS = [
    opt(
        f"{iso('expiry_date')} < {AS_OF}",
        *err("expiry_date", q("ID expired on "), "expiry_date", q(".")),
    ),
    opt(
        "id_type <> '' AND id_number <> '' AND ("
        + " OR ".join(
            f"(lower(id_type) = '{k}' AND NOT regexp_matches(upper({strip('id_number')}), '{p}'))"
            for k, p in ID_FORMATS.items()
        )
        + ")",
        *warn(
            "id_number",
            q("ID number does not match the expected format for "),
            "id_type",
            q("."),
        ),
    ),
]
INVOICE_CHECKS = [RECONCILE, DUE, TAX_ID, WHITELIST]


def by_type(parts: dict[str, list[str]]) -> str:
    arms = " ".join(f"WHEN '{k}' THEN {pack(v)}" for k, v in parts.items())
    return f"CASE document_type {arms} ELSE CAST([] AS VARCHAR[]) END"


ISSUES = (
    f"list_concat(list_concat({by_type(REQUIRED)}, {pack(DATES)}), "
    + by_type(
        {"invoice": INVOICE_CHECKS, "contract": CONTRACT_CHECKS, "id_document": ID_CHECKS}
    )
    + ")"
)

# --- Findings and route ----------------------------------------------------


def norm(x: str) -> str:
    return f"lower(regexp_replace({x}, '\\s+', ' ', 'g'))"


def grounding_items(names: dict[str, str]) -> list[str]:
    """``names`` maps a field to the column that holds it."""
    items = [
        opt(
            f"scan <> '' AND {col} <> '' AND NOT contains({norm('scan')}, {norm(col)})",
            q(f"grounding|warning|Extracted '{n}' not found verbatim in source.|{n}="),
            col,
        )
        for n, col in names.items()
    ]
    digits = "ltrim(regexp_replace(printf('%.2f', total_amount), '[^0-9]', '', 'g'), '0')"
    items.append(
        opt(
            "scan <> '' AND total_amount IS NOT NULL AND NOT contains("
            f"regexp_replace(scan, '[^0-9]', '', 'g'), coalesce(nullif({digits}, ''), '0'))",
            q("grounding|warning|Extracted 'total_amount' value not found in source.|total_amount="),
            "cast(total_amount AS VARCHAR)",
        )
    )
    return items


SENSITIVE = [
    opt(
        f"{n} <> ''",
        q(
            f"pii|warning|Sensitive field '{n}' is present and must be handled securely.|field={n}"
        ),
    )
    for n in ("date_of_birth", "id_number")
]
GROUNDED = {
    n: n for n in ("vendor_name", "invoice_number", "candidate_name", "id_number")
}
POST = pack(grounding_items(GROUNDED) + SENSITIVE)
PASSES = "CASE WHEN extraction_confidence < 0.75 THEN 2 ELSE 1 END"
JUDGED = (
    f"SELECT *, {ISSUES} AS issues, {PASSES} AS passes, {entry()} AS entry, {POST} AS post,"
    " 'could not convert string to float: ''' || bad_number || '''' AS error FROM x"
)
FOUND = (
    "SELECT *, list_concat(entry, CASE WHEN passes = 2 THEN list_concat(post, post) ELSE post END)"
    " AS findings FROM j"
)


def picks(items: str, prefix: str, not_prefix: str | None = None, skip: int = 0) -> str:
    return f"list_filter({items}, lambda x: split_part(x, '|', 2) = '{prefix}')"


def messages(items: str, field: bool) -> str:
    text = "split_part(x, '|', 1) || ': ' || split_part(x, '|', 3)" if field else "split_part(x, '|', 3)"
    return f"array_to_string(list_transform({items}, lambda x: {text}), '; ')"


ERRORS = "list_filter(issues, lambda x: split_part(x, '|', 2) = 'error')"
WARNINGS = "list_filter(issues, lambda x: split_part(x, '|', 2) = 'warning')"
INJECTED = "list_filter(findings, lambda x: split_part(x, '|', 1) = 'injection')"
REVIEW = "list_filter(findings, lambda x: split_part(x, '|', 1) = 'grounding')"
ARMS = [
    ("error IS NOT NULL", "reject", "'Pipeline error: ' || error"),
    ("document_type = 'unknown'", "reject", "'Document type could not be determined.'"),
    (f"len({INJECTED}) > 0", "reject", f"'Security: ' || {messages(INJECTED, False)}"),
    (f"len({ERRORS}) > 0", "reject", f"'Validation errors: ' || {messages(ERRORS, True)}"),
    (
        "document_type = 'invoice' AND total_amount > 10000",
        "flag_for_review",
        "'Invoice total ' || cast(total_amount AS VARCHAR) || ' exceeds auto-approve cap 10000.0.'",
    ),
    (
        f"len({REVIEW}) > 0",
        "flag_for_review",
        f"'Security review required: ' || {messages(REVIEW, False)}",
    ),
    (
        f"len({WARNINGS}) > 0",
        "flag_for_review",
        f"'Warnings require review: ' || {messages(WARNINGS, True)}",
    ),
    (
        "classification_confidence < 0.75",
        "flag_for_review",
        "'Classification confidence below threshold; manual confirmation advised.'",
    ),
]
ROUTED = (
    "SELECT *, CASE "
    + " ".join(f"WHEN {c} THEN '{r}'" for c, r, _ in ARMS)
    + " ELSE 'auto_approve' END AS route, CASE "
    + " ".join(f"WHEN {c} THEN {m}" for c, _, m in ARMS)
    + " ELSE 'All checks passed.' END AS route_reason FROM f"
)
ROUTE_CTES = [("j", JUDGED), ("f", FOUND), ("r", ROUTED)]
ALL = [*text_ctes(mixed_sql()), *EXTRACT_CTES, *ROUTE_CTES]
INVOICE_ALL = [*text_ctes(render_sql("invoice")), *EXTRACT_CTES, *ROUTE_CTES]
RESULT_SQL = (
    "SELECT job_id, CASE WHEN error IS NULL THEN 'completed' ELSE 'failed' END AS status,"
    " CASE WHEN error IS NULL THEN document_type ELSE 'unknown' END AS document_type,"
    " CASE WHEN error IS NULL THEN classification_confidence ELSE 0.0 END::DOUBLE"
    " AS classification_confidence,"
    " CASE WHEN error IS NULL THEN extraction_confidence ELSE 0.0 END::DOUBLE"
    " AS extraction_confidence,"
    " CASE WHEN error IS NULL THEN route END AS route,"
    " CASE WHEN error IS NULL THEN route_reason ELSE '' END AS route_reason,"
    " cast(CASE WHEN error IS NULL THEN passes ELSE 0 END AS BIGINT) AS retries,"
    " coalesce(error, '') AS error,"
    " CASE WHEN error IS NULL THEN len(issues) ELSE 0 END AS n_issues,"
    " CASE WHEN error IS NULL THEN len(findings) ELSE 0 END AS n_findings FROM r"
)

# --- The queries -----------------------------------------------------------

MIXED_TEXT = text_ctes(mixed_sql())

ORACLE["text_source"] = with_(
    *MIXED_TEXT,
    final="SELECT job_id, md5(scan) AS scan_md5, md5(body) AS body_md5,"
    " length(body) AS body_length FROM t",
)
_ext = "lower(regexp_extract(regexp_extract(url, '^[a-z]+://[^/]+([^?#]*)', 1), '[^/](\\.[^./]+)$', 1))"
# The types that the query's suffixes stand for.
_SUFFIX_TYPES = {
    ".zip": "application/zip",
    ".doc": "application/msword",
    ".MD": "text/markdown",
    ".svg": "image/svg+xml",
    ".tif": "image/tiff",
    ".mp4": "video/mp4",
    ".js": "text/javascript",
    ".bmp": "image/bmp",
    ".css": "text/css",
    ".tar.gz": "application/x-tar",
    ".tgz": "application/x-tar",
    ".txt.bz2": "text/plain",
    ".csv": "text/csv",
    ".PDF": "application/pdf",
    ".xls": "application/vnd.ms-excel",
    ".ppt": "application/vnd.ms-powerpoint",
    ".json.Z": "application/json",
}
_OWN_TYPES = {".html": "text/html", ".htm": "text/html", ".pdf": "application/pdf", ".txt": "text/plain",
              ".xml": "text/xml", ".json": "application/json", ".png": "image/png", ".jpg": "image/jpeg"}
_suffixes = "[" + ", ".join(q(x) for x in SUFFIXES) + "]"
_by_suffix = " ".join(f"WHEN {q(e)} THEN {q(m)}" for e, m in _SUFFIX_TYPES.items())
_own = " ".join(f"WHEN {q(e)} THEN {q(m)}" for e, m in _OWN_TYPES.items())
_guess = (
    f"coalesce(CASE suffix {_by_suffix} END, CASE WHEN suffix = '' THEN CASE {_ext}"
    f" {_own} END END, {{}})"
)
ORACLE["mime_guess"] = (
    f"SELECT page_id, {_guess.format(q('text/plain'))} AS batch_mime,"
    f" {_guess.format(q('application/octet-stream'))} AS upload_mime FROM (SELECT *,"
    f" {_suffixes}[page_id % {len(SUFFIXES)} + 1] AS suffix FROM pages)"
)
_UPLOADS = (
    "SELECT page_id, CASE page_id % 7 WHEN 0 THEN '.exe' WHEN 1 THEN '' WHEN 2 THEN '.pdf'"
    " WHEN 3 THEN '.jpeg' ELSE '.txt' END AS ext,"
    " CASE WHEN page_id % 9 = 0 THEN 0 ELSE strlen(html) END AS size,"
    " CASE page_id % 4 WHEN 0 THEN 'application/zip' WHEN 1 THEN NULL ELSE 'text/html' END AS mime"
    " FROM pages"
)
_REASON = (
    "CASE WHEN size = 0 THEN 'Uploaded file is empty.'"
    " WHEN size / 1048576.0 > 0.005 THEN 'File is ' || printf('%.1f', size / 1048576.0::DOUBLE)"
    " || ' MB, exceeding the 0.005 MB limit.'"
    " WHEN ext NOT IN ('.pdf', '.jpeg', '.txt') THEN 'Unsupported file type ''' ||"
    " CASE ext WHEN '' THEN '(none)' ELSE ext END ||"
    " '''. Allowed: .jpeg, .jpg, .pdf, .png, .tiff, .txt, .webp.' END"
)
ORACLE["input_gate"] = (
    f"SELECT page_id, cast(({_REASON}) IS NULL AS INTEGER) AS accepted,"
    f" cast(coalesce(mime = 'application/zip', false) AS INTEGER) AS mime_suspicious"
    f" FROM ({_UPLOADS})"
)
ORACLE["input_quarantine"] = (
    f"SELECT page_id, {_REASON} AS reject_reason FROM ({_UPLOADS}) WHERE ({_REASON}) IS NOT NULL"
)

GOLDEN_CTES = [
    ("lines", render_sql("golden")),
    ("v", "SELECT value, CASE WHEN json_valid(value) THEN value END AS j FROM lines WHERE trim(value) <> ''"),
    (
        "g",
        "SELECT j, j->>'$.name' AS name, j->>'$.file' AS file,"
        " coalesce(j->>'$.mime_type', 'text/plain') AS mime_type,"
        " j->>'$.expected_type' AS expected_type, j->>'$.expected_route' AS expected_route"
        " FROM v WHERE j IS NOT NULL AND j->>'$.name' IS NOT NULL",
    ),
]
ORACLE["golden_scan"] = with_(
    *GOLDEN_CTES,
    final="SELECT name, file, mime_type, expected_type, expected_route,"
    " cast(j->>'$.expected_fields.total_amount' AS DOUBLE) AS expected_total FROM g",
)
ORACLE["golden_rejects"] = with_(
    *GOLDEN_CTES[:2],
    final="SELECT value, CASE WHEN j IS NULL THEN 'not a JSON object' ELSE 'missing name' END"
    " AS problem FROM v WHERE j IS NULL OR j->>'$.name' IS NULL",
)
ORACLE["eval_set_split"] = with_(
    *GOLDEN_CTES,
    final="SELECT name, 'input' AS part, file || '|' || mime_type AS value FROM g"
    " UNION ALL SELECT name, 'output', expected_type || '|' || coalesce(expected_route, 'none')"
    " FROM g",
)

ORACLE["injection_scan"] = with_(
    *MIXED_TEXT,
    ("i", f"SELECT job_id, {pack(injection_items('scan'))} AS items FROM t"),
    final="SELECT job_id, array_to_string(items, ';') AS findings FROM i WHERE len(items) > 0",
)
_counts = ", ".join(f"{pii_n('scan', label)} AS n_{label}" for label, _, _ in P.PII)
ORACLE["pii_scan"] = with_(
    (
        "docs",
        mixed_sql()
        + " UNION ALL SELECT 'conv-' || conv_id || '-' || turn, text FROM conversations",
    ),
    ("t", TEXT),
    ("n", f"SELECT job_id, {_counts} FROM t"),
    final="SELECT * FROM n WHERE n_email + n_ssn + n_credit_card + n_phone > 0",
)
_sums = ", ".join(
    f"cast(sum({pii_n('text', label)}) AS BIGINT) AS n_{label}" for label, _, _ in P.PII
)
ORACLE["pii_by_source"] = (
    f"SELECT source, count(*) AS documents, {_sums} FROM documents GROUP BY source"
)
ORACLE["redact_text"] = with_(
    ("docs", mixed_sql()),
    ("c", f"SELECT job_id, text, {redact('text')} AS clean FROM docs"),
    final="SELECT job_id, md5(clean) AS clean_md5, cast(clean <> text AS INTEGER) AS changed FROM c",
)
ORACLE["mask_value"] = (
    "SELECT c_custkey, coalesce(CASE WHEN length(v) <= 4 THEN repeat('*', length(v))"
    " ELSE repeat('*', length(v) - 4) || right(v, 4) END, '') AS masked FROM (SELECT c_custkey,"
    " CASE c_custkey % 4 WHEN 0 THEN c_custkey::VARCHAR WHEN 1 THEN c_mktsegment WHEN 2 THEN c_name"
    " END AS v FROM customer)"
)
ORACLE["entry_findings"] = with_(
    *MIXED_TEXT,
    ("i", f"SELECT job_id, {entry()} AS items FROM t"),
    final="SELECT job_id, array_to_string(items, ';') AS findings FROM i WHERE len(items) > 0",
)
ORACLE["sensitive_fields"] = with_(
    *forced("id_document"),
    final="SELECT job_id, array_to_string("
    + pack(
        [
            opt("date_of_birth <> ''", q("pii|warning|field=date_of_birth")),
            opt("id_number <> ''", q("pii|warning|field=id_number")),
        ]
    )
    + ", ';') AS findings FROM x",
)


def masked(x: str) -> str:
    return (
        f"CASE WHEN length({x}) <= 4 THEN repeat('*', length({x}))"
        f" ELSE repeat('*', length({x}) - 4) || right({x}, 4) END"
    )


_RED = (
    f"SELECT job_id, {redact('full_name')} AS full_name, {masked('id_number')} AS id_number,"
    f" {masked('date_of_birth')} AS date_of_birth, {redact('expiry_date')} AS expiry_date,"
    f" {redact('email')} AS email, {redact('phone')} AS phone,"
    f" coalesce(array_to_string(list_transform(links, lambda l: {redact('l')}), ' '), '') AS links,"
    f" coalesce(array_to_string(list_transform(skills, lambda l: {redact('l')}), ','), '') AS skills"
)
ORACLE["redact_fields"] = (
    f"SELECT * FROM ({with_(*forced('id_document'), final=_RED + ' FROM x')})"
    f" UNION ALL SELECT * FROM ({with_(*forced('resume'), final=_RED + ' FROM x')})"
)
ORACLE["redact_record"] = with_(
    *text_ctes(render_sql("resume")),
    final=f"SELECT job_id, {redact('cast(to_json(struct_pack(job_id := job_id, body := body)) AS VARCHAR)')}"
    " AS record FROM t",
)
ORACLE["grounding"] = with_(
    *forced("invoice"),
    ("g", f"SELECT job_id, {pack(grounding_items(GROUNDED))} AS items FROM x"),
    final="SELECT job_id, array_to_string(list_transform(items,"
    " lambda x: split_part(x, '|', 3) || '|' || split_part(x, '|', 4)), ';') AS findings"
    " FROM g WHERE len(items) > 0",
)
ORACLE["all_findings"] = with_(
    *ALL, final="SELECT job_id, array_to_string(findings, ';') AS findings FROM f"
)

ORACLE["classify_scores"] = with_(*MIXED_TEXT, final=f"SELECT job_id, {SCORES} FROM t")
ORACLE["classify_documents"] = with_(
    *MIXED_TEXT,
    ("c", CLASSIFIED),
    final="SELECT job_id, document_type, classification_confidence, CASE WHEN hits = 0"
    " THEN 'No recognisable keywords found.' ELSE 'Matched ' || hits || ' keyword(s) for ' ||"
    " document_type || '.' END AS reasoning FROM c",
)
ORACLE["extract_invoice"] = with_(
    *forced("invoice"),
    final="SELECT job_id, vendor_name, invoice_number, invoice_date, due_date, po_number,"
    " total_amount, total_amount AS grand_total, subtotal, tax_amount, vendor_tax_id,"
    " payment_terms, 'USD' AS currency, extraction_confidence FROM x",
)
_PARTIES = "CASE WHEN party1 IS NULL THEN '' ELSE party1 || '|' || party2 END"
ORACLE["extract_contract"] = with_(
    *forced("contract"),
    final=f"SELECT job_id, {_PARTIES} AS parties, effective_date, expiration_date, governing_law,"
    " cast(signed AS INTEGER) AS signed, extraction_confidence FROM x",
)
ORACLE["extract_resume"] = with_(
    *forced("resume"),
    final="SELECT job_id, candidate_name, full_name, email, phone, location,"
    " coalesce(array_to_string(links, '|'), '') AS links,"
    " coalesce(array_to_string(skills, '|'), '') AS skills, extraction_confidence FROM x",
)
ORACLE["extract_id"] = with_(
    *forced("id_document"),
    final="SELECT job_id, full_name, id_number, id_type, date_of_birth, expiry_date,"
    " extraction_confidence FROM x",
)
ORACLE["extract_unknown"] = with_(
    *text_ctes(render_sql("unknown")),
    *EXTRACT_CTES,
    final="SELECT job_id, document_type, extraction_confidence,"
    " cast(vendor_name IS NULL AS INTEGER) AS no_vendor, coalesce(len(qty), 0) AS n_lines FROM x",
)
ORACLE["line_items"] = with_(
    *forced("invoice"),
    ("e", "SELECT job_id, qty, dsc, unit, amt, unnest(range(1, len(qty) + 1)) AS i FROM x"),
    final=f"SELECT job_id, i - 1 AS pos, {strip('dsc[i]')} AS description,"
    " cast(qty[i] AS DOUBLE) AS quantity, try_cast(unit[i] AS DOUBLE) AS unit_price,"
    " try_cast(amt[i] AS DOUBLE) AS amount, try_cast(amt[i] AS DOUBLE) AS line_total FROM e",
)
ORACLE["typed_invoices"] = with_(
    *ALL,
    final="SELECT job_id, vendor_name, invoice_number, invoice_date, total_amount AS grand_total,"
    " 'USD' AS currency, len(qty) AS n_lines FROM r"
    " WHERE error IS NULL AND document_type = 'invoice'",
)
ORACLE["typed_contracts"] = with_(
    *ALL,
    final=f"SELECT job_id, {_PARTIES} AS party_names, effective_date, expiration_date,"
    " governing_law FROM r WHERE document_type = 'contract'",
)

# Payloads.
_CUT = "nullif(regexp_extract(payload, '(?s)\\{.*\\}', 0), '')"
# The repeated key's last value, and bare words as strings, by where the corpus has them.
_PLAIN = (
    "replace(replace(replace(payload, '\"vendor_name\": \"first\", ', ''), ': NaN,', ': \"NaN\",'),"
    " ': -Infinity,', ': \"-Infinity\",')"
)
PAYLOAD_CTES = [
    ("q", render_sql("payload")),
    ("p", f"SELECT k, {_PLAIN} AS payload FROM q"),
    ("o", f"SELECT k, CASE WHEN json_valid({_CUT}) THEN {_CUT} ELSE '{{}}' END AS j FROM p"),
]


def jt(key: str) -> str:
    return f"json_type(j, '$.{key}')"


def js(key: str) -> str:
    return f"(j->>'$.{key}')"


def jnum(key: str) -> str:
    text = f"regexp_replace({js(key)}, '([0-9])_([0-9])', '\\1\\2', 'g')"
    return (
        f"CASE WHEN {jt(key)} = 'BOOLEAN' THEN CASE WHEN {js(key)} = 'true' THEN 1.0 ELSE 0.0 END"
        f" WHEN {jt(key)} = 'VARCHAR' THEN try_cast({text} AS DOUBLE)"
        f" WHEN {jt(key)} IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN cast({js(key)} AS DOUBLE) END"
    )


_CONF = f"coalesce(nullif({jnum('confidence')}, 0), {{}})::DOUBLE"
ORACLE["payload_parse"] = with_(
    *PAYLOAD_CTES,
    final="SELECT k, array_to_string(list_sort(json_keys(j)), ',') AS keys FROM o",
)
ORACLE["payload_classification"] = with_(
    *PAYLOAD_CTES,
    final=f"SELECT k, CASE WHEN lower({js('document_type')}) = 'invoice' THEN 'invoice'"
    " ELSE 'unknown' END AS document_type, "
    + _CONF.format("0.0")
    + f" AS classification_confidence, coalesce({js('reasoning')}, '') AS reasoning,"
    " CASE WHEN k % 20 = 18 THEN 'could not convert string to float: ''high'''"
    " WHEN k % 20 = 19 THEN 'float() argument must be a string or a real number, not ''list'''"
    " END AS classification_error FROM o",
)
_ITEM_OK = (
    f"({jt('line_items')} = 'ARRAY' AND coalesce({js('line_items[1].quantity')}, '') <> 'x')"
)
_LIST = f"CASE WHEN {_ITEM_OK} THEN cast(j->'$.line_items' AS JSON[]) ELSE CAST([] AS JSON[]) END"
_TOTAL = jnum("total_amount")
_GRAND = jnum("grand_total")
ORACLE["payload_fields"] = with_(
    *PAYLOAD_CTES,
    final=f"SELECT k, CASE WHEN {jt('vendor_name')} = 'VARCHAR' THEN {js('vendor_name')} END"
    f" AS vendor_name, coalesce({_TOTAL}, {_GRAND}) AS total_amount,"
    f" CASE WHEN lower({js('signatures_present')}) = 'yes' THEN 1 END AS signed,"
    f" CASE WHEN {jt('parties')} = 'ARRAY' THEN 'A|B' ELSE '' END AS party_names,"
    f" {js('party_roles.A')} AS role_a, len({_LIST}) AS n_lines,"
    f" coalesce(list_sum(list_transform({_LIST}, lambda x: coalesce("
    "cast(x->>'$.line_total' AS DOUBLE), cast(x->>'$.amount' AS DOUBLE), 0.0))), 0.0)"
    " AS line_sum,"
    f" coalesce(list_sum(list_transform({_LIST}, lambda x: coalesce("
    "cast(x->>'$.quantity' AS DOUBLE), 1.0))), 0.0) AS quantity,"
    f" cast(coalesce(json_array_length(j, '$.education'), 0) AS BIGINT) AS n_education, "
    + _CONF.format("0.7")
    + " AS extraction_confidence FROM o",
)
ORACLE["payload_dropped_keys"] = with_(
    *PAYLOAD_CTES,
    final="SELECT k, array_to_string("
    + pack(
        [
            opt(f"{jt('line_items')} <> 'NULL' AND NOT {_ITEM_OK}", "'line_items'"),
            opt(f"{js('party_names[1]')} = '3'", "'party_names'"),
            opt(f"{js('signatures_present')} = '2'", "'signatures_present'"),
            opt(f"{js('total_amount')} IS NOT NULL AND ({_TOTAL}) IS NULL", "'total_amount'"),
            opt(f"{jt('vendor_name')} NOT IN ('VARCHAR', 'NULL')", "'vendor_name'"),
        ]
    )
    + ", ',') AS dropped FROM o",
)
_GT = "CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END"
_TA = "CASE WHEN c_custkey % 2 = 0 THEN cast(c_custkey AS DOUBLE) END"
_P1 = "CASE WHEN c_custkey % 4 = 0 THEN c_name END"
_P2 = "CASE WHEN c_custkey % 6 = 0 THEN c_name || '|B' END"
_YE = "CASE WHEN c_custkey % 5 = 0 THEN 3.0::DOUBLE END"
ORACLE["alias_sync"] = (
    f"SELECT c_custkey, coalesce({_GT}, {_TA}) AS grand_total, coalesce({_TA}, {_GT})"
    f" AS total_amount, coalesce({_P1}, {_P2}, '') AS parties, coalesce({_P2}, {_P1}, '')"
    f" AS party_names, {_YE} AS years_experience, {_YE} AS total_years_experience FROM customer"
)


def checked(kind: str, items: list[str]) -> str:
    return with_(
        *forced(kind),
        ("k", f"SELECT job_id, {pack(items)} AS items FROM x"),
        final="SELECT job_id, array_to_string(items, ';') AS issues FROM k WHERE len(items) > 0",
    )


def union(parts: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT * FROM ({p})" for p in parts)


ORACLE["required_fields"] = union([checked(kind, items) for kind, items in REQUIRED.items()])
ORACLE["date_checks"] = union([checked(k, DATES) for k in ("invoice", "contract", "id_document")])
ORACLE["date_order"] = checked("invoice", [DUE])
ORACLE["reconcile"] = checked("invoice", [RECONCILE])
ORACLE["tax_id_format"] = checked("invoice", [TAX_ID])
ORACLE["vendor_whitelist"] = checked("invoice", [WHITELIST])
ORACLE["contract_checks"] = checked("contract", CONTRACT_CHECKS)
ORACLE["id_checks"] = checked("id_document", ID_CHECKS)
ORACLE["reconcile_orders"] = (
    "SELECT o_orderkey, cents, line_cents, n_lines, CASE WHEN n_lines = 0 THEN 'no lines'"
    " WHEN abs(cents - line_cents) <= 5 THEN 'reconciled' ELSE 'off' END AS status FROM ("
    "SELECT o_orderkey, any_value(cast(round(o_totalprice * 100) AS BIGINT)) AS cents,"
    " cast(sum(cast(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS line_cents,"
    " count(l_orderkey) AS n_lines"
    " FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)"
)
ORACLE["vendor_antijoin"] = (
    "SELECT s_suppkey, s_name FROM supplier WHERE NOT EXISTS (SELECT 1 FROM nation WHERE"
    " contains(lower(s_name), '#0000000' || lpad(cast(n_nationkey AS VARCHAR), 2, '0')))"
)
ORACLE["validate_documents"] = with_(
    *ALL,
    ("e", "SELECT job_id, issues, unnest(range(1, len(issues) + 1)) AS i FROM r"),
    final="SELECT job_id, i - 1 AS pos, split_part(issues[i], '|', 1) AS field,"
    " split_part(issues[i], '|', 2) AS severity, split_part(issues[i], '|', 3) AS message FROM e",
)
ORACLE["issue_counts"] = with_(
    *ALL, final=f"SELECT job_id, len({ERRORS}) AS errors, len({WARNINGS}) AS warnings FROM r"
)
ORACLE["populated_fields"] = with_(
    *forced("resume"),
    final="SELECT job_id, array_to_string(list_sort("
    + pack(
        [
            opt(f"{c} IS NOT NULL AND {c} <> ''", f"'{c}'")
            for c in ("candidate_name", "full_name", "email", "phone", "location")
        ]
        + [opt(f"len({c}) > 0", f"'{c}'") for c in ("links", "skills")]
    )
    + "), ',') AS populated FROM x",
)
ORACLE["retry_passes"] = with_(
    *MIXED_TEXT,
    *EXTRACT_CTES,
    final=f"SELECT job_id, extraction_confidence, cast({PASSES} AS BIGINT) AS passes FROM x",
)
ORACLE["route_documents"] = with_(
    *ALL, final="SELECT job_id, document_type, route, route_reason FROM r"
)
ORACLE["document_results"] = with_(*ALL, final=RESULT_SQL)
ORACLE["flagship"] = (
    "SELECT document_type, status, route, count(*) AS documents FROM ("
    + ORACLE["document_results"]
    + ") GROUP BY ALL"
)
ORACLE["result_json"] = (
    "SELECT job_id, status, document_type, route, n_issues, n_findings, retries FROM ("
    + ORACLE["document_results"]
    + ")"
)
ORACLE["result_roundtrip"] = with_(
    *INVOICE_ALL,
    final="SELECT job_id, CASE WHEN error IS NULL THEN 'completed' ELSE 'failed' END AS status,"
    " CASE WHEN error IS NULL THEN route END AS route,"
    " CASE WHEN error IS NULL THEN total_amount END AS total_amount,"
    " CASE WHEN error IS NULL THEN len(qty) ELSE 0 END AS n_lines,"
    " CASE WHEN error IS NULL THEN len(issues) ELSE 0 END AS n_issues FROM r",
)

# Vendors of a table besides those of the rules.
_LISTED = " OR ".join(f"contains(lower(vendor_name), '{v}')" for v in VENDORS)
ORACLE["whitelist_results"] = with_(
    *INVOICE_ALL,
    ("d", RESULT_SQL),
    final="SELECT job_id, d.status, d.route, d.route_reason, CAST(d.n_issues > 0 AND len(list_filter(r.issues,"
    " lambda x: contains(x, 'is not in the whitelist.'))) > 0 AS INTEGER) AS off_list, n_issues, n_findings"
    " FROM d JOIN r USING (job_id)",
).replace(
    _LISTED,
    _LISTED + " OR EXISTS (SELECT 1 FROM supplier WHERE s_suppkey % 3 = 0"
    " AND contains(lower(vendor_name), lower(s_name)))",
)

# Rules by time: the later half does not know one vendor.
_LATER = "cast(split_part(job_id, '-', 2) AS BIGINT) % 1000 >= 500"
_UNDER = with_(
    *INVOICE_ALL,
    ("d", RESULT_SQL),
    final="SELECT job_id, status, route, route_reason, n_issues, 0::BIGINT AS rules_from FROM d",
)
_KNOWN = "contains(lower(vendor_name), 'globex')"
ORACLE["rules_over_time"] = (
    f"SELECT * FROM ({_UNDER}) WHERE NOT {_LATER} UNION ALL SELECT * REPLACE (500::BIGINT AS rules_from)"
    f" FROM ({_UNDER.replace(_KNOWN, 'false')}) WHERE {_LATER}"
)

# Evaluation.
EVAL_CTES = [
    *GOLDEN_CTES,
    *INVOICE_ALL,
    (
        "b",
        "SELECT g.*, CASE WHEN error IS NULL THEN document_type ELSE 'unknown' END AS ptype,"
        " CASE WHEN error IS NULL THEN route END AS proute,"
        " CASE WHEN error IS NULL THEN vendor_name END AS a_vendor,"
        " CASE WHEN error IS NULL THEN invoice_number END AS a_number,"
        " CASE WHEN error IS NULL THEN due_date END AS a_due,"
        " CASE WHEN error IS NULL THEN total_amount END AS a_total"
        " FROM g JOIN r ON g.name = r.job_id",
    ),
    (
        "m",
        "SELECT name, key, CASE json_type(j, '$.expected_fields.' || key)"
        " WHEN 'DOUBLE' THEN printf('%.2f', cast(j->>('$.expected_fields.' || key) AS DOUBLE))"
        " ELSE lower(trim(regexp_replace(j->>('$.expected_fields.' || key), '\\s+', ' ', 'g')))"
        " END AS expected, CASE key"
        " WHEN 'total_amount' THEN coalesce(printf('%.2f', a_total), '')"
        " ELSE lower(trim(regexp_replace(coalesce(CASE key WHEN 'vendor_name' THEN a_vendor"
        " WHEN 'invoice_number' THEN a_number ELSE a_due END, ''), '\\s+', ' ', 'g'))) END"
        " AS actual FROM (SELECT *, unnest(json_keys(j, '$.expected_fields')) AS key FROM b)",
    ),
    (
        "s",
        "SELECT b.name, cast(ptype = expected_type AS INTEGER) AS cls,"
        " CASE WHEN expected_route IS NOT NULL THEN cast(coalesce(proute = expected_route, false)"
        " AS INTEGER) END AS rt, coalesce(tp, 0) AS tp, coalesce(n, 0) - coalesce(tp, 0) AS fn,"
        " ptype, proute, expected_route FROM b LEFT JOIN (SELECT name, count(*) AS n,"
        " count(*) FILTER (WHERE expected = actual) AS tp FROM m GROUP BY name) USING (name)",
    ),
]


def f1(tp: str, fn: str) -> str:
    recall = f"({tp} / ({tp} + {fn})::DOUBLE)"
    return f"CASE WHEN {tp} > 0 THEN 2 * {recall} / (1 + {recall}) ELSE 0.0 END"


ORACLE["eval_per_example"] = with_(
    *EVAL_CTES,
    final="SELECT name, cls AS classification_ok, rt AS routing_ok, tp AS true_positive,"
    f" fn AS false_negative, round({f1('tp', 'fn')}, 3) AS field_f1, ptype AS predicted_type,"
    " proute AS predicted_route FROM s",
)
ORACLE["field_match"] = with_(
    *EVAL_CTES,
    final="SELECT name, key, expected, actual, cast(expected = actual AS INTEGER) AS matched FROM m",
)
ORACLE["field_accuracy_by_name"] = with_(
    *EVAL_CTES,
    final="SELECT key, count(*) FILTER (WHERE expected = actual) AS hits, count(*) AS labelled,"
    " round(count(*) FILTER (WHERE expected = actual) / count(*)::DOUBLE, 6) AS accuracy"
    " FROM m GROUP BY key",
)
_TOTALS = (
    "SELECT count(*) AS n, sum(cls) / count(*)::DOUBLE AS c, sum(rt) / count(rt)::DOUBLE AS r,"
    " sum(tp) AS tp, sum(fn) AS fn FROM s"
)
ORACLE["eval_report"] = with_(
    *EVAL_CTES,
    ("z", _TOTALS),
    final="SELECT n, round(c, 3) AS classification_accuracy, round(r, 3) AS routing_accuracy,"
    " 1.0::DOUBLE AS field_precision, round(tp / (tp + fn)::DOUBLE, 3) AS field_recall,"
    f" round({f1('tp', 'fn')}, 3) AS field_f1 FROM z",
)
_GATES = pack(
    [
        opt("c < 0.95", "'classification ' || printf('%.2f', c) || ' < 0.95'"),
        opt("r < 0.9", "'routing ' || printf('%.2f', r) || ' < 0.9'"),
        opt(f"{f1('tp', 'fn')} < 0.7", f"'field F1 ' || printf('%.2f', {f1('tp', 'fn')}) || ' < 0.7'"),
    ]
)
ORACLE["eval_gate"] = with_(
    *EVAL_CTES,
    ("z", _TOTALS),
    final=f"SELECT cast(len({_GATES}) = 0 AS INTEGER) AS passed,"
    f" array_to_string({_GATES}, '; ') AS failures FROM z",
)
ORACLE["experiment_scores"] = with_(
    *EVAL_CTES,
    final="SELECT name, 'classification_accuracy' AS key, cls::DOUBLE AS score FROM s"
    " UNION ALL SELECT name, 'routing_accuracy',"
    " (proute IS NOT DISTINCT FROM expected_route)::INTEGER::DOUBLE FROM s"
    " UNION ALL SELECT name, 'field_recall',"
    " CASE WHEN tp + fn = 0 THEN 1.0 ELSE round(tp / (tp + fn)::DOUBLE, 6) END FROM s",
)

# Quota: ranks within minutes, then a running count over the day.
QUOTA_CTES = [
    (
        "e",
        "SELECT event_id, ts, user_id % 5 AS client_id, cast(floor(epoch(ts)) AS BIGINT) AS sec"
        " FROM events",
    ),
    (
        "a",
        "SELECT *, row_number() OVER (PARTITION BY client_id, sec // 60 ORDER BY ts, event_id)"
        " AS rank FROM e",
    ),
    (
        "w",
        "SELECT *, coalesce(sum(CASE WHEN rank <= 1 THEN 1 ELSE 0 END) OVER (PARTITION BY"
        " sec // 86400 ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
        " AS before FROM a",
    ),
    (
        "d",
        "SELECT event_id, client_id, CASE WHEN before >= 200 OR rank > 1 THEN 'reject'"
        " ELSE 'accept' END AS decision, CASE WHEN before >= 200 THEN 'day' WHEN rank > 1"
        " THEN 'minute' END AS reason, CASE WHEN before >= 200 THEN 86400 - sec % 86400"
        " WHEN rank > 1 THEN 60 - sec % 60 END AS retry_after FROM w",
    ),
]
ORACLE["quota_decisions"] = with_(*QUOTA_CTES, final="SELECT * FROM d")
ORACLE["stream_quota"] = ORACLE["quota_decisions"]
ORACLE["quota_summary"] = with_(
    *QUOTA_CTES,
    final="SELECT client_id, decision, coalesce(reason, '-') AS reason, count(*) AS requests"
    " FROM d GROUP BY ALL",
)
_MOVES = (
    "SELECT 'job-' || user_id AS job_id, event_id || '.txt' AS filename,"
    " CASE WHEN event_type = 'signup' THEN 'queued' WHEN event_type IN ('view', 'click')"
    " THEN 'running' WHEN event_type = 'purchase' THEN 'completed' ELSE 'failed' END AS status,"
    " CASE WHEN event_type NOT IN ('signup', 'view', 'click') THEN props END AS result,"
    " event_id AS seq, ts FROM events"
)
_LATEST = (
    "SELECT job_id, arg_max(filename, (ts, seq)) AS filename,"
    " arg_max(status, (ts, seq)) AS status,"
    " arg_max(result, (ts, seq)) FILTER (WHERE result IS NOT NULL) AS result,"
    " epoch_us(min(ts)) AS created_at, epoch_us(max(ts)) AS updated_at FROM moves GROUP BY job_id"
)
ORACLE["job_latest"] = with_(("moves", _MOVES), final=_LATEST)
ORACLE["ledger_snapshot"] = ORACLE["job_latest"]
ORACLE["job_status_counts"] = with_(
    ("moves", _MOVES),
    ("l", _LATEST),
    final="SELECT status, count(*) AS jobs FROM l GROUP BY status",
)
ORACLE["job_lookup"] = with_(
    ("moves", _MOVES),
    ("l", _LATEST),
    final="SELECT a.job_id, l.status, CASE WHEN l.status IS NULL THEN 'unknown'"
    " WHEN l.result IS NULL THEN 'processing' ELSE 'ready' END AS answer"
    " FROM (SELECT 'job-' || c_custkey AS job_id FROM customer) a LEFT JOIN l USING (job_id)",
)
ORACLE["status_as_of"] = with_(
    ("moves", _MOVES),
    (
        "asked",
        "SELECT event_id AS request_id, 'job-' || (user_id + event_id % 2) AS job_id,"
        " to_timestamp(epoch_us(ts) // 1000000 + (event_id % 11) * 60)::TIMESTAMP AS asked_at"
        " FROM events WHERE event_id % 3 = 0",
    ),
    (
        "seen",
        "SELECT request_id, a.job_id, asked_at, arg_max(filename, (ts, seq)) AS filename,"
        " arg_max(status, (ts, seq)) AS status,"
        " arg_max(result, (ts, seq)) FILTER (WHERE result IS NOT NULL) AS result,"
        " min(ts) AS created_at, max(ts) AS updated_at"
        " FROM asked a LEFT JOIN moves m ON a.job_id = m.job_id AND m.ts <= asked_at GROUP BY ALL",
    ),
    final="SELECT request_id, job_id, filename, status, result, CASE WHEN status IS NULL THEN 'unknown'"
    " WHEN result IS NULL THEN 'processing' ELSE 'ready' END AS answer, epoch_us(asked_at) AS asked_at,"
    " epoch_us(created_at) AS created_at, epoch_us(updated_at) AS updated_at FROM seen",
)

# Models: the stand-ins' behaviour by the length of the document's text.
_LENGTHS = (
    "(SELECT doc_id, text, length(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)))"
    " AS n FROM documents)"
)
ORACLE["infer_stub"] = (
    "SELECT 'doc-' || doc_id AS job_id, 'invoice' AS document_type, 'N' || n"
    " AS invoice_number, n::DOUBLE AS total_amount, CASE WHEN n % 4 = 0 THEN 0.5"
    " ELSE 0.9 END::DOUBLE AS extraction_confidence,"
    " cast(CASE WHEN n % 4 = 0 THEN 2 ELSE 1 END AS BIGINT) AS attempts FROM "
    + _LENGTHS
)
_GONE = "request failed on spare: gone"
ORACLE["model_faults"] = (
    "SELECT 'doc-' || doc_id AS job_id, CASE WHEN n % 7 = 0 OR n % 5 = 1 THEN 'unknown' ELSE 'invoice' END"
    f" AS document_type, CASE WHEN n % 7 <> 0 AND n % 5 = 1 THEN '{_GONE}' END AS classify_error,"
    f" CASE WHEN n % 5 = 1 THEN '{_GONE}' WHEN n % 5 = 2 THEN"
    " 'request failed on spare: the answer is bytes, not text' WHEN n % 7 = 1 THEN 'spare;spare'"
    " WHEN n % 4 = 0 THEN 'spare;spare' ELSE 'spare' END AS attempts,"
    " CASE WHEN n % 5 IN (1, 2) OR n % 7 = 1 THEN '' ELSE 'Acme Corp' END AS vendor_name FROM "
    + _LENGTHS
)
_MODEL = (
    "SELECT doc_id, n, CASE WHEN n % 5 <> 0 AND n % 11 <> 3 THEN 'primary'"
    " WHEN n % 5 = 0 AND n % 20 <> 0 THEN 'backup' END AS served,"
    " CASE WHEN n % 5 = 0 AND n % 20 = 0 THEN"
    " 'all models exhausted (primary, backup): overloaded'"
    " WHEN n % 5 <> 0 AND n % 11 = 3 THEN 'request failed on primary: bad request' END"
    " AS err, n % 4 = 0 AS low FROM "
    + _LENGTHS
)
ORACLE["infer_failover"] = (
    "SELECT 'doc-' || doc_id AS job_id, served AS classify_served_by, err AS classify_error,"
    " CASE WHEN err IS NOT NULL THEN err WHEN low THEN served || ';' || served ELSE served END"
    f" AS attempts FROM ({_MODEL})"
)
# Every value the stand-in invents is looked up in the document.
_STUB_GROUND = [
    opt("NOT contains(hay, 'acme corp')", q("Extracted 'vendor_name' not found verbatim in source.")),
    opt("NOT contains(hay, 'n' || n)", q("Extracted 'invoice_number' not found verbatim in source.")),
    opt(
        "NOT contains(regexp_replace(hay, '[^0-9]', '', 'g'), CASE WHEN n = 0 THEN '0'"
        " ELSE n || '00' END)",
        q("Extracted 'total_amount' value not found in source."),
    ),
]
_STUB_LIST = pack(_STUB_GROUND)
ORACLE["model_results"] = with_(
    ("m", _MODEL),
    (
        "h",
        "SELECT m.*, lower(regexp_replace(text, '\\s+', ' ', 'g')) AS hay"
        " FROM m JOIN documents USING (doc_id)",
    ),
    ("g", f"SELECT *, {_STUB_LIST} AS once FROM h"),
    ("z", "SELECT *, CASE WHEN low THEN list_concat(once, once) ELSE once END AS found FROM g"),
    final="SELECT 'doc-' || doc_id AS job_id, CASE WHEN err IS NULL THEN 'completed'"
    " ELSE 'failed' END AS status, CASE WHEN err IS NULL THEN 'invoice' ELSE 'unknown' END"
    " AS document_type, CASE WHEN err IS NOT NULL THEN 'reject'"
    " WHEN n > 10000 OR len(found) > 0 THEN 'flag_for_review' ELSE 'auto_approve' END"
    " AS route, CASE WHEN err IS NOT NULL THEN 'Pipeline error: extraction_failed: ' || err"
    " WHEN n > 10000 THEN 'Invoice total ' || n || '.0 exceeds auto-approve cap 10000.0.'"
    " WHEN len(found) > 0 THEN 'Security review required: ' || array_to_string(found, '; ')"
    " ELSE 'All checks passed.' END AS route_reason,"
    " cast(CASE WHEN err IS NOT NULL THEN 0 WHEN low THEN 2 ELSE 1 END AS BIGINT) AS retries FROM z",
)
ORACLE["model_files"] = ORACLE["model_results"].replace(
    "ELSE once END AS found FROM g", "ELSE once END AS found FROM (SELECT * REPLACE"
    " (CASE WHEN doc_id % 2 = 1 THEN [] ELSE once END AS once) FROM g)"
)
ORACLE["stream_ingest"] = with_(
    *INVOICE_ALL,
    final="SELECT job_id, job_id || CASE WHEN n % 50 = 0 THEN '.exe' ELSE '.txt' END AS filename,"
    " CASE WHEN n % 50 = 0 THEN 'quarantined' WHEN error IS NULL THEN 'completed' ELSE 'failed' END"
    " AS status, CASE WHEN n % 50 <> 0 AND error IS NULL THEN route END AS route"
    " FROM (SELECT *, cast(replace(job_id, 'inv-', '') AS BIGINT) AS n FROM r)",
)
ORACLE["stream_status"] = with_(
    *INVOICE_ALL,
    final="SELECT job_id, CASE WHEN n % 50 = 0 THEN NULL WHEN error IS NULL THEN 'completed'"
    " ELSE 'failed' END AS status, CASE WHEN n % 50 = 0 THEN 'unknown' ELSE 'ready' END AS answer,"
    " CASE WHEN n % 50 <> 0 THEN CASE WHEN error IS NULL THEN document_type ELSE 'unknown' END END"
    " AS document_type, CASE WHEN n % 50 <> 0 AND error IS NULL THEN route END AS route,"
    " CASE WHEN n % 50 <> 0 THEN error END AS error"
    " FROM (SELECT *, cast(replace(job_id, 'inv-', '') AS BIGINT) AS n FROM r)",
)
ORACLE["intake_answers"] = with_(
    *QUOTA_CTES,
    (
        "sized",
        "SELECT *, CASE WHEN event_id % 11 = 0 THEN 0 ELSE event_id END AS size,"
        " decision = 'reject' AS limited FROM d",
    ),
    (
        "judged",
        "SELECT *, CASE WHEN size = 0 THEN 'Uploaded file is empty.' WHEN size / 1048576.0 > 25 THEN"
        " 'File is ' || printf('%.1f', size / 1048576.0::DOUBLE) || ' MB, exceeding the 25.0 MB limit.'"
        " WHEN event_id % 7 = 0 THEN 'Unsupported file type ''.exe''. Allowed: "
        + ", ".join(P.ALLOWED_EXTENSIONS)
        + ".' END AS why FROM sized",
    ),
    final="SELECT event_id, CASE WHEN limited THEN 'limited' WHEN why IS NOT NULL THEN 'rejected'"
    " ELSE 'queued' END AS answer, CASE WHEN limited AND reason = 'day' THEN"
    " 'Daily processing limit reached. Try again tomorrow.' WHEN limited THEN"
    " 'Too many requests; please slow down.' ELSE why END AS message, retry_after,"
    " CASE WHEN NOT limited THEN cast(event_id % 3 = 0 AS INTEGER) END AS mime_suspicious,"
    " CASE WHEN NOT limited AND why IS NULL THEN 'queued' END AS job_status FROM judged",
)
