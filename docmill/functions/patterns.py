"""Patterns, keywords and labels that decide results.

Everything in this module is a fixed value.
"""

# Prompt-injection signatures in order of report: (pattern, label, a literal
# that every match contains). All ignore case.
INJECTION = [
    (
        r"ignore\s+(?:all\s+|the\s+)?(?:previous|prior|above)\s+instructions",
        "instruction override",
        "ignore",
    ),
    (r"disregard\s+(?:all\s+|the\s+)?(?:previous|prior|above)", "instruction override", "disregard"),
    (r"forget\s+(?:everything|all|your)\s+", "instruction override", "forget"),
    (r"you\s+are\s+now\s+", "role reassignment", "you"),
    (r"new\s+instructions?\s*[:\-]", "injected instruction block", "instruction"),
    (r"system\s*prompt", "system-prompt probe", "prompt"),
    (r"</?(?:system|assistant|instructions?)>", "fake role tag", "<"),
    (r"reveal\s+(?:your\s+)?(?:prompt|instructions|system)", "prompt extraction", "reveal"),
    (r"mark\s+(?:this|it)\s+as\s+(?:approved|valid|paid)", "decision manipulation", "mark"),
    (r"override\s+(?:the\s+)?(?:validation|rules|checks)", "control manipulation", "override"),
]

# Personal data in order of report and redaction: (label, pattern, placeholder).
PII = [
    ("email", r"[\w.\-]+@[\w.\-]+\.\w+", "[EMAIL]"),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b", "[SSN]"),
    ("credit_card", r"\b(?:\d[ -]?){13,16}\b", "[CARD]"),
    (
        "phone",
        r"\b(?:\+?\d{1,3}[ -]?)?(?:\(?\d{3}\)?[ -]?)\d{3}[ -]?\d{4}\b",
        "[PHONE]",
    ),
]

# Words whose presence votes for a document type, in order of preference.
KEYWORDS = {
    "invoice": ["invoice", "bill to", "amount due", "total"],
    "contract": ["agreement", "party", "hereby", "terms"],
    "resume": ["resume", "experience", "education", "skills"],
    "id_document": ["passport", "id number", "date of birth"],
}

# Field patterns. All ignore case except ``links``.
INVOICE = {
    "vendor_name": r"(?:vendor|from)\s*[:\-]\s*(.+)",
    "invoice_number": r"invoice\s*#\s*:?\s*(\S+)",
    "invoice_date": r"date\s*[:\-]\s*(\d{4}-\d{2}-\d{2})",
    "due_date": r"due\s*date\s*[:\-]\s*(\d{4}-\d{2}-\d{2})",
    "po_number": r"(?:po|p\.o\.)\s*#?\s*[:\-]?\s*(\S+)",
    "total_amount": r"(?:grand\s*)?total\s*[:\-]?\s*\$?\s*([\d,]+\.?\d*)",
    "subtotal": r"subtotal\s*[:\-]?\s*\$?\s*([\d,]+\.?\d*)",
    "tax_amount": r"tax\s*[:\-]?\s*\$?\s*([\d,]+\.?\d*)",
    "vendor_tax_id": r"(?:gstin|vat|ein|tax\s*id)\s*[:\-]?\s*(\S+)",
    "payment_terms": r"(?:payment\s*)?terms\s*[:\-]\s*(.+)",
}
# Of each match of some field patterns one of these literals is a part.
LITERALS = {
    "invoice": {
        "vendor_name": ["vendor", "from"],
        "invoice_number": ["invoice"],
        "invoice_date": ["date"],
        "due_date": ["due"],
        "po_number": ["po", "p.o."],
        "total_amount": ["total"],
        "subtotal": ["subtotal"],
        "tax_amount": ["tax"],
        "vendor_tax_id": ["gstin", "vat", "ein", "tax"],
        "payment_terms": ["terms"],
    },
    "contract": {
        "effective_date": ["effective"],
        "expiration_date": ["expir", "end"],
        "governing_law": ["governing"],
    },
    "resume": {"candidate_name": ["name"], "email": ["@"], "location": ["location"], "skills": ["skills"]},
    "id_document": {
        "full_name": ["name"],
        "id_number": ["id"],
        "id_type": ["passport", "driver", "aadhaar", "pan"],
        "date_of_birth": ["dob", "birth"],
        "expiry_date": ["expir"],
    },
}
LINE_ITEM = r"(\d+)\s*x\s*(.+?)\s*@\s*\$?([\d.]+)\s*=\s*\$?([\d.]+)"
PARTIES = r"between\s+(.+?)\s+and\s+(.+?)[.\n]"
SIGNED = r"signature|signed|/s/"
CONTRACT = {
    "effective_date": r"effective\s+date\s*[:\-]\s*(\d{4}-\d{2}-\d{2})",
    "expiration_date": r"(?:expir\w+|end)\s*date\s*[:\-]\s*(\d{4}-\d{2}-\d{2})",
    "governing_law": r"governing\s+law\s*[:\-]\s*(.+)",
}
LINKS = r"https?://\S+"
RESUME = {
    "candidate_name": r"name\s*[:\-]\s*(.+)",
    "email": r"[\w.\-]+@[\w.\-]+\.\w+",
    "phone": r"(?:\+?\d{1,3}[ -]?)?\(?\d{3}\)?[ -]?\d{3}[ -]?\d{4}",
    "location": r"location\s*[:\-]\s*(.+)",
    "skills": r"skills\s*[:\-]\s*(.+)",
}
ID_DOCUMENT = {
    "full_name": r"name\s*[:\-]\s*(.+)",
    "id_number": r"id\s*(?:number|#)?\s*[:\-]?\s*(\S+)",
    "id_type": r"(passport|driver'?s?\s*licen[cs]e|aadhaar|pan)",
    "date_of_birth": r"(?:dob|date\s+of\s+birth)\s*[:\-]\s*(\d{4}-\d{2}-\d{2})",
    "expiry_date": r"(?:expir\w+)\s*[:\-]?\s*(\d{4}-\d{2}-\d{2})",
}

# Input gate.
ALLOWED_EXTENSIONS = [".jpeg", ".jpg", ".pdf", ".png", ".tiff", ".txt", ".webp"]
ALLOWED_MIME_PREFIXES = ["image/", "application/pdf", "text/"]

# Model status codes that pass a request on to the next model.
FAILOVER_CODES = (429, 503)
