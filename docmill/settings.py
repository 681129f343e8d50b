"""Configuration: run settings and business rules.

Both are small driver-side objects; operators fold them into the plan as
literals. Nothing here grows with the data.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

log = logging.getLogger(__name__)


# Session settings that suit the document plan. Fused code of this size exceeds
# what the JVM compiles; beyond the limit Spark runs the same projections as
# smaller compiled methods.
# A key that a model's answer repeats has its last value, as in other JSON readers.
SPARK_CONF = {
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Documents go to Python workers in batches of so many bytes.
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
}


@dataclass(frozen=True)
class Settings:
    """Operating limits of a run."""

    min_confidence: float = 0.75
    max_retries: int = 2
    guardrails: bool = True
    max_file_size_mb: float = 25.0
    quota_enabled: bool = True
    quota_per_minute: int = 10
    quota_per_day: int = 200


@dataclass(frozen=True)
class Rules:
    """Business rules; an empty instance means that no rule is configured."""

    thresholds: dict[str, Any] = field(default_factory=dict)
    vendor_whitelist: tuple[str, ...] = ()
    tax_id_formats: dict[str, str] = field(default_factory=dict)
    id_number_formats: dict[str, str] = field(default_factory=dict)
    document_types: dict[str, dict[str, Any]] = field(default_factory=dict)

    def required_fields(self, document_type: str) -> list[str]:
        return list(self.document_types.get(document_type, {}).get("required_fields", []))

    @property
    def total_tolerance(self) -> float:
        return self.document_types.get("invoice", {}).get("total_tolerance", 0.01)

    @property
    def invoice_cap(self) -> float | None:
        """Largest invoice total that may be approved without review."""
        value = self.thresholds.get("invoice_auto_approve_max_amount")
        return None if value is None else float(value)

    @classmethod
    def from_dict(cls, data: dict[str, Any] | None) -> Rules:
        data = data or {}
        return cls(
            thresholds=data.get("thresholds", {}),
            vendor_whitelist=tuple(data.get("vendor_whitelist", ())),
            tax_id_formats=data.get("tax_id_formats", {}),
            id_number_formats=data.get("id_number_formats", {}),
            document_types=data.get("document_types", {}),
        )


def load_rules(path: str | Path) -> Rules:
    """Read rules from YAML. A missing or broken file yields empty rules."""
    import yaml

    path = Path(path)
    if not path.exists():
        log.warning("no rules file at %s, going on without rules", path)
        return Rules()
    try:
        return Rules.from_dict(yaml.safe_load(path.read_text(encoding="utf-8")))
    except yaml.YAMLError:
        log.exception("rules file %s is not valid YAML, going on without rules", path)
        return Rules()


# The standard rule set (thresholds, vendors, id formats).
DEFAULT_RULES = Rules.from_dict(
    {
        "thresholds": {"min_confidence": 0.75, "invoice_auto_approve_max_amount": 10000.0},
        "vendor_whitelist": [
            "Acme Corp",
            "Globex",
            "Initech",
            "Umbrella Industries",
            "Stark Industries",
        ],
        "tax_id_formats": {
            "gstin": r"^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z]{1}[1-9A-Z]{1}Z[0-9A-Z]{1}$",
            "pan": r"^[A-Z]{5}[0-9]{4}[A-Z]$",
            "ein": r"^[0-9]{2}-?[0-9]{7}$",
            "vat": r"^[A-Z]{2}[0-9A-Z]{2,12}$",
        },
        "id_number_formats": {
            "aadhaar": r"^[2-9][0-9]{3}\s?[0-9]{4}\s?[0-9]{4}$",
            "pan": r"^[A-Z]{5}[0-9]{4}[A-Z]$",
            "passport": r"^[A-Z][0-9]{7}$",
            "drivers_license": r"^[A-Z0-9-]{6,20}$",
        },
        "document_types": {
            "invoice": {
                "required_fields": [
                    "vendor_name",
                    "invoice_number",
                    "total_amount",
                    "invoice_date",
                ],
                "total_tolerance": 0.05,
            },
            "contract": {"required_fields": ["parties", "effective_date"]},
            "resume": {"required_fields": ["candidate_name", "email"]},
            "id_document": {"required_fields": ["full_name", "id_number"]},
        },
    }
)
