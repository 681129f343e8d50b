"""Stand-in models for the inference queries: no network, answers read from the document."""

from __future__ import annotations

import json

from docmill.operators.infer import ModelError


class Stub:
    """Answers from the length of the document's text; ``primary`` and ``backup`` fail on some.

    The text is the body, or for a file that is not text the bytes, read as the type says.
    """

    def __init__(self, model: str) -> None:
        self.model = model

    def text(self, document: dict) -> str:
        if document.get("content") is None:
            return document["body"]
        wide = document["mime_type"] == "application/octet-stream"
        return bytes(document["content"]).decode("utf-16-le" if wide else "utf-8")

    def generate(self, task: str, document: dict) -> str:
        number = len(self.text(document))
        if self.model == "primary" and number % 5 == 0:
            raise ModelError(429, "quota")
        if self.model == "primary" and number % 11 == 3:
            raise ModelError(400, "bad request")
        if self.model == "backup" and number % 20 == 0:
            raise ModelError(503, "overloaded")
        if task == "classify":
            return json.dumps({"document_type": "Invoice", "confidence": 0.9})
        if "vendor_name" not in document["fields"]:
            return "{}"
        fields = {
            "vendor_name": "Acme Corp",
            "invoice_number": f"N{number}",
            "invoice_date": "2026-01-15",
            "grand_total": float(number),
            "confidence": 0.5 if number % 4 == 0 else 0.9,
        }
        return "Here you are: " + json.dumps(fields)


class Fragile(Stub):
    """Besides its answers: some nest without end, some end the program, some are no text."""

    def generate(self, task: str, document: dict) -> str:
        number = len(self.text(document))
        if number % 7 == 0 and task == "classify":
            return '{"document_type": "resume", "a": ' + "[" * 200_000
        if number % 5 == 1:
            raise SystemExit("gone")
        if number % 5 == 2 and task == "extract":
            return b"{}"
        if number % 7 == 1 and task == "extract":
            return '{"vendor_name": ' + '{"a": ' * 1500 + "1" + "}" * 1500 + "}"
        return super().generate(task, document)
