"""A batch job: files in, JSON records out, and how many documents failed."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.operators.source_text import from_content
from docmill.plans.documents import process_documents
from docmill.settings import Rules, Settings
from docmill.sources.results import to_record


def run_batch(
    files: DataFrame,
    path: str,
    rules: Rules,
    settings: Settings | None = None,
    as_of: dt.date | None = None,
    processed_at: dt.datetime | None = None,
    redact: bool = False,
    mode: str = "append",
) -> int:
    """Process files (``job_id, content``), write one JSON record per line below ``path`` and
    return the number of records with an error, as a job's exit status needs it.

    The records are counted as they were written, so nothing is processed twice. With
    ``redact`` personal data are masked in the text of each record.
    """
    documents = from_content(files).select("job_id", "scan_text", "body")
    results = process_documents(documents, rules, settings, as_of, processed_at)
    to_record(results, redact).select("result").write.mode(mode).text(path)
    written = files.sparkSession.read.text(path)
    error = F.get_json_object("value", "$.error")
    return written.where(error.isNotNull()).count()
