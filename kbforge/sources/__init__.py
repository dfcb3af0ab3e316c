"""Scans (S1-S4, S10) and sinks."""

from kbforge.sources.readers import (
    KNOWLEDGE_SCHEMAS,
    load_knowledge_tables,
    read_eval_cases,
    read_pages,
    read_table,
    read_text_corpus,
    table_counts,
)
from kbforge.sources.writers import (
    export_chat_log,
    latest_by_key,
    write_documents,
    write_eval_run,
    write_extracted_tables,
    write_vectors,
)

__all__ = [
    "KNOWLEDGE_SCHEMAS",
    "load_knowledge_tables",
    "read_eval_cases",
    "read_pages",
    "read_table",
    "read_text_corpus",
    "table_counts",
    "export_chat_log",
    "latest_by_key",
    "write_documents",
    "write_eval_run",
    "write_extracted_tables",
    "write_vectors",
]
