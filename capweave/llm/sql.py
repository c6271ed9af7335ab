"""DuckDB SQL for the results that SQL can state."""

from __future__ import annotations

from capweave.llm import decontam, linededup

ORACLE: dict[str, str] = {
    "op5_decontaminate": decontam.sql(),
    "op10_line_dedup": f"SELECT doc_id, n_lines, n_dropped, emptied, md5(kept_text) AS kept_md5 FROM ({linededup.sql(columns='o.doc_id')})",
}
