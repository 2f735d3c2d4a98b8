"""Settings: built-in defaults, deep-merged with a YAML file; anything unreadable leaves the defaults."""

from __future__ import annotations

import copy
from pathlib import Path
from typing import Any

DEFAULTS: dict[str, Any] = {
    "paths": {"logs": "logs", "output": "output", "pii_rules": "shipped", "models": "models"},
    "limits": {"max_file_size_mb": 200, "max_pdf_pages": 1000, "pdf_chunk_pages": 10, "max_retries": 2, "retry_backoff_sec": 2.0},
    "ocr": {"engine": "paddle", "lang": "chinese_cht", "use_gpu": "auto", "dpi": 300, "min_text_len_per_page": 50, "digital_coverage": 0.8, "scanned_coverage": 0.1},
    "pii": {"default_mask": True, "operator": "replace", "audit_enabled": True},
    "compare": {"semantic_model_dir": "models/multilingual-MiniLM", "chunk_chars": 400},
    "batch": {"max_workers": 2},
}


def merge(base: dict, override: dict) -> dict:
    """``override`` over ``base``, section by section."""
    out = copy.deepcopy(base)
    for key, value in override.items():
        inner = out.get(key)
        out[key] = merge(inner, value) if isinstance(inner, dict) and isinstance(value, dict) else value
    return out


def load_settings(path: str | Path | None = None) -> dict[str, Any]:
    """The defaults, with the YAML file at ``path`` laid over them if it can be read as a mapping."""
    found: Any = None
    if path is not None:
        try:
            import yaml

            found = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
        except Exception:  # missing file, missing library, broken YAML: defaults
            found = None
    return merge(DEFAULTS, found) if isinstance(found, dict) else copy.deepcopy(DEFAULTS)
