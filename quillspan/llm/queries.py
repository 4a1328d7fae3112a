"""The queries of all problems and their SQL, collected."""

from __future__ import annotations

import importlib

MODULES = ("repeated_lines", "one_form", "leakage", "quality", "main_text", "residue", "tokens", "mixture")
QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _name in MODULES:
    _module = importlib.import_module(f"quillspan.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
