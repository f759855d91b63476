"""Vocabularies and patterns of the text rules."""

from __future__ import annotations

import json
import pkgutil
from functools import lru_cache


def _document(name: str) -> dict:
    return json.loads(pkgutil.get_data(__name__, name).decode("utf-8"))


@lru_cache(maxsize=1)
def technology_rules() -> dict:
    return _document("technologies.json")


@lru_cache(maxsize=1)
def query_set() -> dict:
    return _document("query_set.json")
