"""Settings from files: a YAML scope, and KEY=value environment files."""

from __future__ import annotations

import os
from pathlib import Path

from .. import config

#: Keys of the scope file and the parameters that they set.
SCOPE_KEYS = {"SME_TITLE_KEYWORDS": "title_keywords", "SME_LINH_VUC": "fields", "SME_NGANH": "sectors", "VALID_DOCUMENT_TYPES": "document_types"}


def read_scope(path: str) -> config.Scope:
    """Lists that the file lacks keep their defaults. A bare None in a list is the word None."""
    import yaml

    found = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    return config.Scope(**{field: tuple(str(x) for x in found[key]) for key, field in SCOPE_KEYS.items() if found.get(key)})


def load_environment(path: str) -> dict[str, str]:
    """Sets the variables that aren't set yet, and returns them. Blank lines and # comments don't count; a missing file sets none."""
    if not Path(path).exists():
        return {}
    new: dict[str, str] = {}
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        name, mark, value = line.strip().partition("=")
        name = name.strip()
        if mark and name and not name.startswith("#") and name not in os.environ:
            new[name] = os.environ[name] = value.strip().strip("\"'")
    return new
