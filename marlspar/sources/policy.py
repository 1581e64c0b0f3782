"""Policy files: deep merge, vocabulary extensions, index fingerprints."""

from __future__ import annotations

import hashlib
import json

from ..functions import vocab


def merge(base: dict, override: dict) -> dict:
    """Nested mappings merge; anything else is replaced."""
    return {**base, **{k: merge(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in override.items()}}


def extended(table: dict[str, list[str]], extensions: dict[str, list[str]]) -> dict[str, list[str]]:
    """Phrase lists with a policy's further phrases; new names are added at the end."""
    out = {name: [*phrases] for name, phrases in table.items()}
    for name, more in extensions.items():
        out[name] = list(dict.fromkeys([*out.get(name, []), *more]))
    return out


def fingerprint(files: list[tuple[str, bytes]], extensions: dict, schema: int = 1) -> str:
    """Changes with the index schema, the vocabulary extensions and the files' bytes, not with ranking weights."""
    h = hashlib.sha256(f"{schema}|{json.dumps(extensions, sort_keys=True, ensure_ascii=False)}".encode())
    for name, raw in files:
        h.update(name.encode() + b"\0" + hashlib.sha256(raw).digest())
    return h.hexdigest()
