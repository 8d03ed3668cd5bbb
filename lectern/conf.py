"""Settings: defaults, then a file, then the environment."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields, replace

from lectern.functions import fixed


@dataclass(frozen=True)
class Conf:
    library_path: str = "library"
    chunk_tokens: int = fixed.CHUNK_TOKENS
    chunk_overlap: int = fixed.CHUNK_OVERLAP
    embedding_dim: int = 768
    image_megapixels: float = fixed.IMAGE_MEGAPIXELS
    page_megapixels: float = fixed.PAGE_MEGAPIXELS


def load(path: str | None = None, env: dict[str, str] | None = None) -> Conf:
    """A JSON file's values over the defaults, those of ``<name>.local.json`` beside it over them, ``LECTERN_<NAME>`` over all; unknown keys are errors."""
    conf, env = Conf(), os.environ if env is None else env
    kinds = {f.name: type(getattr(conf, f.name)) for f in fields(Conf)}
    values: dict[str, object] = {}
    for name in (path, f"{os.path.splitext(path)[0]}.local.json") if path else ():
        if name == path or os.path.exists(name):
            with open(name, encoding="utf-8") as f:
                values |= json.load(f)
    if unknown := set(values) - set(kinds):
        raise ValueError(f"no such settings: {', '.join(sorted(unknown))}")
    values |= {n: env[f"LECTERN_{n.upper()}"] for n in kinds if f"LECTERN_{n.upper()}" in env}
    return replace(conf, **{n: kinds[n](v) for n, v in values.items()})
