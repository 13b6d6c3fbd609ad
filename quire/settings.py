"""Settings of extraction runs: a TOML file, with sections for single books."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, fields, replace

#: What each setting may be: its type and a test that its value passes.
RULES = {
    "batch_size": (int, lambda x: x >= 1), "threads": (int, lambda x: x >= 1), "document_timeout_seconds": (int, lambda x: x >= 1),
    "ocr_mode": (str, lambda x: x in ("off", "auto", "full_page")), "table_mode": (str, lambda x: x in ("accurate", "fast")),
    "image_scale": (float, lambda x: 0.5 <= x <= 4), "min_source_chars": (int, lambda x: x >= 0), "min_retained_fraction": (float, lambda x: 0 <= x <= 1),
}


@dataclass(frozen=True)
class Settings:
    input_dir: str
    output_dir: str
    batch_size: int = 40
    threads: int = 4
    document_timeout_seconds: int = 1800
    ocr_mode: str = "off"
    table_mode: str = "accurate"
    image_scale: float = 2.0
    min_source_chars: int = 300
    min_retained_fraction: float = 0.45

    def __post_init__(self) -> None:
        bad = [name for name, (_, test) in RULES.items() if not test(getattr(self, name))]
        if bad:
            raise ValueError(f"out of range: {', '.join(bad)}")

    def with_(self, changes: dict, book: str) -> Settings:
        """These settings with a book's own; names that no book may set are an error."""
        unknown = sorted(set(changes) - set(RULES))
        if unknown:
            raise ValueError(f"unknown settings for {book}: {', '.join(unknown)}")
        return replace(self, **{k: RULES[k][0](v) for k, v in changes.items()})


def load(path: str, book: str | None = None) -> Settings:
    """Settings for a book (or for any); folders are relative to the file."""
    with open(path, "rb") as stream:
        raw = tomllib.load(stream)
    base = os.path.dirname(os.path.abspath(path))
    own = {f.name: raw[f.name] for f in fields(Settings) if f.name in raw}
    for name in ("input_dir", "output_dir"):
        own[name] = os.path.normpath(os.path.join(base, own[name]))
    own |= {k: kind(own[k]) for k, (kind, _) in RULES.items() if k in own}
    return Settings(**own).with_(raw.get("books", {}).get(book, {}) if book else {}, book or "")
