"""Settings of an extraction run: a frozen value that plan builders take, never read inside tasks."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    high_threshold: float = 90.0
    medium_threshold: float = 70.0
    min_ocr_confidence: float = 0.5
    max_image_side: int = 1600
    max_pages: int = 5
    max_pixels: int = 178_956_970  # of an image that is opened
    max_upload_bytes: int = 20 * 1024 * 1024
    max_files: int = 20
    window_lines: int = 6
    fuzzy_threshold: float = 90.0
    earliest_year: int = 1990
    latest_year: int = 2100
    use_fallback: bool = True
    prompt_version: str = "v3"

    @staticmethod
    def from_env(prefix: str = "PARCHMENT_", environ: dict[str, str] | None = None) -> Settings:
        """Defaults with overrides from variables such as PARCHMENT_MAX_PAGES; booleans accept 1, true and yes."""
        environ = os.environ if environ is None else environ
        given = {}
        for f in fields(Settings):
            raw = environ.get(prefix + f.name.upper())
            if raw is None:
                continue
            default = f.default
            given[f.name] = raw.strip().lower() in ("1", "true", "yes") if isinstance(default, bool) else type(default)(raw)
        return replace(Settings(), **given)


DEFAULTS = Settings()
