"""Options of a conversion: read from TOML, later sources over earlier ones."""

from __future__ import annotations

import json
import re
import tomllib
from dataclasses import asdict, dataclass, fields, replace


@dataclass(frozen=True)
class Options:
    verbose: int = 0
    debug_pipeline: str | None = None
    extra_css: str | None = None
    unsmarten_punctuation: bool = False
    chapter_regex: str | None = None
    remove_first_image: bool = False
    insert_metadata: bool = False
    linearize_tables: bool = False
    max_image_size: tuple[int, int] | None = None
    no_images: bool = False
    jpeg_quality: int = 80
    pdf_dpi: int = 200
    pdf_engine: str = "auto"

    @classmethod
    def load(cls, text: str, base: Options | None = None) -> Options:
        """Known fields of ``text`` over ``base``; a size is written WIDTHxHEIGHT, qualities are
        held within 1 and 100, an unknown engine is the automatic one."""
        got = {k: v for k, v in tomllib.loads(text).items() if k in {f.name for f in fields(cls)}}
        if "max_image_size" in got:
            m = re.fullmatch(r"(\d+)x(\d+)", str(got["max_image_size"]))
            got["max_image_size"] = (int(m[1]), int(m[2])) if m else None
        if "jpeg_quality" in got:
            got["jpeg_quality"] = min(100, max(1, got["jpeg_quality"]))
        if got.get("pdf_engine", "auto") not in ("auto", "text-only", "image-only"):
            got["pdf_engine"] = "auto"
        return replace(base or cls(), **got)

    def dump(self) -> str:
        rows = {k: v for k, v in asdict(self).items() if v is not None}
        if "max_image_size" in rows:
            rows["max_image_size"] = "{}x{}".format(*rows["max_image_size"])
        return "".join(f"{k} = {json.dumps(v)}\n" for k, v in rows.items())
