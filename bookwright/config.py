"""Settings of ingest and search, kept as TOML."""

from __future__ import annotations

import json
import tomllib
from dataclasses import asdict, dataclass, fields, replace

#: Sizes offered where a size is chosen from a list.
SIZES = (128, 256, 512, 1024, 2048)


@dataclass(frozen=True)
class Config:
    """How documents become chunks."""

    strategy: str = "hybrid"
    max_tokens: int = 512
    overlap_tokens: int = 64
    custom_tags: tuple[str, ...] = ()

    def to_toml(self) -> str:
        """The settings as TOML, under [chunking] and [metadata]."""
        own = asdict(self)
        tags = own.pop("custom_tags")
        lines = ["[chunking]", *(f"{k} = {json.dumps(v)}" for k, v in own.items()), "", "[metadata]", f"custom_tags = {json.dumps(list(tags))}", ""]
        return "\n".join(lines)

    @classmethod
    def from_toml(cls, text: str) -> Config:
        """Settings from TOML; unknown keys and missing ones don't matter."""
        found = {k: v for section in tomllib.loads(text).values() if isinstance(section, dict) for k, v in section.items()}
        known = {f.name for f in fields(cls)}
        kept = {k: tuple(v) if k == "custom_tags" else v for k, v in found.items() if k in known}
        return replace(cls(), **kept)

    def for_size(self, max_tokens: int) -> Config:
        """The same with another size, and an eighth of it as overlap."""
        return replace(self, max_tokens=max_tokens, overlap_tokens=max_tokens // 8)
