"""Settings from a file of NAME=value lines and the environment, which takes precedence."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from pathlib import Path

# Names of settings, and older names that count where the new one is absent.
LEGACY = {"LLM_MODEL": "GEMINI_MODEL", "LLM_API_KEY": "GOOGLE_API_KEY", "WEB_SEARCH_PROVIDER": "SEARCH_PROVIDER"}


def _minutes(value: str) -> int:
    if not value.lstrip("+").isdecimal() or int(value) < 1:
        raise ValueError("POLL_INTERVAL_MINUTES must be a positive integer")
    return int(value)


@dataclass(frozen=True)
class Settings:
    """Every field has its name in a file, what it is without one, and how its text is read."""

    llm_provider: str = field(metadata={"name": "LLM_PROVIDER"})
    llm_model: str = field(metadata={"name": "LLM_MODEL"})
    llm_api_key: str = field(repr=False, metadata={"name": "LLM_API_KEY"})
    web_search_provider: str = field(metadata={"name": "WEB_SEARCH_PROVIDER", "default": "none"})
    firecrawl_api_key: str = field(repr=False, metadata={"name": "FIRECRAWL_API_KEY"})
    data_dir: str = field(metadata={"name": "DATA_DIR", "default": str(Path.home() / "pressdelta-data")})
    poll_interval_minutes: int = field(metadata={"name": "POLL_INTERVAL_MINUTES", "default": "60", "read": _minutes})

    @property
    def has_llm_key(self) -> bool:
        return bool(self.llm_api_key)

    @property
    def has_firecrawl_key(self) -> bool:
        return bool(self.firecrawl_api_key)

    def missing(self) -> list[str]:
        """What analysis needs and is not set."""
        needed = {"LLM_PROVIDER": self.llm_provider, "LLM_MODEL": self.llm_model, "LLM_API_KEY": self.llm_api_key}
        if self.web_search_provider == "firecrawl":
            needed["FIRECRAWL_API_KEY"] = self.firecrawl_api_key
        return [name for name, value in needed.items() if not value]

    def configured(self, sources: int) -> bool:
        """Whether setup is complete: a key, and a source to poll."""
        return self.has_llm_key and sources > 0

    def runtime(self) -> dict[str, str]:
        """What may be shown of the settings: keys are only said to be there or not."""
        return {
            "LLM provider": self.llm_provider, "LLM model": self.llm_model, "Web search provider": self.web_search_provider,
            "Data directory": self.data_dir, "LLM API key": "present" if self.has_llm_key else "missing",
        }


def lines(text: str) -> dict[str, str]:
    """NAME=value pairs; comments and lines without a name do not count, one pair of quotes goes."""
    found = {}
    for line in map(str.strip, text.splitlines()):
        name, equals, value = (part.strip() for part in line.partition("="))
        if equals and name and not line.startswith("#"):
            quoted = len(value) > 1 and value[0] in "\"'" and value.endswith(value[0])
            found[name] = value[1:-1] if quoted else value
    return found


def load(env_file: str | Path = ".env", environ: Mapping[str, str] | None = None) -> Settings:
    """Settings; a poll interval that is no positive whole number is an error."""
    path = Path(env_file)
    known = (lines(path.read_text(encoding="utf-8")) if path.is_file() else {}) | dict(os.environ if environ is None else environ)
    older = {new: known[old] for new, old in LEGACY.items() if old in known and new not in known}
    texts = {name: text.strip() for name, text in (known | older).items()}
    told = {f.name: (f.metadata, texts.get(f.metadata["name"]) or f.metadata.get("default", "")) for f in fields(Settings)}
    return Settings(**{name: how.get("read", str)(text) for name, (how, text) in told.items()})
