"""Settings of a review: what a file may say, in which ranges, and how the three model tiers inherit from each other."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace
from pathlib import Path
from typing import Any

TIERS = ("review", "verify", "summary")
# Limits of sampling settings, and of whole numbers.
SAMPLING = {"temperature": (0.0, 2.0), "top_p": (0.0, 1.0), "max_tokens": (1, 65_536)}
RANGES = {"caller_depth": (1, 3)}
FLAGS = ("include_callees", "proofs", "summary")
#: Parts of names that no file may hold, as it is read from the repository under review.
SECRETS, ENDPOINTS = ("api_key", "apikey", "token", "secret", "password"), ("base_url", "endpoint", "api_base")


class SettingsError(ValueError):
    """A setting that can't be used; the message names it and where it stands."""


@dataclass(frozen=True)
class Tier:
    """The model of one stage, where it is called, and its sampling settings; None inherits."""

    model: str | None = None
    base_url: str | None = None
    params: Mapping[str, float] | None = None


@dataclass(frozen=True)
class Settings:
    tiers: Mapping[str, Tier] = field(default_factory=dict)
    max_cost_per_run: float | None = None
    min_confidence: float = 0.7
    max_inline_comments: int = 10
    context_token_budget: int = 25_000
    caller_depth: int = 2
    include_callees: bool = True
    max_diff_tokens_per_call: int = 6_000
    summary: bool = True
    proofs: bool = True
    dimensions: tuple[str, ...] = ("correctness", "security")

    def tier(self, name: str) -> Tier:
        """What a stage uses: verify inherits from review, summary from verify.

        A model is inherited if none is named. An endpoint follows the model that is inherited, else it is the review's; one
        that is named wins. Sampling settings are inherited only along with the model.
        """
        own = self.tiers.get(name, Tier())
        if name == TIERS[0]:
            return Tier(own.model, own.base_url, dict(own.params or {}))
        above = self.tier(TIERS[TIERS.index(name) - 1])
        follows = own.model is None
        url = own.base_url or (above.base_url if follows else self.tier(TIERS[0]).base_url)
        params = own.params if own.params is not None else above.params if follows else {}
        return Tier(own.model or above.model, url, dict(params))

    def check_prefixes(self, prefixes: Mapping[str, str]) -> None:
        """Raise if a stage's model lacks the prefix that its endpoint asks for (prefixes by endpoint)."""
        for name in TIERS:
            t = self.tier(name)
            need = prefixes.get(t.base_url or "")
            if need and not (t.model or "").startswith(need):
                raise SettingsError(f"the {name} model {t.model!r} goes to {t.base_url}, which needs {need + (t.model or '')!r}")


def sampling(given: Any, key: str, source: str) -> dict[str, float]:
    """Checked sampling settings; a null has none."""
    if given is None:
        return {}
    if not isinstance(given, Mapping):
        raise SettingsError(f"{key} in {source} must be a mapping")
    made = {}
    for name, value in given.items():
        if name not in SAMPLING:
            raise SettingsError(f"{name!r} in {key} ({source}) can't be set; allowed: {', '.join(sorted(SAMPLING))}")
        low, high = SAMPLING[name]
        whole = isinstance(low, int)
        if isinstance(value, bool) or not isinstance(value, int | float) or whole and value != int(value):
            raise SettingsError(f"{name!r} in {key} ({source}) must be a {'whole ' if whole else ''}number, not {value!r}")
        if not low <= value <= high:
            raise SettingsError(f"{name!r} in {key} ({source}) must be between {low} and {high}, not {value}")
        made[name] = int(value) if whole else float(value)
    return made


def forbidden(given: Any, source: str) -> None:
    """Raise if any key at any depth names a secret or an endpoint."""
    if isinstance(given, Mapping):
        for key, value in given.items():
            name = str(key).lower()
            if name != "max_tokens" and any(x in name for x in SECRETS if x != "token") or name.endswith("token"):
                raise SettingsError(f"{key!r} in {source}: secrets belong in the environment, not in a file")
            if any(x in name for x in ENDPOINTS):
                raise SettingsError(f"{key!r} in {source}: endpoints belong in the environment, not in a file")
            forbidden(value, source)
    elif isinstance(given, list | tuple):
        for value in given:
            forbidden(value, source)


def from_mapping(given: Any, source: str, environment: Mapping[str, str] | None = None, prefix: str = "REVIEW") -> Settings:
    """Settings from what a file holds, then endpoints from the environment: PREFIX_BASE_URL, PREFIX_VERIFY_BASE_URL,
    PREFIX_SUMMARY_BASE_URL. Unknown keys are ignored."""
    given = given if given is not None else {}
    if not isinstance(given, Mapping):
        raise SettingsError(f"{source} must be a mapping, not {type(given).__name__}")
    forbidden(given, source)
    for name in FLAGS:
        if name in given and not isinstance(given[name], bool):
            raise SettingsError(f"{name!r} in {source} must be true or false, not {given[name]!r}")
    for name, (low, high) in RANGES.items():
        if name in given and (isinstance(given[name], bool) or not isinstance(given[name], int) or not low <= given[name] <= high):
            raise SettingsError(f"{name!r} in {source} must be a whole number from {low} to {high}, not {given[name]!r}")
    tiers = {}
    for name, lead in zip(TIERS, ("", "verify_", "summary_"), strict=True):
        key = f"{lead}model_params"
        params = sampling(given[key], key, source) if key in given else None
        url = (environment or {}).get(f"{prefix}_{lead.upper()}BASE_URL") or None
        tiers[name] = Tier(given.get(f"{lead}model"), url, params)
    plain = {f.name for f in fields(Settings)} - {"tiers", "dimensions"}
    made = replace(Settings(tiers), **{k: v for k, v in given.items() if k in plain})
    return replace(made, dimensions=tuple(given["dimensions"])) if "dimensions" in given else made


def read(path: str | Path | None, environment: Mapping[str, str] | None = None) -> Settings:
    """Settings of a YAML or JSON file; the defaults if there is none."""
    if path is None or not Path(path).exists():
        return from_mapping({}, "the defaults", environment)
    body = Path(path).read_text()
    try:
        from yaml import safe_load as load
    except ImportError:
        load = json.loads
    return from_mapping(load(body) if body.strip() else {}, str(path), environment)
