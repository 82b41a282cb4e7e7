"""The configuration of a job, checked on the driver before anything runs."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any
from urllib.parse import urlsplit

from pagelake.functions.hashing import contract_signature
from pagelake.operators.dom import compile_selector
from pagelake.operators.paging import check_pattern

# What a job may ask for.
RENDERS = ("direct", "playwright")
PAGINATION = ("none", "url_pattern", "next_button", "infinite_scroll")
LIMITS = {
    "max_pages": (1, 10_000),
    "concurrency": (1, 20),
    "detail_concurrency": (1, 20),
    "delay": (0, 3600),
    "page_wait": (0, 120_000),
    "robots_timeout": (0.5, 20),
    "scroll_pause": (0, 3600),
    "max_scrolls": (1, 10_000),
}
DEFAULTS = {
    "concurrency": 1, "delay": 0.5, "page_wait": 3000, "detail_concurrency": 1, "robots_timeout": 5.0,
}


class ConfigError(ValueError):
    """A configuration that cannot run."""


def _mapping(value: Any, name: str) -> dict[str, Any]:
    if value is None:
        return {}
    if not isinstance(value, Mapping):
        raise ConfigError(f"{name} must be an object")
    return dict(value)


def _text_mapping(value: Any, name: str, filled: bool = False) -> dict[str, str]:
    out = _mapping(value, name)
    for k, v in out.items():
        if not isinstance(k, str) or not isinstance(v, str) or (filled and not (k.strip() and v.strip())):
            raise ConfigError(f"{name} must map text to text")
    return out


def _number(value: Any, name: str, kind: type) -> int | float:
    try:
        number = kind(value)
    except (TypeError, ValueError, OverflowError) as e:
        raise ConfigError(f"{name} must be a number") from e
    low, high = LIMITS.get(name, (1, math.inf))
    if not math.isfinite(number) or not low <= number <= high:
        raise ConfigError(f"{name} must be from {low} to {high}")
    return number


def _http_url(value: Any, name: str) -> str:
    try:
        parts = urlsplit(value.strip())
        good = parts.scheme in ("http", "https") and bool(parts.hostname)
        parts.port  # noqa: B018  a malformed port raises here
    except (AttributeError, ValueError) as e:
        raise ConfigError(f"{name} must be an http or https URL") from e
    if not good:
        raise ConfigError(f"{name} must be an http or https URL")
    return value.strip()


def _first_page(pattern: str, page: int) -> str:
    try:
        check_pattern(pattern)
        return pattern.format(page=page)
    except (ValueError, KeyError, IndexError) as e:
        raise ConfigError("url_pattern may only hold {page}") from e


@dataclass(frozen=True)
class JobConfig:
    """What to read from pages and what to do with the rows."""

    name: str = "result"
    render: str = "direct"
    first_url: str | None = None
    pagination: dict[str, Any] = field(default_factory=lambda: {"type": "none"})
    item_selector: str = "body"
    fields: dict[str, str] = field(default_factory=dict)
    api: dict[str, Any] = field(default_factory=dict)
    headers: dict[str, str] = field(default_factory=dict)
    detail: dict[str, Any] = field(default_factory=dict)
    postprocess: dict[str, Any] = field(default_factory=dict)
    dedup: dict[str, Any] = field(default_factory=dict)
    storage: dict[str, Any] = field(default_factory=dict)
    concurrency: int = 1
    delay: float = 0.5
    page_wait: int = 3000
    detail_concurrency: int = 1
    robots_timeout: float = 5.0
    respect_robots: bool = False
    resume: bool = False
    user_agent: str | None = None
    raw: dict[str, Any] = field(default_factory=dict, repr=False)

    def signature(self, scope: str | None = None) -> str:
        """Names the source and extraction contract, hence which old pages may be reused."""
        return contract_signature(self.raw, scope or self.raw.get("_checkpoint_scope"))

    @property
    def serial(self) -> bool:
        """One page after the other, ending at the first empty one."""
        return self.pagination["type"] == "url_pattern" and self.concurrency == 1

    @classmethod
    def of(cls, config: Mapping[str, Any]) -> JobConfig:
        """Check a plain configuration and fill in the defaults."""
        if not isinstance(config, Mapping):
            raise ConfigError("the configuration must be an object")
        render = config.get("render", "direct")
        if render not in RENDERS:
            raise ConfigError(f"render must be one of {RENDERS}")
        first_url = config.get("first_url")
        if first_url:
            first_url = _http_url(first_url, "first_url")
        pagination = cls._pagination(config, render, first_url)

        fields = _text_mapping(config.get("fields"), "fields", filled=True)
        selector = config.get("item_selector")
        if selector is not None and not isinstance(selector, str):
            raise ConfigError("item_selector must be text")
        selector = (selector or "").strip()
        if fields and not selector:
            raise ConfigError("HTML fields need an item_selector")
        try:
            compile_selector(selector or "body")
        except ValueError as e:
            raise ConfigError(str(e)) from e

        headers = _text_mapping(config.get("headers"), "headers")
        for k, v in headers.items():
            if not k.strip() or "\r" in k + v or "\n" in k + v:
                raise ConfigError("headers must be single lines")
        api = _mapping(config.get("api"), "api")
        _text_mapping(api.get("fields"), "api.fields")
        detail = _mapping(config.get("detail"), "detail")
        _text_mapping(detail.get("fields"), "detail.fields")
        agent = config.get("user_agent")
        if agent is not None and (not isinstance(agent, str) or "\r" in agent or "\n" in agent):
            raise ConfigError("user_agent must be one line of text")
        given = {k: config.get(k, d) for k, d in DEFAULTS.items()}
        for k in ("concurrency", "detail_concurrency"):
            given[k] = given[k] or 1
        numbers = {k: _number(v, k, type(DEFAULTS[k])) for k, v in given.items()}
        return cls(
            name=str(config.get("name") or "result").strip() or "result",
            render=render, first_url=first_url or None, pagination=pagination,
            item_selector=selector or "body", fields=fields, api=api, headers=headers,
            detail=detail,
            postprocess=_mapping(config.get("postprocess"), "postprocess"),
            dedup=_mapping(config.get("dedup"), "dedup"),
            storage=_mapping(config.get("storage"), "storage"),
            respect_robots=bool(config.get("respect_robots")),
            resume=bool(config.get("resume")),
            user_agent=agent, raw=dict(config), **numbers,
        )

    @staticmethod
    def _pagination(config: Mapping[str, Any], render: str, first_url: str | None) -> dict[str, Any]:
        if "pagination" in config:
            if not isinstance(config["pagination"], Mapping):
                raise ConfigError("pagination must be an object")
            out = dict(config["pagination"])
        elif config.get("page_url_pattern"):
            out = {
                "type": "url_pattern", "url_pattern": config["page_url_pattern"],
                "start_page": config.get("start_page", 1), "max_pages": config.get("max_pages", 1),
            }
        else:
            out = {}
        kind = out.setdefault("type", "none")
        if kind not in PAGINATION:
            raise ConfigError(f"unknown pagination.type {kind!r}")
        if render == "direct" and kind in ("next_button", "infinite_scroll"):
            raise ConfigError(f"{kind} needs rendered pages")
        out["start_page"] = _number(out.get("start_page", 1), "start_page", int)
        out["max_pages"] = _number(out.get("max_pages", 1), "max_pages", int)
        pattern = out.get("url_pattern")
        if kind == "url_pattern":
            if not isinstance(pattern, str) or "{page" not in pattern:
                raise ConfigError("url_pattern must hold {page}")
            _http_url(_first_page(pattern, out["start_page"]), "url_pattern")
        elif pattern:
            fixed = str(pattern)
            out["url_pattern"] = _http_url(
                _first_page(fixed, out["start_page"]) if "{" in fixed else fixed, "url_pattern"
            )
        if kind == "none" and not first_url and not pattern:
            raise ConfigError("a single-page job needs first_url")
        if kind in ("next_button", "infinite_scroll") and not first_url:
            raise ConfigError(f"{kind} needs first_url")
        if kind == "infinite_scroll":
            out["scroll_pause"] = _number(out.get("scroll_pause", 1.5), "scroll_pause", float)
            out["max_scrolls"] = _number(out.get("max_scrolls", 50), "max_scrolls", int)
        return out
