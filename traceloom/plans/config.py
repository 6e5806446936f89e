"""Configuration of the engine: defaults, environment, one validation that names every fault; manifests."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field, fields
from urllib.parse import unquote

_UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}


def duration(text: str | float) -> float:
    """'1m30s' as seconds."""
    if isinstance(text, (int, float)):
        return float(text)
    parts = re.findall(r"(\d+(?:\.\d+)?)(ns|us|µs|ms|s|m|h)", text)
    if not parts or "".join(a + b for a, b in parts) != text:
        raise ValueError(f"not a duration: {text!r}")
    return sum(float(a) * _UNITS[b] for a, b in parts)


@dataclass(frozen=True)
class Config:
    keep_threshold: float = 0.5
    random_floor: float = 0.02
    severity_high: float = 0.8
    temperature: float = 1.0
    decision_question: str = "answer_wrong"
    max_deliveries: int = 5
    backoff_s: tuple[float, ...] = (5.0, 30.0, 120.0, 300.0)
    idle_timeout_s: float = 10.0
    max_wait_s: float = 120.0
    scorer_timeout_s: float = 10.0
    scorer_retries: int = 3
    scorer_backoff_s: tuple[float, ...] = (0.5, 2.0, 5.0)
    models: dict[str, str] = field(default_factory=dict)
    api_keys: list[str] = field(default_factory=list)
    exporters: list[dict] = field(default_factory=list)

    def problems(self) -> list[str]:
        out = [f"{n} must be in [0, 1]" for n in ("keep_threshold", "random_floor", "severity_high") if not 0 <= getattr(self, n) <= 1]
        if not self.temperature > 0:
            out.append("temperature must be above 0")
        if self.severity_high < self.keep_threshold:
            out.append("severity_high must not be under keep_threshold")
        if self.max_deliveries < 1:
            out.append("max_deliveries must be 1 at least")
        if self.idle_timeout_s > self.max_wait_s:
            out.append("idle_timeout must not be over max_wait")
        return out

    def worst_case_s(self) -> float:
        """The longest one trace can be with the scorer."""
        waits = [self.scorer_backoff_s[min(i, len(self.scorer_backoff_s) - 1)] for i in range(self.scorer_retries)] if self.scorer_backoff_s else []
        return self.scorer_timeout_s * (self.scorer_retries + 1) + sum(waits)


def load(values: dict, environment: dict | None = None, prefix: str = "TRACELOOM_") -> Config:
    """A Config of given values over defaults and environment over values; unknown keys and bad values are one error."""
    known = {f.name: f for f in fields(Config)}
    made, wrong = {}, [f"unknown key {k}" for k in values if k not in known]
    env = os.environ if environment is None else environment
    merged = {k: v for k, v in values.items() if k in known} | {k: env[prefix + k.upper()] for k in known if prefix + k.upper() in env}
    for k, v in merged.items():
        default = getattr(Config(), k)
        try:
            made[k] = duration(v) if k.endswith("_s") and not isinstance(default, tuple) else tuple(duration(x) for x in v) if isinstance(default, tuple) else type(default)(v)
        except (TypeError, ValueError) as e:
            wrong.append(f"{k}: {e}")
    config = Config(**made)
    if wrong := wrong + config.problems():
        raise ValueError("; ".join(wrong))
    return config


def with_secrets(values: object, environment: dict, place: str = "") -> tuple[object, list[str]]:
    """values with what their `..._env` keys name in the environment, and what is wrong.

    x_env: NAME becomes x: the variable's value. headers_env adds to the headers that are written there and replaces those
    of the same name; api_keys_env is a list by commas. A variable that is named but not set, or empty, is an error.
    """
    if isinstance(values, list):
        parts = [with_secrets(x, environment, f"{place}[{i}]") for i, x in enumerate(values)]
        return [x for x, _ in parts], [e for _, wrong in parts for e in wrong]
    if not isinstance(values, dict):
        return values, []
    out, wrong = {}, []
    for key, value in values.items():
        if not key.endswith("_env"):
            out[key], more = with_secrets(value, environment, f"{place}.{key}".strip("."))
            wrong += more
    for key, name in values.items():
        if not key.endswith("_env") or not name:
            continue
        target, found = key.removesuffix("_env"), environment.get(str(name), "")
        where = f"{place}.{key}".strip(".")
        if not found:
            wrong.append(f"{where}: ${name} is not set")
        elif target == "headers":
            try:
                out[target] = {**(out.get(target) or {}), **headers(found)}
            except ValueError as e:
                wrong.append(f"{where}: {e}")
        else:
            out[target] = [x.strip() for x in found.split(",") if x.strip()] if target == "api_keys" else found
    return out, wrong


def load_yaml(text: str, environment: dict | None = None, prefix: str = "TRACELOOM_") -> Config:
    """A Config from YAML: secrets from the environment first, then as load(); all that is wrong is one error."""
    import yaml

    env = dict(os.environ) if environment is None else environment
    try:
        values = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ValueError(f"not YAML: {str(e).splitlines()[0]}") from None
    if values is None:
        values = {}
    if not isinstance(values, dict):
        raise ValueError("the configuration must be a mapping")
    found, wrong = with_secrets(values, env)
    try:
        config = load(found, env, prefix)
    except ValueError as e:
        wrong.append(str(e))
    if wrong:
        raise ValueError("; ".join(wrong))
    return config


def headers(text: str) -> dict[str, str]:
    """'k=v,k2=v2' with percent escapes."""
    out = {}
    for part in filter(None, (x.strip() for x in text.split(","))):
        key, eq, value = part.partition("=")
        if not eq or not key.strip():
            raise ValueError(f"not key=value: {part!r}")
        out[key.strip()] = unquote(value.strip())
    return out


@dataclass(frozen=True)
class Manifest:
    model: str
    questions: str
    temperatures: dict[str, float]


def manifest(text: str, question: str) -> Manifest:
    """A manifest; its questions are kept as compact JSON in their order, and the decision question must be among them."""
    found = json.loads(text)
    missing = [k for k in ("model", "questions") if not found.get(k)]
    if missing or question not in found["questions"]:
        raise ValueError(f"manifest lacks {', '.join(missing) or question}")
    return Manifest(found["model"], json.dumps(found["questions"], separators=(",", ":"), ensure_ascii=False), dict(found.get("temperatures") or {}))
