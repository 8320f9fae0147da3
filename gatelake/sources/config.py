"""Run configuration and check batches from JSON with comments."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

#: Modes in the order in which they are inferred from what a configuration holds.
MODES = ("hierarchy", "find-top", "search", "check-connect", "check-connect-batch", "cone", "inst-trace", "path-walk")
PHASES = ("text", "logical", "both", "hgrep", "pyslangwalk")


def strip_jsonc(text: str) -> str:
    """JSON without // and /* */ comments outside strings, and without trailing commas."""
    text = re.sub(r"\"(?:\\.|[^\"\\])*\"|//[^\n]*|/\*.*?\*/", lambda m: m[0] if m[0][0] == '"' else " ", text, flags=re.S)
    return re.sub(r"\"(?:\\.|[^\"\\])*\"|,(\s*[}\]])", lambda m: m[0] if m[0][0] == '"' else m[1], text)


def load(text: str) -> tuple[dict[str, Any], list[str]]:
    """The object with keys in snake case, and the keys that occur twice in one object."""
    twice: list[str] = []

    def pairs(items: list[tuple[str, Any]]) -> dict[str, Any]:
        out: dict[str, Any] = {}
        for k, v in items:
            name = k.replace("-", "_")
            if name in out:
                twice.append(name)
            out[name] = v
        return out

    return json.loads(strip_jsonc(text), object_pairs_hook=pairs), twice


@dataclass
class RunConfig:
    mode: str
    filelist: str = ""
    top: str = ""
    index_cwd: str = ""
    phases: list[str] = field(default_factory=list)
    defines: dict[str, str] = field(default_factory=dict)
    env: dict[str, str] = field(default_factory=dict)
    checks: list[dict[str, Any]] = field(default_factory=list)
    include_ff: bool = False
    raw: dict[str, Any] = field(default_factory=dict)
    duplicate_keys: list[str] = field(default_factory=list)


def infer_mode(raw: dict[str, Any]) -> str:
    if raw.get("mode") in MODES:
        return raw["mode"]
    if raw.get("inst_trace") or raw.get("instance_trace"):
        return "inst-trace"
    if raw.get("cone"):
        return "cone"
    checks = raw.get("checks") or (raw.get("run_conn_check") or {}).get("checks")
    if checks:
        return "check-connect-batch" if len(checks) > 1 else "check-connect"
    if raw.get("search") or raw.get("instance") or raw.get("hierarchy_path"):
        return "search"
    return "hierarchy" if raw.get("top") else "find-top"


def parse(text: str) -> RunConfig:
    raw, twice = load(text)
    phases = raw.get("connect_phase") or []
    phases = [phases] if isinstance(phases, str) else list(phases)
    if bad := [p for p in phases if p not in PHASES]:
        raise ValueError(f"unknown connect phase {bad[0]}")
    nested = raw.get("run_conn_check") or {}
    text_map = lambda d: {str(k): str(v) for k, v in (d or {}).items()}
    return RunConfig(infer_mode(raw), raw.get("filelist", ""), raw.get("top", ""), raw.get("index_cwd", ""), phases, text_map(raw.get("defines")), text_map(raw.get("env")), raw.get("checks") or nested.get("checks") or [], bool(raw.get("include_ff", False)), raw, twice)


def parse_checks(data: str) -> list[dict[str, Any]]:
    """Checks from JSON or from lines of two endpoints; from/to, src/dst and endpoint_a/endpoint_b are other names of a and b."""
    if data.lstrip()[:1] in ("{", "["):
        raw, _ = load(data) if data.lstrip()[0] == "{" else ({"checks": json.loads(strip_jsonc(data))}, [])
        items = raw.get("checks") or []
    else:
        items = [dict(zip(("a", "b"), line.split()[:2])) for line in data.splitlines() if len(line.split()) >= 2 and not line.lstrip().startswith("#")]
    out = []
    for k, c in enumerate(items):
        pick = lambda *names: next((c[n] for n in names if c.get(n) not in (None, "")), None)  # noqa: E731, B023
        a, b = pick("a", "from", "src", "endpoint_a"), pick("b", "to", "dst", "endpoint_b")
        if a is None or b is None:
            raise ValueError(f"check {k} lacks an endpoint")
        many = lambda x: [str(i) for i in x] if isinstance(x, list) else [str(x)]
        out.append({"check_id": str(c.get("id") or c.get("check_id") or f"check_{k}"), "a": many(a), "b": many(b), "loop": {str(n): ",".join(map(str, v)) if isinstance(v, list) else str(v) for n, v in (c.get("loop") or {}).items()}})
    return out


def checks_table(spark: SparkSession, data: str) -> DataFrame:
    return spark.createDataFrame(parse_checks(data), "check_id string, a array<string>, b array<string>, loop map<string,string>")
