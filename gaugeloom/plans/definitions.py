"""Monitor definitions: TOML to a checked, frozen plan; all errors are reported together."""

from __future__ import annotations

import hashlib
import json
import tomllib
from dataclasses import dataclass, field

from gaugeloom.functions.scalar import SEVERITIES, TemplateError, template_parts
from gaugeloom.plans.expression import Compiled, ExpressionError, Names, compile_expression, duration
from gaugeloom.sources.samples import SOURCES


@dataclass(frozen=True)
class Problem:
    path: str
    code: str
    message: str


class DefinitionError(ValueError):
    def __init__(self, problems: list[Problem]):
        super().__init__("; ".join(f"{p.path}: {p.code}: {p.message}" for p in problems))
        self.problems = problems


@dataclass(frozen=True)
class Rule:
    name: str
    when: str
    severity: int
    group: str
    confirm: int = 1
    clear: int = 1
    message: str = ""
    notify_recovery: bool = True
    action: str | None = None


@dataclass(frozen=True)
class Trend:
    name: str
    value: str
    rate: str | None = None
    remaining: str | None = None
    confidence: str | None = None
    least_confidence: float = 0.0
    value_unit: str | None = None
    rate_unit: str | None = None


@dataclass(frozen=True)
class Definition:
    name: str
    source: str
    interval: int
    metrics: frozenset[str]
    attrs: frozenset[str]
    params: dict
    derived: tuple[tuple[str, str], ...]
    exempt: tuple[str, ...]
    rules: tuple[Rule, ...]
    trends: tuple[Trend, ...]
    promotion: str | None
    top_n: int
    windows: frozenset[tuple[str, int]]
    content_hash: str = field(compare=False)


_TOP = {"schema", "monitor", "parameters", "source_options", "promotion", "derived", "exempt", "rule", "glance", "trend"}
_MONITOR = {"name", "description", "version", "enabled", "platforms", "interval", "source"}
_RULE = {"name", "when", "severity", "group", "confirm_cycles", "clear_cycles", "message", "notify_recovery", "action"}


def load(text: str) -> Definition:
    """Parse and check a definition; raises :class:`DefinitionError` with every problem found."""
    try:
        doc = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise DefinitionError([Problem("", "toml", str(e))]) from e
    problems: list[Problem] = []
    bad = lambda path, code, message: problems.append(Problem(path, code, message))
    if doc.get("schema") != 1:
        bad("schema", "schema", "must be 1")
    for key in sorted(set(doc) - _TOP):
        bad(key, "unknown-key", "is not a part of a definition")
    head = doc.get("monitor", {})
    for key in sorted(set(head) - _MONITOR):
        bad(f"monitor.{key}", "unknown-key", "is not a part of [monitor]")
    name, source = head.get("name", ""), SOURCES.get(head.get("source", ""))
    if not name:
        bad("monitor.name", "missing", "a monitor has a name")
    if source is None:
        bad("monitor.source", "unknown-source", f"{head.get('source')!r} is no source")
    interval = 60
    try:
        interval = int(duration(head.get("interval", "60s")))
        if interval < 15:
            bad("monitor.interval", "range", "is at least 15 s")
    except ExpressionError as e:
        bad("monitor.interval", "duration", str(e))
    if problems and source is None:
        raise DefinitionError(problems)

    params = doc.get("parameters", {})
    own = {d.get("name", ""): d.get("expr", "") for d in doc.get("derived", [])}
    if len(own) < len(doc.get("derived", [])):
        bad("derived", "duplicate", "names must differ")
    for clash in sorted(set(own) & set(source.metrics)):
        bad(f"derived.{clash}", "duplicate", "is a metric of the source")
    metrics = frozenset(source.metrics) | frozenset(own)
    names = Names(metrics, frozenset(source.attrs), params)
    windows: set[tuple[str, int]] = set()

    def check(path: str, text: object) -> Compiled | None:
        if not isinstance(text, str) or not text.strip():
            bad(path, "missing", "an expression is needed")
            return None
        try:
            made = compile_expression(text, names)
        except ExpressionError as e:
            bad(path, "expression", str(e))
            return None
        windows.update(made.windows)
        return made

    uses = {n: (c.metrics & set(own) if (c := check(f"derived.{n}", e)) else set()) for n, e in own.items()}
    order: list[str] = []
    while len(order) < len(own):
        ready = [n for n in own if n not in order and uses[n] <= set(order)]
        if not ready:
            bad("derived", "cycle", ", ".join(sorted(set(own) - set(order))))
            break
        order += ready
    exempt = tuple(doc.get("exempt", []))
    for i, e in enumerate(exempt):
        check(f"exempt[{i}]", e)
    rules = []
    for i, r in enumerate(doc.get("rule", [])):
        path = f"rule[{i}]"
        for key in sorted(set(r) - _RULE):
            bad(f"{path}.{key}", "unknown-key", "is not a part of a rule")
        check(f"{path}.when", r.get("when"))
        severity = r.get("severity")
        if severity not in SEVERITIES:
            bad(f"{path}.severity", "severity", f"{severity!r} is none of {', '.join(SEVERITIES)}")
        for key in ("confirm_cycles", "clear_cycles"):
            if not isinstance(r.get(key, 1), int) or r.get(key, 1) < 1:
                bad(f"{path}.{key}", "range", "is a whole number from 1")
        if not isinstance(r.get("notify_recovery", True), bool):
            bad(f"{path}.notify_recovery", "type", "is true or false")
        if not isinstance(r.get("action", ""), str):
            bad(f"{path}.action", "type", "is the name of an action")
        try:
            template_parts(r.get("message", ""))
        except TemplateError as e:
            bad(f"{path}.message", "template", str(e))
        rules.append(Rule(r.get("name", f"rule{i}"), r.get("when", ""), SEVERITIES.index(severity) if severity in SEVERITIES else 0, r.get("group", r.get("name", "")), r.get("confirm_cycles", 1), r.get("clear_cycles", 1), r.get("message", ""), r.get("notify_recovery", True), r.get("action")))
    if len({r.name for r in rules}) < len(rules):
        bad("rule", "duplicate", "names must differ")
    trends = []
    for i, t in enumerate(doc.get("trend", [])):
        for key in ("value", "rate", "remaining", "confidence"):
            if t.get(key) is not None and t[key] not in metrics:
                bad(f"trend[{i}].{key}", "unknown-metric", str(t[key]))
        trends.append(Trend(t.get("name", ""), t.get("value", ""), t.get("rate"), t.get("remaining"), t.get("confidence"), float(t.get("least_confidence", 0)), t.get("value_unit"), t.get("rate_unit")))
    promotion = doc.get("promotion", {})
    if promotion.get("when") is not None:
        check("promotion.when", promotion["when"])
    top_n = promotion.get("top_n", 15)
    if not isinstance(top_n, int) or not 5 <= top_n <= 50:
        bad("promotion.top_n", "range", "is from 5 to 50")
    if problems:
        raise DefinitionError(problems)
    plain = json.dumps(doc, sort_keys=True, separators=(",", ":"))
    return Definition(
        name, source.name, interval, metrics, frozenset(source.attrs), params, tuple((n, own[n]) for n in order), exempt, tuple(rules), tuple(trends),
        promotion.get("when"), top_n, frozenset(windows), hashlib.sha256(plain.encode()).hexdigest(),
    )


def load_all(texts: dict[str, str]) -> tuple[list[Definition], dict[str, list[Problem]]]:
    """Definitions of the texts that are right, and the problems of the others by name."""
    good, wrong = [], {}
    for name, text in texts.items():
        try:
            good.append(load(text))
        except DefinitionError as e:
            wrong[name] = e.problems
    return good, wrong
