"""Rule packs: YAML checked on the driver and compiled once, for column expressions."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path
from typing import Any

import yaml

from ..functions.masking import MaskPolicy
from ..functions.regexes import Translated, java_pattern

DEFAULT_PATH = Path(__file__).with_name("default_rules.yaml")


@dataclass(frozen=True)
class Marker:
    style: str
    pattern: Translated
    page: int
    total: int | None


@dataclass(frozen=True)
class Identifier:
    name: str
    pattern: Translated
    scope: tuple[str, ...]


@dataclass(frozen=True)
class DocClass:
    label: str
    strong: tuple[str, ...]
    weak: tuple[str, ...]


@dataclass(frozen=True)
class RulePack:
    """A checked rule pack. ``classes`` keep the file's order, which breaks ties."""

    version: str | None
    classes: tuple[DocClass, ...]
    markers: tuple[Marker, ...]
    identifiers: tuple[Identifier, ...]
    mask: MaskPolicy
    strong_weight: float
    weak_weight: float
    saturation: float
    case_sensitive: bool
    short_text: int
    least_score: float
    least_margin: float
    short_circuit: bool
    delegate_conflicts: bool
    margin_needs_two: bool
    max_total: int
    reject_page_over_total: bool
    excerpt_chars: int

    @property
    def labels(self) -> tuple[str, ...]:
        return tuple(c.label for c in self.classes)

    @property
    def fallback(self) -> str:
        """The label of pages without any signal: ``OTHER``."""
        return "OTHER"

    def scopes(self) -> dict[str, tuple[str, ...]]:
        """Names of the identifiers that count for a label."""
        return {label: tuple(i.name for i in self.identifiers if label in i.scope) for label in (*self.labels, self.fallback)}


def check_strong_signals(rules: dict[str, Any]) -> None:
    """Raises ValueError if a signal listed as never strong stands among the strong ones of a class."""
    never = set(rules.get("never_strong") or ())
    clashes = {label: sorted(never & set(block.get("strong") or ())) for label, block in (rules.get("doc_types") or {}).items()}
    if clashes := {label: hits for label, hits in clashes.items() if hits}:
        raise ValueError(f"never_strong signals used as strong: {clashes}")


def compile_rules(rules: dict[str, Any]) -> RulePack:
    """Checks and compiles a rule dictionary."""
    check_strong_signals(rules)
    scoring, delegation = rules["scoring"], rules["delegation"]
    limits, masking = rules.get("marker_constraints") or {}, rules.get("masking") or {}
    markers = []
    for item in sorted(rules.get("markers") or (), key=lambda m: m["priority"]):
        pattern = java_pattern(item["regex"], item.get("flags") or ())
        if "page" not in pattern.groups:
            raise ValueError(f"marker {item['style']} has no group named page")
        markers.append(Marker(item["style"], pattern, pattern.groups["page"], pattern.groups.get("total")))
    identifiers = []
    for item in rules.get("instance_identifiers") or ():
        pattern = java_pattern(item["regex"])
        if pattern.count < 1:
            raise ValueError(f"identifier {item['name']} has no group")
        identifiers.append(Identifier(item["name"], pattern, tuple(item.get("scope") or ())))
    names = masking.get("name_masking") or {}
    policy = MaskPolicy(
        tuple((p["regex"], p["replacement"]) for p in masking.get("patterns") or ()),
        tuple(masking.get("never_mask_regex") or ()),
        frozenset(masking.get("preserve_tokens") or ()),
        bool(names.get("enabled", False)),
        names.get("replacement", "[NAME]"),
    )
    classes = tuple(DocClass(label, tuple(b.get("strong") or ()), tuple(b.get("weak") or ())) for label, b in rules["doc_types"].items())
    return RulePack(
        version=rules.get("version"), classes=classes, markers=tuple(markers), identifiers=tuple(identifiers), mask=policy,
        strong_weight=float(scoring["strong_weight"]), weak_weight=float(scoring["weak_weight"]),
        saturation=float(scoring["evidence_saturation"]), case_sensitive=bool(scoring.get("case_sensitive", False)),
        short_text=int(delegation["short_text_threshold"]), least_score=float(delegation["rule_score_threshold"]),
        least_margin=float(delegation["rule_margin_threshold"]), short_circuit=bool(delegation.get("strong_signature_short_circuit", False)),
        delegate_conflicts=bool(delegation.get("delegate_on_conflicting_strong_signals", False)),
        margin_needs_two=bool(delegation.get("require_multiple_classes_for_margin_check", False)),
        max_total=int(limits.get("max_total", 500)), reject_page_over_total=bool(limits.get("reject_if_page_gt_total", True)),
        excerpt_chars=int(masking.get("max_excerpt_chars", 1200)),
    )


def read_rules(path: str | Path = DEFAULT_PATH) -> dict[str, Any]:
    """The YAML as it is; what goes wrong in reading it is raised unchanged."""
    return yaml.safe_load(Path(path).read_text(encoding="utf-8"))


def load_rules(path: str | Path = DEFAULT_PATH) -> RulePack:
    """A rule pack from a YAML file; any file is checked, not just the default one."""
    return compile_rules(read_rules(path))
