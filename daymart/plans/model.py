"""Semantic models: small frozen descriptions that compile to column expressions."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from ..operators.joins import JoinSpec


@dataclass(frozen=True)
class Attribute:
    name: str
    type: str = "string"
    description: str = ""
    enum_map: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Entity:
    name: str
    source: str
    primary_key: str = ""
    attributes: tuple[Attribute, ...] = ()
    description: str = ""


@dataclass(frozen=True)
class Relationship:
    left: str
    right: str
    left_keys: tuple[str, ...]
    right_keys: tuple[str, ...]
    cardinality: str = "1:N"
    how: str = "left"

    def spec(self) -> JoinSpec:
        return JoinSpec(self.left_keys, self.right_keys, self.how, self.cardinality)


@dataclass(frozen=True)
class Metric:
    """One aggregate expression with an optional row filter, or a ratio of two metrics.

    ``alert`` is an abnormal-if predicate such as ``<70``.
    """

    name: str
    expression: str = ""
    filter: str = ""
    numerator: str = ""
    denominator: str = ""
    factor: float = 1.0
    unit: str = ""
    description: str = ""
    alert: str = ""


@dataclass(frozen=True)
class Chain:
    """Composite measure: ordered (column, expression) steps."""

    name: str
    steps: tuple[tuple[str, str], ...]
    unit: str = ""
    alert: str = ""


@dataclass(frozen=True)
class FilterRule:
    partition: str = ""
    conditions: tuple[str, ...] = ()
    dedup_keys: tuple[str, ...] = ()
    dedup_order: tuple[str, ...] = ()
    description: str = ""


@dataclass(frozen=True)
class Axiom:
    id: str
    statement: str
    formal: str = ""


@dataclass(frozen=True)
class DomainModel:
    domain_id: str
    name: str = ""
    description: str = ""
    entities: Mapping[str, Entity] = field(default_factory=dict)
    relationships: tuple[Relationship, ...] = ()
    metrics: Mapping[str, Metric] = field(default_factory=dict)
    chains: Mapping[str, Chain] = field(default_factory=dict)
    hierarchy: Mapping[str, Mapping[str, str]] = field(default_factory=dict)
    business_rules: Mapping[str, str] = field(default_factory=dict)
    axioms: tuple[Axiom, ...] = ()
    filter_rules: Mapping[str, FilterRule] = field(default_factory=dict)


def _pick(d: Mapping[str, Any], *names: str, default: Any = "") -> Any:
    """First present spelling of a field."""
    return next((d[n] for n in names if d.get(n) is not None), default)


def _named(items: Any) -> dict[str, Mapping[str, Any]]:
    """Objects by name, from a list of objects or an object of objects."""
    if isinstance(items, Mapping):
        return dict(items)
    return {i.get("name", ""): i for i in items or []}


def _entity(name: str, d: Mapping[str, Any]) -> Entity:
    key = _pick(d, "primary_key")
    attrs = tuple(
        Attribute(a["name"], _pick(a, "type", default="string"), _pick(a, "description"), _pick(a, "enum_map", default={}))
        for a in d.get("attributes") or []
    )
    return Entity(
        name, _pick(d, "source", "table"), key if isinstance(key, str) else ", ".join(key), attrs, _pick(d, "description")
    )


def _relationship(d: Mapping[str, Any]) -> Relationship:
    """The condition lists equalities ``A.x = B.y`` joined by AND."""
    left, right = d["from"], d["to"]
    lk, rk = [], []
    for part in d["condition"].replace(" and ", " AND ").split(" AND "):
        a, b = (side.strip().split(".") for side in part.split("="))
        if a[0] == right:
            a, b = b, a
        lk.append(a[-1])
        rk.append(b[-1])
    how = _pick(d, "join_type", default="left join").lower().split()[0]
    return Relationship(left, right, tuple(lk), tuple(rk), _pick(d, "cardinality", "type", default="1:N"), how)


def _text(value: Any) -> str:
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def load_model(data: Mapping[str, Any]) -> DomainModel:
    """Read either spelling of a model (list or object form, table/source,
    formula/expression, type/cardinality)."""
    metrics = {
        k: Metric(
            _pick(m, "name", default=k), _pick(m, "expression", "formula"), _pick(m, "filter"), _pick(m, "numerator"),
            _pick(m, "denominator"), float(_pick(m, "factor", default=1.0)), _pick(m, "unit"),
            _pick(m, "description", "definition"), _pick(m, "risk_threshold", "alert"),
        )
        for k, m in _named(data.get("metrics")).items()
    }
    rules = data.get("business_rules") or {}
    if not isinstance(rules, Mapping):
        rules = {f"rule_{i}": r for i, r in enumerate(rules, 1)}
    filters = {
        k: FilterRule(
            _pick(r, "partition"), tuple(_pick(r, "conditions", default=())), tuple(_pick(r, "dedup_keys", default=())),
            tuple(_pick(r, "dedup_order", default=())), _pick(r, "description"),
        )
        for k, r in (data.get("filter_rules") or {}).items()
    }
    return DomainModel(
        domain_id=_pick(data, "domain_id"),
        name=_pick(data, "name", "domain_name"),
        description=_pick(data, "description"),
        entities={k: _entity(k, e) for k, e in _named(data.get("entities")).items()},
        relationships=tuple(_relationship(r) for r in data.get("relationships") or []),
        metrics=metrics,
        chains={
            k: Chain(k, tuple((s["name"], s["expression"]) for s in c["steps"]), _pick(c, "unit"), _pick(c, "risk_threshold"))
            for k, c in _named(data.get("computation_chains")).items()
        },
        hierarchy={
            h: {c: (r["rule"] if isinstance(r, Mapping) else r) for c, r in classes.items()}
            for h, classes in (data.get("hierarchy") or {}).items()
        },
        business_rules={k: _text(v) for k, v in rules.items()},
        axioms=tuple(Axiom(a["id"], a["statement"], _pick(a, "formal")) for a in data.get("axioms") or []),
        filter_rules=filters,
    )
