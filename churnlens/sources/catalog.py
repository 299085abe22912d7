"""Rule catalogs written in YAML: patterns with their detectors by language, boundaries, languages and aliases, as rules and tables."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from churnlens.operators.rules import Boundary, Rule

#: Keys of a detector that are a rule's own, and how its kinds are called.
KEYS = ("pattern", "require", "present_within", "absent_within", "window", "window_before", "window_offset", "absent_before", "absent_before_window", "anchor", "absent", "handler", "note", "confidence")
KINDS = {"regex": "line", "file_absent": "absent", "module": "module"}


def read_catalog(spark: SparkSession, path: str) -> dict[str, Any]:
    """A catalog file as nested values, by a path that Spark can read; an empty file is an empty catalog."""
    import yaml

    rows = spark.read.text(path, wholetext=True).limit(1).collect()
    return (yaml.safe_load(rows[0][0]) if rows else None) or {}


def rules_of(catalog: dict[str, Any], patterns: set[str] | None = None) -> list[Rule]:
    """The detectors of a catalog in its order, of some patterns or all; of one pattern's hits on one line the first stays. Other kinds are left out."""
    out = []
    for pattern in catalog.get("patterns") or []:
        if patterns is None or pattern["id"] in patterns:
            for lang, detectors in (pattern.get("detectors") or {}).items():
                for d in detectors or []:
                    if kind := KINDS.get(d.get("kind", "regex")):
                        own = {k: d[k] for k in KEYS if d.get(k) is not None}
                        out.append(Rule(d["id"], len(out), lang, kind, group=pattern["id"], raw=bool(d.get("include_comments")), **own))
    return out


def boundaries_of(catalog: dict[str, Any]) -> list[Boundary]:
    """The boundary rules of a catalog in its order."""
    rules = [(lang, r) for lang, own in (catalog.get("boundaries") or {}).items() for r in own or []]
    return [Boundary(r["id"], n, r["label"], r["pattern"], lang, r.get("require")) for n, (lang, r) in enumerate(rules)]


def dimension(spark: SparkSession, catalog: dict[str, Any]) -> DataFrame:
    """pattern, name, tier, weight, dormant of a catalog's patterns, for joins."""
    rows = [(p["id"], p.get("name"), str(p.get("tier", "")).upper(), float(p.get("weight", 0)), bool(p.get("dormant"))) for p in catalog.get("patterns") or []]
    return spark.createDataFrame(rows, "pattern string, name string, tier string, weight double, dormant boolean")


def extensions(catalog: dict[str, Any]) -> dict[str, str]:
    """The language of each file extension in lower case."""
    return {x.lower(): lang for lang, own in (catalog.get("languages") or {}).items() for x in own.get("extensions") or []}


def rule_languages(catalog: dict[str, Any]) -> dict[str, str]:
    """The language whose rules a language takes, where it is another's alias."""
    return dict(catalog.get("aliases") or {})


def only_with_leads(catalog: dict[str, Any]) -> set[str]:
    """Languages whose files count only where a rule hits them."""
    return {lang for lang, own in (catalog.get("languages") or {}).items() if own.get("rank_only_with_leads")}
