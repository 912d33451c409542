"""Scenarios: where their files are, their loaded forms, and the facts that are added to them."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import policy as policies
from .facts import load_facts


@dataclass
class Scenario:
    """A scenario's files; the rules and aliases are optional."""

    facts: str
    policy: str
    rules: str = ""
    semantic: str = ""
    label: str = ""


@dataclass
class Catalog:
    """Scenarios by name; a loaded one is kept until its files change through this class."""

    spark: SparkSession
    scenarios: dict[str, Scenario]
    hidden: tuple[str, ...] = ("confidential",)
    loaded: dict[str, dict] = field(default_factory=dict)

    def find(self, name: str) -> Scenario:
        if name in ("auto", "general"):
            raise ValueError("facts belong to a business scenario, not to auto or general")
        if name not in self.scenarios:
            raise ValueError(f"unknown scenario {name!r}; there are {sorted(self.scenarios)}")
        return self.scenarios[name]

    def listed(self) -> list[dict]:
        return [{"id": n, "label": s.label or n} for n, s in self.scenarios.items() if n not in self.hidden]

    def load(self, name: str) -> dict:
        """The facts, policy, terms, rules and aliases of a scenario."""
        if name not in self.loaded:
            s = self.find(name)
            own, terms, data = policies.read_policy(self.spark, s.policy)
            rules = policies.merge_rules(list(data.get("public_rules") or []), policies.read_rules(self.spark, s.rules) if s.rules else [])
            self.loaded[name] = {
                "facts": load_facts(self.spark, s.facts), "policy": own, "terms": terms, "rules": policies.rules_table(self.spark, rules), "aliases": policies.aliases_table(self.spark, data),
                "semantic": policies.read_semantic(self.spark, s.semantic) if s.semantic else None,
            }
        return self.loaded[name]

    def schema(self, name: str) -> dict:
        own = self.load(name)
        first = own["facts"].orderBy("position").select(F.map_keys("fields")).first()
        p = own["policy"]
        return {"scenario": name, "display_field": p.display, "protected_fields": p.protected, "identifier_fields": p.identifiers, "fields": policies.field_schema(p, sorted(first[0]) if first else [])}

    def facts(self, name: str) -> dict:
        """All facts of a scenario, as the file has them."""
        rows = policies.read_json(self.spark, self.find(name).facts)
        if not isinstance(rows, list):
            raise ValueError("a fact file must hold a list")
        return {"scenario": name, "count": len(rows), "facts": rows}

    def add(self, name: str, fact: dict) -> dict:
        """Appends a fact without its empty fields, with an id of its own where it has none; an id that is taken is an error."""
        if not isinstance(fact, dict):
            raise ValueError("a fact must be a JSON object")
        rows = self.facts(name)["facts"]
        clean = {k: v.strip() if isinstance(v, str) else v for k, v in fact.items() if v is not None}
        clean = {k: v for k, v in clean.items() if v != ""}
        clean.setdefault("id", f"{name.upper()}-{len(rows) + 1:03d}")
        if any(str(r.get("id")) == str(clean["id"]) for r in rows):
            raise ValueError(f"the fact id {clean['id']} is taken")
        path = self.find(name).facts
        backup(self.spark, path)
        write_text(self.spark, path, json.dumps([*rows, clean], ensure_ascii=False, indent=2))
        self.loaded.pop(name, None)
        return {"ok": True, "scenario": name, "id": str(clean["id"]), "count": len(rows) + 1, "fact": clean}

    def snapshot(self, name: str) -> DataFrame:
        """(path, length, sha256, facts, protected, identifiers, quasi, display) of a scenario's files."""
        from .resources import snapshot

        s, own = self.find(name), self.load(name)
        p = own["policy"]
        files = snapshot(self.spark, [x for x in (s.facts, s.policy, s.rules, s.semantic) if x])
        names = lambda fields: F.array(*map(F.lit, fields)).cast("array<string>")
        return files.select("*", F.lit(own["facts"].count()).alias("facts"), names(p.protected).alias("protected"), names(p.identifiers).alias("identifiers"), names(p.quasi).alias("quasi"), F.lit(p.display).alias("display"))


def _file(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file beside its place and moves it there, at any path that Spark writes."""
    fs, where = _file(spark, path)
    _, beside = _file(spark, f"{path}.tmp")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(where, False)
    fs.rename(beside, where)


def backup(spark: SparkSession, path: str, now: float | None = None) -> str | None:
    """A copy of a file in ``_backup`` beside it, named by the time; None where there is no file."""
    fs, where = _file(spark, path)
    if not fs.exists(where):
        return None
    stem, dot, end = where.getName().rpartition(".")
    target = f"{where.getParent()}/_backup/{stem or end}.{time.strftime('%Y%m%d_%H%M%S', time.localtime(now))}{dot}{end if stem else ''}.bak"
    copy, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy, spark.sparkContext._jsc.hadoopConfiguration()
    copy(fs, where, fs, _file(spark, target)[1], False, conf)
    return target


def dump_json(data, spark: SparkSession, path: str) -> None:
    """A JSON file with an indent of two."""
    write_text(spark, path, json.dumps(data, ensure_ascii=False, indent=2))
