"""Mineral catalog: a user document, parsed with a schema and checked."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SCHEMA = (
    "experts array<struct<id:string,implemented:boolean>>,"
    "groups array<struct<id:string,expert:string,policies array<struct<policy:string,column_percentile:double>>>>,"
    "minerals array<struct<id:string,group:string>>"
).replace("policies array", "policies:array")


def parse(document: Column) -> Column:
    return F.from_json(document, f"struct<{SCHEMA.replace('experts array', 'experts:array').replace(',groups array', ',groups:array').replace(',minerals array', ',minerals:array')}>")


def problems(catalog: Column) -> Column:
    """Broken references and limits of one catalog, in a fixed order."""
    experts = F.transform(catalog["experts"], lambda e: e["id"])
    groups = F.transform(catalog["groups"], lambda g: g["id"])
    fractions = F.flatten(F.transform(catalog["groups"], lambda g: F.transform(g["policies"], lambda p: p["column_percentile"])))
    return F.array_compact(F.array(
        F.when(F.exists(catalog["groups"], lambda g: ~F.array_contains(experts, g["expert"])), "unknown_expert"),
        F.when(F.exists(catalog["minerals"], lambda m: ~F.array_contains(groups, m["group"])), "unknown_group"),
        F.when(F.exists(fractions, lambda x: (x <= 0) | (x >= 0.5)), "bad_percentile")))
