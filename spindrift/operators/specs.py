"""Scrape specifications and targets."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import BATCH_SIZE, SCRAPE_SPECS, SPEC_RENDER_MODE
from .extract import read_fields
from .frontier import claim, merge, new_urls


def validate(spec: dict) -> dict:
    """A specification with its defaults; ValueError if it cannot be used."""
    mode = spec.get("render_mode", "auto")
    if mode not in SPEC_RENDER_MODE:
        raise ValueError(f"render_mode is none of {', '.join(SPEC_RENDER_MODE)}")
    fields = json.dumps(spec["fields"])
    read_fields(fields)
    given = {k: spec.get(k) for k in ("link_field", "host_pattern", "path_regex")}
    return {"name": spec["name"], "version": int(spec.get("version", 1)), "fields": fields, "render_mode": mode, "feed_to_crawler": bool(spec.get("feed_to_crawler", False)), "feed_from_crawler": bool(spec.get("feed_from_crawler", False))} | given


def register(specs: DataFrame, new: DataFrame) -> DataFrame:
    """specs with new ones put in by name and version. A known one keeps its id, its time and whether it is active."""
    old = specs.select("name", "version", F.col("spec_id").alias("_id"), F.col("is_active").alias("_active"), F.col("created_at").alias("_at"))
    put = new.join(old, ["name", "version"], "left")
    put = put.withColumns({"spec_id": F.coalesce("_id", "spec_id"), "is_active": F.coalesce("_active", F.lit(True)), "created_at": F.coalesce("_at", "created_at")}).drop("_id", "_active", "_at")
    return merge(specs, put.select(*SCRAPE_SPECS.names), ["name", "version"])


def latest(specs: DataFrame) -> DataFrame:
    """The highest version of each name."""
    return specs.groupBy("name").agg(F.max_by(F.struct(*[c for c in specs.columns if c != "name"]), "version").alias("r")).select("name", "r.*")


def listing(specs: DataFrame) -> DataFrame:
    return specs.orderBy("name", "version")


def set_active(specs: DataFrame, name: str, active: bool, version: int | None = None) -> DataFrame:
    hit = (F.col("name") == name) if version is None else (F.col("name") == name) & (F.col("version") == version)
    return specs.withColumn("is_active", F.when(hit, active).otherwise(F.col("is_active")))


def submit(spec_id: int, raw: DataFrame, targets: DataFrame, now: Column) -> DataFrame:
    """New targets of a spec for urls (url, place) that it does not have yet."""
    known = targets.filter(F.col("spec_id") == spec_id)
    return new_urls(raw, known, "url", "place").drop("n_seen").withColumns({"spec_id": F.lit(spec_id), "status": F.lit("pending"), "next_attempt_at": now})


def claim_targets(targets: DataFrame, specs: DataFrame, domains: DataFrame, now: Column, batch: int | None = BATCH_SIZE, strict: bool = True) -> DataFrame:
    """As claim(), for targets of active specs, the longest due first; with the spec's render mode."""
    active = specs.filter("is_active").select("spec_id", F.coalesce("render_mode", F.lit("auto")).alias("spec_render_mode"))
    return claim(targets.join(active, "spec_id"), domains, now, batch, strict, "next_attempt_at", "target_id")


def newest_records(records: DataFrame, targets: DataFrame, spec_id: int, most: int = 100) -> DataFrame:
    """The newest records of a spec with their targets' urls."""
    own = targets.filter(F.col("spec_id") == spec_id).select("target_id", "url")
    return records.filter(F.col("spec_id") == spec_id).join(own, "target_id").orderBy(F.desc("extracted_at"), "target_id").limit(most)
