"""Steps of the intelligence pipeline that can be called by name, from DataFrame to DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clean, coverage, markup, objects
from ..sources import bundles as bd


def ingest(files: DataFrame) -> DataFrame:
    """Cleaned text of the files (name, text) that pass the gates, with stem and status; HTML becomes plain text first."""
    is_html = F.coalesce(F.lower("name").rlike(r"\.html?$"), F.lit(False))
    pages = markup.html_texts(files.filter(is_html), "text", "text")
    plain = files.filter(~is_html).unionByName(pages)
    return clean.route(plain).filter("status IN ('[TEXT]', '[HTML]', '[PDF]')").drop("skip_reason")


def fuse(bundles: DataFrame, id_source: str, by: str) -> DataFrame:
    """The fused bundle of each value of ``by`` of bundle documents (bundle_id, value, ok and the column ``by``); see :func:`objects.fused_documents`."""
    named = bd.explode_objects(bundles).join(bundles.select("bundle_id", by).distinct(), "bundle_id")
    return objects.fused_documents(*objects.fuse_bundles(named, id_source, by), bundles.filter("ok").select(by, "bundle_id"), by)


def cover(wanted: DataFrame, capabilities: DataFrame) -> DataFrame:
    """Coverage report of each bundle; see :func:`coverage.coverage_status`."""
    return coverage.coverage_report(coverage.coverage_status(wanted, capabilities))


STEPS: dict[str, Callable[..., DataFrame]] = {"ingest": ingest, "fuse": fuse, "coverage": cover}


def run_step(name: str, *inputs: DataFrame, **options) -> DataFrame:
    """Run a step by its name; an unknown name is an error that lists the known ones."""
    if name not in STEPS:
        raise ValueError(f"unknown step {name}; there are {', '.join(STEPS)}")
    return STEPS[name](*inputs, **options)
