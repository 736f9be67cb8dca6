"""All queries of the core and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators import chain, chunks, columns, pages, policy, prompts, renderings, search, timestamps
from pagewright.plans.options import ReadOptions, formatted
from pagewright.storage import table
from pagewright.streaming import observations


def preset_read(name: str):  # noqa: ANN201
    """A query of a preset over all snapshots: lengths and sums of what it gives."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        columns_ = ("page_id", "url", "href", "html", "status", "status_text", "is_intermediate", "is_from_cache")
        out = formatted(table(spark, sf_dir, "snapshots").select(*columns_), ReadOptions.preset(name))
        return out.select("page_id", "tokens", F.md5("representation").alias("representation_md5"), *((F.size("chunks").alias("n_chunks"),) if "chunks" in out.columns else ())).distinct()

    return run


_MODULES = [pages, renderings, columns, chunks, search, policy, chain, prompts, observations, timestamps]

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()} | {f"preset_{name}": preset_read(name) for name in ("reader", "index", "spider")}
ORACLE = {name: sql for m in _MODULES for name, sql in getattr(m, "ORACLE", {}).items()}
FLAGSHIP = pages.page_markdown
