"""op10: all pages as WARC records in seekable bundles, read back."""

from pyspark.sql import DataFrame, SparkSession

from .warc import classify, read_archive, write_archive


def op10_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = read_archive(write_archive(classify(spark.read.parquet(f"{sf_dir}/pages.parquet"))))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op10_seekable_warc": op10_seekable_warc}
SQL = {
    "op10_seekable_warc": """
with p as (select page_id, coalesce(html, '') as h from pages),
g as (select h, max(page_id) as first from p where strlen(h) >= 1000 group by h)
select page_id, cast(strlen(p.h) as bigint) as payload_bytes, sha1(p.h) as payload_digest,
       case when first is null or first is not distinct from page_id then 'response' else 'revisit' end as record_type,
       case when first is not null and first is distinct from page_id then first end as refers_to
from p left join g on p.h = g.h
"""
}
