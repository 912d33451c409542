"""op3: components of documents whose 4-word shingle sets have similarity 0.85 or more."""

from pyspark.sql import DataFrame, SparkSession

from .jaccard import jaccard_components


def op3_grouped_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4, num=85, den=100)
    return found.select("doc_id", "n_shingles", "component_id")


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def components_sql(table: str, k: int, num: int, den: int) -> str:
    """Common table expressions n (doc_id, n_shingles) and comp (doc_id, component_id) over ``table``."""
    return rf"""
w as (select doc_id, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') as w from {table}),
s as (select distinct doc_id, array_to_string(w[i:i + {k - 1}], ' ') as g
      from (select doc_id, w, unnest(range(1, greatest(len(w) - {k - 1}, 1) + 1)) as i from w where len(w) > 0)),
n as (select w.doc_id, cast(coalesce(c, 0) as bigint) as n_shingles from w left join (select doc_id, count(*) as c from s group by doc_id) using (doc_id)),
pair as (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.g = y.g and x.doc_id < y.doc_id group by 1, 2),
link as (select a, b from pair join n p on p.doc_id = a join n q on q.doc_id = b where {den} * c >= {num} * (p.n_shingles + q.n_shingles - c)),
edge as (select a, b from link union all select b, a from link),
reach(a, b) as (select a, b from edge union select r.a, e.b from reach r join edge e on r.b = e.a),
comp as (select n.doc_id, least(n.doc_id, coalesce(m, n.doc_id)) as component_id from n left join (select a, min(b) as m from reach group by a) on a = n.doc_id)"""


QUERIES = {"op3_grouped_prefix_join": op3_grouped_prefix_join}
SQL = {"op3_grouped_prefix_join": f"with recursive {components_sql('documents', 4, 85, 100)}\nselect doc_id, n_shingles, component_id from n join comp using (doc_id)"}
