"""Registered queries: the annotation graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelcohort.functions import paths as P
from voxelcohort.operators import graph as G
from voxelcohort.session import cut_lineage
from voxelcohort.workload import tables as T
from voxelcohort.workload.tables import CTE, with_sql

Q: dict[str, tuple] = {}
RULES = [
    (1, "prefix", "src/building/", "construction", ("docs", "special")), (2, "contains", "/house", "household"), (3, "suffix", "7.py", "lucky"),
    (4, "equals", "src/machinery/1.py", "special"), (5, "prefix", "src/", "other-source"), (6, "type", "document", "docs", ("household",)), (7, "label", "R#00000001", "early", ("other-source",)),
]


def q(name, sql=None):
    def add(fn):
        Q[name] = (fn, sql)
        return fn

    return add


CTE["known"] = (("nodes", "edges"), "SELECT * FROM edges WHERE source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes)")
CTE["grouped"] = (("nodes",), """
  SELECT *, CASE WHEN source_file LIKE 'src/building/%' THEN 'construction' WHEN source_file LIKE '%/house%' THEN 'household' WHEN source_file LIKE '%7.py' THEN 'lucky' WHEN source_file = 'src/machinery/1.py' THEN 'special'
    WHEN source_file LIKE 'src/%' THEN 'other-source' WHEN file_type = 'document' THEN 'docs' WHEN lower(label) LIKE '%r#00000001%' THEN 'early' END AS "group",
    CASE WHEN source_file LIKE 'src/building/%' THEN ['docs', 'special'] WHEN source_file LIKE 'src/%' THEN [] WHEN file_type = 'document' THEN ['household'] WHEN lower(label) LIKE '%r#00000001%' THEN ['other-source'] ELSE [] END AS secondary FROM nodes""")
CTE["ends"] = (("known",), "SELECT source AS id, target AS other FROM known UNION ALL SELECT target, source FROM known")


def _round(n, prev):
    return f"""SELECT * FROM l{prev} UNION ALL SELECT id, "group" FROM (SELECT e.id, l."group", row_number() OVER (PARTITION BY e.id ORDER BY count(*) DESC, l."group") AS rn
      FROM ends e JOIN l{prev} l ON l.id = e.other WHERE e.id NOT IN (SELECT id FROM l{prev}) GROUP BY e.id, l."group") WHERE rn = 1"""


CTE["l0"] = (("grouped", "ends"), 'SELECT id, "group" FROM grouped WHERE "group" IS NOT NULL')
for _n in range(1, 5):
    CTE[f"l{_n}"] = ((f"l{_n - 1}",), _round(_n, _n - 1))
CTE["spread"] = (("l4", "grouped"), 'SELECT g.* EXCLUDE ("group"), coalesce(l."group", \'infra\') AS "group" FROM grouped g LEFT JOIN l4 l USING (id)')


def _spread(spark, d):
    return G.propagate_labels(G.classify(T.nodes(spark, d), RULES), T.edges(spark, d), "infra")


@q("N01_valid_edges", with_sql("SELECT * FROM known", "known"))
def _(spark, d):
    return G.valid_edges(T.nodes(spark, d), T.edges(spark, d))


@q("N02_adjacency", with_sql("""
  SELECT a.*, n.label AS other_label FROM (SELECT DISTINCT source AS id, 'outgoing' AS direction, relation, target AS other, confidence FROM known
    UNION SELECT DISTINCT target, 'incoming', relation, source, confidence FROM known) a JOIN nodes n ON n.id = a.other""", "known"))
def _(spark, d):
    return G.adjacency(T.nodes(spark, d), T.edges(spark, d))


@q("N03_classify", with_sql("SELECT id, \"group\", array_to_string(secondary, ',') AS secondary FROM grouped", "grouped"))
def _(spark, d):
    return G.classify(T.nodes(spark, d), RULES).select("id", "group", F.array_join("secondary", ",").alias("secondary"))


@q("N04_propagate_labels", with_sql('SELECT id, "group" FROM spread', "spread"))
def _(spark, d):
    return _spread(spark, d).select("id", "group")


@q("N05_secondary_groups", with_sql("""
  , hints AS (SELECT e.id, o."group", count(*) AS n, row_number() OVER (PARTITION BY e.id ORDER BY count(*) DESC, o."group") AS rank, any_value(me.secondary) AS given
    FROM ends e JOIN spread o ON o.id = e.other JOIN spread me ON me.id = e.id WHERE coalesce(me.source_file, '') = '' AND o."group" <> me."group" GROUP BY e.id, o."group")
  SELECT id, CAST(len(given) + row_number() OVER (PARTITION BY id ORDER BY rank) AS INTEGER) AS rank, "group", n FROM hints WHERE rank <= 2 AND NOT list_contains(given, "group")
  UNION ALL SELECT id, CAST(generate_subscripts(secondary, 1) AS INTEGER), unnest(secondary), NULL FROM grouped""".lstrip(), "spread"))
def _(spark, d):
    # both operators read the valid edges: the join that makes them runs once, and only their ends are kept
    nodes = T.nodes(spark, d)
    known = cut_lineage(G.valid_edges(nodes, T.edges(spark, d)).select("source", "target"))
    spread = G.propagate_labels(G.classify(nodes, RULES), known, "infra", checked=True)
    return G.secondary_groups(spread, known, checked=True)


@q("N06_group_counts", with_sql('SELECT "group", count(*) AS n FROM spread GROUP BY 1', "spread"))
def _(spark, d):
    return G.group_counts(_spread(spark, d))


@q("N07_first_nonempty", with_sql("SELECT id, coalesce(nullif(trim(source_file), ''), nullif(trim(label), '')) AS text FROM nodes", "nodes"))
def _(spark, d):
    return T.nodes(spark, d).select("id", P.first_nonempty("source_file", "label").alias("text"))


_SAFE = r"""coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(trim({c}), '[\\/*?:"<>|#^\[\]]+', '_', 'g'), '\s+', '_', 'g'), '^[ ._]+|[ ._]+$', '', 'g'), ''), 'node')"""


@q("N08_unique_names", with_sql(f"""
  SELECT p_partkey, folder, base || CASE WHEN rn > 1 THEN '__' || rn ELSE '' END AS note FROM (SELECT *, row_number() OVER (PARTITION BY folder, base ORDER BY p_partkey) AS rn FROM (
    SELECT p_partkey, printf('community_%03d', p_size) AS folder, {_SAFE.format(c='p_name')} AS base FROM part))"""
  .replace("WITH ", "", 0).lstrip()))
def _(spark, d):
    p = T.table(spark, d, "part").select("p_partkey", F.col("p_size").alias("community"), F.col("p_name").alias("id"))
    return G.unique_names(p, "p_partkey").select("p_partkey", "folder", "note")


@q("N09_safe_name", f"SELECT page_id, {_SAFE.format(c='url')} AS name FROM pages")
def _(spark, d):
    return T.table(spark, d, "pages").select("page_id", P.safe_name("url").alias("name"))


@q("N09_community_folder", with_sql("SELECT id, coalesce(printf('community_%03d', community), 'community_unassigned') AS folder FROM nodes", "nodes"))
def _(spark, d):
    return T.nodes(spark, d).select("id", P.community_folder("community").alias("folder"))
