"""Entity-graph queries.

Fixture mapping: records = ``customer`` keyed by ``c_custkey`` with two
similarity attributes ``a1 = floor(c_custkey / 60)|floor(c_acctbal / 1000)``
and ``a2 = nation|segment|floor(c_custkey / 240)``, so that a value is shared
by a handful of records at any scale factor; customer-merchant links =
``orders`` x ``lineitem`` (``o_custkey``, ``l_suppkey``, suppliers shifted by
10^12 so the kinds stay apart); blacklist = orders of status ``P`` above
480,000, joined back to ``orders`` on the order key.

Every customer key has one record, so queries that need sums over neighbours
or connectivity use the cell form of the graph (``graph.cells``); their SQL
is the literal pair form.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from risklens.operators.graph import build as B
from risklens.operators.graph import cell_lpa as CP
from risklens.operators.graph import sharing as CS
from risklens.operators.graph import cells as K
from risklens.operators.graph import components as C
from risklens.operators.graph import community as L
from risklens.operators.graph import lpa as P
from risklens.operators.graph import report as R
from risklens.operators.graph.blocks import packed_graph
from risklens.plans.registry import REGISTRY, register, rnd, table
from risklens.session import cut_lineage

SUPPLIER_OFFSET = 10 ** 12
LPA_STEPS = 5
BM_STEPS = 5


def prob9():
    """Probability to 9 decimals. Ratios of small integers can lie exactly
    between two such numbers, where engines round differently: move them off."""
    return F.round(F.col("prob") + 1e-12, 9)


def customers(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(
        "c_custkey",
        F.concat_ws("|", F.floor(F.col("c_custkey") / 60), F.floor(F.col("c_acctbal") / 1000)).alias("a1"),
        F.concat_ws("|", F.col("c_nationkey").cast("string"), F.col("c_mktsegment"),
                    F.floor(F.col("c_custkey") / 240)).alias("a2"))


def cells(spark, sf_dir):
    """Shared cells of the similarity graph, the cell form of ``sim_edges``."""
    return K.shared_cells(K.similarity_cells(customers(spark, sf_dir), "c_custkey", ["a1", "a2"]))


def sim_edges(spark, sf_dir):
    return B.similarity_edges(customers(spark, sf_dir), "c_custkey", ["a1", "a2"])


def co_edges(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    links = o.join(li, o.o_orderkey == li.l_orderkey)
    return B.cooccurrence_edges(links, "o_custkey", "l_suppkey", right_offset=SUPPLIER_OFFSET)


def _black(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o, o.where((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 480000)).select("o_orderkey")


def seeds(spark, sf_dir, vertices):
    o, black = _black(spark, sf_dir)
    return B.seed_labels(vertices, o, black, key="o_custkey", black_key="o_orderkey")


# ------------------------------------------------------------------ SQL parts
CUST_SQL = """cust AS (
  SELECT c_custkey,
         concat_ws('|', CAST(floor(c_custkey / 60) AS BIGINT), CAST(floor(c_acctbal / 1000) AS BIGINT)) AS a1,
         concat_ws('|', c_nationkey, c_mktsegment, CAST(floor(c_custkey / 240) AS BIGINT)) AS a2
  FROM customer)"""

_SCORE = ("((coalesce(a.a1, '') = coalesce(b.a1, '') AND coalesce(b.a1, '') <> '')::INT"
          " + (coalesce(a.a2, '') = coalesce(b.a2, '') AND coalesce(b.a2, '') <> '')::INT) / 2.0")

# the literal all-pairs theta join of the job
SIM_SQL = f"""{CUST_SQL},
sim AS (
  SELECT a.c_custkey AS src, b.c_custkey AS dst, max({_SCORE}) AS weight
  FROM cust a JOIN cust b ON a.c_custkey <> b.c_custkey
  GROUP BY 1, 2 HAVING max({_SCORE}) > 0)"""

CO_SQL = f"""co AS (
  SELECT o.o_custkey AS src, l.l_suppkey + {SUPPLIER_OFFSET} AS dst, count(*)::DOUBLE AS weight
  FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey
  WHERE o.o_custkey IS NOT NULL AND l.l_suppkey IS NOT NULL
  GROUP BY 1, 2)"""

SEED_SQL = """verts AS (SELECT src AS id FROM sim UNION SELECT dst FROM sim),
black AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 480000),
hits AS (SELECT p.o_custkey AS id FROM black b JOIN orders p ON b.o_orderkey = p.o_orderkey),
lab AS MATERIALIZED (SELECT v.id, CASE WHEN h.id IS NOT NULL THEN -1 ELSE v.id END AS label,
               h.id IS NOT NULL AS is_seed
        FROM verts v LEFT JOIN (SELECT DISTINCT id FROM hits WHERE id IS NOT NULL) h USING (id))"""


def _components_sql(edge_rel: str, vert_rel: str, name: str) -> str:
    """Recursive reachability; component = smallest reachable id."""
    return f"""{name}_und AS (SELECT src, dst FROM {edge_rel} WHERE src <> dst
                  UNION SELECT dst, src FROM {edge_rel} WHERE src <> dst),
{name}_reach(id, r) AS (SELECT id, id FROM {vert_rel}
                  UNION SELECT x.id, u.dst FROM {name}_reach x JOIN {name}_und u ON x.r = u.src),
{name} AS (SELECT id, min(r) AS component FROM {name}_reach GROUP BY id)"""


def _lpa_sql(steps: int, start: str = "SELECT id, id AS label FROM verts") -> str:
    parts = ["e2 AS (SELECT src AS target, dst AS source, weight FROM sim "
             "UNION ALL SELECT dst, src, weight FROM sim)",
             f"l0 AS ({start})"]
    for k in range(1, steps + 1):
        parts.append(f"""l{k} AS (
  SELECT v.id, coalesce(b.label, v.label) AS label FROM l{k-1} v LEFT JOIN (
    SELECT id, label FROM (
      SELECT e2.target AS id, l.label, row_number() OVER (
               PARTITION BY e2.target ORDER BY sum(e2.weight) DESC, l.label) AS rn
      FROM e2 JOIN l{k-1} l ON e2.source = l.id GROUP BY e2.target, l.label) WHERE rn = 1
  ) b USING (id))""")
    return ",\n".join(parts)


# the same edges by an equi join on the attributes (one record per customer), for
# the oracles that run many steps on them; ``similarity_edges`` keeps the theta join
SIM_EQ_SQL = f"""{CUST_SQL},
cell AS MATERIALIZED (
  SELECT c_custkey AS k, 1 AS pos, a1 AS v FROM cust WHERE a1 <> ''
  UNION ALL SELECT c_custkey, 2, a2 FROM cust WHERE a2 <> ''),
sim AS MATERIALIZED (
  SELECT a.k AS src, b.k AS dst, count(*) / 2.0::DOUBLE AS weight
  FROM cell a JOIN cell b ON a.pos = b.pos AND a.v = b.v AND a.k <> b.k GROUP BY 1, 2)"""

_BOTH_WAYS_SQL = """e2 AS MATERIALIZED (
  SELECT target, source, sum(weight) AS weight FROM (
    SELECT src AS target, dst AS source, weight FROM sim UNION ALL SELECT dst, src, weight FROM sim) GROUP BY 1, 2)"""


def _bm_sql(steps: int) -> str:
    parts = [_BOTH_WAYS_SQL, "d0 AS MATERIALIZED (SELECT id, label, 1.0::DOUBLE AS prob FROM lab)"]
    for k in range(1, steps + 1):
        p = f"d{k-1}"
        parts.append(f"""n{k} AS MATERIALIZED (
  SELECT id, label, s / sum(s) OVER (PARTITION BY id) AS prob FROM (
    SELECT e2.target AS id, d.label, sum(e2.weight * d.prob) AS s
    FROM e2 JOIN {p} d ON e2.source = d.id
    WHERE NOT EXISTS (SELECT 1 FROM {p} x WHERE x.id = e2.target AND x.label = -1 AND x.prob = 1.0)
    GROUP BY 1, 2)),
d{k} AS MATERIALIZED (
  SELECT id, label, prob FROM n{k}
  UNION ALL SELECT id, label, prob FROM {p} d WHERE NOT EXISTS (SELECT 1 FROM n{k} WHERE n{k}.id = d.id))""")
    return ",\n".join(parts)


def _seed_probability_sql(steps: int) -> str:
    """One number a vertex: the share of the seed label, the rest of a distribution being the others'."""
    parts = [_BOTH_WAYS_SQL, "p0 AS MATERIALIZED (SELECT id, is_seed::INT::DOUBLE AS prob FROM lab)"]
    for k in range(1, steps + 1):
        parts.append(f"""p{k} AS MATERIALIZED (
  SELECT p.id, CASE WHEN p.prob = 1.0 OR m.z IS NULL THEN p.prob ELSE m.s / m.z END AS prob
  FROM p{k-1} p LEFT JOIN (
    SELECT e2.target AS id, sum(e2.weight * q.prob) AS s, sum(e2.weight) AS z
    FROM e2 JOIN p{k-1} q ON e2.source = q.id GROUP BY 1) m USING (id))""")
    return ",\n".join(parts)


# ------------------------------------------------------------------ GR1-GR4
@register("distinct_focus", f"""WITH {CUST_SQL}
SELECT DISTINCT c_custkey, a1, a2 FROM cust
WHERE c_custkey IS NOT NULL AND CAST(c_custkey AS VARCHAR) <> ''""")
def q_distinct_focus(spark, sf_dir):
    return B.distinct_focus(customers(spark, sf_dir), "c_custkey", ["c_custkey", "a1", "a2"])


@register("similarity_edges", f"WITH {SIM_SQL} SELECT src, dst, weight FROM sim")
def q_similarity_edges(spark, sf_dir):
    return sim_edges(spark, sf_dir)


# Compat scoring on attributes with NULLs (negative balances) and empties
# (household segment) plus a third attribute: the comma-joined strings are
# split, trailing empties dropped, and lengths must agree.
_COMPAT_CUST = """cc AS (
  SELECT c_custkey,
         CASE WHEN c_acctbal >= 0 THEN concat_ws('|', CAST(floor(c_custkey / 100) AS BIGINT),
                                                 CAST(floor(c_acctbal / 500) AS BIGINT)) END AS a1,
         CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN ''
              ELSE concat_ws('|', c_nationkey, CAST(floor(c_custkey / 300) AS BIGINT)) END AS a2,
         concat_ws('|', c_mktsegment, CAST(floor(c_custkey / 50) AS BIGINT)) AS a3
  FROM customer),
cs AS (SELECT c_custkey AS k, concat_ws(',', a1, a2, a3) AS j FROM cc),
parts AS (SELECT DISTINCT k, CASE WHEN j <> '' AND rtrim(j, ',') = '' THEN []::VARCHAR[]
                                  ELSE string_split(rtrim(j, ','), ',') END AS p FROM cs)"""


@register("similarity_edges_compat", f"""WITH {_COMPAT_CUST},
scored AS (
  SELECT a.k AS src, b.k AS dst,
         list_sum(list_transform(range(1, len(a.p) + 1),
                  lambda i: CASE WHEN a.p[i] = b.p[i] AND b.p[i] <> '' THEN 1 ELSE 0 END))
           / len(a.p) AS weight
  FROM parts a JOIN parts b ON a.k <> b.k AND len(a.p) = len(b.p) AND len(a.p) > 0)
SELECT src, dst, max(weight) AS weight FROM scored GROUP BY 1, 2 HAVING max(weight) > 0""")
def q_similarity_edges_compat(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    cc = c.select(
        "c_custkey",
        F.when(F.col("c_acctbal") >= 0,
               F.concat_ws("|", F.floor(F.col("c_custkey") / 100), F.floor(F.col("c_acctbal") / 500))).alias("a1"),
        F.when(F.col("c_mktsegment") == "HOUSEHOLD", F.lit(""))
        .otherwise(F.concat_ws("|", F.col("c_nationkey").cast("string"), F.floor(F.col("c_custkey") / 300))).alias("a2"),
        F.concat_ws("|", F.col("c_mktsegment"), F.floor(F.col("c_custkey") / 50)).alias("a3"))
    return B.similarity_edges(cc, "c_custkey", ["a1", "a2", "a3"], compat=True)


@register("cooccurrence_edges", f"WITH {CO_SQL} SELECT src, dst, weight FROM co")
def q_cooccurrence_edges(spark, sf_dir):
    return co_edges(spark, sf_dir)


@register("graph_union", f"""WITH {SIM_SQL}, {CO_SQL}
SELECT src, dst, weight FROM sim UNION ALL SELECT src, dst, weight FROM co""")
def q_graph_union(spark, sf_dir):
    return B.union_edges(sim_edges(spark, sf_dir), co_edges(spark, sf_dir))


@register("graph_vertices", f"""WITH {SIM_SQL}, {CO_SQL},
u AS (SELECT src, dst FROM sim UNION ALL SELECT src, dst FROM co)
SELECT src AS id FROM u UNION SELECT dst FROM u""")
def q_graph_vertices(spark, sf_dir):
    return K.cell_vertices(cells(spark, sf_dir)).unionByName(B.graph_vertices(co_edges(spark, sf_dir))).distinct()


@register("vertex_strength", f"""WITH {SIM_SQL}, {CO_SQL},
u AS (SELECT src, dst, weight FROM sim UNION ALL SELECT src, dst, weight FROM co)
SELECT id, sum(weight) AS degree
FROM (SELECT src AS id, weight FROM u UNION ALL SELECT dst, weight FROM u) GROUP BY id""")
def q_vertex_strength(spark, sf_dir):
    both = K.cell_strength(cells(spark, sf_dir)).unionByName(B.vertex_strength(co_edges(spark, sf_dir)))
    return both.groupBy("id").agg(F.sum("degree").alias("degree"))


# every tenth customer is a second record of the customer before
_SEVERAL_SQL = SIM_SQL.replace("SELECT c_custkey,", "SELECT c_custkey - CASE WHEN c_custkey % 10 = 0 THEN 1 ELSE 0 END AS c_custkey,")


@register("record_strength", f"""WITH {_SEVERAL_SQL}
SELECT id, sum(weight) AS degree FROM (SELECT src AS id, weight FROM sim UNION ALL SELECT dst, weight FROM sim) GROUP BY id""")
def q_record_strength(spark, sf_dir):
    key = F.col("c_custkey") - F.when(F.col("c_custkey") % 10 == 0, 1).otherwise(0)
    return K.record_strength(customers(spark, sf_dir).withColumn("c_custkey", key), "c_custkey", ["a1", "a2"])


@register("total_weight", f"""WITH {SIM_SQL}, {CO_SQL}
SELECT sum(weight) AS total_weight
FROM (SELECT weight FROM sim UNION ALL SELECT weight FROM co)""")
def q_total_weight(spark, sf_dir):
    both = K.cell_total_weight(cells(spark, sf_dir)).unionByName(B.total_weight(co_edges(spark, sf_dir)))
    return both.agg(F.sum("total_weight").alias("total_weight"))


@register("black_seeds", f"""WITH {SIM_SQL}, {SEED_SQL}
SELECT id, label, is_seed FROM lab""")
def q_black_seeds(spark, sf_dir):
    labels, _ = seeds(spark, sf_dir, K.cell_vertices(cells(spark, sf_dir)))
    return labels


@register("black_counts", f"""WITH {SIM_SQL}, {SEED_SQL}
SELECT (SELECT count(*) FROM hits) AS black_num,
       (SELECT count(*) FROM lab WHERE is_seed) AS seeded""")
def q_black_counts(spark, sf_dir):
    _, counts = seeds(spark, sf_dir, K.cell_vertices(cells(spark, sf_dir)))
    return counts


# ------------------------------------------------------------------ GR12
@register("connected_components", f"""WITH RECURSIVE {SIM_SQL}, {SEED_SQL},
{_components_sql('sim', 'verts', 'comp')}
SELECT id, component FROM comp""")
def q_connected_components(spark, sf_dir):
    return K.cell_components(cells(spark, sf_dir))


@register("community_density", f"""WITH RECURSIVE {SIM_SQL}, {SEED_SQL},
{_components_sql('sim', 'verts', 'comp')}
SELECT c.component, c.n_vertices, coalesce(e.n_edges, 0) AS n_edges,
       round(coalesce(e.n_edges, 0) / c.n_vertices, 9) AS density
FROM (SELECT component, count(*) AS n_vertices FROM comp GROUP BY 1) c
LEFT JOIN (SELECT component, count(*) AS n_edges FROM sim JOIN comp ON sim.src = comp.id
           GROUP BY 1) e USING (component)""")
def q_community_density(spark, sf_dir):
    own = cut_lineage(cells(spark, sf_dir))
    d = CS.cell_density(own, cut_lineage(K.cell_components(own)))
    return d.select("component", "n_vertices", "n_edges", rnd("density", 9).alias("density"))


# ------------------------------------------------------------------ GR5, GR6
@register("label_propagation", f"""WITH {SIM_SQL}, {SEED_SQL},
{_lpa_sql(LPA_STEPS)}
SELECT id, label FROM l{LPA_STEPS}""")
def q_label_propagation(spark, sf_dir):
    return CP.cell_label_propagation(cells(spark, sf_dir), max_steps=LPA_STEPS)


@register("bm_label_propagation", f"""WITH {SIM_EQ_SQL}, {SEED_SQL},
{_bm_sql(BM_STEPS)}
SELECT id, label, round(prob + 1e-12, 9) AS prob FROM d{BM_STEPS}""")
def q_bm_label_propagation(spark, sf_dir):
    return _distributions(spark, sf_dir).select("id", "label", prob9().alias("prob"))


def _distributions(spark, sf_dir):
    shared = cut_lineage(cells(spark, sf_dir))
    labels, _ = seeds(spark, sf_dir, K.cell_vertices(shared))
    return CP.cell_bm_label_propagation(shared, labels, max_steps=BM_STEPS)


# GR5 started from the seeded labels (blacklisted vertices share label -1)
@register("label_propagation_seeded", f"""WITH {SIM_SQL}, {SEED_SQL},
{_lpa_sql(LPA_STEPS, "SELECT id, label FROM lab")}
SELECT id, label FROM l{LPA_STEPS}""")
def q_label_propagation_seeded(spark, sf_dir):
    shared = cut_lineage(cells(spark, sf_dir))
    labels, _ = seeds(spark, sf_dir, K.cell_vertices(shared))
    return CP.cell_label_propagation(shared, labels.select("id", "label"), max_steps=LPA_STEPS)


# GR14 per-vertex verdict over the distributions, probabilities taken
# at 9 decimals on both sides so near-ties compare alike in both engines
@register("vertex_verdict", f"""WITH {SIM_EQ_SQL}, {SEED_SQL},
{_bm_sql(BM_STEPS)},
r AS (SELECT id, label, round(prob + 1e-12, 9) AS prob FROM d{BM_STEPS}),
sp AS (SELECT id, prob AS sp FROM r WHERE label = -1),
best AS (SELECT id, label, prob FROM (
           SELECT id, label, prob,
                  row_number() OVER (PARTITION BY id ORDER BY prob DESC, label) AS rn FROM r)
         WHERE rn = 1)
SELECT b.id, CASE WHEN coalesce(sp.sp, 0) > 0 THEN -1 ELSE b.label END AS label,
       CASE WHEN coalesce(sp.sp, 0) > 0 THEN sp.sp ELSE b.prob END AS prob
FROM best b LEFT JOIN sp USING (id)""")
def q_vertex_verdict(spark, sf_dir):
    return R.vertex_verdict(_distributions(spark, sf_dir).withColumn("prob", prob9()))


# ------------------------------------------------------------------ GR14
_GREY_SQL = f"""{SIM_EQ_SQL}, {SEED_SQL},
{_seed_probability_sql(BM_STEPS)},
grey AS MATERIALIZED (SELECT id, prob FROM p{BM_STEPS} WHERE prob > 0),
gsub AS (SELECT s.* FROM sim s WHERE s.src IN (SELECT id FROM grey) AND s.dst IN (SELECT id FROM grey)),
{_components_sql('gsub', 'grey', 'gcomp')}"""


def _grey(spark, sf_dir):
    """Shared cells (written once), grey list and blacklist counts, without any pair."""
    shared = cut_lineage(cells(spark, sf_dir))
    labels, counts = seeds(spark, sf_dir, K.cell_vertices(shared))
    p = K.cell_seed_probability(shared, labels.select("id", "is_seed"), BM_STEPS)
    return shared, cut_lineage(p.where(F.col("prob") > 0)), counts


def _grey_cells(shared, grey):
    """The cells that two grey keys share."""
    own = shared.join(grey.select(F.col("id").alias("k")), on="k", how="left_semi").select("k", "len", "cell", "records")
    return K.shared_cells(own)


def _grey_components(shared, grey):
    """Groups of the grey list."""
    return K.cell_components(_grey_cells(shared, grey), vertices=grey.select("id"))


@register("grey_list", f"""WITH RECURSIVE {_GREY_SQL}
SELECT id, round(prob + 1e-12, 9) AS prob FROM grey""")
def q_grey_list(spark, sf_dir):
    _, grey, _ = _grey(spark, sf_dir)
    return grey.select("id", prob9().alias("prob"))


@register("fraud_groups", f"""WITH RECURSIVE {_GREY_SQL}
SELECT c.component, c.n_vertices, coalesce(e.n_edges, 0) AS n_edges,
       round(coalesce(e.n_edges, 0) / c.n_vertices, 9) AS density
FROM (SELECT component, count(*) AS n_vertices FROM gcomp GROUP BY 1) c
LEFT JOIN (SELECT component, count(*) AS n_edges FROM gsub JOIN gcomp ON gsub.src = gcomp.id
           GROUP BY 1) e USING (component)""")
def q_fraud_groups(spark, sf_dir):
    shared, grey, _ = _grey(spark, sf_dir)
    own = cut_lineage(_grey_cells(shared, grey))
    groups = CS.cell_density(own, cut_lineage(K.cell_components(own, vertices=grey.select("id"))))
    return groups.select("component", "n_vertices", "n_edges", rnd("density", 9).alias("density"))


@register("fraud_summary", f"""WITH RECURSIVE {_GREY_SQL}
SELECT (SELECT count(DISTINCT component) FROM gcomp) AS n_groups,
       (SELECT count(*) FROM hits) AS black_num,
       (SELECT count(*) FROM lab WHERE is_seed) AS seeded,
       (SELECT count(*) FROM gcomp) AS grey_num,
       (SELECT count(*) FROM lab WHERE is_seed) / nullif((SELECT count(*) FROM gcomp), 0)
         AS seed_share""")
def q_fraud_summary(spark, sf_dir):
    shared, grey, counts = _grey(spark, sf_dir)
    return R.fraud_summary(_grey_components(shared, grey), counts)


@register("fraud_members", f"""WITH RECURSIVE {_GREY_SQL}
SELECT DISTINCT c.c_custkey, c.a1, c.a2, g.component
FROM cust c JOIN gcomp g ON c.c_custkey = g.id""")
def q_fraud_members(spark, sf_dir):
    shared, grey, _ = _grey(spark, sf_dir)
    return R.fraud_members(customers(spark, sf_dir), "c_custkey", ["a1", "a2"], _grey_components(shared, grey))


# ------------------------------------------------------------------ CJ7 on the union graph
# similarity edges and customer-merchant links together, as in the fraud job
# with a customer column; one record per customer and merchant
_UNION_SQL = f"""{SIM_SQL.replace("sim AS (", "sim0 AS (")}, {CO_SQL},
sim AS MATERIALIZED (SELECT src, dst, weight FROM sim0 UNION ALL SELECT src, dst, weight FROM co)"""


def union_graph(spark, sf_dir):
    """``entity_graph`` with a customer column: the links table carries the merchant."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") + SUPPLIER_OFFSET).alias("merchant"))
    links = o.join(li, o.o_orderkey == li.l_orderkey).select(F.col("o_custkey").alias("c_custkey"), "merchant")
    return cut_lineage(B.entity_graph(customers(spark, sf_dir), "c_custkey", ["c_custkey", "a1", "a2"], ["a1", "a2"],
                                      links=links, cust="merchant"))


@register("entity_graph", f"""WITH {_UNION_SQL.replace("SELECT o.o_custkey AS src, l.l_suppkey + " + str(SUPPLIER_OFFSET) + " AS dst",
                                                      "SELECT l.l_suppkey + " + str(SUPPLIER_OFFSET) + " AS src, o.o_custkey AS dst")}
SELECT src, dst, weight FROM sim""")
def q_entity_graph(spark, sf_dir):
    return union_graph(spark, sf_dir)


_UNION_EQ_SQL = f"""{SIM_EQ_SQL.replace("sim AS MATERIALIZED (", "sim0 AS MATERIALIZED (")}, {CO_SQL},
sim AS MATERIALIZED (SELECT src, dst, weight FROM sim0 UNION ALL SELECT src, dst, weight FROM co)"""
_UNION_GREY_SQL = _GREY_SQL.replace(SIM_EQ_SQL, _UNION_EQ_SQL)


@register("grey_list_union", f"""WITH RECURSIVE {_UNION_GREY_SQL}
SELECT id, round(prob + 1e-12, 9) AS prob FROM grey""")
def q_grey_list_union(spark, sf_dir):
    e = union_graph(spark, sf_dir)
    labels, _ = seeds(spark, sf_dir, B.graph_vertices(e))
    return R.grey_list_from_seeds(e, labels, BM_STEPS).select("id", prob9().alias("prob"))


@register("fraud_groups_union", f"""WITH RECURSIVE {_UNION_GREY_SQL}
SELECT c.component, c.n_vertices, coalesce(e.n_edges, 0) AS n_edges,
       round(coalesce(e.n_edges, 0) / c.n_vertices, 9) AS density
FROM (SELECT component, count(*) AS n_vertices FROM gcomp GROUP BY 1) c
LEFT JOIN (SELECT component, count(*) AS n_edges FROM gsub JOIN gcomp ON gsub.src = gcomp.id
           GROUP BY 1) e USING (component)""")
def q_fraud_groups_union(spark, sf_dir):
    e = union_graph(spark, sf_dir)
    labels, _ = seeds(spark, sf_dir, B.graph_vertices(e))
    blocks = packed_graph(e)
    _, groups = R.fraud_groups(R.grey_list_from_seeds(e, labels, BM_STEPS, blocks), e, blocks)
    return groups.select("component", "n_vertices", "n_edges", rnd("density", 9).alias("density"))


# ------------------------------------------------------------------ Louvain
_LOUVAIN_ROUND_SQL = f"""{SIM_SQL},
nodes AS (SELECT id, sum(weight) AS degree
          FROM (SELECT src AS id, weight FROM sim UNION ALL SELECT dst, weight FROM sim)
          GROUP BY id),
m AS (SELECT sum(weight) AS m FROM sim),
kin AS (SELECT id, c, sum(weight) AS k_in
        FROM (SELECT src AS id, dst AS c, weight FROM sim UNION ALL SELECT dst, src, weight FROM sim)
        GROUP BY 1, 2),
q AS (SELECT k.id, k.c,
             k.k_in - 1.0 * (t.degree - CASE WHEN k.c = k.id THEN n.degree ELSE 0 END)
                    * n.degree / m.m AS q
      FROM kin k JOIN nodes t ON t.id = k.c JOIN nodes n ON n.id = k.id, m),
best AS (SELECT id, c, q, row_number() OVER (PARTITION BY id ORDER BY q DESC, c) AS rn FROM q),
mv AS (SELECT id, id AS comm, CASE WHEN q > 0 THEN c ELSE id END AS target,
              CASE WHEN q > 0 THEN q ELSE 0.0 END AS gain FROM best WHERE rn = 1),
mv_edges AS (SELECT id AS src, target AS dst FROM mv),
{_components_sql('mv_edges', 'mv', 'mcomp')},
nodes1 AS (SELECT n.id, coalesce(c.component, n.id) AS comm, n.degree, 0.0 AS inner_degree
           FROM nodes n LEFT JOIN mcomp c USING (id)),
t AS (SELECT s.weight, a.comm AS cs, b.comm AS cd
      FROM sim s JOIN nodes1 a ON s.src = a.id JOIN nodes1 b ON s.dst = b.id),
xe AS (SELECT least(cs, cd) AS src, greatest(cs, cd) AS dst, sum(weight) AS weight
       FROM t WHERE cs <> cd GROUP BY 1, 2)"""


def _one_round(spark, sf_dir):
    e = cut_lineage(sim_edges(spark, sf_dir))  # read several times
    m = e.agg(F.sum("weight")).first()[0]
    nodes = cut_lineage(L.louvain_init(e))
    return e, m, nodes


@register("louvain_best_move", f"""WITH RECURSIVE {_LOUVAIN_ROUND_SQL}
SELECT id, comm, target, round(gain, 9) AS gain FROM mv""")
def q_louvain_best_move(spark, sf_dir):
    e, m, nodes = _one_round(spark, sf_dir)
    mv = L.best_moves(nodes, cut_lineage(L.edge_ends(e)), m)
    return mv.select("id", "comm", "target", rnd("gain", 9).alias("gain"))


@register("louvain_coarsen_edges", f"""WITH RECURSIVE {_LOUVAIN_ROUND_SQL}
SELECT src, dst, weight FROM xe""")
def q_louvain_coarsen_edges(spark, sf_dir):
    e, m, nodes = _one_round(spark, sf_dir)
    nodes1, _ = L.louvain_local(nodes, e, m, max_iter=1)
    _, cross, _ = L.louvain_coarsen(nodes1, e)
    return cross


@register("louvain_coarsen_nodes", f"""WITH RECURSIVE {_LOUVAIN_ROUND_SQL},
intra AS (SELECT cs AS id, sum(weight * 2) AS intra FROM t WHERE cs = cd GROUP BY 1),
deg AS (SELECT id, sum(weight) AS degree
        FROM (SELECT src AS id, weight FROM xe UNION ALL SELECT dst, weight FROM xe) GROUP BY 1)
SELECT c.id, coalesce(d.degree, 0.0) AS degree, c.inner0 + coalesce(i.intra, 0.0) AS inner_degree
FROM (SELECT comm AS id, sum(inner_degree) AS inner0 FROM nodes1 GROUP BY 1) c
LEFT JOIN intra i USING (id) LEFT JOIN deg d USING (id)""")
def q_louvain_coarsen_nodes(spark, sf_dir):
    e, m, nodes = _one_round(spark, sf_dir)
    nodes1, _ = L.louvain_local(nodes, e, m, max_iter=1)
    new_nodes, _, _ = L.louvain_coarsen(nodes1, e)
    return new_nodes.select("id", "degree", "inner_degree")


@register("louvain", None)
def q_louvain(spark, sf_dir):
    return L.louvain(sim_edges(spark, sf_dir), max_iter=5, layers=2)


@register("louvain_communities", None)
def q_louvain_communities(spark, sf_dir):
    return L.communities(L.louvain(sim_edges(spark, sf_dir), max_iter=5, layers=2))


# ------------------------------------------------------------------ full Louvain oracle
def _louvain_sql(max_iter: int = 5, layers: int = 2) -> tuple[str, str]:
    """Unrolled SQL of the full Louvain run.

    A round without changes leaves the state as it is, so every level runs
    exactly ``max_iter`` rounds; a level is reported only when every earlier
    level changed something in its first round (the driver's stop rule).
    """
    parts = [SIM_SQL,
             "m AS (SELECT sum(weight) AS m FROM sim)",
             "E0 AS (SELECT src, dst, weight FROM sim)",
             """N0_0 AS (SELECT id, id AS comm, sum(weight) AS degree, 0.0::DOUBLE AS inner_degree
         FROM (SELECT src AS id, weight FROM sim UNION ALL SELECT dst, weight FROM sim) GROUP BY id)""",
             "M0 AS (SELECT id AS vertex, id AS node FROM N0_0)",
             "X0 AS (SELECT true AS ok)"]
    snaps = []
    for lv in range(layers + 2):
        if lv > 0:
            p, e = f"N{lv-1}_{max_iter}", f"E{lv-1}"
            parts.append(f"""CT{lv} AS (SELECT x.weight, a.comm AS cs, b.comm AS cd
        FROM {e} x JOIN {p} a ON x.src = a.id JOIN {p} b ON x.dst = b.id)""")
            parts.append(f"""E{lv} AS (SELECT least(cs, cd) AS src, greatest(cs, cd) AS dst, sum(weight) AS weight
        FROM CT{lv} WHERE cs <> cd GROUP BY 1, 2)""")
            parts.append(f"""N{lv}_0 AS (
  SELECT o.id, o.id AS comm, coalesce(d.degree, 0.0) AS degree,
         o.inner0 + coalesce(i.intra, 0.0) AS inner_degree
  FROM (SELECT comm AS id, sum(inner_degree) AS inner0 FROM {p} GROUP BY 1) o
  LEFT JOIN (SELECT cs AS id, sum(weight * 2) AS intra FROM CT{lv} WHERE cs = cd GROUP BY 1) i USING (id)
  LEFT JOIN (SELECT id, sum(weight) AS degree
             FROM (SELECT src AS id, weight FROM E{lv} UNION ALL SELECT dst, weight FROM E{lv})
             GROUP BY 1) d USING (id))""")
            parts.append(f"""M{lv} AS (SELECT mm.vertex, n.comm AS node
        FROM M{lv-1} mm JOIN {p} n ON mm.node = n.id)""")
            parts.append(f"""X{lv} AS (SELECT x.ok AND (SELECT count(*) FROM MV{lv-1}_1 WHERE target <> comm) > 0 AS ok
        FROM X{lv-1} x)""")
        for it in range(1, max_iter + 1):
            p, t = f"N{lv}_{it-1}", f"{lv}_{it}"
            parts.append(f"""T{t} AS (SELECT x.src, x.dst, x.weight, a.comm AS cs, b.comm AS cd
        FROM E{lv} x JOIN {p} a ON x.src = a.id JOIN {p} b ON x.dst = b.id)""")
            parts.append(f"""K{t} AS (SELECT id, c, sum(weight) AS k_in
        FROM (SELECT src AS id, cd AS c, weight FROM T{t} UNION ALL SELECT dst, cs, weight FROM T{t})
        GROUP BY 1, 2)""")
            parts.append(f"""Q{t} AS (
  SELECT k.id, k.c, n.comm AS own,
         k.k_in - 1.0::DOUBLE * (tt.tot - CASE WHEN k.c = n.comm THEN n.degree + n.inner_degree ELSE 0.0 END)
                * (n.degree + n.inner_degree) / m.m AS q
  FROM K{t} k
  JOIN (SELECT comm AS c, sum(degree + inner_degree) AS tot FROM {p} GROUP BY 1) tt ON tt.c = k.c
  JOIN {p} n ON n.id = k.id, m)""")
            parts.append(f"""MV{t} AS (SELECT id, own AS comm, CASE WHEN q > 0 THEN c ELSE own END AS target
        FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY q DESC, c) AS rn FROM Q{t})
        WHERE rn = 1)""")
            parts.append(f"""U{t} AS (SELECT id AS src, target AS dst FROM MV{t} WHERE id <> target
        UNION SELECT target, id FROM MV{t} WHERE id <> target)""")
            parts.append(f"""R{t}(id, r) AS (SELECT id, id FROM MV{t}
        UNION SELECT x.id, u.dst FROM R{t} x JOIN U{t} u ON x.r = u.src)""")
            parts.append(f"""N{t} AS (SELECT n.id, coalesce(c.component, n.comm) AS comm, n.degree, n.inner_degree
        FROM {p} n LEFT JOIN (SELECT id, min(r) AS component FROM R{t} GROUP BY id) c USING (id))""")
        snaps.append(f"""SELECT mm.vertex, {lv} AS level, n.comm AS community
FROM M{lv} mm JOIN N{lv}_{max_iter} n ON mm.node = n.id, X{lv} WHERE X{lv}.ok""")
    return ",\n".join(parts), "\nUNION ALL\n".join(snaps)


_LOUVAIN_CTES, _LOUVAIN_SNAPS = _louvain_sql()
_LOUVAIN_FULL_SQL = f"WITH RECURSIVE {_LOUVAIN_CTES}\n{_LOUVAIN_SNAPS}"
REGISTRY["louvain"] = (q_louvain, _LOUVAIN_FULL_SQL)
REGISTRY["louvain_communities"] = (
    q_louvain_communities,
    f"SELECT level, community, count(*) AS size FROM ({_LOUVAIN_FULL_SQL}) GROUP BY 1, 2")


# Modularity of every Louvain level at the run's resolution (2.0).
@register("louvain_modularity", f"""WITH RECURSIVE {_LOUVAIN_CTES},
lv AS ({_LOUVAIN_SNAPS}),
tm AS (SELECT sum(2 * weight) AS t FROM sim),
st AS (SELECT id, sum(weight) AS degree
       FROM (SELECT src AS id, weight FROM sim UNION ALL SELECT dst, weight FROM sim) GROUP BY id),
tot AS (SELECT l.level, l.community AS c, sum(st.degree) AS tot
        FROM lv l JOIN st ON st.id = l.vertex GROUP BY 1, 2),
ins AS (SELECT a.level, a.community AS c, sum(2 * x.weight) AS in_c
        FROM sim x JOIN lv a ON x.src = a.vertex
                   JOIN lv b ON x.dst = b.vertex AND a.level = b.level
        WHERE a.community = b.community GROUP BY 1, 2)
SELECT t.level, round(sum(coalesce(i.in_c, 0.0) / tm.t - 2.0 * (t.tot / tm.t) * (t.tot / tm.t)), 9)
         AS modularity
FROM tot t LEFT JOIN ins i USING (level, c), tm GROUP BY t.level""")
def q_louvain_modularity(spark, sf_dir):
    e = cut_lineage(sim_edges(spark, sf_dir))  # read by both
    mem = L.louvain(e)
    q = L.modularity(e, mem, resolution=2.0, by=["level"])
    return q.select("level", rnd("modularity", 9).alias("modularity"))


# Louvain on the union graph (customers and merchants).
@register("louvain_union", f"""WITH RECURSIVE {_LOUVAIN_CTES.replace(SIM_SQL, _UNION_SQL)}
{_LOUVAIN_SNAPS}""")
def q_louvain_union(spark, sf_dir):
    return L.louvain(union_graph(spark, sf_dir), max_iter=5, layers=2)
