"""Lineage and graph queries. Edges: orders hierarchy (nation > customer > order) and dialogue turns; a small numeric graph for paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atomweave.operators.lineage import walk
from atomweave.plans.base import Registry, run_sql, table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

# region -> nation -> customer -> order, as (src, dst)
_EDGES = """SELECT concat('r', r_regionkey) AS src, concat('n', n_nationkey) AS dst FROM region JOIN nation ON n_regionkey = r_regionkey
  UNION ALL SELECT concat('n', c_nationkey), concat('c', c_custkey) FROM customer
  UNION ALL SELECT concat('c', o_custkey), concat('o', o_orderkey) FROM orders"""

def _edges(spark, sf_dir) -> DataFrame:
    return run_sql(spark, sf_dir, _EDGES)


def _joined(separator: str) -> F.Column:
    return F.array_join("path", separator).alias("path")


@R.add(
    "lineage_downstream",
    f"""WITH RECURSIVE e AS ({_EDGES}), d(node, depth, path) AS (
      SELECT 'r1' AS node, 0 AS depth, 'r1' AS path UNION ALL
      SELECT e.dst, d.depth + 1, concat(d.path, '>', e.dst) FROM d JOIN e ON e.src = d.node)
    SELECT node, depth, path FROM d""",
)
def lineage_downstream(spark, sf_dir):
    """To the end."""
    return walk(_edges(spark, sf_dir), "r1").select("node", "depth", _joined(">"))


@R.add(
    "lineage_upstream",
    f"""WITH RECURSIVE e AS ({_EDGES}), u(node, depth, path) AS (
      SELECT 'o1' AS node, 0 AS depth, 'o1' AS path UNION ALL
      SELECT e.src, u.depth + 1, concat(u.path, '<', e.src) FROM u JOIN e ON e.dst = u.node WHERE u.depth < 5)
    SELECT node, depth, path FROM u""",
)
def lineage_upstream(spark, sf_dir):
    return walk(_edges(spark, sf_dir), "o1", 5, upstream=True).select("node", "depth", _joined("<"))


@R.add(
    "lineage_both",
    f"""WITH RECURSIVE e AS ({_EDGES}), d(node, depth) AS (SELECT 'c7' AS node, 0 AS depth UNION ALL SELECT e.dst, d.depth + 1 FROM d JOIN e ON e.src = d.node WHERE d.depth < 10),
    u(node, depth) AS (SELECT 'c7' AS node, 0 AS depth UNION ALL SELECT e.src, u.depth + 1 FROM u JOIN e ON e.dst = u.node WHERE u.depth < 10)
    SELECT node, depth, 'down' AS direction FROM d UNION ALL SELECT node, -depth, 'up' FROM u WHERE depth > 0""",
)
def lineage_both(spark, sf_dir):
    e = _edges(spark, sf_dir)
    down = walk(e, "c7", 10).select("node", "depth", F.lit("down").alias("direction"))
    return down.unionByName(walk(e, "c7", 10, upstream=True).where("depth > 0").select("node", (-F.col("depth")).alias("depth"), F.lit("up").alias("direction")))


@R.add(
    "impact_analysis",
    f"""WITH RECURSIVE e AS ({_EDGES}), d(node, depth) AS (
      SELECT 'n3' AS node, 0 AS depth UNION ALL SELECT e.dst, d.depth + 1 FROM d JOIN e ON e.src = d.node WHERE d.depth < 100)
    SELECT node, depth, count(*) OVER () AS total FROM d WHERE depth > 0""",
)
def impact_analysis(spark, sf_dir):
    hit = walk(_edges(spark, sf_dir), "n3", 100).where("depth > 0").select("node", "depth")
    return hit.withColumn("total", F.lit(hit.count()).cast("long"))


# turns 0, 1, 2 ... without a gap: a turn belongs to the path while it equals the number of turns before it
R.sql("session_paths", "SELECT conv_id, max(turn) AS length FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM (SELECT DISTINCT conv_id, turn FROM conversations) d) s WHERE turn = n GROUP BY conv_id")
R.sql(
    "link_provenance_idempotent",
    """WITH old AS (SELECT DISTINCT conv_id AS a, turn AS b FROM conversations WHERE turn < 3), fresh AS (SELECT DISTINCT conv_id AS a, turn AS b FROM conversations WHERE turn BETWEEN 2 AND 4)
    SELECT a, b, 'old' AS kind FROM old UNION ALL SELECT a, b, 'new' FROM fresh WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.a = fresh.a AND old.b = fresh.b)""",
)
R.sql(
    "export_provenance_json",
    "SELECT conv_id, to_json(sort_array(collect_list(struct(turn, role)))) AS doc FROM conversations GROUP BY conv_id",
    """SELECT conv_id, '[' || string_agg('{"turn":' || turn || ',"role":"' || role || '"}', ',' ORDER BY turn, role) || ']' AS doc FROM conversations GROUP BY conv_id""",
)
R.sql(
    "export_graphml",
    f"SELECT concat('<edge source=\"', src, '\" target=\"', dst, '\"/>') AS line FROM ({_EDGES}) e",
)
R.sql(
    "influencing_weighted",
    f"""SELECT src, count(*) AS fan_out, round(1.0 / count(*), 6) AS weight FROM ({_EDGES}) e GROUP BY src""".replace("round(1.0 / count(*), 6)", "round(CAST(1 AS DOUBLE) / count(*), 6)"),
)
R.sql("error_clusters", "SELECT props, count(*) AS n, count(DISTINCT user_id) AS users, min(event_id) AS first_id FROM events WHERE event_type = 'error' GROUP BY props HAVING count(*) >= 5")

# a sparse numeric graph over nations: i -> 2i+1, i -> 3i+2 modulo 25, weight by distance
_GRAPH = "SELECT n_nationkey AS a, (2 * n_nationkey + 1) % 25 AS b, 1.0 + n_nationkey % 3 AS w FROM nation UNION ALL SELECT n_nationkey, (3 * n_nationkey + 2) % 25, 2.0 + n_nationkey % 5 FROM nation"
_RANK_ROUNDS = 10


def _graph(spark, sf_dir) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("a"))
    one = n.select("a", ((2 * F.col("a") + 1) % 25).alias("b"), (1.0 + F.col("a") % 3).alias("w"))
    return one.union(n.select("a", ((3 * F.col("a") + 2) % 25).alias("b"), (2.0 + F.col("a") % 5).alias("w")))


def shortest_paths(edges: DataFrame, start: int, rounds: int = 1000) -> DataFrame:
    """(node, cost) from one node. A round relaxes the edges of the nodes whose cost changed, until none does."""
    best = edges.sparkSession.range(1).select(F.lit(start).cast("int").alias("node"), F.lit(0.0).alias("cost"), F.lit(True).alias("fresh")).checkpoint()
    for _ in range(rounds):
        step = best.where("fresh").join(edges, F.col("node") == F.col("a")).groupBy(F.col("b").alias("node")).agg(F.min(F.col("cost") + F.col("w")).alias("found"))
        best = best.drop("fresh").join(step, "node", "full").select("node", F.least("cost", "found").alias("cost"), F.coalesce(F.col("found") < F.col("cost"), F.col("cost").isNull()).alias("fresh")).checkpoint()
        if not best.where("fresh").limit(1).count():
            return best.select("node", "cost")
    raise RuntimeError(f"costs didn't settle in {rounds} rounds")


@R.add(
    "shortest_path",
    f"""WITH RECURSIVE g AS ({_GRAPH}), p(node, cost, depth) AS (SELECT 0, 0.0::DOUBLE, 0 UNION SELECT g.b, p.cost + g.w, p.depth + 1 FROM p JOIN g ON g.a = p.node WHERE p.depth < 9)
       SELECT node::INT AS node, min(cost) AS cost FROM p GROUP BY node""",
)
def shortest_path(spark, sf_dir):
    _checkpoints(spark)
    return shortest_paths(_graph(spark, sf_dir), 0)


def _checkpoints(spark) -> None:
    """The shared folder of the session; where none is set, one in the warehouse."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints")


def page_rank(edges: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """(node, rank): rounds until the sum of changes is under the tolerance; the mass of nodes without out-edges is lost."""
    out = edges.groupBy("a").agg(F.count("*").alias("out"))
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().checkpoint()
    n = nodes.count()
    rank = nodes.withColumn("rank", F.lit(1.0 / n))
    for _ in range(rounds):
        given = rank.join(out, rank.node == out.a).select("a", (F.col("rank") / F.col("out")).alias("r")).join(edges, "a").groupBy(F.col("b").alias("node")).agg(F.sum("r").alias("r"))
        new = rank.join(given, "node", "left").select("node", F.col("rank").alias("old"), ((1 - damping) / n + damping * F.coalesce("r", F.lit(0.0))).alias("rank")).checkpoint()
        moved = new.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] or 0.0
        rank = new.drop("old")
        if moved < tolerance:
            break
    return rank


# the oracle goes through all rounds and takes the first that moves less than the tolerance
@R.add(
    "page_rank",
    f"""WITH RECURSIVE g AS MATERIALIZED ({_GRAPH}), o AS MATERIALIZED (SELECT a, count(*) AS n FROM g GROUP BY a),
    x AS MATERIALIZED (SELECT g.a, g.b, 1.0::DOUBLE / o.n AS share FROM g JOIN o ON o.a = g.a UNION ALL SELECT n_nationkey, n_nationkey, 0.0::DOUBLE FROM nation),
    r(node, rank, i) AS (SELECT n_nationkey, 0.04::DOUBLE, 0 FROM nation UNION ALL SELECT x.b, 0.006::DOUBLE + 0.85::DOUBLE * sum(r.rank * x.share), r.i + 1 FROM r JOIN x ON x.a = r.node WHERE r.i < 100 GROUP BY x.b, r.i),
    d AS (SELECT p.i + 1 AS i, sum(abs(q.rank - p.rank)) AS moved FROM r p JOIN r q ON q.node = p.node AND q.i = p.i + 1 GROUP BY p.i)
    SELECT node, round(rank, 8) AS rank FROM r WHERE i = (SELECT coalesce(min(i), 100) FROM d WHERE moved < 0.000001)""",
)
def page_rank_query(spark, sf_dir):
    _checkpoints(spark)
    return page_rank(_graph(spark, sf_dir)).select("node", F.round("rank", 8).alias("rank"))


def _reached(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """(a, b): b can be reached from a, a itself among them; grows along the newest pairs only."""
    all_pairs = edges.select("a").union(edges.select("b")).distinct().select("a", F.col("a").alias("b")).checkpoint()
    front = all_pairs
    step = edges.select(F.col("a").alias("b"), F.col("b").alias("c")).distinct()
    for _ in range(rounds):
        front = front.join(step, "b").select("a", F.col("c").alias("b")).distinct().join(all_pairs, ["a", "b"], "left_anti").checkpoint()
        if not front.limit(1).count():
            return all_pairs
        all_pairs = all_pairs.union(front).checkpoint()
    raise RuntimeError(f"reachability didn't settle in {rounds} rounds")


@R.add(
    "strong_components",
    f"""WITH RECURSIVE g AS MATERIALIZED ({_GRAPH}), t(a, b) AS (SELECT n_nationkey, n_nationkey FROM nation UNION SELECT t.a, g.b FROM t JOIN g ON g.a = t.b)
       SELECT x.a AS node, min(x.b) AS component FROM t x JOIN t y ON y.a = x.b AND y.b = x.a GROUP BY x.a""",
)
def strong_components(spark, sf_dir):
    """Nodes that reach each other, named by the smallest; for the condensed graphs of bounded size that reachability suits."""
    _checkpoints(spark)
    t = _reached(_graph(spark, sf_dir))
    back = t.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return t.join(back, ["a", "b"]).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))


# a path to node 7: cost so far plus a lower bound that never overestimates prunes what can't lie on the best path
@R.add(
    "optimal_path",
    f"""WITH RECURSIVE g AS MATERIALIZED ({_GRAPH}), p(node, cost, path) AS (SELECT 0, 0.0::DOUBLE, '0' UNION ALL
         SELECT g.b, p.cost + g.w, p.path || '>' || g.b FROM p JOIN g ON g.a = p.node WHERE p.node <> 7 AND NOT list_contains(string_split(p.path, '>'), g.b::VARCHAR) AND p.cost + g.w <= 60)
       SELECT path, cost FROM p WHERE node = 7 ORDER BY cost, path LIMIT 1""",
)
def optimal_path(spark, sf_dir):
    """A*: paths grow from the front whose cost plus bound is at most the best goal cost; the bound is one cheapest edge, none at the goal."""
    _checkpoints(spark)
    g, goal = _graph(spark, sf_dir), 7
    cheapest = g.agg(F.min("w")).first()[0]
    front = spark.range(1).select(F.lit(0).cast("int").alias("node"), F.lit(0.0).alias("cost"), F.lit("0").alias("path")).checkpoint()
    best = front.limit(0)
    closed = front.select("node", "cost")
    while front.limit(1).count():
        grown = front.join(g, F.col("node") == F.col("a")).select(F.col("b").alias("node"), (F.col("cost") + F.col("w")).alias("cost"), F.concat_ws(">", "path", F.col("b").cast("string")).alias("path"))
        grown = grown.groupBy("node").agg(F.min(F.struct("cost", "path")).alias("x")).select("node", "x.cost", "x.path")
        grown = grown.join(closed.select("node", F.col("cost").alias("old")), "node", "left").where("old IS NULL OR cost < old").drop("old").checkpoint()
        best = best.union(grown.where(F.col("node") == goal)).orderBy("cost", "path").limit(1).checkpoint()
        most = best.agg(F.min("cost")).first()[0]
        closed = closed.union(grown.select("node", "cost")).groupBy("node").agg(F.min("cost").alias("cost")).checkpoint()
        front = grown.where((F.col("node") != goal) & (F.col("cost") + cheapest <= (float("inf") if most is None else most)))
    return best.select("path", "cost")
