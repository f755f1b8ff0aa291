"""Evaluation, search, lineage and actions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import action_hash, rounded
from ..operators import actions, evaluation, lineage, model, ranking, search
from ..sources import adapters as ad
from .registry import query
from .similarity import EVT

SEEN = {"intra": "d.seq < q.seq", "intrab": "d.step < q.step", "inter": "d.lemma <> q.lemma", "real": "d.lemma <> q.lemma AND d.status = 'Original'"}


def eval_sql(protocol: str, win: str = "win", ef: str = "ef") -> str:
    return f"""SELECT q.seq, q.action AS truth, CAST(coalesce(k.rank, -1) AS INTEGER) AS truth_rank FROM ev q LEFT JOIN (
      SELECT seq, action, row_number() OVER (PARTITION BY seq ORDER BY score DESC, action) - 1 AS rank FROM (
        SELECT p.seq, p.action, round(coalesce(max(s.score), 0.0), 6) AS score FROM (
          SELECT DISTINCT q.seq, d.action FROM ev q JOIN ev d ON d.seq < q.seq AND d.seq >= q.seq - 1000 AND {SEEN[protocol]}) p
        LEFT JOIN (
          SELECT q.seq, d.entry_id, d.action, sum(ln((1.0 + w.n) / (1.0 + w.df))) AS score
          FROM ev q JOIN {win} w ON w.seq = q.seq JOIN {ef} f ON f.feature = w.feature JOIN ev d ON d.entry_id = f.entry_id
          WHERE d.seq < q.seq AND d.seq >= q.seq - 1000 AND {SEEN[protocol]} GROUP BY ALL) s ON s.seq = p.seq AND s.action = p.action
        GROUP BY ALL)) k ON k.seq = q.seq AND k.action = q.action"""


WIN = EVT + """,
  win AS (SELECT seq, feature, count(*) OVER (PARTITION BY feature ORDER BY seq RANGE BETWEEN 1000 PRECEDING AND 1 PRECEDING) AS df, least(seq - 1, 1000) AS n FROM ef WHERE feature IS NOT NULL)"""


#: Complex features: the tokens of an event by kind, and each with the one before it.
COMPLEX = WIN + """,
  tok AS (SELECT seq, list_filter(['user=' || user_id, 'hour=' || hour(ts), 'value=' || CAST(floor(value / 10) AS BIGINT), 'k=' || json_extract_string(props, '$.k')], lambda t: t IS NOT NULL) AS t FROM seqs),
  cf AS (SELECT DISTINCT entry_id, seq, feature FROM (SELECT event_id AS entry_id, seqs.seq, unnest(list_concat(list_transform(t, lambda a: 'Seman:' || a), list_transform(range(2, len(t) + 1), lambda i: 'Verti:' || t[i] || '-' || t[i - 1]))) AS feature FROM tok JOIN seqs USING (seq))),
  cwin AS (SELECT seq, feature, count(*) OVER (PARTITION BY feature ORDER BY seq RANGE BETWEEN 1000 PRECEDING AND 1 PRECEDING) AS df, least(seq - 1, 1000) AS n FROM cf)"""


def evaluated(spark: SparkSession, sf_dir: str, protocol: str) -> DataFrame:
    return evaluation.prequential(ad.event_instances(spark, sf_dir), ad.event_features(spark, sf_dir).select("seq", "feature"), protocol=protocol)


#: Columns of the matrix that have exact neighbours.
MATRIX = [(p, k) for k in ("simple", "complex") for p in ("real", "intra", "intrab", "inter")]


@query(f"WITH {WIN} {eval_sql('intra')}")
def eval_intra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluated(spark, sf_dir, "intra")


@query(f"WITH {WIN} {eval_sql('intrab')}")
def eval_intrab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluated(spark, sf_dir, "intrab")


@query(f"WITH {WIN} {eval_sql('inter')}")
def eval_inter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluated(spark, sf_dir, "inter")


@query(f"WITH {WIN} {eval_sql('real')}")
def eval_real(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluated(spark, sf_dir, "real")


@query(f"""WITH {COMPLEX}, {", ".join(f"{p}_{k} AS ({eval_sql(p, *(('win', 'ef') if k == 'simple' else ('cwin', 'cf')))})" for p, k in MATRIX)}
  SELECT row_number() OVER (ORDER BY seq) AS "row", {", ".join(f"coalesce(CAST({p}_{k}.truth_rank AS VARCHAR), '') AS \"{p}-{k}-knn\"" for p, k in MATRIX)}
  FROM {" JOIN ".join(f"{p}_{k}" + (" USING (seq)" if n else "") for n, (p, k) in enumerate(MATRIX))}""")
def eval_matrix_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Protocols by learners; seq is dense from 1, so it is the row already (evaluation.matrix() numbers rows where it is not)."""
    kinds = {"simple": ad.event_features(spark, sf_dir), "complex": ad.event_complex_features(spark, sf_dir)}
    simple, complex_ = (x.select("seq", F.lit(k).alias("kind"), "feature") for k, x in kinds.items())
    ranks = evaluation.compared(ad.event_instances(spark, sf_dir), simple.unionByName(complex_), {f"{p}-{k}-knn": (p, k) for p, k in MATRIX})
    return ranks.select(F.col("seq").alias("row"), *(F.coalesce(F.col(f"`{p}-{k}-knn`").cast("string"), F.lit("")).alias(f"{p}-{k}-knn") for p, k in MATRIX))


@query(f"WITH {EVT} SELECT entry_id, action, starts_with(user_id::VARCHAR, '1') AS in_file FROM ev")
def eval_file_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ad.event_instances(spark, sf_dir).withColumn("path", F.col("user_id").cast("string"))
    return evaluation.split(rows, "1").select("entry_id", "action", "in_file")


@query("""SELECT event_type AS kind, count(*) AS lemmas, count(*) FILTER (value > 50 AND event_id % 97 <= 60) AS solved, round(avg(value), 6) AS mean_time, CAST(sum(event_id % 97) AS BIGINT) AS inferences, CAST(sum(user_id % 7) AS BIGINT) AS predictions
  FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20) GROUP BY event_type""")
def bench_outcomes_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = ad.table(spark, sf_dir, "events").select(F.col("user_id").alias("lemma"), F.col("event_type").alias("kind"), F.col("value").alias("time"), (F.col("event_id") % 97).alias("inferences"), (F.col("user_id") % 7).alias("predictions"), (F.col("value") > 50).alias("solved"))
    should = ad.table(spark, sf_dir, "customer").where("c_nationkey < 20").select(F.col("c_custkey").alias("lemma"))
    return evaluation.report(evaluation.outcomes(runs, should, budget=60), "kind")


SUCC = """
  nxt AS (SELECT event_type AS state, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS next FROM events),
  cnt AS (SELECT state, next, count(*) AS n FROM nxt WHERE next IS NOT NULL GROUP BY ALL),
  succ AS (SELECT state, next, CAST(row_number() OVER (PARTITION BY state ORDER BY n DESC, next) - 1 AS INTEGER) AS rank FROM cnt)"""


def successors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(state, rank, confidence, next): what follows an event type, the most frequent first."""
    following = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    counts = ad.table(spark, sf_dir, "events").select(F.col("event_type").alias("state"), following.alias("next")).where("next is not null").groupBy("state", "next").count()
    rank = F.row_number().over(Window.partitionBy("state").orderBy(F.desc("count"), "next")) - 1
    return counts.select("state", "next", rank.alias("rank")).withColumn("confidence", -0.75 * (F.col("rank") + 1))


@query(f"""WITH RECURSIVE {SUCC},
  r AS (SELECT DISTINCT event_type AS start, event_type AS state, '' AS path, 0 AS spent, 0 AS len FROM events
        UNION ALL SELECT r.start, s.next, r.path || ',' || s.rank, r.spent + s.rank + 1, r.len + 1 FROM r JOIN succ s ON s.state = r.state WHERE r.spent + s.rank + 1 <= 8)
  SELECT * FROM r""")
def search_diagonal_budget8(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = ad.table(spark, sf_dir, "events").select(F.col("event_type").alias("start")).distinct()
    return search.diagonal(spark, successors(spark, sf_dir), starts, budget=8)


@query(f"""WITH RECURSIVE {SUCC},
  r AS (SELECT DISTINCT event_type AS start, event_type AS state, '' AS path, CAST(5.0 AS DOUBLE) AS "left", 0 AS len FROM events
        UNION ALL SELECT r.start, s.next, r.path || ',' || s.rank, r."left" - 0.75 * (s.rank + 1), r.len + 1 FROM r JOIN succ s ON s.state = r.state WHERE r."left" - 0.75 * (s.rank + 1) > 0)
  SELECT * FROM r""")
def search_cheapest(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = ad.table(spark, sf_dir, "events").select(F.col("event_type").alias("start")).distinct()
    return search.cheapest(spark, successors(spark, sf_dir), starts, budget=5.0)


@query("""SELECT conv_id AS path_id, string_agg('only ' || (turn % 2 + 1) || ': ' || role, '; ' ORDER BY turn) AS witness, array_to_string(list(turn % 3 ORDER BY turn), ',') AS trace FROM conversations GROUP BY conv_id""")
def search_witness(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = ad.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("path_id"), F.col("turn").alias("at"), (F.col("turn") % 2).alias("focus"), F.col("role").alias("action"), (F.col("turn") % 3).alias("rank"))
    return search.witness(steps).withColumn("trace", F.array_join(F.transform("trace", lambda x: x.cast("string")), ","))


@query("""SELECT user_id AS goal, event_id AS rank, user_id % 2 = 0 AS independent FROM events
  QUALIFY user_id % 2 <> 0 OR row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1""")
def independent_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    goals = ad.table(spark, sf_dir, "events").select(F.col("user_id").alias("goal"), F.col("event_id").alias("rank"), (F.col("user_id") % 2 == 0).alias("independent"))
    return search.committed(goals)


@query("""SELECT DISTINCT l_suppkey AS goal FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O'
  AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)""")
def solved_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = ad.table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("goal"))
    edges = ad.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("dst"))
    after = ad.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("goal"), (F.col("s_acctbal") > 0).alias("solved"))
    return search.unsolved(before, after, edges)


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS src, (n_nationkey * 7 + 3) % 25 AS dst FROM nation UNION SELECT n_nationkey, 100 + n_regionkey FROM nation
    UNION SELECT 1000 + range, 1001 + range FROM range(200) UNION SELECT 100, 1000),
  r AS (SELECT node, node AS reached FROM (SELECT n_nationkey AS node FROM nation UNION SELECT src FROM e) UNION SELECT r.node, e.dst FROM r JOIN e ON e.src = r.reached)
  SELECT node, reached FROM r""")
def deps_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each nation, region and link of a chain of 200 depends on; the chain stands behind one of the regions."""
    n = ad.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("r"))
    edges = n.select(F.col("k").alias("src"), ((F.col("k") * 7 + 3) % 25).alias("dst")).unionByName(n.select(F.col("k").alias("src"), (F.col("r") + 100).alias("dst")))
    chain = spark.range(200).select((F.col("id") + 1000).alias("src"), (F.col("id") + 1001).alias("dst")).unionByName(spark.sql("SELECT 100L AS src, 1000L AS dst"))
    edges = edges.unionByName(chain)
    return search.closure(spark, edges, n.select(F.col("k").alias("node")).unionByName(edges.select(F.col("src").alias("node"))))


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS src, (n_nationkey * 7 + 3) % 25 AS dst FROM nation),
  r AS (SELECT n_nationkey AS node, n_nationkey AS reached FROM nation UNION SELECT r.node, e.dst FROM r JOIN e ON e.src = r.reached)
  SELECT n_nationkey AS node, n_nationkey IN (SELECT node FROM r JOIN nation x ON x.n_nationkey = r.reached WHERE x.n_regionkey = 0) AS contains FROM nation""")
def contains_transitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = ad.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("r"))
    edges = n.select(F.col("node").alias("src"), ((F.col("node") * 7 + 3) % 25).alias("dst"))
    hit = search.closure(spark, edges, n.select("node")).join(n.where("r = 0").select(F.col("node").alias("reached")), "reached", "left_semi").select("node", F.lit(True).alias("contains")).distinct()
    return n.select("node").join(hit, "node", "left").withColumn("contains", F.coalesce("contains", F.lit(False)))


@query("""SELECT user_id AS query_id, event_type AS stream, place, CAST(row_number() OVER (PARTITION BY user_id ORDER BY place, event_type) - 1 AS INTEGER) AS rank
  FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS INTEGER) AS place FROM events)""")
def interleave_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id"))
    return ranking.interleaved(ad.table(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), F.col("event_type").alias("stream"), place.alias("place")))


@query("""WITH c AS (SELECT user_id AS query_id, event_type AS action, count(*) AS n, max(value) > 150 AS solves, count(*) > 1 AS progresses FROM events GROUP BY ALL),
  k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, action) - 1 AS rank FROM c),
  w AS (SELECT *, coalesce(sum(solves::INT) OVER b, 0) AS s, coalesce(sum(progresses::INT) OVER b, 0) AS p FROM k WINDOW b AS (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  t AS (SELECT *, max(solves::INT) OVER (PARTITION BY query_id) AS found FROM w WHERE s < 2 AND p < 10000)
  SELECT query_id, action, CAST(rank AS INTEGER) AS rank, solves, progresses, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INTEGER) AS suggestion FROM t WHERE (found = 1 AND solves) OR (found = 0 AND progresses AND p < 2)""")
def suggest_filter_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ad.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("query_id"), F.col("event_type").alias("action")).agg(F.count(F.lit(1)).alias("score"), (F.max("value") > 150).alias("solves"), (F.count(F.lit(1)) > 1).alias("progresses"))
    return ranking.suggested(ranking.ranked(c), p=2).select("query_id", "action", "rank", "solves", "progresses", "suggestion")


@query(f"""WITH {EVT}, a AS (SELECT entry_id AS query_id, action, 0 AS b, 0 AS r FROM ev), z AS (SELECT entry_id, 'idtac', 1, 0 FROM ev WHERE status = 'Substituted')
  SELECT query_id, action, b AS block, CAST(row_number() OVER (PARTITION BY query_id ORDER BY b, r) - 1 AS INTEGER) AS rank FROM (SELECT * FROM a UNION ALL SELECT * FROM z)""")
def rank_concat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ad.event_instances(spark, sf_dir)
    first = e.select(F.col("entry_id").alias("query_id"), "action", F.lit(0).alias("rank"), F.lit(0.0).alias("confidence"))
    second = e.where("status = 'Substituted'").select(F.col("entry_id").alias("query_id"), F.lit("idtac").alias("action"), F.lit(0).alias("rank"), F.lit(0.0).alias("confidence"))
    return ranking.concatenated(first, second).select("query_id", "action", "block", "rank")


@query("""SELECT b.conv_id AS state_id, b.text AS state, coalesce(array_to_string(list(a.text ORDER BY a.turn, a.text) FILTER (a.conv_id IS NOT NULL), '|'), '') AS after
  FROM conversations b LEFT JOIN conversations a ON a.conv_id = b.conv_id AND a.turn > 0 WHERE b.turn = 0 GROUP BY b.conv_id, b.text""")
def record_pair_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ad.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("state_id"), F.col("turn").alias("ord"), F.col("text").alias("state"))
    return lineage.paired(c.where("ord = 0").drop("ord"), c.where("ord > 0")).withColumn("after", F.array_join("after", "|"))


SAID = "CASE doc_id % 7 WHEN 0 THEN 'admit' WHEN 1 THEN 'Fix x' WHEN 2 THEN 'synth with cache ' || source WHEN 3 THEN NULL WHEN 4 THEN 'shelve' WHEN 5 THEN 'synthetic' ELSE 'apply ' || source END"


@query(f"SELECT doc_id, printed FROM (SELECT doc_id, {SAID} AS printed, doc_id % 11 = 0 AS ignored FROM documents) WHERE NOT ignored AND (printed IS NULL OR NOT (lower(printed) IN ('admit', 'synth') OR regexp_matches(lower(printed), '^(synth with cache|fix|cofix|change_no_check|exact_no_check|native_cast_no_check|vm_cast_no_check|shelve)')))")
def record_filter_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ad.table(spark, sf_dir, "documents").select("doc_id", F.expr(SAID).alias("printed"), (F.col("doc_id") % 11 == 0).alias("ignored"))
    return lineage.recorded(rows, ignored="ignored").select("doc_id", "printed")


@query("SELECT o_orderkey AS row_id, o_custkey AS lemma, s.status FROM orders, (SELECT unnest(['Original', 'QedTime']) AS status) s WHERE s.status = 'Original' OR o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def reemit_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ad.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("lemma"))
    ended = ad.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("lemma"), F.when(F.col("c_acctbal") < 0, "Abort").otherwise("Qed").alias("ending"))
    return lineage.reemitted(rows, ended)


@query("""SELECT p_partkey AS row_id, coalesce(CASE WHEN p_size % 2 = 0 THEN 'New' || p_brand END, p_brand) AS const, CASE WHEN p_size % 2 = 0 THEN 'Substituted' ELSE 'Original' END AS status,
  CASE WHEN p_size % 2 = 0 THEN 'Lib.' || p_name END AS from_path, CASE WHEN p_size % 2 = 0 THEN 'Mod.' ELSE 'Lib.' END || p_name AS path FROM part WHERE p_name NOT LIKE '%.%'""")
def substitute_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ad.table(spark, sf_dir, "part").where(~F.col("p_name").contains("."))
    rows = p.select(F.col("p_partkey").alias("row_id"), F.concat_ws("|", F.col("p_brand"), (F.col("p_size") % 2).cast("string")).alias("const"), F.lit("Original").alias("status"), F.concat(F.lit("Lib."), "p_name").alias("path"))
    renames = rows.where(F.col("const").endswith("|0")).select(F.col("const").alias("old"), F.concat(F.lit("New"), "const").alias("new")).distinct()
    out = lineage.substituted(rows, renames, "const", "path", "Mod")
    return out.select("row_id", F.regexp_replace("const", r"\|[01]$", "").alias("const"), "status", "from_path", "path")


@query("""SELECT l_orderkey AS row_id, l_linenumber AS line, 'S' || l_suppkey || CASE WHEN l_linenumber % 2 = 0 THEN '_obligation_' || l_linenumber ELSE '' END AS name, 'Discharged' AS status,
  array_to_string(list_filter(['h0', 'h1', 'h2', 'h3'], lambda h: h = 'h' || (s_nationkey % 4)), ',') AS hyps FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal > 0""")
def discharge_ctx(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ad.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row_id"), F.col("l_linenumber").alias("line"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("_obligation_"), F.col("l_linenumber").cast("string"))).otherwise("")).alias("name"), F.lit("p").alias("path"), F.lit("Original").alias("status"), F.array(*map(F.lit, ("h0", "h1", "h2", "h3"))).alias("hyps"))
    sections = ad.table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("name"), F.array(F.concat(F.lit("h"), (F.col("s_nationkey") % 4).cast("string"))).alias("kept"))
    return lineage.discharged(rows, sections).select("row_id", "line", "name", "status", F.array_join("hyps", ",").alias("hyps"))


@query("""WITH l AS (SELECT DISTINCT l_orderkey, 'let x' || l_linenumber || ' := ' || l_returnflag || ' in ' AS b, 'x' || l_linenumber AS n FROM lineitem WHERE l_tax > 0.04)
  SELECT o_orderkey AS step, coalesce(string_agg(b, '' ORDER BY n, b), '') || o_orderpriority AS printed FROM orders LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderpriority""")
def rebuild_lets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ad.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("step"), F.col("o_orderpriority").alias("printed"))
    local = ad.table(spark, sf_dir, "lineitem").where("l_tax > 0.04").select(F.col("l_orderkey").alias("step"), F.concat(F.lit("x"), F.col("l_linenumber").cast("string")).alias("name"), F.col("l_returnflag").alias("body")).distinct()
    return lineage.rebuilt(rows, local)


@query("""SELECT l_orderkey AS step, l_linenumber AS line, 'c' || l_suppkey AS const, CASE WHEN l_linestatus = 'O' AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 15) THEN 'Var' ELSE 'Const' END AS kind
  FROM lineitem""")
def inline_side_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = ad.table(spark, sf_dir, "lineitem").select(F.concat_ws(":", "l_orderkey", "l_linestatus").alias("step"), F.col("l_orderkey").alias("order"), F.col("l_linenumber").alias("line"), F.concat(F.lit("c"), F.col("l_suppkey").cast("string")).alias("const"), F.lit("T").alias("type"), (F.col("l_linestatus") == "O").alias("opaque"))
    known = ad.table(spark, sf_dir, "supplier").where("s_nationkey < 15").select(F.concat(F.lit("c"), F.col("s_suppkey").cast("string")).alias("const"))
    hyps = lines.select("step", F.lit("H").alias("hyp"), "type").limit(0)
    return lineage.inlined(lines, known, hyps)[0].select(F.col("order").alias("step"), "line", "const", "kind")


CLASSES = {"view": "Then", "click": "Try", "purchase": "Atom", "signup": "Id", "error": "Solve"}
CLASS_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CLASSES.items()) + " ELSE 'First' END"


@query(f"""WITH n AS (SELECT event_id AS node_id, {CLASS_SQL} AS kind FROM events), m AS (SELECT *, CASE kind WHEN 'Then' THEN 'Decompose' WHEN 'Solve' THEN 'Both' ELSE 'Keep' END AS mode FROM n)
  SELECT node_id, kind, mode, kind NOT IN ('Id', 'Fail', 'Try', 'Time', 'ShowHyps', 'Info', 'Fun') AND mode IN ('Keep', 'Both') AS outer_, (mode IN ('Decompose', 'Both') OR kind IN ('Try', 'Time', 'ShowHyps', 'Info', 'Fun')) AND kind NOT IN ('Id', 'Fail') AS descend FROM m""")
def decompose_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = ad.table(spark, sf_dir, "events").select(F.col("event_id").alias("node_id"), F.expr(CLASS_SQL).alias("kind"))
    modes = actions.policy(spark, ["Then", "Try", "Atom", "Id", "Solve"], {"Solve": "Both"})
    return actions.annotated(nodes, modes).withColumnRenamed("outer", "outer_")


@query("""SELECT o_orderkey AS step, i AS "at", CASE WHEN a = 'generalize' THEN args[len(args) - i] ELSE args[i + 1] END AS arg, a || ' ' || CASE WHEN a = 'generalize' THEN args[len(args) - i] ELSE args[i + 1] END AS said FROM (
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'generalize' ELSE 'apply' END AS a, list(l_partkey::VARCHAR ORDER BY l_linenumber, l_partkey) AS args FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL), range(200) r(i) WHERE i < len(args)""")
def split_compound_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = ad.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("step")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"].cast("string")).alias("args"))
    atoms = lines.join(ad.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("step"), F.when(F.col("o_orderstatus") == "F", "generalize").otherwise("apply").alias("action")), "step").withColumn("multiplicity", F.lit(None).cast("string"))
    return actions.split_compound(atoms).select("step", F.col("at").cast("long").alias("at"), "arg", "said")


#: The pair of order and line number is no key of lineitem, so lines are numbered within their order by all that tells them apart.
LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_tax", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate")
LINES = f"""
  li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE_ORDER)}) AS node FROM lineitem)"""
ARGS = LINES + """,
  args AS (SELECT l_orderkey AS tree_id, node AS ord, x.place, x.arg, x.sort FROM li,
    LATERAL (SELECT unnest([1, 2, 3]) AS place, unnest(['S' || l_suppkey, l_returnflag, 'B' || l_partkey]) AS arg, unnest(['section', 'local', CASE WHEN l_linestatus = 'O' THEN 'global' ELSE 'other' END]) AS sort) x WHERE l_tax > 0.02 OR x.place > 1),
  one AS (SELECT tree_id, ord, arg_min(arg, (CASE sort WHEN 'global' THEN 0 WHEN 'section' THEN 1 WHEN 'local' THEN 2 ELSE 3 END) * 10 + place) AS arg, count(*) = 1 AS exact FROM args GROUP BY ALL)"""


def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with node: the number of each line in its order, from 1."""
    return ad.table(spark, sf_dir, "lineitem").withColumn("node", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)).cast("long"))


def arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tree_id, ord, place, arg, sort): the names that lines of an order, taken as an action, are given."""
    s = lambda p, a, k: F.struct(F.lit(p).alias("place"), a.alias("arg"), k.alias("sort"))
    each = F.array(s(1, F.concat(F.lit("S"), F.col("l_suppkey").cast("string")), F.lit("section")), s(2, F.col("l_returnflag"), F.lit("local")), s(3, F.concat(F.lit("B"), F.col("l_partkey").cast("string")), F.when(F.col("l_linestatus") == "O", "global").otherwise("other")))
    return numbered_lines(spark, sf_dir).select(F.col("l_orderkey").alias("tree_id"), F.col("node").alias("ord"), "l_tax", F.explode(each).alias("x")).where("l_tax > 0.02 or x.place > 1").select("tree_id", "ord", "x.*")


@query(f"WITH {ARGS} SELECT tree_id, ord, arg, exact FROM one")
def one_variable_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actions.one_variable(arguments(spark, sf_dir))


@query(f"WITH {ARGS} SELECT tree_id, string_agg('?', ' ' ORDER BY ord) AS template, string_agg(arg, ' ' ORDER BY ord) AS filled FROM one GROUP BY tree_id")
def strip_substitute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actions.filled(actions.stripped(actions.one_variable(arguments(spark, sf_dir)))).select("tree_id", "template", "filled")


@query(f"WITH {ARGS} SELECT tree_id, string_agg(arg, ' ' ORDER BY ord) AS text FROM one WHERE tree_id % 97 = 0 GROUP BY tree_id")
def round_trip_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All trees go through a printer that loses the last argument of some of them; just these are found."""
    lossy = lambda x: x.withColumn("args", F.when(F.col("tree_id") % 97 == 0, F.slice("args", 1, F.size("args") - 1)).otherwise(F.col("args")))
    return actions.round_trip_failures(arguments(spark, sf_dir), lossy).select("tree_id", "text")


@query(f"""WITH {ARGS}, ctx AS (SELECT DISTINCT l_orderkey AS tree_id, 'S' || l_suppkey AS arg FROM li WHERE l_linestatus = 'O'),
  h AS (SELECT tree_id, string_agg(CASE WHEN ctx.arg IS NULL THEN '_hole' ELSE one.arg END, ' ' ORDER BY ord) AS text FROM one LEFT JOIN ctx USING (tree_id, arg) GROUP BY tree_id)
  SELECT tree_id, text, CAST('0x' || substr(md5(text), 1, 8) AS BIGINT) AS hash FROM h""")
def subst_hash_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the substituting neighbours file an action under: only the suppliers of an order's open lines are in its context."""
    context = ad.table(spark, sf_dir, "lineitem").where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("tree_id"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("name"))
    return actions.substituted_hash(actions.one_variable(arguments(spark, sf_dir)).select("tree_id", "ord", "arg"), context)


VARS = LINES + """,
  v AS (SELECT l_orderkey AS tree_id, node AS node_id, 'v' || (l_partkey % 5) AS name FROM li),
  b AS (SELECT o_orderkey AS tree_id, 'v' || (o_custkey % 5) AS name, 2 AS first, 4 AS last FROM orders),
  f AS (SELECT * FROM v WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.tree_id = v.tree_id AND b.name = v.name AND v.node_id BETWEEN b.first AND b.last))"""


def variables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = numbered_lines(spark, sf_dir).select(F.col("l_orderkey").alias("tree_id"), F.col("node").alias("node_id"), F.concat(F.lit("v"), (F.col("l_partkey") % 5).cast("string")).alias("name"))
    b = ad.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tree_id"), F.concat(F.lit("v"), (F.col("o_custkey") % 5).cast("string")).alias("name"), F.lit(2).alias("first"), F.lit(4).alias("last"))
    return v, b


@query(f"WITH {VARS} SELECT tree_id, node_id, name FROM f")
def free_vars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actions.free_variables(*variables(spark, sf_dir))


@query(f"WITH {VARS} SELECT v.tree_id, v.node_id, CASE WHEN f.name = 'v1' THEN 'w1' ELSE v.name END AS name FROM v LEFT JOIN f USING (tree_id, node_id)")
def rename_free_vars(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, b = variables(spark, sf_dir)
    return actions.renamed(v, b, spark.createDataFrame([("v1", "w1")], "old string, new string")).select("tree_id", "node_id", "name")


@query(f"WITH {VARS} SELECT tree_id, node_id, name, 't' || (row_number() OVER (PARTITION BY tree_id ORDER BY node_id) - 1) AS abstract FROM f")
def abstract_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actions.abstracted(actions.free_variables(*variables(spark, sf_dir)))


@query(f"""WITH {VARS}, h AS (SELECT tree_id, min(name) AS first_name, list(DISTINCT name) AS names FROM b GROUP BY tree_id)
  SELECT f.tree_id, f.node_id, CASE WHEN list_contains(names, f.name) THEN f.name ELSE coalesce(first_name, '_') END AS name FROM f LEFT JOIN h USING (tree_id)""")
def rename_by_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, b = variables(spark, sf_dir)
    return actions.by_context(actions.free_variables(v, b), b.select("tree_id", F.lit(0).alias("ord"), F.col("name").alias("hyp"))).select("tree_id", "node_id", "name")


@query(f"WITH {VARS} SELECT tree_id, node_id, name, CASE WHEN name IN ('v0', 'v3') THEN 'Call' ELSE 'Var' END AS kind FROM v")
def cook_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, _ = variables(spark, sf_dir)
    return actions.cooked(v, spark.createDataFrame([("v0",), ("v3",)], "name string")).select("tree_id", "node_id", "name", "kind")


@query("SELECT DISTINCT l_orderkey AS tree_id, 'S' || l_suppkey AS symbol FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal < 0")
def opaque_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = ad.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("tree_id"), F.lit("Const").alias("kind"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"))
    constants = ad.table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol"), (F.col("s_acctbal") < 0).alias("opaque"))
    return actions.opaque_constants(nodes, constants)


@query(f"""WITH {LINES}, n AS (SELECT l_orderkey AS tree_id, node AS node_id, CASE l_returnflag WHEN 'A' THEN 'Var:X' WHEN 'N' THEN 'Const:C' ELSE 'Term:_' END AS s FROM li),
  t AS (SELECT tree_id, string_agg(s, ' ' ORDER BY node_id) AS text FROM n GROUP BY tree_id)
  SELECT tree_id, text, CAST('0x' || substr(md5(text), 1, 8) AS BIGINT) AS hash FROM t""")
def skeleton_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    nodes = numbered_lines(spark, sf_dir).select(F.col("l_orderkey").alias("tree_id"), F.col("node").alias("node_id"), F.when(flag == "A", "Var").when(flag == "N", "Const").otherwise("Term").alias("kind"), flag.alias("symbol"))
    return actions.preorder(actions.skeleton(nodes)).withColumn("hash", action_hash(F.col("text")))


@query("SELECT s_suppkey AS goal, CASE WHEN s_acctbal > 0 THEN 'auto' END AS witness, s_acctbal <= 0 AS must_search FROM supplier")
def cached_witness(spark: SparkSession, sf_dir: str) -> DataFrame:
    goals = ad.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("goal"))
    cache = ad.table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("goal"), F.lit("auto").alias("witness"))
    hit, miss = search.cached(goals, cache)
    return hit.withColumn("must_search", F.lit(False)).unionByName(miss.withColumn("witness", F.lit(None).cast("string")).withColumn("must_search", F.lit(True)))


@query(f"WITH {EVT} SELECT action, count(*) AS instances, round(avg(value), 6) AS mean_value FROM ev WHERE status = 'Original' GROUP BY action")
def replay_learned_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ad.event_instances(spark, sf_dir).withColumns({"canonical": F.lit("Original"), "name": F.col("status")})
    return lineage.replayed(rows).groupBy("action").agg(F.count(F.lit(1)).alias("instances"), rounded(F.avg("value")).alias("mean_value"))


@query("SELECT o_orderkey AS step, l_linenumber AS outcome FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def learn_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = ad.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("step")).agg(F.collect_list("l_linenumber").alias("outcomes"))
    return model.per_outcome(steps)
