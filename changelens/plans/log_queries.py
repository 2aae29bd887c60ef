"""Append-only logs, gates, collection and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.functions.text import law_tier
from changelens.operators import brackets, collect, events, gate
from changelens.plans.catalogue import case, query, table, values

_DECISION = "CASE event_type WHEN 'purchase' THEN 'verified' WHEN 'click' THEN 'rejected' WHEN 'error' THEN 'stale' ELSE 'revoked' END"
_REASON = "CASE WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN 'golden_test_confirmed' WHEN event_type = 'purchase' AND event_id % 3 = 1 THEN 'matched_historical_change' WHEN event_type = 'click' THEN 'wrong_module' ELSE 'other' END"


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "user_id AS mapping_id", f"{_DECISION} AS decision", f"{_REASON} AS reason_code", "CASE WHEN event_id % 10 = 0 THEN 'legacy verified flag' END AS reason_text",
        "CASE WHEN event_id % 5 = 0 THEN 'legacy-backfill' ELSE 'owner' END AS actor", "CASE WHEN event_id % 7 = 0 THEN NULL ELSE ts END AS created_at", "event_id AS seq",
    )


_LOG = f"""WITH d AS (SELECT user_id AS mapping_id, {_DECISION} AS decision, {_REASON} AS reason_code, event_id % 10 = 0 AS legacy_text, event_id % 5 = 0 AS legacy_actor,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE ts END AS created_at, event_id AS seq FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY mapping_id ORDER BY created_at DESC NULLS LAST, seq DESC) AS n FROM d)"""


@query(_LOG + " SELECT mapping_id, decision AS state, reason_code AS last_reason FROM o WHERE n = 1")
def decision_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last decision of every mapping; a missing time is the oldest."""
    return events.state(decisions(spark, sf_dir)).select("mapping_id", "state", "last_reason")


@query(
    _LOG + """ SELECT mapping_id, max(decision) FILTER (n = 1) AS state, max(reason_code) FILTER (n = 1) AS reason_code, count(*) FILTER (decision = 'rejected') AS rejection_count,
  bool_or(decision = 'verified' AND reason_code = 'golden_test_confirmed') AS golden_confirmed, bool_or(decision = 'verified' AND reason_code = 'matched_historical_change') AS historical_match,
  bool_or(decision = 'verified' AND legacy_text AND legacy_actor) AS legacy FROM o GROUP BY mapping_id"""
)
def decision_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mapping's log folded to one context."""
    return events.contexts(decisions(spark, sf_dir))


@query("""WITH o AS (SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS sequence_no FROM events)
SELECT user_id AS run_id, event_id, sequence_no FROM o""")
def event_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events numbered within their run."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), "event_id", "ts")
    return events.number_events(e, "run_id", "ts", "event_id").select("run_id", "event_id", "sequence_no")


@query("""SELECT c.conv_id AS run_id, CAST(coalesce(max(e.turn), -1) + 2 AS BIGINT) AS next_no FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN conversations e ON e.conv_id = c.conv_id GROUP BY 1""")
def next_event_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next number of each run, from its highest."""
    c = table(spark, sf_dir, "conversations")
    e = c.select(F.col("conv_id").alias("run_id"), (F.col("turn") + 1).alias("sequence_no"))
    return events.next_numbers(e, c.select(F.col("conv_id").alias("run_id")))


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role) AS n FROM conversations)
SELECT conv_id, turn AS last_turn, role AS last_role, count(*) OVER () AS runs FROM o WHERE n = 1""")
def latest_run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of every run, and how many runs there are."""
    c = table(spark, sf_dir, "conversations")
    last = c.groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.min_by("role", F.struct((-F.col("turn")).alias("t"), "role")).alias("last_role"))
    runs = c.select("conv_id").distinct().agg(F.count("*").alias("runs"))
    return last.join(F.broadcast(runs))  # one row


@case("""SELECT * FROM (VALUES ('file_missing', CAST(1 AS BIGINT)), ('symbol_missing', 2), ('modified_but_valid', 3), (NULL, 4), (NULL, 5)) AS t(reason, id)""")
def stale_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = values(spark, "(CAST(1 AS BIGINT),false,true,'a','a'),(2,true,false,'a','b'),(3,true,true,'a','b'),(4,true,true,'a','a'),(5,true,true,NULL,'a')", "id,f,s,x,y")
    return v.select(events.stale_reason(F.col("f"), F.col("s"), F.col("x"), F.col("y")).alias("reason"), "id")


@query("""SELECT c_custkey AS mapping_id, CASE WHEN o.k IS NULL THEN 'legacy-backfill' ELSE 'owner' END AS actor, coalesce(o.n, 1) AS decisions
FROM customer LEFT JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) o ON o.k = c_custkey WHERE o.k IS NOT NULL OR c_acctbal > 5000""")
def legacy_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verified mappings without a decision get one."""
    d = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("mapping_id"), F.lit("verified").alias("decision"), F.lit("other").alias("reason_code"), F.lit(None).cast("string").alias("reason_text"), F.lit("owner").alias("actor"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"), F.col("o_orderkey").alias("seq"),
    )
    m = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("mapping_id"), (F.col("c_acctbal") > 5000).alias("verified"))
    return events.backfill(m, d).groupBy("mapping_id", "actor").agg(F.count("*").alias("decisions"))


@query("""WITH a AS (SELECT o_custkey AS p, CASE WHEN o_orderstatus = 'F' THEN 'approve' WHEN o_orderstatus = 'O' THEN 'reject' ELSE 'view' END AS action, o_orderdate AS t, o_orderkey AS s FROM orders),
f AS (SELECT p, arg_min(action, (t, s)) AS first, count(*) - 1 AS later FROM a WHERE action <> 'view' GROUP BY p)
SELECT c_custkey AS proposal_id, CASE WHEN c_nationkey % 5 = 0 THEN 'approved' WHEN first = 'approve' THEN 'approved' WHEN first = 'reject' THEN 'rejected' ELSE 'draft' END AS status,
  CAST(coalesce(later, 0) + CASE WHEN c_nationkey % 5 = 0 AND first IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) AS refused FROM customer LEFT JOIN f ON p = c_custkey""")
def proposal_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts move once; whatever comes later is refused."""
    p = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("proposal_id"), F.when(F.col("c_nationkey") % 5 == 0, "approved").otherwise("draft").alias("status"))
    a = table(spark, sf_dir, "orders").selectExpr("o_custkey AS proposal_id", "CASE WHEN o_orderstatus = 'F' THEN 'approve' WHEN o_orderstatus = 'O' THEN 'reject' ELSE 'view' END AS action", "o_orderdate AS acted_at", "o_orderkey AS seq")
    return events.transitions(p, a)


# --------------------------------------------------------------------------- gates
_CHANGE = """o_orderkey AS change_id, CASE o_orderkey % 6 WHEN 0 THEN 'value_change' WHEN 1 THEN 'rate_change' WHEN 2 THEN 'date_change' WHEN 3 THEN 'structural_change' WHEN 4 THEN 'no_code_impact' ELSE 'condition_change' END AS change_type,
  CASE WHEN o_orderkey % 5 = 0 THEN 0.7 ELSE 0.95 END AS confidence, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'abc' END AS repository_commit, o_orderkey % 13 = 0 AS source_conflict"""
_CAND = """l_orderkey AS change_id, l_linenumber * CAST(1000000000 AS BIGINT) + l_partkey * 1000 + l_suppkey % 1000 AS rank, CASE WHEN l_partkey % 50 = 0 THEN 'gone' ELSE concat('part/', CAST(l_suppkey AS VARCHAR)) END AS path,
  CASE l_partkey % 4 WHEN 0 THEN ['rag','code_graph'] WHEN 1 THEN ['rag','constant_match'] WHEN 2 THEN ['verified_mapping'] ELSE ['rag'] END AS sources,
  CASE WHEN l_discount > 0.02 THEN 0.9 ELSE 0.5 END AS strongest, l_linestatus = 'F' AS stale"""


@query(f"""WITH ch AS (SELECT {_CHANGE} FROM orders), ca AS (SELECT {_CAND} FROM lineitem),
g AS (SELECT change_id, arg_min(sources, rank) AS s, arg_min(strongest, rank) AS best, arg_min(stale, rank) AS st, bool_and(stale) AS all_stale, bool_or(path = 'gone') AS missing FROM ca GROUP BY 1),
x AS (SELECT ch.*, g.* EXCLUDE (change_id), list_filter([
  CASE WHEN change_type NOT IN ('value_change','rate_change','date_change') THEN 'change_type_not_draftable' END,
  CASE WHEN confidence < 0.8 THEN 'classification_confidence_low' END,
  CASE WHEN s IS NULL THEN 'retrieval_candidate_missing' END,
  CASE WHEN best < 0.8 THEN 'retrieval_score_low' END,
  CASE WHEN len(list_filter(s, lambda v: v <> 'code_graph')) < 2 AND NOT (list_contains(s, 'verified_mapping') AND NOT st) THEN 'retrieval_evidence_insufficient' END,
  CASE WHEN all_stale THEN 'stale_only_evidence' END,
  CASE WHEN missing THEN 'candidate_file_missing' END,
  CASE WHEN repository_commit = '' THEN 'repository_commit_missing' END,
  CASE WHEN source_conflict THEN 'source_conflict' END], lambda v: v IS NOT NULL) AS r FROM ch LEFT JOIN g USING (change_id))
SELECT change_id, CASE WHEN len(r) = 0 THEN 'draft_allowed' WHEN change_type IN ('structural_change','no_code_impact') THEN 'analysis_only' ELSE 'manual_review_required' END AS decision,
  array_to_string(r, ',') AS reasons FROM x""")
def policy_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What may be drafted, and every reason against it."""
    ch = table(spark, sf_dir, "orders").selectExpr(*_split(_CHANGE))
    ca = table(spark, sf_dir, "lineitem").selectExpr(*_split(_CAND.replace("VARCHAR", "STRING").replace("['", "array('").replace("']", "')")))
    files = table(spark, sf_dir, "supplier").select(F.concat(F.lit("part/"), F.col("s_suppkey").cast("string")).alias("path"))
    return gate.decide(ch, ca, files)


def _split(text: str) -> list[str]:
    from changelens.plans.retrieval_queries import _split as split

    return [c.strip() for c in split(text)]


_ITEMS = "('L1','제55조','rate table','update the table',0),('L1','제5','short','later item',1),('L2','제189조','withholding','update it',2),('L3','','never','empty pattern',3)"
_ROUTED = "(CAST(1 AS BIGINT),'L1','제55조의2제1항'),(2,'L1','제5조'),(3,'L2','제55조'),(4,'L2','제189조'),(5,'L1',''),(6,'L9','제55조'),(7,'L3','제1조')"


@case("""SELECT * FROM (VALUES (CAST(1 AS BIGINT),'db_update_guidance','x','rate table'),(2,'db_update_guidance','x','short'),(3,'draft_allowed','x',NULL),(4,'db_update_guidance','x','withholding'),
(5,'draft_allowed','x',NULL),(6,'draft_allowed','x',NULL),(7,'draft_allowed','x',NULL)) AS t(change_id,decision,reasons,item_label)""")
def registry_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of registered articles are data updates, whatever the policy says."""
    ch = values(spark, _ROUTED, "change_id,law_id,article_no")
    items = values(spark, _ITEMS, "law_id,article_pattern,item_label,guidance,ord")
    d = ch.select("change_id", F.lit("draft_allowed").alias("decision"), F.lit("x").alias("reasons"))
    return gate.final_decision(d, gate.route(ch, items))


#: Upper limits, rates and deductions of the income tax from 2024 on.
_BRACKETS = """(14000000, 0.06, 0), (50000000, 0.15, 840000), (88000000, 0.24, 6240000), (150000000, 0.35, 15360000),
(300000000, 0.38, 19860000), (500000000, 0.40, 25860000), (1000000000, 0.42, 35860000), (CAST(NULL AS BIGINT), 0.45, 65860000)"""


def _taxed(spark: SparkSession, rows: DataFrame) -> DataFrame:
    b = values(spark, _BRACKETS, "upper,rate,deduction")
    return brackets.first_bracket(rows, F.col("base"), b, "rate", "deduction").withColumn("tax", (F.col("base") * F.col("rate") - F.col("deduction")).cast("long"))


@query(f"""WITH b AS (SELECT *, coalesce(lag(upper) OVER (ORDER BY upper NULLS LAST), -1) AS over FROM (VALUES {_BRACKETS}) AS t(upper, rate, deduction)),
o AS (SELECT o_orderkey, CAST(round(o_totalprice * 3000 / 100) * 100 AS BIGINT) AS base FROM orders)
SELECT o_orderkey, base, CAST(base * rate - deduction AS BIGINT) AS tax FROM o JOIN b ON base > over AND (upper IS NULL OR base <= upper)""")
def bracket_tax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first bracket that reaches the base of each order."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.round(F.col("o_totalprice") * 3000 / 100) * 100).cast("long").alias("base"))
    return _taxed(spark, o).select("o_orderkey", "base", "tax")


@case("SELECT * FROM (VALUES (CAST(10000000 AS BIGINT),CAST(600000 AS BIGINT)),(30000000,3660000),(60000000,8160000),(100000000,19640000),(14000000,840000)) AS t(base,tax)")
def bracket_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Taxes that are known."""
    return _taxed(spark, values(spark, "(CAST(10000000 AS BIGINT)),(30000000),(60000000),(100000000),(14000000)", "base")).select("base", "tax")


# --------------------------------------------------------------------------- collection and listings
_FEED = "concat('L', CAST(o_custkey AS VARCHAR)) AS law_id, c_mktsegment AS law_name, strftime(o_orderdate, '%Y%m%d') AS promulgation_date, strftime(o_orderdate, '%Y%m%d') AS effective_date, 'law' AS source, CASE WHEN o_custkey % 2 = 0 THEN 'tax' ELSE 'hr' END AS domain, o_orderkey AS ord"


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.concat(F.lit("L"), F.col("o_custkey").cast("string")).alias("law_id"), F.col("c_mktsegment").alias("law_name"), F.date_format("o_orderdate", "yyyyMMdd").alias("promulgation_date"),
        F.date_format("o_orderdate", "yyyyMMdd").alias("effective_date"), F.lit("law").alias("source"), F.when(F.col("o_custkey") % 2 == 0, "tax").otherwise("hr").alias("domain"), F.col("o_orderkey").alias("ord"),
    )


@query(f"""WITH f AS (SELECT {_FEED} FROM orders JOIN customer ON o_custkey = c_custkey),
k AS (SELECT * FROM f WHERE promulgation_date >= '19960101' AND law_name IN ('BUILDING','MACHINERY')),
o AS (SELECT *, row_number() OVER (PARTITION BY law_id ORDER BY ord) AS n FROM k)
SELECT law_id, promulgation_date, domain, ord FROM o WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM f s WHERE s.law_id = o.law_id AND s.promulgation_date = o.promulgation_date AND s.ord % 3 = 0)""")
def collect_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Since the mark, on the list, first of each law, not stored yet."""
    f = feed(spark, sf_dir)
    new = collect.changed_since(f, "19960101", values(spark, "('BUILDING'),('MACHINERY')", "name"))
    return collect.only_new(new, f.where("ord % 3 = 0"), ["law_id", "promulgation_date"]).select("law_id", "promulgation_date", "domain", "ord")


@query(f"""WITH f AS (SELECT {_FEED} FROM orders JOIN customer ON o_custkey = c_custkey), o AS (SELECT *, row_number() OVER (PARTITION BY law_id, effective_date ORDER BY ord) AS n FROM f
WHERE effective_date >= '19970601' AND law_name = 'BUILDING') SELECT law_id, effective_date, ord FROM o WHERE n = 1""")
def effective_upcoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collect.effective_from(feed(spark, sf_dir), "19970601", values(spark, "('BUILDING')", "name")).select("law_id", "effective_date", "ord")


@query(f"""WITH f AS (SELECT {_FEED} FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT 'domain' AS dimension, domain AS name, count(*) AS n FROM f GROUP BY ALL UNION ALL SELECT 'tier', '법률', count(*) FROM f""")
def collect_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collect.counts(feed(spark, sf_dir))


@query("""WITH r AS (SELECT p_partkey AS id, p_name, p_size, p_partkey AS ord FROM part),
m AS (SELECT id, ord, CASE WHEN contains(p_name, 'a') THEN 1 WHEN contains(p_name, 'e') THEN 2 END AS q FROM r WHERE p_size >= 10)
SELECT CAST(id AS VARCHAR) AS rule_id, CAST(q AS BIGINT) AS query_ord FROM m WHERE q IS NOT NULL""")
def admin_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules by the first query that their name holds."""
    r = table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("rule_id"), F.col("p_name").alias("rule_name"), F.lpad(F.col("p_size").cast("string"), 2, "0").alias("issued"), F.lit("고시").alias("kind"), F.col("p_partkey").alias("ord")
    )
    q = values(spark, "('a',1),('e',2)", "query,query_ord")
    return collect.admin_rules(r, q, "10").select("rule_id", F.col("query_ord").cast("long").alias("query_ord"))


@case("SELECT * FROM (VALUES ('제55조','L 제1조의2,L 제2조',''),('제56조의3','','R 제9조')) AS t(law_article,decree,rule)")
def three_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = values(spark, "('0055','00','decree','L','0001','02',1),('0055','00','decree','L','0002',NULL,2),('0055','00','decree','L','0001','02',3),('0056','03','rule','R','0009','',4)", "article_no,article_branch,tier,law_name,no,branch,ord")
    t = collect.three_tier(v)
    return t.select("law_article", F.array_join("decree", ",").alias("decree"), F.array_join("rule", ",").alias("rule"))


@case("SELECT * FROM (VALUES ('소득세법','law','법률'),('소득세법 시행령','law','시행령'),('소득세법 시행규칙','law','시행규칙'),('최저임금 고시','고시','고시'),('법인세법 시행령','','시행령')) AS t(law_name,source,tier)")
def law_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = values(spark, "('소득세법','law'),('소득세법 시행령','law'),('소득세법 시행규칙','law'),('최저임금 고시','고시'),('법인세법 시행령','')", "law_name,source")
    return v.select("law_name", "source", law_tier(F.col("law_name"), F.col("source")).alias("tier"))


@case("SELECT * FROM (VALUES ('소득세법'),('소득세법 시행령'),('소득세법 시행규칙'),('법인세법'),('법인세법 시행령'),('법인세법 시행규칙')) AS t(name)")
def whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collect.whitelist(values(spark, "('소득세법'),('법인세법')", "name"))


@query("SELECT o_orderkey AS proposal_id, o_orderpriority AS status, c_name AS title FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def proposals_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals with their change, one join instead of a lookup a row; newest first."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey, "left").orderBy(F.desc("o_orderkey")).select(F.col("o_orderkey").alias("proposal_id"), F.col("o_orderpriority").alias("status"), F.col("c_name").alias("title"))


@query("SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey DESC LIMIT 200")
def list_changes(spark: SparkSession, sf_dir: str, limit: int = 500) -> DataFrame:
    """A report of the newest changes of a status; the limit is held between 1 and 200."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return o.orderBy(F.desc("o_orderkey")).limit(max(1, min(limit, 200))).select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))


@query("""WITH m AS (SELECT s_nationkey AS article_id, s_suppkey AS id, s_acctbal > 8000 AS verified, s_acctbal / 10000 AS confidence FROM supplier),
a AS (SELECT *, bool_or(verified) OVER (PARTITION BY article_id) AS has FROM m) SELECT article_id, id, verified FROM a WHERE CASE WHEN has THEN verified ELSE confidence >= 0.3 END""")
def mapping_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "supplier").selectExpr("s_nationkey AS article_id", "s_suppkey AS id", "s_acctbal > 8000 AS verified", "s_acctbal / 10000 AS confidence")
    return collect.select_mappings(m, 0.3).select("article_id", "id", "verified")


@query("""SELECT c_custkey AS id, c_mktsegment AS payload FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT o_custkey, 'new' FROM orders""")
def keyed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows replaced by key; running it again changes nothing."""
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("payload"))
    new = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.lit("new").alias("payload")).distinct()
    return collect.upsert(collect.upsert(old, new, ["id"]), new, ["id"])


@query("SELECT doc_id, source FROM documents WHERE source NOT IN ('src1','src2')")
def delete_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collect.delete_source(table(spark, sf_dir, "documents").select("doc_id", "source"), values(spark, "('src1'),('src2')", "source"))


@query("SELECT source, count(*) AS chunks FROM documents GROUP BY source")
def chunks_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("chunks"))


@query("""WITH done AS (SELECT o_custkey AS k, o_orderkey AS ord FROM orders) SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT k FROM done) OR c_custkey = (SELECT arg_max(k, ord) FROM done)""")
def resume_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left to do, and the last item again."""
    w = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return collect.pending(w, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("ord")), "k")


@query("SELECT event_type AS status, count(*) AS n, round(avg(value), 6) AS avg_latency, max(value) AS max_latency FROM events GROUP BY event_type")
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("avg_latency"), F.max("value").alias("max_latency"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows, as the stream counts them."""
    from changelens.streaming.collect_stream import windowed_counts

    return windowed_counts(table(spark, sf_dir, "events"))


@query("SELECT coalesce(max(strftime(o_orderdate, '%Y%m%d')), '19900101') AS last_sync FROM orders")
def high_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    from changelens.streaming.collect_stream import high_water as mark

    return mark(feed(spark, sf_dir), "19900101")
