"""Relational shapes of the engine run over the test tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.operators import asof, clones, graph
from quire.session import table

T = table


def policy_first_last(s, d):
    """First and last order of a customer, and whether any is urgent."""
    o = T(s, d, "orders")
    key = F.struct("o_orderdate", "o_orderkey")
    return o.groupBy("o_custkey").agg(F.min_by("o_orderkey", key).alias("first_order"), F.max_by("o_orderkey", key).alias("last_order"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("any_urgent"))


def label_first_place(s, d):
    """Where each label stands first; whether it is listed at several places."""
    p = T(s, d, "paper_label")
    return p.groupBy("label").agg(F.min(F.struct("rel", "line")).alias("at"), F.count_distinct("rel", "line").alias("n_places")).select("label", "at.rel", "at.line", "n_places")


def anti_exists(s, d):
    o = T(s, d, "orders").filter("o_orderstatus = 'P'").select("o_custkey")
    return T(s, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


def semi_double(s, d):
    """Suppliers that delivered a returned line and no large line at the greatest discount and a high tax."""
    li = T(s, d, "lineitem")
    back, cheap = li.filter("l_returnflag = 'R'").select("l_suppkey"), li.filter("l_discount >= 0.1 AND l_quantity >= 50 AND l_tax >= 0.06").select("l_suppkey")
    sup = T(s, d, "supplier")
    return sup.join(back, sup.s_suppkey == back.l_suppkey, "left_semi").join(cheap, F.col("s_suppkey") == cheap.l_suppkey, "left_anti").select("s_suppkey", "s_name")


def lookup_fallback(s, d):
    """A customer's supplier: of its own nation, else of its region, the least key first."""
    n = T(s, d, "nation").select("n_nationkey", "n_regionkey")
    sup = T(s, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    near = sup.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("near"))
    wide = sup.groupBy("n_regionkey").agg(F.min("s_suppkey").alias("wide"))
    c = T(s, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return c.join(near, F.col("c_nationkey") == F.col("s_nationkey"), "left").join(wide, "n_regionkey", "left").select("c_custkey", F.coalesce("near", "wide").alias("suppkey"), F.col("near").isNotNull().alias("is_near"))


def first_match_source(s, d):
    """The cheapest supplier of each part, ties by key."""
    li = T(s, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min("l_extendedprice").alias("price"))
    w = W.partitionBy("l_partkey").orderBy("price", "l_suppkey")
    return li.withColumn("n", F.row_number().over(w)).filter("n = 1").select("l_partkey", "l_suppkey", "price")


def case_join(s, d):
    """Open demands (orders not finished) with their customer's state, in their given order."""
    o = T(s, d, "orders").filter("o_orderstatus <> 'F'")
    c = T(s, d, "customer").select("c_custkey", "c_acctbal")
    state = F.when(F.col("c_custkey").isNull(), "unknown").when(F.col("c_acctbal") < 0, "owing").otherwise("fine")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", state.alias("state"), F.col("c_custkey").isNotNull().alias("is_known"))


def ledger_resolution(s, d):
    """Lines by what they resolve to: no part, part without supplier of its size class, both."""
    li = T(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    p, sup = T(s, d, "part").filter("p_size > 5").select("p_partkey"), T(s, d, "supplier").filter("s_acctbal > 0").select("s_suppkey")
    j = li.join(p, F.col("l_partkey") == F.col("p_partkey"), "left").join(sup, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    found = F.when(F.col("p_partkey").isNull(), "missing").when(F.col("s_suppkey").isNull(), "incomplete").otherwise("resolved")
    return j.groupBy(found.alias("resolution")).agg(F.count("*").alias("n"))


def full_outer_drift(s, d):
    """Labels of papers against labels of flags, both ways."""
    cited = T(s, d, "flag").select(F.explode("refs").alias("label")).distinct().withColumn("is_cited", F.lit(True))
    listed = T(s, d, "paper_label").select("label").distinct().withColumn("is_listed", F.lit(True))
    j = cited.join(listed, "label", "full")
    return j.select("label", F.when(F.col("is_cited").isNull(), "never cited").when(F.col("is_listed").isNull(), "not listed").otherwise("both").alias("side"))


def three_way_drift(s, d):
    """Direction of a change between three recorded texts of a file, by digest."""
    b = T(s, d, "block").filter("text IS NOT NULL").select("block_id", F.left(F.sha2("text", 256), F.lit(12)).alias("ours"), "text", "lang")
    b = b.withColumn("theirs", F.left(F.sha2(F.when(F.col("block_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256), F.lit(12)))
    b = b.withColumn("recorded", F.left(F.sha2(F.when(F.col("block_id") % 4 == 0, F.concat("text", F.lit("?"))).otherwise(F.col("text")), 256), F.lit(12)))
    side = (
        F.when(F.col("ours") == F.col("theirs"), "same").when(F.col("recorded") == F.col("ours"), "theirs changed")
        .when(F.col("recorded") == F.col("theirs"), "ours changed").otherwise("both changed")
    )
    return b.select("block_id", side.alias("direction"))


def set_rewrites(s, d):
    sup, c, n = T(s, d, "supplier"), T(s, d, "customer"), T(s, d, "nation")
    a, b = sup.select(F.col("s_nationkey").alias("k")), c.select(F.col("c_nationkey").alias("k"))
    parts = [("union", a.union(b).distinct()), ("both", a.intersect(b)), ("only_customers", b.subtract(a)), ("neither", n.select(F.col("n_nationkey").alias("k")).subtract(a.union(b)))]
    out = None
    for name, df in parts:
        df = df.select(F.lit(name).alias("what"), F.col("k").cast("int").alias("k"))
        out = df if out is None else out.unionByName(df)
    return out


def array_diff(s, d):
    """Labels that a flag cites and no earlier flag of its passage does, with distinct ones in order."""
    f = T(s, d, "flag").dropDuplicates(["flag_id"]).filter("refs IS NOT NULL")
    all_refs = f.groupBy("item_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("refs")))).alias("all_refs"))
    return f.join(all_refs, "item_id").select("flag_id", F.array_join(F.array_distinct("refs"), " ").alias("distinct_refs"), F.array_join(F.array_except("all_refs", "refs"), " ").alias("not_cited"), F.size("refs").alias("n_refs"))


def grouped_zone_totals(s, d):
    """Documents and characters by source and language, with totals by language."""
    docs = T(s, d, "documents")
    return docs.groupingSets([["source", "lang"], ["lang"]], "source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.grouping("source").cast("int").alias("is_total"))


def nested_projection(s, d):
    """Orders of a customer as a nested document, nulls kept: read back by path."""
    o = T(s, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("orders"))
    c = T(s, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    doc = F.to_json(F.struct("c_custkey", "c_name", F.col("orders")), {"ignoreNullFields": "false"})
    return c.select("c_custkey", F.get_json_object(doc, "$.c_name").alias("name"), F.get_json_object(doc, "$.orders[0].o_orderkey").cast("bigint").alias("first_order"), F.contains(doc, F.lit('"orders":null')).alias("has_none"))


def json_extract_typed(s, d):
    """``k`` of the properties as a whole number, null for any other type."""
    v = F.try_parse_json("props")
    whole = F.schema_of_variant(F.try_variant_get(v, "$.k", "variant")) == "BIGINT"
    return T(s, d, "events").select("event_id", F.when(whole, F.try_variant_get(v, "$.k", "bigint")).alias("k"))


#: Texts of one digest of the first level.
DIGEST_ROWS = 1000


def stale_digest(s, d):
    """One digest over the ordered texts of each source: of the digests of runs of ids, so that no array holds all texts."""
    joined = lambda parts: F.concat(F.lit("sha256:"), F.sha2(F.array_join(F.transform(F.array_sort(parts), lambda p: F.concat(p["k"].cast("string"), F.lit("|"), p["h"])), "|"), 256))
    b = T(s, d, "block").filter("text IS NOT NULL").withColumn("run", F.floor(F.col("block_id") / DIGEST_ROWS))
    runs = b.groupBy("source", "run").agg(joined(F.collect_list(F.struct(F.col("block_id").alias("k"), F.sha2("text", 256).alias("h")))).alias("h"), F.count("*").alias("n"))
    return runs.groupBy("source").agg(F.sum("n").alias("n"), joined(F.collect_list(F.struct(F.col("run").alias("k"), "h"))).alias("digest"))


def threshold_verdict(s, d):
    """Whether the share of flags without a claim stays under a limit."""
    return T(s, d, "flag").agg(F.count("*").alias("n"), F.count_if(F.col("claim").isNull()).alias("n_bad"), (F.avg(F.col("claim").isNull().cast("int")) <= 0.02).alias("is_ok"))


def upper_median(s, d):
    """Upper median of the sizes of documents and the share strictly between two bounds, by source.

    Sizes are counted before they are put in order: the windows hold distinct sizes only.
    """
    sizes = T(s, d, "documents").filter("n_chars IS NOT NULL").groupBy("source", "n_chars").agg(F.count("*").alias("c"))
    w = W.partitionBy("source")
    run = sizes.withColumns({"upto": F.sum("c").over(w.orderBy("n_chars")), "n": F.sum("c").over(w)})
    within = F.when((F.col("n_chars") > 100) & (F.col("n_chars") < 1000), F.col("c")).otherwise(0)
    return run.groupBy("source").agg(F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col("n_chars"))).alias("median"), F.round(100 * F.sum(within) / F.sum("c"), 6).alias("share"))


def pivot_status(s, d):
    return T(s, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0)


def pricing_summary(s, d):
    li = T(s, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


def revenue_by_nation(s, d):
    li, o, c, n = (T(s, d, t) for t in ("lineitem", "orders", "customer", "nation"))
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == c.c_custkey).join(n, F.col("c_nationkey") == n.n_nationkey)
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count_distinct("o_orderkey").alias("n_orders"))


def topn_per_layer(s, d):
    """The longest documents of each source."""
    docs = T(s, d, "documents").filter("n_chars IS NOT NULL")
    return docs.withColumn("place", F.row_number().over(W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))).filter("place <= 5").select("source", "place", "doc_id", "n_chars")


def carry_forward(s, d):
    """The last purchase value that a user has had so far, at every event."""
    e = T(s, d, "events")
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    return e.select("event_id", F.last(F.when(F.col("event_type") == "purchase", F.col("value")), ignorenulls=True).over(w).alias("last_value"))


def asof_events(s, d):
    """The last view of the user before each purchase."""
    e = T(s, d, "events")
    buy = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    view = e.filter("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    return asof.last_before(buy, view, ["user_id"], "ts", "view_id", "view").select("event_id", F.col("view").alias("view_id"))


def next_bounded(s, d):
    """The first click after each view, if it comes before the user's next view."""
    e = T(s, d, "events").select("event_id", "user_id", "ts", "event_type")
    got = asof.next_before_next(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "view", F.col("event_type") == "click", "event_id", "click_id")
    return got.select("event_id", "click_id")


def interval_pairs(s, d):
    """Adjacent view and click of a user; views left without one."""
    e = T(s, d, "events")
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    paired = F.lead("event_type").over(w) == "click"
    return e.withColumn("paired", F.coalesce(paired, F.lit(False))).filter("event_type = 'view'").groupBy("paired").agg(F.count("*").alias("n"))


def range_anti(s, d):
    """Purchases without an error of any kind within an hour."""
    e = T(s, d, "events").withColumn("everywhere", F.lit(1))
    buy, bad = e.filter("event_type = 'purchase'").select("event_id", "everywhere", "ts"), e.filter("event_type = 'error'").select("everywhere", "ts")
    return asof.none_within(buy, bad, ["everywhere"], "ts", 60).select("event_id")


def runs_of_three(s, d):
    """Runs of three or more clicks or views of a user."""
    e = T(s, d, "events").select("user_id", "ts", "event_id", "event_type")
    return asof.islands(e, ["user_id"], ["ts", "event_id"], F.col("event_type").isin("click", "view"), 3)


def section_counter(s, d):
    """Running number of an event since the user's last signup."""
    e = T(s, d, "events")
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    part = F.count_if(F.col("event_type") == "signup").over(w.rowsBetween(W.unboundedPreceding, 0))
    e = e.withColumn("part", part)
    return e.select("event_id", "part", F.row_number().over(W.partitionBy("user_id", "part").orderBy("ts", "event_id")).alias("n"))


def tumbling_events(s, d):
    e = T(s, d, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("v")).select(F.col("w.start").alias("hour"), "event_type", "n", "v")


def session_events(s, d):
    """Sessions of a user that end after thirty minutes without an event."""
    e = T(s, d, "events")
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.col("ts") - F.lag("ts").over(w) > F.expr("INTERVAL 30 MINUTES")
    e = e.withColumn("n", F.count_if(F.coalesce(gap, F.lit(True))).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return e.groupBy("user_id", F.col("n").alias("session")).agg(F.min("ts").alias("begin"), F.count("*").alias("events"))


def clone_matches(s, d):
    """Matches between members by statement, with the pass that made them."""
    return clones.matches(_decls(s, d)).select("left_id", "right_id", "is_clone", "is_renamed", "pass_no")


def _decls(s, d):
    c = T(s, d, "clone_decl")
    whole = F.when(F.col("whole").isNotNull(), F.concat_ws("\n", "whole.kind", "whole.mods", "whole.stmt", "whole.proof"))
    place = F.struct("file", "line", "decl_id")
    return c.select("decl_id", "member", "name", "src_lines", F.concat_ws("\n", "anchor.tag", "anchor.text").alias("anchor"), whole.alias("whole"), place.alias("place"))


def clone_report(s, d):
    decls = _decls(s, d)
    allowed = decls.filter("name like '%\\_le'").select("name")
    return clones.report(clones.matches(decls), decls, allowed)


def member_pairs(s, d):
    return clones.pairs_of_members(T(s, d, "clone_decl").filter("member IS NOT NULL").select("member").distinct())


def ambiguous_suffix(s, d):
    """Last parts of declaration names that name one declaration only, else null."""
    c = T(s, d, "clone_decl").select("name", F.substring_index("name", "_", -1).alias("suffix"))
    return c.groupBy("suffix").agg(F.count_distinct("name").alias("n"), F.min("name").alias("name")).select("suffix", "n", F.when(F.col("n") == 1, F.col("name")).alias("resolved"))


def _nation_edges(s, d):
    n = T(s, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("i"))
    return n.select(F.col("i").alias("src"), F.explode(F.array(F.struct((F.col("i") * 2 % 25).alias("dst"), F.lit(0).alias("pos")), F.struct(((F.col("i") * 3 + 1) % 25).alias("dst"), F.lit(1).alias("pos")))).alias("e")).select("src", "e.dst", "e.pos")


def _nodes(s, d):
    return T(s, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("node"), "n_regionkey")


def closure_reach(s, d):
    return graph.closure(_nation_edges(s, d), _nodes(s, d))


def bfs_paths(s, d):
    return graph.bfs(_nation_edges(s, d), _nodes(s, d)).select("source", "node", "dist")


def bfs_stop(s, d):
    """Distances when nations of region 0 are recorded but not walked through."""
    return graph.bfs(_nation_edges(s, d), _nodes(s, d), _nodes(s, d).filter("n_regionkey = 0")).select("source", "node", "dist")


def invariant_violations(s, d):
    """Nations of region 1 that are reached from nations of region 2, with who reaches them and the nearest."""
    n = _nodes(s, d)
    reach = graph.bfs(_nation_edges(s, d), n.filter("n_regionkey = 2")).join(n.filter("n_regionkey = 1").select("node"), "node")
    return reach.groupBy("node").agg(F.array_join(F.transform(F.array_sort(F.collect_list("source")), lambda x: x.cast("string")), ",").alias("reachers"), F.min("dist").alias("nearest"))


def interface_reach(s, d):
    """Nations of region 0 that nothing of region 3 reaches."""
    n = _nodes(s, d)
    edges = n.select(F.col("node").alias("src"), (F.col("node") * 5 % 25).alias("dst"), F.lit(0).alias("pos"))
    reached = graph.closure(edges, n.filter("n_regionkey = 3"))
    return n.filter("n_regionkey = 0").select("node").join(reached.select("node"), "node", "left_anti")


def import_closure_parent(s, d):
    """Parts reached from the last parts by halving their key, with the first parent."""
    p = T(s, d, "part").select(F.col("p_partkey").alias("i"))
    edges = p.filter("i > 1").select(F.col("i").alias("src"), F.floor(F.col("i") / 2).cast("bigint").alias("dst"), F.lit(0).alias("pos"))
    m = p.agg(F.max("i").alias("m"))
    roots = p.join(F.broadcast(m), F.col("i") >= F.col("m") - 3).select(F.col("i").alias("node"), F.col("i").alias("pos"))
    return graph.first_parents(edges, roots)


def label_components(s, d):
    """Components of labels that reviewers cite together in one flag."""
    f = T(s, d, "flag").dropDuplicates(["flag_id"]).filter("size(refs) > 0").select("flag_id", F.array_distinct("refs").alias("refs"))
    labels = f.select(F.explode("refs").alias("node")).distinct()
    edges = f.select(F.element_at("refs", 1).alias("a"), F.explode("refs").alias("b"))
    found = graph.components(labels, edges)
    return found.groupBy("component").agg(F.count("*").alias("n"))


_EDGES = "edge AS (SELECT n_nationkey::BIGINT AS src, (n_nationkey * 2 % 25)::BIGINT AS dst FROM nation UNION ALL SELECT n_nationkey::BIGINT, ((n_nationkey * 3 + 1) % 25)::BIGINT FROM nation)"
_BFS = "walk AS (SELECT n_nationkey::BIGINT AS source, n_nationkey::BIGINT AS node, 0 AS dist FROM nation UNION SELECT w.source, e.dst, w.dist + 1 FROM walk w JOIN edge e ON w.node = e.src WHERE w.dist < 25)"
_STOP = _BFS.replace("WHERE w.dist < 25", "JOIN nation n ON n.n_nationkey = w.node WHERE w.dist < 25 AND (n.n_regionkey <> 0 OR w.dist = 0)")
_MATCH = """
base AS (SELECT decl_id, member, name, src_lines, concat_ws(chr(10), anchor.tag, anchor.text) AS anchor,
    CASE WHEN "whole" IS NOT NULL THEN concat_ws(chr(10), "whole".kind, "whole".mods, "whole".stmt, "whole".proof) END AS wh, file, line FROM clone_decl),
rows0 AS (SELECT * FROM base WHERE member IS NOT NULL AND wh IS NOT NULL AND anchor IS NOT NULL),
meet AS (SELECT r.anchor, least(r.member, m.member) AS l, greatest(r.member, m.member) AS r, r.member < m.member AS is_left, r.wh, r.name, r.file, r.line, r.decl_id
  FROM rows0 r JOIN (SELECT DISTINCT anchor, member FROM rows0) m ON r.anchor = m.anchor AND r.member <> m.member)"""


def _sql_passes() -> str:
    """The four passes of the matching as common table expressions."""
    out, before = [_MATCH], "meet"
    for k, extra in enumerate((["wh", "name"], ["wh"], ["name"], []), 1):
        key = ["anchor", "l", "r", *extra]
        same = " AND ".join(f"a.{c} = b.{c}" for c in key)
        out.append(f"num{k} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {', '.join(key)}, is_left ORDER BY file NULLS FIRST, line NULLS FIRST, decl_id) AS n FROM {before})")
        out.append(f"hit{k} AS MATERIALIZED (SELECT a.anchor, a.l, a.r, a.decl_id AS left_id, b.decl_id AS right_id, a.wh = b.wh AS is_clone, coalesce(a.name <> b.name, false) AS is_renamed, {k} AS pass_no FROM num{k} a JOIN num{k} b ON {same} AND a.n = b.n AND a.is_left AND NOT b.is_left)")
        out.append(f"rest{k} AS MATERIALIZED (SELECT * FROM {before} m WHERE NOT EXISTS (SELECT 1 FROM hit{k} h WHERE h.l = m.l AND h.r = m.r AND (h.left_id = m.decl_id OR h.right_id = m.decl_id)))")
        before = f"rest{k}"
    out.append("found AS (" + " UNION ALL ".join(f"SELECT * FROM hit{k}" for k in range(1, 5)) + ")")
    return "WITH " + ",\n".join(out)


QUERIES = {
    f.__name__: f
    for f in (
        policy_first_last, label_first_place, anti_exists, semi_double, lookup_fallback, first_match_source, case_join, ledger_resolution, full_outer_drift, three_way_drift,
        set_rewrites, array_diff, grouped_zone_totals, nested_projection, json_extract_typed, stale_digest, threshold_verdict, upper_median, pivot_status, pricing_summary, revenue_by_nation,
        topn_per_layer, carry_forward, asof_events, next_bounded, interval_pairs, range_anti, runs_of_three, section_counter, tumbling_events, session_events,
        clone_matches, clone_report, member_pairs, ambiguous_suffix, closure_reach, bfs_paths, bfs_stop, invariant_violations, interface_reach, import_closure_parent, label_components,
    )
}
SQL = {
    "policy_first_last": "SELECT o_custkey, first(o_orderkey ORDER BY o_orderdate, o_orderkey) AS first_order, last(o_orderkey ORDER BY o_orderdate, o_orderkey) AS last_order, bool_or(o_orderpriority = '1-URGENT') AS any_urgent FROM orders GROUP BY o_custkey",
    "label_first_place": "SELECT label, first(rel ORDER BY rel, line) AS rel, first(line ORDER BY rel, line) AS line, count(DISTINCT (rel, line))::BIGINT AS n_places FROM paper_label GROUP BY label",
    "anti_exists": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    "semi_double": "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R') AND s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_discount >= 0.1 AND l_quantity >= 50 AND l_tax >= 0.06)",
    "lookup_fallback": """WITH s AS (SELECT s_suppkey, s_nationkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey),
      a AS (SELECT s_nationkey, min(s_suppkey) AS near FROM s GROUP BY 1), b AS (SELECT n_regionkey, min(s_suppkey) AS wide FROM s GROUP BY 1)
      SELECT c_custkey, coalesce(near, wide) AS suppkey, near IS NOT NULL AS is_near FROM customer JOIN nation n ON c_nationkey = n_nationkey LEFT JOIN a ON c_nationkey = s_nationkey LEFT JOIN b ON n.n_regionkey = b.n_regionkey""",
    "first_match_source": "SELECT l_partkey, l_suppkey, price FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY price, l_suppkey) AS n FROM (SELECT l_partkey, l_suppkey, min(l_extendedprice) AS price FROM lineitem GROUP BY 1, 2)) WHERE n = 1",
    "case_join": "SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'unknown' WHEN c_acctbal < 0 THEN 'owing' ELSE 'fine' END AS state, c_custkey IS NOT NULL AS is_known FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'F'",
    "ledger_resolution": """SELECT CASE WHEN p_partkey IS NULL THEN 'missing' WHEN s_suppkey IS NULL THEN 'incomplete' ELSE 'resolved' END AS resolution, count(*)::BIGINT AS n
      FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size > 5 LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_acctbal > 0 GROUP BY 1""",
    "full_outer_drift": """SELECT coalesce(c.label, l.label) AS label, CASE WHEN c.label IS NULL THEN 'never cited' WHEN l.label IS NULL THEN 'not listed' ELSE 'both' END AS side
      FROM (SELECT DISTINCT unnest(refs) AS label FROM flag) c FULL JOIN (SELECT DISTINCT label FROM paper_label) l ON c.label = l.label""",
    "three_way_drift": """SELECT block_id, CASE WHEN ours = theirs THEN 'same' WHEN recorded = ours THEN 'theirs changed' WHEN recorded = theirs THEN 'ours changed' ELSE 'both changed' END AS direction
      FROM (SELECT block_id, sha256(text) AS ours, sha256(CASE WHEN block_id % 3 = 0 THEN text || '!' ELSE text END) AS theirs, sha256(CASE WHEN block_id % 4 = 0 THEN text || '?' ELSE text END) AS recorded FROM block WHERE text IS NOT NULL)""",
    "set_rewrites": """WITH a AS (SELECT s_nationkey::INT AS k FROM supplier), b AS (SELECT c_nationkey::INT AS k FROM customer)
      SELECT 'union' AS what, k FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'both', k FROM (SELECT k FROM a INTERSECT SELECT k FROM b)
      UNION ALL SELECT 'only_customers', k FROM (SELECT k FROM b EXCEPT SELECT k FROM a) UNION ALL SELECT 'neither', k FROM (SELECT n_nationkey::INT AS k FROM nation EXCEPT (SELECT k FROM a UNION SELECT k FROM b))""",
    "array_diff": """WITH f AS (SELECT flag_id, any_value(item_id) AS item_id, any_value(refs) AS refs FROM flag WHERE refs IS NOT NULL GROUP BY flag_id),
      g AS (SELECT item_id, list_sort(list_distinct(flatten(list(refs)))) AS all_refs FROM f GROUP BY item_id)
      SELECT flag_id, array_to_string(list_filter(refs, lambda x, i: list_position(refs, x) = i), ' ') AS distinct_refs,
      array_to_string(list_filter(all_refs, lambda x: NOT list_contains(refs, x)), ' ') AS not_cited, len(refs)::INT AS n_refs FROM f JOIN g USING (item_id)""",
    "grouped_zone_totals": "SELECT source, lang, count(*)::BIGINT AS n, sum(n_chars)::BIGINT AS chars, grouping(source)::INT AS is_total FROM documents GROUP BY GROUPING SETS ((source, lang), (lang))",
    "nested_projection": "SELECT c_custkey, any_value(c_name) AS name, min(o_orderkey) AS first_order, count(o_orderkey) = 0 AS has_none FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
    "json_extract_typed": "SELECT event_id, CASE WHEN json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') THEN (props->>'$.k')::BIGINT END AS k FROM events",
    "stale_digest": """WITH r AS (SELECT source, block_id // 1000 AS run, count(*) AS n, 'sha256:' || sha256(string_agg(block_id::VARCHAR || '|' || sha256(text), '|' ORDER BY block_id)) AS h FROM block WHERE text IS NOT NULL GROUP BY 1, 2)
      SELECT source, sum(n)::BIGINT AS n, 'sha256:' || sha256(string_agg(run::VARCHAR || '|' || h, '|' ORDER BY run)) AS digest FROM r GROUP BY source""",
    "threshold_verdict": "SELECT count(*)::BIGINT AS n, count(*) FILTER (WHERE claim IS NULL)::BIGINT AS n_bad, avg((claim IS NULL)::INT) <= 0.02 AS is_ok FROM flag",
    "upper_median": "SELECT source, list_sort(list(n_chars))[count(*) // 2 + 1] AS median, round(100 * avg((n_chars > 100 AND n_chars < 1000)::INT), 6) AS share FROM documents WHERE n_chars IS NOT NULL GROUP BY source",
    "pivot_status": 'SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = \'F\')::BIGINT AS "F", count(*) FILTER (WHERE o_orderstatus = \'O\')::BIGINT AS "O", count(*) FILTER (WHERE o_orderstatus = \'P\')::BIGINT AS "P" FROM orders GROUP BY 1',
    "pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_price, round(avg(l_discount), 6) AS avg_disc, count(*)::BIGINT AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
    "revenue_by_nation": "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey)::BIGINT AS n_orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    "topn_per_layer": "SELECT source, place::INT AS place, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS place FROM documents WHERE n_chars IS NOT NULL) WHERE place <= 5",
    "carry_forward": "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_value FROM events",
    "asof_events": "SELECT b.event_id, max_by(v.event_id, (v.ts, v.event_id)) AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') b LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON v.user_id = b.user_id AND v.ts <= b.ts GROUP BY b.event_id",
    "next_bounded": """WITH o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
      SELECT v.event_id, (SELECT c.event_id FROM o c WHERE c.user_id = v.user_id AND c.n > v.n AND c.event_type = 'click'
        AND c.n < coalesce((SELECT min(w.n) FROM o w WHERE w.user_id = v.user_id AND w.n > v.n AND w.event_type = 'view'), 1000000000) ORDER BY c.n LIMIT 1) AS click_id FROM o v WHERE v.event_type = 'view'""",
    "interval_pairs": "SELECT paired, count(*)::BIGINT AS n FROM (SELECT event_type, coalesce(lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = 'click', false) AS paired FROM events) WHERE event_type = 'view' GROUP BY 1",
    "range_anti": "SELECT event_id FROM events p WHERE event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM events e WHERE e.event_type = 'error' AND e.ts BETWEEN p.ts - INTERVAL 60 SECOND AND p.ts + INTERVAL 60 SECOND)",
    "runs_of_three": """WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
      r AS (SELECT user_id, n, n - row_number() OVER (PARTITION BY user_id ORDER BY n) AS run FROM n WHERE event_type IN ('click', 'view'))
      SELECT user_id, min(n)::INT AS start, count(*)::BIGINT AS length FROM r GROUP BY user_id, run HAVING count(*) >= 3""",
    "section_counter": """SELECT event_id, part, row_number() OVER (PARTITION BY user_id, part ORDER BY ts, event_id)::INT AS n FROM (SELECT *, count(*) FILTER (WHERE event_type = 'signup') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS part FROM events)""",
    "tumbling_events": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS v FROM events GROUP BY 1, 2",
    "session_events": """SELECT user_id, session, min(ts) AS begin, count(*)::BIGINT AS events FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM (
      SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY 1, 2""",
    "clone_matches": _sql_passes() + " SELECT left_id, right_id, is_clone, is_renamed, pass_no FROM found",
    "clone_report": _sql_passes()
    + """, ok AS (SELECT DISTINCT name FROM base WHERE name LIKE '%#_le' ESCAPE '#'), joined AS (SELECT f.*, a.src_lines AS la, b.src_lines AS lb, a.name IN (SELECT name FROM ok) OR b.name IN (SELECT name FROM ok) AS excepted
      FROM found f JOIN base a ON a.decl_id = left_id JOIN base b ON b.decl_id = right_id)
      SELECT l AS "left", r AS "right", count(*)::BIGINT AS n_matches, count(*) FILTER (WHERE is_clone)::BIGINT AS n_clones, count(*) FILTER (WHERE is_clone AND is_renamed)::BIGINT AS n_renamed,
      count(*) FILTER (WHERE is_clone AND coalesce(excepted, false))::BIGINT AS n_excepted, count(*) FILTER (WHERE is_clone AND NOT coalesce(excepted, false))::BIGINT AS n_counted,
      coalesce(sum(CASE WHEN is_clone THEN least(la, lb) ELSE 0 END), 0)::BIGINT AS lines FROM joined GROUP BY 1, 2""",
    "member_pairs": "SELECT a.member AS a, b.member AS b FROM (SELECT DISTINCT member FROM clone_decl) a JOIN (SELECT DISTINCT member FROM clone_decl) b ON a.member < b.member",
    "ambiguous_suffix": "SELECT suffix, n, CASE WHEN n = 1 THEN name END AS resolved FROM (SELECT string_split(name, '_')[-1] AS suffix, count(DISTINCT name)::BIGINT AS n, min(name) AS name FROM clone_decl GROUP BY 1)",
    "closure_reach": f"WITH RECURSIVE {_EDGES}, reach AS (SELECT src AS source, dst AS node FROM edge UNION SELECT r.source, e.dst FROM reach r JOIN edge e ON r.node = e.src) SELECT source, node FROM reach",
    "bfs_paths": f"WITH RECURSIVE {_EDGES}, {_BFS} SELECT source, node, min(dist)::INT AS dist FROM walk WHERE source <> node GROUP BY 1, 2",
    "bfs_stop": f"WITH RECURSIVE {_EDGES}, {_STOP} SELECT source, node, min(dist)::INT AS dist FROM walk WHERE source <> node GROUP BY 1, 2",
    "invariant_violations": f"""WITH RECURSIVE {_EDGES}, {_BFS}, best AS (SELECT source, node, min(dist)::INT AS dist FROM walk WHERE source <> node GROUP BY 1, 2)
      SELECT node, string_agg(source::VARCHAR, ',' ORDER BY source) AS reachers, min(dist)::INT AS nearest FROM best JOIN nation a ON a.n_nationkey = source JOIN nation b ON b.n_nationkey = node WHERE a.n_regionkey = 2 AND b.n_regionkey = 1 GROUP BY node""",
    "interface_reach": """WITH RECURSIVE edge AS (SELECT n_nationkey::BIGINT AS src, (n_nationkey * 5 % 25)::BIGINT AS dst FROM nation), reach AS (SELECT src AS source, dst AS node FROM edge UNION SELECT r.source, e.dst FROM reach r JOIN edge e ON r.node = e.src)
      SELECT n_nationkey::BIGINT AS node FROM nation WHERE n_regionkey = 0 AND n_nationkey NOT IN (SELECT node FROM reach JOIN nation a ON a.n_nationkey = source WHERE a.n_regionkey = 3)""",
    "import_closure_parent": """WITH RECURSIVE w AS (SELECT p_partkey AS node, NULL::BIGINT AS parent, 0 AS dist, p_partkey AS root FROM part WHERE p_partkey >= (SELECT max(p_partkey) - 3 FROM part)
      UNION ALL SELECT node // 2, node, dist + 1, root FROM w WHERE node > 1)
      SELECT node, first(parent ORDER BY dist, root) AS parent, min(dist)::INT AS dist FROM w GROUP BY node""",
}
