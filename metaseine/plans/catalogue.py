"""The engine's operators as queries over the provided tables, and SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import human_size, matches_glob
from ..operators import graph, match, scan, sinks
from ..operators.match import SearchSpec, matches, search
from ..sources import index

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as entities, their turns as units labelled by role."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("entity"), F.col("turn").alias("unit_ord"), F.col("role").alias("label"), "text")


def _hits(found: DataFrame, entity: str) -> DataFrame:
    return found.select(F.col("entity").alias(entity), F.posexplode("hits").alias("k", "h")).select(entity, F.col("h.term").alias("term"), F.col("h.label").alias("label"), F.col("h.snippet").alias("snippet"))


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, 'the', 'is')")
def q_term_ci(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(matches(F.col("text"), "the")).select("doc_id")


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, 'The', 's')")
def q_term_cs(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(matches(F.col("text"), "The", case_sensitive=True)).select("doc_id")


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, 'é', 'is')")
def q_term_accent(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(matches(F.col("text"), "É")).select("doc_id")


@query(r"SELECT doc_id FROM documents WHERE regexp_matches(text, 'er[a-z]{2,4}sh', 'is')")
def q_regex(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(matches(F.col("text"), "er[a-z]{2,4}sh", regex=True)).select("doc_id")


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, 'copyright', 'is') OR regexp_matches(text, 'rights', 'is') OR regexp_matches(text, 'idiot', 'is')")
def q_any(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.where(matches(F.col("text"), "copyright") | matches(F.col("text"), "rights") | matches(F.col("text"), "idiot")).select("doc_id")


@query("SELECT conv_id FROM conversations GROUP BY conv_id HAVING bool_or(regexp_matches(text, 'shh', 'is')) AND bool_or(regexp_matches(text, 'ble', 'is'))")
def q_scope_image_all(spark, sf_dir):
    return search(turns(spark, sf_dir), SearchSpec(("shh", "ble"), snippets=False)).select(F.col("entity").alias("conv_id"))


@query("SELECT DISTINCT conv_id FROM conversations WHERE regexp_matches(text, 'sh', 'is') AND regexp_matches(text, 'ble', 'is')")
def q_scope_field_all(spark, sf_dir):
    return search(turns(spark, sf_dir), SearchSpec(("sh", "ble"), scope="field", snippets=False)).select(F.col("entity").alias("conv_id"))


@query("SELECT DISTINCT conv_id FROM conversations WHERE regexp_matches(text, 'shh', 'is') OR regexp_matches(text, 'tha', 'is')")
def q_scope_field_any(spark, sf_dir):
    return search(turns(spark, sf_dir), SearchSpec(("shh", "tha"), scope="field", mode="any", snippets=False)).select(F.col("entity").alias("conv_id"))


_ANY = """WITH u AS (SELECT conv_id, turn, role, regexp_matches(text, 'shh', 'is') AS a, regexp_matches(text, 'edst', 'is') AS b FROM conversations),
f AS (SELECT conv_id, min(turn) AS turn FROM u WHERE a OR b GROUP BY conv_id)
SELECT u.conv_id, CAST(t.term AS INT) AS term, u.role AS label FROM u JOIN f USING (conv_id, turn), (VALUES (0), (1)) t(term) WHERE (t.term = 0 AND u.a) OR (t.term = 1 AND u.b)"""


@query(_ANY)
def q_any_image(spark, sf_dir):
    return _hits(search(turns(spark, sf_dir), SearchSpec(("shh", "edst"), mode="any", snippets=False)), "conv_id").select("conv_id", "term", "label")


@query("SELECT conv_id FROM conversations GROUP BY conv_id HAVING bool_or(regexp_matches(text, 'shh', 'is')) AND NOT bool_or(regexp_matches(text, 'edst', 'is'))")
def q_not(spark, sf_dir):
    return search(turns(spark, sf_dir), SearchSpec(("shh",), ("edst",), snippets=False)).select(F.col("entity").alias("conv_id"))


@query("SELECT doc_id FROM documents WHERE regexp_matches(lang, 'en', 'is') OR regexp_matches(source, 'en', 'is')")
def q_fields_filter(spark, sf_dir):
    units = match.unpivot(table(spark, sf_dir, "documents"), "doc_id", ["text", "lang", "source"])
    return search(units, SearchSpec(("en",), fields=("LANG", "Source"), snippets=False)).select(F.col("entity").alias("doc_id"))


@query("""SELECT doc_id AS entity, 0 AS unit_ord, 'lang' AS label, lang AS text FROM documents UNION ALL
SELECT doc_id, 1, 'source', source FROM documents UNION ALL SELECT doc_id, 2, 'n_chars', CAST(n_chars AS VARCHAR) FROM documents""")
def q_unpivot_fields(spark, sf_dir):
    return match.unpivot(table(spark, sf_dir, "documents"), "doc_id", ["lang", "source", "n_chars"])


_SNIPPET = """WITH m AS (SELECT doc_id, text, strpos(lower(text), 'sh') AS p FROM documents WHERE regexp_matches(text, 'sh', 'is')),
w AS (SELECT doc_id, text, greatest(p - 1 - 46, 0) AS low, least(p - 1 + 2 + 70, length(text)) AS high FROM m)
SELECT doc_id, CASE WHEN low > 0 THEN '…' ELSE '' END || replace(regexp_replace(substring(text, CAST(low + 1 AS INT), CAST(high - low AS INT)), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]+', ' ', 'g'), chr(10), ' ') || CASE WHEN high < length(text) THEN '…' ELSE '' END AS snippet FROM w"""


@query(_SNIPPET)
def q_snippet(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(matches(F.col("text"), "sh"))
    return d.select("doc_id", match.snippet(F.col("text"), match.term_pattern("sh")).alias("snippet"))


@query("SELECT conv_id, arg_min(role, turn) AS label FROM conversations WHERE regexp_matches(text, 'shh', 'is') GROUP BY conv_id")
def q_first_hit(spark, sf_dir):
    return _hits(search(turns(spark, sf_dir), SearchSpec(("shh",), snippets=False)), "conv_id").select("conv_id", "label")


_PER_TERM = """WITH u AS (SELECT conv_id, turn, role, regexp_matches(text, 'shh', 'is') AS a, regexp_matches(text, 'ble', 'is') AS b FROM conversations),
g AS (SELECT conv_id, arg_min(role, turn) FILTER (WHERE a) AS la, arg_min(role, turn) FILTER (WHERE b) AS lb FROM u GROUP BY conv_id HAVING bool_or(a) AND bool_or(b))
SELECT conv_id, CAST(0 AS INT) AS term, la AS label FROM g UNION ALL SELECT conv_id, 1, lb FROM g"""


@query(_PER_TERM)
def q_hits_per_term(spark, sf_dir):
    return _hits(search(turns(spark, sf_dir), SearchSpec(("shh", "ble"), snippets=False)), "conv_id").select("conv_id", "term", "label")


@query("SELECT conv_id, turn AS unit_ord FROM conversations WHERE regexp_matches(text, 'sh', 'is') AND regexp_matches(text, 'ble', 'is')")
def q_field_hits(spark, sf_dir):
    units = turns(spark, sf_dir).withColumn("label", F.col("unit_ord").cast("string"))
    return _hits(search(units, SearchSpec(("sh", "ble"), scope="field", snippets=False)), "conv_id").select("conv_id", F.col("label").cast("long").alias("unit_ord"))


@query("SELECT event_id, unnest(json_keys(props)) AS field, json_extract_string(props, '$.' || unnest(json_keys(props))) AS text FROM events")
def q_json_fields(spark, sf_dir):
    return match.unpivot_json(table(spark, sf_dir, "events"), "event_id", "props").select(F.col("entity").alias("event_id"), F.col("label").alias("field"), "text")


def _one_node(rows: DataFrame, path: str, kind: str, inputs: str) -> DataFrame:
    """A record for each row whose field ``prompt`` is a graph of one node."""
    graph = F.concat(F.lit('{"1": {"class_type": '), F.to_json(F.array(kind)).substr(F.lit(2), F.length(F.to_json(F.array(kind))) - 2), F.lit(', "inputs": '), F.col(inputs), F.lit("}}"))
    return rows.select(F.col(path).cast("string").alias("path"), F.array(F.struct(F.lit(0).alias("ord"), F.lit("prompt").alias("field"), graph.alias("text"))).alias("fields"))


@query("SELECT event_id, 'prompt#1' AS label FROM events WHERE contains(json_extract_string(props, '$.k'), '7')")
def q_input_filter(spark, sf_dir):
    """Events as nodes with their properties as inputs; those whose input k has a 7."""
    spec = SearchSpec(("7",), inputs=("K",), snippets=False)
    found = search(scan.units(_one_node(table(spark, sf_dir, "events"), "event_id", "event_type", "props"), spec), scan.replaced(spec))
    return _hits(found, "event_id").select(F.col("event_id").cast("long").alias("event_id"), "label")


@query("SELECT p_partkey, 'prompt#1' AS label FROM part WHERE contains(lower(p_type), 'promo') OR contains(lower(p_type), 'small')")
def q_node_type(spark, sf_dir):
    """Parts as nodes of their types."""
    spec = SearchSpec(("class_type",), scope="node", node_types=("Promo", "SMALL"), snippets=False)
    parts = table(spark, sf_dir, "part").withColumn("inputs", F.to_json(F.struct("p_name")))
    return _hits(search(scan.units(_one_node(parts, "p_partkey", "p_type", "inputs"), spec), scan.replaced(spec)), "p_partkey").select(F.col("p_partkey").cast("long").alias("p_partkey"), "label")


@query("""SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages""")
def q_links_extract(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href"))


def _order_graph(spark, sf_dir):
    """One graph: customers, and orders that point at them."""
    edges = table(spark, sf_dir, "orders").select(F.lit(0).alias("graph"), F.concat(F.lit("o"), "o_orderkey").alias("src"), F.concat(F.lit("c"), "o_custkey").alias("dst"))
    nodes = table(spark, sf_dir, "customer").select(F.lit(0).alias("graph"), F.concat(F.lit("c"), "c_custkey").alias("node"))
    return nodes.union(edges.select("graph", "src")), edges


@query("""SELECT 'c' || c_custkey AS node FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
UNION ALL SELECT 'o' || o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE o_custkey = c_custkey)""")
def q_linked(spark, sf_dir):
    nodes, edges = _order_graph(spark, sf_dir)
    return graph.linked(nodes, edges).select("node")


@query("SELECT 'o' || o_orderkey AS src, 'c' || o_custkey AS dst FROM orders WHERE o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)")
def q_live_links(spark, sf_dir):
    """Links between nodes that both exist: finished orders, and customers that owe nothing."""
    _, edges = _order_graph(spark, sf_dir)
    nodes = table(spark, sf_dir, "customer").where("c_acctbal > 0").selectExpr("0 graph", "'c' || c_custkey node").union(table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").selectExpr("0", "'o' || o_orderkey"))
    return graph.live_edges(edges, nodes).select("src", "dst")


@query("SELECT 's' || s_suppkey AS src, 'c' || c_custkey AS dst FROM supplier JOIN customer ON s_nationkey = c_nationkey")
def q_name_join(spark, sf_dir):
    """Suppliers set the name of their nation, customers get it."""
    setters = table(spark, sf_dir, "supplier").selectExpr("0 graph", "'s' || s_suppkey node", "'SetNode' type", "cast(s_nationkey as string) name")
    getters = table(spark, sf_dir, "customer").selectExpr("0", "'c' || c_custkey", "'GetNode'", "cast(c_nationkey as string)")
    return graph.named_edges(setters.union(getters)).select("src", "dst")


@query("""SELECT DISTINCT 'o' || o_orderkey AS src, 'r' || n_regionkey AS dst FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def q_contract(spark, sf_dir):
    """Orders to regions, with customers and nations taken out of the chains between them."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    edges = o.selectExpr("0 graph", "'o' || o_orderkey src", "'c' || o_custkey dst").union(c.selectExpr("0", "'c' || c_custkey", "'n' || c_nationkey")).union(n.selectExpr("0", "'n' || n_nationkey", "'r' || n_regionkey"))
    via = c.selectExpr("0 graph", "'c' || c_custkey node").union(n.selectExpr("0", "'n' || n_nationkey"))
    return graph.contract(edges, via).select("src", "dst")


_REACH = """WITH RECURSIVE e(src, dst) AS (SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
r(node) AS (SELECT DISTINCT dst FROM e WHERE dst IN (SELECT 'r' || r_regionkey FROM region WHERE r_name IN ('ASIA', 'EUROPE')) UNION SELECT e.src FROM r JOIN e ON e.dst = r.node)
SELECT node FROM r"""


@query(_REACH)
def q_reach_output(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    edges = c.selectExpr("0 graph", "'c' || c_custkey src", "'n' || c_nationkey dst").union(n.selectExpr("0", "'n' || n_nationkey", "'r' || n_regionkey"))
    seeds = r.where("r_name in ('ASIA', 'EUROPE')").selectExpr("0 graph", "'r' || r_regionkey node")
    return graph.reaching(edges, seeds).select("node")


@query("SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def q_anti_done(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("dir"))
    return scan.pending(files, table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("dir"))).select("doc_id")


@query("""SELECT d.doc_id, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1) AS cached FROM documents d""")
def q_cache_join(spark, sf_dir):
    """Documents as files, and an index of those with a label, which is stale (of another size) where the quality is 0."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    files = docs.select("doc_id", F.col("doc_id").cast("string").alias("target"), F.col("n_chars").alias("length"), F.lit(0).cast("long").alias("mtime_ns"))
    held = docs.join(labels, "doc_id").select(F.col("doc_id").cast("string").alias("path"), (F.col("n_chars") + 1 - F.col("quality")).alias("size"), F.lit(0).cast("long").alias("mtime_ns"), F.lit(False).alias("deep"), F.expr("array(named_struct('ord', 0, 'field', 'f', 'text', 't'))").alias("fields"))
    read, found = index.lookup(files, held, False)
    return read.select("doc_id", F.lit(False).alias("cached")).union(found.select("doc_id", F.lit(True).alias("cached")))


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def q_dedupe(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("target"))
    return match.distinct_targets(d, "target", "doc_id").select("doc_id")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def q_upsert_latest(spark, sf_dir):
    return match.latest(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query("SELECT event_type AS kind, count(*) AS n FROM events GROUP BY event_type")
def q_kind_hist(spark, sf_dir):
    return match.histogram(table(spark, sf_dir, "events"), F.col("event_type"))


@query("SELECT lang || '/' || source AS kind, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, kind LIMIT 3")
def q_top3(spark, sf_dir):
    return match.top(match.histogram(table(spark, sf_dir, "documents"), F.concat("lang", F.lit("/"), "source")), 3)


@query("SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1, 2 HAVING NOT bool_or(event_type = 'error')")
def q_folder_complete(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return match.completed(e, ["user_id", "day"], F.col("event_type") == "error")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-09 00:00:00'")
def q_since_until(spark, sf_dir):
    from ..functions.columns import parse_when

    since, until = parse_when("2024-01-05"), parse_when("2024-01-08", end_of_day=True)
    return table(spark, sf_dir, "events").where((F.col("ts") >= F.lit(str(since)).cast(_type(spark, sf_dir, "events", "ts"))) & (F.col("ts") < F.lit(str(until)).cast(_type(spark, sf_dir, "events", "ts")))).select("event_id")


def _type(spark, sf_dir, name, column):
    return table(spark, sf_dir, name).schema[column].dataType


@query("SELECT doc_id FROM documents WHERE NOT regexp_full_match(lower(source), 'src1.*')")
def q_glob_exclude(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(~matches_glob(F.col("source"), "SRC1*")).select("doc_id")


_CLASSIFY = r"""SELECT doc_id, CASE WHEN length(text) = 0 THEN 'empty file' WHEN ltrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) LIKE '<%' THEN 'HTML or XML text (an error page saved as an image?)'
WHEN ltrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) LIKE '{%' OR ltrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) LIKE '[%' THEN 'JSON text'
WHEN regexp_full_match(hex(encode(text))[1:128], '((09|0A|0D|[2-6][0-9A-F]|7[0-9A-E]))*') THEN 'plain text' ELSE 'unrecognised content' END AS category FROM documents"""


@query(_CLASSIFY)
def q_classify(spark, sf_dir):
    from ..functions.columns import describe_unreadable

    raw = F.encode("text", "UTF-8")
    d = table(spark, sf_dir, "documents").select("doc_id", describe_unreadable(F.substring(raw, 1, 64), F.octet_length(raw).cast("long")).alias("d"))
    return d.select("doc_id", F.substring_index("d", ";", 1).alias("category"))


@query("SELECT doc_id, CASE WHEN n_chars < 1024 THEN CAST(n_chars AS VARCHAR) || ' B' ELSE printf('%.1f', n_chars / 1024.0) || ' KB' END AS size FROM documents")
def q_human_size(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", human_size(F.col("n_chars")).alias("size"))


@query(r"SELECT page_id, lower(regexp_extract(url, '[^/.][^/]*\.([^./]*)$', 1)) AS ext FROM pages WHERE lower(regexp_extract(url, '[^/.][^/]*\.([^./]*)$', 1)) NOT IN ('com', '')")
def q_ext_filter(spark, sf_dir):
    from ..functions.columns import suffix

    return table(spark, sf_dir, "pages").select("page_id", suffix(F.col("url")).alias("ext")).where(~F.col("ext").isin("com", ""))


@query("SELECT doc_id, source || '__' || lang || '__' || doc_id || '.png' AS link_name FROM documents")
def q_flatten_name(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("/r/"), "source", F.lit("/"), "lang", F.lit("/"), "doc_id", F.lit(".png")).alias("path"))
    return sinks.link_names(d, "/r", flatten=True).select("doc_id", "link_name")


@query("""WITH n AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k FROM documents)
SELECT doc_id, CASE WHEN k = 0 THEN source || '.png' ELSE source || '_' || k || '.png' END AS link_name FROM n""")
def q_link_name(spark, sf_dir):
    """Names that clash, numbered in the order of their paths."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("/r/"), F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit("/"), "source", F.lit(".png")).alias("path"))
    return sinks.link_names(d, "/r").select("doc_id", "link_name")


@query("""WITH f AS (SELECT doc_id, lang = 'es' AS skipped, lang = 'fr' AS bad, regexp_matches(text, 'the', 'is') AS hit, text FROM documents)
SELECT count(*) FILTER (WHERE NOT skipped) AS scanned, count(DISTINCT text) FILTER (WHERE hit AND NOT skipped) AS matched, count(*) FILTER (WHERE hit AND NOT skipped) - count(DISTINCT text) FILTER (WHERE hit AND NOT skipped) AS duplicates,
  count(*) FILTER (WHERE bad) AS unreadable, count(*) FILTER (WHERE doc_id % 2 = 0) AS cached, count(*) FILTER (WHERE doc_id % 2 = 1) AS "read", count(*) FILTER (WHERE skipped) AS skipped_links FROM f""")
def q_run_report(spark, sf_dir):
    """Documents as files: Spanish ones are links that are skipped, French ones cannot be read, equal texts are one file."""
    d = table(spark, sf_dir, "documents")
    scanned = d.select(F.when(F.col("lang") == "es", "symlink").alias("skipped"), F.when(F.col("lang") == "fr", "Bad: x").alias("error"), (F.col("doc_id") % 2 == 0).alias("cached"))
    matched = d.where((F.col("lang") != "es") & matches(F.col("text"), "the")).select("doc_id", F.sha2("text", 256).alias("target"))
    return scan.report({"scanned": scanned, "matched": matched, "results": match.distinct_targets(matched, "target", "doc_id")})


@query("SELECT lang AS kind, count(*) AS n FROM documents WHERE lang <> 'en' GROUP BY lang")
def q_skipped_kinds(spark, sf_dir):
    """Links that are not followed, by kind."""
    return scan.skipped_kinds({"scanned": table(spark, sf_dir, "documents").select(F.when(F.col("lang") != "en", F.col("lang")).alias("skipped"))})


from . import fixtures_queries  # noqa: E402,F401  (registers the queries over built files and graphs)
