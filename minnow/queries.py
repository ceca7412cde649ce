"""The registered queries of the engine's operators, each with its DuckDB form where SQL can express it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from minnow.catalog import Catalog, ForeignKey
from minnow.engine import Engine
from minnow.functions import text as X
from minnow.notes import TableNote
from minnow.operators import retrieval
from minnow.operators.search import search_test
from minnow.plans.planner import Limits, Policy
from minnow.plans.spec import Filter, Measure, QuerySpec
from minnow.sources.tables import key_violations, parquet_dir

Query = Callable[[SparkSession, str], DataFrame]

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "conversations")
PRIMARY_KEYS = {
    "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",),
    "orders": ("o_orderkey",), "documents": ("doc_id",), "labels": ("doc_id",), "events": ("event_id",), "conversations": ("conv_id", "turn"),
}
FOREIGN_KEYS = (
    ForeignKey("nation", ("n_regionkey",), "region"), ForeignKey("customer", ("c_nationkey",), "nation"), ForeignKey("supplier", ("s_nationkey",), "nation"),
    ForeignKey("orders", ("o_custkey",), "customer"), ForeignKey("lineitem", ("l_orderkey",), "orders"), ForeignKey("lineitem", ("l_partkey",), "part"),
    ForeignKey("lineitem", ("l_suppkey",), "supplier"), ForeignKey("labels", ("doc_id",), "documents"), ForeignKey("events", ("user_id",), "customer"),
)
NOW = dt.datetime(2024, 1, 31)
POLICY = Policy(frozenset({("customer", "c_acctbal")}), frozenset({("customer", "c_name")}))
CONCEPTS = {("orders", "open"): (Filter("o_orderstatus", "in", ("O", "P")),)}
MEASURES = {("orders", "revenue"): Measure("sum", "o_totalprice")}
SEARCHABLE = {"part": ("p_name",), "customer": ("c_name",)}
PURPOSES = {"orders": "Customer orders with their status and total price", "customer": "Customers and their market segment", "part": "Parts that can be ordered", "lineitem": "Positions of orders", "events": "What users did, and when"}
NOTES = {t: TableNote(purpose) for t, purpose in PURPOSES.items()}


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    return Catalog(parquet_dir(spark, sf_dir, list(TABLES)), PRIMARY_KEYS, FOREIGN_KEYS)


def engine(spark: SparkSession, sf_dir: str, **more) -> Engine:
    return Engine(spark, catalog(spark, sf_dir), now=lambda: NOW, concepts=CONCEPTS, measures=MEASURES, searchable=SEARCHABLE, notes=NOTES, limits=Limits(max_join_depth=3), **more)


def run_spec(spark: SparkSession, sf_dir: str, spec: dict, rounded: tuple[str, ...] = (), **more) -> DataFrame:
    """The plan's whole result; float sums and means are rounded, since their order of addition is open."""
    df = engine(spark, sf_dir, **more).plan_query(QuerySpec.of(spec), separator="__").df
    return df.withColumns({c: F.round(c, 2) for c in rounded}) if rounded else df


def filters(*tests: tuple) -> list[dict]:
    return [{"column": t[0], "op": t[1], **({"value": t[2]} if len(t) > 2 else {})} for t in tests]


def measure(fn: str, column: str | None = None, alias: str | None = None) -> dict:
    return {"fn": fn, **({"column": column} if column else {}), **({"alias": alias} if alias else {})}


ORDER_COLUMNS = ["o_orderkey", "o_orderstatus", "o_totalprice"]
#: name: (request, SQL, rounded outputs)
SPECS: dict[str, tuple[dict, str] | tuple[dict, str, tuple[str, ...]]] = {
    "scan_rows": ({"table": "customer"}, "SELECT * FROM customer"),
    "project_columns": ({"table": "orders", "columns": ["o_totalprice", "o_orderkey", "o_totalprice"]}, "SELECT o_totalprice, o_orderkey FROM orders"),
    "project_default": ({"table": "supplier"}, "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier"),
    "project_dotted": ({"table": "orders", "columns": ["o_orderkey", "customer.c_name"]}, "SELECT o_orderkey, c_name AS customer__c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey"),
    "filter_eq": ({"table": "orders", "columns": ORDER_COLUMNS, "filters": filters(("o_orderstatus", "eq", "O"))}, "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'O'"),
    "filter_ne": ({"table": "orders", "columns": ORDER_COLUMNS, "filters": filters(("o_orderstatus", "ne", "O"))}, "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'O'"),
    "filter_lt": ({"table": "part", "columns": ["p_partkey", "p_size"], "filters": filters(("p_size", "lt", 10))}, "SELECT p_partkey, p_size FROM part WHERE p_size < 10"),
    "filter_lte": ({"table": "part", "columns": ["p_partkey", "p_size"], "filters": filters(("p_size", "lte", 10))}, "SELECT p_partkey, p_size FROM part WHERE p_size <= 10"),
    "filter_gt": ({"table": "part", "columns": ["p_partkey", "p_retailprice"], "filters": filters(("p_retailprice", "gt", 905))}, "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice > 905"),
    "filter_gte": ({"table": "orders", "columns": ORDER_COLUMNS, "filters": filters(("o_orderdate", "gte", "2000-01-01"))}, "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01'"),
    "filter_in": ({"table": "orders", "columns": ORDER_COLUMNS, "filters": filters(("o_orderstatus", "in", ["P", "F"]))}, "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus IN ('P', 'F')"),
    "filter_not_in": ({"table": "documents", "columns": ["doc_id", "labels.quality"], "filters": filters(("labels.quality", "not_in", [0]))}, "SELECT documents.doc_id, quality AS labels__quality FROM documents LEFT JOIN labels USING (doc_id) WHERE quality NOT IN (0)"),
    "filter_between": ({"table": "lineitem", "columns": ["l_orderkey", "l_linenumber", "l_quantity"], "filters": filters(("l_quantity", "between", [10, 12]))}, "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 12"),
    "filter_contains": ({"table": "part", "columns": ["p_partkey", "p_name"], "filters": filters(("p_name", "contains", "ANV"))}, "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'anv')"),
    "filter_starts_with": ({"table": "part", "columns": ["p_partkey", "p_name"], "filters": filters(("p_name", "starts_with", "Bl"))}, "SELECT p_partkey, p_name FROM part WHERE starts_with(lower(p_name), 'bl')"),
    "filter_is_null": ({"table": "documents", "columns": ["doc_id", "labels.quality"], "filters": filters(("labels.quality", "is_null"))}, "SELECT documents.doc_id, quality AS labels__quality FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL"),
    "filter_not_null": ({"table": "documents", "columns": ["doc_id", "labels.quality"], "filters": filters(("labels.quality", "not_null"))}, "SELECT documents.doc_id, quality AS labels__quality FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL"),
    "filter_since_days": ({"table": "events", "columns": ["event_id", "event_type"], "filters": filters(("ts", "since_days", 7))}, "SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-24 00:00:00'"),
    "filter_conjunction": ({"table": "orders", "columns": ORDER_COLUMNS, "filters": filters(("o_orderstatus", "eq", "F"), ("o_totalprice", "gt", 50000), ("o_orderpriority", "starts_with", "1"))}, "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 50000 AND starts_with(o_orderpriority, '1')"),
    "concept_filter": ({"table": "orders", "columns": ORDER_COLUMNS, "concepts": ["open"]}, "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus IN ('O', 'P')"),
    "join_to_one": ({"table": "orders", "columns": ["o_orderkey", "customer.c_mktsegment"]}, "SELECT o_orderkey, c_mktsegment AS customer__c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey"),
    "join_two_hop": ({"table": "orders", "columns": ["o_orderkey", "customer.nation.n_name"]}, "SELECT o_orderkey, n_name AS customer__nation__n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey"),
    "join_three_hop": ({"table": "orders", "group_by": ["customer.nation.region.r_name"], "measures": [measure("count")]}, "SELECT r_name AS customer__nation__region__r_name, count(*) AS count FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "join_reuse": ({"table": "orders", "columns": ["o_orderkey", "customer.c_name", "customer.c_mktsegment"], "filters": filters(("customer.c_mktsegment", "eq", "BUILDING"))}, "SELECT o_orderkey, c_name AS customer__c_name, c_mktsegment AS customer__c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'"),
    "join_to_many": ({"table": "orders", "columns": ["o_orderkey", "lineitem.l_linenumber", "lineitem.l_quantity"]}, "SELECT o_orderkey, l_linenumber AS lineitem__l_linenumber, l_quantity AS lineitem__l_quantity FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey"),
    "join_role_playing": ({"table": "lineitem", "group_by": ["orders.customer.nation.n_name", "supplier.nation.n_name"], "measures": [measure("count")]}, "SELECT a.n_name AS orders__customer__nation__n_name, b.n_name AS supplier__nation__n_name, count(*) AS count FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation a ON c_nationkey = a.n_nationkey LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation b ON s_nationkey = b.n_nationkey GROUP BY 1, 2"),
    "join_filter": ({"table": "orders", "columns": ["o_orderkey", "customer.c_name"], "filters": filters(("customer.nation.n_nationkey", "lte", 3))}, "SELECT o_orderkey, c_name AS customer__c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE c_nationkey <= 3"),
    "join_unmatched": ({"table": "documents", "columns": ["doc_id", "lang"], "filters": filters(("labels.doc_id", "is_null"))}, "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "agg_count": ({"table": "orders", "group_by": ["o_orderstatus"], "measures": [measure("count")]}, "SELECT o_orderstatus, count(*) AS count FROM orders GROUP BY 1"),
    "agg_count_col": ({"table": "documents", "group_by": ["lang"], "measures": [measure("count", "labels.quality")]}, "SELECT lang, count(quality) AS count_labels_quality FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1"),
    "agg_count_distinct": ({"table": "orders", "group_by": ["o_orderstatus"], "measures": [measure("count_distinct", "o_custkey")]}, "SELECT o_orderstatus, count(DISTINCT o_custkey) AS count_distinct_o_custkey FROM orders GROUP BY 1"),
    "agg_sum": ({"table": "orders", "group_by": ["o_orderstatus"], "measures": [measure("sum", "o_totalprice")]}, "SELECT o_orderstatus, round(sum(o_totalprice), 2) AS sum_o_totalprice FROM orders GROUP BY 1", ("sum_o_totalprice",)),
    "agg_avg": ({"table": "part", "group_by": ["p_brand"], "measures": [measure("avg", "p_retailprice")]}, "SELECT p_brand, round(avg(p_retailprice), 2) AS avg_p_retailprice FROM part GROUP BY 1", ("avg_p_retailprice",)),
    "agg_min": ({"table": "part", "group_by": ["p_brand"], "measures": [measure("min", "p_name"), measure("min", "p_size")]}, "SELECT p_brand, min(p_name) AS min_p_name, min(p_size) AS min_p_size FROM part GROUP BY 1"),
    "agg_max": ({"table": "part", "group_by": ["p_brand"], "measures": [measure("max", "p_name"), measure("max", "p_retailprice")]}, "SELECT p_brand, max(p_name) AS max_p_name, max(p_retailprice) AS max_p_retailprice FROM part GROUP BY 1"),
    "named_measure": ({"table": "orders", "group_by": ["o_orderpriority"], "measures": [measure("measure", "revenue")]}, "SELECT o_orderpriority, round(sum(o_totalprice), 2) AS revenue FROM orders GROUP BY 1", ("revenue",)),
    "agg_global": ({"table": "lineitem", "measures": [measure("count"), measure("max", "l_quantity"), measure("count_distinct", "l_suppkey")]}, "SELECT count(*) AS count, max(l_quantity) AS max_l_quantity, count(DISTINCT l_suppkey) AS count_distinct_l_suppkey FROM lineitem"),
    "agg_group_one": ({"table": "events", "group_by": ["event_type"], "measures": [measure("count"), measure("min", "value")]}, "SELECT event_type, count(*) AS count, min(value) AS min_value FROM events GROUP BY 1"),
    "agg_group_two": ({"table": "lineitem", "group_by": ["l_returnflag", "l_linestatus"], "measures": [measure("sum", "l_quantity"), measure("count")]}, "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_l_quantity, count(*) AS count FROM lineitem GROUP BY 1, 2", ("sum_l_quantity",)),
    "agg_group_joined": ({"table": "orders", "group_by": ["customer.c_mktsegment"], "measures": [measure("sum", "o_totalprice", "revenue")], "filters": filters(("o_orderstatus", "in", ["O", "P"])), "order": [{"by": "revenue", "direction": "desc"}]}, "SELECT c_mktsegment AS customer__c_mktsegment, round(sum(o_totalprice), 2) AS revenue FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus IN ('O', 'P') GROUP BY 1", ("revenue",)),
    "distinct_values": ({"table": "customer", "group_by": ["c_mktsegment", "nation.n_name"]}, "SELECT DISTINCT c_mktsegment, n_name AS nation__n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey"),
    "agg_fanout": ({"table": "orders", "group_by": ["o_orderstatus"], "measures": [measure("sum", "o_totalprice"), measure("count", "lineitem.l_linenumber")]}, "SELECT o_orderstatus, round(sum(o_totalprice), 2) AS sum_o_totalprice, count(l_linenumber) AS count_lineitem_l_linenumber FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1", ("sum_o_totalprice",)),
    "order_by": ({"table": "part", "columns": ["p_partkey", "p_size"], "order": [{"by": "p_size", "direction": "desc"}, {"by": "p_name"}]}, "SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_name, p_partkey"),
    "order_default_pk": ({"table": "nation", "columns": ["n_name"]}, "SELECT n_name FROM nation ORDER BY n_nationkey"),
    "order_grouped_default": ({"table": "customer", "group_by": ["c_mktsegment"], "measures": [measure("count")]}, "SELECT c_mktsegment, count(*) AS count FROM customer GROUP BY 1 ORDER BY 2 DESC, 1"),
}

POLICY_SPECS = {
    "policy_default": ({"table": "customer"}, "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer"),
}

#: Soundex in SQL: the letters' digits (0 for vowels; H and W behind the first letter stand for nothing), equal neighbours once.
CODES = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230120022455012623010202')"


def soundex_sql(word: str) -> str:
    letters = f"regexp_replace(upper({word}), '[^A-Z]', '', 'g')"
    digits = CODES.format(f"(left({letters}, 1) || regexp_replace(substr({letters}, 2), '[HW]', '', 'g'))")
    for d in "123456":
        digits = f"regexp_replace({digits}, '{d}+', '{d}', 'g')"
    return f"(CASE WHEN {letters} <> '' THEN left({letters}, 1) || left(replace(substr({digits}, 2), '0', '') || '000', 3) END)"


#: The codes of a part's words, that of the word looked for, and equal places of a code c with it.
SOUNDS = f"list_transform(list_filter(string_split(p_name, ' '), lambda w: w <> ''), lambda w: {soundex_sql('w')})"
ANVUL = soundex_sql("'anvul'")
ALIKE = "(" + " + ".join(f"CAST(substr(c, {i}, 1) = substr({ANVUL}, {i}, 1) AS INTEGER)" for i in (1, 2, 3, 4)) + ")"
SEARCHES = {
    "search_exact": (("blue anvil",), ("exact",), "all", "p_name = 'blue anvil'"),
    "search_prefix": (("blu",), ("prefix",), "all", "starts_with(lower(p_name), 'blu')"),
    "search_contains": (("NVI",), ("contains",), "all", "contains(lower(p_name), 'nvi')"),
    "search_levenshtein": (("anvul",), ("levenshtein",), "all", "len(list_filter(string_split(lower(p_name), ' '), lambda w: w <> '' AND levenshtein(w, 'anvul') <= 2)) > 0"),
    "search_fulltext": (("anvil",), ("fulltext",), "all", "list_contains(string_split(lower(p_name), ' '), 'anvil')"),
    "search_soundex": (("anvul",), ("soundex",), "all", "list_contains({sounds}, {anvul})"),
    "search_difference": (("anvul",), ("difference",), "all", "len(list_filter({sounds}, lambda c: {alike} >= 3)) > 0"),
    "search_all": (("blue", "anv"), ("contains",), "all", "contains(lower(p_name), 'blue') AND contains(lower(p_name), 'anv')"),
    "search_any": (("blue", "anv"), ("contains",), "any", "contains(lower(p_name), 'blue') OR contains(lower(p_name), 'anv')"),
}

TRIGRAM_SQL = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
SIMILARITY_SQL = f"(SELECT p_partkey, p_name, len(list_intersect(x, y)) AS common, len(x) + len(y) - len(list_intersect(x, y)) AS either FROM (SELECT p_partkey, p_name, {TRIGRAM_SQL.format('p_name')} AS x, {TRIGRAM_SQL.format(chr(39) + 'blu anvil' + chr(39))} AS y FROM part))"
LEVENSHTEIN_MIN_SQL = "coalesce(list_min(list_transform(list_filter(string_split(lower(p_name), ' '), lambda w: w <> ''), lambda w: levenshtein(w, 'anvul'))), 1000000)"
BM25_TERMS = ("the", "ertion")
BM25_SQL = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: t <> '') AS w FROM documents),
c AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda t: t = 'the')) AS a, len(list_filter(w, lambda t: t = 'ertion')) AS b FROM d),
s AS (SELECT count(*) AS nd, avg(n) AS av, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM c)
SELECT doc_id, round(ln(1 + (nd - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / av)) + ln(1 + (nd - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / av)), 6) AS score
FROM c, s WHERE a > 0 OR b > 0
"""
VALUE_COLUMNS = {"orders": ["o_orderstatus", "o_orderpriority"], "customer": ["c_mktsegment"], "events": ["event_type"], "part": ["p_name"]}


#: The words of a text, as the tokenizer splits them, in SQL.
WORDS_SQL = r"list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda t: len(t) >= 2 AND t NOT IN ({1}))"
SINGULAR_SQL = "CASE WHEN ends_with(t, 'ies') AND len(t) > 4 THEN left(t, len(t) - 3) || 'y' WHEN ends_with(t, 'sses') THEN left(t, len(t) - 2) WHEN ends_with(t, 's') AND NOT ends_with(t, 'ss') AND len(t) > 3 THEN left(t, len(t) - 1) ELSE t END"


def tokens_sql(text: str) -> str:
    return f"list_transform({WORDS_SQL.format(text, ', '.join(repr(w) for w in X.STOPWORDS))}, lambda t: {SINGULAR_SQL})"


TOKENIZE_SQL = f"SELECT p_partkey, array_to_string({tokens_sql(chr(40) + 'p_name || ' + repr(' HTTPServers boxesOf classes parties') + chr(41))}, ' ') AS tokens FROM part"
#: Names that hold each of two words by part, sound, edits or trigrams of a word.
SEARCH_WORD = "(contains(lower(p_name), '{0}') OR list_contains({1}, {2}) OR coalesce(list_min(list_transform(list_filter(string_split(lower(p_name), ' '), lambda w: w <> ''), lambda w: levenshtein(w, '{0}'))), 99) <= 2 OR len(list_intersect({3}, {4})) / greatest(len({3}) + len({4}) - len(list_intersect({3}, {4})), 1) >= 0.3)"
SEARCH_SQL = "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part WHERE " + " AND ".join(SEARCH_WORD.format(w, SOUNDS, soundex_sql(repr(w)), TRIGRAM_SQL.format("p_name"), TRIGRAM_SQL.format(repr(w))) for w in ("blu", "anvul"))
MATCHED = "which building customers had an urgent click on blue anvil"
MATCH_SQL = f"""
, q AS (SELECT unnest({tokens_sql(repr(MATCHED))}) AS t),
v AS (SELECT "table", "column", value, lower(value) AS low, {tokens_sql('value')} AS w FROM i),
g AS (
  SELECT "table", "column", value, max(CASE
    WHEN len(value) >= 4 AND contains(value, ' ') AND contains('{MATCHED}', low) THEN 4
    WHEN t = low OR len(w) = 1 AND t = w[1] THEN 3 WHEN len(t) >= 4 AND starts_with(low, t) THEN 2
    WHEN len(t) >= 5 AND levenshtein(t, w[1]) = 1 THEN 1 ELSE 0 END) AS quality FROM v, q GROUP BY ALL
) SELECT "table", "column", value, CAST(quality AS BIGINT) AS quality FROM g WHERE quality > 0 ORDER BY quality DESC, "table", "column", value LIMIT 10"""
#: Both directions of the declared keys, and what a question about open orders of the building segment is given.
RELATED = [
    ("nation", "region", "region", "to_one"), ("region", "nation", "nation", "to_many"), ("customer", "nation", "nation", "to_one"), ("nation", "customer", "customer", "to_many"),
    ("supplier", "nation", "nation", "to_one"), ("nation", "supplier", "supplier", "to_many"), ("orders", "customer", "customer", "to_one"), ("customer", "orders", "orders", "to_many"),
    ("lineitem", "orders", "orders", "to_one"), ("orders", "lineitem", "lineitem", "to_many"), ("lineitem", "part", "part", "to_one"), ("part", "lineitem", "lineitem", "to_many"),
    ("lineitem", "supplier", "supplier", "to_one"), ("supplier", "lineitem", "lineitem", "to_many"), ("labels", "documents", "documents", "to_one"), ("documents", "labels", "labels", "to_many"),
    ("events", "customer", "customer", "to_one"), ("customer", "events", "events", "to_many"),
]
CONTEXT = [*(("card", i, t) for i, t in enumerate(("customer", "orders", "lineitem", "nation", "events"))), *(("line", i, t) for i, t in enumerate(("part", "supplier", "region")))]


def one(name: str):
    def read(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    return read


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [retrieval.value_index(one(t)(spark, sf_dir), t, c, cap=50, samples=3) for t, c in VALUE_COLUMNS.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def value_index_sql(name: str = "") -> str:
    """The index as a statement, or as the last of some named subqueries."""
    pairs = " UNION ALL ".join(f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", {c} AS value FROM {t} WHERE {c} IS NOT NULL" for t, cs in VALUE_COLUMNS.items() for c in cs)
    last = 'SELECT "table", "column", substr(value, 1, 80) AS value, n, rank, k <= 50 AS complete FROM r WHERE k <= 50 OR rank <= 3'
    return f"""
WITH p AS ({pairs}), n AS (SELECT "table", "column", value, count(*) AS n FROM p GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY "table", "column" ORDER BY n DESC, value) AS rank, count(*) OVER (PARTITION BY "table", "column") AS k FROM n)
{f", {name} AS ({last})" if name else last}
"""


def search(spark: SparkSession, sf_dir: str, words: tuple[str, ...], strategies: tuple[str, ...], match: str) -> DataFrame:
    return one("part")(spark, sf_dir).filter(search_test({"p_name": F.col("p_name")}, words, strategies, match)).select("p_partkey", "p_name")


def trigram(spark: SparkSession, sf_dir: str, least: float | None) -> DataFrame:
    df = one("part")(spark, sf_dir).select("p_partkey", "p_name", X.trigram_similarity(F.col("p_name"), F.lit("blu anvil")).alias("similarity"))
    return df.select("p_partkey", F.round("similarity", 6).alias("similarity")) if least is None else df.filter(F.col("similarity") >= least).select("p_partkey", "p_name")


def composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = parquet_dir(spark, sf_dir, ["conversations"])
    frames["turns"] = frames["conversations"]().select("conv_id", "turn", F.char_length("text").cast("long").alias("n_chars"))
    c = Catalog(frames, {"conversations": ("conv_id", "turn"), "turns": ("conv_id", "turn")}, (ForeignKey("conversations", ("conv_id", "turn"), "turns"),))
    return Engine(spark, c).plan_query({"table": "conversations", "columns": ["conv_id", "turn", "role", "turns.n_chars"]}, separator="__").df


def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25(one("documents")(spark, sf_dir), "doc_id", list(BM25_TERMS), {"text": 1.0}, X.plain_tokens).withColumn("score", F.round("score", 6))


def vector_zero(spark: SparkSession, sf_dir: str) -> list[float]:
    return [float(x) for x in one("embeddings")(spark, sf_dir).filter("vec_id = 0").first()["embedding"]]


def cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.cosine_topk(one("embeddings")(spark, sf_dir), "vec_id", "embedding", vector_zero(spark, sf_dir), 10)
    return found.withColumn("score", F.round("score", 6))


def fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = one("orders")(spark, sf_dir)
    by = lambda a: orders.groupBy("o_orderpriority").agg(a.alias("score")).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "o_orderpriority")))
    return retrieval.fuse([(by(F.count("*")), 1.0), (by(F.max("o_totalprice")), 1.5)], "o_orderpriority").withColumn("score", F.round("score", 9))


def introspect(spark: SparkSession, sf_dir: str, columns: bool) -> DataFrame:
    c = catalog(spark, sf_dir)
    if columns:
        rows = [(t.name, i, x.name, x.kind.value, x.data_type, x.nullable, t.primary_key.index(x.name) + 1 if x.name in t.primary_key else 0) for t in c.tables.values() for i, x in enumerate(t.columns)]
        return spark.createDataFrame(rows, "table string, position int, column string, kind string, type string, nullable boolean, key_position int")
    return spark.createDataFrame([(t.name, len(t.columns), ",".join(t.primary_key)) for t in c.tables.values()], "table string, columns int, primary_key string")


def values_sql(rows: list[tuple], names: str) -> str:
    text = ", ".join("(" + ", ".join("NULL" if x is None else str(x).lower() if isinstance(x, (bool, int)) else "'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)
    return f"(VALUES {text}) AS v({names})"


def listed_sql(fields: str, more: str = "") -> str:
    """fields over the columns of the registered tables, as DuckDB knows them."""
    keys = values_sql([(t, c, i + 1) for t, k in PRIMARY_KEYS.items() for i, c in enumerate(k)], "kt, kc, kp")
    tables = values_sql([(t, PURPOSES.get(t, "")) for t in TABLES], "tt, purpose")
    kinds = "CASE WHEN data_type IN ('INTEGER', 'BIGINT') THEN 'integer' WHEN data_type = 'DOUBLE' THEN 'float' WHEN data_type LIKE 'TIMESTAMP%' THEN 'datetime' ELSE 'text' END"
    types = "CASE data_type WHEN 'INTEGER' THEN 'int' WHEN 'BIGINT' THEN 'bigint' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP WITH TIME ZONE' THEN 'timestamp' ELSE 'timestamp_ntz' END"
    return f"""
WITH c AS (
  SELECT DISTINCT table_name, column_name, CAST(ordinal_position AS INTEGER) - 1 AS position, {kinds} AS kind, {types} AS type, coalesce(kp, 0) AS key_position, purpose
  FROM information_schema.columns JOIN {tables} ON table_name = tt LEFT JOIN {keys} ON table_name = kt AND column_name = kc
) SELECT {fields} FROM c {more}"""


def policed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a caller gets for each column of customer, under POLICY, by path from orders: hidden is as good as unknown."""
    e = engine(spark, sf_dir, policy=POLICY)
    asked = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment", "c_nothing"]
    answers = [(c, e.dispatch("query", {"table": "orders", "columns": [f"customer.{c}"], "limit": 3})) for c in asked]
    return spark.createDataFrame([(c, a["error"]["type"] if "error" in a else f"{len(a['rows'])} rows") for c, a in answers], "column string, answer string")


POLICED = [("c_custkey", "3 rows"), ("c_name", "SensitiveColumnError"), ("c_nationkey", "3 rows"), ("c_acctbal", "UnknownColumnError"), ("c_mktsegment", "3 rows"), ("c_nothing", "UnknownColumnError")]


def related(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(r.source, r.name, r.target, "to_many" if r.to_many else "to_one") for r in catalog(spark, sf_dir).relationships]
    return spark.createDataFrame(rows, "source string, name string, target string, cardinality string")


def integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    out = None
    for k in c.foreign_keys:
        row = key_violations(c.tables[k.table].frame, k.columns, c.tables[k.target].frame, k.target_columns).select(F.lit(f"{k.table}.{k.columns[0]}").alias("key"), "orphans", "repeated_keys")
        out = row if out is None else out.union(row)
    return out


def integrity_sql() -> str:
    keys = {t: k[0] for t, k in PRIMARY_KEYS.items()}
    one_key = lambda k: f"SELECT '{k.table}.{k.columns[0]}' AS key, (SELECT count(*) FROM {k.table} a WHERE a.{k.columns[0]} IS NOT NULL AND a.{k.columns[0]} NOT IN (SELECT {keys[k.target]} FROM {k.target})) AS orphans, (SELECT count(*) FROM (SELECT {keys[k.target]} FROM {k.target} GROUP BY 1 HAVING count(*) > 1)) AS repeated_keys"
    return " UNION ALL ".join(map(one_key, FOREIGN_KEYS))


def scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scope uses a hidden column and a joined one; the caller sees neither."""
    scope = lambda t: (Filter("c_acctbal", "gt", 0), Filter("nation.n_regionkey", "lte", 2)) if t == "customer" else ()
    return engine(spark, sf_dir, policy=POLICY, scope=scope).plan_query({"table": "customer", "group_by": ["c_mktsegment"], "measures": [measure("count")]}, separator="__").df


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = engine(spark, sf_dir).dispatch("list_tables", {})["tables"]
    return spark.createDataFrame([(r["table"], r["purpose"], r["columns"]) for r in rows], "table string, purpose string, columns int")


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The card of orders: a row for each column, relationship, concept and measure."""
    card = engine(spark, sf_dir).dispatch("describe_table", {"table": "orders"})
    rows = [("column", c["name"], f"{c['kind']}{' key' if c.get('key') else ''}{' -> ' + c['references'] if 'references' in c else ''}") for c in card["columns"]]
    rows += [("relationship", r["name"], f"{r['table']}{' many' if r.get('many') else ''}") for r in card["relationships"]]
    rows += [(part, x["name"], "") for part in ("concept", "measure") for x in card[f"{part}s"]]
    return spark.createDataFrame(rows, "part string, name string, says string")


DESCRIBED = "SELECT 'column' AS part, column_name AS name, kind || CASE WHEN key_position > 0 THEN ' key' WHEN column_name = 'o_custkey' THEN ' -> customer.c_custkey' ELSE '' END AS says FROM c WHERE table_name = 'orders' UNION ALL SELECT * FROM (VALUES ('relationship', 'customer', 'customer'), ('relationship', 'lineitem', 'lineitem many'), ('concept', 'open', ''), ('measure', 'revenue', ''))"
QUESTION = "Which customers in the building segment have open orders?"


def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables with a card, in order of their rank, and tables with a line only."""
    found = engine(spark, sf_dir).dispatch("get_context", {"question": QUESTION})
    rows = [(part, i, t["table"]) for part, key in (("card", "tables"), ("line", "also")) for i, t in enumerate(found[key])]
    return spark.createDataFrame(rows, "part string, position int, says string")


def capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.limits = Limits(max_columns=3)
    return e.plan_query({"table": "orders"}).df


def limited(spark: SparkSession, sf_dir: str, spec: dict, more: int) -> DataFrame:
    plan = engine(spark, sf_dir).plan_query(spec, separator="__")
    return plan.df.limit(plan.limit + more)


def words(spark: SparkSession, sf_dir: str, **columns) -> DataFrame:
    return one("part")(spark, sf_dir).select("p_partkey", *(c.alias(n) for n, c in columns.items()))


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for key, (spec, _, *rounded) in SPECS.items():
        found[key] = partial(run_spec, spec=spec, rounded=rounded[0] if rounded else ())
    for key, (spec, _) in POLICY_SPECS.items():
        found[key] = partial(run_spec, spec=spec, policy=POLICY)
    for key, (terms, strategies, match, _) in SEARCHES.items():
        found[key] = partial(search, words=terms, strategies=strategies, match=match)
    price = {"table": "orders", "columns": ["o_orderkey", "o_totalprice"], "order": [{"by": "o_totalprice", "direction": "desc"}], "limit": 20}
    found |= {
        "introspect_tables": partial(introspect, columns=False),
        "introspect_columns": partial(introspect, columns=True),
        "relationships": related,
        "fk_integrity": integrity,
        "join_composite": composite,
        "project_capped": capped,
        "scope_filter": scoped,
        "topk": partial(limited, spec=price, more=0),
        "truncation_probe": partial(limited, spec={"table": "orders", "columns": ["o_orderkey"]}, more=1),
        "keyset_page": partial(limited, spec={"table": "orders", "columns": ["o_orderkey", "o_totalprice"], "filters": filters(("o_orderkey", "gt", 500)), "limit": 25}, more=0),
        "search_trigram": partial(trigram, least=0.3),
        "trigram_similarity": partial(trigram, least=None),
        "search_rows_default": lambda s, d: engine(s, d).plan_search("part", "blu anvul").df,
        "soundex_code": lambda s, d: words(s, d, code=X.soundex(F.col("p_name"))),
        "soundex_any": lambda s, d: words(s, d, found=X.soundex_any(F.col("p_name"), F.lit("anvul"))),
        "difference_score": lambda s, d: words(s, d, score=X.difference(F.get(F.split("p_name", " "), F.lit(1)), F.lit("anvul"))),
        "levenshtein_distance": lambda s, d: words(s, d, distance=X.distance(F.col("p_name"), F.lit("blue anvil")).cast("long"), bounded=X.distance(F.col("p_name"), F.lit("blue anvil"), 3).cast("long")),
        "levenshtein_min": lambda s, d: words(s, d, distance=X.distance_min(F.col("p_name"), F.lit("Anvul")).cast("long")),
        "levenshtein_within": lambda s, d: one("part")(s, d).filter(F.levenshtein("p_name", F.lit("blue anvil"), 4).between(0, 4)).select("p_partkey", "p_name"),
        "fulltext_match": lambda s, d: one("documents")(s, d).filter(F.array_contains(X.tokens(F.col("text")), "ertion")).select("doc_id"),
        "tokenize": lambda s, d: one("part")(s, d).select("p_partkey", F.array_join(X.tokens(F.concat("p_name", F.lit(" HTTPServers boxesOf classes parties"))), " ").alias("tokens")),
        "bm25_documents": bm25,
        "value_index": index,
        "value_match": lambda s, d: retrieval.value_match(index(s, d), "which building customers had an urgent click on blue anvil"),
        "nearest_values": lambda s, d: retrieval.nearest_values(index(s, d), "customer", "c_mktsegment", "BILDING"),
        "cosine_topk": cosine,
        "rrf_fusion": fusion,
        "policy_hidden": policed,
        "cmd_list_tables": listed,
        "cmd_describe_table": described,
        "cmd_get_context": context,
    }
    return found


def oracle_sql() -> dict[str, str]:
    found = {k: v[1] for k, v in (SPECS | POLICY_SPECS).items()}
    in_sql = {"sounds": SOUNDS, "anvul": ANVUL, "alike": ALIKE}
    found |= {k: f"SELECT p_partkey, p_name FROM part WHERE {where.format(**in_sql)}" for k, (_, _, _, where) in SEARCHES.items()}
    return found | {
        "introspect_tables": listed_sql("table_name AS \"table\", CAST(count(*) AS INTEGER) AS columns, coalesce(string_agg(column_name, ',' ORDER BY key_position) FILTER (key_position > 0), '') AS primary_key", "GROUP BY 1"),
        "introspect_columns": listed_sql('table_name AS "table", position, column_name AS "column", kind, type, true AS nullable, key_position'),
        "relationships": f"SELECT * FROM {values_sql(RELATED, 'source, name, target, cardinality')}",
        "policy_hidden": f'SELECT * FROM {values_sql(POLICED, chr(34) + "column" + chr(34) + ", answer")}',
        "cmd_list_tables": listed_sql('table_name AS "table", purpose, CAST(count(*) AS INTEGER) AS columns', "GROUP BY 1, 2"),
        "cmd_describe_table": f"{listed_sql('*').rpartition(' SELECT')[0]} {DESCRIBED}",
        "cmd_get_context": f"SELECT * FROM {values_sql(CONTEXT, 'part, position, says')}",
        "soundex_code": f"SELECT p_partkey, {soundex_sql('p_name')} AS code FROM part",
        "soundex_any": f"SELECT p_partkey, list_contains({SOUNDS}, {ANVUL}) AS found FROM part",
        "difference_score": f"SELECT p_partkey, CAST({ALIKE} AS INTEGER) AS score FROM (SELECT p_partkey, {soundex_sql('string_split(p_name, chr(32))[2]')} AS c FROM part)",
        "tokenize": TOKENIZE_SQL,
        "search_rows_default": SEARCH_SQL,
        "value_match": f"{value_index_sql('i')} {MATCH_SQL}",
        "nearest_values": f"{value_index_sql('i')} SELECT value, CAST(d AS BIGINT) AS distance FROM (SELECT value, CASE WHEN contains(lower(value), 'bilding') THEN 0 ELSE levenshtein(lower(value), 'bilding') END AS d FROM i WHERE \"table\" = 'customer' AND \"column\" = 'c_mktsegment') WHERE d <= 2 ORDER BY d, value LIMIT 5",
        "fk_integrity": integrity_sql(),
        "join_composite": "SELECT conv_id, turn, role, CAST(length(text) AS BIGINT) AS turns__n_chars FROM conversations",
        "project_capped": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders",
        "scope_filter": "SELECT c_mktsegment, count(*) AS count FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 AND n_regionkey <= 2 GROUP BY 1",
        "topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
        "truncation_probe": "SELECT o_orderkey FROM orders ORDER BY 1 LIMIT 51",
        "keyset_page": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 500 ORDER BY 1 LIMIT 25",
        "search_trigram": f"SELECT p_partkey, p_name FROM {SIMILARITY_SQL} WHERE common / either >= 0.3",
        "trigram_similarity": f"SELECT p_partkey, round(common / either, 6) AS similarity FROM {SIMILARITY_SQL}",
        "levenshtein_distance": "SELECT p_partkey, levenshtein(p_name, 'blue anvil') AS distance, least(levenshtein(p_name, 'blue anvil'), 4) AS bounded FROM part",
        "levenshtein_min": f"SELECT p_partkey, {LEVENSHTEIN_MIN_SQL} AS distance FROM part",
        "levenshtein_within": "SELECT p_partkey, p_name FROM part WHERE levenshtein(p_name, 'blue anvil') <= 4",
        "fulltext_match": f"SELECT doc_id FROM documents WHERE list_contains({tokens_sql('text')}, 'ertion')",
        "bm25_documents": BM25_SQL,
        "value_index": value_index_sql(),
        "cosine_topk": "SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score FROM embeddings a, embeddings q WHERE q.vec_id = 0 ORDER BY list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) DESC, a.vec_id LIMIT 10",
        "rrf_fusion": "WITH g AS (SELECT o_orderpriority, count(*) AS n, max(o_totalprice) AS m FROM orders GROUP BY 1), r AS (SELECT o_orderpriority, row_number() OVER (ORDER BY n DESC, o_orderpriority) AS a, row_number() OVER (ORDER BY m DESC, o_orderpriority) AS b FROM g) SELECT o_orderpriority, round(1.0 / (60 + a) + 1.5 / (60 + b), 9) AS score FROM r",
    }
