"""Queries over the generated tables, one for each operator, and the same in DuckDB SQL.

Roles: ``part`` is the price list (two lists by parity of the key), parts with their quantities from ``lineitem`` are
the inventory, ``documents`` are texts, ``events`` stand for rows on pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import attributes, numbers, similarity, text
from ..functions import vocabulary as V
from ..operators import candidates, clean, decide, layout, merge, results, score
from ..sources.config import load_config
from . import resolve

QUERIES: dict = {}
ORACLE_SQL: dict = {}
CFG = load_config(over={"restrict_to_price_list_brands": False, "min_valid_price": 905, "max_valid_price": 100000})
BRANDS = {f"Brand#{i}": [f"B{i}"] for i in range(25, 0, -1)}
SYNONYMS = {"red": "crimson", "small ring": "tiny circle", "bolt": "screw"}
RULES = [{"when": ["blue", "gear"], "add": ["azure cog", "teeth"]}, {"when": ["hot"], "add": ["warm"]}]
TERMS = ["red", "blue", "hot", "ring"]

# The same roles and text steps in SQL.
NORM = r"trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
GLUE = r"regexp_replace(regexp_replace({0}, '([a-z])[\s\-_/]+([0-9])', '\1\2', 'g'), '([0-9])[\s\-_/]+([a-z])', '\1\2', 'g')"


# Fixed values of the vocabulary as nested SQL functions.
GLYPHS_SQL = "translate({{0}}, '{}', '{}')".format("".join(k for k, v in V.GLYPHS.items() if len(k) == len(v) == 1), "".join(v for k, v in V.GLYPHS.items() if len(k) == len(v) == 1))
GLYPH_NAME = "translate(p_name, 'abcd', '{}')".format("".join(list(V.GLYPHS)[:4]))
_ONE = {k: v for k, v in V.LETTERS.items() if len(k) == 1}
LETTERS_SQL = "regexp_replace(translate({{0}}, '{}', '{}'), '{}', '', 'g')".format("".join([k for k, v in _ONE.items() if v] + [k for k, v in _ONE.items() if not v]), "".join(v for v in _ONE.values() if v), V.MARKS)


def norm_sql(column: str) -> str:
    return GLUE.format(NORM.format(column))


PRICES_SQL = f"""
prices AS (
  SELECT p_partkey AS price_id, (p_partkey % 2)::INT AS list_ord, p_type || '-' || p_size AS code, p_retailprice AS price,
    regexp_replace(upper(p_type || '-' || p_size), '[^0-9A-Z]', '', 'g') AS code_key, p_type AS family,
    {norm_sql("p_name || ' ' || p_size || ' w'")} AS context,
    replace({norm_sql("p_type || '-' || p_size || '  ' || p_brand || ' ' || p_name || ' ' || p_size || ' w'")}, ' ', '') AS packed
  FROM part),
valid AS (SELECT * FROM prices WHERE price BETWEEN 905 AND 100000 AND (code_key <> '' OR context <> '')),
kept AS (SELECT * FROM valid QUALIFY row_number() OVER (PARTITION BY list_ord, code_key ORDER BY price_id) = 1)"""
ITEMS_SQL = f"""
named AS (
  SELECT p_partkey AS item_id, p_partkey::VARCHAR AS code, stock,
    p_name || ' ' || p_size || ' w ' || p_brand || CASE WHEN p_partkey % 3 = 0 THEN ' (' || p_type || '-' || p_size || ')' ELSE '' END AS name
  FROM part LEFT JOIN (SELECT l_partkey, sum(l_quantity) AS stock FROM lineitem GROUP BY 1) ON l_partkey = p_partkey),
spelled AS (SELECT *, [regexp_replace(upper(x), '[^0-9A-Z]', '', 'g') for x in regexp_extract_all(name, '[A-Za-z]{{2,}}[A-Za-z0-9]*(?:[-/][A-Za-z0-9]+)*')] AS raw FROM named),
items AS (SELECT * EXCLUDE (raw), list_filter(raw, lambda x, i: length(x) >= 3 AND x <> 'NEW' AND list_position(raw, x) = i) AS codes FROM spelled),
keyed AS (SELECT *, {norm_sql("name")} AS norm FROM items),
words AS (SELECT item_id, string_split(norm, ' ') AS w FROM keyed),
tokens AS (
  SELECT DISTINCT item_id, token FROM (
    SELECT item_id, unnest(w) AS token FROM words
    UNION ALL SELECT item_id, unnest([w[i] || w[i + 1] for i in range(1, len(w))]) FROM words)
  WHERE length(token) >= 3)"""
POSTINGS_SQL = """
postings AS (SELECT list_ord, token, price_id FROM (SELECT DISTINCT token FROM tokens) JOIN kept ON contains(packed, token)),
weights AS (
  SELECT list_ord, token, count(*) AS df, ln(1 + n / count(*)) AS idf
  FROM postings JOIN (SELECT list_ord, count(*) AS n FROM kept GROUP BY 1) USING (list_ord) GROUP BY list_ord, token, n)"""
HITS_SQL = """
codes AS (SELECT item_id, unnest(codes) AS c FROM items),
exact AS (SELECT list_ord, item_id, price_id, 3.0::DOUBLE AS w FROM codes JOIN kept ON c = code_key),
family AS (SELECT list_ord, item_id, price_id, 2.0::DOUBLE AS w FROM codes JOIN kept ON regexp_extract(c, '^[A-Z]+') = family),
prefix AS (SELECT list_ord, item_id, price_id, 2.0::DOUBLE AS w FROM codes JOIN kept ON starts_with(c, code_key) OR starts_with(code_key, c)),
word AS (SELECT list_ord, item_id, price_id, idf AS w FROM tokens JOIN postings USING (token) JOIN weights USING (list_ord, token)),
summed AS (
  SELECT list_ord, item_id, price_id, round(sum(w), 9) AS evidence
  FROM (FROM exact UNION ALL FROM family UNION ALL FROM prefix UNION ALL FROM word) GROUP BY ALL)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def raw_prices(spark: SparkSession, d: str) -> DataFrame:
    code = F.concat("p_type", F.lit("-"), F.col("p_size").cast("string"))
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("price_id"), (F.col("p_partkey") % 2).cast("int").alias("list_ord"), F.lit(1).alias("page"), code.alias("code"),
        F.col("p_retailprice").alias("price"), F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit(" w")).alias("text"),
        F.lit("").alias("section_fa"), F.col("p_brand").alias("section_en"),
    )


def prices(spark: SparkSession, d: str, one_list: bool = False) -> DataFrame:
    """The cleaned rows of both lists, or of all parts as a single list 0."""
    raw = raw_prices(spark, d)
    bounds = CFG["min_valid_price"], CFG["max_valid_price"]
    raw = clean.first_of_equal(raw.withColumn("list_ord", F.lit(0)) if one_list else raw, *bounds, ["list_ord"])
    return clean.clean_prices(layout.finalize(raw), *bounds, ["list_ord"])


def inventory(spark: SparkSession, d: str) -> DataFrame:
    stock = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("stock"))
    code = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" ("), F.col("p_type"), F.lit("-"), F.col("p_size").cast("string"), F.lit(")"))).otherwise("")
    return table(spark, d, "part").join(stock, F.col("l_partkey") == F.col("p_partkey"), "left").select(
        F.col("p_partkey").alias("item_id"), F.col("p_partkey").cast("int").alias("row"), F.col("p_partkey").cast("string").alias("code"),
        F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit(" w "), F.col("p_brand"), code).alias("name"), "stock", F.lit("pc").alias("unit"),
    )


def items(spark: SparkSession, d: str) -> DataFrame:
    return clean.clean_inventory(clean.prepare_inventory(inventory(spark, d), CFG))


# Strings and numbers


@query(f"SELECT doc_id, {norm_sql('text')} AS norm FROM documents")
def normalize_docs(spark, d):
    return table(spark, d, "documents").select("doc_id", text.normalize(F.col("text")).alias("norm"))


@query(f"SELECT doc_id, replace({norm_sql('text')}, ' ', '') AS packed FROM documents")
def dense_docs(spark, d):
    return table(spark, d, "documents").select("doc_id", text.dense(F.col("text")).alias("packed"))


@query(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS cleaned FROM documents")
def clean_spaces_docs(spark, d):
    return table(spark, d, "documents").select("doc_id", text.clean_spaces(F.col("text")).alias("cleaned"))


@query("""SELECT p_partkey, p_type || p_size AS code_key, p_type AS family, CASE WHEN p_partkey = 0 THEN '0' ELSE p_partkey::VARCHAR END AS digits_key FROM part""")
def code_keys(spark, d):
    key = text.code_key(F.concat("p_type", F.lit("-"), F.col("p_size").cast("string")))
    digits = text.code_key(F.lpad(F.col("p_partkey").cast("string"), 12, "0"))
    return table(spark, d, "part").select("p_partkey", key.alias("code_key"), text.code_family(key).alias("family"), digits.alias("digits_key"))


@query(f"""WITH {ITEMS_SQL} SELECT item_id, array_to_string(list_sort(list(token)), '|') AS tokens FROM tokens GROUP BY item_id""")
def name_tokens(spark, d):
    long = F.filter("tokens", lambda t: F.length(t) >= 3)
    return items(spark, d).select("item_id", F.array_join(F.array_sort(long), "|").alias("tokens"))


@query("""SELECT c_custkey, regexp_extract(c_name, '[0-9]+')::DOUBLE AS number, abs(c_acctbal) AS parsed,
  CASE WHEN abs(c_acctbal) BETWEEN 100 AND 5000 THEN abs(c_acctbal) END AS price FROM customer""")
def parse_numbers(spark, d):
    shown = F.format_number("c_acctbal", 2)
    parsed = numbers.parse_number(shown)
    return table(spark, d, "customer").select("c_custkey", numbers.parse_number(F.col("c_name")).alias("number"), parsed.alias("parsed"), numbers.parse_price(shown, 100, 5000).alias("price"))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice = floor(o_totalprice) THEN format('{:,}', o_totalprice::BIGINT) ELSE format('{:,.2f}', o_totalprice) END AS shown FROM orders""")
def format_prices(spark, d):
    return table(spark, d, "orders").select("o_orderkey", numbers.format_price(F.col("o_totalprice")).alias("shown"))


# Attributes


@query("""SELECT p_partkey, p_size::DOUBLE AS watt, p_size * 2.0::DOUBLE AS lo, p_size * 3.0::DOUBLE AS hi, p_size * 10.0::DOUBLE AS mm,
  array_to_string(list_sort(list_distinct([p_size, p_size * 2, p_size * 3])), ',') AS numbers,
  array_to_string(list_sort(list_distinct([p_size, 7])), ',') AS dims FROM part""")
def unit_specs(spark, d):
    size = lambda n: (F.col("p_size") * n).cast("string")
    name = F.concat("p_name", F.lit(" "), size(1), F.lit(" w, "), size(3), F.lit(" to "), size(2), F.lit(" v / "), size(1), F.lit(" cm"))
    found = attributes.specs(name)
    dims = attributes.specs(F.concat(size(1), F.lit(" x 7"))).getField("dims")
    return table(spark, d, "part").select(
        "p_partkey", found.getField("watt").alias("watt"), found.getField("volt_range").getField("lo").alias("lo"), found.getField("volt_range").getField("hi").alias("hi"),
        F.element_at(found.getField("mm"), 1).alias("mm"), F.array_join(found.getField("numbers").cast("array<string>"), ",").alias("numbers"), F.array_join(dims.cast("array<string>"), ",").alias("dims"),
    )


@query(f"WITH {ITEMS_SQL} SELECT item_id, array_to_string(codes, ',') AS codes FROM items")
def model_codes(spark, d):
    return inventory(spark, d).select("item_id", F.array_join(attributes.model_codes(F.col("name")), ",").alias("codes"))


@query(f"""WITH {ITEMS_SQL} SELECT item_id, coalesce((SELECT 'Brand#' || min_by(n, -n) FROM range(1, 26) r(n) WHERE contains(replace(norm, ' ', ''), 'brand' || n)), '') AS brand FROM keyed""")
def detect_brands(spark, d):
    return inventory(spark, d).select("item_id", attributes.brand_of(F.col("name"), BRANDS).alias("brand"))


@query(f"""WITH {ITEMS_SQL} SELECT item_id, norm || CASE WHEN contains(norm, 'red') THEN ' crimson' ELSE '' END
  || CASE WHEN contains(norm, 'small ring') THEN ' tiny circle' ELSE '' END || CASE WHEN contains(norm, 'bolt') THEN ' screw' ELSE '' END
  || CASE WHEN contains(norm, 'blue') AND contains(norm, 'gear') THEN ' azure cog teeth' ELSE '' END || CASE WHEN contains(norm, 'hot') THEN ' warm' ELSE '' END AS expanded FROM keyed""")
def expand_names(spark, d):
    return inventory(spark, d).select("item_id", attributes.expand_wording(F.col("name"), SYNONYMS, RULES).alias("expanded"))


# Filters and deduplication


@query(f"WITH {PRICES_SQL} SELECT list_ord, price_id, code_key, family, price, context, packed FROM kept")
def clean_price_list(spark, d):
    return prices(spark, d).select("list_ord", "price_id", "code_key", "family", "price", "context", "packed")


@query(f"""WITH {PRICES_SQL} SELECT (SELECT count(*) FROM prices) AS input, (SELECT count(*) FROM prices) - (SELECT count(*) FROM valid) AS dropped_no_price,
  (SELECT count(*) - count(DISTINCT code_key) FROM valid) AS duplicates, (SELECT count(DISTINCT code_key) FROM valid) AS output""")
def price_list_report(spark, d):
    return clean.price_report(layout.finalize(raw_prices(spark, d)), CFG["min_valid_price"], CFG["max_valid_price"])


@query(f"WITH {ITEMS_SQL} SELECT count(*) AS input, count(*) AS output, count(*) FILTER (WHERE stock IS NULL) AS no_stock FROM items")
def inventory_report(spark, d):
    return clean.inventory_report(clean.prepare_inventory(inventory(spark, d), CFG))


# Candidates


@query(f"WITH {PRICES_SQL}, {ITEMS_SQL}, {POSTINGS_SQL} SELECT list_ord, token, df, round(idf, 6) AS idf FROM weights")
def token_weights(spark, d):
    rows = prices(spark, d)
    out = candidates.token_weights(candidates.containment(candidates.item_tokens(items(spark, d)), rows), rows)
    return out.select("list_ord", "token", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {PRICES_SQL}, {ITEMS_SQL}, {POSTINGS_SQL} SELECT * FROM postings")
def join_contains(spark, d):
    return candidates.containment(candidates.item_tokens(items(spark, d)), prices(spark, d))


def _joined(name: str) -> str:
    return f"WITH {PRICES_SQL}, {ITEMS_SQL}, {POSTINGS_SQL}, {HITS_SQL} SELECT list_ord, item_id, price_id, w FROM {name}"


@query(_joined("exact"))
def join_exact(spark, d):
    return candidates.exact_hits(items(spark, d), prices(spark, d))


@query(_joined("family"))
def join_family(spark, d):
    return candidates.family_hits(items(spark, d), prices(spark, d))


@query(_joined("prefix"))
def join_prefix(spark, d):
    return candidates.prefix_hits(items(spark, d), prices(spark, d))


@query(f"""WITH {PRICES_SQL}, {ITEMS_SQL}, {POSTINGS_SQL}, {HITS_SQL} SELECT list_ord, item_id, price_id, round(evidence, 6) AS evidence FROM summed
  QUALIFY row_number() OVER (PARTITION BY list_ord, item_id ORDER BY evidence DESC, price_id) <= 60""")
def top_candidates(spark, d):
    left, right = items(spark, d), prices(spark, d)
    tokens = candidates.item_tokens(left)
    postings = candidates.containment(tokens, right)
    hits = candidates.exact_hits(left, right).union(candidates.family_hits(left, right)).union(candidates.prefix_hits(left, right))
    hits = hits.union(candidates.token_hits(tokens, postings, candidates.token_weights(postings, right)))
    return candidates.top_candidates(hits, 60).select("list_ord", "item_id", "price_id", F.round("evidence", 6).alias("evidence"))


# Scores


def _pairs(spark, d) -> DataFrame:
    """Items with the price rows of the same type of code."""
    left = items(spark, d).select("item_id", "specs", "dense_expanded", F.explode("codes").alias("c")).withColumn("family", F.regexp_extract("c", "^[A-Z]+", 0))
    right = prices(spark, d).select("list_ord", "price_id", "family", "code_key", "packed", F.col("specs").alias("price_specs"))
    return left.join(right, "family")


PAIRS_SQL = f"WITH {PRICES_SQL}, {ITEMS_SQL}, pairs AS (SELECT * EXCLUDE (packed), replace(norm, ' ', '') AS packed_item, packed FROM (SELECT item_id, norm, unnest(codes) AS c, p_size AS left_size FROM keyed JOIN part ON p_partkey = item_id) JOIN (SELECT kept.*, p_size AS right_size FROM kept JOIN part ON p_partkey = price_id) ON regexp_extract(c, '^[A-Z]+') = family)"


@query(f"{PAIRS_SQL} SELECT item_id, list_ord, price_id, CASE WHEN left_size = right_size THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS ratio, 1 AS comparable, (left_size <> right_size)::INT AS conflicts FROM pairs")
def spec_verdicts(spark, d):
    verdict = score.spec_verdict(F.col("specs"), F.col("price_specs"))
    return _pairs(spark, d).select("item_id", "list_ord", "price_id", verdict.alias("v")).select("item_id", "list_ord", "price_id", "v.ratio", "v.comparable", "v.conflicts")


@query(f"{PAIRS_SQL} SELECT item_id, list_ord, price_id, 0.0 - 12.0::DOUBLE * ({' + '.join(f'''(contains(packed_item, '{t}') <> contains(packed, '{t}'))::INT''' for t in TERMS)}) AS delta FROM pairs")
def discriminators(spark, d):
    return _pairs(spark, d).select("item_id", "list_ord", "price_id", score.discriminator_delta(F.col("dense_expanded"), F.col("packed"), TERMS, 12.0).alias("delta"))


@query(f"{PAIRS_SQL} SELECT item_id, list_ord, price_id, CASE WHEN c = code_key THEN 100.0::DOUBLE WHEN starts_with(c, code_key) OR starts_with(code_key, c) THEN 88.0::DOUBLE ELSE 78.0::DOUBLE END AS code_score FROM pairs")
def code_scores(spark, d):
    ruled = score.code_score(F.array("c"), F.col("code_key"), F.col("family"), F.lit(0.0))
    return _pairs(spark, d).select("item_id", "list_ord", "price_id", ruled.alias("code_score"))


@query(f"""WITH {PRICES_SQL}, {ITEMS_SQL}, {POSTINGS_SQL}, total AS (SELECT list_ord, item_id, sum(idf) AS total FROM tokens JOIN weights USING (token) GROUP BY ALL),
  found AS (SELECT list_ord, item_id, price_id, sum(idf) AS found FROM tokens JOIN postings USING (token) JOIN weights USING (list_ord, token) GROUP BY ALL)
  SELECT list_ord, item_id, price_id, round(100 * pow(found / total, 0.6), 5) AS coverage FROM found JOIN total USING (list_ord, item_id)""")
def coverage_scores(spark, d):
    left, right = items(spark, d), prices(spark, d)
    tokens = candidates.item_tokens(left)
    postings = candidates.containment(tokens, right)
    weights = candidates.token_weights(postings, right)
    total = tokens.join(weights, "token").groupBy("list_ord", "item_id").agg(F.sum("idf").alias("total"))
    found = tokens.join(postings.join(weights, ["list_ord", "token"]), "token").groupBy("list_ord", "item_id", "price_id").agg(F.sum("idf").alias("found"))
    covered = 100 * F.pow(F.col("found") / F.col("total"), F.lit(0.6))
    return found.join(total, ["list_ord", "item_id"]).select("list_ord", "item_id", "price_id", F.round(covered, 5).alias("coverage"))


@query("""SELECT o_orderkey, CASE WHEN s >= 99 THEN 'EXACT' WHEN s >= 85 THEN 'HIGH' WHEN s >= 70 THEN 'REVIEW' ELSE 'NOT_FOUND' END AS status
  FROM (SELECT o_orderkey, o_totalprice % 101 AS s FROM orders)""")
def status_bands(spark, d):
    return table(spark, d, "orders").select("o_orderkey", score.status_of(F.col("o_totalprice") % 101, CFG).alias("status"))


# Decisions over scored pairs: orders as pairs of customers (items) and orders (price rows)


def _scored(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(
        F.lit(0).alias("list_ord"), F.col("o_custkey").alias("item_id"), F.col("o_orderkey").alias("price_id"), F.col("o_orderpriority").alias("price_code"),
        F.floor(F.col("o_totalprice") / 1000).cast("double").alias("price"), (F.col("o_orderkey") * 7919 % 1010 / 10).alias("score"), F.lit("text").alias("kind"), F.lit("").alias("note"),
    )


DECIDED_SQL = """
scored AS (SELECT o_custkey AS item_id, o_orderkey AS price_id, o_orderpriority AS price_code, floor(o_totalprice / 1000) AS price, o_orderkey * 7919 % 1010 / 10 AS score FROM orders),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, price_id) AS rn FROM scored QUALIFY rn <= 4),
best AS (SELECT * FROM ranked WHERE rn = 1),
close AS (
  SELECT item_id, string_agg(r.price_code || ' - ' || format('{:,}', r.price::BIGINT), ';' ORDER BY r.rn) AS labels FROM ranked r JOIN best b USING (item_id)
  WHERE r.rn > 1 AND r.score >= 70 AND b.score - r.score < 4 AND r.price <> b.price GROUP BY item_id),
decided AS (
  SELECT item_id, CASE WHEN score >= 70 THEN price_id END AS price_id, CASE WHEN score >= 70 THEN price END AS price, score,
    CASE WHEN score >= 99 THEN 'EXACT' WHEN score < 70 THEN 'NOT_FOUND' WHEN labels IS NOT NULL OR score < 85 THEN 'REVIEW' ELSE 'HIGH' END AS status,
    CASE WHEN score >= 70 THEN coalesce(labels, '') ELSE '' END AS alternatives
  FROM best LEFT JOIN close USING (item_id))"""


@query(f"WITH {DECIDED_SQL} SELECT item_id, coalesce(price_id, -1) AS price_id, coalesce(price, -1) AS price, round(score, 6) AS score, status, alternatives FROM decided")
def decisions(spark, d):
    out = decide.decide(_scored(spark, d), CFG)
    return out.select("item_id", F.coalesce("price_id", F.lit(-1)).alias("price_id"), F.coalesce("price", F.lit(-1.0)).alias("price"), F.round("score", 6).alias("score"), "status", F.array_join("alternatives", ";").alias("alternatives"))


def _results(spark, d) -> DataFrame:
    """Left outer: every customer once, with the decision."""
    best = decide.decide(_scored(spark, d), CFG)
    every = table(spark, d, "customer").select(F.col("c_custkey").alias("item_id"), F.col("c_custkey").cast("string").alias("code"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("stock"))
    return every.join(best.drop("list_ord"), "item_id", "left").withColumn("status", F.coalesce("status", F.lit("NOT_FOUND"))).withColumn("source", F.lit(""))


RESULTS_SQL = f"WITH {DECIDED_SQL}, results AS (SELECT c_custkey AS item_id, c_custkey::VARCHAR AS code, c_name AS name, c_acctbal AS stock, price, coalesce(status, 'NOT_FOUND') AS status FROM customer LEFT JOIN decided ON item_id = c_custkey)"


@query(f"{RESULTS_SQL} SELECT item_id, code, name, stock, price, status FROM results")
def left_join_result(spark, d):
    return _results(spark, d).select("item_id", "code", "name", "stock", "price", "status")


@query(f"""{RESULTS_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE status = 'EXACT') AS exact, count(*) FILTER (WHERE status = 'HIGH') AS high,
  count(*) FILTER (WHERE status = 'REVIEW') AS review, count(*) FILTER (WHERE status = 'NOT_FOUND') AS not_found,
  count(*) FILTER (WHERE status IN ('EXACT', 'HIGH') AND price IS NOT NULL) AS matched, count(price) AS priced,
  count(price) FILTER (WHERE stock > 0) AS in_stock, count(price) FILTER (WHERE NOT coalesce(stock > 0, false)) AS out_of_stock FROM results""")
def run_summary(spark, d):
    return merge.run_summary(_results(spark, d))


@query(f"{RESULTS_SQL}, f AS (SELECT item_id, unnest(list_filter(['all', CASE WHEN price IS NOT NULL THEN 'priced' END, CASE WHEN status IN ('EXACT', 'HIGH') THEN 'matched' END, CASE WHEN status = 'REVIEW' THEN 'review' END, CASE WHEN status = 'NOT_FOUND' THEN 'not_found' END, CASE WHEN stock > 0 THEN 'in_stock' ELSE 'out_of_stock' END], lambda x: x IS NOT NULL)) AS filter FROM results) SELECT filter, item_id FROM f")
def result_filters(spark, d):
    rows, out = _results(spark, d), None
    for name in ("all", "priced", "matched", "review", "not_found", "in_stock", "out_of_stock"):
        one = results.filter_results(rows, name).select(F.lit(name).alias("filter"), "item_id")
        out = one if out is None else out.union(one)
    return out


@query(f"{RESULTS_SQL} SELECT item_id, code, name FROM results WHERE contains(lower(code || ' ' || name), 'r#00000001')")
def result_search(spark, d):
    return results.search_results(_results(spark, d), "R#00000001").select("item_id", "code", "name")


@query(f"{RESULTS_SQL} SELECT item_id, status FROM results ORDER BY item_id LIMIT 30 OFFSET 20")
def result_page(spark, d):
    return results.page_results(_results(spark, d), 20, 30).select("item_id", "status")


@query(f"""{RESULTS_SQL} SELECT item_id, code, code::BIGINT AS code_number, name, stock, price, CASE WHEN price IS NOT NULL THEN 'Acme' ELSE '' END AS brand,
  CASE status WHEN 'EXACT' THEN 'دقیق' WHEN 'HIGH' THEN 'معتبر' WHEN 'REVIEW' THEN 'نیاز به بررسی' ELSE 'بدون قیمت' END AS status_label FROM results""")
def export_result(spark, d):
    return results.export_rows(_results(spark, d), "Acme")


# Several lists merged: line items as prices of parts by suppliers, five lists


def _listed(spark, d) -> DataFrame:
    every = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 5).cast("int").alias("list_ord"), F.col("l_partkey").alias("item_id")).agg(
        F.min("l_extendedprice").alias("price"), F.sum("l_quantity").alias("stock")
    )
    price = F.when(F.col("price") >= 2000, F.col("price"))
    return every.select("list_ord", F.concat(F.lit("list "), F.col("list_ord").cast("string")).alias("label"), "item_id", price.alias("price"), "stock", F.when(price.isNull(), "NOT_FOUND").otherwise("HIGH").alias("status"))


LISTED_SQL = """
listed AS (SELECT (l_suppkey % 5)::INT AS list_ord, l_partkey AS item_id, CASE WHEN min(l_extendedprice) >= 2000 THEN min(l_extendedprice) END AS price, sum(l_quantity) AS stock FROM lineitem GROUP BY 1, 2),
merged AS (SELECT *, CASE WHEN price IS NULL THEN '' ELSE 'list ' || list_ord END AS source FROM listed QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY price IS NULL, list_ord) = 1)"""


@query(f"WITH {LISTED_SQL} SELECT item_id, list_ord, price, source FROM merged")
def priority_merge(spark, d):
    return merge.merge_lists(_listed(spark, d)).select("item_id", "list_ord", "price", "source")


def _lists(spark, d) -> DataFrame:
    return _listed(spark, d).groupBy("list_ord", "label").agg(F.count("*").alias("pdf_rows"))


@query(f"WITH {LISTED_SQL} SELECT list_ord, 'list ' || list_ord AS label, pdf_rows, coalesce(priced, 0) AS priced FROM (SELECT list_ord, count(*) AS pdf_rows FROM listed GROUP BY 1) LEFT JOIN (SELECT list_ord, count(price) AS priced FROM merged GROUP BY 1) USING (list_ord)")
def list_report(spark, d):
    return merge.list_report(merge.merge_lists(_listed(spark, d)), _lists(spark, d))


@query(f"""WITH {LISTED_SQL} SELECT count(*) AS total, 0 AS exact, count(price) AS high, 0 AS review, count(*) - count(price) AS not_found, count(price) AS priced,
  (SELECT count(*) FROM listed) AS pdf_rows, (SELECT count(DISTINCT list_ord) FROM listed) AS files,
  (SELECT string_agg('list ' || list_ord, '، ' ORDER BY list_ord) FROM (SELECT DISTINCT list_ord FROM listed)) AS brand FROM merged""")
def batch_summary(spark, d):
    return merge.batch_summary(merge.merge_lists(_listed(spark, d)), _lists(spark, d))


# Text of scripts: names of parts spelt with Persian letters, digits and broken glyphs


PLAIN, ODD = "abcdefgh", "يكةىأ٣۷ۀ"
ODD_SQL = f"translate(p_name, '{PLAIN}', '{ODD}')"


def _odd(spark, d) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_type", F.translate("p_name", PLAIN, ODD).alias("odd"))


@query(f"SELECT p_partkey, translate({ODD_SQL}, '{''.join(chr(0x06F0 + i) for i in range(10))}{''.join(chr(0x0660 + i) for i in range(10))}', '01234567890123456789') AS digits FROM part")
def script_digits(spark, d):
    return _odd(spark, d).select("p_partkey", text.ascii_digits(F.col("odd")).alias("digits"))


@query(f"SELECT p_partkey, {LETTERS_SQL.format(ODD_SQL)} AS letters FROM part")
def script_letters(spark, d):
    return _odd(spark, d).select("p_partkey", text.unify_letters(F.col("odd")).alias("letters"))


@query(f"SELECT p_partkey, {GLYPHS_SQL.format(GLYPH_NAME)} AS repaired, {GLYPHS_SQL.format(GLYPH_NAME)} AS plain FROM part")
def broken_glyphs(spark, d):
    """Names whose first letters are glyphs of a broken font; no other compatibility form occurs in them."""
    name = F.translate("p_name", "abcd", "".join(list(V.GLYPHS)[:4]))
    return table(spark, d, "part").select("p_partkey", text.fix_glyphs(name).alias("repaired"), text.plain_shapes(name).alias("plain"))


@query(r"""SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace('لامپ' || p_type || p_size || 'وات' || p_name, '([\x{0600}-\x{06ff}])([A-Za-z0-9])', '\1 \2', 'g'),
  '([A-Za-z0-9])([\x{0600}-\x{06ff}])', '\1 \2', 'g'), '\s+', ' ', 'g')) AS split FROM part""")
def split_names(spark, d):
    glued = F.concat(F.lit("لامپ"), "p_type", F.col("p_size").cast("string"), F.lit("وات"), "p_name")
    return table(spark, d, "part").select("p_partkey", text.split_scripts(glued).alias("split"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'kg' WHEN 1 THEN 'parsec' WHEN 2 THEN 'm' ELSE '' END AS unit FROM part""")
def unit_names(spark, d):
    known = {unit: names[0] for unit, names in V.UNIT_NAMES.items()}
    given = F.when(F.col("p_partkey") % 4 == 0, known["kg"]).when(F.col("p_partkey") % 4 == 1, " Parsec ").when(F.col("p_partkey") % 4 == 2, known["m"]).otherwise("")
    return table(spark, d, "part").select("p_partkey", text.unit_name(given).alias("unit"))


@query("""SELECT p_partkey, p_size::VARCHAR || '|' || (p_size * 1000)::VARCHAR || '|' || (p_size + 0.5)::VARCHAR AS numbers,
  CASE WHEN p_size * 1000 BETWEEN 5000 AND 30000 THEN p_size * 1000.0::DOUBLE END AS price, (p_size + 0.5)::DOUBLE AS stock FROM part""")
def number_lists(spark, d):
    """All numbers of a text, a price within limits, a stock."""
    size = F.col("p_size").cast("string")
    given = F.concat(F.lit("x "), size, F.lit(" y "), size, F.lit(",000 z "), size, F.lit(".5"))
    shown = F.array_join(F.transform(numbers.find_numbers(given), lambda v: F.when(v == F.floor(v), F.floor(v).cast("string")).otherwise(v.cast("string"))), "|")
    return table(spark, d, "part").select(
        "p_partkey", shown.alias("numbers"), numbers.parse_price(F.concat(size, F.lit(",000")), 5000.0, 30000.0).alias("price"), numbers.parse_stock(F.concat(size, F.lit(".5 pcs"))).alias("stock"))


@query("""SELECT p_partkey, concat_ws(' | ', nullif(trim(CASE WHEN p_partkey % 3 = 0 THEN '  ' ELSE p_type END), ''), nullif(trim(CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name END), '')) AS label FROM part""")
def price_labels(spark, d):
    section, name = F.when(F.col("p_partkey") % 3 == 0, "  ").otherwise(F.col("p_type")), F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", text.price_label(section, name).alias("label"))


@query("""SELECT p_partkey, round(CASE WHEN p_partkey % 4 = 0 THEN 40.0 ELSE least(100, 0.75 * 100 * pow((p_partkey % 7 + 1) / 8.0, 0.6) + 0.25 * p_size) END, 6) AS words,
  CASE WHEN p_type LIKE 'A%' THEN 4.0::DOUBLE ELSE -4.0::DOUBLE END AS brand FROM part""")
def text_and_brand_scores(spark, d):
    """The text score by coverage and overlap, or its fallback; the brand's bonus or malus."""
    known = F.when(F.col("p_partkey") % 4 != 0, F.lit(8.0))
    words = score.text_score((F.col("p_partkey") % 7 + 1).cast("double"), known, F.col("p_size").cast("double"), F.lit(40.0), 0.6)
    return table(spark, d, "part").select("p_partkey", F.round(words, 6).alias("words"), score.brand_delta(F.lit("own"), F.col("p_type"), {"own": ["A"]}, 4.0).alias("brand"))


@query("""WITH s AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN -1.0 WHEN 1 THEN 88.0 ELSE 100.0 END::DOUBLE AS code, p_size * 2.0::DOUBLE AS words,
    CASE p_partkey % 4 WHEN 0 THEN -1.0 WHEN 1 THEN 0.5 ELSE 1.0 END::DOUBLE AS ratio, (p_partkey % 5 = 0)::INT AS conflicts, p_partkey % 2 = 0 AS hard FROM part),
  w AS (SELECT *, CASE WHEN ratio >= 0 THEN ratio * 100 WHEN hard THEN 55.0 END AS spec FROM s),
  v AS (SELECT *, (CASE WHEN code >= 0 THEN code * 0.45 ELSE 0 END + coalesce(spec * 0.25, 0) + words * 0.30) / (CASE WHEN code >= 0 THEN 0.45 ELSE 0 END + CASE WHEN spec IS NOT NULL THEN 0.25 ELSE 0 END + 0.30) + 4.0 AS value FROM w)
  SELECT p_partkey, round(greatest(0, least(100, CASE WHEN conflicts > 0 THEN value * 0.35 WHEN code >= 100 THEN 100 ELSE value END))::DOUBLE, 6) AS score,
    CASE WHEN code >= 100 AND conflicts = 0 THEN 'exact_code' WHEN code > 0 THEN 'code_spec' ELSE 'text' END AS kind FROM v""")
def total_scores(spark, d):
    """The weighted mean of the parts there are, the veto, the override of an equal code, and the kind of match."""
    key = F.col("p_partkey")
    code = F.when(key % 3 == 0, -1.0).when(key % 3 == 1, 88.0).otherwise(100.0)
    verdict = F.struct(F.when(key % 4 == 0, -1.0).when(key % 4 == 1, 0.5).otherwise(1.0).alias("ratio"), F.lit(1).alias("comparable"), (key % 5 == 0).cast("int").alias("conflicts"))
    rows = table(spark, d, "part").select(key, code.alias("code"), (F.col("p_size") * 2.0).alias("words"), verdict.alias("verdict"))
    total = score.total_score(F.col("code"), F.col("words"), F.col("verdict"), key % 2 == 0, F.lit(4.0), CFG)
    return rows.select(key, F.round(total, 6).alias("score"), score.match_kind(F.col("code"), F.col("verdict.conflicts")).alias("kind"))


@query("""SELECT c_custkey AS item_id FROM customer WHERE c_acctbal > 0""")
def only_priced(spark, d):
    """Rows with a price, as an export takes them."""
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("item_id"), F.col("c_custkey").cast("string").alias("code"), F.col("c_name").alias("name"), F.lit(1.0).alias("stock"),
                                              F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("price"), F.lit("HIGH").alias("status"), F.lit("a").alias("source"))
    return results.export_rows(rows, "", True).select("item_id")


# Page layout


@query("""SELECT event_id, user_id, coalesce(last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS section FROM events""")
def carry_forward(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return table(spark, d, "events").select("event_id", "user_id", F.coalesce(F.last(F.when(F.col("event_type") == "error", F.col("event_id")), ignorenulls=True).over(w), F.lit(-1)).alias("section"))


@query("""WITH e AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n, count(*) OVER (PARTITION BY user_id, event_type) AS c FROM events)
  SELECT a.user_id, a.event_id AS code_row, b.event_id AS price_row FROM e a JOIN e b ON a.user_id = b.user_id AND a.n = b.n WHERE a.event_type = 'click' AND b.event_type = 'view' AND a.c = b.c AND a.c >= 3""")
def zip_columns(spark, d):
    w = Window.partitionBy("user_id", "event_type")
    rows = table(spark, d, "events").withColumns({"n": F.row_number().over(w.orderBy("event_id")), "c": F.count("*").over(w)})
    left = rows.where("event_type = 'click' and c >= 3").select("user_id", "n", "c", F.col("event_id").alias("code_row"))
    right = rows.where("event_type = 'view'").select("user_id", "n", "c", F.col("event_id").alias("price_row"))
    return left.join(right, ["user_id", "n", "c"]).select("user_id", "code_row", "price_row")


@query("""WITH RECURSIVE sorted AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) AS n FROM events),
  walked AS (SELECT user_id, n, value, value AS anchor, 0 AS "group" FROM sorted WHERE n = 1
    UNION ALL SELECT s.user_id, s.n, s.value, CASE WHEN abs(s.value - w.anchor) <= 3.5 THEN w.anchor ELSE s.value END,
      CASE WHEN abs(s.value - w.anchor) <= 3.5 THEN w."group" ELSE w."group" + 1 END FROM walked w JOIN sorted s ON s.user_id = w.user_id AND s.n = w.n + 1)
  SELECT user_id, value, "group" FROM walked""")
def anchor_groups(spark, d):
    return layout.anchor_rows(table(spark, d, "events"), ["user_id"], "value", 3.5)


@query("""SELECT 'list' AS doc_id, (p_partkey // 40)::INT AS page, p_type || '-' || p_size AS code, round(p_retailprice * 100) AS price, p_name || ' ' || p_size || ' w' AS text FROM part""")
def layout_products(spark, d):
    """Parts printed 40 to a page: code at the right, words, price at the left."""
    part = table(spark, d, "part").withColumn("y", (F.col("p_partkey") % 40) * 20.0 + 50)
    cells = F.array(
        F.struct(F.lit(540.0).alias("x0"), F.concat("p_type", F.lit("-"), F.col("p_size").cast("string")).alias("text")),
        *[F.struct(F.lit(400.0 - 50 * i).alias("x0"), F.element_at(F.split("p_name", " "), i + 1).alias("text")) for i in range(2)],
        F.struct(F.lit(300.0).alias("x0"), F.col("p_size").cast("string").alias("text")), F.struct(F.lit(250.0).alias("x0"), F.lit("w").alias("text")),
        F.struct(F.lit(100.0).alias("x0"), F.format_number(F.round(F.col("p_retailprice") * 100), 0).alias("text")),
    )
    words = part.select(F.lit("list").alias("doc_id"), F.floor(F.col("p_partkey") / 40).cast("int").alias("page"), "y", F.explode(cells).alias("w"))
    words = words.select("doc_id", "page", "y", "w.x0", (F.col("w.x0") + 30).alias("x1"), "w.text")
    out = layout.price_rows(words, load_config(over={"scanned_char_threshold": 1}))
    return out.select("doc_id", "page", "code", "price", F.regexp_replace("text", " [0-9,]+$", "").alias("text"))


# Similarities and the whole resolution


@query()
def similarities(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_name", F.concat("p_type", F.lit(" "), F.col("p_name"), F.lit(" "), F.col("p_brand")).alias("other"))
    a, b = F.col("p_name"), F.col("other")
    return rows.select("p_partkey", F.round(similarity.ratio(a, b), 6).alias("ratio"), F.round(similarity.partial_ratio(a, b), 6).alias("partial"),
                       F.round(similarity.token_set_ratio(a, b), 6).alias("token_set"), F.round(similarity.token_sort_ratio(a, b), 6).alias("token_sort"), F.round(similarity.name_similarity(a, b), 6).alias("name"))


@query()
def resolve_prices(spark, d):
    """Every inventory row with at most one price row of a list of all parts."""
    return resolve.resolve(items(spark, d), prices(spark, d, one_list=True), CFG)


@query()
def resolve_lists(spark, d):
    """Two lists in one job, merged by priority."""
    lists = spark.createDataFrame([(0, "even", ""), (1, "odd", "")], "list_ord int, label string, target string")
    return resolve.resolve_batch(items(spark, d), prices(spark, d), lists, CFG)
