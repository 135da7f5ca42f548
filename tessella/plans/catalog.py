"""Registered queries of the curation operators over the standard tables, with their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import edits as E
from tessella.functions import rewards as R
from tessella.functions import text as X
from tessella.operators import dedup, joins, selection, splits, stats
from tessella.plans import reports
from tessella.sources.tables import table

from .registry import ORACLE, QUERIES, query

@query("funnel_by_source", "SELECT source, count(*) AS n_docs, sum(length(text)) AS n_chars_total FROM documents GROUP BY source")
def funnel_by_source(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.length("text")).alias("n_chars_total"))


# --- predicates and projections


# --- text functions


@query(
    "str_keys",
    r"SELECT doc_id, sha1(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS wskey, regexp_replace(left(text, 40), '[^A-Za-z0-9_.-]', '_', 'g') AS slug, right(text, 20) AS tail FROM documents",
)
def str_keys(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha1(X.wskey(t)).alias("wskey"), X.slug(F.left(t, F.lit(40))).alias("slug"), X.tail(t, 20).alias("tail"))


@query(
    "str05_normalize_error",
    r"""SELECT event_id, trim(left(regexp_replace(regexp_replace(regexp_replace(regexp_replace(props, '`[^'']*''|''[^'']*''|"[^"]*"', '''X''', 'g'), '\\[A-Za-z@]+', '\\CS', 'g'), '\{[^{}]*\}', '{X}', 'g'), '\d+', 'N', 'g'), 70)) AS norm FROM events""",
)
def str05(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.normalize_error(F.col("props")).alias("norm"))


@query("str20_literal_count", "SELECT doc_id, ((length(text) - length(replace(text, 'th', ''))) / 2)::INT AS n FROM documents")
def str20(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.literal_count(F.col("text"), F.lit("th")).alias("n"))


@query(
    "str21_replace_first",
    "SELECT doc_id, sha1(CASE WHEN position('the' IN text) = 0 THEN text ELSE substr(text, 1, position('the' IN text) - 1) || 'THE' || substr(text, position('the' IN text) + 3) END) AS h FROM documents",
)
def str21(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha1(X.replace_first(F.col("text"), F.lit("the"), F.lit("THE"))).alias("h"))


@query(
    "str14_numbered_lines",
    "SELECT doc_id, sha1(array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: i::VARCHAR || ': ' || x), chr(10))) AS h FROM documents",
)
def str14(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha1(X.numbered(F.col("text"))).alias("h"))


@query(
    "str13_tree_block",
    "WITH g AS (SELECT p_brand, list_sort(list(p_name)) AS names FROM part GROUP BY p_brand) SELECT p_brand, sha1(array_to_string(list_transform(names[1:40], lambda x: '- ' || x), chr(10)) || CASE WHEN len(names) > 40 THEN chr(10) || '- ... (' || (len(names) - 40)::VARCHAR || ' more)' ELSE '' END) AS h FROM g",
)
def str13(spark, sf_dir):
    g = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.collect_list("p_name").alias("names"))
    return g.select("p_brand", F.sha1(X.tree_block(F.col("names"))).alias("h"))


@query(
    "dt01_license_by_date",
    "SELECT o_orderkey, CASE WHEN strftime(o_orderdate, '%Y-%m-%d') < '2011-04-08' THEN 'CC-BY-SA-2.5' WHEN strftime(o_orderdate, '%Y-%m-%d') < '2018-05-02' THEN 'CC-BY-SA-3.0' ELSE 'CC-BY-SA-4.0' END AS license FROM orders",
)
def dt01(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", X.license_of(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("license"))


@query(
    "dt02_year_of_paper",
    "WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'x/' ELSE '' END || lpad((p_partkey % 100)::VARCHAR, 2, '0') || CASE WHEN p_partkey % 3 = 0 THEN '01234' ELSE '11.0042' END AS id FROM part) "
    "SELECT p_partkey, CASE WHEN p_partkey % 100 > 90 THEN 1900 + p_partkey % 100 ELSE 2000 + p_partkey % 100 END::INT AS year FROM p",
)
def dt02(spark, sf_dir):
    k = F.col("p_partkey")
    yy = F.lpad((k % 100).cast("string"), 2, "0")
    id = F.when(k % 3 == 0, F.concat(F.lit("x/"), yy, F.lit("01234"))).otherwise(F.concat(yy, F.lit("11.0042")))
    return table(spark, sf_dir, "part").select("p_partkey", X.year_of_paper(id).alias("year"))


@query("jsn01_first_json", "SELECT event_id, json_extract_string(regexp_extract('verdict: ' || props || ' end', '(?s)\\{.*\\}', 0), '$.k') AS k FROM events")
def jsn01(spark, sf_dir):
    free = F.concat(F.lit("verdict: "), F.col("props"), F.lit(" end"))
    return table(spark, sf_dir, "events").select("event_id", X.first_json(free, "k string")["k"].alias("k"))


# --- edits: each document's first line is the search of a response


def _responses(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("first", F.get(X.lines(F.col("text")), F.lit(0)))
    one = F.struct(F.lit("main.tex").alias("file"), F.col("first").alias("search"), F.reverse(F.left("first", F.lit(10))).alias("replace"))
    return docs.withColumn("response", E.format_edits(F.array(one)))


_FIRST = "SELECT doc_id, text, string_split(text, chr(10))[1] AS first FROM documents"


@query(
    "edit03_format",
    f"WITH d AS ({_FIRST}) SELECT doc_id, sha1('<edit>' || chr(10) || '<<<<<<< SEARCH' || chr(10) || first || chr(10) || '=======' || chr(10) || CASE WHEN first <> '' THEN reverse(left(first, 10)) || chr(10) ELSE '' END || '>>>>>>> REPLACE' || chr(10) || '</edit>') AS h FROM d",
)
def edit03(spark, sf_dir):
    return _responses(spark, sf_dir).select("doc_id", F.sha1("response").alias("h"))


@query("edit01_parse", f"WITH d AS ({_FIRST}) SELECT doc_id, first AS search, reverse(left(first, 10)) AS replace FROM d")
def edit01(spark, sf_dir):
    e = F.get(E.parse_edits(F.col("response")), F.lit(0))
    return _responses(spark, sf_dir).select("doc_id", e["search"].alias("search"), e["replace"].alias("replace"))


@query(
    "edit04_apply",
    f"WITH d AS ({_FIRST}), n AS (SELECT *, CASE WHEN first = '' THEN length(text) + 1 ELSE ((length(text) - length(replace(text, first, ''))) / length(first))::INT END AS n FROM d) "
    "SELECT doc_id, CASE WHEN n = 1 THEN NULL WHEN n = 0 THEN 'SEARCH not found' ELSE 'SEARCH ambiguous (' || n::VARCHAR || ' matches)' END AS error, "
    "sha1(CASE WHEN n = 1 THEN reverse(left(first, 10)) || substr(text, length(first) + 1) ELSE text END) AS h FROM n",
)
def edit04(spark, sf_dir):
    done = _responses(spark, sf_dir).withColumn("a", E.apply_edits(F.col("text"), E.parse_any(F.col("response"))))
    return done.select("doc_id", "a.error", F.sha1("a.doc").alias("h"))


@query(
    "edit09_deleted",
    rf"WITH d AS ({_FIRST}), c AS (SELECT doc_id, length(regexp_replace(regexp_replace(first, '%.*', ''), '\s+', '', 'g')) AS a, length(regexp_replace(regexp_replace(reverse(left(first, 10)), '%.*', ''), '\s+', '', 'g')) AS b FROM d) "
    "SELECT doc_id, greatest(0, a - b)::INT AS deleted, (a + b)::INT AS size FROM c",
)
def edit09(spark, sf_dir):
    r = F.col("response")
    return _responses(spark, sf_dir).select("doc_id", E.deleted_chars(r).alias("deleted"), E.edit_size(r).alias("size"))


# --- joins


@query(
    "join01_matched_once",
    "WITH b AS (SELECT l_orderkey, arg_min(l_linenumber, l_linenumber) FILTER (WHERE l_quantity > 40) AS found, count(*) AS n FROM lineitem GROUP BY l_orderkey) "
    "SELECT o_orderkey, found AS linenumber, CASE WHEN found IS NOT NULL THEN 'matched' WHEN n IS NOT NULL THEN 'unusable' ELSE 'unmatched' END AS match FROM orders LEFT JOIN b ON o_orderkey = l_orderkey",
)
def join01(spark, sf_dir):
    out = joins.matched_once(table(spark, sf_dir, "orders").select("o_orderkey"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "o_orderkey", "l_orderkey", "l_linenumber", F.col("l_quantity") > 40)
    return out.select("o_orderkey", F.col("found.l_linenumber").alias("linenumber"), "match")


@query(
    "join02_accepted_and_best",
    "WITH j AS (SELECT o_orderkey, l_linenumber AS id, l_quantity AS s FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey) "
    "SELECT o_orderkey, max(id) FILTER (WHERE id = 2 AND s < 45) AS accepted, arg_max(id, row(s, -id)) FILTER (WHERE id <> 2 AND s < 45 AND s >= 2) AS top, max(s) FILTER (WHERE id <> 2 AND s < 45 AND s >= 2) AS top_score, count(id) AS n_children FROM j GROUP BY o_orderkey",
)
def join02(spark, sf_dir):
    parents = table(spark, sf_dir, "orders").select("o_orderkey", F.lit(2).alias("accepted_id"))
    return joins.accepted_and_best(parents, table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "o_orderkey", "accepted_id", "l_orderkey", "l_linenumber", "l_quantity", F.col("l_quantity") < 45)


@query("join03_with_reference", "SELECT d.doc_id, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id)")
def join03(spark, sf_dir):
    return joins.with_references(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("join04_semi", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def join04(spark, sf_dir):
    return joins.with_references(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id", "left_semi")


@query("join05_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def join05(spark, sf_dir):
    return joins.with_references(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query(
    "join09_similar_line_sets",
    r"""WITH s AS (SELECT doc_id, list_sort(list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''))) AS s FROM documents),
c AS (SELECT doc_id % 10 = 0 AS held, s, min(doc_id) AS id, count(*) AS n FROM s WHERE len(s) > 0 GROUP BY 1, 2),
i AS (SELECT held, id, n, len(s) AS size, unnest(s) AS item FROM c),
p AS (SELECT a.id AS left_id, b.id AS right_id, a.n AS left_n, b.n AS right_n, a.size AS sa, b.size AS sb, count(*) AS common FROM i a JOIN i b ON a.item = b.item AND a.held AND NOT b.held GROUP BY ALL)
SELECT left_id, right_id, round(common / (sa + sb - common), 9) AS similarity, left_n, right_n FROM p WHERE common / (sa + sb - common) >= 0.9""",
)
def join09(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", X.line_set(F.col("text")).alias("items"))
    out = joins.similar_sets(docs.filter("doc_id % 10 = 0"), docs.filter("doc_id % 10 <> 0"), "doc_id", "items")
    return out.withColumn("similarity", F.round("similarity", 9))


@query("join15_author_names", "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 7 = 0 THEN 'own name' END, c_name) AS author FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def join15(spark, sf_dir):
    posts = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("owner_user_id"), F.when(F.col("o_orderkey") % 7 == 0, "own name").alias("owner_display_name"))
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("display_name"))
    return joins.author_names(posts, users).select("o_orderkey", "author")


# --- counts and statistics


@query("agg01_most_common", "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 10")
def agg01(spark, sf_dir):
    return stats.histogram(table(spark, sf_dir, "part"), "p_brand", 10)


@query("agg02_funnel", "SELECT event_type, count(*) AS n, coalesce(list_position(['view', 'click', 'cart'], event_type), 4)::INT AS place FROM events GROUP BY event_type")
def agg02(spark, sf_dir):
    return stats.funnel(table(spark, sf_dir, "events"), ["view", "click", "cart"], "event_type").withColumn("place", F.col("place").cast("int"))


@query("agg03_elements", "SELECT item, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS item FROM part) GROUP BY item")
def agg03(spark, sf_dir):
    return stats.element_histogram(table(spark, sf_dir, "part"), F.split("p_type", " "))


@query("agg05_buckets", "SELECT CASE WHEN l_quantity < 2 THEN '<2' WHEN l_quantity < 5 THEN '2-4' WHEN l_quantity < 20 THEN '5-19' ELSE '>=20' END AS bucket, count(*) AS n FROM lineitem GROUP BY 1")
def agg05(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(stats.bucket(F.col("l_quantity"), [2, 5, 20]).alias("bucket")).agg(F.count("*").alias("n"))


@query("agg07_rates", "SELECT toxic, count(*) AS n, sum(quality)::BIGINT AS n_good, round(avg(quality), 6) AS rate_good FROM labels GROUP BY toxic")
def agg07(spark, sf_dir):
    return stats.rates(table(spark, sf_dir, "labels").withColumn("good", F.col("quality") == 1), ["toxic"], "good").withColumn("rate_good", F.round("rate_good", 6))


@query(
    "agg09_index_percentiles",
    "WITH g AS (SELECT lang, list_sort(list(n_chars)) AS s FROM documents GROUP BY lang) SELECT lang, s[least(floor(len(s) * 0.5), len(s) - 1)::INT + 1] AS p50, s[least(floor(len(s) * 0.9), len(s) - 1)::INT + 1] AS p90 FROM g",
)
def agg09(spark, sf_dir):
    return stats.percentiles(table(spark, sf_dir, "documents"), ["lang"], "n_chars", [0.5, 0.9])


_ARMS = "SELECT l_returnflag AS arm, l_linestatus = 'O' AS compiled, l_quantity AS deleted, l_linenumber % 2 AS lost, l_discount > 0.05 AS strict, CASE WHEN l_linenumber <> 3 THEN 1 - l_tax END AS sim, l_partkey AS out_tokens, l_orderkey, l_linenumber FROM lineitem"


def _arms(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("arm"), (F.col("l_linestatus") == "O").alias("compiled"), F.col("l_quantity").alias("deleted"), (F.col("l_linenumber") % 2).alias("lost"),
        (F.col("l_discount") > 0.05).alias("strict"), F.when(F.col("l_linenumber") != 3, 1 - F.col("l_tax")).alias("sim"), F.col("l_partkey").alias("out_tokens"), "l_orderkey", "l_linenumber",
    )


@query(
    "agg11_held_out_table",
    f"WITH a AS ({_ARMS}) SELECT arm, count(*) AS n, round(avg(compiled::INT) * 100, 6) AS compiles, round(avg((compiled AND deleted <= 40)::INT) * 100, 6) AS few_deleted, round(avg((compiled AND deleted <= 40 AND lost = 0)::INT) * 100, 6) AS intact, "
    "round(avg(strict::INT) * 100, 6) AS strict, round(avg(coalesce(compiled AND sim >= 0.95, false)::INT) * 100, 6) AS near, round(avg(CASE WHEN NOT compiled THEN 0 ELSE sim END), 6) AS mean_sim, round(avg(out_tokens), 6) AS mean_tokens FROM a GROUP BY arm",
)
def agg11(spark, sf_dir):
    out = stats.held_out_table(_arms(spark, sf_dir))
    return out.select("arm", "n", *[F.round(c, 6).alias(c) for c in out.columns[2:]])


@query(
    "agg12_mcnemar",
    "WITH p AS (SELECT quality = 1 AS a, toxic = 1 AS b FROM labels), c AS (SELECT count(*) AS n, count(*) FILTER (WHERE a AND NOT b) AS x, count(*) FILTER (WHERE b AND NOT a) AS y FROM p), "
    "t AS (SELECT n, x, y, list_sum(list_transform(range(0, least(x, y) + 1), lambda i: exp(lgamma(x + y + 1) - lgamma(i + 1) - lgamma(x + y - i + 1) - (x + y) * ln(2)))) AS s FROM c) "
    "SELECT n, x AS a_only, y AS b_only, round(CASE WHEN x + y = 0 THEN 1.0 ELSE least(1.0, 2 * s) END, 9) AS p FROM t",
)
def agg12(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    pairs = joins.paired(labels.select("doc_id", (F.col("quality") == 1).alias("m")), labels.select("doc_id", (F.col("toxic") == 1).alias("m")), "doc_id", "m")
    return stats.mcnemar(pairs).withColumn("p", F.round("p", 9))


@query(
    "agg13_rank_checkpoints",
    f"WITH a AS ({_ARMS}) SELECT l_linenumber, round(avg(compiled::INT) FILTER (WHERE arm IN ('A', 'N')), 6) AS pooled, round(avg(compiled::INT) FILTER (WHERE arm = 'R') * 100, 6) AS gate, coalesce(avg(compiled::INT) FILTER (WHERE arm = 'R') * 100 >= 45, false) AS passes FROM a GROUP BY 1",
)
def agg13(spark, sf_dir):
    out = stats.rank_checkpoints(_arms(spark, sf_dir), "l_linenumber", "arm", "compiled", ["A", "N"], "R", 45)
    return out.select("l_linenumber", F.round("pooled", 6).alias("pooled"), F.round("gate", 6).alias("gate"), "passes")


@query("agg14_cost", "SELECT lang, round(avg(n_chars / 4.0 * 2.5 + length(text) % 100 * 10.0) / 1e6 * 1000, 6) AS cost FROM documents GROUP BY lang")
def agg14(spark, sf_dir):
    cost = stats.cost_per_thousand(F.col("n_chars"), F.length("text") % 100, F.lit(2.5), F.lit(10.0))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.round(cost, 6).alias("cost"))


@query(
    "agg18_collapse",
    "SELECT l_partkey, arg_min(l_orderkey, row(l_orderkey, l_linenumber)) AS l_orderkey, count(*) AS n_rows FROM lineitem GROUP BY l_partkey",
)
def agg18(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", F.struct("l_orderkey", "l_linenumber").alias("pos"))
    return stats.collapse(rows, ["l_partkey"], "pos").select("l_partkey", "l_orderkey", "n_rows")


@query(
    "agg19_multiset_loss",
    "WITH b AS (SELECT l_suppkey, l_linenumber AS i, count(*) AS b FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1, 2), a AS (SELECT l_suppkey, l_linenumber AS i, count(*) AS a FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) "
    "SELECT l_suppkey, sum(greatest(0, b - coalesce(a, 0)))::BIGINT AS lost FROM b LEFT JOIN a USING (l_suppkey, i) GROUP BY l_suppkey",
)
def agg19(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber", "l_returnflag")
    return stats.multiset_loss(l.filter("l_returnflag = 'N'"), l.filter("l_returnflag = 'R'"), ["l_suppkey"], "l_linenumber")


# --- splits and samples

_MOD100 = "list_reduce(list_transform(range(1, 41), lambda i: instr('0123456789abcdef', substr(sha1({0}), i::INT, 1)) - 1), lambda a, d: (a * 16 + d) % 100)"


@query(
    "split01_stratified",
    "WITH d AS (SELECT doc_id, source, doc_id % 50 = 0 AS forced FROM documents), s AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE forced) AS f FROM d GROUP BY source), "
    "r AS (SELECT d.*, n, f, row_number() OVER (PARTITION BY source ORDER BY forced DESC, sha1('0:' || doc_id::VARCHAR), doc_id) AS place FROM d JOIN s USING (source)) "
    "SELECT doc_id, source, CASE WHEN place <= greatest(least(greatest(round_even(0.25 * n, 0), CASE WHEN n >= 2 THEN 1 ELSE 0 END), n - 1), f) THEN 'eval' ELSE 'train' END AS side FROM r",
)
def split01(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return splits.stratified(docs, "source", "doc_id", 0.25, F.col("doc_id") % 50 == 0).select("doc_id", "source", "side")


@query("split02_by_hash", f"SELECT doc_id, CASE WHEN {_MOD100.format('doc_id::VARCHAR')} < 20 THEN 'heldout' ELSE 'train' END AS side FROM documents")
def split02(spark, sf_dir):
    return splits.by_hash(table(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id"), 20)


@query(
    "split03_frozen",
    f"SELECT doc_id, CASE WHEN doc_id < 100 THEN CASE WHEN doc_id % 2 = 0 THEN 'heldout' ELSE 'train' END WHEN {_MOD100.format('doc_id::VARCHAR')} < 20 THEN 'heldout' ELSE 'train' END AS side FROM documents",
)
def split03(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    old = docs.filter("doc_id < 100").withColumn("side", F.when(F.col("doc_id") % 2 == 0, "heldout").otherwise("train"))
    return splits.frozen(docs, "doc_id", old, 20)


@query("split04_lowest_hashes", "WITH c AS (SELECT doc_id FROM (SELECT DISTINCT doc_id FROM documents) ORDER BY sha1(doc_id::VARCHAR) LIMIT 40) SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM c) THEN 'heldout' ELSE 'train' END AS side FROM documents")
def split04(spark, sf_dir):
    return splits.lowest_hashes(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 40)


@query(
    "split05_document_split",
    "WITH s AS (SELECT DISTINCT source FROM documents), n AS (SELECT count(*) AS n FROM s), r AS (SELECT source, row_number() OVER (ORDER BY sha1('0:' || source), source) AS p FROM s) "
    "SELECT doc_id, CASE WHEN p <= least(4, n // 3) THEN 'heldout' WHEN p <= least(4, n // 3) + greatest(1, floor(0.2 * (n - least(4, n // 3)))) THEN 'val' ELSE 'train' END AS side FROM documents JOIN r USING (source), n",
)
def split05(spark, sf_dir):
    return splits.document_split(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", 4, 0.2).select("doc_id", "side")


_U = "('0x' || left(sha1('0:' || doc_id::VARCHAR), 8))::BIGINT / 4294967296.0"


@query(
    "smp01_weighted",
    f"WITH w AS (SELECT doc_id, CASE lang WHEN 'en' THEN 0.25 WHEN 'fr' THEN 2.5 ELSE 1 END AS w FROM documents), t AS (SELECT doc_id, floor(w) + CASE WHEN {_U} < w - floor(w) THEN 1 ELSE 0 END AS t FROM w) "
    "SELECT doc_id, unnest(range(0, t::BIGINT)) AS copy FROM t",
)
def smp01(spark, sf_dir):
    w = F.when(F.col("lang") == "en", 0.25).when(F.col("lang") == "fr", 2.5).otherwise(1.0)
    return splits.weighted(table(spark, sf_dir, "documents"), "doc_id", w).select("doc_id", "copy")


@query("smp02_sample", "SELECT doc_id FROM documents ORDER BY sha1('3:' || doc_id::VARCHAR), doc_id LIMIT 50")
def smp02(spark, sf_dir):
    return splits.sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 50, 3)


@query("smp03_shuffled_slice", "SELECT doc_id FROM documents ORDER BY sha1('3:' || doc_id::VARCHAR), doc_id LIMIT 50 OFFSET 20")
def smp03(spark, sf_dir):
    return splits.shuffled_slice(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 20, 50, 3)


@query("smp04_top_then_sample", "SELECT doc_id FROM (SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 200) ORDER BY sha1('0:' || doc_id::VARCHAR), doc_id LIMIT 30")
def smp04(spark, sf_dir):
    return splits.top_then_sample(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", 200, "doc_id", 30).select("doc_id")


@query("smp05_capped", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 5")
def smp05(spark, sf_dir):
    return selection.capped(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], 5)


@query("smp06_balanced", "SELECT doc_id FROM (SELECT d.doc_id, source, quality FROM documents d JOIN labels USING (doc_id)) QUALIFY row_number() OVER (PARTITION BY source, quality = 1 ORDER BY sha1('0:' || doc_id::VARCHAR), doc_id) <= 3")
def smp06(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return splits.balanced(rows, "source", F.col("quality") == 1, "doc_id", 3).select("doc_id")


@query("aux13_batches", "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY sha1('0:' || doc_id::VARCHAR), doc_id) - 1 AS p, count(*) OVER () AS n FROM documents) SELECT doc_id, (p // 32)::BIGINT AS batch FROM r WHERE p < n // 32 * 32")
def aux13(spark, sf_dir):
    return splits.batches(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 32)


# --- choosing rows


@query("win01_best_row", "SELECT o_custkey, arg_min(o_orderkey, row(-o_totalprice, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def win01(spark, sf_dir):
    return selection.best_row(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], -F.col("o_totalprice"), F.col("o_orderkey")).select("o_custkey", "o_orderkey")


@query(
    "win02_scaled_rank",
    "WITH r AS (SELECT l_orderkey, l_linenumber, l_linestatus = 'O' AS ok, dense_rank() OVER (PARTITION BY l_orderkey, l_linestatus = 'O' ORDER BY l_quantity) AS d FROM lineitem), m AS (SELECT *, max(d) OVER (PARTITION BY l_orderkey, ok) AS most FROM r) "
    "SELECT l_orderkey, l_linenumber, round(CASE WHEN NOT ok THEN 0.0 WHEN most <= 1 THEN 0.5 ELSE (d - 1) / (most - 1) END, 9) AS scaled FROM m",
)
def win02(spark, sf_dir):
    out = selection.scaled_rank(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_linestatus"), ["l_orderkey"], "l_quantity", F.col("l_linestatus") == "O")
    return out.select("l_orderkey", "l_linenumber", F.round("scaled", 9).alias("scaled"))


@query("win03_votes", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'O' THEN count(*) FILTER (WHERE l_linestatus = 'O') OVER (PARTITION BY l_orderkey, l_returnflag) ELSE 0 END AS votes FROM lineitem")
def win03(spark, sf_dir):
    return selection.votes(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"), ["l_orderkey"], ["l_returnflag"], F.col("l_linestatus") == "O").select("l_orderkey", "l_linenumber", "votes")


@query("win05_last_wins", "SELECT user_id, arg_max(event_id, event_id) AS event_id FROM events GROUP BY user_id")
def win05(spark, sf_dir):
    return selection.last_wins(table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], "event_id")


@query("win06_first_passing", "SELECT user_id, min(event_id) AS event_id FROM events WHERE value > 50 GROUP BY user_id")
def win06(spark, sf_dir):
    return selection.first_passing(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", F.col("value") > 50).select("user_id", "event_id")


@query(
    "win07_islands",
    "WITH e AS (SELECT l_suppkey, l_partkey AS a, l_partkey + l_linenumber AS b FROM lineitem), m AS (SELECT *, max(b) OVER (PARTITION BY l_suppkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e), "
    "i AS (SELECT *, sum(CASE WHEN a - reach <= 1 THEN 0 ELSE 1 END) OVER (PARTITION BY l_suppkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM m) SELECT l_suppkey, min(a) AS a, max(b) AS b, count(*) AS n FROM i GROUP BY l_suppkey, island",
)
def win07(spark, sf_dir):
    ranges = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_partkey").alias("a"), (F.col("l_partkey") + F.col("l_linenumber")).alias("b"))
    return selection.islands(ranges, ["l_suppkey"], "a", "b").drop("island")


@query("win08_around_line", "SELECT doc_id, sha1(array_to_string(string_split(text, chr(10))[greatest(1, 4 - 2):4 + 2], chr(10))) AS h FROM documents")
def win08(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha1(selection.around(F.col("text"), F.lit(4), 2)).alias("h"))


@query(
    "srt03_within_budget",
    "WITH r AS (SELECT user_id, event_id, sum(event_id % 50) OVER w AS t, row_number() OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)) SELECT user_id, event_id FROM r WHERE t <= 100 AND p <= 5",
)
def srt03(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 50).alias("size"))
    return selection.within_budget(rows, ["user_id"], ["event_id"], "size", 100, 5).select("user_id", "event_id")


_CANDS = "SELECT l_orderkey AS id, l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey AS i, l_linestatus = 'O' AS compiled, l_discount > 0.05 AS strict, l_quantity AS deleted, l_tax AS p_yes, l_suppkey % 3 AS votes, l_partkey AS len FROM lineitem"


def _cands(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"), (F.col("l_linenumber") * 10000000000 + F.col("l_partkey") * 10000 + F.col("l_suppkey")).alias("i"), (F.col("l_linestatus") == "O").alias("compiled"), (F.col("l_discount") > 0.05).alias("strict"),
        F.col("l_quantity").alias("deleted"), F.col("l_tax").alias("p_yes"), (F.col("l_suppkey") % 3).alias("votes"), F.col("l_partkey").alias("len"),
    )


@query(
    "sel01_best_of_k",
    f"WITH c AS ({_CANDS}) SELECT id, i FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY NOT compiled, CASE WHEN compiled THEN deleted > 40 END, CASE WHEN compiled THEN -p_yes END, CASE WHEN compiled THEN -votes END, CASE WHEN compiled THEN deleted END, i) = 1",
)
def sel01(spark, sf_dir):
    return selection.best_of_k(_cands(spark, sf_dir)).select("id", "i")


@query(
    "sel02_compare_rules",
    f"""WITH c AS (SELECT *, deleted > 40 AS over FROM ({_CANDS})), p AS (SELECT id, coalesce(arg_min(strict, row(-votes, deleted, i)) FILTER (WHERE compiled), false) AS a, coalesce(arg_min(strict, row(-p_yes, -votes, deleted, i)) FILTER (WHERE compiled), false) AS b,
coalesce(arg_min(strict, row(over, -p_yes, -votes, deleted, i)) FILTER (WHERE compiled), false) AS c, coalesce(arg_min(strict, row(over, -votes, deleted, i)) FILTER (WHERE compiled), false) AS d, coalesce(arg_min(strict, row(-(votes + 2 * p_yes), deleted, i)) FILTER (WHERE compiled), false) AS e,
coalesce(bool_or(compiled AND strict), false) AS f FROM c GROUP BY id),
u AS (SELECT unnest(['consensus', 'verifier', 'verifier+kept', 'consensus+kept', 'votes+2p', 'any']) AS rule, unnest([a, b, c, d, e, f]) AS good FROM p)
SELECT rule, count(*) AS n, count(*) FILTER (WHERE good) AS n_good FROM u GROUP BY rule""",
)
def sel02(spark, sf_dir):
    return selection.compare_rules(_cands(spark, sf_dir), "id", "strict")


@query("sel03_search_rules")
def sel03(spark, sf_dir):
    c = _cands(spark, sf_dir)
    return selection.search_rules(c.filter("id % 2 = 0"), c.filter("id % 2 = 1"), "id", "strict", ["deleted", "votes", "len"])


@query(
    "sel04_representatives",
    f"WITH c AS ({_CANDS}) SELECT id, votes, arg_min(i, row(deleted, len, i)) AS i, count(*) AS n_votes FROM c GROUP BY id, votes",
)
def sel04(spark, sf_dir):
    return selection.representatives(_cands(spark, sf_dir), "id", ["votes"]).select("id", "votes", "i", "n_votes")


@query(
    "sel07_accept_reference",
    """WITH c AS (SELECT l_orderkey AS doc, l_linenumber AS candidate, l_linenumber = 1 AS human, l_linestatus = 'O' AS ok, l_suppkey % 2 = 0 AS agreed, l_partkey % 3 = 0 AS faithful, l_quantity * 2 AS deleted, l_suppkey AS diff_lines FROM lineitem),
g AS (SELECT doc, bool_or(ok) AS any_ok, arg_min(candidate, row(NOT human, deleted, diff_lines, candidate)) FILTER (WHERE ok AND agreed AND deleted <= 40) AS a, arg_min(candidate, row(NOT human, deleted, diff_lines, candidate)) FILTER (WHERE ok AND faithful AND deleted <= 80) AS j FROM c GROUP BY doc)
SELECT doc, coalesce(a, j) AS candidate, CASE WHEN NOT any_ok THEN 'none_compiles' WHEN a IS NOT NULL THEN 'agreed' WHEN j IS NOT NULL THEN 'judged' ELSE 'not_faithful' END AS how FROM g""",
)
def sel07(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("candidate"), (F.col("l_linenumber") == 1).alias("human"), (F.col("l_linestatus") == "O").alias("ok"),
        (F.col("l_suppkey") % 2 == 0).alias("agreed"), (F.col("l_partkey") % 3 == 0).alias("faithful"), (F.col("l_quantity") * 2).alias("deleted"), F.col("l_suppkey").alias("diff_lines"),
    )
    return selection.accept_reference(c)


# --- sets


@query("set04_unique_texts", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY sha1(text)")
def set04(spark, sf_dir):
    return dedup.unique_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "doc_id").select("doc_id")


_NORM = r"sha1(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)))"


@query("set05_normal_unique", f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY {_NORM}")
def set05(spark, sf_dir):
    return dedup.unique_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "doc_id", True).select("doc_id")


@query(
    "set06_exclusion_stage",
    f"""WITH d AS (SELECT doc_id, {_NORM} AS h, doc_id % 11 = 0 AS used, doc_id % 13 = 0 AS rej, contains(text, 'token') AS ext FROM documents),
seen AS (SELECT DISTINCT h FROM d WHERE doc_id < 100), f AS (SELECT h, min(doc_id) AS m FROM d WHERE NOT used AND NOT rej AND NOT ext GROUP BY h)
SELECT doc_id, CASE WHEN used THEN 'used' WHEN rej THEN 'rejected' WHEN ext THEN 'external' WHEN d.h IN (SELECT h FROM seen) OR m < doc_id THEN 'dup' ELSE 'kept' END AS stage FROM d LEFT JOIN f USING (h)""",
)
def set06(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup.exclusion_stage(d, "doc_id", "text", "doc_id", d.filter("doc_id % 11 = 0"), d.filter("doc_id % 13 = 0"), F.col("text").contains("token"), d.filter("doc_id < 100"))
    return out.select("doc_id", "stage")


@query(
    "set02_leaks",
    "WITH h AS (SELECT unnest(['o_custkey', 'o_orderkey']) AS \"column\", unnest([o_custkey::VARCHAR, o_orderkey::VARCHAR]) AS key FROM orders WHERE o_orderkey % 10 = 0), t AS (SELECT unnest(['o_custkey', 'o_orderkey']) AS \"column\", unnest([o_custkey::VARCHAR, o_orderkey::VARCHAR]) AS key FROM orders WHERE o_orderkey % 10 <> 0) "
    "SELECT * FROM h INTERSECT SELECT * FROM t",
)
def set02(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return dedup.leaks(o.filter("o_orderkey % 10 = 0"), o.filter("o_orderkey % 10 <> 0"), "o_custkey", "o_orderkey")


@query("set10_path_leaks", "SELECT source, sum(len(regexp_extract_all(text, '/(?:Users|home|private|tmp|var/folders)/')))::BIGINT AS n_paths FROM documents GROUP BY source")
def set10(spark, sf_dir):
    return dedup.leaked_paths(table(spark, sf_dir, "documents"), "source", "text")


# --- rewards


@query(
    "rwd01_reward",
    f"""WITH c AS (SELECT *, i % 5 <> 0 AS applied, CASE WHEN i % 7 <> 3 THEN 1 - p_yes END AS sim FROM ({_CANDS})), k AS (SELECT *, 1 - least(1.0, greatest(0.0, (deleted - 25) / 125.0)) AS keep FROM c)
SELECT id, i, round(CASE WHEN NOT applied THEN -0.2 WHEN NOT compiled THEN 0 ELSE (1 + 0.5 * strict::INT) * keep END, 9) AS strict_mode,
round(CASE WHEN NOT applied THEN -0.2 WHEN NOT compiled THEN 0 WHEN sim IS NOT NULL THEN (sim >= 0.95)::INT ELSE (1 + 0.5 * strict::INT) * keep END, 9) AS gate_mode,
round(CASE WHEN NOT applied THEN -0.2 WHEN NOT compiled THEN 0 WHEN sim IS NOT NULL THEN 1 + sim * sim ELSE (1 + 0.5 * strict::INT) * keep END, 9) AS sim_mode,
round(CASE WHEN NOT applied THEN -0.2::DOUBLE WHEN NOT compiled THEN 0 ELSE (deleted <= 40)::INT + strict::INT END, 9) AS ke_mode FROM k""",
)
def rwd01(spark, sf_dir):
    c = _cands(spark, sf_dir).withColumn("applied", F.col("i") % 5 != 0).withColumn("sim", F.when(F.col("i") % 7 != 3, 1 - F.col("p_yes")))
    args = [F.col(x) for x in ("applied", "compiled", "strict", "deleted", "sim")] + [F.lit(0)]
    return c.select("id", "i", *[F.round(R.reward(*args, mode=m), 9).alias(f"{m}_mode") for m in ("strict", "gate", "sim", "ke")])


# --- what built-in expressions cannot say (rows only; tests hold them against plain Python)


@query("edit07_derive_edits")
def edit07(spark, sf_dir):
    from tessella.functions.python_text import derive_edits_udf

    docs = table(spark, sf_dir, "documents").withColumn("broken", F.regexp_replace("text", "\\bthe\\b", "teh"))
    return docs.select("doc_id", derive_edits_udf("text", "broken").alias("d")).select("doc_id", "d.reason", F.size("d.edits").alias("n_edits"))


@query("edit15_changed_lines")
def edit15(spark, sf_dir):
    from tessella.functions.python_text import changed_lines_udf

    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", changed_lines_udf("text", F.replace("text", F.lit("the"), F.lit("teh"))).alias("n"))


@query("sim01_words_similarity")
def sim01(spark, sf_dir):
    from tessella.functions.python_text import words_similarity_udf

    other = F.concat(F.substring("text", 20, 1 << 30), F.substring("text", 1, 20))
    return table(spark, sf_dir, "documents").select("doc_id", words_similarity_udf("text", other).alias("words"))


@query("sim02_text_similarity")
def sim02(spark, sf_dir):
    from tessella.functions.python_text import text_similarity_udf

    return table(spark, sf_dir, "documents").select("doc_id", text_similarity_udf("text", F.replace("text", F.lit("the"), F.lit("teh"))).alias("chars"))


@query(
    "sim06_line_jaccard",
    r"""WITH s AS (SELECT doc_id, list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')) AS a, list_distinct(list_filter(list_transform(string_split(replace(text, 'the', 'teh'), chr(10)), lambda x: trim(x)), lambda x: x <> '')) AS b FROM documents)
SELECT doc_id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 9) AS j FROM s WHERE len(a) > 0""",
)
def sim06(spark, sf_dir):
    a, b = X.line_set(F.col("text")), X.line_set(F.replace("text", F.lit("the"), F.lit("teh")))
    return table(spark, sf_dir, "documents").filter(F.size(a) > 0).select("doc_id", F.round(X.jaccard(a, b), 9).alias("j"))


@query("gen_perturbed")
def gen_perturbed(spark, sf_dir):
    from tessella.operators.perturb import perturbed

    t = F.concat(F.lit("\\documentclass{article}\n\\usepackage{amsmath}\n\\begin{document}\n"), F.regexp_replace("text", "\\b([a-z]{8,})\\b", "\\\\emph{$1}"), F.lit("\n\\end{document}\n"))
    docs = table(spark, sf_dir, "documents").select("doc_id", t.alias("tex"))
    return perturbed(docs, "tex").select("doc_id", "mutation", "seed", F.col("edit.search").alias("search"), F.col("edit.replace").alias("replace"))


@query("log01_parse")
def log01(spark, sf_dir):
    from tessella.functions.logs import error_lines, parse_log_udf

    log = F.concat(F.lit("(./main.tex\n! Undefined control sequence.\nl."), F.col("doc_id") + 1, F.lit(" \\foo\n(./sections/a.tex\nLaTeX Warning: x on input line 3.\n! "), F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("\nl.7 y\n))"))
    docs = table(spark, sf_dir, "documents").select("doc_id", parse_log_udf(log, F.lit("main.tex")).alias("items"))
    e = error_lines(F.col("items"), F.lit("main.tex"), F.array(F.lit("main.tex"), F.lit("sections/a.tex")))
    return docs.select("doc_id", F.size("items").alias("n_items"), F.explode(e).alias("e")).select("doc_id", "n_items", "e.line", "e.file", "e.fileLabel")


_PROMPT_HEAD = "'The LaTeX file `main.tex` fails to compile. Apply the smallest edit that fixes the compile errors and keep my content intact.' || chr(10) || 'Errors:' || chr(10) || '- line 1: bad'"


@query(
    "prm01_fix_prompt",
    f"""WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE trim(text) <> ''),
b AS (SELECT doc_id, len(l) <= 120 AS whole, left(array_to_string(list_transform(CASE WHEN len(l) <= 120 THEN l ELSE l[1:26] END, lambda x, i: i::VARCHAR || ': ' || x), chr(10)), 4000) AS src FROM s)
SELECT doc_id, sha1({_PROMPT_HEAD} || chr(10) || chr(10) || 'Current content of `main.tex` (' || CASE WHEN whole THEN 'full file' ELSE 'lines 1-26' END || ', line-numbered):' || chr(10) || '```' || chr(10) || src || chr(10) || '```' || chr(10) || chr(10) || 'Compile log (tail):' || chr(10) || '```' || chr(10) || 'log' || chr(10) || '```') AS h FROM b""",
)
def prm01(spark, sf_dir):
    from tessella.functions.prompts import fix_prompt

    errors = F.array(F.struct(F.lit(1).alias("line"), F.lit("bad").alias("text"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("string").alias("fileLabel")))
    docs = table(spark, sf_dir, "documents").filter(F.trim("text") != "")
    return docs.select("doc_id", F.sha1(fix_prompt(F.lit("main.tex"), F.col("text"), errors, F.lit("log"))).alias("h"))


@query(
    "prm06_messages",
    "SELECT conv_id, turn, 3 AS n_messages, sha1('user' || text || 'assistant' || upper(role)) AS h FROM conversations",
)
def prm06(spark, sf_dir):
    from tessella.functions.prompts import messages

    m = messages(F.col("text"), F.upper("role"))
    rows = table(spark, sf_dir, "conversations").withColumn("m", m)
    said = F.array_join(F.transform(F.slice("m", 2, 2), lambda x: F.concat(x["role"], x["content"])), "")
    return rows.select("conv_id", "turn", F.size("m").alias("n_messages"), F.sha1(said).alias("h"))


@query(
    "rec01_closure",
    "WITH RECURSIVE e AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 1 UNION ALL SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey > 2 UNION ALL SELECT 1, 5), "
    "c AS (SELECT p_partkey AS root, p_partkey AS node FROM part UNION SELECT root, dst FROM c JOIN e ON node = src) SELECT root, node FROM c",
)
def rec01(spark, sf_dir):
    from tessella.operators.closure import closure

    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part").select(k)
    half = part.filter(k > 1).select(k.alias("src"), F.floor(k / 2).alias("dst"))
    third = part.filter(k > 2).select(k.alias("src"), F.floor(k / 3).alias("dst"))
    edges = half.unionByName(third).unionByName(part.limit(1).select(F.lit(1).cast("long").alias("src"), F.lit(5).cast("long").alias("dst"))).withColumn("g", F.lit(0))
    roots = part.select(F.lit(0).alias("g"), k.alias("root"))
    return closure(edges, roots, ["g"]).select("root", "node")


@query(
    "strm09_episodes",
    "SELECT user_id AS episode, event_id AS turn, count(*) OVER w AS turns, sum(CASE WHEN event_type <> 'view' THEN event_id % 7 ELSE 0 END) OVER w AS deleted_so_far FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)",
)
def strm09(spark, sf_dir):
    from tessella.streaming.incremental import episodes

    turns = table(spark, sf_dir, "events").select(F.col("user_id").alias("episode"), F.col("event_id").alias("turn"), (F.col("event_id") % 7).alias("deleted"), (F.col("event_type") != "view").alias("applied"), F.lit(0).alias("think_chars"))
    return episodes(turns).select("episode", "turn", "turns", "deleted_so_far")


@query("strm02_todo", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def strm02(spark, sf_dir):
    from tessella.streaming.incremental import todo

    log = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "kept").otherwise("worker_error").alias("stage"), F.lit(1).alias("at"))
    return todo(table(spark, sf_dir, "documents").select("doc_id"), log, "doc_id", ("worker_error",))


@query("strm05_latest", "SELECT user_id, arg_max(event_type, ts) AS event_type FROM events GROUP BY user_id")
def strm05(spark, sf_dir):
    from tessella.streaming.incremental import latest

    return latest(table(spark, sf_dir, "events").select("user_id", "event_type", "ts"), "user_id", "ts").select("user_id", "event_type")


@query(
    "rpt01_mining_report",
    f"""WITH d AS (SELECT doc_id, source, {_NORM} AS h, doc_id % 11 = 0 AS used, contains(text, 'token') AS ext FROM documents), f AS (SELECT h, min(doc_id) AS m FROM d WHERE NOT used AND NOT ext GROUP BY h),
s AS (SELECT CASE WHEN used THEN 'used' WHEN ext THEN 'external' WHEN m < doc_id THEN 'dup' ELSE 'kept' END AS stage FROM d LEFT JOIN f USING (h))
SELECT stage, count(*) AS n, coalesce(list_position(['used', 'rejected', 'external', 'dup', 'kept'], stage), 6)::INT AS place FROM s GROUP BY stage""",
)
def rpt01(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    staged = dedup.exclusion_stage(d, "doc_id", "text", "doc_id", d.filter("doc_id % 11 = 0"), d.limit(0), F.col("text").contains("token"), d.limit(0))
    empty = d.limit(0).select(F.lit("").alias("error_category"), F.array(F.lit("")).alias("tags"), F.lit("").alias("created"), F.lit(0).alias("diff_lines"))
    report = reports.mining_report(staged, empty, ["used", "rejected", "external", "dup", "kept"])
    return report["funnel"].withColumn("place", F.col("place").cast("int"))


from . import collection, inventory, texts  # noqa: E402 - fill the same registry

__all__ = ["ORACLE", "QUERIES", "collection", "inventory", "texts"]
