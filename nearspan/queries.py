"""Queries over the test tables, one or more for each family of operators, and DuckDB statements of the same.

Where DuckDB has no function of a kind, the statement runs its dynamic program: a recursive query that makes one row
of the table at a time, as a list.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearspan.facades import fuzz
from nearspan.functions import matrices
from nearspan.functions.sql import register
from nearspan.operators import joins, ranking

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Distinct strings of a column, each under its smallest key.
_NAMES = "SELECT p_name AS s, min(p_partkey) AS k FROM part GROUP BY p_name"
_URLS = "SELECT url AS s, min(page_id) AS k FROM pages GROUP BY url"
_NATIONS = "SELECT n_name AS s, n_nationkey AS k FROM nation"


def query(name: str, oracle: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def strings(spark: SparkSession, sf_dir: str, table: str, text: str, key: str) -> DataFrame:
    return read(spark, sf_dir, table).groupBy(F.col(text).alias("s")).agg(F.min(F.col(key)).cast("long").alias("k"))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strings(spark, sf_dir, "part", "p_name", "p_partkey")


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strings(spark, sf_dir, "pages", "url", "page_id")


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").select(F.col("n_name").alias("s"), F.col("n_nationkey").cast("long").alias("k"))


#: How the joins find the columns of these frames.
_HOW = {"query": "s", "target": "s", "query_index": "k", "target_index": "k"}


def sql_query(name: str, source: Callable[[SparkSession, str], DataFrame], columns: dict[str, str], needs: tuple[str, ...], oracle: str | None = None) -> None:
    """A query whose columns are SQL expressions over a frame, with functions of the library in them."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, only=needs)
        return source(spark, sf_dir).select(*(F.expr(e).alias(c) for c, e in columns.items()))

    QUERIES[name] = run
    if oracle:
        ORACLES[name] = oracle


# Edit distances and similarities

sql_query(
    "ed1_levenshtein", lambda s, d: read(s, d, "part"),
    {"p_partkey": "p_partkey", "distance": "ns_levenshtein(p_name, 'cold widgit')", "similarity": "ns_levenshtein_similarity(p_name, 'cold widgit')"}, ("levenshtein", "levenshtein_similarity"),
    """SELECT p_partkey, CAST(levenshtein(p_name, 'cold widgit') AS BIGINT) AS distance,
  1.0::DOUBLE - levenshtein(p_name, 'cold widgit')::DOUBLE / greatest(length(p_name), 11)::DOUBLE AS similarity FROM part""",
)
sql_query(
    "ed2_levenshtein_cutoff", lambda s, d: read(s, d, "part"),
    {"p_partkey": "p_partkey", "distance": "ns_levenshtein_score(p_name, 'cold widgit', 4L)", "similarity": "ns_levenshtein_normalized_score(p_name, 'cold widgit', 0.5D)"}, ("levenshtein_score", "levenshtein_normalized_score"),
    """SELECT p_partkey, CAST(least(levenshtein(p_name, 'cold widgit'), 5) AS BIGINT) AS distance, CASE WHEN s < 0.5 THEN 0.0::DOUBLE ELSE s END AS similarity
FROM (SELECT *, 1.0::DOUBLE - levenshtein(p_name, 'cold widgit')::DOUBLE / greatest(length(p_name), 11)::DOUBLE AS s FROM part)""",
)


def dp(pairs: str, first: str, edge: str, cell: str, pick: str, best: str = "best", kind: str = "BIGINT") -> str:
    """DuckDB: a dynamic program over pairs (x, y, a, b), a row of its table for each step of a recursive query.

    first: row 0; edge: column 0 of row i; cell: the cell of row i and column j, from l (this row so far), p (the row
    before) and q (the row before that), which begin at column 0 with [1]; best: what is kept of each row r.
    """
    return f"""WITH RECURSIVE pairs AS ({pairs}), dp AS (
  SELECT x, y, a, b, CAST(0 AS BIGINT) AS i, {first} AS p, {first} AS q, CAST(0 AS {kind}) AS best FROM pairs
  UNION ALL
  SELECT x, y, a, b, i, r, p, {best} FROM (
    SELECT x, y, a, b, i, p, best, list_reduce(
      list_concat([[CAST({edge} AS {kind})]], list_transform(range(1, len(b) + 1), lambda j: [CAST(j AS {kind})])), lambda l, t: list_append(l, CAST({cell} AS {kind}))) AS r
    FROM (SELECT x, y, a, b, i + 1 AS i, p, q, best FROM dp WHERE i < len(a)))
) SELECT x, y, {pick} FROM dp WHERE i = len(a)""".replace("{j}", "CAST(t[1] AS BIGINT)")


_SAME = "a[i] = b[{j}]"
_COUNT = "list_transform(range(0, len(b) + 1), lambda j: CAST(j AS BIGINT))"
_ZEROS = "list_transform(range(0, len(b) + 1), lambda j: CAST(0 AS BIGINT))"
_INDEL = f"CASE WHEN {_SAME} THEN p[{{j}}] ELSE 1 + least(p[{{j}} + 1], l[len(l)]) END"
_ALIGN = f"greatest(p[{{j}}] + CASE WHEN {_SAME} THEN {{match}} ELSE -1 END, p[{{j}} + 1] - 1, l[len(l)] - 1)"
_NAME_PAIRS = f"SELECT k AS x, 0 AS y, s AS a, 'cold widgit' AS b FROM ({_NAMES})"
_WORD_PAIRS = f"SELECT k AS x, 0 AS y, s AS a, 'bolt widget cold large bolt' AS b FROM ({_NAMES})"
_GRID = f"SELECT a.k AS x, b.k AS y, a.s AS a, b.s AS b FROM ({_NATIONS}) a, ({_NATIONS}) b"


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nations(spark, sf_dir)
    return n.select(F.col("k").alias("x"), F.col("s").alias("a")).crossJoin(n.select(F.col("k").alias("y"), F.col("s").alias("b")))


def _against(frame: Callable, literal: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: frame(spark, sf_dir).select(F.col("k").alias("x"), F.lit(0).alias("y"), F.col("s").alias("a"), F.lit(literal).alias("b"))


_names, _words = _against(names, "cold widgit"), _against(names, "bolt widget cold large bolt")


def pair_query(name: str, source: Callable, columns: dict[str, str], oracle: str | None = None) -> None:
    """columns: of function calls on a and b, without the prefix."""
    needs = tuple(e.split("(")[0] for e in columns.values())
    sql_query(name, source, {"x": "x", "y": "y", **{c: f"ns_{e}" for c, e in columns.items()}}, needs, oracle)


def _winkler(a: str, b: str) -> str:
    """Jaro-Winkler as j + l * 0.1 * (1 - j); DuckDB's own function rounds the bonus otherwise in the last digit."""
    j = f"jaro_similarity({a}, {b})"
    prefix = " + ".join(f"CAST(length({a}) >= {k} AND length({b}) >= {k} AND {a}[1:{k}] = {b}[1:{k}] AS INT)" for k in range(1, 5))
    return f"CASE WHEN {j} >= 0.7::DOUBLE THEN {j} + CAST({prefix} AS DOUBLE) * 0.1::DOUBLE * (1.0::DOUBLE - {j}) ELSE {j} END"


def _share(d: str, most: str) -> str:
    return f"1.0::DOUBLE - CAST({d} AS DOUBLE) / {most}"


pair_query(
    "ed3_osa", _names, {"distance": "osa(a, b)", "similarity": "osa_similarity(a, b)"},
    dp(_NAME_PAIRS, _COUNT, "i", f"least(p[{{j}}] + CASE WHEN {_SAME} THEN 0 ELSE 1 END, p[{{j}} + 1] + 1, l[len(l)] + 1, CASE WHEN i > 1 AND {{j}} > 1 AND a[i] = b[{{j}} - 1] AND a[i - 1] = b[{{j}}] THEN q[{{j}} - 1] + 1 ELSE 1000 END)",
       f"p[len(p)] AS distance, {_share('p[len(p)]', 'greatest(len(a), len(b))')} AS similarity"),
)
pair_query(
    "ed5_true_damerau_levenshtein", _names, {"distance": "true_damerau_levenshtein(a, b)", "similarity": "true_damerau_levenshtein_similarity(a, b)"},
    f"SELECT x, y, CAST(damerau_levenshtein(a, b) AS BIGINT) AS distance, {_share('damerau_levenshtein(a, b)', 'greatest(length(a), length(b))')} AS similarity FROM ({_NAME_PAIRS})",
)
pair_query(
    "ed7_indel", _names, {"distance": "indel(a, b)", "similarity": "indel_similarity(a, b)"},
    dp(_NAME_PAIRS, _COUNT, "i", _INDEL, f"p[len(p)] AS distance, {_share('p[len(p)]', '(len(a) + len(b))')} AS similarity"),
)
_HAMMING = "hamming(c_name, 'Customer#000000042')"
sql_query(
    "ed9_hamming", lambda s, d: read(s, d, "customer"), {"c_custkey": "c_custkey", "distance": "ns_hamming(c_name, 'Customer#000000042')", "similarity": "ns_hamming_similarity(c_name, 'Customer#000000042')"}, ("hamming", "hamming_similarity"),
    f"SELECT c_custkey, CAST({_HAMMING} AS BIGINT) AS distance, {_share(_HAMMING, '18')} AS similarity FROM customer",
)
pair_query("ed11_jaro", _grid, {"similarity": "jaro(a, b)"}, f"SELECT x, y, jaro_similarity(a, b) AS similarity FROM ({_GRID})")
pair_query("ed12_jaro_winkler", _names, {"similarity": "jaro_winkler(a, b)"}, f"SELECT x, y, {_winkler('a', 'b')} AS similarity FROM ({_NAME_PAIRS})")

# Alignments

pair_query(
    "al1_smith_waterman", _names, {"score": "smith_waterman(a, b)", "similarity": "smith_waterman_normalized_score(a, b)"},
    dp(_NAME_PAIRS, _ZEROS, "0", f"greatest(0, {_ALIGN.replace('{match}', '2')})", "best AS score, least(1.0::DOUBLE, CAST(best AS DOUBLE) / (least(len(a), len(b)) * 2.0::DOUBLE)) AS similarity", "greatest(best, list_max(r))"),
)
pair_query(
    "al5_needleman_wunsch", _names, {"score": "needleman_wunsch(a, b)", "similarity": "needleman_wunsch_normalized_score(a, b)"},
    dp(_NAME_PAIRS, _COUNT.replace("CAST(j", "CAST(-j"), "-i", _ALIGN.replace("{match}", "2"), "p[len(p)] AS score, greatest(0.0::DOUBLE, least(1.0::DOUBLE, CAST(p[len(p)] AS DOUBLE) / (greatest(len(a), len(b)) * 2.0::DOUBLE))) AS similarity"),
)
pair_query("al2_affine", _names, {"local": "smith_waterman_affine(a, b)", "global": "needleman_wunsch_affine(a, b)"})


@query("al8_paths")
def al8_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, only=("needleman_wunsch_path", "smith_waterman_cigar"))
    found = _names(spark, sf_dir).withColumn("p", F.expr("ns_needleman_wunsch_path(a, b)")).withColumn("local_cigar", F.expr("ns_smith_waterman_cigar(a, b)"))
    return found.select("x", "p.score", "p.cigar", "p.matches", "p.mismatches", "p.insertions", "p.deletions", "p.aligned_query", "p.aligned_target", "local_cigar")


# Matrices

_MATRIX = "identity_matrix('abcdefghijklmnopqrstuvwxyz ', 1, -1, '*')"
sql_query(
    "mx1_matrix_score", _names, {"x": "x", "y": "y", "score": f"ns_smith_waterman_matrix_score(a, b, ns_{_MATRIX})"}, ("smith_waterman_matrix_score", "identity_matrix"),
    dp(_NAME_PAIRS, _ZEROS, "0", f"greatest(0, {_ALIGN.replace('{match}', '1')})", "best AS score", "greatest(best, list_max(r))"),
)


def _letters() -> matrices.Matrix:
    return matrices.ascii_text()


@query("jn6_cdist_matrix", dp(_GRID, _COUNT.replace("CAST(j", "CAST(-j"), "-i", _ALIGN.replace("{match}", "1"), "p[len(p)] AS score"))
def jn6_cdist_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nations(spark, sf_dir)
    return joins.cdist_matrix(n, n, _letters(), False, **_HOW).select(F.col("query_index").alias("x"), F.col("target_index").alias("y"), "score")


_LOCAL = dp(_GRID, _ZEROS, "0", f"greatest(0, {_ALIGN.replace('{match}', '1')})", "best AS score", "greatest(best, list_max(r))")


@query("jn7_matrix_above_threshold", f"SELECT * FROM ({_LOCAL}) WHERE score >= 8")
def jn7_matrix_above_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nations(spark, sf_dir)
    return joins.matrix_above_threshold(n, n, _letters(), 8, **_HOW).select(F.col("query_index").alias("x"), F.col("target_index").alias("y"), "score")


@query("jn8_matrix_top_k", f"SELECT * FROM ({_LOCAL}) ORDER BY score DESC, x, y LIMIT 40")
def jn8_matrix_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nations(spark, sf_dir)
    return joins.matrix_top_k(n, n, _letters(), 40, **_HOW).select(F.col("query_index").alias("x"), F.col("target_index").alias("y"), "score")


# One to many, ranking

_ARRAY = f"(SELECT list(s ORDER BY k) FROM ({_NATIONS}))"


def _with_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation beside the array of all, which has 25 elements."""
    n = nations(spark, sf_dir)
    every = n.agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "s"))), lambda x: x["s"]).alias("all"))
    return n.crossJoin(every)


@query("vec1_scores", f"SELECT k AS x, CAST(j - 1 AS BIGINT) AS y, CAST(levenshtein(s, a[j]) AS BIGINT) AS score, {_winkler('s', 'a[j]')} AS near FROM (SELECT s, k, {_ARRAY} AS a, unnest(range(1, 26)) AS j FROM ({_NATIONS}))")
def vec1_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, only=("levenshtein_scores", "jaro_winkler_similarities"))
    both = _with_array(spark, sf_dir).withColumn("d", F.expr("arrays_zip(ns_levenshtein_scores(s, all), ns_jaro_winkler_similarities(s, all))"))
    rows = both.select(F.col("k").alias("x"), F.posexplode("d").alias("y", "v"))
    return rows.select("x", F.col("y").cast("long").alias("y"), F.col("v.0").alias("score"), F.col("v.1").alias("near"))


@query("top1_top_k", f"SELECT x, r AS rank, y, score FROM (SELECT a.k AS x, b.k AS y, CAST(levenshtein(a.s, b.s) AS BIGINT) AS score, row_number() OVER (PARTITION BY a.k ORDER BY levenshtein(a.s, b.s), b.k) AS r FROM ({_NATIONS}) a, ({_NATIONS}) b) WHERE r <= 4")
def top1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, only=("levenshtein_top_k",))
    found = _with_array(spark, sf_dir).withColumn("m", F.expr("ns_levenshtein_top_k(s, all, 4)"))
    rows = found.select(F.col("k").alias("x"), F.posexplode("m").alias("r", "m"))
    return rows.select("x", (F.col("r") + 1).cast("long").alias("rank"), F.col("m.index").alias("y"), F.col("m.score").alias("score"))


@query("agg2_best", f"SELECT a.k AS x, arg_max(b.k, jaro_similarity(a.s, b.s) - b.k / 1e9) AS y, max(jaro_similarity(a.s, b.s)) AS score FROM ({_NATIONS}) a JOIN ({_NATIONS}) b ON a.k <> b.k GROUP BY a.k")
def agg2_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, only=("jaro_best",))
    others = _with_array(spark, sf_dir).withColumn("others", F.transform("all", lambda t: F.when(t != F.col("s"), t)))
    return others.withColumn("m", F.expr("ns_jaro_best(s, others)")).select(F.col("k").alias("x"), F.col("m.index").cast("int").alias("y"), F.col("m.score").alias("score"))


@query("top6_extract", f"SELECT s AS choice, 1.0::DOUBLE - levenshtein(s, 'cold widgit')::DOUBLE / greatest(length(s), 11)::DOUBLE AS score, k AS index FROM ({_NAMES}) ORDER BY score DESC, index LIMIT 5")
def top6_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.extract(names(spark, sf_dir), "cold widgit", "s", "k")


# Joins

_NEAR = "1.0::DOUBLE - levenshtein(a.s, b.s)::DOUBLE / greatest(length(a.s), length(b.s))::DOUBLE"


@query("jn1_cdist", f"SELECT a.k AS query_index, b.k AS target_index, {_winkler('a.s', 'b.s')} AS score FROM ({_NAMES}) a, ({_NAMES}) b")
def jn1_cdist(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = names(spark, sf_dir)
    return joins.cdist(n, n, "jaro_winkler", **_HOW).select("query_index", "target_index", "score")


@query("jn2_above_threshold", f"SELECT {_NEAR} AS score, a.s AS query, b.s AS target, a.k AS query_index, b.k AS target_index FROM ({_NAMES}) a, ({_NAMES}) b WHERE score >= 0.7")
def jn2_above_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = names(spark, sf_dir)
    return joins.above_threshold(n, n, "levenshtein_normalized", 0.7, **_HOW)


@query("jn2_urls", f"SELECT {_NEAR} AS score, a.k AS query_index, b.k AS target_index FROM ({_URLS}) a, ({_URLS}) b WHERE score >= 0.85")
def jn2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = urls(spark, sf_dir)
    return joins.above_threshold(u, u, "levenshtein_normalized", 0.85, **_HOW).select("score", "query_index", "target_index")


@query("jn3_top_k", f"SELECT {_NEAR} AS score, a.k AS query_index, b.k AS target_index FROM ({_NAMES}) a, ({_NAMES}) b WHERE a.s <> b.s ORDER BY score DESC, query_index, target_index LIMIT 50")
def jn3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = names(spark, sf_dir)
    return joins.top_k(n, n, "levenshtein_normalized", 50, reject_duplicates=True, **_HOW).select("score", "query_index", "target_index")


@query("jn4_top_k_per_query", f"SELECT query_index, rank, score, target_index FROM (SELECT a.k AS query_index, b.k AS target_index, {_NEAR} AS score, CAST(row_number() OVER (PARTITION BY a.k ORDER BY {_NEAR} DESC, b.k) AS INT) AS rank FROM ({_URLS}) a, ({_URLS}) b) WHERE rank <= 3")
def jn4_top_k_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = urls(spark, sf_dir)
    return joins.top_k_per_query(u, u, "levenshtein_normalized", 3, **_HOW).select("query_index", "rank", "score", "target_index")


@query("jn10_process_cdist", f"SELECT x AS query_index, y AS target_index, CASE WHEN s >= 60 THEN s ELSE 0.0::DOUBLE END AS score FROM ({dp(_GRID, _COUNT, 'i', _INDEL, '100.0::DOUBLE * (' + _share('p[len(p)]', '(len(a) + len(b))') + ') AS s')})")
def jn10_process_cdist(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nations(spark, sf_dir)
    scored = joins.cdist(n, n, fuzz.ratio, **_HOW)
    return scored.select("query_index", "target_index", F.when(F.col("score") >= 60, F.col("score")).otherwise(0.0).alias("score"))


def _soundex_sql(s: str) -> str:
    """Letters alone; H and W go, runs of one digit become one, and so do vowels, which part runs."""
    w = f"regexp_replace(upper({s}), '[^A-Z]', '', 'g')"
    codes = f"list_filter(string_split({w}[1] || regexp_replace({w}[2:], '[HW]', '', 'g'), ''), lambda c: c <> '')"
    digits = f"list_transform({codes}, lambda c: translate(c, 'BFPVCGJKQSXZDTLMNRAEIOUYHW', '11112222222233455600000000'))"
    runs = f"list_filter({digits}, lambda c, i: i > 1 AND c <> '0' AND c <> ({digits})[i - 1])"
    return f"CASE WHEN {w} = '' THEN '' ELSE rpad({w}[1] || left(array_to_string({runs}, ''), 3), 4, '0') END"


@query("jn11_phonetic_join", f"SELECT a.c AS code, a.k AS query_index, b.k AS target_index FROM (SELECT k, {_soundex_sql('s')} AS c FROM ({_NAMES})) a JOIN (SELECT k, {_soundex_sql('s')} AS c FROM ({_NAMES})) b ON a.c = b.c AND a.c <> ''")
def jn11_phonetic_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = names(spark, sf_dir)
    return joins.phonetic_join(n, n, lambda c: F.soundex(F.regexp_replace(c, "[^A-Za-z]", "")), **_HOW).select("code", "query_index", "target_index")


@query("agg3_dedupe", f"SELECT DISTINCT arg_max(b.s, struct_pack(n := length(b.s), s := b.s)) AS item FROM ({_NAMES}) a JOIN ({_NAMES}) b ON {_NEAR} >= 0.75 GROUP BY a.s")
def agg3_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.dedupe(read(spark, sf_dir, "part"), "p_name", "levenshtein_normalized", 0.75)


# Subsequences, n-grams, tokens

pair_query("tx1_lcs", _words, {"length": "lcs_length(a, b)"}, dp(_WORD_PAIRS, _COUNT, "i", _INDEL, "(len(a) + len(b) - p[len(p)]) // 2 AS length"))
pair_query(
    "tx2_lcs_substring", _words, {"length": "lcs_substring_length(a, b)"},
    dp(_WORD_PAIRS, _ZEROS, "0", f"CASE WHEN {_SAME} THEN p[{{j}}] + 1 ELSE 0 END", "best AS length", "greatest(best, list_max(r))"),
)
pair_query(
    "tx4_ngrams", _words, {"jaccard": "jaccard(a, b)", "dice": "dice(a, b)", "overlap": "overlap(a, b)", "cosine": "cosine(a, b)"},
    f"""WITH pairs AS ({_WORD_PAIRS}), g AS (SELECT x, a[i:i + 1] AS g, count(*) AS n FROM (SELECT x, a, unnest(range(1, len(a))) AS i FROM pairs) GROUP BY ALL),
h AS (SELECT b[i:i + 1] AS g, count(*) AS n FROM (SELECT b, unnest(range(1, len(b))) AS i FROM (SELECT DISTINCT b FROM pairs)) GROUP BY ALL),
c AS (SELECT x, sum(least(g.n, h.n)) AS c, sum(g.n * h.n) AS dot FROM g JOIN h USING (g) GROUP BY x), p AS (SELECT x, sum(n) AS p, sum(n * n) AS pp FROM g GROUP BY x), q AS (SELECT sum(n) AS q, sum(n * n) AS qq FROM h)
SELECT x, 0 AS y, CAST(coalesce(c, 0) AS DOUBLE) / CAST(p + q - coalesce(c, 0) AS DOUBLE) AS jaccard, 2.0::DOUBLE * CAST(coalesce(c, 0) AS DOUBLE) / CAST(p + q AS DOUBLE) AS dice,
  CAST(coalesce(c, 0) AS DOUBLE) / CAST(least(p, q) AS DOUBLE) AS overlap, CAST(coalesce(dot, 0) AS DOUBLE) / (sqrt(CAST(pp AS DOUBLE)) * sqrt(CAST(qq AS DOUBLE))) AS cosine
FROM p LEFT JOIN c USING (x) CROSS JOIN q""",
)
pair_query("tx6_ratcliff_obershelp", _words, {"similarity": "ratcliff_obershelp_similarity(a, b)"})
pair_query("tx7_partial_ratio", _words, {"score": "partial_ratio(a, b)"})
_SORTED = "array_to_string(list_sort(string_split({}, ' ')), ' ')"
pair_query(
    "tx8_token_sort_ratio", _words, {"score": "token_sort_ratio(a, b)"},
    dp(f"SELECT x, y, {_SORTED.format('a')} AS a, {_SORTED.format('b')} AS b FROM ({_WORD_PAIRS})", _COUNT, "i", _INDEL, f"{_share('p[len(p)]', '(len(a) + len(b))')} AS score"),
)
pair_query("tx9_token_ratios", _words, {"token_set": "token_set_ratio(a, b)", "partial_sort": "partial_token_sort_ratio(a, b)", "partial_set": "partial_token_set_ratio(a, b)"})
pair_query("tx12_wratio", _words, {"score": "wratio(a, b)"})
pair_query(
    "tx15_monge_elkan", _names, {"score": "monge_elkan(a, b, 'jaro')"},
    f"""SELECT x, 0 AS y, sum(m) / count(*) AS score FROM (SELECT x, i, max(jaro_similarity(w[i], v[j])) AS m FROM (
  SELECT x, w, v, i, unnest(range(1, len(v) + 1)) AS j FROM (SELECT x, string_split(a, ' ') AS w, string_split(b, ' ') AS v, unnest(range(1, len(string_split(a, ' ')) + 1)) AS i FROM ({_NAME_PAIRS}))) GROUP BY ALL) GROUP BY x""",
)


@query("tx13_facade_ratios")
def tx13_facade_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    made = {name: fuzz.column(f, a, b) for name, f in fuzz.SCORERS.items()}
    return _words(spark, sf_dir).select("x", *(c.alias(name) for name, c in made.items()), fuzz.column(fuzz.rounded(fuzz.w_ratio), a, b, "int").alias("rounded"))


# Phonetics

sql_query("ph1_soundex", names, {"k": "k", "code": "ns_soundex(s)", "like_widget": "ns_soundex_equal(s, 'cold widgit')"}, ("soundex", "soundex_equal"),
          f"SELECT k, {_soundex_sql('s')} AS code, {_soundex_sql('s')} = {_soundex_sql(chr(39) + 'cold widgit' + chr(39))} AS like_widget FROM ({_NAMES})")


def _codex_sql(s: str) -> str:
    w = f"regexp_replace(upper({s}), '[^A-Z]', '', 'g')"
    letters = f"string_split({w}[1] || regexp_replace({w}[2:], '[AEIOU]', '', 'g'), '')"
    kept = f"array_to_string(list_filter({letters}, lambda c, i: i = 1 OR c <> ({letters})[i - 1]), '')"
    return f"CASE WHEN length({kept}) <= 6 THEN {kept} ELSE {kept}[1:3] || {kept}[-3:] END"


sql_query("ph5_match_rating", names, {"k": "k", "code": "ns_match_rating_codex(s)"}, ("match_rating_codex",), f"SELECT k, {_codex_sql('s')} AS code FROM ({_NAMES})")
sql_query(
    "ph_encoders", names, {"k": "k", **{n: f"ns_{n}(s)" for n in ("metaphone", "nysiis", "caverphone", "cologne_phonetic", "daitch_mokotoff")}, "double": "ns_double_metaphone(s).primary", "rated": "ns_match_rating_compare(s, 'cold widgit')"},
    ("metaphone", "nysiis", "caverphone", "cologne_phonetic", "daitch_mokotoff", "double_metaphone", "match_rating_compare"),
)


# Series

_FIRST = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings ORDER BY vec_id LIMIT 1)"


@query(
    "seq1_dtw",
    dp(f"SELECT vec_id AS x, 0 AS y, CAST(embedding AS DOUBLE[]) AS a, {_FIRST} AS b FROM embeddings", "list_transform(range(0, len(b) + 1), lambda j: CASE WHEN j = 0 THEN 0.0::DOUBLE ELSE 'inf'::DOUBLE END)", "'inf'",
       "(a[i] - b[{j}]) * (a[i] - b[{j}]) + least(p[{j}], p[{j} + 1], l[len(l)])", "p[len(p)] AS cost", kind="DOUBLE"),
)
def seq1_dtw(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, only=("dtw",))
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    first = e.orderBy("vec_id").limit(1).select(F.col("v").alias("w"))
    return e.crossJoin(first).select(F.col("vec_id").alias("x"), F.lit(0).alias("y"), F.expr("ns_dtw(v, w)").alias("cost"))


@query("seq1_dtw_band")
def seq1_dtw_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' values in order of time, against those of the first user, within a tenth of the longer series."""
    register(spark, only=("dtw",))
    series = read(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", "value"))), lambda x: x["value"]).alias("v"))
    first = series.orderBy("user_id").limit(1).select(F.col("v").alias("w"))
    return series.crossJoin(first).select("user_id", F.expr("ns_dtw(v, w, 0.1D)").alias("cost"))


@query("int1_backend", "SELECT 'spark' AS backend, TRUE AS there")
def int1_backend(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, only=("detect_best_backend", "backend_is_available"))
    return spark.range(1).select(F.expr("ns_detect_best_backend()").alias("backend"), F.expr("ns_backend_is_available('spark')").alias("there"))
