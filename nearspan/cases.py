"""Queries over small fixed inputs: odd strings against dynamic programs in SQL, and names and matrices against published values."""

from __future__ import annotations

import io
import re
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearspan.facades import aligner, distance, fuzz, graphemes, process
from nearspan.functions import phonetic, text
from nearspan.functions.arrow import single
from nearspan.functions.dtw import keogh
from nearspan.functions.sql import register
from nearspan.operators import joins
from nearspan.queries import _ALIGN, _COUNT, _GRID, _HOW, _INDEL, _LOCAL, _NATIONS, _SAME, _ZEROS, ORACLES, QUERIES, _share, _winkler, _with_array, _WORD_PAIRS, _words, dp, nations, pair_query, query


def literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, int):
        return f"CAST({v} AS BIGINT)"
    if isinstance(v, float):
        return f"CAST({v!r} AS DOUBLE)"
    return "'" + v.replace("'", "''") + "'"


def values(rows: Sequence[tuple], columns: str) -> str:
    """A DuckDB table of these rows."""
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS t({columns})"


def case_query(name: str, schema: str, inputs: Sequence[tuple], wanted: Sequence[tuple], columns: dict[str, str]) -> None:
    """columns: SQL expressions over the inputs (schema), {} for the prefix; wanted: their published values."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, only=set(re.findall(r"\{\}(\w+)", " ".join(columns.values()))))
        rows = spark.createDataFrame([(k, *r) for k, r in enumerate(inputs)], f"nr long, {schema}")
        return rows.select("nr", *(F.expr(e.replace("{}", "ns_")).alias(c) for c, e in columns.items()))

    QUERIES[name] = run
    ORACLES[name] = values([(k, *r) for k, r in enumerate(wanted)], ", ".join(("nr", *columns)))


# Odd strings: empty, of unequal length, not ASCII, and beyond 64 characters

_ODD = (
    ("", ""), ("abc", ""), ("", "abc"), ("kitten", "sitting"), ("flaw", "lawn"), ("ca", "abc"), ("Müller", "Mueller"), ("γειά", "γεια"), ("你好世界", "你好啊"), ("hi 👋", "ho 👋"), ("x", "xxxxxxxx"),
    ("abcdefghij" * 7, "xbcdefghij" + "abcdefghij" * 6), ("ab" * 40, "ba" * 36 + "你"), ("a" * 63, "a" * 64), ("a" * 64 + "b", "c" + "a" * 65),
)
_ODD_PAIRS = "SELECT x, y, a, b FROM (" + values([(k, 0, a, b) for k, (a, b) in enumerate(_ODD)], "x, y, a, b") + ")"


def _odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(k, 0, a, b) for k, (a, b) in enumerate(_ODD)], "x long, y long, a string, b string")


_OSA = f"least(p[{{j}}] + CASE WHEN {_SAME} THEN 0 ELSE 1 END, p[{{j}} + 1] + 1, l[len(l)] + 1, CASE WHEN i > 1 AND {{j}} > 1 AND a[i] = b[{{j}} - 1] AND a[i - 1] = b[{{j}}] THEN q[{{j}} - 1] + 1 ELSE 1000 END)"
_LEVENSHTEIN = f"least(p[{{j}}] + CASE WHEN {_SAME} THEN 0 ELSE 1 END, p[{{j}} + 1] + 1, l[len(l)] + 1)"
_DOWN = _COUNT.replace("CAST(j", "CAST(-j")
_SCORE = _ALIGN.replace("{match}", "2")
pair_query("ed1_levenshtein_odd", _odd, {"distance": "levenshtein(a, b)"}, dp(_ODD_PAIRS, _COUNT, "i", _LEVENSHTEIN, "p[len(p)] AS distance"))
pair_query("ed2_levenshtein_score_odd", _odd, {"distance": "levenshtein_score(a, b, 3L)"}, dp(_ODD_PAIRS, _COUNT, "i", _LEVENSHTEIN, "least(p[len(p)], 4) AS distance"))
pair_query("ed3_osa_odd", _odd, {"distance": "osa(a, b)"}, dp(_ODD_PAIRS, _COUNT, "i", _OSA, "p[len(p)] AS distance"))
pair_query("ed7_indel_odd", _odd, {"distance": "indel(a, b)"}, dp(_ODD_PAIRS, _COUNT, "i", _INDEL, "p[len(p)] AS distance"))
pair_query("al1_smith_waterman_odd", _odd, {"score": "smith_waterman(a, b)"}, dp(_ODD_PAIRS, _ZEROS, "0", f"greatest(0, {_SCORE})", "best AS score", "greatest(best, list_max(r))"))
pair_query("al5_needleman_wunsch_odd", _odd, {"score": "needleman_wunsch(a, b)"}, dp(_ODD_PAIRS, _DOWN, "-i", _SCORE, "p[len(p)] AS score"))
pair_query("tx1_lcs_odd", _odd, {"length": "lcs_length(a, b)"}, dp(_ODD_PAIRS, _COUNT, "i", _INDEL, "(len(a) + len(b) - p[len(p)]) // 2 AS length"))
pair_query("tx2_lcs_substring_odd", _odd, {"length": "lcs_substring_length(a, b)"}, dp(_ODD_PAIRS, _ZEROS, "0", f"CASE WHEN {_SAME} THEN p[{{j}}] + 1 ELSE 0 END", "best AS length", "greatest(best, list_max(r))"))


def affine_dp(pairs: str, local: bool, match: int = 2, mismatch: int = -1, opening: int = -2, extend: int = -1) -> str:
    """DuckDB: Gotoh's recurrences; e holds the best scores that end in a gap in b."""
    low, floor = "-1000000", "0, " if local else ""
    first = _ZEROS if local else f"list_transform(range(0, len(b) + 1), lambda j: CAST(CASE WHEN j = 0 THEN 0 ELSE {opening} + (j - 1) * {extend} END AS BIGINT))"
    edge = "0" if local else f"({opening} + (i - 1) * {extend})"
    gap = f"list_max(list_transform(range(0, CAST(t[1] AS BIGINT)), lambda k: l[k + 1] + {opening} + (CAST(t[1] AS BIGINT) - 1 - k) * {extend}))"
    cell = f"greatest({floor}p[t[1]] + CASE WHEN a[i] = b[CAST(t[1] AS BIGINT)] THEN {match} ELSE {mismatch} END, e2[t[1] + 1], {gap})"
    return f"""WITH RECURSIVE pairs AS ({pairs}), dp AS (
  SELECT x, y, a, b, CAST(0 AS BIGINT) AS i, {first} AS p, list_transform(range(0, len(b) + 1), lambda j: CAST({low} AS BIGINT)) AS e, CAST(0 AS BIGINT) AS best FROM pairs
  UNION ALL
  SELECT x, y, a, b, i, r, e2, greatest(best, list_max(r)) FROM (
    SELECT *, list_reduce(list_concat([[CAST({edge} AS BIGINT)]], list_transform(range(1, len(b) + 1), lambda j: [CAST(j AS BIGINT)])), lambda l, t: list_append(l, CAST({cell} AS BIGINT))) AS r
    FROM (SELECT x, y, a, b, i + 1 AS i, p, best, list_transform(range(1, len(b) + 2), lambda j: greatest(p[j] + {opening}, e[j] + {extend})) AS e2 FROM dp WHERE i < len(a)))
) SELECT x, y, {'best' if local else 'p[len(p)]'} AS score FROM dp WHERE i = len(a)"""


_SHORT = tuple((a[:12], b[:12]) for a, b in _ODD) + (("ACCCGTTT", "ACGT"), ("AAATTTGGG", "AAAGGG"), ("GATTACA", "GCATGCU"))
_SHORT_PAIRS = "SELECT x, y, a, b FROM (" + values([(k, 0, a, b) for k, (a, b) in enumerate(_SHORT)], "x, y, a, b") + ")"


def _short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(k, 0, a, b) for k, (a, b) in enumerate(_SHORT)], "x long, y long, a string, b string")


pair_query("al2_smith_waterman_affine", _short, {"score": "smith_waterman_affine(a, b)"}, affine_dp(_SHORT_PAIRS, True))
pair_query("al6_needleman_wunsch_affine", _short, {"score": "needleman_wunsch_affine(a, b)"}, affine_dp(_SHORT_PAIRS, False))
pair_query("al4_farrar_names", _short, {"score": "smith_waterman_farrar_score(a, b)"}, dp(_SHORT_PAIRS, _ZEROS, "0", f"greatest(0, {_SCORE})", "best AS score", "greatest(best, list_max(r))"))
del QUERIES["al2_affine"]

# One to many: each nation against the array of all

_PADDED = f"SELECT a.k AS x, b.k AS y, rpad(a.s, 14, '_') AS a, rpad(b.s, 14, '_') AS b FROM ({_NATIONS}) a, ({_NATIONS}) b"


def many_query(name: str, function: str, oracle: str, options: str = "", padded: bool = False) -> None:
    """oracle: rows of x, y (place in the array) and score."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, only=(function, "ascii_matrix") if "ascii_matrix" in options else (function,))
        both = _with_array(spark, sf_dir)
        if padded:
            both = both.select("k", F.rpad("s", 14, "_").alias("s"), F.transform("all", lambda t: F.rpad(t, 14, "_")).alias("all"))
        both = both.withColumn("found", F.expr(f"ns_{function}(s, all{options})"))
        return both.select(F.col("k").alias("x"), F.posexplode("found").alias("y", "score")).select("x", F.col("y").cast("long").alias("y"), "score")

    QUERIES[name], ORACLES[name] = run, f"SELECT x, y, score FROM ({oracle})"


_INDEL_SHARE = f"{_share('p[len(p)]', '(len(a) + len(b))')} AS score"
_OSA_SHARE = f"{_share('p[len(p)]', 'greatest(len(a), len(b))')} AS score"
_LOCAL_SCORE, _GLOBAL_SCORE = dp(_GRID, _ZEROS, "0", f"greatest(0, {_SCORE})", "best AS score", "greatest(best, list_max(r))"), dp(_GRID, _DOWN, "-i", _SCORE, "p[len(p)] AS score")
_TRUE = "SELECT x, y, CAST(damerau_levenshtein(a, b) AS BIGINT) AS score FROM (" + _GRID + ")"
_JARO = "SELECT x, y, jaro_similarity(a, b) AS score FROM (" + _GRID + ")"
_NORMAL = f"SELECT x, y, {_share('levenshtein(a, b)', 'greatest(length(a), length(b))')} AS score FROM ({_GRID})"
many_query("vec1_indel_scores", "indel_scores", dp(_GRID, _COUNT, "i", _INDEL, "p[len(p)] AS score"))
many_query("vec2_levenshtein_normalized_scores", "levenshtein_normalized_scores", _NORMAL)
many_query("vec2_indel_normalized_scores", "indel_normalized_scores", dp(_GRID, _COUNT, "i", _INDEL, _INDEL_SHARE))
many_query("vec3_osa_scores", "damerau_levenshtein_scores", dp(_GRID, _COUNT, "i", _OSA, "p[len(p)] AS score"))
many_query("vec3_osa_normalized_scores", "damerau_levenshtein_normalized_scores", dp(_GRID, _COUNT, "i", _OSA, _OSA_SHARE))
many_query("vec4_true_damerau_scores", "true_damerau_levenshtein_scores", _TRUE)
many_query("vec5_hamming_scores", "hamming_scores", f"SELECT x, y, CAST(hamming(a, b) AS BIGINT) AS score FROM ({_PADDED})", padded=True)
many_query("vec5_hamming_normalized_scores", "hamming_normalized_scores", f"SELECT x, y, {_share('hamming(a, b)', '14')} AS score FROM ({_PADDED})", padded=True)
many_query("vec6_jaro_similarities", "jaro_similarities", _JARO)
many_query("vec7_smith_waterman_scores", "smith_waterman_scores", _LOCAL_SCORE)
many_query("vec8_needleman_wunsch_scores", "needleman_wunsch_scores", _GLOBAL_SCORE)
many_query("vec9_scores_by_name", "scores", dp(_GRID, _COUNT, "i", _INDEL, _INDEL_SHARE), ", 'indel_normalized'")
many_query("mx2_matrix_scores", "smith_waterman_matrix_scores", _LOCAL, ", ns_ascii_matrix()")
many_query("mx2_global_matrix_scores", "needleman_wunsch_matrix_scores", dp(_GRID, _DOWN, "-i", _ALIGN.replace("{match}", "1"), "p[len(p)] AS score"), ", ns_ascii_matrix()")


def top_query(name: str, function: str, grid: str, similarity: bool, best: bool = False) -> None:
    """The four nearest of the array, or the nearest alone; grid: the scores, as above."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, only=(function,))
        found = _with_array(spark, sf_dir).withColumn("m", F.array(F.expr(f"ns_{function}(s, all)")) if best else F.expr(f"ns_{function}(s, all, 4)"))
        rows = found.select(F.col("k").alias("x"), F.posexplode("m").alias("r", "m"))
        return rows.select("x", (F.col("r") + 1).cast("long").alias("rank"), F.col("m.index").alias("y"), F.col("m.target").alias("target"), F.col("m.score").alias("score"))

    order = f"score {'DESC' if similarity else ''}, y"
    QUERIES[name] = run
    ORACLES[name] = f"SELECT x, r AS rank, y, s AS target, score FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY {order}) AS r FROM ({grid}) g) g JOIN ({_NATIONS}) n ON n.k = g.y WHERE r <= {1 if best else 4}"


_WINKLER = f"SELECT x, y, {_winkler('a', 'b')} AS score FROM ({_GRID})"
for _name, _grid_sql, _similar in (
    ("levenshtein", f"SELECT x, y, CAST(levenshtein(a, b) AS BIGINT) AS score FROM ({_GRID})", False), ("levenshtein_normalized", _NORMAL, True), ("damerau_levenshtein", dp(_GRID, _COUNT, "i", _OSA, "p[len(p)] AS score"), False),
    ("damerau_levenshtein_normalized", dp(_GRID, _COUNT, "i", _OSA, _OSA_SHARE), True), ("true_damerau_levenshtein", _TRUE, False), ("indel", dp(_GRID, _COUNT, "i", _INDEL, "p[len(p)] AS score"), False),
    ("indel_normalized", dp(_GRID, _COUNT, "i", _INDEL, _INDEL_SHARE), True), ("jaro", _JARO, True), ("jaro_winkler", _WINKLER, True), ("smith_waterman", _LOCAL_SCORE, True),
):
    top_query(f"top_{_name}", f"{_name}_top_k", _grid_sql, _similar)
    top_query(f"top5_{_name}_best", f"{_name}_best", _grid_sql, _similar, True)


@query("jn5_smith_waterman_cdist", _LOCAL_SCORE)
def jn5_smith_waterman_cdist(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nations(spark, sf_dir)
    return joins.cdist(n, n, "smith_waterman", **_HOW).select(F.col("query_index").alias("x"), F.col("target_index").alias("y"), "score")


@query("jn5_needleman_wunsch_cdist", _GLOBAL_SCORE)
def jn5_needleman_wunsch_cdist(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nations(spark, sf_dir)
    return joins.cdist(n, n, "needleman_wunsch", **_HOW).select(F.col("query_index").alias("x"), F.col("target_index").alias("y"), "score")


# Phonetic codes of names, as published for them

_METAPHONE = (
    ("Thompson", "0MPSN"), ("Catherine", "K0RN"), ("Kathryn", "K0RN"), ("Schmidt", "SKMTT"), ("Robert", "RBRT"), ("Smith", "SM0"), ("Caesar", "KSR"), ("Ashcraft", "AXKRFT"), ("Tymczak", "TMKSK"), ("Pfister", "PFSTR"),
    ("McDonald", "MKTNLT"), ("Xavier", "SFR"), ("Zhang", "SHNK"), ("Aether", "E0R"), ("Knight", "NT"), ("Wright", "RT"), ("Lamb", "LM"), ("Match", "MX"), ("Hugh", "H"), ("Ghost", "KHST"), ("Caught", "KT"), ("", ""), ("12345", ""),
)
case_query("ph2_metaphone", "s string", [(s,) for s, _ in _METAPHONE], _METAPHONE, {"s": "s", "code": "{}metaphone(s)"})
_JELLY = (("Schmidt", "SXMTT"), ("Hugh", "HKH"), ("Through", "0RKH"), ("Tough", "TKH"), ("Plough", "PLKH"), ("Robert", "RBRT"), ("Knight", "NT"), ("Ghost", "KHST"))
case_query("ph2_metaphone_variant", "s string", [(s,) for s, _ in _JELLY], _JELLY, {"s": "s", "code": "{}metaphone(s, 1)"})
_DOUBLE = (
    ("Smith", "SM0", "XMT"), ("Robert", "RPRT", ""), ("Knight", "NT", ""), ("Wright", "RT", ""), ("Caesar", "SSR", ""), ("Lloyd", "LT", ""), ("Lamb", "LMP", ""), ("Match", "MX", ""), ("Chess", "XS", ""), ("Honeyman", "HNMN", ""),
    ("Schmidt", "XMT", "SMT"), ("Schwartz", "XRTS", "XFRTS"), ("Pawlowski", "PLSK", "PLFSK"), ("Hugh", "H", ""), ("High", "H", ""), ("Tough", "TF", ""), ("Cough", "KF", ""), ("Gnaeus", "NS", ""), ("Tymczak", "TMSK", "TMXK"),
    ("", "", ""), ("12345", "", ""),
)
case_query("ph3_double_metaphone", "s string", [(s,) for s, *_ in _DOUBLE], _DOUBLE, {"s": "s", "one": "{}double_metaphone(s).primary", "two": "{}double_metaphone(s).alternate"})
_VARIANT = (("Hugh", "HH"), ("High", "HH"), ("Smith", "SM0"))
case_query("ph3_double_metaphone_variant", "s string", [(s,) for s, _ in _VARIANT], _VARIANT, {"s": "s", "one": "{}double_metaphone(s, 64, 1).primary"})
_NYSIIS = (
    ("Watkins", "WATCAN"), ("Wilkins", "WALCAN"), ("Wilkinson", "WALCANSAN"), ("Robert", "RABAD"), ("Smith", "SNAT"), ("Schmidt", "SNAD"), ("Catherine", "CATARAN"), ("Kathryn", "CATRYN"), ("Knight", "NAGT"), ("Wright", "WRAGT"),
    ("Macarthur", "MCARTAR"), ("Phillips", "FALAP"), ("Pfister", "FASTAR"), ("Schwartz", "SWART"), ("Yarborough", "YARBARAG"), ("Johnson", "JANSAN"), ("Lloyd", "LAYD"), ("Hannah", "HAN"), ("Joshua", "JAS"), ("", ""),
)
case_query("ph4_nysiis", "s string", [(s,) for s, _ in _NYSIIS], _NYSIIS, {"s": "s", "code": "{}nysiis(s)"})
_CAVERPHONE = (
    ("Peter", "PTA1111111"), ("Thompson", "TMPSN11111"), ("Smith", "SMT1111111"), ("Schmidt", "SKMT111111"), ("add", "AT11111111"), ("earth", "AT11111111"), ("hold", "AT11111111"), ("mb", "M111111111"), ("mbmb", "MPM1111111"),
    ("rather", "RTA1111111"), ("writer", "RTA1111111"), ("social", "SSA1111111"), ("able", "APA1111111"), ("Cailean", "KLN1111111"), ("", "1111111111"),
)
case_query("ph6_caverphone", "s string", [(s,) for s, _ in _CAVERPHONE], _CAVERPHONE, {"s": "s", "code": "{}caverphone(s)"})
_COLOGNE = (
    ("Wikipedia", "3412"), ("Breschnew", "17863"), ("Müller", "657"), ("Mueller", "657"), ("Schmidt", "862"), ("Schneider", "8627"), ("Fischer", "387"), ("Weber", "317"), ("Meyer", "67"), ("Wagner", "3467"), ("Becker", "147"), ("Schulz", "858"),
    ("Hoffmann", "0366"), ("Heinz", "068"), ("Köln", "456"), ("Großmann", "47866"), ("", ""), ("12345", ""),
)
case_query("ph7_cologne_phonetic", "s string", [(s,) for s, _ in _COLOGNE], _COLOGNE, {"s": "s", "code": "{}cologne_phonetic(s)"})
_DAITCH = (
    ("Straßburg", "294795"), ("Éregon", "095600"), ("AKSSOL", "054800"), ("GERSCHFELD", "547830|545783|594783|594578"), ("AUERBACH", "097400|097500"), ("OHRBACH", "097400|097500"), ("LIPSHITZ", "874400"), ("LIPPSZYC", "874400|874500"),
    ("LEWINSKY", "876450"), ("SZLAMAWICZ", "486740"), ("Washington", "746536"), ("GOLDEN", "583600"), ("Alpert", "087930"), ("Breuer", "791900"), ("", "000000"),
)
case_query("ph8_daitch_mokotoff", "s string", [(s,) for s, _ in _DAITCH], _DAITCH, {"s": "s", "codes": "{}daitch_mokotoff(s)"})
case_query("ph8_daitch_mokotoff_first", "s string", [("GERSCHFELD",), ("AUERBACH",)], [("GERSCHFELD", "547830"), ("AUERBACH", "097400")], {"s": "s", "code": "{}daitch_mokotoff(s, false)"})
_EQUAL = (("Catherine", "Kathryn", True, False, False), ("Smith", "Smyth", True, False, True), ("Robert", "Rupert", False, False, True), ("", "", False, False, False))
case_query(
    "flt1_phonetic_equality", "a string, b string", [r[:2] for r in _EQUAL if r[0] != "Smith"], [r for r in _EQUAL if r[0] != "Smith"],
    {"a": "a", "b": "b", "metaphone": "{}metaphone_equal(a, b)", "nysiis": "{}nysiis_equal(a, b)", "soundex": "{}soundex_equal(a, b)"},
)
_RATED = (
    ("Robert", "Rupert", True), ("Smith", "Smyth", True), ("Catherine", "Kathryn", True), ("Williams", "Williamson", True), ("Knight", "Night", True), ("John", "Jon", True), ("Sarah", "Sara", True), ("Christopher", "Chris", True),
    ("Hannah", "Hana", True), ("Robert", "Smith", False), ("Catherine", "Robert", False), ("Sarah", "Robert", False), ("", "", False),
)
case_query("flt2_match_rating_compare", "a string, b string", [r[:2] for r in _RATED], _RATED, {"a": "a", "b": "b", "alike": "{}match_rating_compare(a, b)"})

# Ratios with published values

_PARTIAL = (("apple", "an apple a day", 1.0), ("foo bar", "foo bar baz", 1.0), ("hello world", "world hello", 0.625), ("kitten", "kitten", 1.0), ("", "", 1.0), ("abc", "", 0.0), ("", "abc", 0.0))
case_query("tx7_partial_ratio", "a string, b string", [r[:2] for r in _PARTIAL], _PARTIAL, {"a": "a", "b": "b", "score": "{}partial_ratio(a, b)"})
_SETS = (("foo bar", "foo bar baz", 1.0), ("apple", "an apple a day", 1.0), ("", "", 0.0), ("   ", "   ", 0.0), ("abc", "", 0.0), ("", "abc def", 0.0))
case_query("tx9_token_set_ratio", "a string, b string", [r[:2] for r in _SETS], _SETS, {"a": "a", "b": "b", "score": "{}token_set_ratio(a, b)"})
_PARTS = (("foo bar", "bar foo", 1.0), ("hello world", "world hello", 1.0))
case_query("tx10_partial_token_sort_ratio", "a string, b string", [r[:2] for r in _PARTS], _PARTS, {"a": "a", "b": "b", "score": "{}partial_token_sort_ratio(a, b)"})
_PART_SETS = (("foo bar", "foo bar baz", 1.0), ("apple", "an apple a day", 1.0), ("", "", 0.0), ("abc", "", 0.0))
case_query("tx11_partial_token_set_ratio", "a string, b string", [r[:2] for r in _PART_SETS], _PART_SETS, {"a": "a", "b": "b", "score": "{}partial_token_set_ratio(a, b)"})
_WRATIO = (("kitten", "kitten", 1.0), ("the quick brown fox", "the quick brown fox", 1.0), ("", "", 1.0), ("abc", "", 0.0), ("", "abc", 0.0))
case_query("tx12_wratio_cases", "a string, b string", [r[:2] for r in _WRATIO], _WRATIO, {"a": "a", "b": "b", "score": "{}wratio(a, b)"})

# Alignment paths, matrices, series, n-grams

_PATHS = (("ACGT", "ACCT", 5, "2=1X1=", 3, 1, 0, 0, "ACGT", "ACCT", "2=1X1="), ("ACCGT", "CCG", 4, "1D3=1D", 3, 0, 0, 2, "ACCGT", "-CCG-", "3="), ("same", "same", 8, "4=", 4, 0, 0, 0, "same", "same", "4="))
case_query(
    "al8_path_cases", "a string, b string", [r[:2] for r in _PATHS], _PATHS,
    {"a": "a", "b": "b", "score": "{}needleman_wunsch_path(a, b).score", "cigar": "{}needleman_wunsch_cigar(a, b)", **{n: f"{{}}needleman_wunsch_path(a, b).{n}" for n in ("matches", "mismatches", "insertions", "deletions", "aligned_query", "aligned_target")},
     "local_cigar": "{}smith_waterman_trace_cigar(a, b)"},
)
_DNA = "{}identity_matrix('ACGT', 3, -2, '*')"
case_query(
    "mx3_matrix_cases", "a string, b string", [("ACGT", "ACCT"), ("ACCGT", "CCG"), ("AC", "AC")], [("ACGT", "ACCT", 7, "2=1X1=", 7), ("ACCGT", "CCG", 7, "1D3=1D", 9), ("AC", "AC", 6, "2=", 6)],
    {"a": "a", "b": "b", "score": f"{{}}needleman_wunsch_matrix_path(a, b, {_DNA}).score", "cigar": f"{{}}needleman_wunsch_matrix_cigar(a, b, {_DNA})", "local": f"{{}}smith_waterman_matrix_path(a, b, {_DNA}).score"},
)
case_query(
    "mx13_matrix_functions", "a string, b string", [("A", "A"), ("A", "C"), ("T", "G")], [("A", "A", 3, 3, 3, "0,1,2,3", "ACGT*"), ("A", "C", 0, 0, 3, "0,1,2,3", "ACGT*"), ("T", "G", 0, 0, 3, "0,1,2,3", "ACGT*")],
    {"a": "a", "b": "b", "score": f"{{}}substitution_matrix_score({_DNA}, a, b)", "transposed": f"{{}}substitution_matrix_score({{}}matrix_transpose({_DNA}), a, b)", "step": f"{{}}matrix_score_step_limit({_DNA})",
     "code": f"array_join({{}}matrix_encode({_DNA}, 'ACGT'), ',')", "alphabet": f"{{}}matrix_info({_DNA}).alphabet"},
)
case_query(
    "seq2_dtw_distances", "q array<double>, ts array<array<double>>", [([1.0, 2.0, 3.0], [[1.0, 2.0, 3.0], [1.0, 2.0, 2.0, 3.0], [2.0, 2.0, 2.0], [4.0]])], [("0.0,0.0,2.0,14.0",)],
    {"costs": "array_join(transform({}dtw_distances(q, ts), x -> CAST(x AS STRING)), ',')"},
)
_GRAMS = (("night", "nacht", 1 / 7, 0.25, 0.25, 0.25), ("night", "night", 1.0, 1.0, 1.0, 1.0), ("abcd", "wxyz", 0.0, 0.0, 0.0, 0.0))
case_query(
    "tx5_ngram_vectors", "a string, b string", [r[:2] for r in _GRAMS], _GRAMS,
    {"a": "a", "b": "b", "jaccard": "get({}jaccard_similarities(a, array(b)), 0)", "dice": "get({}dice_similarities(a, array(b)), 0)", "overlap": "get({}overlap_similarities(a, array(b)), 0)", "cosine": "round(get({}cosine_similarities(a, array(b)), 0), 12)"},
)
_COMMON = (("abcdef", "zabcy", "abc", 3), ("", "a", "", 0), ("hello world", "yellow", "ello", 4))
case_query("tx3_lcs_substring", "a string, b string", [r[:2] for r in _COMMON], _COMMON, {"a": "a", "b": "b", "part": "{}lcs_substring(a, b)", "length": "{}lcs_substring_length(a, b)"})
_RATCLIFF = (("WIKIMEDIA", "WIKIMANIA", 14 / 18), ("GESTALT PATTERN MATCHING", "GESTALT PRACTICE", 0.6), ("same", "same", 1.0), ("abc", "xyz", 0.0))
case_query("tx6_ratcliff_obershelp_cases", "a string, b string", [r[:2] for r in _RATCLIFF], _RATCLIFF, {"a": "a", "b": "b", "score": "{}ratcliff_obershelp_similarity(a, b)"})
case_query("top6_extract_sql", "q string", [("appel",)], [("appel", "apple:2.0,ape:2.0,maple:3.0")], {"q": "q", "found": "array_join(transform({}extract(q, array('grape juice', 'apple', 'maple', 'ape'), 'levenshtein', 3), x -> concat(x.target, ':', x.score)), ',')"})
case_query("int4_scorer_names", "q string", [("appel",)], [("appel", "2.0,1.0,2.0")], {"q": "q", "scores": "array_join(concat({}scores(q, array('apple'), 'Levenshtein'), {}scores(q, array('apple'), 'osa'), {}scores(q, array('apple'), 'INDEL')), ',')"})

# Prepared queries, table functions, facades


@query("ed13_prepared_levenshtein", f"SELECT k, CAST(levenshtein(s, 'united states') AS BIGINT) AS distance, {_share('levenshtein(s, chr(85) || chr(83))', 'greatest(length(s), 2)')} AS similarity FROM ({_NATIONS})")
def ed13_prepared_levenshtein(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearspan.functions.prepared import LevenshteinScorer

    s = F.col("s")
    return nations(spark, sf_dir).select("k", LevenshteinScorer("united states").column(s).alias("distance"), LevenshteinScorer("US").column(s, True).alias("similarity"))


@query("al10_prepared_scores", dp(f"SELECT k AS x, 0 AS y, 'ARGENTINA' AS a, s AS b FROM ({_NATIONS})", _ZEROS, "0", f"greatest(0, {_SCORE})", "best AS score", "greatest(best, list_max(r))"))
def al10_prepared_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearspan.functions.prepared import Scores

    return nations(spark, sf_dir).select(F.col("k").alias("x"), F.lit(0).alias("y"), Scores("ARGENTINA", "farrar").column(F.col("s")).alias("score"))


@query("jn9_cdist_rows", f"SELECT CAST(x AS INT) AS x, CAST(y AS INT) AS y, jaro_similarity(a, b) AS score FROM ({_GRID})")
def jn9_cdist_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearspan.functions.tables import register_tables

    register_tables(spark)
    every = nations(spark, sf_dir).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "s"))), lambda v: v["s"]).alias("all"))
    every.createOrReplaceTempView("ns_nation_names")
    return spark.sql("SELECT query_index AS x, target_index AS y, score FROM ns_nation_names n, LATERAL ns_cdist_rows(n.all, n.all, 'jaro', 7)")


@query("str1_streamed_pairs", f"SELECT {_share('levenshtein(a.s, b.s)', 'greatest(length(a.s), length(b.s))')} AS score, a.s AS query, b.s AS target FROM ({_NATIONS}) a, ({_NATIONS}) b WHERE score >= 0.5")
def str1_streamed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the iterator gives, row by row."""
    from nearspan.streaming.joins import iterate

    n = nations(spark, sf_dir)
    rows = [(r.score, r.query, r.target) for r in iterate(joins.above_threshold(n, n, "levenshtein_normalized", 0.5, **_HOW))]
    return spark.createDataFrame(rows, "score double, query string, target string")


@query("str2_streamed_queries", f"SELECT query, string_agg(target, ',' ORDER BY r) AS targets FROM (SELECT a.s AS query, b.s AS target, row_number() OVER (PARTITION BY a.k ORDER BY jaro_similarity(a.s, b.s) DESC, b.k) AS r FROM ({_NATIONS}) a, ({_NATIONS}) b) WHERE r <= 3 GROUP BY query")
def str2_streamed_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearspan.streaming.joins import iterate_per_query

    n = nations(spark, sf_dir)
    rows = [(q, ",".join(m["target"] for m in found)) for q, found in iterate_per_query(joins.top_k_per_query(n, n, "jaro", 3, **_HOW))]
    return spark.createDataFrame(rows, "query string, targets string")


def facade_query(name: str, columns: str, rows, wanted: Sequence[tuple]) -> None:
    """rows: what calls of a facade give, made when the query runs; wanted: published values."""
    kinds = ", ".join(f"{c} {'string' if isinstance(v, str) else 'boolean' if isinstance(v, bool) else 'long' if isinstance(v, int) else 'double'}" for c, v in zip(columns.split(", "), wanted[0]))
    QUERIES[name] = lambda spark, sf_dir: spark.createDataFrame(rows(spark), kinds)
    ORACLES[name] = values(wanted, columns)


_BEARS = (("this is a test", "this is a test!"), ("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear"), ("fuzzy was a bear", "fuzzy fuzzy was a bear"))
facade_query(
    "tx14_fuzz_facade", "a, b, ratio, token_sort, token_set", lambda spark: [(a, b, *(fuzz.rounded(f, process=f is not fuzz.ratio)(a, b) for f in (fuzz.ratio, fuzz.token_sort_ratio, fuzz.token_set_ratio))) for a, b in _BEARS],
    [(*_BEARS[0], 97, 100, 100), (*_BEARS[1], 91, 100, 100), (*_BEARS[2], 84, 84, 100)],
)
_TEAMS = ["Atlanta Falcons", "New York Jets", "New York Giants", "Dallas Cowboys"]
facade_query("top8_extract_facade", "nr, choice, score", lambda spark: [(k, c, int(s)) for k, (c, s, *_) in enumerate(process.extract_rounded(spark, "new york jets", _TEAMS, limit=2))], [(0, "New York Jets", 100), (1, "New York Giants", 79)])
facade_query("top7_extract_one", "choice, score", lambda spark: [process.extract_one(spark, "cowboys", [t.lower() for t in _TEAMS], scorer=fuzz.partial_ratio)[:2]], [("dallas cowboys", 100.0)])
_METRICS = (("Levenshtein", "kitten", "sitting", 3), ("Indel", "lewenstein", "levenshtein", 3), ("Hamming", "karolin", "kathrin", 3), ("OSA", "CA", "ABC", 3), ("DamerauLevenshtein", "CA", "ABC", 2), ("LCSseq", "this is a test", "this is a test!", 1))
facade_query("tx16_distance_facade", "metric, a, b, distance", lambda spark: [(m, a, b, int(getattr(distance, m).distance(a, b))) for m, a, b, _ in _METRICS], _METRICS)
facade_query("tx17_edit_operations", "edits, runs", lambda spark: [("; ".join(f"{t} {i} {j}" for t, i, j in distance.editops("ab", "acb")), "; ".join(f"{t} {i}-{j} {k}-{m}" for t, i, j, k, m in distance.opcodes("ab", "acb")))], [("insert 1 1", "equal 0-1 0-1; insert 1-1 1-2; equal 1-2 2-3")])
facade_query("tx18_processors", "text", lambda spark: [(fuzz.full_process(t, False),) for t in ("Hello, World!", "  x  ", "")], [("hello  world",), ("x",), ("",)])

# Joins by published codes


def code_join(name: str, function, codes: Sequence[tuple]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        n = spark.createDataFrame([(k, s) for k, (s, *_) in enumerate(codes)], "k long, s string")
        return joins.phonetic_join(n, n, single(function, "string"), **_HOW).select("query_index", "target_index")

    QUERIES[name] = run
    coded = values([(k, c) for k, (_, c, *_) in enumerate(codes)], "k, c")
    coded = f"SELECT k, unnest(string_split(c, '|')) AS c FROM ({coded}) WHERE c <> ''"
    ORACLES[name] = f"SELECT DISTINCT a.k AS query_index, b.k AS target_index FROM ({coded}) a JOIN ({coded}) b ON a.c = b.c"


code_join("jn11_metaphone_join", phonetic.metaphone, _METAPHONE)
code_join("jn11_nysiis_join", phonetic.nysiis, _NYSIIS)
code_join("jn11_daitch_mokotoff_join", phonetic.daitch_mokotoff, [r for r in _DAITCH if r[0]])

# Processors, corrected lines, token sets


@query("flt4_processors", f"SELECT s AS choice, {_share('levenshtein(lower(s), chr(105) || chr(110) || chr(100) || chr(105) || chr(97))', 'greatest(length(s), 5)')} AS score, k AS index FROM ({_NATIONS}) ORDER BY score DESC, index LIMIT 4")
def flt4_processors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearspan.operators import ranking

    return ranking.extract(nations(spark, sf_dir), "INDIA", "s", "k", k=4, processor=F.lower)


@query(
    "agg5_corrected_lines",
    """WITH words AS (SELECT w, min(k * 100 + p) AS k FROM (SELECT min(p_partkey) AS k, unnest(string_split(p_name, ' ')) AS w, unnest(range(0, len(string_split(p_name, ' ')))) AS p FROM part GROUP BY p_name) GROUP BY w),
lines AS (SELECT min(p_partkey) AS line, unnest(string_split(regexp_replace(p_name, '[aeiou]', 'e', 'g'), ' ')) AS token, unnest(range(0, len(string_split(p_name, ' ')))) AS position FROM part GROUP BY p_name),
best AS (SELECT token, w FROM (SELECT token, w, row_number() OVER (PARTITION BY token ORDER BY {score} DESC, k) AS r FROM (SELECT DISTINCT token FROM lines), words) WHERE r = 1)
SELECT line, string_agg(w, ' ' ORDER BY position) AS text FROM lines JOIN best USING (token) GROUP BY line""".replace("{score}", _winkler("token", "w")),
)
def agg5_corrected_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's name with all vowels alike, word by word, as the nearest words that names have."""
    from nearspan.operators import ranking
    from nearspan.queries import names

    n = names(spark, sf_dir)
    words = n.select("k", F.posexplode(F.split("s", " ")).alias("p", "word")).groupBy("word").agg(F.min(F.col("k") * 100 + F.col("p")).alias("k"))
    lines = n.select(F.col("k").alias("line"), F.posexplode(F.split(F.regexp_replace("s", "[aeiou]", "e"), " ")).alias("position", "token"))
    asked = lines.select("token").distinct().withColumn("q", F.xxhash64("token"))
    return ranking.correct(lines, joins.top_k_per_query(asked, words, "jaro_winkler", 1, "token", "word", "q", "k"))


@query("set1_token_sets", f"SELECT x, array_to_string(list_sort(list_intersect(u, v)), ' ') AS both, array_to_string(list_sort(list_filter(u, lambda t: NOT list_contains(v, t))), ' ') AS left_only FROM (SELECT k AS x, list_distinct(string_split(s, ' ')) AS u, ['cold', 'bolt', 'large', 'widget'] AS v FROM (SELECT p_name AS s, min(p_partkey) AS k FROM part GROUP BY p_name))")
def set1_token_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearspan.queries import names

    u, v = F.array_distinct(F.split("s", " ")), F.array(*map(F.lit, ("cold", "bolt", "large", "widget")))
    return names(spark, sf_dir).select(F.col("k").alias("x"), F.array_join(F.array_sort(F.array_intersect(u, v)), " ").alias("both"), F.array_join(F.array_sort(F.array_except(u, v)), " ").alias("left_only"))

# Partial and token ratios of part names, every window scored by the dynamic program

_RATIO = f"{_share('p[len(p)]', '(len(a) + len(b))')} AS score"


def ratio_sql(pairs: str) -> str:
    return dp(pairs, _COUNT, "i", _INDEL, _RATIO)


def partial_sql(pairs: str) -> str:
    cut = "l[greatest(k, 0) + 1:least(k + len(s), len(l))]"
    sides = f"SELECT x, y, CASE WHEN len(a) <= len(b) THEN a ELSE b END AS s, CASE WHEN len(a) <= len(b) THEN b ELSE a END AS l FROM ({pairs}) UNION ALL SELECT x, y, b, a FROM ({pairs}) WHERE len(a) = len(b)"
    windows = f"SELECT x, y, s AS a, unnest(list_distinct(list_transform(range(1 - len(s), len(l)), lambda k: {cut}))) AS b FROM ({sides})"
    return f"SELECT x, y, max(score) AS score FROM ({ratio_sql(windows)}) GROUP BY x, y"


def sorted_sql(pairs: str) -> str:
    one = "array_to_string(list_sort(string_split({}, ' ')), ' ')"
    return f"SELECT x, y, {one.format('a')} AS a, {one.format('b')} AS b FROM ({pairs})"


def token_set_sql(pairs: str) -> str:
    sets = f"SELECT x, list_distinct(string_split(a, ' ')) AS u, list_distinct(string_split(b, ' ')) AS v FROM ({pairs})"
    parts = f"SELECT x, list_sort(list_intersect(u, v)) AS c, list_sort(list_filter(u, lambda t: NOT list_contains(v, t))) AS p, list_sort(list_filter(v, lambda t: NOT list_contains(u, t))) AS q FROM ({sets})"
    joined = f"SELECT x, c, p, q, array_to_string(c, ' ') AS common, array_to_string(list_concat(c, p), ' ') AS lo, array_to_string(list_concat(c, q), ' ') AS hi FROM ({parts})"
    three = f"SELECT x, 0 AS y, lo AS a, hi AS b FROM ({joined}) UNION ALL SELECT x, 1, common, lo FROM ({joined}) WHERE len(c) > 0 UNION ALL SELECT x, 2, common, hi FROM ({joined}) WHERE len(c) > 0"
    return f"SELECT x, 0 AS y, CASE WHEN len(c) > 0 AND (len(p) = 0 OR len(q) = 0) THEN 1.0::DOUBLE ELSE score END AS score FROM ({joined}) JOIN (SELECT x, max(score) AS score FROM ({ratio_sql(three)}) GROUP BY x) USING (x)"


def partial_set_sql(pairs: str) -> str:
    sets = f"SELECT x, list_distinct(string_split(a, ' ')) AS u, list_distinct(string_split(b, ' ')) AS v FROM ({pairs})"
    apart = f"SELECT x, 0 AS y, array_to_string(list_sort(u), ' ') AS a, array_to_string(list_sort(v), ' ') AS b FROM ({sets}) WHERE len(list_intersect(u, v)) = 0"
    return f"SELECT x, 0 AS y, 1.0::DOUBLE AS score FROM ({sets}) WHERE len(list_intersect(u, v)) > 0 UNION ALL {partial_sql(apart)}"


def wratio_sql(pairs: str) -> str:
    tables = {"r": ratio_sql(pairs), "pr": partial_sql(pairs), "ts": ratio_sql(sorted_sql(pairs)), "tt": token_set_sql(pairs), "ps": partial_sql(sorted_sql(pairs)), "pt": partial_set_sql(pairs)}
    joins_ = " ".join(f"JOIN ({sql}) {name} ON {name}.x = n.x" for name, sql in tables.items())
    longer = "CAST(greatest(len(n.a), len(n.b)) AS DOUBLE) / least(len(n.a), len(n.b))"
    part, token = f"(CASE WHEN {longer} < 1.5 THEN 0.95::DOUBLE ELSE 0.9::DOUBLE END)", f"(CASE WHEN {longer} >= 8 THEN 0.6::DOUBLE ELSE 0.95::DOUBLE END)"
    most = f"greatest(r.score, pr.score * {part}, ts.score * {token}, tt.score * {token}, ps.score * ({part} * {token}), pt.score * ({part} * {token}))"
    return f"SELECT n.x, 0 AS y, CASE WHEN r.score >= 1 THEN r.score ELSE {most} END AS score FROM ({pairs}) n {joins_}"


pair_query("tx7_partial_ratio_words", _words, {"score": "partial_ratio(a, b)"}, partial_sql(_WORD_PAIRS))
pair_query("tx9_token_set_ratio_words", _words, {"score": "token_set_ratio(a, b)"}, token_set_sql(_WORD_PAIRS))
pair_query("tx10_partial_token_sort_words", _words, {"score": "partial_token_sort_ratio(a, b)"}, partial_sql(sorted_sql(_WORD_PAIRS)))
pair_query("tx11_partial_token_set_words", _words, {"score": "partial_token_set_ratio(a, b)"}, partial_set_sql(_WORD_PAIRS))
ORACLES["tx12_wratio"] = wratio_sql(_WORD_PAIRS)
del QUERIES["tx9_token_ratios"]

_SERIES = "SELECT user_id, list(value ORDER BY ts, event_id) AS v FROM events GROUP BY user_id"
_BAND = "ceil(0.1::DOUBLE * greatest(len(a), len(b)))"
ORACLES["seq1_dtw_band"] = "SELECT x AS user_id, cost FROM (" + dp(
    f"SELECT user_id AS x, 0 AS y, v AS a, (SELECT v FROM ({_SERIES}) ORDER BY user_id LIMIT 1) AS b FROM ({_SERIES})", "list_transform(range(0, len(b) + 1), lambda j: CASE WHEN j = 0 THEN 0.0::DOUBLE ELSE 'inf'::DOUBLE END)", "'inf'",
    f"CASE WHEN abs(i - {{j}}) <= {_BAND} THEN (a[i] - b[{{j}}]) * (a[i] - b[{{j}}]) + least(p[{{j}}], p[{{j}} + 1], l[len(l)]) ELSE 'inf'::DOUBLE END", "p[len(p)] AS cost", kind="DOUBLE",
) + ")"

# Further facades


def _aligned(spark: SparkSession) -> list[tuple]:
    m = aligner.matrix_create("ACGT", 2, -1)
    found = [aligner.nw_trace(a, b, 1, 1, m) for a, b in (("ACGT", "ACCT"), ("ACCGT", "CCG"))]
    return [(r.score, r.traceback.query, r.traceback.comp, r.traceback.ref, r.cigar.decode, s) for r, s in zip(found, (aligner.sw(a, b, 1, 1, m).score for a, b in (("ACGT", "ACCT"), ("ACCGT", "CCG"))))]


facade_query("al12_aligner_facade", "score, query, comp, ref, cigar, local", _aligned, [(5, "ACGT", "||.|", "ACCT", "2=1X1=", 5), (4, "ACCGT", " ||| ", "-CCG-", "1D3=1D", 6)])
facade_query(
    "seq3_lower_bound", "band, bound", lambda spark: [(0, keogh(np.array([0.0, 0, 0]), np.array([2.0, 0, -1]), 0)), (1, keogh(np.array([0.0, 1, 0]), np.array([2.0, 0, 0]), 1)), (2, keogh(np.array([1.0, 2, 3]), np.array([3.0, 2, 1]), 2))],
    [(0, 5.0), (1, 1.0), (2, 0.0)],
)
facade_query("tx13_best_team", "choice, score", lambda spark: [tuple(process.extract_rounded(spark, "cowboys", _TEAMS, limit=1)[0][:2])], [("Dallas Cowboys", 90)])
facade_query("udf3_callable_inner", "score", lambda spark: [(text.monge_elkan("a b", "b", lambda p, q: float(p == q)),)], [(0.5,)])
_NCBI = "# a comment\n   A  C  X\nA  4 -1 -4\nC -1  9 -4\nX -4 -4  1\n"
case_query(
    "src4_ncbi_text", "t string", [(_NCBI,)], [("ACX", 4, 13, 9)],
    {"alphabet": "{}matrix_info({}matrix_from_ncbi_text(t)).alphabet", "aa": "{}substitution_matrix_score({}matrix_from_ncbi_text(t), 'A', 'A')", "ac": "{}substitution_matrix_score({}matrix_from_ncbi_text(t), 'AC', 'AC')", "cc": "{}substitution_matrix_score({}matrix_from_ncbi_text(t), 'C', 'C')"},
)


# Files: a table's strings written as text and read back


def _folder(spark: SparkSession) -> str:
    """A folder for this session's text files, shared where the session names one."""
    import tempfile

    return f"{spark.sparkContext.getConf().get('spark.checkpoint.dir') or tempfile.gettempdir()}/nearspan-{spark.sparkContext.applicationId}"


@query("src3_dictionary", f"SELECT DISTINCT lower(s) AS word FROM ({_NATIONS})")
def src3_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearspan.sources.corpus import dictionary

    path = f"{_folder(spark)}/dictionary"
    nations(spark, sf_dir).select(F.lower("s")).write.mode("overwrite").text(path)
    found = dictionary(spark, path)
    return found.select(F.col(found.columns[0]).alias("word")).distinct()


@query("src2_verses", f"SELECT s AS reference, 'in ' || s AS verse FROM ({_NATIONS})")
def src2_verses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file with two lines of heading."""
    from nearspan.sources.corpus import verses

    path = f"{_folder(spark)}/verses"
    lines = nations(spark, sf_dir).agg(F.array_join(F.array_sort(F.collect_list(F.concat("s", F.lit("\tin "), "s"))), "\n").alias("t"))
    lines.select(F.concat(F.lit("a title\nanother line\n"), "t")).coalesce(1).write.mode("overwrite").text(path)
    return verses(spark, path)


@query("snk1_written_scores", f"SELECT a.k AS query_index, b.k AS target_index, jaro_similarity(a.s, b.s) AS score FROM ({_NATIONS}) a, ({_NATIONS}) b")
def snk1_written_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores as files, and read again."""
    path = f"{_folder(spark)}/scores"
    n = nations(spark, sf_dir)
    joins.cdist(n, n, "jaro", **_HOW).select("query_index", "target_index", "score").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _npy() -> bytes:
    out = io.BytesIO()
    np.save(out, np.array([[3, -2], [-2, 3]], np.int8))
    return out.getvalue()


case_query(
    "src5_npy_matrix", "b binary", [(bytearray(_npy()),)], [("AC", 6, 3)],
    {"alphabet": "{}matrix_info({}keyboard_from_npy(b, 'TWO', 'AC', 'C')).alphabet", "same": "{}substitution_matrix_score({}keyboard_from_npy(b, 'TWO', 'AC', 'C'), 'AC', 'AC')", "part": "{}substitution_matrix_score({}keyboard_from_npy(b, 'TWO', 'AC', 'C'), 'A', 'CA')"},
)
_CLUSTERS = (("👨‍👩‍👧", "👨‍👩‍👧‍👦", 1), ("é", "e", 1), ("kitten", "sitting", 3), ("", "ab", 2))
facade_query("tx20_grapheme_distance", "a, b, distance", lambda spark: [(a, b, graphemes.levenshtein_distance(a, b)) for a, b, _ in _CLUSTERS], _CLUSTERS)
facade_query("ph10_phonetic_facade", "name, soundex, codex", lambda spark: [(s, graphemes.soundex(s), graphemes.match_rating_codex(s)) for s in ("Robert", "Smith", "Lloyd")], [("Robert", "R163", "RBRT"), ("Smith", "S530", "SMTH"), ("Lloyd", "L300", "LYD")])
