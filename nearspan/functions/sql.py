"""Registers the function library with a session, so that SQL can call it.

What Spark's own functions can say becomes a SQL function that Catalyst inlines; the rest are Arrow functions that
take their optional arguments by position.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import SparkSession

from nearspan.functions import kernels as k
from nearspan.functions import matrices, phonetic, text
from nearspan.functions.arrow import udf
from nearspan.functions.batch import lcs_length, lcs_substring
from nearspan.functions.matrices import MATRIX_SCHEMA
from nearspan.functions.paths import PATH_SCHEMA
from nearspan.shipping import ship

_FAR = "9223372036854775806L"
_MATRIX_INFO = "struct<name: string, alphabet: string, stride: bigint, wildcard_index: bigint, gap_score: bigint, gap_open: bigint, gap_extend: bigint>"


@dataclass(frozen=True)
class Python:
    """kernel takes ``arity`` lists, then options."""

    kernel: object
    returns: str
    arity: int = 2
    nulls: bool = False


@dataclass(frozen=True)
class Sql:
    """{p} in the body stands for the prefix."""

    arguments: str
    returns: str
    body: str


def _ranked(scores: str, options: str, call: str, kind: str, similarity: bool) -> tuple[Sql, Sql]:
    """The k nearest of an array, and the nearest, from the scores that a function gives."""
    match = k.MATCH.format(kind)
    found = f"{{p}}{scores}(q, targets{call})"
    rows = f"transform({found}, (s, i) -> struct({'-s' if similarity else 's'} AS o, CAST(i AS BIGINT) AS index, get(targets, i) AS target, s AS score))"
    rows = f"array_sort(filter({rows}, x -> x.score IS NOT NULL))"
    pick = "struct(x.target AS target, x.score AS score, x.index AS index)"
    top = Sql(f"q STRING, targets ARRAY<STRING>, k INT DEFAULT 5{options}", f"ARRAY<{match}>", f"transform(slice({rows}, 1, k), x -> {pick})")
    best = Sql(f"q STRING, targets ARRAY<STRING>{options}", match, f"get(transform({rows}, x -> {pick}), 0)")
    return top, best


def catalogue(matrix_dir: str | None = None, rules_dir: str | None = None) -> dict[str, Python | Sql]:
    out: dict[str, Python | Sql] = {
        "align_simd_level": Sql("", "STRING", "'spark'"), "available_backends": Sql("", "ARRAY<STRING>", "array('spark')"),
        "backend_is_available": Sql("name STRING", "BOOLEAN", "lower(name) = 'spark'"), "detect_best_backend": Sql("", "STRING", "'spark'"),
    }
    text2 = "a STRING, b STRING"
    lev = "CAST(levenshtein(a, b) AS BIGINT)"
    distance = Sql(f"{text2}, cutoff BIGINT DEFAULT {_FAR}", "BIGINT", f"CASE WHEN cutoff >= greatest(length(a), length(b)) THEN {lev} WHEN levenshtein(a, b, CAST(greatest(cutoff, -1L) AS INT)) < 0 THEN cutoff + 1 ELSE levenshtein(a, b, CAST(cutoff AS INT)) END + 0 * length(a) * length(b)")
    share = "CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN greatest(length(a), length(b)) = 0 THEN 1.0D ELSE 1.0D - levenshtein(a, b) / greatest(length(a), length(b)) END"
    ratio = Sql(f"{text2}, cutoff DOUBLE DEFAULT 0.0D", "DOUBLE", f"CASE WHEN ({share}) < cutoff THEN 0.0D ELSE {share} END")
    out |= dict.fromkeys(("levenshtein", "levenshtein_score"), distance) | dict.fromkeys(("levenshtein_similarity", "levenshtein_normalized_score"), ratio)
    families = (
        ("osa", "damerau_levenshtein", ("osa", "damerau_levenshtein_score"), ("osa_similarity", "damerau_levenshtein_normalized_score")),
        ("true_damerau_levenshtein", "true_damerau_levenshtein", ("true_damerau_levenshtein", "true_damerau_levenshtein_score"), ("true_damerau_levenshtein_similarity", "true_damerau_levenshtein_normalized_score")),
        ("indel", "indel", ("indel", "indel_score"), ("indel_similarity", "indel_normalized_score")),
        ("hamming", "hamming", ("hamming", "hamming_score"), ("hamming_similarity", "hamming_normalized_score")),
    )
    for _, name, distances, similarities in families:
        out |= dict.fromkeys(distances, Python(k.pair_with_cutoff(name), "bigint"))
        out |= dict.fromkeys(similarities, Python(k.pair_with_cutoff(f"{name}_normalized"), "double"))
    for name in ("levenshtein", "damerau_levenshtein", "true_damerau_levenshtein", "indel", "hamming"):
        out[f"{name}_scores"] = Python(k.many(k.pair_with_cutoff(name)), "array<bigint>")
        out[f"{name}_normalized_scores"] = Python(k.many(k.pair_with_cutoff(f"{name}_normalized")), "array<double>")
        out[f"{name}_top_k"], out[f"{name}_best"] = _ranked(f"{name}_scores", "", "", "bigint", False)
        out[f"{name}_normalized_top_k"], out[f"{name}_normalized_best"] = _ranked(f"{name}_normalized_scores", "", "", "double", True)
    for name in ("jaro", "jaro_winkler"):
        out |= dict.fromkeys((name, f"{name}_similarity"), Python(k.pair(name), "double"))
        out[f"{name}_similarities"] = Python(k.many(k.pair(name)), "array<double>")
    out["jaro_top_k"], out["jaro_best"] = _ranked("jaro_similarities", "", "", "double", True)
    prefix = ", weight DOUBLE DEFAULT 0.1D, threshold DOUBLE DEFAULT 0.7D, cap INT DEFAULT 4"
    out["jaro_winkler_top_k"], out["jaro_winkler_best"] = _ranked("jaro_winkler_similarities", prefix, ", weight, threshold, cap", "double", True)

    for name, local in (("smith_waterman", True), ("needleman_wunsch", False)):
        raw, share = k.pair(name), k.pair(f"{name}_normalized")
        out |= dict.fromkeys((name, f"{name}_score"), Python(raw, "bigint"))
        out[f"{name}_affine"] = Python(k.affine(local), "bigint")
        out[f"{name}_normalized_score"] = Python(share, "double")
        out[f"{name}_scores"], out[f"{name}_normalized_scores"] = Python(k.many(raw), "array<bigint>"), Python(k.many(share), "array<double>")
        out |= dict.fromkeys((f"{name}_path", f"{name}_path_info"), Python(k.path(local), PATH_SCHEMA))
        out |= dict.fromkeys((f"{name}_cigar", f"{name}_trace_cigar", f"{name}_trade_cigar"), Python(k.path(local, "cigar"), "string"))
        score = k.matrix_score(local, matrix_dir)
        out[f"{name}_matrix_score"], out[f"{name}_matrix_scores"] = Python(score, "bigint"), Python(k.many(score), "array<bigint>")
        out |= dict.fromkeys((f"{name}_matrix_path", f"{name}_matrix_path_info"), Python(k.matrix_path(local, matrix_dir), PATH_SCHEMA))
        out[f"{name}_matrix_cigar"] = Python(k.matrix_path(local, matrix_dir, "cigar"), "string")
        out[f"cdist_matrix_{'local' if local else 'global'}"] = Python(k.matrix_grid(local, matrix_dir), "array<array<bigint>>")
    for kind in ("score", "normalized_score", "scores", "normalized_scores"):
        out[f"smith_waterman_farrar_{kind}"] = out[f"smith_waterman_{kind}"]
    gaps = ", match BIGINT DEFAULT 2L, mismatch BIGINT DEFAULT -1L, gap_open BIGINT DEFAULT -1L, gap_extend BIGINT DEFAULT NULL"
    out["smith_waterman_top_k"], out["smith_waterman_best"] = _ranked("smith_waterman_scores", gaps, ", match, mismatch, gap_open, coalesce(gap_extend, gap_open)", "bigint", True)

    double_match = k.MATCH.format("double")
    out |= {
        "scores": Python(k.scores, "array<double>"), "extract": Python(k.extract, f"array<{double_match}>"), "extract_best": Python(k.extract_best, double_match),
        "cdist": Python(k.cdist, "array<array<double>>"), "cdist_above_threshold": Python(k.cdist_above_threshold, f"array<{k.PAIR}>"), "cdist_top_k": Python(k.cdist_top_k, f"array<{k.PAIR}>"),
        "cdist_top_k_per_query": Python(k.cdist_top_k_per_query, f"array<{k.PER_QUERY}>"),
        "cdist_matrix_above_threshold": Python(k.matrix_above_threshold(matrix_dir), f"array<{k.PAIR}>"), "cdist_matrix_top_k": Python(k.matrix_top_k(matrix_dir), f"array<{k.PAIR}>"),
        "lcs_length": Python(lambda a, b: lcs_length(a, b), "bigint"), "lcs_substring": Python(lambda a, b: lcs_substring(a, b), "string"),
        "lcs_substring_length": Python(lambda a, b: [len(s) for s in lcs_substring(a, b)], "bigint"),
    }
    for metric in ("jaccard", "dice", "cosine", "overlap"):
        out[metric], out[f"{metric}_similarities"] = Python(k.ngram(metric), "double"), Python(k.many(k.ngram(metric)), "array<double>")
    singular = {
        "ratcliff_obershelp_similarity": text.ratcliff_obershelp, "partial_ratio": text.partial_ratio, "token_sort_ratio": text.token_sort_ratio, "token_set_ratio": text.token_set_ratio,
        "partial_token_sort_ratio": text.partial_token_sort_ratio, "partial_token_set_ratio": text.partial_token_set_ratio, "wratio": text.wratio,
    }
    for name, function in singular.items():
        plural = name.replace("similarity", "similarities") if "similarity" in name else f"{name}s"
        out[name], out[plural] = Python(k.each(function), "double"), Python(k.many(k.each(function)), "array<double>")
    out["monge_elkan"] = Python(k.each(text.monge_elkan), "double")

    one = {
        "metaphone": (phonetic.metaphone, "string"), "nysiis": (phonetic.nysiis, "string"), "match_rating_codex": (phonetic.match_rating_codex, "string"), "caverphone": (phonetic.caverphone, "string"),
        "cologne_phonetic": (phonetic.cologne_phonetic, "string"), "daitch_mokotoff": (phonetic.daitch_mokotoff, "string"), "double_metaphone": (k.double_metaphone, "struct<primary: string, alternate: string>"),
    }
    out |= {name: Python(k.alone(f), returns, 1) for name, (f, returns) in one.items()}
    plain = "regexp_replace({}, '[^A-Za-z]', '')"
    code = lambda c: f"soundex({plain.format(c)})"  # noqa: E731  of anything but letters Spark's soundex would give back what it got
    out["soundex"] = Sql("s STRING", "STRING", code("s"))
    out["soundex_equal"] = Sql(text2, "BOOLEAN", f"{code('a')} = {code('b')} AND {code('a')} <> ''")
    out |= {
        "metaphone_equal": Python(k.equal(phonetic.metaphone), "boolean"), "nysiis_equal": Python(k.equal(phonetic.nysiis), "boolean"), "match_rating_compare": Python(k.each(phonetic.match_rating_compare), "boolean"),
        "beider_morse": Python(k.beider(rules_dir), "string", 1), "dtw": Python(k.dtw_pairs, "double"), "dtw_distances": Python(k.dtw_many, "array<double>"),
    }

    named = lambda m: k.matrix_of(m, matrix_dir)
    names = ", ".join("'" + n.replace("'", "''") + "'" for n in matrices.available(matrix_dir))
    gap_defaults = "gap_score BIGINT DEFAULT {}L, gap_open BIGINT DEFAULT NULL, gap_extend BIGINT DEFAULT NULL"
    out |= {
        "matrix_available": Sql("", "ARRAY<STRING>", f"array({names})"), "keyboard_available": Sql("", "ARRAY<STRING>", "CAST(array() AS ARRAY<STRING>)"),
        "matrix_info": Python(lambda m: [named(x).info() for x in m], _MATRIX_INFO, 1), "matrix_encode": Python(lambda m, s: [named(x).encode(y) for x, y in zip(m, s)], "array<int>"),
        "matrix_transpose": Python(lambda m, name=None: [named(x).transpose(name).row() for x in m], MATRIX_SCHEMA, 1),
        "matrix_score_step_limit": Python(lambda m, *gaps: [named(x).step_limit(*gaps) for x in m], "bigint", 1),
        "substitution_matrix_score": Python(lambda m, a, b: [named(x).score(y, z) for x, y, z in zip(m, a, b)], "bigint", 3),
        "matrix_from_ncbi_text": Python(k.built(matrices.from_ncbi_text), MATRIX_SCHEMA, 1, True),
        "identity_matrix": Python(k.built(matrices.identity), MATRIX_SCHEMA, 1, True),
        "substitution_matrix": Python(lambda n, a, g, *o: [k.substitution_matrix(x, y, z, *o).row() for x, y, z in zip(n, a, g)], MATRIX_SCHEMA, 3, True),
        "keyboard_from_confusion_counts": Python(k.built(matrices.from_confusion_counts), MATRIX_SCHEMA, 1, True), "keyboard_from_npy": Python(k.built(matrices.from_npy), MATRIX_SCHEMA, 1, True),
        "ascii_matrix_of": Python(k.built(matrices.ascii_text), MATRIX_SCHEMA, 1, True),
        "ascii_matrix": Sql(f"match BIGINT DEFAULT 1L, mismatch BIGINT DEFAULT -1L, name STRING DEFAULT 'ASCII', {gap_defaults.format(-1)}", MATRIX_SCHEMA, "{p}ascii_matrix_of(match, mismatch, name, gap_score, gap_open, gap_extend)"),
    }
    return out


def _needed(functions: dict[str, Python | Sql], only: Iterable[str]) -> dict[str, Python | Sql]:
    """These functions and those that their bodies call."""
    found: dict[str, Python | Sql] = {}
    open_ = list(only)
    while open_:
        name = open_.pop()
        if name not in found:
            found[name] = functions[name]
            open_ += re.findall(r"\{p\}(\w+)", found[name].body) if isinstance(found[name], Sql) else []
    return found


def register(spark: SparkSession, prefix: str = "ns_", matrix_dir: str | None = None, rules_dir: str | None = None, only: Iterable[str] | None = None) -> list[str]:
    """Registers functions (all, or those named) under prefix + name, and returns the names.

    matrix_dir: NCBI text files of substitution matrices; rules_dir: rule files of Beider-Morse codes. Both are read by
    the workers, so they must be there on every executor. A prefix is needed where a name is also one of Spark's own.
    """
    if not prefix:
        raise ValueError("without a prefix the names would hide Spark's own functions")
    ship(spark)
    functions = catalogue(matrix_dir, rules_dir)
    if only is not None:
        functions = _needed(functions, only)
    made: dict[int, object] = {}
    for name, f in functions.items():
        if isinstance(f, Python):
            if id(f) not in made:
                made[id(f)] = udf(f.kernel, f.returns, f.arity, f.nulls)
            spark.udf.register(prefix + name, made[id(f)])
    for name, f in functions.items():
        if isinstance(f, Sql):
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({f.arguments}) RETURNS {f.returns} RETURN {f.body.replace('{p}', prefix)}")
    return [prefix + n for n in functions]
