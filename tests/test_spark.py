import random
from math import isclose

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearspan import cli
from nearspan.facades import fuzz, process
from nearspan.functions import beider_morse as bm
from nearspan.functions import matrices, phonetic, scorers
from nearspan.functions.arrow import single
from nearspan.functions.scorers import SCORERS
from nearspan.functions.sql import catalogue, register
from nearspan.operators import joins, ranking
from nearspan.plans.candidates import by_segments
from nearspan.sources import corpus
from nearspan.streaming import joins as streams


@pytest.fixture(scope="module")
def functions(spark):
    return register(spark)


#: Expressions without the prefix, and what they give.
CALLS = [
    ("levenshtein('kitten', 'sitting')", 3), ("levenshtein('kitten', 'sitting', 1L)", 2), ("levenshtein('a', CAST(NULL AS STRING))", None), ("levenshtein_similarity('', '')", 1.0),
    ("levenshtein_similarity('flaw', 'lawn', 0.9D)", 0.0), ("osa('ca', 'abc')", 3), ("true_damerau_levenshtein('ca', 'abc')", 2), ("indel('kitten', 'sitting')", 5), ("indel_score('kitten', 'sitting', 2)", 3),
    ("indel_similarity('abc', 'xyz', 0.1)", 0.0), ("hamming('karolin', 'kathrin')", 3), ("jaro_winkler('MARTHA', 'MARHTA')", 0.9611111111111111), ("jaro_winkler('MARTHA', 'MARHTA', 0.2, 0.7, 4)", 0.9777777777777779),
    ("smith_waterman('ACCGT', 'ACG')", 5), ("smith_waterman_affine('ACCGT', 'ACG')", 4), ("needleman_wunsch_affine('ACCGT', 'ACG')", 2), ("needleman_wunsch_normalized_score('', '')", 1.0),
    ("smith_waterman_farrar_score('ACCGT', 'ACG', 2, -1, -1)", 5), ("needleman_wunsch_cigar('ACCGT', 'ACG')", "1=1D2=1D"), ("levenshtein_scores('kitten', array('sitting', null, ''))", [3, None, 6]),
    ("needleman_wunsch_scores('AC', array('AC', 'A'), 1, -1, -1)", [2, 0]), ("scores('a', array('a', 'b'), 'osa')", [0.0, 1.0]), ("lcs_length('ABCBDAB', 'BDCAB')", 4), ("lcs_substring('ABCBDAB', 'BDCAB')", "AB"),
    ("jaccard('ABCBDAB', 'BDCAB')", 0.25), ("dice('aaaa', 'aaa', 3)", 2 / 3), ("token_set_ratio('a b', 'b a')", 1.0), ("partial_ratios('abc', array('xabcx', null))", [1.0, None]),
    ("monge_elkan('paul johnson', 'paul', 'jaro', true)", 0.75), ("soundex('Robert')", "R163"), ("soundex('12 a')", "A000"), ("soundex('12')", ""), ("soundex_equal('', '')", False), ("metaphone_equal('Knight', 'Night')", True),
    ("double_metaphone('Schmidt').alternate", "SMT"), ("daitch_mokotoff('AUERBACH', false)", "097400"), ("match_rating_compare('Catherine', 'Kathryn')", True), ("dtw(array(1D, 2D, 3D), array(1D, 3D))", 1.0),
    ("dtw(array(1D, 2D, 3D, 4D), array(1D), 1)", float("inf")), ("dtw(array(1D, 5D), array(1D, 2D), 0, 'l1', 2D)", float("inf")), ("dtw_distances(array(1D), array(array(3D), null))", [4.0, None]),
    ("matrix_info(identity_matrix('ACGT', 5, -4, 'N')).wildcard_index", 4), ("smith_waterman_matrix_score('ACGT', 'ACGA', 'NUC.4.4', -5)", 15), ("smith_waterman_matrix_scores('AC', array('AC', null), 'DNA_MATCH')", [10, None]),
    ("needleman_wunsch_matrix_cigar('ACGT', 'AGT', 'DNA_MATCH', -3, -1)", "1=1D2="), ("matrix_encode('DNA_MATCH', 'ACXT')", [0, 1, 4, 3]), ("matrix_transpose('DNA_MATCH', 'd').name", "d"), ("matrix_score_step_limit('DNA_MATCH', 9)", 9),
    ("substitution_matrix_score('DNA_MATCH', 'ACGT', 'ACGT')", 20), ("substitution_matrix('m', 'AB', array(array(1, -1), array(-1, 1)), -2, 'B').gap_score", -2), ("matrix_from_ncbi_text('  A B\\nA 1 0\\nB 0 1', 't', -4, 'B').alphabet", "AB"),
    ("keyboard_from_confusion_counts(array(array(0D, 3D), array(1D, 0D)), 'ab').wildcard", "b"), ("ascii_matrix(2).name", "ASCII"), ("cdist_matrix_global(array('AC'), array('AC', null), 'DNA_MATCH')", [[10, None]]),
    ("cdist(array('ab', null), array('ab', 'b'), 'levenshtein')", [[0.0, 1.0], [None, None]]), ("size(cdist_above_threshold(array('hello'), array('hallo', null), 'jaro_winkler', 0.8))", 1), ("align_simd_level()", "spark"),
    ("size(cdist_matrix_above_threshold(array('ACGT'), array('ACG'), 'DNA_MATCH', true, 16))", 0), ("cdist_matrix_top_k(array('ACGT', 'A'), array('ACG'), 'DNA_MATCH', true, 1)[0].score", 15.0), ("size(keyboard_available())", 0),
]


def test_sql_functions(spark, functions):
    expressions = [f"ns_{c}".replace("(identity", "(ns_identity").replace("size(cdist", "size(ns_cdist") for c, _ in CALLS]
    expressions = [e.replace("ns_size(", "size(") if "size(ns_" in e else "size(ns_keyboard_available())" if "keyboard_available" in e else e for e in expressions]
    row = spark.range(1).select(*(F.expr(e).alias(f"c{i}") for i, e in enumerate(expressions))).first()
    for i, (call, want) in enumerate(CALLS):
        assert row[i] == want or isinstance(want, float) and isclose(row[i], want), (call, row[i])
    assert len(functions) == len(catalogue()) >= 167


def test_ranked_sql_functions(spark, functions):
    one = lambda e: spark.sql(f"SELECT {e}").first()[0]
    names = "array('sitting', 'kitten', null, 'bitten', 'ktiten')"
    assert [(m.target, m.score, m["index"]) for m in one(f"ns_levenshtein_top_k('kitten', {names}, 3)")] == [("kitten", 0, 1), ("bitten", 1, 3), ("ktiten", 2, 4)]
    assert one("ns_indel_best('a', CAST(array() AS ARRAY<STRING>))") is None and one("ns_jaro_best('a', array(null, 'a'))")["index"] == 1
    assert [m["index"] for m in one("ns_smith_waterman_top_k('AC', array('A', 'AC', 'ACC'), 2)")] == [1, 2]
    assert one(f"ns_extract_best('kitten', {names}, 'Levenshtein-Normalized')")["index"] == 1
    rows = one("ns_cdist_top_k(array('a', 'b'), array('a', 'b'), 'jaro', 3, true)")
    assert [(p.query_index, p.target_index) for p in rows] == [(0, 1), (1, 0)]
    rows = one("ns_cdist_top_k_per_query(array('ab', null), array('ab', 'abc', null), 'hamming_normalized', 2)")
    assert [[m.target_index for m in r.matches] for r in rows] == [[0], []]
    with pytest.raises(ValueError):
        register(spark, "")


def test_columns_on_nulls_and_empty_frames(spark):
    df = spark.createDataFrame([("kitten", "sitting"), (None, "a"), ("", "")], "a string, b string")
    for name, s in SCORERS.items():
        got = [r[0] for r in df.select(scorers.score(name, F.col("a"), F.col("b"), on_length_mismatch="pad").alias("s")).collect()]
        assert got[1] is None and got[2] == (1 if s.normalized else 0), name
        assert df.limit(0).select(scorers.score(name, F.col("a"), F.col("b"))).collect() == []
    rows = df.select(scorers.vector("osa", F.col("a"), F.array("b", F.lit(None)))).collect()
    assert [r[0] for r in rows] == [[3, None], None, [0, None]]


def noisy(rng, n, base):
    out = []
    for _ in range(n):
        s = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(s) + 1)
            if rng.random() < 0.5:
                s.insert(i, rng.choice("abcé"))
            elif s:
                s.pop(min(i, len(s) - 1))
        out.append("".join(s))
    return out


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(1)
    base = ["".join(rng.choice("abcde") for _ in range(rng.randrange(0, 22))) for _ in range(25)]
    q, t = [*noisy(rng, 60, base), "", ""], [*noisy(rng, 70, base), "", None]
    return q, t, spark.createDataFrame(list(enumerate(q)), "query_index long, query string"), spark.createDataFrame(list(enumerate(t)), "target_index long, target string")


@pytest.mark.parametrize("name", ["levenshtein_normalized", "damerau_levenshtein_normalized", "indel_normalized", "jaro_winkler", "needleman_wunsch_normalized"])
def test_joins_equal_brute_force(sides, name):
    q, t, qd, td = sides
    pairs = [(i, j) for i in range(len(q)) for j in range(len(t)) if t[j] is not None]
    score = dict(zip(pairs, SCORERS[name].pairs([q[i] for i, _ in pairs], [t[j] for _, j in pairs])))
    for threshold in (0.0, 0.5, 0.8, 1.0):
        got = [(r.query_index, r.target_index) for r in joins.above_threshold(qd, td, name, threshold).collect()]
        assert sorted(got) == sorted(p for p, s in score.items() if s >= threshold)
    best = sorted(score, key=lambda p: (-score[p], p))
    assert [(r.query_index, r.target_index) for r in joins.top_k(qd, td, name, 9).collect()] == best[:9]
    assert [(r.query_index, r.target_index) for r in joins.top_k(qd, td, name, 9, reject_duplicates=True).collect()] == [p for p in best if q[p[0]] != t[p[1]]][:9]
    want = sorted((i, r + 1, p[1]) for i in range(len(q)) for r, p in enumerate([p for p in best if p[0] == i][:3]))
    assert sorted((r.query_index, r["rank"], r.target_index) for r in joins.top_k_per_query(qd, td, name, 3).collect()) == want


def test_segments_are_an_equi_join(sides):
    _, _, qd, td = sides
    assert by_segments(SCORERS["levenshtein_normalized"], 0.8)
    plan = joins.above_threshold(qd, td, "levenshtein_normalized", 0.8)._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64" in plan and "Cross" not in plan


def test_join_forms(spark, sides):
    q, t, qd, td = sides
    with pytest.raises(ValueError):
        joins.above_threshold(qd, td, "hamming_normalized", 0.5)
    with pytest.raises(ValueError):
        joins.above_threshold(qd, td, "levenshtein", 0.5)
    skipped = joins.top_k_per_query(qd, td, "hamming_normalized", 2)
    assert all(len(r.query) == len(r.target) for r in skipped.collect())
    lists = {r.query_index: r.matches for r in joins.matches(skipped, qd).collect()}
    assert len(lists) == len(q) and all(len(m) <= 2 for m in lists.values())
    assert joins.cdist(qd, td, lambda a, b: float(len(a) + len(b))).where("score <> length(query) + length(target)").count() == 0
    arrays = joins.cdist_array(qd, td, "levenshtein").where("query_index = 0").first().scores
    assert len(arrays) == len(t) - 1
    self_join = joins.above_threshold(qd, qd.toDF("target_index", "target"), "jaro", 0.99, include_self=False)
    assert self_join.where("query_index = target_index").count() == 0 and self_join.where("query = ''").count() == q.count("") * (q.count("") - 1)
    dna = joins.cdist_matrix(qd, td, matrices.identity("abcde", 2, -1), True)
    top = joins.matrix_top_k(qd, td, matrices.identity("abcde", 2, -1), 4).collect()
    assert [r.score for r in top] == sorted((r.score for r in dna.collect()), reverse=True)[:4]
    assert joins.matrix_above_threshold(qd, td, matrices.identity("abcde", 2, -1), 10).where("score < 10").count() == 0
    coded = joins.phonetic_join(qd, td, single(phonetic.daitch_mokotoff, "string")).collect()
    assert coded and all(set(phonetic.daitch_mokotoff(r.query).split("|")) & set(phonetic.daitch_mokotoff(r.target).split("|")) for r in coded)


def test_clashing_and_extra_columns(spark):
    a = spark.createDataFrame([(1, "ab", 9, 9), (1, "ab", 9, 9), (2, None, 9, 9)], "k long, s string, score long, target string")
    assert joins.cdist(a, a, "levenshtein", query="s", target="s", query_index="k", target_index="k").count() == 4
    assert joins.above_threshold(a.limit(0), a, "jaro", 0.5, query="s", target="s", query_index="k", target_index="k").count() == 0


def test_extract_and_dedupe(spark):
    choices = ["new york jets", "new york giants", None, "atlanta falcons", "new york jets"]
    frame = spark.createDataFrame(list(enumerate(choices)), "i long, c string")
    got = ranking.extract(frame, "new york jets", "c", "i", k=3).collect()
    assert [r["index"] for r in got] == [0, 4, 1] and got[0].score == 1
    assert ranking.extract(frame, None, "c", "i").collect() == [] and ranking.extract_best(frame, "NEW YORK JETS", "c", "i", processor=F.lower).first().score == 1
    assert [k for _, _, k in process.extract(spark, "new york jets", choices, limit=2)] == [0, 4]
    assert process.extract_one(spark, "falcons", {"a": "atlanta falcons", "b": None})[2] == "a" and process.extract_one(spark, "a", []) is None
    assert [k for _, _, k in process.extract_iter(spark, "new", choices, "levenshtein", score_cutoff=11)] == [0, 4]
    assert process.extract_rounded(spark, "New York Jets!", choices, limit=1)[0][1:] == (100, 0)
    with pytest.raises(ValueError):
        process.extract(spark, "a", choices, limit=-1)
    table = process.cdist(spark, ["ab", None], ["ab", "b"], score_cutoff=70, dtype=np.uint8)
    assert table.tolist() == [[100, 0], [0, 0]]
    names = ["Tom Sawyer", "Tom Sawyer", "tom sawyer jr", "Huck Finn"]
    assert process.dedupe(spark, names, 70, fuzz.rounded(fuzz.token_set_ratio)) == ["Huck Finn", "tom sawyer jr"]
    assert process.dedupe(spark, ["b", "a"]) == ["b", "a"]


def test_sources(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("# one\n# two\nGen 1\t In the beginning \nGen 2\t \nGen 3\t\"quoted\tverse\n")
    got = corpus.verses(spark, str(tmp_path / "c.tsv")).collect()
    assert [(r.reference, r.verse) for r in got] == [("Gen 1", "In the beginning"), ("Gen 3", '"quoted\tverse')]
    (tmp_path / "words").write_text("Apple\napple \n\nPear\n")
    assert sorted(r.word for r in corpus.dictionary(spark, str(tmp_path / "words")).collect()) == ["apple", "pear"]
    (tmp_path / "none").write_text("\n")
    with pytest.raises(ValueError):
        corpus.dictionary(spark, str(tmp_path / "none"))
    (tmp_path / "TINY").write_text("  A X\nA 3 0\nX 0 -1\n")
    assert corpus.ncbi_matrix(spark, str(tmp_path / "TINY")).name == "TINY" and matrices.load("TINY", str(tmp_path)).gap_open == -10
    np.save(tmp_path / "k.npy", np.arange(4, dtype=np.int8).reshape(2, 2))
    m = corpus.npy_matrix(spark, str(tmp_path / "k.npy"), alphabet="ab", transpose=True)
    assert m.scores.tolist() == [[0, 2], [1, 3]]
    frame = corpus.matrix_frame(spark, m)
    register(spark, only=("matrix_info",))
    assert frame.select(F.expr("ns_matrix_info(struct(*))").alias("i")).first().i.alphabet == "ab"
    corpus.write_scores(spark.range(3), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 3


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "cold widget"), (2, "x")], "query_index long, query string").write.json(str(tmp_path / "in"))
    targets = spark.createDataFrame([(7, "cold widgit")], "target_index long, target string")
    found = []
    stream = spark.readStream.schema("query_index long, query string").json(str(tmp_path / "in"))
    streams.stream_above_threshold(stream, targets, "levenshtein_normalized", 0.8, lambda rows, i: found.extend(rows.collect()), str(tmp_path / "ck")).awaitTermination()
    assert [(r.query_index, r.target_index) for r in found] == [(1, 7)]
    pairs = joins.top_k_per_query(spark.read.json(str(tmp_path / "in")), targets, "jaro", 1)
    assert len(list(streams.iterate(pairs))) == 2 and {q: len(m) for q, m in streams.iterate_per_query(pairs)} == {"cold widget": 1, "x": 1}


def test_command_line(tmp_path, capsys):
    (tmp_path / "a").write_text("kitten")
    (tmp_path / "b").write_bytes(b"kitten\xff")
    assert cli.main(["compare", str(tmp_path / "a"), str(tmp_path / "a")]) == 0 and capsys.readouterr().out.strip() == "1"
    assert cli.main(["compare", str(tmp_path / "a"), str(tmp_path / "b"), "--encoding", "utf8"]) == 2 and "byte 6" in capsys.readouterr().err
    assert cli.main(["compare", str(tmp_path / "a"), str(tmp_path / "b"), "--encoding", "binary", "--mode", "local"]) == 0
    assert cli.main(["benchmark", "--scorers", "jaro", "--pairs", "10", "--format", "csv"]) == 0


def test_rule_files(tmp_path):
    """Made-up rules in the format of the files that are read."""
    files = {
        "gen_languages": "any\nfrench\nenglish\n", "gen_lang": "/* head */\n^x french true // only French\nq english false\n", "gen_rules_any": '"ab" "" "" "(A|b[french])"\n"a" "" "" "a"\n#include gen_more\n',
        "gen_more": '"b" "a" "$" "B"\n"c" "" "[^d]" "(c|k)"\n', "gen_rules_french": '"x" "^" "" "X"\n"a" "" "" "o"\n', "gen_approx_common": '"A" "" "" "(A|E)"\n', "gen_approx_any": '"k" "" "" "K"\n', "gen_approx_french": "",
        "gen_exact_common": "", "gen_exact_any": "", "gen_exact_french": "",
    }
    for name, content in files.items():
        (tmp_path / f"{name}.txt").write_text(content)
    code = lambda s, *o: bm.beider_morse(s, str(tmp_path), *o)
    assert code("ab") == "A|E|b" and code("xa") == "Xo" and code("Xa", 1) == "Xo"
    assert set(code("ca").split("|")) == {"Ka", "ca"} and code("") == "" and code("van xa").startswith("(Xo)-(")
    assert len(code("cacaca", 0, True, 4).split("|")) <= 4
