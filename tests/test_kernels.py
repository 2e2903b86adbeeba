import difflib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from nearspan.facades import aligner, distance, fuzz, graphemes
from nearspan.functions import batch, dtw, matrices, paths, phonetic, text
from nearspan.functions.scorers import SCORERS, Options, scorer

PAIRS = [
    ("", ""), ("abc", ""), ("", "abc"), ("abc", "abc"), ("kitten", "sitting"), ("flaw", "lawn"), ("ca", "abc"), ("MARTHA", "MARHTA"), ("ACCGT", "ACG"), ("Müller", "Mueller"), ("γειά", "γεια"),
    ("你好世界", "你好啊"), ("a😀", "a😃"), ("𝛼+𝛽", "𝛼-𝛽"), ("a\0b", "ab"), ("�", "x"), ("\U0010fffe", ""), ("नमस्ते", "नमस्कार"), ("👨‍👩‍👧", "👨‍👩‍👦"), ("a" * 100, "a" * 99 + "b"), ("界" * 80, "界" * 70),
]
A, B = [a for a, _ in PAIRS], [b for _, b in PAIRS]
words = st.text(alphabet="abcé😀", max_size=12)
#: Longer than a machine word as well.
long_words = st.text(alphabet="ab", min_size=60, max_size=75)


def edits(a, b, substitute=1, swaps=False):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + substitute * (a[i - 1] != b[j - 1]))
            if swaps and i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(words | long_words, words | long_words), min_size=1, max_size=6))
def test_edit_distances_equal_their_definitions(pairs):
    a, b = [p for p, _ in pairs], [q for _, q in pairs]
    assert batch.levenshtein(a, b).tolist() == [edits(p, q) for p, q in pairs]
    assert batch.osa(a, b).tolist() == [edits(p, q, swaps=True) for p, q in pairs]
    assert batch.indel(a, b).tolist() == [edits(p, q, 2) for p, q in pairs]
    assert batch.lcs_length(a, b).tolist() == [text.lcs_bits(p, q) for p, q in pairs]


def test_known_values():
    one = lambda name, a, b: SCORERS[name].pairs([a], [b])[0]
    assert (one("levenshtein", "kitten", "sitting"), one("levenshtein", "café", "cafe")) == (3, 1)
    assert (one("damerau_levenshtein", "ca", "abc"), one("true_damerau_levenshtein", "ca", "abc")) == (3, 2)
    assert one("indel", "kitten", "sitting") == 5
    assert one("jaro", "MARTHA", "MARHTA") == pytest.approx(0.944444444444)
    assert one("jaro_winkler", "MARTHA", "MARHTA") == pytest.approx(0.961111111111)
    assert (one("jaro", "", ""), one("jaro", "a", ""), one("hamming", "karolin", "kathrin")) == (1, 0, 3)


def test_every_scorer_on_every_pair():
    for s in SCORERS.values():
        options = Options(on_length_mismatch="pad")
        got = s.pairs(A, B, options)
        single = [s.pairs([a], [b], options)[0] for a, b in PAIRS]
        assert np.array_equal(got, single), s.name
        if s.normalized:
            assert ((got >= 0) & (got <= 1)).all()


@settings(max_examples=60, deadline=None)
@given(words, words)
def test_true_damerau_levenshtein_is_a_metric_below_osa(a, b):
    d, back, osa = batch.true_damerau_levenshtein([a], [b])[0], batch.true_damerau_levenshtein([b], [a])[0], batch.osa([a], [b])[0]
    assert d == back and d <= osa and (d == 0) == (a == b)


def test_hamming_of_unequal_lengths():
    with pytest.raises(ValueError):
        batch.hamming(["ab"], ["a"])
    assert batch.hamming(["ab"], ["a"], "skip")[0] == -1
    assert batch.hamming(["ab"], ["a"], "pad")[0] == 1


def test_names_of_scorers():
    assert scorer("Levenshtein-Normalized") is scorer(1) is scorer("1") is SCORERS["levenshtein_normalized"]
    assert scorer("osa") is SCORERS["damerau_levenshtein"] and scorer("jaro_similarity") is SCORERS["jaro"]
    with pytest.raises(ValueError):
        scorer("nothing")


def best_global(a, b, match, mismatch, gap_open, gap_extend):
    """Score of the best alignment, with the three states written out."""
    low = -(10**9)
    m, x, y = {(0, 0): 0}, {}, {}
    get = lambda t, k: t.get(k, low)
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if (i, j) == (0, 0):
                continue
            at = lambda k: max(get(m, k), get(x, k), get(y, k))
            if i and j:
                m[i, j] = at((i - 1, j - 1)) + (match if a[i - 1] == b[j - 1] else mismatch)
            if i:
                x[i, j] = max(at((i - 1, j)) + gap_open, get(x, (i - 1, j)) + gap_extend)
            if j:
                y[i, j] = max(at((i, j - 1)) + gap_open, get(y, (i, j - 1)) + gap_extend)
    k = (len(a), len(b))
    return max(get(m, k), get(x, k), get(y, k))


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab", max_size=8), st.text(alphabet="ab", max_size=8), st.sampled_from([(-1, -1), (-2, -1), (-3, -1), (-1, -2)]))
def test_alignments_and_their_paths(a, b, gaps):
    want = best_global(a, b, 2, -1, *gaps)
    assert batch.alignment([a], [b], False, None, 2, -1, *gaps)[0] == want
    local = max([0, *(best_global(a[i:k], b[j:m], 2, -1, *gaps) for i in range(len(a)) for k in range(i + 1, len(a) + 1) for j in range(len(b)) for m in range(j + 1, len(b) + 1))])
    assert batch.alignment([a], [b], True, None, 2, -1, *gaps)[0] == local
    for is_local, score in ((False, want), (True, local)):
        p = paths.align(a, b, is_local, 2, -1, *gaps)
        assert p["score"] == score
        assert p["aligned_query"].replace("-", "") == a[p["query_start"] : p["query_end"]]
        assert p["aligned_target"].replace("-", "") == b[p["target_start"] : p["target_end"]]
        assert len(p["operations"]) == p["aligned_length"] == p["matches"] + p["mismatches"] + p["insertions"] + p["deletions"]
        if gaps[0] == gaps[1]:
            assert score == 2 * p["matches"] - p["mismatches"] + gaps[0] * (p["insertions"] + p["deletions"])


def test_path_orientation():
    p = paths.align("ACCGT", "ACG", True)
    assert (p["score"], p["cigar"], p["query_start"], p["query_end"]) == (5, "1=1D2=", 0, 4)
    assert paths.align("a", "ba", False)["operations"] == "I="
    assert SCORERS["smith_waterman"].pairs(["ACCGT"], ["ACG"], Options(gap_open=-2, gap_extend=-1))[0] == 4


def test_subsequences_and_ngrams():
    assert text.lcs_bits("ABCBDAB", "BDCAB") == 4 and batch.lcs_substring(["ABCBDAB"], ["BDCAB"]) == ["AB"]
    got = [text.ngram_similarity("ABCBDAB", "BDCAB", 2, m) for m in ("jaccard", "dice", "overlap", "cosine")]
    assert got == pytest.approx([0.25, 0.4, 0.5, 0.5303300858899106])
    assert text.ngram_similarity("aaaa", "aaa", 2) == pytest.approx(2 / 3)
    assert (text.ngram_similarity("a", "b"), text.ngram_similarity("a", "bc")) == (1, 0)
    with pytest.raises(ValueError):
        text.ngram_similarity("a", "b", 0)


@settings(max_examples=60, deadline=None)
@given(words, words)
def test_ratios(a, b):
    assert text.ratcliff_obershelp(a, b) == (difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() if a or b else 1)
    short, long = sorted((a, b), key=len)
    windows = [long[i:j] for i in range(len(long)) for j in range(i + 1, len(long) + 1) if j - i == len(short) or (j - i < len(short) and (i == 0 or j == len(long)))]
    if a and b and len(a) != len(b):
        assert text.partial_ratio(a, b) == max(text.indel_ratio(short, w) for w in windows)


def test_token_ratios():
    assert text.token_sort_ratio("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear") == 1
    assert text.token_set_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 1
    assert (text.token_set_ratio("", ""), text.token_sort_ratio("", ""), text.partial_token_set_ratio(" ", "a")) == (0, 1, 0)
    assert text.wratio("", "") == 1 and text.fuzz_wratio("", "") == 0
    assert text.monge_elkan("paul johnson", "paul", "jaro") == pytest.approx(0.5)
    assert text.monge_elkan("paul", "paul johnson", "jaro") == 1
    assert text.monge_elkan("paul johnson", "paul", "jaro", True) == pytest.approx(0.75)
    assert text.monge_elkan("a b", "b", lambda p, q: float(p == q)) == 0.5


def test_phonetic_codes():
    assert [phonetic.soundex(s) for s in ("Robert", "Rupert", "Ashcraft", "Tymczak", "Pfister", "", "12")] == ["R163", "R163", "A261", "T522", "P236", "", ""]
    assert (phonetic.metaphone("Schmidt"), phonetic.metaphone("Schmidt", 1)) == ("SKMTT", "SXMTT")
    assert phonetic.cologne_phonetic("Müller") == "657" and phonetic.cologne_phonetic("Wikipedia") == "3412"
    assert phonetic.daitch_mokotoff("AUERBACH") == "097400|097500"
    assert phonetic.caverphone("Stevenson") == "STFNSN1111" and phonetic.caverphone("") == "1" * 10
    assert phonetic.double_metaphone("Schmidt") == ("XMT", "SMT") and phonetic.double_metaphone("Smith") == ("SM0", "XMT")
    assert phonetic.match_rating_compare("Catherine", "Kathryn") and not phonetic.match_rating_compare("", "")
    assert phonetic.nysiis("Knight") and phonetic.match_rating_codex("Smith") == "SMTH"


def warped(q, t, band, cost):
    inf = float("inf")
    d = {(0, 0): 0.0}
    for i in range(1, len(q) + 1):
        for j in range(1, len(t) + 1):
            if abs(i - j) <= band:
                d[i, j] = cost(q[i - 1] - t[j - 1]) + min(d.get((i - 1, j), inf), d.get((i, j - 1), inf), d.get((i - 1, j - 1), inf))
    return d.get((len(q), len(t)), inf)


def test_time_warping():
    assert dtw.dtw([[1, 2, 3, 4, 5]], [[1, 2, 2.5, 4, 5]])[0] == pytest.approx(0.25)
    rng = random.Random(1)
    series = lambda: [rng.uniform(-1, 1) for _ in range(rng.randrange(1, 12))]
    qs, ts = [series() for _ in range(40)], [series() for _ in range(40)]
    for distance_, cost in (("l1", abs), ("l2_squared", lambda x: x * x)):
        for window in (None, 0, 1, 3):
            got = dtw.dtw(qs, ts, window, distance_)
            assert got == pytest.approx([warped(q, t, 99 if window is None else window, cost) for q, t in zip(qs, ts)])
            cut = dtw.dtw(qs, ts, window, distance_, 1.0)
            assert cut == pytest.approx(np.where(got > 1, np.inf, got))
    with pytest.raises(ValueError):
        dtw.dtw([[]], [[1.0]])
    with pytest.raises(ValueError):
        dtw.dtw([[float("nan")]], [[1.0]])
    assert dtw.dtw([[1, 2, 3]], [[1, 2, 3, 4, 5, 6]], window_fraction=0.5)[0] == warped([1, 2, 3], [1, 2, 3, 4, 5, 6], 3, lambda x: x * x)


def test_matrices():
    m = matrices.identity("ACGT", 5, -4, "N")
    assert m.alphabet == "ACGTN" and m.scores[4, 4] == -4 and m.encode("AXa") == [0, 4, 4]
    assert m.scores_of(["ACGT", "", "NNNN"], ["ACGA", "A", "ACGT"], True, -5).tolist() == [15, 0, 0]
    ordinary = batch.alignment(["ACGTTA"], ["AGTA"], False, None, 5, -4, -3, -1)[0]
    assert m.scores_of(["ACGTTA"], ["AGTA"], False, -3, -1)[0] == ordinary == m.path("ACGTTA", "AGTA", False, -3, -1)["score"]
    assert m.step_limit() == 5 and m.step_limit(-9) == 9 and m.transpose().name == "IDENTITY.T"
    n = matrices.nucleotides()
    cell = lambda a, b: n.scores[n.alphabet.index(a), n.alphabet.index(b)]
    assert [cell(*p) for p in ("AA", "AC", "AR", "AN", "SS", "WK", "BC", "BW", "NN", "VB")] == [5, -4, 1, -2, -1, -2, -1, -3, -1, -2]
    text_ = "# a comment\n   A  B  X\nA  4 -1  0\nB -1  5  0\nX  0  0 -1\n"
    parsed = matrices.from_ncbi_text(text_, "t")
    assert parsed.scores.tolist() == [[4, -1, 0], [-1, 5, 0], [0, 0, -1]] and matrices.Matrix.of(parsed.row()).info() == parsed.info()
    for bad in ("", "A B\nA 1 2", "A B\nB 1 2\nA 1 2", "A B\nA 1\nB 1 2", "A\nA x"):
        with pytest.raises(ValueError):
            matrices.from_ncbi_text(bad, wildcard="A")
    with pytest.raises(ValueError):
        matrices.Matrix("m", "AA", [[1, 1], [1, 1]], "A")
    with pytest.raises(ValueError):
        matrices.Matrix("m", "A", [[200]], "A")
    assert matrices.load("DNA_MATCH").name == "DNA_MATCH" and "NUC.4.4" in matrices.available()
    with pytest.raises(ValueError):
        matrices.load("BLOSUM62")


def test_confusion_counts():
    counts = np.array([[0, 8, 1], [2, 0, 0], [1, 1, 0]], float)
    m = matrices.from_confusion_counts(counts, "abc")
    expected = 2 * np.log2(8 * counts.sum() / (9 * 9))
    assert m.scores[0, 1] == round(expected) and m.scores[0, 0] == max(0, m.scores[~np.eye(3, dtype=bool)].max()) + 4
    assert m.scores[1, 2] == m.scores[~np.eye(3, dtype=bool)].min()
    assert (matrices.from_confusion_counts({("a", "b"): 8, ("a", "c"): 1, ("b", "a"): 2, ("c", "a"): 1, ("c", "b"): 1}, "abc").scores == m.scores).all()
    assert matrices.from_confusion_counts({}, "ab").scores.tolist() == [[1, -1], [-1, 1]]


def test_facades():
    assert fuzz.ratio("this is a test", "this is a test!") == pytest.approx(96.55172413793103)
    assert fuzz.rounded(fuzz.ratio, process=False)("this is a test", "this is a test!") == 97
    assert fuzz.rounded(fuzz.w_ratio)(None, "a") == 0 and fuzz.w_ratio("", "a") == 0
    assert fuzz.default_process(" A-b,é ") == "a b" and fuzz.full_process("É-b") == "é b" and fuzz.full_process("É-b", True) == "b"
    assert distance.Levenshtein.normalized_similarity("kitten", "sitting") == pytest.approx(1 - 3 / 7)
    assert distance.Levenshtein.distance("kitten", "sitting", score_cutoff=1) == 2 and distance.LCSseq.similarity("ab", "acb") == 2
    for a, b in PAIRS[:12]:
        ops = distance.editops(a, b)
        assert len(ops) == batch.levenshtein([a], [b])[0]
        assert "".join(a[i:j] if tag == "equal" else b[k:m] for tag, i, j, k, m in distance.opcodes(a, b)) == b
    assert graphemes.levenshtein_distance("👨‍👩‍👧", "👨‍👩‍👦") == 1 and graphemes.hamming_distance("abc", "ab") == 1
    assert graphemes.jaccard_similarity("a b", "b c") == pytest.approx(1 / 3) and graphemes.jaccard_similarity("", "") == 0
    assert graphemes.match_rating_comparison("ab", "xyzzyxqrt") is None
    m = aligner.matrix_create("ACGT", 2, -1)
    r = aligner.nw_trace("ACCGT", "acg", 1, 1, m)
    assert (r.score, r.cigar.decode, r.query, r.comp, r.ref) == (4, "1=1D2=1D", "ACCGT", "| || ", "A-CG-")
    s = aligner.sw_stats("ACCGT", "ACG", 1, 1, m)
    assert (s.score, s.matches, s.similar, s.length, s.end_query, s.end_ref) == (5, 3, 3, 4, 3, 2)
    assert aligner.sg("A", "A", 1, 1, m).score == 2 and aligner.sw("A", "C", 1, 1, m).end_query == -1
