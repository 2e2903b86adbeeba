"""Secret scans: candidates by one regular expression, false positives removed by a random forest.

Scanning, features and scoring are built-in functions alone. The forest is small: it is grown on the driver
from a bounded table of labelled findings, and becomes a column of nested conditions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearspan.llm.common import table

#: Runs of 16 or more characters of keys and tokens, with parts of 6 or more that dots join to them, as in signed tokens.
#: The parts are possessive: nothing follows them, and Java keeps a stack frame for each part that it could give back.
CANDIDATE = r"(?<![A-Za-z0-9+/=_\-])[A-Za-z0-9+/=_\-]{16,}(?:\.[A-Za-z0-9+/=_\-]{6,})*+"
#: Characters around a candidate that are looked at.
NEAR = 40
#: Labelled findings that the forest is grown from at most; trees and their depth.
LABELLED, TREES, DEPTH = 4000, 15, 5

_DICTIONARY = (
    "the|and|for|with|this|that|from|your|have|are|not|you|all|new|key|token|secret|password|user|name|test|example|sample|dummy|place|holder|here|change|value|data|file|path|image|index|page|site|"
    "node|module|version|build|release|config|default|public|private|static|assets|content|upload|download|report|final|draft|copy|backup|model|layer|table|column|order|item|product|service|client|"
    "server|local|host|cluster|region|service|account|email|mail|address|number|code|http|https|html|json|xml|null|true|false|abc|xyz|foo|bar|baz|lorem|ipsum|error|warning|info|debug|main|master|"
    "branch|commit|hash|digest|license|document|section|chapter|figure|article|title|author|year|month|week|monday|january|spring|summer|winter|time|date|start|end|first|last|next|open|close|read|write"
)
FEATURES = ("length", "transitions", "transition_share", "distinct_share", "digit_share", "upper_share", "hex", "coverage", "vowel_share", "slashes", "dashes", "path", "key_word", "plain_word", "quoted", "assigned")


def features(candidate: Column, before: Column, after: Column) -> list[Column]:
    """In the order of FEATURES, as doubles."""
    n = F.length(candidate).cast("double")
    without = lambda pattern: F.length(F.regexp_replace(candidate, pattern, "")).cast("double")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(candidate, "[^A-Za-z0-9]", "-"), "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0")
    changes = F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")).cast("double") - 1
    flag = lambda c: c.cast("double")
    return [
        n, changes, changes / n, F.size(F.array_distinct(F.split(candidate, ""))) / n, 1 - without("[0-9]") / n, 1 - without("[A-Z]") / n, flag(without("[0-9A-Fa-f]") == 0),
        1 - F.length(F.regexp_replace(F.lower(candidate), f"(?:{_DICTIONARY})", "")).cast("double") / n, 1 - without("[aeiouAEIOU]") / n, n - without("/"), n - without("[_\\-]"),
        flag(before.rlike(r"[/\\.~@]$|https?:\S*$") | after.rlike(r"^\.[a-z]{2,5}\b|^[\\:]\S|^@")),
        flag(before.rlike(r"(?i)(?:token|secret|passw\w*|pwd|api[ _-]?key|access[ _-]?key|private|credentials?|auth\w*|bearer|key)[\"']?[ :=>\"'(]{0,5}$")),
        flag(before.rlike(r"(?i)(?:sha\d*|md5|hash|commit|checksum|digest|uuid|guid|id|version|build|revision|rev|etag|isbn|order|phone|card|invoice|ref|image|img|example|sample|page)[\"']?[ :=#>\"'(-]{0,5}$")),
        flag(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")), flag(before.rlike(r"[:=]\s*[\"'`]?$")),
    ]


def labelled_findings(seed: int = 5) -> list[tuple[str, str, str, int]]:
    """(before, candidate, after, label) of made-up findings: secrets of common shapes, and what resembles them."""
    rng = np.random.default_rng(seed)
    low, up, dig, hexa = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    draw = lambda alphabet, n: "".join(rng.choice(list(alphabet), n))
    pick = lambda *x: x[rng.integers(len(x))]
    word = lambda: pick(*_DICTIONARY.split("|"))
    prose = lambda: " ".join(draw(low, rng.integers(2, 9)) for _ in range(5)) + " "
    out = []
    for _ in range(LABELLED // 2):
        name = pick("token", "secret", "password", "api_key", "api-key", "access_key", "apiKey", "auth_token", "client_secret", "private_key", "Bearer", "passwd", "TOKEN", "SECRET_KEY")
        value = pick(
            lambda: draw(hexa, pick(32, 40, 64)), lambda: draw(hexa.upper(), pick(32, 40)), lambda: draw(low + up + dig, rng.integers(20, 50)), lambda: draw(low + up + dig + "+/", pick(40, 44, 64)) + pick("", "=", "=="),
            lambda: "AKIA" + draw(up + dig, 16), lambda: "ghp_" + draw(low + up + dig, 36), lambda: "sk_live_" + draw(low + up + dig, 24), lambda: "xoxb-" + draw(dig, 11) + "-" + draw(low + up + dig, 24), lambda: "AIza" + draw(low + up + dig + "_-", 35),
            lambda: "eyJhbGciOiJIUzI1NiJ9." + draw(low + up + dig + "_-", rng.integers(30, 80)) + "." + draw(low + up + dig + "_-", 43), lambda: draw(low + up, rng.integers(20, 40)),
        )()
        bare = value[:4] in ("AKIA", "ghp_", "sk_l", "xoxb", "AIza", "eyJh")
        join = pick(" = \"", "=\"", ": \"", "='", ": ", "=", " ")
        before = prose() + pick("", name + join) if bare else prose() + name + join
        quote = before[-1] if before[-1] in "\"'" else ""
        out.append((before, value, quote + pick("", " ", ",", "\n", "### ", "!! ") + prose(), 1))
        kind = rng.integers(11)
        quote = pick("", "", "\"")
        if kind == 0:
            before, value = prose() + pick("commit ", "sha256:", "md5 ", "hash: ", "checksum=", "digest ", "etag: ", "revision "), draw(hexa, pick(32, 40, 64))
        elif kind == 1:
            h = draw(hexa, 32)
            before, value = prose() + pick("id ", "uuid: ", "", "request "), "-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:]))
        elif kind == 2:
            before, value = prose() + pick("/", "./", "https://a.example/", "src/"), "/".join([word() + draw(dig, rng.integers(0, 3)) for _ in range(4)]) + draw(dig, 2)
        elif kind == 3:
            before, value = prose() + pick("", "key = ", "name: "), "".join(word().title() for _ in range(4)) + draw(dig, rng.integers(1, 4))
        elif kind == 4:
            before, value = prose() + pick("", "card ", "order ", "phone ", "invoice ", "token "), draw(dig, rng.integers(16, 22))
        elif kind == 5:
            before, value = prose() + pick("password = ", "token: ", "api_key=", "secret = "), "_".join(["your", word(), word(), "here"]) + draw(dig, rng.integers(1, 4))
        elif kind == 6:
            before, value = prose() + pick("token = ", "secret: ", ""), pick("x" * 20 + "1", "0" * 24, "1234567890abcdef", "abcdefghijklmnop1234", "0123456789" * 3, "abc123" * 4)
        elif kind == 7:
            before, value = prose(), "".join(draw(low, rng.integers(2, 5)) for _ in range(5)) + draw(dig, rng.integers(1, 3))
        elif kind == 8:  # long words, also after the words that stand before keys
            before, value = prose() + pick("", "", "", "token ", "key "), draw(low, 1).upper() * rng.integers(0, 2) + draw(low, rng.integers(15, 24))
        elif kind == 9:
            before, value = prose() + pick("", "see ", "https://"), ".".join("".join(word() for _ in range(rng.integers(3, 6)))[:30].ljust(16, "a") for _ in range(rng.integers(1, 4)))
        else:
            before, value = prose() + pick("", "version ", "build-"), "-".join([word(), word(), draw(dig, 4), draw(dig, 2), draw(dig, 2), word()])
        out.append((before + quote, value, quote + pick("", " ", ".html ", ",") + prose(), 0))
    return out


def grow_forest(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 3) -> list:
    """Trees of (feature, threshold, left, right) with shares of label 1 as leaves, on bootstrap samples and sqrt(features) at each split."""
    rng = np.random.default_rng(seed)
    tries = max(1, int(np.ceil(np.sqrt(x.shape[1]))))

    def grow(rows: np.ndarray, level: int):
        share = float((y[rows].sum() + 0.5) / (len(rows) + 1))
        if level == depth or len(rows) < 8 or y[rows].min() == y[rows].max():
            return share
        best = None
        for f in rng.choice(x.shape[1], tries, replace=False):
            order = np.argsort(x[rows, f], kind="stable")
            v, t = x[rows[order], f], y[rows[order]]
            cuts = np.flatnonzero(v[1:] > v[:-1]) + 1
            if not len(cuts):
                continue
            ones = np.cumsum(t)[cuts - 1]
            rest, n = t.sum() - ones, len(t)
            impurity = ones * (1 - ones / cuts) + rest * (1 - rest / (n - cuts))
            k = int(np.argmin(impurity))
            if best is None or impurity[k] < best[0]:
                best = (impurity[k], f, float((v[cuts[k]] + v[cuts[k] - 1]) / 2))
        if best is None:
            return share
        left = x[rows, best[1]] <= best[2]
        return (int(best[1]), best[2], grow(rows[left], level + 1), grow(rows[~left], level + 1))

    return [grow(rng.integers(0, len(y), len(y)), 0) for _ in range(trees)] if len(y) else [0.0]


def forest_score(forest: list, values: list[Column]) -> Column:
    """Mean of the trees' shares."""

    def say(tree) -> Column:
        if isinstance(tree, float):
            return F.lit(tree)
        f, threshold, left, right = tree
        return F.when(values[f] <= threshold, say(left)).otherwise(say(right))

    total = say(forest[0])
    for tree in forest[1:]:
        total = total + say(tree)
    return total / len(forest)


def fit(spark: SparkSession, findings: DataFrame | None = None) -> list:
    """A forest from (before, candidate, after, label) rows; without a table, from labelled_findings().

    Of more than LABELLED rows those of the least hashes are taken, so that reruns agree. Rows without a label are left out.
    """
    if findings is None:
        findings = spark.createDataFrame(labelled_findings(), "before string, candidate string, after string, label int")
    named = ["before", "candidate", "after"]
    findings = findings.where("label is not null").orderBy(F.xxhash64(*named), *named, "label")
    rows = findings.limit(LABELLED).select(F.col("label"), F.array(*features(F.col("candidate"), F.col("before"), F.col("after"))).alias("x")).collect()
    return grow_forest(np.array([r["x"] for r in rows], float).reshape(-1, len(FEATURES)), np.array([r["label"] for r in rows], float))


def with_findings(docs: DataFrame, forest: list, at: float = 0.5, text_col: str = "text") -> DataFrame:
    """docs with __parts (the text around candidates) and __found: an array of (candidate, score, secret); null where there is none.

    The columns that are added must not be there yet.
    """
    found = docs.withColumn("__candidates", F.regexp_extract_all(F.col(text_col), F.lit(CANDIDATE), 0))
    some = F.size("__candidates") > 0
    found = found.withColumn("__parts", F.when(some, F.split(F.col(text_col), CANDIDATE)))
    score = lambda x: forest_score(forest, [x["f"][k] for k in range(len(FEATURES))])
    seen = F.transform("__candidates", lambda c, i: F.struct(c.alias("candidate"), F.array(*features(c, F.right(F.col("__parts")[i], F.lit(NEAR)), F.left(F.col("__parts")[i + 1], F.lit(NEAR)))).alias("f")))
    scored = F.transform(seen, lambda x: F.struct(x["candidate"].alias("candidate"), score(x).alias("score")))
    marked = F.transform(scored, lambda x: F.struct(x["candidate"].alias("candidate"), x["score"].alias("score"), (x["score"] >= at).alias("secret")))
    return found.withColumn("__found", F.when(some, marked)).drop("__candidates")


def scan(docs: DataFrame, forest: list | None = None, at: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, finding, length, sha256, score, secret): every candidate of every text, in order, from 0.

    Null and empty texts have none; a repeated row has its findings again; null ids stay null.
    """
    forest = forest or fit(docs.sparkSession)
    rows = with_findings(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), forest, at)
    # A condition on __found, given or inferred from a plain column, would be pushed below what __found is made of, which is
    # then done again, and its texts split for every candidate.
    rows = rows.select("doc_id", F.posexplode(F.coalesce("__found", F.array())).alias("finding", "x"))
    return rows.select("doc_id", "finding", F.length("x.candidate").alias("length"), F.sha2("x.candidate", 256).alias("sha256"), F.col("x.score").alias("score"), F.col("x.secret").alias("secret"))


def redact(docs: DataFrame, forest: list | None = None, at: float = 0.5, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with secrets replaced by ``mark``; no row is dropped, n_chars follows a text that changes, and other columns stay."""
    forest = forest or fit(docs.sparkSession)
    # The columns of docs stand in a struct meanwhile, so their names are free.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text_col).alias("text"))
    found = with_findings(rows, forest, at)
    rest = F.transform("__found", lambda x, i: F.concat(F.when(x["secret"], F.lit(mark)).otherwise(x["candidate"]), F.col("__parts")[i + 1]))
    clean = F.when(F.exists("__found", lambda x: x["secret"]), F.concat(F.col("__parts")[0], F.array_join(rest, "")))
    found = found.select("row", clean.alias("clean"))
    made = {text_col: F.coalesce("clean", f"row.`{text_col}`")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.coalesce(F.length("clean").cast(docs.schema["n_chars"].dataType), F.col("row.n_chars"))
    return found.select(*(made.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Every candidate of documents: see scan for null, empty and repeated texts and null ids; other columns are not read."""
    return scan(table(spark, sf_dir, "documents"))
