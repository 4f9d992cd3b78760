"""Secret scans: candidates by pattern, false positives removed by a random forest.

The forest is trained on labelled findings (value, before, path, label); ``labelled_findings`` makes at most
``LABELLED`` of them by rule, and a caller's own table with the same columns may take its place. All features are
native expressions on the whole candidate, however long: its length, how likely its letters follow one another, the
part of it that dictionary words cover, its path and the words beside it. The dictionary is the ``WORDS_KEPT`` most
frequent words of all texts, counted over the whole table, and the transitions are those of its words; the driver sees
those words alone. Fitting and scoring stay on the JVM; each text is scanned whole, and a finding is a row. A private
key goes on to its END line; one without is its header line.

Null and empty texts have no candidates; null ids and paths are kept; repeated rows repeat their findings; an empty
table gives no findings. Columns of other names play no part.
"""

from __future__ import annotations

import math
import random
import string
from collections import Counter
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from pyspark.ml.classification import RandomForestClassificationModel

LABELLED, TREES, DEPTH, SEED = 3000, 30, 7, 7
#: Words of the dictionary, and their least and greatest length.
WORDS_KEPT, SHORTEST, LONGEST = 2000, 3, 24
KINDS = {
    "aws_key": r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])",
    "github_token": r"gh[pousr]_[A-Za-z0-9]{36,}+",
    "slack_token": r"xox[abprs]-[A-Za-z0-9-]{10,}+",
    "google_key": r"AIza[0-9A-Za-z_-]{35}",
    "stripe_key": r"[rs]k_live_[0-9A-Za-z]{16,}+",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*",
    "private_key": r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:(?:(?!-----[BE])[\s\S])*+-----END [A-Z ]{0,40}PRIVATE KEY-----)?",
    "assignment": r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|credential)[A-Za-z0-9_]{0,32}[\"']?[ \t]{0,8}[:=][ \t]{0,8}[\"']?[^\s\"',;]{6,}+",
    "opaque": r"(?<![A-Za-z0-9+/_=.-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{20,}+={0,2}",
}
PATTERN = "|".join(KINDS.values())
#: Words of names and settings that prose may lack.
WORDS = ("password", "secret", "example", "sample", "token", "test", "user", "admin", "change", "your", "here", "value", "null", "none", "true", "false", "key", "api", "config", "default", "string", "dummy", "fake", "index", "http", "www", "com", "name", "data", "file", "path", "main", "service")
_ALPHABET = "abcdefghijklmnopqrstuvwxyz"
SECRET_WORDS = r"(?i)(password|passwd|pwd|secret|token|key|credential|auth|login|bearer)\W*$|(?i)(password|passwd|secret|token|key|credential)"
DIGEST_WORDS = r"(?i)(sha1|sha256|md5|commit|digest|checksum|hash|uuid|etag|revision|integrity)"
PLACEHOLDER = r"(?i)(example|sample|dummy|changeme|placeholder|your|xxxx|\*\*\*|<|\$\{|test)"
FEATURES = ("f_length", "f_transitions", "f_runs", "f_digits", "f_capitals", "f_distinct", "f_covered", "f_hex", "f_prefix", "f_secret_near", "f_digest_near", "f_placeholder", "f_test_path")


def candidates(documents: DataFrame, path: str = "source") -> DataFrame:
    """Per candidate of documents(doc_id, text, path): doc_id, path, n (from 0), start, length, kind, value, before (40 characters)."""
    hit = documents.select("doc_id", F.col(path).cast("string").alias("path"), "text", F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)).alias("found"))
    hit = hit.where(F.size("found") > 0).withColumn("gaps", F.transform(F.split("text", PATTERN, -1), lambda x: F.length(x)))
    ends = F.aggregate(
        F.arrays_zip("found", F.slice("gaps", 1, F.size("found")).alias("gap")),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda acc, x: F.struct((acc["at"] + x["gap"] + F.length(x["found"])).alias("at"), F.concat(acc["starts"], F.array(acc["at"] + x["gap"])).alias("starts")),
        lambda acc: acc["starts"],
    )
    rows = hit.withColumn("starts", ends).select("doc_id", "path", "text", F.posexplode(F.arrays_zip("found", "starts")).alias("n", "x"))
    rows = rows.select("doc_id", "path", F.col("n").cast("bigint").alias("n"), F.col("x.starts").cast("bigint").alias("start"), F.length("x.found").cast("bigint").alias("length"), F.col("x.found").alias("match"), F.substring("text", F.greatest(F.col("x.starts") - 39, F.lit(1)), F.least(F.col("x.starts"), F.lit(40))).alias("before"))
    kind = F.lit("opaque")
    for name, pattern in reversed([x for x in KINDS.items() if x[0] != "opaque"]):
        kind = F.when(F.col("match").rlike(f"^(?:{pattern})$"), name).otherwise(kind)
    rows = rows.withColumn("kind", kind)
    value = F.when(F.col("kind") == "assignment", F.regexp_extract("match", r"^[^:=]*[:=][ \t]*[\"']?(.*)$", 1)).otherwise(F.col("match"))
    named = F.when(F.col("kind") == "assignment", F.concat("before", F.regexp_extract("match", r"^([^:=]*[:=])", 1))).otherwise(F.col("before"))
    return rows.select("doc_id", "path", "n", "start", "length", "kind", value.alias("value"), named.alias("before"))


def dictionary(documents: DataFrame, kept: int = WORDS_KEPT) -> list[tuple[str, int]]:
    """The most frequent lower-case words of all texts with their counts, at most ``kept``, and WORDS once each."""
    words = documents.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(rf"(?<![\w-])[a-z]{{{SHORTEST},{LONGEST}}}(?![\w-])"), F.lit(0))).alias("word"))
    top = words.groupBy("word").count().orderBy(F.desc("count"), "word").limit(kept)
    found = Counter({r.word: r["count"] for r in top.toLocalIterator()})
    found.update(WORDS)
    return sorted(found.items())


def transitions(words: list[tuple[str, int]]) -> list[float]:
    """Log probability of each letter after each other, with additive smoothing, row by row of the alphabet; a word's count weighs by its logarithm."""
    n = len(_ALPHABET)
    counts = [[0.5] * n for _ in range(n)]
    for word, times in words:
        for a, b in zip(word, word[1:]):
            counts[_ALPHABET.index(a)][_ALPHABET.index(b)] += 1 + math.log(times)
    return [math.log(x / sum(row)) for row in counts for x in row]


def features(findings: DataFrame, words: list[tuple[str, int]]) -> DataFrame:
    """Adds the FEATURES of findings(value, before, path)."""
    value, before, path = (F.coalesce(F.col(c), F.lit("")) for c in ("value", "before", "path"))
    size = F.greatest(F.length(value), F.lit(1))
    share = lambda c: (c / size).cast("double")
    removed = lambda c, pattern: F.length(c) - F.length(F.regexp_replace(c, pattern, ""))
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]", "a"), "[A-Z]", "B"), "[0-9]", "1"), "[^aB1]", "-")
    yes = lambda c: c.cast("double")
    # places of letters in the alphabet, 0 for anything else; what isn't a pair of letters is as unlikely as the rarest pair
    table = transitions(words)
    likely = F.array(*[F.lit(x) for x in table])
    places = F.transform(F.split(F.lower(value), ""), lambda c: F.when(c == "", 0).otherwise(F.instr(F.lit(_ALPHABET), c)))
    pair = lambda a, b: F.when((a > 0) & (b > 0), F.get(likely, (a - 1) * len(_ALPHABET) + b - 1)).otherwise(F.lit(min(table)))
    steps = F.zip_with(F.slice(places, 1, F.greatest(F.size(places) - 1, F.lit(0))), F.slice(places, 2, F.size(places)), pair)
    known = "|".join(sorted((w for w, _ in words), key=lambda w: (-len(w), w)))
    return findings.withColumns({
        "f_length": F.log1p(F.length(value).cast("double")),
        "f_transitions": F.aggregate(steps, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(steps), F.lit(1)),
        "f_runs": share(F.length(F.regexp_replace(kinds, r"(.)\1*", "x"))),
        "f_digits": share(removed(value, "[0-9]")),
        "f_capitals": share(removed(value, "[A-Z]")),
        "f_distinct": share(F.size(F.array_distinct(F.split(value, "")))),
        "f_covered": share(removed(F.lower(value), f"(?:{known})")),
        "f_hex": yes(value.rlike("^[0-9a-f]+$|^[0-9A-F]+$")),
        "f_prefix": yes(value.rlike(r"^(AKIA|gh[pousr]_|xox[abprs]-|AIza|[rs]k_live_|eyJ|-----BEGIN)")),
        "f_secret_near": yes(before.rlike(SECRET_WORDS)),
        "f_digest_near": yes(before.rlike(DIGEST_WORDS)),
        "f_placeholder": yes(value.rlike(PLACEHOLDER)),
        "f_test_path": yes(path.rlike(r"(?i)(^|[/._-])(test|tests|example|examples|docs|fixture|fixtures|mock)([/._-]|$)")),
    })


def labelled_findings(spark: SparkSession, n: int = LABELLED, seed: int = SEED) -> DataFrame:
    """(value, before, path, label) of n findings made by rule: secrets of the known forms, and what is often taken for one."""
    rng = random.Random(seed)
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    syllable = lambda: rng.choice(("the", "on", "er", "and", "ing", "tion", "re", "st", "ou", "le", "de", "que", "en", "ver", "ich"))
    word = lambda: "".join(syllable() for _ in range(rng.randint(1, 3)))
    alnum, hexa, upper = string.ascii_letters + string.digits, "0123456789abcdef", string.ascii_uppercase + string.digits
    names = ("password", "token", "secret", "api_key", "access_key", "db_password", "auth_token")
    own = random.Random(seed + 1)
    # half of the private keys are whole, the others without an END line; drawn apart, so that the other findings stay the same
    body = lambda: own.choice(("", "\n" + "\n".join("".join(own.choice(alnum + "+/") for _ in range(64)) for _ in range(own.randint(3, 25))) + "\n-----END RSA PRIVATE KEY-----"))
    lead = lambda: f"{word()} {word()} "
    named = lambda: f"{lead()}{rng.choice(names)}{rng.choice(('=', ': ', ' = '))}"
    real = [
        lambda: ("AKIA" + pick(upper, 16), rng.choice((lead, named))()),
        lambda: (rng.choice(("ghp_", "gho_")) + pick(alnum, 36), rng.choice((lead, named))()),
        lambda: ("sk_live_" + pick(alnum, 24), rng.choice((lead, named))()),
        lambda: ("xoxb-" + pick(string.digits, 11) + "-" + pick(alnum, 24), lead()),
        lambda: ("-----BEGIN RSA PRIVATE KEY-----" + body(), lead()),
        lambda: (pick(hexa, rng.choice((16, 18, 24, 32, 40, 64))), named()),
        lambda: (pick(alnum, rng.randint(12, 44)), named()),
        lambda: (pick(alnum + "+/", rng.randint(24, 60)), named()),
        lambda: (pick(alnum + "!@#%^", rng.randint(10, 20)), named()),
    ]
    false = [
        lambda: (pick(hexa, rng.choice((32, 40, 64))), f"{lead()}{rng.choice(('commit ', 'sha256:', 'md5 ', 'checksum ', 'digest ', 'revision '))}"),
        lambda: ("-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)), f"{lead()}uuid "),
        lambda: (rng.choice(("your", "my", "example", "test", "sample", "dummy")) + rng.choice("-_") + rng.choice(("password", "token", "key-here", "secret")), named()),
        lambda: (rng.choice(("xxxxxxxxxxxx", "****************", "changeme", "<password>", "${TOKEN}", "placeholder", "password", "undefined", "required", "process.env.TOKEN")), named()),
        lambda: ("/".join(word() for _ in range(rng.randint(3, 6))) + str(rng.randint(1, 99)), lead()),
        lambda: ("_".join(word() for _ in range(rng.randint(3, 6))) + "_" + str(rng.randint(1, 99)), lead()),
        lambda: ("".join(word().title() for _ in range(4)) + str(rng.randint(1, 9)), lead()),
        lambda: (pick(string.digits, rng.randint(20, 30)), lead()),
        lambda: (word() + word(), named()),
    ]
    rows = []
    for i in range(n):
        label = i % 2
        value, before = rng.choice(real if label else false)()
        test = rng.random() < (0.1 if label else 0.4)
        rows.append((value, before[-60:], rng.choice(("src/tests/app", "docs/example")) if test else rng.choice(("src/main", "app", "src3", "web")), float(label)))
    return spark.createDataFrame(rows, "value string, before string, path string, label double")


def _vectors(findings: DataFrame, words: list[tuple[str, int]]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(features(findings, words))


class Scanner:
    """A forest with the dictionary that its features were made from."""

    def __init__(self, labelled: DataFrame, words: list[tuple[str, int]], trees: int = TREES, depth: int = DEPTH, seed: int = SEED):
        from pyspark.ml.classification import RandomForestClassifier

        self.words = words
        self.forest: RandomForestClassificationModel = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(_vectors(labelled, words))

    def scored(self, findings: DataFrame, threshold: float = 0.5) -> DataFrame:
        """Findings with score, the forest's share of votes for a secret, and is_secret."""
        from pyspark.ml.functions import vector_to_array

        score: Column = vector_to_array("probability")[1]
        out = self.forest.transform(_vectors(findings, self.words)).withColumn("score", score)
        return out.select(*findings.columns, "score", (F.col("score") >= threshold).alias("is_secret"))


def scan(documents: DataFrame, scanner: Scanner | None = None, path: str = "source", labelled: DataFrame | None = None) -> DataFrame:
    """Every candidate of every whole text with its score and verdict; without a scanner, one is trained on the documents' own dictionary."""
    if scanner is None:
        scanner = Scanner(labelled_findings(documents.sparkSession) if labelled is None else labelled, dictionary(documents))
    return scanner.scored(candidates(documents, path))
