"""Secret scans with a random forest that removes false positives.

Candidates are long runs of key characters, found by one pattern over whole texts together with the word
before them. Each is described by its length, the transitions between classes of characters, the share of
it that a dictionary covers, its path and its neighbouring words, and judged by a random forest trained
from labelled findings. All of it is DataFrame operations; the forest is Spark's own.

Labelled findings can be given as a table (candidate, before, path, label). Without one they are made by
rule, from a seeded hash: keys of known shapes as positives, most of them after a word that tells of a
secret; placeholders, repeated characters, words run together, file names, counters, encoded data, and, as
hard negatives of the same shapes as keys, commits, checksums and identifiers after words that tell of these.

Defined results: null and empty texts have no candidates; texts of any length are scanned whole; each place
is a finding of its own, repeats included; a null path is the empty path; an empty table gives an empty
table; other columns are ignored, whatever their names. Candidates are returned as digests.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import text_or_empty

KEY, NAME, PARTS = r"[A-Za-z0-9_+/\-]", r"[A-Za-z0-9_\-]", r"\s\"'=:(,`\[\]<>{}|;"
#: A run of key characters from its start on; "=" is padding at its end. The letter of an escaped line end is none of it. Directly after NAME= shorter runs count, too.
START = rf"(?:(?<![A-Za-z0-9_+/\-\\])|(?<=\\[nrt])|(?<=\\)(?![nrt]))(?={KEY}{{20}}|(?<={NAME}=){KEY}{{8}})"
#: The word before and what parts them, looked up and not consumed, so that it may be a candidate itself; and the candidate.
BEFORE = rf"(?:(?<=((?<!{NAME}){NAME}{{1,60}}[{PARTS}\\]{{0,8}}(?:\\[nrt])?|(?<![A-Za-z0-9_\-{PARTS}\\])[{PARTS}\\]{{0,8}}(?:\\[nrt])?)))?"
FINDING = rf"{START}{BEFORE}({KEY}{{8,}}+(?:={{1,2}}(?![A-Za-z0-9_+/=\-]))?)"
#: Words that stand before secrets, and in paths of samples.
TELLING = ["token", "secret", "password", "passwd", "apikey", "api_key", "key", "auth", "credential", "bearer", "private"]
#: Words that stand before commits, checksums and identifiers.
HARMLESS = ["commit", "revision", "sha", "sha1", "sha256", "md5", "checksum", "digest", "hash", "etag", "uuid", "build", "fingerprint", "integrity"]
SAMPLES = ["test", "example", "sample", "fixture", "mock", "doc"]
#: Common words by which dictionary coverage is counted.
DICTIONARY = (
    "the and for with from that this have are was not you all can her his one our out use your more new will their what when which about there first "
    "file name path user data test value type code line list page time work year world people hand part place number point home water room example "
    "string index config build version release update install package module class function return public static error message request response "
    "change sample token secret password key here insert replace placeholder dummy none null todo xxxx 0000 1234 abcd"
).split()
FEATURES = ["length", "digits", "uppers", "lowers", "marks", "letter_digit", "digit_letter", "case_change", "longest_lower", "hex_only", "distinct", "coverage", "uuid", "harmless", "telling", "assigned", "quoted", "path_sample", "before_length"]


def described(rows: DataFrame) -> DataFrame:
    """Adds the features to rows of candidate, before, path."""
    c, word = F.col("candidate"), F.lower("before")
    count = lambda pattern, of=c: F.regexp_count(of, F.lit(pattern)).cast("double")
    length = F.length(c).cast("double")
    any_of = lambda words, of: of.rlike("|".join(words)).cast("double")
    left = F.length(F.regexp_replace(F.lower(c), "|".join(sorted(DICTIONARY, key=len, reverse=True)), ""))
    runs = F.split(c, "[^a-z]+")
    return rows.withColumns({
        "length": length,
        "digits": count("[0-9]") / length,
        "uppers": count("[A-Z]") / length,
        "lowers": count("[a-z]") / length,
        "marks": count("[^A-Za-z0-9]") / length,
        "letter_digit": count("[A-Za-z](?=[0-9])") / length,
        "digit_letter": count("[0-9](?=[A-Za-z])") / length,
        "case_change": count("[a-z](?=[A-Z])|[A-Z](?=[a-z])") / length,
        "longest_lower": F.array_max(F.transform(runs, F.length)).cast("double") / length,
        "hex_only": c.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$").cast("double"),
        "distinct": F.size(F.array_distinct(F.split(c, ""))).cast("double") / F.least(length, F.lit(40.0)),
        "coverage": 1 - left / length,
        "uuid": c.rlike("^[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$").cast("double"),
        "harmless": any_of(HARMLESS, word),
        "telling": any_of(TELLING, word),
        "assigned": F.col("before").rlike("[=:]").cast("double"),
        "quoted": F.col("before").rlike("[\"']").cast("double"),
        "path_sample": any_of(SAMPLES, F.lower(F.coalesce("path", F.lit("")))),
        "before_length": F.length(F.regexp_extract("before", r"^[A-Za-z0-9_\-]*", 0)).cast("double"),
    })


def made_findings(spark: SparkSession, rows: int = 8000, seed: int = 11) -> DataFrame:
    """Labelled findings by rule: half secrets, half not; a third of those that are not have the shape of keys."""
    salt = lambda n: F.concat_ws("-", F.lit(str(seed)), F.lit(str(n)), "id")
    hexes, base = F.sha2(salt(1), 256), F.translate(F.base64(F.unhex(F.sha2(salt(2), 256))), "+/=", "-_")
    pick = lambda words, n: F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.xxhash64(salt(n)), F.lit(len(words))) + 1).cast("int"))
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.element_at(F.array(*map(F.lit, DICTIONARY)), (F.pmod(F.xxhash64(salt(3), i), F.lit(len(DICTIONARY))) + 1).cast("int"))), "")
    syllables = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(11)), lambda i: F.element_at(F.array(*map(F.lit, ["an", "er", "en", "ti", "ou", "mente", "ing", "lo", "sch", "que", "ra", "do"])), (F.pmod(F.xxhash64(salt(4), i), F.lit(12)) + 1).cast("int"))), "")
    kind, hard = F.pmod(F.xxhash64(salt(5)), F.lit(6)), F.pmod(F.xxhash64(salt(20)), F.lit(3)) == 0
    shape = F.pmod(F.xxhash64(salt(21)), F.lit(5))
    uuid = F.concat_ws("-", *[F.substring(hexes, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    alike = F.when(shape == 0, F.substring(hexes, 1, 40)).when(shape == 1, F.substring(hexes, 1, 32)).when(shape == 2, hexes).when(shape == 3, uuid).otherwise(F.base64(F.unhex(hexes)))
    secret = F.when(kind == 0, F.substring(hexes, 1, 40)).when(kind == 1, F.upper(F.substring(hexes, 1, 40))).when(kind == 2, F.concat(F.lit("AKIA"), F.upper(F.translate(F.substring(base, 1, 20), "-_", "XY")))).when(kind == 3, F.concat(F.lit("ghp_"), F.substring(F.translate(base, "-_", "ab"), 1, 36))).when(kind == 4, F.substring(hexes, 1, 32)).otherwise(F.substring(base, 1, 40))
    other = F.when(kind == 0, syllables).when(kind == 1, words).when(kind == 2, F.repeat(pick(["x", "0", "-", "=", "ab", "_"], 6), 24)).when(kind == 3, F.concat(words, F.lit("_"), F.substring(F.translate(hexes, "abcdef", "012345"), 1, 3))).when(kind == 4, F.substring(F.translate(hexes, "abcdef", "012345"), 1, 24)).otherwise(F.concat(F.lit("your_"), pick(["token", "secret", "api_key", "password"], 7), F.lit("_goes_here")))
    label = (F.col("id") % 2).cast("double")
    telling = F.concat(pick([*TELLING[:9], "TOKEN", "Secret"], 8), pick([" = \"", "=", ": ", ":\"", "='"], 9))
    plain = F.concat(pick(["the", "and", "of", "", "commit", "digest", "see", "id", "name", "file"], 10), pick([" ", " \"", ": ", ", "], 11))
    before = F.when((label == 1) & (F.pmod(F.xxhash64(salt(12)), F.lit(10)) < 8), telling).when((label == 0) & (F.pmod(F.xxhash64(salt(12)), F.lit(10)) < 3), telling).otherwise(plain)
    of_these = F.concat(pick(HARMLESS, 22), pick([" ", ": ", "=", " = \"", ":"], 23))
    hard = hard & (label == 0)
    before = F.when(hard, of_these).otherwise(before)
    path = F.when((label == 0) & (F.pmod(F.xxhash64(salt(13)), F.lit(4)) == 0), pick(["tests/fixture", "docs/example", "sample"], 14)).otherwise(pick(["src/app", "config", "src0", "src7", "deploy"], 15))
    return spark.range(rows).select(F.when(label == 1, secret).when(hard, alike).otherwise(other).alias("candidate"), before.alias("before"), path.alias("path"), label.alias("label"))


def train_forest(labelled: DataFrame, trees: int = 25, depth: int = 7, seed: int = 11) -> RandomForestClassificationModel:
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(described(labelled)).select("features", "label")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(rows)


def candidates(docs: DataFrame, path: Column | None = None) -> DataFrame:
    """doc_id, nth, candidate, before, path for every candidate of every text."""
    text = F.concat(F.lit(" "), text_or_empty())
    found = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(FINDING), F.lit(i)).alias(x) for i, x in ((1, "before"), (2, "candidate"))])
    rows = docs.select("doc_id", (F.col("source").cast("string") if path is None else path).alias("path"), F.posexplode(found).alias("nth", "found"))
    return rows.select("doc_id", "nth", F.col("found")["candidate"].alias("candidate"), F.col("found")["before"].alias("before"), F.coalesce("path", F.lit("")).alias("path"))


def judged(rows: DataFrame, forest: RandomForestClassificationModel) -> DataFrame:
    """Rows of candidate, before, path with their score."""
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(described(rows))
    return forest.transform(rows).withColumn("score", vector_to_array(F.col("probability"))[1])


def scan_secrets(docs: DataFrame, labelled: DataFrame | None = None, accept: float = 0.5, path: Column | None = None) -> DataFrame:
    """doc_id, nth, length, candidate_sha256, score, secret for every candidate."""
    forest = train_forest(made_findings(docs.sparkSession) if labelled is None else labelled)
    rows = judged(candidates(docs, path), forest)
    return rows.select("doc_id", F.col("nth").cast("long").alias("nth"), F.col("length").cast("long").alias("length"), F.sha2(F.col("candidate").cast("binary"), 256).alias("candidate_sha256"), "score", (F.col("score") >= accept).alias("secret"))
