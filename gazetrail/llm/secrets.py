"""Secrets in texts: candidates by rules, false positives removed by a random forest.

All of it is DataFrame expressions and Spark ML, inside the JVM.  A text is cut at ASCII white space; a word is a
candidate if it has a provider's form, follows an assignment to a telling name, or is a long
mixture of letters and digits.  A word has a candidate for every place where a rule matches, matches within others too; the
same value at the same place counts once, under the first rule.  Each candidate becomes numbers: length, shares of character
classes, transitions between them, distinct characters, cover by dictionary words, what the
path says and what the neighbouring words say.  A random forest trained from labelled findings
gives the probability that it is a secret.  Private-key blocks need no forest.

Labelled findings are a table (value, before2, before, after, path, label); `sample_findings` makes one
from hashes of numbers where there is none.  Null and empty texts have no candidates; a null path is
empty; repeated rows have each their own findings; start is the finding's own place in its text.  An empty table gives
no findings.  A long text is cut into its words and never grows beyond its findings.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazetrail.llm import sieve, storage

NAMES = "passw(?:or)?d|passwd|pwd|secret|token|api_?key|access_?key|auth_?key|private_?key|credential"
RULES = [
    ("aws_key", r"(AKIA[0-9A-Z]{16})(?![0-9A-Za-z])"),
    ("github_token", r"(gh[pousr]_[A-Za-z0-9]{20,})"),
    ("slack_token", r"(xox[abprs]-[A-Za-z0-9-]{10,})"),
    ("google_key", r"(AIza[0-9A-Za-z_-]{35})"),
    ("jwt", r"(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*)"),
    ("assigned", rf"(?i:{NAMES})[A-Za-z0-9_.-]*[\"']?[=:]+[\"']?([^\s\"'<>,;]{{6,}}?)(?=[\"'<>,;]|[^A-Za-z0-9]*$)"),
]
#: A value within a query string; it may also end at the whole word's end.
PARAMETER = rf"(?i:{NAMES})[A-Za-z0-9_.-]*=([^\s\"'<>,;&]{{6,}})(?=&[A-Za-z0-9_.-]+=)"
#: group 1 is what stands before the value, group 2 the value
AFTER_NAME = r"^([\"'(]*)([^\s\"'<>,;]{6,}?)(?:[\"'<>,;].*|[^A-Za-z0-9]*)$"
GENERIC = r"^([\"'(]*)((?=[^0-9]*[0-9][^0-9]*[0-9][^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])[A-Za-z0-9+/_-]{20,}={0,2})[^A-Za-z0-9+/=_-]*$"
SPACE = r"[\x20\x09-\x0D]+"
PLACES = "array<struct<off: int, value: string, rule: string, within: boolean>>"
#: A text without any of these has no candidate.
HINT = rf"AKIA|gh[pousr]_|xox[abprs]-|AIza|eyJ|(?i:{NAMES})|[A-Za-z0-9+/_-]{{20}}"
KEY_BLOCK = r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----[\s\S]*?-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
DICTIONARY = "example|sample|changeme|change|placeholder|your|dummy|fake|test|demo|default|password|passwd|secret|token|user|admin|root|access|public|private|key|name|value|string|null|none|true|false|here|insert|replace|todo|xxxx|abcd|1234|qwerty|config|server|client|service|local|host|file|path|data|base|version|release|build|commit|session|index|table|column|module|class|function|return|import|the|and|ing|tion|ment|able"
SHAM = r"(?i)example|sample|dummy|fake|placeholder|test|redacted|fixture|mock"
OTHER = r"(?i)^[\"'(]*(?:commit|sha1|sha256|md5|checksum|digest|revision|version|uuid|guid|id|hash|etag|branch|file|url)[=:]*$"
FEATURES = ["length", "digits", "uppers", "lowers", "signs", "changes", "vowels", "distinct", "words", "hex", "sham_path", "named", "sham_near", "other_near", "provider"]


def _path(docs: DataFrame) -> Column:
    return F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")


def _key(docs: DataFrame) -> Column:
    """128 bits of a row's text and path: rows that share them, and the doc_id, have the same findings."""
    text = F.col("text").cast("string")
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit("path"), _path(docs), text).alias("b"))


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, path, key, rule, value, start, word, before2, before, after) for each candidate in `docs` (doc_id, text[, source])."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _path(docs).alias("path"), _key(docs).alias("key"), F.col("text").cast("string").alias("text"))
    rows = rows.filter(F.col("text").rlike(HINT)).withColumn("w", F.split("text", SPACE))
    named = rf"(?i)(?:{NAMES})[A-Za-z0-9_.-]*[\"']?$"

    def follows(w: Column, i: Column) -> Column:
        one, two = F.get(F.col("w"), i - 1), F.get(F.col("w"), i - 2)
        return F.coalesce(one.rlike(rf"(?i)(?:{NAMES})[A-Za-z0-9_.-]*[\"']?[=:]+$") | (one.rlike("^[=:]+$") & two.rlike(named)), F.lit(False)) & w.rlike(AFTER_NAME)

    every = F.transform("w", lambda w, i: F.struct(i.alias("i"), w.alias("w")))
    marked = "|".join(f"(?:{p})" for _, p in RULES)
    hits = F.filter(every, lambda x: (F.length(x.w) >= 6) & (x.w.rlike(marked) | x.w.rlike(GENERIC) | follows(x.w, x.i)))
    # arrays of one row are exploded: the optimizer would else repeat their expressions for each word
    rows = rows.select("doc_id", "path", "key", F.explode(F.array(F.struct("text", "w", hits.alias("hits")))).alias("c")).filter(F.size("c.hits") > 0)
    sizes = F.zip_with("c.w", F.regexp_extract_all("c.text", F.lit(SPACE), F.lit(0)), lambda x, y: F.length(x) + F.coalesce(F.length(y), F.lit(0)))
    rows = rows.select("doc_id", "path", "key", F.explode(F.array(F.struct("c.w", "c.hits", sizes.alias("sizes")))).alias("c")).select("doc_id", "path", "key", "c.*")
    # the first character of each hit, carried from hit to hit
    none = F.struct(F.lit(0).alias("i"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))

    def step(state: Column, x: Column) -> Column:
        at = F.aggregate(F.slice("sizes", state.i + 1, x.i - state.i), state.at, lambda n, k: n + k)
        return F.struct(x.i.alias("i"), at.alias("at"), F.array_append(state.all, at).alias("all"))

    found = F.zip_with("hits", F.aggregate("hits", none, step)["all"], lambda x, at: F.struct(x.i.alias("word"), x.w.alias("w"), at.alias("at"), F.coalesce(F.get(F.col("w"), x.i - 2), F.lit("")).alias("before2"), F.coalesce(F.get(F.col("w"), x.i - 1), F.lit("")).alias("before"), F.coalesce(F.get(F.col("w"), x.i + 1), F.lit("")).alias("after"), follows(x.w, x.i).alias("follows")))
    out = rows.select("doc_id", "path", "key", F.explode(found).alias("c")).select("doc_id", "path", "key", "c.*")
    every = F.concat(*(_places("w", n, p) for n, p in [*RULES, ("assigned", PARAMETER)]), _whole("w", "assigned", AFTER_NAME, F.col("follows")), _whole("w", "generic", GENERIC, F.lit(True)))
    out = out.select("*", F.explode(F.array(F.struct(every.alias("every")))).alias("e")).select("*", "e.every")
    once = F.filter("every", lambda x, k: ~F.exists(F.slice("every", F.lit(1), k), lambda y: (y.off == x.off) & (y.value == x.value)))
    out = out.withColumn("f", F.explode(once)).select("*", "f.*")
    # a name within the candidate's own word is its neighbour
    own = F.regexp_extract(F.expr("substring(w, 1, off)"), r"([^,;&?<>{}()]*[=:])[^=:]*$", 1)
    out = out.withColumn("before", F.when((F.col("rule") == "assigned") & F.col("within"), own).otherwise(F.col("before")))
    return out.select("doc_id", "path", "key", "rule", "value", (F.col("at") + F.col("off")).cast("long").alias("start"), F.col("word").cast("long").alias("word"), "before2", "before", "after")


def _places(w: str, rule: str, pattern: str) -> Column:
    """(off, value, rule, within) of every match of `pattern`, whose one group ends it; matches may overlap."""
    ahead, text = f"(?=({pattern}))", F.concat(F.lit(" "), w)  # no match is at the start, so each ends a piece
    full, value = (F.regexp_extract_all(text, F.lit(ahead), F.lit(k)) for k in (1, 2))
    matches = F.zip_with(F.zip_with(full, value, lambda x, v: F.struct(x.alias("x"), v.alias("v"))), F.split(text, ahead, -1), lambda m, piece: F.struct(m.x.alias("x"), m.v.alias("v"), piece.alias("piece")))

    def step(state: Column, m: Column) -> Column:
        at = state.at + F.length(m.piece)
        one = F.struct((at + F.length(m.x) - F.length(m.v)).alias("off"), m.v.alias("value"), F.lit(rule).alias("rule"), F.lit(True).alias("within"))
        return F.struct(at.alias("at"), F.when(m.v.isNull(), state.all).otherwise(F.array_append(state.all, one)).alias("all"))

    every = F.aggregate(matches, F.struct(F.lit(-1).alias("at"), F.array().cast(PLACES).alias("all")), step)["all"]
    return F.when(F.col(w).rlike(pattern), every).otherwise(F.array().cast(PLACES))


def _whole(w: str, rule: str, pattern: str, where: Column) -> Column:
    """The same for a pattern of the whole word."""
    one = F.struct(F.length(F.regexp_extract(w, pattern, 1)).alias("off"), F.regexp_extract(w, pattern, 2).alias("value"), F.lit(rule).alias("rule"), F.lit(False).alias("within"))
    return F.when(where & F.col(w).rlike(pattern), F.array(one)).otherwise(F.array().cast(PLACES))


def key_blocks(docs: DataFrame) -> DataFrame:
    """The private-key blocks of `docs`, in the form of findings, each at its own place."""
    rows = docs.filter(F.col("text").rlike("PRIVATE KEY(?: BLOCK)?-----"))
    blocks = F.regexp_extract_all("text", F.lit(KEY_BLOCK), F.lit(0))
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), _key(docs).alias("key"), blocks.alias("blocks"), F.split("text", KEY_BLOCK, -1).alias("rest"))
    before = lambda i: F.aggregate(F.zip_with(F.slice("rest", 1, i + 1), F.slice("blocks", 1, i), lambda r, b: F.length(r) + F.coalesce(F.length(b), F.lit(0))), F.lit(0), lambda n, k: n + k)
    found = rows.select("doc_id", "key", F.explode(F.transform("blocks", lambda v, i: F.struct(v.alias("value"), before(i).cast("long").alias("start")))).alias("f"))
    return found.select("doc_id", "key", F.lit("private_key").alias("rule"), "f.value", "f.start", F.lit(1.0).alias("probability"))


def numbers(rows: DataFrame) -> DataFrame:
    """`rows` (value, before2, before, after, path, ...) with the FEATURES."""
    v, n = F.col("value"), F.greatest(F.length("value"), F.lit(1))
    count = lambda p: F.regexp_count("value", F.lit(p)) / n
    near = F.concat_ws(" ", "before2", "before", "after")
    return rows.withColumns({
        "length": F.length(v).cast("double"),
        "digits": count("[0-9]"),
        "uppers": count("[A-Z]"),
        "lowers": count("[a-z]"),
        "signs": count("[^A-Za-z0-9]"),
        "changes": count("(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])"),
        "vowels": count("(?i)[bcdfghjklmnpqrstvwxz][aeiouy]"),
        "distinct": F.size(F.array_distinct(F.split("value", ""))) / n,
        "words": 1 - F.length(F.regexp_replace(F.lower(v), DICTIONARY, "")) / n,
        "hex": v.rlike("^[0-9a-f]+$").cast("double"),
        "sham_path": F.coalesce(F.col("path").rlike(SHAM), F.lit(False)).cast("double"),
        "named": near.rlike(f"(?i){NAMES}").cast("double"),
        "sham_near": near.rlike(SHAM).cast("double"),
        "other_near": (F.col("before").rlike(OTHER) | F.col("before2").rlike(OTHER)).cast("double"),
        "provider": F.coalesce(v.rlike("|".join(f"^(?:{p})" for _, p in RULES[:5])), F.lit(False)).cast("double"),
    })


def sample_findings(spark: SparkSession, n: int = 6000) -> DataFrame:
    """Labelled findings made from hashes: random keys in their usual places, and what looks like them."""
    r = spark.range(0, n, 1, 2).select("id", F.sha2(F.concat(F.lit("s"), F.col("id")), 512).alias("h"), F.md5(F.col("id").cast("string").cast("binary")).alias("m"))
    pick = lambda salt, *xs: F.get(F.array(*(F.lit(x) for x in xs)), F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(xs))).cast("int"))
    size = lambda salt, a, b: (F.lit(a) + F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(b - a + 1))).cast("int")
    hexes = lambda a, b: F.substr(F.col("h"), F.lit(1), size("n", a, b))
    b64 = F.regexp_replace(F.base64(F.unhex("h")), "[/+=\\s]", "x")
    word = pick("w", "the", "of", "and", "la", "der", "is", "value", "with", "x", "this")
    noun = pick("n1", "user", "service", "config", "release", "session", "index", "table", "module", "server", "client")
    upper = F.translate(F.upper(F.substr(b64, F.lit(1), F.lit(16))), "189", "234")
    name = pick("k", "password", "token", "secret", "api_key", "access_key", "pwd")
    kinds = [
        # value, word before the last, last word before, label
        (F.concat(F.lit("AKIA"), upper), word, word, 1),
        (hexes(16, 24), word, F.concat(name, F.lit("=")), 1),
        (hexes(32, 40), name, F.lit("="), 1),
        (F.substr(b64, F.lit(1), size("n", 20, 44)), name, pick("e", "=", ":"), 1),
        (F.concat(pick("p", "ghp_", "gho_", "xoxb-", "AIza"), F.substr(b64, F.lit(1), F.lit(36))), word, word, 1),
        (F.substr(b64, F.lit(1), size("n", 10, 16)), word, F.concat(name, pick("e", "=", ":")), 1),
        (F.concat(F.substr(b64, F.lit(1), size("n", 28, 48)), F.lit("A1b2")), word, word, 1),
        (pick("d", "changeme", "password", "your-token-here", "example", "xxxxxxxx", "placeholder", "<secret>", "${TOKEN}", "$(get-secret)", "os.environ", "replace_me", "test1234", "12345678", "qwerty123", "getpass()"), word, F.concat(name, pick("e", "=", ":")), 0),
        (F.concat(F.lit("AKIA"), pick("d", "IOSFODNN7EXAMPLE", "XXXXXXXXXXXXXXXX", "EXAMPLEEXAMPLE12", "0000000000000000", "TESTTESTTEST1234")), word, word, 0),
        (F.concat(noun, F.lit("_"), pick("n2", "name", "version", "file", "path", "data", "build"), F.lit("_"), noun, pick("n3", "_v1_2_3", "_2024_01_02", "-0001-0002", "_100_200_300")), word, word, 0),
        (hexes(40, 40), word, pick("o", "commit", "revision", "sha1:", "branch"), 0),
        (hexes(32, 64), word, pick("o", "checksum", "sha256:", "md5:", "digest", "etag"), 0),
        (F.concat(F.substr("m", F.lit(1), F.lit(8)), F.lit("-"), F.substr("m", F.lit(9), F.lit(4)), F.lit("-4"), F.substr("m", F.lit(13), F.lit(3)), F.lit("-a"), F.substr("m", F.lit(16), F.lit(3)), F.lit("-"), F.substr("m", F.lit(19), F.lit(12))), word, pick("o", "id", "uuid", "id:", "session"), 0),
        (F.concat(noun, pick("n4", "Service", "Config", "Table"), noun, pick("n5", "Release2024", "Version123", "Build000")), word, word, 0),
        (hexes(16, 40), pick("x", "example", "sample", "dummy"), F.concat(name, pick("e", "=", ":")), 0),
    ]
    forms = F.array(*(F.struct(a.alias("value"), b.alias("before2"), c.alias("before"), F.lit(float(y)).alias("label")) for a, b, c, y in kinds))
    path = F.when(F.col("f.label") == 1, F.lit("")).otherwise(pick("path", "", "", "docs/example.md", "tests/fixture.py"))
    return r.select("*", F.get(forms, (F.col("id") % len(kinds)).cast("int")).alias("f")).select("f.value", "f.before2", "f.before", word.alias("after"), path.alias("path"), "f.label")


def train(findings: DataFrame, trees: int = 24, depth: int = 8, seed: int = 7) -> RandomForestClassificationModel:
    """A forest from labelled findings (value, before2, before, after, path, label 0 or 1)."""
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(numbers(findings.filter("label in (0, 1) and value is not null")))
    rows = rows.select("features", "label").persist()
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(rows)
    rows.unpersist()
    return model


def judged(found: DataFrame, model: RandomForestClassificationModel) -> DataFrame:
    """Candidates with the probability that each is a secret."""
    rows = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(numbers(found)))
    return rows.withColumn("probability", F.get(vector_to_array("probability"), F.lit(1))).drop("features", "rawPrediction", "prediction", *FEATURES)


def _judged_in(docs: DataFrame, model: RandomForestClassificationModel) -> DataFrame:
    cols = ["doc_id", "key", "rule", "value", "start", "probability"]
    out = judged(candidates(docs), model).select(cols).unionByName(key_blocks(docs).select(cols))
    return out.withColumn("is_secret", F.col("probability") >= 0.5)


def scan(docs: DataFrame, model: RandomForestClassificationModel) -> DataFrame:
    """(doc_id, rule, value, start, probability, is_secret) for each candidate in `docs` (doc_id, text[, source])."""
    return _judged_in(docs, model).drop("key")


def redact(docs: DataFrame, model: RandomForestClassificationModel, mark: str = "[SECRET]") -> DataFrame:
    """`docs` with every secret replaced by `mark` where it was found, in its own row; secrets that overlap become one
    mark.  n_chars, if there, follows.  Texts without a secret stay as they are and are not shuffled: a
    bounded table of bits (`sieve`) tells which rows may have one."""
    found = _judged_in(docs, model).filter("is_secret").select("doc_id", "key", F.struct("start", (F.col("start") + F.length("value")).alias("stop")).alias("span"))
    found = found.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set("span")).alias("spans"))  # of one text
    found = storage.written(found.withColumn("slot", F.xxhash64("key")), "secrets")
    # whole rows as one column: no name of theirs can clash
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), _key(docs).alias("of"))
    maybe = sieve.split(rows.withColumn("slot", F.xxhash64("of")), found.select("slot"), "slot")
    marked = maybe.filter("maybe").drop("slot").join(found.drop("slot"), (F.col("of") == F.col("key")) & F.col("id").eqNullSafe(F.col("doc_id")), "left").select("row", "spans")
    rows = marked.unionByName(maybe.filter("not maybe").select("row", F.lit(None).cast(marked.schema["spans"].dataType).alias("spans")))

    def step(state: Column, x: Column) -> Column:
        text = F.col("row.text")
        new = F.when(x.start < state.at, state.new).otherwise(F.concat(state.new, F.substr(text, state.at + 1, x.start - state.at), F.lit(mark)))
        return F.struct(F.greatest(state.at, x.stop).cast("int").alias("at"), new.alias("new"))

    spans = F.transform("spans", lambda x: F.struct(x.start.cast("int").alias("start"), x.stop.cast("int").alias("stop")))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("new"))
    text = F.aggregate(spans, start, step, lambda s: F.concat(s.new, F.substr(F.col("row.text"), s.at + 1)))
    rows = rows.withColumn("new", F.when(F.col("spans").isNotNull(), text).otherwise(F.col("row.text")))
    own = {"text": F.col("new")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(F.col("spans").isNull(), F.col("row.n_chars")).otherwise(F.length("new").cast(docs.schema["n_chars"].dataType))
    return rows.select(*(own.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
