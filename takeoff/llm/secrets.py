"""Secret scans: rules find candidates, a random forest removes the false positives. DataFrame and Spark ML functions only.

Candidates are the parts of a word that look opaque (16 or more characters of a key alphabet, with a digit), every value assigned to a
secret's name in the word or before it (a quoted one whole, its white space as one blank each), every key of a known provider and
every password in an address. The forest sees their length, character transitions, dictionary coverage,
path and neighbouring words. It is trained from labelled findings; `own_labels` makes these from formats that leave no doubt.

Null text: no candidate. Rows are findings: a document without a candidate has none; repeated rows of one text and id repeat
theirs. Without labels of both kinds the rules' own verdict holds: an assignment or a known format. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from takeoff.llm.common import documents, held_out, is_few, shuffled, staged

NAMES = r"(?:token|secret|passw|passphrase|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth|credential)"
SIGN = r"(?::=|=>|->|=|:)"
NAMED = rf"(?i){NAMES}[a-z0-9_-]*[\"']?"
# a value in double or single quotes, or up to a blank, quote, comma or semicolon: one group each
VALUE = r"(?:\"([^\"]+)\"|'([^']+)'|[\"'`(<\[{]*([^\"'`\s,;]+))"
GLUED = NAMED + SIGN + VALUE
LOGIN = r"://[^\s/:@]*:([^\s/@]+)@"
KNOWN = r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{30,}|sk[-_][A-Za-z0-9_-]{16,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}.*)"
OPAQUE = r"[A-Za-z0-9+/_=-]{16}"
KEYS = KNOWN.replace("^", "(?<![A-Za-z0-9])").replace(".*)", "[A-Za-z0-9_.-]*)")
SIGNS = ("=", ":", ":=", "=>", "->")
# Words that speak of examples, and common ones that a random string seldom holds.
PLACEHOLDERS = r"(?:example|sample|dummy|placeholder|changeme|xxxx|your[_-]|test|fake|redacted)"
DICTIONARY = r"(?:example|password|secret|token|access|private|public|server|client|value|default|string|number|user|admin|name|data|file|test|tion|ment|ing|the|and|for|key)"
FEATURES = ("length", "transitions", "digit_share", "upper_share", "is_hex", "is_number", "variety", "coverage", "known", "assigned", "named", "quoted",
            "placeholder", "placeholder_near", "test_path", "mail_or_url")
TREES, DEPTH, CUT, SEED = 40, 6, 0.5, 5


def candidates(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), path: str | None = "source") -> DataFrame:
    """A row per candidate: the kept columns, its word's place, its value, the words around it and whether it is assigned."""
    words = F.split(F.coalesce(F.col("text"), F.lit("")), r"[\x09-\x0D\x20]+")
    rows = docs.select(*keep, (F.col(path).cast("string") if path else F.lit(None).cast("string")).alias("_path"), words.alias("_words"))
    at = lambda i: F.get("_words", i)

    def assigned_at(i: Column) -> Column:
        by_sign = at(i - 1).isin(*SIGNS) & at(i - 2).rlike(f"(?i){NAMES}")
        return F.coalesce(by_sign, F.lit(False)) | F.coalesce(at(i - 1).rlike(f"{NAMED}{SIGN}$"), F.lit(False)) | F.coalesce(
            at(i).rlike(f"^{SIGN}.") & at(i - 1).rlike(f"{NAMED}$"), F.lit(False))

    def wanted(i: Column) -> Column:
        w = at(i)
        opaque = (F.length(w) >= 16) & w.rlike("[0-9]") & w.rlike(OPAQUE)
        return F.coalesce(opaque | assigned_at(i) & ~w.isin(*SIGNS) | w.rlike(NAMED + SIGN + ".") | w.rlike(KEYS) | w.rlike(LOGIN), F.lit(False))

    places = F.filter(F.sequence(F.lit(0), F.size("_words") - 1), wanted)
    place = F.col("place")
    found = rows.select(*keep, "_path", "_words", F.explode(places).alias("place")).select(
        *keep, "_path", "place", at(place).alias("_word"), assigned_at(place).alias("_follows"), "_words",
        F.lower(F.array_join(F.array_compact(F.array(*[at(place - k) for k in (3, 2, 1)])), " ")).alias("before"),
        F.lower(F.array_join(F.array_compact(F.array(*[at(place + k) for k in (1, 2)])), " ")).alias("after"))
    # a quote that an assigned value opens and this word doesn't close
    opened = F.when(F.col("_follows") | F.col("_word").rlike(GLUED.split(VALUE)[0] + "[\"']"), F.regexp_extract("_word", r"(?:^|[=:>])([\"'])[^\"']*$", 1)).otherwise("")
    rest = F.when(opened != "", F.array_join(F.slice("_words", F.col("place") + 2, F.size("_words")), " "))
    closed = F.when(opened == '"', F.regexp_extract(rest, r"^([^\"]*\")", 1)).when(opened == "'", F.regexp_extract(rest, r"^([^']*')", 1)).otherwise("")
    found = found.withColumn("_word", F.when(closed != "", F.concat_ws(" ", "_word", closed)).otherwise(F.col("_word")))
    every = lambda p, g: F.regexp_extract_all("_word", F.lit(p), F.lit(g))
    ends = lambda v: F.regexp_replace(v, r"[)\]}>]+$", "")
    first = F.concat(*[F.regexp_extract("_word", f"^{SIGN}?{VALUE}", g) if g < 3 else ends(F.regexp_extract("_word", f"^{SIGN}?{VALUE}", g)) for g in (1, 2, 3)])
    follows = F.when(F.col("_follows") & ~F.col("_word").rlike(NAMED + SIGN + "."), F.array(first)).otherwise(F.array().cast("array<string>"))
    some = lambda a: F.filter(F.array_distinct(a), lambda v: F.length(v) > 0)
    given = some(F.concat(every(GLUED, 1), every(GLUED, 2), F.transform(every(GLUED, 3), ends), every(LOGIN, 1), follows))
    found = found.withColumn("_given", given)
    found = found.withColumn("_keys", F.filter(F.array_distinct(every(KEYS, 0)), lambda k: ~F.exists("_given", lambda v: v.contains(k))))
    runs = F.transform(every(r"[^\"'`()<>\[\]{},;|=\s]+={0,2}", 0), lambda v: F.regexp_replace(v, r"^[!#$%&*:]+|[!#$%&*:]+$", ""))
    opaque = F.filter(F.array_distinct(runs), lambda v: (F.length(v) >= 16) & v.rlike("[0-9]") & v.rlike(OPAQUE) & ~F.exists(
        F.concat("_given", "_keys"), lambda o: o.contains(v) | v.contains(o) & ~v.rlike(LOGIN)))
    told = lambda a, yes: F.transform(a, lambda v: F.struct(v.alias("value"), F.lit(yes).alias("_assigned")))
    values = F.concat(told(F.col("_given"), True), told(F.col("_keys"), False), told(opaque, False))
    return found.select(*keep, "_path", "place", "before", "after", F.col("_word").rlike(r"^[\"'`]|[=:][\"'`]").alias("_quoted"), F.explode(values).alias("_v")).select(
        *keep, "_path", "place", "before", "after", "_v.value", "_v._assigned", "_quoted")


def with_features(found: DataFrame) -> DataFrame:
    v, size = F.col("value"), F.length("value")
    left = lambda p: F.length(F.regexp_replace(v, p, "")) / size  # noqa: E731  share of characters that a pattern doesn't take
    # a letter or digit next to one of another kind
    change = r"(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])"
    number = lambda c: c.cast("double")
    around = F.concat_ws(" ", "before", "after")
    return found.withColumns({
        "length": number(size), "transitions": (F.size(F.split(v, change)) - 1) / size, "digit_share": 1 - left("[0-9]"), "upper_share": 1 - left("[A-Z]"),
        "is_hex": number(v.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")), "is_number": number(v.rlike("^[0-9().+/_-]+$")),
        "variety": F.size(F.array_distinct(F.split(v, ""))) / size, "coverage": 1 - F.length(F.regexp_replace(F.lower(v), DICTIONARY, "")) / size,
        "known": number(v.rlike(KNOWN)), "assigned": number(F.col("_assigned")), "named": number(F.col("before").rlike(NAMES)), "quoted": number(F.col("_quoted")),
        "placeholder": number(F.lower(v).rlike(PLACEHOLDERS)), "placeholder_near": number(around.rlike(PLACEHOLDERS)),
        "test_path": number(F.coalesce(F.lower("_path").rlike("test|example|sample|fixture|docs?/"), F.lit(False))),
        "mail_or_url": number(v.rlike(r"^[\w.+-]+@[\w-]+\.[\w.-]+$|://|^www\.") & ~v.rlike(LOGIN)),
    })


def own_labels(found: DataFrame) -> DataFrame:
    """`label` of findings that leave no doubt; null for the others.

    1: a known format, or a hex or mixed string of 8 or more assigned to a secret's name. 0: a number, an address without a password,
    a dictionary word, a placeholder, an unquoted word of letters alone.
    """
    mixed = F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]") & (F.col("length") >= 8)
    no = (F.col("is_number") + F.col("mail_or_url") + F.col("placeholder") > 0) | (F.col("coverage") > 0.6) | (~F.col("_quoted") & F.col("value").rlike("^[A-Za-z]?[a-z]+[.!?]?$"))
    yes = (F.col("known") == 1) | ((F.col("assigned") == 1) & mixed)
    return found.withColumn("label", F.when(no, 0.0).when(yes, 1.0))


def assembled(found: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="_features").transform(found)


def trained(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH):
    """A forest from findings with features and a `label` of 0 or 1; None without both kinds."""
    rows = labelled.where(F.col("label").isin(0.0, 1.0))
    if rows.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(featuresCol="_features", labelCol="label", numTrees=trees, maxDepth=depth, seed=SEED)
    return forest.fit(assembled(rows).select("label", "_features"))


def judged(found: DataFrame, model, cut: float = CUT) -> DataFrame:
    """Adds score (0 to 1) and secret."""
    if model is None:
        return found.withColumn("score", F.greatest("known", "assigned")).withColumn("secret", F.col("score") >= cut)
    scored = model.transform(assembled(found)).withColumn("score", vector_to_array("probability")[1])
    return scored.drop("_features", "rawPrediction", "probability", "prediction").withColumn("secret", F.col("score") >= cut)


def findings(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), path: str | None = "source", learn: Column | None = None) -> DataFrame:
    """Judged candidates; the forest learns from those of them that `learn` selects (all, if None) and that leave no doubt."""
    found = staged(own_labels(with_features(candidates(docs, keep, path))), "candidates")
    return judged(found, trained(found if learn is None else found.where(learn)))


def redacted(docs: DataFrame, path: str | None = "source", mark: str = "[SECRET]") -> DataFrame:
    """The documents, columns and rows as they are, with every secret in `text` replaced by a mark."""
    key = F.unhex(F.md5(F.col("text").cast("binary")))
    keyed = docs.select("text", *([path] if path else [])).withColumn("_key", key)
    secret = findings(keyed, ("_key",), path).where("secret").groupBy("_key").agg(F.collect_set("value").alias("_secrets"))
    longest_first = F.array_sort("_secrets", lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    # only where the value stands by itself, its blanks being any white space
    quoted = lambda s: F.replace(F.replace(s, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(" "), F.lit("\\E[\\x09-\\x0D\\x20]+\\Q"))
    bound = lambda s, p, e: F.when(s.rlike(p), F.lit(e)).otherwise(F.lit(""))
    alone = lambda s: F.concat(bound(s, "^[A-Za-z0-9]", "(?<![A-Za-z0-9])"), F.lit("\\Q"), quoted(s), F.lit("\\E"), bound(s, "[A-Za-z0-9]$", "(?![A-Za-z0-9])"))
    clean = F.aggregate(longest_first, F.col("_row.text"), lambda t, s: F.regexp_replace(t, alone(s), F.lit(mark.replace("\\", "\\\\").replace("$", "\\$"))))
    rows, secret = docs.select(F.struct(*docs.columns).alias("_row"), key.alias("_key")), staged(secret, "secrets")
    if is_few(secret.select("_key")):  # texts without a secret stay where they are
        keys = F.broadcast(secret.select("_key"))
        marked = rows.join(keys, "_key", "left_semi").join(secret, "_key")
        rows = rows.join(keys, "_key", "left_anti").withColumn("_secrets", F.lit(None).cast("array<string>")).select("_row", "_secrets").union(marked.select("_row", "_secrets"))
    else:
        rows = rows.join(shuffled(secret), "_key", "left")
    text = F.when(F.col("_secrets").isNull(), F.col("_row.text")).otherwise(clean)
    return rows.select(*[text.alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])


def op7_random_forest_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = findings(documents(spark, sf_dir), learn=~held_out(F.col("doc_id")))
    return out.select("doc_id", F.col("place").cast("long").alias("place"), F.sha2("value", 256).alias("value_sha256"), F.length("value").alias("n_chars"),
                      F.round("score", 6).alias("score"), "secret")
