"""Secret scans: candidate strings, and a random forest that removes false positives.

A candidate is a long run of token characters, or a shorter one that an announcing word assigns.
"=" and leading "-" stay outside, but for base64 padding at the end, so that of "name=value" the
value is the candidate and the name stands before it.  Its features are its length, its character
transitions, how much of it common words cover, and its path and neighbouring words.  The forest
is trained on labelled findings and turned into one column expression, so that scanning is a
projection of the document table: no join, no shuffle, DataFrame functions only.
"""
from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfold.session import cut, pin

BEFORE, AFTER = 48, 16
SAMPLE = 4000        # findings of each kind the forest is trained on, at most
DRAWN, LENDING = 20_000, 1_000  # documents that findings are drawn from, about, and that lend neighbours to made strings
DICTIONARY = 300     # common words that count as a dictionary
# Words that announce a secret, and words that announce a harmless long string.
SECRET_WORDS = "token|secret|passwd|password|pwd|api_?key|apikey|access_?key|private_?key|auth|bearer|credential"
HARMLESS_WORDS = "commit|sha1|sha256|md5|checksum|digest|etag|uuid|integrity|revision|hash"
FIRST = "A-Za-z0-9+/_"
PAD = rf"(?:={{1,2}}(?![{FIRST}=\-]))?"
LONG, SHORT = rf"[{FIRST}][{FIRST}\-]{{15,}}+{PAD}", rf"[{FIRST}][{FIRST}\-]{{5,14}}+{PAD}"
ASSIGNED = rf"(?<=[=:>]\s{{0,3}}[\"']?)(?<=(?i:{SECRET_WORDS})[\"']?\s{{0,3}}[=:]{{1,2}}>?\s{{0,3}}[\"']?)"  # the first part is only there to be quick
CANDIDATE = rf"(?<![{FIRST}])(?:{LONG}|(?=[{FIRST}]){ASSIGNED}{SHORT})"
ANNOUNCED = rf"(?i)(?:{SECRET_WORDS})\W{{0,6}}$"
FEATURES = ("length", "digits", "upper", "lower", "symbols", "kinds", "case_steps", "vowels", "variety", "hex", "dictionary", "path", "secret_word", "harmless_word", "assigned", "quoted")


def common_words(docs: DataFrame, size: int = DICTIONARY) -> list[str]:
    """The most frequent words of three to five letters a-z over all documents."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(?<![a-z])[a-z]{3,5}(?![a-z])"), 0)
    top = docs.select(F.explode(words).alias("w")).groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(size)
    return sorted((r["w"] for r in top.collect()), key=lambda w: (-len(w), w))  # at most ``size`` rows


def findings(df: DataFrame, out: str) -> DataFrame:
    """Add ``out``: array of (secret, start, before, after) of all candidates in ``text``; start in
    characters from 0.  The text is matched and split once each; the rest works on the pieces."""
    text = F.coalesce(F.col("text"), F.lit(""))
    pieces = F.struct(F.regexp_extract_all(text, F.lit(CANDIDATE), 0).alias("found"), F.split(text, CANDIDATE).alias("gaps"))  # one gap more than candidates
    held = pin(df, **{out: pieces})
    found, gaps = F.col(out)["found"], F.col(out)["gaps"]
    first = lambda c: F.coalesce(F.left(c, F.lit(AFTER)), F.lit(""))
    both = F.transform(found, lambda x, i: F.struct(x.alias("secret"), F.get(gaps, i).alias("gap"),
        F.left(F.concat(*[first(c) for k in (1, 2, 3) for c in (F.get(gaps, i + k), F.get(found, i + k))]), F.lit(AFTER)).alias("after")))  # no two candidates touch: three more reach far enough
    before = lambda acc, x: F.right(F.concat(acc["tail"], F.right(x["gap"], F.lit(BEFORE))), F.lit(BEFORE))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("tail"), F.array().cast("array<struct<start:bigint,before:string>>").alias("seen"))
    seen = F.aggregate(both, zero, lambda acc, x: F.struct(
        (acc["at"] + F.length(x["gap"]) + F.length(x["secret"])).alias("at"), F.right(F.concat(before(acc, x), x["secret"]), F.lit(BEFORE)).alias("tail"),
        F.concat(acc["seen"], F.array(F.struct((acc["at"] + F.length(x["gap"])).alias("start"), before(acc, x).alias("before")))).alias("seen")))["seen"]
    zipped = F.transform(F.arrays_zip(both.alias("b"), seen.alias("s")), lambda x: F.struct(
        x["b"]["secret"].alias("secret"), x["s"]["start"].alias("start"), x["s"]["before"].alias("before"), x["b"]["after"].alias("after")))
    return held.withColumn(out, zipped)


def describe(secret: Column, before: Column, after: Column, words: list[str]) -> list[Column]:
    """The features of one candidate, as doubles in the order of FEATURES."""
    n = F.length(secret)
    share = lambda pattern: F.regexp_count(secret, F.lit(pattern)) / n
    covered = F.length(F.regexp_replace(F.lower(secret), "|".join(words), "")) if words else n
    yes = lambda c: c.cast("double")
    announced, assigned = before.rlike(ANNOUNCED), before.rlike(r"[=:]>?\s*[\"']?$")
    out = [n, share("[0-9]"), share("[A-Z]"), share("[a-z]"), share(r"[+/_=\-]"),
           share("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])"), share("(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"),
           share("(?i)[aeiou]"), F.size(F.array_distinct(F.split(secret, ""))) / n,
           yes(secret.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")), 1 - covered / n,
           yes(before.rlike(r"(?:://|[\\/.~])\S*$") & ~(announced & assigned) | after.rlike(r"^\.[a-z]{2,4}\b") | (F.regexp_count(secret, F.lit("/")) >= 3)),
           yes(announced), yes(before.rlike(rf"(?i)(?:{HARMLESS_WORDS})\W{{0,6}}$")),
           yes(assigned), yes(before.rlike(r"[\"']$") & after.rlike(r"^[\"']"))]
    return [F.coalesce(c.cast("double"), F.lit(0.0)) for c in out]


def labelled_findings(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """secret, before, after, label: findings with labels of high precision, from the documents themselves.

    A string with digits that an announcing word assigns is a secret; one without digits, of digits only, in a
    path, or announced as a harmless sum, is none.  So that the string counts and not only its
    neighbours, each document also lends its neighbours to random keys drawn from hashes
    (secrets) and to its own words run together or a plain number (none); the same with short strings that are announced and assigned.  All come from a
    sample of DRAWN documents by a hash of id and text; each kind is bounded by ``sample``.
    """
    n = max(1, docs.count())
    bar = lambda many: F.lit(min(int((min(1.0, many / n) - 0.5) * 2**64), 2**63 - 1))
    draw = F.xxhash64(F.lit(1), "doc_id", "text")
    base = cut(docs.where(F.col("text").isNotNull() & (draw <= bar(DRAWN))).select("text", draw.alias("_d")))
    lenders = base.where(F.col("_d") <= bar(LENDING))
    rows = findings(base, "f").select("_d", F.explode("f").alias("f")).select("_d", "f.secret", "f.before", "f.after")
    digit, announced = F.col("secret").rlike("[0-9]"), F.col("before").rlike(ANNOUNCED)
    harmless = ~F.col("secret").rlike("[0-9]") | F.col("secret").rlike("^[0-9]+$") | F.col("before").rlike(rf"(?i)(?:://\S*|(?:{HARMLESS_WORDS})\W{{0,6}})$") & ~(announced & F.col("before").rlike(r"=[\"']?$"))
    real = rows.withColumn("label", F.when(digit & announced & ~harmless, 1.0).when(harmless & ~announced, 0.0)).where("label is not null")
    plain = F.split(F.regexp_replace("text", r"[^A-Za-z ]+", " "), " +")
    near = F.concat_ws(" ", F.slice(plain, 1, 3))
    sha = F.sha2(F.col("text"), 256)
    drawn = F.array(F.sha1("text"), F.substring(sha, 1, 32), F.regexp_replace(F.base64(F.unhex(sha)), "=+$", ""), F.concat(F.lit("AKIA"), F.upper(F.substring(F.regexp_replace(F.base64(F.unhex(sha)), "[^A-Za-z0-9]", ""), 1, 16))))
    joined = F.array(F.array_join(F.slice(plain, 2, 4), ""), F.array_join(F.slice(plain, 3, 3), "_"), F.array_join(F.transform(F.slice(plain, 2, 3), lambda w: F.initcap(w)), ""),
                     F.concat(F.array_join(F.slice(plain, 2, 3), "-"), F.lit("-2024")), F.array_join(F.slice(plain, 1, 4), "/"), F.abs("_d").cast("string"))
    lend = lambda strings, label, told: lenders.select("_d", F.explode(strings).alias("secret"), F.concat(near, told).alias("before"), F.lit(" ").alias("after"), F.lit(label).alias("label"))
    made = lend(drawn, 1.0, F.when(F.col("_d") % 3 == 0, F.lit(" key = ")).otherwise(F.lit(" "))).unionByName(lend(joined, 0.0, F.when(F.col("_d") % 3 == 0, F.lit(" token = ")).otherwise(F.lit(" "))))
    made = made.where(F.col("secret").rlike(rf"^{LONG}$"))
    told = F.element_at(F.array(*map(F.lit, (" password = ", " token: ", " --secret=", "\nAPI_KEY=", " https://example.com/v1?token="))), F.pmod(F.col("_d"), F.lit(5)).cast("int") + 1)
    brief = F.array(F.substring(sha, 1, 12), F.substring(F.regexp_replace(F.base64(F.unhex(sha)), "[^A-Za-z0-9]", ""), 1, 12), F.concat(F.lower(F.get(plain, F.lit(1))), F.regexp_replace(F.substring(sha, 1, 4), "[a-f]", "7")))
    brief = F.filter(brief, lambda x: x.rlike("[0-9]"))
    words_only = F.filter(F.slice(plain, 2, 3), lambda x: F.length(x) >= 6)
    made_brief = lend(brief, 1.0, told).unionByName(lend(words_only, 0.0, told)).where(F.col("secret").rlike(rf"^{SHORT}$"))
    few = lambda d: d.orderBy("_d", "secret").limit(sample)  # noqa: E731  a top-k of short strings
    kinds = [d.where(f"label = {x}") for d in (real, made, made_brief) for x in (1.0, 0.0)]
    out = few(kinds[0])
    for k in kinds[1:]:
        out = out.unionByName(few(k))
    return out.select("secret", "before", "after", "label")


def train_forest(labelled: DataFrame, words: list[str], trees: int = 15, depth: int = 5, seed: int = 1):
    """A forest as nested tuples, one per tree: (feature, threshold, left, right) or a leaf's chance of a secret.
    Empty if the findings have only one label."""
    x = labelled.select(F.col("label").cast("double"), *[c.alias(n) for n, c in zip(FEATURES, describe(F.col("secret"), F.col("before"), F.col("after"), words))])
    x = cut(x)
    if x.select("label").distinct().count() < 2:
        return []
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(x).select("label", "features").coalesce(4)
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=5, featureSubsetStrategy="sqrt", seed=seed).fit(data)

    def read(node):
        if node.subtreeDepth() == 0:
            stats = list(node.impurityStats().stats())
            return stats[1] / max(sum(stats), 1e-9)
        return node.split().featureIndex(), node.split().threshold(), read(node.leftChild()), read(node.rightChild())

    return [read(t._java_obj.rootNode()) for t in model.trees]


def forest_score(forest, values: Column) -> Column:
    """Mean chance over the trees, as a column of an array of feature values."""
    def walk(node) -> Column:
        if isinstance(node, float):
            return F.lit(node)
        feature, threshold, left, right = node
        return F.when(values[feature] <= threshold, walk(left)).otherwise(walk(right))
    total = walk(forest[0])
    for tree in forest[1:]:
        total = total + walk(tree)
    return total / len(forest)


class Scanner:
    """A trained scan: ``find`` adds an array column of what the forest holds for secrets."""

    def __init__(self, forest, words: list[str], threshold: float = 0.5) -> None:
        self.forest, self.words, self.threshold = forest, words, threshold

    @classmethod
    def fit(cls, docs: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.5) -> "Scanner":
        """``labelled``: secret, before, after, label (1.0 or 0.0); drawn from ``docs`` where none is given."""
        words = common_words(docs)
        return cls(train_forest(labelled if labelled is not None else labelled_findings(docs), words), words, threshold)

    def rate(self, df: DataFrame, out: str) -> DataFrame:
        """Add ``out``: array of (secret, start, score) of all candidates; none without a forest."""
        if not self.forest:
            return df.withColumn(out, F.array().cast("array<struct<secret:string,start:bigint,score:double>>"))
        held = findings(df, out)
        seen = F.transform(out, lambda x: F.struct(x["secret"].alias("secret"), x["start"].alias("start"), F.array(*describe(x["secret"], x["before"], x["after"], self.words)).alias("v")))
        scored = F.transform(seen, lambda x: F.struct(x["secret"].alias("secret"), x["start"].alias("start"), F.round(forest_score(self.forest, x["v"]), 6).alias("score")))
        return pin(held, _scored=scored).withColumn(out, F.col("_scored")).drop("_scored")

    def find(self, df: DataFrame, out: str) -> DataFrame:
        """Add ``out``: array of (secret, start, score) of what passes the threshold."""
        held = self.rate(df, "_rated")
        return pin(held, _scored=F.filter("_rated", lambda x: x["score"] >= self.threshold)).withColumn(out, F.col("_scored")).drop("_scored", "_rated")


def scan(docs: DataFrame, scanner: Scanner) -> DataFrame:
    """doc_id, start, end, secret, score: one row per secret, offsets in characters, end exclusive.
    Null and empty texts have none."""
    rows = scanner.find(docs.select("doc_id", "text"), "s").select("doc_id", F.inline("s"))
    return rows.select("doc_id", "start", (F.col("start") + F.length("secret")).alias("end"), "secret", "score")


def redact(docs: DataFrame, scanner: Scanner, mark: str = "<secret>") -> DataFrame:
    """The columns of ``docs`` with every secret in ``text`` replaced where it stands by ``mark`` (``n_chars``, if there, counted anew where any was)."""
    inner = {c: f"c{i}" if c != "text" else c for i, c in enumerate(docs.columns)}  # no clash with the scan's columns
    held = scanner.rate(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in inner.items()]), "_found")
    hit = F.exists("_found", lambda x: x["score"] >= scanner.threshold)
    put = lambda x: F.when(x["score"] >= scanner.threshold, F.lit(mark)).otherwise(F.coalesce(x["secret"], F.lit("")))
    clean = F.array_join(F.transform(F.split("text", CANDIDATE), lambda gap, i: F.concat(gap, put(F.get("_found", i)))), "")  # the gaps between the candidates, and those again
    held = pin(held, _clean=F.when(hit, clean))
    clean, hit = F.col("_clean"), F.col("_clean").isNotNull()
    out = {c: F.col(n) for c, n in inner.items()}
    out["text"] = F.when(hit, clean).otherwise(F.col("text"))
    if "n_chars" in out:
        out["n_chars"] = F.when(hit, F.length(clean).cast("long")).otherwise(out["n_chars"])
    return held.select(*[c.alias(n) for n, c in out.items()])
