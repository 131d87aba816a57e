"""Secret scans: candidates by pattern, false positives removed by a random forest; DataFrame functions only."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sharding import settled
from .work import Scratch

#: A candidate is a run of 16 characters or more of the alphabets of keys and tokens, with padding at its end; runs joined
#: by dots are one. A `=` ends a run: in api_key=9f86d0... the name is no part of the key. Besides, whatever is
#: assigned to a name that says it is secret, if it has 6 characters, whatever its alphabet. Before a candidate, up to 48
#: characters of its line hold the neighbouring words. Possessive: Java matches such groups in a loop, however many there are.
_RUN, _ASSIGNED = r"[A-Za-z0-9+/_\-]", r"(?i:pass|password|passwd|passphrase|pwd|secret|token|api_?key|api-key|access_?key|auth|credentials?|private_key)[\"']? ?[:=] ?[\"'`]?"
TOKEN = rf"{_RUN}{{16,}}+(?:\.{_RUN}{{16,}}+)*+(?:=+(?!{_RUN}))?|(?<=[:=][\"'` ]{{0,2}})(?<={_ASSIGNED})[^\s\"'`]{{5,}}[^\s\"'`,;.:)\]}}]"
#: Words that stand before secrets, words that stand before other long strings, and pieces of
#: ordinary words, by which the share of a candidate that a dictionary covers is measured.
SECRET_WORDS = "token secret password passwd pwd apikey api_key api-key access_key auth bearer credential private".split()
OTHER_WORDS = "commit sha sha1 sha256 md5 checksum digest hash uuid guid id card phone isbn doi version example sample".split()
DICTIONARY = """able about above after again air all also and another any are around ask away back because been before being below between
both build but call came change char check city class code color come config could count data date day default did different does done down
each earth end enough even every example eye far file find first five follow food for found four from function get give good great group grow
had hand hard has have head help here high his home house how image index into item just keep kind know land large last learn leave left letter
life light like line list little live long look made main make many mean might more most mother move much must name near need never new next
night not note number object off often old once one only open order other our out over own page paper part path people place plant play point
put read real report right river run said same sample saw school sea second see seem sentence set she should show side small some something
sound spell start state still stop story string study such system table take talk tell test than that the their them then there these they
thing think this those thought three through time together too took tree try turn two type under until use user value version very walk want
was watch water way well went were what when where which while white who why will with without word work world would write year you young
your""".split()
#: Places whose findings are seldom secrets, and places that hold settings.
TEST_PATH, CONFIG_PATH = r"(?i)test|example|sample|fixture|doc", r"(?i)conf|\.env|\.ya?ml|\.ini|\.properties|secret|deploy"
FEATURES = ["length", "distinct", "digits", "uppers", "hexish", "turns", "entropy", "dictionary", "assigned", "quoted", "said_secret", "said_other", "symbols", "test_path", "config_path"]


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def features(df: DataFrame) -> DataFrame:
    """Adds the numbers of FEATURES for columns before, candidate and path."""
    c, n = F.col("candidate"), F.length("candidate").cast("double")
    before = F.lower("before")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[a-z]", "a"), "[A-Z]", "b"), "[0-9]", "0"), "[^ab0]", "_")
    chars = F.split(c, "")
    # Shannon entropy from the counts of the distinct characters
    alphabet = F.array_distinct(chars)
    entropy = F.aggregate(alphabet, F.lit(0.0), lambda s, x: s + (lambda k: -(k / n) * F.log2(k / n))((n - F.length(F.replace(c, x, F.lit("")))).cast("double")))
    covered = n - F.length(F.regexp_replace(F.lower(c), "(" + "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))) + ")", ""))
    words = lambda ws: "(?<![a-z0-9])(" + "|".join(w.replace("-", r"\-") for w in ws) + ")(?![a-z0-9])"
    return df.select(
        "*", n.alias("length"), F.size(alphabet).cast("double").alias("distinct"), (count_of(c, "[0-9]") / n).alias("digits"), (count_of(c, "[A-Z]") / n).alias("uppers"),
        (count_of(c, "[0-9a-f]") / n).alias("hexish"), (count_of(kinds, r"(?=(ab|a0|a_|ba|b0|b_|0a|0b|0_|_a|_b|_0))[ab0_]") / n).alias("turns"), entropy.alias("entropy"), (covered / n).alias("dictionary"),
        before.rlike(r"[=:]\s*[\"'`]?$").cast("double").alias("assigned"), before.rlike(r"[\"'`]$").cast("double").alias("quoted"),
        before.rlike(words(SECRET_WORDS)).cast("double").alias("said_secret"), before.rlike(words(OTHER_WORDS)).cast("double").alias("said_other"), (count_of(c, "[^A-Za-z0-9]") / n).alias("symbols"),
        F.coalesce(F.col("path").rlike(TEST_PATH), F.lit(False)).cast("double").alias("test_path"), F.coalesce(F.col("path").rlike(CONFIG_PATH), F.lit(False)).cast("double").alias("config_path"),
    )


def labelled_findings(spark: SparkSession, rows: int = 3000, seed: int = 5) -> DataFrame:
    """before, candidate, path, label: a made-up set of judged findings, the same at every call.

    Secrets: hexadecimal, base64 (with and without digits) and prefixed tokens that are assigned or named as secrets,
    and words run together that are named so. Others: hashes of commits and files, card and phone numbers,
    identifiers, dates, versions, placeholders, rules of signs, long words of any case, words joined by signs or run together.
    """
    n = F.col("id")
    rnd = lambda k: F.pmod(F.xxhash64(n, F.lit(seed), F.lit(k)), F.lit(1 << 30)).cast("double") / (1 << 30)
    pick = lambda k, values: F.element_at(F.array(*(F.lit(v) for v in values)), (rnd(k) * len(values)).cast("int") + 1)
    sha = lambda k: F.sha2(F.concat_ws("-", n, F.lit(f"{seed}-{k}")), 256)
    b64 = F.regexp_replace(F.base64(F.unhex(sha("b"))), "[=\r\n]", "")
    digits = lambda k, size: F.substring(F.regexp_replace(F.concat(F.conv(F.substring(sha(k), 1, 12), 16, 10), F.conv(F.substring(sha(k), 13, 12), 16, 10)), "^0", "7"), 1, size)
    word = lambda k: pick(k, DICTIONARY)
    joined = F.concat(*(F.initcap(word(k)) for k in ("w1", "w2", "w3", "w4")))
    compound = F.substring(F.translate(sha("c"), "0123456789abcdef", "aeiounrstlehgcmi"), F.lit(1), (rnd("long") * 20).cast("int") + 16)
    good = F.element_at(F.array(
        F.substring(sha("h"), 1, 40), F.substring(sha("h"), 1, 32), sha("h"), F.substring(b64, 1, 40), F.substring(b64, 1, 24), F.concat(F.lit("AKIA"), F.upper(F.substring(sha("a"), 1, 16))),
        F.concat(F.lit("ghp_"), F.substring(b64, 1, 36)), F.concat(F.lit("sk_live_"), F.substring(b64, 1, 24)), F.concat(F.lit("xoxb-"), digits("x", 12), F.lit("-"), F.substring(b64, 1, 24)),
        F.translate(F.substring(b64, 1, 24), "0123456789", "gHjKmNpQrS"), F.translate(F.substring(b64, 1, 40), "0123456789", "gHjKmNpQrS"), joined,
        F.concat(word("w1"), digits("v", 4)), F.concat(F.initcap(word("w1")), pick("sign", ["!", "@", "#", "$", "_", "-"]), digits("v", 3), word("w2")), F.substring(b64, 1, 10), F.concat(F.substring(b64, 3, 8), pick("sign", ["!", "?", "%", "*"])),
        F.concat_ws("-", word("w1"), word("w2"), word("w3"), word("w4")), F.concat_ws(".", F.concat(F.lit("eyJ"), F.substring(b64, 1, 33)), F.substring(b64, 2, 40), F.translate(F.substring(b64, 1, 43), "+/", "-_")),
    ), (rnd("kind") * 18).cast("int") + 1)
    bad = F.element_at(F.array(
        F.substring(sha("h"), 1, 40), F.substring(sha("h"), 1, 32), digits("d", 16), digits("d", 19), F.concat_ws("-", F.substring(sha("u"), 1, 8), F.substring(sha("u"), 9, 4), F.substring(sha("u"), 13, 4), F.substring(sha("u"), 17, 12)),
        F.concat_ws("-", F.lit("2024"), digits("m", 2), digits("e", 2), word("w1"), word("w2")), F.concat_ws("_", word("w1"), word("w2"), word("w3"), digits("v", 2)), F.concat_ws("/", word("w1"), word("w2"), word("w3"), digits("v", 1)),
        F.concat(F.lit("xxxxxxxxxxxxxxx"), digits("v", 1)), F.concat(F.repeat(F.lit("0"), 12), digits("v", 4)), F.concat(word("w1"), F.lit("="), word("w2"), F.lit("="), digits("v", 4), word("w3")), F.concat_ws("-", digits("p", 3), digits("q", 3), digits("r", 4), digits("s", 4)),
        F.concat_ws("/", word("w1"), word("w2"), word("w3"), word("w4")), F.concat_ws("_", word("w1"), word("w2"), word("w3"), word("w4")), F.concat_ws("-", word("w1"), word("w2"), word("w3"), word("w4")),
        F.repeat(pick("w1", ["-", "=", "_", "/", "+", "-=", "x", "a"]), 40), joined,
        compound, F.upper(compound), F.initcap(compound),
        pick("w1", ["required", "optional", "string", "changed", "expired", "invalid", "missing", "disabled", "None,", "********", "xxxxxxxx"]), F.concat(F.lit("<"), word("w1"), F.lit("_"), word("w2"), F.lit(">")), F.concat(F.lit("${"), F.upper(word("w1")), F.lit("_KEY")), F.concat(F.lit("get_"), word("w1"), F.lit("_"), word("w2"), F.lit("(")),
    ), (rnd("kind") * 24).cast("int") + 1)
    filler = F.concat_ws(" ", word("f1"), word("f2"), word("f3"))
    named = F.concat(filler, F.lit(" "), pick("key", SECRET_WORDS), pick("op", [" = \"", "=", ": ", " = '", "\": \"", " = "]))
    loose = F.concat(filler, pick("gap", [" ", ", ", ". ", " ("]))
    told = F.concat(filler, F.lit(" "), pick("key", OTHER_WORDS), pick("op", [" ", ": ", "=", " = \""]))
    label = (rnd("label") < 0.4).cast("double")
    hexes = F.col("candidate").rlike("^([0-9a-f]{32,}|([A-Z][a-z]+)+|[a-z]+(-[a-z]+){3})$")  # told apart by the words before them only
    df = spark.range(rows).select("id", label.alias("label"), F.when(label == 1, good).otherwise(bad).alias("candidate"), filler.alias("filler"), named.alias("named"), loose.alias("loose"), told.alias("told"), rnd("place").alias("r"), rnd("path").alias("p"))
    # shorter ones are candidates only where they are assigned to a secret's name
    df = df.withColumn("short", ~F.col("candidate").rlike(rf"^{_RUN}{{16}}"))
    before = F.when(F.col("label") == 1, F.when(F.col("short") | (F.col("r") < 0.85) | hexes, F.col("named")).otherwise(F.col("loose"))).otherwise(F.when(~F.col("short") & (hexes | (F.col("r") < 0.4)), F.col("told")).when(F.col("short") | (F.col("r") < 0.5) & ~F.col("candidate").rlike("^[0-9a-f-]+$"), F.col("named")).otherwise(F.col("loose")))
    path = F.when(F.col("p") < 0.1, F.when(F.col("label") == 1, "app/config.yml").otherwise("tests/sample.txt")).otherwise("src")
    return df.select(before.alias("before"), "candidate", path.alias("path"), "label")


def train(labelled: DataFrame, trees: int = 20, depth: int = 7, seed: int = 11) -> RandomForestClassificationModel:
    """A forest on labelled findings (before, candidate, path, label); their number bounds the work."""
    x = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(features(labelled))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, maxBins=32).fit(x.select("label", "features"))


def default_model(spark: SparkSession) -> RandomForestClassificationModel:
    """The forest on labelled_findings, trained once for a Spark application."""
    app = spark.sparkContext.applicationId
    if app not in _MODELS:
        _MODELS[app] = train(labelled_findings(spark))
    return _MODELS[app]


_MODELS: dict[str, RandomForestClassificationModel] = {}


def pieces(text: Column) -> Column:
    """c: the candidates of a text in order; g: what stands before, between and after them."""
    return F.struct(F.regexp_extract_all(text, F.lit(f"({TOKEN})"), 1).alias("c"), F.split(text, TOKEN, -1).alias("g"))


def matches(text: Column) -> Column:
    """An array of (before, c): each candidate and the up to 48 characters before it.

    Candidates have 6 characters or more and a gap between them, so the last seven and the gaps hold these 48.
    """
    last = lambda of, i: F.coalesce(F.right(F.get(of, i), F.lit(48)), F.lit(""))

    def before(f, i):
        near = F.concat(*(last(f[x], i - k - int(x == "c")) for k in range(7, -1, -1) for x in ("c", "g")))
        return F.when(F.length(F.get(f["g"], i)) >= 48, last(f["g"], i)).otherwise(F.right(near, F.lit(48)))

    each = lambda f: F.transform(f["c"], lambda c, i: F.struct(before(f, i).alias("before"), c.alias("c")))
    return F.get(F.transform(F.array(pieces(text)), each), F.lit(0))  # an array of one, so that each text is searched once


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, path, ordinal, before, candidate: each candidate in each text, in order, from 0."""
    found = docs.select("doc_id", F.col("source").cast("string").alias("path"), F.posexplode(matches(F.col("text").cast("string"))).alias("ordinal", "m"))
    return found.select("doc_id", "path", "ordinal", F.regexp_extract("m.before", "[^\n]*$", 0).alias("before"), F.col("m.c").alias("candidate"))


def judged(found: DataFrame, model: RandomForestClassificationModel | None, least: float) -> DataFrame:
    """Candidates with score and is_secret."""
    model = model or default_model(found.sparkSession)
    x = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(features(found))
    score = F.round(F.element_at(vector_to_array("probability"), 2), 6)
    return model.transform(x).select("doc_id", "ordinal", "before", "candidate", score.alias("score")).withColumn("is_secret", F.col("score") >= least)


def scan(docs: DataFrame, model: RandomForestClassificationModel | None = None, least: float = 0.5) -> DataFrame:
    """doc_id, ordinal, before, candidate, score, is_secret: every candidate in every whole text of `docs`.

    A random forest scores each by its length, alphabet, changes between kinds of characters, entropy, dictionary
    coverage, the words before it on its line and the document's `source` as its path; is_secret if the score is
    `least` or more. Null and empty texts and an empty table have no findings; repeated rows report theirs each; a long
    text has all its candidates judged, however long they are; a null source says nothing; other columns are not read, whatever
    their names. No shuffle: a row's findings stay where it is.
    """
    return judged(candidates(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), docs["source"].alias("source"))), model, least)


def redact(docs: DataFrame, model: RandomForestClassificationModel | None = None, least: float = 0.5, mark: str = "[SECRET]") -> DataFrame:
    """`docs` with each finding judged a secret replaced by `mark` where it stands; n_chars, if there, follows the text.

    The same characters elsewhere (judged harmless, or inside a longer string) stay. All rows and columns stay,
    whatever their names; texts without a secret, null and empty ones come back as they were; repeated rows are
    treated one by one; a long text is redacted whole; an empty table gives no rows. Findings meet their rows by the
    row's place in its file (see settled), never by text.
    """
    spark, columns = docs.sparkSession, docs.columns
    # columns by number while rows are joined: no name of the input's can clash
    at = {c: f"c{i}" for i, c in enumerate(columns)}
    rows, ident = settled(docs.select(*(docs[c].alias(at[c]) for c in columns)), Scratch(spark, "secrets"))
    rows = rows.withColumn("row", ident)
    hits = judged(candidates(rows.select(F.col("row").alias("doc_id"), F.col(at["text"]).alias("text"), F.col(at["source"]).alias("source"))), model, least)
    hits = hits.where("is_secret").groupBy(F.col("doc_id").alias("row")).agg(F.collect_set("ordinal").alias("hit"))
    out = rows.join(hits, "row", "left")

    def hidden(f: Column) -> Column:
        said = F.transform(f["c"], lambda c, i: F.concat(F.get(f["g"], i), F.when(F.array_contains("hit", i), F.lit(mark)).otherwise(c)))
        return F.concat(F.array_join(said, ""), F.element_at(f["g"], -1))

    text = F.when(F.col("hit").isNull(), F.col(at["text"])).otherwise(F.get(F.transform(F.array(pieces(F.col(at["text"]).cast("string"))), hidden), F.lit(0)))
    out = out.withColumn(at["text"], text)
    if "n_chars" in at:
        out = out.withColumn(at["n_chars"], F.when(F.col("hit").isNull(), F.col(at["n_chars"])).otherwise(F.length(at["text"]).cast("long")))
    return out.select(*(F.col(at[c]).alias(c) for c in columns))


def digest(findings: DataFrame) -> DataFrame:
    """What a report may show: no finding's text."""
    return findings.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), F.length("candidate").cast("long").alias("length"), F.sha2("candidate", 256).alias("candidate_sha256"), "score", "is_secret")
