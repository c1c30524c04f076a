r"""Secret scans with a random forest that removes false positives.

Candidates are (1) runs of at least 16 key-like characters with a digit among them, without the ``name=`` that they may
begin with, and (2) values of at least 6 characters, with a digit or a mark among them, that are assigned to a key-like
name (``password = "hunter2!"``). Shorter runs that no name announces, and values of letters alone, are not candidates.

The forest judges each one by its length, the changes between character classes, how much of it dictionary
words cover, the path it is in, and the words before and after it. It is trained on labelled findings
(``candidate, before, after, path, label``); by default on :func:`labelled_findings`, which writes secrets of common kinds and what
scanners mistake for them. The dictionary is the whole words of a public tokenizer's vocabulary (its path is a parameter).

DataFrame functions and Spark's own forest only; a text stays in the JVM. All patterns are linear in the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, whole_row

RUN = r"[A-Za-z0-9_+/=.\-]{16,}"
_NAME = r"(?i:secret|token|passw|pwd|credential|api_?key|auth|private_?key|access_?key)"
_SET = r"""(?::=|=>|=|:)"""
#: A key-like name and its assignment at the end of a word; a name alone; a whole assignment within a word: what leads to the value, and the value.
_ENDS, _NAMED = rf"""{_NAME}[\w\-]{{0,40}}["']?{_SET}["'`]?$""", rf"""{_NAME}[\w\-]{{0,40}}["']?$"""
_INLINE = rf"""((?:^|[^\w\-])[\w\-]{{0,40}}?{_NAME}[\w\-]{{0,40}}["']?{_SET}["'`]?)([^\s"'`,;]{{6,}})"""
#: Labelled findings that the default forest is fitted on; words on either side of a candidate that it looks at, and characters of them.
FINDINGS, NEAR, AROUND = 6000, 3, 80
TREES, DEPTH = 30, 9
#: Letters of a dictionary word, at least and at most.
LEAST, MOST = 4, 12
#: Bytes of findings up to which they are sent to every task; more are joined by shuffle.
SENT = 8_000_000

_HOT = "secret|token|passw|pwd|credential|auth|bearer|private|access|api|apikey|key|signature|login"
_COLD = "commit|sha|sha1|sha256|md5|checksum|digest|hash|etag|revision|uuid|guid|phone|call|card|isbn|order|invoice|version|build|at|see|page|url|file|path|image|id|ref|example"
FEATURES = ["length", "digits", "upper", "lower", "marks", "hex", "runs", "vowels", "distinct", "dictionary", "slashes", "dots", "dashes", "extension", "path_test", "path_config", "hot", "cold", "hot_after", "cold_after", "assigned", "only_digits", "prefix", "placeholder"]


def dictionary(spark: SparkSession, path: str | None = None) -> DataFrame:
    """``word``: the whole lower-case words of a tokenizer file, at most some ten thousand."""
    table = spark.read.text(path or f"file://{public_tokenizers.path('word_bpe_49k.json')}", wholetext=True)
    vocabulary = F.from_json("value", "model struct<vocab: map<string, int>>")["model"]["vocab"]
    token = table.select(F.explode(F.map_keys(vocabulary)).alias("token")).where(F.col("token").rlike(f"^[a-z]{{{LEAST},{MOST}}}</w>$"))
    return token.select(F.regexp_replace("token", "</w>", "").alias("word")).distinct()


def coverage(candidates: DataFrame, words: DataFrame) -> DataFrame:
    """``candidate, covered``: by distinct candidate, how many of its characters stand in some dictionary word."""
    # Overlapping stretches of letters, so that the work grows with the length of a candidate, not with its square.
    stretch = F.regexp_extract_all(F.lower("candidate"), F.lit(rf"(?=([a-z]{{{LEAST},{63 + MOST}}}))[a-z]{{1,64}}"), 1)
    parts = candidates.select("candidate").distinct().select("candidate", F.posexplode(stretch).alias("nth", "part"))
    starts = parts.select("candidate", "nth", "part", F.explode(F.sequence(F.lit(1), F.least(F.lit(64), F.length("part") - LEAST + 1))).alias("i"))
    tried = starts.select("candidate", (F.col("nth") * 64 + F.col("i")).alias("at"), F.explode(F.transform(F.sequence(F.lit(LEAST), F.least(F.lit(MOST), F.length("part") - F.col("i") + 1)), lambda n: F.substring("part", F.col("i"), n))).alias("word"))
    found = tried.join(F.broadcast(words), "word")  # some ten thousand words
    letters = found.select("candidate", F.explode(F.sequence(F.col("at"), F.col("at") + F.length("word") - 1)).alias("letter")).distinct()
    return letters.groupBy("candidate").agg(F.count("*").alias("covered"))


def _share(pattern: str, of: str = "candidate") -> Column:
    return F.regexp_count(of, F.lit(pattern)) / F.length(of)


def with_features(findings: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """Adds the features to ``candidate, before, after, path`` (the words around a candidate, and the file it is in)."""
    findings = findings.join(coverage(findings, dictionary(findings.sparkSession) if words is None else words), "candidate", "left")
    c, before, after, path = F.col("candidate"), *(F.lower(F.coalesce(x, F.lit(""))) for x in ("before", "after", "path"))
    flag = lambda x: x.cast("double")
    named = lambda x: F.regexp_count(x, F.lit(f"(?:{_HOT})")).cast("double")
    other = lambda x: F.regexp_count(x, F.lit(rf"\b(?:{_COLD})\b")).cast("double")
    columns = {
        "length": F.least(F.length(c), F.lit(200)).cast("double"), "digits": _share("[0-9]"), "upper": _share("[A-Z]"), "lower": _share("[a-z]"), "marks": _share("[^A-Za-z0-9]"),
        "hex": flag(c.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")), "runs": _share("[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+"), "vowels": _share("[aeiouAEIOU]"),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / F.least(F.length(c), F.lit(64)), "dictionary": F.coalesce("covered", F.lit(0)) / F.length(c),
        "slashes": F.regexp_count(c, F.lit("/")).cast("double"), "dots": F.regexp_count(c, F.lit(r"\.")).cast("double"), "dashes": F.regexp_count(c, F.lit("-")).cast("double"),
        "extension": flag(c.rlike(r"\.[A-Za-z]{2,5}$")), "path_test": flag(path.rlike("test|doc|example|fixture|sample|readme")), "path_config": flag(path.rlike(r"\.env|conf|secret|credential|setting|deploy|\.ya?ml|\.ini")),
        "hot": named(before), "cold": other(before), "hot_after": named(after), "cold_after": other(after),
        "assigned": flag(before.rlike("[=:][^a-z0-9]*$")), "only_digits": flag(c.rlike(r"^[0-9.\-]+$")),
        "prefix": flag(c.rlike("^(?:AKIA|ASIA|gh[pousr]_|sk_live_|sk-|xox[abp]-|eyJ|AIza|glpat-)")),
        "placeholder": flag(F.lower(c).rlike(r"your|example|changeme|dummy|xxxx|0000|1234|placeholder|\$\{|<|process\.env|os\.environ|test_")),
    }
    return findings.withColumns({k: v.cast("double") for k, v in columns.items()}).drop("covered")


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """``n`` labelled findings, always the same ones: half secrets, half what is mistaken for them."""
    r = spark.range(n, numPartitions=4)
    raw = lambda salt: F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    b62 = F.translate(F.base64(F.unhex(F.concat(raw("a"), raw("b")))), "+/=", "xQ7")
    b64 = F.translate(F.base64(F.unhex(raw("c"))), "=", "")
    digits = F.translate(raw("d"), "abcdef", "482917")
    pick = lambda salt, values: F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(len(values))) + 1).cast("int"))
    plain = lambda salt: pick(salt, ["of", "lorem", "tatira", "onen", "and", "que", "the", "erlon", "verde", "sich", "haben", "leur", "para", "dans", "is", "was"])
    hot = F.concat(plain("p"), F.lit(" "), pick("h", ["token", "api_key", "secret", "password", "access_token", "client_secret", "auth_token", "aws_secret_access_key", "SECRET_KEY", "private_key", "Authorization", "apikey", "passwd", "API_TOKEN", "db_password"]), pick("s", [' = "', "=", ': "', " = '", ": ", '="', ": bearer ", " = "]))
    cold = F.concat(plain("p"), F.lit(" "), pick("c", ["commit ", "sha1 ", "sha256: ", "checksum = ", "md5 ", "digest ", "etag ", "revision ", "hash: ", "uuid = ", "id: ", "card ", "order ", "isbn ", "phone: "]))
    nothing = F.concat(plain("p"), F.lit(" "), plain("q"), F.lit(" "), plain("r"), F.lit(" "))
    part = lambda text, a, b: F.substring(text, F.lit(1), (F.pmod(F.xxhash64(F.lit("l"), "id"), F.lit(b - a + 1)) + a).cast("int"))
    word = lambda salt: pick(salt, ["user", "session", "report", "create", "update", "index", "module", "service", "order", "image", "config", "section", "thinking", "erthandor", "ouvement", "ciones", "hunter", "dragon", "summer", "monkey", "harbour", "window"])
    named = F.concat(word("1"), pick("2", ["_", "-", "."]), word("3"), pick("2", ["_", "-", "."]), word("4"), pick("5", ["2", "_v2", "-2024", "10", "_001"]))
    filed = F.concat(word("1"), F.lit("/"), word("3"), F.lit("/v2/"), word("4"), pick("6", [".html", ".java", ".png", ".json", ".txt", ""]))
    password = F.concat(F.initcap(word("1")) if n < 0 else word("1"), pick("y", ["", "!", "#", "_", "@", "$"]), part(digits, 1, 4), pick("z", ["", "!", "pass", "X", "?", "%"]))
    good = [  # candidate, words before it
        (part(raw("e"), 32, 64), hot), (part(raw("e"), 40, 40), hot), (F.concat(F.lit("AKIA"), F.upper(part(raw("f"), 16, 16))), pick("w", [0, 1]).cast("string")),
        (F.concat(pick("g", ["ghp_", "sk_live_", "sk-", "xoxb-", "glpat-", "AIza"]), part(b62, 24, 40)), F.when(F.pmod("id", F.lit(3)) == 0, nothing).otherwise(hot)),
        (part(b64, 32, 43), hot), (part(b62, 20, 48), hot), (F.concat(F.lit("eyJ"), part(b62, 20, 40), F.lit("."), b62), F.when(F.pmod("id", F.lit(2)) == 0, nothing).otherwise(hot)),
        (password, hot), (F.concat(part(b62, 5, 9), pick("z", ["!", "#", "7", "$9", "%"])), hot), (F.upper(part(raw("e"), 40, 40)), hot),
    ]
    bad = [
        (part(digits, 16, 19), nothing), (part(digits, 16, 16), cold), (part(raw("e"), 32, 64), cold), (part(raw("e"), 40, 40), cold), (named, nothing), (named, hot), (filed, nothing), (filed, cold),
        (F.regexp_replace(part(raw("e"), 32, 32), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), F.when(F.pmod("id", F.lit(2)) == 0, nothing).otherwise(cold)),
        (F.concat(pick("x", ["your_token_here_", "xxxxxxxxxxxxxxxx", "example_secret_", "changeme_password_", "0000000000000000", "test_token_value_"]), F.lit("1")), hot),
        (F.concat(F.lit("2024-0"), part(digits, 1, 1), F.lit("-11T10:"), F.substring(digits, 5, 2), F.lit(":00")), nothing),
        (F.concat(F.lit("user."), part(digits, 2, 4), F.lit("mail.example.com")), nothing),
        (F.concat(pick("x", ["${", "<", "process.env.", "os.environ."]), word("3"), F.lit("_"), part(digits, 1, 1), pick("x", ["}", ">", "", ""])), hot),
        (F.concat(word("1"), pick("2", ["-", ".", "_"]), word("4"), pick("x", [".", "!", "", "()"])), hot),
    ]

    def choose(rows: list, at: int) -> Column:
        out = F.lit(None).cast("string")
        kind = F.pmod(F.xxhash64(F.lit("kind"), "id"), F.lit(len(rows)))
        for i, row in enumerate(rows):
            out = F.when(kind == i, row[at]).otherwise(out)
        return out

    label = F.pmod("id", F.lit(2)).cast("double")
    mixed = r.select("id", label.alias("label"), *(F.when(label == 1, choose(good, i)).otherwise(choose(bad, i)).alias(c) for i, c in enumerate(("candidate", "before"))))
    after = F.concat(plain("t"), F.lit(" "), F.when(F.pmod(F.xxhash64(F.lit("u"), "id"), F.lit(8)) == 0, F.when(label == 1, pick("v", ["login", "key", "api"])).otherwise(pick("v", ["commit", "checksum", "version"]))).otherwise(plain("u")))
    tested = F.pmod(F.xxhash64(F.lit("path"), "id"), F.lit(20)) < F.when(label == 1, 1).otherwise(4)
    path = F.when(F.pmod(F.xxhash64(F.lit("none"), "id"), F.lit(2)) == 0, None).when(tested, pick("j", ["tests/fixtures/a.json", "docs/example.md", "README.md"])).otherwise(pick("k", ["src/app.py", "config/prod.env", "deploy/settings.yml", "src0", "notes"]))
    return mixed.withColumn("after", after).withColumn("path", path).drop("id")


def _assemble(findings: DataFrame, words: DataFrame | None) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(findings, words))


def train(findings: DataFrame, seed: int = 9, words: DataFrame | None = None, scratch: Scratch | None = None) -> RandomForestClassificationModel:
    """The forest on labelled findings (``candidate, before, after, path, label``), whose features are written once, as fitting reads them often."""
    scratch = scratch or Scratch(findings.sparkSession, "forest")
    rows = scratch.cut(_assemble(findings, words).select("features", "label", F.xxhash64("candidate", "before", "after").alias("at")).coalesce(2).sortWithinPartitions("at"))
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed).fit(rows)


def candidates(docs: DataFrame, *, text: str = "text", path: str | None = None) -> DataFrame:
    """``row`` (a struct of the other columns of ``docs``), ``of`` (two hashes of the text), ``word`` (place among white-space separated words), ``candidate, before, after, path``."""
    t = F.col(f"`{text}`").cast("string")
    where = F.col(f"`{path}`").cast("string") if path else F.lit(None).cast("string")
    given = docs.where(t.rlike(f"{RUN}|{_NAME}")).select(whole_row(docs.drop(text)).alias("row"), _text_key(t).alias("of"), where.alias("path"), F.split(t, r"[\x20\x09-\x0D]+").alias("words"))
    nth = lambda i: F.get("words", i)
    announced = lambda i: nth(i - 1).rlike(_ENDS) | (nth(i - 1).rlike(f"^{_SET}$") & nth(i - 2).rlike(_NAMED))
    at = F.transform("words", lambda w, i: F.struct(i.alias("i"), w.alias("w"), F.coalesce(announced(i) & w.rlike("[^A-Za-z]"), F.lit(False)).alias("told")))
    at = F.filter(at, lambda x: x["told"] | (x["w"].rlike(RUN) & x["w"].rlike("[0-9]")) | x["w"].rlike(_INLINE))
    found = given.select("row", "of", "path", "words", F.explode(at).alias("x"))
    last, first = (lambda x: F.right(x, F.lit(AROUND))), (lambda x: F.left(x, F.lit(AROUND)))
    before = last(F.concat_ws(" ", F.transform(F.slice("words", F.greatest(F.col("x.i") - NEAR, F.lit(0)) + 1, F.least(F.col("x.i"), F.lit(NEAR))), last)))
    after = first(F.concat_ws(" ", F.transform(F.slice("words", F.col("x.i") + 2, F.lit(NEAR)), first)))
    found = found.select("row", "of", "path", F.col("x.i").alias("word"), F.col("x.w").alias("w"), F.col("x.told").alias("told"), before.alias("before"), after.alias("after"))
    pairs = lambda pattern: F.arrays_zip(F.regexp_extract_all("w", F.lit(pattern), 1).alias("lead"), F.regexp_extract_all("w", F.lit(pattern), 2).alias("c"))
    value = F.regexp_extract("w", r"""^["'`({\[]*([^"'`\s]*)""", 1)
    quoted = F.array(F.struct(F.regexp_extract("w", r"""^["'`({\[]*""", 0).alias("lead"), F.regexp_replace(value, r"[,;.)\]}]{1,9}$", "").alias("c")))
    pieces = F.when(F.col("told"), quoted).when(F.col("w").rlike(_INLINE), pairs(_INLINE)).otherwise(pairs(rf"([^A-Za-z0-9]{{0,24}})({RUN})"))
    found = found.select("row", "of", "path", "word", "before", "after", "told", F.explode(pieces).alias("p"))
    name = F.regexp_extract("p.c", r"^([A-Za-z_][A-Za-z0-9_.\-]{0,63}=)[^=]", 1)
    found = found.withColumn("candidate", F.substring(F.col("p.c"), F.length(name) + 1, F.length("p.c")))
    found = found.where((F.length("candidate") >= 6) & F.col("candidate").rlike("[^A-Za-z]"))
    return found.select("row", "of", "word", "candidate", last(F.concat(F.concat_ws(" ", F.when(F.col("before") != "", F.col("before")), "p.lead"), name)).alias("before"), "after", "path")


def _text_key(t: Column) -> Column:
    return F.struct(F.xxhash64(t).alias("a"), F.xxhash64(F.lit(17), t).alias("b"))


def scan(
    docs: DataFrame, *, model: RandomForestClassificationModel | None = None, text: str = "text", path: str | None = None, threshold: float = 0.4, words: str | None = None, scratch: Scratch | None = None
) -> DataFrame:
    """One row for each candidate of each row of ``docs``: ``row, of, word, candidate, score, secret``.

    ``row`` holds the columns of ``docs`` but the text, ``of`` two hashes of the text. Null or empty text has no candidates; null
    ids and repeated rows are scanned row by row; no rows give no rows. ``words``: path of the tokenizer file of the dictionary.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "secrets")
    known = scratch.cut(dictionary(spark, words).coalesce(1))
    model = model or train(labelled_findings(spark), words=known, scratch=scratch)
    found = scratch.cut(candidates(docs, text=text, path=path))
    score = vector_to_array("probability")[1]
    return model.transform(_assemble(found, known)).select("row", "of", "word", "candidate", score.alias("score"), (score >= threshold).alias("secret"))


def redact(docs: DataFrame, *, text: str = "text", mark: str = "[secret]", scratch: Scratch | None = None, **options) -> DataFrame:
    """``docs`` with every secret replaced by ``mark`` wherever it stands in its text; all rows and columns stay.

    What is a secret is decided by text (and path); rows of one text share their findings, and no row needs an id.
    """
    scratch = scratch or Scratch(docs.sparkSession, "redact")
    found = scan(docs, text=text, scratch=scratch, **options).where("secret").select("of", "candidate").groupBy("of").agg(F.collect_set("candidate").alias("found"))
    found = scratch.cut(found)
    held = found.agg(F.sum(F.length(F.array_join("found", " ")) + 64)).first()[0] or 0
    t = F.col("given")[text].cast("string")
    longest = F.array_sort("found", lambda a, b: F.length(b) - F.length(a))
    clean = F.aggregate(longest, t, lambda x, s: F.replace(x, s, F.lit(mark)))
    joined = docs.select(whole_row(docs).alias("given")).withColumn("of", _text_key(t)).join(F.broadcast(found) if held <= SENT else found, "of", "left")
    return joined.select(F.when(F.col("found").isNull(), F.col("given")).otherwise(F.col("given").withField(f"`{text}`", clean)).alias("given")).select("given.*")
