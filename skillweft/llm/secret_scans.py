"""Secret scans with a random forest that removes false positives.

Candidates are found by one regular expression: values assigned to words such as
``password`` or ``token``, provider formats, private keys, and tokens of twelve
or more characters that hold a digit.  A private key runs from its BEGIN to its END line
or, without one, to the end of the base64 block.  Each candidate is described by its length, its
character classes and transitions between them, how common its letter pairs are, how
much of it dictionary words cover, the path (source) of its document and the words
beside it.  A random forest trained on labelled findings decides which are secrets; a
private key with its body always is one.  Labels come from a table of findings, where
one is given, and for all others from formats that tell what they are.

Everything is column expressions and the forest of ``pyspark.ml``.  Training takes a
bounded sample of labelled candidates: the ``train_rows`` with the smallest hash.
Candidates with their features are stored once and read for training and scoring.

Cases: null or empty texts have no candidates; without labelled findings nothing is a
secret, with one class only every candidate has that class; a null path is an empty
one; candidates never overlap; repeated rows are scanned once and each redacted; a
null ``doc_id`` is an id like any other; U+0001 in a text is looked at as U+0002 but
stays in the redacted text; other columns stay as they are when texts are redacted.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from skillweft.llm.components import stored

# What names a secret, what names an example, common words and letter pairs.
SECRET_WORDS = "password passwd pwd secret token apikey api_key api-key access_key access-key auth bearer".split()
EXAMPLE_WORDS = "example sample dummy placeholder changeme test fake your xxxx redacted".split()
COMMON_WORDS = (
    "the and for that with this from have are was not you all can had her his one our out day get has him how man "
    "new now old see two way who boy did its let put say she too use mail http https www com org net html user "
    "name file path data test example sample page time date version license"
).split()
COMMON_PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch".split()

_TOKEN = r"A-Za-z0-9+/_.@\-"
_ASSIGNED = r"(?i:" + "|".join(SECRET_WORDS) + r")[\"']?[ ]{0,2}[:=][ ]{0,2}[\"']?"
# a value goes on past symbols, but not into the next name or the punctuation around it
_VALUE_END = r"[,;&|]\w*[=:]|[,;:)\]}>]++(?:[\s\"']|$)|<|\\[\"'nrt]"
_KEY_NAME = r"[A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
_GAP = r"(?:[\s\"'+>#|,]|\\[nrt])"  # between the lines of a key, which may stand in a string or a comment
# groups are possessive: those are matched without recursion, however long the key is
_TO_END = rf"(?:[^-]++|-(?!----))*+-----END {_KEY_NAME}"
_KEY_BLOCK = (
    rf"(?:{_GAP}*+(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset): [^\n\\]*+)*+"
    rf"(?:{_GAP}*+[A-Za-z0-9+/]{{16,}}+={{0,2}})++(?:{_GAP}*+[A-Za-z0-9+/]++={{0,2}}(?=[ ]*(?:\n|\r|$|[\"']|\\[nr])))?"
)
PATTERN = (
    rf"-----BEGIN {_KEY_NAME}(?:{_TO_END}|{_KEY_BLOCK})?"
    rf"|(?<=[:=\"' ])(?<=[ \"']?{_ASSIGNED})(?=[A-Za-z+/_.@\-]*+[0-9])(?=[{_TOKEN}]{{12}})(?:(?!{_VALUE_END})[^\s\"'])++"
    rf"|(?<![{_TOKEN}])(?:(?=[A-Za-z+/_.@\-]*+[0-9])[{_TOKEN}]{{12,}}+={{0,2}}|AKIA[A-Z]{{16}}(?![{_TOKEN}]))"
    rf"|(?<=[:=\"' ])(?<=[ \"']?{_ASSIGNED})[^\s\"']{{6,}}+"
)
_MAY_HOLD = r"[0-9:=]|AKIA|PRIVATE KEY"
_MARK = "\x01"

FEATURES = [
    "length", "digits", "uppers", "lowers", "symbols", "distinct", "changes", "pairs", "coverage", "hex", "dots",
    "at_sign", "assigned", "quoted", "secret_word_before", "example_beside", "example_path", "provider",
]


def _times(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("double")


def features(value: Column, before: Column, after: Column, path: Column) -> dict[str, Column]:
    """Description of a candidate; ``before`` and ``after`` are the texts beside it."""
    length = F.char_length(value).cast("double")
    words = F.char_length(F.regexp_replace(F.lower(value), "|".join(sorted(COMMON_WORDS, key=len, reverse=True)), ""))
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[A-Z]+", "A"), "[a-z]+", "a"), "[0-9]+", "9")
    letters = F.greatest(_times(F.lower(value), "[a-z](?=[a-z])"), F.lit(1.0))
    near = F.lower(F.concat(F.right(before, F.lit(40)), F.lit(" "), value, F.lit(" "), F.left(after, F.lit(40))))
    return {
        "length": length,
        "digits": _times(value, "[0-9]") / length,
        "uppers": _times(value, "[A-Z]") / length,
        "lowers": _times(value, "[a-z]") / length,
        "symbols": _times(value, "[^A-Za-z0-9]") / length,
        "distinct": F.size(F.array_distinct(F.split(value, ""))).cast("double") / length,
        "changes": F.char_length(classes).cast("double") / length,
        "pairs": _times(F.lower(value), "(?=" + "|".join(COMMON_PAIRS) + ")") / letters,
        "coverage": (length - words) / length,
        "hex": _flag(value.rlike("^[0-9a-fA-F]+$")),
        "dots": _times(value, r"\."),
        "at_sign": _flag(F.instr(value, "@") > 0),
        "assigned": _flag(before.rlike(r"[:=][ ]{0,2}[\"']?$")),
        "quoted": _flag(before.rlike("[\"']$") & after.rlike("^[\"']")),
        "secret_word_before": _flag(
            F.lower(F.right(before, F.lit(40))).rlike("(" + "|".join(SECRET_WORDS) + r")[^\n]{0,12}$")
        ),
        "example_beside": _flag(near.rlike("|".join(EXAMPLE_WORDS))),
        "example_path": _flag(F.lower(path).rlike("test|example|sample|fixture|doc")),
        "provider": _flag(value.rlike(r"^(AKIA[0-9A-Z]{16}|gh[pousr]_\w{36,}|xox[abprs]-.{10,}|-----BEGIN [\s\S]*)$")),
    }


def rule_label() -> Column:
    """Findings whose format alone tells what they are: 1 secret, 0 something else, else null.

    Secrets: provider formats, private keys, and values assigned to a secret word that are
    hexadecimal or, without an example word or path beside them, mix three of upper case,
    lower case, digits and symbols and are mostly not made of common words.  Not secrets:
    plain numbers, network and mail addresses, versions and links.
    """
    value = F.col("value")
    kinds = sum((F.col(c) > 0).cast("int") for c in ("uppers", "lowers", "digits", "symbols"))
    mixed = (kinds >= 3) & (F.col("length") >= 8) & (F.col("coverage") < 0.5) & (F.col("example_beside") == 0) \
        & (F.col("example_path") == 0) & ~value.rlike(r"^[^@]+@[^@]+\.[a-z]+$") & ~value.rlike(r"://|^www\.")
    secret = (F.col("provider") == 1) | (
        (F.col("assigned") == 1) & (F.col("secret_word_before") == 1)
        & (((F.col("hex") == 1) & (F.col("digits") < 1)) | mixed)
    )
    other = value.rlike(r"^[0-9.+/\-]+$") | value.rlike(r"^[^@]+@[^@]+\.[a-z]+$") | value.rlike(r"^(www\.|https?)")
    return F.when(secret, 1).when(other, 0)


def running_starts(lengths: Column, block: int = 256) -> Column:
    """What the lengths before each one add up to, block by block: an array grows by copies, so short ones are grown."""

    def grow(values: Column, start: Column) -> Column:
        return F.aggregate(
            values, F.array(start.cast("bigint")), lambda seen, n: F.array_append(seen, F.element_at(seen, -1) + n)
        )

    blocks = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(lengths) - 1, F.lit(0)), F.lit(block)),
        lambda at: F.slice(lengths, at + 1, F.lit(block)),
    )
    sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda a, n: a + n))
    starts = F.transform(
        F.arrays_zip(blocks.alias("b"), grow(sums, F.lit(0)).alias("s")),
        lambda x: F.slice(grow(x["b"], x["s"]), F.lit(1), F.size(x["b"])),
    )
    return F.flatten(F.filter(starts, lambda x: x.isNotNull()))


def candidates(docs: DataFrame, path: str | None = "source") -> DataFrame:
    """``doc_id``, ``text_key``, ``start`` (code points before it), ``value`` and the features."""
    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path in docs.columns else F.lit("")
    rows = docs.select("doc_id", "text", where.alias("path")).filter(F.col("text").rlike(_MAY_HOLD))
    marked = F.regexp_replace(F.replace("text", F.lit(_MARK), F.lit("\x02")), PATTERN, _MARK + "$0" + _MARK)
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_key"), "path", F.split(marked, _MARK).alias("parts"))
    rows = rows.filter(F.size("parts") > 1)
    # every second part is a candidate; parts' lengths add up to its place
    rows = rows.withColumn("starts", running_starts(F.transform("parts", F.char_length)))
    each = F.transform(
        F.sequence(F.lit(1), F.size("parts") - 1, F.lit(2)),
        lambda i: F.struct(
            F.get("starts", i).alias("start"), F.get("parts", i).alias("value"),
            F.get("parts", i - 1).alias("before"), F.get("parts", i + 1).alias("after"),
        ),
    )
    found = rows.select("doc_id", "text_key", "path", F.explode(each).alias("c")).select(
        "doc_id", "text_key", "path", "c.*"
    )
    return found.select(
        "doc_id", "text_key", "start", "value",
        *[c.alias(n) for n, c in features(F.col("value"), F.col("before"), F.col("after"), F.col("path")).items()],
    )


def train(labelled: DataFrame, trees: int = 20, depth: int = 6, train_rows: int = 20_000):
    """Forest from candidates with a column ``label``, or the only label there is (None without any)."""
    sample = labelled.filter("label is not null").withColumn("label", F.col("label").cast("double"))
    sample = sample.orderBy(F.xxhash64("doc_id", "start", "value"), "doc_id", "start", "value").limit(train_rows)
    sample = VectorAssembler(inputCols=FEATURES, outputCol="vector").transform(sample).select("vector", "label")
    seen = [r["label"] for r in sample.select("label").distinct().collect()]
    if len(seen) < 2:
        return seen[0] if seen else None
    forest = RandomForestClassifier(
        featuresCol="vector", labelCol="label", numTrees=trees, maxDepth=depth, seed=11, subsamplingRate=1.0,
    )
    return forest.fit(sample)


def score(found: DataFrame, model) -> DataFrame:
    """Candidates with ``probability`` of being a secret."""
    if model is None or isinstance(model, float):
        return found.withColumn("probability", F.lit(model or 0.0))
    rows = VectorAssembler(inputCols=FEATURES, outputCol="vector").transform(found)
    rows = model.transform(rows).withColumn("probability", vector_to_array("probability")[1])
    return rows.drop("vector", "rawPrediction", "prediction")


def _labels(found: DataFrame, labelled: DataFrame | None) -> DataFrame:
    """Candidates with ``given``, the label of the table (null without one), and ``label`` to learn from."""
    if labelled is None:
        return found.withColumns({"given": F.lit(None).cast("int"), "label": rule_label()})
    known = labelled.filter("label is not null").groupBy(
        F.col("doc_id").alias("known_doc"), F.col("value").alias("known_value")
    ).agg(F.max(F.col("label").cast("int")).alias("given"))
    same = found["doc_id"].eqNullSafe(known["known_doc"]) & (found["value"] == known["known_value"])
    return found.join(known, same, "left").drop("known_doc", "known_value").withColumn(
        "label", F.coalesce("given", rule_label())
    )


def scan_secrets(
    docs: DataFrame, path: str | None = "source", threshold: float = 0.5, labelled: DataFrame | None = None
) -> DataFrame:
    """All candidates: ``doc_id``, ``text_key``, ``start``, ``length``, ``value``, ``probability``, ``secret``.

    ``labelled`` holds findings judged before: ``doc_id``, ``value`` and ``label`` (1 secret,
    0 something else; 1 where both are given).  They go before the labels of ``rule_label``
    in training and keep their label.
    """
    found = stored(candidates(docs, path).distinct(), "secret-candidates")
    found = _labels(found, labelled)
    scored = score(found, train(found))
    whole_key = F.when(F.col("value").rlike(r"^-----BEGIN [^-]*-----[\s\S]"), True)
    return scored.select(
        "doc_id", "text_key", "start", F.col("length").cast("bigint").alias("length"), "value", "probability",
        F.coalesce(F.col("given") == 1, whole_key, F.col("probability") >= threshold).alias("secret"),
    )


def redact_secrets(
    docs: DataFrame, path: str | None = "source", replacement: str = "[SECRET]", labelled: DataFrame | None = None
) -> DataFrame:
    """``docs`` with every secret replaced; ``n_chars``, where there is one, follows the text."""
    spans = scan_secrets(docs, path, labelled=labelled).filter("secret").groupBy("doc_id", "text_key").agg(
        F.array_sort(F.collect_set(F.struct("start", "length"))).alias("spans")  # of one text
    ).select(F.col("doc_id").alias("span_doc"), F.col("text_key").alias("span_key"), "spans")
    names = docs.columns
    rows = docs.select(F.struct(*names).alias("row"))  # apart from the columns added here
    text = F.col("row.text")
    rows = rows.join(
        spans, F.col("row.doc_id").eqNullSafe(F.col("span_doc")) & (F.xxhash64(text) == F.col("span_key")), "left"
    )

    def end(i: Column) -> Column:
        span = F.get("spans", i)
        return F.coalesce((span["start"] + span["length"]).cast("int"), F.lit(0))

    kept = F.transform(
        "spans",
        lambda s, i: F.concat(
            F.substr(text, end(i - 1) + 1, s["start"].cast("int") - end(i - 1)), F.lit(replacement)
        ),
    )
    rest = F.substr(text, end(F.size("spans") - 1) + 1)
    clean = F.when(F.col("spans").isNull(), text).otherwise(F.concat(F.array_join(kept, ""), rest))
    rows = rows.withColumn("clean", clean)
    columns = []
    for name in names:
        if name == "text":
            columns.append(F.col("clean").alias("text"))
        elif name == "n_chars":
            changed = F.char_length("clean").cast(docs.schema["n_chars"].dataType)
            columns.append(F.when(F.col("spans").isNull(), F.col("row.n_chars")).otherwise(changed).alias("n_chars"))
        else:
            columns.append(F.col("row")[name].alias(name))
    return rows.select(*columns)
