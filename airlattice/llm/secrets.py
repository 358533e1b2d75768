"""Secret scans: candidates by pattern, a random forest to drop false positives. Spark functions only.

A candidate is a run of at least ``SHORTEST`` key-like characters, or a shorter one assigned to a name for secrets.
Only runs of plain words that are neither a known key shape nor assigned to such a name are passed over. Its features are its
length, transitions between character classes, how much of it dictionary words cover, its
path, and the words beside it. Labelled findings train the forest; what it rates at ``CUT`` or more
is a secret, as are known key shapes and quoted passwords whatever it rates them. The dictionary holds the words that make up at least a ``DICTIONARY``-th of
all words of the corpus, so it has at most that many entries.

Defined cases: null and empty texts have no candidate; a null path is the empty path; without labelled findings of
both kinds the rules alone decide (probability 1 or 0, 0.5 where they are silent); rows without an id and
repeated rows are scanned like any others; equal candidates in one text are separate findings; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlattice.llm.common import Scratch, unused

SHORTEST = 12
CUT = 0.5
DICTIONARY = 20_000
PER_CLASS = 10_000     # labelled findings per class that train the forest
TREES, DEPTH = 40, 6
PART = 256             # runs of a text that are looked at together
LEFT, RIGHT = 48, 24   # characters looked at beside a candidate
MASK = "[SECRET]"
# Words that name a secret, words that mark an example, known key shapes.
NAMES = "token|secret|passw(or)?d|passwd|pwd|api[_-]?key|apikey|access[_-]?key|auth|bearer|credential|private|pass[_-]?phrase"
PASSWORDS = "passw(or)?d|passwd|pwd|pass[_-]?phrase"
EXAMPLES = "(?<![a-z])((examples?|samples?|dummy|placeholder|changeme|tests?|testing)(?![a-z])|your[_-])|xxxx"
SHAPES = "^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+[.][A-Za-z0-9_-]+)$"
CHARS = "A-Za-z0-9+/_.@-"
ASSIGNED = "[\"'`]?\\s{0,2}[:=]>?\\s{0,2}[\"'`]?"
# Padding is no padding where a value follows. The cheap look back comes before the one for names.
KEYLIKE = (f"[{CHARS}]{{{SHORTEST},}}+(?:={{1,2}}(?![=\"'`{CHARS}]))?"
           f"|(?<![{CHARS}])(?<=[:=>]\\s{{0,2}}[\"'`]?)(?<=(?i:{NAMES}){ASSIGNED})[{CHARS}]{{4,{SHORTEST - 1}}}+")
WORD = "(?:[A-Z]?[a-z]++(?:[A-Z][a-z]{2,}+)*+|[A-Z]++)"
PLAIN = f"^[+/_.@=-]*+(?:{WORD}(?:[+/_.@=-]++{WORD})*+[+/_.@=-]*+)?+$"   # words and nothing else
FEATURES = ["size", "transitions", "distinct", "digits", "uppers", "punctuation", "hexadecimal", "numeric", "address",
            "coverage", "assigned", "quoted", "named", "example", "path_depth", "path_size", "path_example"]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): lower-cased letter words of three letters and more over all texts."""
    words = docs.select(F.explode(F.split(F.lower("text"), "[^\\p{L}]+")).alias("word")).where(F.length("word") >= 3)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def candidates(docs: DataFrame, *keep: str) -> DataFrame:
    """Every candidate: kept columns, path, start (0-based character), value, left and right context.

    The text is split at the runs, so the pieces between them give both offsets and neighbours; the run
    before a candidate may name it and belongs to its left context.
    """
    runs = (docs.withColumn("run", F.regexp_extract_all("text", F.lit(KEYLIKE), F.lit(0))).where(F.size("run") > 0)
            .withColumn("piece", F.split("text", KEYLIKE, -1)))
    # A text with very many runs comes in parts of a bounded number of them; a part knows its offset and the run before it.
    parts = runs.select(*keep, "path", F.expr(
        f"transform(sequence(0, (size(run) - 1) div {PART}), c -> named_struct('run', slice(run, c * {PART} + 1, {PART}), "
        f"'piece', slice(piece, c * {PART} + 1, {PART} + 1), 'before', if(c = 0, '', run[greatest(c * {PART}, 1) - 1])))").alias("part"))
    sizes = F.expr(f"transform(part, p -> aggregate(p.run, 0L, (n, s) -> n + length(s)) + aggregate(slice(p.piece, 1, {PART}), 0L, (n, s) -> n + length(s)))")
    parts = parts.select(*keep, "path", "part", sizes.alias("sizes")).select(*keep, "path", F.explode(F.expr(
        "transform(part, (p, c) -> named_struct('p', p, 'at', aggregate(slice(sizes, 1, c), 0L, (n, s) -> n + s)))")).alias("_part"))
    parts = parts.select(*keep, "path", F.col("_part.at").alias("at"), "_part.p.*")
    before = F.expr("at + aggregate(sequence(0, pos), 0L, (n, i) -> n + length(piece[i]) + if(i < pos, length(run[i]), 0))")
    return (parts.select(*keep, "path", "at", "run", "piece", "before", F.posexplode("run").alias("pos", "value"))
            .withColumn("left", F.expr(f"right(concat(if(pos > 0, run[greatest(pos, 1) - 1], before), piece[pos]), {LEFT})"))
            .where(~F.col("value").rlike(PLAIN) | F.col("value").rlike(SHAPES) | (_assigned() & _named()))
            .select(*keep, "path", before.alias("start"), "value", "left",
                    F.expr(f"left(piece[pos + 1], {RIGHT})").alias("right")))


def _assigned() -> Column:
    return F.col("left").rlike("[:=]>?\\s*[\"'`]?$")


def _named() -> Column:
    return F.lower("left").rlike(f"({NAMES})[^\\n]{{0,16}}$")


def _sure() -> Column:
    """Known key shapes, and quoted values assigned to a name for passwords that nothing marks as an example."""
    return F.col("value").rlike(SHAPES) | (
        F.lower("left").rlike(f"({PASSWORDS})[\"'`]?\\s*[:=]>?\\s*[\"'`]$") & (F.col("quoted") == 1) & (F.col("example") == 0))


def _share(value: Column, chars: str) -> Column:
    return F.length(F.regexp_replace(value, f"[^{chars}]", "")) / F.length(value)


def featured(found: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates with their features; ``known`` is the dictionary (word)."""
    pieces = found.select("value").distinct().select(
        "value", F.explode(F.filter(F.split(F.lower("value"), "[^a-z]+"), lambda w: F.length(w) >= 3)).alias("word"))
    covered = (pieces.join(F.broadcast(known.select("word", F.lit(1).alias("hit"))), "word")
               .groupBy("value").agg(F.sum(F.length("word")).alias("covered")))
    v = F.col("value")
    runs = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[a-z]+", "a"), "[A-Z]+", "B"), "[0-9]+", "0")
    beside = F.lower(F.concat_ws(" ", "left", "right"))
    return found.join(covered, "value", "left").select(
        *found.columns, F.log1p(F.length(v)).alias("size"),
        ((F.length(runs) - 1) / (F.length(v) - 1)).alias("transitions"),
        (F.size(F.array_distinct(F.split(v, ""))) / F.length(v)).alias("distinct"),
        _share(v, "0-9").alias("digits"), _share(v, "A-Z").alias("uppers"), _share(v, "+/_.@=-").alias("punctuation"),
        v.rlike("^[0-9a-fA-F]+$").cast("double").alias("hexadecimal"),
        v.rlike("^[0-9.-]+$").cast("double").alias("numeric"),
        v.rlike("@.*[.]|^[0-9]+([.][0-9]+){3}$|^(www[.]|/?[a-z]+[.](com|org|net)/)").cast("double").alias("address"),
        F.coalesce(F.col("covered") / F.length(v), F.lit(0.0)).alias("coverage"),
        _assigned().cast("double").alias("assigned"),
        (F.col("left").rlike("[\"'`]$") & F.col("right").rlike("^[\"'`]")).cast("double").alias("quoted"),
        _named().cast("double").alias("named"),
        (beside.rlike(EXAMPLES) | F.lower(v).rlike(EXAMPLES)).cast("double").alias("example"),
        F.size(F.split("path", "[/\\\\]")).cast("double").alias("path_depth"),
        F.log1p(F.length("path")).alias("path_size"),
        F.lower("path").rlike(f"{EXAMPLES}|doc|spec").cast("double").alias("path_example"))


def ruled(rows: DataFrame) -> Column:
    """Label of a finding by clear rules, null where they are silent.

    Secret: a known key shape, a quoted password, or an assigned quoted value beside a name for secrets that no
    dictionary word explains. Not one of the others: plain numbers, addresses, covered by words, or marked as example.
    """
    clean = (F.col("example") == 0) & (F.col("coverage") < 0.3) & (F.col("numeric") == 0) & (F.col("address") == 0)
    secret = (F.col("named") == 1) & (F.col("assigned") == 1) & (F.col("quoted") == 1) & (F.length("value") >= 20)
    benign = (F.col("numeric") == 1) | (F.col("address") == 1) | (F.col("coverage") >= 0.6) | (F.col("example") == 1)
    return F.when(_sure() | (secret & clean), 1).when(benign, 0)


def scan(docs: DataFrame, scratch: Scratch, *, path: str = "source", findings: DataFrame | None = None) -> DataFrame:
    """(doc_id, text, path) -> doc_id, start, value, label, probability, is_secret of every candidate.

    ``findings`` (doc_id, start, label 0/1) are labelled findings; without them the rules label the
    clear ones. At most about ``PER_CLASS`` per class train the forest, by a seeded hash.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                        F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"))
    counted = scratch.save(word_counts(texts).where("n > 1"), "word-counts")
    n = counted.agg(F.sum("n").alias("n")).first()["n"] or 0
    known = scratch.save(counted.where(F.col("n") >= max(2, n / DICTIONARY)).select("word"), "dictionary")
    rows = scratch.save(featured(scratch.save(candidates(texts, "doc_id"), "candidates"), known), "featured")
    scratch.drop("word-counts", "candidates")
    if findings is None:
        rows = rows.withColumn("label", ruled(rows))
    else:
        marks = findings.groupBy("doc_id", "start").agg(F.max("label").cast("int").alias("label"))
        rows = rows.join(marks, ["doc_id", "start"], "left")
    sizes = {r["label"]: r["n"] for r in rows.where("label IN (0, 1)").groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    sure = _sure() & ~F.col("label").eqNullSafe(0)
    if len(sizes) < 2:
        rated = rows.withColumn("probability", F.coalesce(F.col("label").cast("double"), F.lit(0.5)))
    else:
        draw = F.pmod(F.xxhash64(F.lit(31), "doc_id", "start"), F.lit(1 << 30)) / float(1 << 30)
        keep = F.lit(False)
        for label, count in sizes.items():
            keep = keep | ((F.col("label") == label) & (draw < PER_CLASS / count))
        vector = VectorAssembler(inputCols=FEATURES, outputCol="features")
        train = scratch.save(rows.where(keep).select("doc_id", "start", "label", *FEATURES), "findings")
        forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, seed=7,
                                        featureSubsetStrategy="sqrt").fit(
            vector.transform(train.repartition(1).sortWithinPartitions("doc_id", "start")))
        rated = forest.transform(vector.transform(rows)) \
            .withColumn("chance", vector_to_array("probability")).drop("probability") \
            .withColumn("probability", F.col("chance")[1])
    rated = rated.select("doc_id", "start", "value", "label",
                         F.when(sure, 1.0).otherwise(F.col("probability")).alias("probability"))
    return rated.withColumn("is_secret", F.col("probability") >= CUT)


def redact(docs: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents with every confirmed secret masked wherever its text holds it; n_chars follows the text.

    ``key`` is the column of ``docs`` whose values the findings have as doc_id.

    The secrets of one document are gathered as its own text holds them, longest first.
    """
    sure = found.where("is_secret")
    held_in = unused(docs, "_secrets")
    secret = sure.groupBy(F.col("doc_id").alias(key)).agg(F.sort_array(
        F.collect_set(F.struct(F.length("value").alias("n"), "value")), asc=False).alias(held_in))
    # Sent to all tasks only while it is small; otherwise joined by document.
    if sure.count() <= 50_000:
        secret = F.broadcast(secret)
    rows = docs.join(secret, key, "left")
    held = F.col(held_in).isNotNull()
    new = F.when(held, F.aggregate(F.col(f"{held_in}.value"), F.col("text"),
                                   lambda t, s: F.replace(t, s, F.lit(MASK)))).otherwise(F.col("text"))
    out = {c: F.col(c) for c in docs.columns}
    out["text"] = new.alias("text")
    if "n_chars" in out:
        out["n_chars"] = F.when(held, F.length(new).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")).alias("n_chars")
    return rows.select(*out.values())
