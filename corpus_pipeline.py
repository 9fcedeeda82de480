"""The corpus pipeline: language ID, line dedup, near-duplicate join, decontamination, mixing to target weights.

Every stage takes all documents that its predecessor kept and returns the columns of `documents`; the last one adds
those of the mix. A stage's result is written as Parquet to the shared folder and read again by the next one, so a
lost executor costs at most part of one stage; it is deleted once the next one is written.

Defined results: the pipeline reads doc_id, text, lang and source; n_chars follows the text where a line goes, and
further columns pass through whatever their names, but for those that the mix adds (size, source_size, target, copies,
taken), which it replaces. A null, empty or letterless text is in no language and goes in the first stage. A document
is an id with a text: rows that repeat both stay or go together, rows that repeat an id alone are documents of their own,
save that lines are dropped by id. Of a group of near copies the one with the smallest id stays, null last, and of equal
ids the one with the smallest hash of its text. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sweepmill.llm import common, decontaminate, jaccard_join, language_id, line_dedup, source_mix

#: Least cosine with the best prototype for long texts; see least_score for short ones.
LEAST_SCORE = 0.3
#: A list of keys is sent to all executors up to this many rows of 24 bytes (12 MB); a longer one is joined by a shuffle.
BROADCAST_KEYS = 500_000
# Random draws and folds have no SQL form; tests hold run() against a brute-force version instead.
ORACLE_SQL = None


def least_score(extent):
    """The least cosine for a text of so many trigrams that count. Prose of n trigrams has a cosine of about
    sqrt(n / (n + 140)) with its prototype (medians of short texts at sf0.1); twice the deviation of cosines of unlike
    vectors is allowed for. So a few words, which say too little to differ from a language, stay."""
    return LEAST_SCORE * F.sqrt(extent / (extent + 140)) - 2 / language_id.DIMENSION**0.5


def hidden(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs under names that no operator uses, and those by column: results cannot clash with columns."""
    names = {c: f"_column{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def shown(df: DataFrame, names: dict[str, str], **changed) -> DataFrame:
    return df.select(*[changed.get(c, F.col(n)).alias(c) for c, n in names.items()])


def text_key(text):
    """128 bits of a text."""
    return F.struct(F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2"))


def without_keys(docs: DataFrame, keys: DataFrame, same) -> DataFrame:
    """docs without those that a row of keys names; the keys are kept from here on."""
    keys = common.stash(keys, "keys")
    return docs.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, same, "left_anti")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the prototypes know; those without a letter, or less like any language
    than prose of their length is, go."""
    common.small_batches(spark)
    plain, names = hidden(docs)
    prototypes = language_id.fit(plain, id_col=names["doc_id"], text_col=names["text"], lang_col=names["lang"])
    found = language_id.identify(plain, prototypes, text_col=names["text"], extent="extent")
    like = (F.col("score") >= LEAST_SCORE) | (F.col("score") >= least_score(F.col("extent")))
    return shown(found.where((F.col("lang_pred") != language_id.UNKNOWN) & like), names)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that five or more of them hold; n_chars follows the text."""
    plain, names = hidden(docs)
    kept = line_dedup.drop_repeated_lines(plain, id_col=names["doc_id"], text_col=names["text"])
    if "n_chars" not in names:
        return shown(kept, names)
    chars = F.when(F.col("n_dropped") > 0, F.length(names["text"]).cast("long")).otherwise(F.col(names["n_chars"]))
    return shown(kept, names, n_chars=chars)


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    plain, names = hidden(docs)
    doc = F.struct(F.col(names["doc_id"]).isNull().cast("int").alias("none"), F.col(names["doc_id"]).alias("id"), text_key(F.col(names["text"])).alias("text"))
    groups = jaccard_join.jaccard_groups(plain.select(doc.alias("doc"), F.col(names["text"]).alias("text")), id_col="doc")
    copies = groups.where("doc <> component_id").select("doc.id", "doc.text.h1", "doc.text.h2").distinct()
    same = F.col(names["doc_id"]).eqNullSafe(F.col("id")) & (F.xxhash64(names["text"]) == F.col("h1")) & (text_key(F.col(names["text"]))["h2"] == F.col("h2"))
    return shown(without_keys(plain, copies, same), names)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item. Texts stand for themselves, whatever their ids."""
    common.small_batches(spark)
    plain, names = hidden(docs)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hits = decontaminate.find_contained(plain.select(text_key(F.col(names["text"])).alias("key"), F.col(names["text"]).alias("text")), items, id_col="key")
    same = (F.xxhash64(names["text"]) == F.col("h1")) & (text_key(F.col(names["text"]))["h2"] == F.col("h2"))
    return shown(without_keys(plain, hits.select("key.h1", "key.h2").distinct(), same), names)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how many copies of each."""
    return source_mix.mix_sources(docs).where("copies > 0")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_lines),
    ("jaccard_join", keep_one_of_group),
    ("decontaminate", drop_contaminated),
    ("source_mix", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = common.stash(stage(spark, docs, sf_dir), name)
        if before is not None:
            common.unstash(before)
        before = docs
    return docs
