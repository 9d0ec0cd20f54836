"""The stages of corpus_pipeline.py: each takes (spark, docs, sf_dir) and returns documents, the last one pieces.

For all of them: columns of the input besides those of documents are passed on under their names, whatever these are; a null
doc_id, source, lang or n_chars is a value like others; repeated rows and rows of one doc_id are judged row by row, by what
they hold; an empty table gives an empty one.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import dropped, own_names, scope, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _text_key() -> F.Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without their hosts' boilerplate lines.

    The limit of lines is a number of documents alone, the same at every size of a host. A null or empty text fails the
    rules; a very long one is judged whole; copies of one text count once for a line, and all of them stay.
    """
    from .quality import clean_documents

    return clean_documents(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that n-gram Jaccard links (five words, 0.8) join. Documents without words stay, once for each doc_id and text.

    It is that of the least doc_id, nulls last, then of the least hash of its text; doc_id and hash together find it again,
    so that rows without a doc_id or with that of another text are judged by themselves. Of rows equal in doc_id and text one stays.
    """
    from .jaccard import jaccard_rows

    key, none, place, of_none, of, of_text = own_names(docs.columns, "text_key", "none", "place", "of_none", "of", "of_text")
    doc_id = F.col("doc_id").cast("long")
    # a row's place holds no null, so that the join and what sets repeated rows apart deal the texts by the same columns, once
    keyed = docs.select(*docs.columns, _text_key().alias(key), doc_id.isNull().alias(none), F.coalesce(doc_id, F.lit(0)).alias(place))
    rows = jaccard_rows(keyed.select(doc_id.alias("doc_id"), "text", F.col(key).alias("key")), 5, 80, ["key"])
    found = written(rows, "jaccard-found")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
    stays = found.filter("component is not null").groupBy("component").agg(first).select("first.doc_id", "first.key")
    stays = stays.unionByName(found.filter("component is null").select("doc_id", "key"))
    stays = stays.select(F.col("doc_id").isNull().alias(of_none), F.coalesce("doc_id", F.lit(0)).alias(of), F.col("key").alias(of_text)).distinct()
    kept = keyed.join(stays, (F.col(none) == F.col(of_none)) & (F.col(place) == F.col(of)) & (F.col(key) == F.col(of_text)), "left_semi")
    return kept.dropDuplicates([none, place, key, "doc_id", "text"]).select(*docs.columns)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of strings of 400 bytes that occur more than once; a null text becomes an empty one."""
    from .suffixes import remove_repeats

    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    *told, text = own_names(docs.columns, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")
    kept = remove_repeats(docs, 400, keep=others).toDF("doc_id", *told, text, *others)
    length = F.length(F.col(text)).cast("long")
    return kept.select(*["doc_id" if c == "doc_id" else F.col(text).alias("text") if c == "text" else length.alias(c) if c == "n_chars" else c for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix to target weights has it; a text without words is taken as often as its size's rate says: never.

    Copies are told by doc_id, source and text. Of rows equal in these one goes on, with the copies of all.
    """
    from .mixing import mix_sources

    key, of, of_source, of_text, copies, rows, turn = own_names(docs.columns, "text_key", "of", "of_source", "of_text", "copies", "rows", "turn")
    keyed = docs.withColumn(key, _text_key())
    mixed = mix_sources(keyed.select("doc_id", "source", "text", F.col(key).alias("key")), extra=["key"])
    told = mixed.groupBy(F.col("doc_id").alias(of), F.col("source").alias(of_source), F.col("key").alias(of_text)).agg(F.sum("copies").cast("int").alias(copies), F.count("*").alias(rows))
    told = written(told, "copies").filter(F.col(copies) > 0)
    same = keyed.doc_id.cast("long").eqNullSafe(told[of]) & keyed.source.cast("string").eqNullSafe(told[of_source]) & (keyed[key] == told[of_text])
    joined = keyed.join(told, same)
    once = joined.filter(F.col(rows) == 1).unionByName(joined.filter(F.col(rows) > 1).dropDuplicates([of, of_source, of_text]))
    return once.withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, as packing makes them: a null or empty text is a piece of the end id alone."""
    import public_tokenizers

    from .packing import pack_documents

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), "words", 2, 4096)


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("suffix-array dedup", repeated_strings), ("mixing to target weights", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage returns for the documents table; each stage's result is written and read again.

    What a stage has written for itself is deleted when its result is, and so is the result that the next stage has read.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scope(spark) as keep:
            docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            keep(docs)
        dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
