"""A corpus pipeline: quality, near-duplicates, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and
reread before the next one.  All stages but the last return the columns of ``docs``,
whatever further columns there are and whatever these are called.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm import decontaminate, packing, pii, quality, simhash
from docloom.llm.storage import materialise, read


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under column names that no operator uses, and the new name of each."""
    names = {c: f"_in{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def quality_rules(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are not anomalous; the labels set the limit.

    Null, empty and blank texts fail the base rules.  Repeated rows share their verdict, and a row
    without an id is judged like any other.  Without labels the base rules alone decide.
    """
    own, names = _plain(docs)
    stats = materialise(quality.rule_statistics(own, [names["doc_id"]], text=names["text"]))
    forest = quality.calibrate(stats, read(spark, sf_dir, "labels"), row_id=names["doc_id"])
    kept = quality.judge(own, forest, list(names.values()), text=names["text"]).where("kept")
    return kept.select(*names.values()).toDF(*names)


def near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near-duplicates: that with the least id, of equal ids that with the least hash.

    Texts that share an id are linked by their fingerprints only, so unlike texts both
    stay.  Rows that are equal in all columns leave one.  A row without an id stays only
    if no row of its component has one.  Null, empty and blank texts are copies of each other.
    """
    own, names = _plain(docs)
    key, text = names["doc_id"], names["text"]
    own = own.withColumn("_h", F.xxhash64(*names.values()))
    fps = materialise(simhash.fingerprints(own, [key, "_h"], text=text))
    order = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.col("_h"))
    first = simhash.with_classes(fps).groupBy("class").agg(F.min(order).alias("first"))
    stay = first.select(F.col("first._h").alias("_stay"))
    left = own.mapInArrow(_once(own.columns.index("_h"), own.columns.index(key)), own.schema)
    left = left.join(stay, left["_h"] == stay["_stay"], "left_semi")
    nth = F.row_number().over(Window.partitionBy("_h", key).orderBy(F.lit(0)))
    return left.withColumn("_nth", nth).where("_nth = 1").select(*names.values()).toDF(*names)


def _once(hash_at: int, id_at: int, most: int = 1_000_000):
    """A task's rows without those that repeat an earlier one; so equal rows of the whole table meet as few."""

    def run(batches):
        seen: set = set()
        for batch in batches:
            fresh = []
            for row in zip(batch.column(hash_at).to_pylist(), batch.column(id_at).to_pylist()):
                fresh.append(row not in seen)
                seen.add(row)
            if len(seen) > most:
                seen.clear()
            yield batch if all(fresh) else batch.filter(pa.array(fresh))

    return run


def benchmark_decontamination(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark.

    Null, empty and blank texts have none; repeated rows share their verdict.  An empty benchmark leaves all.
    """
    own, names = _plain(docs)
    marked = decontaminate.decontaminate(own, read(spark, sf_dir, "benchmark"), text=names["text"], keep=list(names.values()))
    return marked.where("n_hit = 0").select(*names.values()).toDF(*names)


def personal_data(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each identifier replaced by its kind in brackets; n_chars follows the text.

    A null text stays null, and an empty one empty; repeated rows stay repeated.
    """
    own, names = _plain(docs)
    rest = [n for c, n in names.items() if c != "text"]
    cleaned = pii.detect(own, rest, text=names["text"], redact=True).withColumnRenamed("redacted", names["text"])
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        length = F.coalesce(F.length(names["text"]), F.lit(0)).cast(kind)
        cleaned = cleaned.withColumn(names["n_chars"], length)
    return cleaned.select(*names.values()).toDF(*names)


def bestfit_packing(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its token ids, its sequence and its place there.

    A null or empty text is one piece with the end id only; repeated rows are packed each.
    """
    own, names = _plain(docs)
    cut = materialise(packing.pieces(own, [names["doc_id"]], text=names["text"], ids=True))
    packed = packing.with_ids(packing.pack(cut, [names["doc_id"], "piece", "ids_crc32"]))
    return packed.withColumnRenamed(names["doc_id"], "doc_id").select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("bestfit_packing", bestfit_packing),
]

#: Token ids and the forest are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialise(docs)
    return docs
