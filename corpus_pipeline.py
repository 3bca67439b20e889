"""From raw documents to packed sequences: each stage calls one operator of lodestone.llm on all its predecessor kept.

Every function takes (spark, docs, sf_dir); docs has the columns of `documents`. All but the last return those columns.
A row is known by its doc_id, null included, and a hash of its text: rows that share a doc_id but not a text are filtered
each by itself. Stages are written as Parquet between one another, so a lost executor costs no more than its tasks; what
a stage wrote meanwhile is deleted when its output is there.

Texts stay where they are in the quality and mixing stages at any size. The two dedup stages send the keys of the rows to
drop (8 bytes each) to the texts; only above BROADCAST_KEYS of them do texts meet their keys by a shuffle.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from lodestone.llm.catalog import MIXTURE, tokenizer_path
from lodestone.llm.exact_dedup import exact_dedup
from lodestone.llm.mixing import keep_mixed, source_group
from lodestone.llm.near_dedup import near_dedup
from lodestone.llm.packing import pack
from lodestone.llm.quality_rules import keep_quality
from lodestone.plans.runtime import materialize, release, scratch, table

#: Share of the remaining tokens that the mixture takes.
BUDGET = 0.8
#: Keys of rows to drop (8 bytes each) that are sent to every task; more meet the texts by a shuffle.
BROADCAST_KEYS = 3_000_000


def _key(doc_id, mark):
    """A row's key, 64 bits; null ids have keys too."""
    return F.xxhash64(doc_id.cast("long"), mark)


def _own(docs: DataFrame):
    return _key(docs["doc_id"], F.xxhash64(docs["text"].cast("string")))


def _keys(found: DataFrame) -> tuple[DataFrame, str]:
    """The distinct keys of found (doc_id, mark) and their column's name, sent to every task up to BROADCAST_KEYS."""
    name = f"_key_{uuid.uuid4().hex}"  # no column of the documents has it
    named = materialize(found.select(_key(F.col("doc_id"), F.col("mark")).alias(name)).distinct(), "keys")
    return (F.broadcast(named) if named.count() <= BROADCAST_KEYS else named), name


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs that gone (doc_id, mark) does not name."""
    keys, name = _keys(gone)
    return docs.join(keys, _own(docs) == F.col(name), "left_anti")


def _ordered(kind: DataType) -> bool:
    """Whether values of the type can be compared."""
    if isinstance(kind, StructType):
        return all(_ordered(f.dataType) for f in kind.fields)
    return _ordered(kind.elementType) if isinstance(kind, ArrayType) else not isinstance(kind, (MapType, VariantType))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return keep_quality(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal documents the one with the smallest doc_id stays; of rows that share doc_id and text the least one does, by
    the columns that can be compared."""
    found = materialize(exact_dedup(docs).select("doc_id", "mark", "kept", F.expr("doc_id <=> keep_id AND mark = keep_mark").alias("same")), "exact")
    left = _without(docs, found.where("NOT kept AND NOT same"))
    repeated = found.where("NOT kept AND same")
    if repeated.isEmpty():
        return left
    keys, name = _keys(repeated)
    again = left.join(keys, _own(left) == F.col(name), "left_semi")
    least = F.struct(*(again[f.name] for f in again.schema.fields if _ordered(f.dataType)))
    once = again.groupBy(_own(again).alias(name)).agg(F.min_by(F.struct("*"), least).alias("row")).select("row.*")
    return _without(left, repeated).unionByName(once)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the row with the smallest doc_id stays."""
    return _without(docs, near_dedup(docs).where("NOT kept"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that a mixture at the target weights takes."""
    return keep_mixed(docs, source_group(), BUDGET, MIXTURE)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences, each mixed as the whole is."""
    return pack(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality),
    ("exact_dedup", exact),
    ("simhash_dedup", near),
    ("mixing", mixture),
    ("packing", packed),
]

#: Several stages (expectation-maximisation, XXH64 votes, a tokenizer) are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch() as keep:
            out = keep(materialize(stage(spark, docs, sf_dir), name))
        release(docs)  # the stage before; the input is no table of ours
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
