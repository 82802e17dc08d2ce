"""Label vocabularies of a model: JSON files with rel_vocab, pos_vocab and, for some models, feats_vocab."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phraseloom.functions import decode

SCHEMA = "rel_vocab map<string,int>, pos_vocab map<string,int>, feats_vocab map<string,map<string,int>>"


@dataclass(frozen=True)
class Vocab:
    """Labels by place; ``feats`` is empty for models without that head."""

    rels: list[str]
    upos: list[str]
    feats: list[tuple[str, list[str]]] = field(default_factory=list)


def invert(vocabs: DataFrame) -> DataFrame:
    """rels, upos and feats (category, values) arrays of rows of ``SCHEMA``."""
    feats = F.coalesce("feats_vocab", F.create_map().cast("map<string,map<string,int>>"))
    return vocabs.select(decode.invert_vocab(F.col("rel_vocab")).alias("rels"), decode.invert_vocab(F.col("pos_vocab")).alias("upos"), decode.invert_feats(feats).alias("feats"))


def read(spark: SparkSession, path: str) -> Vocab:
    """The vocabulary in one JSON file; other keys are ignored."""
    row = invert(spark.read.schema(SCHEMA).option("multiLine", True).json(path)).first()
    return Vocab(row.rels, row.upos, [(f["category"], f["values"]) for f in row.feats])
