"""A corpus pipeline of five stages; each works on all that the stage before it kept.

Language ID drops documents in no language; near-dedup keeps one document of each group; private
data is replaced by its kind; sources are replicated to their target weights; and what is left is
encoded as byte-level BPE and proved by decoding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodewatch.llm.bpe import tokens_of_documents
from lodewatch.llm.langid import keep_identified
from lodewatch.llm.minhash import keep_first_of_group
from lodewatch.llm.mixing import replicated_to_weights
from lodewatch.llm.pii import without_private_data
from lodewatch.llm.shared import drop, settle, written

STAGES = [
    ("language_id", keep_identified),
    ("minhash_near_dedup", keep_first_of_group),
    ("private_data", without_private_data),
    ("mix_sources", replicated_to_weights),
    ("byte_bpe", tokens_of_documents),
]

#: No stage but mixing can be said in SQL; tests/llm/test_pipeline.py holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the whole documents table, each written and read again before the next.

    What a stage wrote on its way is deleted once its result is written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    known = set(written())
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
        made = [p for p in written() if p not in known]
        drop([p for p in made if p != made[-1]])  # the newest is the stage's own result
    return STAGES[-1][1](spark, docs, sf_dir)
