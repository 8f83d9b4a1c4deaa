"""The training-data pipeline: five stages over the documents table.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents. Stages are joined by Parquet tables in the
shared folder, so that a lost executor costs no more than its own stage's work.

Edge cases: an empty table passes all stages and gives no piece. Nulls, repeated
rows and very long texts are handled as each stage's module says; extra columns
pass all stages but the last, which returns those of packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkquarry.deploy import shipped
from sparkquarry.llm import containment, line_quality, minhash_dedup, packing, scratch, secret_scan

STAGES = [
    ("quality_rules", shipped(line_quality.keep_content)),
    ("near_dedup", shipped(minhash_dedup.keep_one)),
    ("decontamination", shipped(containment.drop_contaminated)),
    ("secret_scan", shipped(secret_scan.mask_secrets)),
    ("packing", shipped(packing.packed)),
]

#: Line labelling, secret spans and token ids have no SQL form; the tests compare with a brute-force pipeline.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = scratch.cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
