"""Token counts (op 9): heap-and-linked-list byte-pair merging per distinct piece, counts only.

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated rows give repeated results; an empty
table gives an empty table; texts of any length are counted whole. Other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodestrata.llm import bpe
from lodestrata.llm.common import text_map

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048


def count_tokens(df: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row; ``path`` is the vocabulary file on the executors."""
    folder = None if path else VOCABULARY

    def make():
        import public_tokenizers

        counter = bpe.merge_counter(path or public_tokenizers.path(folder))

        def kernel(texts, kept):
            return {"doc_id": kept[doc_id], "n_bytes": [len(t.encode()) for t in texts], "n_tokens": counter.count(texts)}

        return kernel

    counted = text_map(df, f"doc_id {dict(df.dtypes)[doc_id]}, n_bytes bigint, n_tokens bigint", make, text, (doc_id,))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
