"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from triagelake.llm.audio import op5_mpeg_audio
from triagelake.llm.bpe import op7_byte_bpe
from triagelake.llm.centroids import OP11_SQL, op11_lloyd
from triagelake.llm.chat import OP13_SQL, op13_reply_trees
from triagelake.llm.decontaminate import op2_benchmark_leaks
from triagelake.llm.line_dedup import op6_line_dedup
from triagelake.llm.manifest import OP12_SQL, op12_merkle
from triagelake.llm.near_duplicates import op1_ngram_jaccard
from triagelake.llm.sharding import OP10_SQL, op10_feistel_shards
from triagelake.llm.token_counts import op8_token_counts
from triagelake.llm.toxicity import op3_toxicity
from triagelake.llm.url_filter import op4_url_filter
from triagelake.llm.warc import OP9_SQL, op9_warc


def queries():
    return {
        "op1_ngram_jaccard": op1_ngram_jaccard,
        "op2_benchmark_leaks": op2_benchmark_leaks,
        "op3_toxicity": op3_toxicity,
        "op4_url_filter": op4_url_filter,
        "op5_mpeg_audio": op5_mpeg_audio,
        "op6_line_dedup": op6_line_dedup,
        "op7_byte_bpe": op7_byte_bpe,
        "op8_token_counts": op8_token_counts,
        "op9_warc": op9_warc,
        "op10_feistel_shards": op10_feistel_shards,
        "op11_lloyd": op11_lloyd,
        "op12_merkle": op12_merkle,
        "op13_reply_trees": op13_reply_trees,
    }


def oracle_sql():
    return {"op9_warc": OP9_SQL, "op10_feistel_shards": OP10_SQL, "op11_lloyd": OP11_SQL, "op12_merkle": OP12_SQL, "op13_reply_trees": OP13_SQL}
