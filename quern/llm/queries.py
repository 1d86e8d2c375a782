"""The queries of the ten operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm.arrowfile import op1_token_files
from quern.llm.chat import op6_chat_format, op6_sql
from quern.llm.extract import op8_extract
from quern.llm.imatch import op9_imatch, op9_sql
from quern.llm.language import op5_language
from quern.llm.lmscore import op10_lm_score
from quern.llm.media import op7_media
from quern.llm.mixing import op4_mixing
from quern.llm.packing import op2_packing
from quern.llm.simjoin import op3_jaccard_join

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_packing": op2_packing,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_mixing": op4_mixing,
    "op5_language": op5_language,
    "op6_chat_format": op6_chat_format,
    "op7_media": op7_media,
    "op8_extract": op8_extract,
    "op9_imatch": op9_imatch,
    "op10_lm_score": op10_lm_score,
}
ORACLE: dict[str, str] = {"op6_chat_format": op6_sql(), "op9_imatch": op9_sql()}
