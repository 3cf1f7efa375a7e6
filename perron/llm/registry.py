"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from perron.llm import sql
from perron.llm.ann import op5_ann
from perron.llm.html import op4_html
from perron.llm.langid import op10_langid
from perron.llm.minhash import op8_minhash
from perron.llm.mixing import op2_mixing
from perron.llm.packing import op6_packing
from perron.llm.pii import op3_pii
from perron.llm.quality import op9_quality
from perron.llm.sharding import op1_sharding
from perron.llm.warc import op7_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": op1_sharding,
        "op2_mixing": op2_mixing,
        "op3_pii": op3_pii,
        "op4_html": op4_html,
        "op5_ann": op5_ann,
        "op6_packing": op6_packing,
        "op7_warc": op7_warc,
        "op8_minhash": op8_minhash,
        "op9_quality": op9_quality,
        "op10_langid": op10_langid,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_sharding": sql.sharding(),
        "op2_mixing": sql.mixing(),
        "op7_warc": sql.archives(),
        "op8_minhash": sql.near_duplicates(),
        "op9_quality": sql.quality(),
    }
