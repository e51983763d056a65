"""The dealt operators as named queries over the driver tables, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from subsight.llm.alignment import op11_alignment
from subsight.llm.bpe import op2_bpe
from subsight.llm.decontamination import op5_decontamination
from subsight.llm.embeddings import op1_embeddings
from subsight.llm.langid import op8_language
from subsight.llm.lines import OP13_SQL, op13_lines
from subsight.llm.manifest import OP12_SQL, op12_manifest
from subsight.llm.records import op3_records
from subsight.llm.simhash import op10_simhash
from subsight.llm.suffix_dedup import op6_suffix
from subsight.llm.toxicity import op7_toxicity
from subsight.llm.urls import OP4_SQL, op4_urls
from subsight.llm.warc import OP9_SQL, op9_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embeddings": op1_embeddings,
    "op2_bpe": op2_bpe,
    "op3_records": op3_records,
    "op4_urls": op4_urls,
    "op5_decontamination": op5_decontamination,
    "op6_suffix": op6_suffix,
    "op7_toxicity": op7_toxicity,
    "op8_language": op8_language,
    "op9_warc": op9_warc,
    "op10_simhash": op10_simhash,
    "op11_alignment": op11_alignment,
    "op12_manifest": op12_manifest,
    "op13_lines": op13_lines,
}
ORACLE: dict[str, str] = {"op4_urls": OP4_SQL, "op9_warc": OP9_SQL, "op12_manifest": OP12_SQL, "op13_lines": OP13_SQL}
