"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversations, decontaminate, language, licenses, media, neardup, packing, pii, quality, repeats, sharding, spelling, webtext

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media": media.op1_media,
    "op2_quality": quality.op2_quality,
    "op3_main_text": webtext.op3_main_text,
    "op4_packing": packing.op4_packing,
    "op5_language": language.op5_language,
    "op6_licenses": licenses.op6_licenses,
    "op7_pii": pii.op7_pii,
    "op8_neardup": neardup.op8_neardup,
    "op9_sharding": sharding.op9_sharding,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_repair": conversations.op11_repair,
    "op12_repeats": repeats.op12_repeats,
    "op13_spelling": spelling.op13_spelling,
}

ORACLE_SQL: dict[str, str] = {
    "op6_licenses": licenses.SQL,
    "op11_repair": conversations.SQL,
    "op13_spelling": spelling.SQL,
}
