"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from folioscan.llm import extract, fuzzy, language, media, mixing, packing, quality, sharding, simhash, warc


def queries() -> dict:
    return {
        "op1_extract": extract.op1_extract,
        "op2_packing": packing.op2_packing,
        "op3_fingerprints": fuzzy.op3_fingerprints,
        "op4_language": language.op4_language,
        "op5_sharding": sharding.op5_sharding,
        "op6_mixing": mixing.op6_mixing,
        "op7_quality": quality.op7_quality,
        "op8_media": media.op8_media,
        "op9_simhash": simhash.op9_simhash,
        "op10_warc": warc.op10_warc,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_mixing": mixing.SQL, "op10_warc": warc.SQL}
