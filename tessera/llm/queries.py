"""The corpus queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import ann, bitplanes, licenses, media, mixing, neardup, packing, quality, sharding, viterbi

QUERIES = {
    "op1_token_planes": bitplanes.op1_token_planes,
    "op2_best_two_fit": packing.op2_best_two_fit,
    "op3_ivf_pq": ann.op3_ivf_pq,
    "op4_viterbi_counts": viterbi.op4_viterbi_counts,
    "op5_curriculum_mix": mixing.op5_curriculum_mix,
    "op6_subword_quality": quality.op6_subword_quality,
    "op7_near_duplicates": neardup.op7_near_duplicates,
    "op8_license_index": licenses.op8_license_index,
    "op9_chunked_media": media.op9_chunked_media,
    "op10_bounded_ring": sharding.op10_bounded_ring,
}

ORACLE_SQL: dict[str, str] = {
    "op5_curriculum_mix": mixing.OP5_SQL,
    "op7_near_duplicates": neardup.OP7_SQL,
    "op8_license_index": licenses.OP8_SQL,
}
