"""Queries of the corpus operators and the SQL that they are held against."""

from __future__ import annotations

from . import decontamination, jaccard, licenses, linededup, mixing, mpegts, pii, sharding, toxicity, warc


def queries() -> dict:
    return {
        "op1_transport_streams": mpegts.op1_transport_streams,
        "op2_sainte_lague_mix": mixing.op2_sainte_lague_mix,
        "op3_wu_manber_decontamination": decontamination.op3_wu_manber_decontamination,
        "op4_line_site_spread": linededup.op4_line_site_spread,
        "op5_skip_chain_pii": pii.op5_skip_chain_pii,
        "op6_prefix_tree_join": jaccard.op6_prefix_tree_join,
        "op7_license_templates": licenses.op7_license_templates,
        "op8_prefix_sum_shards": sharding.op8_prefix_sum_shards,
        "op9_warc_segments": warc.op9_warc_segments,
        "op10_nearest_toxic": toxicity.op10_nearest_toxic,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_wu_manber_decontamination": decontamination.OP3_SQL,
        "op4_line_site_spread": linededup.OP4_SQL,
        "op6_prefix_tree_join": jaccard.OP6_SQL,
        "op7_license_templates": licenses.OP7_SQL,
        "op8_prefix_sum_shards": sharding.OP8_SQL,
        "op9_warc_segments": warc.OP9_SQL,
    }
