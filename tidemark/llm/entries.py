"""The registered queries of this subpackage and their SQL."""

from tidemark.llm import bpe, capfilters, conversations, decontam, fst, lm, merkle, ppm, secrets, seeds, setsketch, suffix, warc

QUERIES = {
    "op1_lm_scoring": lm.query,
    "op2_suffix_array": suffix.query,
    "op3_minhash": setsketch.query,
    "op4_warc": warc.query,
    "op5_bpe": bpe.query,
    "op6_secret_scan": secrets.query,
    "op7_decontamination": decontam.query,
    "op8_substring_dedup": seeds.query,
    "op9_cap_filters": capfilters.query,
    "op10_language_id": ppm.query,
    "op11_token_counts": fst.query,
    "op12_merkle_manifest": merkle.query,
    "op13_conversation_repair": conversations.query,
}

ORACLE: dict[str, str] = {
    "op4_warc": warc.ORACLE,
    "op8_substring_dedup": seeds.ORACLE,
    "op9_cap_filters": capfilters.ORACLE,
    "op12_merkle_manifest": merkle.ORACLE,
    "op13_conversation_repair": conversations.ORACLE,
}
