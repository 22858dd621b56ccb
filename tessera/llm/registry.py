"""The queries of this folder by name, and the SQL that must give the same rows."""

from . import collocation, decontaminate, jaccard_join, licenses, merkle, mixing, quality, quality_fm, secrets, substring_dedup, token_files, toxicity, url_filter

QUERIES = {
    "op4_jaccard_join": jaccard_join.op4_jaccard_join,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op6_secret_scan": secrets.op6_secret_scan,
    "op7_license_scan": licenses.op7_license_scan,
    "op1_toxicity": toxicity.op1_toxicity,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_mix_sources": mixing.op9_mix_sources,
    "op10_token_files": token_files.op10_token_files,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op5_quality_rules": quality.op5_quality_rules,
    "op11_quality_classifier": quality_fm.op11_quality_classifier,
    "op12_collocations": collocation.op12_collocations,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}
ORACLE_SQL = {"op4_jaccard_join": jaccard_join.OP4_SQL, "op2_substring_dedup": substring_dedup.OP2_SQL, "op3_decontaminate": decontaminate.OP3_SQL, "op12_collocations": collocation.OP12_SQL, "op13_merkle_manifest": merkle.OP13_SQL}
