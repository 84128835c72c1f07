"""The queries of the corpus operators, by name, and the SQL that some of them equal."""

from __future__ import annotations

from girder.llm.collocations import OP13_SQL, op13_collocations
from girder.llm.decontam import OP7_SQL, op7_decontamination
from girder.llm.fingerprint import op10_fingerprints
from girder.llm.langid import op1_language_id
from girder.llm.pii import op2_personal_data
from girder.llm.periodic import op11_periodic_runs
from girder.llm.pieces import op8_sentencepiece
from girder.llm.secret_scan import OP5_SQL, op5_secret_scan
from girder.llm.sharding import op12_balanced_shards
from girder.llm.simhash import op3_simhash
from girder.llm.substring import OP6_SQL, op6_substring_dedup
from girder.llm.token_count import op9_token_counts
from girder.llm.url_filter import op4_url_filter

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_personal_data": op2_personal_data,
    "op3_simhash": op3_simhash,
    "op4_url_filter": op4_url_filter,
    "op5_secret_scan": op5_secret_scan,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_decontamination": op7_decontamination,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_token_counts": op9_token_counts,
    "op10_fingerprints": op10_fingerprints,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_balanced_shards": op12_balanced_shards,
    "op13_collocations": op13_collocations,
}

ORACLES: dict[str, str] = {
    "op5_secret_scan": OP5_SQL,
    "op6_substring_dedup": OP6_SQL,
    "op7_decontamination": OP7_SQL,
    "op13_collocations": OP13_SQL,
}
