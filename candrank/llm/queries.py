"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from candrank.llm.audit import OP13_SQL, op13_filter_audit
from candrank.llm.chat import op4_chat
from candrank.llm.decontamination import op8_decontamination
from candrank.llm.language_model import op2_language_model
from candrank.llm.minhash import op11_minhash
from candrank.llm.near_duplicates import op5_simhash
from candrank.llm.packing import op3_packing
from candrank.llm.quality import OP6_SQL, op6_quality
from candrank.llm.secrets import op1_secrets
from candrank.llm.spelling import op12_spelling
from candrank.llm.token_counts import op10_token_counts
from candrank.llm.token_files import op9_token_files
from candrank.llm.url_filter import op7_url_filter

QUERIES = {f.__name__: f for f in (op1_secrets, op2_language_model, op3_packing, op4_chat, op5_simhash, op6_quality, op7_url_filter, op8_decontamination, op9_token_files, op10_token_counts, op11_minhash, op12_spelling, op13_filter_audit)}
ORACLES: dict[str, str] = {"op6_quality": OP6_SQL, "op13_filter_audit": OP13_SQL}
