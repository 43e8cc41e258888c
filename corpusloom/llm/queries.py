"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from corpusloom.llm import oracles
from corpusloom.llm.chat_format import op7_chat_format
from corpusloom.llm.decontaminate import op2_decontaminate
from corpusloom.llm.fingerprint import op5_fingerprint
from corpusloom.llm.html_text import op10_html_text
from corpusloom.llm.jaccard_join import op9_jaccard_join
from corpusloom.llm.license_scan import op4_license_scan
from corpusloom.llm.quality import op3_quality
from corpusloom.llm.sentencepiece_codec import op6_sentencepiece
from corpusloom.llm.token_counts import op8_token_counts
from corpusloom.llm.toxicity import op1_toxicity

QUERIES = {f.__name__: f for f in (op1_toxicity, op2_decontaminate, op3_quality, op4_license_scan, op5_fingerprint, op6_sentencepiece, op7_chat_format, op8_token_counts, op9_jaccard_join, op10_html_text)}
QUERIES["pipeline"] = corpus_pipeline.run

SQL: dict[str, str] = {**oracles.SQL, **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})}
