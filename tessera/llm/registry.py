"""Queries of the training-data operators, by name, and their SQL where SQL can say the same."""

from __future__ import annotations

from tessera.llm.bpe import op8_bpe
from tessera.llm.decontaminate import op2_decontaminate
from tessera.llm.langid import op7_language
from tessera.llm.linededup import OP6_SQL, op6_lines
from tessera.llm.ngramlm import op9_lm
from tessera.llm.repeats import op1_repeats
from tessera.llm.secretscan import op4_secrets
from tessera.llm.simhash import op10_simhash
from tessera.llm.topk import OP5_SQL, op5_topk
from tessera.llm.urlrules import op3_urls

QUERIES = {
    "op1_repeats": op1_repeats,
    "op2_decontaminate": op2_decontaminate,
    "op3_urls": op3_urls,
    "op4_secrets": op4_secrets,
    "op5_topk": op5_topk,
    "op6_lines": op6_lines,
    "op7_language": op7_language,
    "op8_bpe": op8_bpe,
    "op9_lm": op9_lm,
    "op10_simhash": op10_simhash,
}

ORACLE_SQL: dict[str, str] = {
    "op5_topk": OP5_SQL,
    "op6_lines": OP6_SQL,
}
