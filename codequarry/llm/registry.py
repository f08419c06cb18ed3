"""Queries of this subpackage by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from .chat import ORACLE_OP10, op10_chat
from .collocations import ORACLE_OP11, op11_collocations
from .decontaminate import op1_decontaminate
from .language_id import op6_language_id
from .licenses import ORACLE_OP12, op12_licenses
from .lm_score import op5_lm_score
from .mpeg_audio import op9_mpeg_audio
from .piece_bpe import op3_piece_bpe
from .sharding import op4_sharding
from .simhash import op2_simhash
from .substring_dedup import op7_substring_dedup
from .toxicity import op8_toxicity
from .vector_codes import ORACLE_OP13, op13_vector_codes

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_simhash": op2_simhash,
    "op3_piece_bpe": op3_piece_bpe,
    "op4_sharding": op4_sharding,
    "op5_lm_score": op5_lm_score,
    "op6_language_id": op6_language_id,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_mpeg_audio": op9_mpeg_audio,
    "op10_chat": op10_chat,
    "op11_collocations": op11_collocations,
    "op12_licenses": op12_licenses,
    "op13_vector_codes": op13_vector_codes,
}
ORACLE: dict[str, str] = {"op10_chat": ORACLE_OP10, "op11_collocations": ORACLE_OP11, "op12_licenses": ORACLE_OP12, "op13_vector_codes": ORACLE_OP13}
