"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from .bpe import op5_byte_bpe
from .classify import op8_quality, op10_language_id
from .gif import op2_gif
from .hilbert import op3_hilbert_neighbours
from .mixing import op1_context_mixing
from .near_dup import op7_near_dup
from .oracles import NEAR_DUP, SECRETS
from .packing import op6_packing
from .secrets import op9_secrets
from .token_counts import op4_token_counts

QUERIES: dict[str, Callable[..., DataFrame]] = {
    "op1_context_mixing": op1_context_mixing,
    "op2_gif": op2_gif,
    "op3_hilbert_neighbours": op3_hilbert_neighbours,
    "op4_token_counts": op4_token_counts,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_packing": op6_packing,
    "op7_near_dup": op7_near_dup,
    "op8_quality": op8_quality,
    "op9_secrets": op9_secrets,
    "op10_language_id": op10_language_id,
}

ORACLE: dict[str, str] = {"op7_near_dup": NEAR_DUP, "op9_secrets": SECRETS}
