"""The queries of the text operators and their SQL."""

from __future__ import annotations

from .byte_bpe import op3_byte_bpe
from .decontaminate import op1_decontaminate
from .line_dedup import op7_line_dedup
from .media import op4_media
from .pii import op6_pii
from .secrets import op10_secrets
from .sharding import op5_sharding
from .simhash import op9_simhash
from .sql import DECONTAMINATE, SECRETS
from .token_counts import op2_token_counts
from .toxicity import op8_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_decontaminate,
        op2_token_counts,
        op3_byte_bpe,
        op4_media,
        op5_sharding,
        op6_pii,
        op7_line_dedup,
        op8_toxicity,
        op9_simhash,
        op10_secrets,
    )
}
SQL: dict[str, str] = {"op1_decontaminate": DECONTAMINATE, "op10_secrets": SECRETS}
