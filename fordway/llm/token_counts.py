"""Token counts: encode whole texts with a public tokenizer and keep the lengths only.

Batches are balanced by bytes, not rows, so a task holds a few megabytes of text whatever the rows are like. A long
text is cut where no token can straddle: before a space that follows something else than a space. In a vocabulary
that marks word starts by U+2581, no piece has that mark after another character (checked when the model is loaded),
so no merge reaches over such a cut; the next part is encoded without its space, since the encoder itself puts one
mark in front of every input (tried on loading, too). With any other model texts are encoded whole.

Nulls count as the empty text (0 bytes, 0 tokens). Ties, repeated rows and repeated or null ids are no matter: each
row is counted by itself. An empty table gives an empty result. Only the id and the text are read, so extra columns
can have any name.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, functions as F

from .common import map_texts

MARK = "▁"
CUT = re.compile(f"(?<=[^ {MARK}]) (?=.)", re.S)


def safe_parts(text: str, size: int) -> Iterator[str]:
    """Parts of about `size` characters whose token counts add up to the whole text's."""
    start = 0
    while len(text) - start > size:
        cut = CUT.search(text, start + size)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.end()
    yield text[start:]


def piece_counter(model_path: str, part: int = 1 << 16) -> Callable[[list[str]], list[int]]:
    """A function from texts to token counts, by sentencepiece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    straddles = any(MARK in model.id_to_piece(i).lstrip(MARK) for i in range(model.get_piece_size()))
    # nor may the cut be seen in other ways: a model without a mark in front, or one that drops it, takes texts whole
    size = lambda text: len(model.encode(text))
    straddles = straddles or any(size(a + gap + b) != size(a) + size(gap[1:] + b) for a in ("a", "word", "1", ".") for b in ("b", "Word", "2", ",") for gap in (" ", "  "))

    def count(batch: list[str]) -> list[int]:
        totals = [0] * len(batch)
        parts: list[str] = []
        owner: list[int] = []
        held = 0

        def flush() -> None:
            nonlocal held
            for k, ids in zip(owner, model.encode(parts, num_threads=1), strict=True):
                totals[k] += len(ids)
            parts.clear()
            owner.clear()
            held = 0

        for k, text in enumerate(batch):
            for piece in [text] if straddles else safe_parts(text, part):
                parts.append(piece)
                owner.append(k)
                held += len(piece)
                if held >= 4 * part:
                    flush()
        if parts:
            flush()
        return totals

    return count


def json_counter(model_path: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to token counts, by tokenizers; whole texts, as its normalisers may look anywhere."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(model_path)
    model.no_truncation()
    model.no_padding()
    return lambda batch: [len(x.ids) for x in model.encode_batch(batch, add_special_tokens=False)]


def count_tokens(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens for every row. model_path: a .model (sentencepiece) or .json (tokenizers) file."""
    counter = json_counter if model_path.endswith(".json") else piece_counter

    def make():
        count = counter(model_path)
        return lambda batch: {"n_bytes": [len(x.encode()) for x in batch], "n_tokens": count(batch)}

    return map_texts(df, [id_col], text_col, "n_bytes long, n_tokens long", make)


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    counted = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)
