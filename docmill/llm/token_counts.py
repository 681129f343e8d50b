"""Token counts: encode in batches and return lengths only."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docmill.llm.shared import per_text

#: Distinct pieces encoded in one call hold about so many bytes.
BATCH_BYTES = 256 << 10
#: A task forgets the pieces it has seen beyond so many.
SEEN_PIECES = 2_000_000
#: A piece ends where white space follows another character. No token of a tokenizer
#: that keeps white space with the word behind it reaches over that place.
PIECE = re.compile(r"\s*\S+|\s+")
FIELDS = T.StructType(
    [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("over_limit", T.BooleanType()),
    ]
)


def split_pieces(text: str) -> list[str]:
    """The text cut at every safe boundary; the pieces joined give the text."""
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        # Python takes these for white space and the tokenizer does not.
        return [text]
    if "  " in text or not text.isprintable():
        return PIECE.findall(text)
    head, *rest = text.split(" ")
    return ([head] if head else []) + [" " + x for x in rest]


def batches(pieces: list[str], limit: int = BATCH_BYTES) -> list[list[str]]:
    """Lists of pieces of about equal bytes: sorted by size, so that a batch is even."""
    sized = sorted((len(p) if p.isascii() else len(p.encode()), p) for p in pieces)
    out: list[list[str]] = [[]]
    held = 0
    for size, piece in sized:
        if held + size > limit and out[-1]:
            out.append([])
            held = 0
        out[-1].append(piece)
        held += size
    return out


def count_tokens(
    df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
    limit: int = 512,
) -> DataFrame:
    """Bytes and tokens of every text, and whether it has more than ``limit`` tokens.

    ``path`` names a tokenizers file whose pre-tokenizer keeps white space with the word
    behind it. No special tokens are added; special strings in a text are handled as by the
    library's default. Every text is cut at safe boundaries, each distinct piece of a slice is
    encoded once, and only lengths are kept.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows stay; columns other than
    ``keep`` are not read, so their names cannot clash. An empty table gives an empty result.
    """

    def start():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        seen: dict[str, int] = {}

        def work(texts: list) -> dict:
            cut = [split_pieces(t) if t else [] for t in texts]
            new = set().union(*cut).difference(seen)
            if len(seen) + len(new) > SEEN_PIECES:
                seen.clear()
                new = set().union(*cut)
            for batch in batches(list(new)):
                encoded = tokenizer.encode_batch_fast(batch, add_special_tokens=False)
                seen.update(zip(batch, map(len, encoded)))
            counts = [sum(map(seen.__getitem__, pieces)) for pieces in cut]
            return {
                "n_bytes": [len(t.encode()) if t else 0 for t in texts],
                "n_tokens": counts,
                "over_limit": [n > limit for n in counts],
            }

        return work

    return per_text(df, text, list(keep), FIELDS, start)
