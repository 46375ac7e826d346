"""Column functions on text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import arrow_udf


def strip(c: Column) -> Column:
    """The text without white space at either end, any white space."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def count_tokens(c: Column) -> Column:
    """Deterministic token count: runs of letters and digits, and single other characters that are no white space."""
    return F.regexp_count(c, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")).cast("long")


def vocabulary(name: str = "word_bpe_49k.json") -> str | None:
    """The file of a public tokenizer's vocabulary, or None where there is none."""
    try:
        import public_tokenizers
    except ImportError:
        return None
    return str(public_tokenizers.path(name))


_ENCODERS: dict = {}
#: Characters that are encoded at once.
ENCODED = 262_144


def encoded_tokens(c: Column, path: str | None) -> Column:
    """Tokens by the vocabulary of a tokenizer file; ``count_tokens`` where none is given."""
    if path is None:
        return count_tokens(c)

    @arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if path not in _ENCODERS:
            from tokenizers import Tokenizer

            _ENCODERS[path] = Tokenizer.from_file(path)
        for texts in batches:
            # encodings take many times a text's size: few texts at a time
            n, some, size = [], [], 0
            for t in texts:
                some.append(t.as_py() or "")
                size += len(some[-1])
                if size >= ENCODED or len(some) >= 256:
                    n += [len(e.ids) for e in _ENCODERS[path].encode_batch_fast(some, add_special_tokens=False)]
                    some, size = [], 0
            n += [len(e.ids) for e in _ENCODERS[path].encode_batch_fast(some, add_special_tokens=False)]
            yield pc.if_else(texts.is_valid(), pa.array(n, pa.int64()), pa.scalar(None, pa.int64()))

    return count(c)


def truncate(c: Column, tokens: int, mark: str = "...(truncated)") -> Column:
    """The first four characters a token, marked where something was cut."""
    n = 4 * tokens
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(mark))).otherwise(c)


def doc_key(c: Column) -> Column:
    """A file name as a key: no square brackets, spaces as underscores."""
    return F.replace(F.translate(c, "[]", ""), F.lit(" "), F.lit("_"))


def key_document(c: Column) -> Column:
    """The document part of a chunk id, up to its last underscore."""
    return F.regexp_extract(c, r"(?s)^(.*)_([^_]*)$", 1)


def label_name(c: Column, default: str, upper: bool = False) -> Column:
    """A graph label: letters, digits and underscores of any script, else the default."""
    clean = F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N}_]", "")
    return F.coalesce(F.nullif(F.upper(clean) if upper else clean, F.lit("")), F.lit(default))


def unfence(c: Column) -> Column:
    """JSON text without the Markdown fence around it."""
    return F.regexp_replace(F.regexp_replace(c, r"^\s*```(json)?\s*", ""), r"\s*```\s*$", "")


def signature(c: Column) -> Column:
    """What must be found again of a ground truth: its first 50 characters, stripped; null if blank."""
    return F.nullif(F.substring(strip(c), 1, 50), F.lit(""))


def words(c: Column) -> Column:
    """White-space tokens, case kept."""
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")
