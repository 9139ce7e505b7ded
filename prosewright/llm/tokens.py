"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are cut where no token of a byte-level BPE can cross (before a space or line feed that follows a
letter, digit or punctuation mark), the pieces are dealt into encoder calls of about equal bytes, and the piece
lengths are summed per row.  A text of any length therefore costs bounded memory besides itself.

Null text counts as the empty text: 0 bytes, 0 tokens.  Repeated rows are counted each; an empty table gives an
empty result; further columns of the input are ignored unless named in ``keep``.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import types as T

PIECE_CHARS = 16_384
CALL_BYTES = 1 << 20

_ENCODERS: dict[str, object] = {}
#: a white-space character may start a piece if what precedes it is surely not white space
_SAFE = re.compile(r"(?<=[\w!-/:-@\[-`{-~])[ \n]")
_SAFE_SEARCH = 4_096


def tokenizer_path(name: str) -> str:
    """A file name is looked up among the installed public tokenizers on the node that runs this."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def load_tokenizer(name: str):
    """One tokenizer per Python worker and file, single-threaded: Spark's tasks are the parallelism."""
    if name not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        path = tokenizer_path(name)
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
        elif path.endswith(".model"):
            import sentencepiece

            tok = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            raise ValueError(f"no library for tokenizer file {path}")
        _ENCODERS[name] = tok
    return _ENCODERS[name]


def safe_pieces(text: str, size: int = PIECE_CHARS) -> Iterable[str]:
    """Pieces of about ``size`` characters whose byte-level BPE ids, concatenated, are the text's ids.

    Without a safe boundary the piece grows until one comes, at worst to the whole text.
    """
    if len(text) <= size:
        return (text,) if text else ()
    out, at = [], 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size)
        if cut is None:
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    out.append(text[at:])
    return out


def byte_balanced(pieces: list[str], limit: int = CALL_BYTES) -> Iterator[list[int]]:
    """Positions of pieces, grouped so that each group has about ``limit`` UTF-8 bytes."""
    group, held = [], 0
    for i, piece in enumerate(pieces):
        group.append(i)
        held += len(piece) if piece.isascii() else len(piece.encode("utf-8", "surrogatepass"))
        if held >= limit:
            yield group
            group, held = [], 0
    if group:
        yield group


def piece_lengths(name: str, pieces: list[str]) -> list[int]:
    tok = load_tokenizer(name)
    out: list[int] = []
    for group in byte_balanced(pieces):
        chunk = [pieces[i] for i in group]
        if name.endswith(".model"):
            out += [len(ids) for ids in tok.encode(chunk, num_threads=1)]
        else:
            out += [len(e) for e in tok.encode_batch_fast(chunk, add_special_tokens=False)]
    return out


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_bytes and n_tokens of every row's whole text; one scan, no shuffle."""
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    whole = tokenizer.endswith(".model")

    def counted(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            texts = batch.column(len(keep))
            n_bytes = pc.fill_null(pc.binary_length(texts), 0)
            pieces: list[str] = []
            owner: list[int] = []
            for row, value in enumerate(texts.to_pylist()):
                if value:
                    cut = (value,) if whole else safe_pieces(value)
                    pieces.extend(cut)
                    owner.extend([row] * len(cut))
            sums = np.bincount(np.array(owner, "i8"), weights=np.array(piece_lengths(tokenizer, pieces), "f8"), minlength=batch.num_rows) if pieces else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], n_bytes.cast(pa.int64()), pa.array(sums.astype("i8"))], names=[*keep, "n_bytes", "n_tokens"])

    return docs.select(*keep, docs[text].cast("string").alias("text")).mapInArrow(counted, schema)
