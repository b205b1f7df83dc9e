"""Token counts by the whole-token shortcut.

Most pre-tokens of ordinary text are themselves vocabulary strings, and for nearly all of
those it can be proved once, from the vocabulary alone, that they encode to exactly one
token. Counting then needs one dictionary look-up for such a pre-token; only the rest go
through byte-pair merging, each distinct one once per worker.

Defined results: a null text counts as empty (0 bytes, 0 tokens); texts of any length are
counted whole; repeated rows give repeated results; other input columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from textloom.llm.common import map_batches

#: The pre-tokenisation pattern of byte-level BPE.
PRETOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Characters beyond those on whose classes the pattern above and the library are tested to agree.
BEYOND_TESTED = regex.compile(r"[^\x00-ɏ]")
#: Distinct merged pre-tokens that a worker remembers before it starts afresh.
REMEMBERED = 400_000


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte: itself where printable, else from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Counts(dict):
    """Pre-token to token count; merges and remembers what it has not seen."""

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.letters = byte_alphabet()
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.between = regex.compile("|".join(regex.escape(s) for s in self.specials)) if self.specials else None
        self.proved = self.prove()
        self.update(self.proved)
        self.seen: dict[str, bool] = {}

    def merged(self, pretoken: str) -> int:
        return len(self.tokenizer.model.tokenize("".join(self.letters[b] for b in pretoken.encode())))

    def prove(self) -> dict[str, int]:
        """The vocabulary strings that are one pre-token and encode alone as one token."""
        bytes_of = {c: b for b, c in self.letters.items()}
        found = {}
        for piece in self.tokenizer.get_vocab(with_added_tokens=False):
            try:
                text = bytes(bytes_of[c] for c in piece).decode()
            except (KeyError, UnicodeDecodeError):
                continue
            if PRETOKENS.findall(text) == [text] and self.merged(text) == 1:
                found[text] = 1
        return found

    def agrees(self, c: str) -> bool:
        """Whether the library cuts as the pattern does beside a character: letters join letters, and so on."""
        if c not in self.seen:
            probe = f"a{c}a1{c}1.{c}. {c} {c}{c}  {c}a {c}1 {c}.\n{c}\n {c}"
            found = [x for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(probe)]
            self.seen[c] = found == ["".join(self.letters[b] for b in x.encode()) for x in PRETOKENS.findall(probe)]
        return self.seen[c]

    def __missing__(self, pretoken: str) -> int:
        if len(self) > len(self.proved) + REMEMBERED:
            self.clear()
            self.update(self.proved)
        n = self.merged(pretoken)
        if len(pretoken) <= 64:
            self[pretoken] = n
        return n

    def count(self, text: str) -> int:
        if BEYOND_TESTED.search(text) and not all(map(self.agrees, set(BEYOND_TESTED.findall(text)))):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if self.between is None or not any(s in text for s in self.specials):
            return sum(map(self.__getitem__, PRETOKENS.findall(text)))
        parts = self.between.split(text)
        return len(parts) - 1 + sum(sum(map(self.__getitem__, PRETOKENS.findall(p))) for p in parts)


@lru_cache(2)
def counts(path: str) -> Counts:
    return Counts(path)


def token_counts(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """One row (id, n_bytes, n_tokens, over_limit) per input row. vocabulary: a tokenizers .json file."""
    id_type = df.schema[id_col].dataType

    def per_batch(b: pa.RecordBatch) -> pa.RecordBatch:
        of = counts(vocabulary)
        texts = pc.fill_null(b.column(1), "")
        tokens = [of.count(t) for t in texts.to_pylist()]
        sizes = pc.cast(pc.binary_length(texts), pa.int64())
        return pa.RecordBatch.from_arrays([b.column(0), sizes, pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens])], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    return map_batches(df.select(id_col, text_col), per_batch, f"`{id_col}` {id_type.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean")
