"""Token counts of a word-end BPE vocabulary without encoding most of the text.

Offline, every vocabulary entry that ends a word is decoded and encoded alone by the tokenizer; those that give one
token are proven whole tokens. A text's pre-tokens that are among them count one each. Only the others go through
the merges, each distinct one once, and their counts are kept.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.llm.tables import ready, struct

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: Counts kept by a worker for words and pre-tokens that are no whole token, and the longest one that is kept.
KEPT = 400_000
LONGEST = 40
#: Pre-tokens of one call of the tokenizer.
JOINED = 5000

#: The split pattern of the vocabulary file below U+0300, where classes are written out: white space is U+0009-U+000D,
#: space, U+0085 and U+00A0; letters and numbers are those of Unicode.
_LETTERS = r"a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u02c1\u02c6-\u02d1\u02e0-\u02e4\u02ec\u02ee"
_NUMBERS = r"0-9\xb2\xb3\xb9\xbc-\xbe"
_PRE_TOKENS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\t-\r \x85\xa0{_LETTERS}{_NUMBERS}]+")
#: Texts with these go through the library's own normalizer and splitter. U+001C-U+001F are white space for Python only.
_BEYOND = re.compile("[\x1c-\x1f\u0300-\U0010ffff]")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def whole_tokens(tokenizer) -> frozenset[str]:
    """The strings that the tokenizer gives as one token when they are a whole pre-token."""
    from tokenizers.pre_tokenizers import ByteLevel

    byte_of = {c: b for b, c in enumerate(_byte_characters())}
    assert set(byte_of) == set(ByteLevel.alphabet())
    found = []
    for entry in tokenizer.get_vocab(with_added_tokens=False):
        if entry.endswith("</w>"):
            try:
                found.append(bytes(byte_of[c] for c in entry.removesuffix("</w>")).decode())
            except (KeyError, UnicodeDecodeError):
                continue  # part of a character: never a pre-token
    lone = [s for s in found if s and s == tokenizer.normalizer.normalize_str(s) and len(tokenizer.pre_tokenizer.pre_tokenize_str(s)) == 1]
    encoded = tokenizer.encode_batch(lone, add_special_tokens=False)
    return frozenset(s for s, e in zip(lone, encoded) if len(e.ids) == 1)


def _byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    shift = iter(range(256, 512))
    return [chr(b if b in shown else next(shift)) for b in range(256)]


class Counter:
    """Counts tokens as `len(tokenizer.encode(text, add_special_tokens=False).ids)` does."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread a Spark task
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.whole = whole_tokens(self.tokenizer)
        special = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special)))
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, np.bool_)
        self.ends[[i for entry, i in vocabulary.items() if entry.endswith("</w>")]] = True
        self.known: dict[str, int] = dict.fromkeys(self.whole, 1)

    def _units(self, text: str) -> list[str]:
        """What a text's count is the sum of: words between white space, or the pre-tokens themselves."""
        lowered = text.lower()
        if _BEYOND.search(lowered) is None:
            # nothing to compose below U+0300, lower case is per character there, and no pre-token holds white space
            return lowered.split()
        normal = self.tokenizer.normalizer.normalize_str(text)
        return [normal[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]

    def _merge(self, tokens: list[str]) -> dict[str, int]:
        """Counts of pre-tokens through the merges: encoded with spaces between, cut at tokens that end a word."""
        counts: list[int] = []
        for at in range(0, len(tokens), JOINED):
            ids = np.array(self.tokenizer.encode(" ".join(tokens[at : at + JOINED]), add_special_tokens=False).ids)
            counts += np.diff(np.flatnonzero(self.ends[ids]), prepend=-1).tolist()
        return dict(zip(tokens, counts, strict=True))

    def _merged(self, unknown: set[str]) -> dict[str, int]:
        """Counts of units that are not known: their whole tokens count one, the rest goes through the merges."""
        split = {unit: _PRE_TOKENS.findall(unit) if _BEYOND.search(unit) is None else [unit] for unit in unknown}
        rest = list({token for tokens in split.values() for token in tokens if token not in self.known})
        merged = self._merge(rest)
        for token, n in merged.items():
            if len(token) <= LONGEST:
                self.known[token] = n
        return {unit: sum(merged[t] if t in merged else self.known[t] for t in tokens) for unit, tokens in split.items()}

    def counts(self, texts) -> list[int]:
        """One count a text."""
        if len(self.known) > KEPT + len(self.whole):
            self.known = dict.fromkeys(self.whole, 1)
        units, totals, unknown = [], [], set()
        for text in texts:
            pieces = self.special.split(text) if "<|" in text else [text]
            own = self._units(pieces[0]) if len(pieces) == 1 else [u for piece in pieces for u in self._units(piece)]
            totals.append(len(pieces) - 1)
            units.append(own)
            unknown.update(set(own).difference(self.known))
        found = self._merged(unknown)
        self.known.update((s, n) for s, n in found.items() if len(s) <= LONGEST)
        long = any(len(s) > LONGEST for s in found)
        get = {**found, **self.known}.__getitem__ if long else self.known.__getitem__
        return [total + sum(map(get, own)) for total, own in zip(totals, units)]


@lru_cache(maxsize=2)
def _counter(path: str) -> Counter:
    return Counter(path)


def counted(path: str):
    """The UDF that gives the size in bytes and the number of tokens of each text."""

    @F.pandas_udf(struct("n_bytes long, n_tokens long"))
    def run(text: pd.Series) -> pd.DataFrame:
        plain = [t if t is not None else "" for t in text]
        return pd.DataFrame({"n_bytes": [len(t.encode()) for t in plain], "n_tokens": _counter(path).counts(plain)})

    return run


def token_counts(
    documents: DataFrame, path: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: `doc_id, n_bytes, n_tokens, over_limit`, as the tokenizers library counts.

    No begin, end or added special tokens, no truncation or padding; special strings inside a text are one token
    each. `path` names the vocabulary file, which every worker must have at that place. A null text is empty: no
    bytes, no tokens. Rows are independent, so repeated rows and null ids come back as they are.
    """
    path = path or vocabulary_path()
    source = ready(documents).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = source.select("doc_id", counted(path)("text").alias("c")).select("doc_id", "c.*")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
