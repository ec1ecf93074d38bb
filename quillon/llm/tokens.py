"""Token counts with a shortcut for whole tokens.

Before any text is read, each vocabulary string is run through the merges alone; those that come out as one token are proven whole. In a
text, a pre-token that is proven whole counts 1 at once, and only the others are merged. Texts of characters in PLAIN are split by a
pattern that equals the library's splitter on all of them (a test compares every one); other texts are split by the library itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILE, LIMIT = "byte_bpe_50k.json", 512
#: Code points of texts split here, as ranges.
PLAIN = ((0x00, 0x24F), (0x2000, 0x206F))
#: Merged pre-tokens that a worker remembers, and pre-tokens handled at once in one text.
MEMORY, RUN = 300_000, 100_000


def tokenizer_path(name: str = FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _ranges(property_: str) -> str:
    one = regex.compile(property_)
    return "".join(re.escape(chr(c)) for a, b in PLAIN for c in range(a, b + 1) if one.match(chr(c)))


@lru_cache(1)
def plain_pattern() -> re.Pattern:
    """The byte-level splitter over PLAIN: contractions, letters, numbers, others, white space."""
    letter, number, space = _ranges(r"\p{L}"), _ranges(r"\p{N}"), _ranges(r"\s")
    return re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


def byte_alphabet() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Counter:
    """Counts tokens as the tokenizer in a JSON file does, special strings in texts included."""

    def __init__(self, definition: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.model, self.splitter = self.tokenizer.model, self.tokenizer.pre_tokenizer
        special = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        plain = "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in PLAIN)
        self.other = re.compile(f"[^{plain}]")
        self.alphabet = byte_alphabet()
        self.whole = self.proven(set(special))
        self.counts = dict(self.whole)

    def proven(self, special: set[str]) -> dict[str, int]:
        """Pre-tokens that are one token: vocabulary strings that the merges alone turn into themselves."""
        back = {c: b for b, c in enumerate(self.alphabet)}
        out = {}
        for token in self.tokenizer.get_vocab():
            if token in special or len(self.model.tokenize(token)) != 1:
                continue
            try:
                out[bytes(back[c] for c in token).decode()] = 1
            except (KeyError, UnicodeDecodeError):
                continue  # part of a character: no pre-token by itself
        return out

    def merged(self, pre: str) -> int:
        return len(self.model.tokenize("".join(self.alphabet[b] for b in pre.encode())))

    def _sum(self, pres: Iterator[str]) -> int:
        total = 0
        while run := list(islice(pres, RUN)):
            try:
                total += sum(map(self.counts.__getitem__, run))
            except KeyError:
                for pre in run:
                    if pre not in self.counts:
                        if len(self.counts) > len(self.whole) + MEMORY:
                            self.counts = dict(self.whole)
                        self.counts[pre] = self.merged(pre)
                    total += self.counts[pre]
        return total

    def _plain(self, text: str) -> int:
        if self.other.search(text):
            return self._sum(text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text))
        return self._sum(m.group() for m in plain_pattern().finditer(text)) if len(text) > 1 << 20 else self._sum(iter(plain_pattern().findall(text)))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        return sum(map(self._plain, filter(None, self.special.split(text)))) + sum(1 for _ in self.special.finditer(text))


@lru_cache(2)
def counter(definition: str) -> Counter:
    return Counter(definition)


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) for each row, in the input's partitions; NULL text is empty and has 0 tokens.

    The driver reads the tokenizer (1.5 MB, a property of the file and not of the data) and sends it to the workers. Repeated rows count
    once each; other columns aren't read.
    """
    with open(path or tokenizer_path(), encoding="utf-8") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(definition.value).count
        for batch in batches:
            texts = batch.column(1)
            tokens = [count(texts[i].as_py()) for i in range(len(texts))]
            n_bytes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], names=[key, "n_bytes", "n_tokens", "over_limit"])

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string")).mapInArrow(counted, f"`{key}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
