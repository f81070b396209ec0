"""Token counts with the whole-token shortcut.

A vocabulary string is *whole* if it encodes, alone, as exactly one token; that is proved once per process by encoding
every candidate with the library itself. In a text, a pre-token that is whole counts one without any merging; only the
rest is merged, and each distinct rest string once per task.
"""

from __future__ import annotations

import functools
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ledgerloom.llm.common import arrow_map, numbered

#: Pieces of an ASCII word, lower-cased, by the vocabulary's own pre-tokenizer pattern restricted to ASCII. Fixed value.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
#: White space as the normalizer's pattern knows it; str.split() also takes the four separators U+001C to U+001F.
WHITE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
CONTROL = re.compile("[\x1c-\x1f]")
#: Longest word that is remembered, and how many.
WORD, WORDS = 48, 300_000


class Counter49k:
    """Counts the tokens of a text as the library does, without special tokens added."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = self._prove()
        self.known: dict[str, int] = {}

    def _prove(self) -> frozenset[str]:
        names = (v[:-4] for v in self.tokenizer.get_vocab() if v.endswith("</w>"))
        names = [v for v in names if v and v.isascii() and PIECES.fullmatch(v)]
        encoded = self.tokenizer.encode_batch(names, add_special_tokens=False)
        return frozenset(v for v, e in zip(names, encoded, strict=True) if len(e.ids) == 1)

    def merged(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def word(self, word: str) -> int:
        n = self.known.get(word)
        if n is None:
            # outside ASCII, letters and normal forms are the library's business; special strings and separators too
            if not word.isascii() or CONTROL.search(word) or any(s in word for s in self.specials):
                n = self.merged(word)
            else:
                n = sum(1 if p in self.whole else self.merged(p) for p in PIECES.findall(word.lower()))
            if len(word) <= WORD and len(self.known) < WORDS:
                self.known[word] = n
        return n

    def count(self, text: str) -> int:
        words = text.split() if not CONTROL.search(text) else [w for w in WHITE.split(text) if w]
        if len(words) > 2000:
            return sum(k * self.word(w) for w, k in Counter(words).items())
        known, word = self.known, self.word
        return sum(known.get(w) or word(w) for w in words)


@functools.cache
def counter(path: str) -> Counter49k:
    return Counter49k(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """All columns of docs but the text, with n_bytes, n_tokens (named by `out`) and over_limit.

    `path` names a tokenizers file that every executor can read (it is public and small, and installed with them).
    Null texts count as empty: 0 bytes, 0 tokens. Repeated rows each give a row; an empty table gives an empty one.
    Columns of docs with the names of the new columns are replaced by these. Whole texts are read, whatever their length.
    """
    rest = [c for c in docs.columns if c not in (text, "n_bytes", out, "over_limit")]
    rows, own = numbered(docs)
    narrow = rows.select(*[own[c] for c in rest], F.coalesce(F.col(own[text]), F.lit("")).alias("__text"))

    def run(batches):
        count = counter(path).count
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            n = pa.array([count(t) for t in texts], pa.int64())
            size = pa.array([len(t.encode()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], size, n], names=[*b.schema.names[:-1], "n_bytes", out])

    fields = StructType([StructField(own[c], docs.schema[c].dataType) for c in rest])
    fields = fields.add("n_bytes", "long").add(out, "long")
    return arrow_map(narrow, run, fields).withColumn("over_limit", F.col(f"`{out}`") > limit).toDF(*rest, "n_bytes", out, "over_limit")
