"""Sizes of texts in tokens of a public byte-level BPE vocabulary.

A text is cut into atoms: a run of white space together with the stretch that
follows it.  The vocabulary's own pre-splitting never joins characters across
the start of such an atom, so the tokens of a text are exactly those of its
atoms, and the counts of short atoms can be kept.  An atom is encoded as a
whole, however long it is: the encoder merges in n log n steps.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ranks of the vocabulary; a parameter of every operator that counts tokens.
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# White space as the pattern knows it (Unicode's White_Space).
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
ATOMS = re.compile(rf"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: Longest atom whose count is kept, and how many are kept in a worker.
KEPT_CHARS, KEPT_ATOMS = 48, 300_000


class Counter(dict):
    """Token counts of atoms, looked up by ``counts[atom]``."""

    def __init__(self, vocabulary: str = DEFAULT_VOCABULARY):
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}
        self.encoding = tiktoken.Encoding(os.path.basename(vocabulary), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, atom: str) -> int:
        n = len(self.encoding.encode_ordinary(atom))
        if len(atom) <= KEPT_CHARS:
            if len(self) >= KEPT_ATOMS:
                self.clear()
            self[atom] = n
        return n

    def count(self, text: str | None) -> int:
        return sum(map(self.__getitem__, ATOMS.findall(text))) if text else 0


@lru_cache(maxsize=2)
def counter(vocabulary: str, sent: str | None = None) -> Counter:
    """One counter per worker process; the kept counts serve all tasks that run in it.  ``sent`` is what ``ship`` gave."""
    path = SparkFiles.get(sent) if sent else vocabulary
    return Counter(path if os.path.exists(path) else vocabulary)


def ship(spark: SparkSession, vocabulary: str) -> str | None:
    """Send the vocabulary's file to the executors, once a session, so that they need no copy at the same path; its name there.

    None if another file of this name was sent before: then the path itself is read.
    """
    name = os.path.basename(vocabulary)
    known = {os.path.basename(f): f for f in spark.sparkContext.listFiles}
    if name not in known:
        spark.sparkContext.addFile(vocabulary)
        return name
    return name if known[name].endswith(os.path.abspath(vocabulary)) else None


def token_counts(df: DataFrame, keys: dict[str, Column], text: str, vocabulary: str = DEFAULT_VOCABULARY, name: str = "n_tokens") -> DataFrame:
    """The ``keys`` and the number of tokens of each whole text; 0 for null and empty texts."""
    small = df.select(*(c.alias(k) for k, c in keys.items()), F.col(text).alias("_text"))
    kept = small.drop("_text")
    sent = ship(df.sparkSession, vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(vocabulary, sent)
        for batch in batches:
            *columns, texts = batch.columns
            sizes = pa.array([counts.count(t) for t in texts.to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*columns, sizes], names=[*batch.schema.names[:-1], name])

    schema = kept.withColumn(name, F.lit(0).cast("bigint")).schema
    return small.mapInArrow(run, schema)
