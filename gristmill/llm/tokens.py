"""Token counts attributed to sections by offsets.

A document is encoded once, whole; the lengths of its tokens' bytes give their spans, which are joined as
intervals to the spans of its sections. A token that crosses a boundary goes to one section by a rule:
`longest` (the one that holds most of its bytes, of equals the first), `first` (that of its first byte),
or `last` (that of its last byte).
"""

from __future__ import annotations

import base64
import hashlib
import os

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import ship, table

#: Where the vocabulary file of op4_token_counts is: a setting of the session, else a variable of the environment, else a default.
SETTING, VARIABLE = "gristmill.vocabulary", "GRISTMILL_VOCABULARY"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the public byte-level vocabularies split text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("longest", "first", "last")
#: Runs of white space that PATTERN's look-ahead can't take; every one ends a piece before its last character.
LONG_SPACE = regex.compile(r"\p{White_Space}{1000,}")

_KEPT: dict[str, tuple[tiktoken.Encoding, np.ndarray]] = {}


def encoder(ranks: bytes, pattern: str = PATTERN) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoding of a vocabulary file's bytes and each token's length in bytes, kept by a worker over tasks."""
    name = hashlib.sha256(ranks + pattern.encode()).hexdigest()
    if name not in _KEPT:
        table_ = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        size = np.zeros(max(table_.values()) + 1, np.int64)
        for token, k in table_.items():
            size[k] = len(token)
        _KEPT.clear()
        _KEPT[name] = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=table_, special_tokens={}), size
    return _KEPT[name]


def attribute(ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(section of each token, which tokens cross a boundary). Tokens lie end to end from 0; section j is
    [bounds[j], bounds[j + 1])."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    starts = np.concatenate([[0], ends[:-1]])
    first = np.searchsorted(bounds, starts, "right") - 1
    last = np.searchsorted(bounds, ends - 1, "right") - 1
    crossing = last > first
    if rule == "first":
        return first, crossing
    if rule == "last":
        return last, crossing
    out = first.copy()
    for i in np.flatnonzero(crossing).tolist():
        inner = bounds[first[i] : last[i] + 2].clip(starts[i], ends[i])
        out[i] = first[i] + int(np.argmax(np.diff(inner)))
    return out, crossing


def encode(text: str, enc: tiktoken.Encoding) -> list[int]:
    """The tokens of a text. Long runs of white space are taken out before the pattern sees them, as the pieces that it would
    make of them: all of a run at the end, else all but its last character, which goes with what follows."""
    out, at = [], 0
    for run in LONG_SPACE.finditer(text):
        end = run.end() - (run.end() < len(text))
        out += enc.encode_ordinary(text[at : run.start()])
        out += enc._encode_single_piece(text[run.start() : end])
        at = end
    return out + enc.encode_ordinary(text[at:])


def line_bounds(data: np.ndarray) -> np.ndarray:
    """Where the lines of a text begin and the last one ends; a line keeps its line feed."""
    return np.unique(np.concatenate([[0], np.flatnonzero(data == 10) + 1, [len(data)]]))


def count_text(text: str, enc: tiktoken.Encoding, size: np.ndarray, bounds: np.ndarray | None = None, rule: str = "longest") -> tuple[np.ndarray, int]:
    """(tokens of each section, tokens that cross a boundary) of one text; sections are its lines by default."""
    data = text.encode()
    if not data:
        return np.zeros(0, np.int64), 0
    bounds = line_bounds(np.frombuffer(data, np.uint8)) if bounds is None else bounds
    ends = np.cumsum(size[np.array(encode(text, enc), np.int64)])
    section, crossing = attribute(ends, bounds, rule)
    return np.bincount(section, minlength=len(bounds) - 1), int(crossing.sum())


def token_counts(text: Column, ranks: bytes, rule: str = "longest") -> Column:
    """struct<n_tokens, n_crossing, line_tokens> of a text; a null text has no lines."""

    @F.arrow_udf("struct<n_tokens:bigint,n_crossing:bigint,line_tokens:array<bigint>>")
    def run(texts: pa.Array) -> pa.Array:
        enc, size = encoder(ranks)
        counts, crossing = [], []
        for t in texts:
            per_line, crossed = count_text(t.as_py() or "", enc, size, rule=rule)
            counts.append(per_line)
            crossing.append(crossed)
        ends = np.concatenate([[0], np.cumsum([len(c) for c in counts])]).astype(np.int32)
        flat = np.concatenate([np.zeros(0, np.int64), *counts])
        lines = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
        total = np.array([c.sum() for c in counts], np.int64)
        return pa.StructArray.from_arrays([pa.array(total), pa.array(crossing, pa.int64()), lines], ["n_tokens", "n_crossing", "line_tokens"])

    return run(text)


def field_counts(docs: DataFrame, fields: list[str], ranks: bytes, between: str = "\n", rule: str = "longest", name: str = "field_tokens") -> DataFrame:
    """Adds an array with the tokens of each of the string columns `fields`, encoded as one text joined by
    `between`, which counts to the field before it. A null field is empty."""
    ship(docs.sparkSession)

    @F.arrow_udf("array<bigint>")
    def run(*columns: pa.Array) -> pa.Array:
        enc, size = encoder(ranks)
        out = []
        for parts in zip(*[[x.as_py() or "" for x in c] for c in columns]):
            pieces = [p + between for p in parts[:-1]] + [parts[-1]]
            bounds = np.concatenate([[0], np.cumsum([len(p.encode()) for p in pieces])])
            kept = np.flatnonzero(np.diff(bounds) > 0)
            whole = np.zeros(len(pieces), np.int64)
            if len(kept):
                whole[kept] = count_text("".join(pieces), enc, size, np.unique(bounds), rule)[0]
            out.append(whole.tolist())
        return pa.array(out, pa.list_(pa.int64()))

    return docs.withColumn(name, run(*[F.col(f"`{c}`") for c in fields]))


def load(path: str = VOCABULARY) -> bytes:
    """A vocabulary file of token ranks, read by the driver and sent to the workers with the code (under 2 MB)."""
    if not os.path.exists(path):
        raise FileNotFoundError(f"no vocabulary file at {path}: name one by the setting {SETTING} or the variable {VARIABLE}")
    with open(path, "rb") as f:
        return f.read()


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, n_crossing, n_lines, line_tokens of every document, each encoded whole.

    line_tokens sums to n_tokens. A null or empty text has no token and no line. Equal texts count alike; texts of any
    length are encoded whole, long runs of white space included; without rows the result is empty; other columns are
    not read.
    """
    ranks = load(spark.conf.get(SETTING, None) or os.environ.get(VARIABLE) or VOCABULARY)
    docs = table(spark, sf_dir, "documents").select("doc_id", token_counts(F.col("text"), ranks).alias("t"))
    return docs.select("doc_id", "t.n_tokens", "t.n_crossing", F.size("t.line_tokens").cast("long").alias("n_lines"), "t.line_tokens")
