"""Token counts of a unigram vocabulary by count-only Viterbi.

An Aho-Corasick automaton lists every piece that ends at a character; a table over the characters carries the best
score and the number of its pieces. Ties follow the tokenizer library: candidates come longest first and only a strictly
better one replaces another; a character without a piece of its own costs the least score less ten and, with byte
fallback, one token a byte. Scores are added as doubles, so large sums do not blur as they do in single precision.

A space starts a new unit if no piece has one inside, which is checked; the best split of a text is then that of its
units, and each worker keeps the counts of units it has met.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field

import ahocorasick
import pandas as pd
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from gridloom.llm.common import free_name

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN_PENALTY = 10.0
#: Units a worker remembers; beyond, it starts anew.
REMEMBERED = 500_000
SPACE = "▁"
NORMAL, USER_DEFINED = 1, 4


@dataclass
class Vocabulary:
    """What counting needs of a model file: pieces with scores, and how text is normalised."""

    scores: dict[str, float]
    least: float
    byte_fallback: bool
    dummy_prefix: bool
    by_unit: bool
    model: bytes | None = None  # set if the model's own normalisation is needed


def read_vocabulary(path: str = MODEL) -> Vocabulary:
    """Pieces of a model file, with their scores taken as unigram scores. Read by the driver, which sends them on."""
    with open(path, "rb") as f:
        raw = f.read()
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(raw)
    pieces = [p for p in proto.pieces if p.type in (NORMAL, USER_DEFINED)]
    plain = [p.score for p in pieces if p.type == NORMAL]
    top = max(plain)
    # a user-defined piece is always taken: it scores as well as its characters could
    scores = {p.piece: p.score if p.type == NORMAL else len(p.piece.encode()) * top - 0.1 for p in pieces}
    norm = proto.normalizer_spec
    own = bool(norm.precompiled_charsmap) or norm.remove_extra_whitespaces or not norm.escape_whitespaces
    inner = any(SPACE in p.lstrip(SPACE) for p in scores)
    return Vocabulary(scores, min(plain), proto.trainer_spec.byte_fallback, norm.add_dummy_prefix, not inner, raw if own else None)


@dataclass
class Counter:
    """Counts tokens with one vocabulary."""

    vocabulary: Vocabulary
    remembered: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.pieces = ahocorasick.Automaton()
        for piece, score in self.vocabulary.scores.items():
            self.pieces.add_word(piece, (len(piece), score))
        self.pieces.make_automaton()
        self.unit = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+") if self.vocabulary.by_unit else re.compile(r".+", re.S)
        self.normal = sentencepiece.SentencePieceProcessor(model_proto=self.vocabulary.model) if self.vocabulary.model else None

    def tokens(self, unit: str) -> int:
        """Tokens on the best path through `unit`."""
        scores, fallback = self.vocabulary.scores, self.vocabulary.byte_fallback
        unknown = self.vocabulary.least - UNKNOWN_PENALTY
        best, count = [0.0], [0]
        ends = self.pieces.iter(unit)
        end, match = next(ends, (-1, None))
        for i, c in enumerate(unit):
            top, n = None, 0
            while end == i:
                length, score = match
                value = best[i + 1 - length] + score
                if top is None or value > top:
                    top, n = value, count[i + 1 - length] + 1
                end, match = next(ends, (-1, None))
            if c not in scores:
                value = best[i] + unknown
                if top is None or value > top:
                    top, n = value, count[i] + (len(c.encode("utf-8", "surrogatepass")) if fallback else 1)
            best.append(top)
            count.append(n)
        return count[-1]

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if self.normal:
            line = self.normal.normalize(text)
        else:
            line = (SPACE if self.vocabulary.dummy_prefix else "") + text.replace(" ", SPACE)
        seen, total = self.remembered, 0
        for unit in self.unit.findall(line):
            n = seen.get(unit)
            if n is None:
                n = self.tokens(unit)
                if len(unit) < 64:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen[unit] = n
            total += n
        return total


_counters: dict[str, Counter] = {}


def token_count(docs: DataFrame, text: str | Column = "text", vocabulary: Vocabulary | None = None) -> Column:
    """Column of token counts; a null text has none. The vocabulary is broadcast, its size fixed by the model file."""
    shared, token = docs.sparkSession.sparkContext.broadcast(vocabulary or read_vocabulary()), uuid.uuid4().hex

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        if token not in _counters:
            _counters.clear()
            _counters[token] = Counter(shared.value)
        return pd.Series([_counters[token](t) for t in texts], dtype="int64")

    return count(text)


def counted(docs: DataFrame, vocabulary: Vocabulary | None = None, out: str = "n_tokens") -> DataFrame:
    """`docs`, all columns, and `out` (another name if taken), the tokens of its text; null and empty texts have none."""
    return docs.withColumn(free_name(docs.columns, out), token_count(docs, "text", vocabulary))
