"""Token counts by a compiled finite-state transducer.

A greedy merge vocabulary gives every prefix of a text one last token: the one
suffix that is a token and stands after the last token of what is before it as
an undisturbed pair. What the rest of the text needs to know of a prefix is
therefore finite: for each place from which a token may still reach beyond the
end, the token that ends there and by how many tokens that place is ahead or
behind. That is the state. Reading a character leads to one next state, and
the transition is annotated with the change of the token count. States and
transitions are compiled when they are first met and shared by all texts of a
worker; the table is bounded by the vocabulary, not by the texts.

No token spans from a visible character to a space, so at each such place the
transducer is in its start state again. The texts of a batch are cut there
into chunks; a chunk's state map takes the start state to itself and emits its
count, maps compose by addition, and one prefix scan over all chunks of the
batch gives every document's count as a difference. Equal chunks have equal
maps, computed once.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.llm.arrow import by_bytes, tidy
from triagelake.llm.shared import table

SPACE = "▁"
_CHUNKS = re.compile(f"{SPACE}+[^{SPACE}]*")
#: Chunk maps and pairs, and states, that a worker remembers before it starts anew: memory only, results do not depend on it.
REMEMBERED = 400_000
STATES = 400_000


class Transducer:
    """Over the pieces of a merge vocabulary (text and rank, lower merges first; other characters fall back to bytes)."""

    def __init__(self, ranks: dict[str, int]):
        self.ranks = ranks
        self.heads = {p[:k] for p in ranks for k in range(1, len(p))}
        self.pairs: dict[tuple[str, str], bool] = {}
        #: A state's key: for each open place, the text since, the token that ends there, and its count less the present one.
        self.start_key = (("", "", 0),)
        self.keys = [self.start_key]
        self.numbers = {self.start_key: 0}
        self.moves: list[dict[str, tuple[int, int]]] = [{}]

    def merged(self, text: str) -> list[str]:
        """The tokens of a short text by merging outright; only pairs of tokens are ever asked."""
        parts, ranks = list(text), self.ranks
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def undisturbed(self, a: str, b: str) -> bool:
        """Whether token b may follow token a (none: the start, or a character of bytes)."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) > REMEMBERED:
                self.pairs.clear()
            want = [a, b] if a else [b]
            found = self.pairs[a, b] = self.merged(a + b) == want
        return found

    def compile(self, state: int, char: str) -> tuple[int, int]:
        """The transition from a state on a character: next state, emitted tokens."""
        grown = [(text + char, last, ahead) for text, last, ahead in self.keys[state]]
        for text, last, ahead in grown:
            if text in self.ranks and self.undisturbed(last, text):
                token, emit = text, ahead + 1
                break
        else:  # not in the vocabulary: its bytes, with which nothing merges
            if char in self.ranks:
                raise RuntimeError(f"no last token for {char!r}; the vocabulary cannot be compiled")
            token, emit, grown = "", len(char.encode()), []
        key = (*((t, last, ahead - emit) for t, last, ahead in grown if t in self.heads), ("", token, 0))
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.keys)
            self.keys.append(key)
            self.moves.append({})
        self.moves[state][char] = number, emit
        return number, emit

    def run(self, chunk: str, state: int = 0) -> tuple[int, int]:
        """The state map of a chunk at a state: where it leads, and the tokens emitted."""
        total, moves = 0, self.moves
        for char in chunk:
            step = moves[state].get(char)
            state, emit = step if step is not None else self.compile(state, char)
            total += emit
        return state, total


class _Maps(dict):
    """Emitted tokens by chunk, from the start state."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer = transducer

    def __missing__(self, chunk: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        if len(self.transducer.keys) > STATES:
            self.transducer = Transducer(self.transducer.ranks)
        count = self.transducer.run(chunk)[1]
        if len(chunk) <= 64:
            self[chunk] = count
        return count


@functools.lru_cache(2)
def load(path: str) -> _Maps:
    """The transducer of a sentencepiece merge model with byte fallback that leaves texts as they are but for a leading space."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    if sp.normalize(" a  B　ﬁ ") != f"{SPACE}{SPACE}a{SPACE}{SPACE}B　ﬁ{SPACE}":
        raise ValueError("only models that leave texts as they are can be compiled")
    if not any(sp.is_byte(i) for i in range(sp.vocab_size())):
        raise ValueError("only models with byte fallback can be compiled")
    plain = [i for i in range(sp.vocab_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    pieces = {sp.id_to_piece(i): sp.get_score(i) for i in plain}
    if any(SPACE in p.lstrip(SPACE) for p in pieces):
        raise ValueError("a piece spans words")
    scores = {s: k for k, s in enumerate(sorted(set(pieces.values()), reverse=True))}
    return _Maps(Transducer({p: scores[s] for p, s in pieces.items()}))


def count_texts(texts: Iterable[str | None], maps: _Maps) -> np.ndarray:
    """Tokens of each text: chunk maps of all texts, one prefix scan, differences at the texts' ends."""
    chunks: list[str] = []
    ends = [0]
    for text in texts:
        if text:
            chunks += _CHUNKS.findall(SPACE + text.replace(" ", SPACE))
        ends.append(len(chunks))
    scan = np.concatenate(([0], np.cumsum(np.fromiter(map(maps.__getitem__, chunks), np.int64, len(chunks)))))
    return np.diff(scan[ends])


def token_counts(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document.

    A null or empty text has no bytes and no tokens; repeated rows and null ids
    are kept; an empty table gives an empty result.
    """
    def run(batches):
        maps = load(path)
        for batch in by_bytes(batches, "text", 4 << 20):
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], pa.array(count_texts(batch["text"].to_pylist(), maps), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
