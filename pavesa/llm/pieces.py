"""SentencePiece encoding and decoding with a streaming Viterbi search.

A model file is read with the public library; encoding and decoding are done here. Boundaries between characters are nodes, pieces are arcs.
The best way to each boundary is one backpointer, chosen

* in a unigram model by the highest sum of scores (ties: the longest last piece);
* in a BPE model by consistency: the merges of every prefix are fixed, so exactly one last piece agrees with the way to its start. It is the
  piece that, with the piece before it, merges back to just these two.

A piece has at most ``longest`` characters, so only as many boundaries can still grow. Whenever all of them lead back to one boundary, the
ids up to there are final: they are committed, and the window starts anew. Memory doesn't grow with the text.

A space becomes U+2581; a text gets one in front where the model says so. No piece goes on into the next word, so each word starts a window
and common words come from a bounded memory. Characters without a piece become byte pieces, also a literal U+2581, so that every
text decodes to itself.

Defined cases: a null text gives null ids; an empty text gives none; repeated rows are encoded alike; other columns pass through, and one that
has the name of a result is replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SPACE = "▁"
#: Stands for a literal U+2581 while a text is encoded. It can't be in a text, as UTF-8 has no lone surrogates.
LITERAL = "\udc00"
#: Words and pairs of pieces that are remembered: the first ones met, among which are the common ones.
MEMORY = 1_000_000
PAIRS = 300_000
MEMORY_CHARS = 48
_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


@dataclass
class PieceModel:
    """Pieces by text with id and score, byte pieces by value, and the bytes of every id."""

    ids: dict[str, int]
    scores: dict[str, float]
    byte_ids: list[int]
    spelled: list[bytes]
    unigram: bool
    prefix: bool
    longest: int
    known_edges: dict[str, tuple[list[tuple[str, float]], list[tuple[str, float]]]] = field(default_factory=dict)
    known_pairs: dict[tuple[str, str], bool] = field(default_factory=dict)
    memory: dict[str, bytes] = field(default_factory=dict)
    begins: dict[str, bool] = field(init=False)

    def __post_init__(self) -> None:
        """Beginnings of pieces, and whether each is a piece."""
        self.begins = {p[:i]: False for p in self.ids for i in range(1, len(p))}
        self.begins |= dict.fromkeys(self.ids, True)

    @classmethod
    def load(cls, path: str) -> PieceModel:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        kind = proto.SentencePiece
        ids, scores, byte_ids, spelled = {}, {}, [0] * 256, []
        for i, p in enumerate(proto.pieces):
            spelled.append(b"")
            if p.type == kind.BYTE:
                byte_ids[int(p.piece[1:-1], 16)] = i
                spelled[i] = bytes([int(p.piece[1:-1], 16)])
            elif p.type in (kind.NORMAL, kind.USER_DEFINED):
                ids[p.piece], scores[p.piece] = i, p.score
                spelled[i] = p.piece.replace(SPACE, " ").encode()
        if not all(byte_ids):
            raise ValueError("the model has no byte pieces, so not every text could be decoded")
        return cls(ids, scores, byte_ids, spelled, proto.trainer_spec.model_type == 1, proto.normalizer_spec.add_dummy_prefix, max(map(len, ids)))

    def edges(self, piece: str) -> tuple[list[tuple[str, float]], list[tuple[str, float]]]:
        """How the first and the last symbol of a piece grow while it is merged: each with the score of the merge that ends it."""
        if piece in self.known_edges:
            return self.known_edges[piece]
        parts, first, last = list(piece), [], []
        while len(parts) > 1:
            pairs = [(self.scores[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.scores]
            if not pairs:
                break
            score, i = max(pairs)
            i = -i
            if i == 0:
                first.append((parts[0], score))
            if i == len(parts) - 2:
                last.append((parts[-1], score))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        first.append((parts[0], -math.inf))
        last.append((parts[-1], -math.inf))
        self.known_edges[piece] = first, last
        return first, last

    def agree(self, before: str, piece: str) -> bool:
        """Whether merging two pieces' text gives the two pieces: no merge over the border comes first.

        While both pieces are built, the symbols at the border change. A merge of the two would win if its score is above that of the next
        merge on the left and not below that on the right (of equal merges the leftmost is made first).
        """
        left, right = self.edges(before)[1], self.edges(piece)[0]
        i = j = 0
        while True:
            (x, next_left), (y, next_right) = left[i], right[j]
            over = self.scores.get(x + y)
            if over is not None and over > next_left and over >= next_right:
                return False
            if next_left >= next_right:
                if next_left == -math.inf:
                    return True
                i += 1
            else:
                j += 1


class Stream:
    """Viterbi over characters given bit by bit. ``push`` and ``close`` return the pieces that have become final."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.text = ""  # characters since the last commit
        self.back = [0]  # start of the last piece of the best way to each boundary
        self.total = [0.0]
        self.before: str | None = None  # last committed piece

    def push(self, text: str) -> list[str]:
        out: list[str] = []
        for at in range(0, len(text), self.model.longest):
            self._extend(text[at : at + self.model.longest])
            if len(self.text) > 2 * self.model.longest:
                out += self._commit()
        return out

    def close(self) -> list[str]:
        out = self._way(len(self.text), 0)
        self.text, self.back, self.total, self.before = "", [0], [0.0], None
        return out

    def _extend(self, more: str) -> None:
        self.text += more
        (self._by_score if self.model.unigram else self._by_merges)(len(self.back))

    def _by_merges(self, begin: int) -> None:
        """Arcs are followed forward, the way to their start being known, and as far as some piece goes on. Only one arc to a boundary agrees."""
        m, text, back = self.model, self.text, self.back
        begins, agree, pairs = m.begins, m.agree, m.known_pairs
        size = len(text)
        back += [-1] * (size + 1 - len(back))
        for s in range(max(0, begin - m.longest), size):
            last = text[back[s] : s] if s else self.before
            for e in range(s + 1, size + 1):
                whole = begins.get(piece := text[s:e])
                if whole is None:
                    break
                if whole and back[e] < 0:
                    if last is None:
                        back[e] = s
                    else:
                        fits = pairs.get((last, piece))
                        if fits is None:
                            fits = agree(last, piece)
                            if len(pairs) < PAIRS:
                                pairs[last, piece] = fits
                        if fits:
                            back[e] = s
            if back[s + 1] < 0:
                back[s + 1] = s

    def _by_score(self, begin: int) -> None:
        m, text, total = self.model, self.text, self.total
        unknown = -1e12  # worse than any piece
        for end in range(begin, len(text) + 1):
            best, start = total[end - 1] + m.scores.get(text[end - 1], unknown), end - 1
            for s in range(end - 2, max(0, end - m.longest) - 1, -1):
                score = m.scores.get(text[s:end])
                if score is not None and total[s] + score >= best:
                    best, start = total[s] + score, s
            self.back.append(start)
            total.append(best)

    def _way(self, end: int, start: int) -> list[str]:
        out = []
        while end > start:
            out.append(self.text[self.back[end] : end])
            end = self.back[end]
        return out[::-1]

    def _commit(self) -> list[str]:
        """Pieces up to the last boundary that every way still open goes through."""
        ways = set(range(max(0, len(self.text) - self.model.longest + 1), len(self.text) + 1))
        while len(ways) > 1:
            late = max(ways)
            ways.discard(late)
            ways.add(self.back[late])
        at = ways.pop()
        if at == 0:
            return []
        out = self._way(at, 0)
        self.before = out[-1]
        self.text, self.total = self.text[at:], [t - self.total[at] for t in self.total[at:]] if self.model.unigram else []
        self.back = [max(0, b - at) for b in self.back[at:]]
        return out


def _ids(model: PieceModel, pieces: Iterable[str]) -> Iterator[int]:
    for p in pieces:
        if p in model.ids:
            yield model.ids[p]
        else:
            for b in (SPACE if p == LITERAL else p).encode():
                yield model.byte_ids[b]


def _word(model: PieceModel, word: str) -> bytes:
    """Ids of a word as int32 bytes, from memory if it is short."""
    found = model.memory.get(word)
    if found is None:
        stream = Stream(model)
        found = np.fromiter(_ids(model, [*stream.push(word), *stream.close()]), np.int32).tobytes()
        if len(word) <= MEMORY_CHARS and len(model.memory) < MEMORY:
            model.memory[word] = found
    return found


def encode(model: PieceModel, text: str) -> np.ndarray:
    """Ids of a text."""
    if not text:
        return np.zeros(0, np.int32)
    marked = (" " * model.prefix + text.replace(SPACE, LITERAL)).replace(" ", SPACE)
    memory = model.memory.get
    return np.frombuffer(b"".join([memory(w) or _word(model, w) for w in _WORDS.findall(marked)]), np.int32)


def decode(model: PieceModel, ids: Iterable[int]) -> str:
    """Text of ids; ids without bytes (control pieces) add nothing."""
    out = b"".join(map(model.spelled.__getitem__, ids)).decode()
    return out[1:] if model.prefix and out.startswith(" ") else out


def model_path(name: str = "piece_bpe_32k.model") -> str:
    """A model file of the installed tokenizer package; any other path will do as well."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _loaded(docs: DataFrame, path: str):
    return docs.sparkSession.sparkContext.broadcast(PieceModel.load(path))


def encoded(docs: DataFrame, path: str, keep: list[str] | None = None, text: str = "text", verify: bool = False) -> DataFrame:
    """The columns ``keep`` (None: all) with ids and n_ids; ``verify`` adds round_trip: whether the ids decode to the text."""
    results = ["ids", "n_ids", *["round_trip"] * verify]
    names = [c for c in (docs.columns if keep is None else keep) if c not in results]
    rows = docs.select(*dict.fromkeys([*names, text]))
    shared = _loaded(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(text).to_pylist()
                ids = [None if t is None else encode(model, t) for t in texts]
                sizes = [0 if x is None else len(x) for x in ids]
                flat = pa.array(np.concatenate([np.zeros(0, np.int32), *(x for x in ids if x is not None)]))
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(ends), flat, mask=pa.array([x is None for x in ids]))
                extra = [column, pa.array([None if x is None else len(x) for x in ids], pa.int64())]
                if verify:
                    extra.append(pa.array([None if t is None else decode(model, x.tolist()) == t for t, x in zip(texts, ids, strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *extra], names=[*names, *results])

    kinds = {"ids": T.ArrayType(T.IntegerType()), "n_ids": T.LongType(), "round_trip": T.BooleanType()}
    return rows.mapInArrow(run, T.StructType([*(f for c in names for f in rows.schema if f.name == c), *(T.StructField(c, kinds[c]) for c in results)]))


def decoded(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``rows`` with ids replaced by text."""
    names = [c for c in rows.columns if c not in (ids, "text")]
    shared = _loaded(rows, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else decode(shared.value, x) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.string())], names=[*names, "text"])

    return rows.select(*names, ids).mapInArrow(run, T.StructType([*(f for f in rows.schema if f.name in names), T.StructField("text", T.StringType())]))
