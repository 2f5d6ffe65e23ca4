"""SentencePiece encoding by a streaming Viterbi search, and decoding.

The best segmentation of a text into pieces maximises the sum of piece scores. The search keeps best scores for the
last ``longest`` boundaries only, since no piece reaches further back. Ids are committed whenever the backpointers of
all surviving boundaries have met in one boundary; what lies before it is forgotten. (Paths through a long run of
one letter may not meet before it ends; its backpointers, not its scores, are held until then.) In a vocabulary whose pieces
never hold a space after another character all paths meet at the end of every word, so words are the units that are
remembered; short ones are searched many at a time as arrays, longer ones, and texts of other vocabularies, by the
stream.

The given vocabulary is one of merges, whose numbers are ranks and not log probabilities. Scores therefore follow
Zipf's law by rank, -ln(1 + rank); ``scores="model"`` takes the model's own, right for unigram vocabularies. A
character without a piece is spelt in bytes. Spaces are kept as they are and one is put in front of a text; decoding
removes it, so decode(encode(text)) == text for every text.

Defined cases: null and empty texts have no ids; a text of any length is encoded whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridfolio.llm.chunk_ids import ChunkEncoder, id_lists
from gridfolio.llm.common import mix

SPACE = "▁"
SHORT = 48  # characters of a word up to which words are searched as arrays
EXACT = 1 << 20  # scores are multiples of 1 / EXACT, so sums and ties do not depend on where a search begins
_BASE = np.uint64(0x9E3779B97F4A7C55)


class Pieces:
    """The pieces, scores and byte ids of a vocabulary; spaces stand for themselves."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int]) -> None:
        self.byte_ids = np.array(byte_ids, np.int64)
        self.of: dict[str, tuple[int, float]] = {}
        self.shown: list[bytes] = [b""] * len(pieces)
        special = set(byte_ids)
        for i, (p, s) in enumerate(zip(pieces, scores, strict=True)):
            if i in special:
                self.shown[i] = bytes([byte_ids.index(i)])
            elif not math.isnan(s):
                word = p.replace(SPACE, " ")
                self.of[word], self.shown[i] = (i, round(s * EXACT) / EXACT), word.encode()
        self.longest = max(map(len, self.of))
        self.byte_score = min(s for _, s in self.of.values()) - 4
        self.by_word = all(" " not in w.lstrip(" ") for w in self.of)
        words = sorted(self.of, key=len)
        keys = np.zeros(len(words), np.uint64)
        for n in range(1, self.longest + 1):
            at = [i for i, w in enumerate(words) if len(w) == n]
            if at:
                keys[at] = mix(self._prefixes(_codes([words[i] for i in at], n))[:, -1])
        order = np.argsort(keys)
        self.keys = keys[order]
        assert (self.keys[1:] != self.keys[:-1]).all(), "two pieces share a hash"
        self.ids = np.array([self.of[w][0] for w in words], np.int64)[order]
        self.scores = np.array([self.of[w][1] for w in words])[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    @staticmethod
    def load(path: str, scores: str = "rank") -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        usable = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i)) for i in range(n)]
        value = sp.get_score if scores == "model" else lambda i: -math.log(1 + i)
        spelt = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        return Pieces([sp.id_to_piece(i) for i in range(n)], [value(i) if u else math.nan for i, u in enumerate(usable)], [spelt[b] for b in range(256)])

    @staticmethod
    def _prefixes(codes: np.ndarray) -> np.ndarray:
        out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
        for i in range(codes.shape[1]):
            out[:, i + 1] = out[:, i] * _BASE + codes[:, i] + np.uint64(1)
        return out

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of ``keys`` that are pieces, their ids and scores."""
        rows = np.flatnonzero(self.maybe[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, keys[rows]), len(self.keys) - 1)
        good = self.keys[at] == keys[rows]
        return rows[good], self.ids[at[good]], self.scores[at[good]]

    # Words of one length, many at a time -------------------------------------------

    def search(self, words: list[str], n: int) -> list[bytes]:
        codes = _codes(words, n)
        sums = self._prefixes(codes)
        powers = np.array([pow(int(_BASE), k, 2**64) for k in range(n + 1)], np.uint64)
        best = np.full((len(words), n + 1), -np.inf)
        best[:, 0] = 0
        step = np.zeros((len(words), n + 1), np.int64)
        piece = np.zeros((len(words), n + 1), np.int64)
        width = _utf8_length(codes)
        every = np.arange(len(words))
        for i in range(1, n + 1):
            most = min(self.longest, i)
            keys = mix(sums[:, i : i + 1] - sums[:, i - most : i][:, ::-1] * powers[1 : most + 1])  # column k - 1: the last k characters
            at, ids, scores = self.look_up(keys.ravel())
            row, k = at // most, at % most
            value = np.full(keys.shape, -np.inf)
            value[row, k] = best[row, i - 1 - k] + scores
            which = np.zeros(keys.shape, np.int64)
            which[row, k] = ids
            k = value.argmax(axis=1)  # of equal sums the shortest last piece
            spelt = best[:, i - 1] + self.byte_score * width[:, i - 1]
            whole = value[every, k] > spelt
            best[:, i] = np.where(whole, value[every, k], spelt)
            step[:, i] = np.where(whole, k + 1, 1)
            piece[:, i] = np.where(whole, which[every, k], -1 - codes[:, i - 1].astype(np.int64))
        at = np.full(len(words), n)
        found = np.zeros((len(words), n), np.int64)
        used = np.zeros((len(words), n), bool)
        live = np.arange(len(words))
        while len(live):
            found[live, at[live] - 1], used[live, at[live] - 1] = piece[live, at[live]], True
            at[live] -= step[live, at[live]]
            live = live[at[live] > 0]
        flat, counts = found[used], used.sum(axis=1)
        if (flat < 0).any():  # spell in bytes
            owner = np.repeat(np.arange(len(words)), counts)
            kinds, where = np.unique(np.where(flat < 0, flat, 0), return_inverse=True)
            spelt = [[0] if c == 0 else self.byte_ids[list(chr(-1 - c).encode("utf-8", "surrogatepass"))].tolist() for c in kinds.tolist()]
            sizes = np.array([len(x) for x in spelt])[where]
            table = np.array([x + [0] * (4 - len(x)) for x in spelt])
            nth = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            again = np.repeat(np.arange(len(flat)), sizes)
            flat = np.where(flat[again] < 0, table[where[again], nth], flat[again])
            counts = np.bincount(owner, sizes, len(words)).astype(np.int64)
        data, ends = flat.astype("<i4").tobytes(), np.cumsum(counts).tolist()
        return [data[4 * a : 4 * b] for a, b in zip([0, *ends], ends, strict=False)]

    def encode_words(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(words)
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        for n, at in by_length.items():
            if n > SHORT:
                for i in at:
                    out[i] = np.fromiter(Stream(self).all(words[i]), "<i4").tobytes()
            else:
                for i, found in zip(at, self.search([words[i] for i in at], n), strict=True):
                    out[i] = found
        return out

    def encoder(self) -> ChunkEncoder:
        words = re.compile(r" *[^ ]+| +\Z").findall if self.by_word else lambda t: [t]
        return ChunkEncoder(lambda t: words(" " + t) if t else [], self.encode_words)

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.shown.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass")
        return text[1:] if text.startswith(" ") else text


def _codes(words: list[str], n: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), n).astype(np.uint64)


def _utf8_length(codes: np.ndarray) -> np.ndarray:
    return 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)


class Stream:
    """The search over characters that arrive bit by bit; holds only what is not yet committed."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        self.text = ""  # since the last commit
        self.best = [0.0]  # per boundary since the last commit; only the last ``longest`` are read
        self.step, self.piece = [0], [-1]
        self.widest = 0  # characters ever held at once

    def feed(self, text: str) -> list[int]:
        """Take in characters; return the ids that no later character can change."""
        out: list[int] = []
        p = self.pieces
        for c in text:
            self.text += c
            i = len(self.text)
            best, step, piece = self.best[i - 1] + p.byte_score * len(c.encode("utf-8", "surrogatepass")), 1, -1
            for k in range(1, min(p.longest, i) + 1):
                hit = p.of.get(self.text[i - k :])
                if hit and (value := self.best[i - k] + hit[1]) > best:
                    best, step, piece = value, k, hit[0]
            self.best.append(best)
            self.step.append(step)
            self.piece.append(piece)
            self.widest = max(self.widest, i)
            if i % p.longest == 0:
                out += self._commit(self._meeting(i))
        return out

    def _meeting(self, end: int) -> int:
        """The last boundary through which the best paths to all boundaries a later piece can start from lead."""
        live = set(range(max(0, end - self.pieces.longest + 1), end + 1))
        while len(live) > 1:
            far = max(live)
            live.remove(far)
            live.add(far - self.step[far])
        return live.pop()

    def _path(self, end: int) -> list[int]:
        out: list[int] = []
        while end:
            k = self.step[end]
            if self.piece[end] < 0:
                out += self.pieces.byte_ids[list(self.text[end - 1].encode("utf-8", "surrogatepass"))].tolist()[::-1]
            else:
                out.append(self.piece[end])
            end -= k
        return out[::-1]

    def _commit(self, b: int) -> list[int]:
        if not b:
            return []
        out = self._path(b)
        self.text, self.best, self.step, self.piece = self.text[b:], self.best[b:], self.step[b:], self.piece[b:]
        return out

    def finish(self) -> list[int]:
        return self._commit(len(self.text))

    def all(self, text: str) -> list[int]:
        return self.feed(text) + self.finish()


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encoded(documents: DataFrame, model: str | None = None, scores: str = "rank") -> DataFrame:
    """(doc_id, ids, n_ids, round_trip) of every row; round_trip says that decoding the ids gives the text.

    Rows of one text that lie together, as copies of a mixture do, are encoded and decoded once.
    """
    pieces = Pieces.load(model or default_model(), scores)  # as large as the vocabulary

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = pieces.encoder()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                coded = batch.column(1).dictionary_encode(null_encoding="encode")
                texts, which = [t or "" for t in coded.dictionary.to_pylist()], coded.indices.to_pylist()
                once = to_ids(texts)
                exact = [pieces.decode(np.frombuffer(f, "<i4")) == t for f, t in zip(once, texts, strict=True)]
                found, same = [once[i] for i in which], [exact[i] for i in which]
                yield pa.RecordBatch.from_arrays([batch.column(0), id_lists(found), pa.array([len(f) // 4 for f in found], pa.int64()), pa.array(same)], ["doc_id", "ids", "n_ids", "round_trip"])

    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", "text").mapInArrow(encode, f"doc_id {kind}, ids array<int>, n_ids long, round_trip boolean")
