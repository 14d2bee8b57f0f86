"""SentencePiece encoding by suffix-array matching, and decoding."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from sentencepiece import sentencepiece_model_pb2 as proto

from alertloom.llm.bpe_core import Merger, PairTable
from alertloom.llm.common import bound_batches, trimmed

MODEL = "piece_bpe_32k.model"
BLANK = "▁"
#: Characters of documents taken together; their distinct words are indexed as one text.
SLICE = 250_000
#: Known pairs of neighbours before the table is cleared and filled again.
MAX_PAIRS = 1_000_000
NORMAL, BYTE = 1, 6
_END = 0x110000


class PieceModel:
    """A model of type BPE with byte fallback, an identity normalizer and a leading blank."""

    def __init__(self, path: str) -> None:
        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        rules, trained = model.normalizer_spec, model.trainer_spec
        plain = not rules.precompiled_charsmap and rules.add_dummy_prefix and rules.escape_whitespaces
        if trained.model_type != 2 or not trained.byte_fallback or not plain or rules.remove_extra_whitespaces:
            raise ValueError("only BPE models with byte fallback and identity normalization are supported")
        self.texts = [p.piece for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        if any(re.search(f"[^{BLANK}]{BLANK}", p) for p in self.ids):
            raise ValueError("pieces that reach over a blank are not supported")
        self.byte_ids = np.zeros(256, np.int32)
        self.raw: list[bytes] = []
        for i, p in enumerate(model.pieces):
            if p.type == BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = i
                self.raw.append(bytes([int(p.piece[3:5], 16)]))
            else:
                self.raw.append(p.piece.encode() if p.type == NORMAL else b"")
        score = {p.piece: -p.score for p in model.pieces if p.type == NORMAL}
        self.merger = Merger(lambda a, b: score.get(a + b), 1)  # `fitting` remembers pairs
        # Pieces that merging can produce, sorted; the others never stand in an encoding.
        self.pieces = sorted(p for p in self.ids if self.merger.merge(list(p)) == [p])
        self.sizes = np.array([len(p) for p in self.pieces])
        self.piece_ids = np.array([self.ids[p] for p in self.pieces], np.int32)
        self.width = int(self.sizes.max())
        self.single = {ord(p): k for k, p in enumerate(self.pieces) if len(p) == 1}
        laid = np.zeros((len(self.pieces), self.width), np.int32)
        for k, p in enumerate(self.pieces):
            laid[k, :len(p)] = [ord(c) + 1 for c in p]
        self.codes = laid
        self.fitting = PairTable()

    def fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether pieces may be neighbours; by numbers in `pieces`, unknown characters fit with all."""
        n = len(self.pieces)
        known = np.flatnonzero((left < n) & (right < n))
        good = np.ones(len(left), bool)
        key = left[known] * np.int64(n) + right[known]
        at = self.fitting.place(key)
        missing = self.fitting.keys[at] != key
        if missing.any():
            if self.fitting.size > MAX_PAIRS:
                self.fitting = PairTable()
                missing[:] = True
            new = np.unique(key[missing])
            split = list
            found = [self.merger.fits(self.pieces[k // n], self.pieces[k % n], split) for k in new.tolist()]
            self.fitting.put(new, np.array(found, np.int64), np.zeros(len(new), np.int64))
            at = self.fitting.place(key)
        good[known] = self.fitting.first[at] > 0
        return good


def packed(codes: np.ndarray, bits: int) -> tuple[np.ndarray, int]:
    """For each place the codes from there on in one integer, zeros beyond the end, and how many they are."""
    per = 63 // bits
    padded = np.concatenate([codes, np.zeros(per, codes.dtype)])
    key = np.zeros(len(codes), np.int64)
    for k in range(per):
        key = key << bits | padded[k:k + len(codes)]
    return key, per


def suffix_array(key: np.ndarray, have: int, depth: int) -> np.ndarray:
    """Places sorted by the `depth` codes that begin there, by prefix doubling from `have` codes in `key` on."""
    while True:
        order = np.argsort(key)
        if have >= depth:
            return order
        rank = np.empty_like(key)
        rank[order] = np.cumsum(np.diff(key[order], prepend=key[order[:1]] - 1) > 0)
        key = rank << 32
        key[:-have] |= rank[have:]
        have *= 2


def occurrences(codes: np.ndarray, model: PieceModel) -> tuple[np.ndarray, np.ndarray]:
    """Places and piece numbers of every occurrence of every piece in the text.

    Characters are numbered anew, by the slice's own alphabet, so that an integer packs as many as it can.
    Each piece is searched in the suffix array by halving, some characters at a time: from the first
    suffix that is not below it to the first that is above everything that begins with it.
    """
    alphabet = np.unique(codes)
    bits = int(len(alphabet) + 1).bit_length()
    number = np.zeros(_END + 2, np.int32)  # code points are kept plus one; others have no number
    number[alphabet + 1] = np.arange(1, len(alphabet) + 1)
    key, per = packed(number[codes + 1], bits)
    order = suffix_array(key, per, model.width)
    wanted = number[model.codes]
    piece = np.flatnonzero(((wanted > 0) | (model.codes == 0)).all(axis=1))
    wanted, sizes = wanted[piece], model.sizes[piece]
    first, last = np.zeros(len(piece), np.int64), np.full(len(piece), len(codes))
    for begin in range(0, model.width, per):
        there = np.flatnonzero((sizes > begin) & (first < last))
        low, high = np.zeros(len(there), np.int64), np.zeros(len(there), np.int64)
        for k in range(begin, begin + per):
            own = wanted[there, k] if k < model.width else np.zeros(len(there), np.int32)
            low, high = low << bits | own, high << bits | np.where(own > 0, own, (1 << bits) - 1)
        if begin == 0:
            ranked = key[order]
            first[there], last[there] = np.searchsorted(ranked, low), np.searchsorted(ranked, high, "right")
            continue
        after = np.concatenate([key[begin:], np.zeros(begin, np.int64)])
        ends = first[there], last[there]
        first[there] = _halved(after, order, *ends, low)
        last[there] = _halved(after, order, *ends, high + 1)
    n = np.maximum(last - first, 0)
    ends = np.cumsum(n)
    rows = np.arange(int(n.sum())) - np.repeat(ends - n, n) + np.repeat(first, n)
    return order[rows].astype(np.int32), np.repeat(piece.astype(np.int32), n)


def _halved(key: np.ndarray, order: np.ndarray, lo: np.ndarray, hi: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """For each range of `order` the first row whose key is not below `wanted`, or the range's end."""
    lo, hi = lo.copy(), hi.copy()
    open_ = np.flatnonzero(lo < hi)
    while len(open_):
        mid = (lo[open_] + hi[open_]) // 2
        below = key[order[mid]] < wanted[open_]
        lo[open_[below]], hi[open_[~below]] = mid[below] + 1, mid[~below]
        open_ = open_[lo[open_] < hi[open_]]
    return lo


def encode_words(words: list[str], model: PieceModel) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, one after the other, and how many each has.

    The words stand in one text. Occurrences are edges from their begin to their end; sorted by
    the end's distance from the word's begin, they are relaxed for all words at once: an end is reached by
    the one piece that fits the piece which reached its begin.
    """
    sizes = np.array([len(w) for w in words])
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int32)
    ends = np.cumsum(sizes)
    laid = np.insert(codes, ends, _END)
    begins = ends - sizes + np.arange(len(words))
    offset = (np.arange(len(laid)) - np.repeat(begins, sizes + 1)).astype(np.int32)
    place, piece = occurrences(laid, model)
    single = np.zeros(len(laid), bool)
    single[place[model.sizes[piece] == 1]] = True
    unknown = np.flatnonzero(~single & (laid != _END))
    n = len(model.pieces)
    place = np.concatenate([place, unknown.astype(np.int32)])
    piece = np.concatenate([piece, (n + laid[unknown]).astype(np.int32)])
    width = np.append(model.sizes, 1).astype(np.int32)
    size = width[np.minimum(piece, n)]
    reach = offset[place] + size
    order = np.argsort(reach.astype(np.uint16) if reach.max(initial=0) < 65_536 else reach, kind="stable")
    place, piece, size, reach = place[order], piece[order], size[order], reach[order]
    steps = np.searchsorted(reach, np.arange(1, int(sizes.max(initial=0)) + 2))
    reached = np.full(len(laid) + 1, -1, np.int32)
    for a, b in zip(steps[:-1], steps[1:], strict=True):
        p, k = place[a:b], piece[a:b]
        at_begin = offset[p] == 0
        before = reached[p]
        good = at_begin | (before >= 0)
        check = np.flatnonzero(good & ~at_begin)
        good[check] = model.fits(before[check], k[check])
        reached[p[good] + size[a:b][good]] = k[good]

    at, owner = begins + sizes, np.arange(len(words))
    taken: list[tuple[np.ndarray, np.ndarray]] = []
    while len(at):
        k = reached[at]
        taken.append((owner, k))
        at = at - width[np.minimum(k, n)]
        more = at > begins[owner]
        at, owner = at[more], owner[more]
    own = np.zeros(len(words), np.int64)
    for owner, _ in taken:
        own[owner] += 1
    last = np.cumsum(own) - 1
    pieces = np.empty(int(own.sum()), np.int64)
    for step, (owner, k) in enumerate(taken):  # pieces were taken from the end
        pieces[last[owner] - step] = k
    own = np.repeat(np.arange(len(words)), own)
    point = pieces - n
    spread = np.where(point < 0, 1, 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000))
    ids = np.repeat(model.piece_ids[np.minimum(pieces, n - 1)], spread)
    odd = np.flatnonzero(point >= 0)
    if len(odd):
        starts = np.cumsum(spread) - spread
        raw = np.frombuffer("".join(map(chr, point[odd].tolist())).encode(), np.uint8)
        slots = np.concatenate([np.arange(starts[i], starts[i] + spread[i]) for i in odd])
        ids[slots] = model.byte_ids[raw]
    return ids, np.bincount(own, spread, len(words)).astype(np.int64)


_WORD = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


def encode(texts: list[str | None], model: PieceModel) -> list[np.ndarray]:
    """Ids of each text, equal to those of the library; null and empty texts have none."""
    found: list[np.ndarray] = [np.zeros(0, np.int32)] * len(texts)
    held: list[int] = []
    size = 0
    for i, text in enumerate(texts):
        if text:
            held.append(i)
            size += len(text)
        if held and (size >= SLICE or i == len(texts) - 1):
            # A word that is not known gets the next number. Nothing here refers to the dictionary itself,
            # so its words go with the slice and do not wait for the cycle collector.
            number: defaultdict[str, int] = defaultdict(count().__next__)
            of = [np.fromiter(map(number.__getitem__, _WORD.findall((BLANK + texts[k]).replace(" ", BLANK))), np.int32)
                  for k in held]
            ids, counts = encode_words(list(number), model)
            begins = np.cumsum(counts) - counts
            for k, own in zip(held, of, strict=True):
                n = counts[own]
                last = np.cumsum(n)
                found[k] = ids[np.arange(int(last[-1])) - np.repeat(last - n, n) + np.repeat(begins[own], n)]
            held, size = [], 0
    return found


def decode(ids: list[int], model: PieceModel) -> str:
    """The text of ids: bytes joined, blanks restored, the leading blank taken away."""
    raw = model.raw
    return b"".join([raw[i] for i in ids]).decode("utf-8", "replace").replace(BLANK, " ").removeprefix(" ")


@lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    return PieceModel(path)


def _path(path: str | None) -> str:
    return path or public_tokenizers.path(MODEL)


def encode_docs(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text, piece_ids of each document, without a shuffle.

    Null and empty texts have no pieces. Null ids and repeated rows pass through; other columns are
    not looked at; an empty table gives an empty result.
    """
    file = _path(path)
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = encode(batch.column("text").to_pylist(), load(file))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text"), pa.array(ids, pa.list_(pa.int32()))],
                ["doc_id", "text", "piece_ids"])

    narrow = docs.selectExpr("cast(doc_id as long) as doc_id", "text")
    return narrow.mapInArrow(trimmed(run), "doc_id long, text string, piece_ids array<int>")


DIGESTS = "doc_id long, n_pieces long, ids_sha256 string, text_sha256 string, round_trip boolean"


def decode_docs(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Digests of ids and of the text decoded from them, and whether it is the text again.

    A text may hold the character that stands for a blank; like the library, decoding gives a blank for it.
    """
    file = _path(path)
    bound_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("piece_ids")
            flat, offsets = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            offsets = offsets - offsets[0]
            own = [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            back = [decode(x.tolist(), load(file)) for x in own]
            texts = [(t or "").replace(BLANK, " ") for t in batch.column("text").to_pylist()]
            sha = lambda b: hashlib.sha256(b).hexdigest()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x) for x in own], pa.int64()),
                 pa.array([sha(x.astype("<i4").tobytes()) for x in own]),
                 pa.array([sha(t.encode()) for t in back]),
                 pa.array([a == b for a, b in zip(back, texts, strict=True)])],
                ["doc_id", "n_pieces", "ids_sha256", "text_sha256", "round_trip"])

    return encoded.mapInArrow(trimmed(run), DIGESTS)


def op2_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_docs(encode_docs(spark.read.parquet(f"{sf_dir}/documents.parquet")))
