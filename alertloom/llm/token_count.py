"""Token counts by finite-state transducers, equal to the counts of the tokenizers library.

Two machines are compiled from a byte-level BPE file. The scanner is a small automaton over
character classes that marks where the splitting pattern starts a new word; it is run over fixed
chunks from every entry state at once, the chunks' state maps are composed by a parallel prefix
scan, and a second pass from the now known entry states writes the marks. The word transducer
reads the bytes of a word; each transition carries how many tokens it adds to (or takes from) the
count. Its states are made when first needed; their number is bounded, then they are made anew.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from alertloom.llm.bpe_core import Merger, PairTable

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
#: Characters handled at once; a longer text is cut where the pattern always cuts.
SLICE = 1_000_000
CHUNK = 128
#: States of the word transducer before it is cleared and filled again: some 200 MB a process.
MAX_STATES = 250_000

CLASSES = "letter s t m d r e v l apostrophe number space blank other end".split()
STATES = "start letter number other space blank apostrophe r v l done".split()
_C = {name: i for i, name in enumerate(CLASSES)}
_S = {name: i for i, name in enumerate(STATES)}
#: What a transition marks: a new word at this character, at the one before, or both.
HERE, BEFORE = 1, 2


def scanner_tables() -> tuple[np.ndarray, np.ndarray]:
    """Next state and marks of the splitting pattern, by state and class."""
    following = np.zeros((len(STATES), len(CLASSES)), np.uint8)
    marks = np.zeros_like(following)
    letters = {"letter", *"stmdrevl"}
    for state in STATES:
        for name in CLASSES:
            plain = "letter" if name in letters else name if name != "end" else "start"
            to, mark = plain, HERE
            if state == plain and state in ("letter", "number", "other"):
                mark = 0
            elif state == "other" and name == "apostrophe":
                to, mark = "other", 0
            elif state in ("space", "blank"):
                if name in ("space", "blank"):
                    mark = 0
                elif name != "end":  # the last blank before a word stands apart or leads the word
                    mark = BEFORE | (HERE if state == "blank" else 0)
                    if state == "space" and name == "apostrophe":
                        to = "other"
            elif state == "apostrophe":
                if name in "stmd" and len(name) == 1:
                    to, mark = "done", 0
                elif name in ("r", "v", "l"):
                    to, mark = name, 0
                elif name in ("apostrophe", "other"):
                    to, mark = "other", 0
            elif state in ("r", "v", "l"):
                if name == ("l" if state == "l" else "e"):
                    to, mark = "done", 0
                else:
                    mark = BEFORE | (0 if plain == "letter" else HERE)
            following[_S[state], _C[name]] = _S[to]
            marks[_S[state], _C[name]] = mark
    return following, marks


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """The class of each code point."""
    table = np.full(0x110000 + 1, _C["other"], np.uint8)
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    everything = "".join(map(chr, points))
    for name, pattern in (("letter", r"\p{L}+"), ("number", r"\p{N}+"), ("blank", r"\p{White_Space}+")):
        for m in regex.finditer(pattern, everything):
            for at in (m.start(), m.end() - 1):
                assert points[at] - points[m.start()] in (at - m.start(), at - m.start() + 0x800)
            table[np.array(points[m.start():m.end()])] = _C[name]
    for c in "stmdrevl":
        table[ord(c)] = _C[c]
    table[ord("'")], table[ord(" ")], table[0x110000] = _C["apostrophe"], _C["space"], _C["end"]
    return table


def word_starts(classes: np.ndarray) -> np.ndarray:
    """Marks of word starts for the classes of a text or of several with `end` between them."""
    following, marks = scanner_tables()
    n = len(classes)
    chunks = -(-n // CHUNK)
    laid = np.full(chunks * CHUNK, _C["end"], np.uint8)
    laid[:n] = classes
    laid = np.ascontiguousarray(laid.reshape(chunks, CHUNK).T)

    # (1) Each chunk as a map from every entry state to its exit state.
    maps = np.tile(np.arange(len(STATES), dtype=np.uint8), (chunks, 1))
    for column in laid:
        maps = following[maps, column[:, None]]
    # (2) Composition of the maps of all chunks before, in a logarithmic number of rounds.
    step = 1
    while step < chunks:
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step], axis=1)
        step *= 2
    # (3) The marks, now that every chunk knows where it enters.
    state = np.concatenate([[_S["start"]], maps[:-1, _S["start"]]]).astype(np.uint8)
    found = np.empty((CHUNK, chunks), np.uint8)
    for j, column in enumerate(laid):
        found[j] = marks[state, column]
        state = following[state, column]
    flat = found.T.reshape(-1)[:n]
    starts = (flat & HERE) > 0
    starts[:-1] |= (flat[1:] & BEFORE) > 0
    return starts


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}


class WordTransducer:
    """Token counts of words, one byte at a time.

    A state knows the longest ending of what was read that begins some token, and for each
    place within it the last token of the encoding up to there and its count, relative to now.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        letters = byte_alphabet()
        to_bytes = lambda s: bytes(letters[c] for c in s)
        self.added = [t["content"] for t in model["added_tokens"]]
        added = set(self.added)
        self.tokens = {to_bytes(t) for t in model["model"]["vocab"] if t not in added}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        rank = {(to_bytes(a), to_bytes(b)): i for i, (a, b) in enumerate(merges)}
        self.merger = Merger(lambda a, b: rank.get((a, b)))
        self.begins = {t[:i] for t in self.tokens for i in range(len(t) + 1)}
        self.split = lambda t: [t[i:i + 1] for i in range(len(t))]
        self._whole: dict[bytes, bool] = {}
        self.clear()

    def clear(self) -> None:
        self.table = PairTable()
        self.keys: list = [(b"", ((None, 0),))]
        self.numbers = {self.keys[0]: 0}

    def whole(self, token: bytes) -> bool:
        known = self._whole.get(token)
        if known is None:
            known = token in self.tokens and self.merger.merge(self.split(token)) == [token]
            self._whole[token] = known
        return known

    def transition(self, state: int, byte: int) -> tuple[int, int]:
        ending, places = self.keys[state]
        read = ending + bytes([byte])
        for i in range(len(read)):
            token, (last, count) = read[i:], places[i]
            if token in self.tokens and self.whole(token) and (
                    last is None or self.merger.fits(last, token, self.split)):
                break
        else:
            raise ValueError(f"no token ends with byte {byte}")
        count += 1
        kept = read
        while kept not in self.begins:
            kept = kept[1:]
        reached = (*places, (token, count))[-len(kept) - 1:]
        key = (kept, tuple(  # only places from which a token may still begin tell states apart
            (t, c - count) if kept[i:] in self.begins else (b"", 0) for i, (t, c) in enumerate(reached)
        ))
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.keys)
            self.keys.append(key)
        return number, count

    def counts(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of each word of `data`; all words take one step together."""
        if len(self.keys) > MAX_STATES:
            self.clear()
        order = np.argsort(-lengths, kind="stable")
        at = starts[order]
        alive = np.searchsorted(-lengths[order], -np.arange(int(lengths.max(initial=0))), side="left")
        state = np.zeros(len(order), np.int64)
        total = np.zeros(len(order), np.int64)
        for j, n in enumerate(alive):
            byte = data[at[:n] + j]
            key = state[:n] * 256 + byte
            slot = self.table.place(key)
            missing = self.table.keys[slot] != key
            if missing.any():
                new = np.unique(key[missing])
                made = np.array([self.transition(int(k) // 256, int(k) % 256) for k in new])
                self.table.put(new, made[:, 0], made[:, 1])
                slot = self.table.place(key)
            total[:n] += self.table.second[slot]
            state[:n] = self.table.first[slot]
        counts = np.empty(len(order), np.int64)
        counts[order] = total
        return counts


@lru_cache(maxsize=2)
def transducer(path: str) -> WordTransducer:
    return WordTransducer(path)


def pieces(text: str, size: int = SLICE) -> Iterator[str]:
    """The text cut before blanks that follow a word, where every word ends."""
    at = 0
    cut = re.compile(r"(?<=\S) ")
    while len(text) - at > size:
        found = cut.search(text, at + size)
        if not found:
            break
        yield text[at:found.start()]
        at = found.start()
    yield text[at:]


def count_tokens(texts: list[str], machine: WordTransducer) -> np.ndarray:
    """Tokens of each text; strings of added tokens count one and part the text."""
    totals = np.zeros(len(texts), np.int64)
    cut = re.compile("|".join(map(re.escape, sorted(machine.added, key=len, reverse=True)))) if machine.added else None
    owners: list[int] = []
    parts: list[str] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if parts:
            np.add.at(totals, np.array(owners), _count_parts(parts, machine))
        owners.clear()
        parts.clear()
        held = 0

    for i, text in enumerate(texts):
        if cut:
            between = cut.split(text)
            totals[i] += len(between) - 1
        else:
            between = [text]
        for part in between:
            for piece in pieces(part):
                if piece:
                    owners.append(i)
                    parts.append(piece)
                    held += len(piece)
                if held >= SLICE:
                    flush()
    flush()
    return totals


def _count_parts(parts: list[str], machine: WordTransducer) -> np.ndarray:
    lengths = np.array([len(p) for p in parts])
    points = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
    ends = np.cumsum(lengths)
    with_ends = np.insert(points, ends, 0x110000)  # an end after each part
    starts = word_starts(class_table()[with_ends])
    starts = np.delete(starts, ends + np.arange(len(parts)))
    starts[ends - lengths] = True
    widths = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
    offsets = np.concatenate([[0], np.cumsum(widths, dtype=np.int64)])
    where = np.flatnonzero(starts)
    begin = offsets[where]
    size = np.diff(np.append(begin, offsets[-1]))
    data = np.frombuffer("".join(parts).encode(), np.uint8)
    counts = machine.counts(data, begin, size)
    first = np.searchsorted(where, ends - lengths)
    return np.add.reduceat(counts, first)


COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than `limit`).

    Null texts count as empty: no bytes, no tokens. Null ids and repeated rows pass through; other
    columns are not looked at; an empty table gives an empty result. Nothing is shuffled.
    """
    file = path or public_tokenizers.path(TOKENIZER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(file)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            sizes = np.array([len(t.encode()) for t in texts], np.int64)
            tokens = count_tokens(texts, machine)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes), pa.array(tokens), pa.array(tokens > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    narrow = docs.selectExpr("cast(doc_id as long) as doc_id", "text")
    return narrow.mapInArrow(run, COUNTS)


def op10_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
