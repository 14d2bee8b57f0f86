"""Words grouped with their frequent spelling, found through numbered nodes of two tries."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from alertloom.llm.common import bound_batches
from alertloom.session import stage

MIN_CHARS = 7
MIN_COUNT = 2
#: A word's form is at least so many times as frequent as the word.
RATIO = 10
#: A run whose hash this divides loses one code point.
DELETE_EVERY = 31
#: Rows of position keys that a task hands over at a time.
KEY_ROWS = 1 << 17
#: What a position key stands for: a word without one character, the same where the character
#: before is equal (so an earlier position gives the same rest), or a word cut in two.
SKIPPED, REPEATED, CUT = 0, 1, 2

#: Latin-1 letters A-Z in lower case, a-z and from U+00C0 on as they are; all else ends a run.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def doc_words(doc_id: str, text: str | None, least: int = MIN_CHARS) -> Counter[str]:
    """Counts of a text's words of `least` characters or more, deletions applied."""
    found: Counter[str] = Counter()
    salt = zlib.crc32(f"{doc_id}:".encode())
    runs = (text or "").encode("latin-1", "replace").translate(_LETTERS).split()
    for run, n in Counter(r for r in runs if len(r) >= least).items():
        word = run.decode("latin-1")
        h = zlib.crc32(run if run.isascii() else word.encode(), salt)
        if h % DELETE_EVERY == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1:]
        if len(word) >= least:
            found[word] += n
    return found


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n of the words of all texts that occur `MIN_COUNT` times or more.

    A null text has no words; a null id is written as nothing in the hash that deletes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter[str] = Counter()
            for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                found.update(doc_words(doc_id or "", text.as_py()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    narrow = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    bound_batches(docs.sparkSession)
    counted = narrow.mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_COUNT)


class Part(NamedTuple):
    """A range of sorted words: the nodes of its first word and of the first word after it."""

    first: str
    nodes: list[int]
    next_first: str
    next_nodes: list[int]
    base: int  # of its own node numbers
    rank: int  # of its first word


def common_prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def trie_parts(bounds: Iterable[tuple[int, str, int, int]]) -> dict[int, Part]:
    """Parts by number, from (part, first word, characters and words, words) in order.

    A prefix that words on both sides of a border have is one of the first word after it. So the
    nodes of first words are all that ranges share, and each follows from the first word before.
    """
    made, base, rank = [], 0, 0
    first, nodes = "", [0]  # the root
    for part, word, size, words in bounds:
        shared = common_prefix(first, word)
        nodes = nodes[:shared + 1] + [base + d for d in range(shared + 1, len(word) + 1)]
        first = word
        made.append((part, first, nodes, base, rank))
        base += size
        rank += words
    after = [(w, n) for _, w, n, _, _ in made[1:]] + [("", [0])]
    return {p: Part(w, n, *rest, b, r) for (p, w, n, b, r), rest in zip(made, after, strict=False)}


class TrieNumbers:
    """Numbers the nodes of words that come in order; a prefix is new unless the word before has it too."""

    def __init__(self, parts: dict[int, Part]) -> None:
        self.parts = parts
        self.at: int | None = None

    def add(self, part: int, word: str) -> list[int]:
        """The nodes of the word's prefixes by length; `rank` is the word's rank then."""
        info = self.parts[part]
        if part != self.at:
            self.at, self.seen, self.nodes, self.rank = part, info.first, info.nodes, info.rank - 1
            self.number = info.base + len(info.first) + 1
        known = common_prefix(self.seen, word)
        ahead = common_prefix(word, info.next_first)
        own = self.nodes[:known + 1]
        for depth in range(known + 1, len(word) + 1):
            if depth <= ahead:
                own.append(info.next_nodes[depth])
            else:
                own.append(self.number)
                self.number += 1
        self.seen, self.nodes, self.rank = word, own, self.rank + 1
        return own


def _in_ranges(words: DataFrame, key: str) -> tuple[DataFrame, dict[int, Part]]:
    """The rows sorted by `key` within numbered ranges, and what a task must know of each range.

    One row a range comes to the driver, its first word and sizes.
    """
    ranges = stage(words.repartitionByRange(key).withColumn("part", F.spark_partition_id()), "word-ranges")
    bounds = ranges.groupBy("part").agg(
        F.min(key).alias("first"), F.sum(F.char_length(key) + 1).alias("size"), F.count("*").alias("words"))
    parts = trie_parts([tuple(r) for r in bounds.orderBy("part").collect()])
    return ranges.repartition("part").sortWithinPartitions("part", key), parts


def forward_nodes(words: DataFrame) -> DataFrame:
    """word, n, no, nodes: rank of the word and numbers of its prefixes in the forward trie."""
    rows, parts = _in_ranges(words.select("word", "n"), "word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = TrieNumbers(parts)
        for batch in batches:
            ranks, nodes = [], []
            for part, word in zip(batch.column("part").to_pylist(), batch.column("word").to_pylist(), strict=True):
                nodes.append(trie.add(part, word))
                ranks.append(trie.rank)
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), batch.column("n"), pa.array(ranks, pa.int64()),
                 pa.array(nodes, pa.list_(pa.int64()))], ["word", "n", "no", "nodes"])

    return stage(rows.mapInArrow(run, "word string, n long, no long, nodes array<long>"), "forward-nodes")


def position_keys(forward: DataFrame) -> DataFrame:
    """prefix, suffix, no, n, kind: the node pair of each position of each word.

    A word skips each of its characters and is cut at each place. Two words differ by a replaced
    character if a pair of both skips one, and by an inserted one if a skip of the longer is a cut
    of the shorter.
    """
    rows, parts = _in_ranges(forward.withColumn("back", F.reverse("word")), "back")
    schema = pa.schema([(c, pa.int64()) for c in ("prefix", "suffix", "no", "n")] + [("kind", pa.int8())])

    def batch_of(columns: list[list[int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = TrieNumbers(parts)
        out: list[list[int]] = [[], [], [], [], []]
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("part", "back", "no", "n", "nodes"))
            for part, back, no, n, before in zip(*columns, strict=True):
                suffixes = trie.add(part, back)[::-1]  # by start: suffixes[i] is the node of word[i:]
                size, word = len(back), back[::-1]
                out[0] += before[:-1] + before
                out[1] += suffixes[1:] + suffixes
                out[2] += [no] * (2 * size + 1)
                out[3] += [n] * (2 * size + 1)
                out[4] += [REPEATED if i and word[i - 1] == c else SKIPPED for i, c in enumerate(word)]
                out[4] += [CUT] * (size + 1)
                if len(out[0]) >= KEY_ROWS:
                    yield batch_of(out)
                    out = [[], [], [], [], []]
        yield batch_of(out)

    return rows.mapInArrow(run, "prefix long, suffix long, no long, n long, kind byte")


def near_words(keys: DataFrame) -> DataFrame:
    """no, n_near, best: how many words are near, and (n, -rank) of the most frequent one.

    A node pair holds at most one cut, and skips that differ in one character: its members are no
    more than the characters of the alphabet, 90, and one. Each pair of words is met once: two equal lengths
    differ in one position, and of equal neighbouring characters only the first counts as inserted.
    """
    pair = Window.partitionBy("prefix", "suffix")
    met = keys.withColumn("members", F.count("*").over(pair)).filter("members > 1")
    groups = met.groupBy("prefix", "suffix").agg(F.collect_list(F.struct("no", "n", "kind")).alias("all"))

    def meets(a, b):
        replaced = (a["kind"] != CUT) & (b["kind"] != CUT)
        inserted = ((a["kind"] == SKIPPED) & (b["kind"] == CUT)) | ((a["kind"] == CUT) & (b["kind"] == SKIPPED))
        return (a["no"] != b["no"]) & (replaced | inserted)

    each = groups.select(F.explode("all").alias("own"), "all")
    others = F.filter("all", lambda o: meets(F.col("own"), o))
    seen = each.select(F.col("own.no").alias("no"), others.alias("others")).filter(F.size("others") > 0)
    best = F.array_max(F.transform("others", lambda o: F.struct(o["n"].alias("n"), (-o["no"]).alias("neg_no"))))
    return (
        seen.select("no", F.size("others").alias("count"), best.alias("best"))
        .groupBy("no").agg(F.sum("count").alias("n_near"), F.max("best").alias("best"))
    )


def last_forms(forms: DataFrame) -> DataFrame:
    """no, root: the word at the end of the chain of forms, for words (no) with a form (form_no).

    Counts grow along a chain, so it ends; each round joins a chain's halves, and is written.
    """
    links = stage(forms.select("no", F.col("form_no").alias("root")), "forms")
    while True:
        onward = links.select(F.col("no").alias("root"), F.col("root").alias("next"))
        longer = stage(
            links.join(onward, "root", "left").select(
                "no", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
            "forms")
        links = longer.select("no", "root")
        if longer.filter("moved").isEmpty():
            return links


def variant_groups(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for words (word, n), each word once.

    Near words differ by one inserted, deleted or replaced code point. The form is the most
    frequent near word, the first in code-point order of equals, if it is `RATIO` times as
    frequent; `root` follows forms to the last. Words may be of any length: a word of L characters gives
    2 L + 1 pairs of integers, and no prefix is written out. An empty table gives an empty result.
    """
    bound_batches(words.sparkSession)
    forward = forward_nodes(words)
    near = stage(near_words(position_keys(forward)), "near-words")
    told = forward.select("no", "word", "n").join(near, "no", "left")
    formed = F.col("best.n") >= F.col("n") * RATIO
    told = stage(
        told.select("no", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                    F.when(formed, -F.col("best.neg_no")).alias("form_no"),
                    F.when(formed, F.col("best.n")).alias("form_n")),
        "word-forms")
    roots = last_forms(told.filter("form_no IS NOT NULL"))
    names = told.select("no", "word")
    variants = (
        told.filter("form_no IS NOT NULL").join(roots, "no")
        .join(names.toDF("form_no", "form"), "form_no").join(names.toDF("root", "_root"), "root")
        .select("word", "form", F.col("_root").alias("root"), "n", "n_near", "form_n")
    )
    own = told.filter("form_no IS NULL").select(
        "word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", "n_near", "form_n")
    return variants.unionByName(own)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variant groups of the words of `documents`; null texts have none, other columns are not looked at."""
    return variant_groups(word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet")))
