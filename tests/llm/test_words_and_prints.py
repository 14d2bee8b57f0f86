"""Spelling variants and fingerprint links against all pairs, and the numbers and codes behind them."""

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash

from alertloom.llm import golay, simhash_dedup, source_divergence, spelling_variants
from alertloom.llm.registry import LLM_QUERIES
from tests.llm.conftest import prose, rows

TEXT = "doc_id long, text string, word string, part string, `n` string"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def near(a, b):
    """Whether one inserted, deleted or replaced code point makes `b` of `a`."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def variants(found: list[tuple[int | None, str | None]]) -> set[tuple]:
    counts = Counter()
    for doc_id, text in found:
        for run in re.findall("[A-Za-zÀ-ÿ]+", lower(text)):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            at = h % len(run)
            counts[run if h % 31 else run[:at] + run[at + 1:]] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}
    neighbours = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(neighbours[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n[w], len(neighbours[w]), n.get(form[w])) for w in n}


def misspelled(rng):
    """Texts with frequent words and rarer misspellings of them, in chains, with equal letters in a row."""
    words = ["aaaaaaaa", "aabbaabb", "straßenÿ", "Àlteration", "committee", "bookkeeper", "zzzzzzzb", "aaaaaaab"]
    made = []
    for word in words:
        forms = {word}
        for _ in range(14):
            base = rng.choice(sorted(forms))
            at = rng.randrange(len(base))
            forms.add(rng.choice([base[:at] + base[at + 1:], base[:at] + rng.choice("abÿ") + base[at:],
                                  base[:at] + rng.choice("kzé") + base[at + 1:]]))
        for i, form in enumerate(sorted(forms, key=lambda f: (f != word, f))):
            made += [form.upper() if rng.random() < 0.2 and form.isascii() else form] * (400 if i == 0 else 30 if i < 4 else 2)
    rng.shuffle(made)
    texts = [(i, " ".join(made[i * 40:i * 40 + 40])) for i in range(len(made) // 40 + 1)]
    long = "xy" * 1500
    return texts + [texts[0], (None, texts[1][1]), (None, None), (7, ""), (8, f"{long} {long}, {long}q {long}q"), (9, "日本" * 9)]


@pytest.mark.parametrize("ranges", [1, 7])
def test_variants_match_all_pairs(spark, ranges):
    found = misspelled(random.Random(11))
    docs = spark.createDataFrame([(d, t, "x", "x", "x") for d, t in found], TEXT)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        groups = spelling_variants.variant_groups(spelling_variants.word_counts(docs)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    got = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in groups}
    want = variants(found)
    assert len(groups) == len(got) and got == want
    assert sum(r[1] is not None for r in want) > 20 and any(r[1] != r[2] and r[1] for r in want)


def test_variants_of_the_table(spark, tables):
    got = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in LLM_QUERIES["op11_spelling_variants"](spark, tables).collect()}
    assert got == variants([(r["doc_id"], r["text"]) for r in rows()])


def test_trie_nodes_are_numbered_once_over_all_ranges():
    rng = random.Random(2)
    words = sorted({"".join(rng.choices("abé", k=rng.randint(1, 7))) for _ in range(400)})
    cuts = [0, 1, 2, 40, 41, 150, len(words)]
    parts = [words[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    trie = spelling_variants.TrieNumbers(spelling_variants.trie_parts(
        [(i, p[0], sum(len(w) + 1 for w in p), len(p)) for i, p in enumerate(parts)]))
    numbers, ranks = {}, []
    for i, part in enumerate(parts):
        for word in part:
            for depth, node in enumerate(trie.add(i, word)):
                assert numbers.setdefault(word[:depth], node) == node
            ranks.append(trie.rank)
    assert len(set(numbers.values())) == len(numbers)
    assert ranks == list(range(len(words)))


def test_code_words_near_a_word():
    table, sizes = golay.patterns()
    assert set(sizes.tolist()) == {1, 6} and (golay.remainders(table) == np.arange(len(table))[:, None])[sizes == 6].all()
    rng = np.random.default_rng(3)
    words = rng.integers(0, 1 << 23, 4000)
    flips = (1 << rng.integers(0, 23, 4000)) | (1 << rng.integers(0, 23, 4000))

    def indices(of):
        at, index = golay.near_codewords(of)
        return [set(index[at == i].tolist()) for i in range(len(of))]

    assert all(a & b for a, b in zip(indices(words), indices(words ^ flips), strict=True))


def test_keys_of_linked_prints_meet():
    rng = np.random.default_rng(4)
    prints = rng.integers(-1 << 63, 1 << 63, 3000, np.int64)
    one, two = (np.int64(1) << rng.integers(0, 64, 3000) for _ in range(2))
    keys = []
    for own in (prints, prints ^ one ^ two):
        at, key = simhash_dedup.segment_keys(own)
        assert np.bincount(at).max() <= 18
        keys.append([set(k) for k in np.split(key[np.argsort(at, kind="stable")], np.cumsum(np.bincount(at))[:-1])])
    assert all(a & b for a, b in zip(*keys, strict=True))


def print_groups(found):
    """(id, fingerprint, component) of each row, from all pairs."""
    prints = []
    for _, text in found:
        words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        shingles = [" ".join(words[i:i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    reach = list(range(len(found)))
    links = [(i, j) for i in range(len(found)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            low = min(reach[i], reach[j])
            changed |= reach[i] != low or reach[j] != low
            reach[i] = reach[j] = low
    least = {}
    for (d, _), c in zip(found, reach, strict=True):
        if d is not None:
            least[c] = min(d, least.get(c, d))
    return Counter((d, format(p, "016x"), least.get(c)) for (d, _), p, c in zip(found, prints, reach, strict=True))


def copies(rng):
    """Long texts with one word changed here and there, null and repeated ids, and texts without words."""
    base = prose(rng, "en", 3000).split(" ")
    found = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(90)}"
        found.append((i, " ".join(words)))
    return found + [(None, found[3][1]), (3, found[3][1]), (3, "one two"), (None, "alone here"), (70, None), (71, " \n"), (72, "One TWO")]


@pytest.mark.parametrize("compared", [0, 3, simhash_dedup.COMPARED])
def test_print_groups_match_all_pairs(spark, compared):
    found = copies(random.Random(8))
    docs = spark.createDataFrame([(d, t, "x", "x", "x") for d, t in found], TEXT)
    groups = simhash_dedup.simhash_groups(docs, compared).collect()
    want = print_groups(found)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in groups) == want
    assert len({p for _, p, _ in want}) > 20 > len({c for *_, c in want})


def test_prints_of_the_table(spark, tables, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "SLICE", 50)  # so that texts take several slices
    found = [(r["doc_id"], r["text"]) for r in rows()]
    groups = LLM_QUERIES["op12_simhash_dedup"](spark, tables).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in groups) == print_groups(found)


@pytest.mark.parametrize("block, chunk", [(1, 64), (3, 1024)])
def test_divergence_in_blocks_and_chunks(spark, tables, tmp_path, monkeypatch, block, chunk):
    monkeypatch.setattr(source_divergence, "BLOCK", block)
    monkeypatch.setattr(source_divergence, "CHUNK", chunk)
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    empty = docs.filter("doc_id < 2").selectExpr("null as doc_id", "cast(null as string) as text", "'en' as lang", "null as source")
    more = docs.select("doc_id", "text", "lang", "source").unionByName(empty).unionByName(
        docs.filter("doc_id < 30").select("doc_id", "text", "lang", "source"))
    more.write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = Counter(db.execute(source_divergence.ORACLE).fetchall())
    found = source_divergence.source_divergence(spark.read.parquet(str(tmp_path / "documents.parquet")))
    got = Counter(tuple(r) for r in found.select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == want and {p for _, _, p, *_ in want} == {"pair", "term"}
