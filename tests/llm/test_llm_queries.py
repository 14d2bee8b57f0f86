"""Each query over a small table of odd rows, against SQL, a library or brute force."""

import hashlib
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest

from alertloom.llm.registry import LLM_ORACLES, LLM_QUERIES
from tests.llm.conftest import rows


def _text(row):
    return row["text"] or ""


def _all(spark, name, sf_dir):
    return {r["doc_id"]: r for r in LLM_QUERIES[name](spark, sf_dir).collect()}


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_sql(spark, tables, name):
    db = duckdb.connect()
    for table in ("documents", "conversations"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tables}/{table}.parquet'")
    found = LLM_QUERIES[name](spark, tables)
    columns = sorted(found.columns)
    want = db.execute(f"SELECT {', '.join(columns)} FROM ({LLM_ORACLES[name]})").fetchall()
    got = [tuple(r) for r in found.select(*columns).collect()]
    assert Counter(map(str, got)) == Counter(map(str, want))


@pytest.mark.parametrize("name", sorted(LLM_QUERIES))
def test_empty_tables(spark, no_rows, name):
    assert LLM_QUERIES[name](spark, no_rows).count() == (1 if name == "op3_chat_format" else 0)


def test_pieces_match_the_library(spark, tables):
    sp = pytest.importorskip("sentencepiece")
    library = sp.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = _all(spark, "op2_sentence_pieces", tables)
    for row in rows():
        ids = library.encode(_text(row))
        own = got[row["doc_id"]]
        digest = hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest()
        assert (own.n_pieces, own.ids_sha256, own.round_trip) == (len(ids), digest, True), row["doc_id"]


def test_token_counts_match_the_library(spark, tables):
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    got = _all(spark, "op10_token_count", tables)
    for row in rows():
        n = len(library.encode(_text(row), add_special_tokens=False).ids)
        own = got[row["doc_id"]]
        assert (own.n_bytes, own.n_tokens, own.over_limit) == (len(_text(row).encode()), n, n > 512), row["doc_id"]


def _removed(texts: list[bytes]) -> list[np.ndarray]:
    """Which bytes of each text a string of 400 bytes covers that starts twice or more."""
    starts = Counter(t[i:i + 400] for t in texts for i in range(len(t) - 399))
    gone = [np.zeros(len(t), bool) for t in texts]
    for t, flags in zip(texts, gone, strict=True):
        for i in range(len(t) - 399):
            if starts[t[i:i + 400]] > 1:
                flags[i:i + 400] = True
    return gone


@pytest.mark.parametrize("group", [None, 1])
def test_repeated_strings(spark, tables, monkeypatch, group):
    if group:  # every group of different strings goes the way of the large ones
        monkeypatch.setattr("alertloom.llm.suffix_dedup.GROUP", group)
    got = _all(spark, "op7_suffix_dedup", tables)
    texts = [_text(r).encode() for r in rows()]
    for row, data, gone in zip(rows(), texts, _removed(texts), strict=True):
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1).sum())
        own = got[row["doc_id"]]
        assert (own.n_bytes, own.n_removed, own.n_spans, own.kept_sha256) == (
            len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()), row["doc_id"]


def _groups(texts: list[str]) -> tuple[list[int], list[int]]:
    """Sizes of the shingle sets, and the first document each document reaches, from all pairs."""
    sets = []
    for text in texts:
        words = text.encode().lower().split()
        last = max(len(words) - 4, 1 if words else 0)
        sets.append({tuple(words[i:i + 5]) for i in range(last)})
    reach = list(range(len(texts)))
    changed = True
    links = [(i, j) for i in range(len(sets)) for j in range(i)
             if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in links:
            low = min(reach[i], reach[j])
            if reach[i] != low or reach[j] != low:
                reach[i] = reach[j] = low
                changed = True
    return [len(s) for s in sets], reach


def test_near_groups(spark, tables):
    got = _all(spark, "op9_minhash_dedup", tables)
    sizes, reach = _groups([_text(r) for r in rows()])
    assert {d: (r.n_shingles, r.component_id, r.kept) for d, r in got.items()} == {
        i: (n, c, c == i) for i, (n, c) in enumerate(zip(sizes, reach, strict=True))}
    assert 5 < sum(c != i for i, c in enumerate(reach)) < 60


def test_language_of_held_out_rows(spark, tables):
    got = _all(spark, "op5_language_id", tables)
    right = held = 0
    for row in rows():
        own = got[row["doc_id"]]
        assert own.held_out == (zlib.crc32(str(row["doc_id"]).encode()) % 3 == 1) and 0 <= own.score <= 1
        if not any(c.isalpha() for c in _text(row)):
            assert own.lang_pred == "und"
        elif own.held_out and row["lang"]:
            held += 1
            right += own.lang_pred == row["lang"]
    assert held > 30 and right >= 0.9 * held


def test_quality_scores(spark, tables):
    got = _all(spark, "op4_quality_crf", tables)
    assert len(got) == len(rows())
    for d, own in got.items():
        assert own.held_out == (zlib.crc32(str(d).encode()) % 5 == 0)
        assert 0 <= own.score <= 1 and own.predicted == int(own.score >= 0.3)


def test_mix_meets_its_probabilities(spark, tables):
    for own in _all(spark, "op6_source_mix", tables).values():
        digest = hashlib.md5(str(own.doc_id).encode()).hexdigest()
        assert own.draw == int(digest[:8], 16) / 2**32
        assert own.sampled == (own.draw < own.probability) and 0 <= own.probability <= 1
