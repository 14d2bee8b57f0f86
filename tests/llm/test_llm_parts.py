"""Parts of the operators: round trips, raking, code words, and the stages of the pipeline."""

import gc
import random
import re
import tracemalloc
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from alertloom.llm import bwt_repeats, chat_format, exact_dedup, minhash_dedup, source_mix, suffix_dedup
from alertloom.llm.common import trimmed
from alertloom.llm.language_id import BUCKETS, Model, code_words
from alertloom.llm.sentence_pieces import MODEL, decode, encode, load
from alertloom.llm.window_anchors import LENGTH, anchored


@pytest.mark.parametrize("text", ["", "\\", "</s>", "<\\/s>", "\\</s>[INST]\\\\[/INST]", "<|role|><<SYS>>"])
def test_controls_are_escaped_reversibly(text):
    inside = chat_format.escape(text)
    assert chat_format.unescape(inside) == text
    assert not any(c in inside for c in chat_format.CONTROLS)


def _expected(mix, at):
    sums = {}
    for k, n in mix.cells.items():
        sums[k[at]] = sums.get(k[at], 0.0) + n * mix.probability[k]
    return sums


def test_raking_meets_the_targets():
    cells = {(a, b): n for (a, b), n in zip([(x, y) for x in "ab" for y in "cd"], [10, 20, 30, 400], strict=True)}
    targets = {"first": {"a": 0.3, "b": 0.7}, "second": {"c": 0.5, "d": 0.5}}
    mix = source_mix.rake(cells, targets, 0.1)
    assert mix.gap < 1e-6 and sum(_expected(mix, 0).values()) == pytest.approx(46)
    assert _expected(mix, 0) == pytest.approx({"a": 13.8, "b": 32.2}, rel=1e-5)
    assert _expected(mix, 1) == pytest.approx({"c": 23, "d": 23}, rel=1e-5)


def test_raking_goes_on_beside_whole_cells():
    """Without the cap, raking wants more than 8 tokens of (a, c), which has 5."""
    cells = {("a", "c"): 5, ("a", "d"): 95, ("b", "c"): 70, ("b", "d"): 30}
    mix = source_mix.rake(cells, {"first": {"a": 0.5, "b": 0.5}, "second": {"c": 0.54, "d": 0.46}}, 0.5)
    assert mix.probability["a", "c"] == 1.0 and mix.gap < 1e-5
    assert _expected(mix, 0) == pytest.approx({"a": 50, "b": 50}, rel=1e-5)
    assert _expected(mix, 1) == pytest.approx({"c": 54, "d": 46}, rel=1e-5)


@pytest.mark.parametrize("seed", range(5))
def test_raking_meets_any_targets_that_some_probabilities_meet(seed):
    rng = np.random.default_rng(seed)
    cells = {(a, b, c): int(rng.integers(0, 1000)) for a in range(4) for b in range(3) for c in range(2)}
    chance = {k: rng.random() ** 3 for k in cells}
    total = sum(cells[k] * chance[k] for k in cells)
    targets = {side: {v: sum(cells[k] * chance[k] for k in cells if k[side] == v) / total for v in range(n)}
               for side, n in enumerate((4, 3, 2))}
    mix = source_mix.rake(cells, targets, total / sum(cells.values()))
    assert mix.gap < 1e-4 and all(0 <= p <= 1 for p in mix.probability.values())


def test_targets_that_cannot_be_met_are_reported(spark):
    cells = {("a",): 10, ("b",): 90, ("c",): 0}
    mix = source_mix.rake(cells, {"side": {"a": 0.6, "b": 0.3, "none": 0.1}}, 0.5)
    assert mix.probability == pytest.approx({("a",): 1.0, ("b",): 40 / 90, ("c",): 1.0})
    got = {r.value: (r.tokens, r.target, round(r.attained, 6), r.reachable) for r in source_mix.attained(spark, mix).collect()}
    assert got == {"a": (10, 0.6, 0.2, False), "b": (90, 0.3, 0.8, True), "c": (0, 0.0, 0.0, True), "none": (0, 0.1, 0.0, False)}
    apart = source_mix.rake({("a", "c"): 10, ("b", "d"): 10}, {"x": {"a": 0.9, "b": 0.1}, "y": {"c": 0.1, "d": 0.9}}, 0.5)
    assert apart.gap > 0.1  # each side could be met, but not both
    assert source_mix.rake({}, source_mix.TARGETS).probability == {}


def test_code_words_differ():
    words = code_words(9)
    assert len({tuple(w) for w in words.tolist()}) == 9


@pytest.mark.parametrize("length", [3, 8])
def test_transform_finds_repeated_windows(length):
    rng = np.random.default_rng(3)
    strings = [bytes(rng.integers(97, 99, n).astype(np.uint8)) for n in (0, 2, 8, 40, 90)] + [b"\0\0\0\0" * 4, b"\xff" * 9]
    count: dict[bytes, int] = {}
    for s in strings:
        for i in range(len(s) - length + 1):
            count[s[i:i + length]] = count.get(s[i:i + length], 0) + 1
    for s, found in zip(strings, bwt_repeats.repeated_starts(strings, length), strict=True):
        assert found.tolist() == [count[s[i:i + length]] > 1 for i in range(len(s) - length + 1)]


def test_every_window_has_one_anchor():
    data = bytes(np.random.default_rng(4).integers(0, 4, 5000).astype(np.uint8))
    for text in (data, b"ab" * 1000, data[:LENGTH], data[:LENGTH - 1]):
        _, first, last = anchored(text)
        held = sorted(i for a, b in zip(first, last, strict=True) for i in range(a, b + 1))
        assert held == list(range(len(text) - LENGTH + 1))


def test_only_strings_with_a_partner_are_transformed():
    rng = np.random.default_rng(6)
    noise = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8))
    left, core, right = noise(368), noise(32), noise(368)
    shared = [(0, 368), (10, 358), (184, 184), (200, 168), (368, 0), (0, 0), (90, 90), (184, 130), (130, 184)]
    strings = [noise(368 - a) + left[368 - a:] + core + right[:b] + noise(368 - b) for a, b in shared]
    windows = [{s[i:i + LENGTH] for i in range(len(s) - LENGTH + 1)} for s in strings]
    near = suffix_dedup.may_repeat(strings, [368] * len(strings))
    for k, own in enumerate(windows):
        assert near[k] or not any(own & other for i, other in enumerate(windows) if i != k)
    assert not any(near[5:]) and suffix_dedup.may_repeat(strings[:1], [368]) == [False]
    flags = bwt_repeats.repeated_starts([strings[0], strings[1] + b"x", core + right, left + core], LENGTH)
    near = suffix_dedup.may_repeat([strings[0], core + right, left + core], [368, 0, 368])
    assert near == [True, True, False] and flags[2].all() and not flags[3].any()


def test_pieces_round_trip():
    import public_tokenizers

    model = load(public_tokenizers.path(MODEL))
    for text in ("a", " a  b ", "日本☃\n\t", "x" * 3000):
        assert decode(encode([text], model)[0].tolist(), model) == text


def test_pipeline_stages(spark, tables, documents):
    kept = spark.read.parquet(f"{tables}/documents.parquet")
    before = kept.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, tables)
        assert after.columns == kept.columns
        got = {r["doc_id"]: r for r in after.collect()}
        assert 0 < len(got) <= before
        want = {r["doc_id"]: r for r in kept.filter(kept.doc_id.isin(*got)).collect()}
        assert got == want  # kept rows are unchanged
        before = len(got)
        kept = spark.createDataFrame(list(got.values()), kept.schema)
    out = corpus_pipeline.STAGES[-1][1](spark, kept, tables).collect()
    assert {r.doc_id for r in out} == {r.doc_id for r in kept.collect()}
    assert all(r.n_pieces == len(r.piece_ids) for r in out)


def test_pipeline_over_empty_tables(spark, no_rows):
    assert corpus_pipeline.run(spark, no_rows).count() == 0


TEXT = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


@pytest.mark.parametrize("dedup", [minhash_dedup.near_dedup, exact_dedup.exact_dedup])
def test_rows_without_an_id_are_told_apart(spark, dedup):
    other = TEXT[::-1]
    rows = [(1, TEXT, "a"), (None, TEXT, "b"), (None, other, "c"), (None, None, "d"), (4, "", "e"), (5, TEXT + " nu " + other, "f")]
    kept = sorted((r["doc_id"] or 0, r["row"]) for r in dedup(spark.createDataFrame(rows, "doc_id int, text string, row string")).collect())
    near = [(0, "d")] if dedup is minhash_dedup.near_dedup else []  # without a word, nothing is near
    assert kept == [(0, "c"), *near, (1, "a"), (4, "e"), (5, "f")]


def test_only_suspects_are_shuffled(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    plan = exact_dedup.exact_dedup(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and "LeftSemi" not in plan
    hashing = [line for line in plan.splitlines() if "sha2(" in line]
    assert len(hashing) == 1 and plan.startswith("Union")  # the digest is computed on one branch alone


def test_words_of_a_slice_are_not_held():
    import public_tokenizers

    model = load(public_tokenizers.path(MODEL))
    gc.collect()
    gc.disable()
    try:
        encode(["oncewritten word"], model)
        held = [x for x in gc.get_objects() if isinstance(x, defaultdict) and "▁oncewritten" in x]
    finally:
        gc.enable()
    assert not held


def test_near_copies_of_a_missing_text_meet_only_if_linked(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(80)]
    texts = []
    for k in range(150):  # the text itself is not there, and most copies lie near the limit
        words = list(base)
        for at in rng.sample(range(80), rng.choice((1, 1, 2, 2, 3))):
            words[at] = f"new{k}-{at}"
        texts.append(" ".join(words))
    formed = []
    whole = minhash_dedup.remaining_pairs

    def remaining_pairs(*tables):
        formed.append(minhash_dedup.stage(whole(*tables), "formed"))
        return formed[0]

    monkeypatch.setattr(minhash_dedup, "remaining_pairs", remaining_pairs)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_groups(docs).collect()}
    sets = [set(minhash_dedup.shingles(t).tolist()) for t in texts]
    linked = {(a, b) for a in range(150) for b in range(a + 1, 150)
              if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    expected = list(range(150))
    while True:
        lower = list(expected)
        for a, b in linked:
            lower[a] = lower[b] = min(lower[a], lower[b])
        if lower == expected:
            break
        expected = lower
    assert [got[k] for k in range(150)] == expected and 1 < len(set(expected)) < 150
    pairs = {(r.a, r.b) for r in formed[0].collect()}
    assert len(pairs - linked) <= 50, (len(pairs), len(pairs & linked))


def _copies_of_a_missing_text(rng, n, at_most):
    texts = []
    for k in range(n):
        words = [f"w{i}" for i in range(80)]
        for at in rng.sample(range(80), rng.randint(1, at_most)):
            words[at] = rng.choice((f"new{k}-{at}", "often"))
        texts.append(" ".join(words))
    return texts


def _linked(sets, limit=75):
    return {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= limit * len(sets[a] | sets[b])}


def test_sets_told_from_a_leader_meet_by_rare_differences(spark):
    texts = [" ".join([f"w{i}" for i in range(80)] + ["only here"]), *_copies_of_a_missing_text(random.Random(9), 200, 6)]
    sets = {k: set(minhash_dedup.shingles(t).tolist()) for k, t in enumerate(texts)}
    linked = _linked(sets)
    part = {k: 0 if (0, k) in linked else k for k in sets}
    rows = [(k, 0, len(sets[k]), part[k]) for k in sets if k]
    full = spark.createDataFrame([(k, list(v)) for k, v in sets.items()], "rep long, shingles array<long>")
    told = minhash_dedup.differences(spark.createDataFrame(rows, "rep long, pivot long, n int, component long"), full)
    got = [(r.a, r.b) for r in minhash_dedup.told_links(told).collect()]
    expected = {(a, b) for a, b in linked if a and part[a] != part[b]}
    assert set(got) == expected and len(got) == len(expected) > 9
    held = defaultdict(lambda: [0, 0])
    for r in minhash_dedup.difference_prefixes(told).collect():
        held[r.element][r.near] += 1
    compared = sum(far * (far + near) for far, near in held.values())
    far = sum(part[k] > 0 for k in sets)
    assert 50 < far < 150 and compared < 4 * far * len(rows), (compared, far)  # lists alone compare each pair up to 31 times


@pytest.mark.parametrize("apart", [0, 30])
def test_sets_without_a_known_difference_meet_too(spark, monkeypatch, apart):
    monkeypatch.setattr(minhash_dedup, "APART", apart)
    texts = _copies_of_a_missing_text(random.Random(10), 90, 4)
    sets = {k: set(minhash_dedup.shingles(t).tolist()) for k, t in enumerate(texts)}
    expected = dict.fromkeys(sets, 0) | {k: k for k in sets}
    for _ in sets:
        for a, b in _linked(sets):
            expected[a] = expected[b] = min(expected[a], expected[b])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_groups(docs).collect()}
    assert got == expected and 1 < len(set(expected.values())) < 90


def test_no_task_of_the_removal_holds_two_python_processes(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")

    def processes(node):
        below = [processes(node.children().apply(i)) for i in range(node.children().size())]
        assert all(n <= 1 for n in below), plan.toString()
        own = max(below, default=0)
        return 0 if "SortMergeJoin" in node.nodeName() else own + ("MapInArrow" in node.nodeName())

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = suffix_dedup.remove_repeats(docs)._jdf.queryExecution().sparkPlan()  # a sort-merge join begins a stage
        assert processes(plan) <= 1 and plan.toString().count("MapInArrow") == 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _peak(function) -> int:
    tracemalloc.start()
    try:
        function()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_encoding_holds_no_more_for_a_whole_batch_than_for_a_quarter():
    import public_tokenizers

    model = load(public_tokenizers.path(MODEL))
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("etaoinshr", k=6)) for _ in range(1000)) for _ in range(140)]
    encode(texts, model)  # fills the table of pairs
    part, whole = (_peak(lambda n=n: encode(texts[:n], model)) for n in (35, 140))
    assert whole < 2 * part


def test_prediction_holds_no_more_for_a_whole_batch_than_for_a_quarter():
    code = code_words(5)
    weights, ones = np.ones((BUCKETS, code.shape[1]), np.float32), np.ones(code.shape[1])
    model = Model(list("abcde"), code, weights, 0 * ones, ones, ones)
    texts = ["several words of a text " * 400] * 24
    part, whole = (_peak(lambda n=n: model.margins(texts[:n])) for n in (6, 24))
    assert whole < 2 * part


def test_workers_give_back_what_they_freed():
    def anonymous() -> float:
        with open("/proc/self/status") as f:
            return int(re.search(r"RssAnon:\s+(\d+)", f.read())[1]) / 1024

    def run(batches):
        held = [np.ones(12_000) for _ in range(2500)]  # 240 MB in pieces that the allocator keeps
        pinned.append(np.ones(12_000))
        yield from batches
        del held

    pinned: list[np.ndarray] = []
    batch = pa.RecordBatch.from_pydict({"x": [1, 2]})
    before = anonymous()
    assert list(trimmed(run)(iter([batch, batch]))) == [batch, batch]
    assert anonymous() < before + 60
    del pinned
