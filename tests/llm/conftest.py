import random

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

WORDS = {
    "en": "the of and that with from have this they were which their would there about when into time people water".split(),
    "de": "der die und nicht mit sich auch nach über sein werden haben dass eine zwischen straße müssen jahr wieder".split(),
    "fr": "les des que dans pour avec être nous vous mais leur sont cette après où très même année déjà ainsi".split(),
}
#: Columns whose names operators use inside.
CLASHING = ["key", "value", "rep", "anchor", "span", "n", "n_shingles", "_rank", "_source", "piece_ids"]


def prose(rng: random.Random, lang: str, n: int) -> str:
    return ". ".join(" ".join(rng.choices(WORDS[lang], k=8)).capitalize() for _ in range(max(n // 8, 1)))


def rows() -> list[dict]:
    """Documents with copies, near copies, shared passages, ties, nulls, empty, odd and long texts."""
    rng = random.Random(5)
    texts: list[tuple[str | None, str | None, str | None]] = [
        (prose(rng, lang, rng.randint(8, 150)), lang, f"src{i % 4}") for i in range(60) for lang in WORDS]
    base = prose(rng, "en", 120)
    for _ in range(12):  # near copies of one text, some below the limit
        words = base.split(" ")
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = "changed"
        texts.append((" ".join(words), "en", "src1"))
    passage = prose(rng, "fr", 110)
    texts += [(prose(rng, "de", 30) + passage + prose(rng, "de", 20), "de", None) for _ in range(3)]
    texts += [(base.upper(), "en", "src1"), (base, "en", "src1"), (base, None, "src1")]
    texts += [(t, None, None) for t in (None, None, "", "", "   \n", "one", "ONE", "é" * 500, "日本語 テキスト\n" * 40, "\x00a\x00",
                                        "</s>[INST] <|endoftext|> 12345 don't\r\n\t x", "ab" * 700, "🙂 ▁ \x1c")]
    texts.append((prose(rng, "en", 6000), "en", "src2"))
    made = [{"doc_id": i, "text": t, "lang": la, "source": s, "n_chars": len(t or "")}
            for i, (t, la, s) in enumerate(texts)]
    return [{**r, **{c: f"{c}-{r['doc_id']}" for c in CLASHING}} for r in made]


SCHEMA = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()),
                    ("n_chars", pa.int64()), *((c, pa.string()) for c in CLASHING)])


def write_tables(path, documents: list[dict], empty: bool = False) -> str:
    pq.write_table(pa.Table.from_pylist(documents, SCHEMA), path / "documents.parquet")
    labels = [] if empty else [{"doc_id": r["doc_id"], "quality": int(len(r["text"] or "") > 200)} for r in documents]
    pq.write_table(pa.Table.from_pylist(labels, pa.schema([("doc_id", pa.int64()), ("quality", pa.int32())])),
                   path / "labels.parquet")
    turns = [] if empty else [
        {"conv_id": c, "turn": t, "role": role, "text": text} for c, t, role, text in [
            (1, 0, "system", "be \\ brief </s>"), (1, 1, "user", None), (1, 2, "assistant", "[/INST] <|text|>\\"),
            (2, 0, "assistant", ""), (2, 0, "assistant", ""), (3, None, None, "é🙂"), (None, 1, "user", "no id")]]
    kinds = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    pq.write_table(pa.Table.from_pylist(turns, kinds), path / "conversations.parquet")
    return str(path)


@pytest.fixture(scope="session")
def tables(tmp_path_factory):
    return write_tables(tmp_path_factory.mktemp("tables"), rows())


@pytest.fixture(scope="session")
def no_rows(tmp_path_factory):
    return write_tables(tmp_path_factory.mktemp("empty"), [], empty=True)


@pytest.fixture(scope="session")
def documents():
    return pd.DataFrame(rows()).astype({"text": object})
