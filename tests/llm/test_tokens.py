import random

import numpy as np
import pytest

from letterloom.llm import packing, tokenizer

PATH = f"{tokenizer.TOKENIZERS}/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=tokenizer.ranks(PATH), special_tokens={})


def test_ids_equal_the_public_library(reference):
    rng = random.Random(1)
    signs = " \n\t'sstmdrevel'lläé漢字١٢½¼ⅷ  \r​😀-.,,9 0A<|>"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(4000)] + ["<|endoftext|>", "a" * 30_000, " " * 999 + "x", None, ""]
    ids, at = tokenizer.encoder(PATH).encode(texts)
    for i, t in enumerate(texts):
        own = ids[at[i] : at[i + 1]].tolist()
        assert own == (reference.encode_ordinary(t) if t else [])
        assert tokenizer.encoder(PATH).decode(own) == (t or "")


def test_column_in_spark(spark, reference):
    df = spark.createDataFrame([(1, "Guten Tag", "x"), (2, None, "y"), (3, "", None), (1, "Guten Tag", "x")], "doc_id long, text string, ids string").drop("ids")
    got = sorted((r["doc_id"], r["ids"]) for r in tokenizer.encode_column(df, "text").collect())
    want = reference.encode_ordinary("Guten Tag")
    assert got == [(1, want), (1, want), (2, []), (3, [])]
    assert tokenizer.encode_column(df.limit(0), "text").count() == 0
    assert sorted(r["n_tokens"] for r in tokenizer.encode_column(df, "text", counts_only=True).collect()) == [0, 0, len(want), len(want)]


def test_forgetting_changes_nothing(monkeypatch, reference):
    monkeypatch.setattr(tokenizer, "KEPT_WORDS", 3)
    e = tokenizer.Encoder(PATH)
    for t in ("eins zwei drei vier", "fünf sechs eins", "zwei drei"):
        assert e.encode([t])[0].tolist() == reference.encode_ordinary(t)


def test_nnls_meets_the_optimality_conditions():
    rng = np.random.default_rng(2)
    a, b = np.abs(rng.normal(size=(20, 60))), np.abs(rng.normal(size=20))
    x = packing.nnls(a, b)
    w = a.T @ (b - a @ x)
    assert (x >= 0).all() and (w <= 1e-5).all() and abs(w[x > 0]).max() < 1e-5


@pytest.mark.parametrize("name", ["mixed", "long", "tiny", "one size", "none"])
def test_packing_keeps_every_piece_and_the_capacity(spark, name):
    rng = random.Random(4)
    size = {"mixed": lambda: int(rng.lognormvariate(4, 0.8)), "long": lambda: rng.randint(150, 900), "tiny": lambda: rng.randint(0, 6), "one size": lambda: 171, "none": lambda: 0}[name]
    rows = [(i, size() if i % 50 else None, "x") for i in range(1500)] if name != "none" else []
    df = spark.createDataFrame(rows, "item long, n int, teil string")
    got = packing.pack(df, "item", "n", 256).collect()
    whole, used = {}, {}
    for r in got:
        assert 0 <= r["laenge"] <= 256
        whole[r["item"]] = whole.get(r["item"], 0) + r["laenge"]
        used[r["behaelter"]] = used.get(r["behaelter"], 0) + r["laenge"]
    assert whole == {i: n or 0 for i, n, _ in rows}
    assert all(u <= 256 for u in used.values())
    for r in got:
        if (dict((i, n) for i, n, _ in rows)[r["item"]] or 0) <= 256:
            assert r["teil"] == 0
    if name == "mixed":
        assert sum(used.values()) / (256 * len(used)) > 0.95
