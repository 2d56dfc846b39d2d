import os
import random

import pytest

from textloom.llm import tokenizer as tk

pytestmark = pytest.mark.skipif(not os.path.exists(tk.rank_file("byte_bpe_50k")), reason="no vocabulary files here")


@pytest.mark.parametrize("name", ["byte_bpe_50k", "byte_bpe_multi_50k"])
def test_same_as_replaying_merges(name):
    import base64

    import tiktoken

    with open(tk.rank_file(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    ref = tiktoken.Encoding("ref", pat_str=tk.PATTERN, mergeable_ranks=ranks, special_tokens={})
    bpe = tk.encoder(tk.rank_file(name))
    rng = random.Random(7)
    alphabet = "etaoin shrdlu  \n\t.,'s't-é漢🙂0123\u00a0́"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    texts += ["<|endoftext|>", " ", "   ", "a  b", "\n\n x", "x ", "a" * 5000, " " * 3000, "ab" * 3000]
    for t in texts:
        assert bpe.encode(t) == ref.encode_ordinary(t), repr(t)
        assert ref.decode(bpe.encode(t)) == t


def test_null_and_empty(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "the cat")], "doc_id long, text string")
    got = {r[0]: r[1] for r in df.select("doc_id", tk.encode(df.text)).collect()}
    assert got[1] == [] and got[2] == [] and len(got[3]) == 2
    n = {r[0]: r[1].byte_bpe_50k for r in df.select("doc_id", tk.count_tokens(df.text, ["byte_bpe_50k"])).collect()}
    assert n == {1: 0, 2: 0, 3: 2}
