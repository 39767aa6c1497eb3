import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docloom.llm import packing as P


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def fast():
    return P.Encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


TEXTS = [
    "", "a", " a", "a ", "a  b", "a\nb", "a\n\nb", "\na", "a \nb", "a\n b", "it's  we'll\tx", "x\r\ny", "é\xa0ü", "<|endoftext|>", "a <|endoftext|> b",
    "漢字 🚀 x", "don't DON'T '' 's's", "12 3.4,5 a1b2", "soft\xadhyphen", "q\x85w", "½ ² ³ ª º", "don't stop\nit's 'm 're", "I’m   x", "᠆ ᠎", "a\x00b",
]


def test_ids_equal_the_tokenizers_file(plain, fast):
    rnd = random.Random(0)
    alphabet = [chr(c) for c in range(0x20, 0x2B0)] + list("   \n\n''aaatsmeé.,!0")
    texts = TEXTS + ["".join(rnd.choices(alphabet, k=rnd.randrange(80))) for _ in range(3000)]
    texts += [" ".join(rnd.choices(["the", "of,", "un'der", "x\ny", "Zu.", "42%", "'s"], k=50)) for _ in range(300)]
    raw = [t.encode() for t in texts]
    bounds = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
    odd = P.odd_texts(P.K.Text(np.frombuffer(b"".join(raw), dtype=np.uint8), bounds)).tolist()
    assert 100 < sum(odd) < len(texts) - 100
    for text, strange in zip(texts, odd):
        assert np.frombuffer(fast(text, strange), dtype="<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def check_plan(histogram, capacity):
    runs = P.plan(dict(histogram), capacity)
    used = {}
    for run in runs:
        assert run.count > 0
        assert sum(n * k for n, k in run.rows) <= capacity
        for n, k in run.rows:
            used[n] = used.get(n, 0) + k * run.count
    assert used == {n: c for n, c in histogram.items() if c}
    return sum(r.count for r in runs)


@pytest.mark.parametrize("seed", range(30))
def test_plans_use_every_piece_once(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([1, 2, 7, 50, 2048])
    histogram = {n: rnd.choice([1, 2, 5, 1000, 10**9]) for n in rnd.choices(range(1, capacity + 1), k=rnd.randrange(1, 60))}
    sequences = check_plan(histogram, capacity)
    least = max(-(-sum(n * c for n, c in histogram.items()) // capacity), sum(c for n, c in histogram.items() if 2 * n > capacity))
    assert least <= sequences


def best_fit_decreasing(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        at = min((r, i) for i, r in enumerate(room) if r >= n)[1] if any(r >= n for r in room) else None
        if at is None:
            room.append(capacity - n)
        else:
            room[at] -= n
    return len(room)


@pytest.mark.parametrize("seed", range(12))
def test_no_worse_than_best_fit(seed):
    rnd = random.Random(seed)
    lengths = [min(2048, int(rnd.lognormvariate(5.5, 1.2)) + 1) for _ in range(rnd.choice([50, 400, 900]))]
    histogram = {n: lengths.count(n) for n in set(lengths)}
    assert check_plan(histogram, 2048) <= best_fit_decreasing(lengths, 2048)


def test_exact_complements_beat_plain_best_fit():
    # 6+2+2 and 4+3+3 fill exactly; best fit by decreasing length would take 6+4 first
    assert check_plan({6: 1, 4: 1, 3: 2, 2: 2}, 10) == 2
    assert check_plan({1024: 5, 1000: 4, 24: 8, 2048: 3}, 2048) == 3 + 3 + 2
    assert check_plan({}, 10) == 0


def test_small_lengths_fill_everything():
    rnd = random.Random(1)
    histogram = {n: rnd.randrange(1, 400) for n in range(10, 2048)}
    total = sum(n * c for n, c in histogram.items())
    assert check_plan(histogram, 2048) <= 1.1 * total / 2048


def test_query(spark, tmp_path, plain):
    rnd = random.Random(3)
    docs = [(i, " ".join(rnd.choices(["the", "of", "éa", "x1\n"], k=rnd.choice([0, 1, 30, 300])))) for i in range(120)]
    docs += [(500, "word " * 9000), (501, None), (502, ""), (503, "a" + " a" * 2046), (504, "a" + " a" * 2047), (7, docs[7][1]), (None, "null id"), (7, docs[7][1])]
    spark.createDataFrame([(k, t, 5) for k, t in docs], "doc_id long, text string, length int").write.parquet(f"{tmp_path}/documents.parquet")
    got = P.op7(spark, str(tmp_path)).toPandas()
    want = []
    for k, t in docs:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        for i, (s, e) in enumerate(zip(cuts, cuts[1:])):
            want.append((str(k), i, s, e - s, zlib.crc32(np.array(ids[s:e], dtype="<u4").tobytes())))
    ids = ["None" if k != k else str(int(k)) for k in got.doc_id]
    assert sorted(zip(ids, got.piece, got.start, got.length, got.ids_crc32)) == sorted(want)
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *own.length.cumsum()[:-1].tolist()]
        assert own.length.sum() <= 2048
    assert got.sequence_id.nunique() <= 1 + -(-got.length.sum() // 2048)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert P.op7(spark, str(tmp_path)).count() == 0
