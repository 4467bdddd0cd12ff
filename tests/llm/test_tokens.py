import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from portolan.llm import tokens
from portolan.llm.common import fresh_path

PATH = public_tokenizers.path("byte_bpe_50k.json")


def sample():
    rng = random.Random(6)
    texts = [None, "", " ", "a", " a", "a ", "a  b", "a \n b", "x\ty", "it's we'll 's 'll", "x <|endoftext|> y", "é Ünï 漢字   z", "a b c", "\x1c \x1d q",
             "don't stop", "a\n\nb c\n", "1 22 333, 4.5", "word " * 5000 + "end"]
    alphabet = "ab'sé.,! \n1漢　\x85\t"
    texts += ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(300)]
    return texts


def other_rules(folder):
    """The tokenizer with other rules for parting words, and one that comes with others."""
    from tokenizers import normalizers, pre_tokenizers

    made = [(None, pre_tokenizers.ByteLevel(add_prefix_space=True)), (None, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)),
            (normalizers.Lowercase(), pre_tokenizers.ByteLevel(add_prefix_space=False))]
    for i, (normalizer, rule) in enumerate(made):
        t = Tokenizer.from_file(PATH)
        t.pre_tokenizer = rule
        if normalizer is not None:
            t.normalizer = normalizer
        t.save(f"{folder}/{i}.json")
        yield f"{folder}/{i}.json"
    yield public_tokenizers.path("word_bpe_49k.json")


def test_tokenizers_with_other_rules(tmp_path):
    for path in other_rules(tmp_path):
        t, code = Tokenizer.from_file(path), tokens.Encoder(path)
        assert not code.parted
        for text, got in zip(sample(), code.encode(sample()), strict=True):
            assert np.frombuffer(got, dtype=code.kind).tolist() == t.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_encoder_equals_whole_texts():
    t = Tokenizer.from_file(PATH)
    code = tokens.Encoder(PATH)
    assert code.parted
    for texts in (sample(), sample()[::-1]):
        for text, got in zip(texts, code.encode(texts), strict=True):
            assert np.frombuffer(got, dtype=code.kind).tolist() == t.encode(text or "", add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 5000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(-(2**62), 2**62, n))
    index = tokens.PerfectHash.of(keys)
    assert sorted(index.slot(keys).tolist()) == list(range(len(keys))) if n else True


@pytest.mark.parametrize("shard_ids", [1, 200, 1 << 22])
def test_round_trip(spark, shard_ids):
    t = Tokenizer.from_file(PATH)
    texts = sample()[:120]
    rows = [(i * 7 - 50, x) for i, x in enumerate(texts)] + [(20, "twice"), (20, "twice"), (20, None), (None, "no key"), (None, "no key 2")]
    path = fresh_path(spark, "tokens")
    docs = spark.createDataFrame([(d, x, 1) for d, x in rows], "doc_id long, text string, part int").repartition(5)
    tokens.write(docs, PATH, path, shard_ids=shard_ids, part_docs=20)
    got = sorted(map(tuple, tokens.documents(spark, path).collect()), key=lambda r: r[1])
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    want, at = [], 0
    for d, x in ordered:
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        want.append((d, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    assert got == want
    found = {k: sorted(r.ids for r in tokens.lookup(spark, path, k).collect()) for k in (20, 6, 10**9, 21)}
    enc = lambda x: t.encode(x, add_special_tokens=False).ids + [2]
    assert found == {20: sorted([enc("twice"), enc("twice"), enc(""), enc(texts[10])]), 6: [enc(texts[8])], 10**9: [], 21: []}


def test_empty(spark):
    path = fresh_path(spark, "tokens")
    tokens.write(spark.createDataFrame([], "doc_id long, text string"), PATH, path)
    assert tokens.documents(spark, path).count() == 0
