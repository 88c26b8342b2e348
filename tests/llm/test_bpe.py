import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

from pointloom.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " ", "Hello world's  they'll don't 'S", "a<|endoftext|>b<|startoftext|>", "<|endoftext|", "x\x1cy\x85z w v", "ΑΣ ΣΑΣ σς", "İstanbul K Å",
    "é é 日本語テキスト 12345 ½ ²", "a" * 5000, "ab" * 3000 + "!" * 700, "\U0001f600\U0001f468‍\U0001f469", "naïve façade ÀÉÎ—“quoted” €5", "\x00\x01", "ſt ﬁ Ⅷ ٣", "🇩🇪" * 30,
]


def truth(texts):
    t = Tokenizer.from_file(PATH)
    t.no_padding(), t.no_truncation()
    ids = [t.encode(x, add_special_tokens=False).ids for x in texts]
    return [(len(i), " ".join(map(str, i)), t.decode(i, skip_special_tokens=False)) for i in ids]


def test_matches_library_on_odd_and_random_texts():
    rng = random.Random(5)
    some = ["".join(rng.choice("abcdeéß'st re.,!0 9\n") for _ in range(rng.randrange(400))) for _ in range(300)]
    wild = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x2FF), rng.randrange(0x300, 0xD000)])) for _ in range(60)) for _ in range(200)]
    texts = ODD + some + wild
    assert bpe.Encoder(PATH).encode_all(texts) == truth(texts)


def test_query_matches_library(spark):
    docs = spark.createDataFrame([(i, x, "en") for i, x in enumerate(ODD)] + [(99, None, None), (99, "again", "en")], "doc_id long, text string, n_tokens string")
    got = sorted(tuple(r) for r in bpe.encode(docs, PATH, digest=True).collect())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = [(i, n, sha(a), sha(b)) for i, (n, a, b) in zip([*range(len(ODD)), 99, 99], truth([*ODD, "", "again"]), strict=True)]
    assert got == sorted(want)
    back = bpe.decode(bpe.encode(docs, PATH), PATH)
    assert sorted(r.decoded for r in back.collect()) == sorted(x[2] for x in truth([*ODD, "", "again"]))


def test_empty_table(spark):
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
