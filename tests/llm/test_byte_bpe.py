"""Byte-level BPE against the tokenizer library."""

import base64
import hashlib

import public_tokenizers as P
import tiktoken

from vellum.llm.byte_bpe import encode_and_decode, splitter

PATH = P.path("byte_bpe_50k.tiktoken")


def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [
    "It's a test, they'll say: 1234 ½ x²  and\n\n  more\t\tspace ", "", None, " ", "  \n ", "Ünïcödé ÿ µ ª º × ÷ \xa0nbsp \x85nel", "日本語 テキスト 一二三 ٣٤",
    "emoji 🙂🙂 and œuvre", "a" * 3000, "the " * 5000, "<|endoftext|>", "\x1c\x1d\x1e\x1f control \x00", "it'S 'll've 're'd 'm", " line　wide",
]


def test_same_ids_as_the_library(spark):
    enc = library()
    df = spark.createDataFrame([(k, t, k, "x", b"y") for k, t in enumerate(TEXTS)] + [(None, "null id", 0, "x", b"y"), (0, TEXTS[0], 0, "x", b"y")], "doc_id long, text string, id long, key string, payload binary")
    got = encode_and_decode(df.repartition(3), PATH, P.PATTERN, with_ids=True).collect()
    assert len(got) == len(TEXTS) + 2
    texts = {**dict(enumerate(TEXTS)), None: "null id"}
    for row in got:
        text = texts[row["id"]] or ""
        ids = enc.encode_ordinary(text)
        joined = " ".join(map(str, ids)).encode()
        assert (row["n_tokens"], row["ids"]) == (len(ids), joined), text
        assert row["decoded"] == text.encode()
        assert row["ids_sha256"] == hashlib.sha256(joined).hexdigest() and row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_fast_pattern_means_the_same():
    import regex

    general, split = regex.compile(P.PATTERN), splitter(P.PATTERN)
    every = "".join(map(chr, range(256)))
    for text in [*filter(None, TEXTS), every, " ".join(every), every[::-1] * 2]:
        assert list(split(text)) == general.findall(text)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert encode_and_decode(df, PATH, P.PATTERN).collect() == []
