import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from itemforge.llm.bpe import Codec, PerfectHash, bpe_roundtrip, load_ranks, merge_bytes
from itemforge.llm.token_file import bits_for, chunk_encoder, pack, read_document, read_tokens, token_digest, unpack, write_tokens

ODD = ["", " ", "  ", "a  b", "a   b", "x \n y", "w\n\n  z", "tab\tx", "it's I'll we'D", "ÀÉ ß ŒŸ ﬁ é ́x", "Σίσυφος ΣΑΣ", "nbsp\xa0x y", "\x1cz\x1d q", "<|endoftext|> <|ENDOFTEXT|>", "a.b, c., d!. 12345 x9", "ΑΣ. İstanbul", "日本語 テキスト", "end\n ", "\n \n b", "q" * 300, "ab" * 2000, "\0 a \0b", "don't.\nThing, " * 5, "\r\n x\r", "😀😀 a😀."]
DOCS = "doc_id long, text string, lang string, n_tokens int, ids string, shard string"


def docs_of(spark, texts, start=10):
    return spark.createDataFrame([(start - i, t, None, 1, "x", "y") for i, t in enumerate(texts)], DOCS)


def tiktoken_encoding(name="byte_bpe_50k.tiktoken"):
    import tiktoken

    ranks = {t: i for i, t in enumerate(load_ranks(public_tokenizers.path(name))) if t}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("bits", [1, 7, 8, 16, 17, 31])
def test_packing_is_a_round_trip(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 63, 64, 65, 1000):
        ids = rng.integers(0, 1 << bits, n).astype(np.uint32)
        data = pack(ids, bits)
        assert len(data) == -(-n * bits // 64) * 8
        assert (unpack(data, bits, 0, n) == ids).all()
        assert (unpack(data, bits, n // 3, n // 2) == ids[n // 3 : n // 2]).all()
    assert bits_for(49408) == 16 and bits_for(65537) == 17


def test_chunks_encode_as_the_whole_text(spark, sf_dir):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok, encode = Tokenizer.from_file(path), chunk_encoder(open(path).read())
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    for t, got in zip(texts, encode(texts)):
        assert np.frombuffer(got, np.uint32).tolist() == tok.encode(t, add_special_tokens=False).ids, t[:80]


def test_token_file_reads_back(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path := public_tokenizers.path("word_bpe_49k.json"))
    texts = [*ODD, None, "same", "same"]
    got = token_digest(docs_of(spark, texts), path).orderBy("doc_id").collect()
    want, start = [], 0
    for i, t in sorted((10 - i, t) for i, t in enumerate(texts)):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [tuple(r)[:4] for r in got] == want


def test_token_file_of_nothing_and_random_access(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert token_digest(docs_of(spark, []), path).count() == 0
    write_tokens(docs_of(spark, ["a b", None, "hello world"]), f"file://{tmp_path}/t", path)
    assert read_document(spark, f"file://{tmp_path}/t", 9) == [[1]]
    assert len(read_document(spark, f"file://{tmp_path}/t", 8)[0]) == 3
    assert read_tokens(spark, f"file://{tmp_path}/t").count() == 3


def test_perfect_hash_is_minimal_and_perfect():
    keys = [str(i).encode() for i in range(5000)]
    table = PerfectHash(keys)
    assert table.find(keys).tolist() == list(range(5000))
    assert sorted(table.key_at.tolist()) == list(range(5000))


def test_heap_merge_equals_repeated_scan():
    tokens = [bytes([i]) for i in range(97, 101)] + [b"ab", b"aba", b"bb", b"abab", b"cd", b"dcd"]
    ranks = {t: i for i, t in enumerate(tokens)}
    rng = np.random.default_rng(0)
    for _ in range(300):
        word = bytes(rng.integers(97, 101, rng.integers(1, 30)).tolist())
        parts = [word[i : i + 1] for i in range(len(word))]
        while True:
            best = min(((ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
            if best is None:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        assert merge_bytes(word, ranks) == [ranks[p] for p in parts]


def test_bpe_equals_the_library(spark, sf_dir):
    encoding = tiktoken_encoding()
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    tokens = load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    codec = Codec(tokens, public_tokenizers.PATTERN, PerfectHash(tokens), list(range(len(tokens))))
    for t, got in zip(texts, codec.encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == encoding.encode_ordinary(t), t[:80]
        assert codec.decode(got) == t.encode()


def test_bpe_rows(spark):
    rows = bpe_roundtrip(docs_of(spark, ["hello", None, "", "hello"]), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True).orderBy("doc_id").collect()
    assert [r.n_tokens for r in rows] == [1, 0, 0, 1]
    assert rows[1].ids_sha256 == hashlib.sha256(b"").hexdigest() and bytes(rows[0].decoded) == b"hello"
    assert bpe_roundtrip(docs_of(spark, []), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0


def test_memo_keeps_what_is_used(monkeypatch):
    """A long tail of words seen once fills the memo many times: a frequent word is still merged once, and
    not again after each filling."""
    import itemforge.llm.bpe as B
    import itemforge.llm.common as C

    merged, merge = [], B.merge_bytes
    monkeypatch.setattr(C, "MEMO_BYTES", 1 << 17)
    monkeypatch.setattr(B, "merge_bytes", lambda word, ranks: merged.append(word) or merge(word, ranks))
    tokens, encoding = load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), tiktoken_encoding()
    codec = Codec(tokens, public_tokenizers.PATTERN, PerfectHash(tokens), list(range(len(tokens))))
    for k in range(40):
        text = "qzvxqzvx " + " ".join(f"zq{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + i % 26)}{chr(97 + i // 26)}vx" for i in range(200)) + " qzvxqzvx."
        assert np.frombuffer(codec.encode([text])[0], "<u4").tolist() == encoding.encode_ordinary(text)
    assert merged.count(b" qzvxqzvx") == 1 and merged.count(b"qzvxqzvx") == 1
    assert sum(C.ENTRY_BYTES + len(w) + len(i) for g in (codec.memo.young, codec.memo.old) for w, i in g.items()) < 2 * C.MEMO_BYTES


def test_chunks_in_use_are_learned_once(monkeypatch):
    """However often a long tail fills the memo."""
    import itemforge.llm.common as C
    from tokenizers import Tokenizer

    learned, unknown = [], C.Memo.unknown
    monkeypatch.setattr(C, "MEMO_BYTES", 1 << 17)
    monkeypatch.setattr(C.Memo, "unknown", lambda memo, keys: learned.extend(new := unknown(memo, keys)) or new)
    path = public_tokenizers.path("word_bpe_49k.json")
    C.worker_store("")
    tok, encode = Tokenizer.from_file(path), chunk_encoder(open(path).read())
    for k in range(40):
        text = "qzvxqzvx " + " ".join(f"zq{k}x{i}" for i in range(200)) + " other,"
        assert np.frombuffer(encode([text])[0], np.uint32).tolist() == tok.encode(text, add_special_tokens=False).ids
    assert learned.count("qzvxqzvx") == learned.count("zq1x1") and learned.count("other,") == 1  # as often as a chunk that is there once
    C.worker_store("")


def test_marks_behind_letters_are_not_encoded_with_them(monkeypatch):
    """However many marks are seen behind a word, its letters go to the library once."""
    import itemforge.llm.common as C

    learned, unknown = [], C.Memo.unknown
    monkeypatch.setattr(C.Memo, "unknown", lambda memo, keys: learned.extend(new := unknown(memo, keys)) or new)
    path = public_tokenizers.path("word_bpe_49k.json")
    C.worker_store("")
    encode = chunk_encoder(open(path).read())
    encode(["qzvxqzvx*** qzvxqzvx.### Qzvxqzvx, (qzvxqzvx)", "qzvxqzvx### qzvxqzvx"])
    assert learned.count("qzvxqzvx") == 1 and learned.count("***") == 1 and learned.count("###") == 1
    C.worker_store("")


def test_chunks_of_any_sign_encode_as_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok, encode = Tokenizer.from_file(path), chunk_encoder(open(path).read())
    signs = [*map(chr, range(256)), *"Ως…’€İǅſ́​ 　­ͅ漢😀"]
    texts = [f"ab{c}de {c}Xy XY{c} zz{c}*** {c}.{c} qu{c},### {c}" for c in signs] + [f"Ω ab{c}De {c}Xy XY{c} zz{c}*** {c}s Don't{c}" for c in signs]
    texts += ["".join(signs), " ".join(signs), "", " ", "l'amour. l'*** it's'' 'tis x'", "a1*** 1*** ***a a***b ***"]
    for together in (texts, texts[::-1]):
        for t, got in zip(together, encode(together)):
            assert np.frombuffer(got, np.uint32).tolist() == tok.encode(t, add_special_tokens=False).ids, t[:80]
    assert encode([]) == [] and encode([""]) == [b""]


@pytest.mark.parametrize("bits", [7, 8, 16, 17, 32])
def test_packed_bits_are_where_the_format_says(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 131).astype(np.uint32)
    whole = sum(int(x) << (k * bits) for k, x in enumerate(ids))
    assert pack(ids, bits) == whole.to_bytes(-(-131 * bits // 64) * 8, "little")
