import hashlib

import numpy as np
import pytest

from lamina.llm import packing, pieces, tokens
from lamina.llm.common import tokenizer_path


def test_counts_equal_the_library(docs, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    found = tokens.count_tokens(docs).collect()
    expected = [(len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for t in texts]
    assert sorted((r["n_bytes"], r["n_tokens"]) for r in found) == sorted(expected)


def test_counts_of_no_rows(docs):
    assert tokens.count_tokens(docs.where("false")).count() == 0


def test_pieces_equal_the_library(docs, texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    found = {r["doc_id"]: r for r in pieces.piece_digests(docs).collect()}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        r = found[i if i != 4 else None]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids).encode())), t


def test_word_ids_equal_the_library(texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    own = packing.word_ids(tokenizer_path("word_bpe_49k.json"))
    for t in texts:
        assert np.frombuffer(own.ids(t or ""), own.wide).tolist() == library.encode(t or "", add_special_tokens=False).ids, t


@pytest.mark.parametrize("seed", range(5))
def test_windows_are_full_and_hold_each_token_once(seed):
    lengths = np.random.default_rng(seed).integers(0, 4097, 200).tolist()
    seen = [np.zeros(n, int) for n in lengths]
    for w in packing.packed_windows(lengths):
        size = sum(n for *_, n in w)
        assert size & (size - 1) == 0 and size <= 4096
        for i, at, n in w:
            seen[i][at : at + n] += 1
    assert all((s == 1).all() for s in seen)


def test_pack(spark, docs, texts):
    from tokenizers import Tokenizer

    long = "the cat sat on a mat " * 3000
    docs = docs.unionByName(spark.createDataFrame([(99, long, "s", "k"), (99, long, "s", "k")], docs.schema))
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    rows = packing.pack(docs, bucket_bytes=20_000).collect()
    ids = {i if i != 4 else None: library.encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(texts)} | {99: library.encode(long, add_special_tokens=False).ids + [2]}
    sequences = {}
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert packing.crc(np.array(part)) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 4096 and at & (at - 1) == 0
    assert sum(r["length"] for r in rows) == sum(map(len, ids.values())) + len(ids[99])
    assert packing.pack(docs.where("false")).count() == 0


def test_step_groups_are_balanced():
    rng = np.random.default_rng(6)
    for total in (1, 20, 90, 400):
        sizes = [4096] * total + [2**b for b in range(11)]
        rng.shuffle(sizes)
        group = packing.balanced(sizes, 65536)
        filled = np.bincount(group, sizes)
        assert filled.max() - filled.min() <= 4096 and len(filled) == max(1, round(sum(sizes) / 65536))
        assert total < 90 or abs(filled / 65536 - 1).max() < 0.25
