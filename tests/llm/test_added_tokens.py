"""op3_token_file against the library's own encoding where a text contains an added token's string."""

import zlib

import numpy as np
import public_tokenizers as public
import pytest
from tokenizers import Tokenizer

from joinlift.llm import queries, token_file


def test_query_encodes_added_tokens_as_the_library_does(spark, tmp_path):
    texts = ["a<|endoftext|>b", "<|endoftext|><|endoftext|> !!!", "plain words, no token", "x <|endoftext |> y", None, "",
             "one  two <|endoftext|>\n three"]
    rows = [(i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    plain = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    assert 50256 in plain.encode(texts[0], add_special_tokens=False).ids
    want, at = [], 0
    for i, t in rows:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = queries.op3_token_file(spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == want


@pytest.mark.parametrize("bits", [0, 1, 7, 8, 13, 16, 17, 31, 32])
def test_values_are_packed_bit_after_bit(bits):
    rng = np.random.default_rng(bits)
    for size in (1, 7, 8, 9, 4096):
        values = rng.integers(0, 1 << bits, size, dtype=np.uint64).astype(np.uint32)
        plain = np.unpackbits(values.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
        assert token_file._pack(values, bits) == np.packbits(plain.ravel(), bitorder="little").tobytes()
        assert (token_file.unpack_block(token_file.pack_block(values)) == values).all()
