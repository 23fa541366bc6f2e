import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from edgeloom.llm.queries import default_tokenizer
from edgeloom.llm.tokens import Encoder, TokenFiles, read, write


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(default_tokenizer())
    found.encode_special_tokens = True
    return lambda t: found.encode(t or "", add_special_tokens=False).ids + [0]


def test_remembered_runs_encode_like_the_library(plain):
    pieces = [" ", "  ", "\n", "\t", "a", "the", "é", "12", ".", ",", "'s", "don't", "!", "\x1c", "\xa0", "日本", "<|endoftext|>", "\r\n", "Ġ", "😀", "_", "²", "'"]
    random.seed(5)
    texts = ["".join(random.choices(pieces, k=random.randint(0, 12))) for _ in range(4000)] + [None, "a b, c.\nD e.", "Word.", "x \n y"]
    encoder = Encoder(default_tokenizer())
    ids, counts = encoder.encode(pa.array(texts))
    at = 0
    for text, n in zip(texts, counts, strict=True):
        assert ids[at : at + n].tolist() == plain(text), repr(text)
        at += n
    assert at == len(ids)


def test_files_hold_what_was_encoded(spark, docs, plain):
    rows = [(i * 3, f"text number {i}, of many.\nAnd a line" * (i % 5)) for i in range(400)] + [(7, None)]
    folder = write(docs(rows), default_tokenizer())
    files = TokenFiles(folder)
    want = [plain(t) for _, t in sorted(rows)]
    assert len(files) == len(rows) and [files[i].tolist() for i in range(len(files))] == want
    with pytest.raises(IndexError):
        files[len(rows)]
    out = sorted(read(spark, folder).collect())
    start = 0
    for (doc_id, _), ids, got in zip(sorted(rows), want, out, strict=True):
        assert tuple(got) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_awkward_rows_and_the_empty_table(spark, docs, awkward, plain):
    out = read(spark, write(docs(awkward), default_tokenizer())).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens) for r in out) == sorted((i is not None, i or 0, len(plain(t))) for i, t in awkward)
    assert read(spark, write(docs([]), default_tokenizer())).collect() == []


def test_texts_that_hold_the_marks(plain):
    texts = ["a \x00b c", "a \x01b", "word \x00. c", "x \x00, y", "a \x00.\n b", "\x00", "one, two \x01three. four"]
    ids, counts = Encoder(default_tokenizer()).encode(pa.array(texts))
    ends = np.cumsum(counts)
    assert [ids[a:b].tolist() for a, b in zip([0, *ends], ends, strict=False)] == [plain(t) for t in texts]
