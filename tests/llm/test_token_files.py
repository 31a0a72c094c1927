import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from veritrace.llm.common import shared_path
from veritrace.llm.token_files import WordEncoder, read_document, read_token_files, write_token_files

from . import tables

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids_of(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [2]


def test_words_encoded_together_give_the_ids_of_the_whole_text():
    texts = [
        "Plain words, it's 1,234.5 don't they'LL",
        "á ́b été ẞ İstanbul ΣΣ ﬁ",
        "<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|> Z",
        "　   \x1c\x1d x　y  z",
        "\U0001f600\U0001f1e9\U0001f1ea क्ष 안녕 你好 \x00\x7f",
        "One. two, été! ñ?! ¿qué? «a». b². ...x.. y… z….",
        "",
        " \n\t ",
    ]
    encoder = WordEncoder(PATH, 2)
    for group in (texts, texts[::-1]):
        got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode_each(pa.array(group))]
        assert got == [ids_of(t) for t in group]


@pytest.mark.parametrize("per_file", [4, 10_000])
def test_round_trip(spark, per_file):
    rng = random.Random(per_file)
    docs = spark.createDataFrame([tables.row(1000 - i, tables.text(rng, rng.randint(0, 200))) for i in range(60)], tables.DOCS).union(tables.awkward(spark))
    out = shared_path(spark, "test")
    manifest = write_token_files(docs, out, PATH, docs_per_file=per_file)
    got = read_token_files(manifest, out).collect()
    rows = [(r.doc_id, ids_of(r.text)) for r in docs.collect()]
    want = sorted((i is not None, i or 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, ids in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == want
    in_order = sorted(got, key=lambda r: r.start)
    assert [(r.doc_id is not None, r.doc_id or 0) for r in in_order] == [w[:2] for w in want]
    assert [r.start for r in in_order] == np.cumsum([0] + [r.n_tokens for r in in_order])[:-1].tolist()
    found = [ids.tolist() for m in manifest.collect() for ids in read_document(m.path, out, 8)]
    assert found == [ids for i, ids in rows if i == 8]


def test_empty_table_and_wrong_dictionary(spark):
    out = shared_path(spark, "test")
    assert read_token_files(write_token_files(tables.empty(spark), out, PATH), out).collect() == []
    manifest = write_token_files(tables.awkward(spark), out, PATH)
    with open(out.removeprefix("file:") + "/dictionary", "ab") as f:
        f.write(b"x")
    with pytest.raises(Exception, match="another dictionary"):
        read_token_files(manifest, out).collect()
