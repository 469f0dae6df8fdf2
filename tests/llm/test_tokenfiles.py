"""Token files: exact round trip, order, odd rows."""

import random
import uuid
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pressgauge.llm import tokenfiles
from pressgauge.session import staged_dir

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "", "a", "Hello, world! it's 42²", "  two  spaces\n\n\tand tabs \x0b", "naïve façade Ærø ﬁ ж 日本 🙂", "x<|endoftext|>y",
    "\x1c\x1d odd", " \xa0\x85 ", "!" * 3000, "word " * 5000, "ends with space ",
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_those_of_the_library(name):
    library, mine = Tokenizer.from_file(public_tokenizers.path(name)), tokenfiles.Encoder(public_tokenizers.path(name))
    rng = random.Random(5)
    alphabet = "ab é'stllred  \n\t.,!?0129ªº²½\xa0\x85\x1c​жñ<|endoftext|>"
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        want = [x.ids for x in library.encode_batch(part, add_special_tokens=False)]
        assert [np.frombuffer(x, mine.width).tolist() for x in mine.encode(part)] == want


def test_round_trip(spark):
    library = Tokenizer.from_file(PATH)
    rows = [(i * 7 % 11, t, "s") for i, t in enumerate(TEXTS)] + [(100, None, "s"), (None, "no id", "s"), (100, None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(5)
    found = tokenfiles.token_table(docs, PATH, 2, [F.col("doc_id"), F.xxhash64("text")]).collect()
    want, at = [], 0
    for doc, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, found), key=lambda r: r[1]) == want


def test_files(spark):
    folder = f"{staged_dir(spark)}/files-{uuid.uuid4().hex}"
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    parts = tokenfiles.write_tokens(docs, folder, PATH, 2, [F.col("doc_id")])
    bases = tokenfiles.part_bases(spark, folder)
    assert parts == len(bases)
    width = tokenfiles.encoder(PATH).width
    seen, total = [], 0
    for part, base, n_docs, n_tokens in bases:
        tokens, offsets, ids = tokenfiles.map_part(folder, part, width)
        assert base == total and len(tokens) == n_tokens == offsets[-1] and len(ids) == n_docs == len(offsets) - 1
        assert all(tokens[int(e) - 1] == 2 for e in offsets[1:])
        seen += ids.tolist()
        total += n_tokens
    assert seen == list(range(50))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert tokenfiles.token_table(docs, PATH, 2, [F.col("doc_id")]).count() == 0
