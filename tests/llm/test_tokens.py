import random
import time
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from candrank.llm.packing import hilbert_keys, pack
from candrank.llm.token_counts import token_counts
from candrank.llm.token_files import pack_ranks, read_token_files, unpack_ranks, write_token_files
from candrank.llm.tokens import Encoder, default_path, encoder
from tests.llm.conftest import rows

T = Tokenizer.from_file(default_path())


def ids(text):
    return T.encode(text or "", add_special_tokens=False).ids


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


def test_encoder_equals_the_library():
    own = encoder(default_path())
    for _, text, *_ in rows(200, 7):
        assert np.frombuffer(own.ids(text or ""), own.dtype).tolist() == ids(text)
        assert sum(len(own.piece_ids(p)) for p in own.pieces(text or "")) == len(ids(text))


def test_encoder_equals_the_library_on_mixed_strings_and_small_caches():
    r = random.Random(4)
    own = Encoder(default_path())
    own.cache.entries = 50
    parts = ["a", "é", "B", "1", "23", ".", ",", "'s", "'", "'ll", " ", " ", "\n", "\t", "_", "ß", "\xa0", "<|endoftext|>", "日", "½", "\x1c", "-", "(", "hello", "  ", "×", "ǅ", "·", "x" * 70]
    for _ in range(8000):
        text = "".join(r.choices(parts, k=r.randint(0, 12)))
        assert np.frombuffer(own.ids(text), own.dtype).tolist() == ids(text), text
        assert sum(len(own.piece_ids(p)) for p in own.pieces(text)) == len(ids(text)), text
    assert len(own.cache) <= 50 and len(own.cache.older) <= 50


def test_counts(small, none, clashing):
    want = sorted(((d, len((t or "").encode()), len(ids(t)), len(ids(t)) > 1024) for d, t, *_ in rows()), key=str)
    for head in (1 << 18, 5, 0):
        assert sorted(map(tuple, token_counts(small, head_pieces=head).collect()), key=str) == want
    assert sorted(map(tuple, token_counts(clashing).collect()), key=str) == want
    assert token_counts(none).count() == 0


def test_files_round_trip(spark, small, none, tmp_path):
    write_token_files(small, str(tmp_path / "f"), block_tokens=500)
    got = sorted(map(tuple, read_token_files(spark, str(tmp_path / "f")).collect()), key=lambda r: r[1])
    at = 0
    order = [d for d, *_ in got]
    assert order == sorted(order, key=lambda d: (d is not None, d))
    for _, start, n, _ in got:
        assert start == at
        at += n
    assert sorted(((d, n, c) for d, _, n, c in got), key=str) == sorted(((d, len(ids(t)) + 1, crc([*ids(t), 0])) for d, t, *_ in rows()), key=str)
    write_token_files(none, str(tmp_path / "n"))
    assert read_token_files(spark, str(tmp_path / "n")).count() == 0


def test_files_of_clashing_columns_and_very_many_tiny_documents(spark, clashing, tmp_path):
    write_token_files(clashing, str(tmp_path / "c"))
    got = read_token_files(spark, str(tmp_path / "c")).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=str) == sorted(((d, len(ids(t)) + 1, crc([*ids(t), 0])) for d, t, *_ in rows()), key=str)
    began = time.monotonic()
    write_token_files(spark.range(300_000).coalesce(1).selectExpr("id AS doc_id", "'' AS text"), str(tmp_path / "t"))
    got = read_token_files(spark, str(tmp_path / "t"))
    assert got.where(f"start = doc_id AND n_tokens = 1 AND ids_crc32 = {crc([0])}").count() == got.count() == 300_000
    assert time.monotonic() - began < 60  # a block's cost does not grow with the square of its documents


def test_code_round_trip():
    r = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 1001):
        x = (r.integers(0, 1 << 32, n) >> r.integers(0, 32, n)).astype("<u4")
        assert (unpack_ranks(*pack_ranks(x), n) == x).all()


def test_hilbert_is_a_curve():
    n = 1 << 3
    cells = np.array([(a, b, c) for a in range(n) for b in range(n) for c in range(n)])
    keys = hilbert_keys(cells, 3)
    assert sorted(keys) == list(range(n**3))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_packing(small, none, clashing):
    for docs in (small, clashing):
        got = [r.asDict() for r in pack(docs, length=256).collect()]
        by_doc, by_seq = defaultdict(list), defaultdict(list)
        for p in got:
            by_doc[p["doc_id"]].append(p)
            by_seq[p["sequence_id"]].append(p)
        for pieces in by_seq.values():
            at = 0
            for p in sorted(pieces, key=lambda p: p["offset"]):
                assert p["offset"] == at
                at += p["length"]
            assert at <= 256
        want = sorted(((d, len(ids(t)) + 1) for d, t, *_ in rows()), key=str)
        assert sorted(((p["doc_id"], p["doc_tokens"]) for p in got if p["start"] == 0), key=str) == want
        for d, t, *_ in rows():
            if len(by_doc[d]) and d not in (3, None):
                x = [*ids(t), 1]
                parts = sorted(by_doc[d], key=lambda p: p["start"])
                assert [p["ids_crc32"] for p in parts] == [crc(x[p["start"] : p["start"] + p["length"]]) for p in parts]
                assert sum(p["length"] for p in parts) == len(x)
        assert sum(p["length"] for p in got) == sum(n for _, n in want)
        assert sum(1 for s in by_seq.values() if sum(p["length"] for p in s) < 256) <= 8
    assert pack(none).count() == 0
