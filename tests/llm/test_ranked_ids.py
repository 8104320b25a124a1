import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from ampertide.llm import ranked_ids as R
from ampertide.llm.bpe import default_path
from ampertide.session import scratch_path


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(default_path())


def brute(rows, tok):
    """Documents in ascending order: (doc_id, start, n, crc); ties by length, then checksum."""
    made = []
    for i, t in rows:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        made.append((i, len(ids), zlib.crc32(ids.tobytes())))
    out, start = [], 0
    for i, n, c in sorted(made, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        out.append((i, start, n, c))
        start += n
    return out


def some_rows(n):
    rng = random.Random(n)
    words = ["the", "a", "of", "Straße", "naïve", "x", "\n", "<|endoftext|>", "漢字", "🤦🏼", "0x7f", "zymurgy"]
    rows = [(rng.randrange(-50, 10**9), " ".join(rng.choices(words, k=rng.randrange(80)))) for _ in range(n)]
    return rows + [(None, "null id"), (None, None), (3, None), (4, ""), (5, "twin"), (5, "twin"), (5, "other twin"), (6, "long tail " * 60_000)]


@pytest.mark.parametrize("file_tokens", [50, 3000, R.FILE_TOKENS])
def test_files_give_back_every_document(spark, docs_of, tok, file_tokens):
    rows = some_rows(150)
    got = R.id_file_round_trip(docs_of(rows).repartition(5), file_tokens=file_tokens).collect()
    key = lambda r: r[1]
    assert sorted([(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got], key=key) == brute(rows, tok)


def test_ids_and_file_sizes(spark, docs_of, tok):
    rows = some_rows(60)
    folder = scratch_path(spark, "test-ids")
    R.write_ids(docs_of(rows).repartition(3), folder, file_tokens=400)
    got = R.read_ids(spark, folder).collect()
    want = sorted((i if i is not None else -1, tuple([*tok.encode(t or "", add_special_tokens=False).ids, 2])) for i, t in rows)
    assert sorted((r.id if r.id is not None else -1, tuple(np.frombuffer(bytes(r.ids), "<u4").tolist())) for r in got) == want
    for r in got:
        assert r.before <= 400  # a file ends with the document that passes the limit
    assert len({(r.part, r.chunk) for r in got}) > 5


def test_common_ids_take_one_byte():
    ranks = np.arange(300, dtype=np.uint32)
    control, data = R.code_ranks(ranks)
    assert len(control) == 75 and len(data) == 256 + 2 * 44


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 8, 1023, R.SLICE - 1, R.SLICE, 2 * R.SLICE + 7])
def test_codec_round_trip(n):
    rng = np.random.default_rng(n)
    ranks = (rng.integers(0, 1 << 32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
    control, data = R.code_ranks(ranks)
    assert len(control) == -(-n // 4)
    back = R.decode_ranks(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n)
    assert (back == ranks).all()


def test_a_damaged_file_is_named():
    data = R.record("7", np.arange(9, dtype=np.uint32)) + b"\n"
    assert [(i, r.tolist()) for i, r in R.records_in(data)] == [("7", list(range(9)))]
    with pytest.raises(ValueError):
        list(R.records_in(data[:-1] + b"x"))


def test_ranks_fall_by_frequency(spark, docs_of, tok):
    encoded = R.encode_ids(docs_of([(1, "a a a a b"), (2, "b a")]).repartition(2), "doc_id", "text", default_path())
    ranked, total = R.rank_table(encoded)
    ids = [tok.token_to_id(t) for t in ("Ġa", "a", "b", "Ġb")]
    assert total == 9 and ranked[0] == ids[0] and set(ranked.tolist()) == {2, *ids}


def test_empty_table(docs_of):
    assert R.id_file_round_trip(docs_of([])).count() == 0
