import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ampertide.llm import bpe, chunk_bpe, packing, token_counts

os.environ["TOKENIZERS_PARALLELISM"] = "false"
SHARED = "the quick brown fox jumps over the lazy dog and runs away from it all. " * 40


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    return lambda text: t.encode(text, add_special_tokens=False).ids, lambda ids: t.decode(ids, skip_special_tokens=False)


def texts():
    rng = random.Random(4)
    words = ["don't", "été", "naïve", "<|endoftext|>", "  ", "\n\n", "123", "x'r", "e", "日本語", "\U0001f600", "...", "word", "Über", "\u00a0"]
    out = [None, "", " ", "a", "'re", "x'", "<|endoftext|>", SHARED, SHARED, "日本語" * 3000, "日本語" * 3000 + "!", "a" * 20_000]
    for i in range(60):
        body = "".join(rng.choice(words) + rng.choice([" ", "", " "]) for _ in range(rng.randrange(400)))
        out.append(body + (SHARED[rng.randrange(200) :] if i % 2 else "") + body[: rng.randrange(50)])
    return out


def test_encoder_equals_the_library(library):
    enc = bpe.encoder(bpe.default_path())
    for t in texts():
        ids = enc.encode(t or "")
        assert ids.tolist() == library[0](t or "")
        assert enc.decode(ids) == library[1](ids.tolist()) == (t or "")


def test_joins_are_exact_for_any_cuts(library):
    enc = bpe.encoder(bpe.default_path())
    sizes = chunk_bpe.token_sizes(enc)
    rng = random.Random(5)
    for t in texts():
        data = (t or "").encode()
        starts = [i for i in range(1, len(data)) if data[i] & 0xC0 != 0x80]
        for _ in range(3):
            ends = sorted(set(rng.sample(starts, min(len(starts), rng.randrange(12)))) | ({len(data)} if data else set()))
            parts = [(a, b, enc.encode(data[a:b].decode())) for a, b in zip([0, *ends[:-1]], ends)]
            assert chunk_bpe.join_stretches(data, parts, enc, sizes).tolist() == library[0](t or "")


def test_chunks_follow_the_content():
    data = SHARED.encode() + bytes(random.Random(6).choices(range(97, 123), k=6000))
    moved = b"a prefix of another length; " + data
    own = {data[a:b] for a, b in chunk_bpe.spans_of(data)}
    shared = own & {moved[a:b] for a, b in chunk_bpe.spans_of(moved)}
    assert len(shared) >= len(own) - 2
    for d in (data, moved, "日本語".encode() * 5000):
        spans = chunk_bpe.spans_of(d)
        assert b"".join(d[a:b] for a, b in spans) == d
        assert all(b - a <= chunk_bpe.MAX_BYTES for a, b in spans)
        [d[a:b].decode() for a, b in spans]


@pytest.mark.parametrize("bits", [64, 1 << 20])
def test_documents_equal_the_library(docs_of, library, bits):
    rows = list(enumerate(texts())) + [(None, SHARED), (7, SHARED), (7, SHARED)]
    got = chunk_bpe.encode_documents(docs_of(rows).repartition(3), filter_bits=bits).collect()
    want = []
    for i, t in rows:
        ids = np.array(library[0](t or ""), "<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted([(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got], key=key) == sorted(want, key=key)


def test_histogram_answers_every_limit(docs_of, library):
    rows = list(enumerate(texts()))
    lengths = [len(library[0](t or "")) for _, t in rows]
    sums = token_counts.suffix_sums(token_counts.length_histogram(docs_of(rows))).cache()
    got = {r.length: r for r in sums.collect()}
    assert {k: r.docs for k, r in got.items()} == Counter(lengths)
    for k, r in got.items():
        assert r.docs_fitting == sum(n <= k for n in lengths) and r.docs_longer == sum(n > k for n in lengths)
        assert r.tokens_longer == sum(n for n in lengths if n > k)
        assert r.truncated_total == sum(min(n, k) for n in lengths)
    limits = [0, 1, 7, 100, 2048, 10**6]
    at = {r.context_limit: r for r in token_counts.totals_at(sums, limits).collect()}
    for k in limits:
        assert (at[k].docs_fitting, at[k].truncated_total) == (sum(n <= k for n in lengths), sum(min(n, k) for n in lengths))
    q = {r.share: r.length for r in token_counts.length_quantiles(sums, [0.5, 0.9, 1.0]).collect()}
    for p, n in q.items():
        assert n == min(x for x in lengths if sum(y <= x for y in lengths) >= p * len(lengths))


def test_empty_tables(docs_of):
    assert token_counts.suffix_sums(token_counts.length_histogram(docs_of([]))).count() == 0
    assert chunk_bpe.encode_documents(docs_of([]), filter_bits=64).count() == 0
    assert packing.pack_documents(docs_of([])).count() == 0


def check_packing(rows, got, library, capacity):
    docs = defaultdict(list)
    for r in got:
        docs[r.doc_id].append(r)
    for i, t in rows:
        ids = np.array(library[0](t or "") + [0], "<u4")
        mine = sorted(docs[i], key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine)))
        assert [r.start for r in mine] == [sum(x.length for x in mine[:k]) for k in range(len(mine))]
        assert sum(r.length for r in mine) == len(ids)
        assert all(r.length == capacity for r in mine[1:])
        for r in mine:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(seqs)


def test_packing_is_whole_and_tight(docs_of, library):
    rows = list(enumerate(texts()))
    got = packing.pack_documents(docs_of(rows).repartition(3), capacity=256).collect()
    n = check_packing(rows, got, library, 256)
    bound = -(-sum(r.length for r in got) // 256)
    assert n <= bound + 3
    small = packing.pack_documents(docs_of(rows), capacity=256, group_pieces=10).collect()
    assert check_packing(rows, small, library, 256) >= bound


def test_repeated_rows_are_packed_each(docs_of):
    got = packing.pack_documents(docs_of([(1, "a b"), (1, "a b"), (None, None), (None, "z")])).collect()
    assert sorted(r.length for r in got) == [1, 2, 3, 3] and len({(r.sequence_id, r.offset) for r in got}) == 4


def test_sum_of_squares_takes_the_smallest_change():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 64, 800)
    where, offset = packing.sum_of_squares(lengths, 64)
    fill: dict[int, int] = {}
    for s, b, o in zip(lengths.tolist(), where.tolist(), offset.tolist()):
        gaps = Counter(64 - f for f in fill.values() if f < 64)
        score = lambda c: sum(v * v for v in c.values())
        options = {}
        for g in [g for g in gaps if g >= s]:
            after = gaps.copy()
            after[g] -= 1
            if g > s:
                after[g - s] += 1
            options[g] = score(after)
        if options:
            assert options[64 - fill[b]] == min(options.values())
        else:
            assert b not in fill
        assert fill.get(b, 0) == o
        fill[b] = o + s
