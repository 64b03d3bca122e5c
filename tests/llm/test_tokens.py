import base64
import random
import zlib

import numpy as np
import pytest
import tiktoken

from mdlake.llm import packing, token_output as T, tokens
from mdlake.llm import textkernel as K

from .helpers import awkward, frame, prose


@pytest.fixture(scope="module")
def exact():
    return tiktoken.Encoding("t", pat_str=tokens.PATTERN, mergeable_ranks=tokens.ranks(tokens.VOCABULARY), special_tokens={})


def test_chunks_encode_like_whole_texts(exact):
    import pyarrow as pa

    rng = random.Random(1)
    texts = ["", None, "a", " a", "a  b", "a\n\nb", "it's  don't\tx", "É, ß; 日本語 \U0001f600!", "a\r\nb \n c", "x" * 500, "12,3.4 5", " \n ", "a ,b .c", "«é»", " x  y"]
    alphabet = ["a", "É", " ", "\n", "\t", ",", ".", "'s", "1", "ß", "日", " ", "B", "-", "×", "÷", "é", "\x00", " "]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 40))) for _ in range(1500)]
    enc = tokens.Encoder(tokens.ranks(tokens.VOCABULARY))
    for _ in range(2):  # the second time from memory
        for s in K.slices(pa.array(texts), 3000):
            ids, bounds = enc.encode(s)
            assert (enc.counts(s) == np.diff(bounds)).all()
            for i in range(s.offs.size - 1):
                assert ids[bounds[i] : bounds[i + 1]].tolist() == exact.encode_ordinary(texts[s.first + i] or "")


def test_slots_are_a_permutation():
    for n in (1, 2, 3, 5, 16, 17, 1000, 4097):
        s = T.slots(np.arange(n), n, 7)
        assert sorted(s.tolist()) == list(range(n))
    assert (T.slots(np.arange(1000), 1000, 7) != T.slots(np.arange(1000), 1000, 8)).any()


def test_round_trip(spark, tmp_path, exact):
    rows = awkward(random.Random(3), 5000)
    docs = frame(spark, rows).selectExpr("*", "'c' AS slot", "'c' AS shard", "'c' AS data", "'c' AS `x.y`").repartition(3)
    path = str(tmp_path / "out")
    docs.write.parquet(str(tmp_path / "in"))
    docs = spark.read.parquet(str(tmp_path / "in"))
    out = T.write(docs, path, length=64, per_shard=10)
    rows_out = sorted(out.collect(), key=lambda r: r.slot)
    n = len(rows_out)
    assert [r.slot for r in rows_out] == list(range(n)) and {r.stride for r in rows_out} == {128}
    every = T.read(path, 0, n, 10, 128)
    assert every.shape == (n, 64)
    for r in rows_out:
        own = T.read(path, r.slot, 1, 10, 128)
        assert zlib.crc32(own.tobytes()) == r.crc32 and r.offset == (r.slot % 10) * 128
    assert (T.read(path, 7, 9, 10, 128) == every[7:16]).all()
    # in order of the sequences, the ids are those of the documents
    perm = T.slots(np.arange(n), n, T.PARAMS["key"])
    stream = every[perm].ravel()
    end = T.PARAMS["end"]
    pieces = [tuple(x) for x in np.split(stream, np.flatnonzero(stream == end) + 1) if len(x) and not (len(x) == 1)]
    want = [tuple(exact.encode_ordinary(r[1]) + [end]) for r in rows if r[1]]
    assert sorted(pieces) == sorted(want)
    assert T.write(docs.where("false"), str(tmp_path / "none")).count() == 0
    assert {x for r in rows_out for x in r.doc_ids} == {r[0] for r in rows if r[1]}


def check_windows(windows, rows, exact, window):
    have = {}
    for r in windows:
        assert r.used == sum(p.n_tokens for p in r.pieces) <= window and r.n_docs == len(r.pieces) and r.doc_ids == [p.doc_id for p in r.pieces]
        for p in r.pieces:
            have.setdefault(p.doc_id, []).append((p.first_token, p.n_tokens))
    assert len({r.window_id for r in windows}) == len(windows)
    want = {}
    for r in rows:
        if r[1]:
            want.setdefault(r[0], []).append(len(exact.encode_ordinary(r[1])) + 1)
    assert set(have) == set(want)
    for d, sizes in want.items():
        assert sum(n for _, n in have[d]) == sum(sizes)
        if len(sizes) == 1:
            at = 0
            for first, n in sorted(have[d]):
                assert first == at
                at += n


def test_packing(spark, exact):
    rows = awkward(random.Random(6), 5000)
    windows = packing.pack(frame(spark, rows, clash=True), window=256).collect()
    check_windows(windows, rows, exact, 256)
    assert packing.pack(frame(spark, rows).where("false")).count() == 0
    rng = random.Random(7)
    rows = [(i, prose(rng, rng.randrange(1, 300)), "en", "web", 1) for i in range(600)]
    windows = packing.pack(frame(spark, rows), window=1024).collect()
    check_windows(windows, rows, exact, 1024)
    fill = sum(r.used for r in windows) / (1024 * len(windows))
    assert fill > 0.93


def test_packer_is_best_fit():
    """Window by window, in the order in which they are emitted: the least room
    that holds an item takes it, the oldest of equals; the fullest window leaves
    when none does."""

    def plain(sizes, window, most):
        held, out, made = [], [], 0  # [room, number, items]
        for i, s in enumerate(sizes):
            fits = [w for w in held if w[0] >= s]
            gone = None
            if fits:
                w = min(fits)
            else:
                if len(held) >= most:
                    gone = min(held)
                    held.remove(gone)
                w = [window, made, []]
                made += 1
                held.append(w)
            w[0] -= s
            w[2].append(i)
            if gone is not None:
                out.append(gone[2])
            elif w[0] == 0:
                held.remove(w)
                out.append(w[2])
        return out, sorted(held)

    rng = random.Random(8)
    for most in (1, 2, 3, 10, 64):
        for top in (5, 50):
            sizes = [rng.randrange(1, top + 1) for _ in range(2000)]
            p = packing.Packer(50, most)
            out = [x for x in (p.add(s, i) for i, s in enumerate(sizes)) if x]
            want, held = plain(sizes, 50, most)
            assert out == want and list(p.rest()) == [(50 - room, items) for room, _, items in held]


def test_an_unfinished_shard_is_removed(tmp_path):
    from mdlake.llm import token_output

    out = token_output._Shards(str(tmp_path))
    out.write(0, b"ab")
    out.write(1, b"cd")
    assert [x.name for x in tmp_path.glob("shard-*")] == ["shard-00000000.bin"]
    out.drop()
    assert [x.name for x in tmp_path.iterdir()] == ["shard-00000000.bin"]


def test_ranks_file():
    r = tokens.ranks(tokens.VOCABULARY)
    assert len(set(r.values())) == len(r) and all(base64.b64encode(k) for k in list(r)[:10]) and T.PARAMS["end"] not in r.values()
