import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from millrace.llm import byte_bpe, packing, ragged, token_counts

ODD = ["", " ", "\n\n", "a<|endoftext|>b <|startoftext|>", "Don't WE'LL 12 ½ ÀÉ İstanbul ΣΑΣ 中文字 a\tc\x1cd\x85e",
       "aaaaaaaaaa " * 3, "x" * 5000, "é́ é", "<|endoftext|", "🙂🙂 ok", "!!'s 's ''", "\x00a", "abcdab" * 2000,
       "a  \n\n b   ", "q  z  x \n\ny", "word " * 3000]
ALPHABET = "abcdefghijkl mno\n.,'!<|>éßñÀ½0123αΣЖ中🙂́  \t\x1c "


def texts(n: int) -> list[str]:
    rng = random.Random(1)
    return ODD + ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(P.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_word_bpe_gives_the_librarys_ids(library):
    rows = texts(2000)
    own = token_counts.WordBpe(P.path("word_bpe_49k.json"))
    want = [library.encode(t, add_special_tokens=False).ids for t in rows]
    assert [x.tolist() for x in own.encode([t.encode() for t in rows])] == want
    assert own.count([t.encode() for t in rows]).tolist() == [len(w) for w in want]


def test_slices_and_a_full_store_change_nothing(library, monkeypatch):
    rows = texts(300)
    monkeypatch.setattr(ragged, "SLICE_BYTES", 64)
    monkeypatch.setattr(ragged, "CACHE_BITS", 9)
    monkeypatch.setattr(ragged, "STORE_ENTRIES", 500)
    own = token_counts.WordBpe(P.path("word_bpe_49k.json"))
    assert [x.tolist() for x in own.encode([t.encode() for t in rows])] == [
        library.encode(t, add_special_tokens=False).ids for t in rows]


def test_byte_bpe_gives_tiktokens_ids_and_the_text_back(tik, monkeypatch):
    rng = random.Random(2)
    rows = texts(2000) + ["".join(rng.choice("abcdethisn") for _ in range(1500)) for _ in range(5)]
    own = byte_bpe.ByteBpe(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for text, (ids, digits, decoded) in zip(rows, own.encode(rows)):
        want = tik.encode_ordinary(text)
        assert ids.tolist() == want and digits.decode() == " ".join(map(str, want)) and decoded == text.encode()
    monkeypatch.setattr(byte_bpe, "WIDE", 1 << 20)  # long pieces through the matrices too
    assert own.encode_pieces([b"abcdethisn" * 60])[0].tolist() == tik.encode_ordinary("abcdethisn" * 60)


def test_columns_of_tokens(spark, library, tik):
    rows = [(1, "The cat sat."), (2, None), (3, ""), (3, ""), (None, "word " * 2100), (5, "<|endoftext|>")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_tokens", "'x' as __text")
    got = token_counts.count_tokens(df, P.path("word_bpe_49k.json")).collect()
    want = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
    assert sorted(map(str, got)) == sorted(str(type(got[0])(doc_id=i, n_bytes=b, n_tokens=n, over_limit=n > 2048)) for i, b, n in want)
    for r in byte_bpe.digests(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect():
        text = next(t or "" for i, t in rows if i == r["doc_id"])
        ids = tik.encode_ordinary(text)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    encoded = byte_bpe.encode_documents(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    back = byte_bpe.decode_documents(encoded, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert sorted(bytes(r["data"]).decode() for r in back) == sorted(t or "" for _, t in rows)
    assert token_counts.count_tokens(df.limit(0), P.path("word_bpe_49k.json")).count() == 0
    assert byte_bpe.digests(df.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def sequences(rows: np.ndarray) -> int:
    return int((rows[:, 3] + rows[:, 2]).max()) if len(rows) else 0


def filled(rows: np.ndarray, capacity: int) -> dict[int, int]:
    """Tokens of each sequence, by walking the plan; places must follow each other without gaps."""
    ends: dict[int, int] = {}
    for size, first, times, sequence, offset in rows.tolist():
        copies = [s for s in rows.tolist() if s[3] == sequence and s[4] > offset]
        nxt = min((s[4] for s in copies), default=None)
        for s in range(sequence, sequence + times):
            ends[s] = max(ends.get(s, 0), nxt or 0, offset + size)
    assert max(ends.values(), default=0) <= capacity
    return ends


@pytest.mark.parametrize("sizes,best", [([6, 4, 5, 5, 7, 3], 3), ([7, 7, 7], 3), ([4] * 5, 3), ([10, 10, 1], 3), ([], 0),
                                        ([6, 5, 4, 3, 2], 2), ([9, 8, 2, 1], 2)])
def test_plans_of_small_sets_are_optimal(sizes, best):
    counts = {s: sizes.count(s) for s in sizes}
    rows = packing.plan(counts, 10)
    assert sequences(rows) == best
    filled(rows, 10)


def test_bin_completion_comes_near_the_bound():
    rng = np.random.default_rng(0)
    sizes = rng.lognormal(6.5, 1.0, 50_000).astype(int).clip(1, 4096)
    values, n = np.unique(sizes, return_counts=True)
    assert sequences(packing.plan(dict(zip(values.tolist(), n.tolist())), 4096)) <= -(-sizes.sum() // 4096) + 2


def fewest_of_all(sizes, capacity):
    """Exhaustive: for every subset, the fewest sequences and then the least filled last one."""
    best = {0: (0, capacity)}
    for mask in range(1, 1 << len(sizes)):
        options = []
        for i, size in enumerate(sizes):
            if mask >> i & 1:
                n, filled = best[mask ^ 1 << i]
                options.append((n, filled + size) if filled + size <= capacity else (n + 1, size))
        best[mask] = min(options)
    return best[(1 << len(sizes)) - 1][0]


def test_bin_completion_takes_the_fewest_against_exhaustive_search():
    rng = random.Random(12)
    cases = [([60, 51, 37, 32, 24, 19, 9, 5, 53], 100)]
    for _ in range(400):
        capacity = rng.choice([20, 60, 100])
        cases.append(([rng.randrange(1, capacity * 2 // 3) for _ in range(9)], capacity))
    for sizes, capacity in cases:
        want = fewest_of_all(sizes, capacity)
        counts = {s: sizes.count(s) for s in sizes}
        rows = packing.plan(counts, capacity)
        filled(rows, capacity)
        assert packing.fewest(counts, capacity) <= want == sequences(rows)


def test_waste_stays_small_where_large_pieces_dominate():
    sizes = np.random.default_rng(0).lognormal(7.5, 0.6, 50_000).astype(int).clip(1, 4096)
    values, n = np.unique(sizes, return_counts=True)
    counts = dict(zip(values.tolist(), n.tolist()))
    assert packing.fewest(counts, 4096) == 24_934 and sequences(packing.plan(counts, 4096)) <= 24_940


@pytest.mark.parametrize("n", [1500, 2500, 9000])
def test_many_shortest_pieces_are_planned(n):
    assert sequences(packing.plan({1: n}, 4096)) == -(-n // 4096)
    assert sequences(packing.plan({3: n, 4000: 2}, 4096)) == 2 + -(-(n - 64) // 1365)


def test_fillings_waste_the_least_against_brute_force():
    rng = random.Random(7)
    for _ in range(300):
        room = rng.randrange(1, 40)
        counts = [0] * 41
        for _ in range(rng.randrange(1, 6)):
            counts[rng.randrange(1, 41)] = rng.randrange(1, 5)
        sums = {0}
        for size, n in enumerate(counts):
            sums = {x + k * size for x in sums for k in range(n + 1)}
        filling = packing.best_filling(room, counts, [s for s in range(41) if counts[s]])
        assert sum(filling) == max(x for x in sums if x <= room)
        assert filling == sorted(filling, reverse=True) and all(filling.count(s) <= counts[s] for s in filling)


def test_packing_holds_every_token_once(spark, library):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["cat", "sat", "mat", "12"]) for _ in range(rng.randrange(40)))) for i in range(60)]
    rows += [(60, None), (61, ""), (61, ""), (None, "one two"), (63, "word " * 100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as id", "1 as length").repartition(3)
    got = packing.pack(df, P.path("word_bpe_49k.json"), capacity=32, with_ids=True).collect()
    by_sequence: dict[int, list] = {}
    for r in got:
        assert r["length"] == len(r["ids"]) and r["start"] == 32 * r["piece"]
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 32
    pieces: dict = {}
    for r in sorted(got, key=lambda r: (str(r["doc_id"]), r["piece"])):
        if r["doc_id"] != 61:
            pieces.setdefault(r["doc_id"], []).extend(r["ids"])
    want = {i: library.encode(t or "", add_special_tokens=False).ids + [1] for i, t in rows if i != 61}
    assert pieces == want
    assert len(by_sequence) <= -(-sum(r["length"] for r in got) // 32) + 1
    assert packing.pack(df.limit(0), P.path("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("texts", [["one two"] + [""] * 300, ["cat"] * 700 + [None] * 900 + ["one two three"] * 2])
def test_many_short_copies_beside_few_lengths_leave_no_gaps(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = packing.pack(df, P.path("word_bpe_49k.json"), capacity=4096).collect()
    assert len(got) == len(texts)
    by_sequence: dict[int, list] = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 4096
