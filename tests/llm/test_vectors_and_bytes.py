"""Hard negatives, centroid clusters and the byte transducer against brute force and the library."""

import hashlib
import math
import random

import numpy as np
import pytest
from conftest import DATA
from hypothesis import given, settings
from hypothesis import strategies as st

from mailquarry.llm import bytebpe, centroids, negatives, registry, vectors

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute_negatives(rows, every=50, relabel=7):
    kept = [(i, (label + 1) % 10 if i % relabel == 0 else label, [math.floor(256 * x) for x in v]) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (a, label, v) in enumerate(kept):
        if a % every:
            continue
        ranked = sorted(((-sum(x * y for x, y in zip(v, w)), b, k == label) for n, (b, k, w) in enumerate(kept) if n != at))
        for s, b, _ in [r for r in ranked if r[2]][:5]:
            band = [(t, c) for t, c, same in ranked if not same and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(a, b, n, c, -s, -t) for n, (t, c) in enumerate(band, 1)]
    return sorted(out)


def made_vectors(seed, n=400, dim=6, big=1.0):
    rnd = random.Random(seed)
    rows = [(i, [rnd.gauss(0.3, 1) * big for _ in range(dim)], rnd.randrange(4)) for i in range(n)]
    rows += [rows[3], rows[50], rows[50]] + [(1000 + i, rows[0][1], i % 3) for i in range(60)]
    rows += [(2000, None, 1), (2050, [1.0, None], 1), (2001, [float("inf")] * dim, 2), (2002, [1.0] * dim, None), (None, [1.0] * dim, 1), (2003, [], 1), (2100, [2.0] * (dim + 2), 1)]
    return rows


@pytest.mark.parametrize(("big", "blocks"), [(1.0, (8192, 4096)), (1.0, (40, 5)), (1e6, (64, 8)), (1e12, (64, 8))])
def test_negatives_against_brute_force(spark, monkeypatch, big, blocks):
    monkeypatch.setattr(negatives, "ROWS", blocks[0])
    monkeypatch.setattr(negatives, "ANCHORS", blocks[1])
    rows = made_vectors(1, big=big)
    found = sorted(map(tuple, negatives.mine(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    want = sorted((tuple(None if abs(x) >= 1 << 63 else x for x in r) for r in brute_negatives(rows)), key=str)
    assert found == want and len(found) > 50


def test_scores_are_sorted_exactly():
    rnd = np.random.default_rng(2)
    for most in (5, 1 << 40, 1 << 52):
        x, y = (rnd.integers(-most, most, (7, 9)) for _ in range(2))
        order, negated = negatives.sorted_scores(negatives.scores(x, y))
        for i in range(7):
            want = sorted((-sum(int(a) * int(b) for a, b in zip(x[i], y[j])), j) for j in range(7))
            assert [(int(s), int(p)) for s, p in zip(negated[i], order[i])] == want


def brute_clusters(rows, clusters, rounds, dim):
    kept = [(i, tuple(math.floor(1024 * x) for x in v)) for i, v, _ in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)
    c = [q for _, q in start[:clusters]]

    def assigned():
        return [min((sum((a - b) ** 2 for a, b in zip(q, k)), n) for n, k in enumerate(c)) for _, q in kept]

    for _ in range(rounds):
        of = assigned()
        for n in range(len(c)):
            mine = [q for (_, q), (_, k) in zip(kept, of) if k == n]
            if mine:
                c[n] = tuple(sum(x) // len(mine) for x in zip(*mine))
    of = assigned()
    inertia = [sum(d for d, k in of if k == n) for n in range(len(c))]
    return sorted(((i, k, d, inertia[k], sum(inertia)) for (i, _), (d, k) in zip(kept, of)), key=str), [list(k) for k in c]


@pytest.mark.parametrize(("big", "share"), [(1.0, 512), (1.0, 8), (1e4, 512)])
def test_clusters_against_brute_force(spark, monkeypatch, big, share):
    monkeypatch.setattr(centroids, "SHARE", share)
    rows = made_vectors(5, n=150, big=big)
    found, final = centroids.clusters_of(spark.createDataFrame(rows, SCHEMA), clusters=5, rounds=6, dim=6)
    want, centres = brute_clusters(rows, 5, 6, 6)
    assert sorted(map(tuple, found.collect()), key=str) == want
    assert final == centres


def test_clusters_of_fewer_rows_than_centroids(spark):
    rows = [(1, [0.5, 1.0], 0), (2, [0.5, 1.0], 0), (3, [-9.0, 0.0], 0)]
    found, final = centroids.clusters_of(spark.createDataFrame(rows, SCHEMA), dim=2)
    want, centres = brute_clusters(rows, 8, 10, 2)
    assert sorted(map(tuple, found.collect()), key=str) == want and final == centres and len(final) == 3


def test_sums_beyond_64_bits_are_null(spark):
    rows = [(i, [(-1.0) ** i * 1e300, 1e300], 0) for i in range(4)]
    found, _ = centroids.clusters_of(spark.createDataFrame(rows, SCHEMA), clusters=1, dim=2)
    assert {(r.cluster, r.distance, r.inertia) for r in found.collect()} == {(0, None, None)}


def test_packed_vectors_are_equal_exactly_if_the_vectors_are():
    for v in ([0.1, -0.2], [31.9, -32.0], [32.0, 1.0], [], [1e300, -1e300]):
        want = [min(max(math.floor(1024 * x), -vectors.LIMIT), vectors.LIMIT) for x in v]
        assert vectors.unpacked([vectors.quantised(v, 1024)]).tolist() == [want]
    assert vectors.unpacked([vectors.quantised([1.0], 1), vectors.quantised([1e9, 2.0], 1)]).tolist() == [[1, 0], [10**9, 2]]


# ---- bytes


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.ranks_of(bytebpe.RANKS), special_tokens={})


ODD = ["", " ", "\n\n  x", "a" * 3000, "-" * 3000, " " * 3000, "漢字かな交じり文" * 40, "привет мир " * 30, "é​\x1c\x85\xa0", "😀👍🏽", "<|endoftext|>", "I'll we've 'S", "١٢٣ ½ Ⅳ", "\u0000￿\U0010ffff", "thththhehehereretion" * 50]


@given(st.text(max_size=60) | st.text("abehtinors '1-\n", max_size=200))
@settings(max_examples=400, deadline=None)
def test_transducer_is_the_library_on_any_text(library, text):
    machine, decoder = bytebpe.machines()
    ids = machine.encode(text)
    assert ids.tolist() == library.encode_ordinary(text)
    assert decoder.decode(ids) == text


@pytest.mark.parametrize("text", ODD)
def test_transducer_is_the_library_on_odd_text(library, text):
    machine, decoder = bytebpe.machines()
    assert machine.encode(text).tolist() == library.encode_ordinary(text)
    assert decoder.decode(library.encode_ordinary(text)) == text


def test_each_character_between_others(library):
    machine, _ = bytebpe.machines()
    for at in range(0, 0x110000, 1 << 9):
        text = "".join(f"a{chr(c)}1 {chr(c)}  {chr(c)}!" for c in range(at, at + (1 << 9), 3) if not 0xD800 <= c < 0xE000)
        assert machine.encode(text).tolist() == library.encode_ordinary(text)


def test_full_tables_start_anew(library):
    machine = bytebpe.Transducer(bytebpe.ranks_of(bytebpe.RANKS), states=50, pieces=10)
    text = " ".join(random.Random(1).choices(["thththretion", "onheon", "annt", "études", "x" * 70, "12345"], k=300))
    assert machine.encode(text).tolist() == library.encode_ordinary(text) and len(machine.state) <= 50


def test_tokens_come_after_bounded_lookahead():
    machine, _ = bytebpe.machines()
    data, read, settled, longest = ("thinretion-----reaux" * 60).encode(), 0, 0, max(map(len, machine.ranks))

    def bytes_read():
        nonlocal read
        for b in data:
            read += 1
            yield b

    for run in machine.run(bytes_read()):
        settled += sum(len(machine.bytes[i]) for i in run)
        assert read - settled <= longest
    assert settled == len(data)


def test_vocabularies_whose_merges_are_out_of_order():
    """Tokens that the merges never make, or that rank below their parts, are tried by plain merging."""
    rnd = random.Random(4)
    for _ in range(30):
        ranks = {bytes([b]): i for i, b in enumerate(b"abc")}
        while len(ranks) < 25:
            a, b = rnd.choice(list(ranks)), rnd.choice(list(ranks))
            if len(a + b) < 7:
                ranks.setdefault(a + b, len(ranks))
        order = list(range(3, len(ranks)))
        rnd.shuffle(order)
        ranks = {t: i if i < 3 else order[i - 3] for t, i in ranks.items()}
        machine = bytebpe.Transducer(ranks)
        for _ in range(40):
            data = bytes(rnd.choices(b"abc", k=rnd.randint(1, 30)))
            want = [ranks[data]] if data in ranks else [ranks[p] for p in bytebpe.merged(data, ranks)[0]]
            assert list(machine.encode_piece(data)) == want


@given(st.binary(max_size=40), st.lists(st.integers(1, 5), max_size=40))
@settings(max_examples=500, deadline=None)
def test_decoding_is_incremental_utf8(data, lengths):
    tokens, at = {}, 0
    for i, n in enumerate([*lengths, len(data) or 1]):
        tokens[i], at = data[at : at + n], at + n
    assert bytebpe.Decoder(tokens, most=3).decode(range(len(tokens))) == data.decode("utf-8", "replace")


def test_byte_query_against_the_library(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    found = registry.QUERIES["op12_byte_bpe_transducer"](spark, DATA).collect()
    assert {r.doc_id for r in found} == set(docs) and len(found) == len(docs)
    for r in found:
        ids = library.encode_ordinary(docs[r.doc_id])
        want = len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode_bytes(ids)).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want


def test_encode_and_decode_documents(spark, library):
    docs = spark.createDataFrame([(1, t) for t in ODD] + [(None, None)], "k int, text string")
    ids = bytebpe.encode_documents(docs, "k")
    assert sorted(r.ids for r in ids.collect()) == sorted([*map(library.encode_ordinary, ODD), []])
    assert sorted(r.text for r in bytebpe.decode_documents(ids, "k").collect()) == sorted([*ODD, ""])
