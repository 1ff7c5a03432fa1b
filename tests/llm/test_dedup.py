"""SimHash, suffix arrays, chunks and components against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import xxhash

from cellgrid.llm import chunk_dedup, simhash, suffix_dedup
from cellgrid.llm.components import components
from cellgrid.llm.induced import permuted_prefixes, suffix_array


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [words[i : i + 4] for i in range(len(words) - 3)] or ([words] if words else [])
    hashes = [xxhash.xxh64_intdigest(b" ".join(s), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps, max_bits=4):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= max_bits:
                root[find(i)] = find(j)
    groups = {}
    for i, doc in enumerate(ids):
        groups.setdefault(find(i), []).append(doc)
    least = {r: min((x for x in g if x is not None), default=None) for r, g in groups.items()}
    return [least[find(i)] for i in range(len(ids))]


def test_near_duplicates_match_brute_force(edges, edge_rows):
    fps = [plain_fingerprint(t) for _, t in edge_rows]
    groups = plain_components([i for i, _ in edge_rows], fps)
    want = Counter((i, f, g) for (i, _), f, g in zip(edge_rows, fps, groups))
    got = Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(edges).collect())
    assert got == want


def test_links_find_every_pair_within_four_bits(spark):
    rng = random.Random(1)
    values = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        values.add(x)
        for flips in (1, 3, 4, 5):
            values.add(x ^ sum(1 << b for b in rng.sample(range(64), flips)))
    signed = [x - (1 << 64) if x >> 63 else x for x in values]
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 4}
    assert got == want and len(want) > 100


def test_one_row_of_each_group_stays(edges, edge_rows, no_docs):
    kept = simhash.one_per_group(edges)
    assert kept.columns == edges.columns
    rows = kept.collect()
    fps = [plain_fingerprint(t) for _, t in edge_rows]
    groups = plain_components([i for i, _ in edge_rows], fps)
    assert len(rows) == len(set(groups))
    assert sorted(r.doc_id for r in rows) == sorted(set(groups))
    assert simhash.one_per_group(no_docs).count() == 0


def test_components_of_paths_rings_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, x) for x in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{x: 100 for x in range(100, 160)}, **{x: 200 for x in range(200, 203)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_suffix_array_and_prefixes_match_sorting():
    rng = random.Random(0)
    for _ in range(400):
        alphabet = rng.choice([b"ab", b"abc", b"a", b"mississippi", b"\x00\xff"])
        text = bytes(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 2, 5, 40, 120])))
        text = text[:15] * rng.randrange(1, 5) + text
        order = sorted(range(len(text)), key=lambda i: text[i:])
        shared = [0] * len(text)
        for a, b in zip(order, order[1:]):
            while max(a, b) + shared[b] < len(text) and text[a + shared[b]] == text[b + shared[b]]:
                shared[b] += 1
        data = np.frombuffer(text, np.uint8)
        found = suffix_array(data, 256)
        assert found.tolist() == order
        assert permuted_prefixes(data, found).tolist() == shared


def plain_repeats(rows, length):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(x[a : a + length] for x in data for a in range(len(x) - length + 1))
    out = Counter()
    for (doc, _), x in zip(rows, data):
        covered = np.zeros(len(x) + 1, int)
        for a in range(len(x) - length + 1):
            if seen[x[a : a + length]] > 1:
                covered[a] += 1
                covered[a + length] -= 1
        gone = np.cumsum(covered)[: len(x)] > 0
        spans = int(np.sum(np.diff(gone.astype(int), prepend=0) == 1))
        kept = np.frombuffer(x, np.uint8)[~gone].tobytes()
        out[doc, len(x), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def found_repeats(docs, **options):
    rows = suffix_dedup.remove_repeats(docs, **options).collect()
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in rows)


def test_repeated_strings_match_brute_force(edges, edge_rows, no_docs):
    assert found_repeats(edges) == plain_repeats(edge_rows, 200)
    assert suffix_dedup.remove_repeats(no_docs).count() == 0


def test_strings_of_hot_anchors_are_decided_singly(edges, edge_rows):
    assert found_repeats(edges, length=70, hot_bytes=300) == plain_repeats(edge_rows, 70)


def test_anchors_do_not_depend_on_blocks():
    rng = random.Random(3)
    text = bytes(rng.choice(b"abcdef ") for _ in range(5000))
    for block in (400, 1024, 1 << 22):
        anchor, start, size = suffix_dedup.Anchors(200, block).of(text)
        assert start[0] == 0 and (start[1:] == start[:-1] + size[:-1] - 199).all() and start[-1] + size[-1] == len(text)


def test_chunks_resist_shifts_and_keep_characters():
    rng = random.Random(9)
    text = "".join(rng.choice("abcé日 x🙂") for _ in range(6000))
    data = text.encode()
    ends = chunk_dedup.cuts(data)
    assert ends[-1] == len(data) and all(b - a <= chunk_dedup.MOST for a, b in zip([0, *ends], ends))
    [data[a:b].decode() for a, b in zip([0, *ends], ends)]
    shifted = chunk_dedup.cuts(b"inserted " + data)
    pieces, moved = ({x[a:b] for a, b in zip([0, *e], e)} for x, e in ((data, ends), (b"inserted " + data, shifted)))
    assert len(pieces & moved) > 0.95 * len(pieces)
    assert chunk_dedup.cuts(b"") == []


def test_gear_hash_is_the_weighted_sum_of_the_window():
    data = np.frombuffer(b"some bytes to be hashed, more than thirty-two of them", np.uint8)
    for at, value in enumerate(chunk_dedup.gear_hashes(data)):
        window = data[max(0, at - 31) : at + 1][::-1]
        assert int(value) == sum(int(chunk_dedup.GEAR[b]) << j for j, b in enumerate(window)) % (1 << 32)


def test_later_chunks_go_and_first_ones_stay(edges, edge_rows, no_docs):
    rows = chunk_dedup.remove_repeats(edges).collect()
    assert len(rows) == len(edge_rows)
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append(r)
    base = dict(edge_rows)[1]
    # the null id sorts first, so its copy is the one that stays
    assert next(r for r in by_id[None] if r.n_bytes).kept == base
    assert by_id[1][0].kept == "" and [r.kept for r in by_id[2]] == ["", ""]
    assert 200 < by_id[14][0].n_removed <= 350
    assert by_id[7][0].kept == "one" and by_id[5][0].n_bytes == 0
    assert chunk_dedup.remove_repeats(no_docs).count() == 0


def test_chunk_dedup_matches_brute_force(edges, edge_rows):
    distinct = {((-(1 << 63) if i is None else i), xxhash.xxh64_intdigest((t or "").encode(), 42)): (t or "").encode() for i, t in edge_rows}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    ordered = sorted(((i, signed(h)), x) for (i, h), x in distinct.items())
    seen, want = set(), {}
    for key, data in ordered:
        runs, at = [], 0
        for end in chunk_dedup.cuts(data):
            chunk = data[at:end]
            if chunk in seen:
                if runs and runs[-1][1] == at:
                    runs[-1][1] = end
                else:
                    runs.append([at, end])
            seen.add(chunk)
            at = end
        want[key] = sum(b - a for a, b in runs if b - a >= chunk_dedup.MIN_BYTES)
    got = Counter((r.doc_id, r.n_removed) for r in chunk_dedup.remove_repeats(edges).collect())
    keys = [((-(1 << 63) if i is None else i), signed(xxhash.xxh64_intdigest((t or "").encode(), 42))) for i, t in edge_rows]
    assert got == Counter((i, want[k]) for (i, _), k in zip(edge_rows, keys))
