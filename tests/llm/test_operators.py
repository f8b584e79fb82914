"""The training-data operators against brute force, round trips, libraries and edge cases."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import sketchspark.llm.line_dedup as line_dedup_module
from sketchspark.llm import queries
from sketchspark.llm.decontaminate import decontaminate
from sketchspark.llm.elias_fano import Boundaries, encode_boundaries, token_shards
from sketchspark.llm.language_id import CompressionClassifier, canonical, identify
from sketchspark.llm.line_dedup import Split, _beyond, _near, _spanning, blocks, line_dedup, normalise, signs, within_edits
from sketchspark.llm.ngram_join import ngram_jaccard_join, signatures
from sketchspark.llm.packing import best_fit, best_fit_pack
from sketchspark.llm.suffix_dedup import suffix_dedup
from sketchspark.llm.tiff import decode, encode, pages, read_pages, text_media
from sketchspark.llm.token_prefix import PrefixCounter, longest_prefix, token_prefixes, tokens_at
from sketchspark.llm.toxicity import StringKernelSVM, fit_texts, score, with_score

EDGES = [(1, "one two three four five six seven eight"), (1, "one two three four five six seven eight"), (2, None), (None, "one two three four five six seven eight nine"), (3, ""), (4, " \n\t "), (5, "x " * 30_000), (6, "日本 é ß\n\nend"), (7, "one")]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(i, t, "s", "c") for i, t in EDGES], "doc_id long, text string, source string, score string")


@pytest.fixture(scope="module")
def empty(edges):
    return edges.limit(0)


def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


# --- 1 ------------------------------------------------------------------------------------------


def brute_substrings(texts, length):
    count = collections.Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    for b in texts:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        yield len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) > 0).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()


@pytest.mark.parametrize("ways", [{}, {"crowd": 2}, {"crowd": 2, "hash_from": 2}])
def test_suffix_dedup(spark, ways):
    rng = random.Random(3)
    base = ["".join(rng.choice("ab") for _ in range(60)) for _ in range(4)]
    rows = [(rng.choice([i, 5, None]), "".join(rng.choice(base)[rng.randrange(20) :][: rng.randrange(60)] if rng.random() < 0.7 else rng.choice("ab") * rng.randrange(30) for _ in range(rng.randrange(8))) if rng.random() < 0.95 else None) for i in range(60)]
    want = sorted((str(i), *r) for (i, _), r in zip(rows, brute_substrings([(t or "").encode() for _, t in rows], 25), strict=True))
    got = suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), length=25, **ways).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == want


# --- 2 ------------------------------------------------------------------------------------------


def brute_links(rows, width, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    root, degree = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                degree[a], degree[b] = degree[a] + 1, degree[b] + 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(s), least.get(find(i)), degree[i]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def test_ngram_join(spark):
    rng = random.Random(5)
    rows = []
    for size in (5, 8, 14, 25, 60, 150, 400):
        for _ in range(3):
            words = [rng.choice("abcdefghijklmnop") + str(rng.randrange(50)) for _ in range(size)]
            for _ in range(8):
                copy = list(words)
                for _ in range(rng.randrange(0, 1 + size // 25)):
                    copy[rng.randrange(len(copy))] = "z" + str(rng.randrange(99))
                rows.append((len(rows), " ".join(copy)))
    for width, percent in ((4, 85), (5, 80)):
        got = ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), width=width, percent=percent).collect()
        assert sorted(map(tuple, got)) == sorted(brute_links(rows, width, percent))


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_ngram_join_one_word_more_or_less(spark, width, percent):
    rows = []
    for size in range(1, 61):
        words = [f"w{size}x{i}" for i in range(size)]
        for copy in (words, [*words, "more"], words[:-1]):
            rows.append((len(rows), " ".join(copy)))
    got = ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), width=width, percent=percent).collect()
    assert sorted(map(tuple, got)) == sorted(brute_links(rows, width, percent))


def linked_pairs(percent):
    """Random sets at the greatest difference that still links, at all sizes up to 60."""
    rng = np.random.default_rng(7)
    for a in range(1, 61):
        for b in range(a, a * 100 // percent + 1):
            shared = -(-percent * (a + b) // (100 + percent))
            for _ in range(20):
                items = rng.integers(0, 1 << 63, a + b - shared, dtype=np.uint64) * np.uint64(2)
                yield np.sort(items[:a]), np.sort(items[a - shared :])


@pytest.mark.parametrize("percent", [80, 85])
def test_linked_sets_share_a_signature(percent):
    for a, b in linked_pairs(percent):
        x, y = ({s for _, _, part in signatures(v, percent) for s in part.tolist()} for v in (a, b))
        assert x & y or np.array_equal(a, b), (len(a), len(b))


@pytest.mark.parametrize("percent", [80, 85])
def test_linked_sets_share_as_many_signatures_as_they_need(percent):
    for a, b in linked_pairs(percent):
        x, y = ({band: (need, set(part.tolist())) for band, need, part in signatures(v, percent)} for v in (a, b))
        met = [len(x[i][1] & y[i][1]) >= max(x[i][0], y[i][0]) for i in x.keys() & y.keys()]
        assert any(met) or np.array_equal(a, b), (len(a), len(b))


def test_ngram_join_of_null_ids_and_repeated_rows(spark):
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join([*words[:k], "z", *words[k + 1 :]]) for k in range(0, 40, 8)]
    one = spark.createDataFrame([(None, t) for t in texts] + [(3, texts[0])], "doc_id long, text string")
    many = one.unionAll(one.limit(0)).crossJoin(spark.range(300).select()).unionAll(spark.createDataFrame([(9, "another text")], one.schema))
    # a word changed at the start spoils one shingle, elsewhere four: only the first text is near enough to all others
    got = ngram_jaccard_join(many, width=4, percent=70).groupBy("doc_id", "component_id", "n_links").count().collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(None, 3, 1799, 300), (None, 3, 899, 1200), (3, 3, 1799, 300), (9, 9, 0, 1)]))


# --- 3 ------------------------------------------------------------------------------------------


def brute_lines(rows):
    """By edit similarity alone."""
    lines = [(d, n, normalise(x.encode())) for d, t in rows for n, x in enumerate((t or "").split("\n"))]
    lines = [(d, n, f) for d, n, f in lines if f]
    names = sorted({f for _, _, f in lines})
    root = list(range(len(names)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(names)):
        for b in range(a):
            u, v = names[a].decode(), names[b].decode()
            if within_edits(u, v, int(max(len(u), len(v)) * 0.2 + 1e-9)):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    index, seen, gone = {f: i for i, f in enumerate(names)}, set(), collections.defaultdict(set)
    for d, n, f in sorted(lines):
        if find(index[f]) in seen:
            gone[d].add(n)
        seen.add(find(index[f]))
    return {d: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[d]) for d, t in rows}


@pytest.mark.parametrize("tiles", [{}, {"tile": 2, "hot_from": 4}, {"tile_chars": 100}])
def test_line_dedup(spark, tiles):
    rng = random.Random(2)
    pool = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 9) for _ in range(rng.randrange(3, 90))) for _ in range(12)]

    def vary(x):
        k = rng.random()
        return x.upper() + "!!" if k < 0.3 else x[:-2] + rng.choice("xyz") + x[-1:] if k < 0.6 else x

    rows = [(i, "\n".join(vary(rng.choice(pool)) for _ in range(rng.randrange(6)))) for i in range(50)] + [(98, None), (99, "")]
    got = {r.doc_id: r.text for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), **tiles).collect()}
    assert got == brute_lines(rows)


def shares_a_block(pairs):
    """Whether each pair of normalised lines becomes a candidate."""
    split = Split([x for pair in pairs for x in pair])
    owner, value = blocks(split)
    at, (sim, size) = np.searchsorted(owner, np.arange(2 * len(pairs) + 1)), signs(split)
    near = _near(sim[::2], sim[1::2], size[::2], size[1::2], 0.8, 20)
    return [bool(n and set(value[at[2 * i] : at[2 * i + 1]].tolist()) & set(value[at[2 * i + 1] : at[2 * i + 2]].tolist())) for i, n in enumerate(near)]


def test_line_candidates_recall_against_edit_similarity(spark, sf):
    """Every 4th line of the table against all lines, by edit distance; a bag of letters bounds it from below."""
    names = sorted({f for r in docs(spark, sf).collect() for x in (r.text or "").split("\n") if (f := normalise(x.encode()))})
    texts = [f.decode() for f in names]
    size, bag = np.array([len(t) for t in texts]), np.array([np.bincount(np.frombuffer(t.encode("utf-32-le"), np.uint32) % 64, minlength=64) for t in texts])
    pairs = []
    for q in range(0, len(texts), 4):
        most = np.floor(np.maximum(size, size[q]) * 0.2 + 1e-9)
        apart = bag - bag[q]
        least = np.maximum(np.clip(apart, 0, None).sum(1), np.clip(-apart, 0, None).sum(1))
        pairs += [(names[q], names[j]) for j in np.flatnonzero(least <= most) if j != q and within_edits(texts[q], texts[j], int(most[j]))]
    assert len(pairs) > 5
    assert np.mean(shares_a_block(pairs)) >= 0.9


def test_line_candidates_recall_of_small_edits():
    rng = random.Random(6)
    for words in (1, 3, 6, 10, 12, 13, 16, 19, 25, 60, 200):
        pairs = []
        for _ in range(300):
            line = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(5 if words < 3 else 2, 11))) for _ in range(words)]
            other, at = list(line), rng.randrange(words)
            k = rng.randrange(len(other[at]))
            other[at] = other[at][:k] + rng.choice(["q", "", "qz"]) + other[at][k + 1 :]
            if words > 13 and rng.random() < 0.5:
                other.insert(rng.randrange(words), "more")
            a, b = " ".join(line), " ".join(other)
            if within_edits(a, b, int(max(len(a), len(b)) * 0.2 + 1e-9)):
                pairs.append((a.encode(), b.encode()))
        assert np.mean(shares_a_block(pairs)) >= 0.9, words


def random_words(rng, count):
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9))) for _ in range(count)]


def test_common_words_are_no_block():
    """Lines that share but their first and last words don't meet: their pairs would grow with the square of the input."""
    rng = random.Random(8)
    lines = [" ".join(["of", "the", *random_words(rng, rng.randrange(14, 60)), "and", "the"]).encode() for _ in range(300)]
    assert np.unique(blocks(Split(lines))[1], return_counts=True)[1].max() == 1


def test_line_dedup_of_spread_edits(spark):
    """Every tenth word replaced: edit similarity above 0.8, but SimHashes up to 30 bits apart."""
    rng = random.Random(9)
    rows = []
    for i in range(40):
        line = random_words(rng, 90)
        other = list(line)
        for k in rng.sample(range(90), 9):
            other[k] = random_words(rng, 1)[0]
        rows += [(i, " ".join(line)), (100 + i, " ".join(other))]
    got = {r.doc_id: r.text for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: t if d < 100 else "" for d, t in rows}


def test_pieces_bound_the_edits():
    rng = random.Random(10)
    texts = []
    for _ in range(300):
        line = [rng.choice("abcdefgh é日") for _ in range(rng.randrange(1, 400))]
        other = list(line)
        for _ in range(rng.randrange(len(line) // 3 + 1)):
            k = rng.randrange(len(other) + 1)
            other[k : k + rng.randrange(2)] = rng.choice(["", "a", "日"])
        texts += ["".join(line), "".join(other) or "x"]
    at = np.r_[0, np.cumsum([len(t) for t in texts])]
    letters = (np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32) & 31).astype(np.uint8)
    a = np.arange(0, 600, 2)
    b = np.r_[a[:200] + 1, a[200:][::-1]]
    most = np.array([int(max(len(texts[i]), len(texts[j])) * 0.2 + 1e-9) for i, j in zip(a, b, strict=True)])
    far = _beyond(letters, at, a, b, most, few=1)
    close = np.array([within_edits(texts[i], texts[j], int(m)) for i, j, m in zip(a, b, most, strict=True)])
    assert far.any() and close.any() and not (far & close).any()


def test_bit_vectors_are_exact():
    """No pair of plain letters is left to be verified one by one, whichever of the two is longer."""
    rng = random.Random(11)
    texts = []
    for _ in range(400):
        line = [rng.choice("abcdefgh ij") for _ in range(rng.randrange(1, 420))]
        other = list(line)
        for _ in range(rng.randrange(len(line) // 3 + 1)):
            k = rng.randrange(len(other) + 1)
            other[k : k + rng.randrange(2)] = rng.choice(["", "a", "c"])
        cut = rng.randrange(30) * rng.randrange(2)
        texts += ["".join(line), "".join(other[cut:]) + "c" * rng.randrange(cut + 1) or "x"]
    at = np.r_[0, np.cumsum([len(t) for t in texts])]
    letters = (np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32) & 31).astype(np.uint8)
    a = np.r_[0:800:2, 1:800:2]
    most = np.array([int(max(len(texts[i]), len(texts[i ^ 1])) * 0.2 + 1e-9) for i in a])
    far = _beyond(letters, at, a, a ^ 1, most, few=1)
    close = np.array([within_edits(texts[i], texts[i ^ 1], int(m)) for i, m in zip(a, most, strict=True)])
    assert far.any() and close.any() and (far != close).all()


def test_cells_are_verified_together(monkeypatch):
    """Unrelated lines that share five words are told apart in a few batches, not cell by cell or pair by pair."""
    rng, calls = random.Random(12), collections.Counter()
    for name in ("_beyond", "within_edits"):
        monkeypatch.setattr(line_dedup_module, name, lambda *x, f=getattr(line_dedup_module, name), name=name: calls.update([name]) or f(*x))
    cells, texts = np.repeat(np.arange(20), 70), []
    for _ in range(20):
        shared = random_words(rng, 5)
        texts += [" ".join([*random_words(rng, 15), *shared, *random_words(rng, 20)]) for _ in range(68)]
        texts += [texts[-1] + " more", texts[-2] + " less"]
    sim, size = signs(Split([t.encode() for t in texts]))
    links = list(_spanning(cells, list(range(20)), texts, sim, size, [[int(c)] for c in cells], 0.8, 20))
    assert sorted(map(sorted, links)) == sorted(sorted(x) for c in range(20) for x in ((70 * c + 67, 70 * c + 68), (70 * c + 66, 70 * c + 69)))
    assert calls["_beyond"] <= 60 and calls["within_edits"] <= 400


def test_line_dedup_clashing_names(spark):
    rows = [(1, "one same line of text\nx", 7, 8, 9, 10, "a", "b"), (2, "one same line of text", 7, 8, 9, 10, "a", "b")]
    names = "doc_id long, text string, n_lines int, _n_lines int, dropped int, _id int, row string, kept string"
    out = line_dedup(spark.createDataFrame(rows, names))
    assert out.columns == ["doc_id", "text", "__n_lines", "_n_lines", "dropped", "_id", "row", "kept", "n_lines", "n_removed"]
    assert sorted(map(tuple, out.collect())) == [(1, rows[0][1], 7, 8, 9, 10, "a", "b", 2, 0), (2, "", 7, 8, 9, 10, "a", "b", 1, 1)]


def test_line_dedup_short_lines(spark):
    rows = [(1, "Read more\n日本語の長い一行です。\n--\n--\nPage 1\nonly here"), (2, "read MORE!\n日本語の長い一行です。\n\nx\nPage 2"), (3, "X\n\nread more")]
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("\nx", 3), 3: ("", 2)}


def test_within_edits():
    rng = random.Random(1)
    for _ in range(2000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(12))) for _ in "ab")
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        for most in range(6):
            assert within_edits(a, b, most) == (row[-1] <= most)


def test_within_edits_of_long_lines():
    """Exact in its band, and unrelated long lines are told apart by little of it: the whole of it costs ten times as much."""
    rng = random.Random(13)
    for _ in range(60):
        a = [rng.choice("abcd ") for _ in range(rng.randrange(200, 1400))]
        b = list(a)
        for _ in range(rng.randrange(len(a) // 2)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randrange(2)] = rng.choice(["", "a", "é"])
        a, b = "".join(a), "".join(b)
        letters, at = np.array(list(b)), np.arange(len(b) + 1)
        row = at
        for i, x in enumerate(a, 1):
            row = np.minimum.accumulate(np.r_[i, np.minimum(row[1:] + 1, row[:-1] + (letters != x))] - at) + at
        for most in (row[-1] - 1, row[-1], row[-1] + 1, int(max(len(a), len(b)) * 0.2)):
            assert within_edits(a, b, int(most)) == within_edits(b, a, int(most)) == (row[-1] <= most)
    lines = ["".join(rng.choice("abcdefgh") for _ in range(60_000)) for _ in range(2)] + ["stshon " * 8_600, "thend " * 10_000]
    began, x, y = time.process_time(), *(random.Random(k).getrandbits(60_000) for k in range(2))
    for _ in range(400_000):
        x ^ y | x & y  # about a third of what the bit vectors of all rows cost
    whole, began = time.process_time() - began, time.process_time()
    assert not within_edits(*lines[:2], 12_000) and not within_edits(*lines[2:], 12_000)
    assert time.process_time() - began < whole


# --- 4 ------------------------------------------------------------------------------------------


def test_best_fit_is_brute_force():
    rng = random.Random(0)
    for _ in range(150):
        lengths = sorted((rng.randrange(1, 50) for _ in range(rng.randrange(1, 40))), reverse=True)
        sources, clusters = ([rng.choice(c) for _ in lengths] for c in ([-1, 0, 0, 1], [-1, -1, 0, 1]))
        bins, want = [], []
        for x in zip(lengths, sources, clusters, strict=True):
            fits = [(50 - sum(y[0] for y in b), i) for i, b in enumerate(bins) if 50 - sum(y[0] for y in b) >= x[0] and not any((x[k] >= 0 and x[k] == y[k]) for y in b for k in (1, 2))]
            at = min(fits)[1] if fits else len(bins)
            if at == len(bins):
                bins.append([])
            bins[at].append(x)
            want.append(at)
        assert best_fit(lengths, sources, clusters, 50)[0] == want


def test_packing_of_repeated_rows(spark):
    rows = spark.range(20_000).selectExpr("cast(7 as bigint) as doc_id", "'the same few words' as text", "'one' as source", "id % 2 as bin_id")
    placed = best_fit_pack(rows, capacity=100, shard_docs=1000)
    got = placed.agg(F.count("*"), F.sum("n_words"), F.count_distinct("bin_id")).first()
    assert tuple(got) == (20_000, 80_000, 20_000)  # one cluster: no two share a bin
    assert placed.groupBy(F.shiftright("bin_id", 32)).count().agg(F.max("count")).first()[0] < 2000


def test_packing_keeps_all_words(spark, sf):
    d = docs(spark, sf)
    placed = best_fit_pack(d, capacity=500, shard_docs=64).toPandas()
    words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in d.collect()}
    assert placed.groupby("doc_id").n_words.sum().to_dict() == words
    assert placed.groupby("bin_id").n_words.sum().max() <= 500
    source = {r.doc_id: r.source for r in d.collect()}
    full = placed[placed.residual.notna()]
    assert not full.assign(s=full.doc_id.map(source)).duplicated(["bin_id", "s"]).any()


# --- 5 ------------------------------------------------------------------------------------------


def test_tiff_round_trips():
    rng = np.random.default_rng(0)
    for compression in (1, 5, 8, 32773, 32946):
        for predictor in (1, 2):
            for tile in (None, (16, 16)):
                for order in "<>":
                    for kind in (np.uint8, np.uint16):
                        images = [rng.integers(0, 4, (33, 21, 3)).astype(kind), np.full((40, 70, 1), 7, kind)]
                        raw = encode(images, compression, predictor, tile, None if tile else 7, order)
                        assert all((a == b).all() for a, b in zip(images, decode(raw), strict=True))
    for bad in (b"", b"II*\0", raw[:40], raw[: len(raw) // 2], raw[:-3]):
        assert list(read_pages(bad))[-1][-1]
    assert list(read_pages(None)) == []


def test_media_query(spark, sf):
    got = {r.doc_id: r for r in queries.op5_tiff_media(spark, sf).collect()}
    for r in docs(spark, sf).collect():
        raw = (r.text or "").encode()
        padded = raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0")
        g = got[r.doc_id]
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))


# --- 6, 10 --------------------------------------------------------------------------------------

PIECES = ["a", "b", "th", "E", " ", "  ", "\n", "'s", "'LL", "'re", "'", "é", "é", "Σ", " the", "!!", "1", "23", " ", "日本", "<|endoftext|>", "\t", "\x1c", "\x85", "İ", ".", "x."]


def odd_texts(n):
    rng = random.Random(2)
    return [(k, "".join(rng.choice(PIECES) for _ in range(rng.randrange(0, 14)))) for k in range(n)]


def test_token_shards(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, rows, start, want = Tokenizer.from_file(path), odd_texts(300), 0, []
    for k, t in rows:
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        want.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = token_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), path).select("doc_id", "start", "n_tokens", F.crc32("ids")).collect()
    assert sorted(map(tuple, got)) == want


def test_elias_fano():
    rng = random.Random(1)
    for n in (0, 1, 2, 300, 1000):
        ends = np.cumsum([rng.choice([0, 1, 5, 1000]) for _ in range(n)]).astype(np.int64)
        read = Boundaries(n, *encode_boundaries(ends))
        assert (read.all() == ends).all()
        assert all(read.select(i) == ends[i] for i in range(n))


def test_prefix_counts(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, rows = Tokenizer.from_file(path), odd_texts(200)
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    for r in token_prefixes(spark.createDataFrame(rows, "doc_id long, text string"), path).collect():
        text, table = rows[r.doc_id][1], bytes(r.prefix)
        assert r.n_tokens == count(text)
        assert all(tokens_at(table, len(text[:i].encode())) == count(text[:i]) for i in range(len(text) + 1))
        assert longest_prefix(table, r.n_tokens) == len(text.encode())


def test_prefix_counts_of_very_long_words():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, count, rng = Tokenizer.from_file(path), PrefixCounter(path), random.Random(2)
    word = "".join(rng.choice("etaoinshrdlu") for _ in range(1 << 20))
    for text in (word, "a" * 100_000, (word[:100_000] + "<|endoftext|>") * 3 + "x", "<|endoftext|>" * 5000, "日本語" * 20_000):
        raw = np.frombuffer(text.encode(), np.uint8)
        got = np.cumsum(count.deltas(raw, np.array([0, len(raw)])), dtype=np.int64)
        for n in (len(text), len(text) // 2, 20_001, 4097):
            assert got[len(text[:n].encode()) - 1] == len(library.encode(text[:n], add_special_tokens=False).ids)


# --- 7, 8 ---------------------------------------------------------------------------------------


def test_language_held_out(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    got = queries.op7_compression_language_id(spark, sf).join(docs(spark, sf).select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_language_edges(edges, empty):
    model = CompressionClassifier({"en": canonical("the of and to in that " * 20), "de": canonical("der die das und ist nicht " * 20)})
    got = {(r.doc_id, r.lang_pred) for r in identify(edges, model).collect()}
    assert {(2, "und"), (3, "und"), (4, "und")} <= got
    assert identify(empty, model).count() == 0
    assert CompressionClassifier({}).predict("words")[0] == "und"


def test_toxicity_gaps_and_inserts():
    rng = random.Random(4)
    clean = [" ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9))) for _ in range(40)) for _ in range(120)]
    toxic = [t.replace(" ", f" {rng.choice(['grobnik', 'fuzzlewump'])} ", 1) for t in clean[:60]]
    model = fit_texts(toxic + clean[60:], [1] * 60 + [0] * 60)
    texts = ["well you g.r.o.b.n.i.k there", "a g r o b n i k", "g * r * o * b * n * i * k", "grobxnik tone", "fuzzlewumps", "nothing to see here", ""]
    raw = [t.encode() for t in texts]
    p = model.probability(model.texts(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])]))
    assert (p[:5] > 0.5).all() and (p[5:] < 0.5).all()


def test_toxicity_without_labels(edges):
    assert {r.predicted for r in score(edges, StringKernelSVM()).collect()} == {0}


def test_with_score_keeps_clashing_columns(spark):
    model = fit_texts(["you grobnik fool here"] * 30 + ["a fine day out there"] * 30, [1] * 30 + [0] * 30)
    rows = [("x", "you grobnik", 1, 0.5, "r"), ("y", None, 2, 0.5, "r")]
    out = with_score(spark.createDataFrame(rows, "_scored string, text string, doc_id long, toxicity double, row string"), model)
    assert out.columns == ["_scored", "text", "doc_id", "row", "toxicity"]
    assert [r[:4] for r in out.orderBy("doc_id").collect()] == [("x", "you grobnik", 1, "r"), ("y", None, 2, "r")]
    assert with_score(out.limit(0), model).count() == 0 and score(out.limit(0), model).count() == 0


# --- 9 ------------------------------------------------------------------------------------------


def test_decontamination(spark):
    bench = spark.createDataFrame([(1, "if anna has 12 apples and Bob gives Carol 5.5 kg of rice how many apples does Bob have left in the end"), (2, "Short item here now"), (3, None)], "item_id long, text string")
    rows = [
        (1, "intro. if anna has 40 apples and Zed gives Maria 7 kg of rice how many apples does Zed have left in the end, ok"),
        (2, "if anna has 40 apples and Zed gives Maria 7 kg of rice how many apples does Tom have left in the end"),
        (3, "if anna has 12 apples and Bob gives Carol 5.5 kg of rice how many apples does Bob have left in the end"),
        (4, None), (5, "short item HERE now"), (5, ""), (6, "an innocent text about rice and apples that shares some words only"),
    ]
    want = [(1, 1, "re-parameterised"), (3, 1, "exact"), (5, 2, "exact")]
    for rows_at_most in (500_000, 0):
        got = decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), bench, broadcast_rows=rows_at_most).collect()
        assert sorted((r.doc_id, r.item_id, r.kind) for r in got) == want


def test_decontamination_names_numbers_and_units(spark):
    """Hand-written: full and accented names, number words and units that change."""
    bench = spark.createDataFrame([
        (1, "every morning the baker Bob Smith sends three trays of rolls to Carol Jones who sells them for 40 cents each at the old market"),
        (2, "in the village José walks 12 km to see Zoë and then they share the bread that his mother made for them"),
    ], "item_id long, text string")
    rows = [
        (1, "every morning the baker Tom Brown sends seven trays of rolls to Mary Ann White who sells them for 3 dollars each at the old market"),
        (2, "in the village Émile walks 7 miles to see Ana and then they share the bread that his mother made for them"),
        (3, "every morning the baker Tom Brown reads the news while his cat sleeps on the warm stones of the oven all day long"),
        (4, ""), (5, None),
    ]
    found = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.kind) for r in decontaminate(found, bench).collect()) == [(1, 1, "re-parameterised"), (2, 2, "re-parameterised")]
    assert decontaminate(found, bench.limit(0)).count() == 0 and decontaminate(found.limit(0), bench, whole=True).count() == 0


def test_decontamination_whole(spark):
    dense = "What is 12 + 7 * 3 - 5 / 2 + 9 * 4 - 6 ?"
    bench = spark.createDataFrame([(1, dense), (2, "Short item here now"), (3, "Add 3 and 4")], "item_id long, text string")
    rows = [(1, f"some words before {dense} and after"), (2, "what is 13 + 7 * 3 - 5 / 2 + 9 * 4 - 8 and more words"), (3, "a long text with a short item HERE now inside of it"), (4, "then add 3 and 4 to get the sum of both"), (5, "then add 3 and 5 to get the sum of both")]
    docs_ = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontaminate(docs_, bench, whole=True).collect()
    assert {(1, 1, "exact"), (3, 2, "exact"), (4, 3, "exact")} <= {(r.doc_id, r.item_id, r.kind) for r in got}
    assert 5 not in {r.doc_id for r in got}
    assert not decontaminate(docs_, bench).where("doc_id in (1, 3, 4)").count()


# --- all ----------------------------------------------------------------------------------------


def operators():
    path = public_tokenizers.path
    return {
        "suffix_dedup": lambda d: suffix_dedup(d, length=20),
        "ngram_join": ngram_jaccard_join,
        "line_dedup": line_dedup,
        "packing": best_fit_pack,
        "tiff": lambda d: pages(text_media(d)),
        "shards": lambda d: token_shards(d, path("word_bpe_49k.json")),
        "prefix": lambda d: token_prefixes(d, path("byte_bpe_50k.json")),
    }


@pytest.mark.parametrize("name", sorted(operators()))
def test_edges(name, edges, empty):
    run = operators()[name]
    assert len(run(edges).collect()) >= len(EDGES)
    assert run(empty).count() == 0


def test_edges_join_matches_brute(edges):
    got = ngram_jaccard_join(edges, width=4, percent=85).collect()
    key = lambda r: str(r)
    want = [(d, n, d if n == 0 else c, k) for d, n, c, k in brute_links(EDGES, 4, 85)]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    d = docs(spark, sf)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, sf)
        assert out.columns == d.columns, name
        assert 0 < out.count() <= d.count()
        d = spark.createDataFrame(out.toPandas(), d.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, d, sf).count() >= d.count()
