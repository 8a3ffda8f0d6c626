"""Tokenizers, packing, near-duplicates and the suffix tree against plain versions."""

import base64
import collections
import functools
import hashlib
import json
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from songloom.llm import byte_bpe, packing, simhash, suffix_tree
from songloom.llm.common import cut_lineage, parts_of
from tests.llm import cases

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
WHOLE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
DEFINITION = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
WORD_BPE = Tokenizer.from_str(DEFINITION)
WORDS = packing.WordTokenizer(DEFINITION)
TEXT = st.text(st.one_of(st.sampled_from(list(" \n\t' \x1c\x85sStTve.,!09éßÀ÷ªİΣ́abc<|>")), st.characters(exclude_categories=["Cs"])), max_size=40)


def key(row):
    return tuple((x is None, str(type(x)), x if x is not None else 0) for x in row)


def same(ours, theirs):
    assert sorted(map(tuple, ours), key=key) == sorted(map(tuple, theirs), key=key)


@given(TEXT)
@settings(max_examples=400, deadline=None)
def test_words_encode_apart(text):
    words = byte_bpe.space_words(text)
    assert "".join(map(byte_bpe.literal, words)) == text
    assert [i for w in words for i in WHOLE.encode_ordinary(byte_bpe.literal(w))] == WHOLE.encode_ordinary(text)


@given(TEXT)
@settings(max_examples=400, deadline=None)
def test_word_tokenizer_gives_the_same_ids(text):
    assert np.frombuffer(WORDS.encode([text])[0], dtype=np.uint32).tolist() == WORD_BPE.encode(text, add_special_tokens=False).ids


def test_every_vocabulary_entry_encodes_to_itself():
    letters = {c: bytes([b]) for b, c in packing.byte_letters().items()}
    wrong = []
    for token, i in json.loads(DEFINITION)["model"]["vocab"].items():
        if token.startswith("<|"):
            continue
        ended = token.endswith("</w>")
        raw = b"".join(letters[c] for c in (token[:-4] if ended else token)) + (packing.MARK if ended else b"")
        if [int(WORDS.id_of[r]) for r in WORDS.merger._core_bpe.encode_single_piece(raw)] != [i]:
            wrong.append(token)
    assert wrong == ["Ā</w>"]  # the byte 0, which plain words lack


def test_byte_bpe(spark):
    found = byte_bpe.decode(byte_bpe.encode(cases.docs(spark))).collect()
    same([(r.doc_id, r.ids, bytes(r.decoded)) for r in found], [(r[0], WHOLE.encode_ordinary(r[1] or ""), (r[1] or "").encode()) for r in cases.rows()])
    assert byte_bpe.decode(byte_bpe.encode(cases.none(spark))).count() == 0


def test_packing(spark):
    found = packing.pack(packing.pieces(cases.docs(spark), capacity=64, keep_ids=True), capacity=64, max_docs=5, max_cost=3000.0).collect()
    expected = []
    for r in cases.rows():
        ids = WORD_BPE.encode(r[1] or "", add_special_tokens=False).ids + [1]
        for n, a in enumerate(range(0, len(ids), 64)):
            own = ids[a : a + 64]
            expected.append((r[0], n, a, len(own), zlib.crc32(np.array(own, dtype="<u4").tobytes())))
    same([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found], expected)
    bins = collections.defaultdict(list)
    for r in found:
        bins[r.sequence_id].append(r)
        assert zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32
    for rows in bins.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == [0, *np.cumsum([r.length for r in rows])[:-1].tolist()]
        assert sum(r.length for r in rows) <= 64 and len(rows) <= 5
        assert len(rows) == 1 or sum(r.length**2 for r in rows) <= 3000
    assert packing.pack(packing.pieces(cases.none(spark))).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_is_tight(rule):
    lengths = np.random.default_rng(1).integers(1, 2000, 3000)
    bins, _ = packing.best_fit(lengths, 4096, 4096, 4096.0**2, rule=rule)
    assert len(set(bins.tolist())) <= (1.01 if rule == "norm" else 1.1) * lengths.sum() / 4096 + 1


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, bits=4):
    values = sorted(set(prints))
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= bits and find(i) != find(j):
                root[find(i)] = find(j)
    return {v: values[find(i)] for i, v in enumerate(values)}


def test_simhash(spark):
    found = simhash.near_duplicates(cases.docs(spark)).collect()
    prints = [plain_print(r[1]) for r in cases.rows()]
    root = plain_components(prints)
    least = {}
    for r, p in zip(cases.rows(), prints):
        if r[0] is not None:
            least[root[p]] = min(least.get(root[p], r[0]), r[0])
    same([(r.doc_id, r.fp % 2**64, r.component_id) for r in found], [(r[0], p, least[root[p]]) for r, p in zip(cases.rows(), prints)])
    assert simhash.near_duplicates(cases.none(spark)).count() == 0


@pytest.mark.parametrize("blocks,cell", [(3, 20_000), (2, 20_000), (3, 25)])
def test_links_lose_nothing(spark, monkeypatch, blocks, cell):
    """A chain, a dense cluster, and single ones; also with anchors cut into cells."""
    monkeypatch.setattr(simhash, "CELL", cell)
    rng = np.random.default_rng(7)
    values = [int(x) for x in rng.integers(0, 2**63, 60)]
    center = values[0]
    values += [center ^ 1 << int(a) ^ 1 << int(b) for a, b in rng.integers(0, 64, (80, 2))]
    for _ in range(12):
        values.append(values[-1] ^ sum(1 << int(b) for b in rng.choice(64, 4, replace=False)))
    signed = [v - 2**64 if v >= 2**63 else v for v in sorted(set(values))]
    prints = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    edges = simhash.links(prints, 4, blocks)
    got = {r.node % 2**64: r.root % 2**64 for r in simhash.components(edges).collect()}
    expected = plain_components(values)
    clusters = collections.defaultdict(set)
    for v in set(values):
        clusters[got.get(v, v)].add(v)
    truth = collections.defaultdict(set)
    for v, r in expected.items():
        truth[r].add(v)
    assert sorted(map(sorted, clusters.values())) == sorted(map(sorted, truth.values()))


def test_suffix_tree(spark):
    found = suffix_tree.score(cases.docs(spark)).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "")), None] for r in cases.rows()]
    counts = collections.Counter(w for r, ws in zip(cases.rows(), tokens) if not held(r[0]) for w in ws)
    n, v = sum(counts.values()), len(counts)
    expected = [(r[0], held(r[0]), len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 5)) for r, ws in zip(cases.rows(), tokens)]
    same([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in found], expected)
    assert all(r.score < 0 and math.isfinite(r.score) for r in found)
    assert suffix_tree.score(cases.none(spark)).count() == 0


def test_tree_distributions_add_up_and_learn_contexts():
    counts = np.zeros((suffix_tree.K,) * 2, dtype=np.int64)
    counts[2, 3], counts[4, 5], counts[8, 9] = 500, 500, 3
    p = 10 ** suffix_tree.short_contexts(counts, 50, 8.0, 20.0)[0]
    assert np.allclose(p.sum(axis=1), 1)
    assert p[2, 3] > 0.9 and p[4, 5] > 0.9
    assert np.allclose(p[8], p[0])  # too rare: the empty context


def plain_tree_scores(rows, share, min_count=2, divergence=2.0, prior=50.0, depth=4):
    """Scores by a plain suffix tree over the same symbols; contexts above ``share`` are common. Also the contexts of each length kept."""
    words_of = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    count = collections.Counter(w for i, t in rows if not held(i) for w in words_of(t))
    alone = {w: i for i, w in enumerate(sorted(count, key=lambda w: (-count[w], w))[: suffix_tree.TOP])}
    symbol = lambda w: alone.get(w, suffix_tree.TOP + zlib.crc32(w[-2:].encode()) % suffix_tree.ENDINGS)
    tokens, kinds = collections.Counter(), collections.Counter()
    for w, n in count.items():
        if w not in alone:
            tokens[symbol(w)] += n
            kinds[symbol(w)] += 1
    following = collections.defaultdict(collections.Counter)
    series = lambda t: [symbol(w) for w in words_of(t)] + [suffix_tree.END]
    for i, t in rows:
        if not held(i):
            seq = [suffix_tree.END] * depth + series(t)
            for at in range(depth, len(seq)):
                for d in range(depth + 1):
                    following[d, tuple(seq[at - d : at])][seq[at]] += 1

    @functools.cache
    def p(context, nxt):
        c = following.get((len(context), context), {})
        if not context:
            return (c.get(nxt, 0) + 1) / (sum(c.values()) + suffix_tree.K) if c else 1 / suffix_tree.K
        return (c.get(nxt, 0) + prior * p(context[1:], nxt)) / (sum(c.values()) + prior)

    def passes(context):
        c = following.get((len(context), context), {})
        n = sum(c.values())
        return n >= min_count and sum(x * math.log(x / n / p(context[1:], nxt)) for nxt, x in c.items()) >= divergence

    kept = {c for d, c in following if d >= 1 and (passes(c) or 2 <= d < depth and sum(following[d, c].values()) > share)}
    out = []
    for _, t in rows:
        seq, total = [suffix_tree.END] * depth + series(t), 0.0
        for at in range(depth, len(seq)):
            context = next((tuple(seq[at - d : at]) for d in range(depth, 0, -1) if tuple(seq[at - d : at]) in kept), ())
            total += math.log10(p(context, seq[at]))
        for w in words_of(t):
            if w not in alone:
                total += math.log10((count[w] + 1) / (tokens[symbol(w)] + kinds[symbol(w)] + 1))
        out.append((total, len(seq) - depth))
    return out, collections.Counter(map(len, kept)), following


def tree_fixture():
    """Sentences of a small grammar, so that long contexts tell, and one passage that holds a third of all tokens."""
    rng = random.Random(2)
    names = [f"w{i}{'abcdefgh'[i % 8]}" for i in range(150)]
    paths = [[rng.choice(names) for _ in range(8)] for _ in range(12)]
    texts = []
    for _ in range(220):
        words = []
        for _ in range(rng.randint(0, 5)):
            path = rng.choice(paths)
            words += path if rng.random() < 0.8 else [*path[:4], rng.choice(names), *path[5:]]
        texts.append(" ".join(words))
    texts += ["tick " * 1400, "tick " * 1400, "so tick " + "tick " * 1400, None, "", "  ", "Tick"]
    return [(i, t) for i, t in enumerate(texts)] + [(None, "tick tock"), (5, texts[5])]


@pytest.mark.parametrize("parts", [1, 5])
def test_scores_are_those_of_a_plain_suffix_tree(spark, parts):
    rows = tree_fixture()
    table = cut_lineage(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts), "tree-test")
    buckets = parts_of(table)
    tokens = sum(len((t or "").split()) + 1 for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2)
    expected, kept, following = plain_tree_scores(rows, max(tokens // buckets, 2))
    assert all(kept[d] for d in range(1, 5))
    assert any(sum(c.values()) > tokens // buckets for (d, _), c in following.items() if d == 3)  # a common context of three
    found = suffix_tree.score(table).collect()
    assert len(found) == len(rows)
    told = collections.defaultdict(list)
    for r in found:
        told[r.doc_id].append(r.score)
    for (i, t), (score, n) in sorted(zip(rows, expected), key=lambda x: x[1][0]):
        near = min(told[i], key=lambda x: abs(x - score))
        assert abs(near - score) <= n * 0.6 / suffix_tree.STEPS + 1e-6, (i, t, near, score)
        told[i].remove(near)


def test_held_out_texts_score_better_than_by_counts_and_pairs(spark):
    """Better than word counts, and than word pairs smoothed by them."""
    from songloom.llm.common import read_table

    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    rows = [r for r in suffix_tree.score(docs).collect() if r.held_out]
    held = {r.doc_id for r in rows}
    words = {r.doc_id: [*re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").lower()), None] for r in docs.select("doc_id", "text").collect()}
    count, pairs = collections.Counter(), collections.Counter()
    for i, ws in words.items():
        if i not in held:
            count.update(ws)
            pairs.update(zip([None, *ws], ws))
    n, v = sum(count.values()), len(count)
    by_pairs = sum(math.log10((pairs[a, w] + 5 * (count[w] + 1) / (n + v + 1)) / (count[a] + 5)) for i in held for a, w in zip([None, *words[i]], words[i]))
    score, base = sum(r.score for r in rows), sum(r.base_score for r in rows)
    assert score > by_pairs > base


def test_digests(spark):
    from songloom.llm.queries import op5_byte_bpe
    from songloom.llm.common import read_table

    texts = {r.doc_id: r.text or "" for r in read_table(spark, "/root/testdata/sf0.001", "documents").collect()}
    for r in op5_byte_bpe(spark, "/root/testdata/sf0.001").collect():
        ids = WHOLE.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
