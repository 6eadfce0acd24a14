"""Exact operators against brute force on small fixtures."""

import hashlib
import itertools
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnql.llm import common, decontamination, fingerprints, html_text, jaccard_join, packing


def _words(rng, n, size=40):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


# packing


@pytest.mark.parametrize("seed", range(40))
def test_best_fit_decreasing_is_the_greedy_one(seed):
    rng = random.Random(seed)
    capacity = rng.choice([8, 16, 37, 64])
    lengths = [rng.randint(1, capacity) if seed % 2 else rng.choice([1, 2, 3, capacity // 2]) for _ in range(rng.randint(0, 120))]
    rooms = []
    for x in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(rooms) if r >= x]
        if fits:
            rooms[min(fits)[1]] -= x
        else:
            rooms.append(capacity - x)
    counts = Counter(lengths)
    runs, windows = packing.best_fit_decreasing(counts, capacity)
    held, ranks = defaultdict(list), defaultdict(list)
    for length, rank, items, each, window, offset in runs:
        for k in range(items):
            ranks[length].append(rank + k)
            held[window + k // each].append((offset + k % each * length, length))
    assert {x: sorted(r) for x, r in ranks.items()} == {x: list(range(c)) for x, c in counts.items()}
    left = []
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        left.append(capacity - at)
    assert sorted(left) == sorted(rooms) and len(held) == windows


def test_tokens_of_odd_texts():
    own = packing.Encoder(packing.default_tokenizer())
    rng = random.Random(1)
    pool = [" ", " ", " ", "　", "\x85", "\x1c", "\x1f", "​", "́", "é", "ΑΣ", "'s", "'S", "<|endoftext|>", "don't", "İ", "﻿", "\n", "\x00", "\x01", "abc", "12", "!!", "中文", "\U0001f600", "Å"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    assert list(own.encode(texts)) == [own.whole(t) for t in texts]


def test_pieces_round_trip(spark):
    from tokenizers import Tokenizer

    rng = random.Random(4)
    docs = [(i, " ".join(_words(rng, rng.choice([0, 3, 40, 900])))) for i in range(60)]
    got = packing.pack(spark.createDataFrame(docs, "doc_id long, text string"), packing.default_tokenizer(), capacity=256).collect()
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    pieces, rows = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        rows[r["sequence_id"]].append(r)
    for doc_id, text in docs:
        ids, at = [*tokenizer.encode(text, add_special_tokens=False).ids, 1], 0
        for r in sorted(pieces[doc_id], key=lambda r: r["start"]):
            part = ids[r["start"] : r["start"] + r["length"]]
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            at += r["length"]
        assert at == len(ids)
    for parts in rows.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256
    # no two windows are so empty that one would do
    filled = sorted(sum(r["length"] for r in parts) for parts in rows.values())
    assert filled[0] + filled[1] > 256


# decontamination


def test_index_against_brute_force(spark):
    rng = random.Random(2)
    base = _words(rng, 200)
    items = [(i, " ".join(base[s : s + rng.choice([4, 9, 10, 11, 30])])) for i, s in enumerate(range(0, 180, 7))] + [(3, "w1 W2!"), (None, "w5 w6"), (99, "")]
    docs = []
    for i in range(150):
        s = rng.randrange(190)
        docs.append((i, " ".join(_words(rng, rng.randrange(30)) + base[s : s + rng.randrange(25)] + _words(rng, 5))))
    docs += [(150, None), (151, "..."), (152, ", ".join(base).upper())]
    want = decontamination.brute_force(docs, items)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    index = decontamination.build_index(frame)
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in decontamination.report(decontamination.search(index, bench)).collect()}
    assert got == want and sum(v[1] > 0 for v in want.values()) > 30
    assert got[150] == (0, 0, 0, hashlib.sha256(b"").hexdigest())


def test_blocks_and_candidate_parts(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 150)
    rng = random.Random(6)
    items = [(i, " ".join(_words(rng, 12, 3))) for i in range(20)]
    docs = [(i, " ".join(_words(rng, 400, 3))) for i in range(4)]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.report(decontamination.search(decontamination.build_index(frame), bench))
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in found.collect()} == decontamination.brute_force(docs, items)
    monkeypatch.setattr(decontamination, "CANDIDATES", 5)
    query = decontamination.windows([(str(i), t.encode()) for i, t in items])
    own = decontamination.segment([i for i, _ in docs], [t.encode() for _, t in docs])
    got = decontamination.search_segment(query, own)
    want = decontamination.brute_force(docs, items)
    assert [len(h) for h in got["hits"]] == [want[i][1] for i, _ in docs]


@pytest.mark.parametrize("seed", range(6))
def test_proximity_against_brute_force(seed):
    rng = random.Random(seed)
    items = [(i, " ".join(_words(rng, rng.choice([2, 3, 5, 12]), 8))) for i in range(8)] + [(None, "w1 w2"), (9, None)]
    docs = [(i, " ".join(_words(rng, rng.choice([0, 1, 3, 12, 60]), 8))) for i in range(25)]
    query = decontamination.windows([("" if i is None else str(i), None if t is None else t.encode()) for i, t in items], length=4)
    got = decontamination.search_segment(query, decontamination.segment([i for i, _ in docs], [t.encode() for _, t in docs]), slack=2)
    want = decontamination.brute_force_near(docs, items, 4, 2)
    assert [sorted({query["names"][o] for o in s}) for s in got["near"]] == [want[i] for i, _ in docs]


def test_proximity():
    query = decontamination.windows([("a", b"one two three four")], length=4)
    own = decontamination.segment([1, 2, 3], [b"x one two three four", b"one two y three four", b"one two y y y y three four"])
    got = decontamination.search_segment(query, own, slack=2)
    assert [len(h) for h in got["hits"]] == [4, 0, 0] and [len(x) for x in got["near"]] == [1, 1, 0]


# Jaccard join


def _sets(texts):
    out = []
    for t in texts:
        w = common.blank_words(t.encode()) if t else []
        out.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    return out


def _components(ids, texts):
    sets, parent = _sets(texts), {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = root(ids[i]), root(ids[j])
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in zip(ids, sets, strict=True)}


def _near_texts(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(12):
        base = _words(rng, rng.choice([1, 4, 5, 7, 30, 120]), 400)
        for _ in range(rng.randrange(1, 9)):
            own = list(base)
            for _ in range(rng.choice([0, 1, 2, 4])):
                own[rng.randrange(len(own))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(own[: rng.choice([len(own), len(own), max(1, len(own) * 3 // 4)])]))
    passage = " ".join(_words(rng, 60, 400))
    texts += [f"{passage} {' '.join(_words(rng, rng.choice([3, 10, 40]), 10**6))}" for _ in range(12)]
    return texts + ["", None, " \t\n"]


@pytest.mark.parametrize("seed, large", [(0, 256), (1, 2), (2, 4)])
def test_components_against_all_pairs(spark, seed, large):
    texts = _near_texts(seed)
    ids = random.Random(seed).sample(range(1000), len(texts))
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs, large).collect()}
    want = _components(ids, texts)
    assert got == want and len({c for _, c in want.values()}) < len(ids)


def test_large_groups_at_the_default(spark):
    """Over 256 sets share shingles: near copies on both sides of the threshold, and a passage of many short texts."""
    rng = random.Random(11)
    base, passage = _words(rng, 80, 10**6), _words(rng, 40, 10**6)
    texts = []
    for k in range(330):
        own = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 5])):
            own[rng.randrange(len(own))] = f"e{k}x{rng.randrange(10**6)}"
        texts.append(" ".join(own[: rng.choice([80, 80, 70, 60])]))
    texts += [" ".join([*passage, *_words(rng, rng.choice([2, 6, 12, 25]), 10**6)]) for _ in range(300)]
    ids = rng.sample(range(10_000), len(texts))
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs).collect()} == _components(ids, texts)


def test_few_pairs_of_alike_sets_below_the_threshold(spark, monkeypatch):
    """Texts with a word of one base replaced: those with the same word replaced link, all others are alike, but not enough."""
    rng = random.Random(12)
    base, texts = _words(rng, 40, 10**6), []
    for k in range(400):
        own = list(base)
        own[rng.randrange(4, 36)] = f"e{k}"
        texts.append(" ".join(own))
    ids = rng.sample(range(10_000), len(texts))
    second, made = jaccard_join._second_round, []

    def seen(*args):
        out = common.stored(second(*args))
        made.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "_second_round", seen)
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs).collect()}
    want = _components(ids, texts)
    assert got == want and len({c for _, c in want.values()}) == 32
    assert len(made) == 1 and made[0] < 20 * len(texts)


def test_few_pairs_of_one_component(spark, monkeypatch):
    """Near copies of two sizes that meet no common pivots, and all link: not all the links are verified."""
    rng = random.Random(13)
    base, sets = [rng.randrange(1, 2**63) for _ in range(100)], []
    for k in range(400):
        own = set(base) | {rng.randrange(1, 2**63)}
        sets.append(own.difference(rng.sample(base, 2)) if k % 2 else own)
    sets += [set(rng.sample(base, 70)) | {rng.randrange(1, 2**63) for _ in range(30)} for _ in range(40)]
    ids = rng.sample(range(10_000), len(sets))
    group = {i: i for i in ids}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    links = [(x, y) for (x, a), (y, b) in itertools.combinations(zip(ids, sets, strict=True), 2) if 100 * len(a & b) >= 75 * len(a | b)]
    for x, y in links:
        x, y = root(x), root(y)
        group[max(x, y)] = min(x, y)

    def terms(texts):
        found = [sorted(map(int, t.split())) for t in texts]
        return np.array([x for s in found for x in s], np.uint64), np.array([len(s) for s in found], np.int64)

    verified, made = jaccard_join._verified, []

    def seen(rows, blocks, *args):
        blocks = common.stored(blocks)
        made.append(blocks.count())
        return verified(rows, blocks, *args)

    monkeypatch.setattr(jaccard_join, "_verified", seen)
    docs = spark.createDataFrame([(i, " ".join(map(str, s))) for i, s in zip(ids, sets, strict=True)], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs, terms=terms).collect()}
    assert got == {i: root(i) for i in ids} and len(links) > 10_000
    assert sum(made[1:]) < 10 * len(sets), made


@pytest.mark.parametrize("most", [0, 10**6])
def test_components_by_one_task_or_stars(spark, monkeypatch, most):
    monkeypatch.setattr(jaccard_join, "ONE_TASK", most)
    edges = [(1, 2), (2, 3), (3, 1), (-9, -4), (-4, 70), (70, 5), (8, 8)]
    got = {r["node"]: r["component"] for r in jaccard_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {x: got.get(x, x) for x in (1, 2, 3, -9, -4, 70, 5, 8)} == {1: 1, 2: 1, 3: 1, -9: -9, -4: -9, 70: -9, 5: -9, 8: 8}


def test_parity_maps_bound_the_difference():
    rng = np.random.default_rng(6)
    for _ in range(300):
        a = np.unique(rng.integers(0, 2**64, size=rng.integers(1, 400), dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > rng.choice([0, 0.02, 0.3])], rng.integers(0, 2**64, size=rng.integers(0, 20), dtype=np.uint64)]))
        differ = sum((int(x) & 2**64 - 1).bit_count() for x in jaccard_join.parity_map(a) ^ jaccard_join.parity_map(b))
        assert differ <= len(np.setxor1d(a, b)) and (len(np.setxor1d(a, b)) - differ) % 2 == 0


def test_high_counters(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HIGH_LARGE", 0)
    monkeypatch.setattr(jaccard_join, "HIGH_MEAN", 0)
    texts = _near_texts(4)
    ids = random.Random(4).sample(range(1000), len(texts))
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs).collect()} == _components(ids, texts)


def test_trie_overlaps():
    rng = np.random.default_rng(5)
    for _ in range(60):
        own = np.unique(rng.integers(0, 900, size=300)).astype(np.uint64)
        partners = []
        for _ in range(25):
            keep = own[rng.random(len(own)) > rng.choice([0.02, 0.1, 0.3])]
            partners.append(np.unique(np.concatenate([keep, rng.integers(0, 900, size=rng.integers(0, 60)).astype(np.uint64)])))
        partners.sort(key=lambda s: s.astype(">u8").tobytes())
        want = [100 * len(np.intersect1d(own, s)) >= 75 * len(np.union1d(own, s)) for s in partners]
        assert jaccard_join.trie_overlaps(own, partners) == want


def test_bounds():
    for a in range(1, 40):
        assert jaccard_join.prefix_length(a) == min(a - next(o for o in range(a + 1) if 100 * o >= 75 * a) + 1, a)
        for b in range(a, 40):
            assert jaccard_join.needed(a, b) == next(o for o in range(a + b) if 100 * o >= 75 * (a + b - o))


def test_star_contraction(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(90), rng.randrange(90)) for _ in range(50)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in jaccard_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == root(x) for x in parent)


# fingerprints


def test_fingerprints_against_plain_text(spark):
    rng = random.Random(3)
    pool = ["the", "of", "and", "é", "中", "x", "y", "z\n", "\U0001f600"]
    docs = [(i * 3 - 20, "".join(rng.choice(pool) + rng.choice(["", " "]) for _ in range(rng.choice([0, 1, 2, 9, 60])))) for i in range(70)]
    got = {r["doc_id"]: r for r in fingerprints.fingerprint(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    docs.sort()
    for (doc_id, text), (_, after) in zip(docs, [*docs[1:], docs[0]], strict=True):
        n = len(text) // 2
        new = text[: len(text) - n] + after[:n]
        a, b, c = (fingerprints.signatures(t.encode()) for t in (text, new, after))
        want = (len(text), hashlib.sha256(new.encode()).hexdigest(), fingerprints.encode(a), fingerprints.encode(b), len(a & b) / len(a | b), len(a & c) / len(a | c))
        assert tuple(got[doc_id][c] for c in ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")) == want


@pytest.mark.parametrize("groups, size", [(12, 5), (2, 60)])
def test_near_classes_against_all_pairs(spark, groups, size):
    rng = random.Random(groups)
    docs = []
    for g in range(groups):
        base = [w for _ in range(rng.choice([3, 20, 40])) for w in (rng.choice(["the", "of", "and"]), *_words(rng, 2, 10**5))]
        for _ in range(rng.randint(1, size)):
            own = [w if rng.random() > 0.04 else f"e{rng.randrange(10**6)}" for w in base]
            docs.append((len(docs) * 7 % 1009, " ".join(own)))
    docs += [(2000, ""), (2001, None), (2002, "no anchors here"), (2003, "no anchors here")]
    sets = [fingerprints.signatures((t or "").encode()) for _, t in docs]
    parent = {i: i for i, _ in docs}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for i, a in enumerate(sets):
        for j in range(i):
            if fingerprints.likeness(a, sets[j]) >= 0.75:
                x, y = root(docs[i][0]), root(docs[j][0])
                parent[max(x, y)] = min(x, y)
    got = {r["doc_id"]: r["near_class"] for r in fingerprints.fingerprint(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert got == {i: root(i) for i, _ in docs} and got[2001] == 2000 and got[2003] == 2002


def test_near_pairs_against_all_pairs(spark):
    rng = random.Random(9)
    sets = []
    for _ in range(15):
        base = [rng.getrandbits(32) for _ in range(rng.choice([1, 3, 20, 60]))]
        sets += [frozenset(x for x in base if rng.random() > 0.08) | {rng.getrandbits(32)} if k else frozenset(base) for k in range(4)]
    sets.append(sets[0])
    prints = [(i, fingerprints.encode(s)) for i, s in enumerate(sets)]
    got = {(r["doc_a"], r["doc_b"]): r["likeness"] for r in fingerprints.near_pairs(spark.createDataFrame(prints, "doc_id long, fingerprint string")).collect()}
    first = {}
    for i, p in prints:
        first.setdefault(p, i)
    reps = sorted(first.values())
    want = {(a, b): x for a in reps for b in reps if a < b and (x := fingerprints.likeness(sets[a], sets[b])) >= 0.75}
    assert got == pytest.approx(want) and want


# pages

ARTICLE = "<h1>Ti&amp;tle</h1><p>Hello   <b>wo</b>rld &lt;x&gt;<p>Second\npara</p>"


def _page(i, body):
    return f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><a href=/>Home</a></nav><div class='ad-{i}'>Buy {i}</div>{body}<footer>(c) site</footer></body></html>"


def test_main_text(spark):
    plain = f"<article>{ARTICLE}<div class='comments'><p>nice {{}}</p></div></article>"
    div = f"<div class='post-body'>{ARTICLE}</div><div class='sidebar'>Side {{}}</div><div class='cookie-notice'>We use cookies</div><form>Name <input></form>"
    pages = [(i, f"http://a.example/{i}", _page(i, plain.format(i))) for i in range(12)] + [(i, f"https://user@B.example:8080/{i}", _page(i, div.format(i))) for i in range(20, 32)]
    bare = "<div><p>" + "Running text goes on and on. " * 5 + "</p><p>And more of it.</p></div>"
    pages.append((50, "http://c.example/", f"<div><ul><li><a>One</a><li><a>Two</a></ul></div>{bare}"))
    got = {r["page_id"]: r for r in html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)).collect()}
    for i in [*range(12), *range(20, 32)]:
        assert got[i]["text"] == "Ti&tle Hello world <x> Second para" and got[i]["n_chars"] == 34
    assert got[50]["text"] == ("Running text goes on and on. " * 5 + "And more of it.")


def test_wrapper_alignment():
    one = html_text.pattern("<ul><li>a<li>b</ul><p>x</p>")
    two = html_text.pattern("<ul><li>c</ul><h2>new</h2><p>x</p>")
    got = html_text.merge(one, two)
    ul, h2, p = got.children
    assert (ul.label, h2.label, p.label) == ("ul", "h2", "p")
    assert ul.children[0].repeated and h2.optional and not p.optional
    assert p.children[0].text == "x" and ul.children[0].children[0].text is None
    assert html_text.Node.unpack(got.pack()).pack() == got.pack()


@pytest.mark.parametrize("page, text", [("", ""), ("plain", "plain"), ("<p>unclosed", "unclosed"), ("<!-- x", ""), ("<script>a", ""), ("< 3 <b", "< 3 <b"), ("a<br>b<i>c</i>d", "a bcd"), ("<p>&nbsp;x &eacute;&#x41;&#66;</p>", "x éAB")])
def test_odd_markup(page, text):
    assert html_text.extract(page, frozenset(html_text.main_slots(html_text.pattern(page)))) == text


def test_layouts_of_a_host(spark):
    words = "Running text number {} goes on and on. " * 5
    marked = [(i, _page(i, f"<article><p>{words.format(*[i] * 5)}</p></article>")) for i in range(20)]
    other = [(i, _page(i, f"<h1>Title {i}</h1><div class='one'><p>{words.format(*[i] * 5)}</p></div><div class='two'><p>Rest {i}</p></div>")) for i in range(20, 24)]
    third = [(30, _page(30, "<p>alone</p>"))]
    for url in ("http://a.example/{}", None):
        pages = [(i, url and url.format(i), html) for i, html in marked + other + third]
        got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
        assert all(got[i] == words.format(*[i] * 5).strip() for i in range(20))
        assert all(got[i] == f"Title {i} {words.format(*[i] * 5)}Rest {i}" for i in range(20, 24))
        assert got[30] == "alone"


def test_page_without_text_in_its_slots():
    assert html_text.page_text("<div><p>own text</p></div>", frozenset(["html/body/p"])) == "own text"


@pytest.mark.parametrize("n", [2, 7, 8, 20])
def test_text_seen_once_is_no_template(n):
    pages = [f"<div class='top'>Our site</div><p>Text {i} goes on.</p>" + (f"<blockquote>Only here</blockquote><div class='only-{'abcd'[i]}'>Mine</div>" if i < 1 else "") for i in range(n)]
    wrapper = html_text.pattern(pages[0])
    for page in pages[1:]:
        wrapper = html_text.merge(wrapper, html_text.pattern(page))
    slots = frozenset(html_text.main_slots(wrapper))
    assert html_text.extract(pages[0], slots) == "Text 0 goes on. Only here Mine"
    assert html_text.extract(pages[1], slots) == "Text 1 goes on."


def test_template_text_of_all_layouts():
    wrappers = [html_text.pattern(f"<div class='top'>Our site</div><{tag}>x {i}</{tag}>") for i, tag in enumerate(("p", "h2", "pre"))]
    assert html_text.template_paths(wrappers) == {("div.top",)}
    assert html_text.template_paths(wrappers[:1]) == set()


def test_texts_with_one_beginning_differ():
    lead = "BERLIN, Monday. " * 6
    pages = [f"<div class='top'>{lead}</div><p>{lead}then {i}</p><p class='b'>x <b>{lead}</b> y {i}</p>" for i in range(9)]
    wrapper = html_text.pattern(pages[0])
    for page in pages[1:]:
        wrapper = html_text.merge(wrapper, html_text.pattern(page))
    assert html_text.extract(pages[3], frozenset(html_text.main_slots(wrapper))) == f"{lead}then 3 x {lead}y 3"


@pytest.mark.parametrize("seed", range(8))
def test_longest_common_sequence(seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(html_text, "CELLS", rng.choice([1, 6, 40, 4096]))
    for _ in range(60):
        left, right = ([rng.choice("abcd"[: rng.randint(1, 4)]) for _ in range(rng.randrange(18))] for _ in range(2))
        best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
        for i, a in enumerate(left):
            for j, b in enumerate(right):
                best[i + 1][j + 1] = best[i][j] + 1 if a == b else max(best[i][j + 1], best[i + 1][j])
        got = html_text.common_labels(left, right)
        assert len(got) == best[-1][-1] and all(left[i] == right[j] for i, j in got)
        assert all(a < c and b < d for (a, b), (c, d) in zip(got, got[1:]))


def test_wide_pages_align():
    rng = random.Random(1)
    one, two = (["abcdefg"[rng.randrange(7)] for _ in range(4000)] for _ in range(2))
    assert len(html_text.common_labels(one, two)) > 2000


@pytest.mark.parametrize("depth", [0, 10, 70, 300])
def test_deep_pages(depth):
    page = "<div>" * depth + "<article>Body<aside>Not</aside> text</article><nav>menu <a>link</a></nav><footer>copyright foot</footer>" + "</div>" * depth
    assert html_text.page_text(page, frozenset(html_text.main_slots(html_text.pattern(page)))) == "Body text"


@pytest.mark.parametrize("n", [3, 7, 8, 9])
def test_unmarked_paragraphs_with_one_beginning(spark, n):
    lead = "The same eighty-eight characters stand at the beginning of each of these paragraphs here. "
    pages = [(i, f"http://x.example/{i}", f"<html><body><div class='top'>Our site</div><div><p>{lead}Number {i} differs.</p><p>Rest {i}.</p></div></body></html>") for i in range(n)]
    got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)).collect()}
    # the wrapper makes the difference: a page alone doesn't tell that its first text is the site's
    assert got == {i: f"{lead}Number {i} differs. Rest {i}." for i in range(n)}
    assert html_text.page_text(pages[0][2], frozenset()).startswith("Our site")


@pytest.mark.parametrize("ids", [[None] * 40, [7] * 40, [3] * 20 + [None] * 20, list(range(5)) * 8])
def test_fingerprints_of_hot_ids(spark, ids):
    rng = random.Random(2)
    docs = [(i, f"the word{rng.randrange(30)} of a thing{rng.randrange(9)}") for i in ids]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    blocks = fingerprints._blocks(frame).groupBy("block").count().collect()
    assert len(blocks) > 3
    order = [(r["doc_id"], r["text"]) for r in frame.withColumn("h", F.xxhash64("text")).orderBy(F.col("doc_id").asc_nulls_first(), "h", "text").collect()]
    want = []
    for (i, text), (_, after) in zip(order, [*order[1:], order[0]], strict=True):
        want.append((i, hashlib.sha256(fingerprints.edited(text.encode(), after.encode())).hexdigest()))
    got = [(r["doc_id"], r["edited_sha256"]) for r in fingerprints.fingerprint(frame).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("bounds", [[], [5], [-(2**63), -7, 0, 3, 2**53, 2**53 + 1, 2**63 - 1], list(range(-30, 2000, 3))])
def test_search_of_blocks_has_one_size(spark, bounds):
    ids = sorted({max(-(2**63), min(2**63 - 1, b + d)) for b in bounds for d in (-1, 0, 1)} | {0})
    found = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", fingerprints._search("doc_id", bounds).alias("block"))
    assert [r["block"] for r in found.orderBy("doc_id").collect()] == [sum(b < i for b in bounds) for i in ids]
    # the driver holds each plan, and its text, as often as the plan changes
    assert found._jdf.queryExecution().executedPlan().toString().upper().count("WHEN") <= 2


def test_fingerprints_with_other_quantiles_each_time(spark, monkeypatch):
    whole, calls = F.percentile_approx, []

    def percentile(col, shares, accuracy):  # approximate quantiles may differ from one run to the next
        calls.append(1)
        return whole(col, [x ** len(calls) for x in shares], accuracy)

    monkeypatch.setattr(fingerprints.F, "percentile_approx", percentile)
    docs = [(i, f"the word{i} of a thing{i % 9}") for i in range(80)]
    got = {r["doc_id"]: r["edited_sha256"] for r in fingerprints.fingerprint(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    assert got == {i: hashlib.sha256(fingerprints.edited(text.encode(), docs[(i + 1) % 80][1].encode())).hexdigest() for i, text in docs}


def _compact(pages):
    wrapper = html_text.pattern(pages[0])
    for page in pages[1:]:
        wrapper = html_text.merge(wrapper, html_text.pattern(page))
    return html_text.compact(wrapper, html_text.template_paths([wrapper]), wrapper.pages)


def test_wrapper_tells_slots_of_one_path_apart():
    """Only the aligned pattern tells the site's line from the article's: both have one path and no name."""
    pages = [f"<div>Welcome to our site</div><h2>News {i}</h2><div>Article number {i} has this text.</div><ul><li>Point {i}</ul>" for i in range(6)]
    pages.append("<div>Welcome to our site</div><p>Odd element</p><div>Short one.</div>")
    found = _compact(pages)
    assert html_text.matched(pages[2], found) == "News 2 Article number 2 has this text. Point 2"
    # an optional heading left out, and an element that the pattern lacks on other pages
    assert html_text.matched(pages[6], found) == "Odd element Short one."
    assert html_text.matched("<div>Welcome to our site</div><h2>New</h2><div>Text.</div><table><tr><td>Unseen</table>", found) == "New Text. Unseen"
    assert html_text.page_text(pages[2], frozenset()).startswith("Welcome")


def test_optional_and_repeated_elements():
    pages = [f"<article><h1>T{i}</h1>{'<p>x</p>' * (i + 1)}{'<pre>code</pre>' if i % 2 else ''}<p>end {i}</p></article><nav>menu</nav>" for i in range(4)]
    found = _compact(pages)
    for i, page in enumerate(pages):
        assert html_text.matched(page, found) == " ".join([f"T{i}", *["x"] * (i + 1), *["code"] * (i % 2), f"end {i}"])
    assert html_text.matched("<article><h1>T</h1><p>a</p><pre>b</pre><p>c</p><pre>d</pre></article><nav>menu</nav><nav>again</nav>", found) == "T a b c d"
    assert html_text.matched("<nav>only <b>this</b></nav><footer>unseen</footer>", found) == ""


@pytest.mark.parametrize("seed", range(5))
def test_marked_pages_lose_nothing_to_the_wrapper(seed):
    """Random articles on one host: the wrapper gives what a plain walk over each article gives."""
    rng = random.Random(seed)

    def block(depth):
        tag = rng.choice(["p", "div", "section", "blockquote", "ul", "table"])
        if tag == "ul":
            return "<ul>" + "".join(f"<li>{word()}" for _ in range(rng.randint(1, 3))) + "</ul>"
        if tag == "table":
            return "<table><tr>" + "".join(f"<td>{word()}" for _ in range(rng.randint(1, 3))) + "</table>"
        if depth and tag != "p" and rng.random() < 0.5:
            return f"<{tag}>{word()}{block(depth - 1)}{word()}{block(depth - 1)}</{tag}>"
        return f"<{tag}>{word()} <b>{word()}</b>{word()}</{tag}>"

    def word():
        text = " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randint(1, 4)))
        own.append(text)
        return f" {text} "

    pages, wants = [], []
    for _ in range(30):
        own: list[str] = []
        body = "".join(block(2) for _ in range(rng.randint(1, 5)))
        pages.append(f"<header>site</header><main>{body}<aside>not this</aside></main><footer>foot</footer>")
        wants.append(" ".join(own))
    found = _compact(pages)
    assert [html_text.matched(p, found) for p in pages] == wants


def test_workers_forget():
    big = common.remembered("a", lambda: common.Words(len))
    assert big[b"word"] == 4 and common.remembered("a", lambda: 0) is big
    common.forget()
    common.forget()  # with nothing to forget
    assert common.remembered("a", lambda: 5) == 5
    common.remembered("b", lambda: 6)
    assert common.remembered("a", lambda: 7) == 7  # another key's memory went first


def test_chunk_memory_changes_no_ids():
    draw = random.Random(1)
    texts = [" ".join("".join(draw.choices("abcdé", k=draw.randint(1, 9))) for _ in range(200)) for _ in range(40)]
    wide, narrow = packing.Encoder(packing.default_tokenizer()), packing.Encoder(packing.default_tokenizer(), 1000)
    want = [wide.whole(t) for t in texts]
    assert list(wide.encode(texts)) == want
    assert [ids for t in texts for ids in narrow.encode([t])] == want


def test_stored_writes_in_small_batches(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64()), "size": pa.array([batch.nbytes], pa.int64())})

    before = spark.conf.get(common.BATCH_SETTING)
    rows = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("text "), 1000).alias("text")).mapInArrow(sizes, "n long, size long")
    got = common.stored(rows).collect()
    assert sum(r["n"] for r in got) == 4000 and len(got) > 1
    assert max(r["size"] for r in got) < 2 * common.SLICE_BYTES
    assert spark.conf.get(common.BATCH_SETTING) == before
    with pytest.raises(Exception, match="(?i)divi"):
        common.stored(spark.range(3).select(F.expr("raise_error('division')").alias("x")))
    assert spark.conf.get(common.BATCH_SETTING) == before


def test_pipeline_stages_begin_on_small_heaps(spark, monkeypatch):
    import gc

    import corpus_pipeline

    jvm = spark.sparkContext._jvm
    ref = jvm.java.lang.ref.WeakReference(jvm.java.util.ArrayList())
    gc.collect()
    common.collected(spark)
    assert ref.get() is None
    got = spark.range(0, 2, 1, 2).select(F.expr("java_method('java.lang.System', 'gc')")).collect()
    assert len(got) == 2
    began, collected = [], common.collected
    monkeypatch.setattr(common, "collected", lambda s: (began.append(1), collected(s)))
    docs = spark.createDataFrame([(1, "some words of a text")], "doc_id long, text string")
    assert corpus_pipeline.packing_stage(spark, docs, "").count() == 1 and began == [1]
    assert len(corpus_pipeline.STAGES) == 5 and all(hasattr(stage, "__wrapped__") for _, stage in corpus_pipeline.STAGES)
