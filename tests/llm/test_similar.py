"""SimHash dedup, decontamination and chat collapse against brute force."""

import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from tidewright.llm import chat, common, decontaminate, simhash
from tidewright.llm.common import Scratch, components, read_table


def plain_fingerprint(text, k=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints, radius):
    """Smallest id reachable over links, by breadth-first search over all pairs."""
    n = len(prints)
    near = [[j for j in range(n) if bin(prints[i] ^ prints[j]).count("1") <= radius] for i in range(n)]
    root = [-1] * n
    for i in range(n):
        if root[i] < 0:
            todo, root[i] = [i], i
            while todo:
                for j in near[todo.pop()]:
                    if root[j] < 0:
                        root[j] = i
                        todo.append(j)
    return root


@pytest.mark.parametrize("where", ["odd", "small", "empty"])
def test_simhash_query(spark, request, where):
    path = request.getfixturevalue(where)
    docs = [(r.doc_id, r.text) for r in read_table(spark, path, "documents").select("doc_id", "text").collect()]
    prints = [plain_fingerprint(t) for _, t in docs]
    root = plain_groups(prints, 2)
    least = defaultdict(list)
    for (i, _), r in zip(docs, root):
        least[r].append(i)
    want = Counter((i, f"{p:016x}", min((x for x in least[r] if x is not None), default=None)) for (i, _), p, r in zip(docs, prints, root))
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.op5(spark, path).collect())
    assert got == want


@pytest.mark.parametrize("width,radius", [(1, 0), (1, 2), (1, 7), (4, 42), (2, 100)])
@pytest.mark.parametrize("m", [2, 64, 65, 200])
def test_bit_slices_count_right(width, radius, m):
    rng = np.random.default_rng(m)
    base = rng.integers(0, 2**63, (1, width), dtype=np.uint64)
    noise = rng.random((m, 64 * width)) < 0.6 * radius / (64 * width)
    words = base ^ np.packbits(noise, axis=1, bitorder="little").view("<u8")
    words[m // 2 :] = rng.integers(0, 2**63, (m - m // 2, width), dtype=np.uint64)
    near = simhash.within(words, radius)
    want = np.array([[i != j and sum(int(x).bit_count() for x in words[i] ^ words[j]) <= radius for j in range(m)] for i in range(m)])
    assert (near is None and not want.any()) or np.array_equal(near, want)


def test_exact_tables_catch_all_within_radius():
    rng = random.Random(3)
    tables = simhash.exact_tables(2)
    for _ in range(300):
        flips = set(rng.sample(range(64), rng.randrange(3)))
        assert any(not flips & set(t) for t in tables)


def test_large_buckets_are_sliced(spark, tables, monkeypatch):
    """A group larger than a cell comes out whole."""
    monkeypatch.setattr(simhash, "CELL", 8)
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(400)]
    docs = [(i, " ".join(words[:200] + [f"x{i}"] + words[200:])) for i in range(60)] + [(100 + i, " ".join(rng.sample(words, 60))) for i in range(20)]
    path = tables(docs)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark, read_table(spark, path, "documents")).collect()}
    assert {got[i] for i in range(60)} == {0}
    assert all(got[100 + i] == 100 + i for i in range(20))


@pytest.mark.parametrize("where", ["odd", "small"])
def test_midpoints_link_what_slices_link(spark, request, where, monkeypatch):
    """Every bucket taken through midpoints gives the groups of the brute force."""
    monkeypatch.setattr(simhash, "MANY", 1)
    test_simhash_query(spark, request, where)


def test_twenty_thousand_near_copies_in_one_bucket(spark):
    """Rows named grow with the bucket, not with its square, and all links are kept."""
    rng = random.Random(13)
    base, found = rng.getrandbits(64), set()
    table = simhash.exact_tables(2)[0]
    free = [b for b in range(64) if b not in set(table)]
    while len(found) < 20_000:
        found.add(base ^ sum(1 << b for b in rng.sample(free, rng.choice([3, 4, 9]))))
    prints = sorted(found)
    rows = [(0, i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)]
    hot = spark.createDataFrame(rows, "tab int, node long, f0 long")
    began = time.monotonic()
    scratch = Scratch(spark, "t")
    links = scratch.write(simhash._by_midpoints(scratch, hot, simhash.exact_tables(2), 2), "links")
    got = {r.node: r.root for r in components(scratch, links).collect()}
    assert links.count() <= 33 * len(rows) and time.monotonic() - began < 120
    place = {p: i for i, p in enumerate(prints)}
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    one = [1 << b for b in free]
    near = [*one, *[a | b for k, a in enumerate(one) for b in one[:k]]]
    for p, i in place.items():
        for d in near:
            if (j := place.get(p ^ d)) is not None:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert {i: got.get(i, i) for i in range(len(prints))} == {i: find(i) for i in range(len(prints))}


def test_near_copies_go_and_clean_texts_stay(spark, tables):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefghijklm", k=rng.randint(2, 9))) for _ in range(5000)]
    clean = [rng.choices(vocabulary, k=300) for _ in range(80)]
    copies = []
    for k in range(40):
        words = list(clean[k])
        for at in rng.sample(range(300), 3):
            words[at] = "changed"
        copies.append(words)
    docs = [(i, " ".join(w)) for i, w in enumerate(clean + copies)] + [(900, ""), (901, None)]
    kept = {r.doc_id for r in simhash.drop_near_duplicates(spark, read_table(spark, tables(docs), "documents")).collect()}
    assert set(range(80)) <= kept and {900, 901} <= kept
    assert len(kept & set(range(80, 120))) <= 1


def test_similarity_decides_not_distance(spark, tables):
    """Weighted Jaccard similarity of 0.8 by brute force, short and repetitive texts included."""
    rng = random.Random(21)
    vocabulary = ["".join(rng.choices("abcdefghijklm", k=rng.randint(2, 9))) for _ in range(900)]
    texts = []
    for n in [8, 9, 10, 11, 12, 15, 25, 60, 150] * 4:
        words = rng.choices(vocabulary, k=n)
        texts += [words, [*words, "more"], words[: -max(1, round(n * 0.12))]]
        for share in (0.1, 0.17, 0.22, 0.25, 0.3, 0.45):
            shingles = n - 4
            keep = n - round(shingles * share)  # a common start, then another end
            texts.append(words[:keep] + rng.choices(vocabulary, k=n - keep))
    texts += [["ha", "ho"] * k for k in (20, 21, 22, 24, 40)] + [["word"] * k for k in (5, 50, 55, 65, 100)]
    sets = [Counter(" ".join(t[i : i + 5]) for i in range(len(t) - 4)) for t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if (s := sum((sets[i] & sets[j]).values())) >= 0.8 * (sum(sets[i].values()) + sum(sets[j].values()) - s) - 1e-9]
    root = list(range(len(texts)))
    while any(root[i] != root[j] for i, j in near):
        for i, j in near:
            root[i] = root[j] = min(root[i], root[j])
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark, read_table(spark, tables([(i, " ".join(t)) for i, t in enumerate(texts)]), "documents")).collect()}
    assert got == dict(enumerate(root)) and len(near) > 100


def test_groups_on_given_tables_match_brute_force(spark, small):
    """Weighted Jaccard similarity of five-word shingles over all pairs that share one: every pair from 0.8 on is grouped, and nothing else."""
    path = small.replace("sf0.001", "sf0.01")
    docs = [(r.doc_id, r.text or "") for r in read_table(spark, path, "documents").select("doc_id", "text").collect()]
    words = [t.encode().lower().split() for _, t in docs]
    bags = [Counter([b" ".join(w[i : i + 5]) for i in range(len(w) - 4)] or ([b" ".join(w)] if w else [])) for w in words]
    held = defaultdict(list)
    for i, bag in enumerate(bags):
        for s, n in bag.items():
            held[s].append((i, n))
    shared = Counter()
    for rows in held.values():
        for k, (i, n) in enumerate(rows):
            for j, m in rows[:k]:
                shared[j, i] += min(n, m)
    sizes = [sum(b.values()) for b in bags]
    near = [p for p, w in shared.items() if w >= 0.8 * (sizes[p[0]] + sizes[p[1]] - w) - 1e-9]
    root = list(range(len(docs)))
    while any(root[i] != root[j] for i, j in near):
        for i, j in near:
            root[i] = root[j] = min(root[i], root[j])
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark, read_table(spark, path, "documents")).where("size > 0").collect()}
    grouped = sum(got[docs[i][0]] == got[docs[j][0]] for i, j in near)
    assert len(near) > 50 and grouped >= 0.95 * len(near)
    least = defaultdict(lambda: 1 << 60)
    for (d, _), r in zip(docs, root):
        least[r] = min(least[r], d)
    assert all(least[r] <= got[d] for (d, _), r in zip(docs, root) if d in got)  # never a wider group than the brute force's


def test_components_that_do_not_settle_are_an_error(spark, monkeypatch):
    chain = spark.createDataFrame([(i + 1, i) for i in range(200)], "a long, b long")
    got = {r.node: r.root for r in components(Scratch(spark, "t"), chain).collect()}
    assert got == dict.fromkeys(range(201), 0)
    monkeypatch.setattr(common, "ROUNDS", 2)
    with pytest.raises(RuntimeError):
        components(Scratch(spark, "t"), chain)


def test_components(spark):
    chain = [(i + 1, i) for i in range(40)] + [(100, 7), (200, 201), (201, 202), (500, 500)] + [(1000, 1001 + i) for i in range(50)]
    got = {r.node: r.root for r in components(Scratch(spark, "t"), spark.createDataFrame(chain, "a long, b long")).collect()}
    want = dict.fromkeys([*range(41), 100], 0) | dict.fromkeys([200, 201, 202], 200) | dict.fromkeys(range(1000, 1051), 1000)
    assert got == want


# decontamination


def tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def shingled(words, k=5):
    return [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])


def plain_matches(docs, items):
    out = {}
    for d, text in docs:
        h = shingled(tokens(text))
        for i, item in items:
            g = shingled(tokens(item))
            want, n = Counter(g), len(g)
            if not n:
                continue
            if (len(tokens(item)) < 5) != (len(tokens(text)) < 5) and n == 1:
                continue
            for at in range(len(h) - n + 1):
                shared = sum((Counter(h[at : at + n]) & want).values())
                s = shared / (2 * n - shared)
                if s >= 0.8 and (s, -at) > out.get((d, i), (0, 0)):
                    out[d, i] = (s, -at)
    return {k: (round(s, 9), -at) for k, (s, at) in out.items()}


def test_decontamination_matches_every_window(spark, tables):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choices("abcdefghijklm", k=rng.randint(2, 7))) for _ in range(800)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(6, 70)))) for i in range(25)] + [(90, "tiny item"), (91, items_dup := "a b c d e f g a b c d e f g"), (92, items_dup)]
    docs = []
    for i in range(120):
        words = rng.choices(vocabulary, k=rng.randint(0, 250))
        if i % 2:
            passage = items[rng.randrange(25)][1].split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                passage[rng.randrange(len(passage))] = "edited"
            at = rng.randrange(len(words) + 1)
            words[at:at] = [w.upper() + rng.choice(["", ",", "!"]) for w in passage]
        docs.append((i, "  ".join(words)))
    docs += [(900, "Tiny, item!"), (901, items_dup + " " + items_dup), (902, None), (903, "")]
    path = tables(docs, benchmark=items)
    got = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.window) for r in decontaminate.op1(spark, path).collect()}
    assert got == plain_matches(docs, items)
    assert len(got) > 30


def test_decontamination_of_documents_shorter_than_the_item(spark, tables):
    """A text cut short is found while 0.8 of the item's shingles are there, whether cut in front or behind."""
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdefghijklm", k=rng.randint(2, 7))) for _ in range(800)]
    items = [(n, rng.choices(vocabulary, k=n)) for n in (9, 14, 19, 38, 64)]
    docs, want = [], {}
    for item, words in items:
        n = item - 4
        for cut in range(1, n // 3 + 2):
            for part in (words[cut:], words[:-cut]):
                if n - cut >= 0.8 * n:
                    want[len(docs), item] = (0, n - cut, round((n - cut) / n, 9))
                docs.append((len(docs), " ".join(part)))
    path = tables(docs, benchmark=[(i, " ".join(w)) for i, w in items])
    got = {(r.doc_id, r.item_id): (r.window, r.n_shingles, round(r.similarity, 9)) for r in decontaminate.op1(spark, path).collect()}
    assert got == want and len(want) > 20
    kept = decontaminate.drop_contaminated(spark, read_table(spark, path, "documents"), read_table(spark, path, "benchmark"))
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {i for i, _ in want}


def test_index_blocks_find_all_within_the_radius():
    """Any flips up to the radius leave a block with few enough, and the masks hold them."""
    rng = random.Random(3)
    masks = set(decontaminate.masks())
    assert decontaminate.BLOCK >= 8 and len(masks) == 697
    for _ in range(500):
        flips = sum(1 << b for b in rng.sample(range(128), rng.randint(0, decontaminate.RADIUS)))
        assert any(flips >> 16 * k & 0xFFFF in masks for k in range(decontaminate.BLOCKS))


@pytest.mark.parametrize("wide", [16, 32])
def test_window_fingerprints_match_plain_counts(spark, wide):
    """Rolling counters give each window the majority bits of its own shingles."""
    rng = random.Random(7)
    hashes = [rng.getrandbits(64) - (1 << 63) for _ in range(40)]
    size, starts, low = 9, {5, 8, 9, 22, 36}, 5
    parts = spark.createDataFrame([(1, 1, size, size, 0, low, sorted(starts), hashes), (2, 2, 40, 40, 0, 3, [3], hashes)], "row_id long, doc_id long, n int, size int, part int, low int, windows array<int>, s array<long>")
    second = {r.s: r.t for r in spark.createDataFrame([(h,) for h in hashes], "s long").selectExpr("s", "xxhash64(s, 1) as t").collect()}
    got = {(r.row_id, r.window): (r.f0, r.f1) for r in decontaminate._prints(parts, wide).collect()}

    def plain(xs):
        f = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in xs) > len(xs))
        return f - (1 << 64) if f >> 63 else f

    want = {(1, a): hashes[a - low : a - low + size] for a in starts} | {(2, 3): hashes}
    assert got == {k: (plain(xs), plain([second[h] for h in xs])) for k, xs in want.items()}


def test_decontamination_tells_what_each_step_leaves(spark, small):
    told = {}
    docs, bench = (read_table(spark, small, t) for t in ("documents", "benchmark"))
    found = decontaminate.find_contamination(spark, docs, bench, told=told).count()
    assert told["matches"] == found <= told["candidates"] and told["windows"] > 0


def test_decontamination_odd_rows(spark, odd, empty):
    found = {(r.doc_id, r.item_id) for r in decontaminate.op1(spark, odd).collect()}
    assert found == {(5, 1), (6, 1), (7, 1), (2**40, None)}
    assert decontaminate.op1(spark, empty).count() == 0
    docs = read_table(spark, odd, "documents")
    kept = decontaminate.drop_contaminated(spark, docs, read_table(spark, odd, "benchmark"))
    assert kept.columns == docs.columns and kept.count() == docs.count() - 4


# chats


def plain_chats(rows):
    turns = defaultdict(set)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].add((t is not None, t or 0, role or "", text or ""))
    whole = {c: tuple((x[2], x[3]) for x in sorted(ts)) for c, ts in turns.items()}
    out = {}
    for c, w in whole.items():
        if any(len(o) > len(w) and o[: len(w)] == w for o in whole.values()):
            continue
        same = [d for d, o in whole.items() if o == w]
        if c == min(same):
            out[c] = (len(w), "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in w), len(same))
    return out


def test_chats(spark, tables):
    rng = random.Random(4)
    rows = []
    for c in range(60):
        talk = [(rng.choice(["user", "assistant"]), rng.choice(["hi", "ok", "no", ""])) for _ in range(rng.randint(1, 5))]
        rows += [(c, t, r, x) for t, (r, x) in enumerate(talk)]
    rows += [(100, t, "user", str(t)) for t in range(400)] + [(101, t, "user", str(t)) for t in range(300)]
    rows += [(102, None, "user", "x"), (102, None, "user", "x"), (102, 0, None, None), (None, 0, "user", "lost"), (103, 5, "user", "x"), (103, 9, "", "")]
    got = {r.conv_id: (r.n_turns, r.text, r.n_equal) for r in chat.op4(spark, tables([], conversations=rows)).collect()}
    assert got == plain_chats(rows)


def test_chats_with_other_columns_and_long_texts(spark, tables):
    rows = [(1, 0, "user", "long " * 200_000), (1, 1, "assistant", "ok"), (2, 0, "user", "long " * 200_000), (3, 0, None, None), (3, 0, None, None)]
    table = read_table(spark, tables([], conversations=rows), "conversations")
    more = table.selectExpr("*", "1 as place", "2 as chunk", "'x' as ha", "3 as n", "4 as rank", "5 as base", "6 as n_equal")
    got = {r.conv_id: (r.n_turns, r.text, r.n_equal) for r in chat.format_chats(spark, more).collect()}
    assert got == plain_chats(rows)


def test_chats_on_tables(spark, small, empty):
    rows = [tuple(r) for r in read_table(spark, small, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: (r.n_turns, r.text, r.n_equal) for r in chat.op4(spark, small).collect()}
    assert got == plain_chats(rows)
    assert chat.op4(spark, empty).count() == 0
