"""Exact dedup, sharding, token files and packing against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidewright.llm import decontaminate, exact_dedup, packing, quality, shard, simhash, token_files
from tidewright.llm.common import Scratch, numbered, read_table

SPACES = re.compile(r"[\x20\x09-\x0D]+")


def texts(spark, path):
    return [(r.doc_id, r.text) for r in read_table(spark, path, "documents").select("doc_id", "text").collect()]


@pytest.mark.parametrize("where", ["odd", "small", "empty"])
def test_exact_dedup_matches_grouping(spark, request, where):
    path = request.getfixturevalue(where)
    docs = [(i, SPACES.sub(" ", t or "")) for i, t in texts(spark, path)]
    groups = defaultdict(list)
    for i, t in docs:
        groups[t].append(i)
    want = Counter()
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        for n, i in enumerate(sorted(ids, key=lambda i: (i is None, i or 0))):
            want[i, keep, len(ids), n == 0, hashlib.sha256(t.encode()).hexdigest()] += 1
    got = Counter(tuple(r) for r in exact_dedup.op10(spark, path).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
    assert got == want


def test_exact_dedup_small_blocks(spark, tables):
    """Many levels, and texts that share all blocks but one or all but the order."""
    a, b, c = "abcd", "efgh", "ijkl"
    rows = [a * 3, a * 4, a + b + c, a + c + b, a + b + c, a + b + c + "m", a, "", b * 9 + "x", b * 9 + "y", b * 9 + "x"]
    path = tables(list(enumerate(rows)))
    got = {r.doc_id: r.keep_id for r in exact_dedup.exact_duplicates(spark, read_table(spark, path, "documents"), block_chars=4).collect()}
    assert got == {i: rows.index(t) for i, t in enumerate(rows)}


def test_dropping_keeps_all_columns(spark, odd):
    docs = read_table(spark, odd, "documents")
    kept = exact_dedup.drop_exact_duplicates(spark, docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({SPACES.sub(" ", t or "") for _, t in texts(spark, odd)})


@pytest.mark.parametrize("where", ["odd", "small", "empty"])
def test_shards(spark, request, where):
    path = request.getfixturevalue(where)
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts(spark, path))
    rows = shard.op2(spark, path).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert shard.place_of(r.row_number, len(rows), 17) == r.slot * 16 + r.shard
        assert shard.row_at(r.shard, r.slot, 16, len(rows), 17) == r.row_number
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    counts = [len(by[k]) for k in range(16)]
    assert max(counts) - min(counts) <= 1
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.row_number)] == sorted((r.doc_id for r in rows), key=lambda i: (i is not None, i or 0))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 97, 1000])
def test_feistel_is_a_permutation(n):
    assert sorted(shard.place_of(i, n, 3) for i in range(n)) == list(range(n))
    a, b = shard.domain(n)
    assert n <= a * b < n + a


@pytest.mark.parametrize("where", ["odd", "small", "empty"])
def test_token_files_round_trip(spark, request, where):
    path = request.getfixturevalue(where)
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, at = [], 0
    for i, t in sorted(texts(spark, path), key=lambda d: (d[0] is not None, d[0] or 0, d[1] is not None, (d[1] or "").encode())):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = [tuple(r) for r in token_files.op3(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert sorted(got, key=lambda r: r[1]) == want


@pytest.mark.parametrize("given,kind", [(None, "<u2"), (2, "<u2"), (4, "<u4")])
def test_token_files_widths(spark, small, given, kind):
    path = Scratch(spark, "t").path("files")
    docs = read_table(spark, small, "documents")
    tok = public_tokenizers.path("byte_bpe_50k.json")
    manifest = token_files.write_token_files(spark, docs, path, tok, 2, id_bytes=given)
    files = token_files.TokenFiles(path)
    total = sum(len(ids) for p in files.parts for _, _, ids in files.documents(p))
    assert total == manifest["ids"] and files.array(0, "ids").dtype == np.dtype(kind)


@pytest.mark.parametrize("where", ["odd", "small", "empty"])
def test_packing_covers_every_id_once(spark, request, where):
    path = request.getfixturevalue(where)
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = defaultdict(list)
    for i, t in texts(spark, path):
        want[i].append(np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes())
    docs = read_table(spark, path, "documents").select("doc_id", "text")
    rows = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 1, with_ids=True).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
        pieces[r.doc_id].append(r)
        assert r.ids_crc32 == zlib.crc32(r.ids) and r.length == len(r.ids) // 4 > 0
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == [sum(x.length for x in s[:k]) for k in range(len(s))]
        assert sum(r.length for r in s) <= 2048
    for i, docs_ in want.items():
        covered = sum(r.length for r in pieces[i])
        assert covered == sum(len(d) // 4 for d in docs_)
        if len(docs_) == 1:
            assert b"".join(r.ids for r in sorted(pieces[i], key=lambda r: r.start)) == docs_[0]
            assert {r.doc_tokens for r in pieces[i]} == {len(docs_[0]) // 4}
    total = sum(r.length for r in rows)
    parts = max(1, len({r.sequence_id >> 36 for r in rows}))
    assert len(sequences) <= total // 2048 + parts


def test_pack_balances_cost():
    lengths = [1500, 1500, 700, 300, 200, 100, 50, 50, 5000, 1]
    pieces = packing.pack(lengths, 2048)
    used = defaultdict(int)
    for item, _, n, seq in pieces:
        used[seq] += n
    assert max(used.values()) <= 2048 and sum(used.values()) == sum(lengths) and len(used) == -(-sum(lengths) // 2048)
    for item, size in enumerate(lengths):
        spans = sorted((s, n) for i, s, n, _ in pieces if i == item)
        assert spans[0][0] == 0 and sum(n for _, n in spans) == size


def plain_packing(lengths, capacity):
    """The rule as it is stated, step by step."""
    n = -(-sum(lengths) // capacity)
    held, cost, out = [0] * n, [0] * n, []
    left = [(size, item, 0) for item, size in enumerate(lengths) if size]
    while left:
        size, item, start = piece = min(left, key=lambda p: (-p[0], p[1], p[2]))
        left.remove(piece)
        room = [capacity - h for h in held]
        fits = [k for k in range(n) if room[k] >= size]
        if fits:
            at, take = min(fits, key=lambda k: (cost[k], k)), size
        else:
            at = max(range(n), key=lambda k: (room[k], -k))
            take = room[at]
            left.append((size - take, item, start + take))
        held[at] += take
        cost[at] += packing.LINEAR * take + take * take
        out.append((item, start, take, at))
    return out


def test_documents_go_to_the_lowest_cost_with_room():
    rng = random.Random(12)
    for _ in range(60):
        lengths = [rng.choice([rng.randint(0, 40), rng.randint(1, 300), 100, 700]) for _ in range(rng.randint(1, 40))]
        assert sorted(packing.pack(lengths, 256)) == sorted(plain_packing(lengths, 256))


def test_rows_of_one_id_fill_many_partitions(spark, tables):
    """A third of the rows and more with one doc_id, or none, are dealt over partitions, in an order that holds."""
    rows = [(None, f"text {i % 40:03d}") for i in range(300)] + [(7, f"other {i:03d}") for i in range(300)] + [(7, "same")] * 300
    path = tables(rows)
    folder = Scratch(spark, "t").path("files")
    manifest = token_files.write_token_files(spark, read_table(spark, path, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), 2)
    assert len([p for p in manifest["parts"] if p["docs"]]) >= 3 and max(p["docs"] for p in manifest["parts"]) <= 500
    files = token_files.TokenFiles(folder)
    ids = [i for p in sorted(files.parts) for i, _, _ in files.documents(p)]
    assert ids == [None] * 300 + [7] * 600


def shifting(monkeypatch, spark):
    """From now on every stored table is followed by other splits of scans, as where executors come and go."""
    store, count = Scratch.write, iter(range(10_000))

    def write(self, df, name):
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        out = store(self, df, name)
        spark.conf.set("spark.sql.files.maxPartitionBytes", str([600, 2_000_000, 3_000, 40_000_000][next(count) % 4]))
        return out

    monkeypatch.setattr(Scratch, "write", write)


@pytest.fixture
def splits(spark):
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = [spark.conf.get(n) for n in names]
    yield
    for n, v in zip(names, before):
        spark.conf.set(n, v)


def test_rows_are_met_again_whatever_the_splits(spark, tables, splits, monkeypatch):
    """Row ids are stored once: dropping picks the right rows though each scan is split otherwise."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmn", k=6)) for _ in range(2000)]
    clean = [rng.choices(words, k=60) for _ in range(60)]
    item = " ".join(rng.choices(words, k=30))
    docs = [(i, " ".join(w)) for i, w in enumerate(clean)]
    docs += [(100 + i, "  ".join(clean[i])) for i in range(20)]
    docs += [(200 + i, " ".join([*clean[20 + i], "more"])) for i in range(20)]
    docs += [(300 + i, " ".join([*rng.choices(words, k=20), item])) for i in range(20)]
    rng.shuffle(docs)
    path = tables(docs, benchmark=[(1, item)])
    spread = f"{path}/spread.parquet"
    read_table(spark, path, "documents").repartition(16).write.parquet(spread)
    table, bench = spark.read.parquet(spread), read_table(spark, path, "benchmark")
    shifting(monkeypatch, spark)
    ids = lambda df: {r.doc_id for r in df.collect()}
    every = {i for i, _ in docs}
    assert ids(exact_dedup.drop_exact_duplicates(spark, table)) == every - set(range(100, 120))
    kept = ids(simhash.drop_near_duplicates(spark, table))
    assert kept == every - set(range(100, 120)) - set(range(200, 220))
    assert ids(decontaminate.drop_contaminated(spark, table, bench)) == every - set(range(300, 320))
    assert {r.doc_id for r in decontaminate.find_contamination(spark, table, bench).collect()} == set(range(300, 320))


def test_tables_that_are_no_plain_scan_are_numbered_too(spark, tables):
    """A filtered, joined or doubled table is stored with its ids; a scan is named by file and place."""
    path = tables([(i, f"text number {i % 7} of some words") for i in range(40)])
    docs = read_table(spark, path, "documents")
    scratch = Scratch(spark, "t")
    for df in (docs, docs.where("doc_id < 30"), docs.union(docs), docs.crossJoin(spark.range(2)), spark.read.parquet(f"{path}/documents.parquet", f"{path}/documents.parquet"), docs.withColumnRenamed("lang", "_metadata")):
        made = numbered(scratch, df, "mark")
        rows = made.collect()
        assert made.columns == [*df.columns, "mark"] and len({r.mark for r in rows}) == len(rows) == df.count()
        assert sorted(rows) == sorted(made.collect())
    assert exact_dedup.drop_exact_duplicates(spark, docs.union(docs)).count() == 7


def test_columns_of_clashing_names_come_through(spark, tables):
    path = tables([(1, "a b c d e f"), (2, "a b c d e f"), (3, "other words are here now")], benchmark=[(1, "other words are here now")], labels=[(1, 1, 0), (2, 0, 0)])
    docs = read_table(spark, path, "documents").selectExpr("*", "1 as tidewright_row", "2 as TIDEWRIGHT_ROW_", "3.5D as tidewright_score", "'x' as dropped", "4 as mid", "5 as hub")
    model = quality.fit_quality(docs, read_table(spark, path, "labels"))
    for kept, n in (
        (exact_dedup.drop_exact_duplicates(spark, docs), 2), (simhash.drop_near_duplicates(spark, docs), 2), (decontaminate.drop_contaminated(spark, docs, read_table(spark, path, "benchmark")), 2), (quality.drop_low_quality(docs, model, 0.0), 3),
    ):
        rows = kept.collect()
        assert kept.columns == docs.columns and len(rows) == n
        assert all((r.tidewright_row, r.tidewright_score, r.mid) == (1, 3.5, 4) for r in rows)
