"""Inputs, journals, grounding."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tidewright.errors import WorkflowError
from tidewright.operators import grounding, verify
from tidewright.sources.export import contained_folder, export_value
from tidewright.sources.ingest import MemoryStore, ingest_records, journal_exposure, over_limits, read_input_object, read_package, replace_by_key, require_digests


def test_input_objects(tmp_path):
    f = tmp_path / "a.json"
    f.write_text('{"a": 1}')
    assert read_input_object(f) == {"a": 1}
    for bad in (b"[1]", b"{", b'{"a":1,"a":2}', b"\xff", b"\xef\xbb\xbf{}"):
        f.write_bytes(bad)
        with pytest.raises(WorkflowError) as e:
            read_input_object(f)
        assert e.value.code == "invalid_input"


def test_ingest_splits_accepted_and_rejected(spark, tmp_path):
    rows = {"a": '{"app": "x", "n": 2}', "b": '{"app": "y", "n": 0}', "c": '{"app": "z", "n": "no"}', "d": "[1]", "e": "{", "all": '{"app": "w", "n": 9}'}
    for name, text in rows.items():
        (tmp_path / f"{name}.json").write_text(text)
    good, bad = ingest_records(spark, str(tmp_path), "app string, n int", F.col("n") > 0, skip=("all.json",))
    assert [tuple(r) for r in good.collect()] == [("a.json", "x", 2)]
    assert {r.filename for r in bad.collect()} == {"b.json", "c.json", "d.json", "e.json"}


def test_journal_limits(spark):
    j = spark.createDataFrame([("get",), ("get",), ("post",), ("odd",)], "kind string")
    assert {(r.kind, r.attempts, r.allowed) for r in over_limits(j, {"get": 1, "post": 3}).collect()} == {("get", 2, 1), ("odd", 1, 0)}


def test_stale_inputs(tmp_path):
    (tmp_path / "a").write_bytes(b"1")
    want = "sha256:" + hashlib.sha256(b"1").hexdigest()
    require_digests({"a": want}, tmp_path)
    for expected in ({"a": "sha256:0"}, {"b": want}):
        with pytest.raises(WorkflowError) as e:
            require_digests(expected, tmp_path)
        assert e.value.code == "stale_input"


def test_memory_store():
    m = MemoryStore()
    name = m.put({"b": 1, "a": None})
    assert m.get(name) == {"b": 1, "a": None} and m.put({"b": 1, "a": None}) == name and len(m) == 1
    assert m.delete(name) and not m.delete(name)
    with pytest.raises(WorkflowError):
        m.get(name)


def test_grounding_and_redaction(spark):
    df = spark.createDataFrame([("it costs 5 or 7.50, $9.99", "5 items"), ("", "")], "t string, s string")
    t, s = F.col("t"), F.col("s")
    a, b = df.select(grounding.ungrounded_numbers(t, s).alias("u"), grounding.word_count(t).alias("w"), grounding.banned(t, ["COSTS", "no"]).alias("b"), grounding.has_price(t).alias("p"), verify.redact(F.lit("jo@ex.org token: abc d")).alias("r")).collect()
    assert (a.u, a.w, a.b, a.p, a.r) == (["7.50", "9.99"], 6, ["COSTS"], True, "[redacted] token: [redacted] d") and (b.u, b.w, b.p) == ([], 0, False)


def failing(f, *a, **k):
    with pytest.raises(WorkflowError) as e:
        f(*a, **k)
    return e.value.code, e.value.context.get("why") or e.value.context.get("part")


def make_package(folder, **change):
    """A sound capture package, but for what ``change`` says of its manifest."""
    (folder / "events").mkdir(parents=True)
    events = [{"type": "reserved", "attemptId": 1, "reservationNanoUsd": 70}, {"type": "reserved", "attemptId": 2, "reservationNanoUsd": 30}, {"type": "note"}, {"type": "settled", "attemptId": 1, "chargedNanoUsd": 25}]
    for k, e in enumerate(events):
        (folder / f"events/{k:06d}.json").write_text(json.dumps(e))
    (folder / "result.json").write_text('{"ok": true}')
    names = [f"events/{k:06d}.json" for k in range(len(events))] + ["result.json"]
    files = [[n, hashlib.sha256((folder / n).read_bytes()).hexdigest()] for n in names]
    raw = json.dumps({"version": 1, "mode": "mock-only", "files": files, "exposureNanoUsd": 55, "status": "completed", "exported": True} | change).encode()
    (folder / "manifest.json").write_bytes(raw)
    (folder / "seal.sha256").write_text(hashlib.sha256(raw).hexdigest())
    return folder


def test_capture_packages(tmp_path):
    got = read_package(make_package(tmp_path / "ok"))
    assert got["result"] == {"ok": True} and got["manifest"]["exposureNanoUsd"] == 55
    for k, (change, part) in enumerate([({"version": 2}, "version"), ({"mode": "live"}, "version"), ({"exposureNanoUsd": 54}, "accounting"), ({"files": []}, "journal"), ({"files": [["../x", "0"]]}, "file_name"), ({"files": [["result.json", "0"]]}, "file_digest")]):
        assert failing(read_package, make_package(tmp_path / str(k), **change)) == ("package_corrupt", part)
    altered = make_package(tmp_path / "altered")
    (altered / "manifest.json").write_bytes((altered / "manifest.json").read_bytes() + b" ")
    assert failing(read_package, altered) == ("package_corrupt", "seal")
    more = make_package(tmp_path / "more")
    (more / "events/000009.json").write_text("{}")
    assert failing(read_package, more) == ("package_corrupt", "journal")
    assert failing(read_package, tmp_path / "none")[0] == "package_corrupt"


def test_journals_are_settled_once(spark):
    reserve, settle = {"type": "reserved", "attemptId": "a", "reservationNanoUsd": 5}, {"type": "settled", "attemptId": "a", "chargedNanoUsd": 0}
    assert journal_exposure([reserve]) == 5 and journal_exposure([reserve, settle]) == 0 and journal_exposure([]) == 0
    for bad in ([reserve, reserve], [settle], [reserve, settle, settle], [{**reserve, "reservationNanoUsd": 1.5}]):
        assert failing(journal_exposure, bad)[0] == "package_corrupt"


def test_replacement_meets_exactly_one(spark):
    have = spark.createDataFrame([("Ann", 1), ("bob", 2), ("BOB", 3), (None, 4)], "name string, n int")
    put = lambda *rows: spark.createDataFrame(list(rows), "name string, n int")
    got = replace_by_key(have, put(("ANN", 9)), "name")
    assert sorted((r.name or "", r.n) for r in got.collect()) == [("", 4), ("ANN", 9), ("BOB", 3), ("bob", 2)]
    for rows in ([("Bob", 1)], [("eve", 1)], [("ann", 1), ("Ann", 2)]):
        assert failing(replace_by_key, have, put(*rows), "name")[0] == "replacement_not_unique"
    assert replace_by_key(have, put(), "name").count() == 4


def test_exports_stay_below_the_root(tmp_path):
    (tmp_path / "root/out").mkdir(parents=True)
    (tmp_path / "else").mkdir()
    (tmp_path / "root/link").symlink_to(tmp_path / "else")
    assert export_value(tmp_path / "root", "nowhere", "a.json", 1) == {"mode": "disabled", "filename": "a.json"}
    told = export_value(tmp_path / "root", "out", "a.json", {"b": [1]}, enabled=True)
    data = (tmp_path / "root/out/a.json").read_bytes()
    assert json.loads(data) == {"b": [1]} and told["sha256"] == "sha256:" + hashlib.sha256(data).hexdigest()
    for folder in ("nowhere", "link", "../else", str(tmp_path / "else")):
        assert failing(contained_folder, tmp_path / "root", folder)[0] == "destination_not_contained"
    assert failing(export_value, tmp_path / "root", "out", "../x", 1, enabled=True)[0] == "destination_not_contained"
    (tmp_path / "root/out/l.json").symlink_to(tmp_path / "else/x")
    assert failing(export_value, tmp_path / "root", "out", "l.json", 1, enabled=True)[0] == "destination_not_regular"


def test_private_exports_are_refused(spark):
    ok = {"see": "https://docs.example.com/a", "n": [1, "x"]}
    assert verify.export_text(ok, True, ("https://docs.example.com",)) == '{"see":"https://docs.example.com/a","n":[1,"x"]}'
    cases = [(ok, "url"), ({"a": "https://docs.example.com/a?x=1"}, "url"), ({"a": "https://u@docs.example.com/"}, "mail"), ({"a": {"API-key": 1}}, "secret_member"), (["Bearer abc"], "bearer"), ("-----BEGIN RSA PRIVATE KEY-----", "private_key"), ("jo@ex.org", "mail"), ("xyzzy", "given_secret")]
    for value, why in cases:
        allowed = () if value is ok else ("https://docs.example.com",)
        assert failing(verify.export_text, value, True, allowed, ("xyzzy",)) == ("private_export", why)
    assert failing(verify.export_text, 1, False) == ("private_export", "not_approved")
    df = spark.createDataFrame([(1, json.dumps(v)) for v, _ in cases] + [(2, None)], "id int, text string")
    told = [(r.id, r.violations) for r in verify.refusals(df, origins=("https://docs.example.com",), secrets=("xyzzy",)).collect()]
    assert told[0] == (1, []) and told[-1] == (2, [])
    assert [v for _, v in told[1:-1]] == [["url"], ["mail", "url"], ["secret_member"], ["bearer"], ["private_key"], ["mail"], ["given_secret"]]


def test_redaction_of_links_controls_and_given_secrets(spark):
    text = "key k-12\tsee https://a.b/c?d now\x7f"
    r = spark.range(1).select(verify.redact(F.lit(text), ("k-12",)).alias("r"), verify.capped(F.lit("x" * 700)).alias("c")).first()
    assert r.r == "key [redacted] see [redacted URL] now " and len(r.c) == 600
