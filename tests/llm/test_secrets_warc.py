import base64
import gzip
import hashlib
import random
import re
import string

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinetrove.llm import secrets, warc
from kinetrove.llm.common import scratch, stage

ASSIGN = re.compile(r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def base_of(text):
    found = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [x[2] for x in sorted(found)]


def check(docs):
    rows = {}
    for r in docs.collect():
        rows.setdefault(str(r.doc_id), []).append(base_of(r.text or ""))
    got = {}
    for r in secrets.report(secrets.scan(docs)).collect():
        base = [s for s in r.spans.split(",") if s and not s.startswith("random")]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex")]
        got.setdefault(str(r.doc_id), []).append(base)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in rows.items()}


def test_base_spans(spark, documents, odd, empty):
    rng = random.Random(5)
    parts = ["password", "Secret", "token", "api_key", "APIKEY", ": ", "=", '"', "'", " ", "abcdefgh", "short", "AKIA", "AKIAABCDEFGHIJKL", "0" * 31, "f" * 33, "é", "🙂", "x.y", "\n"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))) for i in range(400)]
    check(spark.createDataFrame(rows, "doc_id long, text string"))
    check(documents)
    check(odd)
    assert secrets.scan(empty).count() == 0


def test_random_tokens_are_found_and_words_are_not(spark):
    rng = random.Random(6)
    alphabets = [string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits, "0123456789abcdef", string.ascii_uppercase + "234567"]
    planted = [(i, "é " + "".join(rng.choice(alphabets[i % 4]) for _ in range(31)) + " end") for i in range(200)]
    words = ["internationalization2024", "the-quick-brown-fox-jumps-over-2", "http/path/to/some/Thing/index2", "2024-01-02-10-22-33-44-Ab", "a" * 30 + "1", "ConfigurationManagerFactory2Bean", string.ascii_lowercase + string.digits]
    texts = [(1000 + i, f"x {w} y") for i, w in enumerate(words * 30)]
    found = {r.doc_id: r.added for r in secrets.scan(spark.createDataFrame(planted + texts, "doc_id long, text string")).select("doc_id", "added").collect()}
    hits = [i for i, _ in planted if [(s.start, s.end) for s in found[i]] == [(2, 33)]]
    assert len(hits) >= 180
    assert not any(found[i] for i, _ in texts)


def test_added_spans_leave_base_spans_alone(spark):
    text = "token: q8Zr5TnW2xLk9VbYc3Hd7Mf4 and q8Zr5TnW2xLk9VbYc3Hd7Mf4"
    r = secrets.report(secrets.scan(spark.createDataFrame([(1, text)] * 50, "doc_id long, text string"))).first()
    assert r.spans.startswith("assign:0:31") and "random:0" not in r.spans and r.n_assign == 1


def test_values_after_equals_signs_are_tested(spark):
    rng = random.Random(8)
    rows = []
    for i in range(120):
        before = ("AWS_KEY=", "https://x.y?sig=", "export client_key=", "a==")[i % 4]
        rows.append((i, before + "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(40)) + " end", len(before)))
    found = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, at int")).collect()
    at = {i: n for i, _, n in rows}
    for kind in range(4):
        assert sum([(s.start, s.end) for s in r.added] == [(at[r.doc_id], at[r.doc_id] + 40)] for r in found if r.doc_id % 4 == kind) >= 27


def test_tokens_of_any_length_are_tested(spark):
    rng = random.Random(9)
    lengths = [511, 512, 513, 520, 2000, 20_000]
    rows = [(i, "x " + "".join(rng.choice(string.ascii_letters + string.digits + "+/") for _ in range(n)) + " end") for i, n in enumerate(lengths * 5)]
    rows += [(1000 + n, "x " + "ab1C/" * (n // 5) + " end") for n in (1000, 20_000)]
    found = {r.doc_id: [(s.start, s.end) for s in r.added] for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, n in enumerate(lengths):
        assert sum(found[k] == [(2, 2 + n)] for k in range(i, 30, 6)) >= 4
    assert found[2000] == found[21_000] == []


def test_tokens_of_every_alphabet_are_tested(spark):
    rng = random.Random(10)
    # Thirty characters: 32 digits would be a base span of their own.
    alphabets = [string.ascii_uppercase + string.digits, string.ascii_letters, string.ascii_lowercase, string.ascii_uppercase, string.digits]
    alphabets += [string.ascii_letters + string.digits + "+/-_", string.ascii_lowercase + string.digits + "-_"]
    rows = [(i, "x " + "".join(rng.choice(alphabets[i % 7]) for _ in range(30)) + " end") for i in range(280)]
    words = ["CONFIGURATIONMANAGERFACTORY", "INTERNATIONALIZATION2024", "donaudampfschifffahrtsgesellschaft", "ConfigurationManagerFactoryBean"]
    words += ["http/path/to/some/thing/index", "the_quick-brown/fox+jumps_over", "-" * 40, "_" * 21, "THE-QUICK-BROWN-FOX-JUMPS", "1234567890" * 3, "20240102102233445566"]
    rows += [(1000 + i, f"x {w} y") for i, w in enumerate(words * 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: [(s.start, s.end) for s in r.added] for r in secrets.scan(docs).collect()}
    hits = [sum(found[i] == [(2, 32)] for i in range(kind, 280, 7)) for kind in range(7)]
    assert min(hits[:6]) >= 34, hits
    assert not any(found[i] for i in found if i >= 1000), {words[(i - 1000) % len(words)] for i in found if i >= 1000 and found[i]}
    run = F.regexp_extract("text", secrets.TOKEN, 0)
    assert docs.where(secrets.battery(run).isNull()).count() == 0


PAGES = "page_id long, url string, html string, row string, payload string, sha string"


def pages(spark):
    rows = [(5, "http://a/x y", "<p>é</p>"), (3, None, "<p>é</p>"), (9, "http://b/\n", None), (8, "u", ""), (7, "u", "\r\n\r\nWARC/1.1\r\n"), (3, None, "<p>é</p>"), (None, "n", "z"), (11, "n", "z"), (12, "l", "y" * 300_000)]
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], PAGES)


def test_archives_round_trip(spark):
    docs = pages(spark)
    got = sorted(((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in warc.archive_pages(docs).where("digest_ok").collect()))
    rows = docs.collect()
    first = {}
    for r in rows:
        html = (r.html or "").encode()
        mine = (r.page_id is None, r.page_id or 0)
        first[html] = min(first.get(html, mine), mine)
    want = []
    for r in rows:
        html = (r.html or "").encode()
        mine = (r.page_id is None, r.page_id or 0) == first[html]
        want.append((str(r.page_id), len(html), base64.b32encode(hashlib.sha1(html).digest()).decode(), "response" if mine else "revisit", "None" if mine else str(first[html][1])))
    assert got == sorted(want)
    assert warc.archive_pages(docs.where("false")).count() == 0


def test_smaller_payloads_are_all_responses(spark):
    got = warc.archive_pages(pages(spark), min_bytes=3).groupBy("record_type").count().collect()
    assert dict(got) == {"response": 8, "revisit": 1}


def test_archives_are_plain_gzip_members(spark):
    chunks = warc.write_archives(pages(spark), scratch(spark, "w")).collect()
    records = b""
    for path in {c.path for c in chunks}:
        with gzip.open(path.removeprefix("file://")) as file:
            records += file.read()
    assert records.count(b"WARC-Type: request\r\n") == 9 and records.count(b"WARC-Type: metadata\r\n") == 9
    assert records.count(b"WARC-Type: response\r\n") + records.count(b"WARC-Type: revisit\r\n") == 9


def test_links_in_either_direction_and_missing_parts(spark):
    rows = [("r1", "response", ["q1"]), ("q1", "request", []), ("m1", "metadata", ["r1"]), ("r2", "response", []), ("q3", "request", ["gone"]), ("i1", "warcinfo", [])]
    records = spark.createDataFrame(rows, "record_id string, type string, concurrent_to array<string>").withColumn("fields", F.lit(None).cast("map<string,string>"))
    got = {r.capture_id: r for r in warc.transactions(stage(records, "r")).collect()}
    assert set(got) == {"r1", "r2"}
    assert got["r1"].request.record_id == "q1" and got["r1"].metadata.record_id == "m1"
    assert got["r2"].request is None and got["r2"].metadata is None


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=300), st.text(max_size=30))
def test_parse_gives_back_the_payload(payload, url):
    page = {"page_id": 4, "url": url, "payload": payload, "again": False, "response_id": None, "response_url": None}
    response, request, about = map(warc.parse, warc.records_of(page, "c", "1970-01-01T00:00:00Z"))
    assert response["payload"] == payload and response["digest_ok"] and request["concurrent_to"] == about["concurrent_to"] == [response["record_id"]]
    assert about["fields"] == {"page-id": "4", "payload-bytes": str(len(payload))}
