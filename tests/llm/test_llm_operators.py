"""Each operator against a plain version on small fixtures, with nulls, empty texts, repeated rows and odd columns."""

import base64
import gzip
import hashlib
import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from questrel.llm import common, embeddings, minhash, mixing, packing, quality, sentences, suffixes, syncmers, toxicity, warc

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, k=400):
    return " ".join(f"w{rng.randint(0, k)}" for _ in range(n))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)


def odd_rows(rng):
    text = words(rng, 80)
    return [(1, None, "a"), (2, "", None), (3, "   \n", "a"), (4, text, "a"), (5, text, "b"), (5, text, "b"), (None, words(rng, 30), None), (7, "x", "é"), (8, words(rng, 20_000), "a")]


@pytest.fixture
def rng():
    return random.Random(11)


def least_reachable(nodes, links):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    return {n: top(n) for n in nodes}


def test_components(spark, rng):
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(35)] + [(100, 100 + i) for i in range(1, 30)] + [(i, i + 1) for i in range(200, 230)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    assert got == least_reachable(nodes, edges)
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 1


def test_near_duplicates(spark, rng):
    base = [words(rng, rng.randint(3, 120)) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(120):
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, max(1, len(w) // 20))):
            w[rng.randrange(len(w))] = f"z{rng.randint(0, 999)}"
        if rng.random() < 0.3:
            w.insert(rng.randrange(len(w)), "extra")
        rows.append((1000 + i, " ".join(w)))
    rows += [(5000, None), (5001, ""), (5002, " ")]
    known = {}
    seqs = {i: minhash.hashed(t, known).astype(np.uint32) for i, t in rows}
    full = [i for i, s in seqs.items() if len(s)]
    links = [(a, b) for n, a in enumerate(full) for b in full[:n] if plain_alike(seqs[a].tolist(), seqs[b].tolist())]
    want = least_reachable(list(seqs), links)
    out = minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.did: r.class_id for r in out} == want
    assert len(set(want.values())) < 110


def plain_alike(a, b, least=0.8):
    n = plain_common(a, b)
    return n >= least * (len(a) + len(b) - n) - 1e-9


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        corner = 0
        for j, y in enumerate(b):
            row[j + 1], corner = corner + 1 if x == y else max(row[j + 1], row[j]), row[j + 1]
    return row[-1]


def test_banded_alignment(rng):
    """Words repeat, and most pairs lie near the threshold."""
    yes = 0
    for _ in range(1500):
        kinds = rng.choice([3, 30, 10**6])
        a = [rng.randint(0, kinds) for _ in range(rng.randint(1, 60))]
        b = [x for x in a if rng.random() > 0.08]
        for _ in range(rng.randint(0, 4)):
            b.insert(rng.randint(0, len(b)), rng.randint(0, kinds))
        if len(b) > 1 and rng.random() < 0.3:
            i, j = rng.sample(range(len(b)), 2)
            b[i], b[j] = b[j], b[i]
        if b:
            want = plain_alike(a, b)
            yes += want
            assert minhash.alike(np.array(a, np.uint32), np.array(b, np.uint32)) == want == minhash.alike(np.array(b, np.uint32), np.array(a, np.uint32))
    assert 300 < yes < 1400


def test_long_texts_align_in_their_stored_form(rng):
    """Twelve thousand words at 32 bits each, a tenth of them changed, against the dynamic programme."""
    a = [rng.randint(0, 500) for _ in range(1500)]
    for share in (0.02, 0.1, 0.12, 0.2):
        b = [x if rng.random() > share else rng.randint(501, 10**6) for x in a]
        assert minhash.alike(np.array(a, np.uint32), np.array(b, np.uint32)) == plain_alike(a, b)
    t = words(rng, 12_000, 3000)
    w = t.split()
    for i in rng.sample(range(len(w)), 1200):
        w[i] = "changed"
    x, y, z = (minhash.hashed(t, {}).astype(np.uint32) for t in (t, " ".join(w), " ".join(w[6000:] + w[:6000])))
    assert minhash.alike(x, y) and not minhash.alike(x, z)


def test_sketches_find_edited_texts(rng):
    """Texts of few and many words, a word in nine changed, evenly or anywhere: what the alignment accepts collides."""
    seen = Counter()
    for k in range(900):
        n = rng.choice([10, 14, 20, 30, 45, 58, 65, 90, 150, 300])
        a = [rng.randint(0, 2000) for _ in range(n)]
        spread = k % 2
        at = range(rng.randint(0, 8), n, 9) if spread else rng.sample(range(n), n // 10)
        b = [x + 10**6 if i in set(at) else x for i, x in enumerate(a)]
        x, y = np.array(a, np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.array(b, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        if minhash.alike(x, y):
            s, t = minhash.sketches(x), minhash.sketches(y)
            m = min(len(s), len(t))
            seen[spread, bool((s[:m] == t[:m]).any())] += 1
    for spread in (0, 1):
        assert seen[spread, True] >= 0.9 * (seen[spread, True] + seen[spread, False]) > 200


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")
def test_recall_of_near_duplicates(spark):
    """All pairs that share a run of five words, at scale 0.01: of those whose words align, 0.9 or more are together."""
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    known, runs, texts = {}, {}, {}
    for r in d.collect():
        texts[r.doc_id] = each = minhash.hashed(r.text, known)
        for h in set(minhash.shingles(each)[0].tolist()) if len(each) else ():
            runs.setdefault(h, []).append(r.doc_id)
    pairs = {(a, b) for ids in runs.values() for a in ids for b in ids if a < b}
    near = [(a, b) for a, b in pairs if len(texts[a]) != len(texts[b]) or (texts[a] != texts[b]).any()]
    near = [(a, b) for a, b in near if minhash.alike(texts[a].astype(np.uint32), texts[b].astype(np.uint32))]
    of = {r.did: r.class_id for r in minhash.classes(d).collect()}
    assert len(near) > 80 and sum(of[a] == of[b] for a, b in near) >= 0.9 * len(near)


def test_order_counts():
    each = lambda t: minhash.hashed(t, {})
    _, a = minhash.shingles(each("a b c d e a b c d e a b c d e"))
    assert len(a) == len(set(a.tolist())) == 11
    assert len(minhash.shingles(each("one two"))[0]) == 1 and len(each("")) == len(each(None)) == 0
    assert len(minhash.sketches(each("one two"))) == minhash.BANDS + minhash.MORE
    assert len(minhash.sketches(each("one " * 99))) == minhash.BANDS


def test_one_of_each_class_stays(spark, rng):
    t = words(rng, 60)
    d = docs(spark, [(3, t, "a"), (1, t, "b"), (1, t, "b"), (2, t + " more", "c"), (9, None, "a"), (10, "", "a"), (None, words(rng, 50), "a"), (None, None, "a")])
    d = d.withColumns({c: F.lit(1) for c in ("rows", "k0", "class_id", "did", "row")})
    out = minhash.dedup(d)
    assert out.columns == d.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == [(False, 1), (False, 9), (False, 10), (True, 0), (True, 0)]
    assert minhash.dedup(d.where("false")).count() == 0


# ---- 2


def plain_bytes(rows, size=200):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + size] for b in data for i in range(len(b) - size + 1))
    out = []
    for (k, _), b in zip(rows, data, strict=True):
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                gone[i] += 1
                gone[i + size] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        out.append((k, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=str)


def test_repeated(rng):
    for _ in range(200):
        parts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 30))) for _ in range(4)]
        seen = Counter(p[i : i + 5] for p in parts for i in range(len(p) - 4))
        assert [list(x) for x in suffixes.repeated(parts, 5)] == [[seen[p[i : i + 5]] > 1 for i in range(len(p) - 4)] for p in parts]


@pytest.mark.parametrize("large", [10**6, 20])
def test_repeated_bytes(spark, rng, monkeypatch, large):
    monkeypatch.setattr(suffixes, "LARGE", large)
    letters = lambda n, of: "".join(rng.choice(of) for _ in range(n))
    base = letters(400, "abcdefghij")
    rows = [(1, "a" * 900), (2, None), (3, ""), (4, "x" * 199), (5, "ab" * 200), (6, "ba" * 150), (7, "é" * 150), (8, "same" * 60), (8, "same" * 60), (None, base[:250])]
    rows += [(100 + i, letters(rng.randint(0, 200), "klmnop") + base + letters(rng.randint(0, 200), "qrst")) for i in range(60)]
    rows += [(500 + i, letters(40, "uv") + base[100:290] + letters(40, "uv")) for i in range(10)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("did", F.lit(0)).withColumn("h", F.lit(0))
    out = suffixes.dedup_bytes(d)
    assert sorted((tuple(r)[:5] for r in out.collect()), key=str) == plain_bytes(rows)
    assert suffixes.dedup_bytes(d.where("false")).count() == 0


def test_long_text_in_chunks(rng, monkeypatch):
    text = bytes(rng.choice(b"abcd") for _ in range(3000))
    whole = suffixes.runs(text)
    monkeypatch.setattr(suffixes, "CHUNK", 500)
    cut = suffixes.runs(text)
    place = lambda found: [h for h, _, n in found for _ in range(n)]
    assert place(cut) == place(whole) and len(place(whole)) == 2801


# ---- 3


def test_embedding_links(spark, rng, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    g = np.random.default_rng(4)
    rows, n = [], 0
    for _ in range(30):
        base = g.normal(size=24)
        for _ in range(rng.randint(1, 12)):
            rows.append((n, (base + g.normal(size=24) * 0.08).tolist(), rng.choice([1, 1, 1, 2])))
            n += 1
    hot = g.normal(size=24)
    for _ in range(80):
        rows.append((n, (hot + g.normal(size=24) * 0.02).tolist(), 3))
        n += 1
    rows += [(n + i, hot.tolist(), 3) for i in range(20)]
    n += 20
    rows += [(n, None, 3), (n + 1, [0.0] * 24, 3), (n + 2, [float("nan")] * 24, 3), (n + 3, [None] + [1.0] * 23, 3), (n + 4, hot.tolist(), None), (n + 5, [], 3), (n + 6, [1.0, 2.0], 3), (n + 7, [2.0, 4.0], 3)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("rep", F.lit(1)).withColumn("copies", F.lit(1))
    links, count = [], Counter()
    good = [(k, np.array(v) / np.linalg.norm(v), label) for k, v, label in rows if v and label is not None and None not in v and np.isfinite(v).all() and any(v)]
    for i, (a, x, p) in enumerate(good):
        for b, y, q in good[:i]:
            if p == q and len(x) == len(y) and x @ y >= 0.98:
                links.append((a, b))
                count.update((a, b))
    want = least_reachable([r[0] for r in rows], links)
    out = embeddings.link(d).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out} == {k: (count[k], c, c == k) for k, c in want.items()}
    assert embeddings.link(d.where("false")).count() == 0


def test_hadamard(rng):
    x = np.random.default_rng(1).normal(size=(5, 16))
    y = embeddings.rotate(x, np.array([[1.0] * 16]))
    h = np.array([[(-1) ** bin(i & j).count("1") for j in range(16)] for i in range(16)])
    assert np.allclose(y, x @ h)


# ---- 4


@pytest.mark.parametrize("version", ["1", "2"])
def test_arc(version):
    records = [("http://a/b c", b"HTTP/1.0 200 OK\r\n\r\nxx\nfiledesc://"), ("http://e", b""), ("", b"plain")]
    found = list(warc.read_arc(warc.make_arc(records, version)))
    assert [b for _, b in found] == [b for _, b in records] and [f["url"] for f, _ in found] == ["http://a/b%20c", "http://e", "-"]
    named, block = next(warc.parse_warc(iter(warc.convert(*found[0]).split(warc.MARK))))
    assert named["warc-type"] == "response" and named["warc-date"] == "2008-04-30T20:48:25Z" and block == records[0][1]
    assert named["warc-payload-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(b"xx\nfiledesc://").digest()).decode()
    assert next(warc.parse_warc(iter(warc.convert(*found[2]).split(warc.MARK))))[0]["warc-type"] == "resource"
    with pytest.raises(ValueError):
        list(warc.read_arc(warc.make_arc(records, version)[:-4]))
    with pytest.raises(ValueError):
        list(warc.read_arc(warc.make_arc(records, version) + b"http://x 5\nabcde\n"))


def test_warc_round_trip(spark):
    rows = [(1, None, "a"), (2, "u v", None), (3, "http://x", "a"), (4, "http://y", ""), (None, "z", "WARC/1.1\r\nContent-Length: 5\r\n\r\nWARC/1.1\r\nWARC/1.1\r\n\r\n\r\n"), (None, "z", "a"), (7, "q", "é" * 100_000), (9, "r", "a"), (9, "r", "a")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit(1)).withColumn("refers", F.lit(2))
    path = common.new_path(spark, "warc")
    warc.write_warc(d, path)
    out = warc.read_warc(spark, path).collect()
    top = {}
    for i, _, h in rows:
        top[h or ""] = max(top.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in rows:
        first = (-1 if i is None else i) == top[h or ""]
        data = (h or "").encode()
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first else "revisit", None if first else top[h or ""], data if first else None))
    got = [(None if r.row is None else int(r.row), r.payload_bytes, r.payload_digest, r.record_type, None if r.refers is None else int(r.refers), None if r.payload is None else bytes(r.payload)) for r in out]
    assert sorted(got, key=str) == sorted(want, key=str)
    heads = [line for r in spark.read.text(path).collect() for line in r.value.split("\r\n")]
    ids = [x for x in heads if x.startswith("WARC-Record-ID")]
    assert len(set(ids)) == len(rows) and {x.split(": ")[1] for x in heads if x.startswith("WARC-Refers-To: ")} <= {x.split(": ")[1] for x in ids}
    path = common.new_path(spark, "warc")
    warc.write_warc(d, path, least=2)
    assert warc.read_warc(spark, path).where("record_type = 'revisit'").count() == 0
    path = common.new_path(spark, "warc")
    warc.write_warc(d.where("false"), path)
    assert warc.read_warc(spark, path).count() == 0


def test_foreign_archives(spark, tmp_path):
    """Files not written here: version 1.0, a warcinfo record, no digests, a revisit that tells no length; and ARC files."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>WARC/1.0\r\n\xff"
    head = lambda kind, uri, n: f"WARC/1.0\r\nWARC-Type:{kind}\r\n{uri}WARC-Date: 2010-01-01T00:00:00Z\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Length: {n}\r\n\r\n".encode()
    data = head("warcinfo", "", 13) + b"software: x\r\n\r\n\r\n" + head("response", "WARC-Target-URI: http://a/\r\n", len(block)) + block + b"\r\n\r\n" + head("revisit", "", 19) + b"HTTP/1.1 200 OK\r\n\r\n\r\n\r\n"
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "x.warc").write_bytes(data)
    got = [(r.record_type, r.uri, r.payload_bytes, r.payload and bytes(r.payload)) for r in warc.read_warc(spark, f"file://{tmp_path}/w").collect()]
    assert got == [("warcinfo", None, 13, b"software: x\r\n"), ("response", "http://a/", 14, b"<p>WARC/1.0\r\n\xff"), ("revisit", None, None, None)]
    records = [("http://a/b", block), ("http://e", b""), ("http://a/b", block)]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.arc").write_bytes(warc.make_arc(records, "1"))
    (tmp_path / "a" / "two.arc.gz").write_bytes(gzip.compress(warc.make_arc(records[:1], "2")) + gzip.compress(warc.make_arc(records, "2").split(b"\n", 3)[3][:0]))
    warc.convert_arc(spark, f"file://{tmp_path}/a", f"file://{tmp_path}/out")
    out = warc.read_warc(spark, f"file://{tmp_path}/out").collect()
    payload = block.split(b"\r\n\r\n", 1)[1]
    assert Counter((r.uri, r.record_type, bytes(r.payload)) for r in out) == {("http://a/b", "response", payload): 3, ("http://e", "resource", b""): 1}


# ---- 5


def check_pieces(out, rows, ids):
    left = Counter()
    for i, _ in rows:
        left[i] += 1
    for i, g in out.groupby("doc_id", dropna=False):
        key = None if i != i else int(i)
        want = ids[key]
        assert (g.doc_tokens == len(want)).all()
        got = Counter((int(r.start), int(r.length), int(r.ids_crc32)) for r in g.itertuples())
        assert all(zlib.crc32(want[s : s + n].tobytes()) == c for s, n, c in got)
        assert sum(n * k for (_, n, _), k in got.items()) == len(want) * left[key]
    seq = out.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    sizes = seq.length.sum()
    assert (sizes <= packing.WINDOW).all() and all(n & (n - 1) == 0 for n in sizes)
    ordered = out.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()


def test_packing(spark, rng):
    from tokenizers import Tokenizer

    rows = [(i, words(rng, rng.randint(0, 900))) for i in range(60)] + [(100, None), (101, ""), (102, "  "), (103, words(rng, 20_000)), (104, "It's ÉTÉ!! <|endoftext|> don't　x"), (105, "same text"), (105, "same text"), (None, "nobody")]
    tok = Tokenizer.from_file(packing.tokenizer_path())
    ids = {i: np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for i, t in rows}
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit(1)).withColumn("n", F.lit(1))
    check_pieces(packing.pack(d).toPandas(), rows, ids)
    assert packing.pack(d.where("false")).count() == 0


def test_ids_are_the_tokenizers(rng):
    import pyarrow as pa
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    letters = list("abcABC .,!?;:'’\"<|>|\n\t\r\x0b\x1c 　éÉßΣσςİıǅ数字123´###") + ["́", "<|endoftext|>", "<|ENDOFTEXT|>", "it's", "don't ", "Ünï", "ſ", "ﬀ", "K"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(4000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    out = next(packing._tokenize(packing.tokenizer_path(), [batch]))
    for t, n, row in zip(texts, out.column("n").to_pylist(), out.column("ids").to_pylist(), strict=True):
        assert packing._ids(row, n).tolist() == tok.encode(t, add_special_tokens=False).ids + [1]


def test_other_tokenizers_encode_plainly(rng):
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = packing.tokenizer_path("byte_bpe_50k.json")
    tok, texts = Tokenizer.from_file(path), ["Two  Words, and\n\tmore <|x", "", "ÉTÉ it's", None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4)), pa.array(texts)], ["doc_id", "text"])
    out = next(packing._tokenize(path, [batch]))
    for t, n, row in zip(texts, out.column("n").to_pylist(), out.column("ids").to_pylist(), strict=True):
        assert packing._ids(row, n).tolist() == tok.encode(t or "", add_special_tokens=False).ids + [1]


def test_routes_are_dealt_by_size():
    first, parts, n = packing.deal({3: 40, 5: 30, 6: 250, 9: 20, 11: 90}, 16, 100)
    assert (first[[3, 5, 6, 9, 11]].tolist(), parts[[3, 5, 6, 9, 11]].tolist(), n) == ([0, 0, 1, 4, 5], [1, 1, 3, 1, 1], 6)
    assert packing.deal({}, 4, 100)[2] == 0


def test_neighbours_meet_in_a_shard(spark, rng, monkeypatch):
    """Many shards: texts that share a rare word of their own stand in one window; copies spread over shards."""
    monkeypatch.setattr(packing, "SHARD", 3000)
    rows = [(i, " ".join(["topic" + "bcdfghjklm"[i % 10] * 3] * 6 + [f"w{rng.randint(0, 20)}" for _ in range(20)])) for i in range(200)] + [(None, "copy " * 50)] * 90
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert out[out.doc_id.isna()].sequence_id.map(lambda x: x >> 32).nunique() >= 2
    where = out[out.doc_id.notna() & (out.start == 0)].set_index("doc_id").sequence_id.map(lambda x: x >> 32)
    assert (out.sequence_id.map(lambda x: x >> 32).nunique()) >= 5
    for k in range(10):
        assert where[[i for i in range(200) if i % 10 == k]].value_counts().iloc[0] >= 16


def test_neighbours_share_terms():
    d = [np.array([1, 2, 3, 4] * 5), np.array([50, 51, 52] * 5), np.array([1, 2, 3, 9] * 5), np.array([60, 61] * 5)]
    index = packing.Index(d, np.log1p(np.full(100, 3.0)), 15.0)
    s = index.scores(0, 4)
    assert s.argsort()[::-1][:2].tolist() == [0, 2] and s[1] == s[3] == 0
    pieces = list(packing.fill(d, np.log1p(np.full(100, 3.0)), 15.0, window=40))
    assert {p[0] for p in pieces if p[3] == 0} == {0, 2}


def test_fill_looks_past_long_neighbours():
    near = [np.array([1, 2, 3, 4] * 10) for _ in range(130)]
    d = [np.array([1, 2] * 35), *near, np.array([1] + [5] * 29), *(np.full(35, 10 + i) for i in range(500))]
    pieces = list(packing.fill(d, np.ones(600), 36.0, window=100))
    assert [p[:3] for p in pieces if p[3] == 0] == [(0, 0, 70), (131, 0, 30)]


# ---- 6


def test_mixture(spark, rng):
    rows = [(i, words(rng, rng.randint(0, 60)), s) for i, s in enumerate(["a"] * 60 + ["b"] * 30 + ["c"] * 5 + ["é"] * 10 + [None] * 20)] + odd_rows(rng)[:7]
    d = docs(spark, rows).withColumns({c: F.lit(7) for c in ("size", "u", "copies", "row", "i", "skey", "salt")})
    out = mixing.mix(d).toPandas()
    assert len(out) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, goal, open_ = sum(sizes.values()), {}, set(order)
    while True:  # reshare until none is above
        left = total - sum(goal.values())
        over = {s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 3 * sizes[s]}
        if not over:
            break
        goal |= {s: 3.0 * sizes[s] for s in over}
        open_ -= over
    goal |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
    for s, g in out.groupby("source", dropna=False):
        s = None if s != s else s
        assert np.allclose(g.target, goal[s]) and (g.source_size == sizes[s]).all()
        left = g[(g["size"] > 0) & (g.copies == int(goal[s] / sizes[s]) if sizes[s] else g.copies < 0)]
        assert abs(g.taken.sum() - goal[s]) <= (left["size"].min() if len(left) else 1e-6)
    assert (out.taken <= 3 * out["size"]).all()
    again = mixing.mix(d).toPandas()
    assert sorted(map(str, out.itertuples(index=False))) == sorted(map(str, again.itertuples(index=False)))
    many = mixing.repeat(d)
    assert many.columns == d.columns and many.count() == out.copies.sum()
    assert mixing.mix(d.where("false")).count() == 0 and mixing.mix(d.where("doc_id = 30")).count() == 1


def plain_mix(rows, f, want):
    """Which (u, size) a share f takes of a source, for `want` words: two passes by rank, then three nearest."""
    ranked = sorted((u / (1 - u) / (f / (1 - f)), u, n) for u, n in rows if n)
    taken, rest = set(), want
    for _ in range(2):
        run, limit = 0, rest
        for odds, u, n in ranked:
            if u not in taken and n <= limit:
                run += n
                if run > limit:
                    break
                taken.add(u)
                rest -= n
    for _ in range(3):
        near = [(abs(n - rest), odds, u, n) for odds, u, n in ranked if u not in taken and abs(n - rest) < rest]
        if near:
            *_, u, n = min(near)
            taken.add(u)
            rest -= n
    return taken


def test_a_mix_is_the_plain_ones(spark, rng):
    """Null and repeated ids, and sizes of which many are longer than what remains."""
    rows = [(rng.choice([i, i, None, 7]), words(rng, rng.choice([1, 3, 40, 41, 400, 900])), s) for i, s in enumerate(["a"] * 150 + ["b"] * 90 + ["c"] * 60)]
    rows += [(None, "the same words", "a")] * 30
    d = docs(spark, rows)
    out = mixing.mix(d).toPandas()
    drawn = mixing._drawn(d).toPandas()
    assert len(out) == len(drawn) == len(rows) and drawn.u.nunique() == len(rows)
    for s, g in out.groupby("source"):
        total, goal = g["size"].sum(), g.target.iloc[0]
        f = goal / total - goal // total
        mine = drawn[drawn.source == s]
        taken = plain_mix(list(zip(mine.u, mine["size"])), f, goal - goal // total * total)
        want = Counter((None if i != i else i, k, int(goal // total) + (u in taken)) for i, k, u in zip(mine.doc_id, mine["size"], mine.u))
        assert Counter((None if i != i else i, k, c) for i, k, c in zip(g.doc_id, g["size"], g.copies)) == want
        assert abs(g.taken.sum() - goal) <= 20
    many = mixing.repeat(d)
    assert sorted(Counter(r.source for r in many.collect()).items()) == sorted(out.groupby("source").copies.sum().items())


# ---- 7, 9


def toxic_rows(rng, n):
    bad = ["idiotic", "moronic", "trashface"]
    rows = []
    for i in range(n):
        w = words(rng, rng.randint(20, 200)).split()
        label = int(rng.random() < 0.3)
        for _ in range(3 * label):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w), label))
    return rows


def test_toxicity(spark, rng):
    rows = toxic_rows(rng, 400)
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(d.drop("toxic"), d.drop("text"), fold=0)
    out = toxicity.score(d.withColumn("_score", F.lit("x")), model).toPandas()
    held = out[[zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id]]
    assert ((held._score >= 0.5) == (held.toxic == 1)).mean() > 0.95
    spelt = spark.createDataFrame([(1, "w1 w2 w3 idiotics moronical w4 w5"), (2, "w1 w2 w3 w4 w9 w5"), (3, None), (4, ""), (5, "!!")], "doc_id long, text string")
    s = {r.doc_id: r._score for r in toxicity.score(spelt, model).collect()}
    assert s[1] > 0.5 > max(s[2], s[3], s[4], s[5])
    assert toxicity.score(spelt.where("false"), model).count() == 0
    none = toxicity.train(spelt, spark.createDataFrame([(1, None)], "doc_id long, toxic int"))
    assert {round(r._score, 3) for r in toxicity.score(spelt, none).collect()} == {0.0}


def test_one_very_long_text_costs_no_class(spark, rng):
    """Texts of half the bound come last in a sample, wherever their hash puts them."""
    rows = toxic_rows(rng, 60)
    long = {label: [i for i, _, x in rows if x == label][:3] for label in (0, 1)}
    rows = [(i, t + " word" * 1_800_000 if i in long[label] else t, label) for i, t, label in rows]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(d.drop("toxic"), d.drop("text"))
    assert model.value[1] > -20
    found = {r.doc_id: r._score for r in toxicity.score(d, model).collect()}
    assert sum((found[i] >= 0.5) == bool(label) for i, _, label in rows) >= 57
    graded = quality.train(d.drop("toxic"), d.drop("text"), "toxic")
    assert graded.value["levels"] == [0, 1] and len(graded.value["cuts"]) == 1
    with pytest.raises(Exception, match="has over"):
        toxicity.train(d.where("length(text) > 1000000 or toxic = 0").drop("toxic"), d.where("length(text) > 1000000 or toxic = 0").drop("text"))


def test_too_many_grades_are_an_error(spark):
    d = spark.range(150).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.col("id").cast("int").alias("quality"))
    with pytest.raises(ValueError, match="grades"):
        quality.train(d.drop("quality"), d.drop("text"))


def plain_toxicity(text, weights, bias):
    """The worst window of six words, of the means of their n-grams' weights."""
    each = []
    for w in toxicity.WORDS.findall((text or "").lower()):
        b = b"<" + w.encode() + b">"
        g = [b] + [b[i : i + n] for n in (3, 4, 5) for i in range(len(b) - n + 1)]
        each.append(sum(float(weights[zlib.crc32(x) % toxicity.BUCKETS]) for x in g) / len(g))
    runs = [each[i : i + 6] for i in range(max(1, len(each) - 5))] if each else []
    z = max(sum(r) / len(r) for r in runs) + bias if runs else min(bias, -20.0)
    return 1 / (1 + np.exp(-z))


def test_scores_are_the_plain_ones(spark, rng):
    """Toxicity and quality against a computation of a document at a time; repeated rows, ties, very long texts."""
    rows = toxic_rows(rng, 80) + [(900, None, 0), (901, "", 1), (902, words(rng, 30_000), 0), (903, "x y", 0), (903, "x y", 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    weights, bias = (model := toxicity.train(d.drop("toxic"), d.drop("text"))).value
    for r in toxicity.score(d, model).collect():
        assert abs(r._score - plain_toxicity(r.text, weights, bias)) < 1e-6
    m = (model := quality.train(d.drop("toxic"), d.drop("text"), "toxic")).value
    for r in quality.score(d, model).collect():
        slots, values = quality.features(r.text or "", {})
        z = sum(float(m["w"][s]) * float(v) for s, v in zip(slots, values))
        tail = 1 / (1 + np.exp(-(z - m["cuts"][0])))
        assert abs(r._tail - tail) < 1e-5 and abs(r._expected - tail) < 1e-5


def test_ordinal_quality(spark, rng):
    rows = []
    for i in range(450):
        grade = i % 3
        w = words(rng, 60).split()
        for _ in range(25 * (2 - grade)):
            w[rng.randrange(len(w))] = "SPAM!!"
        rows.append((i, " ".join(w), grade))
    d = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.train(d.drop("quality"), d.drop("text"), fold=0)
    cuts = model.value["cuts"]
    assert len(cuts) == 2 and cuts[0] < cuts[1]
    out = quality.score(d.withColumn("_tail", F.lit(1)), model).toPandas()
    held = out[[zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id]]
    assert (held._expected.round() == held.quality).mean() > 0.8
    assert ((held._tail >= 0) & (held._tail <= 1)).all()
    means = held.groupby("quality")._expected.mean()
    assert means[0] < means[1] < means[2]
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "x")], "doc_id long, text string")
    assert quality.score(odd, model).count() == 3 and quality.score(odd.where("false"), model).count() == 0
    none = quality.train(odd, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r._expected for r in quality.score(odd, none).collect()} == {0.0}


# ---- 8


def test_fingerprints(spark, rng):
    rows = [(i, words(rng, rng.randint(0, 120))) for i in range(40)] + [(100, None), (101, ""), (102, "short"), (103, "äöü" * 40), (104, "a" * 9000), (105, words(rng, 9000)), (106, rng.choice(["x", "y"]) * 3), (107, "🙂" * 30)]
    rows.append((200, rows[5][1]))
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bucket", F.lit(1)).withColumn("ghost", F.lit(True))
    out = {r.doc_id: r for r in syncmers.fingerprints(d).collect()}
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    edited = {}
    for k, (i, t) in enumerate(order):
        c = len(t) // 3
        edited[i] = t[: len(t) - c] + order[(k + 1) % len(order)][1][:c]
    direct = spark.createDataFrame([(i, t) for i, t in edited.items()], "i long, t string").select("i", syncmers.text_of(syncmers.lowest(syncmers.anchors(F.col("t").cast("binary")))).alias("f"))
    direct = {r.i: r.f for r in direct.collect()}
    for i, t in order:
        r = out[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited[i].encode()).hexdigest() and r.edited_fingerprint == direct[i], i
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if t == edited[i]:
            assert r.near_edited == 1
    assert out[200].fingerprint == out[5].fingerprint
    assert syncmers.fingerprints(d.where("false")).count() == 0
    one = syncmers.fingerprints(d.where("doc_id = 102")).first()
    assert one.edited_sha256 == hashlib.sha256(b"shors").hexdigest() and one.near_next == 1


def test_closed_syncmers(spark, rng):
    """Against the definition: the least of a k-mer's inner hashes stands first or last."""
    text = words(rng, 900).encode()
    k, s = syncmers.K, syncmers.S
    parts = spark.createDataFrame([(i, bytearray(text[i : i + s])) for i in range(len(text) - s + 1)], "i int, b binary")
    h = [r.h for r in parts.orderBy("i").select(F.xxhash64("b").alias("h")).collect()]
    want = [i for i in range(len(text) - k + 1) if min(h[i : i + k - s + 1]) in (h[i], h[i + k - s])]
    got = spark.createDataFrame([(bytearray(text),)], "b binary").select(syncmers.anchors(F.col("b")).alias("a")).first().a
    assert [x & 0xFFFFFFFF for x in got] == want


def test_all_anchors_and_their_places(spark, rng):
    parts = [words(rng, 300, 10**6) + " " for _ in range(6)]
    shared = words(rng, 60, 10**6)
    rows = [(9, "".join(parts)), (8, "".join(parts[3:] + parts[:3])), (7, words(rng, 3000, 10**6) + shared), (6, shared + words(rng, 2000, 10**6)), (5, words(rng, 500, 10**6))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in syncmers.fingerprints(d).collect()}
    every = {r.doc_id: r.a for r in d.select("doc_id", syncmers.anchors(F.col("text").cast("binary")).alias("a")).collect()}
    place = {}
    for i, t in rows:
        assert out[i].fingerprint.split() == [f"{x:X}" for x in sorted(every[i])] and len(every[i]) > len(t) / 8
        place[i] = {x >> 32: x & 0xFFFFFFFF for x in sorted(every[i], reverse=True)}
    for i in (9, 8, 7, 6):
        a, b = place[i], place[i - 1]
        agree = Counter(b[h] - a[h] for h in a if h in b)
        assert abs(out[i].near_next - max(agree.values(), default=0) / len(a.keys() | b.keys())) < 1e-9
    assert 0.4 < out[9].near_next < 0.6 and 0 < out[7].near_next < 0.05 and out[6].near_next == 0


@pytest.mark.parametrize("few", [0, 64, 10**6])
def test_likeness_is_the_plain_one(spark, rng, monkeypatch, few):
    """Repeated hashes, one offset or several, many common hashes or few, empty texts; all ways give the same."""
    monkeypatch.setattr(syncmers, "FEW", few)
    rows = []
    for _ in range(60):
        a = [(rng.randint(0, rng.choice([5, 300])), i) for i in range(rng.randint(0, 150))]
        cut, shift = rng.randint(0, 150), rng.choice([0, 0, 7, 40])
        b = [(h if rng.random() < 0.8 else rng.randint(0, 300), i + shift * (i > cut)) for h, i in a] if rng.random() < 0.8 else [(rng.randint(0, 300), i) for i in range(20)]
        rows.append(tuple(sorted(h << 32 | i for h, i in x) for x in (a, b)))
    d = spark.createDataFrame(rows, "a array<long>, b array<long>")
    for r in d.select("a", "b", syncmers.likeness(syncmers.firsts(F.col("a")), syncmers.firsts(F.col("b"))).alias("x")).collect():
        a, b = ({v >> 32: v & 0xFFFFFFFF for v in sorted(s, reverse=True)} for s in (r.a, r.b))
        agree = Counter(b[h] - a[h] for h in a if h in b)
        assert abs(r.x - (max(agree.values(), default=0) / len(a.keys() | b.keys()) if a or b else 1)) < 1e-9


# ---- 10


def plain_spans(rows):
    first, hit = {}, {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        parts, found = sentences.spans(t or "")
        assert "".join(parts) == (t or "")
        for a, n in found:
            key = " ".join("".join(parts[a : a + n]).split())
            if first.setdefault(key, (i, a)) != (i, a):
                hit.setdefault(i, set()).update(range(a, a + n))
    return {i: "".join(p for j, p in enumerate(sentences.spans(t or "")[0]) if j not in hit.get(i, ())) for i, t in rows}


def test_sentence_spans(spark, rng):
    stock = [words(rng, rng.randint(1, 30)).capitalize() + "." for _ in range(60)]
    rows = []
    for i in range(80):
        body = [words(rng, rng.randint(2, 30)) + rng.choice([".", "!", "?\n"]) for _ in range(rng.randint(0, 8))]
        at = rng.randint(0, len(body))
        k = rng.randint(0, 50)
        body[at:at] = stock[k : k + rng.randint(0, 8)]
        rows.append((i, rng.choice([" ", "  "]).join(body)))
    rows += [(100, None), (101, ""), (102, " . . "), (103, rows[3][1]), (None, rows[4][1]), (104, words(rng, 60) + "."), (105, "A b c. " * 40)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("at", "hit", "did", "th", "row", "_removed")})
    out = sentences.dedup_spans(d)
    assert {r.doc_id: r.text or "" for r in out.collect()} == plain_spans(rows)
    assert sentences.dedup_spans(d.where("false")).count() == 0


def every_run(text):
    """Every run of several sentences with 24 words, and sentences of 40, enumerated without spans()."""
    parts = sentences.SENTENCE.findall(text)
    n = [len(p.split()) for p in parts]
    runs = [(a, b) for a in range(len(n)) for b in range(a + 1, len(n) + 1) if n[a] and n[b - 1]]
    return parts, [(a, b) for a, b in runs if sum(n[a:b]) >= 24 and sum(x > 0 for x in n[a:b]) >= 2 or b == a + 1 and n[a] >= 40]


def test_every_repeated_run_goes(spark, rng):
    sizes = [[23, 11, 33, 8, 15], [20, 30, 5, 5], [45, 8], [8, 45], [3, 4, 5]] + [[rng.choice([1, 3, 8, 20, 45]) for _ in range(rng.randint(1, 7))] for _ in range(30)]
    rows = []
    for k, s in enumerate(sizes):
        passage = " ".join(f"p{k}x{j} " + words(rng, n - 1, 10**6) + "." if n > 1 else f"p{k}x{j}." for j, n in enumerate(s))
        rows += [(2 * k, words(rng, 30, 10**6) + ". " + passage), (2 * k + 1, words(rng, 9, 10**6) + ". " + passage + " " + words(rng, 12, 10**6) + ".")]
    first, want = {}, {}
    for i, t in rows:
        parts, runs = every_run(t)
        gone = set()
        for a, b in runs:
            if first.setdefault(" ".join("".join(parts[a:b]).split()), (i, a)) != (i, a):
                gone.update(range(a, b))
        want[i] = "".join(p for j, p in enumerate(parts) if j not in gone)
    out = sentences.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.text for r in out.collect()} == want
    assert all(len(want[i].split()) == 21 for i in (1, 3, 5, 7))


# ---- the pipeline


def test_pipeline(spark, rng, tmp_path):
    from questrel.llm import queries

    import corpus_pipeline as c

    rows = [(i, t, f"s{i % 4}") for i, t, _ in toxic_rows(rng, 60)]
    rows += [(100 + i, rows[i][1], "s1") for i in range(10)] + [(200, None, "s0"), (201, "", None)]
    sf = f"file://{tmp_path}"
    docs(spark, rows).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, int("idiotic" in t or "moronic" in t or "trashface" in t)) for i, t, _ in rows[:60]], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    d, names = spark.read.parquet(f"{sf}/documents.parquet"), [f.name for f in spark.read.parquet(f"{sf}/documents.parquet").schema]
    assert [n for n, _ in c.STAGES] == ["toxicity", "near_duplicates", "repeated_spans", "mixture", "packing"]
    sizes, given = [], d
    key = lambda r: (r.doc_id, r.text)
    weights, bias = toxicity.train(d, spark.read.parquet(f"{sf}/labels.parquet")).value
    for name, stage in c.STAGES:
        given, d = d, common.saved(stage(spark, d, sf), name)
        sizes.append(d.count())
        before, after = given.collect(), d.collect()
        if name != "packing":
            assert d.columns == names
        if name == "toxicity":
            assert Counter(map(key, after)) == Counter(key(r) for r in before if plain_toxicity(r.text, weights, bias) < 0.5)
        elif name == "near_duplicates":
            known = {}
            seqs = {r.doc_id: minhash.hashed(r.text, known).astype(np.uint32) for r in before}
            links = [(i, j) for i in seqs for j in seqs if i < j and len(seqs[i]) and len(seqs[j]) and minhash.alike(seqs[i], seqs[j])]
            top = least_reachable(list(seqs), links)
            assert Counter(map(key, after)) == Counter(key(r) for r in before if top[r.doc_id] == r.doc_id)
        elif name == "repeated_spans":
            cut = plain_spans([(r.doc_id, r.text) for r in before])
            assert {r.doc_id: r.text or "" for r in after} == cut
        elif name == "mixture":
            taken = {r.doc_id: r.copies for r in mixing.mix(given).collect()}
            assert Counter(r.doc_id for r in after) == Counter({i: n for i, n in taken.items() if n})
        else:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(packing.tokenizer_path())
            rows = [(r.doc_id, r.text) for r in before]
            check_pieces(d.toPandas(), rows, {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in rows})
    assert sizes[0] < 72 and sizes[1] < sizes[0] and sizes[2] == sizes[1]
    out = c.run(spark, sf).toPandas()
    assert len(out) == sizes[-1] and set(out.columns) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
    assert set(queries.SQL) <= set(queries.QUERIES) and len({q.split("_")[0] for q in queries.QUERIES}) == 10
